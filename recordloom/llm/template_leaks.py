"""Benchmark decontamination: template canonicalisation.

Numbers, names and units become typed placeholders, so a question and the same question with other values have the same template.
Windows of ``WINDOW`` template tokens of benchmark items are hash-joined with those of the documents.  Each place where windows of an
item line up with a document (same distance between the two positions) is one alignment; its slots must be consistent: a
value of the item, for a number with its unit, stands for itself or for the value that it has in most of its places in the document.
Windows that hold another value do not count; the other windows of the alignment do.  A document leaks an item if consistent windows
hold at least ``COVERAGE`` of the item's windows.

    number  digits, with separators inside         name  a run of capitalised words, at the start of sentences too; a first
    unit    one of ``UNITS`` right after a number        word that often begins sentences (``STARTERS``) is left out of it
    other tokens stand for themselves, in lower case

An item of fewer than ``WINDOW`` tokens is one window, met word for word: all values must be the same.

Only DataFrame functions are used: regular expressions, array functions, joins and aggregates.

Scale.  Windows are made inside the row and met by a hash join with the benchmark's windows, which are broadcast only if counted to
be few (else the join is shuffled and adaptive execution splits a hot window).  What is left of a document after that join is its
matches; slot values are read again only for documents that already reach the coverage, and only for items with slots.

Results.  One row per leaked (document, item): ``doc_id``, ``text_key`` (60 bits of the text's md5, tells repeated ids apart), ``item_id``,
``n_windows``, ``n_matched``, ``coverage``.  Null and empty texts leak nothing; very long texts are read whole; empty tables give no rows.
Items whose windows all have fewer than ``LITERALS`` literal tokens say too little and match nothing.  Of two values that a slot has equally
often neither counts, but for the item's own.  Repeated document rows give one row; items with equal text each give their own.  Null ids
are kept as null.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import side, stored

WINDOW, COVERAGE, LITERALS = 5, 0.5, 2

# Units of measure that may follow a number.
UNITS = (
    "mm cm dm m km in ft yd mi mg g kg t oz lb lbs ml cl dl l s sec min h hr hrs ms kb mb gb tb hz khz mhz ghz w kw kwh v a "
    "seconds minutes hours days weeks months years meters metres kilometers kilometres miles feet inches grams kilograms pounds "
    "liters litres dollars euros cents percent degrees"
).split()

# English words that begin sentences and are no names.
STARTERS = (
    "a an the this that these those some any each every all both no not one two i you he she it we they my your his her its our "
    "their who whom whose what which when where why how if then else so because since while until after before during for from "
    "to in on at by of off with without within about above below under over between through against into is are was were be been "
    "am do does did has have had can could will would shall should may might must and or but nor yet as than there here let "
    "suppose assume given find calculate compute solve determine explain describe choose name list"
).split()

# A run of capitalised words; a number with the word right after it; another word.  Repeated groups are possessive: nothing after them is ever
# met by giving some back, and a greedy group takes a frame of the stack per round, so that a run of 2,000 words ends its executor.
_WORDS = r"\p{Lu}[\p{Ll}\p{M}]+(?:[ \n]\p{Lu}[\p{Ll}\p{M}]+)*+|\p{N}+(?:[.,]\p{N}+)*+(?: ?[\p{L}\p{M}]+)?|[\p{L}\p{M}]+"
_CAPITAL = r"^\p{Lu}[\p{Ll}\p{M}]"
NAME, UNIT, NUMBER, _LITERAL = "\u0001", "\u0002", "\u0003", "\u0004"


def _named(words: Column) -> Column:
    """Tokens of a run of words: a capitalised run is one name, but for a first word that begins sentences."""
    plain = F.lower(F.translate(words, "\n", " "))
    head = F.substring_index(plain, " ", 1)
    rest = F.substring(plain, F.length(head) + 2, F.length(plain))
    name = F.concat(F.lit(NAME), plain)
    split = F.when(rest == "", F.array(head)).otherwise(F.array(head, F.concat(F.lit(NAME), rest)))
    return F.when(~words.rlike(_CAPITAL), F.array(plain)).when(head.isin(STARTERS), split).otherwise(F.array(name))


def _measured(found: Column) -> Column:
    """Tokens of a number and the word right after it."""
    digits = F.array(F.concat(F.lit(NUMBER), F.translate(F.regexp_extract(found, r"^[\p{N}.,]+", 0), ".,", "")))
    word = F.regexp_extract(found, r"[\p{L}\p{M}]+$", 0)
    unit = F.array(F.concat(F.lit(UNIT), F.lower(word)))
    return F.when(word == "", digits).when(F.lower(word).isin(UNITS), F.concat(digits, unit)).otherwise(F.concat(digits, _named(word)))


def filled(text: Column) -> Column:
    """Tokens of a text: names, units and numbers are their placeholder character and value."""
    return F.flatten(F.transform(
        F.regexp_extract_all(text, F.lit(_WORDS), 0), lambda t: F.when(t.rlike(r"^\p{N}"), _measured(t)).otherwise(_named(t))))


def template(tokens: Column) -> Column:
    """Template tokens: of every name, unit and number only the placeholder."""
    return F.transform(tokens, lambda t: F.when(t < _LITERAL, F.substring(t, 1, 1)).otherwise(t))


def slot_keys(tokens: Column) -> Column:
    """What makes two slots the same: the value, for a number with its unit."""
    def key(token: Column, place: Column) -> Column:
        after = F.get(tokens, place + 1)
        return F.when(token.startswith(NUMBER) & after.startswith(UNIT), F.concat(token, after)).otherwise(token)

    return F.transform(tokens, key)


def text_key(text: Column) -> Column:
    """60 bits of the text's md5: tells texts with one id apart."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _windows(tokens: str, size: int) -> Column:
    """A hash for each run of ``size`` tokens, in order; none for fewer tokens."""
    count = F.size(tokens) - size + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(tokens, i, size))))


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, item_id, at, window, values, n_windows): the windows that say enough, with their slot values by place.

    Two items with the same id, or none, are told apart by ``item``.
    """
    rows = benchmark.filter(F.col("text").isNotNull()).select(
        F.xxhash64("item_id", "text").alias("item"), "item_id", filled(F.col("text")).alias("values")).distinct()
    rows = rows.withColumns({"tokens": template(F.col("values")), "keys": slot_keys(F.col("values"))})
    long = rows.filter(F.size("tokens") >= size).select("*", F.posexplode(_windows("tokens", size)).alias("at", "window"))
    short = rows.filter(F.size("tokens") < size).select("*", F.lit(0).alias("at"), F.xxhash64("values").alias("window"))
    rows = long.unionByName(short).withColumn("own", F.slice("tokens", F.col("at") + 1, size))
    rows = rows.filter(F.size(F.filter("own", lambda t: t >= _LITERAL)) >= LITERALS)
    return rows.select(
        "item", "item_id", "at", "window", F.size("own").alias("size"),
        F.slice("values", F.col("at") + 1, size).alias("item_values"), F.slice("keys", F.col("at") + 1, size).alias("item_keys"),
        ((F.size("own") == size) & F.exists("own", lambda t: t < _LITERAL)).alias("has_slots"))


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """Leaked (document, item) pairs; see the module."""
    docs = docs.filter(F.col("text").isNotNull()).select(
        F.col("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", text_key(F.col("text")))
    items = stored(item_windows(benchmark, size), "items")
    totals = items.groupBy("item", "item_id").agg(
        F.count(F.lit(1)).alias("n_windows"), F.max("has_slots").alias("item_has_slots"))
    totals = stored(totals, "totals")

    short = sorted(r[0] for r in items.filter(F.col("size") < size).select("size").distinct().collect())  # fewer than a window's tokens
    placed = docs.select("doc_id", "text_key", filled(F.col("text")).alias("values")).withColumn("tokens", template(F.col("values")))
    windows = [_windows("tokens", size), *[_windows("values", n) for n in short]]
    windows = F.concat(*[F.coalesce(w, F.array().cast("array<bigint>")) for w in windows])
    placed = placed.select("doc_id", "text_key", F.explode(windows).alias("window"))
    met = placed.join(side(items.select("item", "at", "window")), "window")
    pairs = met.groupBy("doc_id", "text_key", "item", "at").agg(F.count(F.lit(1)).alias("_n")).groupBy(
        "doc_id", "text_key", "item").agg(F.count(F.lit(1)).alias("n_matched"))
    pairs = pairs.join(side(totals), "item").filter(F.col("n_matched") >= coverage * F.col("n_windows"))
    pairs = stored(pairs, "pairs")

    shape = ["doc_id", "text_key", "item_id", "n_windows", "n_matched"]
    sure = pairs.filter("not item_has_slots").select(*shape)
    asked = pairs.filter("item_has_slots").select("doc_id", "text_key", "item", "n_windows")
    checked = _consistent(docs, stored(asked, "asked"), items, size).join(
        side(totals.select("item", "item_id")), "item").filter(F.col("n_matched") >= coverage * F.col("n_windows")).select(*shape)
    return sure.unionByName(checked).withColumn("coverage", F.col("n_matched") / F.col("n_windows"))


def _consistent(docs: DataFrame, asked: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, item, n_windows, n_matched) of asked pairs, counting consistent windows only."""
    keys = asked.select(F.col("text_key").alias("key")).distinct()
    again = docs.join(side(keys), F.col("text_key") == F.col("key"), "left_semi").dropDuplicates(["doc_id", "text_key"]).select(
        "doc_id", "text_key", filled(F.col("text")).alias("values")).withColumn("tokens", template(F.col("values")))
    again = again.select("doc_id", "text_key", "values", F.posexplode(_windows("tokens", size)).alias("doc_at", "window"))
    met = again.join(side(items), "window").select(
        "doc_id", "text_key", "item", "at", (F.col("doc_at") - F.col("at")).alias("shift"),
        "item_values", "item_keys", F.slice("values", F.col("doc_at") + 1, size).alias("doc_values"))
    wanted = asked.withColumnsRenamed({"doc_id": "a_doc", "text_key": "a_key", "item": "a_item"})
    met = met.join(
        side(wanted), F.col("doc_id").eqNullSafe(F.col("a_doc")) & (F.col("text_key") == F.col("a_key")) & (F.col("item") == F.col("a_item")))
    met = stored(met, "met")
    where = ["doc_id", "text_key", "item", "n_windows", "shift"]
    slots = F.filter(
        F.transform(F.arrays_zip("item_values", "item_keys", "doc_values"), lambda p, i: F.struct(
            (F.col("at") + i).alias("place"), p["item_values"].alias("item_value"), p["item_keys"].alias("item_key"),
            p["doc_values"].alias("doc_value"))),
        lambda p: p["item_value"] < _LITERAL)
    slots = met.select(*where, "at", F.explode(slots).alias("slot")).select(*where, "at", "slot.*")
    # windows overlap: a place counts once
    places = slots.select(*where, "place", "item_key", "item_value", "doc_value").distinct().groupBy(
        *where, "item_key", "item_value", "doc_value").agg(F.count(F.lit(1)).alias("n"))
    stands = places.groupBy(*where, "item_key", "item_value").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("doc_value", "n")).alias("seen"))
    odd = stands.filter(F.size("seen") > 1).select(*where, "item_key", F.explode(F.filter(
        "seen", lambda v: (v["doc_value"] != F.col("item_value")) & (2 * v["n"] <= F.col("total")))["doc_value"]).alias("doc_value"))

    def equal(names: list[str]) -> list[Column]:
        return [F.col(f"m.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]

    broken = slots.alias("m").join(odd.alias("b"), equal([*where, "item_key", "doc_value"]), "left_semi").select(*where, "at").distinct()
    good = met.alias("m").join(broken.alias("b"), equal([*where, "at"]), "left_anti")
    return good.groupBy("doc_id", "text_key", "item", "n_windows", "at").agg(F.count(F.lit(1)).alias("_n")).groupBy(
        "doc_id", "text_key", "item", "n_windows").agg(F.count(F.lit(1)).alias("n_matched"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that leak an item."""
    found = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_leak"), F.col("text_key").alias("_key")).distinct()
    found = side(stored(found, "leaks"))
    same = docs["doc_id"].eqNullSafe(found["_leak"]) & (text_key(docs["text"].cast("string")) == found["_key"])
    return docs.join(found, same, "left_anti")

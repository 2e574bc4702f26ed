"""Registered queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import (
    compact_windows, forest_join, language_backoff, pair_counts, permutation_index, pfor_files, quality_trees, separator_scan, site_templates,
    spectrum_slicing, temperature_mix, template_leaks, word_table,
)
from recordloom.llm.common import table

# Where the public tokenizers lie is a parameter of the operators; the queries take the installed files.
TOKENIZER = "word_bpe_49k.json"
PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_join.ngram_join(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_backoff.identify(docs, language_backoff.fit(docs))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_trees.score(docs, quality_trees.fit(docs, table(spark, sf_dir, "labels")))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.extract(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separator_scan.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temperature_mix.mix(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum_slicing.whiten(table(spark, sf_dir, "embeddings"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table.digests(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_counts.digests(table(spark, sf_dir, "documents"), tokenizer_path(BYTES), tokenizer_path(PIECES))


# The mixture with its default parameters: bisected exponent, whole epochs, and the rest by the order of the last epoch.
_MIX_SQL = """
WITH RECURSIVE counted AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0)::BIGINT AS n,
         coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS key FROM documents
), sources AS (
  SELECT source, sum(n)::BIGINT AS tokens FROM counted GROUP BY source
), ends AS (
  SELECT max(tokens)::DOUBLE / min(tokens) AS ratio FROM sources WHERE tokens > 0
), bisect(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN pow(ratio, 1 - (low + high) / 2) <= 2.0 THEN low ELSE (low + high) / 2 END,
         CASE WHEN pow(ratio, 1 - (low + high) / 2) <= 2.0 THEN (low + high) / 2 ELSE high END
  FROM bisect, ends WHERE step < 60
), edge AS (
  SELECT high AS e FROM bisect WHERE step = 60
), weights AS (
  SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE, e) / sum(CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE, e) END) OVER () ELSE 0 END AS w
  FROM sources, edge
), targets AS (
  SELECT source, tokens, round(w * max(CASE WHEN w > 0 THEN tokens / w END) OVER ())::BIGINT AS target FROM weights
), plan AS (
  SELECT source, tokens, target, CASE WHEN tokens > 0 THEN target // tokens ELSE 1 END AS epochs,
         CASE WHEN tokens > 0 THEN target - (target // tokens) * tokens ELSE 0 END AS rest,
         CASE WHEN tokens > 0 THEN target / tokens ELSE 1.0 END AS reads
  FROM targets
), placed AS (
  SELECT d.doc_id, d.source, d.n, d.key, p.epochs, p.rest, p.reads, md5(p.epochs || '|' || d.key) AS digest
  FROM counted d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
), filled AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar FROM placed
), cuts AS (
  SELECT source, max(digest) AS last FROM filled WHERE rest > 0 AND sofar < rest GROUP BY source
), times AS (
  SELECT p.*, p.epochs + CASE WHEN p.digest <= c.last THEN 1 ELSE 0 END AS times
  FROM placed p LEFT JOIN cuts c ON p.source IS NOT DISTINCT FROM c.source
), read AS (
  SELECT doc_id, source, n, key, reads, unnest(range(times)) AS epoch FROM times
), hexed AS (
  SELECT *, substr(md5(epoch || '|' || key), 1, 3) AS h FROM read
), blocks AS (
  SELECT *, ((strpos('0123456789abcdef', substr(h, 1, 1)) - 1) * 256 + (strpos('0123456789abcdef', substr(h, 2, 1)) - 1) * 16
             + strpos('0123456789abcdef', substr(h, 3, 1)) - 1)::BIGINT AS block FROM hexed
)
SELECT doc_id, source, n AS n_tokens, epoch, block, least((epoch + (block + 0.5::DOUBLE) / 4096) / greatest(reads, 1e-9), 1.0) AS turn FROM blocks
"""


def _words_sql(words: str) -> str:
    """Tokens of a run of words, as ``template_leaks`` has them."""
    plain = f"lower(translate({words}, chr(10), ' '))"
    head = f"split_part({plain}, ' ', 1)"
    rest = f"substr({plain}, length({head}) + 2)"
    starters = ", ".join(f"'{w}'" for w in template_leaks.STARTERS)
    return (
        f"CASE WHEN NOT regexp_matches({words}, '^\\p{{Lu}}[\\p{{Ll}}\\p{{M}}]') THEN [{plain}] "
        f"WHEN {head} NOT IN ({starters}) THEN [chr(1) || {plain}] "
        f"WHEN {rest} = '' THEN [{head}] ELSE [{head}, chr(1) || {rest}] END"
    )


def _filled_sql(text: str) -> str:
    """Tokens of a text with their values."""
    number = "chr(3) || translate(regexp_extract(t, '^[\\p{N}.,]+'), '.,', '')"
    word = "regexp_extract(t, '[\\p{L}\\p{M}]+$')"
    units = ", ".join(f"'{u}'" for u in template_leaks.UNITS)
    return (
        f"flatten(list_transform(regexp_extract_all({text}, '"
        "\\p{Lu}[\\p{Ll}\\p{M}]+(?:[ \\n]\\p{Lu}[\\p{Ll}\\p{M}]+)*|\\p{N}+(?:[.,]\\p{N}+)*(?: ?[\\p{L}\\p{M}]+)?|[\\p{L}\\p{M}]+"
        f"'), lambda t: CASE WHEN NOT regexp_matches(t, '^\\p{{N}}') THEN {_words_sql('t')} WHEN {word} = '' THEN [{number}] "
        f"WHEN lower({word}) IN ({units}) THEN [{number}, chr(2) || lower({word})] "
        f"ELSE list_concat([{number}], {_words_sql(word)}) END))"
    )


# Windows are compared as joined tokens; everything else as in the operator, over all documents and items.
_LEAKS_SQL = f"""
WITH d AS (
  SELECT doc_id, ('0x' || substr(md5(text), 1, 15))::BIGINT AS text_key, {_filled_sql('text')} AS v
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
), docs AS (
  SELECT *, list_transform(v, lambda t: CASE WHEN t < chr(4) THEN substr(t, 1, 1) ELSE t END) AS k FROM d
), i AS (
  SELECT row_number() OVER () AS item, item_id, {_filled_sql('text')} AS v
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), items AS (
  SELECT *, list_transform(v, lambda t: CASE WHEN t < chr(4) THEN substr(t, 1, 1) ELSE t END) AS k FROM i
), places AS (
  SELECT item, item_id, v, k, unnest(range(1, greatest(len(k) - 3, 2))) AS spot FROM items WHERE len(k) > 0
), own AS (
  SELECT item, item_id, v, spot, len(k) < 5 AS short, k[spot:spot + 4] AS tokens,
         array_to_string(CASE WHEN len(k) < 5 THEN v ELSE k[spot:spot + 4] END, '|') AS win FROM places
), good AS (
  SELECT *, NOT short AND len(list_filter(tokens, lambda t: t < chr(4))) > 0 AS slotted
  FROM own WHERE len(list_filter(tokens, lambda t: t >= chr(4))) >= 2
), totals AS (
  SELECT item, item_id, count(*) AS n_windows, bool_or(slotted) AS slotted FROM good GROUP BY item, item_id
), long AS (
  SELECT doc_id, text_key, v, k, unnest(range(1, len(k) - 3)) AS doc_spot FROM docs WHERE len(k) >= 5
), sizes AS (
  SELECT DISTINCT len(v) AS n FROM good WHERE short
), brief AS (
  SELECT doc_id, text_key, v, n, unnest(range(1, len(v) - n + 2)) AS doc_spot FROM docs, sizes WHERE len(v) >= n
), met AS (
  SELECT doc_id, text_key, item, spot, doc_spot, g.v AS item_v, w.v AS doc_v
  FROM (SELECT *, array_to_string(k[doc_spot:doc_spot + 4], '|') AS win FROM long) w JOIN (SELECT * FROM good WHERE NOT short) g USING (win)
  UNION ALL SELECT doc_id, text_key, item, spot, doc_spot, g.v, w.v
  FROM (SELECT *, array_to_string(v[doc_spot:doc_spot + n - 1], '|') AS win FROM brief) w JOIN (SELECT * FROM good WHERE short) g USING (win)
), pairs AS (
  SELECT doc_id, text_key, item, item_id, n_windows, slotted, count(DISTINCT spot) AS n_matched
  FROM met JOIN totals USING (item) GROUP BY ALL HAVING count(DISTINCT spot) >= 0.5 * n_windows
), asked AS (
  SELECT m.* FROM met m JOIN pairs p
  ON m.doc_id IS NOT DISTINCT FROM p.doc_id AND m.text_key = p.text_key AND m.item = p.item WHERE p.slotted
), spread AS (
  SELECT doc_id, text_key, item, spot, doc_spot - spot AS shift, unnest(range(5)) AS o, item_v, doc_v FROM asked
), slots AS (
  SELECT doc_id, text_key, item, spot, shift, spot + o AS place, item_v[spot + o] AS iv, doc_v[spot + shift + o] AS dv,
         item_v[spot + o] || CASE WHEN substr(item_v[spot + o], 1, 1) = chr(3) AND substr(item_v[spot + o + 1], 1, 1) = chr(2)
                                THEN item_v[spot + o + 1] ELSE '' END AS key
  FROM spread WHERE item_v[spot + o] < chr(4)
), counted AS (
  SELECT doc_id, text_key, item, shift, key, iv, dv, count(DISTINCT place) AS n FROM slots GROUP BY ALL
), odd AS (
  SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, text_key, item, shift, key) AS total FROM counted) WHERE dv <> iv AND 2 * n <= total
), broken AS (
  SELECT DISTINCT s.doc_id, s.text_key, s.item, s.shift, s.spot FROM slots s JOIN odd o
  ON s.doc_id IS NOT DISTINCT FROM o.doc_id AND s.text_key = o.text_key AND s.item = o.item AND s.shift = o.shift AND s.key = o.key AND s.dv = o.dv
), kept AS (
  SELECT doc_id, text_key, item, count(DISTINCT spot) AS n_matched FROM asked a WHERE NOT EXISTS (
    SELECT 1 FROM broken b WHERE a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.text_key = b.text_key AND a.item = b.item
    AND a.doc_spot - a.spot = b.shift AND a.spot = b.spot) GROUP BY ALL
), found AS (
  SELECT doc_id, text_key, item_id, n_windows, n_matched FROM pairs WHERE NOT slotted
  UNION ALL SELECT doc_id, text_key, item_id, n_windows, n_matched FROM kept JOIN totals USING (item) WHERE n_matched >= 0.5 * n_windows
)
SELECT *, n_matched / n_windows AS coverage FROM found
"""

QUERIES: dict[str, Query] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_language_id": op2_language_id,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_token_output": op5_token_output,
    "op6_html_text": op6_html_text,
    "op7_token_counts": op7_token_counts,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_decontamination": op9_decontamination,
    "op10_source_mix": op10_source_mix,
    "op11_whitening": op11_whitening,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {"op9_decontamination": _LEAKS_SQL, "op10_source_mix": _MIX_SQL}

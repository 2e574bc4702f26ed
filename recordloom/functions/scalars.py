"""Column functions: text, years, dates, URLs, run figures.  All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Default bounds of the decade and century buckets and the stand-in for older years.
FIRST_YEAR = -1999
LAST_YEAR = 2010
ANCIENT = "-9999"

# Authority prefixes and names used when an identifier is completed.
LIBRARY_AUTHORITY = "http://libris.kb.se/resource/auth"
LIBRARY_NAME = "Kungliga biblioteket"
VIAF_AUTHORITY = "http://viaf.org/viaf"
VIAF_NAME = "VIAF"
MUSEUM_PERIOD_AUTHORITY = "http://mis.historiska.se/rdf/period"

_WHITE = "".join(chr(code) for code in range(1, 33))


def _col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_to_null(value: ColumnLike) -> Column:
    """Value without surrounding white space and control characters; null when nothing is left."""
    trimmed = F.btrim(_col(value), F.lit(_WHITE))
    return F.nullif(trimmed, F.lit(""))


# ---- years -------------------------------------------------------------------------------

_ERA = r"^\s*([+-]?\d+)\s*(.)\.kr"
_ISO = (
    r"^([+-]?\d{1,9})(?:-(\d{1,2})(?:-(\d{1,2}))?|-(\d{3}))?"
    r"(?:t(?:\d{1,2}(?::\d{1,2}(?::\d{1,2}(?:[.,]\d+)?)?)?)?(?:z|[+-]\d{2}(?::?\d{2})?)?)?$"
)


def year_of(value: ColumnLike) -> Column:
    """Year of an ISO date, or of ``N f.kr`` (before Christ, N>0) or ``N e.kr``; else null."""
    def groups(text: Column) -> Column:
        parts = {
            "era": F.regexp_extract(text, _ERA, 2), "number": F.regexp_extract(text, _ERA, 1).try_cast("int"),
            **{
                name: F.regexp_extract(text, _ISO, place).try_cast("int")
                for place, name in enumerate(("year", "month", "day", "day_of_year"), start=1)
            },
        }
        return F.struct(text.alias("text"), *[part.alias(name) for name, part in parts.items()])

    def read(part: Column) -> Column:
        year, month, day, day_of_year = part["year"], part["month"], part["day"], part["day_of_year"]
        number = part["number"]
        by_era = (
            F.when((part["era"] == "f") & (number > 0), F.lit(1) - number)
            .when((part["era"] == "e") & (number >= 0), number)
        )
        leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
        month_days = (
            F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        )
        valid = (
            (month.isNull() | month.between(1, 12))
            & (day.isNull() | ((day >= 1) & (day <= month_days)))
            & (day_of_year.isNull() | day_of_year.between(F.lit(1), F.when(leap, 366).otherwise(365)))
        )
        return F.when(F.instr(part["text"], ".kr") > 1, by_era).when(valid, year)

    # a bare year is the usual case and needs no pattern
    bare = _col(value).try_cast("int")
    return F.coalesce(F.when(F.abs(bare) <= 999_999_999, bare), let(let(F.lower(_col(value)), groups), read))


def tidy_year(value: ColumnLike) -> Column:
    """Shorten a year text to four digits; years before -9999 become the stand-in."""
    text = _col(value)
    negative = text.startswith("-")
    return F.trim(
        F.when((F.length(text) > 5) & negative, F.lit(ANCIENT))
        .when((F.length(text) > 4) & ~negative, F.substring(text, 1, 4))
        .otherwise(text)
    )


def _step_down(year: Column, size: int) -> Column:
    return year - year % size - F.when(year < 0, size).otherwise(0)


def decade(year: ColumnLike) -> Column:
    """Decade of a year: toward zero, then one step down for negative years (-20 gives -30)."""
    return _step_down(_col(year), 10)


def century(year: ColumnLike) -> Column:
    return _step_down(_col(year), 100)


def interval_bounds(
    from_time: ColumnLike, to_time: ColumnLike, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR
) -> tuple[Column, Column]:
    """First and last year of an interval after filling, tidying and clamping to the bounds; null when not a year."""
    first = F.coalesce(_col(from_time), _col(to_time))
    last = F.coalesce(_col(to_time), _col(from_time))
    low = tidy_year(first).try_cast("int")
    high = tidy_year(last).try_cast("int")
    usable = low.isNotNull() & high.isNotNull()
    return (
        F.when(usable, F.greatest(low, F.lit(first_year))),
        F.when(usable, F.least(high, F.lit(last_year))),
    )


def decades_between(
    from_time: ColumnLike, to_time: ColumnLike, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR
) -> Column:
    """Array of ``(index, value)`` decade and century entries that an interval covers within the bounds.

    An interval within the default bounds has at most 401 steps, so the array stays small whatever the input is; give a later
    ``last_year`` for records of later years.
    """
    start, stop = interval_bounds(from_time, to_time, first_year, last_year)

    def entry(index: str, year: Column) -> Column:
        return F.struct(F.lit(index).alias("index"), year.alias("value"))

    def closing(index: str, value: Column, seen: Column, last: Column) -> Column:
        return F.when((value != seen) & (last > first_year), F.array(entry(index, value))).otherwise(
            F.array().cast("array<struct<index:string,value:int>>")
        )

    def last_or(years: Column, first: Column) -> Column:
        return F.coalesce(F.try_element_at(years, F.lit(-1)), first)

    def entries(span: Column) -> Column:
        first, last, steps, hundreds = span["first"], span["last"], span["steps"], span["hundreds"]
        return F.concat(
            F.transform(steps, lambda year: entry("decade", decade(year))),
            F.transform(hundreds, lambda year: entry("century", century(year))),
            closing("decade", decade(last), decade(last_or(steps, first)), last),
            closing("century", century(last), century(last_or(hundreds, first)), last),
        )

    def with_steps(span: Column) -> Column:
        def years(size: int) -> Column:
            return F.when(span["first"] <= span["last"], F.sequence(span["first"], span["last"], F.lit(size))).otherwise(
                F.array().cast("array<int>")
            )

        return F.struct(
            span["first"].alias("first"), span["last"].alias("last"),
            years(10).alias("steps"), years(100).alias("hundreds"),
        )

    bounds = F.struct(start.alias("first"), stop.alias("last"))
    return F.when(start.isNotNull(), let(let(bounds, with_steps), entries))


# ---- dates -------------------------------------------------------------------------------

def iso_timestamp(value: ColumnLike) -> Column:
    """Timestamp of an ISO date with optional time after ``T``; null when it is not one."""
    text = _col(value)
    shape = text.rlike(r"^\d{4,}(-\d{1,2}){0,2}(T.*)?$")
    return F.when(shape, text.try_cast("timestamp"))


def iso_day(value: ColumnLike, now: Column) -> Column:
    """``yyyy-MM-dd`` of an ISO date; null when unreadable or after ``now``."""
    moment = iso_timestamp(value)
    return F.when(moment <= now.cast("timestamp"), F.date_format(moment, "yyyy-MM-dd"))


def iso_problem(index: ColumnLike, identifier: ColumnLike, value: ColumnLike, now: Column) -> Column:
    """Message for a date that ``iso_day`` drops; null for a good one."""
    text, moment = _col(value), iso_timestamp(value)
    return F.when(
        text.isNotNull() & moment.isNull(),
        F.concat(_col(index), F.lit(" is not a date: "), text),
    ).when(
        moment > now.cast("timestamp"),
        F.concat(
            _col(index), F.lit(" of "), _col(identifier), F.lit(" lies in the future: "), text,
        ),
    )


def from_date(moment: ColumnLike, granularity: ColumnLike) -> Column:
    """Lower bound of an incremental harvest in the granularity that the source declares."""
    return F.when(
        _col(granularity) == "YYYY-MM-DDThh:mm:ssZ",
        F.date_format(F.to_utc_timestamp(_col(moment), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ).otherwise(F.date_format(_col(moment), "yyyy-MM-dd"))


def added_date(added: ColumnLike, first_index: ColumnLike, created: ColumnLike, now: Column) -> Column:
    """When a record entered the corpus: stored date, else the later of first index and creation."""
    first, made = _col(first_index), _col(created)
    return F.coalesce(
        _col(added),
        F.when(first.isNull(), now).when(made > first, made).otherwise(first),
    )


# ---- text and URIs -----------------------------------------------------------------------

def like_escape(value: ColumnLike) -> Column:
    """LIKE pattern of a term whose wildcards are ``*`` and ``?``; other characters are literal."""
    escaped = F.regexp_replace(_col(value), r"([\\%_])", r"\\$1")
    return F.translate(escaped, "*?", "%_")


def like_pattern(term: str) -> str:
    """Same rule as ``like_escape`` for a constant term."""
    out = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return out.replace("*", "%").replace("?", "_")


def escape_term(value: ColumnLike) -> Column:
    """Put a backslash before every reserved character of a term except the wildcards."""
    return F.regexp_replace(_col(value), r'([\\+\-!():^\[\]"{}~|&;/\s])', r"\\$1")


def suffix_after(value: ColumnLike, prefix: str, number: bool = False) -> Column:
    """Part after ``prefix`` (null without it); numeric form drops leading zeros when possible."""
    text = _col(value)
    rest = F.when(text.startswith(prefix), F.substr(text, F.lit(len(prefix) + 1)))
    if not number:
        return rest
    digits = F.when(rest.rlike(r"^[+-]?\d+$"), rest.try_cast("bigint").cast("string"))
    return F.coalesce(digits, rest)


def join_auth_id(authority: ColumnLike, delimiter: str, identifier: ColumnLike) -> Column:
    """Authority and identifier with exactly one added delimiter."""
    auth = _col(authority)
    head = F.when(auth.endswith(delimiter), auth).otherwise(F.concat(auth, F.lit(delimiter)))
    return F.concat(head, _col(identifier))


def authority_uri(authority: ColumnLike, identifier: ColumnLike, kind: str, own_periods: str) -> Column:
    """One URI of an authority and an identifier, by the rules for actors, periods or places."""
    auth, ident = _col(authority), _col(identifier)
    if kind == "place":
        return join_auth_id(auth, "/", ident)
    actor = (
        F.when(auth.startswith(LIBRARY_AUTHORITY), join_auth_id(auth, "/", ident))
        .when(auth == LIBRARY_NAME, join_auth_id(F.lit(LIBRARY_AUTHORITY), "/", ident))
        .when(auth == VIAF_NAME, join_auth_id(F.lit(VIAF_AUTHORITY), "/", ident))
    )
    period = F.when(auth.startswith(own_periods), auth).when(
        auth.startswith(MUSEUM_PERIOD_AUTHORITY), join_auth_id(auth, "#", ident)
    )
    if kind == "actor":
        return actor
    if kind == "period":
        return period
    if kind == "any":
        return F.when(ident.isNotNull(), F.coalesce(period, actor))
    raise ValueError(f"unknown kind of authority: {kind}")


def full_name(full: ColumnLike, first: ColumnLike, last: ColumnLike) -> Column:
    return F.coalesce(_col(full), F.concat(_col(first), F.lit(" "), _col(last)))


def query_map(query: ColumnLike) -> Column:
    """Parameters of a query string as a map: decoded, ``=`` kept in values, blanks dropped."""
    parts = F.filter(
        F.split(_col(query), "&"), lambda part: part.rlike("^[^=]*=[^=]") & (F.instr(part, "=") > 0)
    )
    pairs = F.transform(
        parts,
        lambda part: F.struct(
            F.substring_index(part, "=", 1).alias("key"),
            F.try_url_decode(
                F.regexp_replace(F.substr(part, F.instr(part, "=") + 1), "=+$", "")
            ).alias("value"),
        ),
    )
    last_wins = F.filter(
        pairs,
        lambda pair, place: ~F.exists(
            F.slice(pairs, place + 2, F.size(pairs)), lambda later: later["key"] == pair["key"]
        ),
    )
    return F.map_from_entries(last_wins)


def clean_url(url: ColumnLike) -> Column:
    return F.replace(F.replace(_col(url), F.lit(" "), F.lit("%20")), F.lit("&"), F.lit("%26"))


def without_quotes(url: ColumnLike) -> Column:
    return F.replace(_col(url), F.lit('"'), F.lit(""))


def insert_format(uri: ColumnLike, fmt: ColumnLike) -> Column:
    """Put the format before the last path segment."""
    text = _col(uri)
    head = F.regexp_extract(text, r"^(.*/)?[^/]*$", 1)
    return F.concat(head, _col(fmt), F.lit("/"), F.substr(text, F.length(head) + 1))


def path_parts(path: ColumnLike) -> Column:
    """Struct ``(path, format)`` of a request path with three or four parts; null otherwise."""
    text = _col(path)
    parts = F.split(F.regexp_replace(F.substr(text, F.lit(2)), "/+$", ""), "/")
    size = F.size(parts)
    plain = F.struct(F.array_join(parts, "/").alias("path"), F.lit(None).cast("string").alias("format"))
    named = F.struct(
        F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(3))).alias("path"),
        F.lower(F.get(parts, F.lit(2))).alias("format"),
    )
    return F.when(F.contains(text, F.lit(".")), None).when(size == 3, plain).when(size == 4, named)


def mime_of(image: ColumnLike) -> Column:
    return (
        F.when(_col(image).endswith(".gif"), "image/gif")
        .when(_col(image).endswith(".png"), "image/png")
        .otherwise("image/jpeg")
    )


# ---- run figures -------------------------------------------------------------------------

def speed(n: ColumnLike, millis: ColumnLike) -> Column:
    """Records per second with one decimal."""
    seconds = F.greatest(F.floor(_col(millis) / 1000), F.lit(1))
    return F.floor(_col(n) * 10.0 / seconds + 0.5) / 10.0


def remaining(millis: ColumnLike, n: ColumnLike, full: ColumnLike) -> Column:
    """Estimated milliseconds left; -1 when nothing is known."""
    done, total, spent = _col(n), _col(full), _col(millis)
    estimate = F.floor(total * spent * F.lit(1.0) / done + 0.5).cast("bigint") - spent
    return F.when((total > 0) & (done > 0), estimate).otherwise(F.lit(-1).cast("bigint"))


def duration(millis: ColumnLike) -> Column:
    seconds = F.floor(_col(millis) / 1000).cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(seconds / 3600).cast("bigint"),
        F.floor(seconds % 3600 / 60).cast("bigint"),
        seconds % 60,
    )


def version_numbers(version: ColumnLike) -> Column:
    """Numeric segments of a version without trailing zeros; null when it is not a version."""
    text = _col(version)
    stated = F.when(text.rlike(r"^\d+(\.\d+)*\.*$") & F.contains(text, F.lit(".")), F.rtrim(text, F.lit(".")))
    # zeros at the end say nothing: 1.2.0 is 1.2
    short = F.regexp_replace(stated, r"(\.0+)+$", "")
    return F.transform(F.split(short, r"\."), lambda part: part.try_cast("int"))


def rule_set(version: ColumnLike) -> Column:
    """Extraction rules for a record version; null means the record is rejected.

    1.11 came out before 1.2.0, so above 1.0 only equality counts.
    """
    def choose(numbers: Column) -> Column:
        def equals(*parts: int) -> Column:
            return numbers == F.array(*[F.lit(part) for part in parts])

        return (
            F.when(equals(1, 3), "1.3.0")
            .when(equals(1, 2), "1.2.0")
            .when(equals(1, 11), "1.11")
            .when(equals(1, 1), "1.1")
            .when(numbers <= F.array(F.lit(1)), "1.0")
        )

    return let(version_numbers(version), choose)

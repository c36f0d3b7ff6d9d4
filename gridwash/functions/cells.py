"""Cell-level Column functions. Every function maps Column -> Column and stays
inside whole-stage codegen: no Python worker, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from gridwash.functions import rules


def column(c) -> Column:
    """A Column from a name or a Column; names may hold dots and blanks."""
    return c if isinstance(c, Column) else F.col("`" + c.replace("`", "``") + "`")


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def trim_text(c) -> Column:
    """Strip every kind of white space from both ends.

    ``trim`` handles blanks at the cost of two comparisons; only a text that then
    still starts or ends with other white space takes the general strip.
    """
    col = column(c)
    blanks = F.trim(col)
    ends = F.concat(F.substring(blanks, 1, 1), F.substring(blanks, -1, 1))
    return F.when(ends.rlike(f"[{rules.STRIP_CHARS}]"), F.btrim(col, F.lit(rules.STRIP_CHARS))).otherwise(blanks)


def is_missing(c, dtype: T.DataType | None = None) -> Column:
    """Null, or NaN when ``dtype`` is a floating type."""
    col = column(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def known(c, dtype: T.DataType | None = None) -> Column:
    """The value with NaN as null, if ``dtype`` is a floating type: NaN is missing."""
    col = column(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col)
    return col


def clean_number(c) -> Column:
    """Double of a number, NaN as null: what every numeric aggregate works on."""
    return known(column(c).cast("double"), T.DoubleType())


def is_blank(c, dtype: T.DataType | None = None) -> Column:
    """Missing, or text that is empty after a strip."""
    col = column(c)
    if dtype is None or isinstance(dtype, T.StringType):
        return col.isNull() | (trim_text(col) == "")
    return is_missing(col, dtype)


def safe_str(c, dtype: T.DataType | None = None) -> Column:
    """Text of a value, without exponents where ten decimals hold it exactly:
    12345678.5, not 1.23456785E7; different doubles never give the same text."""
    col = column(c)
    if not isinstance(dtype, (T.DoubleType, T.FloatType)):
        return col.cast("string")
    plain = col.try_cast("decimal(38,10)").cast("string")
    short = F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", ".0")
    return F.coalesce(F.when(plain.cast("double") == col.cast("double"), short), col.cast("string"))


def row_json(types: dict[str, T.DataType], columns) -> Column:
    """One row as JSON with explicit nulls, equal for equal rows and only for them.

    Times keep their microseconds, -0.0 is written as 0.0 and NaN as null.
    """
    fields = []
    for c in columns:
        col = column(c)
        if isinstance(types[c], (T.DateType, T.TimestampType, T.TimestampNTZType)):
            col = col.cast("string")
        elif isinstance(types[c], (T.DoubleType, T.FloatType)):
            col = known(col, types[c]) + F.lit(0.0)
        fields.append(col.alias(c))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def null_tokens(c, tokens=rules.NULL_TOKENS) -> Column:
    """Null for cells that spell out a missing value."""
    col = column(c)
    return F.when(col.isin(*tokens), None).otherwise(col)


def strip_number_symbols(c) -> Column:
    return F.translate(column(c), rules.NUMBER_SYMBOLS, "")


def is_number(c) -> Column:
    """Text that is a number once thousands separators and currency signs are gone."""
    return strip_number_symbols(c).rlike(rules.padded(rules.NUMBER))


def is_plain_number(c) -> Column:
    """Text that is a number as it stands."""
    return column(c).rlike(rules.padded(rules.NUMBER))


def is_date(c) -> Column:
    """Text that contains something date-like."""
    return any_of(column(c).rlike(p) for p in rules.DATE_SEARCH)


def looks_like_data(c) -> Column:
    """A header candidate that reads like a value: number, date, long, symbols only."""
    text = trim_text(c)
    return F.coalesce(
        (text != "")
        & (
            is_number(text)
            | is_date(text)
            | (F.char_length(text) > rules.LONG_TEXT)
            | text.rlike(rules.SYMBOLS_ONLY)
        ),
        F.lit(False),
    )


def type_tag(c, dtype: T.DataType | None = None) -> Column:
    """numeric / date-like / numeric-string / text / other; null for a missing cell."""
    col = column(c)
    if isinstance(dtype, T.NumericType):
        return F.when(~is_missing(col, dtype), F.lit("numeric"))
    if dtype is not None and not isinstance(dtype, T.StringType):
        return F.when(col.isNotNull(), F.lit("other"))
    return (
        F.when(col.isNull(), None)
        .when(col.rlike("[/-]") & col.rlike(r"\d"), "date-like")
        .when(F.translate(col, ".,-", "").rlike(r"^\d+$"), "numeric-string")
        .otherwise("text")
    )


def case_text(c, mode: str = "title") -> Column:
    """lower / upper / title / title_parity.

    Title keeps the letter after an apostrophe or hyphen lower; title_parity starts a
    word after anything that is no letter (``O'Neil-Smith``).
    """
    col = column(c)
    if mode == "title_parity":
        parts = F.split(F.lower(col), r"(?<!\p{L})(?=\p{L})")
        first = F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x))))
        return F.array_join(first, "")
    return {"lower": F.lower, "upper": F.upper, "title": F.initcap}[mode](col)


def to_number(c) -> Column:
    """Double for text that is a plain number, else null."""
    return F.when(is_plain_number(c), trim_text(c).try_cast("double"))


def money(c) -> Column:
    """Double for text that is a number behind currency signs and separators."""
    return F.when(is_number(c), trim_text(strip_number_symbols(c)).try_cast("double"))


_CLOCK = r"([ T]\d{1,2}:\d{2}:\d{2})?$"
_MARK = r"[-/]"
_TWO = rf"(\d{{1,2}}){_MARK}(\d{{1,2}}){_MARK}"
# Rewrites towards year-month-day; groups are first number, second number, year, clock.
_TO_ISO = (
    (rf"^{_TWO}(\d{{4}}){_CLOCK}", ""),
    (rf"^{_TWO}(69|[7-9]\d){_CLOCK}", "19"),
    (rf"^{_TWO}(\d{{2}}){_CLOCK}", "20"),
)
_YEAR_FIRST = rf"^(\d{{4}}){_MARK}(\d{{1,2}}){_MARK}(\d{{1,2}}){_CLOCK}"
_BARE = (
    (r"^((?:1[6-9]|2[0-2])\d{2})$", "$1-01-01"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
)
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:\d{2}:\d{2})?$"
# Rewrites towards day-month-year with a month name.
_TO_NAMED = (
    (r"^([A-Za-z]{3})[A-Za-z]*\s+(\d{1,2}),?\s+(\d{4})$", "$2-$1-$3"),
    (r"^(\d{1,2}-[A-Za-z]{3}-)(69|[7-9]\d)$", "$119$2"),
    (r"^(\d{1,2}-[A-Za-z]{3}-)(\d{2})$", "$120$2"),
)
_NAMED = r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"


def _rewrite(text: Column, steps) -> Column:
    for pattern, into in steps:
        text = F.regexp_replace(text, pattern, into)
    return text


def _starts(c: Column, pattern: str) -> Column:
    """The text starts with the pattern, leading white space aside."""
    return c.rlike(f"^[{rules.STRIP_CHARS}]*{pattern}")


def parse_datetime(c, day_first: bool = True, bare_years: bool = False) -> Column:
    """Timestamp of a date text in one of the supported shapes, else null.

    Year-first text is always year-month-day. ``day_first=False`` tries the
    month-first reading of ambiguous text before the day-first one.
    ``bare_years`` also accepts ``1998`` and ``20240101``.

    The first characters choose the shape, so text that is no date costs a few failed
    matches; a date is rewritten to ISO form step by step and cast once.
    """
    col = column(c)
    text = trim_text(col)

    def stamp(steps):
        return F.regexp_extract(_rewrite(text, steps), _ISO, 0).try_cast("timestamp_ntz")

    def year_last(order):
        return stamp([(p, f"{century}$3-{order}$4") for p, century in _TO_ISO])

    orders = ["$2-$1"] if day_first else ["$1-$2", "$2-$1"]
    named = F.regexp_extract(_rewrite(text, _TO_NAMED), _NAMED, 0)
    out = (
        F.when(_starts(col, r"\d{4}[-/]\d"), stamp([(_YEAR_FIRST, "$1-$2-$3$4")]))
        .when(_starts(col, r"\d{1,2}[-/]\d"), F.coalesce(*[year_last(o) for o in orders]))
    )
    if bare_years:
        out = out.when(_starts(col, r"(?:\d{4}|\d{8})\s*$"), stamp(_BARE))
    return out.when(
        _starts(col, r"(?:\d{1,2}-[A-Za-z]{3}-\d|[A-Za-z]{3,9}\s+\d)"),
        F.when(named != "", F.try_to_timestamp(named, F.lit("d-MMM-yyyy"))).cast("timestamp_ntz"),
    )


def is_date_text(c, day_first: bool = False) -> Column:
    """The whole text parses as a date."""
    return parse_datetime(c, day_first=day_first, bare_years=True).isNotNull()


def json_body(c) -> Column:
    """Text from the first ``{`` to the last ``}``; null when there is none."""
    body = F.regexp_extract(column(c), r"(?s)\{.*\}", 0)
    return F.when(body != "", body)


def json_field(c, path: str) -> Column:
    """A field of the JSON object embedded anywhere in a text."""
    return F.get_json_object(json_body(c), path)


def parse_bool(c, default: bool = False) -> Column:
    """``true`` in any case is true, other text false, null the default."""
    return F.coalesce(F.lower(column(c)) == "true", F.lit(default))

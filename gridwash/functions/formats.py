"""Format rules as Column expressions: name hints, validity, repair, suggestions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from gridwash.functions import cells, rules


def detect_format_by_name(name: str, word_match: bool = False) -> str | None:
    """Format hinted by a column name; substring hits unless ``word_match``."""
    lower = str(name).lower()
    words = set(re.split(r"[^a-z0-9]+", lower)) if word_match else None
    for fmt, hints in rules.NAME_WORDS:
        if any((h in words) if word_match else (h in lower) for h in hints):
            return fmt
    return None


def content_hit(fmt: str, value) -> Column:
    """Does a sampled value speak for ``fmt``?"""
    v = cells.column(value)
    if fmt == "email":
        return v.contains("@") & v.contains(".")
    pattern = next(p for f, p, _ in rules.CONTENT_RULES if f == fmt)
    return (F.translate(v, " -", "") if fmt == "phone" else v).rlike(pattern)


# The date pattern with its range check: day 1-31, month 1-12, year 1900-2100.
_DATE_IN_RANGE = r"^(0[1-9]|[12]\d|3[01])/(0[1-9]|1[0-2])/(19\d{2}|20\d{2}|2100)$"


def is_valid(c, fmt: str) -> Column:
    """Null, empty and unknown formats are valid; dates are range-checked, not
    calendar-checked."""
    col = cells.column(c)
    if fmt not in rules.FORMATS:
        return F.lit(True)
    pattern = _DATE_IN_RANGE if fmt == "date" else rules.FORMATS[fmt][0]
    return F.coalesce((col == "") | col.rlike(rules.padded(pattern)), F.lit(True))


def _standard_date(text: Column) -> Column:
    def put(pattern, day, month, year):
        return F.concat(
            F.lpad(F.regexp_extract(text, pattern, day), 2, "0"),
            F.lit("/"),
            F.lpad(F.regexp_extract(text, pattern, month), 2, "0"),
            F.lit("/"),
            year,
        )

    short, first, long = rules.DATE_SHORT_YEAR, rules.DATE_YEAR_FIRST, rules.DATE_DAY_FIRST
    same_mark = cells.any_of(text.rlike(p) for p in rules.DATE_ONE_MARK)
    return (
        F.when(
            text.rlike(short) & same_mark,
            put(short, 1, 2, F.concat(F.lit("20"), F.regexp_extract(text, short, 3))),
        )
        .when(text.rlike(first), put(first, 3, 2, F.regexp_extract(text, first, 1)))
        .when(text.rlike(long), put(long, 1, 2, F.regexp_extract(text, long, 3)))
        .otherwise(text)
    )


def _standard_phone(text: Column) -> Column:
    digits = F.regexp_replace(text, r"[\s-]", "")
    plus = F.lit("+91-")
    return (
        F.when(digits.rlike(r"^[6-9].{9}$"), F.concat(plus, digits))
        .when(digits.startswith("91") & (F.length(digits) == 12), F.concat(plus, F.substr(digits, F.lit(3))))
        .when(digits.startswith("+91"), F.concat(plus, F.substr(digits, F.lit(4))))
        .otherwise(text)
    )


def _standard_currency(text: Column) -> Column:
    number = cells.trim_text(F.translate(text, "₹$,", ""))
    amount = F.when(number.rlike(rules.NUMBER), number.try_cast("double"))
    return F.coalesce(F.concat(F.lit("₹ "), F.format_number(amount, 2)), text)


def _standard_percentage(text: Column) -> Column:
    number = F.when(text.rlike(rules.NUMBER), text.try_cast("double"))
    return F.coalesce(F.concat(cells.safe_str(number, DoubleType()), F.lit("%")), text)


def standardize_value(c, fmt: str) -> Column:
    """Rewrite a value towards its format; text that cannot be rewritten is only stripped."""
    col = cells.column(c)
    text = cells.trim_text(col)
    rewrite = {
        "date": _standard_date,
        "phone": _standard_phone,
        "gst": F.upper,
        "pan": F.upper,
        "currency_inr": _standard_currency,
        "percentage": _standard_percentage,
    }.get(fmt, lambda t: t)
    return F.when(col.isNull() | (col == ""), col).otherwise(rewrite(text))


def repair(c, fmt: str) -> Column:
    """The standardised value where the cell is invalid and the new value is valid."""
    col = cells.column(c)
    new = standardize_value(col, fmt)
    return F.when(~is_valid(col, fmt) & is_valid(new, fmt), new).otherwise(col)


def matches_pattern(c, name: str) -> Column:
    """Case-insensitive match of one of the identifier patterns, after a strip."""
    return cells.column(c).rlike("(?i)" + rules.padded(rules.PATTERNS[name][0]))


def suggest_fix(c) -> Column:
    """Array of likely corrections for a value that is close to a known identifier."""
    col = cells.column(c)
    upper = F.upper(cells.trim_text(col))
    digits = F.regexp_replace(col, r"\D", "")
    pan = F.when(
        upper.rlike(r"^\p{L}{5}\d{4}.$"), F.concat(F.lit("Possible PAN: "), upper)
    )
    aadhaar = F.when(
        F.length(digits) == 12,
        F.concat(
            F.lit("Possible Aadhaar: "),
            F.substring(digits, 1, 4),
            F.lit(" "),
            F.substring(digits, 5, 4),
            F.lit(" "),
            F.substring(digits, 9, 4),
        ),
    )
    mobile = F.when(
        digits.rlike(r"^[6-9]\d{9}$"), F.concat(F.lit("Possible Mobile: +91-"), digits)
    ).when(
        digits.rlike(r"^91\d{10}$"),
        F.concat(F.lit("Possible Mobile: +91-"), F.substring(digits, 3, 10)),
    )
    return F.array_compact(F.array(pan, aadhaar, mobile))

"""Text operations: Column in, Column out; flags are added to a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridwash.functions import cells


def remove_special(c, keep: str = r"\p{L}\p{N}\s") -> Column:
    """Remove characters outside ``keep`` (default: letters, digits, white space)."""
    return F.regexp_replace(cells.column(c), f"[^{keep}]", "")


# --- fixed values: Windows-1252 characters and the bytes they stand for ----------------
_WINDOWS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_WINDOWS_BYTES = (
    "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e"
    "\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
)


def _undo(col: Column) -> Column:
    """The characters as single bytes re-read as UTF-8; null when that is not valid."""
    return F.try_validate_utf8(F.encode(col, "ISO-8859-1").cast("string"))


def fix_encoding(c) -> Column:
    """Repair UTF-8 text that was read as Latin-1 or Windows-1252.

    Only text with a non-ASCII character that fits the single-byte charset is tried;
    text whose bytes are no valid UTF-8 was fine as it was.
    """
    col = cells.column(c)
    accented = col.rlike(r"[^\x00-\x7F]")
    latin = accented & col.rlike(r"^[\x00-\xFF]*$")
    windows = accented & col.rlike(rf"^[\x00-\xFF{_WINDOWS}]*$")
    single = F.translate(col, _WINDOWS, _WINDOWS_BYTES)
    return F.coalesce(F.when(latin, _undo(col)), F.when(windows, _undo(single)), col)


def normalize_name(c) -> Column:
    """A name value: white space squeezed, ends stripped, words capitalised."""
    return F.initcap(F.regexp_replace(cells.trim_text(c), r"\s+", " "))


def remove_control(c) -> Column:
    """Remove non-printable control characters."""
    return F.regexp_replace(cells.column(c), r"\p{Cntrl}", "")


def split_words(c) -> Column:
    """Separate run-together words: ``orderDate2024`` -> ``order Date 2024``."""
    out = F.regexp_replace(cells.column(c), r"([a-z])([A-Z])", "$1 $2")
    out = F.regexp_replace(out, r"([A-Za-z])([0-9])", "$1 $2")
    return F.regexp_replace(out, r"([0-9])([A-Za-z])", "$1 $2")


# --- fixed values: script classes ---------------------------------------------------
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Devanagari")


def script_letters(c, script: str) -> Column:
    """Number of letters of one script."""
    return F.char_length(F.regexp_replace(cells.column(c), rf"[^\p{{Is{script}}}]", "")).cast("long")


def script_counts(c, scripts=SCRIPTS) -> Column:
    """Map of script -> number of letters of that script."""
    return F.create_map(*[x for s in scripts for x in (F.lit(s), script_letters(c, s))])


def flag_mixed_script(
    df: DataFrame, column: str, flag: str = "mixed_script", share: float = 0.1, scripts=SCRIPTS
) -> DataFrame:
    """Add a flag: more than one script holds over ``share`` of the letters."""
    names = {f"_n_{s}": script_letters(column, s) for s in scripts}
    counted = df.withColumns(names)
    total = sum((F.col(n) for n in names), F.lit(0).cast("long"))
    present = sum(((F.col(n) > total * share).cast("int") for n in names), F.lit(0))
    return counted.withColumn(flag, F.coalesce(present > 1, F.lit(False))).drop(*names)

"""Pieces of DuckDB SQL shared by the twins; written from the rules, not from Spark plans."""

from __future__ import annotations

from gridwash.functions import rules


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def trim(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def number(c: str) -> str:
    return has(trim(f"translate({c}, ',$€£', '')"), rules.NUMBER)


def plain_number(c: str) -> str:
    return has(trim(c), rules.NUMBER)


def date_like(c: str) -> str:
    return "(" + " OR ".join(has(c, p) for p in rules.DATE_SEARCH) + ")"


def date_value(c: str, day_first: bool = True, bare_years: bool = False) -> str:
    """TIMESTAMP of the date shapes the fixtures use."""
    t = trim(c)

    def ymd(y, m, d, pattern):
        return (
            f"TRY_CAST(concat({y}, '-', regexp_extract({t}, {q(pattern)}, {m}), '-', "
            f"regexp_extract({t}, {q(pattern)}, {d})) AS TIMESTAMP)"
        )

    first = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$"
    long = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$"
    short = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{2})$"
    yy = f"regexp_extract({t}, {q(short)}, 3)"
    century = f"concat(CASE WHEN TRY_CAST({yy} AS INT) >= 69 THEN '19' ELSE '20' END, {yy})"

    def both(year, pattern):
        dmy, mdy = ymd(year, 2, 1, pattern), ymd(year, 1, 2, pattern)
        return dmy if day_first else f"COALESCE({mdy}, {dmy})"

    out = (
        f"CASE WHEN {has(t, first)} THEN {ymd(f'regexp_extract({t}, {q(first)}, 1)', 2, 3, first)} "
        f"WHEN {has(t, long)} THEN {both(f'regexp_extract({t}, {q(long)}, 3)', long)} "
        f"WHEN {has(t, short)} THEN {both(century, short)} "
    )
    if bare_years:
        out += (
            f"WHEN {has(t, '^(1[6-9]|20|21|22)[0-9]{2}$')} THEN TRY_CAST(concat({t}, '-01-01') AS TIMESTAMP) "
            f"WHEN {has(t, '^[0-9]{8}$')} THEN TRY_CAST(concat({t}[1:4], '-', {t}[5:6], '-', {t}[7:8]) AS TIMESTAMP) "
        )
    return out + "END"


def valid(c: str, fmt: str) -> str:
    t = trim(c)
    ok = has(t, rules.FORMATS[fmt][0])
    if fmt == "date":
        ok = (
            f"({ok} AND TRY_CAST({t}[1:2] AS INT) BETWEEN 1 AND 31 AND "
            f"TRY_CAST({t}[4:5] AS INT) BETWEEN 1 AND 12 AND TRY_CAST({t}[7:10] AS INT) BETWEEN 1900 AND 2100)"
        )
    return f"({c} IS NULL OR {c} = '' OR {ok})"


def matches(c: str, pattern: str) -> str:
    return has(trim(c), "(?i)" + rules.PATTERNS[pattern][0])


def float_text(c: str) -> str:
    """Python-like text of a double."""
    return f"CAST({c} AS VARCHAR)"


def standard(c: str, fmt: str) -> str:
    t = trim(c)
    if fmt == "date":

        def put(p, d, m, year):
            return (
                f"concat(lpad(regexp_extract({t}, {q(p)}, {d}), 2, '0'), '/', "
                f"lpad(regexp_extract({t}, {q(p)}, {m}), 2, '0'), '/', {year})"
            )

        cases = []
        for p in (r"^(\d{1,2})-(\d{1,2})-(\d{2})$", r"^(\d{1,2})/(\d{1,2})/(\d{2})$"):
            cases.append((p, put(p, 1, 2, f"concat('20', regexp_extract({t}, {q(p)}, 3))")))
        p = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
        cases.append((p, put(p, 3, 2, f"regexp_extract({t}, {q(p)}, 1)")))
        p = r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
        cases.append((p, put(p, 1, 2, f"regexp_extract({t}, {q(p)}, 3)")))
        new = "CASE " + " ".join(f"WHEN {has(t, p)} THEN {e}" for p, e in cases) + f" ELSE {t} END"
    elif fmt == "phone":
        d = rf"regexp_replace({t}, '[\s-]', '', 'g')"
        new = (
            f"CASE WHEN length({d}) = 10 AND {d}[1:1] IN ('6','7','8','9') THEN concat('+91-', {d}) "
            f"WHEN {d} LIKE '91%' AND length({d}) = 12 THEN concat('+91-', {d}[3:]) "
            f"WHEN {d} LIKE '+91%' THEN concat('+91-', {d}[4:]) ELSE {t} END"
        )
    elif fmt in ("gst", "pan"):
        new = f"upper({t})"
    elif fmt == "currency_inr":
        n = trim(f"translate({t}, '₹$,', '')")
        new = (
            f"CASE WHEN {has(n, rules.NUMBER)} THEN concat('₹ ', "
            f"format('{{:,.2f}}', TRY_CAST({n} AS DOUBLE))) ELSE {t} END"
        )
    elif fmt == "percentage":
        new = (
            f"CASE WHEN {t} NOT LIKE '%\\%' ESCAPE '\\' AND {has(t, rules.NUMBER)} "
            f"THEN concat({float_text(f'TRY_CAST({t} AS DOUBLE)')}, '%') ELSE {t} END"
        )
    else:
        new = t
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN {c} ELSE {new} END"


def cells(columns, keys="row_id", source="f") -> str:
    """Long form (keys, column, value), non-null cells only."""
    return " UNION ALL ".join(
        f"SELECT {keys}, {q(c)} AS \"column\", CAST({c} AS VARCHAR) AS value FROM {source} WHERE {c} IS NOT NULL"
        for c in columns
    )


def sample(columns, k, keys="row_id") -> str:
    """Long form of the first k non-null values per column, with pos."""
    return (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY {keys}) AS pos "
        f"FROM ({cells(columns, keys)})) WHERE pos <= {k}"
    )


def per_column(columns, body, source="f") -> str:
    """One SELECT per column from ``body`` with {c} the column and {n} its quoted name."""
    return " UNION ALL ".join(
        f"SELECT {q(c)} AS \"column\", {body.replace('{c}', c).replace('{n}', q(c))} FROM {source}"
        for c in columns
    )


def join_list(expr: str, order: str) -> str:
    return f"coalesce(string_agg({expr}, '|' ORDER BY {order}), '')"

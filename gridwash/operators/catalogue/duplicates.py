"""Duplicate operations. Groups are only ever reduced by aggregates that combine
map-side (or by a window whose group limit prunes each task), so a key that fills a
third of the table stays small before the shuffle. Pairs within a group are never
formed: copies point to one leader of their group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwash.functions import cells
from gridwash.operators.sampling import as_list, data_columns
from gridwash.session import stored


def drop_exact_duplicates(df: DataFrame, order_by) -> DataFrame:
    """Keep the first of equal rows (explicit request only); NaN equals null and becomes it."""
    keys = as_list(order_by)
    cols = data_columns(df, order_by)
    types = {f.name: f.dataType for f in df.schema}
    first = F.min(F.struct(*[cells.column(k) for k in keys])).alias("_first")
    out = df.groupBy(*[cells.known(c, types[c]).alias(c) for c in cols]).agg(first)
    return out.select(
        *[F.col("_first")[k].alias(k) if k in keys else cells.column(k) for k in df.columns]
    )


def partial_duplicates(df: DataFrame, keys) -> DataFrame:
    """Rows whose key occurs more than once.

    Only repeated keys are joined back; a hot key is split by AQE's skew join on the
    row side, as the key side has one row per key.
    """
    keys = as_list(keys)
    repeated = df.groupBy(*[cells.column(k) for k in keys]).count().where("count > 1").select(
        *[cells.column(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    )
    match = cells.all_of(
        cells.column(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)
    )
    return df.join(repeated, match, "left_semi")


def deduplicate(df: DataFrame, keys, rule) -> DataFrame:
    """Keep one row per key: the first by ``rule`` (columns or sort expressions)."""
    w = Window.partitionBy(*[cells.column(k) for k in as_list(keys)]).orderBy(*as_list(rule))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def fingerprint(c) -> Column:
    """Key under which near-equal values collide: lower case, no punctuation, sorted
    distinct words."""
    words = F.split(
        F.trim(F.regexp_replace(F.lower(cells.column(c)), r"[^\p{L}\p{N}]+", " ")), " "
    )
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def near_duplicates(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """id, near_duplicate_of, group_size for rows sharing a fingerprint with others.

    The leader is the smallest id of the group; it is listed with itself. Texts without a
    letter or digit have no fingerprint and are nobody's copies.
    """
    keyed = (
        df.select(cells.column(id_col), fingerprint(column).alias("_words"))
        .where("_words <> ''")
        .select(cells.column(id_col), F.unhex(F.sha2("_words", 256)).alias("_key"))
    )
    groups = (
        keyed.groupBy("_key")
        .agg(F.min(cells.column(id_col)).alias("near_duplicate_of"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    return keyed.join(groups, "_key").select(id_col, "near_duplicate_of", "group_size")


#: Shingles, as a share of a text's, that a text posts beyond its prefix.
SLACK = 0.2


def _shingles(words: int) -> Column:
    """Distinct hashes of the runs of the words ``t``; a text shorter than one is its own run."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("t") - F.lit(words - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice("t", i, words))))


def _missing(n: Column, threshold: float) -> Column:
    """The most of ``n`` shingles that a text like this one can lack; never too small."""
    return n - F.ceil(n * F.lit(threshold) - F.lit(1e-6))


def _accompanied(texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """doc (hash of the key): texts that can be like another row, and few others.

    In any fixed order of all shingles, here that of their hashes, the first k shingles
    that two texts have in common stand among the first missing + k of either. So a text
    posts that many, k being a share of its size, and has a like one only if others post
    k of these as well (k of the smallest size that a text like it can have).
    """
    split = texts.select(F.xxhash64("key").alias("doc"), F.split("plain", " ").alias("t"))
    sorted_sets = split.select("doc", F.sort_array(_shingles(words)).alias("shingles")).withColumn("n", F.size("shingles"))
    post = _missing(F.col("n"), threshold) + 1 + F.floor(F.col("n") * F.lit(SLACK))
    need = 1 + F.floor(F.greatest(F.col("n") * F.lit(SLACK * threshold) - F.lit(1e-6), F.lit(0)))
    posted = sorted_sets.select("doc", need.cast("int").alias("need"), F.slice("shingles", F.lit(1), post.cast("int")).alias("posted"))
    # Counted and joined from a table, so texts are split once.
    each = stored(posted, "posted").select("doc", "need", F.explode("posted").alias("list"))
    often = each.groupBy("list").agg(F.count("*").alias("often")).where("often > 1").select("list")
    # Rows of one text count their postings together, which only lets more through.
    met = each.join(often, "list").groupBy("doc").agg(F.count("*").alias("met"), F.min("need").alias("need"))
    return met.where("met >= need").select("doc")


def _shared_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """node, n, places, shared: the shingles that other texts have too, rarest first, of
    all texts that can be like another one.

    Two sets that reach the threshold share more than n - ceil(threshold * n) of the n
    shingles of either, so in any fixed order of all shingles they share one of the first
    n - ceil(threshold * n) + 1. Here the rarest come first. A shingle that only one text
    has takes up a place but needs no list, so the first ``places`` of ``shared`` do.
    """
    each = sets.select("node.key", "n", F.explode("shingles").alias("list"))
    often = each.groupBy("list").agg(F.count("*").alias("often")).where("often > 1")
    shared = each.join(often, "list").groupBy("key").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("often", "list"))).alias("shared")
    )
    places = _missing(F.col("n"), threshold) + 1 - (F.col("n") - F.size("shared"))
    nodes = sets.select("node", F.col("node.key").alias("key"))
    return shared.withColumn("places", places.cast("int")).where("places > 0").join(nodes, "key").select(
        "node", "n", "places", F.transform("shared", lambda x: x["list"]).alias("shared")
    )


def _verified(pairs: DataFrame, shared: DataFrame, threshold: float) -> DataFrame:
    """(node, best): the smallest leader of each node that its full set is like."""
    mine = shared.select("node", "n", F.col("shared").alias("mine"))
    theirs = shared.select(F.col("node").alias("leader"), F.col("n").alias("m"), F.col("shared").alias("theirs"))
    both = pairs.join(mine, "node").join(theirs, "leader")
    # What two texts have in common is among the shared shingles of both.
    common = F.size(F.array_intersect("mine", "theirs"))
    similarity = common / (F.col("n") + F.col("m") - common)
    return (
        both.select("node", F.struct("leader", similarity.alias("similarity")).alias("best"))
        .where(F.col("best.similarity") >= threshold)
        .groupBy("node").agg(F.min("best").alias("best"))
    )


def similar_texts(
    df: DataFrame, id_col: str, column: str, threshold: float = 0.8, words: int = 3
) -> DataFrame:
    """id, near_duplicate_of, similarity: texts that resemble an earlier text, all of them.

    Texts are alike if their sets of word shingles (letters and digits, lower case) have
    a Jaccard similarity of at least ``threshold``. near_duplicate_of is the smallest id
    of all texts that are like a text, listed if it is smaller than the text's own;
    similarity is exact. Ids may be of any type that has an order. Rows without an id,
    and texts without a letter or digit, are nobody's copies; rows that share an id count
    as texts of their own.

    Texts that can be like no other are set aside first (see ``_accompanied``): only the
    rest is shuffled by shingles in full. Equal texts are one before any comparison. The
    others meet in the lists of their rarest shingles (see ``_shared_sets``), where every
    text that is like another one stands with it. A list's smallest texts lead it:
    members are tried with one leader, then with four, sixteen and so on, until for every
    member of every list no smaller text than the one it was found like is left untried.
    So a list of copies is settled by its first leader, with one row per member, and only
    texts that share rare shingles without being alike are compared with more. No pairs
    within a list are formed beyond that, and each round reads only the texts of lists
    that are still open. Intermediate tables are written to the scratch folder.
    """
    plain = F.trim(F.regexp_replace(F.lower(cells.column(column)), r"[^\p{L}\p{N}]+", " "))
    texts = (
        df.select(cells.column(id_col).alias("id"), plain.alias("plain")).where("id IS NOT NULL AND plain <> ''")
        .select("id", F.unhex(F.md5("plain")).alias("key"), "plain")
    )
    rows = stored(texts.select("id", "key"), "rows")
    accompanied = stored(_accompanied(texts, threshold, words), "accompanied")
    sets = stored(
        texts.join(accompanied, F.xxhash64("key") == F.col("doc"), "left_semi")
        .groupBy("key").agg(F.min("id").alias("lead"), F.first("plain").alias("plain"))
        .select(F.struct("lead", "key").alias("node"), F.split("plain", " ").alias("t"))
        .select("node", _shingles(words).alias("shingles"))
        .select("node", F.size("shingles").alias("n"), "shingles"),
        "sets",
    )
    shared = stored(_shared_sets(sets, threshold), "shared")
    members = stored(shared.select("node", "n", F.explode(F.slice("shared", F.lit(1), F.col("places"))).alias("list")), "members")
    best = None
    waiting, tried = members, 0
    while not waiting.isEmpty():
        leaders_now = max(1, 4 * tried)
        if tried:
            # Only texts before the last one that waits in a list can lead it.
            ends = waiting.groupBy("list").agg(F.max("node").alias("end"))
            members = stored(members.join(ends, "list").where("node <= end").select("node", "n", "list"), "members")
            shared = stored(shared.join(members.select("node").distinct(), "node", "left_semi"), "shared")
        # The rank is limited inside each task before a list's rows move.
        place = F.row_number().over(Window.partitionBy("list").orderBy("node"))
        leaders = stored(
            members.withColumn("place", place).where(F.col("place") <= leaders_now)
            .select("list", F.col("node").alias("leader"), F.col("n").alias("m"), "place"),
            "leaders",
        )
        able = (F.least("n", "m") >= F.greatest("n", "m") * F.lit(threshold) - F.lit(1e-6)) & (F.col("leader") < F.col("node"))
        if best is not None:
            waiting = waiting.join(best, "node", "left")
            able = able & F.coalesce(F.col("leader") < F.col("best.leader"), F.lit(True))
        pairs = waiting.join(leaders.where(F.col("place") > tried), "list").where(able).select("node", "leader").distinct()
        found = _verified(stored(pairs, "pairs"), shared, threshold)
        if best is not None:
            found = best.unionByName(found).groupBy("node").agg(F.min("best").alias("best"))
        best = stored(found, "best")
        # Members go on in lists that hold texts beyond the leaders, if one of them could
        # still be smaller than themselves and what they were found like.
        last = leaders.where(F.col("place") == leaders_now).select("list", F.col("leader").alias("last"))
        waiting = stored(
            waiting.select("node", "n", "list").join(last, "list").join(best, "node", "left")
            .where((F.col("last") < F.col("node")) & F.coalesce(F.col("last") < F.col("best.leader"), F.lit(True)))
            .select("node", "n", "list"),
            "waiting",
        )
        tried = leaders_now
    # A copy of a text is like the text's first row, and like all that is like it.
    known = rows.groupBy("key").agg(F.min("id").alias("near_duplicate_of")).withColumn("similarity", F.lit(1.0))
    if best is not None:
        earlier = F.coalesce(F.col("best.leader.lead") < F.col("near_duplicate_of"), F.lit(False))
        known = known.join(best.select(F.col("node.key").alias("key"), "best"), "key", "left").select(
            "key",
            F.when(earlier, F.col("best.leader.lead")).otherwise(F.col("near_duplicate_of")).alias("near_duplicate_of"),
            F.when(earlier, F.col("best.similarity")).otherwise(F.lit(1.0)).alias("similarity"),
        )
    found = rows.select("id", "key").join(known, "key")
    return found.where(F.col("near_duplicate_of") < F.col("id")).select(
        F.col("id").alias(id_col), "near_duplicate_of", "similarity"
    )


def near_duplicates_minhash(
    df: DataFrame, id_col: str, column: str, threshold: float = 0.8, words: int = 3
) -> DataFrame:
    """First name of :func:`similar_texts`, which needs no signatures: its lists lose no pair."""
    return similar_texts(df, id_col, column, threshold, words)


def merge_duplicates(df: DataFrame, keys, order_by, columns=None) -> DataFrame:
    """One row per key: the first non-null value of every other column, by order."""
    keys, order = as_list(keys), as_list(order_by)
    cols = columns or [c for c in df.columns if c not in keys and c not in order]
    place = F.struct(*[cells.column(o) for o in order])
    return df.groupBy(*[cells.column(k) for k in keys]).agg(
        *[
            F.min_by(cells.column(c), F.when(cells.column(c).isNotNull(), place)).alias(c)
            for c in cols
        ],
        F.count("*").alias("merged_rows"),
    )


def flag_suspicious(df: DataFrame, keys) -> DataFrame:
    """Add ``suspicious``: the normalised key (case, padding) occurs more than once.

    Counts come from a grouped table joined back, not from a window, so a hot key is
    not sorted in one task.
    """
    keys = as_list(keys)
    norm = {
        f"_k{i}": F.lower(cells.trim_text(cells.column(k).cast("string")))
        for i, k in enumerate(keys)
    }
    counts = (
        df.select(*[e.alias(n) for n, e in norm.items()]).groupBy(*norm).agg(F.count("*").alias("_n"))
    )
    counts = counts.where("_n > 1").select(*[F.col(n).alias(f"{n}r") for n in norm], "_n")
    match = cells.all_of(F.col(n).eqNullSafe(F.col(f"{n}r")) for n in norm)
    joined = df.withColumns(norm).join(counts, match, "left")
    return joined.select(
        *[cells.column(c) for c in df.columns], F.col("_n").isNotNull().alias("suspicious")
    )

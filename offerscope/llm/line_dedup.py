"""Removal of repeated runs of lines.

Each document is a sequence of line ids.  Prefix doubling ranks the suffixes
by their first 1, 2, 4, ... lines, until no window of that many lines repeats:
a rank is the place of a window among all windows of its length in sorted
order, from a range sort, so windows of equal rank are an interval of the
suffix array whose longest common prefix is at least the window.  Windows that
occur once leave at once, so later rounds see only repeats.

The LCP intervals follow from the ranks by halving: an interval of ``len``
common lines is split by the ranks of the next 2^k lines, k going down.  What
shares them goes on as a longer interval, all else stays, and with it the first
member of each longer interval, which stands for it.  So an interval ends with
the exact number of lines that its members share, and all of them together
hold at most one row a suffix and one an interval.

A suffix that is not its interval's first is a later copy: a run of ``len``
lines that begins earlier as well (in a smaller ``doc_id``, or further up) and
no longer one does.  Such runs that no run from the line before contains are
the maximal ones; the lines of those of at least ``min_words`` words go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

MIN_WORDS = 2        # a single word that is a line of its own is no repeat worth the name
HOT = 1024           # a key with more than a HOT-th of all rows is joined apart
PLACE = ["doc_id", "_row", "idx"]
WORD = r"[^\x20\x09-\x0D]+"


def _unused(columns: list[str], name: str) -> str:
    while name in columns:
        name += "_"
    return name


def _repeated(windows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number and first place."""
    return windows.groupBy(*key).agg(F.min(F.struct(*PLACE)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")


def _ranked(groups: DataFrame, key: list[str]) -> DataFrame:
    """Keys with their rank: the id of a row after a range sort follows the
    sort order."""
    return groups.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("rank", F.monotonically_increasing_id())


def _with(windows: DataFrame, groups: DataFrame, key: list[str], how: str) -> DataFrame:
    """``windows`` joined with ``groups``, both tables that were written.  The
    keys of more than a ``HOT``-th of the rows, so fewer than ``HOT`` keys, go
    to every task, and their rows are not dealt by key."""
    least = windows.count() // HOT
    hot, rest = F.broadcast(groups.where(F.col("n") > least)), groups.where(F.col("n") <= least)
    if hot.isEmpty():
        return windows.join(groups, key, how)
    return windows.join(hot, key).unionByName(windows.join(hot, key, "left_anti").join(rest, key, how))


def _levels(scratch: Scratch, lines: DataFrame) -> list[DataFrame]:
    """The windows of 1, 2, 4, ... lines that repeat, until none does, with
    their rank, the first place of that rank and whether they come later."""
    often = scratch.write(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    windows = scratch.write(_with(lines, often, ["h1", "h2"], "inner").drop("n"), "windows-1")
    levels, key, span = [], ["h1", "h2"], 1
    while not windows.isEmpty():
        ranks = scratch.write(_ranked(_repeated(windows, key), key), f"ranks-{span}")
        if ranks.isEmpty():
            break
        level = scratch.write(_with(windows, ranks, key, "inner")
                              .select(*PLACE, "words", "rank", F.col("first._row").alias("of_row"), F.col("first.idx").alias("of_idx"),
                                      (F.struct(*PLACE) > F.col("first")).alias("later")), f"level-{span}")
        scratch.drop(f"windows-{span}", f"ranks-{span}")
        levels.append(level)
        after = level.select("_row", (F.col("idx") - span).alias("idx"), F.col("rank").alias("r2"), F.col("words").alias("more"))
        pairs = (level.select(*PLACE, "words", F.col("rank").alias("r1")).join(after, ["_row", "idx"])
                 .withColumn("words", F.col("words") + F.col("more")).drop("more"))
        key, span = ["r1", "r2"], 2 * span
        windows = scratch.write(pairs, f"windows-{span}")
    return levels


def later_copies(scratch: Scratch, lines: DataFrame) -> DataFrame:
    """The longest run that also begins earlier, of each line (doc_id, _row,
    idx, words, h1, h2) that begins one: _row, idx, len and words.

    An interval is known by ``len`` and its first place (of_row, of_idx)."""
    levels = _levels(scratch, lines)
    if not levels:
        return lines.select("_row", "idx", F.col("idx").alias("len"), "words").where("false")
    state = None
    for k in reversed(range(len(levels))):
        span, level = 1 << k, levels[k]
        fresh = level
        if k + 1 < len(levels):
            fresh = level.join(levels[k + 1].where("later").select("_row", "idx"), ["_row", "idx"], "left_anti")
        fresh = fresh.withColumn("len", F.lit(span)).select(*PLACE, "len", "words", "of_row", "of_idx", "later")
        if state is None:
            state = fresh
            continue
        ahead = level.select("_row", F.col("idx").alias("to"), F.col("rank").alias("next"), F.col("words").alias("more"))
        asked = scratch.write(state.withColumn("to", F.col("idx") + F.col("len")).join(ahead, ["_row", "to"], "left").drop("to"), f"asked-{span}")
        key = ["len", "of_row", "of_idx", "next"]
        groups = scratch.write(_repeated(asked.where("next IS NOT NULL"), key), f"longer-{span}")
        longer = F.col("first").isNotNull()
        later = F.struct(*PLACE) > F.col("first")
        one = F.struct((F.col("len") + span).alias("len"), (F.col("words") + F.col("more")).alias("words"),
                       F.col("first._row").alias("of_row"), F.col("first.idx").alias("of_idx"), later.alias("later"))
        same = F.struct("len", "words", "of_row", "of_idx", "later")
        split = F.array_compact(F.array(F.when(longer, one), F.when(~longer | ~later, same)))
        state = _with(asked, groups, key, "left").select(*PLACE, F.inline(split)).unionByName(fresh)
    return state.where("later").select("_row", "idx", "len", "words")


def maximal_runs(copies: DataFrame) -> DataFrame:
    """Those of ``later_copies`` that reach further down than the one from the
    line before, with their end."""
    order = Window.partitionBy("_row").orderBy("idx")
    return (copies.withColumn("end", F.col("idx") + F.col("len")).withColumn("before", F.lag("end").over(order))
            .where("before IS NULL OR end > before").drop("before"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and any others) with the repeated lines taken out
    of ``text``, plus n_lines (lines with a word) and n_deleted.

    Lines end at ``\\n``; lines without words are neither matched nor deleted.
    Documents are ordered by ``doc_id`` (null first), rows that share one by
    their place in the input.  A null text stays null, with no lines; no row is
    dropped; own columns named n_lines or n_deleted are replaced, all others
    stay whatever their names."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    docs = docs.drop("n_lines", "n_deleted")
    row_id, gone = _unused(docs.columns, "_row"), _unused(docs.columns, "_gone")
    # Written with their ids: a fresh plan of the scan could be cut into other
    # partitions, which would give the ids to other rows.
    rows = scratch.write(docs.withColumn(row_id, F.monotonically_increasing_id()), "rows")
    cut = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    marked = F.transform(cut, lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("words")))
    worded = F.filter(marked, lambda x: x["words"] > 0)
    lines = scratch.write(rows.select("doc_id", F.col(row_id).alias("_row"), F.posexplode(worded).alias("idx", "line"))
                          .select("doc_id", "_row", "idx", "line.*"), "lines")

    order = Window.partitionBy("_row").orderBy("idx")
    long = maximal_runs(later_copies(scratch, lines)).where(F.col("words") >= min_words)
    # Both ends of maximal runs grow with their places: each adds what follows the one before.
    start = F.greatest("idx", F.coalesce(F.lag("end").over(order), F.lit(0)))
    deleted = (long.withColumn("run", F.sequence(start, F.col("end") - 1))
               .groupBy(F.col("_row").alias(row_id)).agg(F.flatten(F.collect_list("run")).alias(gone)))
    # Columns of their own, so that they are not worked out again for each line.
    parts, places = _unused([*docs.columns, row_id, gone], "_parts"), _unused([*docs.columns, row_id, gone], "_places")
    joined = rows.join(deleted, row_id, "left").withColumn(parts, cut)
    every = F.sequence(F.lit(0), F.size(parts) - 1)
    joined = joined.withColumn(places, F.filter(every, lambda i: F.get(parts, i).rlike(WORD)))
    stay = F.array_except(every, F.transform(gone, lambda i: F.get(places, i)))
    left = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    kept = [F.when(F.col(gone).isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*kept, F.size(places).cast("long").alias("n_lines"), F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_deleted"))

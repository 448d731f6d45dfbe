"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive bytes.  Each round looks at the next bytes of
the texts that are still undecided and counts the documents of every group and
segment; one document alone is a singleton, texts that have ended there are equal,
and all others make new groups for the next, deeper round.  Segments themselves are
the keys, so equality never rests on a digest.  Depths grow geometrically, so a
text of n bytes takes O(log n) rounds.

Rows have a number of their own, and only narrow rows (number, segment) meet at a
group's key; texts move by row number, evenly, and only those still undecided.  A
group of a thousandth of a round's rows or more is dealt over ``SALTS`` keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objtrail.llm.shared import Scratch, store

FIRST_DEPTH = 32
GROWTH = 16
#: a group with more than one of this many parts of a round's rows is hot; so there are no more hot groups than that
HOT = 1000
SALTS = 64
#: bytes of segments or texts that a task of a last stage takes on
TASK_BYTES = 16_000_000


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    first_depth: int = FIRST_DEPTH,
    growth: int = GROWTH,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty.  Of equal texts the largest id stays.  Ties: rows
    that repeat both id and text are each counted in ``group_size`` and each
    marked kept when theirs is the surviving id.  A null id is smaller than any
    other; a group of null ids has a null ``keep_id`` and all its rows are kept.
    An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch()
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), body.alias("body"))
    rows = scratch.store(rows.withColumn("size", F.length("body").cast("long")), "rows")
    decided = _decide(rows, _weight(rows), first_depth, growth, scratch)
    hashed = rows.select("row", F.unhex(F.sha2("body", 256)).alias("sha"))
    found = store(decided.join(hashed, "row"), "classes")
    scratch.drop()
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def distinct_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    first_depth: int = FIRST_DEPTH,
    growth: int = GROWTH,
) -> DataFrame:
    """The rows of ``docs`` without repeated texts, in all their columns.

    Rows are decided one by one: of equal texts, null being empty, one row stays, that
    with the largest id; of rows that repeat the id as well, or have none, any one.
    """
    scratch = Scratch()
    numbered = store(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = numbered.select(F.col("_row").alias("row"), F.col(id_col).alias("doc_id"), body.alias("body"))
    rows = rows.withColumn("size", F.length("body").cast("long"))
    weight = _weight(rows)
    gone = _decide(rows, weight, first_depth, growth, scratch).where("row <> keep_row").select(F.col("row").alias("_row"))
    gone = store(gone, "gone", weight[0])
    scratch.drop()
    # the join's tasks are bounded by the bytes that come in
    kept = numbered.join(gone, "_row", "left_anti").drop("_row")
    return kept.coalesce(max(1, -(-weight[1] // TASK_BYTES)))


def _decide(rows: DataFrame, weight: tuple[int, int], depth: int, growth: int, scratch: Scratch) -> DataFrame:
    """row, doc_id, keep_row, keep_id, group_size of every row (row, doc_id, body, size in bytes) of this ``weight``."""
    before, bodies, done = 0, rows.withColumn("group", F.lit(0).cast("long")), None
    count, volume = weight
    while True:
        # a row brings its segment to the join
        per_file = max(1, TASK_BYTES // (depth - before + 64))
        table = scratch.store(_split(bodies, count, before, depth, scratch), "radix", count, per_file)
        part = table.where("group IS NULL").drop("group")
        done = part if done is None else done.unionByName(part)
        active = table.where("group IS NOT NULL").select("row", "group")
        if active.isEmpty():
            return done
        # the join's tasks are bounded by the bytes that come in, not by those that stay
        bodies = scratch.store(bodies.drop("group").join(active, "row"), "bodies", volume, TASK_BYTES)
        count, volume = _weight(bodies)
        before, depth = depth, depth * growth


def _weight(bodies: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of their texts."""
    held = bodies.agg(F.count("*").alias("n"), F.sum("size").alias("volume")).first()
    return held.n, held.volume or 0


def _split(bodies: DataFrame, count: int, before: int, depth: int, scratch: Scratch) -> DataFrame:
    """One radix round of ``count`` rows over the bytes before..depth: ``group`` is null for
    decided rows, else the number of the group that goes on, the smallest of its rows."""
    keyed = bodies.select(
        "row",
        "doc_id",
        F.struct(
            "group",
            F.substring("body", before + 1, depth - before).alias("segment"),
            (F.length("body") <= depth).alias("ended"),
        ).alias("key"),
    )
    shared = (
        keyed.groupBy("key")
        .agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("top"), F.min("row").alias("low"))
        .where("n > 1")
        .withColumn("route", F.xxhash64("key"))
    )
    shared = scratch.store(shared, "shared", count, max(1, TASK_BYTES // (depth - before + 64)))
    # no more than HOT routes: each holds its part of the rows
    hot = [r.route for r in shared.select("route", "n").where(F.col("n") > count / HOT).collect()]
    salted = F.xxhash64("key").isin(hot) if hot else F.lit(False)
    keyed = keyed.withColumn("salt", F.when(salted, F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(0).cast("int"))
    several = F.col("route").isin(hot) if hot else F.lit(False)
    salts = F.when(several, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    joined = keyed.join(shared.select("key", "n", "top", "low", F.explode(salts).alias("salt")), ["key", "salt"], "left")
    alone = F.col("n").isNull()
    return joined.select(
        "row",
        "doc_id",
        F.when(alone, F.col("row")).otherwise(F.col("top.row")).alias("keep_row"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(~alone & ~F.col("key.ended"), F.col("low")).alias("group"),
    )

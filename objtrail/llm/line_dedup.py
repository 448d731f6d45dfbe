"""Line dedup by a log-template tree, in DataFrame operations only.

A line's path through the tree is its token count and its first tokens, with
tokens that hold a digit generalised.  Within a leaf, a token that stands at the
same place in the lines of enough documents is fixed, any other is a variable
field; a line's template is its tokens with the variable ones generalised.  A
template of mostly fixed tokens that recurs in enough documents is boilerplate,
and its lines are dropped.

Most lines share their leaf with no other document.  Leaves are counted first, on
narrow digests and with one row per document and leaf, and only lines of
recurring leaves have their tokens compared, once per distinct line.

Leaves, lines within a leaf and templates stand by 64-bit digests.  Among n distinct
values two share one with odds of about n * n / 2**65: one in 37 at a billion distinct
recurring lines of one leaf, far less over the many leaves of a corpus.  Such a pair would
be counted as one line; nothing else rests on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objtrail.llm.shared import Scratch, small_or_shuffled, store

LEADING = 3
MIN_DOCS = 5
MIN_FIXED = 0.5
BROADCAST_ROWS = 1_000_000
FIELD = "<*>"


def _spaced(text: Column) -> Column:
    """Text with one space for every run of spaces, tabs and carriage returns; trim gives a line's tokens."""
    odd = F.contains(text, F.lit("  ")) | F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r"))
    return F.when(odd, F.regexp_replace(text, "[ \t\r]+", " ")).otherwise(text)


def _generalised(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def _leaf(spaced: Column, leading: int) -> Column:
    """Digest of a spaced, trimmed line's path: token count and leading tokens, without cutting the rest."""
    spaces = F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit("")))
    lead = F.substring_index(spaced, " ", leading)
    field = F.regexp_replace(lead, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*", FIELD)
    return F.xxhash64(spaces, F.when(lead.rlike("[0-9]"), field).otherwise(lead))


def drop_recurring_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    leading: int = LEADING,
    min_docs: int = MIN_DOCS,
    min_fixed: float = MIN_FIXED,
) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text without its recurring lines, per row.

    Lines end at a line feed; blank lines are never dropped.  Tokens are cut at runs
    of spaces, tabs and carriage returns.  A null text gives no
    lines and an empty text, an empty one its one blank line.  Every row counts as
    a document of its own, so copies make their lines recur; run exact dedup
    first where that is not wanted.  Rows that repeat id and text get equal
    results.  An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    filled = F.filter(F.array_distinct(lines), lambda x: x.rlike(r"[^ \t\r]"))
    spaced = F.transform(F.split(_spaced(F.coalesce("text", F.lit(""))), "\n"), lambda x: F.trim(x))
    paths = F.transform(F.filter(F.array_distinct(spaced), lambda x: x != ""), lambda x: _leaf(x, leading))
    scratch = Scratch()
    # (1) leaves that recur, one row per document and leaf
    leaves = rows.select(F.explode(F.array_distinct(paths)).alias("leaf"))
    hot = leaves.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    hot = scratch.store(hot, "leaves")
    hot_rows = hot.count()
    # (2) their lines, one row per document and distinct line; from here on a digest
    # stands for a line within its leaf, so texts do not travel with every token
    listed = rows.select("doc_id", F.xxhash64("text").alias("version"), F.explode(filled).alias("line"))
    listed = listed.withColumns({"leaf": _leaf(F.trim(_spaced(F.col("line"))), leading), "digest": F.xxhash64("line")})
    listed = scratch.store(listed.join(small_or_shuffled(hot, hot_rows, BROADCAST_ROWS), "leaf"), "lines")
    distinct = scratch.store(
        listed.groupBy("leaf", "digest").agg(F.count("*").alias("n_docs"), F.first("line").alias("line")), "distinct"
    )
    # (3) tokens of distinct lines, and which of them are fixed
    tokens = F.split(F.trim(_spaced(F.col("line"))), " ")
    placed = distinct.select("leaf", "digest", "n_docs", F.posexplode(tokens).alias("place", "token"))
    fixed = (
        placed.groupBy("leaf", "place", "token")
        .agg(F.sum("n_docs").alias("n"))
        .where((F.col("n") >= min_docs) & ~F.col("token").rlike("[0-9]"))
        .select("leaf", "place", "token", F.lit(1).alias("fixed"))
    )
    fixed = scratch.store(fixed, "fixed")
    # a line that recurs by itself has all its tokens fixed but those with digits
    shared = F.col("n_docs") >= min_docs
    own = distinct.where(shared).select(
        "leaf",
        "digest",
        F.array_join(F.transform(tokens, _generalised), " ").alias("template"),
        F.aggregate(tokens, F.lit(0), lambda n, x: n + F.when(x.rlike("[0-9]"), 0).otherwise(1)).alias("n_fixed"),
        F.size(tokens).alias("n_tokens"),
    )
    made = (
        placed.where(~shared)
        .join(fixed, ["leaf", "place", "token"], "left")
        .groupBy("leaf", "digest")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("place", F.when(F.col("fixed") == 1, F.col("token")).otherwise(FIELD).alias("t")))
            ).alias("parts"),
            F.count("fixed").cast("int").alias("n_fixed"),
            F.count("*").cast("int").alias("n_tokens"),
        )
        .select("leaf", "digest", F.array_join(F.col("parts.t"), " ").alias("template"), "n_fixed", "n_tokens")
    )
    templates = (
        own.unionByName(made)
        .where(F.col("n_fixed") >= min_fixed * F.col("n_tokens"))
        .select("leaf", "digest", F.xxhash64("leaf", "template").alias("template"))
    )
    # (4) templates that recur in enough documents
    narrow = listed.select("doc_id", "version", "leaf", "digest")
    seen = narrow.join(templates, ["leaf", "digest"]).select("doc_id", "version", "digest", "template")
    seen = scratch.store(seen, "seen")
    recurring = (
        seen.select("doc_id", "version", "template")
        .distinct()
        .groupBy("template")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_docs)
        .select("template")
    )
    recurring = scratch.store(recurring, "recurring")
    gone = (
        seen.join(small_or_shuffled(recurring, recurring.count(), BROADCAST_ROWS), "template")
        .groupBy(F.col("doc_id").alias("_id"), F.col("version").alias("_version"))
        .agg(F.collect_set("digest").alias("gone"))
    )
    gone = store(gone, "gone")
    scratch.drop()
    none = F.array().cast("array<bigint>")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.coalesce("gone", none), F.xxhash64(x)))
    joined = rows.withColumn("_v", F.xxhash64("text")).join(
        gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_v") == F.col("_version")), "left"
    )
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    return joined.select(
        "doc_id",
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("text"),
    )

"""Line deduplication by overlapping windows of three lines. DataFrame functions only.

Every run of three consecutive lines is hashed (128 bits); windows are counted over the whole corpus, combined before
the shuffle, and the first occurrence of a repeated window (smallest id, then position) stays. The lines that any later
occurrence covers are removed: covered positions of a document merge into one set. A bitmap of the documents that lose
lines tells the others while they are read, so that texts which stay as they are never cross a shuffle.

Defined results: null texts are empty; texts of fewer than three lines have no windows and stay as they are; windows of
blank lines only (of spaces; a tab counts as text) don't count; rows that repeat both id and text are one occurrence and are treated alike; null ids come
first; an empty table gives an empty table; further columns survive in `deduplicated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm.common import documents, in_bitmap, key_bitmap, landed, shielded, text_of

WINDOW = 3


def split_once(df: DataFrame, text: Column, out: str) -> DataFrame:
    """df with the lines of text. The generator keeps the optimiser from splitting again at each use."""
    return df.select("*", F.explode(F.array(F.split(text, "\n", -1))).alias(out))


def window_keys(lines: Column, window: int = WINDOW) -> Column:
    """For each position at which a window starts its two hashes, null if all its lines are blank."""
    last = F.size(lines) - window
    own = lambda i: [F.element_at(lines, i + k + 1) for k in range(window)]

    def key(i: Column) -> Column:
        parts = own(i)
        blank = F.length(F.trim(F.concat(*parts))) == 0
        return F.when(~blank, F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(window), *parts[::-1]).alias("b")))

    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), key))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, mark, removed: the sorted positions of the lines that go, for the rows that lose any."""
    text = text_of(text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text, F.length(text)).alias("mark"), text.alias("text"))
    own = split_once(own, F.col("text"), "lines").select("doc_id", "mark", window_keys(F.col("lines"), window).alias("keys"))
    # outer: else keys are computed once more for a filter of empty arrays
    placed = own.select("doc_id", "mark", F.posexplode_outer("keys").alias("at", "key")).filter("key is not null")
    placed = placed.select("doc_id", "mark", "at", "key.a", "key.b")
    place = F.struct("doc_id", "mark", "at")
    again = (
        placed.groupBy("a", "b")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .filter(~F.col("first").eqNullSafe(F.col("last")))
        .select("a", "b", "first")
    )
    later = placed.join(again, ["a", "b"]).filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "mark", "at")
    covered = F.flatten(F.transform(F.collect_set("at"), lambda i: F.sequence(i, i + window - 1)))
    return later.groupBy("doc_id", "mark").agg(F.array_sort(F.array_distinct(covered)).alias("removed"))


@shielded
def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with their texts without repeated windows, and __lines and __removed, the number of lines before and gone."""
    text, names = text_of(text_col), docs.columns
    gone = landed(removed_lines(docs, id_col, text_col, window), "lines-removed")
    own = docs.withColumn("__mark", F.xxhash64(text, F.length(text)))
    losing = in_bitmap(key_bitmap(gone, F.col("mark"), "lines-bitmap"), F.col("__mark"))
    same = F.col(id_col).eqNullSafe(F.col("__gone.doc_id")) & (F.col("__mark") == F.col("__gone.mark"))
    found = own.filter(losing).join(gone.select(F.struct("*").alias("__gone")).hint("merge"), same, "left")
    found = split_once(found, text, "__all")
    count = F.size("__all")
    stay = F.transform(F.array_except(F.sequence(F.lit(0), count - 1), F.col("__gone.removed")), lambda i: F.element_at("__all", i + 1))
    kept = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(stay, "\n"))
    changed = found.select(
        *[kept.alias(c) if c == text_col else F.col(c) for c in names],
        count.cast("long").alias("__lines"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone.removed")).cast("long").alias("__removed"),
    )
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    whole = own.filter(~losing).select(*names, lines.cast("long").alias("__lines"), F.lit(0).cast("long").alias("__removed"))
    return whole.unionAll(changed)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its lines, how many go, and the digest of what stays."""
    found = deduplicated(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        F.col("__lines").alias("n_lines"),
        F.col("__removed").alias("n_removed"),
        F.sha2(text_of("text"), 256).alias("kept_sha256"),
    )


OP5_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
p AS (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d),
w AS (SELECT doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS k FROM p
      WHERE length(trim(l[i] || l[i + 1] || l[i + 2])) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM r, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
y AS (SELECT x.doc_id, x.i, x.line, c.i IS NOT NULL AS gone FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM y GROUP BY doc_id
"""

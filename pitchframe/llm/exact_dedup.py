"""Exact deduplication through the state of a stream. DataFrame functions only.

Arrivals (digest, id, row, locator of the content) go through a Structured Streaming aggregation whose keyed state lies
on disk, in RocksDB, and never expires: one entry a digest, with a count and the row of the largest id seen, its locator
(the file that holds the content) included. The state is then written as a table, so that its stores are opened only
once. Documents whose digest was hit more than once are checked by their full bytes: a second scan, which a bitmap of the
hit digests filters before anything is shuffled, groups them by digest and whole text, combined before the shuffle, so that
a text that a third of all rows share is one row a task. A digest with two different texts (a collision) is split by text.

Defined results: null texts count as empty; a null id loses to any other id, and rows without an id stay together with
keep_id null; of rows that repeat both id and text one is kept; an empty table gives an empty table; further columns
are ignored here and survive in `kept_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchframe.llm.common import documents, in_bitmap, key_bitmap, landed, shielded, text_of, work_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",  # of each executor
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",  # of each store; a full one goes to disk
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # else every entry is read before it is written
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # stores of ended queries are let go soon
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every store sets 4 MB aside
}


ARRIVALS = "doc_id long, row long, digest binary, locator string"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def state_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The kept state as a table."""
    state = spark.read.format("statestore").load(checkpoint)
    kinds = {f.name: f.name for f in state.schema["value"].dataType.fields}
    size = next(n for n in kinds if n.startswith("count"))
    latest = next(n for n in kinds if n.startswith("max"))
    return state.select(
        F.col("key.digest").alias("digest"),
        F.col(f"value.`{latest}`.doc_id").alias("keep_id"),
        F.col(f"value.`{latest}`.row").alias("keep_row"),
        F.col(f"value.`{size}`").alias("group_size"),
        F.col(f"value.`{latest}`.locator").alias("locator"),
    )


def digest_state(arrivals_path: str, spark: SparkSession, checkpoint: str, max_bytes: str | None = None) -> DataFrame:
    """Run the stream over what has arrived and return its state: digest, keep_id, keep_row, group_size, locator.

    A second call with the same checkpoint reads only new arrivals and goes on with the kept state."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(ARRIVALS)
        if max_bytes:
            reader = reader.option("maxBytesPerTrigger", max_bytes)
        seen = (
            reader.parquet(arrivals_path)
            .groupBy("digest")
            .agg(
                F.count(F.lit(1)).alias("group_size"),
                F.max(F.struct("doc_id", "row", "locator")).alias("latest"),
            )
        )
        run = (
            seen.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
        return landed(state_rows(spark, checkpoint), "exact-groups")  # read once, under the same bounds of memory
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, max_bytes: str | None = None
) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, digest."""
    spark = docs.sparkSession
    text = text_of(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), digest(text).alias("digest"))
    arrivals = work_dir(spark, "exact-arrivals")
    place = F.monotonically_increasing_id().alias("row")
    base.select("doc_id", place, "digest", F.input_file_name().alias("locator")).write.parquet(arrivals)
    keyed = spark.read.schema(ARRIVALS).parquet(arrivals)
    state = digest_state(arrivals, spark, work_dir(spark, "exact-state"), max_bytes)

    # the full bytes of every hit; a digest that only shares a bit with one is a group of its own
    again = key_bitmap(state.filter("group_size > 1"), F.xxhash64("digest"), "exact-hits")
    hits = base.filter(in_bitmap(again, F.xxhash64("digest")))
    variants = hits.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    texts = variants.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts"))
    split = landed(texts.filter("n_texts > 1").select("digest"), "exact-collisions")

    named = keyed.select("doc_id", "row", "digest").join(state.select("digest", "keep_id", "keep_row", "group_size"), "digest")
    named = named.withColumn("kept", F.col("row") == F.col("keep_row"))
    if not split.isEmpty():
        apart = base.join(split, "digest", "left_semi").join(variants.join(split, "digest", "left_semi"), ["digest", "text"])
        first = F.row_number().over(W.partitionBy("digest", "text", "doc_id").orderBy(F.lit(1)))
        apart = apart.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (first == 1))
        named = named.join(split, "digest", "left_anti").unionByName(apart, allowMissingColumns=True)
    return named.select("doc_id", "keep_id", "group_size", "kept", "digest")


@shielded
def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that exact deduplication keeps. Rows without a copy aren't shuffled."""
    groups = exact_groups(docs, id_col, text_col)
    many = landed(groups.filter("group_size > 1").select("doc_id", "digest", "keep_id"), "exact-copies")
    gone = many.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("__gone"), F.col("digest").alias("__of"))
    own = docs.withColumns({"__id": F.col(id_col).cast("long"), "__digest": sha256(text_of(text_col))})
    copied = in_bitmap(key_bitmap(many, F.xxhash64("digest"), "exact-bitmap"), F.xxhash64("__digest"))
    one = own.filter(copied).dropDuplicates(["__id", "__digest"])
    same = F.col("__id").eqNullSafe(F.col("__gone")) & (F.col("__digest") == F.col("__of"))
    one = one.join(gone.hint("merge"), same, "left_anti")
    return own.filter(~copied).select(*docs.columns).unionAll(one.select(*docs.columns))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, keep_id, group_size, kept, text_sha256."""
    found = exact_groups(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""

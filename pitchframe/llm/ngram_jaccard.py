"""N-gram Jaccard join: a grouped prefix join with exact verification.

Two documents link when 100 * |A & B| >= percent * |A | B| for their sets of distinct word shingles.

1. A table of CELLS counters over all shingles (summed inside tasks, then by block) ranks hashes: those of lighter cells
   come first. Any order gives right results; this one keeps passages that documents share out of prefixes.
2. Every document is sorted by (rank, hash) and cut to its prefix of n - ceil(percent * n / 100) + 1 shingles. Documents
   of one size and prefix make a group; equal sets make a class within it. Groups, not documents, are joined.
3. Groups that share a token of their prefixes are candidates if their sizes allow a link and if no more tokens come
   before the shared one than the two sets may differ by. In each bucket of a token all groups are first paired with
   one leader, the group that has the fewest rarer tokens, so that a bucket of m groups gives m - 1 pairs.
   Pairs of groups are then filtered by all that their prefixes show of how they differ.
4. Pairs are verified on the whole texts of one document of each class. Verified links give components.
5. What lies in one bucket but in different components is then paired without a leader, all of it, and verified. A
   bitmap of parities of each set tells most pairs that differ too much while they are joined (an exact bound).
   Documents that are in one component already need no further link, so a group of near copies isn't paired with itself.
   Classes within a group are handled as one more bucket.

Texts of classes that occur in pairs are fetched by a second scan that a bitmap of fixed size filters, then by a join.

Defined results: null texts count as empty; documents without words have no shingles, link with nothing and are their own
component; rows that repeat an id are told apart by their texts; null ids count as the largest in a component; an empty
table gives an empty table; further columns are ignored, and survive in `one_of_each`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm.byte_bpe import slices
from pitchframe.llm.common import documents, landed, shielded, text_batches, text_of, tidied
from pitchframe.llm.components import components
from pitchframe.llm.shingles import cells, shingle_hashes, shingle_sets

WIDTH, PERCENT = 5, 80
CELLS, BLOCK = 1 << 22, 1 << 12
BITMAP_BITS = 1 << 24
PARITY_BITS = 1024
MARKED = "rid long, doc_id long, mark long, n long, class binary, prefix array<long>, last long, parity array<long>"


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts of a block, all of them or, if few aren't 0, those with their places; a first byte tells which and how wide."""
    wide = int(counts.max() > 255)
    kind = np.uint32 if wide else np.uint8
    some = np.flatnonzero(counts)
    if len(some) * (2 + kind().itemsize) < BLOCK * kind().itemsize:
        return bytes([2 + wide]) + some.astype(np.uint16).tobytes() + counts[some].astype(kind).tobytes()
    return bytes([wide]) + counts.astype(kind).tobytes()


def add_packed(sums: np.ndarray, packed: memoryview) -> None:
    """Adds what packed_counts made."""
    form, body = packed[0], packed[1:]
    kind = np.uint32 if form & 1 else np.uint8
    if form < 2:
        sums += np.frombuffer(body, kind)
        return
    n = len(body) // (2 + kind().itemsize)
    sums[np.frombuffer(body[: 2 * n], np.uint16)] += np.frombuffer(body[2 * n :], kind)


def counted_cells(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Counts of all shingles of a task, a row for each block of cells that isn't empty."""
    found = np.zeros(CELLS, np.uint32)
    for batch in batches:
        for _, data, offsets in slices(batch.column(0)):
            _, h = shingle_hashes(data, offsets, width)
            at, n = np.unique(cells(h, CELLS), return_counts=True)
            found[at] += n.astype(np.uint32)
    blocks = [(k, b) for k, b in enumerate(found.reshape(-1, BLOCK)) if b.any()]
    for i in range(0, len(blocks), 64):
        some = blocks[i : i + 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in some], pa.int32()), pa.array([packed_counts(b) for _, b in some], pa.binary())], names=["block", "counts"]
        )


def summed_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by block, as batches come."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            if block not in sums:
                sums[block] = np.zeros(BLOCK, np.int64)
            add_packed(sums[block], memoryview(packed.as_buffer()).cast("B"))
    for block, counts in sums.items():
        total = pa.array([int(counts.sum())], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([counts.tobytes()], pa.binary()), total], names=["block", "counts", "total"])


def ranked_cells(batches: Iterator[pa.RecordBatch], mean: float) -> Iterator[pa.RecordBatch]:
    """A byte for each cell instead of its count, from the lightest: quarters of the deviation that chance gives, then powers of two.

    A shingle that a few deviations of documents share lies in no light cell, so prefixes hold few such shingles."""
    deviation = max(1.0, mean**0.5)
    for batch in batches:
        packed = []
        for counts in batch.column(1):
            z = (np.frombuffer(counts.as_buffer(), np.int64) - mean) / deviation
            fine = np.clip(np.floor((z + 4) * 4), 0, 31)
            coarse = np.clip(32 + np.floor(2 * np.log2(np.maximum(z, 4) / 4)), 32, 60)
            packed.append(np.where(z < 4, fine, coarse).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["block", "ranks"])


def ranks(texts: DataFrame, width: int) -> np.ndarray:
    """The rank of every cell. CELLS bytes reach the driver."""
    kinds = "block int, counts binary"
    parts = texts.mapInArrow(tidied(lambda batches: counted_cells(batches, width)), kinds)
    sums = landed(parts.repartition("block").mapInArrow(summed_cells, f"{kinds}, total long"), "jaccard-cells")
    mean = (sums.agg(F.sum("total")).first()[0] or 0) / CELLS
    out = np.zeros(CELLS, np.uint8)
    for row in sums.select("block", "counts").mapInArrow(lambda batches: ranked_cells(batches, mean), "block int, ranks binary").toLocalIterator():
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["ranks"], np.uint8)
    return out


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def order_keys(h: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Numbers that sort as (rank, hash) does."""
    return (rank[cells(h, len(rank))].astype(np.uint64) << np.uint64(57) | h >> np.uint64(7)).astype(np.int64)


def parities(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set PARITY_BITS bits, each the parity of how many of its hashes fall on it, as rows of 64-bit numbers.

    Two bitmaps differ in no more places than their sets differ in elements."""
    n = len(bounds) - 1
    place = (h % np.uint64(PARITY_BITS)).astype(np.int64) + np.repeat(np.arange(n), np.diff(bounds)) * PARITY_BITS
    odd = (np.bincount(place, minlength=n * PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, PARITY_BITS), axis=1).view(np.int64)


def differing(a: Column, b: Column) -> Column:
    """In how many places two parity bitmaps differ."""
    return reduce(Column.__add__, [F.bit_count(F.element_at(a, k).bitwiseXOR(F.element_at(b, k))) for k in range(1, PARITY_BITS // 64 + 1)])


def marked(docs: DataFrame, rank_of, width: int, percent: int) -> DataFrame:
    """docs(doc_id, mark, text) to a row each with its size, its class (a digest of its set) and its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(rank_of.value, np.uint8)
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for i, data, offsets in slices(batch.column(2)):
                n = len(offsets) - 1
                h, bounds = shingle_sets(data, offsets, width, rank)
                sizes = np.diff(bounds)
                classes, prefixes, lasts = [], [], []
                for k in range(n):
                    own = h[bounds[k] : bounds[k + 1]]
                    classes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    prefix = own[: prefix_size(len(own), percent)]
                    prefixes.append(prefix.view(np.int64) if len(own) else None)
                    lasts.append(int(order_keys(prefix[-1:], rank)[0]) if len(own) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(rid, rid + n), pa.int64()),
                        batch.column(0).slice(i, n),
                        batch.column(1).slice(i, n),
                        pa.array(sizes, pa.int64()),
                        pa.array(classes, pa.binary()),
                        pa.array(prefixes, pa.list_(pa.int64())),
                        pa.array(lasts, pa.int64()),
                        pa.array(list(parities(h, bounds)), pa.list_(pa.int64())),
                    ],
                    names=["rid", "doc_id", "mark", "n", "class", "prefix", "last", "parity"],
                )
                rid += n

    return docs.select("doc_id", "mark", "text").mapInArrow(tidied(run), MARKED)


def may_differ(n: Column, m: Column, percent: int) -> Column:
    """By how many elements sets of sizes n and m that link differ at most."""
    return n + m - 2 * F.ceil((n + m) * percent / F.lit(100.0 + percent) - F.lit(1e-9))


def may_link(n: Column, m: Column, percent: int, i: Column, j: Column) -> Column:
    """Whether sets of sizes n and m, whose first shared token is at places i and j, can still link."""
    shared = F.ceil((n + m) * percent / F.lit(100.0 + percent) - F.lit(1e-9))  # the least intersection of a link
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    return sizes & (i + j <= n + m - 2 * shared) & (1 + F.least(n - 1 - i, m - 1 - j) >= shared)


def plausible(batches: Iterator[pa.RecordBatch], rank_of, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of groups whose known parts of their prefixes don't already differ by more than a link allows.

    Columns: four numbers to keep, then for both groups their shared tokens, places, sizes and last keys. Tokens that
    aren't shared with any group differ for sure; up to the lesser of the last keys all tokens of both are known."""
    rank = np.frombuffer(rank_of.value, np.uint8)
    for batch in batches:
        ta, tb, pa_, pb, na, nb, la, lb = (batch.column(i).to_pylist() for i in range(4, 12))
        keep = []
        for k in range(batch.num_rows):
            known = []
            a, b = np.array(ta[k], np.int64), np.array(tb[k], np.int64)
            cut = min(la[k], lb[k])
            for tokens, places, n, last in ((a, pa_[k], na[k], la[k]), (b, pb[k], nb[k], lb[k])):
                if last == cut:
                    known.append(prefix_size(n, percent))
                else:
                    within = np.array(places)[order_keys(tokens.view(np.uint64), rank) <= cut]
                    known.append(int(within.max()) + 1 if len(within) else 0)
            shared = len(np.intersect1d(a, b, assume_unique=True))
            least = -(-percent * (na[k] + nb[k]) // (100 + percent))
            keep.append(sum(known) - 2 * shared <= na[k] + nb[k] - 2 * least)
        yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["u", "v", "g", "h"]).filter(pa.array(keep, pa.bool_()))


def intersections(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, text of a, text of b) to the pairs that link. Texts that repeat in a batch are cut into shingles once."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            coded = pa.concat_arrays([part.column(2), part.column(3)]).dictionary_encode()
            sets: list[np.ndarray] = []
            for _, data, offsets in slices(coded.dictionary):
                h, bounds = shingle_sets(data, offsets, width)
                sets += [h[bounds[k] : bounds[k + 1]] for k in range(len(offsets) - 1)]
            which = coded.indices.to_numpy(zero_copy_only=False)
            keep = []
            for k in range(part.num_rows):
                a, b = sets[which[k]], sets[which[k + part.num_rows]]
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


class JaccardJoin:
    """The steps of one join; `rows` is what each document became, `classes` and `groups` what they were collapsed to."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> None:
        self.width, self.percent = width, percent
        text_batches(docs.sparkSession)
        text = text_of(text_col)
        self.docs = docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text, F.length(text)).alias("mark"), text.alias("text")
        )
        self.rank = docs.sparkSession.sparkContext.broadcast(ranks(self.docs.select("text"), width).tobytes())
        self.rows = landed(marked(self.docs, self.rank, width, percent), "jaccard-rows")
        group = F.sha2(F.concat_ws(",", F.col("n").cast("string"), F.col("prefix").cast("array<string>")), 256)
        worded = self.rows.filter("n > 0").withColumn("group", F.substring(F.unhex(group), 1, 16))
        classes = worded.groupBy("class").agg(
            F.min("rid").alias("cid"), F.min("doc_id").alias("least_id"), F.min(F.struct("rid", "doc_id", "mark")).alias("at"), F.first("group").alias("group"), F.first("parity").alias("parity")
        )
        self.classes = landed(classes.select("class", "cid", "least_id", "at.doc_id", "at.mark", "group", "parity"), "jaccard-classes")
        groups = worded.groupBy("group").agg(F.min("rid").alias("gid"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("last").alias("last"))
        self.groups = landed(groups, "jaccard-groups")
        named = self.groups.select("group", "gid", "n")
        self.members = landed(self.classes.select("cid", "group").join(named, "group").select("cid", "gid", "n"), "jaccard-members")

    def buckets(self) -> DataFrame:
        """token, gid, n, at, and the bucket's leader, for the tokens that two groups or more share."""
        posts = self.groups.select("gid", "n", F.posexplode("prefix").alias("at", "token"))
        shared = posts.groupBy("token").agg(F.count(F.lit(1)).alias("groups"), F.min(F.struct("at", "gid", "n")).alias("lead")).filter("groups > 1")
        shared = shared.select("token", F.col("lead.gid").alias("lead_gid"), F.col("lead.n").alias("lead_n"), F.col("lead.at").alias("lead_at"))
        return posts.join(shared.hint("merge"), "token")

    def filtered(self, pairs: DataFrame, buckets: DataFrame) -> DataFrame:
        """pairs(u, v, g, h) without those whose groups g and h can't link by what their prefixes show."""
        held = buckets.groupBy("gid").agg(F.collect_list("token").alias("tokens"), F.collect_list("at").alias("places"))
        held = held.join(self.groups.select("gid", "n", "last"), "gid")
        both = pairs
        for side in ("g", "h"):
            own = held.select(F.col("gid").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("tokens", "places", "n", "last")])
            both = both.join(own.hint("merge"), side)
        columns = [f"{side}_{c}" for c in ("tokens", "places", "n", "last") for side in ("g", "h")]
        rank, percent = self.rank, self.percent
        return both.select("u", "v", "g", "h", *columns).mapInArrow(tidied(lambda x: plausible(x, rank, percent)), "u long, v long, g long, h long")

    def first_pairs(self, buckets: DataFrame) -> DataFrame:
        """Pairs of classes (u < v): of each group with the leaders of its buckets, and of classes within a group."""
        ok = may_link(F.col("n"), F.col("lead_n"), self.percent, F.col("at"), F.col("lead_at"))
        grouped = buckets.filter((F.col("gid") != F.col("lead_gid")) & ok).select("gid", "lead_gid").distinct()
        grouped = grouped.select(*[F.col(c).alias(a) for c, a in (("gid", "u"), ("lead_gid", "v"), ("gid", "g"), ("lead_gid", "h"))])
        grouped = self.filtered(grouped, buckets).select(F.col("u").alias("gid"), F.col("v").alias("lead_gid"))
        leads = self.members.groupBy("gid").agg(F.min("cid").alias("lead"))
        inside = self.members.join(leads, "gid").filter("cid <> lead").select(F.col("lead").alias("u"), F.col("cid").alias("v"))
        across = grouped.join(leads, "gid").withColumnRenamed("lead", "u").join(leads.select(F.col("gid").alias("lead_gid"), F.col("lead").alias("v")), "lead_gid")
        return across.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).union(inside).distinct()

    def other_pairs(self, buckets: DataFrame, roots: DataFrame, done: DataFrame) -> DataFrame:
        """All further pairs of classes that share a bucket and are in different components."""
        placed = self.members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        placed = landed(placed, "jaccard-placed")
        inside = placed.select(F.lit(1).alias("kind"), F.col("gid").alias("token"), "cid", "gid", "root", "n", F.lit(0).alias("at"))
        across = buckets.select("token", "gid", "at").join(placed, "gid").select(F.lit(0).alias("kind"), "token", "cid", "gid", "root", "n", "at")
        every = across.union(inside)
        by_root = every.groupBy("kind", "token", "root").agg(F.count(F.lit(1)).alias("n"))
        mixed = by_root.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).alias("main")).filter("roots > 1")
        rest = landed(every.join(mixed.select("kind", "token", F.col("main.root").alias("main")).hint("merge"), ["kind", "token"]), "jaccard-rest")
        rest = landed(rest.join(self.classes.select("cid", "parity").hint("merge"), "cid"), "jaccard-rest")
        a = rest.filter("root <> main").select("kind", "token", *[F.col(c).alias(f"a_{c}") for c in ("cid", "gid", "root", "n", "at", "parity")])
        b = rest.select("kind", "token", *[F.col(c).alias(f"b_{c}") for c in ("cid", "gid", "root", "n", "at", "parity", "main")])
        ok = (F.col("kind") == 1) | may_link(F.col("a_n"), F.col("b_n"), self.percent, F.col("a_at"), F.col("b_at"))
        ok = ok & (differing(F.col("a_parity"), F.col("b_parity")) <= may_differ(F.col("a_n"), F.col("b_n"), self.percent))
        order = (F.col("b_root") == F.col("b_main")) | (F.col("a_cid") < F.col("b_cid"))
        pairs = a.join(b, ["kind", "token"]).filter((F.col("a_root") != F.col("b_root")) & order & ok)
        pairs = pairs.select("kind", F.least("a_cid", "b_cid").alias("u"), F.greatest("a_cid", "b_cid").alias("v"), F.col("a_gid").alias("g"), F.col("b_gid").alias("h"))
        pairs = landed(pairs.distinct().join(done, ["u", "v"], "left_anti"), "jaccard-pairs")
        across = self.filtered(pairs.filter("kind = 0").select("u", "v", "g", "h"), buckets)
        return across.select("u", "v").union(pairs.filter("kind = 1").select("u", "v")).distinct()

    def texts(self, pairs: DataFrame) -> DataFrame:
        """cid and text for the classes of pairs. A bitmap of BITMAP_BITS bits drops most other texts while scanning."""
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("cid")).distinct()
        wanted = landed(self.classes.select("cid", "doc_id", "mark").join(wanted, "cid", "left_semi"), "jaccard-wanted")
        bit = F.pmod("mark", F.lit(BITMAP_BITS)) + 1  # Spark's first bucket begins at 1
        bits = wanted.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
        bitmap = np.zeros((BITMAP_BITS // 32768, 4096), np.uint8)
        for row in bits.collect():  # BITMAP_BITS / 32768 rows at most
            bitmap[row["bucket"] - 1] = np.frombuffer(row["bits"], np.uint8)
        shared = self.docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(shared.value, np.uint8)
            for batch in batches:
                place = batch.column(1).to_numpy() % BITMAP_BITS
                yield batch.filter(pa.array((bits[place >> 3] >> (place & 7) & 1).astype(bool)))

        found = self.docs.mapInArrow(tidied(run), "doc_id long, mark long, text string")
        key = wanted.withColumnsRenamed({"doc_id": "w_id", "mark": "w_mark"}).hint("merge")
        same = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark"))
        return landed(found.join(key, same).select("cid", "text").dropDuplicates(["cid"]), "jaccard-texts")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that link."""
        texts = self.texts(pairs)
        both = pairs.join(texts.select(F.col("cid").alias("u"), F.col("text").alias("u_text")).hint("merge"), "u")
        both = both.join(texts.select(F.col("cid").alias("v"), F.col("text").alias("v_text")).hint("merge"), "v")
        width, percent = self.width, self.percent
        return both.select("u", "v", "u_text", "v_text").mapInArrow(tidied(lambda x: intersections(x, width, percent)), "u long, v long")

    def links(self) -> DataFrame:
        """Verified links between classes that join all components (not every link within one)."""
        buckets = landed(self.buckets(), "jaccard-buckets")
        first = landed(self.first_pairs(buckets), "jaccard-pairs")
        linked = landed(self.verified(first), "jaccard-links")
        other = landed(self.other_pairs(buckets, components(linked), first), "jaccard-pairs")
        if other.isEmpty():
            return linked
        return linked.union(landed(self.verified(other), "jaccard-links"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """A row for each row of docs: doc_id, mark, rid, n_shingles, component_id (the least id of its component)."""
    join = JaccardJoin(docs, id_col, text_col, width, percent)
    roots = components(join.links()).withColumnRenamed("node", "cid")
    placed = join.classes.select("class", "cid", "least_id").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = landed(placed.join(least, "root").select("class", "component_id"), "jaccard-components")
    worded = join.rows.filter("n > 0").select("doc_id", "mark", "rid", "n", "class").join(named, "class")
    empty = join.rows.filter("n = 0").select("doc_id", "mark", "rid", "n", F.col("doc_id").alias("component_id"))
    return worded.select("doc_id", "mark", "rid", "n", "component_id").union(empty).withColumnRenamed("n", "n_shingles")


@shielded
def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with their columns, that are the least of their component, and all without an id."""
    found = similar_components(docs, id_col, text_col, width, percent)
    gone = found.filter("doc_id > component_id").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    text = text_of(text_col)
    same = (F.col(id_col).cast("long") == F.col("__id")) & (F.xxhash64(text, F.length(text)) == F.col("__mark"))
    return docs.join(gone.hint("merge"), same, "left_anti").select(*docs.columns)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: n_shingles and component_id, by four-word shingles at 85 per cent."""
    found = similar_components(documents(spark, sf_dir), width=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")

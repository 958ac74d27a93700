"""The prefix trie of conversations by distributed MSD radix partitioning.

Distinct turns get numbers from a dictionary (keyed by the SHA-256 of role and text), so that a conversation is an array
of numbers; one of more than SEGMENT turns is several such arrays. Conversations with equal arrays become one row with a
count, combined before the shuffle, so that copies never meet. Buckets of rows with a common prefix are then recursed: a
bucket with more than LOCAL turns left is partitioned by its next turn, and the prefix that all rows of a part share
(that of its least and greatest array) is passed in one step; a smaller one goes to one task, where multikey quicksort
splits it by one turn at a time and each equal part that its recursion enters is a node. What nodes sum over their
subtrees is carried back up, part by part. Segments behind an array that several conversations share are buckets of the
next round; where one conversation is alone, its remaining turns are nodes as they stand and are never gathered.

Digests of members read their ids in order: ids are first joined to texts of at most 2^CHUNK_BITS ids, the texts of a node
then pass one task as a stream (a SHA-256 can't be split).

Defined results: turns of equal number are ordered by the digest of role and text; turns without conv_id belong to no
conversation and are left out; repeated turns are turns of their own; an empty table has no nodes, not even a root; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm.common import landed, text_of
from pitchframe.llm.ranks import ranked

SEGMENT = 1024
LOCAL = 1 << 15
HOT = 1000  # turns with more than this part of all rows, so at most as many, are looked up without a shuffle
CHUNK_BITS = 12
HEADS, FAMILY = 4, 20
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long"
FOUND = f"is_top boolean, {NODE}"
EXTRA = ["more_children", "more_leaves", "more_saved"]


def turn_rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, digest of role and text, words of the text."""
    role, text = text_of("role"), text_of("text")
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def coded(turns: DataFrame) -> DataFrame:
    """turns (digest and more) with code in place of digest: the number of its digest in a dictionary of all."""
    words = turns.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"))
    words = landed(words.withColumn("code", F.monotonically_increasing_id()), "dictionary")
    total = words.agg(F.sum("rows")).first()[0] or 0
    hot = words.filter(F.col("rows") * HOT > total).select("digest", F.col("code").alias("hot"))  # at most HOT rows
    both = turns.join(F.broadcast(hot), "digest", "left")
    rest = both.filter("hot is null").join(words.select("digest", "code"), "digest")
    names = [c for c in turns.columns if c != "digest"]
    return both.filter("hot is not null").select(*names, F.col("hot").alias("code")).unionByName(rest.select(*names, "code"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose heads come from another of their family: (conv, at, code, words) and (conv, length).

    The first h turns, h = CRC-32 of the conv_id modulo HEADS, come from the conversation conv_id - conv_id % FAMILY."""
    own = landed(turn_rows(turns).withColumn("rid", F.monotonically_increasing_id()), "turns")
    placed = ranked(own, ["conv_id"], ["turn", "digest", "rid"]).select("conv_id", "place", "size", "digest", "words")
    placed = landed(coded(landed(placed, "turns-placed")), "turns-coded")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h")
    convs = placed.groupBy("conv_id").agg(F.max("size").alias("size"))
    convs = convs.select("conv_id", "size", h, (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("origin"))
    given = convs.select(F.col("conv_id").alias("origin"), F.col("size").alias("there"))
    take = F.least("h", F.coalesce("there", F.lit(0))).alias("take")
    convs = landed(convs.join(given, "origin", "left").select("conv_id", "size", "h", "origin", take), "convs")
    later = placed.join(convs.select("conv_id", "h", "take"), "conv_id").filter("place >= h")
    later = later.select(F.col("conv_id").alias("conv"), (F.col("take") + F.col("place") - F.col("h")).alias("at"), "code", "words")
    heads = placed.filter((F.col("place") < HEADS - 1) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "origin")
    heads = heads.join(convs.select("origin", F.col("conv_id").alias("conv"), "take"), "origin").filter("place < take")
    heads = heads.select("conv", F.col("place").alias("at"), "code", "words")
    length = (F.col("take") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length")
    return later.unionAll(heads), convs.select(F.col("conv_id").alias("conv"), length)


# ------------------------------------------------------------------ one task's buckets


def grown(top: int, at: int, rows: list) -> Iterator[tuple]:
    """Nodes below (top, at) of rows (group, codes, words, n, ended, children, leaves, saved), and last what comes to (top, at).

    Multikey quicksort: each call splits its rows by their turn at one depth into less, equal and greater; an equal part
    is a node and goes on one turn deeper."""
    parent, depth, conv, count, word, children, leaves, saved, ends = [-1], [at], [top], [0], [0], [0], [0], [0], [None]

    def node(above: int, d: int, own: list, words: int) -> int:
        for column, value in zip((parent, depth, conv, count, word), (above, d, min(r[0] for r in own), sum(r[3] for r in own), words)):
            column.append(value)
        for column in (children, leaves, saved):
            column.append(0)
        ends.append(None)
        children[above] += 1
        return len(parent) - 1

    def stop(i: int, row: tuple) -> None:
        group, _, _, _, ended, more_children, more_leaves, more_saved = row
        ends[i] = group if ended else None
        children[i] += more_children
        leaves[i] += more_leaves
        saved[i] += more_saved

    calls = [(rows, at, 0)]
    while calls:
        own, d, above = calls.pop()
        rest = []
        for row in own:
            stop(above, row) if len(row[1]) == d else rest.append(row)
        if not rest:
            continue
        pivot = rest[len(rest) // 2][1][d]
        equal = [r for r in rest if r[1][d] == pivot]
        if len(equal) < len(rest):
            calls += [(part, d, above) for part in ([r for r in rest if r[1][d] < pivot], [r for r in rest if r[1][d] > pivot]) if part]
        calls.append((equal, d + 1, node(above, d + 1, equal, equal[0][2][d])))
    for i in range(len(parent) - 1, 0, -1):
        leaves[i] += not children[i]
        saved[i] += (count[i] - 1) * word[i]
        leaves[parent[i]] += leaves[i]
        saved[parent[i]] += saved[i]
        yield False, conv[i], depth[i], conv[parent[i]], count[i], children[i], leaves[i], saved[i], ends[i]
    yield True, top, at, None, 0, children[0], leaves[0], saved[0], ends[0]


def finished(rows: DataFrame) -> DataFrame:
    """Nodes of all buckets (top, at) of rows, and a row is_top for what comes to each bucket's own node."""

    def run(own: Iterator) -> Iterator[tuple]:
        for (top, at), bucket in groupby(own, key=lambda r: (r[0], r[1])):
            yield from grown(top, at, [tuple(r[2:]) for r in bucket])

    dealt = rows.select("top", "at", "group", "codes", "words", "n", "ended", *EXTRA).repartition("top", "at").sortWithinPartitions("top", "at")
    return landed(rows.sparkSession.createDataFrame(dealt.rdd.mapPartitions(run), FOUND, verifySchema=False), "trie-local")


# ------------------------------------------------------------------ buckets that are too large for a task


def shared(lo: str, hi: str) -> Column:
    """How many first elements two arrays have in common."""
    near = F.least(F.size(lo), F.size(hi))
    differ = f"filter(sequence(1, greatest(1, least(size({lo}), size({hi})))), i -> not element_at({lo}, i) <=> element_at({hi}, i))"
    return F.when(near == 0, 0).otherwise(F.coalesce(F.expr(f"get({differ}, 0)") - 1, near))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One radix step. rows of large buckets (top, at) to the same rows in their parts, edges, and rows that end at their top.

    An edge is the chain of nodes from a bucket's top down to the top of one of its parts: (top, at) to (m, to)."""
    ending = rows.filter(F.size("codes") == F.col("at"))
    rest = rows.filter(F.size("codes") > F.col("at")).withColumn("digit", F.expr("element_at(codes, at + 1)"))
    parts = rest.groupBy("top", "at", "digit").agg(
        F.min("group").alias("m"), F.sum("n").alias("n"), F.min(F.struct("codes", "words")).alias("lo"), F.max("codes").alias("hi")
    )
    parts = parts.select("top", "at", "digit", "m", "n", F.col("lo.codes").alias("low"), F.col("lo.words").alias("words"), "hi")
    parts = landed(parts.withColumn("to", shared("low", "hi")).drop("low", "hi"), "trie-edges")
    moved = rest.join(parts.select("top", "at", "digit", "m", "to"), ["top", "at", "digit"]).drop("top", "at", "digit")
    return moved.withColumnsRenamed({"m": "top", "to": "at"}), parts, ending


def sums(df: DataFrame) -> DataFrame:
    return df.groupBy("top", "at").agg(*[F.sum(c).alias(c) for c in EXTRA], F.max("ends").alias("ends"))


def edge_nodes(edges: DataFrame, tops: DataFrame, base: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of edges, and what each edge brings to the top it hangs from. tops: what came to the lower ends."""
    below = tops.select(F.col("top").alias("m"), F.col("at").alias("to"), *EXTRA, "ends")
    own = edges.join(below, ["m", "to"], "left").fillna(0, EXTRA)
    own = own.withColumn("leaves", F.when(F.col("more_children") == 0, 1).otherwise(F.col("more_leaves")))
    saved = F.expr("more_saved + (n - 1) * aggregate(slice(words, d, to - d + 1), 0L, (s, w) -> s + w)")
    last = F.col("d") == F.col("to")
    nodes = own.withColumn("d", F.explode(F.expr("sequence(at + 1, to)"))).select(
        F.col("m").alias("conv_id"),
        (F.col("d") + base).cast("long").alias("depth"),
        F.when(F.col("d") == F.col("at") + 1, F.col("top")).otherwise(F.col("m")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("more_children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").cast("long").alias("n_leaves"),
        saved.cast("long").alias("saved_tokens"),
        F.when(last, F.col("ends")).alias("ends"),
    )
    whole = F.expr("more_saved + (n - 1) * aggregate(slice(words, at + 1, to - at), 0L, (s, w) -> s + w)")
    brought = own.select(
        "top", "at", F.lit(1).cast("long").alias("more_children"), F.col("leaves").cast("long").alias("more_leaves"),
        whole.cast("long").alias("more_saved"), F.lit(None).cast("long").alias("ends"),
    )
    return nodes, brought


def grouped_trie(groups: DataFrame, base: int, local: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes of groups (bucket, group, codes, words, n, ended, more_*) whose buckets stand at depth base; what comes to each bucket."""
    rows = groups.withColumnsRenamed({"bucket": "top"}).withColumn("at", F.lit(0))
    small, steps = None, []
    while True:
        sizes = rows.groupBy("top", "at").agg(F.sum(F.size("codes") - F.col("at") + 1).alias("left"))
        large = landed(sizes.filter(F.col("left") > local).select("top", "at"), "trie-large")
        done = large.isEmpty()
        own = rows if done else rows.join(large, ["top", "at"], "left_anti")
        small = own if small is None else small.unionByName(own)
        if done:
            break
        rows, edges, ending = split(rows.join(large, ["top", "at"], "left_semi"))
        rows = landed(rows, "trie-rows")
        steps.append((edges, ending))
    found = finished(small)
    nodes = [found.filter("not is_top").drop("is_top").withColumn("depth", F.col("depth") + base)]
    tops = found.filter("is_top").select(
        F.col("conv_id").alias("top"), F.col("depth").cast("int").alias("at"), F.col("n_children").alias("more_children"),
        F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved"), "ends",
    )
    for edges, ending in reversed(steps):
        own, brought = edge_nodes(edges, tops, base)
        nodes.append(own)
        ended = ending.select("top", "at", *EXTRA, F.when(F.col("ended"), F.col("group")).alias("ends"))
        tops = landed(tops.unionByName(sums(brought.unionByName(ended))), "trie-tops")
    return nodes, tops.filter("at = 0")


# ------------------------------------------------------------------ the whole


def member_digests(members: DataFrame) -> DataFrame:
    """members (ends, depth, conv) to ends, depth, ends_sha256: of their ids in order, joined by commas."""
    order = F.array_sort(F.collect_list("conv"))
    texts = members.groupBy("ends", "depth", F.shiftright("conv", CHUNK_BITS).alias("chunk")).agg(
        F.array_join(F.transform(order, lambda c: c.cast("string")), ",").alias("ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for ends, depth, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (ends, depth) != key:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (ends, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield batch_of(out)
            out = []
        if key:
            yield batch_of([(*key, state.hexdigest())])

    def batch_of(rows: list) -> pa.RecordBatch:
        columns = zip(zip(*rows) if rows else [()] * 3, (pa.int64(), pa.int64(), pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in columns], names=["ends", "depth", "ends_sha256"])

    dealt = texts.repartition("ends", "depth").sortWithinPartitions("ends", "depth", "chunk").select("ends", "depth", "ids")
    return dealt.mapInArrow(run, "ends long, depth long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame, segment: int = SEGMENT, local: int = LOCAL) -> DataFrame:
    """turns (conv, at, code, words), lengths (conv, length): the nodes of the trie of all conversations."""
    lengths = landed(lengths, "trie-lengths")
    root, n = lengths.agg(F.min("conv"), F.count(F.lit(1))).first()
    spark = turns.sparkSession
    if not n:
        return spark.createDataFrame([], NODE).drop("ends").withColumn("ends_sha256", F.lit(""))
    one = F.array_sort(F.collect_list(F.struct("at", "code", "words")))
    parts = turns.groupBy("conv", F.expr(f"at div {segment}").alias("part")).agg(one.alias("x"))
    parts = landed(parts.select("conv", "part", F.col("x.code").alias("codes"), F.col("x.words").alias("words")), "trie-segments")
    parts = parts.join(lengths, "conv")
    none = F.array().cast("array<long>")
    rows = parts.filter("part = 0").drop("part").unionByName(lengths.filter("length = 0").select("conv", none.alias("codes"), none.alias("words"), "length"))
    rows = rows.withColumn("bucket", F.lit(root))
    rounds, nodes, members, r = [], [], [], 0
    while True:
        on = F.col("length") > segment * (r + 1)
        rows = landed(rows.withColumn("on", on), "trie-round")
        groups = rows.groupBy("bucket", "codes", "words").agg(
            F.min("conv").alias("group"), F.count(F.lit(1)).alias("n"), F.count_if("on").alias("n_on")
        )
        groups = landed(groups, "trie-groups")
        rounds.append(groups)
        held = rows.join(groups.select("bucket", "codes", "group", "n_on"), ["bucket", "codes"])
        held = landed(held.select("conv", "length", "on", "group", "n_on"), "trie-held")
        members.append(held.filter("not on").select(F.col("group").alias("ends"), F.col("length").alias("depth"), "conv"))
        alone = held.filter("on and n_on = 1").select("conv", "group")
        first, end = F.col("depth") == segment * (r + 1) + 1, F.col("depth") == F.col("length")
        chain = parts.filter(F.col("part") > r).join(alone, "conv")
        chain = chain.select("conv", "group", "length", F.posexplode("codes").alias("i", "code"), "part")
        chain = chain.withColumn("depth", (F.col("part") * segment + F.col("i") + 1).cast("long"))
        nodes.append(
            chain.select(
                F.col("conv").alias("conv_id"),
                "depth",
                F.when(first, F.col("group")).otherwise(F.col("conv")).alias("parent_conv_id"),
                *[F.lit(v).cast("long").alias(c) for c, v in (("n_convs", 1), ("n_leaves", 1), ("saved_tokens", 0))],
                F.when(end, 0).otherwise(1).cast("long").alias("n_children"),
                F.when(end, F.col("conv")).alias("ends"),
            )
        )
        members.append(alone.join(lengths, "conv").select(F.col("conv").alias("ends"), F.col("length").alias("depth"), "conv"))
        if groups.filter("n_on > 1").isEmpty():
            break
        rows = parts.filter(F.col("part") == r + 1).drop("part").join(held.filter("on and n_on > 1").select("conv", F.col("group").alias("bucket")), "conv")
        r += 1
    tops = None
    for r in range(len(rounds) - 1, -1, -1):
        groups = rounds[r].withColumn("ended", F.col("n") > F.col("n_on"))
        if tops is None:
            more = [F.when(F.col("n_on") == 1, v).otherwise(0).cast("long").alias(c) for c, v in zip(EXTRA, (1, 1, 0))]
            groups = groups.select("*", *more)
        else:
            below = tops.select(F.col("top").alias("group"), *[F.col(c).alias(f"deep_{c}") for c in EXTRA])
            groups = groups.join(below, "group", "left")
            more = [F.when(F.col("n_on") == 1, v).when(F.col("n_on") > 1, F.col(f"deep_{c}")).otherwise(0).cast("long").alias(c) for c, v in zip(EXTRA, (1, 1, 0))]
            groups = groups.select(*rounds[r].columns, "ended", *more)
        groups = landed(groups.drop("n_on"), "trie-weighted")
        own, tops = grouped_trie(groups, segment * r, local)
        nodes += own
    nodes.append(
        tops.select(
            F.col("top").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n).cast("long").alias("n_convs"),
            F.col("more_children").alias("n_children"), F.greatest("more_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.col("more_saved").alias("saved_tokens"), "ends",
        )
    )
    every = nodes[0]
    for own in nodes[1:]:
        every = every.unionByName(own)
    ids = members[0]
    for own in members[1:]:
        ids = ids.unionByName(own)
    found = every.join(member_digests(ids), ["ends", "depth"], "left")
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).drop("ends")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    turns, lengths = rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return trie(turns, lengths).select(*names)


OP13_SQL = r"""
WITH b AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
         md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (
  SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''),
           lambda x: list_transform(range(8), lambda b: (ascii(x)::BIGINT >> b) & 1)))),
           lambda x, b: xor(x >> 1, CASE WHEN xor(x, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM b)),
t AS (
  SELECT h.c, 0 AS part, b.i, b.k, b.w FROM h JOIN b ON b.c = h.c - h.c % 20 AND b.i < h.h
  UNION ALL
  SELECT h.c, 1, b.i, b.k, b.w FROM h JOIN b ON b.c = h.c AND b.i >= h.h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, k, w FROM t),
q AS MATERIALIZED (
  SELECT c, d, w, md5(string_agg(k, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS p FROM s
  UNION ALL SELECT c, 0, 0, '' FROM h),
n AS MATERIALIZED (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, max(w) AS w FROM q GROUP BY p, d),
u AS MATERIALIZED (
  SELECT n.p, n.d, n.conv_id, n.n_convs, n.w, o.p AS above, m.conv_id AS parent_conv_id
  FROM n LEFT JOIN q o ON o.c = n.conv_id AND o.d = n.d - 1 LEFT JOIN n m ON m.p = o.p AND m.d = o.d),
k AS (SELECT above AS p, d - 1 AS d, count(*) AS n FROM u WHERE d > 0 GROUP BY ALL),
v AS (SELECT u.*, coalesce(k.n, 0) AS n_children FROM u LEFT JOIN k ON k.p = u.p AND k.d = u.d),
sums AS (
  SELECT q.p, q.d, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.w) AS saved_tokens
  FROM v JOIN q ON q.c = v.conv_id AND q.d <= v.d GROUP BY q.p, q.d),
last AS (SELECT c, max(d) AS d FROM q GROUP BY c),
ends AS (SELECT q.p, q.d, string_agg(q.c::VARCHAR, ',' ORDER BY q.c) AS ids FROM q JOIN last USING (c, d) GROUP BY q.p, q.d)
SELECT v.conv_id, v.d::BIGINT AS depth, v.parent_conv_id, v.n_convs, v.n_children::BIGINT AS n_children, sums.n_leaves::BIGINT AS n_leaves,
       sums.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM v JOIN sums ON sums.p = v.p AND sums.d = v.d LEFT JOIN ends ON ends.p = v.p AND ends.d = v.d
"""

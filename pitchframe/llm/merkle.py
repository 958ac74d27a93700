"""A Merkle manifest of a dataset: leaves of rows, a tree for each group of rows, a tree of their roots, proofs of all rows.

H is the lowercase hex SHA-256 of its inputs one behind the other, digests as hex text. A leaf is H of a row's fields,
each as its UTF-8 byte count, ":" and value, or "-" for null. In a group leaves ascend by id; every two nodes that follow
each other become their H, a lone last one too, until one node is left: the group's root. The roots of groups, ordered by
the group's value, become the root of the dataset in the same way.

Trees are built by supersteps on RDDs. A vertex stands for a block of 2^LEVELS neighbouring nodes of a tree and the
levels above them. Upwards, nodes send their digests to their block; a block that has them hashes its levels and sends its
top to the block above, until one is left; blocks of all trees step together. Downwards, the top block sends to each of
its nodes the siblings on their way to the root; each block below puts its own siblings before those and sends them on,
until they reach the rows. The blocks of each step are written to the shared folder, so that no superstep depends on an
executor that may be lost. There are log(rows) / LEVELS steps each way, a block holds 2^LEVELS digests whatever the size
of its group, and the driver sees only how many nodes the largest tree has.

Defined results: null ids come first; rows with equal ids are ordered by their leaves (equal leaves are interchangeable);
a null group is a group of its own and comes first; a group of one row has its leaf as root; an empty table has no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm.common import documents, landed
from pitchframe.llm.ranks import ranked

LEVELS = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
BYTES = 32
STATE = "tree long, block long, nodes long, digests binary"
PROOF = "id long, leaf binary, group_root binary, root binary, siblings binary, folded_root binary"


def field(value: Column) -> Column:
    """A field as text: its byte count, a colon and itself, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def h(*digests: bytes) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def height(nodes: int) -> int:
    """Levels above so many nodes."""
    return (nodes - 1).bit_length()


def levels_of(digests: bytes, nodes: int, levels: int) -> list[list[bytes]]:
    """The nodes of a block, level by level, its top last. nodes: how many the whole tree has at the block's level."""
    now = [digests[i : i + BYTES] for i in range(0, len(digests), BYTES)]
    found = [now]
    for _ in range(min(levels, height(nodes))):
        now = [h(*now[i : i + 2]) for i in range(0, len(now), 2)]
        found.append(now)
    return found


def siblings(levels: list[list[bytes]], place: int) -> bytes:
    """Of the node at place, from its own level up to the one below the top."""
    own = [level[i] for t, level in enumerate(levels[:-1]) if (i := place >> t ^ 1) < len(level)]
    return b"".join(own)


def folded(digest: bytes, ways: list[tuple[int, int]], path: bytes) -> bytes:
    """The root that a digest and its siblings lead to. ways: (place, nodes) in each tree on the way."""
    at = 0
    for place, nodes in ways:
        for t in range(height(nodes)):
            i = place >> t
            if i ^ 1 > (nodes - 1) >> t:  # no sibling
                digest = h(digest)
                continue
            other = path[at : at + BYTES]
            at += BYTES
            digest = h(other, digest) if i & 1 else h(digest, other)
    return digest


def climbed(nodes: RDD, most: int, spark: SparkSession, tasks: int, levels: int) -> list[DataFrame]:
    """nodes ((tree, block), (place, nodes, digest)) to the blocks of every superstep, upwards. most: nodes of the largest tree."""
    steps = []
    while True:

        def block(x):
            (tree, number), own = x
            own = sorted(own)
            return tree, number, own[0][1], b"".join(d for _, _, d in own)

        steps.append(landed(spark.createDataFrame(nodes.groupByKey(tasks).map(block), STATE, verifySchema=False), "merkle-blocks"))
        if most <= 1 << levels:
            return steps
        most = -(-most >> levels)

        def up(r):
            top = levels_of(bytes(r["digests"]), r["nodes"], levels)[-1][0]
            return (r["tree"], r["block"] >> levels), (r["block"] & (1 << levels) - 1, -(-r["nodes"] >> levels), top)

        nodes = steps[-1].filter(F.col("nodes") > 1 << levels).rdd.map(up)


def tops(steps: list[DataFrame], levels: int) -> RDD:
    """(tree, its root) of each tree."""
    alone = [s.filter(F.col("nodes") <= 1 << levels).rdd for s in steps]
    return alone[0].context.union(alone).map(lambda r: (r["tree"], levels_of(bytes(r["digests"]), r["nodes"], levels)[-1][0]))


def descended(steps: list[DataFrame], starts: RDD, tasks: int, levels: int, last: int) -> RDD:
    """starts (tree, (what goes to all, path)) to ((tree, node), the same with the path of the node), down to step last."""
    messages = None
    for k in range(len(steps) - 1, last - 1, -1):
        own = steps[k].rdd.map(lambda r: ((r["tree"], r["block"]), (r["nodes"], bytes(r["digests"]))))
        # trees whose top block is in this step begin here
        tall = lambda x: x[1][0] <= 1 << levels
        begun = own.filter(tall).map(lambda x: (x[0][0], None)).join(starts, tasks).map(lambda x: ((x[0], 0), x[1][1]))
        messages = begun if messages is None else messages.union(begun)

        def down(x) -> Iterator:
            (tree, number), ((nodes, digests), (header, path)) = x
            made = levels_of(digests, nodes, levels)
            for place in range(len(made[0])):
                yield (tree, (number << levels) + place), (header, siblings(made, place) + path)

        messages = own.join(messages, tasks).flatMap(down)
    return messages


def proofs(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """leaves (group, id, leaf, changed) to id, leaf, group_root, root, siblings, folded_root.

    siblings: the digests on the way from the leaf to the root. folded_root is what these and the row's changed digest
    (its leaf where that is null) lead to."""
    spark = leaves.sparkSession
    rows = landed(leaves.select("group", "id", "leaf", "changed").withColumn("rid", F.monotonically_increasing_id()), "merkle-leaves")
    placed = landed(ranked(rows, ["group"], ["id", "leaf", "rid"], groups=True), "merkle-placed")
    most, n_groups = placed.agg(F.max("size"), F.max("n_groups")).first()
    if most is None:
        return spark.createDataFrame([], PROOF)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = (1 << levels) - 1
    own = placed.rdd.map(lambda r: ((r["group_place"], r["place"] >> levels), (r["place"] & low, r["size"], bytes(r["leaf"]))))
    steps = climbed(own, most, spark, tasks, levels)
    roots = tops(steps, levels)
    above = climbed(roots.map(lambda x: ((0, x[0] >> levels), (x[0] & low, n_groups, x[1]))), n_groups, spark, tasks, levels)
    start = tops(above, levels).map(lambda x: (0, (x[1], b"")))
    ways = descended(above, start, tasks, levels, 0).map(lambda x: (x[0][1], x[1]))
    begun = roots.join(ways, tasks).map(lambda x: (x[0], ((x[1][0], x[1][1][0]), x[1][1][1])))
    begun = spark.createDataFrame(begun.map(lambda x: (x[0], *x[1][0], x[1][1])), "tree long, group_root binary, root binary, path binary", verifySchema=False)
    begun = landed(begun, "merkle-starts").rdd.map(lambda r: (r["tree"], ((bytes(r["group_root"]), bytes(r["root"])), bytes(r["path"]))))
    blocks = descended(steps, begun, tasks, levels, 1) if len(steps) > 1 else None
    lone = steps[0].filter(F.col("nodes") <= 1 << levels).rdd.map(lambda r: (r["tree"], None)).join(begun, tasks).map(lambda x: ((x[0], 0), x[1][1]))
    blocks = lone if blocks is None else blocks.union(lone)
    held = placed.rdd.map(lambda r: ((r["group_place"], r["place"] >> levels), (r["place"], r["size"], r["id"], bytes(r["leaf"]), r["changed"])))

    def arrive(x) -> Iterator:
        (tree, _), (mine, messages) = x
        mine = sorted(mine, key=lambda r: r[0])
        ((group_root, root), path), *_ = messages
        made = levels_of(b"".join(r[3] for r in mine), mine[0][1], levels)
        for place, size, number, own, changed in mine:
            way = siblings(made, place & low) + path
            reached = folded(own if changed is None else bytes(changed), [(place, size), (tree, n_groups)], way)
            yield number, own, group_root, root, way, reached

    return spark.createDataFrame(held.cogroup(blocks, tasks).flatMap(arrive), PROOF, verifySchema=False)


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents by lang; where 7 divides the CRC-32 of an id, changed is the leaf with one more in n_chars."""
    more = [F.col("n_chars").cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return docs.select(
        F.col("lang").alias("group"),
        F.col("doc_id").cast("long").alias("id"),
        leaf([F.col(c) for c in FIELDS]).alias("leaf"),
        F.when(hit, leaf(more)).alias("changed"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    found = proofs(document_leaves(documents(spark, sf_dir)))
    text = lambda c: F.lower(F.hex(c))
    return found.select(
        F.col("id").alias("doc_id"),
        text("leaf").alias("leaf"),
        text("group_root").alias("subroot"),
        text("root").alias("root"),
        F.sha2(text("siblings").cast("binary"), 256).alias("proof_sha256"),
        text("folded_root").alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


OP12_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, lang, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
           lambda c: list_transform(range(8), lambda b: (ascii(c)::BIGINT >> b) & 1)))),
           lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)) AS crc,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents),
e AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 7 = 0
              THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS changed
  FROM d),
r AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g
  FROM e),
up AS (
  SELECT g, 0 AS t, i, n, leaf AS h FROM r
  UNION ALL
  SELECT g, t + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i))
  FROM up WHERE n > 1 GROUP BY g, t, n, i // 2),
up_all AS MATERIALIZED (SELECT * FROM up),
sub AS MATERIALIZED (SELECT g, h AS subroot FROM up_all WHERE n = 1),
top AS (
  SELECT 0 AS t, g AS i, (SELECT count(*) FROM sub) AS n, subroot AS h FROM sub
  UNION ALL
  SELECT t + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY t, n, i // 2),
top_all AS MATERIALIZED (SELECT * FROM top),
ways AS (
  SELECT g, i AS spot, 0 AS t, i, n FROM r WHERE n > 1
  UNION ALL
  SELECT g, spot, t + 1, i // 2, (n + 1) // 2 FROM ways WHERE n > 2),
root_ways AS (
  SELECT g, 0 AS t, g AS i, (SELECT count(*) FROM sub) AS n FROM sub WHERE (SELECT count(*) FROM sub) > 1
  UNION ALL
  SELECT g, t + 1, i // 2, (n + 1) // 2 FROM root_ways WHERE n > 2),
path AS (
  SELECT w.g, w.spot, w.t AS k, w.i % 2 AS is_right, u.h AS sib FROM ways w
  LEFT JOIN up_all u ON u.g = w.g AND u.t = w.t AND u.i = xor(w.i, 1)
  UNION ALL
  SELECT r.g, r.i, 1000 + w.t, w.i % 2, u.h FROM r JOIN root_ways w ON r.g = w.g LEFT JOIN top_all u ON u.t = w.t AND u.i = xor(w.i, 1)),
paths AS (
  SELECT g, spot, list(struct_pack(r := is_right, s := sib) ORDER BY k) AS p, coalesce(string_agg(sib, '' ORDER BY k), '') AS joined
  FROM path GROUP BY g, spot),
walk AS (
  SELECT r.g, r.i, coalesce(r.changed, r.leaf) AS h, 1 AS k, p.p FROM r LEFT JOIN paths p ON p.g = r.g AND p.spot = r.i
  UNION ALL
  SELECT g, i, sha256(CASE WHEN p[k].s IS NULL THEN h WHEN p[k].r = 1 THEN p[k].s || h ELSE h || p[k].s END), k + 1, p
  FROM walk WHERE k <= len(p)),
ends AS (SELECT g, i, h AS folded_root FROM walk WHERE k = coalesce(len(p), 0) + 1)
SELECT r.doc_id, r.leaf, sub.subroot, top_all.h AS root, sha256(coalesce(paths.joined, '')) AS proof_sha256, ends.folded_root,
       ends.folded_root = top_all.h AS verified
FROM r JOIN sub ON sub.g = r.g JOIN top_all ON top_all.n = 1 JOIN ends ON ends.g = r.g AND ends.i = r.i
LEFT JOIN paths ON paths.g = r.g AND paths.spot = r.i
"""

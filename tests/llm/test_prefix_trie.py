import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pitchframe.llm.prefix_trie import coded, grown, op13_prefix_trie, rebuilt, trie

KINDS = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def remainder(c, n):
    return abs(c) % n * (1 if c >= 0 else -1)


def plain(given):
    """Nodes by all prefixes of all rebuilt conversations."""
    own = defaultdict(list)
    for c, turn, role, text in given:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    seen = {}
    for c, turns in own.items():
        k = zlib.crc32(str(c).encode()) % 4
        seen[c] = tuple(own.get(c - remainder(c, 20), [])[:k] + turns[k:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in seen.items():
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + ((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0)
        out.append(
            (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p],
             hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        )
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    out = []
    for c in range(-25, 130):
        turns = [("system", "the same first turn for all")] * (c % 3 > 0) + [(rng.choice(["user", "assistant"]), f"turn {rng.randrange(3)}") for _ in range(rng.randrange(1, 9))]
        out += [(c, t, *own) for t, own in enumerate(turns)]
    long = [("user", f"long {k} of many words") for k in range(70)]
    for c, end in ((201, 70), (202, 70), (203, 40), (221, 66), (222, 70), (223, 70), (224, 70)):  # prefixes of each other, copies
        out += [(c, t, *own) for t, own in enumerate(long[:end])]
    out += [(224, 70 + t, "user", f"alone {t}") for t in range(60)]
    out += [(300, None, None, None), (300, 1, "user", None), (300, 1, "user", "b"), (300, 1, "user", "a"), (300, 2, None, " \t "), (301, 0, "", "x")]
    out += [(340, 0, "user", "z")] * 3  # rows given more than once
    out += [(None, 0, "user", "of no conversation"), (None, None, None, None)]
    rng.shuffle(out)
    return out


def ours(df, **more):
    turns, lengths = rebuilt(df)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, trie(turns, lengths, **more).select(*names).collect()), key=str)


@pytest.mark.parametrize("segment, local", [(1024, 1 << 15), (1024, 40), (16, 1 << 15), (16, 40), (3, 5)])
def test_nodes_equal_all_prefixes(spark, segment, local):
    df = spark.createDataFrame(cases(), KINDS).repartition(3).withColumn("digest", F.lit("extra")).withColumn("size", F.lit("extra"))
    assert ours(df, segment=segment, local=local) == plain(cases())


def test_an_empty_table_has_no_nodes(spark):
    assert ours(spark.createDataFrame([], KINDS)) == []
    assert ours(spark.createDataFrame([(None, 1, "a", "b")], KINDS)) == []


def test_turnless_conversations_end_at_the_root(spark):
    alone = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:2]
    given = [(c, 0, "user", "only turn") for c in alone]
    assert ours(spark.createDataFrame(given, KINDS)) == plain(given)
    assert len(plain(given)) == 1


def test_a_dictionary_gives_equal_turns_one_number(spark):
    given = [(i, digest("", str(i % 7 if i < 5000 else i))) for i in range(6000)]
    found = coded(spark.createDataFrame(given, "i long, digest binary")).collect()
    numbers = defaultdict(set)
    for r in found:
        numbers[given[r["i"]][1]].add(r["code"])
    assert len(found) == 6000 and all(len(x) == 1 for x in numbers.values()) and len({min(x) for x in numbers.values()}) == 1007


def test_deep_buckets_need_no_deep_stack():
    own = [(g, list(range(5000)) + [g], [1] * 5001, 1, True, 0, 0, 0) for g in (1, 2)]
    *nodes, top = grown(1, 0, own)
    assert len(nodes) == 5002 and top[0] and top[6] == 2 and top[7] == 5000


def test_query_equals_all_prefixes_on_the_given_tables(spark, matches_dir):
    given = [tuple(r) for r in spark.read.parquet(f"{matches_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, op13_prefix_trie(spark, matches_dir).collect()), key=str) == plain(given)

import hashlib
import zlib
from collections import defaultdict

import pytest
from fixtures import KINDS, rows, table
from pyspark.sql import functions as F

from pitchframe.llm.merkle import document_leaves, proofs
from pitchframe.llm.ranks import ranked


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(*values) -> str:
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and for each node its siblings as (is it on the left, digest or None) from the lowest level."""
    ways = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for i, own in enumerate(below):
            other = i ^ 1
            for leaf in own:
                ways[leaf].append((other < i, nodes[other]) if other < len(nodes) else (False, None))
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        below = [sum(below[i : i + 2], []) for i in range(0, len(below), 2)]
    return nodes[0], ways


def brute(given):
    groups = defaultdict(list)
    for i, text, lang, source, n in given:
        changed = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        groups[lang].append((i, told(i, source, lang, n, text), told(i, source, lang, n + 1, text) if changed else None))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {g: tree([r[1] for r in own]) for g, own in groups.items()}
    root, above = tree([trees[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for (i, leaf, changed), way in zip(groups[g], trees[g][1]):
            way = way + above[k]
            reached = changed or leaf
            for left, other in way:
                reached = sha(reached) if other is None else sha(other, reached) if left else sha(reached, other)
            out.append((i, leaf, trees[g][0], root, sha(*(o for _, o in way if o)), reached))
    return sorted(out, key=str)


def ours(df, **more):
    text = lambda c: F.lower(F.hex(c))
    found = proofs(document_leaves(df), **more)
    found = found.select("id", text("leaf"), text("group_root"), text("root"), F.sha2(text("siblings").cast("binary"), 256), text("folded_root"))
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_proofs_equal_brute_force(spark, levels):
    assert ours(table(spark), levels=levels) == brute(rows())


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9])
def test_small_groups(spark, n):
    given = [(i, f"text {i}", f"l{k}", "web", i) for k in range(n) for i in range(k * 10, k * 10 + n - k)]
    assert ours(table(spark, given), levels=2) == brute(given)


def test_changed_rows_and_no_others_fail(spark):
    given = [(i, f"text {i}", "en", "web", None if i % 5 == 0 else i) for i in range(100)]
    found = ours(table(spark, given))
    bad = {r[0] for r in found if r[5] != r[3]}
    assert bad == {i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 0 and i % 5} and bad


def test_an_empty_table_has_no_rows(spark):
    assert proofs(document_leaves(spark.createDataFrame([], KINDS))).count() == 0


def test_places_of_groups_of_any_size(spark):
    given = [(None if i % 3 == 0 else i % 2, i * 7919 % 1000) for i in range(1000)]
    found = ranked(spark.createDataFrame(given, "g long, v long").repartition(5), ["g"], ["v"], groups=True).collect()
    want = {}
    for place, g in enumerate([None, 0, 1]):
        own = sorted(v for h, v in given if h == g)
        want |= {(g, v): (i, len(own), place, 3) for i, v in enumerate(own)}
    assert {(r["g"], r["v"]): (r["place"], r["size"], r["group_place"], r["n_groups"]) for r in found} == want

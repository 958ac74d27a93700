import hashlib
from collections import defaultdict

from fixtures import CLASHING, KINDS, rows, table
from pyspark.sql import functions as F

from pitchframe.llm.exact_dedup import exact_groups, kept_documents, op3_exact_dedup


def brute(given):
    groups = defaultdict(list)
    for i, text, *_ in given:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        taken = False
        for i in ids:
            kept = i == keep and not taken
            taken |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def ours(df, **more):
    found = exact_groups(df, **more).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))).collect()
    return sorted(map(tuple, found), key=str)


def test_groups_equal_brute_force(spark):
    assert ours(table(spark)) == brute(rows())


def test_digests_that_collide_are_split_by_text(spark):
    found = exact_groups(table(spark), digest=lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 0))
    assert sorted((tuple(r)[:4] for r in found.select("doc_id", "keep_id", "group_size", "kept").collect()), key=str) == sorted((r[:4] for r in brute(rows())), key=str)


def test_kept_rows_hold_each_text_once_with_their_columns(spark):
    df = table(spark)
    kept = kept_documents(df)
    assert kept.columns == df.columns and set(CLASHING) <= set(kept.columns)
    texts = [r["text"] or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t, *_ in rows()})


def test_an_empty_table_gives_an_empty_table(spark):
    assert exact_groups(spark.createDataFrame([], KINDS)).count() == 0
    assert kept_documents(spark.createDataFrame([], KINDS)).count() == 0


def test_sizes_add_up_on_the_given_tables(spark, sf_dir):
    found = op3_exact_dedup(spark, sf_dir).collect()
    assert sum(r["kept"] for r in found) == len({r["text_sha256"] for r in found})

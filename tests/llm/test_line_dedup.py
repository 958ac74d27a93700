from fixtures import CLASHING, KINDS, rows, table
from pyspark.sql import Row

from pitchframe.llm.line_dedup import deduplicated


def brute(given):
    """id, text to what stays of the text; occurrences by (id, text, place), null ids first."""
    docs = sorted({(i is not None, i or 0, t or "") for i, t, *_ in given})
    where = {}
    for d in docs:
        lines = d[2].split("\n")
        for at in range(len(lines) - 2):
            key = tuple(lines[at : at + 3])
            if "".join(key).strip(" "):
                where.setdefault(key, []).append((d, at))
    out = {}
    for d in docs:
        lines = d[2].split("\n")
        gone = {at + k for found in where.values() for e, at in found[1:] if e == d for k in range(3)}
        out[d] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


LINES = [
    (1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "a\nb"), (4, None), (5, ""), (6, "p\nq\np\nq\np\nq"), (7, "\n\n\n\n"),
    (8, "a\nb\nc\nd"), (9, "  \n \n   \nz"), (10, "b\nc\nd\na\nb\nc"), (11, "k\n" * 3000), (12, "t\nu\nv\n" * 2),
]


def test_kept_lines_equal_brute_force(spark):
    given = [(i, t, "en", "a", 0) for i, t in LINES]
    want = brute(given)
    found = deduplicated(table(spark, given)).collect()
    assert len(found) == len(given)
    for r in found:
        source = dict(LINES)[r["doc_id"]]
        text = want[True, r["doc_id"], source or ""]
        assert (r["text"] or "") == text
        assert r["__lines"] == len((source or "").split("\n"))
        assert r["__removed"] == 0 or r["text"] != source or source == text


def test_all_cases_keep_their_rows_and_columns(spark):
    df = table(spark)
    found = deduplicated(df)
    assert set(CLASHING) <= set(found.columns)
    assert found.count() == len(rows())


def test_rows_that_repeat_are_one_occurrence(spark):
    twice = [(1, "a\nb\nc", "en", "a", 0)] * 2
    assert [r["text"] for r in deduplicated(table(spark, twice)).collect()] == ["a\nb\nc"] * 2


def test_an_empty_table_gives_an_empty_table(spark):
    assert deduplicated(spark.createDataFrame([], KINDS)).collect() == []
    assert isinstance(Row(a=1), Row)

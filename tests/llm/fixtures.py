"""Small tables of documents with the cases that every operator must stand."""

from __future__ import annotations

import random

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHING = ["mark", "rid", "n", "class", "digest", "kept", "keep_id", "group_size", "score", "features", "component_id", "topic", "p", "w", "taken", "n_tokens", "__x"]


def words(seed: int, n: int, vocabulary: int = 4000) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def texts() -> list[str | None]:
    """Unrelated texts, copies, chains of near copies, long ones, short ones, blanks, nulls, repeats."""
    out: list[str | None] = [None, "", " \t\n", "one", "ONE", "one two", "a b c d", "A b C d", "nul\x00 byte", "ſtraße ÇA é́ 　wide 👩‍👩‍👧 end"]
    base = words(1, 200)
    out += [" ".join(base)] * 4
    for k in range(6):  # a chain: each differs a little from the one before
        base = base.copy()
        base[20 * k + 5] = f"new{k}"
        out.append(" ".join(base))
    passage = words(2, 60)
    for k in range(8):  # a passage that many unrelated documents share
        out.append(" ".join(words(100 + k, 80) + passage + words(200 + k, 80)))
    out += [" ".join(words(300 + k, 30, 60)) for k in range(10)]
    out.append("same " * 3000)
    out.append(" ".join(words(9, 30_000)))
    out.append("x" * 50_000)
    out += ["Straße\nLine two\nline three\n\nline two", "Straße\nLine two\nline three\n\nline two", "line one\r\nline two"]
    return out


def rows(shuffled: int = 0) -> list[tuple]:
    found = [(i, t, ["en", "de", None][i % 3], ["web", "web", "news", None][i % 4], len(t) if t else None) for i, t in enumerate(texts())]
    found.append(found[12])  # a row that is given twice
    found.append((None, "a text without an id that nothing else says", "en", "web", 3))
    found.append((None, "one two", "en", "web", 3))
    random.Random(shuffled).shuffle(found)
    return found


def table(spark, given=None, clashing: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if given is None else given, KINDS).repartition(3)
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING}) if clashing else df

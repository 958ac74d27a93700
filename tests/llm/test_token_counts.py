from bisect import bisect_left, bisect_right

import public_tokenizers
import tiktoken
from fixtures import KINDS, rows, table
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

from pitchframe.llm.byte_bpe import vocabulary
from pitchframe.llm.common import text_of
from pitchframe.llm.token_counts import TAIL, head_body_tail, section_counts


def brute(text, library):
    """(section, code points, tokens, crossing): each token to the section that holds most of its code points."""
    line = text.find("\n") + 1 or len(text)
    cut = max(line, len(text) - TAIL)
    sections = [("head", 0, line), ("body", line, cut), ("tail", cut, len(text))]
    starts = [0]
    for c in text:
        starts.append(starts[-1] + len(c.encode()))
    counts = {n: [b - a, 0, 0] for n, a, b in sections}
    at = 0
    for token in library.encode_ordinary(text):
        end = at + len(library.decode_single_token_bytes(token))
        first, last = bisect_right(starts, at) - 1, bisect_left(starts, end)  # the code points that it touches
        live = [(min(b, last) - max(a, first), -k, n) for k, (n, a, b) in enumerate(sections) if b > a and min(b, last) > max(a, first)]
        best = max(live)
        counts[best[2]][1] += 1
        counts[best[2]][2] += len(live) > 1
        at = end
    return {n: tuple(c) for n, c in counts.items()}


def test_counts_equal_brute_force(spark):
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(vocabulary()), special_tokens={})
    given = rows() + [(500 + k, "héllo wörld 👩‍👩‍👧 " * k + "\n" * (k % 3) + "字é" * 60 * k, "en", "a", 0) for k in range(6)]
    df = table(spark, given)
    found = section_counts(df, head_body_tail(text_of("text")), vocabulary()).collect()
    ours = sorted((str(r["doc_id"]), r["section"], r["n_chars"], r["n_tokens"], r["n_crossing"]) for r in found)
    want = sorted((str(i), n, *c) for i, t, *_ in given for n, c in brute(t or "", library).items())
    assert ours == want


def test_counts_add_up_and_what_lies_outside_goes_nowhere(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id long, text string")
    some = F.array(F.struct(F.lit("x").alias("name"), F.lit(0).alias("start"), F.lit(5).alias("end")))
    found = {r["section"]: r["n_tokens"] for r in section_counts(df, some, vocabulary()).collect()}
    assert set(found) == {"x", "(none)"} and found["x"] >= 1 and found["(none)"] >= 3


def test_an_empty_table_gives_an_empty_table(spark):
    df = spark.createDataFrame([], KINDS)
    assert section_counts(df, head_body_tail(text_of("text")), vocabulary()).count() == 0

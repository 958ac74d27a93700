import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from fixtures import KINDS, rows, table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

from pitchframe.llm.byte_bpe import ByteBpe, decoded, encoded, id_digests, op4_byte_bpe, token_rows, vocabulary


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(vocabulary()), special_tokens={})


def digests(text, library):
    ids = library.encode_ordinary(text)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


CHARS = st.sampled_from(list("ab'sSreltdvm  \n\t\r.,!?1234é́ß字🙂  　\x00-_")) | st.characters(exclude_categories=["Cs"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(CHARS, max_size=60), min_size=1, max_size=5))
def test_slices_of_documents_encode_as_the_library_does(library, texts):
    raw = [t.encode() for t in texts]
    bpe = ByteBpe.at(vocabulary())
    ids, before = bpe.encode(b"".join(raw), np.append(0, np.cumsum([len(r) for r in raw])))
    for k, text in enumerate(texts):
        own = ids[before[k] : before[k + 1]]
        assert own.tolist() == library.encode_ordinary(text)
        assert bpe.decode(own) == raw[k]


def test_digests_of_the_cases(spark, library):
    found = token_rows(table(spark), vocabulary()).collect()
    want = sorted(((i, *digests(t or "", library)) for i, t, *_ in rows()), key=str)
    assert sorted((tuple(r)[:4] for r in found), key=str) == want
    assert all(len(r["token_ids"]) == len(r["token_ends"]) == r["n_tokens"] for r in found)


def test_every_code_point_encodes_as_the_library_does(library):
    bpe = ByteBpe.at(vocabulary())
    around = ["{}{}{}", "a{}b{}1", " {} {}  {}", "'s{}'ll{}.{}"]
    for start in range(0, 0x110000, 256):
        if 0xD800 <= start < 0xE000:
            continue
        points = list(map(chr, range(start, start + 256)))
        text = "".join(around[k % 4].format(*points[k : k + 3]) for k in range(254))
        raw = text.encode()
        assert bpe.encode(raw, np.array([0, len(raw)]))[0].tolist() == library.encode_ordinary(text), hex(start)


def test_digests_of_given_documents(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op4_byte_bpe(spark, sf_dir).collect():
        assert tuple(r)[1:4] == digests(texts[r["doc_id"]], library)


def test_tokens_decode_to_their_text_and_ends_are_offsets(spark):
    back = encoded(table(spark), vocabulary()).withColumn("decoded", decoded(F.col("token_ids"), vocabulary())).collect()
    assert len(back) == len(rows())
    bpe = ByteBpe.at(vocabulary())
    for r in back:
        raw = (r["text"] or "").encode()
        assert bytes(r["decoded"]) == raw
        assert [0, *r["token_ends"]][-1] == len(raw)
        if len(raw) < 5000:  # any run of tokens stands for the bytes between its ends
            cuts = [0, *r["token_ends"]]
            assert all(bpe.decode(np.array(r["token_ids"][k : k + 1])) == raw[cuts[k] : cuts[k + 1]] for k in range(len(cuts) - 1))


def test_an_empty_table_gives_an_empty_table(spark):
    assert token_rows(spark.createDataFrame([], KINDS), vocabulary()).count() == 0


def test_one_worker_a_task_encodes_and_digests(spark):
    found = token_rows(table(spark), vocabulary())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    again = encoded(table(spark), vocabulary(), keep=["doc_id"]).select("doc_id", id_digests(F.col("token_ids")).alias("ids"), F.sha2(decoded(F.col("token_ids"), vocabulary()), 256).alias("bytes"))
    assert sorted(map(tuple, found.select("doc_id", "ids_sha256", "decoded_sha256").collect()), key=str) == sorted(map(tuple, again.collect()), key=str)

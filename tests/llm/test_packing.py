import random
import zlib
from collections import defaultdict

import numpy as np
from fixtures import KINDS, rows, table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pitchframe.llm.packing import SEQUENCE, Cuts, best_fit, numbered, op11_packing, packed, pieces, placements, sequences, vocabulary

PATH = vocabulary()
LIBRARY = Tokenizer.from_file(PATH)


def plain_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def plain_best_fit(lengths, size, most_open):
    """A list of open sequences, searched from end to end. Of equal free spaces the one that got it last counts first."""
    opened, out, made = [], [], 0
    for n in lengths:
        fits = [(space, -at, i) for i, (space, at, _) in enumerate(opened) if space >= n]
        if fits:
            space, _, own = opened.pop(min(fits)[2])
        else:
            if len(opened) == most_open:
                opened.remove(min(opened, key=lambda x: (x[0], -x[1])))
            space, own, made = size, made, made + 1
        out.append((own, size - space))
        if space > n:
            opened.append((space - n, len(out), own))
    return out


def whole(placed, size):
    """Every sequence is gapless from 0 and no longer than size."""
    held = defaultdict(list)
    for r in placed:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(held)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(1, 6))
def test_best_fit_equals_a_search_of_a_list(lengths, most_open):
    sequence, place, spaces = best_fit(lengths, 40, most_open)
    assert list(zip(sequence, place)) == plain_best_fit(lengths, 40, most_open) and len(spaces) <= most_open


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aBzÉéİIi̇ΣσK'sStT,.;:!? \t\n\x0b\x1c  ̷9٣<|>endoftx=é𝒜한ㅎ", max_size=30), max_size=4))
def test_cuts_encode_as_the_library_does(texts):
    texts.append("The end's, it'll <|endoftext|> BE,so. <|EndOfText|>")
    data = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum(list(map(len, data)))).astype(np.int64)
    ids, before = Cuts.at(PATH).encode(b"".join(data), offsets, 1)
    assert [ids[a:b].tolist() for a, b in zip(before[:-1], before[1:])] == list(map(plain_ids, texts))


def test_a_long_text_is_encoded_whole_in_blocks(monkeypatch):
    monkeypatch.setattr("pitchframe.llm.packing.LONG_TEXT", 50)
    texts = ["", "x" * 300 + " end", "the words, of a text é of " * 40 + "\n", "   " * 40]
    data = [t.encode() for t in texts]
    ids, before = Cuts.at(PATH).encode(b"".join(data), np.append(0, np.cumsum(list(map(len, data)))).astype(np.int64), 1)
    assert [ids[a:b].tolist() for a, b in zip(before[:-1], before[1:])] == list(map(plain_ids, texts))


def test_pieces_are_those_of_the_whole_text(spark):
    want = []
    for i, text, *_ in rows():
        ids = plain_ids(text)
        want += [(i, k, at, tuple(ids[at : at + 1000])) for k, at in enumerate(range(0, len(ids), 1000))]
    found = pieces(table(spark), PATH, length=1000).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in found), key=str) == sorted(want, key=str)
    assert all(r["length"] == len(r["ids"]) // 4 for r in found)


def test_sequences_hold_all_ids_in_place(spark):
    found = numbered(pieces(table(spark), PATH, length=1000))
    own = packed(found, size=1000)
    made = {r["sequence_id"]: r for r in sequences(own).collect()}
    held = own.collect()
    assert len(held) == found.count()
    whole(held, 1000)
    for r in held:
        into = made[r["sequence_id"]]
        assert into["ids"][4 * r["offset"] :][: len(r["ids"])] == r["ids"]
    assert sum(m["length"] for m in made.values()) == sum(r["length"] for r in held)


def test_rounds_leave_nothing_out_and_pack_well(spark):
    rng = random.Random(4)
    lengths = [rng.randint(1, 1000) for _ in range(6000)] + [1000] * 50
    items = spark.createDataFrame(list(enumerate(lengths)), "rid long, length long")
    placed = placements(items, size=1000, most_open=40, a_task=700).join(items, "rid").collect()
    assert sorted(r["rid"] for r in placed) == list(range(len(lengths)))
    assert whole(placed, 1000) <= 1.05 * sum(lengths) / 1000


def test_pieces_of_one_length_end(spark):
    items = spark.range(3000).select(F.col("id").alias("rid"), F.lit(600).cast("long").alias("length"))
    placed = placements(items, size=1000, most_open=2000, a_task=500).join(items, "rid").collect()
    assert whole(placed, 1000) == 3000  # dealing anew can't help and stops


def test_an_empty_table_gives_an_empty_table(spark):
    own = packed(numbered(pieces(spark.createDataFrame([], KINDS), PATH)))
    assert own.count() == 0 and sequences(own).count() == 0


def test_query_equals_the_library_on_the_given_tables(spark, sf_dir):
    found = op11_packing(spark, sf_dir).collect()
    assert whole(found, SEQUENCE) <= 1.05 * sum(r["length"] for r in found) / SEQUENCE + 1
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = np.array(plain_ids(r["text"]), "<u4")
        want += [(r["doc_id"], k, at, len(ids[at : at + SEQUENCE]), zlib.crc32(ids[at : at + SEQUENCE].tobytes())) for k, at in enumerate(range(0, len(ids), SEQUENCE))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(want)

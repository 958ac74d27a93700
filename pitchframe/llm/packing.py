"""Packing token sequences by bounded-space online best-fit.

Each document becomes the ids of its text and one end id. A document longer than a sequence is cut into pieces of a
sequence's length (the last may be shorter); no other document is cut. Pieces are then packed by their lengths alone:
rows of some 60 bytes are dealt evenly to tasks by a hash of their number, and each task keeps a fixed number of open
sequences. Those are found by a bitset keyed by free space: the best fit is the lowest set bit at or above a piece's
length; where nothing fits and no more may be opened, the fullest open sequence (the lowest set bit) closes first. What
is still open and not nearly full at the end of a task isn't given up: its pieces are dealt anew, together with those
of the other tasks, until one task is left, which packs what it has open at its end once more, longest first, or until
dealing anew no longer halves them.

Texts are tokenised by the given tokenizer file. As its patterns never match across white space, nor across a border of
an ASCII letter and one of , . ; : ! ?, a text is cut there by whole arrays and only distinct cuts reach the library.

Defined results: null texts count as empty and have the end id only; null and repeated ids keep their rows (each row is
packed by itself); ties of free space go to the sequence that got it last; an empty table gives an empty table; further
columns are ignored. A text of any length is tokenised whole; its ids leave in batches of about BATCH_TOKENS.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm.common import documents, landed, text_batches, text_of

SEQUENCE = 4096
END_ID = 1
OPEN = 1024  # sequences that a task keeps open
PIECES_A_TASK = 1 << 17
NEARLY_FULL = 99  # per cent: such a sequence isn't opened again
CACHE_CUTS = 600_000  # distinct cuts that a worker remembers
BATCH_TOKENS = 1 << 22
LONG_TEXT = 1 << 24  # bytes; a longer one is tokenised in blocks of about this size, cut at white space
PIECE = "doc_id long, piece int, start long, length long, ids binary"

BLANK, LETTER, MARK, OTHER = range(4)
KIND = np.full(256, OTHER, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = BLANK
KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = LETTER
KIND[list(b",.;:!?")] = MARK
#: Letters of ASCII and Latin-1: whatever stands among them, they stay letters, and are what they are composed to.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
BLANKS = re.compile(rb"[\x20\x09-\x0d]")

_made: dict = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Cuts:
    """Encodes texts cut by cut, each distinct one once while it is remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        self.library = Tokenizer.from_file(path)
        ids = self.library.get_vocab()
        self.last = np.zeros(max(ids.values()) + 1, bool)  # tokens that end a word
        self.last[[i for token, i in ids.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def at(cls, path: str) -> Cuts:
        if ("cuts", path) not in _made:
            _made["cuts", path] = cls(path)
        return _made["cuts", path]

    def learn(self, fresh: list[bytes]) -> None:
        """Encodes cuts: those of plain letters only, a word each, all in one text, the others one by one."""
        words = list(filter(LETTERS, fresh))
        if words:
            ids = np.array(self.library.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            flat = ids.tobytes()
            self.known.update(zip(words, (flat[a:b] for a, b in zip([0, *ends], ends)), strict=True))
        if rest := list(itertools.filterfalse(LETTERS, fresh)):
            found = self.library.encode_batch_fast([c.decode() for c in rest], add_special_tokens=False)
            self.known.update(zip(rest, (np.array(e.ids, np.uint32).tobytes() for e in found)))

    def encode(self, data: bytes, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, each with end_id behind it, and how many ids come before each."""
        if len(data) <= LONG_TEXT:
            return self.encode_block(data, offsets, end_id)
        found = [self.encode_text(data[a:b], end_id) for a, b in itertools.pairwise(offsets.tolist())]
        return np.concatenate(found), np.append(0, np.cumsum(list(map(len, found))))

    def encode_text(self, text: bytes, end_id: int | None) -> np.ndarray:
        """A text of any length, in blocks that end before white space."""
        found, a = [], 0
        while a < len(text) or not found:
            gap = BLANKS.search(text, min(a + LONG_TEXT, len(text)))
            b = gap.start() if gap else len(text)
            found.append(self.encode_block(text[a:b], np.array([0, b - a]), end_id if b == len(text) else None)[0])
            a = b
        return np.concatenate(found)

    def encode_block(self, data: bytes, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        if b"<|" not in data:  # else a special token's name could come of it; lower case is what the library does anyway
            data = data.lower()
        raw = np.frombuffer(data, np.uint8)
        kind = KIND[raw]
        before = np.empty(len(kind), np.uint8)
        before[:1] = BLANK
        before[1:] = kind[:-1]
        starts = (kind != BLANK) & ((before == BLANK) | ((kind == LETTER) & (before == MARK)) | ((kind == MARK) & (before == LETTER)))
        heads = offsets[:-1][offsets[1:] > offsets[:-1]]
        starts[heads] = kind[heads] != BLANK
        starts = np.flatnonzero(starts)
        letters = raw[kind != BLANK]
        bounds = np.append(np.cumsum(kind != BLANK)[starts] - 1, len(letters)).astype(np.int32)
        cuts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
        coded = cuts.dictionary_encode()
        if len(self.known) > CACHE_CUTS:
            self.known.clear()
        distinct = coded.dictionary.to_pylist()
        self.learn([c for c in distinct if c not in self.known])
        parts = list(map(self.known.__getitem__, distinct))
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cut_before = np.searchsorted(starts, offsets)
        if end_id is not None:
            which = np.insert(which, cut_before[1:], len(parts))
            cut_before = cut_before + np.arange(len(cut_before))
            parts.append(np.uint32(end_id).tobytes())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        flat = np.frombuffer(b"".join(parts), np.uint32)
        counts = sizes[which]
        ends = np.append(0, np.cumsum(counts))
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], counts) + np.arange(ends[-1])]
        return ids, ends[cut_before]


def pieces(
    docs: DataFrame, path: str, length: int = SEQUENCE, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids (little-endian unsigned 32-bit numbers)."""
    text_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = Cuts.at(path)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = texts.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if offsets[-1] > offsets[0] else b""
            ids, before = cuts.encode(data, offsets - offsets[0], end_id)
            n = np.diff(before)
            count = -(-n // length)
            owner = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * length
            size = np.minimum(n[owner] - start, length)
            ends = np.append(0, np.cumsum(size))
            doc_ids = batch.column(0).take(pa.array(owner))
            a = 0
            while a < len(owner):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + BATCH_TOKENS, "right")) - 1)
                own = pa.py_buffer(ids[ends[a] : ends[b]].astype("<u4").tobytes())
                bounds = pa.py_buffer(((ends[a : b + 1] - ends[a]) * 4).astype(np.int32))
                columns = [doc_ids.slice(a, b - a), pa.array(piece[a:b], pa.int32()), pa.array(start[a:b]), pa.array(size[a:b])]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.Array.from_buffers(pa.binary(), b - a, [None, bounds, own])], names=[x.split()[0] for x in PIECE.split(", ")]
                )
                a = b

    return given.mapInArrow(run, PIECE)


def best_fit(lengths: list[int], size: int, most_open: int) -> tuple[list[int], list[int], dict[int, int]]:
    """The sequence and the place in it of each length, in the order given, and the free space of those open at the end."""
    free_set, at_space, spaces = 0, [[] for _ in range(size + 1)], {}
    sequence, place, made = [], [], 0
    for n in lengths:
        fits = free_set >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            own = at_space[space].pop()
        else:
            if len(spaces) >= most_open:
                fullest = (free_set & -free_set).bit_length() - 1
                del spaces[at_space[fullest].pop()]
                if not at_space[fullest]:
                    free_set ^= 1 << fullest
            space, own, made = size, made, made + 1
        if space < size and not at_space[space]:
            free_set ^= 1 << space
        sequence.append(own)
        place.append(size - space)
        if space == n:  # full: it closes at once
            spaces.pop(own, None)
        else:
            spaces[own] = space - n
            at_space[space - n].append(own)
            free_set |= 1 << (space - n)
    return sequence, place, spaces


def best_fit_closed(lengths: list[int], size: int, most_open: int, full: int) -> tuple[list[int], list[int]]:
    """best_fit, after which the pieces of sequences that are still open and not nearly full are packed once more, longest first."""
    sequence, place, spaces = best_fit(lengths, size, most_open)
    again = {s for s, space in spaces.items() if 100 * (size - space) < full * size}
    own = sorted((i for i, s in enumerate(sequence) if s in again), key=lambda i: -lengths[i])
    better, there, _ = best_fit([lengths[i] for i in own], size, most_open)
    if len(set(better)) < len(again):
        made = len(lengths)  # more than any number so far
        for i, s, at in zip(own, better, there):
            sequence[i], place[i] = made + s, at
    return sequence, place


PLACED = "rid long, length long, sequence_id long, offset long, again boolean"


def placed_once(items: DataFrame, tasks: int, round_no: int, last: bool, size: int, most_open: int, full: int) -> DataFrame:
    """items(rid, length) with sequence_id, offset and whether a piece is to be dealt again; each task packs its own."""
    dealt = items.select("rid", "length", F.xxhash64("rid", F.lit(round_no)).alias("key"))
    dealt = dealt.repartition(tasks, "key").sortWithinPartitions("key", "rid")  # the same order whenever a task runs again

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = list(batches)
        if not own:
            return
        own = pa.Table.from_batches(own)
        lengths = own["length"].to_pylist()
        if last:
            (sequence, place), again = best_fit_closed(lengths, size, most_open, full), []
        else:
            sequence, place, spaces = best_fit(lengths, size, most_open)
            again = [s for s, space in spaces.items() if 100 * (size - space) < full * size]
        sequence = np.array(sequence, np.int64)
        again = np.isin(sequence, again)
        number = (np.int64(round_no) << 54) | (np.int64(TaskContext.get().partitionId()) << 32) | sequence
        columns = [own["rid"], own["length"], pa.array(number), pa.array(place, pa.int64()), pa.array(again)]
        yield from pa.table(columns, names=[x.split()[0] for x in PLACED.split(", ")]).to_batches(10_000)

    return dealt.mapInArrow(run, PLACED)


def placements(items: DataFrame, size: int = SEQUENCE, most_open: int = OPEN, a_task: int = PIECES_A_TASK, full: int = NEARLY_FULL) -> DataFrame:
    """items(rid, length), rid unique, to rid, sequence_id and offset. No length is over size."""
    left, done, round_no = items.select("rid", "length"), None, 0
    n = left.count()
    while True:
        tasks = max(1, -(-n // a_task))
        found = landed(placed_once(left, tasks, round_no, tasks == 1, size, most_open, full), "packed")
        now = found.select("rid", "sequence_id", "offset", "again")
        still = 0 if tasks == 1 else found.filter("again").count()
        ended = 2 * still > n  # dealing anew hardly helps: they stay as they are
        now = now if ended else now.filter("not again")
        done = now if done is None else done.unionByName(now)
        if ended or not still:
            return done.drop("again")
        left, n, round_no = found.filter("again").select("rid", "length"), still, round_no + 1


def numbered(found: DataFrame) -> DataFrame:
    """Pieces below the shared folder, each with a number of its own, rid."""
    return landed(found.withColumn("rid", F.monotonically_increasing_id()), "pieces")


def packed(found: DataFrame, **more) -> DataFrame:
    """Numbered pieces (rid, length and whatever else) with their sequence_id and offset."""
    return found.join(placements(found, **more), "rid").drop("rid")


def sequences(found: DataFrame) -> DataFrame:
    """Packed pieces put together: sequence_id, length, ids (binary), doc_ids and offsets of its pieces in order."""
    each = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    own = found.groupBy("sequence_id").agg(each.alias("x"))
    return own.select(
        "sequence_id",
        F.expr("aggregate(x, 0L, (n, p) -> n + p.length)").alias("length"),
        F.expr("unhex(array_join(transform(x, p -> hex(p.ids)), ''))").alias("ids"),
        F.col("x.doc_id").alias("doc_ids"),
        F.col("x.offset").alias("offsets"),
    )


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = pieces(documents(spark, sf_dir), vocabulary())
    narrow = numbered(found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packed(narrow).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

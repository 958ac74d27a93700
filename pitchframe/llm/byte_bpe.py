"""Byte-level BPE encoding and decoding, a batch of documents at a time.

Pre-tokenisation uses no regular expression. Every code point of a batch is mapped to a class (letter, number, other,
space, other white space). Where a piece starts follows from the classes of a code point and its neighbours, but for
contractions ('s, 're, ...), which a four-state automaton follows: each code point stands for a transition function on
the states, and an associative scan composes these functions, so that the state before every code point is known
without walking the text. The pieces are slices of the UTF-8 buffer; equal pieces are merged once (dictionary encoding
and a bounded cache of merged pieces). Token ends are kept as byte offsets, so that any run of tokens can be decoded or
attributed to a place in its document.

Which code points are letters, numbers or white space is asked of the tokenizer library whose ids are to be met, once on
the driver, and goes to all tasks with the job: classes don't depend on what a machine has installed, nor on the age of
another library's Unicode tables.

Defined results: null texts count as empty; an empty text has no tokens; ids follow the rank file, no special tokens.
Memory is bounded by SLICE_BYTES of text at a time (one longer document is taken alone).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchframe.llm.common import documents, shielded, text_batches, text_of, tidied

SLICE_BYTES = 1 << 20
CACHE_PIECES = 1 << 16
LONG_PIECE = 256
NONE = np.int64(1 << 40)
LETTER, NUMBER, OTHER, SPACE, BLANK, EDGE = range(6)
# The contractions of the public pattern, by their letters after the apostrophe.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
# States of the automaton: outside a contraction, one or two of its letters left, just behind it.
OUTSIDE, ONE_LEFT, TWO_LEFT, BEHIND = range(4)

_made: dict = {}


def matching(pattern: str) -> np.ndarray:
    """The code points that a pattern of the tokenizer library matches: with one token a byte, all else is left out."""
    import tiktoken

    each = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    found = []
    for start in range(0, 0x110000, 0x800):
        if not 0xD800 <= start < 0xE000:
            found.append(each.decode_bytes(each.encode_ordinary("".join(map(chr, range(start, start + 0x800))))))
    return np.frombuffer(b"".join(found).decode().encode("utf-32-le"), np.uint32)


def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """The classes of all code points as runs: their first code points and their classes. Some thousand numbers."""
    if "runs" not in _made:
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
            table[matching(pattern)] = kind
        table[0x20] = SPACE
        starts = np.flatnonzero(np.append(True, table[1:] != table[:-1])).astype(np.uint32)
        _made["runs"] = starts, table[starts]
    return _made["runs"]


def class_table(runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.repeat(runs[1], np.diff(np.append(runs[0], 0x110000)))


def _start_rule() -> np.ndarray:
    """Whether a piece starts, by the classes of a code point, of the one before and of the one after it."""
    rule = np.zeros((6, 6, 6), bool)
    for now in range(5):
        for before in range(6):
            for after in range(6):
                if before == EDGE:
                    found = True
                elif now < SPACE:
                    found = before not in (now, SPACE)
                else:  # a run of white space gives its last code point away if a word follows
                    found = before < SPACE or after < SPACE
                rule[now, before, after] = found
    return rule.reshape(-1)


def _function(of: list[int]) -> int:
    return sum(to << 2 * state for state, to in enumerate(of))


def _composed() -> np.ndarray:
    """For two coded functions the code of the first followed by the second."""
    code = np.arange(256)
    out = np.zeros((256, 256), np.uint8)
    for state in range(4):
        middle = code[:, None] >> 2 * state & 3
        out |= ((code[None, :] >> 2 * middle & 3) << 2 * state).astype(np.uint8)
    return out


STARTS = _start_rule()
COMPOSED = _composed().reshape(-1)
STEP = _function([OUTSIDE, BEHIND, ONE_LEFT, OUTSIDE])
SYMBOLS = np.array(
    [STEP, _function([ONE_LEFT] * 4), _function([TWO_LEFT] * 4), _function([OUTSIDE] * 4)], np.uint8
)  # any code point, a short contraction, a long one, the first of a document
IDENTITY = _function([0, 1, 2, 3])


def scanned(codes: np.ndarray, width: int = 256) -> np.ndarray:
    """Inclusive scan of coded functions under composition, by blocks."""
    n = len(codes)
    if n <= width:
        out = codes.copy()
        for i in range(1, n):
            out[i] = COMPOSED[int(out[i - 1]) << 8 | int(out[i])]
        return out
    rows = -(-n // width)
    grid = np.full(rows * width, IDENTITY, np.uint8)
    grid[:n] = codes
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for j in range(1, width):
        grid[j] = COMPOSED[grid[j - 1].astype(np.uint16) << 8 | grid[j]]
    before = np.full(rows, IDENTITY, np.uint8)
    before[1:] = scanned(grid[-1])[:-1]
    return COMPOSED[(before.astype(np.uint16) << 8)[None, :] | grid].T.reshape(-1)[:n]


def piece_starts(data: bytes, row_starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte offsets at which pieces start. row_starts: byte offsets of the documents that aren't empty."""
    points = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    raw = np.frombuffer(data, np.uint8)
    at = None if len(points) == len(raw) else np.flatnonzero((raw & 0xC0) != 0x80)
    first = row_starts if at is None else np.searchsorted(at, row_starts)
    kind = classes[points]
    around = np.full(len(kind) + 2, EDGE, np.uint8)
    around[1:-1] = kind
    before, after = around[:-2].copy(), around[2:].copy()
    before[first] = EDGE
    after[first[1:] - 1] = EDGE
    local = STARTS[kind * np.uint8(36) + before * np.uint8(6) + after]

    symbols = np.zeros(len(kind), np.uint8)
    quotes = np.flatnonzero(points == ord("'"))
    quotes = quotes[(before[quotes] != OTHER) & (before[quotes] != SPACE)]
    if len(quotes):
        ends = np.append(first[1:], len(kind))[np.searchsorted(first, quotes, "right") - 1]
        padded = np.append(points, [0, 0])
        for letters in CONTRACTIONS:
            hit = quotes + len(letters) < ends
            for k, letter in enumerate(letters, 1):
                hit &= padded[quotes + k] == ord(letter)
            symbols[quotes[hit]] = len(letters)
        hit = symbols[first] == 0
        codes = SYMBOLS[symbols]
        codes[first[hit]] = SYMBOLS[3]
    else:
        codes = SYMBOLS[symbols]
        codes[first] = SYMBOLS[3]
    state = np.empty(len(kind), np.uint8)
    state[:1] = OUTSIDE
    state[1:] = scanned(codes)[:-1] & 3  # the image of the state OUTSIDE
    starts = local & (state == OUTSIDE) | (state == BEHIND)
    starts[first] = True
    found = np.flatnonzero(starts)
    return found if at is None else at[found]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of lowest rank, the leftmost first, until none is left.

    For long pieces: a heap of pairs over a linked list."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))
    prev = list(range(-1, n - 1))
    follow = list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = follow[i] if alive[i] else n
        if j >= n or end[j] != stop or end[i] != j:
            continue
        end[i], follow[i], alive[j] = stop, follow[j], False
        if follow[j] < n:
            prev[follow[j]] = i
            k = follow[j]
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = follow[i]
    return out


class ByteBpe:
    """A vocabulary of ranks with its cache of merged pieces."""

    def __init__(self, path: str, runs: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.classes = class_table(runs or class_runs())
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.parts = {rank: part for part, rank in self.ranks.items()}
        self.lengths = np.zeros(max(self.parts) + 1, np.int64)
        for rank, part in self.parts.items():
            self.lengths[rank] = len(part)
        pairs, of = array("q"), array("q")
        for part, rank in self.ranks.items():
            for i in range(1, len(part)):
                if (a := self.ranks.get(part[:i])) is not None and (b := self.ranks.get(part[i:])) is not None:
                    pairs.append(a << 32 | b)
                    of.append(rank)
        order = np.argsort(np.frombuffer(pairs, np.int64))
        self.pairs, self.pair_ranks = np.frombuffer(pairs, np.int64)[order], np.frombuffer(of, np.int64)[order]
        self.bytes = np.fromiter((self.ranks[bytes([i])] for i in range(256)), np.int64, 256)
        self.cache: dict[bytes, bytes] = {}

    @classmethod
    def at(cls, path: str, runs: tuple[np.ndarray, np.ndarray] | None = None) -> ByteBpe:
        """One for each Python worker."""
        if ("bpe", path) not in _made:
            _made["bpe", path] = cls(path, runs)
        return _made["bpe", path]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NONE)

    def merged_together(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as bytes. In every round each piece merges its leftmost pair of lowest rank."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        rank = np.full(len(ids), NONE)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inside] = self.pair_rank(ids[inside], ids[inside + 1])
        done_ids, done_owner = [], []
        while len(ids):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(first, len(ids)))
            least = np.repeat(np.minimum.reduceat(rank, first), sizes)
            over = least == NONE
            if over.any():
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                ids, owner, rank, least = ids[~over], owner[~over], rank[~over], least[~over]
            at = np.flatnonzero(rank == least)
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])] if len(at) else at
            ids[at] = rank[at]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            at -= np.arange(len(at))  # so many have gone before
            for i in (at, at[at > 0] - 1):
                i = i[i + 1 < len(ids)]
                same = owner[i] == owner[i + 1]
                rank[i] = np.where(same, self.pair_rank(ids[i], ids[i + 1]), NONE)
            if len(ids):
                rank[-1] = NONE
        owner = np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        flat = np.concatenate(done_ids)[order].astype(np.uint32).tobytes()
        ends = (np.cumsum(np.bincount(owner, minlength=len(pieces))) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens, and how many tokens come before each document (one number more than documents)."""
        offsets = np.asarray(offsets, np.int64)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = piece_starts(data, offsets[:-1][offsets[1:] > offsets[:-1]], self.classes)
        bounds = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        cache = self.cache
        if len(cache) > CACHE_PIECES:
            cache.clear()
        distinct = coded.dictionary.to_pylist()
        fresh = []
        for piece in distinct:
            if piece not in cache:
                if piece in self.ranks or len(piece) > LONG_PIECE:
                    cache[piece] = array("I", merged(piece, self.ranks)).tobytes()
                else:
                    fresh.append(piece)
        if fresh:
            cache.update(zip(fresh, self.merged_together(fresh)))
        known = list(map(cache.__getitem__, distinct))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        flat = np.frombuffer(b"".join(known), np.uint32)
        counts = sizes[which]
        ends = np.cumsum(counts)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - counts), counts) + np.arange(ends[-1])]
        before = np.append(0, ends)[np.searchsorted(starts, offsets)]
        return ids, before

    def token_ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of the end of each token, from the start of the first."""
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.parts.__getitem__, ids.tolist()))


def slices(texts: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """First row, UTF-8 bytes and offsets of runs of rows of about SLICE_BYTES."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        a, b = int(offsets[i]), int(offsets[j])
        yield i, data.slice(a, b - a).to_pybytes() if b > a else b"", offsets[i : j + 1] - a
        i = j


def coded(bpe: ByteBpe, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[pa.Array]]]:
    """For each slice its first row, the ids of all tokens, how many come before each document, and both as lists with the ends."""
    for i, data, offsets in slices(texts):
        ids, before = bpe.encode(data, offsets)
        ends = bpe.token_ends(ids)
        ends = ends - np.repeat(np.append(0, ends)[before[:-1]], np.diff(before))
        bounds = pa.array(before, pa.int32())
        yield i, ids, before, [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (ids, ends)]


@shielded
def encoded(
    docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids", ends_col: str = "token_ends", keep: list[str] | None = None
) -> DataFrame:
    """docs (or its columns keep) with the ids of each text's tokens and the byte offsets at which they end."""
    text_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (ids_col, ends_col)]
    given = docs.select(*kept, text_of(docs[text_col]).alias("__text"))
    kinds = given.drop("__text").schema.add(ids_col, T.ArrayType(T.IntegerType())).add(ends_col, T.ArrayType(T.IntegerType()))
    runs = class_runs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.at(path, runs)
        for batch in batches:
            for i, _, before, lists in coded(bpe, batch.column(batch.num_columns - 1)):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, len(before) - 1).columns[:-1], *lists], names=[*kept, ids_col, ends_col])

    return given.mapInArrow(tidied(run), kinds)


def runs_of(ids: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each document of a batch; none for a null."""
    flat = ids.values.to_numpy(zero_copy_only=False)
    bounds = ids.offsets.to_numpy()
    for a, b, there in zip(bounds[:-1], bounds[1:], ids.is_valid().to_pylist()):
        yield flat[a:b] if there else flat[:0]


def decoded(ids: Column, path: str) -> Column:
    """The bytes that token ids stand for."""

    @F.arrow_udf("binary")
    def bytes_of(ids: pa.Array) -> pa.Array:
        bpe = ByteBpe.at(path, runs)
        return pa.array(map(bpe.decode, runs_of(ids)), pa.binary())

    runs = class_runs()
    return bytes_of(ids)


def id_digest(ids: np.ndarray) -> str:
    """SHA-256 (lowercase hex) of ids as little-endian unsigned 32-bit numbers."""
    return hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()


def id_digests(ids: Column) -> Column:
    """id_digest of each row."""

    @F.arrow_udf("string")
    def digest(ids: pa.Array) -> pa.Array:
        return pa.array(map(id_digest, runs_of(ids)), pa.string())

    return digest(ids)


def token_rows(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document encoded and decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids, token_ends.

    One worker a task does it all: digests as expressions behind the encoding would take a second one with a vocabulary of
    its own."""
    text_batches(docs.sparkSession)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs[text_col]).alias("text"))
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, token_ids array<int>, token_ends array<int>"
    names = [c.split()[0] for c in kinds.split(", ")]
    runs = class_runs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.at(path, runs)
        for batch in batches:
            for i, ids, before, lists in coded(bpe, batch.column(1)):
                each = [ids[a:b] for a, b in zip(before[:-1], before[1:])]
                of_ids = pa.array((id_digest(x) for x in each), pa.string())
                of_bytes = pa.array((hashlib.sha256(bpe.decode(x)).hexdigest() for x in each), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(each)), pa.array(np.diff(before)), of_ids, of_bytes, *lists], names=names)

    return own.mapInArrow(tidied(run), kinds)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return token_rows(documents(spark, sf_dir), vocabulary()).drop("token_ids", "token_ends")

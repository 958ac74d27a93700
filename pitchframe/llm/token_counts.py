"""Token counts of sections, attributed by offsets.

A document is encoded once, whole, so that counts of sections add up to the count of the document. Tokens come with the
byte offsets at which they end, which give their spans in code points; the spans are joined to the sections of their
document (a merge of two sorted lists of intervals, for all documents of a slice together). A token that crosses a
boundary goes to the section that holds most of its code points, the earlier one in a tie; a token that no section
touches goes to the section NOWHERE.

Defined results: null texts are empty and have sections of no tokens; sections mustn't overlap and are sorted by start;
a null list of sections is an empty one; rows that repeat each keep their rows; an empty table gives an empty table; a
text of any length is encoded whole, in one slice of its own if it is longer than a slice; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm.byte_bpe import ByteBpe, class_runs, slices, vocabulary
from pitchframe.llm.common import documents, text_batches, text_of

NOWHERE = "(none)"
TAIL = 256
SECTIONS = "array<struct<name:string,start:int,end:int>>"
COUNTS = "doc_id long, section string, n_chars long, n_tokens long, n_crossing long"


def attributed(token_start: np.ndarray, token_end: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the number of its section (-1: none), and whether it crosses a boundary. Spans of code points."""
    if not len(start):
        return np.full(len(token_start), -1), np.zeros(len(token_start), bool)
    first = np.searchsorted(end, token_start, "right")  # the first section that ends behind the token's start
    last = np.searchsorted(start, token_end, "left") - 1  # the last one that starts before its end
    first_or_0, last_or_0 = np.minimum(first, len(start) - 1), np.maximum(last, 0)
    none = first > last
    inside = ~none & (first == last) & (token_start >= start[first_or_0]) & (token_end <= end[last_or_0])
    owner = np.where(none, -1, first_or_0)
    for t in np.flatnonzero(~none & (first < last)):
        own = np.arange(first[t], last[t] + 1)
        share = np.minimum(end[own], token_end[t]) - np.maximum(start[own], token_start[t])
        owner[t] = own[int(np.argmax(share))]
    return owner, ~none & ~inside


def section_counts(docs: DataFrame, sections: Column, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each section of each document: doc_id, section, n_chars, n_tokens, n_crossing.

    sections: an array of (name, start, end) in code points."""
    text_batches(docs.sparkSession)
    given = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), sections.cast(SECTIONS).alias("sections"), text_of(text_col).alias("text")
    )

    runs = class_runs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.at(path, runs)
        for batch in batches:
            for i, data, offsets in slices(batch.column(2)):
                n = len(offsets) - 1
                ids, before = bpe.encode(data, offsets)
                raw = np.frombuffer(data, np.uint8)
                led = np.append(0, np.cumsum((raw & 0xC0) != 0x80))  # code points that start before each byte
                ends = bpe.token_ends(ids)
                starts = np.append(0, ends)[:-1]
                token_start = led[np.minimum(starts + 1, len(raw))] - 1
                token_end = led[ends]
                doc_ids = batch.column(0).slice(i, n).to_pylist()
                rows = []
                for k, own in enumerate(batch.column(1).slice(i, n).to_pylist()):
                    own = own or []
                    base = int(led[offsets[k]])
                    a, b = before[k], before[k + 1]
                    live = [j for j, s in enumerate(own) if s["end"] > s["start"]]
                    owner, crossing = attributed(
                        token_start[a:b] - base,
                        token_end[a:b] - base,
                        np.array([own[j]["start"] for j in live], np.int64),
                        np.array([own[j]["end"] for j in live], np.int64),
                    )
                    counts = np.bincount(owner + 1, minlength=len(live) + 1)
                    crossed = np.bincount(owner[crossing] + 1, minlength=len(live) + 1)
                    place = {j: p + 1 for p, j in enumerate(live)}
                    for j, s in enumerate(own):
                        p = place.get(j)
                        rows.append((doc_ids[k], s["name"], max(0, s["end"] - s["start"]), int(counts[p]) if p else 0, int(crossed[p]) if p else 0))
                    if counts[0]:
                        rows.append((doc_ids[k], NOWHERE, 0, int(counts[0]), int(crossed[0])))
                columns = list(zip(*rows)) if rows else [[], [], [], [], []]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in COUNTS.split(", ")]
                )

    return given.mapInArrow(run, COUNTS)


def head_body_tail(text: Column) -> Column:
    """The first line with its end, what follows, and the last TAIL code points behind the first line."""
    n = F.length(text)
    line = F.locate("\n", text)
    head = F.when(line > 0, line).otherwise(n)
    tail = F.greatest(head, n - TAIL)
    part = lambda name, a, b: F.struct(F.lit(name).alias("name"), a.alias("start"), b.alias("end"))
    return F.array(part("head", F.lit(0), head), part("body", head, tail), part("tail", tail, n))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: tokens of its first line, of its body and of its end."""
    docs = documents(spark, sf_dir)
    return section_counts(docs, head_body_tail(text_of("text")), vocabulary())

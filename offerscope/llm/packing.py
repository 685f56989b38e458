"""Packing of tokenized documents into windows of at most ``window`` tokens,
in the order of the rows, by dynamic programming over the places to cut.

Cuts are free at document ends, cost a little at sentence ends, more at clause
ends and most elsewhere (only where a clause outgrows a window).  With ``best[k]`` the
least cost of cutting at place ``k``,

    best[k] = penalty[k] + min over i of best[i] + window - (pos[k] - pos[i])

over the places ``i`` within a window of ``k``.  ``best[i] + pos[i]`` does not
depend on ``k``, so a monotone queue gives each minimum in constant time.

A task packs its own rows as a stream: it plans about ``PLAN`` tokens at a
time and carries the last window over, so its memory does not grow with the
rows.  Only the last window of a task can stay far from full.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame

from .common import python_stages, text_or_empty
from .encode import encoder

PLAN = 1 << 20          # tokens planned at once
SENTENCE_CUT = 2.0      # cost in tokens of a cut at a sentence's end
CLAUSE_CUT = 10.0       # at a clause's end
HARD_CUT = 64.0         # and anywhere else
SENTENCE_ENDS = (".", "!", "?", "...")
CLAUSE_ENDS = (",", ";", ":")


def cut_points(ends: np.ndarray, sentences: np.ndarray, clauses: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and their costs: 0, document ``ends``, ``sentences``, ``clauses``
    and, in gaps wider than a window, one place a window."""
    price = np.full(1 + max([0, *[int(x[-1]) for x in (ends, sentences, clauses) if len(x)]]), np.inf)
    for at, cost in ((clauses, CLAUSE_CUT), (sentences, SENTENCE_CUT), (ends, 0.0)):
        price[at] = cost
    price[0] = 0.0
    soft = np.flatnonzero(price < np.inf)
    for w in np.flatnonzero(np.diff(soft) > window):
        price[soft[w] + window:soft[w + 1]:window] = HARD_CUT
    places = np.flatnonzero(price < np.inf)
    return places, price[places]


def best_cuts(places: np.ndarray, cost: np.ndarray, window: int) -> list[int]:
    """Cut places from 0 to the last one, of least padding and penalties."""
    pos, pen = places.tolist(), cost.tolist()
    value, back = [0.0] * len(pos), [0] * len(pos)    # value: best + pos
    queue = deque([0])
    for k in range(1, len(pos)):
        while pos[k] - pos[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        v = value[i] + window + pen[k]
        value[k], back[k] = v, i
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(k)
    cuts, k = [], len(pos) - 1
    while k:
        cuts.append(pos[k])
        k = back[k]
    return [0, *reversed(cuts)]


def tail_cuts(length: int, window: int) -> list[int]:
    """Lengths of the last windows of a task: one padded window, or windows of
    powers of two, which need no padding, if their cuts cost less."""
    bits = [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]
    return bits if (len(bits) - 1) * HARD_CUT < window - length else [length]


class Packer:
    """Pieces of a stream of documents; ``add`` and ``finish`` yield
    (doc, start, length, crc32, doc tokens, sequence, offset)."""

    def __init__(self, window: int, sentence_ids: np.ndarray, clause_ids: np.ndarray, sequence: int, plan: int = PLAN):
        self.window, self.sentence_ids, self.clause_ids, self.sequence, self.plan = window, sentence_ids, clause_ids, sequence, plan
        # Documents not fully placed: [key, whole length, ids left].
        self.docs: list[list] = []
        self.left = 0

    def add(self, key, ids: np.ndarray):
        self.docs.append([key, len(ids), ids])
        self.left += len(ids)
        if self.left >= self.plan:
            yield from self._place(False)

    def finish(self):
        if self.left:
            yield from self._place(True)

    def _place(self, last: bool):
        ids = np.concatenate([d[2] for d in self.docs])
        ends = np.cumsum([len(d[2]) for d in self.docs])
        sentences = np.flatnonzero(np.isin(ids, self.sentence_ids)) + 1
        clauses = np.flatnonzero(np.isin(ids, self.clause_ids)) + 1
        cuts = best_cuts(*cut_points(ends, sentences, clauses, self.window), self.window)
        if last:
            cuts[-1:] = (cuts[-2] + np.cumsum(tail_cuts(cuts[-1] - cuts[-2], self.window))).tolist()
        elif len(cuts) > 2:
            cuts.pop()
        k, at = 0, 0
        for a, b in zip(cuts, cuts[1:]):
            while at < b:
                key, whole, rest = self.docs[k]
                n = min(b, int(ends[k])) - at
                start = whole - (int(ends[k]) - at)
                yield key, start, n, zlib.crc32(ids[at:at + n].astype("<u4").tobytes()), whole, self.sequence, at - a
                at += n
                if at == ends[k]:
                    k += 1
            self.sequence += 1
        self.docs = self.docs[k:]
        if self.docs:
            self.docs[0][2] = ids[at:ends[k]].copy()
        self.left = len(ids) - at


def _packed(batches, path: str, end_id: int, window: int):
    import pyarrow as pa
    from pyspark import TaskContext

    enc, end = encoder(path), np.asarray([end_id], "<u4").tobytes()
    # An end's id: the last token of a word that is only punctuation.
    sentence_ids, clause_ids = (np.unique(np.concatenate([np.frombuffer(x, "<u4")[-1:] for x in enc.encode(list(marks))])) for marks in (SENTENCE_ENDS, CLAUSE_ENDS))
    packer = Packer(window, sentence_ids, clause_ids, TaskContext.get().partitionId() << 33)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7, names=names)

    for batch in batches:
        rows = []
        for key, coded in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
            rows += packer.add(key, np.frombuffer(coded + end, "<u4"))
        yield table(rows)
    yield table(list(packer.finish()))


def pack(docs: DataFrame, path: str, end_id: int, window: int = 2048) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text); each id of a document,
    its ``end_id`` included, lies in one piece.

    Rows keep their order within a partition and no row moves.  Null text is
    empty (its end id only), repeated rows and null ``doc_id`` are packed as
    rows of their own, no rows give no pieces, other columns are not read.
    ``sequence_id`` is unique, not consecutive between partitions."""
    python_stages(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        lambda it: _packed(it, path, end_id, window),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

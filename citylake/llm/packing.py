"""Packing token ids into sequences by multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylake.llm import tokens

LAYOUT = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deal positive sizes out to k windows with sums that are nearly equal.

    Karmarkar-Karp for k ways: every partial partition lists its windows' sums (those over 0). The two with
    the widest spread are merged again and again, the largest windows of one with the smallest of the
    other, so that opposing imbalances cancel. Ties fall to the earlier item.
    """
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        shared = max(0, len(a) + len(b) - k)  # windows over 0 in both
        keep = len(a) - shared
        paired = [(x + y, p + q) for (x, p), (y, q) in zip(a[keep:], reversed(b[len(b) - shared :]))] if shared else []
        merged = a[:keep] + b[: len(b) - shared] + paired
        merged.sort(key=lambda w: -w[0])
        if len(merged) == k:
            least = merged[-1][0]
            merged = [(s - least, items) for s, items in merged]
        heapq.heappush(heap, (-(merged[0][0] - (merged[-1][0] if len(merged) == k else 0)), order, merged))
        order += 1
    return [items for _, items in heap[0][2] if items] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; one more window whenever one of them exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return found
        k += 1


class _Packer:
    """Pieces of one task. Full sequences leave at once; tails wait for ``batch`` tokens of company."""

    def __init__(self, capacity: int, piece: int, batch: int, first: int):
        self.capacity, self.piece, self.batch, self.next = capacity, piece, batch, first
        self.tails: list[tuple] = []
        self.waiting = 0

    def _row(self, doc, start, ids, total, offset):
        return (*doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset, ids)

    def add(self, doc: tuple, ids: bytes) -> Iterator[tuple]:
        total, at = len(ids) // 4, 0
        while total - at >= self.capacity:
            yield self._row(doc, at, ids[4 * at : 4 * (at + self.capacity)], total, 0)
            self.next += 1
            at += self.capacity
        parts = -(-(total - at) // self.piece)
        for p in range(parts):  # equal parts, so that no crumb is left
            end = total - (total - at) * (parts - 1 - p) // (parts - p) if p < parts - 1 else total
            self.tails.append((doc, at, ids[4 * at : 4 * end], total))
            self.waiting += end - at
            at = end
        if self.waiting >= self.batch:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        for window in windows([len(t[2]) // 4 for t in self.tails], self.capacity):
            offset = 0
            for i in sorted(window):
                doc, start, ids, total = self.tails[i]
                yield self._row(doc, start, ids, total, offset)
                offset += len(ids) // 4
            self.next += 1
        self.tails, self.waiting = [], 0


def pack(
    docs: DataFrame, capacity: int = 1024, end_id: int = 0, vocabulary: str | None = None, piece: int = 192, batch: int = 1 << 17
) -> DataFrame:
    """Token sequences of at most ``capacity`` ids, as pieces: which ids of which document lie where.

    docs: doc_id and text; other columns are left out. Each document is its ids and then ``end_id``; a null
    or empty text is ``end_id`` alone. Multiples of the capacity are sequences of their own; the tails, cut
    into parts of at most ``piece`` ids, are packed by differencing, about ``batch`` ids at a time. Repeated
    rows and null ids are packed like any others. An empty table gives no pieces.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (the piece itself,
    little-endian 32-bit). One pass over the scan, no shuffle: a task packs what it has read, so a source
    or key with most rows changes nothing; sequence ids are the task's number and a count, the same
    whenever the task is run again. At most ``batch`` / capacity windows a task are not quite full.
    """
    path = vocabulary or tokens.default_vocabulary()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {LAYOUT}"
    names = [c.split()[0] for c in schema.split(", ")]
    end = np.array([end_id], "<u4").tobytes()

    def run(frames):
        encode = tokens.encoder(path).batch
        packer = _Packer(capacity, piece, batch, TaskContext.get().partitionId() << 36)
        for doc_ids, texts in tokens.text_batches(frames):
            ids, offsets = encode(texts)
            raw, at = ids.tobytes(), (4 * offsets).tolist()
            del ids, texts
            rows = []
            for k, doc_id in enumerate(doc_ids):
                rows.extend(packer.add((doc_id,), raw[at[k] : at[k + 1]] + end))
            yield pd.DataFrame(rows, columns=names, dtype=object)
        yield pd.DataFrame(list(packer.flush()), columns=names, dtype=object)

    return docs.select("doc_id", F.col("text").cast("string")).mapInPandas(run, schema)

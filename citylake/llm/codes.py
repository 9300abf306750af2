"""Token ids in directly addressable codes: any token can be read without decoding those before it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylake.llm import tokens
from citylake.llm.common import stored

CHUNK = 8  # bits of an id that one level holds
BLOCK = 512  # bits of a bitmap that one entry of its rank directory covers


class Codes:
    """A sequence of unsigned 32-bit ids, split into levels of 8-bit chunks, low bits first.

    Level k has a chunk of every id that needs more than k chunks, in order, and a bitmap with a 1 where
    the id goes on in level k + 1. An id's place there is the number of ones before it: its rank, from the
    directory (ones before each block of 512 bits) and the bits of one block.
    """

    def __init__(self, chunks: list[np.ndarray], bitmaps: list[np.ndarray], ranks: list[np.ndarray]):
        self.chunks, self.bitmaps, self.ranks = chunks, bitmaps, ranks

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        rest = np.asarray(ids, np.uint32)
        chunks, bitmaps, ranks = [], [], []
        while True:
            chunks.append((rest & np.uint32(255)).astype(np.uint8))
            rest = rest >> np.uint32(CHUNK)
            on = rest != 0
            bitmaps.append(np.packbits(on, bitorder="little"))
            ones = np.add.reduceat(on, np.arange(0, len(on), BLOCK)) if len(on) else np.zeros(0, np.int64)
            ranks.append(np.append(0, np.cumsum(ones))[:-1].astype(np.uint32) if len(on) else np.zeros(0, np.uint32))
            rest = rest[on]
            if not len(rest):
                return cls(chunks, bitmaps, ranks)

    def to_bytes(self) -> bytes:
        """Levels one after the other, each led by its number of chunks."""
        out = [np.array([len(self.chunks)], "<u4").tobytes()]
        for c, b, r in zip(self.chunks, self.bitmaps, self.ranks):
            out += [np.array([len(c)], "<u4").tobytes(), r.astype("<u4").tobytes(), b.tobytes(), c.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> Codes:
        """Views into the bytes; nothing is decoded."""
        chunks, bitmaps, ranks, at = [], [], [], 4
        for _ in range(int.from_bytes(data[:4], "little")):
            n, at = int.from_bytes(data[at : at + 4], "little"), at + 4
            for kept, dtype, size in ((ranks, "<u4", -(-n // BLOCK)), (bitmaps, np.uint8, -(-n // 8)), (chunks, np.uint8, n)):
                kept.append(np.frombuffer(data, dtype, size, at))
                at += kept[-1].nbytes
        return cls(chunks, bitmaps, ranks)

    def __len__(self) -> int:
        return len(self.chunks[0])

    def _rank(self, level: int, i: int) -> int:
        """Ones of a level's bitmap before position i."""
        block = i // BLOCK
        if block >= len(self.ranks[level]):
            block = len(self.ranks[level]) - 1
        if block < 0:
            return 0
        bits = np.unpackbits(self.bitmaps[level][block * BLOCK // 8 : -(-i // 8)], bitorder="little")
        return int(self.ranks[level][block]) + int(bits[: i - block * BLOCK].sum())

    def at(self, i: int) -> int:
        """One id."""
        value = 0
        for level in range(len(self.chunks)):
            value |= int(self.chunks[level][i]) << CHUNK * level
            if not self.bitmaps[level][i // 8] >> i % 8 & 1:
                break
            i = self._rank(level, i)
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids from start to end: two ranks a level, then as many chunks as the ids have there."""
        values = np.zeros(end - start, np.uint32)
        where = np.arange(end - start)
        for level in range(len(self.chunks)):
            if end <= start:
                break
            values[where] |= self.chunks[level][start:end].astype(np.uint32) << np.uint32(CHUNK * level)
            bits = np.unpackbits(self.bitmaps[level][start // 8 : -(-end // 8)], bitorder="little")
            on = bits[start % 8 : start % 8 + end - start].astype(bool)
            start = self._rank(level, start)
            where = where[on]
            end = start + len(where)
        return values


def write_codes(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, segment: int = 1 << 17) -> DataFrame:
    """Encode each text, append ``end_id``, write the ids in ascending doc_id order, and return the files' rows.

    docs: doc_id and text; other columns are left out. A null or empty text is ``end_id`` alone. Null doc_ids
    come first; rows with one doc_id follow each other by the hash of their text, and rows that are equal in
    both in any order. An empty table gives files without rows.

    Rows are dealt by range of (doc_id, text hash), so neither a doc_id nor a source can fill one task.
    A file is one range; its rows are segments of whole documents, of at least ``segment`` ids but for the
    last: part (the file's number, ascending), segment, before (ids of the file's segments before it),
    doc_ids, starts (a document's first id in the segment, one more at the end), n_tokens and codes
    (``Codes`` bytes).
    """
    path = vocabulary or tokens.default_vocabulary()
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("part", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("before", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("n_tokens", T.LongType()), T.StructField("codes", T.BinaryType()),
        ]
    )

    def run(frames):
        encode, part, number, before = tokens.encoder(path).batch, TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4")
        held: list[np.ndarray] = []
        doc_ids: list = []
        starts = [0]

        def out():
            codes = Codes.of(np.concatenate(held)).to_bytes()
            return pd.DataFrame([(part, number, before, list(doc_ids), list(starts), starts[-1], codes)], columns=schema.names)

        for batch_ids, texts in tokens.text_batches(frames):
            ids, offsets = encode(texts)
            for k, doc_id in enumerate(batch_ids):
                held += [ids[offsets[k] : offsets[k + 1]], end]
                doc_ids.append(doc_id)
                starts.append(starts[-1] + int(offsets[k + 1] - offsets[k]) + 1)
                if starts[-1] >= segment:
                    yield out()
                    number, before = number + 1, before + starts[-1]
                    held, doc_ids, starts = [], [], [0]
        if doc_ids:
            yield out()

    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_h")).repartitionByRange("doc_id", "_h")
    rows = rows.sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    return stored(rows.mapInPandas(run, schema), "codes")


def read_codes(files: DataFrame) -> DataFrame:
    """Every document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids.

    The ids before a segment are those of its file, which it knows, and of the files before: a total for each
    file, added up over their numbers. The codes themselves stay where they are read; only the totals, one row
    a file, are joined to them.
    """
    from pyspark.sql import Window

    totals = files.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_file"))
    rows = files.join(F.broadcast(totals), "part").select((F.col("_file") + F.col("before")).alias("base"), "doc_ids", "starts", "codes")
    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]

    def run(frames: Iterator[pd.DataFrame]):
        for frame in frames:
            for base, doc_ids, starts, data in zip(*(frame[c] for c in ("base", "doc_ids", "starts", "codes"))):
                codes, out = Codes.from_bytes(data), []
                for k, doc_id in enumerate(doc_ids):
                    a, b = int(starts[k]), int(starts[k + 1])
                    ids = codes.slice(a, b).astype("<u4").tobytes()
                    out.append((None if pd.isna(doc_id) else doc_id, base + a, b - a, zlib.crc32(ids), ids))
                yield pd.DataFrame(out, columns=names, dtype=object)

    return rows.mapInPandas(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, ids binary")

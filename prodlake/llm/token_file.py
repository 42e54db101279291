"""Token-id files of directly addressable codes.

An id is cut into byte-sized chunks, lowest first.  Level 0 holds the first chunk of every
token; a bitmap beside each level marks the ids that go on in the next one, and a directory of
running bit counts gives the place there.  Any token, or any run of tokens, is read without
decoding a block: each level needs one lookup and one rank.

A dataset is a folder of Parquet files; a row is one segment of whole documents with its code
as a binary blob.  Files follow each other in ascending doc_id order, so that file, segment and
document starts add up to the place of a token in the whole corpus.

Defined cases: a null text is empty and holds only the end id; a null doc_id comes first;
repeated doc_ids stay separate documents, in the order of their texts; a document longer than a
segment has one of its own; an empty table gives an empty dataset; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .tokens import WordEncoder, tokenizer_path
from .worker import per_worker

END_ID = 2
SEGMENT = 1 << 17  # tokens after which a segment is closed
_MAGIC = b"DAC1"
_BLOCK = 512  # bits of one directory entry

SEGMENTS = (
    "part int, seq int, first bigint, n_tokens bigint, doc_ids array<bigint>, doc_ends array<bigint>, blob binary"
)


def dac_encode(ids: np.ndarray) -> bytes:
    """The blob of an array of unsigned 32-bit ids."""
    levels = []
    rest = np.ascontiguousarray(ids, np.uint32)
    while len(rest) or not levels:
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(np.bitwise_count(bitmap), np.arange(0, len(bitmap), _BLOCK // 8)) if len(bitmap) else []
        ranks = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[: len(counts)].astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bitmap.tobytes() + ranks.tobytes())
        rest = rest[more] >> np.uint32(8)
    return _MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)


class Dac:
    """Random access to a blob; arrays are views, nothing is decoded up front."""

    def __init__(self, blob: bytes) -> None:
        if blob[:4] != _MAGIC:
            raise ValueError("not a directly addressable code")
        (levels,), at = struct.unpack_from("<I", blob, 4), 8
        self._levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", blob, at)
            at += 8
            parts = []
            for kind, size in (("u1", n), ("u1", -(-n // 8)), ("<u4", -(-n // _BLOCK))):
                parts.append(np.frombuffer(blob, kind, size, at))
                at += parts[-1].nbytes
            self._levels.append(tuple(parts))

    def __len__(self) -> int:
        return len(self._levels[0][0])

    @staticmethod
    def _rank(bitmap: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before ``i``: one directory entry and at most one block of the bitmap."""
        block = i // _BLOCK
        if block >= len(ranks):
            block = len(ranks) - 1
            if block < 0:
                return 0
        start = block * _BLOCK // 8
        whole = int(np.bitwise_count(bitmap[start : i // 8]).sum())
        tail = int(bitmap[i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(ranks[block]) + whole + tail.bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, ranks in self._levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(bitmap, ranks, i), shift + 8
        return value

    def read(self, start: int, end: int) -> np.ndarray:
        """Tokens ``start`` to ``end``: the ids that go on are a run of the next level too."""
        out = np.zeros(end - start, np.uint32)
        places, shift = np.arange(end - start), np.uint32(0)
        for chunks, bitmap, ranks in self._levels:
            if start >= end:
                break
            out[places] |= chunks[start:end].astype(np.uint32) << shift
            bits = np.unpackbits(bitmap[start // 8 : -(-end // 8)], bitorder="little")
            more = bits[start % 8 : start % 8 + end - start].astype(bool)
            places = places[more]
            start = self._rank(bitmap, ranks, start)
            end, shift = start + len(places), shift + np.uint32(8)
        return out


def _segments(path: str, end_id: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = per_worker(("words", path), lambda: WordEncoder(path))
        part, state = TaskContext.get().partitionId(), {"seq": 0, "first": 0}
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        ends: list[int] = []

        def close() -> pa.RecordBatch:
            row = {
                "part": [part], "seq": [state["seq"]], "first": [state["first"]], "n_tokens": [ends[-1]],
                "doc_ids": [list(doc_ids)], "doc_ends": [list(ends)], "blob": [dac_encode(np.concatenate(ids))],
            }
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            state["seq"], state["first"] = state["seq"] + 1, state["first"] + ends[-1]
            ids.clear(), doc_ids.clear(), ends.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for batch in batches:
            encoded = encoder.encode(text.as_py() for text in batch.column(1))
            for doc_id, own in zip(batch.column(0).to_pylist(), encoded, strict=True):
                own = np.append(own, np.uint32(end_id))
                ids.append(own)
                doc_ids.append(doc_id)
                ends.append((ends[-1] if ends else 0) + len(own))
                if ends[-1] >= segment:
                    yield close()
        if ends:
            yield close()

    return run


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
    segment: int = SEGMENT, files: int | None = None,
) -> None:
    """Encode every whole text of ``docs`` (doc_id, text) and write the dataset to ``path``.

    The texts are range partitioned by doc_id before they are encoded: each task encodes and
    writes one file of ascending ids, and a task that is run again writes the same bytes.
    """
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text").repartitionByRange(files, F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    run = _segments(tokenizer or tokenizer_path("word_bpe_49k.json"), end_id, segment)
    rows.mapInArrow(run, SEGMENTS).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            part, first, doc_ids, ends, blob = (batch.column(c)[row].as_py() for c in range(5))
            code, start, starts, sizes, crcs = Dac(blob), 0, [], [], []
            for end in ends:
                ids = code.read(start, end)
                starts.append(first + start)
                sizes.append(end - start)
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                start = end
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ends), pa.int32()), *(pa.array(x, pa.int64()) for x in (doc_ids, starts, sizes, crcs))],
                names=["part", "doc_id", "place", "n_tokens", "ids_crc32"],
            )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` is the place of its first token in the corpus.  Only the number of tokens per file
    is summed over files; places inside a file are stored with its segments.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    per_file = segments.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_file.select(F.col("part").alias("file"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    found = segments.select("part", "first", "doc_ids", "doc_ends", "blob").mapInArrow(
        _documents, "part int, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return found.join(offsets, F.col("part") == F.col("file")).select(
        "doc_id", (F.col("offset") + F.col("place")).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )


def read_tokens(spark: SparkSession, path: str, file: int, place: int, n: int = 1) -> list[int]:
    """``n`` tokens from ``place`` on inside one file: prunes to the segments that hold them."""
    held = spark.read.schema(SEGMENTS).parquet(path).filter(
        (F.col("part") == file) & (F.col("first") < place + n) & (F.col("first") + F.col("n_tokens") > place)
    )
    out: list[int] = []
    for first, size, blob in sorted(held.select("first", "n_tokens", "blob").collect()):
        out += Dac(bytes(blob)).read(max(place - first, 0), min(place + n - first, size)).tolist()
    return out


def token_round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` to fresh files in the shared folder and index what is read back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, **options)
    return read_index(spark, path)

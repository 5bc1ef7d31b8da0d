"""Token ids in a binary file format with Elias-Fano encoded document boundaries.

Documents are dealt by ranges of ``doc_id`` and sorted, tokenised, and written as *blocks*: runs of whole
documents in ascending ``doc_id`` order, closed at about ``block_tokens`` ids. A block is one binary value::

    magic "KLT1" | u32 documents n | u64 ids N | u8 bytes of an id (2 or 4) | u8 low bits | 2 spare bytes
    | u32 upper bytes | low parts of the n+1 boundaries, bit-packed | upper parts in unary
    | u64 position of every 256th one in the upper parts (the select structure) | ids, little-endian

Boundary i is the number of ids before document i; it is found by select, about 2 + log2(N/n) bits each. Reading goes
from sample to sample, so no table of all boundaries is made; ``read_document`` fetches one document by two selects.
Blocks travel in Parquet files, so commits, retries and remote stores are Spark's affair. Reading needs no
shuffle: a block carries the number of ids before it in its shard, and the ids before each shard (one
number for each partition) are broadcast.

Defined results: a null text is empty and has the end id alone; a null ``doc_id`` sorts first; rows that
repeat stay, each with its own ids; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import Stage, shuffle_parts
from .tokens import encoder

MAGIC = b"KLT1"
HEAD = struct.Struct("<4sIQBBxxI")
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence, with ``select(i)`` giving its i-th value."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.upper, self.samples = n, low_bits, low, upper, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        ratio = int(v[-1]) // n if n else 0
        low_bits = max(0, ratio.bit_length() - 1)
        if low_bits:
            bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.empty(0, dtype=np.uint8)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        flags[ones] = 1
        return cls(n, low_bits, low, np.packbits(flags, bitorder="little"), ones[::SAMPLE].astype("<u8"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.int64)
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th value, reading at most SAMPLE ones from the nearest sampled position."""
        at, skip = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        word = int(self.upper[byte]) >> (at & 7) << (at & 7)
        while word.bit_count() <= skip:
            skip -= word.bit_count()
            byte += 1
            word = int(self.upper[byte])
        for _ in range(skip):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        return ((one - i) << self.low_bits) | int(self._low(np.array([i]))[0])

    def select_run(self, k: int) -> np.ndarray:
        """Values ``k * SAMPLE`` and on, up to the next sample: the bits between two samples, and no others, are read."""
        first = int(self.samples[k])
        end = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.upper)
        flags = np.unpackbits(self.upper[first >> 3 : (end + 7) >> 3], bitorder="little")
        i = np.arange(k * SAMPLE, min((k + 1) * SAMPLE, self.n))
        ones = np.flatnonzero(flags[first & 7 :])[: len(i)] + first
        return ((ones - i) << self.low_bits) | self._low(i)

    def runs(self) -> Iterator[np.ndarray]:
        """All values in order, ``SAMPLE`` at a time: no table of them is made."""
        return map(self.select_run, range(len(self.samples)))


def encode_block(lengths: list[int], ids: bytes, id_bytes: int) -> bytes:
    """One block of the format; ``ids`` are little-endian unsigned 32-bit integers."""
    bounds = np.concatenate(([0], np.cumsum(np.array(lengths, dtype=np.int64))))
    ef = EliasFano.encode(bounds)
    data = np.frombuffer(ids, dtype="<u4")
    if id_bytes == 2:
        if len(data) and int(data.max()) > 0xFFFF:
            raise ValueError("an id needs more than 2 bytes")
        data = data.astype("<u2")
    head = HEAD.pack(MAGIC, len(lengths), len(data), id_bytes, ef.low_bits, len(ef.upper))
    return b"".join((head, ef.low.tobytes(), ef.upper.tobytes(), ef.samples.tobytes(), data.tobytes()))


def decode_block(block: bytes) -> tuple[EliasFano, np.ndarray]:
    """Boundaries and ids of a block, both views of its bytes."""
    magic, n, total, id_bytes, low_bits, upper = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = HEAD.size
    sizes = (-(-(n + 1) * low_bits // 8), upper, 8 * (-(-(n + 1) // SAMPLE)))
    parts = []
    for size in sizes:
        parts.append(np.frombuffer(block, dtype=np.uint8, count=size, offset=at))
        at += size
    samples = np.frombuffer(parts[2].tobytes(), dtype="<u8")
    ids = np.frombuffer(block, dtype="<u2" if id_bytes == 2 else "<u4", count=total, offset=at)
    return EliasFano(n + 1, low_bits, parts[0], parts[1], samples), ids


def read_document(block: bytes, i: int) -> np.ndarray:
    """The ids of the i-th document of a block: two selects, and nothing else is decoded."""
    bounds, ids = decode_block(block)
    return ids[bounds.select(i) : bounds.select(i + 1)]


def _below(value: Column, bounds: Column, n: int, equal: bool) -> Column:
    """How many of ``n`` sorted bounds are below the value (with ``equal``: not above it), by binary search."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))
    under = (lambda b: b <= value) if equal else (lambda b: b < value)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(under(F.get(bounds, at + step - 1)), at + step).otherwise(at))


def _dealt(slim: DataFrame) -> DataFrame:
    """Rows in ranges of ``doc_id``, one to a partition: ``shard`` ascends with the id.

    For numeric ids the bounds come from quantiles of that column alone, so texts are scanned once. An id (or null) that
    fills several ranges by itself is spread over them by text.
    """
    parts = max(1, shuffle_parts(slim.sparkSession))
    if not isinstance(slim.schema["doc_id"].dataType, IntegralType):
        by_range = slim.repartitionByRange(parts, "doc_id", F.xxhash64("text"))
        return by_range.withColumn("shard", F.spark_partition_id()).sortWithinPartitions("doc_id", "text")
    value = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    cuts = [k / parts for k in range(1, parts)]
    found = slim.select(value.alias("v")).agg(F.percentile_approx("v", cuts, max(10_000, 10 * parts)).alias("b")).first()["b"] if cuts else None
    if not found:
        return slim.withColumn("shard", F.lit(0)).repartitionById(parts, "shard").sortWithinPartitions("doc_id", "text")
    bounds = F.lit(np.array(sorted(found), dtype=np.int64))
    low, high = _below(value, bounds, len(found), False), _below(value, bounds, len(found), True)
    spread = slim.withColumn("_low", low).withColumn("shard", high)
    shard = F.when(F.col("shard") - F.col("_low") < 2, F.col("shard")).otherwise(F.col("_low") + F.pmod(F.xxhash64("text"), F.col("shard") - F.col("_low") + 1).cast("int"))
    return spread.withColumn("shard", shard).drop("_low").repartitionById(parts, "shard").sortWithinPartitions("doc_id", "text")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", cut: str = "lead", end_id: int = 2, block_tokens: int = 1 << 20, id_bytes: int = 2, cache_pieces: int = 2_400_000) -> None:
    """Write the files below ``path``: ``shard, block, shard_start, doc_ids, data`` by row.

    ``cache_pieces`` bounds the encoder's cache: about 250 bytes each in a Python worker.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = _dealt(slim)
    end = np.uint32(end_id).astype("<u4").tobytes()
    kind = slim.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, enc = 0, encoder(tokenizer, cut, cache_pieces)
        names, held_ids, lengths, data, tokens, number, before = ["shard", "block", "shard_start", "n_tokens", "doc_ids", "data"], [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            block = encode_block(lengths, b"".join(data), id_bytes)
            ids = pa.concat_arrays(held_ids)
            row = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([number], pa.int64()), pa.array([before], pa.int64()), pa.array([tokens], pa.int64()), row, pa.array([block], pa.binary())], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                shard = part.column("shard")[0].as_py()
                first = 0
                for i, ids in enumerate(enc.encode_many(part.column("text").to_pylist())):
                    data += (ids, end)
                    lengths.append(len(ids) // 4 + 1)
                    tokens += lengths[-1]
                    if tokens >= block_tokens:
                        held_ids.append(part.column("doc_id").slice(first, i + 1 - first))
                        yield close()
                        first, number, before = i + 1, number + 1, before + tokens
                        held_ids, lengths, data, tokens = [], [], [], 0
                held_ids.append(part.column("doc_id").slice(first))
        if lengths:
            yield close()

    out = dealt.mapInArrow(write, f"shard long, block long, shard_start long, n_tokens long, doc_ids array<{kind}>, data binary")
    out.write.mode("overwrite").option("compression", "snappy").option("parquet.block.size", 32 << 20).parquet(path)


def read_tokens(spark, path: str, *, keep_ids: bool = False) -> DataFrame:
    """Rows ``(doc_id, start, n_tokens, ids_crc32[, ids])`` decoded from the files below ``path``."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    start, total = {}, 0
    for r in sorted(files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).toLocalIterator(), key=lambda r: r["shard"]):
        start[r["shard"]] = total
        total += r["n"]
    before = spark.sparkContext.broadcast(start)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids
        for batch in batches:
            for k in range(batch.num_rows):
                base = before.value[batch.column("shard")[k].as_py()] + batch.column("shard_start")[k].as_py()
                bounds, ids = decode_block(batch.column("data")[k].as_py())
                whole, own = ids.astype("<u4", copy=False), batch.column("doc_ids")[k].values
                # the offsets of up to SAMPLE documents at a time, and where the last of them ends
                runs = bounds.runs()
                at = next(runs)
                first = 0
                while first < len(own):
                    more = next(runs, np.empty(0, np.int64))
                    ends = np.concatenate((at[1:], more[:1]))
                    starts = at[: len(ends)]
                    pieces = [memoryview(whole[a:b]).cast("B") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    cols = [own.slice(first, len(ends)), pa.array(base + starts), pa.array(ends - starts), pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
                    if keep_ids:
                        cols.append(pa.array([bytes(p) for p in pieces], pa.binary()))
                    yield pa.RecordBatch.from_arrays(cols, names)
                    first, at = first + len(ends), more

    return files.select("shard", "shard_start", "doc_ids", "data").mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)


def tokens_round_trip(docs: DataFrame, tokenizer: str, **kw) -> DataFrame:
    """Write ``docs`` to the shared folder and return what the files hold."""
    path = Stage(docs.sparkSession, "tokens").path("blocks")
    write_tokens(docs, path, tokenizer, **kw)
    return read_tokens(docs.sparkSession, path)

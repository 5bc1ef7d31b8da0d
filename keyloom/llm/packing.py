"""Packing by shortest-pack-first over the length histogram.

1. Documents become pieces of at most ``capacity`` tokens (long documents are cut every ``capacity``).
2. The histogram of piece lengths, at most ``capacity`` numbers, goes to the driver. Lengths are placed
   longest first, each into the shortest open pack; packs that hold the same lengths in the same order are
   one *pattern* with a count, so the work depends on ``capacity`` and not on the number of documents.
3. Pieces of each length are ranked; the rank finds pattern, sequence and offset in tables whose size
   depends on ``capacity`` alone. Ranks are counted in salted buckets, so one very frequent length is
   spread over many tasks, and joined with the number of pieces in the buckets before.

Defined results: a null text is empty and yields the end id alone; an empty table yields no rows; rows
that repeat are packed once each; a null ``doc_id`` is kept as it is.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage, shuffle_parts
from .tokens import CACHE_PIECES, encoder

BUCKETS = 256


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns ``(count, lengths)``: lengths longest first, each into the pack that is shortest so far."""
    open_packs: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    fills: list[int] = []
    done: list[tuple[int, tuple]] = []

    def add(fill: int, count: int, pack: tuple) -> None:
        if fill == capacity:
            done.append((count, pack))
            return
        if not open_packs[fill]:
            heapq.heappush(fills, fill)
        open_packs[fill].append((count, pack))

    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        left = histogram[length]
        while left:
            if fills and fills[0] + length <= capacity:
                fill = fills[0]
                count, pack = open_packs[fill].pop()
                if not open_packs[fill]:
                    heapq.heappop(fills)
                used = min(count, left)
                if count > used:
                    add(fill, count - used, pack)
                add(fill + length, used, (pack, length))
                left -= used
                continue
            each = capacity // length  # one after another they would fill each new pack before the next opens
            whole, rest = divmod(left, each)
            for count, n in ((whole, each), (1 if rest else 0, rest)):
                if count:
                    pack: tuple = ()
                    for _ in range(n):
                        pack = (pack, length)
                    add(n * length, count, pack)
            left = 0
    done += [x for fill in sorted(open_packs) for x in open_packs[fill]]

    def lengths(pack: tuple) -> list[int]:
        out = []
        while pack:
            pack, length = pack
            out.append(length)
        return out[::-1]

    return [(count, lengths(pack)) for count, pack in done]


def token_pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", cut: str = "drop", end_id: int = 2, capacity: int = 4096, keep_ids: bool = False, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """Rows ``(id, start, length, ids_crc32, doc_tokens[, ids])``, one for each piece of each document.

    ``cache_pieces`` bounds the encoder's cache: about 250 bytes each in a Python worker.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = np.uint32(end_id).astype("<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, cut, cache_pieces)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, data in enumerate(enc.encode_many(part.column("text").to_pylist())):
                    data += end
                    for k in range(0, len(data), 4 * capacity):
                        piece = data[k : k + 4 * capacity]
                        row.append(i)
                        start.append(k // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(data) // 4)
                        if keep_ids:
                            ids.append(piece)
                cols = [part.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    cols.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(cut_up, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids)


def _slots(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank of each slot, first sequence of its pattern, offset in the pattern."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for count, lengths in patterns:
        offset = 0
        for n in lengths:
            found[n].append((ranks[n], sequence, offset))
            ranks[n] += count
            offset += n
        sequence += count
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for n, rows in found.items()}


def pack_pieces(pieces: DataFrame, *, capacity: int = 4096) -> DataFrame:
    """``pieces`` (already stored: it is read more than once) with ``sequence_id`` and ``offset``.

    The driver gets one number for each length, ``capacity`` at most. Ranks are counted within a length and a bucket; what
    the buckets before it hold is joined to them.
    """
    spark: SparkSession = pieces.sparkSession
    buckets = max(BUCKETS, shuffle_parts(spark))
    salted = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = Stage(spark, "packing").put("counts", salted.groupBy("length", "_bucket").agg(F.count("*").alias("n")))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(shortest_pack_first(totals, capacity)))
    ahead = F.sum("n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("length", "_bucket", F.coalesce(ahead, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = salted.withColumn("_rank", within).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = slots.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.empty_like(length), np.empty_like(length)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                first, start, shift = found[n]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = start[k] + rank[at] - first[k]
                offset[at] = shift[k]
            keep = [i for i, name in enumerate(batch.schema.names) if name != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)], [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*pieces.columns, "_rank").mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, **kw) -> DataFrame:
    """Tokenise, cut and pack: one row for each piece, with its place in a sequence."""
    stage = Stage(docs.sparkSession, "packing")
    pieces = stage.put("pieces", token_pieces(docs, tokenizer, capacity=capacity, **kw))
    return pack_pieces(pieces, capacity=capacity)

"""Line deduplication over a sharded minimal perfect hash.

1. Each document gives the 128-bit hashes of its distinct keys (a key is a line without white space at its
   ends, ASCII letters in lower case); documents are counted for each hash, with counts merged before and
   after the shuffle, so that a line found everywhere costs one row for each task.
2. All distinct hashes are dealt to shards. Each shard becomes a minimal perfect hash (levels of bit arrays, as in
   published fingerprint-based constructions) and two arrays in its order: a 16-bit fingerprint and the count of
   documents, in as few bytes as ``min_docs`` needs, about 27 bits a line. Shards are built on the executors and
   written to the shared folder; none passes through the driver.
3. Documents probe the arrays: their distinct hashes go to the shards, each behind its shard's arrays in one sorted
   stream, so a task holds one shard. Hashes that reach ``min_docs`` go back to the texts that asked. No line is joined.
4. Lines found in more than one of ``HOT`` of all line occurrences would make hot shards. There are fewer than ``HOT`` of
   them whatever the input, so the whole hashes of these are broadcast and answer before anything is sent.

Texts meet their answers by a 128-bit hash of the text, in a join whose skewed parts Spark splits.

Defined results: a null or empty text is one empty line; keys shorter than ``min_chars`` code points are
never dropped; every row counts as a document, repeated rows too; an empty table gives no rows; when all
lines go the text is empty.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, shuffle_parts

WHITE = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 500_000
HOT = 20_000
GAMMA = 1.5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def line_keys(text: str | None, min_chars: int = 1) -> tuple[list[bytes], list[bytes]]:
    """Lines of a text and, for each, the 16-byte hash of its key (empty where the key is too short)."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    keys = [x.strip(WHITE).lower() for x in lines]
    if min_chars <= 1:
        return lines, [digest(k) if k else b"" for k in keys]
    return lines, [digest(k) if len(k.decode("utf-8", "surrogatepass")) >= min_chars else b"" for k in keys]


def _mixed(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """A position below ``bits`` for each key of two 64-bit words, another at each level."""
    odd = np.uint64(int(_MIX) * (2 * level + 1) & 0xFFFFFFFFFFFFFFFF)
    x = keys[:, 0] + odd
    x = (x ^ (x >> np.uint64(33))) * _MIX + (keys[:, 1] ^ odd)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Distinct 128-bit keys (rows of two words) to 0..n-1, about 3 bits a key: each level keeps the keys alone in their bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # packed bits
        self.ranks = []
        self.first = []
        total = 0
        for packed in levels:
            words = packed.view("<u8")
            counts = np.bitwise_count(words).astype(np.int64)
            self.first.append(total)
            self.ranks.append(np.cumsum(counts) - counts)
            total += int(counts.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            bits = -(-int(len(left) * GAMMA + 64) // 64) * 64
            at = _mixed(left, len(levels), bits)
            hits = np.bincount(at, minlength=bits)
            levels.append(np.packbits(hits == 1, bitorder="little"))
            left = left[hits[at] != 1]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for keys that no level holds. A foreign key may get any place."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (packed, ranks, first) in enumerate(zip(self.levels, self.ranks, self.first, strict=True)):
            if not len(left):
                break
            at = _mixed(keys[left], level, len(packed) * 8)
            words = packed.view("<u8")[at >> 6]
            bit = (at & 63).astype(np.uint64)
            hit = (words >> bit) & np.uint64(1) == 1
            under = np.bitwise_count(words[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = first + ranks[at[hit] >> 6] + under
            left = left[~hit]
        return out


class Shard:
    """A perfect hash with its fingerprints and counts, which stop at the largest number their width holds."""

    def __init__(self, mph: PerfectHash, prints: np.ndarray, counts: np.ndarray):
        self.mph, self.prints, self.counts = mph, prints, counts

    @classmethod
    def build(cls, hashes: np.ndarray, counts: np.ndarray, limit: int) -> Shard:
        mph = PerfectHash.build(hashes)
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if limit <= np.iinfo(k).max)
        at = mph.find(hashes)
        prints, own = np.empty(mph.size, dtype=np.uint16), np.empty(mph.size, dtype=kind)
        prints[at] = _prints(hashes)
        own[at] = np.minimum(counts, min(np.iinfo(kind).max, np.iinfo(np.int64).max)).astype(kind)
        return cls(mph, prints, own)

    def to_bytes(self) -> bytes:
        return pickle.dumps((self.mph.levels, self.prints, self.counts))

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        levels, prints, counts = pickle.loads(data)
        return cls(PerfectHash(levels), prints, counts)

    @property
    def nbytes(self) -> int:
        return self.prints.nbytes + self.counts.nbytes + sum(x.nbytes for x in self.mph.levels)

    def count_of(self, hashes: np.ndarray) -> np.ndarray:
        """How many documents hold each line; 0 for lines that are not indexed (but for one in 65,536 of those)."""
        at = self.mph.find(hashes)
        ok = at >= 0
        ok[ok] = self.prints[at[ok]] == _prints(hashes[ok])
        out = np.zeros(len(hashes), dtype=np.int64)
        out[ok] = self.counts[at[ok]]
        return out


def _prints(hashes: np.ndarray) -> np.ndarray:
    return (hashes[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)


def _as_hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes[:, 1] >> np.uint64(17)) % np.uint64(shards)).astype(np.int64)


def line_counts(docs: DataFrame, *, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """Rows ``(hash, n)``: each distinct key's hash and the number of documents that hold it."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["hash", "n"])
            counts.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for text in batch.slice(at, 512).column(0).to_pylist():
                    for h in set(line_keys(text, min_chars)[1]):
                        counts[h] = counts.get(h, 0) + 1
                if len(counts) > 100_000:
                    yield flush()
        yield flush()

    seen = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(hashes, "hash binary, n long")
    return seen.filter(F.length("hash") > 0).groupBy("hash").agg(F.sum("n").alias("n"))


def build_index(lines: DataFrame, shards: int, limit: int) -> DataFrame:
    """Rows ``(shard, data)``: the index of all lines, one row for each shard."""

    def build(key, table):
        shard = Shard.build(_as_hashes(table.column("hash").to_pylist()), table.column("n").to_numpy(), limit)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([shard.to_bytes()], pa.binary())})

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _shard_of(_as_hashes(b.column("hash").to_pylist()), shards)
            yield pa.RecordBatch.from_arrays([b.column("hash"), b.column("n"), pa.array(at)], ["hash", "n", "shard"])

    return lines.mapInArrow(numbered, "hash binary, n long, shard long").groupBy("shard").applyInArrow(build, "shard long, data binary")


def _asked(texts: DataFrame, hot: Broadcast, shards: int, min_chars: int) -> DataFrame:
    """Rows ``(shard, t1, t2, data)``: the distinct hashes of a text that a shard must answer, one after another."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value | {b""}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = [set(line_keys(t, min_chars)[1]) - known for t in part.column("text").to_pylist()]
                row = np.repeat(np.arange(len(own)), [len(x) for x in own])
                hashes = _as_hashes([h for x in own for h in x])
                shard = _shard_of(hashes, shards)
                by = np.lexsort((shard, row))
                row, shard, data = row[by], shard[by], hashes[by].tobytes()
                starts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])))) if len(row) else np.empty(0, np.int64)
                ends = np.append(starts, len(row))[1:]
                of = pa.array(row[starts])
                cols = [pa.array(shard[starts]), part.column("t1").take(of), part.column("t2").take(of), pa.array([data[16 * a : 16 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "t1", "t2", "data"])

    return texts.mapInArrow(ask, "shard long, t1 long, t2 long, data binary")


def _answered(index: DataFrame, asked: DataFrame, min_docs: int) -> DataFrame:
    """Rows ``(t1, t2, data)``: of the hashes asked those that ``min_docs`` documents hold."""
    arrays = index.withColumn("kind", F.lit(0)).withColumn("t1", F.lit(None).cast("long")).withColumn("t2", F.lit(None).cast("long"))
    stream = arrays.unionByName(asked.withColumn("kind", F.lit(1))).repartition(shuffle_parts(index.sparkSession), "shard").sortWithinPartitions("shard", "kind")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            first = b.column("kind").to_numpy() == 0
            data = b.column("data")
            bounds = [0, *np.flatnonzero(first).tolist(), b.num_rows]
            for x, y in itertools.pairwise(sorted(set(bounds))):
                if first[x]:
                    shard, x = Shard.from_bytes(data[x].as_py()), x + 1
                own = data.slice(x, y - x).to_pylist()
                if not own:
                    continue
                often = shard.count_of(_as_hashes(own)) >= min_docs
                ends = np.cumsum([len(d) // 16 for d in own])
                rows, found = [], []
                for k, part in enumerate(np.split(often, ends[:-1])):
                    if part.any():
                        rows.append(x + k)
                        found.append(np.frombuffer(own[k], dtype="<u8").reshape(-1, 2)[part].tobytes())
                of = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("t1").take(of), b.column("t2").take(of), pa.array(found, pa.binary())], ["t1", "t2", "data"])

    return stream.select("shard", "kind", "t1", "t2", "data").mapInArrow(answer, "t1 long, t2 long, data binary")


def drop_frequent_lines(docs: DataFrame, *, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with the lines left in ``text_col`` and the columns ``n_lines`` and ``n_dropped``."""
    spark = docs.sparkSession
    stage = Stage(spark, "lines")
    lines = stage.put("counts", line_counts(docs, text_col=text_col, min_chars=min_chars))
    n, total = lines.agg(F.count("*"), F.sum("n")).first()
    shards = max(1, -(-n // SHARD_KEYS))
    index = stage.put("index", build_index(lines, shards, min_docs))
    hot = lines.filter(F.col("n") >= max(min_docs, (total or 0) // HOT + 1)).toArrow()  # fewer than HOT rows
    known = spark.sparkContext.broadcast(frozenset(hot.column("hash").to_pylist()))

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    names = [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]
    asked = _asked(docs.select(text.alias("text"), *names), known, shards, min_chars)
    found = _answered(index, asked, min_docs).groupBy("t1", "t2").agg(F.collect_set("data").alias("found"))
    own = "_"  # a prefix that no column of the documents has
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    keys = [f"{own}t1", f"{own}t2"]
    found = stage.put("found", found.select(F.col("t1").alias(keys[0]), F.col("t2").alias(keys[1]), F.array_join(F.transform("found", F.hex), "").alias(f"{own}found")))

    kept = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_dropped")]
    where = [f.name for f in kept].index(text_col)
    whole = docs.select(*(F.col(f"`{f.name}`") for f in kept), names[0].alias(keys[0]), names[1].alias(keys[1]))
    whole = whole.join(found, keys, "left").drop(*keys)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        always = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts, n_lines, n_dropped = [], [], []
                for text, answer in zip(part.column(where).to_pylist(), part.column(len(kept)).to_pylist(), strict=True):
                    ls, keys = line_keys(text, min_chars)
                    raw = bytes.fromhex(answer or "")
                    own = {raw[k : k + 16] for k in range(0, len(raw), 16)}
                    left = [x for x, h in zip(ls, keys, strict=True) if h not in always and h not in own]
                    texts.append(b"\n".join(left).decode("utf-8", "surrogatepass"))
                    n_lines.append(len(ls))
                    n_dropped.append(len(ls) - len(left))
                cols = [pa.array(texts, pa.string()) if i == where else part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*part.schema.names[: len(kept)], "n_lines", "n_dropped"])

    fields = ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in kept)
    return whole.mapInArrow(drop, f"{fields}, n_lines long, n_dropped long")

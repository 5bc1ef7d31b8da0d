"""Language-model scoring by Katz backoff, over n-gram tables that stay partitioned.

The model has two levels. With ``N`` training tokens and ``n_r`` types of count ``r``:

* word level: ``p1(w) = d1(c(w)) * c(w) / (N + 1)``; what is left over is the probability of a word that
  training never saw, as one outcome;
* pair level: ``p2(w|h) = d2(c(h,w)) * c(h,w) / (c(h) + DELTA)`` for pairs seen in training, otherwise
  ``a(h) * p1(w)``, with ``a(h) = (1 - sum of p2 over words seen after h) / (1 - sum of their p1)``, so that
  the probabilities after each history sum to one. ``a(h) = 1`` where ``h`` was never seen.

``d`` are Good-Turing discounts for counts up to ``K`` (with an absolute discount where the counts of counts
give no value between 0 and 1). ``DELTA`` leaves a little to unseen words after histories without any rare
successor. A document starts after a fixed start token and ends with an end token.

How it is computed. No table of words or pairs is collected or broadcast:

1. Texts become *chunks* of about a million tokens as local word numbers, written to the shared folder.
2. Each chunk sends its distinct words, with training counts, to partitions by word hash; they return to
   each chunk its words' global numbers and counts.
3. Each chunk sends its distinct pairs to partitions by history (a frequent history is spread by pair), with
   training counts and, for each document, the number of its tokens.
4. A partition sums the pairs of all chunks and resolves each document's tokens: seen pairs at the pair
   level, the others at the word level; it keeps what the backoff weights of the unseen ones need.
5. The discounts follow from counts of counts over all partitions (``K + 1`` numbers each); weights and
   logarithms are added up for each document.

Everything that moves is a packed array for each (chunk, partition), never a row for each token.

Defined results: a null text is empty and has the end token alone; a null id belongs to training; rows that
repeat are scored and counted each; an empty table gives no rows; without training tokens all words are
unknown and every score is 0. A document longer than a chunk continues in the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import END, chunked, mix, order_of, pack, unpack
from .common import Stage, shuffle_parts

K = 5
DELTA = 0.01


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discounts for counts 1..K from ``n[r]``, the number of types with count r up to K + 1."""
    d = np.ones(K + 1)
    share = (K + 1) * n[K + 1] / n[1] if n[1] else 0.0
    for r in range(1, K + 1):
        value = ((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share) if n[r] and share != 1 else 0.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


def _word_table(chunks: DataFrame, parts: int) -> DataFrame:
    """Per word partition: a row with counts of counts, and for each chunk its words' numbers and counts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                hashes = np.frombuffer(b.column("words")[i].as_py(), "<u8")
                counts = unpack(b.column("counts")[i].as_py())[0]
                order, at = order_of(hashes, parts)
                used = [p for p in range(parts) if at[p + 1] > at[p]]
                cols = [
                    pa.array(used, pa.int64()),
                    pa.array([b.column("chunk")[i].as_py()] * len(used), pa.int64()),
                    pa.array([hashes[order[at[p] : at[p + 1]]].tobytes() for p in used], pa.binary()),
                    pa.array([pack(counts[order[at[p] : at[p + 1]]]) for p in used], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["part", "chunk", "words", "counts"])

    def number(key, table):
        part = key[0].as_py()
        words = [np.frombuffer(x, "<u8") for x in table.column("words").to_pylist()]
        counts = np.concatenate([unpack(x)[0] for x in table.column("counts").to_pylist()])
        found, inverse = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(found)).astype(np.int64)
        rank = np.empty(len(found), dtype=np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(found))  # small numbers for frequent words
        gid, c = (rank * parts + part)[inverse], total[inverse]
        ends = np.cumsum([len(w) for w in words])
        back = [pack(g, n) for g, n in zip(np.split(gid, ends[:-1]), np.split(c, ends[:-1]), strict=True)]
        few = np.bincount(np.minimum(total, K + 2), minlength=K + 3)
        stat = pack(np.array([total.sum(), (total > 0).sum()]), few, total[found == _end_hash()])
        chunk = [*table.column("chunk").to_pylist(), -1]
        return pa.table({"part": pa.array([part] * len(chunk), pa.int64()), "chunk": pa.array(chunk, pa.int64()), "data": pa.array([*back, stat], pa.binary())})

    return chunks.select("chunk", "words", "counts").mapInArrow(send, "part long, chunk long, words binary, counts binary").groupBy("part").applyInArrow(number, "part long, chunk long, data binary")


def _end_hash() -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(END))


class _Words:
    """The word level: probabilities by count."""

    def __init__(self, n: int, v: int, few: np.ndarray, ends: int):
        self.n, self.v, self.ends = n, v, ends  # ends: training documents, the count of the start as history
        self.d = discounts(few)
        self.unknown = 1.0 - (n - sum((1 - self.d[r]) * r * few[r] for r in range(1, K + 1))) / (n + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.where(c <= K, c, 0)] * c / (self.n + 1), self.unknown)


def _send_pairs(joined: DataFrame, level: _Words, parts: int, kind: str) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "chunk", "ids", "data"]
        for b in batches:
            for i in range(b.num_rows):
                chunk = b.column("chunk")[i].as_py()
                order, at = unpack(b.column("order")[i].as_py())
                size = len(order)
                gid, cnt = np.zeros(size, np.int64), np.zeros(size, np.int64)
                for back in b.column("back")[i].as_py():
                    mine = order[at[back["part"]] : at[back["part"] + 1]]
                    gid[mine], cnt[mine] = unpack(back["data"])
                uid, held, first, n, _ = unpack(b.column("meta")[i].as_py())
                tokens = unpack(b.column("tokens")[i].as_py())[0]
                start = np.cumsum(n) - n
                seg = np.repeat(np.arange(len(n)), n)
                c = cnt[tokens]
                if level.n:
                    base = np.add.reduceat(np.log10((c + 1) / (level.n + level.v + 1)), start)
                else:
                    base = np.zeros(len(n))
                known = np.add.reduceat((c > 0).astype(np.int64), start)
                info = pack(uid, held, n, known)
                yield pa.RecordBatch.from_arrays([pa.array([chunk % parts], pa.int64()), pa.array([chunk], pa.int64()), b.column("ids").slice(i, 1), pa.array([b"I" + len(info).to_bytes(8, "little") + info + base.astype("<f8").tobytes()])], names)
                if not level.n:
                    continue
                hist = np.empty_like(tokens)
                hist[1:] = tokens[:-1]
                hist[start] = first
                hist_count = cnt.copy()
                hist_count[1] = level.ends
                key = hist * size + tokens
                by = np.argsort(key, kind="stable")
                key, seg, train = key[by], seg[by], (held == 0)[seg[by]]
                new_type = np.concatenate(([True], key[1:] != key[:-1]))
                new_ref = new_type | np.concatenate(([True], seg[1:] != seg[:-1]))
                types, refs = np.flatnonzero(new_type), np.flatnonzero(new_ref)
                h, w = key[types] // size, key[types] % size
                r = np.add.reduceat(train.astype(np.int64), types)
                mult = np.diff(np.append(refs, len(key)))
                ref_seg, n_ref = seg[refs], np.diff(np.append(np.searchsorted(refs, types), len(refs)))
                ref_at = np.cumsum(n_ref) - n_ref
                spread = hist_count[h] * 4 * parts > level.n
                dest = (mix(gid[h] + np.where(spread, (gid[w] + 1) * 0x9E3779B1, 0)) % np.uint64(parts)).astype(np.int64)
                by = np.argsort(dest, kind="stable")
                bounds = np.searchsorted(dest[by], np.arange(parts + 1))
                out_part, out_data = [], []
                for p in range(parts):
                    t = by[bounds[p] : bounds[p + 1]]
                    if not len(t):
                        continue
                    m = n_ref[t]
                    own = np.repeat(ref_at[t] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                    runs = np.flatnonzero(np.concatenate(([True], h[t][1:] != h[t][:-1])))
                    hl = h[t][runs]
                    out_part.append(p)
                    out_data.append(b"P" + pack(gid[hl], hist_count[hl], np.diff(np.append(runs, len(t))), gid[w[t]], cnt[w[t]], r[t], m, ref_seg[own], mult[own], spread[t][runs].astype(np.int64), np.array([len(n)])))
                none = pa.array([None] * len(out_part), b.column("ids").type)
                yield pa.RecordBatch.from_arrays([pa.array(out_part, pa.int64()), pa.array([chunk] * len(out_part), pa.int64()), none, pa.array(out_data, pa.binary())], names)

    return joined.mapInArrow(send, f"part long, chunk long, ids array<{kind}>, data binary")


def _resolve(pairs: DataFrame, level: _Words, kind: str) -> DataFrame:
    def resolve(key, table):
        chunk, ids, data = table.column("chunk").to_pylist(), table.column("ids"), table.column("data").to_pylist()
        info = [i for i, d in enumerate(data) if d[:1] == b"I"]
        rows = [i for i, d in enumerate(data) if d[:1] == b"P"]
        out_chunk, out_data = [chunk[i] for i in info], [data[i] for i in info]
        out_ids = [ids.take(pa.array(info, pa.int64()))] if info else []
        if rows:
            blobs = [unpack(data[i][1:], wide=False) for i in rows]
            hg = np.concatenate([np.repeat(b[0], b[2]) for b in blobs])
            hc = np.concatenate([np.repeat(b[1], b[2]) for b in blobs])
            split = np.concatenate([np.repeat(b[9], b[2]) for b in blobs])
            wg, wc, r, m = (np.concatenate([b[k] for b in blobs]) for k in (3, 4, 5, 6))
            h_all, h_first, h_inv = np.unique(hg, return_index=True, return_inverse=True)
            w_all, w_inv = np.unique(wg, return_inverse=True)
            pair, first, inv = np.unique(h_inv * len(w_all) + w_inv, return_index=True, return_inverse=True)
            count = np.bincount(inv, weights=r, minlength=len(pair)).astype(np.int64)
            few = np.bincount(np.minimum(count, K + 2), minlength=K + 3)
            # for each history: types by count up to K, tokens above K, and word-level mass of what was seen
            own = pair // len(w_all)
            seen = count > 0
            table_h = np.zeros((K + 2, len(h_all)))
            for k in range(1, K + 1):
                table_h[k - 1] = np.bincount(own[count == k], minlength=len(h_all))
            table_h[K] = np.bincount(own, weights=np.where(count > K, count, 0), minlength=len(h_all))
            table_h[K + 1] = np.bincount(own[seen], weights=level.p(wc[first])[seen], minlength=len(h_all))
            h_count, h_split = hc[h_first], split[h_first]
            p1 = np.log10(level.p(wc))
            token_count = count[inv]
            value = np.where(token_count > K, np.log10(np.maximum(token_count, 1)), 0.0) - np.where(token_count > 0, np.log10(hc + DELTA), 0.0) + np.where(token_count == 0, p1, 0.0)
            at = 0
            for i, b in zip(rows, blobs, strict=True):
                n, segs = len(b[3]), int(b[10][0])
                t = np.repeat(np.arange(at, at + n), b[6])
                seg, mult = b[7], b[8]
                sums = np.bincount(seg, weights=value[t] * mult, minlength=segs)
                rare = [np.bincount(seg, weights=np.where(token_count[t] == k, mult, 0), minlength=segs).astype(np.int64) for k in range(1, K + 1)]
                back = np.flatnonzero((token_count[t] == 0) & (hc[t] > 0))
                bh, where = np.unique(h_inv[t[back]], return_inverse=True)
                ints = pack(*rare, seg[back], mult[back], where, h_all[bh], h_count[bh], h_split[bh])
                out_chunk.append(chunk[i])
                out_data.append(b"S" + len(ints).to_bytes(8, "little") + ints + segs.to_bytes(8, "little") + sums.astype("<f8").tobytes() + table_h[:, bh].astype("<f8").tobytes())
                at += n
            spread = np.flatnonzero(h_split)
            ints = pack(few, h_all[spread])
            out_chunk.append(-1)
            out_data.append(b"N" + len(ints).to_bytes(8, "little") + ints + table_h[:, spread].astype("<f8").tobytes())
        none = pa.chunked_array([pa.array([None] * (len(out_chunk) - len(info)), ids.type)])
        out_ids = pa.chunked_array([c for x in [*out_ids, none] for c in x.chunks], ids.type)
        return pa.table({"chunk": pa.array(out_chunk, pa.int64()), "ids": out_ids, "data": pa.array(out_data, pa.binary())})

    return pairs.groupBy("part").applyInArrow(resolve, f"chunk long, ids array<{kind}>, data binary")


def _body(data: bytes) -> tuple[list[np.ndarray], bytes]:
    size = int.from_bytes(data[1:9], "little")
    return unpack(data[9 : 9 + size]), data[9 + size :]


def _backoff(table_h: np.ndarray, count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The weight of each history from its row of counts."""
    seen = (d[1:, None] * np.arange(1, K + 1)[:, None] * table_h[:K]).sum(axis=0) + table_h[K]
    left = np.maximum(1.0 - seen / (count + DELTA), 1e-300)
    return left / np.maximum(1.0 - table_h[K + 1], 1e-300)


def score(docs: DataFrame, held_out, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)``; ``held_out`` is a column."""
    spark = docs.sparkSession
    stage, parts = Stage(spark, "katz"), 2 * max(1, shuffle_parts(spark))  # smaller groups than tasks
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    kind = slim.schema["id"].dataType.simpleString()
    whole = chunked(slim, kind, words_of, parts)
    none = lambda name: F.lit(None).cast(whole.schema[name].dataType).alias(name)
    text, vocab = ("ids", "meta", "tokens", "order"), ("words", "counts")
    one = F.struct(F.lit("text").alias("kind"), *text, *map(none, vocab))
    two = F.struct(F.lit("vocab").alias("kind"), *map(none, text), *vocab)
    # Two folders from one pass: the vocabularies are read once and then removed.
    both = whole.select("chunk", F.explode(F.array(one, two)).alias("r")).select("chunk", "r.*")
    both.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(stage.path("chunks"))
    stored = spark.read.schema(both.schema).parquet(stage.path("chunks"))
    chunks = stored.filter("kind = 'text'").select("chunk", *text)
    words = stage.put("words", _word_table(stored.filter("kind = 'vocab'"), parts))
    stage.drop("chunks/kind=vocab")

    n, v, ends, few = 0, 0, 0, np.zeros(K + 3, dtype=np.int64)
    for r in words.filter("chunk = -1").select("data").toLocalIterator():
        total, own, end = unpack(bytes(r["data"]))
        n, v, few, ends = n + int(total[0]), v + int(total[1]), few + own, ends + int(end.sum())
    level = _Words(n, v, few, ends)

    back = words.filter("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("part", "data")).alias("back"))
    joined = chunks.join(back, "chunk")
    stored = stage.put("pairs", _resolve(_send_pairs(joined, level, parts, kind), level, kind))
    stage.drop("words")

    few = np.zeros(K + 3, dtype=np.int64)
    spread: dict[int, np.ndarray] = {}  # frequent histories only: at most 4 for each partition
    for r in stored.filter("chunk = -1").select("data").toLocalIterator():
        (own, gid), rest = _body(bytes(r["data"]))
        few += own
        for g, column in zip(gid.tolist(), np.frombuffer(rest, "<f8").reshape(K + 2, -1).T, strict=True):
            spread[g] = spread.get(g, 0) + column
    d = discounts(few)
    shared = spark.sparkContext.broadcast(spread)

    def add(key, table):
        total, info, ids = None, None, None
        for i, data in enumerate(table.column("data").to_pylist()):
            ints, rest = _body(data)
            if data[:1] == b"I":
                info, ids = (ints, np.frombuffer(rest, "<f8")), table.column("ids")[i].values
                continue
            *rare, seg, mult, where, gid, count, split = ints
            segs = int.from_bytes(rest[:8], "little")
            sums = np.frombuffer(rest, "<f8", segs, 8).copy()
            table_h = np.frombuffer(rest, "<f8", -1, 8 + 8 * segs).reshape(K + 2, -1).copy()
            for j in np.flatnonzero(split).tolist():
                table_h[:, j] = shared.value[int(gid[j])]
            for k in range(1, K + 1):
                sums += rare[k - 1] * np.log10(d[k] * k)
            if len(seg):
                weight = np.log10(_backoff(table_h, count, d))
                sums += np.bincount(seg, weights=weight[where] * mult, minlength=segs)
            total = sums if total is None else total + sums
        (uid, held, n_tokens, known), base = info
        if total is None:
            total = np.zeros(len(uid))
        return pa.table({"uid": pa.array(uid), "id": ids, "held_out": pa.array(held > 0), "n_tokens": pa.array(n_tokens), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(total)})

    parted = stored.filter("chunk >= 0").groupBy("chunk").applyInArrow(add, f"uid long, id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    whole = parted.groupBy("uid", "id", "held_out").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return whole.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")

"""Jaccard join over word n-grams by a MinHash LSH forest, with exact verification.

1. A document's set holds the hashes of its runs of ``n`` words (all words, if fewer). Documents with equal
   sets are one class with its smallest id; only that representative goes on.
2. Each of ``trees`` trees orders the representatives by a path of ``depth`` MinHash values, a sorted trie. A text's
   matched prefix is shortened from ``depth`` until a pair of the least similarity that the text can have is met in
   some tree with probability ``recall`` (``matched_prefix``). That similarity is the smallest fraction from
   ``threshold`` on that its number of n-grams allows: a text of 6 stops at 7 values, a long one at 6, and one of 3 can
   only be equal to another. A pair is met on the longer of both prefixes, as its similarity is within reach of both.
   Rows are dealt by the shortest prefix of all and sorted, which lays the runs of the trie out.
3. Within a run of at most ``ALL_PAIRS`` texts all pairs are candidates; the texts of a larger one go to step 5.
   Pairs whose signatures agree far too rarely are left out.
4. Candidates are verified exactly on the whole texts.
5. Texts of large runs are brought together once (in blocks, if they are very many) with all texts that they
   share such runs with. There every pair that meets in some tree is verified once, whatever else joins it. Only
   each text's number of links and the links that join classes leave the task, so a run of g near copies gives
   about g rows and not g * g. A very large run is salted in step 3 and met whole here.
6. Connected classes come from alternating large-star and small-star steps.

Inside, a set is named by a number of its own, not by a document's id: the texts of an id that repeats are different
members, each verified on its own text.

Result: one row for each document: ``class_id`` (smallest id among the documents linked to it, directly or
through others), ``rep_id`` (smallest id with the same set) and ``n_links``: the number of verified links of
its representative to other texts, in runs of any size.

Defined results: null texts and texts without words are linked to nothing; a null id is dropped; rows that repeat an
id with different texts give one row: the classes of these texts are one, ``rep_id`` is the smallest of theirs and
``n_links`` the sum over its different sets; an empty table gives no rows; ids that are no integers raise.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage, arrow_rows, integral, shuffle_parts

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALL_PAIRS = 32
HOT_RUN = 20_000
SIG = 64
BLOCK = 4096
BLOCK_SHINGLES = 2_000_000
BROADCAST_IDS = 700_000  # 16 MB of numbers, ids and hashes
ROUNDS = 200  # the steps needed grow with the logarithm of a class's diameter


def shortest_prefix(trees: int, depth: int, threshold: float, recall: float) -> int:
    """The longest prefix at which a pair of ``threshold`` similarity is met with probability ``recall``."""
    for k in range(depth, 0, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    return 1


def least_similarity(n: int, threshold: float) -> float | None:
    """The least similarity from ``threshold`` on, below 1, that a set of ``n`` can have with any set; None if there is none."""
    found = []
    for both in range(max(1, math.ceil(threshold * n - 1e-9)), n + 1):
        union = math.floor(both / threshold + 1e-9)
        if union >= n and both < union:
            found.append(both / union)
    return min(found, default=None)


def matched_prefix(sizes: np.ndarray, trees: int, depth: int, threshold: float, recall: float) -> np.ndarray:
    """For each number of n-grams the matched prefix; 0 where only an equal set can be similar enough."""
    known = {}
    for n in np.unique(sizes).tolist():
        least = threshold if n > 1000 else least_similarity(n, threshold)
        known[n] = 0 if least is None else shortest_prefix(trees, depth, least, recall)
    return np.array([known[n] for n in sizes.tolist()], dtype=np.int64)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words."""
    import xxhash

    text = text or ""
    words = WORDS.findall(text.lower() if text.isascii() else text.translate(_ASCII_LOWER))
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = dict.fromkeys(words)
    for w in hashes:
        hashes[w] = xxhash.xxh3_64_intdigest(w)
    h = np.array([hashes[w] for w in words], dtype=np.uint64)
    n = min(n, len(h))
    m = len(h) - n + 1
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + m]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(out ^ (out >> np.uint64(31)))


class MinHash:
    """Signatures of ``size`` values by multiply-add hashing; their low 16 bits are kept."""

    def __init__(self, size: int):
        rng = np.random.RandomState(7)
        self.a = (rng.randint(0, 1 << 31, size).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.randint(0, 1 << 31, size).astype(np.uint32)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(x), 256):
            y = x[at : at + 256, None] * self.a + self.b
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            best = np.minimum(best, y.min(axis=0))
        return best


def _signed(docs: DataFrame, n: int, trees: int, depth: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        mh = MinHash(trees * depth)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, sizes, sigs = [], [], []
                for text in part.column("text").to_pylist():
                    s = shingles(text, n)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sizes.append(len(s))
                    sigs.append(mh.of(s).astype("<u2").tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("copy"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["id", "copy", "key", "n", "sig"])

    return docs.mapInArrow(sign, "id long, copy long, key binary, n long, sig binary")


def _keys(sig: np.ndarray, prefix: int) -> np.ndarray:
    """For each row and tree the hash of its path down to the shortest prefix."""
    h = np.zeros(sig.shape[:2], dtype=np.uint64)
    for k in range(prefix):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k] + np.uint64(1)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.arange(sig.shape[1], dtype=np.uint64)
    return h.view(np.int64)


def _short(sig: np.ndarray) -> np.ndarray:
    """A byte of each of ``SIG`` values, for estimates."""
    flat = sig.reshape(len(sig), -1)
    return flat[:, :: max(1, flat.shape[1] // SIG)][:, :SIG].astype(np.uint8)


def _key_counts(reps: DataFrame, trees: int, depth: int, prefix: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(-1, trees, depth)
                keys, n = np.unique(_keys(sig, prefix), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

    return reps.select("sig").mapInArrow(count, "key long, n long")


def _runs(reps: DataFrame, trees: int, depth: int, prefix: int, threshold: float, recall: float, hot: DataFrame | None, salts: int) -> DataFrame:
    """A row for each (tree, representative), dealt and sorted so that runs are contiguous.

    ``rest``: the values of the path below the shortest prefix; ``own``: the representative's matched prefix.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                own = matched_prefix(part.column("n").to_numpy(), trees, depth, threshold, recall)
                part = part.filter(pa.array(own > 0))
                own, m = own[own > 0], part.num_rows
                if not m:
                    continue
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(m, trees, depth)
                short = [x.tobytes() for x in _short(sig)]
                rest = sig[:, :, prefix:].reshape(m * trees, -1)
                doc, size = np.array(part.column("id").to_pylist(), dtype=np.int64), part.column("n").to_numpy()
                salt = (doc * 2654435761 >> 7) % salts + 1
                wide = (np.repeat(x, trees) for x in (salt.astype(np.int32), doc, size, own.astype(np.int8)))
                cols = [pa.array(_keys(sig, prefix).ravel()), *map(pa.array, wide), pa.array([r.tobytes() for r in rest], pa.binary()), pa.array([s for s in short for _ in range(trees)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["key", "salt", "id", "n", "own", "rest", "sig"])

    shape = "key long, salt int, id long, n long, own byte, rest binary, sig binary"
    out = reps.mapInArrow(rows, shape)
    if hot is None:
        out = out.withColumn("salt", F.lit(0))
    else:  # as small as its keys are few; Spark chooses how to join it
        out = out.join(hot.select("key", F.lit(1).alias("_hot")), "key", "left").withColumn("salt", F.when(F.col("_hot").isNotNull(), F.col("salt")).otherwise(0)).drop("_hot")
    return out.repartition(shuffle_parts(reps.sparkSession), "key", "salt").sortWithinPartitions("key", "salt", "rest", "id")


def _near(sig: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs that size and signature allow; five standard errors below the threshold are allowed."""
    ok = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])
    ok[ok] = (sig[i[ok]] == sig[j[ok]]).mean(axis=1) >= max(0.0, threshold - 0.25)
    return ok


def _candidates(runs: DataFrame, prefix: int, threshold: float) -> DataFrame:
    """Rows ``(kind, a, b)``. Kind 0: pairs of texts, a < b, of small runs. Kind 1: the first text and each
    text of a run of more than ``ALL_PAIRS``. Kind 2: a salted run and the first text of one of its parts."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        out: list[tuple[int, int, int]] = []

        def run(part: pa.Table) -> None:
            ids, n = part.column("id").to_numpy(), part.column("n").to_numpy()
            g = len(ids)
            if g <= ALL_PAIRS and not part.column("salt")[0].as_py():
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(g, -1)
                rest = np.frombuffer(b"".join(part.column("rest").to_pylist()), "<u2").reshape(g, -1)
                own = part.column("own").to_numpy()
                i, j = np.triu_indices(g, 1)
                common = prefix + np.cumprod(rest[i] == rest[j], axis=1).sum(axis=1)
                met = common >= np.maximum(own[i], own[j])
                i, j = i[met], j[met]
                ok = _near(sig, n, i, j, threshold)
                for a, b in zip(ids[i[ok]].tolist(), ids[j[ok]].tolist(), strict=True):
                    pair = (0, min(a, b), max(a, b))
                    if pair not in seen:
                        if len(seen) > 100_000:
                            seen.clear()
                        seen.add(pair)
                        out.append(pair)
                return
            out.extend((1, int(ids[0]), x) for x in ids.tolist())
            if part.column("salt")[0].as_py():
                out.append((2, part.column("key")[0].as_py(), int(ids[0])))

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(3)], ["kind", "a", "b"])
            out.clear()
            return made

        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            key, salt = held.column("key").to_numpy(), held.column("salt").to_numpy()
            bounds = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1).tolist()]
            for x, y in itertools.pairwise(bounds):
                if y - x > 1 or salt[x]:
                    run(held.slice(x, y - x))
            held = held.slice(bounds[-1])
            if len(out) > 10_000:
                yield batch_of()
        if held is not None and (len(held) > 1 or (len(held) and held.column("salt")[0].as_py())):
            run(held)
        yield batch_of()

    return runs.mapInArrow(pairs, "kind long, a long, b long").distinct()


def _settled(texts: DataFrame, n: int, threshold: float, trees: int, depth: int, prefix: int) -> DataFrame:
    """Step 5: rows ``(a, b, n_links)`` of texts ``(group, i, j, mine, id, sig, text)``.

    ``a = b``: a text and its number of links found in this block; ``a < b``: a link that joins classes (with 0).
    Block ``(i, j)`` has the pairs between parts i and j, so each pair of a group is looked at in one block only.
    """

    def settle(key, table):
        ids, mine = table.column("id").to_numpy(), table.column("mine").to_numpy()
        apart = key[1].as_py() != key[2].as_py()
        g = len(ids)
        full = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(g, trees, depth)
        keys, sig = np.ascontiguousarray(_keys(full, prefix).T), _short(full)
        sets = [shingles(t, n) for t in table.column("text").to_pylist()]
        size = np.array([len(s) for s in sets])
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        start = np.cumsum(size) - size
        member = np.zeros(len(flat), dtype=np.uint8)  # the shingles of one text
        label, n_links = np.arange(g), np.zeros(g, dtype=np.int64)
        joins = []
        for i in range(g - 1):
            ok = (keys[:, i + 1 :] == keys[:, i : i + 1]).any(axis=0) & (ids[i + 1 :] != ids[i])
            if apart:
                ok &= mine[i + 1 :] != mine[i]
            rest = i + 1 + np.flatnonzero(ok)
            rest = rest[_near(sig, size, np.full(len(rest), i), rest, threshold)]
            own = flat[start[i] : start[i] + size[i]]
            member[own] = 1
            for at in range(0, len(rest), 512):
                some = rest[at : at + 512]
                first = np.cumsum(size[some]) - size[some]
                places = np.repeat(start[some] - first, size[some]) + np.arange(size[some].sum())
                both = np.add.reduceat(member[flat[places]], first, dtype=np.int64)
                linked = some[both / (size[i] + size[some] - both) >= threshold]
                n_links[linked] += 1
                n_links[i] += len(linked)
                for j in linked[label[linked] != label[i]].tolist():
                    if label[j] != label[i]:
                        joins.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                        label[label == label[j]] = label[i]
            member[own] = 0
        some = np.flatnonzero(n_links)
        a = np.concatenate([ids[some], np.array([x[0] for x in joins], np.int64)])
        b = np.concatenate([ids[some], np.array([x[1] for x in joins], np.int64)])
        return pa.table({"a": pa.array(a), "b": pa.array(b), "n_links": pa.array(np.concatenate([n_links[some], np.zeros(len(joins), np.int64)]))})

    return texts.groupBy("group", "i", "j").applyInArrow(settle, "a long, b long, n_links long")


def _texts_of(docs: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts ``(id, text)`` of some members by number; what finds them is broadcast only if they are few enough."""
    nodes = nodes.distinct()
    few = nodes.count() <= BROADCAST_IDS
    found = reps.select(F.col("node").alias("id"), F.col("rep").alias("doc"), "copy").join(F.broadcast(nodes) if few else nodes, "id", "left_semi")
    own = docs.withColumnRenamed("id", "doc").join(F.broadcast(found) if few else found, ["doc", "copy"])
    return own.groupBy("id").agg(F.max("text").alias("text"))


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, stage: Stage, n: int, threshold: float) -> DataFrame:
    """The pairs whose exact similarity reaches the threshold, with it."""
    texts = stage.put("texts", _texts_of(docs, reps, pairs.select(F.explode(F.array("a", "b")).alias("id"))))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sims = []
                for a, ta, tb in zip(part.column("a").to_pylist(), part.column("ta").to_pylist(), part.column("tb").to_pylist(), strict=True):
                    if a != last:
                        last, own = a, shingles(ta, n)
                    other = shingles(tb, n)
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    sims.append(both / (len(own) + len(other) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(sims, pa.float64())], ["a", "b", "jaccard"])

    one = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    two = one.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    return two.mapInArrow(verify, "a long, b long, jaccard double").filter(F.col("jaccard") >= threshold)


def components(edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """Rows ``(id, cls)`` for every id in ``edges (a, b)``: the smallest id of its connected class."""
    edges = stage.put(f"{name}-0", edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for step in range(1, ROUNDS + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.unionByName(edges.join(low, "u").select("u", F.least("m", "u").alias("v"))).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        after = stage.put(f"{name}-{step}", small)
        same = after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty()
        stage.drop(f"{name}-{step - 1}") if not same else None
        edges = after
        if same:
            break
    else:
        raise RuntimeError(f"connected classes were not settled after {ROUNDS} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("cls")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("cls")).distinct())


def near_duplicates(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, trees: int = 24, depth: int = 8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, class_id, rep_id, n_links)``, one for each id of ``docs``."""
    spark = docs.sparkSession
    stage = Stage(spark, "forest")
    integral(docs, id_col)
    prefix = shortest_prefix(trees, depth, threshold, recall)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("id").isNotNull())
    slim = slim.withColumn("copy", F.xxhash64("text"))  # which of an id's texts it is
    signed = stage.put("signed", _signed(slim, n, trees, depth))
    reps = signed.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct("id", "copy")).alias("own"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = stage.put("reps", reps.select("key", F.col("own.id").alias("rep"), F.col("own.copy").alias("copy"), "n", "sig", F.monotonically_increasing_id().alias("node")))
    alone = reps.select(F.col("node").alias("id"), "n", "sig")

    # Runs that hold far more than their share are salted: few, since each holds over HOT_RUN rows.
    hot = None
    if reps.count() > HOT_RUN:
        often = stage.put("hot", _key_counts(alone, trees, depth, prefix).groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT_RUN))
        hot = None if often.isEmpty() else often
    pairs = stage.put("pairs", _candidates(_runs(alone, trees, depth, prefix, threshold, recall, hot, 64), prefix, threshold))
    with arrow_rows(spark, 64):  # rows of two whole texts
        links = stage.put("links", _verified(pairs.filter("kind = 0"), slim, reps, stage, n, threshold))
    stage.drop("texts")
    edges, counted = links.select("a", "b"), links.select("a", "b")

    # Step 5: texts of large runs, each once, with all texts that they share such runs with.
    parts = pairs.filter("kind = 2").withColumn("c", F.min("b").over(Window.partitionBy("a")))
    large = pairs.filter("kind = 1").select("a", "b").unionByName(parts.select("b", F.col("c").alias("a")))
    inside = None
    if not large.isEmpty():
        groups = stage.put("group-of", components(large, stage, "groups").withColumnRenamed("cls", "group"))
        held = groups.join(alone, "id")
        counts = held.groupBy("group").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
        held = stage.put("held", held.join(counts, "group").drop("n"))
        own = _texts_of(slim, reps, held.select("id"))
        blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
        mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
        each = held.join(own, "id").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        each = each.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
        more = stage.put("more-links", _settled(each.select("group", "i", "j", "mine", "id", "sig", "text"), n, threshold, trees, depth, prefix))
        edges = edges.unionByName(more.filter("a < b").select("a", "b"))
        stage.drop("held")
        # Pairs inside a group are counted in its blocks, those of their small runs as well.
        counted = counted.join(groups.select(F.col("id").alias("a"), F.col("group").alias("ga")), "a", "left").join(groups.select(F.col("id").alias("b"), F.col("group").alias("gb")), "b", "left")
        counted = counted.filter("ga is null or gb is null or ga <> gb").select("a", "b")
        inside = more.filter("a = b").select(F.col("a").alias("id"), "n_links")
    # the different sets of one id belong together
    twice = signed.filter(F.col("key").isNotNull()).groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("z")).filter("a <> z").select("id")
    twice = stage.put("twice", signed.join(twice, "id", "left_semi").select("id", "key").distinct().join(reps.select("key", "node"), "key").select("id", "node"))
    if not twice.isEmpty():
        edges = edges.unionByName(twice.join(twice.groupBy("id").agg(F.min("node").alias("a")), "id").filter("node <> a").select("a", F.col("node").alias("b")))
    labels = stage.put("labels", components(edges, stage, "cc"))

    degree = counted.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    if inside is not None:
        degree = degree.unionByName(inside).groupBy("id").agg(F.sum("n_links").alias("n_links"))
    classed = labels.select(F.col("id").alias("node"), "cls").join(reps.select("node", "rep"), "node")
    named = classed.join(classed.groupBy("cls").agg(F.min("rep").alias("class")), "cls").select("node", "class")
    found = reps.select("key", "node", F.col("rep").alias("rep_id")).join(named, "node", "left").join(degree.withColumnRenamed("id", "node"), "node", "left").drop("node")
    out = signed.select("id", "key").distinct().join(found, "key", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("class", "rep_id", "id").alias("class_id"), F.coalesce("rep_id", "id").alias("rep_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = out.groupBy(id_col).agg(F.min("class_id").alias("class_id"), F.min("rep_id").alias("rep_id"), F.sum("n_links").alias("n_links"))
    out = Stage(spark, "forest-result").put("result", out)
    stage.drop()  # signatures are most of it
    return out

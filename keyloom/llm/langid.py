"""Language identification by nearest centroid over TF-IDF vectors of character n-grams.

Fitting. A bounded sample of labelled rows (``per_lang`` texts of each language, ``max_sample`` in all, chosen
by a hash of the id) is turned into n-gram counts on the executors; the driver learns document frequencies,
keeps the ``features`` most frequent n-gram buckets, and clusters the normalised TF-IDF vectors of each
language into ``clusters`` spherical centroids (k-means with farthest-first starts, no randomness).

Prediction. Each whole text gets its own normalised TF-IDF vector, which is compared with all centroids by
cosine. The nearest one names the language; the score is that cosine. A text is *rejected* when its cosine
distance to the nearest centroid exceeds the limit for its language and length. Limits come from cross-fitting:
each sample text is measured against centroids of the other folds, and of texts about as long the ``QUANTILE``
farthest (of few texts the farthest, with an allowance that shrinks with their number) is still accepted. Lengths
with too few texts of a language take the limit of all languages, and if those are too few, nearly no limit.

N-grams are those of 1 to 3 code points of the lower-case text with runs of characters other than letters
as one blank, hashed into ``BUCKETS``. Very long texts are counted in chunks that overlap, so memory is
bounded and the counts are those of the whole text.

Defined results: a null text, or one without a letter (a code point of a category L*), is ``und`` with score 0 and rejected; if nothing can
be learned (no labelled row) all texts are ``und``; rows that repeat get equal predictions; ties go to the
first language in sorted order.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
CHUNK = 1 << 18
FOLDS = 5
QUANTILE = 0.999
ENOUGH = 10
LENGTHS = 40
MODEL_BYTES = 512 << 20


_OTHER = re.compile(r"[\W\d_]+")


@functools.cache
def _numbers() -> re.Pattern:
    """What ``\\w`` takes beside letters (general categories L*) and decimal digits: fractions, numerals and such."""
    return re.compile("[" + "".join(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]+")


#: For texts within the first 256 code points: letters stay, all else becomes a blank.
_LATIN = bytes(c if chr(c).isalpha() else 0x20 for c in range(256))


def _letters(text: str) -> np.ndarray:
    """The code points of the lower-case text, with runs of other characters than letters as one blank and none at the ends."""
    low = text.lower()
    try:
        return np.frombuffer(b" ".join(low.encode("latin-1").translate(_LATIN).split()), dtype=np.uint8)
    except UnicodeEncodeError:
        clean = _OTHER.sub(" ", _numbers().sub(" ", low)).strip()
        return np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed 1- to 3-grams of a whole text; None if it has no letter."""
    clean = _letters(text or "")
    if not len(clean):
        return None
    clean = np.concatenate([[0x20], clean, [0x20]])
    out = None
    for at in range(0, len(clean), CHUNK):
        x = clean[at : at + CHUNK + 2].astype(np.uint32)
        own = min(CHUNK, len(clean) - at)
        grams = [x[:own] * np.uint32(0x9E3779B1)]
        for n in (2, 3):
            if len(x) >= n:
                prev = grams[-1][: len(x) - n + 1]
                nxt = x[n - 1 :][: len(prev)]
                grams.append((prev ^ (prev >> np.uint32(15))) * np.uint32(0x85EBCA77) + nxt * np.uint32(0xC2B2AE3D))
        found = np.bincount((np.concatenate(grams) >> np.uint32(17)).astype(np.int64), minlength=BUCKETS)
        out = found if out is None else out + found
    return out


@dataclass
class Model:
    """``centroids``: unit rows; ``owner``: the language of each; ``limits``: largest accepted
    distance by language and length (as a power of two)."""

    langs: list[str]
    keep: np.ndarray
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    limits: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return self._unit(counts[:, self.keep])

    def _unit(self, kept: np.ndarray) -> np.ndarray:
        x = np.log1p(kept).astype(np.float32) * self.idf
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(norm > 0, norm, 1)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine and rejection for each row of counts."""
        return self.nearest(counts[:, self.keep], counts.sum(axis=1))

    def nearest(self, kept: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same from the counts of the kept buckets and the number of all n-grams of each text."""
        cos = self._unit(kept) @ self.centroids.T
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(cos)), best].astype(np.float64), 0.0, 1.0)
        return self.owner[best], score, 1.0 - score > self.limits[self.owner[best], _length(grams)]


def _length(grams: np.ndarray) -> np.ndarray:
    """The power of two of a text's letters and blanks, from its number of n-grams."""
    return np.minimum(np.log2(np.maximum(grams / 3, 1)).astype(np.int64), LENGTHS - 1)


def _crossed(x: np.ndarray, clusters: int) -> np.ndarray:
    """The distance of each row to the nearest of the centroids learned without its fold."""
    fold = np.arange(len(x)) % FOLDS
    out = np.zeros(len(x))
    for k in range(min(FOLDS, len(x))):
        out[fold == k] = 1.0 - (x[fold == k] @ _clusters(x[fold != k], clusters, 6).T).max(axis=1)
    return out


def _limits(length: np.ndarray, distance: np.ndarray, default: np.ndarray) -> np.ndarray:
    """The largest accepted distance at each length, from texts of that length and the next shorter ones.

    Shorter texts are farther, so limits never rise with the length.
    """
    out = default.copy()
    for b in range(LENGTHS):
        low = max(b - 1, 0)
        while low > 0 and ((length >= low) & (length <= b)).sum() < ENOUGH:
            low -= 1
        own = np.sort(distance[(length >= low) & (length <= b)])
        n = len(own)
        if n >= ENOUGH:
            far = own[min(n, int(np.ceil((n + 1) * QUANTILE))) - 1]
            out[b] = min(0.98, far + (1.0 - far) * 0.5 / np.sqrt(n))
    return np.maximum.accumulate(out[::-1])[::-1]


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows: farthest-first starts from the row nearest the mean."""
    mean = x.mean(axis=0)
    picked = [int((x @ mean).argmax())]
    near = x @ x[picked[0]]
    for _ in range(1, min(k, len(x))):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    c = x[picked]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 800, max_sample: int = 8000, clusters: int = 4, features: int = 4096) -> Model | None:
    """Learn from the rows of ``docs`` with a label. About ``max_sample`` texts reach the driver, or 21 of each label, if that is more.

    All labels are learned, whatever their number: the more there are, the fewer texts of each are drawn, one at least. A model
    whose centroids would take more than ``MODEL_BYTES`` is refused.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    tally = rows.groupBy("lang").agg(F.count("*").alias("n"))
    most = MODEL_BYTES // (4 * features)
    counts = {r["lang"]: r["n"] for r in tally.limit(most + 1).collect()}
    if len(counts) > most:
        raise ValueError(f"more than {most} labels: their centroids would not fit")
    if not counts:
        return None
    each = max(1, min(per_lang, max_sample // len(counts)))
    span = 1 << 31
    drawn = 1.3 * max(each, 16)  # so that no label is left without a text by chance
    langs = sorted(counts)
    # From an Arrow table, which the JVM reads; a list of rows starts Python workers of its own.
    limit = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array(langs, pa.string()), "limit": pa.array([int(span * min(1.0, drawn / counts[x])) + 1 for x in langs], pa.int64())}))
    draw = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(span))
    sample = rows.withColumn("draw", draw).join(F.broadcast(limit), "lang").filter(F.col("draw") < F.col("limit"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                b = batch.slice(start, 128)
                at, val = [], []
                for t in b.column("text").to_pylist():
                    c = ngram_counts(t)  # all buckets: one text's at a time
                    own = np.zeros(0, np.int64) if c is None else np.flatnonzero(c)
                    at.append(own.astype("<u2").tobytes())
                    val.append(b"" if c is None else c[own].astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("draw"), pa.array(at, pa.binary()), pa.array(val, pa.binary())], ["lang", "draw", "at", "n"])

    got: dict[str, list] = {}
    for r in sample.select("text", "lang", "draw").mapInArrow(count, "lang string, draw long, at binary, n binary").toLocalIterator():
        own = got.setdefault(r["lang"], [])
        own.append((r["draw"], bytes(r["at"]), bytes(r["n"])))
        if len(own) > 2 * each:
            own.sort()
            del own[each:]
    langs, xs = [], []
    for lang in sorted(got):
        own = sorted(x for x in got[lang] if x[1])[:each]
        if own:
            langs.append(lang)
            xs.append(own)
    if not langs:
        return None
    df = np.zeros(BUCKETS, dtype=np.int64)
    total = sum(map(len, xs))
    for own in xs:
        for _, at, _ in own:
            df[np.frombuffer(at, "<u2")] += 1
    keep = np.sort(np.argsort(-df, kind="stable")[:features])
    idf = (np.log((1 + total) / (1 + df[keep])) + 1.0).astype(np.float32)
    model = Model(langs, keep, idf, np.zeros((0, len(keep)), np.float32), np.zeros(0, np.int64), np.ones((len(langs), LENGTHS)))
    centroids, owner, lengths, distances = [], [], [], []
    for k, own in enumerate(xs):
        dense = np.zeros((len(own), BUCKETS), dtype=np.int32)
        for i, (_, at, n) in enumerate(own):
            dense[i, np.frombuffer(at, "<u2")] = np.frombuffer(n, "<u4")
        x = model.vectors(dense)
        c = _clusters(x, clusters)
        centroids.append(c)
        owner += [k] * len(c)
        if len(x) > 1:
            lengths.append(_length(dense.sum(axis=1)))
            distances.append(_crossed(x, clusters))
        else:  # of a single text nothing can be held out
            lengths.append(np.zeros(0, np.int64))
            distances.append(np.zeros(0))
    anywhere = _limits(np.concatenate(lengths), np.concatenate(distances), np.full(LENGTHS, 0.98))
    model.limits = np.stack([_limits(n, d, anywhere) for n, d in zip(lengths, distances, strict=True)])
    model.centroids, model.owner = np.concatenate(centroids).astype(np.float32), np.array(owner)
    return model


def identify(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``lang_rejected``."""
    added = ("lang_pred", "score", "lang_rejected")
    fields = [f for f in docs.schema.fields if f.name not in added]
    where = [f.name for f in fields].index(text_col)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                known, kept, grams = [], [], []
                for i, t in enumerate(part.column(where).to_pylist()):
                    c = None if m is None else ngram_counts(t)
                    if c is not None:
                        known.append(i)
                        kept.append(c[m.keep])
                        grams.append(int(c.sum()))
                lang, score, out = ["und"] * part.num_rows, [0.0] * part.num_rows, [True] * part.num_rows
                if known:
                    for i, k, s, r in zip(known, *(x.tolist() for x in m.nearest(np.stack(kept), np.array(grams))), strict=True):
                        lang[i], score[i], out[i] = m.langs[k], s, r
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], [*part.schema.names, *added])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*(F.col(f"`{f.name}`") for f in fields)).mapInArrow(predict, f"{shape}, lang_pred string, score double, lang_rejected boolean")


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text."""
    return F.crc32(F.col(id_col).cast("string"))

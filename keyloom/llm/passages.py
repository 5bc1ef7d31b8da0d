"""Fuzzy passages shared by documents, by collinear chaining of word k-mers.

1. Documents become chunks of word numbers. The hash of each ``K`` words in a row is a *seed*; none is left
   out, since passages with a fifth of their words changed have few runs of ``K`` words in common.
2. Each chunk sends its distinct seeds, with their first document, to partitions by hash. A seed found in two
   documents or more returns with its *hub*: the smallest (document, position) that holds it. A seed found in
   a third of all documents costs one entry for each chunk, and joining every document with the hub alone
   makes as many matches as there are occurrences, never a pair of all.
3. In its chunk, each document's matches with one hub are chained: positions must rise in both, each match
   gains ``K`` and pays ``GAP`` for each word skipped; the best predecessor is found in a Fenwick tree over
   positions. Chains are cut where more than ``MAX_GAP`` words are skipped.
4. The hub's words around each chain are fetched once for each region and joined to the chains, which are
   then aligned: matches between anchors by edit distance, ends extended while they agree, and those of a short
   alignment as far as it keeps ``similarity``.
5. Alignments of at least ``min_words`` words and ``similarity`` are passages.
6. A seed's hub may be a document that holds only a fragment of the passage. So each document's runs of seeds that are
   found elsewhere, long enough for a passage but with some seeds that neither lie in a passage just found, or in a chain
   which is one by its anchors alone, nor in such a run of which the document is itself the hub, stay *open*. Open runs go through steps 2 to
   5 again by themselves, with fresh hubs among them (holders of short fragments have no open run) and with wider seeds:
   pairs of ``K`` words whose beginnings are ``GAPS`` words apart, which fragments shorter than that don't hold and
   chance seldom repeats. This goes on until no run is open or a round finds no new pair of documents.
7. Chains of several documents with one hub are compared with each other, whether or not they are similar enough to
   the hub (``_sibling_links``). Chains with the same words over the same words of the hub are one *variant*; variants
   are compared pair by pair inside tasks, in blocks of up to ``BLOCK``.

Result, one row for each passage: ``doc_id, start, n_words`` and ``other_id, other_start, other_words`` (word
positions), ``similarity``: matched words by the longer side, and ``n_links``. ``other_id`` is the smaller id. A document
whose passages were first seen in several others has a row for each. Every link of two variants is a row where a hub
has up to ``LISTED`` of them, but for what a copy of the hub's words shares with another that agrees with the hub. Beyond, rows are the links with the hub and those that join a variant to others
without it, and ``n_links`` counts the rest: with how many passages of this hub's the one of ``doc_id`` was found to agree, the
hub's own and copies included. Copies of a variant have rows with one another's first holder or the hub alone.

Defined results: null or short texts have no passages; a null id is dropped; rows that repeat an id are one
document to itself and never match each other; an empty table gives no rows; ids that are no integers raise. A document that
fits a chunk is never cut; a longer one has parts that share ``OVERLAP`` words, so that a passage across a cut is
whole in one of them (one longer than that has a row in each part).
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as chunking
from .chunks import chunked, mix, order_of, pack, unpack
from .common import Stage, integral, shuffle_parts

K = 5
GAP = 0.1
MAX_GAP = 24
GRID = 64
MIN_ANCHORS = 3
REPEAT = 16
FEW_DIAGONALS = 12
OVERLAP = 1024
#: Bytes of words, with A-Z in lower case; all others become blanks.
_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_SIGN = np.uint64(1 << 63)
GAPS = (20, 45)
DENSE = 0.5
CELL = 16
RUN_WORDS = 1 << 17  # words of open runs to a chunk
PAD = 16  # words beside an open run that go with it
BLOCK = 512  # variants of one hub that are compared at once
LISTED = 32  # variants of one hub of which each link is a row
_PASSAGE = "doc_id long, start long, n_words long, other_id long, other_start long, other_words long, similarity double"
_CHAIN = "doc long, other long, hub_chunk long, lo2 long, hi2 long, x array<long>, y array<long>, lo long, words binary"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split()


def seeds(hashes: np.ndarray, first: np.ndarray, gaps: tuple[int, ...] = (0,)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and gaps of the seeds of a token sequence; none crosses a segment (``first``: starts).

    A seed is ``K`` words in a row, together with the ``K`` words that begin ``gap`` words later if that is not 0.
    """
    m = len(hashes) - K + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(m, dtype=np.uint64)
    for k in range(K):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[k : k + m]
    h = mix(h)
    ends = np.append(first[1:], len(hashes)) - 1  # the end token of each segment takes no part
    end = np.repeat(ends, np.diff(np.append(first, len(hashes))))[:m]
    found = []
    for gap in gaps:
        at = np.flatnonzero(np.arange(m) + gap + K <= end)
        own = h[at] if not gap else mix((h[at] ^ (h[at] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[at + gap] + np.uint64(gap))
        found.append((at, _numbered(at, own), np.full(len(at), gap)))
    at, own, gap = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(gaps) > 1:
        by = np.argsort(at, kind="stable")
        at, own, gap = at[by], own[by], gap[by]
    return at, own, gap


def _by_hash(h: np.ndarray) -> np.ndarray:
    """The stable order of hashes. Their high bits are sorted together with their places, which is much faster than ``argsort``."""
    low = np.uint64((1 << len(h).bit_length()) - 1)
    by = (np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)
    own = h[by]
    return by if (own[1:] >= own[:-1]).all() else np.argsort(h, kind="stable")


def _numbered(at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Seeds that come again within ``REPEAT`` words get their number in that run into the hash, so that text
    which repeats itself ("a a a a") still matches position by position."""
    if len(h) < 2:
        return h
    by = _by_hash(h)
    again = np.concatenate(([False], (h[by][1:] == h[by][:-1]) & (np.diff(at[by]) <= REPEAT)))
    place = np.arange(len(h))
    ordinal = np.empty(len(h), dtype=np.uint64)
    ordinal[by] = (place - np.maximum.accumulate(np.where(again, 0, place))).astype(np.uint64)
    return np.where(ordinal > 0, mix(h + ordinal * np.uint64(0x9E3779B97F4A7C15)), h)


def _groups(group: np.ndarray, x: np.ndarray, y: np.ndarray, least: int, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The matches of each group in pieces that no chain leaves: steps of at most ``K + MAX_GAP`` words in both texts move the
    diagonal by no more than that. A passage that a text holds many times falls into as many pieces. Those of fewer matches than
    ``least``, or of fewer words than ``reach`` on both sides, are left out."""
    if not len(x):
        return
    far = K + MAX_GAP
    by = np.lexsort((x, x - y, group))
    group, x, y = group[by], x[by], y[by]
    piece = np.cumsum(np.concatenate(([True], (np.diff(group) != 0) | (np.diff(x - y) > far))))
    by = np.lexsort((y, x, piece))
    group, x, y = group[by], x[by], y[by]
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(piece) != 0) | (np.diff(x) > far))))
    ends = np.append(starts[1:], len(x))
    wide = np.maximum(x[ends - 1] - x[starts], np.maximum.reduceat(y, starts) - np.minimum.reduceat(y, starts)) + K
    for k in np.flatnonzero((ends - starts >= least) & (wide >= reach)).tolist():
        yield int(group[starts[k]]), x[starts[k] : ends[k]], y[starts[k] : ends[k]]


def chain(x: np.ndarray, y: np.ndarray, least: int = MIN_ANCHORS) -> list[tuple[list[int], list[int]]]:
    """Best chains of matches ``(x, y)``, as lists of positions; each match is used once."""
    return [c for _, a, b in _groups(np.zeros(len(x), np.int64), x, y, least, 0) for c in _chained(a, b, least)]


def _chained(x: np.ndarray, y: np.ndarray, least: int) -> list[tuple[list[int], list[int]]]:
    """Chains of one group, whose matches are in order of x and then y."""
    diagonal = x - y
    if (diagonal == diagonal[0]).all():
        keep = np.concatenate(([True], x[1:] > x[:-1]))
        return _cut(x[keep].tolist(), y[keep].tolist(), least)
    few = np.unique(diagonal)
    if len(few) <= FEW_DIAGONALS:
        return _chained_few(x.tolist(), y.tolist(), np.searchsorted(few, diagonal).tolist(), few.tolist(), least)
    xs, ys = x.tolist(), y.tolist()
    out: list[tuple[list[int], list[int]]] = []
    left = list(range(len(xs)))
    while len(left) >= least:
        places = sorted({ys[i] for i in left})
        size = len(places)
        tree: list[tuple[float, int]] = [(0.0, -1)] * (size + 1)  # prefix maximum of score + GAP * (x + y)
        score, back = {}, {}
        k = 0
        while k < len(left):
            same = [left[k]]
            while k + len(same) < len(left) and xs[left[k + len(same)]] == xs[left[k]]:
                same.append(left[k + len(same)])
            for i in same:
                best, at = (0.0, -1), bisect.bisect_left(places, ys[i])  # strictly smaller y
                while at > 0:
                    best = max(best, tree[at])
                    at -= at & -at
                gain = best[0] - GAP * (xs[i] + ys[i])
                score[i], back[i] = (K + gain, best[1]) if best[1] >= 0 and gain > 0 else (float(K), -1)
            for i in same:
                value, at = (score[i] + GAP * (xs[i] + ys[i]), i), bisect.bisect_left(places, ys[i]) + 1
                while at <= size:
                    tree[at] = max(tree[at], value)
                    at += at & -at
            k += len(same)
        end = max(left, key=lambda i: (score[i], -i))
        path = []
        while end >= 0:
            path.append(end)
            end = back[end]
        if len(path) < least:
            break
        path.reverse()
        out += _cut([xs[i] for i in path], [ys[i] for i in path], least)
        used = set(path)
        left = [i for i in left if i not in used]
    return out


def _chained_few(xs: list[int], ys: list[int], on: list[int], diagonals: list[int], least: int) -> list[tuple[list[int], list[int]]]:
    """The chains of ``_chained`` where matches lie on few diagonals (``on``: which): on one of them those before both positions
    are those before one, so the best of each diagonal so far takes the tree's place."""
    out: list[tuple[list[int], list[int]]] = []
    left = list(range(len(xs)))
    while len(left) >= least:
        places: list[list[int]] = [[] for _ in diagonals]
        tops: list[list[tuple[float, int]]] = [[] for _ in diagonals]  # best up to each place
        score, back = {}, {}
        k, n = 0, len(left)
        while k < n:
            x, at = xs[left[k]], k
            while k < n and xs[left[k]] == x:
                i, best = left[k], (0.0, -1)
                y = ys[i]
                for d, there, top in zip(diagonals, places, tops, strict=True):
                    if there:
                        m = len(there) if there[-1] < y + d else bisect.bisect_left(there, y + d)
                        if m and top[m - 1] > best:
                            best = top[m - 1]
                gain = best[0] - GAP * (x + y)
                score[i], back[i] = (K + gain, best[1]) if best[1] >= 0 and gain > 0 else (float(K), -1)
                k += 1
            for i in left[at:k]:
                top, value = tops[on[i]], (score[i] + GAP * (x + ys[i]), i)
                top.append(max(top[-1], value) if top else value)
                places[on[i]].append(x)
        end = max(left, key=lambda i: (score[i], -i))
        path = []
        while end >= 0:
            path.append(end)
            end = back[end]
        if len(path) < least:
            break
        path.reverse()
        out += _cut([xs[i] for i in path], [ys[i] for i in path], least)
        used = set(path)
        left = [i for i in left if i not in used]
    return out


def _cut(x: list[int], y: list[int], least: int) -> list[tuple[list[int], list[int]]]:
    """A chain in parts, cut where more than MAX_GAP words are skipped."""
    parts, at = [], 0
    for i in range(1, len(x) + 1):
        if i == len(x) or max(x[i] - x[i - 1], y[i] - y[i - 1]) > K + MAX_GAP:
            if i - at >= least:
                parts.append((x[at:i], y[at:i]))
            at = i
    return parts


def _by_part(chains: list[tuple[list[int], list[int]]], step: int, least: int) -> Iterator[tuple[list[int], list[int]]]:
    """Chains that no part of the hub holds whole, as pieces that one part holds; pieces overlap as parts do."""
    for x, y in chains:
        at = 0
        while at < len(y):
            part = max(0, y[at] - GRID) // GRID * GRID // step
            end = bisect.bisect_left(y, part * step + step + OVERLAP - K - GRID)
            if end - at >= least:
                yield x[at:end], y[at:end]
            if end == len(y):
                break
            at = max(at + 1, bisect.bisect_left(y, (part + 1) * step + 2 * GRID))


def _thinned(x: list[int], y: list[int]) -> tuple[list[int], list[int]]:
    """A chain without the anchors whose words lie in their neighbours on the same diagonal; it aligns alike."""
    keep = [0]
    for t in range(1, len(x) - 1):
        k = keep[-1]
        if not (x[t + 1] - x[k] <= K and x[t] - y[t] == x[k] - y[k] == x[t + 1] - y[t + 1]):
            keep.append(t)
    keep.append(len(x) - 1)
    return [x[k] for k in keep], [y[k] for k in keep]


def matched(a: np.ndarray, b: np.ndarray) -> int:
    """Words in common and in order: the longest common subsequence."""
    if len(a) == len(b):
        same = int((a == b).sum())
        if same >= len(a) - 1:
            return same
    row = [0] * (len(b) + 1)
    b_list = b.tolist()
    for x in a.tolist():
        prev = 0
        for j, z in enumerate(b_list, 1):
            keep = row[j]
            row[j] = prev + 1 if x == z else max(row[j], row[j - 1])
            prev = keep
    return row[-1]


def _extend(a: np.ndarray, b: np.ndarray, drop: int = 4) -> tuple[int, int]:
    """How far two sequences agree from their beginning, mismatches allowed: words and matches."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    gain = np.cumsum(np.where(same, 1, -2))
    best = np.maximum.accumulate(gain)
    stop = np.flatnonzero(best - gain > drop)
    limit = int(stop[0]) if len(stop) else n
    if not limit or gain[:limit].max() <= 0:
        return 0, 0
    at = int(gain[:limit].argmax()) + 1
    return at, int(same[:at].sum())


def align(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int]) -> tuple[int, int, int, int, int]:
    """Align ``a`` and ``b`` along anchors (positions of K equal words); spans in both and matched words."""
    count, ax, by = K, x[0] + K, y[0] + K
    for i, j in zip(x[1:], y[1:], strict=True):
        if i >= ax and j >= by:
            count += matched(a[ax:i], b[by:j]) + K
            ax, by = i + K, j + K
        else:  # overlapping anchors: what lies beyond the last one
            step = min(i + K - ax, j + K - by)
            if step > 0:
                count += step
            ax, by = max(ax, i + K), max(by, j + K)
    n, more = _extend(a[ax:], b[by:])
    ax, by, count = ax + n, by + n, count + more
    n, more = _extend(a[: x[0]][::-1], b[: y[0]][::-1])
    return x[0] - n, ax, y[0] - n, by, count + more


def stretched(a: np.ndarray, b: np.ndarray, span: tuple[int, int, int, int, int], similarity: float) -> tuple[int, int, int, int, int]:
    """An alignment as far as its ends can go, each to an equal word, while all of it keeps the similarity."""
    a0, a1, b0, b1, count = span
    more = []
    for own, other in ((a[:a0][::-1], b[:b0][::-1]), (a[a1:], b[b1:])):
        n = min(len(own), len(other), GRID)
        same = own[:n] == other[:n]
        at = np.flatnonzero(same)
        more.append((np.append(0, at + 1), np.arange(len(at) + 1)))
    (left, l_same), (right, r_same) = more
    wide = left[:, None] + right
    ok = count + l_same[:, None] + r_same >= similarity * (max(a1 - a0, b1 - b0) + wide)
    if not ok.any():
        return span
    i, j = np.unravel_index(np.where(ok, wide, -1).argmax(), wide.shape)
    return int(a0 - left[i]), int(a1 + right[j]), int(b0 - left[i]), int(b1 + right[j]), int(count + l_same[i] + r_same[j])


def _seed_table(chunks: DataFrame, parts: int, gaps: tuple[int, ...]) -> DataFrame:
    """For each chunk and partition: which of its seeds occur in several documents, and their hubs."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found, doc, pos, several, _ = _seeds_of(b, i, gaps)
                order, at = order_of(found, parts)
                used = [p for p in range(parts) if at[p + 1] > at[p]]
                data = []
                for p in used:
                    k = order[at[p] : at[p + 1]]
                    # 48 bits of the seeds, which are in order, as differences
                    data.append(pack(np.diff(found[k] >> np.uint64(16), prepend=np.uint64(0)), doc[k].view(np.uint64) ^ _SIGN, pos[k], several[k]))
                cols = [pa.array(used, pa.int64()), pa.array([b.column("chunk")[i].as_py()] * len(used), pa.int64()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "chunk", "data"])

    def hubs(key, table):
        steps, docs, places, many = zip(*(unpack(d) for d in table.column("data").to_pylist()), strict=True)
        all_seeds = [np.cumsum(x) for x in steps]
        chunk = np.repeat(table.column("chunk").to_numpy(), [len(x) for x in all_seeds])
        doc, pos, several = np.concatenate(docs), np.concatenate(places), np.concatenate(many)
        doc = doc.view(np.uint64)  # still with the sign turned: unsigned order is the order of ids
        seed = np.concatenate(all_seeds)
        by = _by_hash(seed.view(np.uint64) << np.uint64(16))
        same = seed[by][1:] == seed[by][:-1]
        shared = np.flatnonzero(np.append(same, False) | np.append(False, same))
        own = by[shared]
        by[shared] = own[np.lexsort((-chunk[own], pos[own], doc[own], seed[own]))]  # where parts overlap the later one, whose number follows from the position
        starts = np.flatnonzero(np.concatenate(([True], seed[by][1:] != seed[by][:-1])))
        group = np.empty(len(seed), dtype=np.int64)
        sizes = np.diff(np.append(starts, len(seed)))
        group[by] = np.repeat(np.arange(len(starts)), sizes)
        last = by[starts + sizes - 1]
        repeated = (doc[by[starts]] != doc[last]) | (np.maximum.reduceat(several[by], starts) > 0)
        ends = np.cumsum([len(x) for x in all_seeds])
        rows = []
        for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            at = np.flatnonzero(repeated[group[a:z]])
            hub = by[starts[group[a:z][at]]]
            rows.append(pack(at, doc[hub], pos[hub], chunk[hub]))
        return pa.table({"part": pa.array([key[0].as_py()] * len(rows), pa.int64()), "chunk": table.column("chunk"), "data": pa.array(rows, pa.binary())})

    return chunks.select("chunk", "ids", "meta", "tokens", "words").mapInArrow(send, "part long, chunk long, data binary").groupBy("part").applyInArrow(hubs, "part long, chunk long, data binary")


def _seeds_of(b: pa.RecordBatch, i: int, gaps: tuple[int, ...]) -> tuple:
    """Of a chunk: its distinct seeds, the smallest document and position of each, whether it has several
    documents there, and all occurrences ``(seed number, document, segment, position, gap)`` with the chunk's arrays."""
    hashes = np.frombuffer(b.column("words")[i].as_py(), "<u8")
    _, _, _, n, place = unpack(b.column("meta")[i].as_py())
    tokens = unpack(b.column("tokens")[i].as_py())[0]
    first = np.cumsum(n) - n
    at, h, gap = seeds(hashes[tokens], first, gaps)
    seg = np.searchsorted(first, at, side="right") - 1
    doc = b.column("ids")[i].values.to_numpy()[seg]
    pos = at - first[seg] + place[seg]
    ids = b.column("ids")[i].values.to_numpy()
    if len(np.unique(ids)) == len(ids):  # segments are in order of their documents, then
        rank = np.empty(len(ids), dtype=np.uint16 if len(ids) < 1 << 16 else np.int64)
        rank[np.argsort(ids)] = np.arange(len(ids))
        near = np.argsort(rank[seg], kind="stable")
        by = near[_by_hash(h[near])]
    else:
        by = np.lexsort((pos, doc, h))
    starts = np.flatnonzero(np.concatenate(([True], h[by][1:] != h[by][:-1]))) if len(h) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(h)))
    number = np.empty(len(h), dtype=np.int64)
    number[by] = np.repeat(np.arange(len(starts)), sizes)
    head, tail = by[starts], by[starts + sizes - 1]
    return h[head], doc[head], pos[head], (doc[head] != doc[tail]).astype(np.int64), (number, doc, seg, pos, gap, hashes, tokens, first, n, place)


def _solid(x: np.ndarray, similarity: float) -> bool:
    """Whether anchors alone, at positions ``x``, make what lies between them similar enough."""
    return K + np.minimum(np.diff(x), K).sum() >= similarity * (x[-1] + K - x[0])


def _open(p: np.ndarray, own: np.ndarray, covered: list[tuple[int, int]], min_words: int, similarity: float) -> tuple[int, int] | None:
    """The part still open of one run of ``K`` words found elsewhere, at positions ``p``; ``own``: their hub is this
    document. Nothing is open where no window of ``min_words`` has ``DENSE`` of its words in such seeds."""
    done = np.zeros(len(p), dtype=bool)
    for a, z in covered:
        done |= (p >= a) & (p + K <= z)
    mine = p[own]
    for part in np.split(mine, np.flatnonzero(np.diff(mine) > K + MAX_GAP) + 1):
        if len(part) and part[-1] + K - part[0] >= min_words and _solid(part, similarity):
            done |= (p >= part[0]) & (p <= part[-1])
    left = p[~done]
    if not len(left) or len(np.unique(left)) <= K:
        return None
    lo, hi = max(p[0], left[0] - min_words), min(p[-1], left[-1] + min_words) + K
    p = np.unique(p[(p >= lo) & (p < hi)])
    held = np.concatenate(([0], np.cumsum(np.minimum(np.diff(p), K))))
    last = np.searchsorted(p, p + min_words - K, side="right") - 1
    return (int(lo), int(hi)) if hi - lo >= min_words - 2 * K and (held[last] - held + K).max() >= DENSE * min_words else None


def _chains(joined: DataFrame, parts: int, min_words: int, similarity: float, gaps: tuple[int, ...], step: int) -> DataFrame:
    """Chains ``(doc, other, hub_chunk, lo2, hi2, x, y, lo, words)``: anchors, and the document's words from lo; and, where
    ``other`` is null, open runs ``(doc, x, lo, words)``: where a run begins and ends, and whole hashes from lo. ``step``: words between the beginnings of two
    parts of a long document, 0 if there are no parts."""
    far = step or 1 << 62

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found, _, _, _, (number, doc, seg, pos, gap, hashes, tokens, first, n, place) = _seeds_of(b, i, gaps)
                order, at = order_of(found, parts)
                hub_doc, hub_pos = np.zeros(len(found), np.int64), np.full(len(found), -1, np.int64)
                hub_chunk = np.zeros(len(found), np.int64)
                for back in b.column("back")[i].as_py():
                    mine = order[at[back["part"]] : at[back["part"] + 1]]
                    k, d, p, c = unpack(back["data"])
                    hub_doc[mine[k]] = (d.view(np.uint64) ^ _SIGN).view(np.int64)
                    hub_pos[mine[k]], hub_chunk[mine[k]] = p, c
                elsewhere = hub_pos[number] >= 0
                is_own = hub_doc[number] == doc
                ok = np.flatnonzero(elsewhere & ~is_own)
                covered: dict[int, list[tuple[int, int]]] = {}
                rows: list[tuple] = []
                # matches of one document part with one hub, together
                hd, sg = hub_doc[number[ok]], seg[ok]
                hc = hub_chunk[number[ok]] - hub_pos[number[ok]] // far  # the chunk where the hub begins
                by = np.lexsort((pos[ok], hc, hd, sg))
                ok, hd, hc, sg = ok[by], hd[by], hc[by], sg[by]
                cut = np.flatnonzero(np.concatenate(([True], (hd[1:] != hd[:-1]) | (hc[1:] != hc[:-1]) | (sg[1:] != sg[:-1])))) if len(ok) else np.empty(0, np.int64)
                bounds = np.append(cut, len(ok))
                x_all, y_all, g_all = pos[ok], hub_pos[number[ok]], gap[ok]
                size = np.diff(bounds)
                span = x_all[bounds[1:] - 1] + g_all[bounds[1:] - 1] - x_all[cut]
                least = MIN_ANCHORS if len(gaps) == 1 else 2  # a pair of seeds is two anchors
                group = np.repeat(np.arange(len(cut)), size)
                use = ((size * len(gaps) >= least) & (span + K + 2 * GRID >= min_words))[group]
                wide = use & (g_all > 0)
                x_use, y_use = (np.concatenate((v[use], (v + g_all)[wide])) for v in (x_all, y_all))
                for g, x_own, y_own in _groups(np.concatenate((group[use], group[wide])), x_use, y_use, least, min_words // 3):
                    a = bounds[g]
                    s = int(sg[a])
                    for x, y in _by_part(_chained(x_own, y_own, least), far, least):
                        if max(x[-1] - x[0], y[-1] - y[0]) + K < min_words // 3:
                            continue
                        if min(x[-1] - x[0], y[-1] - y[0]) + K >= min_words and _solid(np.array(x), similarity) and _solid(np.array(y), similarity):
                            covered.setdefault(s, []).append((x[0], x[-1] + K))
                        from_, to = x[0] - int(place[s]), x[-1] + K - int(place[s])
                        if step and ((n[s] > step and from_ >= step + GRID) or (place[s] and from_ < GRID and to + GRID < OVERLAP)):
                            continue  # whole in the next or in the last part
                        lo = max(x[0] - GRID, int(place[s]))
                        hi = min(x[-1] + K + GRID, int(place[s] + n[s]) - 1)
                        start = int(first[s] - place[s])
                        own = (hashes[tokens[start + lo : start + hi]] >> np.uint64(32)).astype("<u4")
                        lo2 = max(0, y[0] - GRID) // GRID * GRID
                        x, y = _thinned(x, y)
                        rows.append((int(doc[ok[a]]), int(hd[a]), int(hc[a]) + lo2 // far, lo2, -(-(y[-1] + K + GRID) // GRID) * GRID, x, y, lo, own.tobytes()))
                seen = np.flatnonzero(elsewhere)
                edges = np.flatnonzero((np.diff(seg[seen]) != 0) | (np.diff(pos[seen]) > K + MAX_GAP)) + 1 if len(seen) else []
                starts, ends = np.append(0, edges).astype(np.int64), np.append(edges, len(seen)).astype(np.int64)
                long = (pos[seen[ends - 1]] + gap[seen[ends - 1]] + K - pos[seen[starts]] >= min_words - 2 * K) if len(seen) else []
                if len(seen) and len(gaps) == 1:  # no window of such a run is dense enough, as in _open
                    at = pos[seen] + seg[seen].astype(np.int64) * (1 << 40)
                    held = np.concatenate(([0], np.cumsum(np.minimum(np.diff(at), K))))
                    last = np.searchsorted(at, at + min_words - K, side="right") - 1
                    long &= np.maximum.reduceat(held[last] - held + K, starts) >= DENSE * min_words
                for r in np.flatnonzero(long).tolist():
                    k = seen[starts[r] : ends[r]]
                    s = int(seg[k[0]])
                    at_all, own_all = pos[k], is_own[k]
                    if len(gaps) > 1:  # both words of a pair
                        at_all, by = np.concatenate((at_all, at_all + gap[k])), np.tile(np.arange(len(k)), 2)
                        order_all = np.argsort(at_all, kind="stable")
                        at_all, own_all = at_all[order_all], own_all[by[order_all]]
                    part = _open(at_all, own_all, covered.get(s, []), min_words, similarity)
                    if part:
                        lo, hi = max(part[0] - PAD, int(place[s])), min(part[1] + PAD, int(place[s] + n[s]) - 1)
                        start = int(first[s] - place[s])
                        rows.append((int(doc[k[0]]), None, None, None, None, list(part), None, lo, hashes[tokens[start + lo : start + hi]].tobytes()))
                names = ["doc", "other", "hub_chunk", "lo2", "hi2", "x", "y", "lo", "words"]
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2 + [pa.int64(), pa.binary()]
                for k in range(0, len(rows), 2000):
                    cols = list(zip(*rows[k : k + 2000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names)

    return joined.mapInArrow(find, _CHAIN)


def _rechunked(runs: DataFrame, parts: int) -> DataFrame:
    """Open runs ``(doc, lo, words)`` as segments of new chunks, in about ``parts`` of them as long as those are not full."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        base, number = TaskContext.get().partitionId() << 32, 0
        end = np.array([xxhash.xxh3_64_intdigest(chunking.END)], dtype="<u8")
        held: list[tuple[int, int, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            n = np.array([len(h) + 1 for _, _, h in held])
            words, tokens = np.unique(np.concatenate([x for _, _, h in held for x in (h, end)]), return_inverse=True)
            none = np.zeros(len(held), dtype=np.int64)
            meta = pack(none, none, none, n, np.array([p for _, p, _ in held]))
            ids = pa.array([[d for d, _, _ in held]], pa.list_(pa.int64()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([base + number], pa.int64()), ids, pa.array([meta]), pa.array([pack(tokens)]), pa.array([words.astype("<u8").tobytes()])], ["chunk", "ids", "meta", "tokens", "words"])

        size = 0
        for b in batches:
            for doc, lo, words in zip(b.column("doc").to_pylist(), b.column("lo").to_pylist(), b.column("words").to_pylist(), strict=True):
                held.append((doc, lo, np.frombuffer(words, "<u8")))
                size += len(words) // 8
                if size >= chunking.CHUNK_TOKENS:
                    yield close()
                    number, size = number + 1, 0
        if held:
            yield close()

    return runs.select("doc", "lo", "words").coalesce(parts).mapInArrow(gather, "chunk long, ids array<bigint>, meta binary, tokens binary, words binary")


def _regions(joined: DataFrame) -> DataFrame:
    """The words of the wanted regions of each chunk's documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                hashes = np.frombuffer(b.column("words")[i].as_py(), "<u8")
                _, _, _, n, place = unpack(b.column("meta")[i].as_py())
                tokens = unpack(b.column("tokens")[i].as_py())[0]
                first = np.cumsum(n) - n
                where: dict[int, list[int]] = {}
                for s, d in enumerate(b.column("ids")[i].as_py()):
                    where.setdefault(d, []).append(s)
                rows = []
                for r in b.column("wanted")[i].as_py():
                    for s in where.get(r["other"], ()):
                        lo, hi = max(r["lo2"], int(place[s])), min(r["hi2"], int(place[s] + n[s]) - 1)
                        if lo < hi:
                            start = int(first[s] - place[s])
                            rows.append((r["other"], b.column("chunk")[i].as_py(), r["lo2"], r["hi2"], lo, (hashes[tokens[start + lo : start + hi]] >> np.uint64(32)).astype("<u4").tobytes()))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols[:5]] + [pa.array(list(cols[5]), pa.binary())], ["other", "hub_chunk", "lo2", "hi2", "lo_other", "other_words"])

    out = joined.mapInArrow(cut, "other long, hub_chunk long, lo2 long, hi2 long, lo_other long, other_words binary")
    # repeated ids can give one region several texts; the longest stands for it
    return out.groupBy("other", "hub_chunk", "lo2", "hi2").agg(F.max_by(F.struct("lo_other", "other_words"), F.length("other_words")).alias("r")).select("other", "hub_chunk", "lo2", "hi2", "r.*")


def _aligned(chains: DataFrame, regions: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """Step 5."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_words", "other_id", "other_start", "other_words", "similarity", "x0", "y0"]
        for b in batches:
            rows = []
            for r in b.to_pylist():
                own, hub = np.frombuffer(r["words"], "<u4"), np.frombuffer(r["other_words"], "<u4")
                x, y = [v - r["lo"] for v in r["x"]], [v - r["lo_other"] for v in r["y"]]
                if y[0] < 0 or y[-1] + K > len(hub):
                    continue
                a, b2, c, d, count = align(own, hub, x, y)
                if min(b2 - a, d - c) < min_words:
                    a, b2, c, d, count = stretched(own, hub, (a, b2, c, d, count), similarity)
                length = max(b2 - a, d - c)
                if min(b2 - a, d - c) >= min_words and count >= similarity * length:
                    rows.append((r["doc"], a + r["lo"], b2 - a, r["other"], c + r["lo_other"], d - c, min(1.0, count / length), r["x"][0], r["y"][0]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.float64() if k == 6 else pa.int64()) for k, c in enumerate(cols)], names)

    both = chains.join(regions, ["other", "hub_chunk", "lo2", "hi2"])
    return both.select("doc", "other", "x", "y", "lo", "words", "lo_other", "other_words").mapInArrow(check, f"{_PASSAGE}, x0 long, y0 long")


class _Variant:
    """A chain with a hub, to be compared with others: its words, and which of them stand at which of the hub's."""

    def __init__(self, r: dict):
        self.r, self.doc, self.text, self.lo = r, r["doc"], r["text"], r["lo"]
        self.own = np.frombuffer(r["words"], "<u4")
        x, y = np.array(r["x"]) - r["lo"], np.array(r["y"])
        self.y0, self.y1 = int(y[0]), int(y[-1]) + K
        self.at = np.full(self.y1 - self.y0, -1)
        stop = np.minimum(np.maximum(np.append(y[1:], self.y1), y + K), np.minimum(self.y1, y + len(self.own) - x))  # up to the next anchor on this one's diagonal
        n = np.maximum(stop - y, 0)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.at[np.repeat(y - self.y0, n) + step] = np.repeat(x, n) + step  # of anchors that overlap the later one's
        held = self.at >= 0
        back = np.minimum.accumulate(np.where(held, self.at, 1 << 40)[::-1])[::-1]  # a later anchor's words win, so that places rise
        held &= self.at <= back
        held[1:] &= self.at[1:] > np.maximum.accumulate(np.where(held, self.at, -1))[:-1]
        self.there = np.where(held, self.own[np.maximum(self.at, 0)].astype(np.int64), -1)

    @functools.cached_property
    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        at, h, _ = seeds(np.append(self.own, 0).astype(np.uint64), np.array([0]))
        by = np.argsort(h, kind="stable")
        return h[by], at[by]


def _in_place(a: _Variant, others: list[_Variant], min_words: int, similarity: float) -> list[tuple[int, int, int, int, int] | None]:
    """The passage that a variant shares with each of ``others``, which begin no earlier, by the words at equal places of the hub."""
    lo, hi = np.array([b.y0 for b in others]), np.minimum([b.y1 for b in others], a.y1)
    found: list[tuple[int, int, int, int, int] | None] = [None] * len(others)
    wide = np.flatnonzero(hi - lo >= min_words)
    if not len(wide):
        return found
    size = (hi - lo)[wide]
    first = np.cumsum(size) - size
    own = a.there[np.repeat(lo[wide] - a.y0 - first, size) + np.arange(size.sum())]
    hits = np.flatnonzero((own == np.concatenate([others[k].there[: n] for k, n in zip(wide.tolist(), size.tolist(), strict=True)])) & (own >= 0))
    begin, end = np.searchsorted(hits, first), np.searchsorted(hits, first + size)
    enough = end - begin >= similarity * min_words
    for k, at, n, i, j in zip(wide[enough].tolist(), first[enough].tolist(), (end - begin)[enough].tolist(), hits[begin[enough]].tolist(), hits[end[enough] - 1].tolist(), strict=True):
        b = others[k]
        shift = b.y0 - a.y0 - at
        a0, a1, b0, b1 = int(a.at[i + shift]), int(a.at[j + shift]) + 1, int(b.at[i - at]), int(b.at[j - at]) + 1
        if min(a1 - a0, b1 - b0) >= min_words and n >= similarity * max(a1 - a0, b1 - b0):
            found[k] = a0, a1, b0, b1, n
    return found


def _agree(a: _Variant, others: list[_Variant], min_words: int, similarity: float) -> list[tuple[int, int, int, int, int] | None]:
    """The passage that a variant shares with each of ``others``, as by ``align``: first by places of the hub, then by their own seeds."""
    found = _in_place(a, others, min_words, similarity)
    left = [k for k, f in enumerate(found) if f is None]
    if not left:
        return found
    h, pos = a.seeds
    hb, pb = (np.concatenate(v) for v in zip(*(others[k].seeds for k in left), strict=True))
    group = np.repeat(left, [len(others[k].seeds[0]) for k in left])
    first = np.searchsorted(h, hb, "left")
    n = np.searchsorted(h, hb, "right") - first
    x = pos[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
    for k, gx, gy in _groups(np.repeat(group, n), x, np.repeat(pb, n), MIN_ANCHORS, 0):
        b = others[k]
        for cx, cy in _chained(gx, gy, MIN_ANCHORS):
            one = align(a.own, b.own, cx, cy)
            if min(one[1] - one[0], one[3] - one[2]) < min_words:
                one = stretched(a.own, b.own, one, similarity)
            a0, a1, b0, b1, count = one
            best = found[k]
            if min(a1 - a0, b1 - b0) >= min_words and count >= similarity * max(a1 - a0, b1 - b0) and (best is None or count > best[4]):
                found[k] = one
    return found


def _compared(rows: list[dict], min_words: int, similarity: float) -> tuple[dict[str, int], list[tuple]]:
    """Of the variants of one block, or of two: with how many passages each agrees, and the links that are rows."""
    all_ = sorted((_Variant(r) for r in rows), key=lambda v: (v.y0, v.doc, v.text))
    apart, listed = rows[0]["bi"] != rows[0]["bj"], rows[0]["variants"] <= LISTED
    links = dict.fromkeys((v.text for v in all_), 0)
    root = {v.text: "" if v.r["known"] else v.text for v in all_} | {"": ""}

    def top(t: str) -> str:
        while root[t] != t:
            root[t] = t = root[root[t]]
        return t

    out = []
    begins = [v.y0 for v in all_]
    for i, a in enumerate(all_):
        others = [b for b in all_[i + 1 : bisect.bisect_right(begins, a.y1 - K)] if a.doc != b.doc and not (apart and a.r["b"] == b.r["b"])]
        for b, found in zip(others, _agree(a, others, min_words, similarity) if others else (), strict=True):
            if found is None:
                continue
            links[a.text] += b.r["n"]
            links[b.text] += a.r["n"]
            one, two = top(a.text), top(b.text)
            told = (a.r["copy"] or b.r["copy"]) and a.r["known"] and b.r["known"] and min(a.y1, b.y1) - max(a.y0, b.y0) >= min_words
            if (listed and not told) or one != two:
                root[max(one, two)] = min(one, two)  # the hub's class is the empty text
                a0, a1, b0, b1, count = found
                one, two = (a.doc, a0 + a.lo, a1 - a0), (b.doc, b0 + b.lo, b1 - b0)
                big, small = (a, b) if a.doc > b.doc else (b, a)
                out.append((*max(one, two), *min(one, two), min(1.0, count / max(a1 - a0, b1 - b0)), big.text))
    return links, out


def _sibling_links(chains: DataFrame, found: DataFrame, stage: Stage, parts: int, min_words: int, similarity: float) -> DataFrame:
    """Step 7: the rows of ``found`` and those beside the hubs, all with ``n_links``."""
    size = lambda c: F.element_at(c, -1) - F.col(c)[0] + K
    m = chains.withColumn("x0", F.col("x")[0]).withColumn("y0", F.col("y")[0]).withColumn("length", size("x"))
    m = m.filter((F.col("length") >= min_words - 2 * K) & (size("y") >= min_words - 2 * K))
    core = F.expr("substring(words, int(4 * (x0 - lo) + 1), int(4 * length))")
    whole = (F.col("length") >= min_words) & (size("y") >= min_words)
    own = F.concat_ws(":", "y0", size("y"), F.when(whole, F.md5(core)).otherwise(F.concat_ws("@", "doc", "x0")))
    m = m.withColumn("text", own)
    known = found.select(F.col("other_id").alias("other"), F.col("doc_id").alias("doc"), "x0", "y0", "similarity").groupBy("other", "doc", "x0", "y0").agg(F.lit(True).alias("known"), (F.max("similarity") >= 1).alias("copy"))
    members = stage.put("members", m.select("other", "doc", "x0", "y0", "text", "length").distinct().join(known, ["other", "doc", "x0", "y0"], "left"))
    texts = members.groupBy("other", "text").agg(F.count("*").alias("n"), F.min(F.struct("doc", "x0")).alias("first"), (F.count("known") > 0).alias("known"), F.coalesce(F.max("copy"), F.lit(False)).alias("copy"))
    sizes = texts.groupBy("other").agg(F.count("*").alias("variants")).filter("variants > 1")
    texts = stage.put("texts", texts.join(sizes, "other").select("other", "text", "n", F.col("first.doc").alias("doc"), F.col("first.x0").alias("x0"), "known", "copy", "variants"))
    # of copies only the words that they share take part
    shared = (F.col("n") > 1) & whole
    rows = m.dropDuplicates(["other", "text", "doc", "x0"]).join(texts, ["other", "text", "doc", "x0"])
    rows = rows.select("other", "text", "doc", "n", "known", "copy", "variants", "x", "y", F.when(shared, F.col("x0")).otherwise(F.col("lo")).alias("lo"), F.when(shared, core).otherwise(F.col("words")).alias("words"))
    blocks = F.ceil(F.col("variants") / BLOCK)
    rows = rows.withColumn("b", F.pmod(F.xxhash64("text"), blocks)).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.withColumn("bi", F.least("b", "c")).withColumn("bj", F.greatest("b", "c")).drop("c")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        names, kinds = ["other", "text", "links", "doc_id", "start", "n_words", "other_id", "other_start", "other_words", "similarity"], [pa.int64(), pa.string(), *[pa.int64()] * 7, pa.float64()]
        for b in itertools.chain(batches, [None]):
            out = []
            for r in b.to_pylist() if b is not None else [None]:
                if held and (r is None or any(r[c] != held[0][c] for c in ("other", "bi", "bj"))):
                    links, found = _compared(held, min_words, similarity)
                    out += [(held[0]["other"], t, n, *[None] * 7) for t, n in links.items() if n]
                    out += [(held[0]["other"], p[7], None, *p[:7]) for p in found]
                    held.clear()
                if r is not None:
                    held.append(r)
            cols = list(zip(*out, strict=True)) if out else [[]] * 10
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

    dealt = rows.repartition(parts, "other", "bi", "bj").sortWithinPartitions("other", "bi", "bj")
    beside = stage.put("beside", dealt.mapInArrow(compare, f"other long, text string, links long, {_PASSAGE}"))
    links = beside.filter("links is not null").groupBy("other", "text").agg(F.sum("links").alias("links"))
    total = (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1 + F.coalesce("known", F.lit(False)).cast("long")).alias("n_links")
    weights = stage.put("weights", texts.join(links, ["other", "text"], "left").select("other", "text", "n", "known", "doc", "x0", "links"))
    counted = members.select("other", "doc", "x0", "y0", "text").join(weights.drop("doc", "x0"), ["other", "text"], "left")
    plain = [c.split()[0] for c in _PASSAGE.split(", ")]
    hubs = found.alias("f").join(counted.alias("c"), F.expr("f.other_id = c.other and f.doc_id = c.doc and f.x0 = c.x0 and f.y0 = c.y0"), "left")
    hubs = hubs.select(*(f"f.{c}" for c in plain), F.greatest(total, F.lit(1)).cast("long").alias("n_links"))
    pairs = beside.filter("links is null").drop("links").join(weights.drop("doc", "x0"), ["other", "text"]).select(*plain, total)
    # copies of a variant that is no passage of its hub's
    rest = members.alias("m").join(weights.filter("not known and n > 1").alias("w"), F.expr("m.other = w.other and m.text = w.text and m.doc != w.doc"))
    copies = rest.select(F.col("m.doc").alias("doc_id"), F.col("m.x0").alias("start"), F.col("length").alias("n_words"), F.col("w.doc").alias("other_id"), F.col("w.x0").alias("other_start"), F.col("length").alias("other_words"), F.lit(1.0).alias("similarity"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return hubs.unionByName(pairs).unionByName(copies)


def _still_open(runs: DataFrame, found: DataFrame) -> DataFrame:
    """Runs of which two cells of ``CELL`` words or more lie in no passage just found, on either side of it.

    Passages become distinct cells before they meet, so a hub with a million partners costs its length.
    """
    near = lambda c: F.floor((c + CELL // 2) / CELL)
    sides = [(F.col("doc_id"), F.col("start"), F.col("n_words")), (F.col("other_id"), F.col("other_start"), F.col("other_words"))]
    held = [found.select(d.alias("doc"), F.explode(F.sequence(near(a), near(a + n) - 1)).alias("cell")) for d, a, n in sides]
    held = held[0].unionByName(held[1]).distinct()
    first, last = F.ceil(F.col("x")[0] / CELL), F.floor(F.col("x")[1] / CELL) - 1
    cells = runs.select("doc", "lo", first.alias("a"), last.alias("z")).filter("a <= z").select("doc", "lo", F.explode(F.sequence("a", "z")).alias("cell"))
    left = cells.join(held, ["doc", "cell"], "left_anti").groupBy("doc", "lo").count().filter("count >= 2")
    return runs.join(left.select("doc", "lo"), ["doc", "lo"], "left_semi")


def shared_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, similarity: float = 0.8) -> DataFrame:
    """The passages of ``docs``, as described above."""
    spark = docs.sparkSession
    integral(docs, id_col)
    stage, parts = Stage(spark, "passages"), 4 * max(1, shuffle_parts(spark))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(False).alias("held")).filter(F.col("id").isNotNull())
    chunks = stage.put("chunks-0", chunked(slim, "bigint", _BYTES, overlap=OVERLAP).drop("counts", "order"))
    gaps, step, found, linked = (0,), chunking.CHUNK_TOKENS - OVERLAP, [], []
    for k in itertools.count():
        back = stage.put(f"hubs-{k}", _seed_table(chunks, parts, gaps)).groupBy("chunk").agg(F.collect_list(F.struct("part", "data")).alias("back"))
        chains = stage.put(f"chains-{k}", _chains(chunks.join(back, "chunk"), parts, min_words, similarity, gaps, step))
        runs, chains = chains.filter("other is null"), chains.filter("other is not null")
        linked.append(chains.select("doc", "other", "x", "y", "lo", "words"))
        wanted = chains.select("hub_chunk", "other", "lo2", "hi2").distinct().groupBy(F.col("hub_chunk").alias("chunk")).agg(F.collect_list(F.struct("other", "lo2", "hi2")).alias("wanted"))
        regions = stage.put(f"regions-{k}", _regions(chunks.join(wanted, "chunk")))
        found.append(stage.put(f"found-{k}", _aligned(chains, regions, min_words, similarity)))
        stage.drop(f"regions-{k}")
        stage.drop(f"hubs-{k}")
        runs = stage.put(f"open-{k}", _still_open(runs, found[-1]))
        words = runs.agg(F.sum(F.length("words") / 8)).first()[0]
        if not words:
            break
        if k:
            pairs = [f.select("doc_id", "other_id") for f in found]
            if pairs[-1].join(functools.reduce(DataFrame.unionByName, pairs[:-1]), ["doc_id", "other_id"], "left_anti").isEmpty():
                break
        chunks = stage.put(f"chunks-{k + 1}", _rechunked(runs, max(4, math.ceil(words / RUN_WORDS))))  # messages go from each chunk to each part
        for table in ("chunks", "open"):
            stage.drop(f"{table}-{k}")
        gaps, step = GAPS, 0
    stage.drop(f"chunks-{k}")
    every = stage.put("found", functools.reduce(DataFrame.unionByName, found).distinct())
    names = [c for c in every.columns if c not in ("similarity", "x0", "y0")]
    out = _sibling_links(functools.reduce(DataFrame.unionByName, linked), every, stage, parts, min_words, similarity)
    return out.groupBy(*names).agg(F.max("similarity").alias("similarity"), F.max("n_links").alias("n_links"))

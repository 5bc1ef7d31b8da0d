"""Documents as chunks of word numbers, and packed arrays that travel between chunks and partitions."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_TOKENS = 1 << 20
END, START = b"\n</s>", b"\n<s>"  # no word holds a line feed


def pack(*arrays: np.ndarray) -> bytes:
    """Non-negative integer arrays, each in its smallest width and by byte planes, compressed together."""
    import zstandard

    head, body = [len(arrays)], []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
        head += [len(a), width]
        body.append(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, dtype="<i8").tobytes() + b"".join(body))


def unpack(data: bytes, wide: bool = True) -> list[np.ndarray]:
    """The arrays of ``pack``, as 64-bit integers or, to save memory, in their stored width."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    shape = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(-1, 2)
    at, out = 8 + 16 * n, []
    for size, width in shape.tolist():
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        own = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()
        out.append(own.astype(np.int64) if wide else own)
        at += size * width
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def coded(flat: bytes) -> tuple[list[bytes], np.ndarray]:
    """Distinct words, after END and START, and the place in them of each word of a text with blanks between."""
    data = np.frombuffer(flat, np.uint8)
    word = data != 32
    edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    offsets = np.concatenate(([0], np.cumsum(edges[1::2] - edges[::2])))
    found = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[word])]).dictionary_encode()
    _, at, own = found.dictionary.buffers()  # slices of one object are much faster than to_pylist
    at, own = np.frombuffer(at, np.int64, len(found.dictionary) + 1).tolist(), own.to_pybytes()
    words = [own[a:z] for a, z in itertools.pairwise(at)]
    end = words.index(END)
    place = np.arange(2, len(words) + 2)
    place[end:] -= 1
    place[end] = 0
    return [END, START, *words[:end], *words[end + 1 :]], place[found.indices.to_numpy()]


def chunked(docs: DataFrame, kind: str, split: Callable[[str], list[bytes]] | bytes, parts: int = 1, overlap: int = 0) -> DataFrame:
    """Chunks of ``docs (id, text, held)``: about ``CHUNK_TOKENS`` words each, every document closed by END.

    ``ids``: the id of each segment (a document, or a part of a very long one). ``meta``: row number, held,
    word before it (as a number), length and place in its document of each segment. ``tokens``: word numbers.
    ``words``: the 64-bit hash of each number. ``counts``: its tokens in segments that are not held.
    ``order``: the words by partition of ``parts``, and where each partition begins.

    With ``overlap`` no document is cut that fits a chunk, and one of more than ``step = CHUNK_TOKENS - overlap``
    words has a part at each multiple of ``step``, in chunks that follow each other; parts share ``overlap`` words.

    ``split`` gives a text's words. Or it is a table by which all bytes between words become blanks: words are then told apart
    once for a chunk, which is much faster, and the word before a segment is always START.
    """
    step = CHUNK_TOKENS - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than a chunk")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        number, row, table = 0, 0, isinstance(split, bytes)
        names = ["chunk", "ids", "meta", "tokens", "words", "counts", "order"]
        words: defaultdict[bytes, int] = defaultdict()
        segments: list[tuple] = []  # row, held, word before, tokens, place
        size = 0

        def fresh() -> None:
            nonlocal size
            words.clear()
            words.default_factory = itertools.count().__next__
            words[END], words[START]  # numbers 0 and 1
            segments.clear()
            ids.clear()
            size = 0

        def close() -> pa.RecordBatch:
            nonlocal number
            held = np.array([s[1] for s in segments], dtype=np.int64)
            own_words: Collection[bytes] = words
            if table:
                n = np.array([s[5] for s in segments], dtype=np.int64)
                own_words, tokens = coded(b" ".join([*(s[3] for s in segments), END]))  # one END more, for chunks without
                tokens = tokens[:-1]
            else:
                n = np.array([len(s[3]) for s in segments], dtype=np.int64)
                tokens = np.concatenate([s[3] for s in segments])
            train = np.repeat(held == 0, n)
            counts = np.bincount(tokens[train], minlength=len(own_words))
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in own_words], dtype="<u8")
            meta = pack(np.array([s[0] for s in segments]), held, np.array([s[2] for s in segments]), n, np.array([s[4] for s in segments]))
            own = pa.array(ids, ids_type)
            cols = [pa.array([base + number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([meta]), pa.array([pack(tokens)]), pa.array([hashes.tobytes()]), pa.array([pack(counts)]), pa.array([pack(*order_of(hashes, parts))])]
            number += 1
            return pa.RecordBatch.from_arrays(cols, names)

        ids: list = []
        ids_type = None
        fresh()
        for batch in batches:
            ids_type = batch.column("id").type
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for key, text, held in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), part.column("held").to_pylist(), strict=True):
                    if table:
                        whole = (text or "").encode("utf-8", "surrogatepass").translate(split)
                        blank = np.frombuffer(whole, np.uint8) == 32
                        count = int((blank[:-1] & ~blank[1:]).sum()) + int(len(blank) > 0 and not blank[0]) + 1
                        if count <= step and (size + count <= CHUNK_TOKENS or overlap):  # never cut
                            if size and size + count > CHUNK_TOKENS:
                                yield close()
                                fresh()
                            segments.append((base + row, int(held), 1, whole + b" " + END, 0, count))
                            ids.append(key)
                            size, row = size + count, row + 1
                            if size >= CHUNK_TOKENS:
                                yield close()
                                fresh()
                            continue
                        found = whole.split()
                    else:
                        found = split(text or "")
                    found.append(END)
                    last, k = START, 0
                    if overlap and size and size + len(found) > CHUNK_TOKENS:
                        yield close()
                        fresh()
                    while k < len(found):
                        some = found[k : k + max(CHUNK_TOKENS - size, 1)]
                        if table:
                            segments.append((base + row, int(held), 1, b" ".join(some), k, len(some)))
                        else:
                            first = words[last]
                            segments.append((base + row, int(held), first, np.fromiter(map(words.__getitem__, some), np.int64, len(some)), k))
                        ids.append(key)
                        size += len(some)
                        k += step if overlap else len(some)
                        last = found[min(k, len(found)) - 1]
                        if size >= CHUNK_TOKENS or (overlap and k < len(found)):
                            yield close()
                            fresh()
                    row += 1
        if segments:
            yield close()

    return docs.mapInArrow(cut, f"chunk long, ids array<{kind}>, meta binary, tokens binary, words binary, counts binary, order binary")


def order_of(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a chunk's words go out: by partition; and where each partition begins."""
    part = (mix(hashes) % np.uint64(parts)).astype(np.int64)
    return np.argsort(part, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))



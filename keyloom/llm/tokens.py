"""Token ids of whole texts by the ``tokenizers`` library, with a cache of words.

A text of common characters is cut into pieces by the tokenizer's own pre-tokenizing pattern; each
distinct piece is encoded once by the library and then found in a cache. Any other text goes to the
library whole. ``cut`` says what the pre-tokenizer does:

* ``"drop"``: texts are lower-cased, white space separates pieces and yields no ids.
* ``"lead"``: nothing is changed, and a blank belongs to the piece after it.

Strings of special tokens in a text count as ordinary text. A null text is the empty text. A very long
text is encoded in segments that end at a blank between two other characters, where no piece crosses.
"""

from __future__ import annotations

import functools
import itertools
import operator
import os
import re
import unicodedata
from collections.abc import Iterator

#: Characters whose case, composition and class need no context: texts with others go to the library.
_COMMON = "\t\n\r -~\xa1-\u024f\u2010-\u2027\u2030-\u2052\u20a0-\u20bf"
_RARE = re.compile(f"[^{_COMMON}]")
#: All that a text of these characters can hold, before and after lower-casing, which leads beyond that range.
_MET = sorted({x for c in map(chr, range(0x20C0)) if not _RARE.match(c) for x in c + c.lower()})
_L = "".join(c for c in _MET if unicodedata.category(c)[0] == "L")
_N = "".join(c for c in _MET if unicodedata.category(c)[0] == "N")
#: The pre-tokenizers' patterns in the two vocabulary files, for the characters below.
PRE = {
    "drop": rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+",
    "lead": rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+",
}
SEGMENT_CHARS = 1 << 20
CACHE_PIECES = 400_000  # about 100 MB in a Python worker


class _Torn(Exception):
    """The library cuts a joint text elsewhere than between the pieces asked for."""


class _Cache(dict):
    """Ids of pieces; a look-up of an unknown piece notes it and gives None."""

    def __init__(self, known=()):
        super().__init__(known)
        self.new: set[str] = set()

    def __missing__(self, piece: str) -> None:
        self.new.add(piece)


class WordCachedEncoder:
    def __init__(self, path: str, cut: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.tk.encode_special_tokens = True
        self.find = re.compile(PRE[cut]).findall
        self.lower = cut == "drop"
        self.cache = _Cache()
        self.cache_pieces = cache_pieces
        self.between = " " if self.lower else "\n"
        vocab = self.tk.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        if self.lower:  # the last id of a piece carries the end-of-word mark
            self.closes[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        else:  # a line feed between pieces is an id of its own
            self.closes[self.tk.encode("\n", add_special_tokens=False).ids] = True

    def _raw(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        found = [e.ids for e in self.tk.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(itertools.chain.from_iterable(found), dtype="<u4").tobytes()
        ends = [0, *itertools.accumulate(4 * len(x) for x in found)]
        return [flat[a:b] for a, b in itertools.pairwise(ends)]

    def _pieces(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each piece with its ids, encoded in joint texts whose separators end every piece."""
        import numpy as np

        joint = [p for p in pieces if not p.isspace()]
        for k in range(0, len(joint), 4096):
            some = joint[k : k + 4096]
            ids = np.array(self.tk.encode_batch_fast([self.between.join([*some, ""])], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.closes[ids]) + (1 if self.lower else 0)
            starts = np.concatenate(([0], ends[:-1] + (0 if self.lower else 1)))
            if len(ends) != len(some):
                raise _Torn
            data = ids.tobytes()
            yield from zip(some, [data[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)], strict=True)
        space = [p for p in pieces if p.isspace()]
        yield from zip(space, self._raw(space), strict=True)

    def _segments(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > 2 * SEGMENT_CHARS:
            end = text.find(" ", at + SEGMENT_CHARS)
            while end >= 0 and (text[end - 1].isspace() or text[end + 1 : end + 2].isspace()):
                end = text.find(" ", end + 1)
            if end < 0:
                break
            yield text[at:end]
            at = end
        yield text[at:]

    def _group(self, texts: list[str]) -> list[bytes]:
        pieces = [None if _RARE.search(t) else self.find(t.lower() if self.lower else t) for t in texts]
        out = [self._raw([t])[0] if p is None else self._join(p) for t, p in zip(texts, pieces, strict=True)]
        new = self.cache.new
        if new:
            if len(self.cache) + len(new) > self.cache_pieces:  # keep what is in use
                used = set().union(*(p for p in pieces if p)).intersection(self.cache)
                self.cache = _Cache((p, self.cache[p]) for p in used)
            self.cache.new = set()
            try:
                self.cache.update(self._pieces(list(new)))
            except _Torn:  # not cut as its pattern says: these texts go to the library whole
                return self._raw(texts)
            out = [self._join(p) if x is None else x for x, p in zip(out, pieces, strict=True)]
        return out

    def _join(self, pieces: list[str]) -> bytes | None:
        """The ids of all pieces; None if any is not known yet, and then all unknown ones are noted."""
        if len(pieces) < 2:
            return self.cache[pieces[0]] if pieces else b""
        try:
            return b"".join(operator.itemgetter(*pieces)(self.cache))
        except TypeError:
            return None

    def encode_many(self, texts: list[str | None], group_chars: int = 1 << 21) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        group: list[str] = []
        size = 0
        for t in texts:
            t = t or ""
            if len(t) > group_chars:
                yield from self._group(group)
                group, size = [], 0
                yield b"".join(x for s in self._segments(t) for x in self._group([s]))
                continue
            group.append(t)
            size += len(t)
            if size > group_chars:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)


@functools.lru_cache(maxsize=1)
def encoder(path: str, cut: str, cache_pieces: int = CACHE_PIECES) -> WordCachedEncoder:
    """One encoder in each Python worker."""
    return WordCachedEncoder(path, cut, cache_pieces)

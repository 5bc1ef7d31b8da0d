"""Spelling variants: words one edit apart, by merging light subtrees of a trie (an errata trie).

The words stand in a trie. At each node the child that holds most words is *heavy*, the others are *light*; a word has
at most ``log2`` of the number of words light edges on its path. Two words one edit apart part at one node ``x``, and one of
them leaves it by a light edge. So at each node the light subtrees alone are merged, smaller into larger:

* with the light character replaced by the heavy one. A terminal that coincides with a word of the heavy
  subtree is one replacement away from it, and terminals of two light subtrees that coincide there are one
  replacement away from each other;
* with the light character skipped: a terminal that coincides with a word is one deletion away from it;
* with the heavy character put before: a terminal that coincides with a word is one insertion away from it.

A skip is entered only where the next character differs, so a pair is found once. Entries are matched with words by
an equi-join. Groups that coincide are never expanded into pairs: a member gets the group's size and the best other.

Distribution: words are dealt by range, so that a task holds whole subtrees; it walks them on its sorted words
and holds one range. Only nodes along the first and last word of a range may have children in other ranges: their
children are counted by all ranges, summed, and the heavy one comes back to each range that asked. Nodes
of such paths are named by a digest of their prefix, so long words stay cheap.

Words of ``documents``: runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z in lower case. Runs are counted in tasks that empty
their tables every ``FLUSH`` words.

Defined results: null and empty texts have no words; a null id counts as the text ``null`` in the checksum. Repeated rows
count again. Among near words with equal ``n`` the smallest in code-point order is the form. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, shuffle_parts

RUN = rb"(?:[a-z]|\xc3[\x80-\xbf])+"  # in UTF-8, after A-Z went to lower case
FLUSH = 300_000
WORDS_A_PART = 100_000
REPLACED, SKIPPED, PUT = 0, 1, 2


def word_counts(docs: DataFrame, *, min_chars: int = 5, min_count: int = 3, damage: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: distinct words and their occurrences, after one character of a run in ``damage`` has gone."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, found = re.compile(RUN).findall, Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return batch

        def chars(run: bytes) -> int:
            return len(run) - run.count(b"\xc3")  # which begins each character of two bytes

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                head = b"null:" if doc is None else b"%d:" % doc
                for run, n in Counter(find((text.as_py() or b"").lower())).items():
                    if len(run) < min_chars or chars(run) < min_chars:
                        continue
                    h = zlib.crc32(head + run)
                    if h % damage == 0:
                        whole = run.decode()
                        at = h % len(whole)
                        if len(whole) <= min_chars:
                            continue
                        run = (whole[:at] + whole[at + 1 :]).encode()
                    found[run] += n
                if len(found) > FLUSH:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# -- inside one range of sorted words ---------------------------------------------------------------------------------


def _common(a: str, b: str, start: int) -> int:
    """Length of the common prefix, which is ``start`` at least."""
    top = min(len(a), len(b))
    if a[:top] == b[:top]:
        return top
    while a[start] == b[start]:
        start += 1
    return start


def _digests(word: str) -> list[bytes]:
    """A name for each prefix of the word, the empty and the whole one included."""
    state, out = hashlib.blake2b(digest_size=16), []
    out.append(state.digest())
    for c in word:
        state.update(c.encode("utf-32-le"))
        out.append(state.digest())
    return out


class Trie:
    """The subtrees over sorted distinct words, walked as ranges of the list."""

    def __init__(self, words: list[str]):
        self.words = words
        self.first, self.last = _digests(words[0]), _digests(words[-1])

    def nodes(self) -> Iterator[tuple[int, int | None, list[tuple[str, int, int]], bytes | None]]:
        """For each node that may branch: depth, the number of the word that ends there, its children ``(character, from, to)``,
        and its name if other ranges may hold a part of it."""
        words, todo = self.words, [(0, len(self.words), 0)]
        while todo:
            lo, hi, d = todo.pop()
            name = self.first[d] if lo == 0 else self.last[d] if hi == len(words) else None
            if name is None:
                if hi - lo == 1:
                    continue
                d = _common(words[lo], words[hi - 1], d)
            own = lo if len(words[lo]) == d else None
            children, i = [], lo if own is None else lo + 1
            while i < hi:
                c = words[i][d]
                j = hi if words[hi - 1][d] == c else bisect_right(words, c, i + 1, hi, key=lambda w: w[d])  # noqa: B023
                children.append((c, i, j))
                i = j
            yield d, own, children, name
            todo += [(i, j, d + 1) for _, i, j in children]

    def shared(self) -> Iterator[tuple[bytes, str, int]]:
        """Counts of the children of nodes that other ranges may share; a word that ends there counts as child ''."""
        for _, own, children, name in self.nodes():
            if name is not None:
                if own is not None:
                    yield name, "", 1
                for c, i, j in children:
                    yield name, c, j - i

    def entries(self, heavy: dict[bytes, str]) -> Iterator[tuple[str, int, int, int]]:
        """Terminals of the merged light subtrees: ``(text, kind, depth, number of the word)``."""
        words = self.words
        for d, own, children, name in self.nodes():
            if name is not None:
                h = heavy.get(name)
            else:
                h = max(children, key=lambda x: (x[2] - x[1], -ord(x[0])))[0] if children else None
            if h is None:
                continue
            if own is not None:
                yield words[own] + h, PUT, d, own
            for c, i, j in children:
                if c == h:
                    continue
                for k in range(i, j):
                    w = words[k]
                    x, rest = w[:d], w[d + 1 :]
                    yield x + h + rest, REPLACED, d, k
                    yield x + h + w[d:], PUT, d, k
                    if rest[:1] != c:
                        yield x + rest, SKIPPED, d, k


def _sorted(table: pa.Table) -> tuple[list[str], list[int]]:
    pairs = sorted(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))
    return [w for w, _ in pairs], [n for _, n in pairs]


def _shared(table: pa.Table) -> pa.Table:
    words, _ = _sorted(table)
    rows = list(zip(*Trie(words).shared(), strict=True))
    part = table.column("part")[0].as_py()
    return pa.table({"part": pa.array([part] * len(rows[0]), pa.int32()), "node": pa.array(rows[0], pa.binary()), "child": pa.array(rows[1], pa.string()), "n": pa.array(rows[2], pa.int64())})


def _entries(table: pa.Table, heavy: pa.Table) -> pa.Table:
    schema = pa.schema([("key", pa.string()), ("kind", pa.int32()), ("depth", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
    words, counts = _sorted(table)
    known = dict(zip(heavy.column("node").to_pylist(), heavy.column("heavy").to_pylist(), strict=True))
    batches, rows = [], []

    def flush() -> None:
        if rows:
            keys, kinds, depths, own = zip(*rows, strict=True)
            batches.append(pa.record_batch([pa.array(keys, pa.string()), pa.array(kinds, pa.int32()), pa.array(depths, pa.int32()), pa.array([words[k] for k in own], pa.string()), pa.array([counts[k] for k in own], pa.int64())], schema=schema))
            rows.clear()

    for entry in Trie(words).entries(known):
        rows.append(entry)
        if len(rows) >= 50_000:
            flush()
    flush()
    return pa.Table.from_batches(batches, schema)


# -- over all ranges --------------------------------------------------------------------------------------------------


def _other(n: str, word: str) -> Column:
    """A candidate; the smaller the better."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def near_words(words: DataFrame, stage: Stage) -> DataFrame:
    """For each word of ``(word, n)``, distinct, that has near words: ``(word, n_near, best)``, best as ``(-n, word)``."""
    spark = words.sparkSession
    n_words = words.count()
    parts = max(shuffle_parts(spark), -(-n_words // WORDS_A_PART))
    dealt = words.repartitionByRange(parts, "word").withColumn("part", F.spark_partition_id())
    dealt = stage.put("dealt", dealt)
    shared = stage.put("shared", dealt.groupBy("part").applyInArrow(_shared, "part int, node binary, child string, n long"))
    # the root's name is asked for by all ranges: sums come first
    child = shared.groupBy("node", "child").agg(F.sum("n").alias("n"))
    letters = F.max(F.when(F.col("child") != "", F.struct("n", (-F.ascii("child")).alias("first"), "child")))
    heavy = child.groupBy("node").agg(F.count("*").alias("children"), letters["child"].alias("heavy")).filter((F.col("children") > 1) & F.col("heavy").isNotNull())
    asked = shared.select("part", "node").distinct().join(heavy.select("node", "heavy"), "node").select("part", "node", "heavy")
    entries = dealt.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(_entries, "key string, kind int, depth int, word string, n long")
    entries = stage.put("entries", entries)

    met = entries.join(words.select(F.col("word").alias("key"), F.col("n").alias("key_n")), "key", "left")
    # entries replaced at one place, whose texts coincide: how many, and the best two, one of which is another than the row's own
    group = Window.partitionBy("key", "kind", "depth").orderBy(F.desc("n"), "word")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = met.withColumns({"size": F.count("*").over(whole), "rank": F.row_number().over(group), "first": F.first(_other("n", "word")).over(whole), "second": F.nth_value(_other("n", "word"), 2).over(whole)})
    there = F.col("key_n").isNotNull()
    swapped = F.col("kind") == REPLACED
    among = F.when(swapped & (F.col("rank") == 1), F.col("second")).when(swapped, F.col("first"))
    mine = F.struct("word", (F.when(swapped, F.col("size") - 1).otherwise(0) + there.cast("long")).alias("n_near"), F.least(among, F.when(there, _other("key_n", "key"))).alias("best"))
    its = F.when(there, F.struct(F.col("key").alias("word"), F.lit(1).cast("long").alias("n_near"), _other("n", "word").alias("best")))
    found = met.select(F.explode(F.filter(F.array(mine, its), lambda f: f["n_near"] > 0)).alias("f")).select("f.*")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(formed: DataFrame, stage: Stage) -> DataFrame:
    """``(word, root)`` for words with a form: pointers are doubled until all stand at a word without one.

    A form has at least twice the count of its word, so a chain is no longer than the bits of a count.
    """
    at = stage.put("roots0", formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    for k in itertools.count(1):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        at = stage.put(f"roots{k}", step)
        if at.filter("moved").isEmpty():
            return at.select("word", "root")


def spelling_variants(words: DataFrame, *, factor: int = 2, word_col: str = "word", n_col: str = "n") -> DataFrame:
    """For each distinct word with its count: ``word, n, n_near, form, form_n, root``.

    ``form`` is the near word of largest count, if that is ``factor`` times the word's at least (``factor`` over 1); ``root`` is
    what a word comes to by following forms, the word itself where it has none. Null and empty words are left out, and rows
    that repeat a word add up."""
    if factor < 2:
        raise ValueError("a form must be more frequent than its word: factor 2 at least")
    stage = Stage(words.sparkSession, "variants")
    rows = words.select(F.col(f"`{word_col}`").alias("word"), F.col(f"`{n_col}`").cast("long").alias("n")).filter(F.col("word") != "")
    known = stage.put("words", rows.groupBy("word").agg(F.sum("n").alias("n")))
    near = near_words(known, stage)
    form_n = -F.col("best.less")
    formed = known.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form_n >= factor * F.col("n"), F.struct(F.col("best.word").alias("word"), form_n.alias("n"))).alias("form"))
    formed = stage.put("formed", formed.select("word", "n", "n_near", F.col("form.word").alias("form"), F.col("form.n").alias("form_n")))
    rooted = _roots(formed, stage)
    return formed.join(rooted, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

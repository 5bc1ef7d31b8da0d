"""Data structures and edge cases of the operators."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm import decontam, katz, langid, licences, linededup, lshforest, packing, passages, queries, tokenbin, vamana
from keyloom.llm.chunks import pack, unpack
from keyloom.llm.tokens import WordCachedEncoder


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 50), max_size=20))
def test_packing_places_every_length(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    placed = {}
    for count, lengths in patterns:
        assert count > 0 and sum(lengths) <= 64 and lengths == sorted(lengths, reverse=True)
        for n in lengths:
            placed[n] = placed.get(n, 0) + count
    assert placed == {k: v for k, v in histogram.items() if v}


def test_packing_rejects_long_lengths():
    with pytest.raises(ValueError):
        packing.shortest_pack_first({65: 1}, 64)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=700))
def test_elias_fano_selects_every_value(steps):
    values = np.cumsum(np.array(steps, dtype=np.int64))
    ef = tokenbin.EliasFano.encode(values)
    assert np.concatenate(list(ef.runs())).tolist() == values.tolist()
    for i in {0, len(values) // 2, len(values) - 1}:
        assert ef.select(i) == values[i]
    bits = 8 * (len(ef.low) + len(ef.upper))
    assert bits <= len(values) * (3 + max(0, int(values[-1] / len(values)).bit_length())) + 64


def test_token_block_round_trip():
    ids = np.array([1, 2, 65535, 7, 9], dtype="<u4")
    ef, got = tokenbin.decode_block(tokenbin.encode_block([2, 0, 3], ids.tobytes(), 2))
    assert got.tolist() == ids.tolist() and np.concatenate(list(ef.runs())).tolist() == [0, 2, 2, 5] and tokenbin.read_document(tokenbin.encode_block([2, 0, 3], ids.tobytes(), 2), 2).tolist() == [65535, 7, 9]
    with pytest.raises(ValueError):
        tokenbin.encode_block([1], np.array([70000], dtype="<u4").tobytes(), 2)
    with pytest.raises(ValueError):
        tokenbin.decode_block(b"x" * 64)


@pytest.mark.parametrize(("name", "cut"), [("word_bpe_49k.json", "drop"), ("byte_bpe_50k.json", "lead")])
def test_cached_ids_equal_the_library(name, cut):
    e = WordCachedEncoder(queries.vocabulary(name), cut)
    rnd = random.Random(5)
    parts = ["a", "B", "'s", "'", " ", "  ", "\n", "\t", "1", "é", "é", ".", "!!", " ", "日", "<|endoftext|>", "\x1c", "\x85", "Σ", "İ", "\r\n", "word", "½"]
    texts = ["", None, " ", *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 16))) for _ in range(3000)), "ab cd " * 1_200_000]
    want = [np.asarray(x.ids, dtype="<u4").tobytes() for x in e.tk.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert list(e.encode_many(texts)) == want


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.RandomState(1)
    hashes = rng.randint(0, 1 << 62, (5000, 2)).astype(np.uint64)
    hashes[:50, 0] = hashes[50:100, 0]  # one word may be equal
    shard = linededup.Shard.from_bytes(linededup.Shard.build(hashes, np.arange(5000), 300).to_bytes())
    at = shard.mph.find(hashes)
    assert sorted(at.tolist()) == list(range(5000))
    assert shard.count_of(hashes).tolist() == list(range(5000)) and shard.nbytes * 8 < 5000 * 40
    assert (shard.count_of(rng.randint(0, 1 << 62, (5000, 2)).astype(np.uint64)) > 0).mean() < 0.002
    assert linededup.Shard.build(hashes, np.arange(5000), 10).count_of(hashes).tolist() == [min(i, 255) for i in range(5000)]
    assert linededup.Shard.build(np.empty((0, 2), np.uint64), np.empty(0, np.int64), 10).count_of(hashes).max() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1 << 40), max_size=20), min_size=1, max_size=4))
def test_packed_arrays(arrays):
    a = [np.array(x, dtype=np.int64) for x in arrays]
    assert [x.tolist() for x in unpack(pack(*a))] == arrays


def test_discounts_are_proper():
    for n in ([0, 0, 0, 0, 0, 0, 0], [0, 100, 40, 20, 10, 6, 4], [0, 1, 0, 5, 0, 0, 9]):
        d = katz.discounts(np.array(n))
        assert ((d[1:] > 0) & (d[1:] < 1)).all()


def test_chains_and_alignment():
    x = np.array([0, 5, 10, 15, 90, 95, 100])
    y = np.array([3, 8, 14, 19, 40, 45, 50])
    assert [c[0] for c in passages.chain(x, y)] == [[0, 5, 10, 15], [90, 95, 100]]
    assert passages.chain(np.array([0, 5, 10]), np.array([10, 5, 0])) == []
    a, b = np.arange(80), np.concatenate([np.arange(40), [999], np.arange(41, 80)])
    assert passages.align(a, b, [0, 10, 50], [0, 10, 50]) == (0, 80, 0, 80, 79)
    assert passages.matched(np.array([1, 2, 3, 4]), np.array([1, 9, 3])) == 2


def test_forest_depth_follows_recall():
    assert lshforest.shortest_prefix(24, 8, 0.8, 0.999) == 6
    assert lshforest.shortest_prefix(1, 8, 0.8, 0.999) == 1
    assert len(lshforest.shingles("one two three")) == 1 and len(lshforest.shingles("")) == 0


def test_graph_search_finds_neighbours_among_copies():
    rng = np.random.RandomState(0)
    x = np.concatenate([rng.randn(600, 16), np.zeros((50, 16)) + 1])
    g = vamana.Graph.build(x)
    ids, _, _ = g.search(x[:50], 32)
    true = ((x[:50, None] - x[None]) ** 2).sum(axis=2).argsort(axis=1)[:, :10]
    hits = sum(len(set(i[:10]) & set(t)) for i, t in zip(ids, true, strict=True))
    assert hits >= 0.95 * true.size
    assert vamana.Graph.build(x[:1]).search(x[:1], 4)[0][0, 0] == 0


def test_licences():
    s = licences.Scanner(licences.default_templates(), 0.9)
    assert [(f[1], round(f[0], 6)) for f in s.scan("Prose.\n// Released under the MIT License.\nMore prose.")] == [("MIT", 1.0)]
    assert s.scan(licences.TEXTS["BSD-3-Clause"])[0][1] == "BSD-3-Clause"
    assert s.scan(None) == [] and s.scan("under the sun") == []


def test_language_counts_cover_long_texts():
    text = "abc é " * 100_000
    assert langid.ngram_counts(text).sum() == 3 * (len(" ".join(text.split())) + 2) - 3
    assert langid.ngram_counts("12 !!") is None and langid.ngram_counts(None) is None


# Edge cases of the operators: nulls in any column, empty and long texts, repeated rows, clashing columns.

LONG = "long words here " * 60_000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "x", "r"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "x", "r"),
        (2, None, None, None, None), (3, "", "de", "x", ""), (4, "  \n\t", "de", "", "q"), (None, "gamma delta", "fr", "x", "r"), (5, LONG, "en", "y", "r"), (6, "?!", None, "y", None), (-7, "ünï çödé\nline\nline", "fr", "y", "z"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, `key` string, n_lines string")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


def test_packing_edges(odd, nothing):
    tok = queries.vocabulary("word_bpe_49k.json")
    got = packing.pack_documents(odd, tok, capacity=64).toPandas()
    assert len(got[got.start == 0]) == 9 and got[got.doc_id == 2].length.tolist() == [1]
    assert got.groupby("sequence_id").length.sum().max() <= 64
    assert packing.pack_documents(nothing, tok).count() == 0
    kept = packing.token_pieces(odd, tok, keep_ids=True).toPandas()
    assert all(len(i) == 4 * n for i, n in zip(kept.ids, kept.length, strict=True))


def test_token_file_edges(odd, nothing):
    tok = queries.vocabulary("byte_bpe_50k.json")
    got = tokenbin.tokens_round_trip(odd, tok, block_tokens=1000).toPandas().sort_values("start")
    assert len(got) == 9 and got.start.tolist() == [0, *got.n_tokens.cumsum()[:-1]]
    ids = got.doc_id.fillna(-99).tolist()
    assert ids == sorted(ids)
    assert tokenbin.tokens_round_trip(nothing, tok).count() == 0


def test_language_edges(odd, nothing):
    m = langid.fit(odd)
    got = langid.identify(odd, m).toPandas()
    assert len(got) == 9 and set(got[got.text.isna() | (got.text == "?!")].lang_pred) == {"und"} and set(got.lang_pred) <= {"und", "en", "de", "fr"}
    assert langid.fit(nothing) is None and set(langid.identify(odd, None).toPandas().lang_pred) == {"und"}


def test_line_edges(odd, nothing):
    got = linededup.drop_frequent_lines(odd, min_docs=2).toPandas()
    assert len(got) == 9 and got.text.notna().all()
    first = got[got.doc_id == 1]
    assert first.n_dropped.tolist() == [1, 1] and first.text.tolist() == ["", ""]
    assert got[got.doc_id == 2].n_lines.tolist() == [1] and got[got.doc_id == -7].n_dropped.tolist() == [0]
    assert linededup.drop_frequent_lines(nothing).count() == 0
    assert linededup.drop_frequent_lines(odd, min_docs=2, min_chars=500).toPandas().n_dropped.sum() == 0


def test_lines_in_many_shards(odd, monkeypatch):
    """With tiny shards, with and without lines frequent enough for the broadcast."""
    monkeypatch.setattr(linededup, "SHARD_KEYS", 1)
    for hot in (20_000, 1):
        monkeypatch.setattr(linededup, "HOT", hot)
        got = linededup.drop_frequent_lines(odd, min_docs=1).toPandas()
        assert set(got[got.doc_id == -7].n_dropped) == {3} and set(got[got.doc_id == 3].n_dropped) == {0}
        got = linededup.drop_frequent_lines(odd, min_docs=2).toPandas()
        assert got[got.doc_id == 1].n_dropped.tolist() == [1, 1] and got.n_dropped.sum() == 2 and got.columns.tolist() == ["doc_id", "text", "lang", "key", "n_lines", "n_dropped"]


def test_decontamination_edges(spark, odd, nothing):
    items = spark.createDataFrame([("a", "beta gamma delta epsilon zeta eta theta iota kappa lambda"), ("b", "GAMMA delta"), ("c", None), (None, "alpha beta"), ("d", "??"), ("b", "gamma delta")], "item_id string, text string")
    for rows in (100_000, 3):
        got = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontam.contamination(odd, items, slice_rows=rows).collect()}
        assert (1, 11, 10, ("a", "b")) in got and (None, 2, 2, ("b",)) in got and (2, 0, 0, ()) in got and (-7, 4, 0, ()) in got
        assert decontam.contamination(odd, items, slice_rows=rows).count() == 9
    assert decontam.contamination(nothing, items).count() == 0
    assert decontam.contamination(odd, items.limit(0)).filter("n_hit > 0").count() == 0


def test_katz_edges(odd, nothing):
    from pyspark.sql import functions as F

    got = katz.score(odd, F.col("doc_id") == 3).toPandas()
    assert len(got) == 9 and got[got.doc_id == 2].n_tokens.tolist() == [1] and (got.score <= 0).all() and np.isfinite(got.score).all()
    assert katz.score(nothing, F.lit(False)).count() == 0
    none = katz.score(odd, F.lit(True)).toPandas()
    assert (none.train_tokens == 0).all() and (none.score == 0).all()


def test_long_documents_continue_in_the_next_chunk(odd, monkeypatch):
    from pyspark.sql import functions as F

    from keyloom.llm import chunks

    whole = katz.score(odd, F.col("doc_id") == 5).toPandas().sort_values(["doc_id", "score"])
    monkeypatch.setattr(chunks, "CHUNK_TOKENS", 1000)
    cut = katz.score(odd, F.col("doc_id") == 5).toPandas().sort_values(["doc_id", "score"])
    assert np.allclose(whole.score, cut.score) and whole.n_tokens.tolist() == cut.n_tokens.tolist()


def test_passage_edges(spark, nothing):
    words = [f"w{i}" for i in range(120)]
    fuzzy = [w if i % 12 else "other" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, "lead in " + " ".join(fuzzy) + " end"), (3, None), (4, "short"), (5, " ".join(words)), (5, " ".join(words)), (None, " ".join(words)), (-6, "z " * 400)]
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).toPandas()
    assert {(a, b) for a, b in zip(got.doc_id, got.other_id, strict=True)} == {(2, 1), (5, 1)} and got.n_words.min() > 100
    assert passages.shared_passages(nothing).count() == 0


def test_join_edges(odd, nothing):
    got = lshforest.near_duplicates(odd).toPandas()
    assert sorted(got.doc_id) == [-7, 1, 2, 3, 4, 5, 6] and (got.n_links == 0).all() and (got.class_id == got.doc_id).all()
    assert lshforest.near_duplicates(nothing).count() == 0


def test_licence_edges(odd, nothing):
    assert licences.scan_licences(odd).count() == 9 and licences.scan_licences(nothing).count() == 0


def test_neighbour_edges(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (2, [0.0, 0.0], "c"), (3, None, "d"), (4, [1.0, None], "e"), (5, [float("nan"), 1.0], "f"), (6, [float("inf"), 1.0], "g"), (7, [0.5, 0.5], None), (100, [1.0, 0.0], "h"), (200, [1.0, 2.0, 3.0], "i"), (None, [1.0, 1.0], "j"), (8, [1.0, 0.0], "k"), (8, [1.0, 0.0], "k")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, vec string")
    got = vamana.search(df, k=3).toPandas().sort_values(["query_id", "rank"])
    assert got[got.query_id == 0].vec_id.tolist() == [1, 8, 100] and got[got.query_id == 100].vec_id.tolist() == [0, 1, 8] and 200 not in set(got.query_id)
    assert vamana.search(df, k=10).toPandas().groupby("query_id").size().tolist() == [4, 4]
    assert vamana.search(df.limit(0)).count() == 0


def test_passages_across_chunk_borders(spark, monkeypatch):
    """With small chunks: a passage where a chunk is full, and across the parts of a long document and of its hub."""
    from keyloom.llm import chunks

    monkeypatch.setattr(chunks, "CHUNK_TOKENS", 2048)
    passage = [f"p{i}" for i in range(60)]

    def text(d, n, at):
        w = [f"d{d}w{i}" for i in range(n)]
        w[at:at] = passage
        return " ".join(w)

    step = 2048 - passages.OVERLAP
    for lengths, places in (([2018, 300, 500], [None, 0, 100]), ([5000, 5000, 400], [2018, step - 30, 200]), ([5000, 5000, 400], [2 * step + 5, 2048 - 30, 0])):
        rows = [(d, " ".join(f"d{d}w{i}" for i in range(n)) if at is None else text(d, n, at)) for d, (n, at) in enumerate(zip(lengths, places, strict=True))]
        found = passages.shared_passages(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()
        held = [d for d, at in enumerate(places) if at is not None]
        want = {(d, places[d], 60, held[0], places[held[0]], 60) for d in held[1:]}
        assert {tuple(r)[:6] for r in found} == want


@pytest.mark.parametrize("n", [60, 80])
def test_passages_with_many_substitutions(spark, n):
    """Passages with 10 to 18 % of their words changed: nearly all are found."""
    rng = np.random.RandomState(n)
    rows, d = [], 0
    for k in range(300):
        passage = [f"p{k}w{i}" for i in range(n)]
        other = list(passage)
        for i in 1 + rng.choice(n - 2, int(n * (0.10, 0.15, 0.18)[k % 3]), replace=False):
            other[i] = f"x{k}w{i}"
        for w in (passage, other):
            rows.append((d, " ".join([*(f"a{d}w{i}" for i in range(30)), *w, *(f"b{d}w{i}" for i in range(30))])))
            d += 1
    got = {(r["doc_id"], r["other_id"]) for r in passages.shared_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got <= {(d, d - 1) for d in range(1, len(rows), 2)}
    for part in range(3):
        caught = [(2 * k + 1, 2 * k) in got for k in range(part, 300, 3)]
        assert sum(caught) >= 95


def test_licences_by_the_nearest_template():
    s = licences.scanner(0.9)
    gnu = "# This {0} is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
    two = licences.TEXTS["BSD-3-Clause"].split("Neither")[0]
    for name, text in [
        ("AGPL-3.0", gnu.format("program", "Affero General Public License", 3)),
        ("LGPL-3.0", gnu.format("program", "Lesser General Public License", 3)),
        ("LGPL-2.1", gnu.format("library", "Lesser General Public License", 2.1)),
        ("GPL-3.0", gnu.format("program", "General Public License", 3)),
        ("GPL-2.0", gnu.format("program", "General Public License", 2)),
        ("BSD-2-Clause", two),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
         " If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
        ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute"
         " this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
        ("CC0-1.0", "// SPDX-License-Identifier: CC0-1.0"),
        ("AGPL-3.0", "// SPDX-License-Identifier: AGPL-3.0-or-later"),
        ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ]:
        found = s.scan("code before\n" + text + "\nand after")
        assert [x[1] for x in found] == [name], (name, found)
    for name, text in licences.default_templates():
        best = s.scan(text)
        assert best and max(best)[1] == name, (name, text, best)


def test_forest_prefix_follows_the_text():
    """Small sets reach few similarities, so their prefixes stay longer; brute force over all other sizes agrees."""
    for n in range(1, 40):
        reach = [c / (n + m - c) for m in range(1, 80) for c in range(min(n, m) + 1) if 0.8 <= c / (n + m - c) < 1]
        least = lshforest.least_similarity(n, 0.8)
        assert (least is None) == (not reach) and (least is None or abs(least - min(reach)) < 1e-12)
    got = lshforest.matched_prefix(np.array([3, 4, 6, 7, 500, 5000]), 24, 8, 0.8, 0.999)
    assert got.tolist() == [0, 6, 7, 8, 6, 6]

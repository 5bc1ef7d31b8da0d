"""Findings of round 3: links beside the hubs."""

import random
import re

import numpy as np

from keyloom.llm import passages


def _words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(n)]


def _changed(rng, words, at):
    return [("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) if i in at else w) for i, w in enumerate(words)]


def _found(spark, texts):
    return passages.shared_passages(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(1)).collect()


def test_links_beside_the_hub(spark):
    rng = random.Random(4)
    base = _words(rng, 100)
    left, right = set(range(7, 100, 14)), set(range(3, 100, 14))
    far, other = ({i for i in range(100) if i % 25 in some} for some in ((9, 10, 11, 12), (20, 21, 22, 23)))
    again = _words(rng, 100)
    around = lambda words: " ".join(_words(rng, 40) + words + _words(rng, 40))
    texts = {1: around(base), 2: around(_changed(rng, base, left)), 3: around(_changed(rng, base, right))}
    # the hub 11 agrees with 12, and 12 with 13, but 11 does not with 13
    texts |= {11: around(_changed(rng, again, far)), 12: around(again), 13: around(_changed(rng, again, other)), 14: around(_words(rng, 100))}
    got = _found(spark, texts)
    assert {(r.doc_id, r.other_id) for r in got} == {(2, 1), (3, 1), (3, 2), (12, 11), (13, 12)}
    assert {(r.doc_id, r.n_links) for r in got} == {(2, 2), (3, 2), (12, 2), (13, 1)}
    for r in got:
        a, b = (texts[d].split()[at : at + n] for d, at, n in ((r.doc_id, r.start, r.n_words), (r.other_id, r.other_start, r.other_words)))
        assert min(len(a), len(b)) >= 50 and sum(x == y for x, y in zip(a, b, strict=True)) >= 0.8 * len(a)


def test_many_variants_are_counted(spark, monkeypatch):
    rng = random.Random(5)
    base = _words(rng, 80)
    texts = {d: " ".join(_words(rng, 30) + _changed(rng, base, {rng.randrange(80)}) + _words(rng, 30)) for d in range(1, 41)}
    texts |= {d: " ".join(_words(rng, 30) + base + _words(rng, 30)) for d in range(41, 44)}  # copies
    for block in (512, 16):
        monkeypatch.setattr(passages, "BLOCK", block)
        got = _found(spark, texts)
        assert {r.doc_id for r in got if r.other_id == 1} == set(range(2, 44))
        assert {r.n_links for r in got if r.other_id == 1} == {42}
        assert len(got) < 100


def test_stages_drop_rows_without_a_shuffle_of_texts(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from keyloom.llm import common

    rng = random.Random(6)
    texts = [" ".join(_words(rng, 60)) for _ in range(8)]
    texts += [texts[0], texts[1] + " more", texts[2]]
    rows = [(None if d == 4 else d, t, "en", "web", len(t)) for d, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    items = [(str(k), " ".join(texts[d].split()[5:20])) for k, d in enumerate((3, 4))]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where Spark guesses that there are many ids
    try:
        for few in (common.FEW_IDS, 0):
            monkeypatch.setattr(common, "FEW_IDS", few)
            for step, gone in ((corpus_pipeline.near_duplicates, {8, 9, 10}), (corpus_pipeline.decontaminate, {3, None})):
                left = step(spark, docs, str(tmp_path))
                assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(str(r[0]) for r in rows if r[0] not in gone)
                assert ("Exchange hashpartitioning" in left._jdf.queryExecution().executedPlan().toString()) == (few == 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_words_of_a_chunk_by_a_table(spark, monkeypatch):
    from pyspark.sql import functions as F

    from keyloom.llm import chunks

    rng = random.Random(7)
    monkeypatch.setattr(chunks, "CHUNK_TOKENS", 300)
    texts = [None, "", " ;", "a", "Ärger, x9A\x00b\x7fÉ", *(" ".join(rng.choices(["x", "Yz", "w7"], k=n)) for n in (198, 199, 200, 201, 299, 300, 301, 950, 40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").withColumn("held", F.lit(False)).coalesce(1)

    def read(split, overlap):
        out = []
        for r in chunks.chunked(docs, "bigint", split, overlap=overlap).collect():
            hashes, (row, held, _, n, place) = np.frombuffer(r.words, "<u8"), chunks.unpack(r.meta)
            out.append((r.ids, row.tolist(), held.tolist(), n.tolist(), place.tolist(), hashes[chunks.unpack(r.tokens)[0]].tolist()))
        return out

    for overlap in (0, 100):
        assert read(passages._BYTES, overlap) == read(lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.encode().lower()), overlap)


def test_chains_on_few_diagonals(monkeypatch):
    rng = random.Random(8)
    for _ in range(200):
        shifts = rng.sample(range(-20, 20), rng.randrange(2, 6))
        x, y = np.array(sorted({(at, at + rng.choice(shifts) + 30) for at in (rng.randrange(60) for _ in range(50))})).T
        monkeypatch.setattr(passages, "FEW_DIAGONALS", 12)
        few = passages.chain(x, y, 2)
        monkeypatch.setattr(passages, "FEW_DIAGONALS", 0)
        assert few == passages.chain(x, y, 2)

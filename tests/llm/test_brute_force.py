"""Each operator against a plain version of itself, over a whole small table."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from keyloom.llm import queries

from ..oracle import duck, spark_rows


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id")


def run(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).toPandas()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == duck(sf_dir, queries.ORACLES[name])


def whole_ids(path, texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    return [np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for t in texts]


def test_op1_pieces_and_sequences(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op1_packing")
    want = dict(zip(docs.doc_id, whole_ids(queries.vocabulary("word_bpe_49k.json"), docs.text), strict=True))
    for doc, p in got.groupby("doc_id"):
        at = 0
        for r in p.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want[doc]), zlib.crc32(want[doc][at : at + r.length].tobytes()))
            at += r.length
        assert at == len(want[doc])
    for _, p in got.groupby("sequence_id"):
        p = p.sort_values("offset")
        assert list(p.offset) == [0, *p.length.cumsum()[:-1]] and p.length.sum() <= 4096
    tokens = sum(map(len, want.values()))
    assert set(got.doc_id) == set(want) and got.sequence_id.nunique() <= math.ceil(tokens / 4096) + 1


def test_op4_files_hold_all_ids(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op4_token_binary").set_index("doc_id")
    at = 0
    for doc, ids in zip(docs.doc_id, whole_ids(queries.vocabulary("byte_bpe_50k.json"), docs.text), strict=True):
        r = got.loc[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(docs)


def test_op3_held_out_accuracy(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op3_language_id").merge(docs[["doc_id", "lang"]], on="doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())
    assert (got.lang == got.lang_pred)[got.held_out].mean() > 0.97 and got.lang_rejected.mean() < 0.01


def test_op3_rejects_what_it_has_not_learned(spark, docs):
    """Gibberish and other languages in Latin letters are rejected, labelled texts held out of the fit are not."""
    from keyloom.llm import langid

    rng = np.random.RandomState(0)

    def letters(alphabet):
        return " ".join("".join(rng.choice(list(alphabet), rng.randint(2, 10))) for _ in range(150))

    odd = [
        letters("abcdefghijklmnopqrstuvwxyz"),
        letters("bcdfghjklmnpqrstvwxz"),
        letters("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"),
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. " * 3,
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " * 3,
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. " * 3,
    ]
    table = spark.createDataFrame(docs[["doc_id", "text", "lang"]])
    model = langid.fit(table.filter("doc_id % 4 <> 1"))
    got = langid.identify(spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string"), model).toPandas()
    assert got.lang_rejected.all(), got
    held = langid.identify(table.filter("doc_id % 4 = 1"), model).toPandas()
    assert held.lang_rejected.mean() < 0.03


def katz_by_hand(texts, held):
    def words(t):
        return [*(t or "").encode().lower().split(), b"\n</s>"]

    start, split = b"\n<s>", {d: words(t) for d, t in texts.items()}
    one, two = collections.Counter(), collections.Counter()
    for d, w in split.items():
        if not held[d]:
            one.update(w)
            two.update(zip([start, *w[:-1]], w, strict=True))
    total, types = sum(one.values()), len(one)

    def discount(counts):
        n = collections.Counter(min(c, 7) for c in counts.values())
        d, share = [1.0] * 6, 6 * n[6] / n[1] if n[1] else 0
        for r in range(1, 6):
            v = ((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share) if n[r] and share != 1 else 0
            d[r] = v if 0 < v < 1 else (r - 0.5) / r
        return lambda c: d[c] if c <= 5 else 1.0

    d1, d2 = discount(one), discount(two)
    p1 = {w: d1(c) * c / (total + 1) for w, c in one.items()}
    unknown, hist = 1 - sum(p1.values()), dict(one) | {start: sum(not h for h in held.values())}
    seen, mass = collections.defaultdict(float), collections.defaultdict(float)
    for (h, w), c in two.items():
        seen[h] += d2(c) * c / (hist[h] + 0.01)
        mass[h] += p1[w]
    back = {h: (1 - seen[h]) / (1 - mass[h]) for h in seen}

    def p2(h, w):
        c = two.get((h, w), 0)
        return d2(c) * c / (hist[h] + 0.01) if c else back.get(h, 1.0) * p1.get(w, unknown)

    return split, one, total, types, p1, unknown, p2, start


def test_op5_scores_and_normalisation(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op5_katz_scores").set_index("doc_id")
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs.doc_id}
    split, one, total, types, p1, unknown, p2, start = katz_by_hand(dict(zip(docs.doc_id, docs.text, strict=True)), held)
    for d, w in split.items():
        r = got.loc[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in one for x in w), total, held[d])
        assert math.isclose(r.base_score, sum(math.log10((one.get(x, 0) + 1) / (total + types + 1)) for x in w), abs_tol=1e-6)
        assert math.isclose(r.score, sum(math.log10(p2(h, x)) for h, x in zip([start, *w[:-1]], w, strict=True)), abs_tol=1e-6)
    for h in (start, *list(one)[:3], b"never seen"):
        assert math.isclose(sum(p2(h, w) for w in p1) + p2(h, b"unknown word"), 1.0, abs_tol=1e-9)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_op2_finds_every_repeated_passage(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op2_shared_passages")
    find = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    words = {d: find(t.encode().lower()) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    holders = collections.defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - 49):
            holders[tuple(w[i : i + 50])].add(d)
    repeated = set().union(*(h for h in holders.values() if len(h) > 1))
    assert repeated <= set(got.doc_id) | set(got.other_id)
    for r in got.itertuples():
        a, b = words[r.doc_id][r.start : r.start + r.n_words], words[r.other_id][r.other_start : r.other_start + r.other_words]
        assert min(len(a), len(b)) >= 50 and r.other_id < r.doc_id
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                row[j], prev = (prev + 1 if x == y else max(row[j], row[j - 1])), row[j]
        assert row[-1] >= 0.8 * max(len(a), len(b))


def test_op8_finds_every_notice(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op8_licence_scan").set_index("doc_id")
    stated = docs.text.str.contains("licensed under|released under the", case=False)
    assert (got.loc[docs.doc_id].n_licences.to_numpy() > 0).tolist() == stated.tolist()


def test_op9_recall_and_scores(spark, sf_dir):
    got = run(spark, sf_dir, "op9_nearest_neighbours")
    v = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    v = v[v.embedding.notna()]
    x, ids = np.stack(v.embedding.to_numpy()).astype(float), v.vec_id.to_numpy()
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        r = got[got.query_id == ids[q]].sort_values("rank")
        assert list(r["rank"]) == list(range(1, 11)) and np.allclose(r.score, [d[np.flatnonzero(ids == i)[0]] for i in r.vec_id], rtol=1e-13)
        hits, total = hits + len(set(r.vec_id) & set(ids[np.lexsort((ids, d))[:10]])), total + 10
    assert hits / total >= 0.9


def jaccard_classes(texts):
    find, lower = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(t):
        w = find((t or "").translate(lower))
        n = min(5, len(w))
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()

    sets, first, rep = {d: shingles(t) for d, t in texts.items()}, {}, {}
    for d in sorted(sets):
        rep[d] = first.setdefault(sets[d], d) if sets[d] else d
    holders, both = collections.defaultdict(list), collections.Counter()
    for d in sorted(set(rep.values())):
        for s in sets[d]:
            holders[s].append(d)
    for h in holders.values():
        both.update(itertools.combinations(h, 2))
    parent, links = {d: d for d in sets}, collections.Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in both.items():
        if c / (len(sets[a]) + len(sets[b]) - c) >= 0.8:
            links.update((a, b))
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {d: (root(rep[d]), rep[d], links[rep[d]]) for d in sets}


def test_op10_classes_and_links(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op10_jaccard_join")
    assert {r.doc_id: (r.class_id, r.rep_id, r.n_links) for r in got.itertuples()} == jaccard_classes(dict(zip(docs.doc_id, docs.text, strict=True)))


def test_op10_large_runs_are_settled(spark, monkeypatch):
    """A group of near copies too large for all pairs: classes are those of brute force."""
    from keyloom.llm import lshforest

    rng = np.random.RandomState(3)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for d in range(90):
        w = list(base)
        for i in rng.choice(60, rng.randint(0, 4), replace=False):
            w[i] = f"x{rng.randint(1000)}"
        texts[d] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = {d: c[0] for d, c in jaccard_classes(texts).items()}
    for limit in (32, 4):
        monkeypatch.setattr(lshforest, "ALL_PAIRS", limit)
        got = {r["doc_id"]: r["class_id"] for r in lshforest.near_duplicates(df).collect()}
        assert got == want


def test_op10_large_runs_count_all_links(spark, monkeypatch):
    """A group of 90 near copies beside other texts: all links of brute force are counted, in one block or many."""
    from keyloom.llm import lshforest

    rng = np.random.RandomState(5)
    texts = {}
    for d in range(110):
        w = [f"w{i}" if d < 90 else f"d{d}w{i}" for i in range(200)]
        for i in rng.choice(200, rng.randint(0, 3), replace=False):
            w[i] = f"x{rng.randint(1000)}"
        texts[d] = " ".join(w)
    texts[110] = texts[100] + " more"
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = jaccard_classes(texts)
    assert max(c[2] for c in want.values()) > 40
    for block, hot in ((4096, 20_000), (16, 20_000), (16, 50)):
        monkeypatch.setattr(lshforest, "BLOCK", block)
        monkeypatch.setattr(lshforest, "HOT_RUN", hot)
        got = {r["doc_id"]: (r["class_id"], r["rep_id"], r["n_links"]) for r in lshforest.near_duplicates(df).collect()}
        assert got == want


def test_pipeline_by_its_parts(spark, sf_dir, docs):
    import corpus_pipeline
    from keyloom.llm.common import Stage

    stage, frame, seen = Stage(spark, "test"), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        frame = stage.put(str(k), step(spark, frame, sf_dir))
        seen.append((name, frame))
    for _, f in seen[:-1]:
        assert f.columns == corpus_pipeline.COLUMNS
    kept = [{r["doc_id"]: r["text"] for r in f.select("doc_id", "text").collect()} for _, f in seen[:-1]]
    assert set(kept[0]) == set(docs.doc_id)
    assert set(kept[1]) == set(kept[0])
    assert set(kept[2]) == {d for d, c in jaccard_classes(kept[1]).items() if c[0] == d}
    leaked = {r["doc_id"] for r in queries.decontam.contamination(seen[2][1], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("n_hit > 0").collect()}
    assert leaked and set(kept[3]) == set(kept[2]) - leaked
    assert {r["doc_id"] for r in seen[-1][1].select("doc_id").distinct().collect()} == set(kept[3])

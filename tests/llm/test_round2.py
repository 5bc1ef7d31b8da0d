"""Cases that the first version got wrong, and operators recomputed plainly."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from keyloom.llm import langid, queries, vamana
from keyloom.llm.tokens import WordCachedEncoder


@pytest.mark.parametrize(("name", "cut"), [("word_bpe_49k.json", "drop"), ("byte_bpe_50k.json", "lead")])
def test_ids_of_every_common_character(name, cut):
    """Each letter below U+0250 and what its case leads to: alone, between letters, and beside punctuation."""
    e = WordCachedEncoder(queries.vocabulary(name), cut)
    chars = sorted({x for c in map(chr, range(0x250)) for x in c + c.lower() + c.upper()})
    texts = [t for c in chars for t in (c, f"a{c}b", f'the "{c}man" is here', f"{c}!", f"1{c}2", f"{c}{c} x", f"({c})'s", f"{c}e is a name")]
    want = [np.asarray(x.ids, dtype="<u4").tobytes() for x in e.tk.encode_batch(texts, add_special_tokens=False)]
    assert [next(e.encode_many([t])) for t in texts] == want
    assert list(e.encode_many(texts)) == want


def test_torn_pieces_go_to_the_library(monkeypatch):
    """Where the library cuts elsewhere than the pattern, whole texts are encoded, then and later."""
    import re

    e = WordCachedEncoder(queries.vocabulary("word_bpe_49k.json"), "drop")
    e.find = re.compile(r"\S+").findall
    texts = ['say "so", now', "plain words", "(a)"]
    want = [np.asarray(x.ids, dtype="<u4").tobytes() for x in e.tk.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert list(e.encode_many(texts)) == want
    assert not e.cache.new


def test_letters_only_make_a_language(spark):
    model = langid.fit(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur le lit", "fr")] * 20)], "doc_id bigint, text string, lang string"))
    rows = list(enumerate(["½ ² Ⅷ", "①②", "½", "Ⅷ", "12_3", "", None, "½ le chat est sur le lit ②"]))
    got = langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["und"] * 7 + ["fr"]
    assert all(r["score"] == 0 and r["lang_rejected"] for r in got[:7])


def test_all_labels_are_learned(spark):
    rows = [(i, f"some words of text {i}", "en" if i % 2 else f"x{i}") for i in range(1200)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), max_sample=300, features=256)
    assert len(model.langs) == 601
    with pytest.raises(ValueError):
        langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), features=langid.MODEL_BYTES // 400)


def test_language_vectors_recomputed_plainly(spark, sf_dir):
    """Counts, TF-IDF, cosine, choice and rejection in plain Python, for whole texts."""
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")[["doc_id", "text", "lang"]].iloc[:150]
    frame = spark.createDataFrame(docs)
    model = langid.fit(frame)
    got = langid.identify(frame, model).toPandas().set_index("doc_id")
    column = {int(b): i for i, b in enumerate(model.keep)}

    def bucket(gram):
        """The hash of 1 to 3 code points, 32 bits wide."""
        h = ord(gram[0]) * 0x9E3779B1 % 2**32
        for c in gram[1:]:
            h = ((h ^ (h >> 15)) * 0x85EBCA77 + ord(c) * 0xC2B2AE3D) % 2**32
        return h >> 17

    for r in docs.itertuples():
        clean = "".join(c if c.isalpha() else " " for c in (r.text or "").lower())
        clean = " ".join(clean.split())
        if not clean:
            assert got.loc[r.doc_id].lang_pred == "und"
            continue
        clean = f" {clean} "
        counts, total = {}, 0
        for n in (1, 2, 3):
            for i in range(len(clean) - n + 1):
                b = bucket(clean[i : i + n])
                counts[b], total = counts.get(b, 0) + 1, total + 1
        vector = {column[b]: math.log1p(c) * float(model.idf[column[b]]) for b, c in counts.items() if b in column}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        cosines = [sum(float(c[i]) * x for i, x in vector.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        own = got.loc[r.doc_id]
        assert math.isclose(own.score, max(0.0, min(1.0, cosines[best])), abs_tol=1e-4)
        if sorted(cosines)[-1] - sorted(cosines)[-2] > 1e-4:
            assert own.lang_pred == model.langs[model.owner[best]]
        limit = model.limits[model.owner[best]][min(int(math.log2(max(total / 3, 1))), langid.LENGTHS - 1)]
        if abs(1 - own.score - limit) > 1e-4:
            assert own.lang_rejected == (1 - own.score > limit)


def test_neighbours_at_any_scale(spark):
    """Very large and very small components give the ids and ranks of plain ones, and right distances."""
    rng = np.random.RandomState(4)
    x = rng.randint(-50, 50, (400, 6)).astype(float)
    x[7] = x[3]
    want = None
    for scale in (1.0, 2.0**515, 2.0**-565, 2.0**1000):
        rows = [(i, [float(c) for c in v * scale]) for i, v in enumerate(x)]
        got = vamana.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), query_every=50, shard_rows=150).toPandas().sort_values(["query_id", "rank"])
        ranks = list(zip(got.query_id, got["rank"], got.vec_id, got.score / scale, strict=True))
        want = want or ranks
        assert ranks == want and len(ranks) == 80
    exact = {(q, i): math.dist(x[q], x[i]) for q, _, i, _ in want}
    assert all(math.isclose(s, exact[q, i], rel_tol=1e-14) for q, _, i, s in want)


def test_neighbours_beyond_the_range_of_doubles(spark):
    rows = [(0, [1.7e308, 0.0]), (1, [-1.7e308, 0.0]), (2, [1.7e308, 1.0]), (100, [1e-300, 1e-300])]
    got = vamana.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=3).toPandas().sort_values(["query_id", "rank"])
    assert got[got.query_id == 0].vec_id.tolist() == [2, 100, 1] and got[got.query_id == 0].score.tolist() == [1.0, 1.7e308, math.inf]
    assert sorted(got[got.query_id == 100].vec_id) == [0, 1, 2] and (got[got.query_id == 100].score == 1.7e308).all()


def test_token_files_spread_repeated_and_null_ids(spark):
    """One id, and null ids, in a third of the rows each: order, places and ids hold, and no shard has all of them."""
    from keyloom.llm import tokenbin
    from keyloom.llm.common import Stage

    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {i} " * (i % 7)) for i in range(600)]
    path = Stage(spark, "test").path("blocks")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    tokenbin.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), path, queries.vocabulary("byte_bpe_50k.json"))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    files = spark.read.parquet(path).collect()
    assert max(len(r["doc_ids"]) for r in files) < 200 and len({r["shard"] for r in files}) > 3
    got = tokenbin.read_tokens(spark, path).orderBy("start").collect()
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()[:-1]]
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))


def test_contamination_by_many_items(spark):
    """A window of many items, in one pass and in many: ids are joined to verified places."""
    from keyloom.llm import decontam

    items = spark.createDataFrame([(f"i{k:03}", "one two three four") for k in range(200)] + [("z", "five six")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "so one two three four it is"), (2, "five six"), (2, "five six"), (3, None), (4, "one two four")], "doc_id bigint, text string")
    for rows in (100_000, 1):
        got = sorted((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"])) for r in decontam.contamination(docs.repartition(3), items, slice_rows=rows).collect())
        assert got == [(1, 7, 4, 200), (2, 2, 2, 1), (2, 2, 2, 1), (3, 0, 0, 0), (4, 3, 0, 0)]


def _texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_passages_whose_seeds_stood_in_fragments_before(spark):
    """Documents 1 and 2 hold 40 words each of a passage of 80 that only 3 and 4 hold whole."""
    from keyloom.llm import passages

    p = [f"p{i}" for i in range(80)]
    rows = [(1, " ".join([*p[:40], *(f"a{i}" for i in range(30))])), (2, " ".join([*(f"b{i}" for i in range(30)), *p[40:]])), (3, " ".join(["c1", "c2", *p, "c3"])), (4, " ".join(p + [f"d{i}" for i in range(30)]))]
    got = [tuple(r)[:6] for r in passages.shared_passages(_texts(spark, rows)).collect()]
    assert got == [(4, 0, 80, 3, 2, 80)]


def test_passages_among_many_partial_holders(spark):
    """Passages, with up to 12 % of their words changed, made of stock sentences that stand alone in earlier documents."""
    from keyloom.llm import passages

    rng = np.random.RandomState(9)
    stock = [[f"s{k}w{i}" for i in range(12)] for k in range(60)]
    rows = [(d, " ".join([*(f"a{d}x{i}" for i in range(20)), *stock[d % 60], *(f"b{d}x{i}" for i in range(20)), *stock[(7 * d + 1) % 60]])) for d in range(200)]
    want = []
    for k in range(100):
        passage = [w for s in rng.choice(60, 5, replace=False) for w in stock[s]]
        for half in range(2):
            own = list(passage)
            if half:
                for i in 1 + rng.choice(58, rng.randint(0, 8), replace=False):
                    own[i] = f"y{k}w{i}"
            d = 1000 + 2 * k + half
            rows.append((d, " ".join([*(f"c{d}x{i}" for i in range(25)), *own, *(f"e{d}x{i}" for i in range(25))])))
        want.append((1001 + 2 * k, 1000 + 2 * k))
    got = passages.shared_passages(_texts(spark, rows)).collect()
    pairs = {(r["doc_id"], r["other_id"]) for r in got}
    caught = sum(p in pairs for p in want)
    print("caught", caught, "of", len(want), "rows", len(got))
    assert caught >= 95 and all(r["n_words"] >= 50 and r["similarity"] >= 0.8 for r in got)


def _licences_by_hand(text, templates, threshold):
    """All windows between common bigrams, the best end of each beginning, then the best that do not overlap."""
    from collections import Counter

    from keyloom.llm import licences

    words = licences.words_of(text)
    grams = list(itertools.pairwise(words))
    found = []
    for name, template in templates:
        own = Counter(itertools.pairwise(licences.words_of(template)))
        b = sum(own.values())
        places = [i for i, g in enumerate(grams) if g in own]
        for n, i in enumerate(places):
            best, counts, common = None, Counter(), 0
            for j in places[n:]:
                counts[grams[j]] += 1
                common += counts[grams[j]] <= own[grams[j]]
                dice = 2 * common / (j - i + 1 + b)
                if best is None or dice > best[0] + 1e-12:
                    best = (dice, j - i + 1)
            if best and best[0] >= threshold - 1e-12:
                found.append((-best[0], -b, name, i, best[1] + 1))
    taken = []
    for dice, _, name, start, n in sorted(found):
        if all(start + n <= s or s + m <= start for s, m, _, _ in taken):
            taken.append((start, n, name, -dice))
    return sorted(taken)


def test_licences_recomputed_plainly():
    from keyloom.llm import licences

    rng = np.random.RandomState(2)
    vocabulary = [f"v{i}" for i in range(25)]
    for threshold in (0.6, 0.9):
        for _ in range(60):
            templates = [(f"t{k}", " ".join(rng.choice(vocabulary, rng.randint(2, 12)))) for k in range(6)]
            words = list(rng.choice(vocabulary, 40))
            for k in rng.randint(0, 6, 4):
                at = rng.randint(len(words))
                words[at:at] = templates[k][1].split()[rng.randint(0, 2) :]
            got = [(s, n, name, d) for d, name, s, n in licences.Scanner(templates, threshold).scan(" ".join(words))]
            want = _licences_by_hand(" ".join(words), templates, threshold)
            assert [round(x[3], 9) for x in got] == [round(x[3], 9) for x in want], (got, want)


def test_whole_licences_with_changes():
    """Whole texts, cut, changed here and there, and beside prose, are found as the nearest licence."""
    from keyloom.llm import licences

    rng = np.random.RandomState(1)
    s = licences.scanner(0.9)
    for name, text in licences._from_files():
        words = text.split()
        for share in (0.0, 0.03):
            some = [w if rng.rand() >= share else "changed" for w in words]
            found = s.scan("Prose goes before it. " + " ".join(some) + " And prose goes after it.")
            if share and len(words) < 100:
                continue
            assert found and max(found)[1] == name and max(found)[0] > 0.9, (name, share, found[:3])
    assert [x[1] for x in s.scan("Released under the MIT License. Some prose. " * 3000)] == ["MIT"] * 3000


# The pipeline's stages on odd tables.

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def odd_corpus(spark):
    prose = {"en": "the quick brown fox jumps over the lazy dog and runs away from the old house near the river ", "de": "der schnelle braune Fuchs springt über den faulen Hund und läuft weg vom alten Haus am Fluss "}
    rows = [(i, prose["en" if i % 2 else "de"] + f"number {i} of many texts with words w{i} x{i} y{i} z{i}", "en" if i % 2 else "de", "s", 1) for i in range(40)]
    rows += [(50, None, None, None, None), (51, "", "en", "s", 0), (None, prose["en"] + "a text without an id", "en", None, 5), (None, prose["en"] + "a text without an id", "en", None, 5), (52, "?! 12", "de", "s", 3)]
    rows += [(7, rows[7][1], "en", "s", 1), (60, (prose["en"] + "word ") * 8000, "en", "s", 9), (61, "\n".join(["one line"] * 3 + ["another line of it"]), "en", "s", 9)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def benchmark_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    items = [("i1", "fuchs springt über den faulen hund und läuft weg vom alten haus"), (None, "x"), ("i2", None)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def test_pipeline_stages_on_odd_tables(spark, odd_corpus, benchmark_dir):
    import corpus_pipeline as p

    language, lines, near, clean, pack = (f for _, f in p.STAGES)
    kept = language(spark, odd_corpus, benchmark_dir)
    assert kept.columns == p.COLUMNS
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert 50 not in ids and 51 not in ids and 52 not in ids and ids.count(None) == 2 and ids.count(7) == 2 and 60 in ids
    left = lines(spark, odd_corpus, benchmark_dir)
    assert left.columns == p.COLUMNS and left.count() == odd_corpus.count() and left.filter("text is null").isEmpty()
    assert left.filter("doc_id = 61").first()["n_chars"] == len("one line\n" * 3 + "another line of it")
    one = near(spark, odd_corpus, benchmark_dir)
    got = [r["doc_id"] for r in one.select("doc_id").collect()]
    assert one.columns == p.COLUMNS and got.count(None) == 2 and got.count(7) == 2 and {50, 51, 52, 60, 61} <= set(got)
    free = clean(spark, odd_corpus, benchmark_dir)
    gone = {r["doc_id"] for r in odd_corpus.collect()} - {r["doc_id"] for r in free.collect()}
    assert free.columns == p.COLUMNS and gone == {i for i in range(40) if i % 2 == 0}
    packed = pack(spark, odd_corpus, benchmark_dir)
    assert packed.filter("start = 0").count() == odd_corpus.count() and packed.filter("doc_id = 60").count() > 20


def test_pipeline_stages_on_empty_tables(spark, odd_corpus, benchmark_dir):
    import corpus_pipeline as p

    for _, stage in p.STAGES:
        assert stage(spark, odd_corpus.limit(0), benchmark_dir).count() == 0


def test_clashing_columns(spark):
    """Operators keep or ignore further columns whose names they use themselves."""
    from keyloom.llm import decontam, licences, lshforest, packing, passages, tokenbin

    rows = [(i, f"some words of text {i} here", "x", "y", i, "z") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, id string, chunk string, words bigint, n string")
    df = df.withColumns({c: df["n"] for c in ("key", "sig", "held", "hash", "t1", "_t1", "found", "_found", "items", "_row", "start", "length", "other_id", "n_lines", "lang_pred", "shard")})
    tok = queries.vocabulary("word_bpe_49k.json")
    assert lshforest.near_duplicates(df).count() == 5 and passages.shared_passages(df).count() == 0 and licences.scan_licences(df).count() == 5
    assert packing.pack_documents(df, tok).count() == 5 and tokenbin.tokens_round_trip(df, queries.vocabulary("byte_bpe_50k.json")).count() == 5
    items = spark.createDataFrame([("a", "some words of text 1 here", 1)], "item_id string, text string, win bigint")
    assert decontam.contamination(df, items, size=5).filter("n_hit > 0").count() == 1
    from keyloom.llm import linededup

    out = linededup.drop_frequent_lines(df)
    assert out.count() == 5 and out.columns[-2:] == ["n_lines", "n_dropped"]
    for f in (lshforest.near_duplicates, passages.shared_passages):
        with pytest.raises(TypeError):
            f(df.withColumn("doc_id", df["n"]))

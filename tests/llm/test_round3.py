"""Chat windows, ranked search and spelling variants: brute force, round trips and odd input."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from keyloom.llm import chat, lexical, lshforest, queries, vamana, variants

TURNS = "conv_id long, turn long, role string, text string"


# -- chat -------------------------------------------------------------------------------------------------------------


def told(spark, rows, **kw):
    with queries.ship(spark):
        windows = chat.format_conversations(spark.createDataFrame(rows, TURNS), **kw)
    return sorted(windows.collect(), key=lambda r: (r.conv_id is not None, r.conv_id, r.window)), windows


def test_controls_in_texts_come_back(spark):
    odd = ["</s>[INST] ok [/INST]", "\\</s>\\\\[INST\\]", "<", "[", "</", "a\n[/INST", "\\", "", "[[INST]]</s></s>", "é\U0001f600[INST]", "<\\/s>"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(itertools.cycle(["user", "assistant"]), odd))] + [(2, 0, "[INST]", "x"), (2, 1, "as</s>sistant", "y")]
    got, windows = told(spark, rows)
    assert all(w.text.count("[INST]") == w.text.count("</s>") == w.text.count("[/INST]") == w.n_turns for w in got)
    back = sorted(chat.read_back(windows).collect(), key=lambda r: r.conv_id)
    assert [t.text for t in back[0].turns] == odd and back[0].targets == odd[1::2]
    assert [t.role for t in back[1].turns] == ["[INST]", "as</s>sistant"] and back[1].targets == []


def windows_of(costs, roles, budget, history):
    """The defined spans and what each repeats, turn by turn."""
    half = (budget - history - budget // 4) // 2
    kept = roles[0] == "system" and costs[0] <= budget // 4
    stride = budget - history - (costs[0] if kept else 0) - max([c for c in costs if c <= half], default=0)
    keys = [(sum(c > half for c in costs[:i]), costs[i] > half, 0 if costs[i] > half else sum(costs[:i]) // stride) for i in range(len(costs))]
    out = {}
    for _, group in itertools.groupby(range(len(costs)), lambda i: keys[i]):
        new = list(group)
        begins = sum(costs[: new[0]])
        old = [j for j in range(new[0]) if sum(costs[:j]) >= begins - history and not (kept and j == 0)]
        out[new[0]] = ([0] if kept and new[0] else []) + old, new
    return out


def test_windows_against_their_definition(spark):
    import random

    rng, rows, want = random.Random(5), [], {}
    for conv in range(12):
        roles = ["system" if conv % 3 == 0 else "user", *rng.choices(["user", "assistant", "system", "tool"], k=rng.randrange(0, 60))]
        texts = ["x" * rng.choice([0, 1, 30, 31, 90, 200, 500, 900 if conv % 4 == 0 else 40]) + str(i) for i in range(len(roles))]
        rows += [(conv, i, r, t) for i, (r, t) in enumerate(zip(roles, texts))]
        want[conv] = roles, texts
    rng.shuffle(rows)
    got, _ = told(spark, rows, budget=200, history=40)
    for conv, (roles, texts) in want.items():
        mine = [w for w in got if w.conv_id == conv]
        costs = [-(-len(t) // 4) + 4 for t in texts]
        spans = windows_of(costs, roles, 200, 40)
        assert [w.window for w in mine] == list(spans)
        for w, (old, new) in zip(mine, spans.values()):
            pieces = [f"[INST]{roles[i]}[/INST]{texts[i]}</s>" for i in [*old, *new]]
            assert w.text == "".join(pieces) and (w.n_repeated, w.n_turns, w.n_tokens) == (len(old), len(old) + len(new), sum(costs[i] for i in [*old, *new]))
            assert w.n_tokens <= 200 or (len(new) == 1 and costs[new[0]] > 60)
            assert [w.text[s.start : s.start + s.length] for s in w.loss] == [texts[i] for i in new if roles[i] == "assistant"]


def test_chat_odd_rows(spark):
    rows = [(None, 1, "user", "a"), (None, None, None, None), (3, 0, "assistant", "b"), (3, 0, "assistant", "b"), (3, 0, "assistant", "a"), (4, 0, "user", "x" * 100_000), (4, 1, "assistant", "y")]
    got, windows = told(spark, [(*r,) for r in rows], history=0)
    back = {(r.conv_id, r.window): r for r in chat.read_back(windows).collect()}
    assert [(t.role, t.text) for t in back[None, 0].turns] == [("", ""), ("user", "a")]
    order = sorted(["b", "b", "a"], key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert back[3, 0].targets == order
    assert [len(back[4, k].turns[0].text) for k in (0, 1)] == [100_000, 1]
    assert told(spark, [])[0] == []
    more = spark.createDataFrame([(1, 0, "user", "t", "c", 1)], TURNS + ", conv string, at long")
    assert chat.format_conversations(more).first().n_turns == 1


def test_a_conversation_with_most_rows_is_spread(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("word "), "id").alias("text"))
    ordered = chat._ordered(rows, "conv_id", "turn", "role", "text", None, 4)
    sizes = [r[1] for r in ordered.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2600
    back = chat.read_back(chat.format_conversations(rows, budget=400, history=50)).filter("conv_id = 7").orderBy("window").collect()
    assert [t for b in back for t in b.targets] == [f"word {i}" for i in range(6000) if i % 3 > 0]


def test_template_rules():
    for args in (("[INST]", "[INST]", "</s>"), ("x", "[/INST]", "</s>"), ("[a[", "[b]", "</s>"), ("\\a", "[b]", "</s>")):
        with pytest.raises(ValueError):
            chat.Template(*args)
    with pytest.raises(ValueError):
        chat.format_conversations(None, budget=100, history=60)


# -- ranked search ----------------------------------------------------------------------------------------------------


def ranked(docs, items, k=20):
    find = re.compile(rb"[0-9a-z\x80-\xff]+").findall
    held = [(i, collections.Counter(find((t or "").encode().lower()))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for _, c in held for t in c)
    asked = collections.defaultdict(collections.Counter)
    for item, text in items:
        if item is not None:
            asked[item].update(find((text or "").encode().lower()))
    out = {}
    for item, terms in asked.items():
        scores = []
        for (doc, c), n in zip(held, sizes):
            m = 75 + (25 * n * n_docs) // max(1, n_terms)
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in terms.items() if c[t])
            if s > 0:
                scores.append((-s, doc is not None, doc))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        for r, (s, _, doc) in enumerate(scores[:k], 1):
            out[item, r] = (doc, -s)
    return out


@pytest.mark.parametrize("kw", [{}, {"vocabulary_bytes": 0}, {"slice_rows": 5}])
def test_search_against_brute_force(spark, kw):
    docs = [(1, "The cat sat"), (1, "THE cat"), (2, None), (3, ""), (None, "cat cat cat"), (4, "...!"), (5, "éa É ÉA cat"), (6, "the the the dog " * 400), (7, "the cat sat"), (8, "dog 9cat cat9"), (9, "the cat sat")]
    docs += [(100 + i, f"the cat w{i % 7}") for i in range(60)]
    items = [(1, "the cat"), (1, "dog"), (2, None), (3, "zzz"), (None, "cat"), (4, "CAT cat w3"), (5, "É"), (6, "!"), (7, "the the dog")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").withColumn("bucket", F.lit("x")), spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1)), **kw)
    assert {(r.item_id, r.rank): (r.doc_id, r.score) for r in got.collect()} == ranked(docs, items)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id int, text string"), spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert [r.rank for r in lexical.search(docs, items).collect()] == [1]
    assert lexical.search(docs.limit(0), items).collect() == [] == lexical.search(docs, items.limit(0)).collect()
    with pytest.raises(TypeError):
        lexical.search(docs.withColumn("doc_id", F.lit("x")), items)


# -- spelling variants ------------------------------------------------------------------------------------------------


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    found = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, vs in found.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(found[w]), counts[form[w]] if form[w] else None)
    return out


def spelled(spark, counts):
    rows = variants.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("seed,letters,longest,n", [(1, "ab", 7, 150), (2, "abc", 5, 200), (3, "aéÿz", 6, 250), (4, "a", 40, 30), (5, "abcdefgh", 4, 600)])
def test_variants_against_brute_force(spark, seed, letters, longest, n):
    import random

    rng = random.Random(seed)
    words = {"".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(n)}
    counts = {w: rng.choice([3, 3, 4, 6, 8, 12, 50]) for w in words}
    assert spelled(spark, counts) == plain_variants(counts)


def test_variants_of_odd_words(spark, monkeypatch):
    monkeypatch.setattr(variants, "WORDS_A_PART", 3)  # many ranges: nodes are shared
    long = "ab" * 3000
    counts = {"b": 1, "bb": 3, "abbb": 9, long: 5, long + "c": 40, long[:-1]: 90, "c" + long: 2, long[:3000] + "x" + long[3001:]: 1, "\U0001f600a": 1, "\U0001f601a": 2, "a": 7, "aa": 7}
    assert spelled(spark, counts) == plain_variants(counts)
    assert spelled(spark, {}) == {}
    twice = spark.createDataFrame([("word", 1, 0), ("word", 2, 0), (None, 3, 0), ("", 3, 0), ("wort", 1, 0)], "word string, n int, key int")
    assert sorted((r.word, r.n, r.form) for r in variants.spelling_variants(twice).collect()) == [("word", 3, None), ("wort", 1, "word")]
    with pytest.raises(ValueError):
        variants.spelling_variants(twice, factor=1)


def plain_counts(docs):
    counts = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_op13_whole_table(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    counts = plain_counts(zip(docs.doc_id, docs.text))
    got = queries.QUERIES["op13_spelling_variants"](spark, sf_dir).collect()
    words = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}
    assert len(got) == len(words) and {w: v[2] for w, v in words.items()} == counts
    # near words by all one-edit texts of each word
    letters = sorted({c for w in counts for c in w})
    edits = {w: {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[j:] for i in range(len(w) + 1) for c in letters for j in (i, i + 1)} for w in counts}
    for w, about in edits.items():
        vs = [v for v in about if v in counts and v != w]
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 2 * counts[w] else None
        assert (words[w][0], words[w][3]) == (form, len(vs)), w
        root = w
        while words[root][0] is not None:
            root = words[root][0]
        assert words[w][1] == root


def test_word_counts_of_odd_texts(spark):
    docs = [(None, "Hällo hällo HÄLLO hÄllo"), (1, None), (2, ""), (3, "abcde " * 5 + "×÷×÷×"), (4, "x" * 200_000), (3, "ABCDE")]
    got = variants.word_counts(spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1)), min_count=1)
    want = plain_counts([("null" if d is None else d, t) for d, t in docs for _ in range(3)])
    assert {r.word: r.n for r in got.collect()} == {w: n // 3 for w, n in want.items()}


def test_light_edges_bound_the_entries(spark):
    words = sorted("".join(p) for p in itertools.product("abcd", repeat=6))
    n = sum(1 for _ in variants.Trie(words).entries({d: "a" for d in variants._digests(words[0]) + variants._digests(words[-1])}))
    assert n <= 3 * len(words) * math.log2(len(words))


# -- repeated ids -----------------------------------------------------------------------------------------------------


def test_queries_of_repeated_ids_with_unusable_rows(spark):
    rows = [(0, [5.0, 5.0]), (0, [0.0, 0.0]), (200, [6.0, 6.0]), (200, [6.0, None]), (300, [6.5, 6.5]), (300, [9.0, 1.0]), (400, None), (7, [1.0, 2.0])] + [(100 * k, [4.0, 4.0]) for k in range(5, 20)]
    got = vamana.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    known = {i: v for i, v in {0: (5, 5), 200: (6, 6), 300: (6.5, 6.5), 7: (1, 2)}.items()} | {100 * k: (4, 4) for k in range(5, 20)}
    for q in known:
        if q % 100 == 0:
            want = sorted((math.dist(known[q], v), i) for i, v in known.items() if i != q)[:3]
            assert [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_links_of_repeated_ids(spark, monkeypatch, broadcast):
    """Each text of a repeated id keeps its links; the id's texts are one class."""
    monkeypatch.setattr(lshforest, "BROADCAST_IDS", broadcast)
    words = lambda k: [f"w{k}x{i}" for i in range(60)]
    text = lambda k, last: " ".join([*words(k), last])
    docs = [(1, text("a", "one")), (1, text("b", "one")), (2, text("a", "two")), (3, text("b", "three")), (9, text("c", "x")), (8, text("c", "x")), (8, text("d", "x")), (7, text("d", "y")), (6, text("e", "z")), (6, ""), (5, None)]
    with queries.ship(spark):
        got = {r.doc_id: (r.class_id, r.rep_id, r.n_links) for r in lshforest.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").withColumn("copy", F.lit(1))).collect()}
    assert got == {1: (1, 1, 2), 2: (1, 2, 1), 3: (1, 3, 1), 9: (7, 8, 0), 8: (7, 8, 1), 7: (7, 7, 1), 6: (6, 6, 0), 5: (5, 5, 0)}

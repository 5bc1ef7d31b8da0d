"""Memory of a Python worker, told from the functions that the operators hand to Spark."""

import tracemalloc

import pyarrow as pa

from keyloom.llm import langid


def test_fit_holds_the_counts_of_few_texts(spark, monkeypatch):
    """A batch of a worker has up to 10,000 rows, and a text's counts are 256 KB before empty buckets are left out."""
    frame = spark.createDataFrame([(i, f"the cat {i} sat on the mat", "en") for i in range(30)] + [(99, "12", "en")], "doc_id bigint, text string, lang string")
    handed = []
    plain = type(frame).mapInArrow

    def spy(self, f, *a, **b):
        handed.append(f)
        return plain(self, f, *a, **b)

    monkeypatch.setattr(type(frame), "mapInArrow", spy)
    model = langid.fit(frame)
    assert model.langs == ["en"]

    texts = ["one two three", "12 !", None, *(f"the cat sat on mat {'x' * (i % 7)}" for i in range(1000))]
    batch = pa.record_batch({"text": pa.array(texts, pa.string()), "lang": ["en"] * len(texts), "draw": pa.array(range(len(texts)), pa.int64())})
    tracemalloc.start()
    made = pa.Table.from_batches(list(handed[0](iter([batch]))))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20
    assert made.column("draw").to_pylist() == list(range(len(texts)))
    assert made.column("at").to_pylist()[1:3] == [b"", b""]
    for k in (0, 3, 500, 1002):
        c = langid.ngram_counts(texts[k])
        own = c.nonzero()[0]
        assert made.column("at")[k].as_py() == own.astype("<u2").tobytes() and made.column("n")[k].as_py() == c[own].astype("<u4").tobytes()


def test_fit_starts_no_python_for_its_limits(spark, monkeypatch):
    """The limits of the draw come from an Arrow table: rows of Python are read by workers besides those of the operators."""
    frame = spark.createDataFrame([(i, f"the cat {i} sat on the mat", "en") for i in range(30)], "doc_id bigint, text string, lang string")
    given = []
    plain = type(spark).createDataFrame

    def spy(self, data, *a, **b):
        given.append(type(data))
        return plain(self, data, *a, **b)

    monkeypatch.setattr(type(spark), "createDataFrame", spy)
    langid.fit(frame)
    assert given == [pa.Table]

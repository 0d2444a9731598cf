"""Many equal rows: the de Bruijn operator stays linear, and no language is lost."""
import time

from passkit.llm import debruijn, langid
from pyspark.sql import functions as F


def test_equal_rows_are_removed_in_linear_time(spark, make_docs):
    text = " ".join(f"w{k}" for k in range(200))
    took = {}
    for n in (300, 3000):
        docs = make_docs([(1, text)] * n + [(2, "other words " * 3), (3, None)])
        start = time.time()
        got = debruijn.remove_repeats(docs).collect()
        took[n] = time.time() - start
        assert len(got) == n + 2 and all((r["n_words"], r["n_removed"], r["text"]) == (200, 200, "") for r in got if r["doc_id"] == 1)
        assert [r["n_removed"] for r in got if r["doc_id"] == 2] == [0]
    assert took[3000] < 4 * took[300] + 10


def test_places_of_equal_rows_are_listed_once(spark):
    rows = spark.createDataFrame([(1, 5, 0, 7)] * 50 + [(1, 5, 9, 2)] * 50, "id long, th long, first int, n int")
    got = debruijn._by_document(rows, "first", "n").collect()
    assert len(got) == 1 and sorted(tuple(p) for p in got[0]["places"]) == [(0, 7), (9, 2)]


def test_a_language_of_one_repeated_text_is_learned(spark, make_docs):
    german = ["Der Hund läuft über die Straße", "Wir gehen heute nicht zur Schule", "Das Wetter ist schön und warm"]
    english = [f"the quick brown fox number {'abcdefghij'[k % 10] * 3} jumps over the lazy dog" for k in range(50)]
    for k, text in enumerate(german):
        docs = make_docs([(i, text, "de") for i in range(2000)] + [(5000 + i, t, "en") for i, t in enumerate(english)])
        model = langid.learn(docs, F.lit(True))
        assert model.langs == ["de", "en"], text
        if not k:
            got = langid.identify(make_docs([(1, "Die Schule und der Hund"), (2, "the dog jumps over"), (3, None), (4, "123")]), model)
            assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {1: "de", 2: "en", 3: "und", 4: "und"}

"""Queries that must take every row, whatever its language."""

from __future__ import annotations

from types import SimpleNamespace

from sparkloom.plans import placement, text


def test_word_count_of_all_languages(spark):
    docs = spark.createDataFrame([("One two", "en"), ("two  drei", "de"), ("Two", None), (None, "fr")], "text string, lang string")
    assert [tuple(r) for r in text.word_count_all(SimpleNamespace(documents=docs)).collect()] == [("two", 3), ("drei", 1), ("one", 1)]


def test_hot_cold_union_keeps_the_null_key(spark):
    for nulls in (1, 5):
        rows = [(k, "en", 1) for k in range(6)] + [(6, "de", 10)] + [(7 + k, None, 100) for k in range(nulls)]
        docs = spark.createDataFrame(rows, "doc_id long, lang string, n_chars long")
        got = {r.lang: r.total for r in placement.hot_cold_union(SimpleNamespace(documents=docs)).collect()}
        assert got == {"en": 6, "de": 10, None: 100 * nulls}

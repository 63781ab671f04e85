"""Odd rows and clashing names, for every operator that hands rows on and every stage of the pipeline."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import chat, decontaminate, licenses, media, mixing, near, pii, quality, simhash, toxicity, warc
from sparkloom.llm.shared import fresh, materialise, release, temporary

#: Names that operators use inside, or return, and one with a dot and a quote.
NAMES = (
    "row own u salt size source_size target copies taken copy t_salt t_source t_null _m0 _p0 _base _all _text _ordered spans n_email fp fp_0 mine marks ident kept_id kept_fp node root key "
    "component_id place score label predicted held_out item_id distance start stop license found media offsets n_bytes a.b c`d"
).split()
PROSE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega and some more words to go on with here"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, very long, tied, repeated and near rows, with a column of every clashing name."""
    texts = [(1, PROSE), (2, PROSE), (2, PROSE), (3, PROSE + " call +12345678901 or mail a@b.com"), (None, None), (4, ""), (4, None), (5, "w\n" * 200_000 + "x" * 300_000), (6, "quick brown fox jumps over")]
    rows = [(i, t, ("a", None)[n % 2], "en", len(t or "")) for n, (i, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    return materialise(df.select("*", *[F.lit(f"v {n}").alias(n) for n in NAMES]), "odd")


def same_rest(out, given, but=()):
    """The columns of given come back in order, the clashing ones with their values."""
    assert [c for c in out.columns if c not in but] == [c for c in given.columns if c not in but]
    rows = out.collect()
    assert all(r[n] == f"v {n}" for r in rows for n in NAMES if n not in but)
    return rows


STAGES = {name: stage for name, stage in corpus_pipeline.STAGES}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_of_any_name(spark, sf_dir, odd, name):
    rows = same_rest(STAGES[name](spark, odd, sf_dir), odd, ("copy",))
    assert len(rows) <= 2 * odd.count()
    assert STAGES[name](spark, odd.limit(0), sf_dir).count() == 0


def test_results_replace_what_they_are_named_like(spark, odd):
    model = pii.fit(odd)
    found = pii.report(odd, model)
    assert [c for c in found.columns if c not in pii.OUT] == [c for c in odd.columns if c not in pii.OUT]
    assert {r.doc_id: r.n_phone for r in found.where("doc_id = 3").collect()} == {3: 1} and all(r["_m0"] == "v _m0" for r in found.collect())
    mixed = mixing.mix(odd)
    assert [c for c in mixed.columns if c not in mixing.OUT] == [c for c in odd.columns if c not in mixing.OUT]
    rows = mixed.collect()
    assert len(rows) == odd.count() and all(r["u"] == "v u" and r["t_salt"] == "v t_salt" and r["a.b"] == "v a.b" for r in rows)
    assert sum(r.size for r in rows if r.doc_id == 5) == 200_001


def test_readers_of_id_and_text_ignore_the_rest(spark, odd):
    n = odd.count()
    assert simhash.near_duplicates(odd).count() == n
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(odd).collect()}[2] == 1
    stored = media.store(odd)
    assert stored.count() == n and {r.payload_bytes for r in media.read(stored).where("doc_id = 4").collect()} == {64}
    assert licenses.scan(odd).count() == 0
    assert [r.doc_id for r in decontaminate.contaminated(odd, spark.createDataFrame([(9, "quick brown fox jumps")], "item_id long, text string")).collect()] == [6]
    for module in (quality, toxicity):
        assert module.score(odd, 0.25).where("score = 0.25").count() == n


def test_near_copies_fall_and_rows_without_an_id_stay(odd):
    for keep in (near.keep_one, simhash.keep_one):
        rows = same_rest(keep(odd), odd)
        assert sorted((r.doc_id or 0) for r in rows if r.doc_id != 3) == [0, 1, 4, 5, 6]


def test_chat_and_captures_keep_columns_of_any_name(spark):
    names = [n for n in NAMES if n != "turns"]
    records = spark.createDataFrame([(1, '{"prompt": "p", "response": "r"}'), (2, None)], "conv_id long, record string").select("*", *[F.lit(f"v {n}").alias(n) for n in ("parts", "begins", *names)])
    out = chat.render(chat.canonical(records))
    assert out.columns[: len(records.columns)] == records.columns and all(r["parts"] == "v parts" and r["c`d"] == "v c`d" for r in out.collect())
    rows = [(1, None, None, "response", {"etag": "x"}), (2, "http://x", 5, "response", {"etag": "x" * 100_000}), (3, "http://x", 9, "revisit", {"etag": "x" * 100_000}), (3, "http://x", 9, "revisit", {"etag": "x" * 100_000})]
    captures = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>").select("*", *[F.lit(f"v {n}").alias(n) for n in ("slice", "inner", "carried", "full", "tie", *NAMES)])
    got = warc.resolve(captures).collect()
    assert sorted((r.record_id, r.outcome, r.refers_to) for r in got)[2:] == [(3, "resolved", 2)] * 2 and all(r["full"] == "v full" and r["row"] == "v row" for r in got)


def by_definition(text):
    """The fingerprint of a text in lower case, from counts of its shingles of three words."""
    words = text.lower().split()
    counts = Counter(" ".join(words[k : k + 3]) for k in range(len(words) - 2))
    hashes = [(xxhash.xxh64_intdigest(s.encode(), 42), n) for s, n in counts.items()]
    return sum(1 << b for b in range(64) if 2 * sum(n for h, n in hashes if h >> b & 1) > counts.total())


def test_very_long_texts_count_whole(spark):
    """What stands at the end of two million characters is found."""
    long = "plain words go on and on " * 80_000
    items = spark.createDataFrame([(1, "an unusual passage of a benchmark that ends it all")], "item_id long, text string")
    docs = spark.createDataFrame([(1, long + "an unusual passage of a benchmark that ends it all"), (2, long + "Released under the MIT License. mail me@x.org"), (3, long)], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(docs, items).collect()] == [1]
    assert [(r.doc_id, r.license) for r in licenses.scan(docs).collect()] == [(2, "MIT")]
    assert {r.doc_id: r.n_email for r in pii.report(docs, pii.fit(docs)).collect()} == {1: 0, 2: 1, 3: 0}
    assert {r.doc_id: r.payload_bytes - 64 < r.n_bytes <= r.payload_bytes for r in media.read(media.store(docs)).collect()} == dict.fromkeys((1, 2, 3), True)
    assert {r.doc_id: r.size for r in mixing.mix(docs.withColumn("source", F.lit("s"))).collect()}[3] == 480_000
    fps = {r.doc_id: r.fp % 2**64 for r in simhash.near_duplicates(docs).collect()}
    assert fps == {r.doc_id: by_definition(r.text) for r in docs.collect()}


def test_scratch_tables_go(spark):
    with temporary():
        made = materialise(spark.range(3), "gone")
        path = made.scratch_path
        assert made.count() == 3
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert not files.exists(where)
    kept = materialise(spark.range(3), "kept")
    release(kept, None)
    assert fresh(["A", "a_0"], "a", "b") == ["a_1", "b"]

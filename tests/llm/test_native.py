"""Personal data, chat formatting, mixing, revisits: brute force, oracles and odd rows."""

from __future__ import annotations

import hashlib
import json
import random
import re
import time

import pytest
from compare import same
from pyspark.sql import functions as F

from sparkloom.llm import chat, mixing, pii, warc
from sparkloom.llm.queries import ORACLES, QUERIES

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    checks = (
        lambda m: True, lambda m: all(int(x) <= 255 for x in m[0].split(".")), lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m)), lambda m: 8 <= len(digits(m)) <= 15,
    )
    return [[m.span() for m in re.finditer(p, text or "") if ok(m)] for p, ok in zip(PLAIN, checks)]


TRICKY = [
    None, "", "a@b.c_x@d.e.f", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4", "4111 1111-1111 1111 5", "card 4111111111111111, tel +49 (30) 1234-567.", "\U0001f600 me@é.x me@x.y",
    "+1 (((", "a" * 50_000 + "@b.c", "1 " * 20_000, "+1-2 +12345678 +1234567890123456", "@@ a@b a@b. a@-.-", "10.0.0.1@x.y", "4072783015161058 and 40727830151610580",
]


@pytest.mark.parametrize("folder", [None, "sf0.001"])
def test_base_spans_equal_plain_patterns(spark, folder):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string") if folder is None else spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.report(docs, pii.fit(docs)).collect():
        want = base_spans(texts[r.doc_id])
        listed = [f"{k}:{a}:{b}" for k, s in zip(pii.KINDS, want) for a, b in s]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(s) for s in want], texts[r.doc_id][:80]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(","))or not listed


def test_loose_spans_and_masking(spark):
    rows = [(1, "call me at (212) 555-0199 or mail jo at host dot org, ip 9.8.7.6", 0), (2, "mail a@b.com 10.1.2.3", 0), (3, "version 1.2.3.4", 0), (4, None, 4), (5, "plain text", 10)]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, n_chars long")
    model = pii.fit(docs)
    found = {r.doc_id: r.spans for r in pii.report(docs, model).collect()}
    assert "phone:11:25" in found[1] and "email:34:52" in found[1]
    masked = {r.doc_id: (r.text, r.n_chars) for r in pii.mask(docs, model).collect()}
    assert masked[2] == ("mail <EMAIL> <IP>", 17) and masked[4] == (None, 4) and masked[5] == ("plain text", 10)
    assert masked[1][0] == "call me at <PHONE> or mail <EMAIL>, ip <IP>"
    clash = docs.withColumn("spans", F.lit(1)).limit(0)
    assert pii.report(clash, pii.fit(clash)).count() == 0


def test_blocks_of_spans_change_nothing(spark, monkeypatch):
    """Blocks of two spans, of 256, and a plain replacement agree, overlaps at a block's end included."""
    texts = ["a@b.c 1.2.3.4@x.y " * 9 + "end", "1.2.3.4@x.y", "+12345678 10.0.0.1@x.y " * 5 + "\U0001f600 \U0001f600 1.1.1.1", *TRICKY, "u@v.w 9.9.9.9, " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit(docs)
    answers = []
    for size in (2, 256):
        monkeypatch.setattr(pii, "BLOCK", size)
        answers.append(([r.spans for r in pii.report(docs, model).orderBy("doc_id").collect()], [r.text for r in pii.mask(docs, model).orderBy("doc_id").collect()]))
    assert answers[0] == answers[1]
    for text, listed, masked in zip(texts, *answers[0]):
        at, want = 0, ""
        for start, stop, kind in sorted((int(a), int(z), pii.KINDS.index(k)) for k, a, z in (x.split(":") for x in listed.split(",") if x)):
            if start >= at:
                want += text[at:start] + f"<{pii.KINDS[kind].upper()}>"
            at = max(at, stop)
        assert masked == (None if text is None else want + text[at:])


def test_loose_spans_that_touch_base_ones_go(spark, monkeypatch):
    """The blocks of base spans leave out what comparing all pairs leaves out."""
    texts = ["555-123-4567@x.y 555-123-4567, " * 40, "555-123-4567", "a@b.c " * 9 + "(555) 123-4567 555-123-4567@x.y 10.0.0.1", *TRICKY]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (2, 256):
        monkeypatch.setattr(pii, "BLOCK", size)
        kept = {r.row.doc_id: [(s.start, s.stop) for s in r._loose] for r in pii.candidates(docs).collect()}
        base = {r.row.doc_id: [(s.start, s.stop) for s in r._base] for r in pii.candidates(docs).collect()}
        assert [len(kept[n]) for n in range(3)] == [40, 1, 1]
        assert not any(a < z and b < y for n in kept for a, y in kept[n] for b, z in base[n])


def test_expectation_maximisation_trusts_what_agrees():
    names = pii.LABELERS
    rows = [dict(zip(names, v)) | {"kind": 0, "length": 3, "form": 2, "n": n} for v, n in (((1, 1, 1, 0, 0), 500), ((0, -1, -1, 0, -1), 300), ((1, 1, -1, 0, 0), 20), ((0, -1, 1, 0, 0), 20))]
    rates, post = pii.estimate(rows)
    assert post[0] > 0.95 and post[1] < 0.05 and rates["structure", 1, 1] > rates["gazetteer", 1, 1] > 0.8


def test_layouts_become_turns(spark):
    records = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        "sharegpt": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "instruction": {"instruction": "q", "output": "a"},
        "prompt": {"prompt": "q", "response": "a"},
        "completion": {"completion": "a", "prompt": "q"},
        "question": {"question": "q", "answer": "a"},
    }
    odd = [json.dumps({"what": 1}), "not json", None, "{}", json.dumps({"messages": []})]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in records.items()] + [(f"odd{n}", x) for n, x in enumerate(odd)], "name string, record string")
    for r in chat.canonical(df).collect():
        turns = [(t.role, t.text) for t in r.turns]
        assert (r.layout, turns) == ((r.name, [("user", "q"), ("assistant", "a")]) if r.name in records else (None, []))
    nested = {"nested_prompt": {"data": {"prompt": "q", "response": "a"}}, "dialogue": {"data": {"id": 7, "dialogue": {"items": [{"speaker": "user", "utterance": "q"}, {"speaker": "model", "utterance": "a"}]}}}}
    for r in chat.canonical(spark.createDataFrame([(k, json.dumps(v)) for k, v in nested.items()], "name string, record string")).collect():
        assert (r.layout, [(t.role, t.text) for t in r.turns]) == (r.name, [("user", "q"), ("assistant", "a")])
    extra = json.dumps({"instruction": "q", "output": "a", "input": "i", "system": "s"})
    got = chat.canonical(spark.createDataFrame([(extra,)], "record string")).first()
    assert [(t.role, t.text) for t in got.turns] == [("system", "s"), ("user", "q"), ("user", "i"), ("assistant", "a")]


def test_field_paths_at_any_depth(spark):
    deep = {"a": [{"b": {"c": [[{"d": 1}], [{"e": None}]]}}, {"f": "x"}], "g h": {"i": []}, 'k"q': "v: \"z\\", "s": '{"no": [1]}'}
    want = ["a", "a[].b", "a[].b.c", "a[].b.c[][].d", "a[].b.c[][].e", "a[].f", "g h", "g h.i", "k~q", "s"]
    rows = [(json.dumps(deep),), (json.dumps(deep, indent=1),), ('[{"x": 1}]',), ("",), (None,)]
    got = [r.p for r in spark.createDataFrame(rows, "r string").select(chat.field_paths(F.col("r")).alias("p")).collect()]
    assert got == [want, want, ["[].x"], [], []]


def test_a_turn_beyond_the_json_readers_limit_is_kept(spark):
    rows = spark.range(2).select(
        F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("ab"), 10_500_000).alias("text")
    )
    got = chat.digest(chat.render(chat.canonical(chat.records_of(rows)))).first()
    text = "ab" * 10_500_000
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (2, 21_000_000, hashlib.sha256(text.encode()).hexdigest())
    assert got.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_conversations_are_dealt_over_all_list_layouts(spark, sf_dir):
    records = chat.canonical(chat.records_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    assert {r.layout for r in records.select("layout").distinct().collect()} == {k.name for k in chat.LAYOUTS if k.turns}


def test_blocks_of_loss_spans_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(1, json.dumps({"turns": [{"role": ("user", "assistant")[k % 2], "text": "x" * k} for k in range(23)]})), (2, "{}")], "conv_id long, record string")
    found = []
    for size in (1, 4, 256):
        monkeypatch.setattr(chat, "BLOCK", size)
        found.append([(r.formatted, r.loss) for r in chat.render(chat.canonical(df)).orderBy("conv_id").collect()])
    assert found[0] == found[1] == found[2] and len(found[0][0][1]) == 11


def test_render_and_parse_give_turns_back(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\.", "\\\\.</s", "<", "", "[INS[INST]T]", "a\né\U0001f600 </s></s>", "[/INST]" * 500, " [/INST]x"]
    turns = [{"role": r, "text": t} for t in texts for r in ("user", "assistant", "[INST]", "")]
    df = spark.createDataFrame([(1, json.dumps({"turns": turns})), (2, json.dumps({"turns": [{"role": "user", "text": "x"}]}))], "conv_id long, record string")
    out = chat.render(chat.canonical(df)).withColumn("back", chat.parse(F.col("formatted"))).withColumn("learned", chat.learned(F.col("formatted"), F.col("loss")))
    row = out.where("conv_id = 1").first()
    assert [(t.role, t.text) for t in row.back] == [(t["role"], t["text"]) for t in turns]
    assert row.learned == "".join(texts) and len(row.loss) == len(texts)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(name, spark, sf_dir, duck):
    same(QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df())


def test_conversations_odd_rows(spark):
    rows = [(1, None, None, None, 5), (1, 0, "assistant", None, 5), (1, 0, "assistant", "b", 5), (1, 0, "assistant", "b", 5), (None, 2, "user", "u", 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record int")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digest(chat.render(chat.canonical(chat.records_of(df)))).collect()}
    assert got == {1: (4, 2), None: (1, 0)}
    assert chat.digest(chat.render(chat.canonical(chat.records_of(df.limit(0))))).count() == 0


def test_roles_are_read_back_as_written(spark):
    """Names that some layouts have for user and assistant stay where a conversation uses them itself, whatever layout it is dealt to."""
    said = ("human", "gpt", "user", "assistant", "", "bot", "Human", "prompter", "model", "tool")
    plain = ("user", "assistant", "system", "tool")
    rows = [(c, n, r, f"{r} {n}") for c in range(60) for n, r in enumerate(said if c % 2 else plain)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = chat.canonical(chat.records_of(df))
    assert {r.layout for r in records.where("conv_id % 2 = 0").select("layout").distinct().collect()} == {k.name for k in chat.LAYOUTS if k.turns}
    got = {r.conv_id: r for r in chat.digest(chat.render(records)).collect()}
    for c in range(60):
        mine = [(r, t) for k, _, r, t in rows if k == c]
        learned = "".join(t for r, t in mine if r in chat.LEARNED)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_mix(spark):
    words = lambda n: "w " * n
    rows = [(i, words(10), s, 1) for i in range(400) for s in ("a",)] + [(1000 + i, words(5), "b", 1) for i in range(20)] + [(2000, None, None, 1), (None, words(50), None, 1), (3000, "", "c", 1), (3000, "", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows)
    by = {r.source: r for r in mixed}
    assert by["a"].source_size == 4000 and by["b"].target == 200.0 and by["c"].target == 0.0 and by[None].target <= 100.0
    assert sum({r.source: r.target for r in mixed}.values()) == pytest.approx(1.5 * 4150)
    assert all(r.taken <= 2 * r.size for r in mixed)
    taken = sum(r.taken for r in mixed if r.source == "a")
    assert abs(taken - by["a"].target) < 0.1 * by["a"].target
    copies = mixing.emit(docs).collect()
    assert sum(len((r.text or "").split()) for r in copies) == sum(r.taken for r in mixed)
    assert sorted(map(str, copies)) == sorted(map(str, mixing.emit(docs).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_target_levels_by_iteration(spark):
    sizes = {f"s{k:02d}": (k * 7919) % 1000 + 1 for k in range(30)}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sorted(sizes))}
    capped, left = set(), 1.5 * sum(sizes.values())
    while True:
        level = (left - sum(2 * sizes[s] for s in capped)) / sum(w for s, w in weights.items() if s not in capped)
        over = {s for s in sizes if s not in capped and level * weights[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx({s: 2.0 * sizes[s] if s in capped else level * weights[s] for s in sizes})


def test_targets_of_many_sources(spark):
    """Thousands of sources, an empty one among them, by the oracle's SQL."""
    import duckdb

    docs = spark.range(6000).select("id", F.concat(F.lit("s"), (F.col("id") % 3000).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"))
    docs = docs.withColumnRenamed("id", "doc_id")
    documents = docs.toPandas()  # noqa: F841  read by name
    same(mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").toPandas(), duckdb.sql(mixing.ORACLE_SQL).df())


def test_canonical_urls(spark):
    pairs = [
        ("HTTP://www.Ex.com:80/a/?b=2&utm_source=x&a=1#top", "ex.com/a?a=1&b=2"), ("https://ex.com/a?a=1&b=2", "ex.com/a?a=1&b=2"), ("ex.com", "ex.com"),
        ("https://ex.com:8443/", "ex.com:8443"), (None, ""), ("", ""), ("https://ex.com/?ref=x", "ex.com"),
    ]
    df = spark.createDataFrame([(u,) for u, _ in pairs], "u string")
    assert [r.c for r in df.select(warc.canonical_url(F.col("u")).alias("c")).collect()] == [c for _, c in pairs]


def test_revisits(spark):
    full = lambda tag: {"etag": tag, "content-type": "t", "date": "1", "content-length": "9"}
    rows = [
        (1, "http://x/a", 10, "response", full("A")), (2, "https://x/a#f", 20, "revisit", {"etag": "W/A", "date": "2", "content-length": "0"}),
        (3, "http://x/a", 30, "response", full("B")), (4, "http://x/a", 30, "revisit", {"etag": "A"}), (5, "http://x/a", 31, "revisit", {"etag": "A"}),
        (6, "http://x/b", 5, "revisit", {"etag": "A"}), (7, "http://x/a", None, "revisit", {"etag": "A"}), (8, "http://x/c", 1, "response", {"last-modified": "m"}),
        (9, "http://x/c", 900, "revisit", {"last-modified": "m"}), (10, "http://x/c", 901, "revisit", None), (11, None, 7, "response", None), (12, None, 8, "revisit", {}),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "record_id long, url string, ts long, kind string, headers map<string,string>, outcome string")
    for slices in (1, 3, 64):
        got = {r.record_id: r for r in warc.resolve(df, slices).collect()}
        assert {k: (r.outcome, r.refers_to) for k, r in got.items() if r.kind == "revisit"} == {
            2: ("resolved", 1), 4: ("resolved", 1), 5: ("changed", None), 6: ("orphan", None), 7: ("orphan", None), 9: ("resolved", 8), 10: ("changed", None), 12: ("changed", None),
        }
        assert got[2].merged == {"etag": "W/A", "content-type": "t", "date": "2", "content-length": "9"}
    assert warc.resolve(df.limit(0)).count() == 0


def test_one_odd_time_does_not_gather_the_rest(spark):
    """Parts are cut in the whole order; repeated records and ids have one result."""
    rows = [(k, "http://x/a", 10**9 + k, "response" if k % 50 == 0 else "revisit", {"etag": str(k // 50)}) for k in range(2000)] + [(9000, "http://x/a", 0, "response", {"etag": "z"})]
    df = spark.createDataFrame(rows + rows[:60], "record_id long, url string, ts long, kind string, headers map<string,string>")
    got = warc.resolve(df, 16).collect()
    assert len(got) == len(rows) + 60 and all(r.outcome in ("full", "resolved") for r in got)
    assert all(r.refers_to == r.record_id // 50 * 50 for r in got if r.kind == "revisit")
    sizes = [r["count"] for r in warc.dealt(df, 16).groupBy("part").count().collect()]
    assert max(sizes) < 300


def test_a_url_with_half_of_all_records_is_dealt(spark):
    """Half of 100,000 records have one URL, a third of those one time: no part is over twice the median, and each revisit finds what a plain pass finds."""
    n = 100_000
    i = F.col("id")
    hot = i % 2 == 0
    url = F.when(hot, "http://x/hot").otherwise(F.concat(F.lit("http://x/"), (i % 9973).cast("string")))
    ts = F.when(hot & (i % 3 == 0), F.lit(50_000)).otherwise((i * 7919) % n).cast("long")
    kind = F.when(F.xxhash64("id") % 3 == 0, "response").otherwise("revisit")
    rows = spark.range(n).select(i.alias("record_id"), url.alias("url"), ts.alias("ts"), kind.alias("kind"), F.create_map(F.lit("etag"), (i % 2).cast("string")).alias("headers"))
    sizes = sorted(r["count"] for r in warc.dealt(rows, 20).groupBy("part").count().collect())
    assert len(sizes) == 20 and sizes[-1] < 2 * sizes[10]
    got = {r.record_id: (r.outcome, r.refers_to) for r in warc.resolve(rows, 20).select("record_id", "outcome", "refers_to").collect()}
    latest, want = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.ts, r.kind == "response", r.record_id)):
        if r.kind == "response":
            latest[r.url], want[r.record_id] = r, ("full", None)
        else:
            seen = latest.get(r.url)
            want[r.record_id] = ("orphan", None) if seen is None else ("resolved", seen.record_id) if seen.headers == r.headers else ("changed", None)
    assert got == want


def test_a_conversation_of_very_many_turns(spark):
    """Time grows with the text: 30,000 turns in seconds, with the digests of every one; pieces are cut inside control strings, escapes and characters of two units."""
    n = 30_000
    text = lambda k: f"\U0001f600 turn {k} </s> \\ [INST] " + "é" * (k % 97)
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("\U0001f600 turn "), F.col("id").cast("string"), F.lit(" </s> \\ [INST] "), F.repeat(F.lit("é"), (F.col("id") % 97).cast("int"))).alias("text"))
    began = time.time()
    got = chat.digest(chat.render(chat.canonical(chat.records_of(rows)))).first()
    loss = "".join(text(k) for k in range(1, n, 2))
    turns = "".join(f"{('user', 'assistant')[k % 2]}\n{text(k)}\n" for k in range(n))
    assert (got.n_turns, got.loss_chars) == (n, len(loss)) and got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert time.time() - began < 120


def card_like(rng, first):
    """A number of 15 digits that passes Luhn's check."""
    body = first + "".join(rng.choice("0123456789") for _ in range(12))
    return next(body + c for c in "0123456789" if luhn(body + c))


def test_added_spans_of_a_labelled_sample(spark):
    """Looser spans planted in sentences are all found; telephone-like numbers of orders and invoices are not taken for them."""
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    words = lambda text: rng.choice(text.split())
    planted = [
        lambda: ("phone", "please call ", f"({rng.randint(2, 9)}{digits(2)}) {rng.randint(2, 9)}{digits(2)}-{digits(4)}"), lambda: ("phone", "you reach us at ", f"{rng.randint(2, 9)}{digits(2)} {rng.randint(2, 9)}{digits(2)} {digits(4)}"),
        lambda: ("email", "write to ", f"{words('jo anna.b k_lee sam')} at {words('host example post')} dot {words('org com net de')}"), lambda: ("email", "", f"{words('jo anna.b')} [at] {words('host post')} [dot] {words('org de')}"),
        lambda: ("card", "paid by card ", card_like(rng, "37")), lambda: ("ip", "from server ", ":".join(f"{rng.randint(4096, 65535):x}" for _ in range(8))),
    ]
    decoys = [lambda: ("", "order number ", f"{rng.randint(100, 199)}-{rng.randint(100, 199)}-{digits(4)}"), lambda: ("", "invoice ", f"{rng.randint(100, 199)} {digits(3)} {digits(4)}")]
    rows, want = [], {}
    for k in range(600):
        kind, before, body = rng.choice(planted if rng.random() < 0.6 else decoys)()
        lead = "words go on " * rng.randint(0, 4) + before
        rows.append((k, f"{lead}{body} and so on"))
        want[k] = f"{kind}:{len(lead)}:{len(lead) + len(body)}" if kind else ""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.spans for r in pii.report(docs, pii.fit(docs)).collect()} == want

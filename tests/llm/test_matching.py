"""Decontamination and license scans against brute force."""

from __future__ import annotations

import random
import time
import tracemalloc
from collections import Counter

from sparkloom.llm import decontaminate, licenses
from sparkloom.llm.queries import QUERIES


def edits(pattern, text):
    """Smallest edit distance of a pattern to any substring, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_equals_the_plain_table():
    rng = random.Random(5)
    for _ in range(60):
        pattern, text = ("".join(rng.choice("abcé") for _ in range(rng.randint(1, n))) for n in (80, 90))
        want = edits(pattern, text)
        got = decontaminate.myers(pattern, text, len(pattern))
        assert got[0] == want
        k, start, stop = decontaminate.occurrence(pattern, text, len(pattern))
        assert k == want and edits(pattern, text[start:stop]) == want
        assert (decontaminate.myers(pattern, text, want - 1) is None) if want else True


def damaged(rng, text, n):
    letters = list(text)
    for _ in range(n):
        at = rng.randrange(len(letters))
        how = rng.randrange(3)
        letters[at : at + (how != 2)] = [rng.choice("xyz")] if how else []
    return "".join(letters)


def test_planted_passages_are_all_found():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghü") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(rng.randint(8, 16))) for k in range(6)]
    index = decontaminate.PieceIndex(items)
    docs, want = [], []
    for n in range(24):
        k, text = rng.choice(items)
        body = decontaminate.normal(prose(8) + " " + (damaged(rng, text, int(decontaminate.RATE * len(text))) if n % 2 else "") + " " + prose(8))
        docs.append(body)
        want += [(n, i) for i, t in items if edits(t, body) <= int(decontaminate.RATE * len(t))]
    got = [(d, index.items[i][0]) for d, i, *_ in index.search(docs)]
    assert got == sorted(want)
    for d, i, k, start, stop in index.search(docs):
        assert edits(index.items[i][1], docs[d][start:stop]) == k


def test_query_finds_what_contains_an_item(spark, sf_dir):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_pigeonhole_decontamination"](spark, sf_dir).where("distance = 0").collect()}
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert got == {(d.doc_id, i.item_id) for d in docs for i in items if decontaminate.normal(i.text) in decontaminate.normal(d.text)}


def test_query_finds_edited_items_too(spark, sf_dir):
    """Every document and item against Myers' distance over the whole text."""
    got = {(r.doc_id, r.item_id): r for r in QUERIES["op2_pigeonhole_decontamination"](spark, sf_dir).collect()}
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = {}
    for d in docs:
        text = decontaminate.normal(d.text)
        for i in items:
            item = decontaminate.normal(i.text)
            found = decontaminate.myers(item, text, int(decontaminate.RATE * len(item)))
            if found:
                want[d.doc_id, i.item_id] = found[0]
    assert {k: r.distance for k, r in got.items()} == want
    whole = {d.doc_id: d.text for d in docs}
    assert all(decontaminate.normal(whole[d][r.text_start : r.text_stop]) == decontaminate.normal(whole[d])[r.start : r.stop].strip() for (d, _), r in got.items())


def test_edited_passages_in_frames(spark):
    rng = random.Random(8)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(14))
    budget = int(decontaminate.RATE * len(item))
    rows = [(n, "İn  front\n" + damaged(rng, item, n) + "  behind") for n in range(2 * budget)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.distance for r in decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    want = {n: edits(decontaminate.normal(item), decontaminate.normal(t)) for n, t in rows}
    assert got == {n: k for n, k in want.items() if k <= budget} and len(set(got.values())) > 3


def test_places_in_the_text_itself():
    for text in ("  A\x00 b\t\nİc  ", "", "x", " \n", "Σας\u2003Y"):
        places = decontaminate.original_places(text)
        assert len(places) == len(decontaminate.normal(text))
        assert all(decontaminate.normal(text[a:z]) in ("", c, c.strip()) or c in text[a:z].lower() for (a, z), c in zip(places, decontaminate.normal(text)))


def test_places_asked_for_are_those_of_all():
    """Against a walk by characters; of ten million characters only what is asked for is held."""

    def by_characters(text):
        out, gap = [], -1
        for i, c in enumerate(text.replace("\x00", " ")):
            if c.isspace():
                gap = i if gap < 0 else gap
                continue
            if gap >= 0 and out:
                out.append((gap, i))
            gap = -1
            out += [(i, i + 1)] * len(c.lower())
        return out

    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("aBİ \n\x00\u2003\x1cΣß\u0085") for _ in range(rng.randrange(40)))
        whole = by_characters(text)
        assert len(whole) == len(decontaminate.normal(text)) and decontaminate.original_places(text) == whole
        some = [k for k in range(len(whole)) if rng.random() < 0.3]
        assert decontaminate.original_places(text, some) == [whole[k] for k in some]
    long = "Word  İx\n" * 1_200_000
    tracemalloc.start()
    got = decontaminate.original_places(long, [0, 4, 8, 9 * 1_200_000 - 2])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(0, 1), (4, 6), (8, 9), (len(long) - 2, len(long) - 1)]
    assert peak < 1 << 20


def test_decontaminate_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "The  QUICK brown\nfox jumps over it", 7), (3, "The  QUICK brown\nfox jumps over it", 7), (None, "ab", 1), (4, "x" * 200_000, 2)], "doc_id long, text string, distance int")
    items = spark.createDataFrame([(1, "quick brown fox jumps"), (2, None), (3, ""), (4, "quick brown fox jumps"), (5, "ab")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id, r.distance, r.start) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(-1, 5, 0, 0)] + [(3, 1, 0, 4)] * 2 + [(3, 4, 0, 4)] * 2
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [1, 2, 4]
    assert decontaminate.clean(docs, items).columns == docs.columns
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert len(list(decontaminate.blocks(items, 25))) == 2


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT-permission"]
    changed = mit.replace("free of charge", "gratis").replace("copy, modify,", "copy,")
    docs = [(1, f"x\n{mit}\ny"), (2, changed.upper()), (3, "Released under the MIT License. And Released under the MIT License!"), (4, None), (5, ""), (6, "Nothing of the kind under the sun"), (3, "released  under\nthe mit license")]
    got = licenses.scan(spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, license string")).collect()
    by = sorted((r.doc_id, r.license, r.start, r.stop) for r in got)
    assert (1, "MIT-permission", 2, 2 + len(mit)) in by
    assert [r.coverage >= 0.9 for r in got if r.doc_id == 2] == [True]
    assert [x[2:] for x in by if x[0] == 3] == [(0, 30), (0, 31), (36, 66)]
    assert {x[0] for x in by} == {1, 2, 3}


RIGHT = {
    "Licensed under CC BY 4.0": "CC-BY-4.0", "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0", "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0", "CC BY-NC-ND 3.0": "CC-BY-NC-ND-3.0",
    "Licensed under the GNU GPL, version 2": "GPL-2.0-short", "GNU GPL, version 3": "GPL-3.0-short", "Licensed under the Apache License, Version 1.1": "Apache-1.1",
    "Licensed under the Apache License, Version 2.0": "Apache-2.0", "Attribution-ShareAlike 4.0": "CC-BY-SA-4.0-title", "Attribution 4.0 International": "CC-BY-4.0-title",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0", "Licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1",
    "Licensed under the Apache License, Version 3.0": None, "GNU GPL, version 1": None, "CC BY 1.0": None, "Released under the BSD License": None,
}


def test_words_that_tell_licenses_apart_decide():
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    for text, name in RIGHT.items():
        for around in ("{}", "Copyright 2020 by us. {}. Version 7 of our MIT and Apache tools."):
            given = around.format(text)
            got = [m[0] for m in licenses.placed(given, index.matches(licenses.words(given)))]
            assert got == ([name] if name else []), (given, got)


def test_bodies_survive_edits():
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    for name in ("MIT-body", "ISC", "Zlib", "BSD-disclaimer", "Apache-2.0-notice"):
        edited = licenses.TEMPLATES[name].replace("software", "program").replace("ALL", "ANY")
        text = f"some code\n{edited}\nmore code"
        got = licenses.placed(text, index.matches(licenses.words(text)))
        assert [m[0] for m in got] == [name] and got[0][1] > 0.85 and text[got[0][3] : got[0][4]] in edited


def constrained(template, text, must, stops):
    """Most words in common by the whole table: no `must` word left out, no `stops` word passed over inside the span."""
    best = 0
    for first in range(len(text)):
        row = {first - 1: 0}
        for i, word in enumerate(template):
            new = {}
            for j, n in row.items():
                if not must[i]:
                    new[j] = max(new.get(j, -1), n)
                for k in range(j + 1, len(text)):
                    if text[k] == word and (n or k == first):
                        new[k] = max(new.get(k, -1), n + 1)
                    if stops[k] and n:
                        break
            row = new
        best = max([best, *row.values()])
    return best


def test_alignment_equals_the_whole_table():
    rng = random.Random(11)
    for _ in range(150):
        template, text = ([rng.choice([b"a", b"b", b"c", b"mit"]) for _ in range(rng.randint(1, n))] for n in (6, 9))
        must, stops = licenses.telling(template), licenses.telling(text)
        n, first, last = licenses.align(template, text, 0, must, stops, band=12)
        assert n == constrained(template, text, must, stops)
        assert not n or text[first] in template and text[last] in template


def test_blocks_of_templates_change_nothing(spark):
    text = " ".join([*licenses.NOTICES.values(), "CC BY-SA 3.0 here", "All rights reserved All rights reserved"])
    docs = spark.createDataFrame([(1, text), (2, None), (1, text)], "doc_id long, text string")
    whole, parts = (sorted(map(tuple, licenses.scan(docs, size=size).collect())) for size in (200_000, 40))
    assert whole == parts and len(licenses.blocks(licenses.TEMPLATES, 40)) > 10 and len(whole) > 20
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(docs, {}).count() == 0


def test_winnowing_keeps_a_run_of_every_shared_stretch():
    rng = random.Random(7)
    hashes = [rng.getrandbits(16) for _ in range(200)]
    kept = set(licenses.winnow(hashes, 4))
    assert all(kept & set(range(at, at + 4)) for at in range(197))


def test_license_query_equals_line_search(spark, sf_dir):
    lines = {"MIT": "Released under the MIT License.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "all-rights-reserved": "All rights reserved."}
    folder = sf_dir.replace("0.001", "0.01")
    got = {(r.doc_id, r.license) for r in QUERIES["op7_license_scan"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = {(d.doc_id, k) for d in docs for k, line in lines.items() if line in d.text}
    assert want and got == want


def on_all_diagonals(index, found):
    """Names that an alignment in a band about any diagonal finds; templates of whose words the text has too few are left out."""
    stops, have = licenses.telling(found), Counter(found)
    out = set()
    for n, template in enumerate(index.templates):
        if sum(w in have for w in template) >= index.least(n):
            if any(licenses.align(template, found, s, index.must[n], stops)[0] >= index.least(n) for s in range(-len(template), len(found) + 1)):
                out.add(index.names[n])
    return out


def test_edited_templates_are_all_candidates():
    """As many words replaced as the coverage allows, never a telling one: what any diagonal finds is found."""
    index, rng, seen = licenses.TemplateIndex(licenses.TEMPLATES), random.Random(5), 0
    around = [w.encode() for w in "lorem ipsum dolor sit amet consectetur words go on".split()]
    for n, name in enumerate(index.names):
        template = index.templates[n]
        if len(template) > 40:
            continue
        for _ in range(3):
            may = [i for i, m in enumerate(index.must[n]) if not m]
            drop = set(rng.sample(may, min(len(template) - index.least(n), len(may))))
            body = [b"zz%d" % rng.randint(0, 99) if i in drop else w for i, w in enumerate(template)]
            body = [w for w in body for w in ([w, b"more"] if rng.random() < 0.05 else [w])]
            text = rng.choices(around, k=9) + body + rng.choices(around, k=9)
            want = name in on_all_diagonals(index, text)
            seen += want
            assert not want or name in {m[0] for m in index.matches(text)}, (name, text)
    assert seen > 250


def test_query_equals_all_diagonals(spark, sf_dir):
    """Every license named by an alignment on some diagonal stands in the text's matches, and what is reported is such a match or lies in twice the band."""
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {}
    for r in licenses.scan(spark.createDataFrame(docs)).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.coverage, r.matched, r.start, r.stop))
    for r in docs:
        found = licenses.words(r.text or "")
        matches = index.matches(found)
        assert on_all_diagonals(index, found) <= {m[0] for m in matches}
        assert sorted(got.get(r.doc_id, [])) == sorted(licenses.placed(r.text or "", matches))
    assert len(got) > 3


def test_headings_and_identifiers():
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    named = {
        "MIT License": "MIT-title", "BSD 3-Clause License": "BSD-3-Clause-title", "Mozilla Public License 2.0": "MPL-2.0-title", "Apache License 2.0": "Apache-2.0-title", "GNU General Public License v3.0": "GPL-3.0-title",
        "GPLv3": "GPL-3.0-letters", **{f"// SPDX-License-Identifier: {n}": f"{n}-spdx" for n in licenses.SPDX}, "SPDX-License-Identifier: Made-Up-1.0": None,
    }
    for text, name in named.items():
        assert [m[0] for m in licenses.placed(text, index.matches(licenses.words(text)))] == ([name] if name else []), text


def test_repeated_notices_take_seconds():
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    text = "GNU General Public License, version 2 " * 8000
    began = time.time()
    assert len(licenses.placed(text, index.matches(licenses.words(text)))) == 8000 and time.time() - began < 20

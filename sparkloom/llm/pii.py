"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the base spans (strict patterns that also pass their check) and
looser ones: addresses written out ("name at host dot org"), telephone numbers
without a country code, IPv6 addresses, 15 digit cards. Five labelers vote
yes, no or nothing on every candidate: its pattern, its structure, a gazetteer
and two lists of context words. Expectation-maximisation over the counts of vote
patterns estimates each labeler's reliability without labels; the posteriors
train a naive Bayes span classifier over votes, length and separators, which
decides on the looser candidates. Base spans always stay.

What reaches the driver is one row per pattern of votes and features: at most
4 kinds * 3^5 votes * 8 lengths * 3 separators, whatever the corpus.

Patterns begin where no earlier character could belong to the match (or where
the last match ended) and use possessive quantifiers: same matches as the plain
forms, linear time and no recursion on very long runs.

Defined results: a null or empty text has no spans; very long texts are searched
whole; spans of one kind and place (ties) are one by base, then the looser one;
repeated rows are treated one by one; an empty table gives an empty result; other
columns are kept whatever their names, and those that report() returns by the
same name replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import packed, unpacked

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, one per kind, in the order of KINDS.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
LOOSE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?\(at\) ?| ?\[at\] ?| at )[A-Za-z0-9-]++(?:(?: ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    r"(?<![0-9+.-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])",
    r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
)
#: What a text must hold for the pattern to be tried at all.
GUARD_BASE = ("contains(text, '@')", "text RLIKE '[0-9]'", "text RLIKE '[0-9]'", "contains(text, '+')")
GUARD_LOOSE = (
    "(contains(text, 'dot ') OR contains(text, 'dot)') OR contains(text, 'dot]'))",
    "text RLIKE '[0-9A-Fa-f]:[0-9A-Fa-f]'",
    "text RLIKE '3[47][0-9]{2}'",
    "text RLIKE '[0-9]{3}[ .-][0-9]{4}'",
)
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
TLDS = "com org net edu gov mil int info biz io dev app co uk de fr es it nl ch at be pl se no fi dk pt ie eu us ca au jp cn in br ru".split()
CUES = {
    "email": "e-?mail|mail|contact|write|reach|reply|address",
    "ip": "ip|server|host|address|client|login|from",
    "card": "card|visa|master|amex|credit|debit|pay|paid|charge",
    "phone": "phone|tel|call|mobile|cell|fax|contact|ring|whatsapp",
}
DOUBTS = "version|ver|release|isbn|issn|order|invoice|serial|section|chapter|figure|page|build"
CONTEXT = 40
#: Spans of a text that are placed, or replaced, at once.
BLOCK = 256
LABELERS = ("pattern", "structure", "gazetteer", "cue", "doubt")
OUT = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
_SPAN = "STRUCT<kind: INT, start: INT, stop: INT, base: BOOLEAN, body: STRING, before: STRING>"


def _sql(pattern: str) -> str:
    return "r'" + pattern + "'"


def _luhn(digits: str) -> str:
    """SQL that says whether a string of digits passes Luhn's check."""
    digit = f"CAST(substring({digits}, i, 1) AS INT)"
    twice = f"CASE WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + CASE WHEN (length({digits}) - i) % 2 = 1 THEN {twice} ELSE {digit} END) % 10 = 0"


def _valid(kind: int, base: bool) -> str:
    """SQL check of a match `s.body`."""
    digits = "regexp_replace(s.body, '[^0-9]', '')"
    if kind == 1 and base:
        return f"s.body RLIKE {_sql(rf'^{OCTET}(?:[.]{OCTET}){{3}}$')}"
    if kind == 2:
        return f"CASE WHEN length({digits}) BETWEEN {16 if base else 13} AND {19 if base else 15} THEN {_luhn(digits)} ELSE false END"
    if kind == 3:
        return f"length({digits}) BETWEEN {8 if base else 10} AND 15"
    return "true"


def _placed(kind: int, base: bool) -> str:
    """SQL that turns the matches m and the pieces p between them into spans with places.

    Places are running sums of lengths. An accumulator that grows by one span is
    copied at each step, so the matches are taken in blocks: first the lengths of
    blocks, then each block from its own start.
    """
    n = kind + 4 * (not base)
    begin = f"acc.at + length(_p{n}[i])"
    span = (
        f"named_struct('kind', {kind}, 'start', {begin}, 'stop', {begin} + length(_m{n}[i]), 'base', {str(base).lower()}, 'body', _m{n}[i], "
        f"'before', lower(right(_p{n}[i], {CONTEXT})))"
    )
    step = f"named_struct('at', {begin} + length(_m{n}[i]), 'out', concat(acc.out, array({span})))"
    inside = f"sequence({{0}}, least({{0}} + {BLOCK}, size(_m{n})) - 1)"
    lengths = f"transform(sequence(0, size(_m{n}) - 1, {BLOCK}), b -> aggregate({inside.format('b')}, 0, (a, i) -> a + length(_p{n}[i]) + length(_m{n}[i])))"
    starts = f"aggregate({lengths}, named_struct('at', 0, 'out', CAST(array() AS ARRAY<INT>)), (acc, x) -> named_struct('at', acc.at + x, 'out', concat(acc.out, array(acc.at))), acc -> acc.out)"
    first = f"named_struct('at', at, 'out', CAST(array() AS ARRAY<{_SPAN}>))"
    every = f"flatten(transform({starts}, (at, k) -> aggregate({inside.format(f'(k * {BLOCK})')}, {first}, (acc, i) -> {step}, acc -> acc.out)))"
    return f"CASE WHEN size(_m{n}) > 0 THEN filter({every}, s -> {_valid(kind, base)}) ELSE CAST(array() AS ARRAY<{_SPAN}>) END"


def candidates(docs: DataFrame) -> DataFrame:
    """(row, text, _base, _loose): the columns of docs, the text (null: empty) and arrays of spans; a loose one that touches a base span is left out."""
    out = docs.select(packed(docs), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = {}
    for n, (pattern, guard) in enumerate(zip(BASE + LOOSE, GUARD_BASE + GUARD_LOOSE)):
        found[f"_m{n}"] = F.expr(f"CASE WHEN {guard} THEN regexp_extract_all(text, {_sql(pattern)}, 0) ELSE CAST(array() AS ARRAY<STRING>) END")
    out = out.withColumns(found)
    out = out.withColumns({f"_p{n}": F.expr(f"CASE WHEN size(_m{n}) > 0 THEN split(text, {_sql(p)}, -1) ELSE CAST(array() AS ARRAY<STRING>) END") for n, p in enumerate(BASE + LOOSE)})
    out = out.withColumn("_base", F.expr(f"concat({', '.join(_placed(k, True) for k in range(4))})"))
    out = out.withColumn("_near", F.expr(f"concat({', '.join(_placed(k, False) for k in range(4))})"))
    # base spans ascend within a kind: a loose one is compared with the reach of each block, and with the spans of the few blocks that it touches
    blocks = f"transform(sequence(1, size(_base), {BLOCK}), b -> named_struct('b', slice(_base, b, {BLOCK})))"
    reach = "transform({}, x -> named_struct('b', x.b, 'start', array_min(transform(x.b, y -> y.start)), 'stop', array_max(transform(x.b, y -> y.stop))))"
    out = out.withColumn("_reach", F.expr(f"CASE WHEN size(_base) > 0 AND size(_near) > 0 THEN {reach.format(blocks)} END"))
    meets = "s.start < {0}.stop AND {0}.start < s.stop"
    touched = f"exists(_reach, r -> {meets.format('r')} AND exists(r.b, b -> {meets.format('b')}))"
    out = out.withColumn("_loose", F.expr(f"CASE WHEN _reach IS NULL THEN _near ELSE filter(_near, s -> NOT {touched}) END"))
    return out.select("row", "text", "_base", "_loose")


def _by_kind(s: Column, cases: dict[str, Column]) -> Column:
    out = F.lit(0)
    for k, kind in reversed(list(enumerate(KINDS))):
        out = F.when(s["kind"] == k, cases[kind]).otherwise(out)
    return out


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.when(no, -1) if no is not None else out).otherwise(0)


def votes(s: Column) -> dict[str, Column]:
    """Each labeler's vote (1, 0, -1) on a span."""
    body, digits, before = s["body"], F.regexp_replace(s["body"], "[^0-9]", ""), s["before"]
    n = F.length(digits)
    tld = F.lower(F.regexp_extract(F.right(body, F.lit(24)), r"([A-Za-z]+)$", 1))  # the end only: the pattern is quadratic on a long run
    private = body.rlike(r"^(?:10|127|0|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|2[3-5][0-9])\.")
    return {
        "pattern": _vote(s["base"]),
        "structure": _by_kind(
            s,
            {
                "email": _vote(tld.rlike("^[a-z]{2,}$"), tld == ""),
                "ip": _vote(~body.rlike(r"(?:^|\.)0[0-9]"), body.rlike(r"(?:^|\.)0[0-9]")),
                "card": _vote(n.isin(15, 16), n < 15),
                "phone": _vote(n >= 10, n < 10),
            }
        ),
        "gazetteer": _by_kind(
            s,
            {
                "email": _vote(tld.isin(TLDS), ~tld.isin(TLDS)),
                "ip": _vote(~private, private),
                "card": _vote(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"), ~digits.rlike("^[2-6]")),
                "phone": _vote(body.rlike(r"^\+(?:1|7|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), body.rlike(r"^[(]?[01]")),
            }
        ),
        "cue": _by_kind(s, {k: _vote(before.rlike(rf"\b(?:{c})\b")) for k, c in CUES.items()}),
        "doubt": F.when(before.rlike(rf"\b(?:{DOUBTS})\b"), -1).otherwise(0),
    }


def features(s: Column) -> dict[str, Column]:
    """Votes and form of a span, all of few values."""
    form = F.when(s["body"].rlike(r"^[0-9]+$"), 0).when(s["body"].rlike(r"[ ()-]"), 1).otherwise(2)
    return {"kind": s["kind"], **votes(s), "length": F.least(F.floor(F.length(s["body"]) / 4), F.lit(7)).cast("int"), "form": form}


def vote_counts(docs: DataFrame) -> list:
    """Candidates by kind, votes and form: a bounded number of rows."""
    worth = F.expr(" OR ".join(sorted(set(GUARD_BASE + GUARD_LOOSE))))
    spans = candidates(docs.select("text").where(worth)).select(F.explode(F.concat("_base", "_loose")).alias("s"))
    named = features(F.col("s"))
    return spans.select(*[c.alias(k) for k, c in named.items()]).groupBy(*named).agg(F.count("*").alias("n")).collect()


def estimate(rows: list, rounds: int = 40) -> tuple[dict, list[float]]:
    """Labelers' vote rates given truth, and each row's posterior, by expectation-maximisation.

    Starts from labelers that are right more often than not; a prior of a few
    counts keeps a labeler that seldom votes from being trusted or inverted.
    """
    first = {(1, 1): 0.6, (1, 0): 0.3, (1, -1): 0.1, (0, 1): 0.15, (0, 0): 0.45, (0, -1): 0.4}
    rates = {(name, y, v): p for name in LABELERS for (y, v), p in first.items()}
    share = {k: 0.7 for k in range(len(KINDS))}
    post = []
    for _ in range(rounds):
        post = []
        for r in rows:
            odds = math.log(share[r["kind"]] / (1 - share[r["kind"]])) + sum(math.log(rates[n, 1, r[n]] / rates[n, 0, r[n]]) for n in LABELERS)
            post.append(1 / (1 + math.exp(-max(-30, min(30, odds)))))
        for k in share:
            mine = [(p, r["n"]) for p, r in zip(post, rows) if r["kind"] == k]
            share[k] = (sum(p * n for p, n in mine) + 3.5) / (sum(n for _, n in mine) + 5)
        for name in LABELERS:
            for y in (0, 1):
                mass = {v: 10 * first[y, v] for v in (1, 0, -1)}
                for p, r in zip(post, rows):
                    mass[r[name]] += r["n"] * (p if y else 1 - p)
                total = sum(mass.values())
                rates |= {(name, y, v): m / total for v, m in mass.items()}
    return rates, post


def train(rows: list, post: list[float]) -> dict[str, dict[int, float]]:
    """Log odds of each value of each feature, the spans' posteriors being soft labels; '' has the prior."""
    total = [sum(r["n"] * (1 - p) for r, p in zip(rows, post)) + 1, sum(r["n"] * p for r, p in zip(rows, post)) + 1]
    out = {"": {0: math.log(total[1] / total[0])}}
    values = {"kind": range(4), **dict.fromkeys(LABELERS, (1, 0, -1)), "length": range(8), "form": range(3)}
    for name, kinds in values.items():
        out[name] = {}
        for v in kinds:
            mass = [2.0, 2.0]
            for r, p in zip(rows, post):
                if r[name] == v:
                    mass[0] += r["n"] * (1 - p)
                    mass[1] += r["n"] * p
            out[name][v] = math.log(mass[1] / (total[1] + 2 * len(kinds))) - math.log(mass[0] / (total[0] + 2 * len(kinds)))
    return out


def fit(docs: DataFrame) -> dict[str, dict[int, float]]:
    """The span classifier of a corpus."""
    rows = vote_counts(docs)
    _, post = estimate(rows)
    return train(rows, post)


def odds(model: dict[str, dict[int, float]], s: Column) -> Column:
    """Log odds that a span is personal data."""
    total = F.lit(model[""][0])
    for name, value in features(s).items():
        pairs = [F.lit(x) for v, w in model[name].items() for x in (v, w)]
        total = total + F.element_at(F.create_map(*pairs), value.cast("int"))
    return total


def spans(docs: DataFrame, model: dict[str, dict[int, float]]) -> DataFrame:
    """(row, text, _base, _all): the columns of docs, the text, base spans and all spans in order of kind and place."""
    found = candidates(docs)
    added = F.filter("_loose", lambda s: odds(model, s) > 0)
    every = F.transform(F.concat("_base", added), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["base"].alias("base")))
    return found.withColumn("_all", F.array_sort(every)).drop("_loose")


def _digest(column: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame, model: dict[str, dict[int, float]]) -> DataFrame:
    """docs with counts of base spans by kind, the digest of base spans and all spans as text."""
    found = spans(docs, model)
    kinds = F.transform("_base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(*unpacked(docs, *OUT), *counts, F.sha2(_digest("_base"), 256).alias("base_sha256"), _digest("_all").alias("spans"))


def mask(docs: DataFrame, model: dict[str, dict[int, float]]) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets; n_chars, if there, follows the new text.

    Spans that overlap are one, named after the first.
    """
    found = spans(docs, model)
    tag = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    ordered = F.array_sort(F.transform("_all", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    found = found.withColumn("_ordered", ordered)
    text, size = F.col("text"), F.size("_ordered")
    # where each block of spans ends: the furthest stop so far
    stops = F.transform(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1, F.lit(BLOCK)), lambda b: F.array_max(F.transform(F.slice("_ordered", b + 1, BLOCK), lambda s: s["stop"])))
    ends = F.aggregate(stops, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), x))))
    found = found.withColumn("_ends", ends)

    def block(k: Column) -> Column:
        """New text of a block of spans, from the end of the block before to its own end."""
        start = F.get("_ends", k)
        piece = text.substr(start + 1, F.get("_ends", k + 1) - start)  # bound once, so that spans are cut from a short text
        empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def replaced(piece: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                more = F.concat(acc["out"], piece.substr(acc["at"] + 1, s["start"] - start - acc["at"]), F.get(tag, s["kind"]))
                return F.struct(F.greatest(s["stop"] - start, acc["at"]).alias("at"), F.when(s["start"] - start >= acc["at"], more).otherwise(acc["out"]).alias("out"))

            return F.aggregate(F.slice("_ordered", k * BLOCK + 1, BLOCK), empty, step, lambda acc: acc["out"])

        return F.get(F.transform(F.array(piece), replaced), F.lit(0))

    pieces = F.transform(F.sequence(F.lit(0), F.size("_ends") - 2), block)
    new = F.concat(F.array_join(pieces, ""), text.substr(F.element_at("_ends", -1) + 1, F.length(text)))
    old = F.col("row")
    masked = found.select("row", F.when(F.size("_all") > 0, new).otherwise(old["text"]).alias("text"), (F.size("_all") > 0).alias("changed"))
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(old["n_chars"])
    return masked.select(*[made[c].alias(c) if c in made else old.getField(c).alias(c) for c in docs.columns])

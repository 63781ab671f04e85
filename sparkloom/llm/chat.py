"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is a JSON object of one of several layouts: messages with role and
content, conversations with from and value, turns, a nested dialogue, instruction
with input and output, prompt with response. The nested field paths of a record
(names through objects and arrays at any depth, no types) are hashed; the hash
selects a declarative mapping from the registry, which converts the record into
canonical turns (role, text). A record of an unknown layout keeps its paths and
fingerprint and gets no turns.

Paths are read from the record's brackets and keys alone, string values being cut
out first, so a long text costs one pass and no depth or length is too much. The
JSON reader's limit on strings is lifted to what a Spark string can hold.

Canonical turns are rendered with a template that marks each turn,

    [INST] role [/INST]text</s>

and escapes reversibly: a backslash is doubled, and a control string gets the
two characters \\. after its first one. The loss mask is a list of code-point
spans of the rendered text that hold the assistants' texts.

Defined results: a null text or role is empty; turns sort by number, nulls first,
then role and text, so ties have one order; repeated rows stay; texts of any
length are kept whole; a record without turns, one that is null, and one that is
no JSON render as the empty text; names of roles that belong to a layout (human and
gpt where speakers are named so) are read as user and assistant there, and in all
others a role stays as it is written; the loss mask holds every text whose role is a
name of the assistant; an empty table gives an empty result; other columns are kept,
those named like a result column replaced.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, own

ASSISTANT = "assistant"
#: Role names of layouts with names of their own, and what they are called here.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: All names of the assistant.
LEARNED = (ASSISTANT, *(name for name, role in ROLES.items() if role == ASSISTANT))
BEGIN, MIDDLE, END = "[INST] ", " [/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TURNS = "array<struct<role:string,text:string>>"
#: The JSON reader refuses longer strings; the most that an array of bytes can hold.
_JSON = {"maxStringLen": str((1 << 31) - 1)}
#: Turns whose spans are placed at once.
BLOCK = 256
#: Characters of a piece of a formatted text, from which spans are taken.
PIECE = 4096


@dataclass(frozen=True)
class Layout:
    """A kind of record: its field paths, those of them that may be missing, and how it becomes turns.

    `turns` names the path of an array and the role and text fields of its items;
    `fields` lists (role, path) of single texts instead. A path goes through
    objects with dots; `a[].b` is field b of the objects in array a. `written`
    says what the layout calls roles; one that says so reads all of ROLES.
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    written: tuple[tuple[str, str], ...] = ()


#: The declarative registry.
LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), ("messages[].name",), ("messages", "role", "content")),
    Layout("sharegpt", ("conversations[].from", "conversations[].value"), (), ("conversations", "from", "value"), (), (("user", "human"), ("assistant", "gpt"))),
    Layout("turns", ("turns[].role", "turns[].text"), ("turns[].turn",), ("turns", "role", "text")),
    Layout("dialogue", ("data.dialogue.items[].speaker", "data.dialogue.items[].utterance"), ("data.id",), ("data.dialogue.items", "speaker", "utterance"), (), (("user", "human"), ("assistant", "bot"))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), None, (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("prompt", ("prompt", "response"), ("system",), None, (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("nested_prompt", ("data.prompt", "data.response"), ("data.system",), None, (("system", "data.system"), ("user", "data.prompt"), ("assistant", "data.response"))),
    Layout("completion", ("completion", "prompt"), (), None, (("user", "prompt"), ("assistant", "completion"))),
    Layout("question", ("answer", "question"), ("context",), None, (("user", "context"), ("user", "question"), ("assistant", "answer"))),
)


def with_parents(paths: tuple[str, ...]) -> set[str]:
    """Paths and those of the fields that they go through."""
    out: set[str] = set()
    for path in paths:
        parts = path.split(".")
        out.update(".".join(parts[: n + 1]).removesuffix("[]") for n in range(len(parts)))
    return out


def path_hash(paths: tuple[str, ...]) -> str:
    """Fingerprint of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(with_parents(paths))).encode()).hexdigest()[:16]


def variants(layout: Layout) -> list[tuple[str, ...]]:
    """Each set of paths that a layout allows."""
    return [layout.paths + extra for n in range(len(layout.optional) + 1) for extra in itertools.combinations(layout.optional, n)]


def field_paths(record: Column) -> Column:
    """Sorted paths of all fields of a JSON record, at any depth.

    What is left of the record without its string values is brackets and keys; a
    stack of paths follows them. A field of a list of objects counts if any of them
    has it.
    """
    plain = F.replace(F.replace(record, F.lit("\\\\"), F.lit("~")), F.lit('\\"'), F.lit("~"))
    keys = F.regexp_replace(plain, r'("[^"]*+"\s*+:)|"[^"]*+"', "$1")
    tokens = F.regexp_extract_all(keys, F.lit(r'"[^"]*+"|[{}\[\]]'), F.lit(0))
    none = F.array().cast("array<string>")
    first = F.struct(none.alias("stack"), F.lit("").alias("last"), none.alias("paths"))

    def step(acc: Column, token: Column) -> Column:
        stack, last = acc["stack"], acc["last"]
        top = F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit(""))
        opens, closes = token.isin("{", "["), token.isin("}", "]")
        key = F.concat(F.when(top == "", "").otherwise(F.concat(top, F.lit("."))), token.substr(F.lit(2), F.length(token) - 2))
        is_key = ~opens & ~closes
        return F.struct(
            F.when(opens, F.concat(stack, F.array(last))).when(closes, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(stack).alias("stack"),
            F.when(token == "[", F.concat(last, F.lit("[]"))).when(token == "{", last).when(closes, top).otherwise(key).alias("last"),
            F.when(is_key & ~F.array_contains(acc["paths"], key), F.concat(acc["paths"], F.array(key))).otherwise(acc["paths"]).alias("paths"),
        )

    return F.array_sort(F.aggregate(F.coalesce(tokens, none), first, step, lambda acc: acc["paths"]))


def fingerprint(paths: Column) -> Column:
    """The hash of a record's sorted field paths."""
    return F.substring(F.sha2(F.array_join(paths, "\n"), 256), 1, 16)


def _ddl(paths: list[str]) -> str:
    """The schema that reads just these paths; a leaf is text."""
    tree: dict[str, list[str]] = {}
    for path in paths:
        name, _, rest = path.partition(".")
        tree.setdefault(name, []).extend([rest] if rest else [])
    fields = []
    for name, below in tree.items():
        kind = _ddl(below) if below else "string"
        fields.append(f"`{name.removesuffix('[]')}`:{f'array<{kind}>' if name.endswith('[]') else kind}")
    return f"struct<{','.join(fields)}>"


def _at(value: Column, path: str) -> Column:
    for name in path.split("."):
        value = value[name]
    return value


def _convert(layout: Layout, record: Column) -> Column:
    empty = F.array().cast(TURNS)
    if layout.turns:
        name, role, text = layout.turns
        items = _at(F.from_json(record, _ddl([f"{name}[].{role}", f"{name}[].{text}"]), _JSON), name)
        read = _role if layout.written else lambda r: F.coalesce(r, F.lit(""))
        return F.coalesce(F.transform(items, lambda x: F.struct(read(x[role]).alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))), empty)
    values = F.from_json(record, _ddl([p for _, p in layout.fields]), _JSON)
    turns = [F.struct(F.lit(r).alias("role"), _at(values, p).alias("text")) for r, p in layout.fields]
    return F.filter(F.array(*turns), lambda t: t["text"].isNotNull()).cast(TURNS)


def _role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    role = F.coalesce(role, F.lit(""))
    return F.coalesce(F.try_element_at(names, role), role)


def canonical(records: DataFrame, record: str = "record") -> DataFrame:
    """records with `paths`, `fingerprint`, `layout` (null: unknown) and `turns`."""
    out = records.withColumn("paths", field_paths(own(records, record)))
    out = out.withColumn("fingerprint", fingerprint(F.col("paths")))
    turns, layout = F.array().cast(TURNS), F.lit(None).cast("string")
    for kind in LAYOUTS:
        hit = F.col("fingerprint").isin([path_hash(v) for v in variants(kind)])
        turns = F.when(hit, _convert(kind, own(records, record))).otherwise(turns)
        layout = F.when(hit, F.lit(kind.name)).otherwise(layout)
    return out.withColumn("layout", layout).withColumn("turns", turns)


def escape(text: Column) -> Column:
    """Text without control strings; unescape gives it back."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\." + c[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\)|\\\.", "$1")


def render(turns: DataFrame) -> DataFrame:
    """Records with `formatted` and `loss`, the spans (start, stop) of the assistants' texts in it."""
    parts = F.transform("turns", lambda t: F.struct(t["role"].isin(*LEARNED).alias("learn"), escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    marks = len(BEGIN) + len(MIDDLE)
    size = lambda t: F.length(t["role"]) + F.length(t["text"]) + marks + len(END)
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def spans(block: Column) -> Column:
        """Spans of a block of turns, from the place where it begins."""

        def step(acc: Column, t: Column) -> Column:
            start = acc["at"] + F.length(t["role"]) + marks
            stop = start + F.length(t["text"])
            span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
            return F.struct((stop + len(END)).alias("at"), F.when(t["learn"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block["turns"], F.struct(block["at"].alias("at"), first["out"].alias("out")), step, lambda acc: acc["out"])

    name, begins = fresh(turns.columns, "parts", "begins")
    text = F.transform(name, lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit(MIDDLE), t["text"], F.lit(END)))
    # an array that grows by one item is copied at each step: first the lengths of blocks, then each block from its own start
    starts = F.sequence(F.lit(0), F.greatest(F.size(name), F.lit(1)) - 1, F.lit(BLOCK))
    lengths = F.transform(starts, lambda b: F.aggregate(F.slice(name, b + 1, BLOCK), F.lit(0), lambda a, t: a + size(t)))
    upto = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    blocks = F.transform(starts, lambda b, k: F.struct(F.get(begins, k).alias("at"), F.slice(name, b + 1, BLOCK).alias("turns")))
    return (
        turns.withColumn(name, parts)
        .withColumn(begins, upto)
        .withColumn("formatted", F.array_join(text, ""))
        .withColumn("loss", F.flatten(F.transform(blocks, spans)))
        .drop(name, begins)
    )


def parse(formatted: Column) -> Column:
    """Turns read back from a rendered text."""
    pieces = F.filter(F.split(formatted, "</s>"), lambda p: p != "")
    # after the marks are cut, the first MIDDLE ends the role: escaped roles and texts hold none
    role = lambda p: F.substring_index(p.substr(F.lit(len(BEGIN) + 1), F.length(p)), MIDDLE, 1)
    rest = lambda p: p.substr(F.length(role(p)) + len(BEGIN) + len(MIDDLE) + 1, F.length(p))
    return F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(rest(p)).alias("text")))


def learned(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between.

    A substring is found by counting from its text's start. So the text is cut into pieces once, in a lambda
    that holds them, and each span is taken from the pieces it lies in: time grows with the text, not with spans times text.
    """
    cut = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def taken(pieces: Column, s: Column) -> Column:
        first, last = F.floor(s["start"] / PIECE).cast("int"), F.floor(F.greatest(s["stop"] - 1, s["start"]) / PIECE).cast("int")
        near = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return unescape(near.substr(s["start"] % PIECE + 1, s["stop"] - s["start"]))

    return F.array_join(F.flatten(F.transform(F.array(cut), lambda pieces: F.transform(loss, lambda s: taken(pieces, s)))), "")


def written(layout: Layout, turns: Column) -> Column:
    """JSON of turns (role, text) in a layout of lists; canonical() reads it back."""
    name, role, text = layout.turns
    names = F.create_map(*[F.lit(x) for pair in layout.written for x in pair]) if layout.written else None
    called = (lambda r: F.coalesce(F.try_element_at(names, r), r)) if names is not None else (lambda r: r)
    value = F.transform(turns, lambda t: F.struct(called(t["role"]).alias(role), t["text"].alias(text)))
    for part in reversed(name.split(".")):
        value = F.struct(value.alias(part))
    return F.to_json(value)


def records_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, record) of rows (conv_id, turn, role, text): a JSON record for each conversation.

    The layouts of lists are dealt by a hash of the id, so a table's records are
    heterogeneous. A conversation with a role that a layout's own names would change
    is written in one without such names, so every role is read back as it was.
    All turns of a conversation make one record, so they have to meet; a conversation
    is one output value whatever its length.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    named = F.coalesce(F.bool_or(F.col("role").isin(*ROLES)), F.lit(False))
    ordered = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"), named.alias("named"))
    kinds = [k for k in LAYOUTS if k.turns]
    place = F.pmod(F.xxhash64("conv_id"), F.lit(len(kinds)))
    record = written(kinds[0], F.col("turns"))
    for n, kind in enumerate(kinds[1:], 1):
        mine = (place == n) & ~F.col("named") if kind.written else place == n
        record = F.when(mine, written(kind, F.col("turns"))).otherwise(record)
    return ordered.select("conv_id", record.alias("record"))


def digest(formatted: DataFrame) -> DataFrame:
    """What the rendered records say when read back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    read = formatted.select(
        "conv_id", parse(F.col("formatted")).alias("turns"), learned(F.col("formatted"), F.col("loss")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars")
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars",
    )


def _escaped_length(column: str) -> str:
    """SQL: length of a text after escape()."""
    text = rf"replace({column}, '\', '\\')"
    more = " + ".join(f"2 * ((length({column}) - length(replace({column}, '{c}', ''))) // {len(c)})" for c in CONTROL)
    return f"(length({text}) + {more})"


ORACLE_SQL = f"""
WITH rows_ AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), clean AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows_
), grouped AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS all_text,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role IN {LEARNED}), '') AS loss_text,
    sum({len(BEGIN) + len(MIDDLE) + len(END)} + {_escaped_length('role')} + {_escaped_length('text')}) AS formatted_chars
  FROM clean GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(all_text) AS turns_sha256, length(loss_text)::BIGINT AS loss_chars,
  sha256(loss_text) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM grouped
"""

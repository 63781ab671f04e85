"""Column builders that several queries share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tiers(value: Column, steps: Sequence[tuple[float, str]], lowest: str, strict: int = 0) -> Column:
    """Name of the first step whose bound the value reaches, from the highest; the first `strict` bounds must be exceeded."""
    out = F.lit(lowest)
    for n, (bound, name) in reversed(list(enumerate(steps))):
        out = F.when(value > bound if n < strict else value >= bound, name).otherwise(out)
    return out


def month(date: Column) -> Column:
    """yyyy-MM."""
    return F.date_format(date, "yyyy-MM")


def day(date: Column) -> Column:
    """yyyy-MM-dd."""
    return F.date_format(date, "yyyy-MM-dd")


def within(column: Column, start: str, stop: str) -> Column:
    """Half-open range of dates; unlike year() and month() it reaches the parquet scan."""
    return (column >= F.lit(start).cast("timestamp_ntz")) & (column < F.lit(stop).cast("timestamp_ntz"))


def code(prefix: str, number: Column, width: int = 5, cut: bool = False) -> Column:
    """prefix and the number padded with zeros; longer numbers stay whole unless cut."""
    text = number.cast("string")
    size = F.lit(width) if cut else F.greatest(F.lit(width), F.length(text))
    return F.concat(F.lit(prefix), F.lpad(text, size, F.lit("0")))


def number_or(text: Column, default: float = 0.0) -> Column:
    """A text as a double; what is no number becomes the default."""
    return F.coalesce(text.try_cast("double"), F.lit(default))


def words(text: Column) -> Column:
    """Words between runs of white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def count_up(n: Column) -> Column:
    """0 .. n-1; empty unless n is positive (a plain sequence(0, -1) would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<long>"))


def letters(text: Column) -> Column:
    """Single characters of a text, none of an empty one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def lookup(key: Column, names: Mapping[str, str], default: str) -> Column:
    """A small fixed map, with a default."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def salt(key: Column, salts: int) -> Column:
    """A salt that is the same at each evaluation."""
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def initial_index(text: Column) -> Column:
    """0 for A .. 25 for Z, whatever the case; 0 for the rest."""
    n = F.ascii(F.upper(F.substring(text, 1, 1))) - F.lit(65)
    return F.when(n.between(0, 25), n).otherwise(0)


def bands(value: Column, bounds: Sequence[float]) -> Column:
    """How many bounds the value reaches: half-open bands without gaps."""
    out = F.lit(0)
    for n, bound in enumerate(bounds):
        out = F.when(value >= bound, n + 1).otherwise(out)
    return out

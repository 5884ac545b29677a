"""Column-to-Column helpers shared by every operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_half_even(x: Column, digits: int) -> Column:
    """Round so that exact binary ties go to the even digit.

    ``x`` is exactly halfway between two ``digits``-place decimals only if
    ``x * 2**(digits + 1)`` is an odd integer, a product doubles hold exactly.
    """
    x = x.cast("double")
    return F.when(F.abs(x * float(2 ** (digits + 1))) % 2 == 1, F.bround(x, digits)).otherwise(F.round(x, digits))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Floor of ``x + 0.5`` at the given number of digits."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def falsy_default(value: Column, default, kind: T.DataType) -> Column:
    """``value`` unless it is null, zero or empty; then ``default``."""
    if isinstance(kind, T.StringType):
        blank = value == ""
    elif isinstance(kind, T.BooleanType):
        blank = ~value
    else:
        blank = value == 0
    return F.when(value.isNull() | blank, F.lit(default)).otherwise(value)


def strip(text: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) == 0


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def parse_time(text: Column) -> Column:
    """Timestamp of ``YYYY-MM-DD HH:MM:SS`` text, null where unparsable."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def choose(pairs, default: Column) -> Column:
    """First value whose condition holds, else ``default``."""
    pairs = list(pairs)
    if not pairs:
        return default
    head, *rest = pairs
    chain = F.when(head[0], head[1])
    return reduce(lambda acc, pair: acc.when(pair[0], pair[1]), rest, chain).otherwise(default)


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    return choose([(key == F.lit(k), F.lit(v)) for k, v in table.items()], F.lit(default))


def stable_id(kind: T.DataType, *parts: Column) -> Column:
    """Deterministic identifier of the given key columns."""
    if isinstance(kind, T.StringType):
        text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
        return F.sha2(F.concat_ws("\u001f", *text), 256)
    return F.xxhash64(*parts).cast(kind)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once per row.

    A one-element generator keeps the optimizer from copying an expensive
    expression (parsing, say) into every later use and filter.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*df.columns, F.inline(F.array(row)))

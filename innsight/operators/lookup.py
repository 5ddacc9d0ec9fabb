"""Attaching columns of a dimension to a large table.

A dimension of measured, small size is broadcast and the large side does not
move. Beyond that the join is shuffled. Both ways take the same schemas and read
the same columns under the same filters. The shuffled one spreads the rows of keys
that hold a notable part of the table, where the caller names narrow columns to
spread them by; all other keys are neither salted nor copied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_CONF = "innsight.lookup.broadcastBytes"  # overrides it in a session
SALTS = 32
#: A key is hot if it holds this part of the rows.
HOT_SHARE = 1 / 64
TRACKED = 8192  # counters of a sketch

_WIDTHS = {
    T.BooleanType: 1,
    T.IntegerType: 4,
    T.DateType: 4,
    T.LongType: 8,
    T.DoubleType: 8,
    T.TimestampType: 8,
}


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row without its texts."""
    return 8 + sum(_WIDTHS.get(type(column.dataType), 0) for column in df.schema)


def measured_bytes(df: DataFrame) -> int:
    """Bytes held by a frame: rows times fixed widths plus the text lengths.

    One aggregate over the columns that are really used; only two numbers reach
    the driver.
    """
    text_total = F.lit(0)
    for column in df.schema:
        if type(column.dataType) not in _WIDTHS:
            length = F.octet_length(F.col(column.name).cast("string"))
            text_total = text_total + F.coalesce(F.sum(length), F.lit(0))
    rows, text = df.agg(F.count(F.lit(1)), text_total).first()
    return rows * row_bytes(df) + text


def lookup(
    fact: DataFrame,
    dimension: DataFrame,
    on: list[str],
    how: str = "left",
    salt: list[str] | None = None,
    salts: int = SALTS,
    at_most_bytes: int | None = None,
) -> DataFrame:
    """``fact`` joined with ``dimension`` on equal columns.

    ``how`` is inner, left, left_semi or left_anti. All ways give the same rows;
    none needs the dimension's key to be unique. ``at_most_bytes`` is a bound the
    caller has measured already, for instance on what the dimension is drawn from;
    without it the dimension is measured here. ``salt`` names columns of ``fact``
    whose values spread the rows of one key; without them a shuffled join leaves
    hot keys to adaptive execution, which can split them unless a grouping by the
    same key follows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    if at_most_bytes is None:
        at_most_bytes = measured_bytes(dimension)
    limit = int(fact.sparkSession.conf.get(BROADCAST_CONF, str(BROADCAST_BYTES)))
    if at_most_bytes <= limit:
        return fact.join(F.broadcast(dimension), on, how)
    if not salt or fact.isStreaming:
        return fact.join(dimension, on, how)
    return salted_join(fact, dimension, on, how, salt, salts)


def key_hash(on: list[str], kinds: list[str]) -> Column:
    """One number for a key, alike in both tables; null if a column is null."""
    columns = [F.col(name).cast(kind) for name, kind in zip(on, kinds)]
    present = reduce(Column.__and__, [F.col(name).isNotNull() for name in on])
    return F.when(present, F.xxhash64(*columns))


def hot_keys(fact: DataFrame, on: list[str], share: float = HOT_SHARE) -> list[int]:
    """Hashes of all keys that hold more than ``share`` of the rows, and perhaps of a few
    that hold a little less; there are less than 2 / share.

    One pass over the key columns alone, with one sketch of frequent items a task. A
    sketch has TRACKED counters however many keys there are, and sketches add up.
    A count is off by at most 3.5 / TRACKED of the rows, far less than ``share``, so
    no such key can be missed.
    """
    kinds = [fact.schema[name].dataType.simpleString() for name in on]
    keyed = fact.select(key_hash(on, kinds).alias("key")).where("key is not null")
    listed = int(2 / share)
    rows, found = keyed.agg(
        F.count(F.lit(1)), F.expr(f"approx_top_k(key, {listed}, {max(TRACKED, 64 * listed)})")
    ).first()
    return [row["item"] for row in found if row["count"] > rows * share * 0.9]


def salted_join(
    fact: DataFrame,
    dimension: DataFrame,
    on: list[str],
    how: str,
    salt: list[str],
    salts: int = SALTS,
) -> DataFrame:
    """A shuffled join that spreads every hot key over ``salts`` tasks.

    Unlike the adaptive skew join it also holds when the result is grouped by the
    same key afterwards. The salt is a hash of the row's own values, so a task that
    is run again gives its rows the same salts. Only rows of the dimension with a
    hot key are copied. Keys count as hot by a hash; one that is so by chance is
    spread like the others, which changes no row.
    """
    hot = hot_keys(fact, on)
    if not hot:
        return fact.join(dimension, on, how)
    kinds = [fact.schema[name].dataType.simpleString() for name in on]
    is_hot = F.coalesce(key_hash(on, kinds).isin(hot), F.lit(False))
    spread = F.pmod(F.xxhash64(*salt), F.lit(salts)).cast("int")
    salted = fact.withColumn("lookup_salt", F.when(is_hot, spread).otherwise(F.lit(0)))
    every, one = F.sequence(F.lit(0), F.lit(salts - 1)), F.array(F.lit(0))
    copies = dimension.withColumn("lookup_salt", F.explode(F.when(is_hot, every).otherwise(one)))
    return salted.join(copies, [*on, "lookup_salt"], how).drop("lookup_salt")

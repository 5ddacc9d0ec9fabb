"""Integrity checks: missing required values, repeated keys, orphan rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.sources.schemas import TABLES


@dataclass(frozen=True)
class Check:
    """One check; ``parent`` is the table and column that hold what may occur."""

    table: str
    name: str
    columns: tuple[str, ...]
    parent: tuple[str, str] | None = None


_NUMBERS = {
    "tinyint": lambda c: c.cast("long"),
    "smallint": lambda c: c.cast("long"),
    "int": lambda c: c.cast("long"),
    "bigint": lambda c: c,
    "date": lambda c: F.unix_date(c).cast("long"),
    "timestamp": F.unix_micros,
}
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _kinds(tables: Mapping[str, DataFrame], check: Check) -> list[str]:
    """The types of the values that a check compares, one kind for all integers."""
    kinds = [tables[check.table].schema[c].dataType.simpleString() for c in check.columns]
    if check.parent:
        kinds.append(tables[check.parent[0]].schema[check.parent[1]].dataType.simpleString())
    return ["bigint" if k in _INTEGERS else k for k in kinds]


def _as_numbers(tables: Mapping[str, DataFrame], check: Check) -> bool:
    """Whether the values of a check are told apart by whole numbers, one a column."""
    kinds = _kinds(tables, check)
    return all(k in _NUMBERS for k in kinds) and (not check.parent or len(set(kinds)) == 1)


def _value(df: DataFrame, columns: tuple[str, ...], numbers: bool, width: int) -> list[Column]:
    """A value as ``width`` numbers and a text, those that are not needed null. A text of
    several columns differs where one of them does."""
    empty, text = [F.lit(None).cast("long")] * width, F.lit(None).cast("string")
    if numbers:
        made = [_NUMBERS[df.schema[c].dataType.simpleString()](F.col(c)) for c in columns]
        return [*made, *empty[len(made) :], text]
    if len(columns) == 1:
        return [*empty, F.col(columns[0]).cast("string")]
    texts = [F.col(c).cast("string") for c in columns]
    sizes = [F.coalesce(F.char_length(t), F.lit(-1)).cast("string") for t in texts]
    return [*empty, F.concat_ws(":", *sizes, *(F.coalesce(t, F.lit("")) for t in texts))]


def _entries(
    tables: Mapping[str, DataFrame], table: str, checks: list[Check], width: int
) -> DataFrame:
    """(check, n0.., text, held): what the checks have to know of a table, in one pass over
    it. A row gives an entry to each check that it matters to: its value to those of
    keys and references, with ``held`` true where it is the parent's, and a mark to
    those of missing values where there is none."""
    df, entries = tables[table], []
    names = [*(f"n{i}" for i in range(width)), "text"]

    def entry(number: int, columns: tuple[str, ...], numbers: bool, held: bool) -> Column:
        value = [v.alias(n) for v, n in zip(_value(df, columns, numbers, width), names)]
        return F.struct(F.lit(number).alias("check"), *value, F.lit(held).alias("held"))

    for number, check in enumerate(checks):
        numbers = _as_numbers(tables, check)
        if check.table == table:
            first = F.col(check.columns[0])
            if check.name == "missing":
                entries.append(F.when(first.isNull(), entry(number, (), True, False)))
            elif check.name == "repeated":
                entries.append(entry(number, check.columns, numbers, False))
            else:
                entries.append(F.when(first.isNotNull(), entry(number, check.columns, numbers, False)))
        if check.parent and check.parent[0] == table:
            held = F.col(check.parent[1]).isNotNull()
            entries.append(F.when(held, entry(number, (check.parent[1],), numbers, True)))
    return df.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))


def run_checks(tables: Mapping[str, DataFrame], checks: list[Check]) -> DataFrame:
    """The checks on the tables: (table_name, check_name, column_name, violations).

    Every table is read once, however many checks it takes part in, and all checks
    share one shuffle. Rows are counted by check and value ahead of it, so a value
    that holds most of them crosses it once a task, and so does a parent's: whether a
    value is known is a count like the others and no join. (A Bloom filter of the
    children's values could keep some parents back, but only after a pass of its own.)
    """
    needed = dict.fromkeys([*(c.table for c in checks), *(c.parent[0] for c in checks if c.parent)])
    compared = [c for c in checks if c.name != "missing"]
    width = max([1, *(len(c.columns) for c in compared if _as_numbers(tables, c))])
    parts = reduce(DataFrame.unionByName, [_entries(tables, t, checks, width) for t in needed])
    if all(_as_numbers(tables, c) for c in compared):
        parts = parts.drop("text")
    counts = (
        parts.groupBy(*(c for c in parts.columns if c != "held"))
        .agg(F.count_if(~F.col("held")).alias("n"), F.max("held").alias("known"))
    )
    repeated = F.col("check").isin([i for i, c in enumerate(checks) if c.name == "repeated"])
    wrong = F.when(repeated, F.col("n") - 1).when(~F.col("known"), F.col("n")).otherwise(0)
    summed = counts.groupBy("check").agg(F.sum(wrong).cast("long").alias("violations"))
    named = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("check"),
                    F.lit(c.table).alias("table_name"),
                    F.lit(c.name).alias("check_name"),
                    F.lit(",".join(c.columns)).alias("column_name"),
                )
                for i, c in enumerate(checks)
            ]
        )
    )
    listed = counts.sparkSession.range(0, 1, 1, 1).select(named)
    # as many rows as there are checks on both sides
    return listed.join(F.broadcast(summed), "check", "left").select(
        "table_name",
        "check_name",
        "column_name",
        F.coalesce("violations", F.lit(0).cast("long")).alias("violations"),
    )


def integrity_audit(
    tables: Mapping[str, DataFrame],
    required: Mapping[str, list[str]],
    keys: Mapping[str, list[list[str]]],
    parents: Mapping[str, Mapping[str, tuple[str, str]]],
) -> DataFrame:
    """All checks on all tables: ``missing`` counts rows without a required value,
    ``repeated`` rows beyond the first of a key (rows without one are alike), ``orphan``
    rows whose value the parent's column does not hold (null has no parent to miss).
    """
    checks = [Check(t, "missing", (c,)) for t, columns in required.items() for c in columns]
    checks += [Check(t, "repeated", tuple(key)) for t, own in keys.items() for key in own]
    checks += [
        Check(t, "orphan", (c,), parent) for t, own in parents.items() for c, parent in own.items()
    ]
    return run_checks(tables, checks)


def audit_stored_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The audit by the declared rules, for the stored tables that are given."""
    rules = {name: TABLES[name] for name in tables}
    return integrity_audit(
        tables,
        {name: list(rule.required) for name, rule in rules.items()},
        {name: [[rule.key]] for name, rule in rules.items() if rule.key == "id"},
        {
            name: {
                column: parent for column, parent in rule.parents.items() if parent[0] in tables
            }
            for name, rule in rules.items()
        },
    )

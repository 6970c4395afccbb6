"""Relational shapes that recur: key sets, optional filters, newest rows, as-of, upserts, pages."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_set(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters for the parameters that are set; they reach the scan."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def between(df: DataFrame, col: str, start=None, end=None, closed: bool = False) -> DataFrame:
    """start <= col < end, or <= end if closed; either may be missing."""
    if start is not None:
        df = df.where(F.col(col) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(col) <= F.lit(end) if closed else F.col(col) < F.lit(end))
    return df


def has_flag(df: DataFrame, flagged: DataFrame, on: list[str] | str, wanted: bool | None) -> DataFrame:
    """Rows with a match, without one, or all."""
    return df if wanted is None else df.join(flagged, on, "left_semi" if wanted else "left_anti")


def either(df: DataFrame, unset: Column, keys: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows where unset holds or whose key is in keys: two branches, no disjunctive join."""
    return df.where(unset).unionByName(df.where(~F.coalesce(unset, F.lit(False))).join(keys, on, "left_semi"))


def newest(df: DataFrame, by: list, order: list[Column], keep: int = 1) -> DataFrame:
    """The first rows of each group; with keep 1, Spark prunes groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")


def inherited(df: DataFrame, group: list[str], version: str, value: Column, tie: list[str] = ()) -> DataFrame:
    """Adds inherited: value (a struct, or null where a row has none) of the greatest lower version in the group."""
    past = Window.partitionBy(*group).orderBy(version).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn("inherited", F.max_by(value, F.when(value.isNotNull(), F.struct(version, *tie))).over(past))


def merge(target: DataFrame, source: DataFrame, keys: list[str], rules: Mapping[str, Column | str]) -> DataFrame:
    """Upsert as a full outer join. Rules by column: 'new' (the source's value), 'keep' (the first
    stays), 'fill' (the source's if not null), 'least', 'greatest', 'or'; or an expression of t.x and s.x."""
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), source.withColumn("_s", F.lit(True)).alias("s")
    both = t.join(s, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], "full")
    old, new = (lambda c: F.col(f"t.{c}")), (lambda c: F.col(f"s.{c}"))
    how = {
        "new": lambda c: F.when(F.col("_s"), new(c)).otherwise(old(c)),
        "keep": lambda c: F.when(F.col("_t"), old(c)).otherwise(new(c)),
        "fill": lambda c: F.coalesce(new(c), old(c)),
        "first": lambda c: F.coalesce(old(c), new(c)),
        "least": lambda c: F.least(old(c), new(c)),
        "greatest": lambda c: F.greatest(old(c), new(c)),
        "or": lambda c: F.coalesce(old(c), F.lit(False)) | F.coalesce(new(c), F.lit(False)),
    }
    value = lambda c: rules.get(c, "new")
    return both.select(*[F.coalesce(old(k), new(k)).alias(k) for k in keys], *[(how[r](c) if isinstance(r := value(c), str) else F.when(F.col("_t") & F.col("_s"), r).when(F.col("_s"), new(c)).otherwise(old(c))).alias(c) for c in target.columns if c not in keys])


def replaced(target: DataFrame, source: DataFrame, parents: list[str]) -> DataFrame:
    """All children of the source's parents replaced by the source's rows."""
    return target.join(source.select(*parents).distinct(), parents, "left_anti").unionByName(source)


# Keyset pages: at most limit rows after a cursor, one more to know whether there are others.


def token(shape: Mapping, values: Mapping) -> str:
    """A cursor: hex of JSON with a digest of what was asked for."""
    return json.dumps({"v": 1, "h": _digest(shape), **values}, sort_keys=True, separators=(",", ":")).encode().hex()


def read_token(text: str, shape: Mapping) -> dict:
    try:
        found = json.loads(bytes.fromhex(text))
    except ValueError as wrong:
        raise ValueError("the cursor can't be read") from wrong
    if found.get("h") != _digest(shape):
        raise ValueError("the cursor belongs to another query")
    return {k: v for k, v in found.items() if k not in ("v", "h")}


def _digest(shape: Mapping) -> str:
    return hashlib.sha256(json.dumps(shape, sort_keys=True, default=str).encode()).digest()[:16].hex()


def page(df: DataFrame, order: list[tuple[str, bool]], limit: int, after: Mapping | None = None) -> DataFrame:
    """limit + 1 rows after the row that after describes, in order ((column, descending), all one way)."""
    cols, down = [c for c, _ in order], order[0][1]
    if after:
        here, there = F.struct(*cols), F.struct(*[F.lit(after[c]).cast(df.schema[c].dataType).alias(c) for c in cols])
        df = df.where(here < there if down else here > there)
    return df.orderBy(*[F.desc(c) if d else F.asc(c) for c, d in order]).limit(limit + 1)

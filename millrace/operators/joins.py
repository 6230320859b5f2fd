"""Joins. Spark chooses the physical strategy from sizes; nothing here forces a broadcast of a table whose size is not known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_activations(items: DataFrame, activations: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Items with a date and, where there is one, their activation: what an outer join less rows without a date gives."""
    return items.where(F.col(date).isNotNull()).join(activations, keys, "left")


def join_dim(facts: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    return facts.join(dim, keys)


def left_with_flag(left: DataFrame, right: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Left join with 1 where the right side has a row and 0 where not."""
    return left.join(right.withColumn(flag, F.lit(1)), keys, "left").withColumn(flag, F.coalesce(flag, F.lit(0)))


def latest(df: DataFrame, keys: list[str], order: str, ties: list[str] = ()) -> DataFrame:
    """The row of each key with the greatest order value that is not null; `ties` decides between equal ones."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), *ties)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def left_latest(left: DataFrame, right: DataFrame, keys: list[str], order: str, ties: list[str] = ()) -> DataFrame:
    """Left join with the newest right row of each key. A null order value loses to any other. The right side is reduced before the join."""
    return left.join(latest(right, keys, order, ties), keys, "left")


def enrich(base: DataFrame, others: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Successive left joins; columns of a table whose names are taken get its name as prefix."""
    taken = set(base.columns)
    for name, df in others.items():
        df = df.withColumnsRenamed({c: f"{name}_{c}" for c in df.columns if c in taken and c not in keys})
        taken |= set(df.columns)
        base = base.join(df, keys, "left")
    return base


def join_named(left: DataFrame, right: DataFrame, pairs: dict[str, str], how: str = "left") -> DataFrame:
    """Join on differently named keys, left name to right name; the right keys are dropped."""
    right = right.withColumnsRenamed({r: f"_{r}" for r in pairs.values()})
    return left.join(right, reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_{r}") for k, r in pairs.items())), how).drop(*(f"_{r}" for r in pairs.values()))


def join_event_outcomes(sent: DataFrame, outcomes: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Sent events, one for each key, with 0/1 for every kind of outcome that has the key."""
    out = sent.dropDuplicates(keys)
    for name, df in outcomes.items():
        out = left_with_flag(out, df.select(*keys).distinct(), keys, name)
    return out


def restrict_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def remaining(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(done.select(*keys), keys, "left_anti")


def feature_union(branches: list[DataFrame], key: list[str]) -> DataFrame:
    """Full outer join of feature branches on their row key."""
    return reduce(lambda a, b: a.join(b, key, "full"), branches)


def align_to(df: DataFrame, dates: DataFrame, key: str) -> DataFrame:
    """A row for each of the given time stamps, with df's values where it has them."""
    return dates.select(key).distinct().join(df, key, "left")


def text_lookup(df: DataFrame, table: DataFrame, text: str, value: str) -> DataFrame:
    """Joins on equal text, by digest first so that rows are dealt and sorted by 32 bytes, then by the text itself."""
    d = df.withColumn("_k", F.sha2(text, 256))
    t = table.select(F.sha2(text, 256).alias("_k"), F.col(text).alias("_t"), value)
    return d.join(t, (d["_k"] == t["_k"]) & (d[text] == t["_t"]), "left").select(*df.columns, value)


def range_join(raw: DataFrame, target: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Left equi-join with a further condition on both sides."""
    t = target.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, (raw[k] == t[f"_{k}"] for k in keys))
    return raw.join(t, on & condition, "left").drop(*(f"_{k}" for k in keys))

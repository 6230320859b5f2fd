"""Encoders of categories. Levels are those of the fit; nothing is learned from data that is transformed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.lineage import cut
from millrace.operators.quantiles import grouped_quantile, quantiles
from millrace.operators.sets import position
from millrace.operators.steps import Fit, Step

#: Columns that a one-hot encoding may add for one column; with more values it must be sparse.
MOST_COLUMNS = 10_000
#: Values up to which an encoder is an expression with its codes in the parameter; beyond, they are a table that is joined.
MOST_CASES = 200
#: Rows up to which that table is broadcast.
BROADCAST_LEVELS = 100_000


def _few(df: DataFrame, most: int) -> list | None:
    """The rows of a table with at most `most`, None if there are more."""
    rows = df.limit(most + 1).collect()
    return None if len(rows) > most else rows


def _coded(step: Step, df: DataFrame, col: str, codes: dict | None, size: int, kind: str) -> DataFrame:
    """df with _code, what the fit gave the column's value as text, null where it has none."""
    if codes is not None:
        pairs = [F.lit(x) for kv in codes.items() for x in kv]
        return df.withColumn("_code", (F.create_map(*pairs)[F.col(col).cast("string")] if pairs else F.lit(None)).cast(kind))
    table = step.table(col).select(F.col("value").alias("_value"), F.col("code").cast(kind).alias("_code"))
    return df.join(F.broadcast(table) if size <= BROADCAST_LEVELS else table, F.col(col).cast("string") == F.col("_value"), "left").drop("_value")


def _levels(df: DataFrame, cols: list[str], nulls: str | None = None) -> dict:
    """Of each column the values as text in order, with places from 0: as codes while they are few, else as a table (value, code). With `nulls`, null is a
    value of that name, the last. Places in a large table are counted over ranges, not in one task."""
    codes, sizes, tables = {}, {}, {}
    for c in cols:
        text = F.col(c).cast("string")
        seen = df.select(text.alias("value")).distinct()
        null = nulls is not None and not df.where(F.col(c).isNull()).isEmpty()
        seen = seen.where(F.col("value").isNotNull() & (F.col("value") != F.lit(nulls))) if nulls is not None else seen.where("value is not null")
        null = null or nulls is not None and not df.where(text == nulls).isEmpty()
        few = _few(seen, MOST_CASES)
        if few is not None:
            codes[c] = {v: i for i, v in enumerate(sorted(r[0] for r in few) + [nulls] * null)}
            sizes[c] = len(codes[c])
        else:
            placed = position(seen, ["value"], "code")
            sizes[c] = placed.count()
            if null:
                placed = placed.unionByName(df.sparkSession.createDataFrame([(nulls, sizes[c])], "value string, code long"))
                sizes[c] += 1
            codes[c], tables[c] = None, placed.select("value", "code")
    return {"codes": codes, "sizes": sizes, "tables": tables}


class OneHotModel(Step):
    def apply(self, df, cols, codes, sizes, drop_first=False, sparse=False):
        new = {}
        for c in cols:
            text = F.coalesce(F.col(c).cast("string"), F.lit("nan_ohe"))
            if sparse:
                df = self.sparse(df.withColumn(c, text), c, codes[c], sizes[c], drop_first)
                continue
            levels = list(codes[c]) if codes[c] is not None else [r.value for r in self.table(c).orderBy("code").collect()]  # at most MOST_COLUMNS
            for i, v in enumerate(levels):
                if not (drop_first and i == 0):
                    new[f"{c}_{i if drop_first else v}"] = F.when(text == v, 1).otherwise(0)
        return df.withColumns(new).drop(*cols)

    def sparse(self, df: DataFrame, col: str, codes: dict | None, size: int, drop_first: bool) -> DataFrame:
        from pyspark.ml.feature import OneHotEncoder

        first = 1 if drop_first else 0
        code = F.coalesce(F.col("_code") - first, F.lit(-1))
        d = _coded(self, df, col, codes, size, "int").withColumn("_code", F.when(code >= 0, code).otherwise(size - first))
        known = df.sparkSession.createDataFrame([(float(max(0, size - first - 1)),)], "_code double")  # tells the encoder how long its vectors are
        encoder = OneHotEncoder(inputCol="_code", outputCol=f"{col}_ohe", handleInvalid="keep", dropLast=True).fit(known)
        return encoder.transform(d).drop("_code")


class OneHot(Fit):
    """An int column for each fitted value, <column>_<value>; null is a value, nan_ohe; an unknown value has zeros throughout. drop_first leaves out the
    first value and names the columns <column>_<index>. With `sparse` a column gives one sparse vector, <column>_ohe, and may have any number of values."""

    step = OneHotModel

    def learn(self, df, cols, drop_first=False, sparse=False):
        found = _levels(df, cols, "nan_ohe")
        for c, n in found["sizes"].items():
            if n > MOST_COLUMNS and not sparse:
                raise ValueError(f"{c} has more than {MOST_COLUMNS} values: encode it with sparse=True, or group rare ones first")
        return found


class LabelEncoderModel(Step):
    def apply(self, df, cols, codes, sizes):
        for c in cols:
            df = _coded(self, df, c, codes[c], sizes[c], "int").withColumn(c, F.coalesce("_code", F.lit(sizes[c]))).drop("_code")
        return df


class LabelEncoder(Fit):
    """The place of a value among the fitted ones in order; unknown values and null get the code after the last. Any number of values."""

    step = LabelEncoderModel

    def learn(self, df, cols):
        return _levels(df, cols)


class TargetEncoderModel(Step):
    def apply(self, df, cols, target, codes, sizes, others, how="mean", unknown=None):
        for c in cols:
            df = _coded(self, df, c, codes[c], sizes[c], "double")
            df = df.withColumn(c, F.col("_code") if others[c] is None else F.coalesce("_code", F.lit(others[c]))).drop("_code")
        return df


class TargetEncoder(Fit):
    """The mean or median target of a category; keys are strings at the fit too. `unknown` gives unseen ones the mean or median of the map's values. Any
    number of categories, and of rows in one: medians come from counts summed up over ranges."""

    step = TargetEncoderModel

    def learn(self, df, cols, target, how="mean", unknown=None):
        codes, sizes, others, tables = {}, {}, {}, {}
        for c in cols:
            d = df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("value"), F.col(target).alias("_target"))
            if how == "mean":
                seen = d.groupBy("value").agg(F.avg("_target").alias("code"))
            else:  # a category without a target keeps its place, with null
                seen = d.select("value").distinct().join(grouped_quantile(d, "value", "_target", 0.5, "code"), "value", "left")
            few = _few(seen, MOST_CASES)
            if few is not None:
                codes[c] = {r.value: r.code for r in sorted(few, key=lambda r: r.value)}
                sizes[c] = len(codes[c])
            else:
                seen = cut(seen)
                codes[c], sizes[c], tables[c] = None, seen.count(), seen
            others[c] = None
            if unknown == "mean":
                others[c] = seen.agg(F.avg("code")).first()[0]
            elif unknown is not None:
                others[c] = quantiles(seen, {"code": F.col("code")}, [0.5])[0]["code"][0]
        return {"codes": codes, "sizes": sizes, "others": others, "tables": tables}


class GroupRareModel(Step):
    def apply(self, df, cols, valid, dropped, threshold=0.05):
        return df.withColumns({c: F.when(F.col(c).isin(v), F.col(c)).otherwise("grouped") for c, v in valid.items()}).drop(*dropped)


class GroupRare(Fit):
    """Values with a share of at most the threshold, and unseen ones, become 'grouped', matched whole; columns with one value are dropped."""

    step = GroupRareModel

    def learn(self, df, cols, threshold=0.05):
        if not threshold > 0:
            raise ValueError("threshold must be above 0")
        valid, dropped, total = {}, [], df.count()
        for c in cols:
            counts = df.groupBy(c).count()
            if counts.limit(2).count() <= 1:
                dropped.append(c)
            else:
                # Fewer than 1 / threshold values can have more than that share, so few are collected.
                common = counts.where(F.col(c).isNotNull() & (F.col("count") / F.lit(total) > threshold)).collect()
                valid[c] = sorted(r[c] for r in common)
        return {"valid": valid, "dropped": dropped}

"""Projections, filters, casts, fills and recodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.steps import Fit, Step

GROUPS = {"float": "double", "int": "bigint", "binary": "tinyint", "category": "string", "datetime": "timestamp_ntz"}


class ApplyTypes(Step):
    """Casts columns by type group; a column in no group keeps its type. Names of absent columns are an error."""

    def apply(self, df, **groups):
        return df.withColumns({c: F.col(c).cast(GROUPS[g]) for g, cols in groups.items() for c in cols})

    @staticmethod
    def unlisted(df: DataFrame, **groups) -> list[str]:
        """Columns that no group names, which are only reported."""
        named = {c for cols in groups.values() for c in cols}
        return [c for c in df.columns if c not in named]


def try_numeric(df: DataFrame, cols: list[str], kind: str = "double") -> DataFrame:
    """Casts; a value that cannot be read as a number becomes null."""
    return df.withColumns({c: F.col(c).try_cast(kind) for c in cols})


class ColumnSelector(Step):
    def apply(self, df, cols):
        return df.select(*cols)


class ColumnDropper(Step):
    """Drops columns; absent names are tolerated."""

    def apply(self, df, cols):
        return df.drop(*cols)


_FAMILIES = {"float": (T.FloatType, T.DoubleType), "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "str": (T.StringType,), "bool": (T.BooleanType,), "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType)}


def family(field: T.StructField) -> str:
    """float, int, category (a string column with that metadata), str, bool, datetime or other."""
    if isinstance(field.dataType, T.StringType) and field.metadata.get("kind") == "category":
        return "category"
    return next((k for k, kinds in _FAMILIES.items() if isinstance(field.dataType, kinds)), "other")


class TypeSelectorModel(Step):
    def apply(self, df, cols, types, include=None, exclude=None):
        now = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        changed = [c for c in cols if now.get(c) != types[c]]
        if changed:
            raise ValueError(f"types changed since the fit: {changed}")
        return df.select(*cols)


class TypeSelector(Fit):
    """Selects columns by type family. An empty selection is an error, and so is a type that differs from the fit's."""

    step = TypeSelectorModel

    def learn(self, df, include=None, exclude=None):
        fields = [f for f in df.schema.fields if (not include or family(f) in include) and not (exclude and family(f) in exclude)]
        if not fields:
            raise ValueError("no column has such a type")
        return {"cols": [f.name for f in fields], "types": {f.name: f.dataType.simpleString() for f in fields}}


def as_category(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string").alias(c, metadata={"kind": "category"}) for c in cols})


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.lower() for c in df.columns))


class RowFilter(Step):
    """Keeps rows for which all conditions hold. Fitting data and data to score may have conditions of their own: `fitting` and `scoring`, named by `use`."""

    def apply(self, df, fitting, scoring=None, use="fitting"):
        conditions = (scoring if scoring is not None else fitting) if use == "scoring" else fitting
        return df.filter(reduce(lambda a, b: a & b, (F.expr(c) for c in conditions), F.lit(True)))


def drop_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


class FillNull(Step):
    """Fills nulls in the columns (all without a list) with one value, or by kind: 0 in numbers, 'missing' in strings. NaN counts as null."""

    def apply(self, df, value=None, cols=None):
        cols = cols or df.columns
        if value is not None:
            return df.fillna(value, cols)
        return df.fillna(0, cols).fillna("missing", cols)


class MeanImputerModel(Step):
    def apply(self, df, cols, means, indicator=False):
        new = {f"{c}_dropind": F.isnull(c).cast("int") for c in cols} if indicator else {}
        return df.withColumns(new | {c: F.coalesce(F.col(c), F.lit(means[c])) for c in cols})


class MeanImputer(Fit):
    """Fills nulls with the fitted mean; `indicator` adds <column>_dropind, 1 where the value was null. All means come from one aggregate."""

    step = MeanImputerModel

    def learn(self, df, cols, indicator=False):
        row = df.agg(*(F.avg(c).alias(c) for c in cols)).first()
        return {"means": {c: row[c] for c in cols}}


class ClipNegative(Step):
    """Negative values, and nulls, become 0."""

    def apply(self, df, cols):
        return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)).otherwise(0) for c in cols})


def encode_sex(c: Column) -> Column:
    """0 for f, 1 for m in either case, 0.5 for anything else and null."""
    return F.when(F.lower(c) == "f", 0.0).when(F.lower(c) == "m", 1.0).otherwise(0.5)


class EncodeSex(Step):
    """encode_sex of a column, as a stage."""

    def apply(self, df, col):
        return df.withColumn(col, encode_sex(F.col(col)))


def recode_12(c: Column) -> Column:
    """1 for code 1 and 0 for code 2."""
    return F.abs(c - 2)


def binarize_score(c: Column, last_low: int = 7, top: int = 10) -> Column:
    """0 for scores from 0 to last_low, 1 from there to the top, null outside."""
    return F.when(c.between(0, last_low), 0).when((c > last_low) & (c <= top), 1)


# The federal states of Brazil by macro region.
REGIONS = {"norte": "AC AM AP PA RO RR TO", "nordeste": "AL BA CE MA PB PE PI RN SE", "centro-oeste": "DF GO MS MT", "sudeste": "ES MG RJ SP", "sul": "PR RS SC"}


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default=None) -> DataFrame:
    """df with `value` from a table with one row for each key; the default where the key is absent."""
    got = df.join(table, key, "left")
    return got if default is None else got.withColumn(value, F.coalesce(value, F.lit(default)))


def lookup_region(df: DataFrame, key: str) -> DataFrame:
    """df with the column regiao of the state in `key`, 'null' where it is none."""
    rows = [(s, region) for region, states in REGIONS.items() for s in states.split()]
    return lookup(df, df.sparkSession.createDataFrame(rows, f"{key} string, regiao string"), key, "regiao", "null")


def classify_contains(c: Column, rules: list[tuple[str, str]], default: str = "GERAL") -> Column:
    """The class of the first rule (substring, class) whose substring the text contains."""
    found = F.lit(None).cast("string")
    for part, name in reversed(rules):
        found = F.when(c.contains(part), F.lit(name)).otherwise(found)
    return F.coalesce(found, F.lit(default))


def encode_map(c: Column, codes: dict[str, int], strict: bool = False) -> Column:
    """The code of a category; an unknown one gives null, or an error when strict."""
    code = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))[c]
    return F.when(F.assert_true(code.isNotNull() | c.isNull(), "unknown category").isNull(), code) if strict else code


def zfill(c: Column, n: int = 11) -> Column:
    """Padded with zeros to n digits; a longer text stays whole."""
    s = c.cast("string")
    return F.when(F.length(s) < n, F.lpad(s, n, "0")).otherwise(s)


def two_scores(df: DataFrame, first: str, second: str, date: str, since, name: str) -> DataFrame:
    """Rows with the first score, or with the second one dated after `since`, and the first of the two that is not null."""
    return df.filter(F.col(first).isNotNull() | (F.col(second).isNotNull() & (F.col(date) > F.lit(since)))).withColumn(name, F.coalesce(first, second))


def presence_flag(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with 1 where the other table has the keys and 0 elsewhere, null keys included."""
    return df.join(other.select(*keys).distinct().withColumn(name, F.lit(1)), keys, "left").fillna(0, [name])


class CustomStep(Step):
    """A named SQL statement over __THIS__ as a stage; a Python function fits DataFrame.transform directly."""

    def apply(self, df, statement):
        return df.sparkSession.sql(statement.replace("__THIS__", "{t}"), t=df)


def between_dates(c: Column, lo, hi, closed: str = "left") -> Column:
    """In [lo, hi), or in (lo, hi] with closed='right'."""
    lo, hi = F.lit(lo), F.lit(hi)
    return (c >= lo) & (c < hi) if closed == "left" else (c > lo) & (c <= hi)


def valid_text(c: Column) -> Column:
    return c.isNotNull() & ~c.isin("", "<NA>")

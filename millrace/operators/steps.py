"""Transformers and estimators of this library as pyspark.ml stages, so that pipelines of them save and load.

A stage's options and small fitted values are one JSON parameter; what grows with the data is a table, kept as Parquet and saved beside the parameter."""

from __future__ import annotations

import json
import uuid

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import DataFrame, SparkSession

from millrace.operators.lineage import shared_dir


class _Stateful(Params):
    state = Param(Params._dummy(), "state", "options and fitted values as JSON", typeConverter=TypeConverters.toString)

    def __init__(self, **options):
        super().__init__()
        self._set(state=json.dumps(options))

    @property
    def values(self) -> dict:
        return json.loads(self.getOrDefault(self.state))


class _TableWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        for name, source in self.instance.tables.items():
            SparkSession.active().read.parquet(source).write.parquet(f"{path}/tables/{name}")


class _TableReader(DefaultParamsReader):
    def load(self, path: str):
        step = super().load(path)
        step.tables = {name: f"{path}/tables/{name}" for name in step.values.get("table_names", [])}
        return step


class Step(_Stateful, Model, DefaultParamsReadable, DefaultParamsWritable):
    """A stage that needs no fit, or the result of one. Subclasses define apply(df, values)."""

    def __init__(self, **options):
        super().__init__(**options)
        #: Fitted tables: name -> path of a Parquet folder.
        self.tables: dict[str, str] = {}

    def write(self) -> _TableWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> _TableReader:
        return _TableReader(cls)

    def table(self, name: str) -> DataFrame:
        return SparkSession.active().read.parquet(self.tables[name])

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.apply(df, **{k: v for k, v in self.values.items() if k != "table_names"})

    def apply(self, df: DataFrame, **values) -> DataFrame:
        raise NotImplementedError


class Fit(_Stateful, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """A stage that learns. Subclasses define learn(df, **options), which returns what the step adds to its options, and name the step. An entry `tables` of
    that, name -> DataFrame, is written to the folder that driver and executors share, and handed to the step as tables."""

    step: type[Step]

    def _fit(self, df: DataFrame) -> Step:
        options = self.values
        learned = self.learn(df, **options)
        tables, root = learned.pop("tables", {}), f"{shared_dir(df.sparkSession).rstrip('/')}/fitted-{uuid.uuid4().hex}"
        for name, table in tables.items():
            table.write.parquet(f"{root}/{name}")
        step = self.step(**options, **learned, **({"table_names": sorted(tables)} if tables else {}))
        step.tables = {name: f"{root}/{name}" for name in tables}
        return step

    def learn(self, df: DataFrame, **options) -> dict:
        raise NotImplementedError

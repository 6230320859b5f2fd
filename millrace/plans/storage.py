"""Readers and writers: tables are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from millrace.operators import aggregate as A
from millrace.operators import encode as E
from millrace.operators import models as M
from millrace.operators.lineage import shared_dir
from millrace.plans.registry import Registry
from millrace.sources import io as IO

R = Registry()


def _new(d, name):
    """A folder of its own in the folder that driver and executors share."""
    return f"{shared_dir(d.sparkSession).rstrip('/')}/io-{name}-{uuid.uuid4().hex}"


def _people(t):
    return t("customer").select("c_custkey", "c_name", "c_nationkey")


_PEOPLE = "SELECT c_custkey, c_name, c_nationkey FROM customer"
_SCHEMA = "c_custkey long, c_name string, c_nationkey int"


@R.query("io1_read_delimited", "SELECT c_custkey, c_name FROM customer")
def _(t):
    d, path = _people(t), _new(_people(t), "csv")
    IO.write_csv(d, path, sep=";")
    return IO.read_delimited(d.sparkSession, path, _SCHEMA, ";", ["c_custkey", "c_name"])


@R.query("io2_read_lines_split", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def _(t):
    d, path = _people(t), _new(_people(t), "lines")
    IO.write_csv(d.repartition(3), path, sep="|")
    return IO.read_lines_split(d.sparkSession, path, "|")


@R.query("io3_read_headerless", _PEOPLE)
def _(t):
    d, path = _people(t), _new(_people(t), "bare")
    IO.write_csv(d, path, header=False)
    return IO.read_headerless(d.sparkSession, path, _SCHEMA)


@R.query("io4_read_parquet_union", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 5 < 3 THEN 1 END AS extra FROM customer")
def _(t):
    d, path = _people(t), _new(_people(t), "union")
    IO.write_parquet(d.where("c_custkey % 5 < 3").withColumn("extra", F.lit(1)), path + "/a")
    IO.write_parquet(d.where("c_custkey % 5 >= 3"), path + "/b")
    IO.write_parquet(d.where("c_custkey % 5 = 4"), path + "/c")
    return IO.read_parquet_union(d.sparkSession, [f"{path}/{k}" for k in "abc"])


@R.query("io5_read_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01'")
def _(t):
    return IO.read_range(t("orders"), "o_orderdate", "1996-01-01", "1996-02-01").select("o_orderkey")


@R.query("io6_sql", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    d = _people(t)
    return IO.sql(d.sparkSession, "select c_nationkey, count(*) as n from {people} group by 1", people=d)


@R.query("io7_read_annotations", "SELECT s_name AS text, 0 AS start, 3 AS \"end\", 'N' AS label FROM supplier")
def _(t):
    d, path = t("supplier"), _new(t("supplier"), "json")
    span = F.array(F.struct(F.lit(0).alias("startOffset"), F.lit(3).alias("endOffset"), F.lit("N").alias("label")))
    first = d.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("source"), F.array(F.struct(F.struct(F.struct(span.alias("entities")).alias("x")).alias("answerContent"))).alias("answers"))
    second = d.where("s_suppkey % 2 = 1").select(F.col("s_name").alias("source"), F.struct(F.struct(F.struct(F.struct(span.alias("entities")).alias("annotations")).alias("job")).alias("content")).alias("consolidatedAnnotation"))
    for name, x in (("a", first), ("b", second)):
        IO.write_documents(x, f"{path}/{name}", "source")
    return IO.read_annotations(d.sparkSession, [f"{path}/a", f"{path}/b"]).drop("file")


@R.query("io8_route_files", "SELECT c_name, CASE WHEN contains(c_name, '7') THEN 'sete' ELSE 'tres' END AS \"table\" FROM customer WHERE contains(c_name, '7') OR contains(c_name, '3')")
def _(t):
    return IO.route_files(_people(t), "c_name", {"sete": "7", "tres": "3"})


@R.query("io9_parse_names", "SELECT c_custkey, c_name AS nome, CAST(c_nationkey AS VARCHAR) AS codigo FROM customer WHERE c_custkey % 3 > 0")
def _(t):
    parts = F.concat_ws(" - ", "c_name", F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "x"))
    d = _people(t).select("c_custkey", F.concat(F.lit("/in/"), parts, F.lit(".wav")).alias("path"))
    return IO.parse_names(d, "path", ["nome", "codigo"]).drop("path")


@R.query("io10_write_parquet", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey = 1")
def _(t):
    d, path = _people(t), _new(_people(t), "gzip")
    IO.write_parquet(d, path, ["c_nationkey"])
    return d.sparkSession.read.parquet(path).where("c_nationkey = 1").select(*d.columns)


@R.query("io11_write_csv", _PEOPLE)
def _(t):
    d, path = _people(t), _new(_people(t), "csv")
    IO.write_csv(d, path, sep="\t")
    return d.sparkSession.read.schema(_SCHEMA).options(sep="\t", header=True).csv(path)


@R.query("io12_write_table", _PEOPLE)
def _(t):
    d, name = _people(t), f"people_{uuid.uuid4().hex}"
    IO.write_table(d, name)
    return d.sparkSession.table(name)


@R.query("io13_append_registry", "SELECT c_custkey, c_name FROM customer ORDER BY 1")
def _(t):
    d, path = _people(t).select("c_custkey", "c_name"), _new(_people(t), "registry")
    IO.append_registry(d.where("c_custkey % 5 < 3"), path, ["c_custkey"])
    return IO.append_registry(d.where("c_custkey % 5 >= 2"), path, ["c_custkey"])


@R.query("io14_write_by_group", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    d, path = _people(t), _new(_people(t), "groups")
    IO.write_by_group(d, "c_nationkey", path)
    return d.sparkSession.read.parquet(path).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@R.query("io15_probe", "SELECT CAST(floor(count(*) * 0.2) AS BIGINT) AS n FROM orders")
def _(t):
    d, path = t("orders"), _new(t("orders"), "probe")
    IO.probe(d, path, 0.2, exact_key=["o_orderkey"])
    return d.sparkSession.read.parquet(path).agg(F.count("*").alias("n"))


_PROBED = " UNION ALL ".join(f"SELECT '{k}' AS property, (SELECT {agg.format('v')} FROM twice) / (SELECT {agg.format('o_totalprice')} FROM orders) - 1 AS ratio" for k, agg in {"mean": "avg({})", "std": "stddev({})", "min": "min({})", "max": "max({})", "q50": "quantile_cont({}, 0.5)", "q75": "quantile_cont({}, 0.75)", "skew": "skewness({})", "kurtosis": "kurtosis({})"}.items())


@R.query("io16_monitor_probes", f"WITH twice AS (SELECT o_totalprice * 2 AS v FROM orders, range(2)) SELECT 'o_totalprice' AS feature, property FROM ({_PROBED}) WHERE abs(ratio) > 0.15")
def _(t):
    d, path = t("orders").select("o_totalprice"), _new(t("orders"), "probes")
    base = A.profile(d, ["o_totalprice"])
    for k in (2, 2):
        IO.probe(d.withColumn("o_totalprice", F.col("o_totalprice") * k), path)
    return IO.monitor_probes(d.sparkSession, path, base, ["o_totalprice"]).select("feature", "property")


@R.query("io17_latest", "SELECT c_custkey FROM customer WHERE c_custkey % 5 >= 2")
def _(t):
    d, path = _people(t).select("c_custkey"), _new(_people(t), "versions")
    IO.write_parquet(d.where("c_custkey % 5 < 3"), path + "/v00000001")
    IO.write_parquet(d.where("c_custkey % 5 >= 2"), path + "/v00000002")
    return IO.latest(d.sparkSession, path)


_CODED = "(SELECT c_custkey, c_acctbal, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer)"


@R.query("l26_saved_pipeline", f"SELECT c_custkey, CAST(code AS INTEGER) AS c_mktsegment, round(code * (SELECT sum(code * c_acctbal) / sum(code * code) FROM {_CODED}), 4) AS prediction FROM {_CODED}")
def _(t):
    """A fitted pipeline, one stage of which keeps a table, is saved and loaded again; the loaded one codes and predicts."""
    d, path = t("customer").select("c_custkey", "c_mktsegment", "c_acctbal"), _new(t("customer"), "pipeline")
    stages = [E.LabelEncoder(cols=["c_mktsegment"]), *M.pipeline("ols", "regression", ["c_mktsegment"], "c_acctbal").getStages()]
    Pipeline(stages=stages).fit(d).write().save(path)
    return PipelineModel.load(path).transform(d).select("c_custkey", "c_mktsegment", F.round("prediction", 4).alias("prediction"))


queries, oracle_sql = R.queries, R.oracle_sql

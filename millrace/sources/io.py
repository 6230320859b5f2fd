"""Readers and writers. Schemas are given, not inferred; nothing that is read is overwritten."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.sets import sample_rows


def read_delimited(spark: SparkSession, paths: str | list[str], schema: str | T.StructType, sep: str = ";", cols: list[str] | None = None, encoding: str = "ISO-8859-1") -> DataFrame:
    """Delimited files with a header line; only the chosen columns are parsed."""
    d = spark.read.schema(schema).options(sep=sep, encoding=encoding, header=True, enforceSchema=True).csv(paths)
    return d.select(*cols) if cols else d


def read_lines_split(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Ragged files: whole lines split at the separator and named by the first line of a file, which each file begins with; missing fields are null, surplus
    ones dropped, blank lines left out."""
    names = spark.read.text(path).first()[0].split(sep)
    lines = spark.read.schema("value string").options(header=True, sep="\u0001", quote="", enforceSchema=True).csv(path)
    parts = F.split("value", _quoted(sep))
    return lines.select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))


def _quoted(sep: str) -> str:
    return "\\" + sep if sep in "|.*+?^$()[]{}\\" else sep


def read_headerless(spark: SparkSession, path: str | list[str], schema: str | T.StructType, sep: str = ",") -> DataFrame:
    """Files without a header: every line is data."""
    return spark.read.schema(schema).options(sep=sep, header=False).csv(path)


def read_parquet_union(spark: SparkSession, paths: list[str], dedup: bool = True) -> DataFrame:
    """All files of the paths together; columns that some lack are null there."""
    d = spark.read.option("mergeSchema", True).parquet(*paths)
    return d.dropDuplicates() if dedup else d


def read_range(df: DataFrame, date_col: str, lo, hi) -> DataFrame:
    """Rows dated in [lo, hi); over a JDBC or Parquet scan the range is pushed down."""
    return df.where((F.col(date_col) >= F.lit(lo)) & (F.col(date_col) < F.lit(hi)))


def read_jdbc(spark: SparkSession, url: str, name: str, date_col: str | None = None, lo=None, hi=None, partitions: int = 8, **options) -> DataFrame:
    """A table over JDBC, read in ranges of dates where a date column is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if date_col:
        reader = reader.options(partitionColumn=date_col, lowerBound=str(lo), upperBound=str(hi), numPartitions=partitions)
        return read_range(reader.load(), date_col, lo, hi)
    return reader.load()


_SPAN = "struct<startOffset:int,endOffset:int,label:string>"
ANNOTATION = f"source string, answers array<struct<answerContent:map<string,struct<entities:array<{_SPAN}>>>>>, consolidatedAnnotation struct<content:map<string,struct<annotations:struct<entities:array<{_SPAN}>>>>>"


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, start, end, label) of annotation JSON, in either layout: answers of workers or a consolidated annotation. A file holds one document or an array of them."""
    d = spark.read.schema(ANNOTATION).option("multiLine", True).json(path)
    first = F.flatten(F.flatten(F.transform("answers", lambda a: F.transform(F.map_values(a["answerContent"]), lambda v: v["entities"]))))
    second = F.flatten(F.transform(F.map_values("consolidatedAnnotation.content"), lambda v: v["annotations"]["entities"]))
    return d.select(F.input_file_name().alias("file"), F.col("source").alias("text"), F.explode(F.coalesce(first, second)).alias("e")).select("file", "text", F.col("e.startOffset").alias("start"), F.col("e.endOffset").alias("end"), "e.label")


def write_documents(df: DataFrame, path: str, key: str, most: int = 1000) -> None:
    """JSON files each of which holds an array of some `most` rows, dealt by the hash of a key: layouts that are read as whole documents, in files that grow in
    number with the rows' thousandths. A file for each row would cost the file system, and the driver that lists and commits, more than the rows do."""
    files = max(1, -(-df.count() // most))
    made = df.select(F.pmod(F.xxhash64(key), F.lit(files)).alias("_f"), F.to_json(F.struct("*")).alias("_j")).groupBy("_f").agg(F.array_join(F.collect_list("_j"), ",").alias("_j"))
    made.select(F.concat(F.lit("["), "_j", F.lit("]")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def route_files(files: DataFrame, path: str, rules: dict[str, str]) -> DataFrame:
    """(path, table): the first table whose part of a name the path contains; others are left out."""
    c = F.coalesce(*(F.when(F.contains(F.lower(path), F.lit(part.lower())), F.lit(table)) for table, part in rules.items()))
    return files.select(path, c.alias("table")).where("table is not null")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of files below a path by name pattern; contents are not read."""
    return spark.read.format("binaryFile").options(pathGlobFilter=pattern, recursiveFileLookup=True).load(path).select("path", "length", "modificationTime")


def parse_names(df: DataFrame, col: str, fields: list[str], sep: str = " - ") -> DataFrame:
    """The fields of names with exactly as many parts; names of other shapes are left out."""
    d = df.withColumn("_p", F.split(F.regexp_replace(F.element_at(F.split(col, "/"), -1), r"\.[^.]*$", ""), sep)).where(F.size("_p") == len(fields))
    return d.select(*df.columns, *(F.trim(F.get("_p", F.lit(i))).alias(f) for i, f in enumerate(fields)))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "error") -> None:
    df.write.mode(mode).option("compression", "gzip").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", mode: str = "error") -> None:
    df.write.mode(mode).options(header=header, sep=sep).csv(path)


def write_table(df: DataFrame, name: str, mode: str = "overwrite", url: str | None = None, **options) -> None:
    """Into a database over JDBC, or into the catalogue."""
    if url:
        df.write.mode(mode).format("jdbc").options(url=url, dbtable=name, **options).save()
    else:
        df.write.mode(mode).saveAsTable(name)


def write_by_group(df: DataFrame, col: str, path: str, mode: str = "error") -> None:
    """One folder for each value; rows of a value are dealt to as many files as Spark's rebalancing makes of them."""
    df.hint("rebalance", col).write.mode(mode).partitionBy(col).parquet(path)


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of version folders below a root, in order; none if there is no such root."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []


def latest(spark: SparkSession, root: str) -> DataFrame | None:
    """The table of the last version, None without one."""
    names = versions(spark, root)
    return spark.read.parquet(f"{root}/{names[-1]}") if names else None


def append_registry(new: DataFrame, root: str, sort_by: list[str]) -> DataFrame:
    """Writes a new version that holds the last one's rows and the new ones, without repeats, in order; versions already there stay as they are."""
    spark = new.sparkSession
    names, old = versions(spark, root), latest(spark, root)
    both = (new if old is None else old.unionByName(new)).dropDuplicates().orderBy(*sort_by)
    path = f"{root}/v{len(names) + 1:08d}"
    both.write.parquet(path)
    return spark.read.parquet(path)


def probe(df: DataFrame, path: str, keep_ratio: float = 1.0, seed: int = 0, exact_key: list[str] | None = None, at: datetime.datetime | None = None) -> None:
    """Appends a sample of the rows with the time of the probe. exact_key: columns by whose hashes exactly that share of the rows is drawn."""
    d = df
    if keep_ratio < 1 and exact_key:
        d = sample_rows(df, exact_key, round(df.count() * keep_ratio), seed)
    elif keep_ratio < 1:
        d = df.sample(keep_ratio, seed)
    d.withColumns({"probe_ts": F.lit(at or datetime.datetime.now()).cast("timestamp_ntz"), "probe_id": F.lit(uuid.uuid4().hex)}).write.mode("append").parquet(path)


def monitor_probes(spark: SparkSession, path: str, baseline: DataFrame, cols: list[str], threshold: float = 0.15) -> DataFrame:
    """Drift of all probes together against a baseline profile."""
    from millrace.operators.aggregate import profile
    from millrace.operators.monitor import numeric_drift

    return numeric_drift(baseline, profile(spark.read.parquet(path), cols), threshold)


def sql(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """A query over named tables and the catalogue."""
    return spark.sql(query, **tables)



"""Reads: driver tables, JSON documents, JSON-lines logs, YAML and binary artifacts."""

from __future__ import annotations

import tempfile
import uuid

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder, which may be in any store that Spark reads."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_json_objects(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON files of one object each; a file that is none has nulls and its text in ``_corrupt_record``."""
    full = StructType([*schema.fields]).add("_corrupt_record", "string")
    return spark.read.schema(full).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows: (path, raw, size, sha) with sha the SHA-256 of the bytes, which is an artifact's address. Spark lists no empty files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("content").alias("raw"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha"))


def read_yaml_objects(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """YAML files of one mapping each as rows of schema, with ``path`` and ``problem`` (null if the file is a mapping)."""
    import json

    import pandas as pd

    def parse(batches):
        for pdf in batches:
            texts, problems = [], []
            for raw in pdf["content"]:
                try:
                    value = yaml.safe_load(bytes(raw).decode("utf-8"))
                    ok = isinstance(value, dict)
                    texts.append(json.dumps(value, default=str) if ok else None)
                    problems.append(None if ok else "not_a_mapping")
                except (yaml.YAMLError, UnicodeDecodeError):
                    texts.append(None)
                    problems.append("not_yaml")
            yield pd.DataFrame({"path": pdf["path"], "json": texts, "problem": problems})

    parsed = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, json string, problem string")
    return parsed.select("path", F.from_json("json", schema).alias("value"), "problem").select("path", "value.*", "problem")


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the Parquet store at path does not hold; returns how many. First of equal keys wins."""
    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    try:
        held = spark.read.parquet(path).select(key)
    except Exception as e:  # the store does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = None
    if held is not None:
        fresh = fresh.join(held, key, "left_anti")
    fresh = fresh.cache()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


#: Rows of a part where rows are dealt out by hand.
ROWS = 100_000


def dealt(df: DataFrame, *keys: str, rows: int = ROWS) -> DataFrame:
    """df dealt out by keys into parts of so many rows, which Spark leaves as they are: what a task holds does not grow with the
    table, and windows and aggregates by these keys need no other shuffle. df is counted first, which costs a table next to nothing."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.count() // rows), *keys)


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where none is named: a temporary one if driver and tasks are one process, as in tests, else one in the warehouse, which
    must then be a place that all can reach.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        if context.master == "local" or context.master.startswith("local["):
            if context.applicationId not in _local:
                _local[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='veritrail-')}"
            return _local[context.applicationId]
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if "://" not in warehouse or warehouse.startswith("file:"):
            raise ValueError(f"spark.checkpoint.dir names no shared folder, and the warehouse {warehouse} is one of the driver's machine")
        named = warehouse.rstrip("/") + "/veritrail"
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what many steps read is made once, and outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)

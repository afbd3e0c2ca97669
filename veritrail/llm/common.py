"""What the training-data operators share: table reads, the shared folder, written tables, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Copies of a node's row in the joins of ``components``; a hub's edges go to that many tasks.
SALTS = 8
_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the path may be one that only Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where none is named: a temporary one if driver and tasks are one process, as in tests, else one in the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        alone = context.master == "local" or context.master.startswith("local[")
        if alone and context.applicationId not in _local:
            _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="veritrail-")
        named = _local[context.applicationId] if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/veritrail"
    return named.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written to the shared folder (with the writer's options) and read again, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a written table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def unused(name: str, columns: list[str]) -> str:
    """The name, or one made of it that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; every other character stays as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32(doc_id as text) mod divisor, the fold of a document; null for a null id."""
    return F.crc32(doc_id.cast("string")) % divisor


def _salted_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the least neighbour of u; the rows of one u are spread over SALTS tasks."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(copies, ["u", "salt"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of undirected edges (a, b): root is the least node that it reaches.

    Large-star and small-star steps alternate until the edges are stars. Each round's edges are a written
    table; nothing but a count and a checksum reaches the driver. Self-links and repeats are harmless.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _salted_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = _salted_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        before, edges = edges, written(small.where("u > v").distinct(), "edges")
        dropped(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

"""Streaming twins of the append-only logs: tolerant reads, tumbling ledgers, ordered admission, latest decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from veritrail.sources.event_log import events_of


def table_stream(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    """A Parquet folder as a stream, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON-lines logs as a stream of events; malformed lines are left out, as in the batch read."""
    return events_of(spark.readStream.text(path))


def daily_totals(charges: DataFrame, ts: str, amount: str, late: str = "1 hour") -> DataFrame:
    """(day, total, n) of a stream of charges; the watermark bounds the state."""
    windows = charges.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, "1 day"))
    return windows.agg(F.sum(F.col(amount).cast("decimal(28,6)")).alias("total"), F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "total", "n")


def latest_decisions(log: DataFrame, action: str, order: str, status: str) -> DataFrame:
    """(action, status) as of now, for the update mode; automatic and pending entries do not count."""
    return log.where(F.col(status).isin("approved", "rejected")).groupBy(action).agg(F.max_by(status, order).alias(status))


def admissions(requests: DataFrame, run: str, order: str, amount: str, limit: float, calls: int) -> DataFrame:
    """(run, order, amount, admitted, used): requests admitted in order while calls and amount fit; a refused one uses nothing.

    The state of a run is two numbers. Within a batch a run's requests are sorted; across batches arrival is the order.
    """
    schema = f"{run} long, {order} long, {amount} double, admitted boolean, used double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, used = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(order)
        flags, totals = [], []
        for x in rows[amount]:
            fits = n < calls and used + x <= limit
            n, used = (n + 1, used + x) if fits else (n, used)
            flags.append(fits)
            totals.append(used)
        state.update((n, used))
        yield rows.assign(admitted=flags, used=totals)[[run, order, amount, "admitted", "used"]]

    picked = requests.select(F.col(run).cast("long"), F.col(order).cast("long"), F.col(amount).cast("double"))
    return picked.groupBy(run).applyInPandasWithState(step, schema, "n long, used double", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that a stream holds now to a Parquet folder, exactly once for each batch, and stops."""
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        put = lambda df, n: df.write.mode("overwrite").parquet(path)
        query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

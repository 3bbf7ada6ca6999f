"""Structured Streaming: incremental bars, deduplicated intake, sessions, and stateful monitors.

Each function takes a streaming (or static) DataFrame and returns one; `run_available` runs a query over what has arrived
and returns its output as a table, which is how tests and registered queries use them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_dir


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The bracket makes the path a pattern, which may name a single file as well as a folder.
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def bars(events: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Tumbling bars; a bar is final once the watermark has passed its end."""
    order = F.struct("ts", "event_id")
    out = events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), F.col("event_type").alias("symbol"))
    out = out.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("ticks"))
    return out.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "ticks")


def intake(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """Idempotent intake: a key counts once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events", "total")


def drift_monitor(events: DataFrame, key: str, value: str, target: float, slack: float, limit: float) -> DataFrame:
    """CUSUM by key over micro-batches: a row whenever a side passes the limit, after which it starts anew.

    A task holds 24 bytes an event of a key and micro-batch, and as much again while it puts them in order.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down, n = state.get if state.exists else (0.0, 0.0, 0)
        # Bare numbers of each batch at once, so that no data frame of the whole key is made.
        parts = [(b["_us"].to_numpy(np.int64), b["event_id"].to_numpy(np.int64), b[value].to_numpy(np.float64)) for b in batches]
        at, event, values = (np.concatenate([p[i] for p in parts]) for i in range(3))
        del parts
        values = values[np.lexsort((event, at))]
        del at, event
        alarms = []
        for i in range(0, len(values), 65_536):
            for x in values[i : i + 65_536].tolist():
                n += 1
                up, down = max(0.0, up + x - target - slack), max(0.0, down - (x - target) - slack)
                if up > limit or down > limit:
                    alarms.append((name[0], n, "up" if up > limit else "down"))
                    up = down = 0.0
        state.update((up, down, n))
        yield pd.DataFrame(alarms, columns=[key, "n", "side"])

    kind = dict(events.dtypes)[key]
    view = events.select(key, F.unix_micros("ts").alias("_us"), "event_id", F.col(value).cast("double").alias(value))
    return view.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, side string", "up double, down double, n long", "append", GroupStateTimeout.NoTimeout)


def admission(requests: DataFrame, key: str, seconds: int, most: int) -> DataFrame:
    """Sliding-window pacing: a request is admitted while fewer than `most` admitted ones lie in the last seconds; denials don't count."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for ts, event in zip(rows["ts"], rows["event_id"], strict=True):
            now = ts.timestamp()
            recent = [t for t in recent if t > now - seconds]
            admitted = len(recent) < most
            if admitted:
                recent.append(now)
            out.append((name[0], event, admitted))
        state.update((recent,))
        yield pd.DataFrame(out, columns=[key, "event_id", "admitted"])

    kind = dict(requests.dtypes)[key]
    return requests.select(key, "ts", "event_id").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id long, admitted boolean", "recent array<double>", "append", GroupStateTimeout.NoTimeout)


def run_available(out: DataFrame) -> DataFrame:
    """Runs a stream over all that has arrived, into a table of the shared folder."""
    spark = out.sparkSession
    path = f"{shared_dir(spark)}/tidemark/stream-{uuid.uuid4().hex}"
    out.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}-state").format("parquet").outputMode("append").start(path).awaitTermination()
    return spark.read.schema(out.schema).parquet(path)

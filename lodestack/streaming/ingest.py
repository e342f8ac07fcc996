"""Streams: files dropped into a folder, taken once, deduplicated by content, run through idempotent stages."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

IN_PROGRESS = (".part", ".tmp", ".crdownload", ".download", ".filepart")
MAX_ATTEMPTS = 3
RUN_LOG = "job_id string, stage string, result string, attempts int, ms long, message string"


def eligible_name(path):
    """File names that may be taken: no dot or underscore in front, not still being written, no sidecar."""
    name = F.element_at(F.split(path, "/"), -1)
    busy = F.lit(False)
    for s in IN_PROGRESS:
        busy = busy | F.endswith(F.lower(name), F.lit(s))
    return ~F.startswith(name, F.lit(".")) & ~F.startswith(name, F.lit("_")) & ~busy & ~F.endswith(F.lower(name), F.lit(".meta.yaml"))


def dropped_files(spark: SparkSession, folder: str, glob: str = "*", max_per_batch: int = 1000) -> DataFrame:
    """A stream of (path, modified, length, sha256) of the files in a folder, those eligible by name."""
    raw = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
           .option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_per_batch).load(folder))
    return raw.filter(eligible_name(F.col("path"))).select(
        "path", F.col("modificationTime").alias("modified"), "length", F.sha2("content", 256).alias("sha256"))


def stable(samples: DataFrame, now, seconds: int = 5) -> DataFrame:
    """Files whose last two samples (path, size, modified, seen_at) agree and whose size has held for `seconds`."""
    w = Window.partitionBy("path").orderBy("seen_at")
    runs = samples.withColumn("changed", F.coalesce((F.lag("size").over(w) != F.col("size")) | (F.lag("modified").over(w) != F.col("modified")), F.lit(True)))
    since = runs.groupBy("path").agg(F.max(F.when(F.col("changed"), F.col("seen_at"))).alias("since"), F.max_by("size", "seen_at").alias("size"))
    return since.filter(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("since") >= seconds * 1_000_000).select("path", "size")


def once_by_content(stream: DataFrame, key: str = "sha256", ts: str | None = None, within: str | None = None) -> DataFrame:
    """Every content once, however often and under whatever name it comes.

    With a time column and a span, contents are remembered for the span only and the state stays bounded; `new_contents`
    in the sink then keeps out what comes again later. Without them every content is remembered.
    """
    if ts is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(ts, within or "7 days").dropDuplicatesWithinWatermark([key])


def new_contents(batch: DataFrame, taken: DataFrame, key: str = "sha256") -> DataFrame:
    """Rows of a batch whose content the sink doesn't hold yet, each content once: nothing needs to be remembered by the stream."""
    return batch.dropDuplicates([key]).join(taken.select(key), key, "left_anti").select(batch.columns)


def with_late_windows(stream: DataFrame, ts: str, width: str, lateness: str, keys: Sequence[str]) -> DataFrame:
    """Counts per tumbling window and key; rows later than `lateness` are dropped. An extension: the reference has no windows."""
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("window_start"), *keys, "n")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Take what is there now, batch by batch, and stop; the checkpoint remembers what was taken."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def batch_folder_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch into its own folder, so that a batch that is tried again replaces itself."""
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return write


def fold_jobs(events: DataFrame, job: str, stage: str, ts: str, order: str, failed: str = "error") -> DataFrame:
    """State of every job from its event log: attempts that failed, the last stage, and whether it may be tried again."""
    last = F.max_by(stage, F.struct(ts, order))
    return events.groupBy(job).agg(
        F.count("*").alias("n_events"), F.sum((F.col(stage) == failed).cast("int")).alias("failures"), last.alias("last_stage"),
        F.max(ts).alias("updated_at")).withColumn("state", F.when(F.col("failures") >= MAX_ATTEMPTS, "failed").when(
            F.col("last_stage") == failed, "retry").otherwise("ok"))


def run_stage(log: DataFrame, job_id: str, stage: str, fn: Callable[[], DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """(result, log with this run): a stage that the log says is ok isn't run again.

    The log has job_id, stage, result, attempts, ms, message; a run replaces the stage's entry. A failure adds an attempt and
    leaves its message; a stage that failed MAX_ATTEMPTS times is `failed`, before that `retry`. A stage that isn't built is `skipped`.
    """
    mine = (F.col("job_id") == job_id) & (F.col("stage") == stage)
    past = log.filter(mine).orderBy(F.desc("attempts")).select("result", "attempts").first()
    if past and past.result in ("ok", "failed"):
        return None, log
    out, outcome, message, began = None, "ok", None, time.monotonic()
    attempts = past.attempts if past else 0
    try:
        out = fn()
    except NotImplementedError as e:
        outcome, message = "skipped", str(e)
    except Exception as e:  # noqa: BLE001 - whatever a stage raises is its outcome, kept in the log
        attempts += 1
        outcome, message = ("failed" if attempts >= MAX_ATTEMPTS else "retry"), f"{type(e).__name__}: {e}"
    row = [(job_id, stage, outcome, attempts, int(1000 * (time.monotonic() - began)), message)]
    entry = log.sparkSession.createDataFrame(row, RUN_LOG)
    return out, log.filter(~F.coalesce(mine, F.lit(False))).unionByName(entry)


class Stages:
    """An ordered list of stages, each bound to a function; an unbound one fails before anything runs."""

    def __init__(self, names: Sequence[str]):
        self.names, self.bound = list(names), {}

    def runs(self, name: str):
        if name not in self.names:
            raise KeyError(name)

        def bind(fn):
            self.bound[name] = fn
            return fn

        return bind

    def run(self, df: DataFrame) -> DataFrame:
        missing = [n for n in self.names if n not in self.bound]
        if missing:
            raise ValueError(f"stages without a function: {missing}")
        for n in self.names:
            df = self.bound[n](df)
        return df

"""The live event feed: one JSON event per logged request."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from costlens.functions.money import exact_sum
from costlens.functions.text import iso
from costlens.operators.reports import SUMS, _kpi_columns, _totals, kpi_totals
from costlens.schemas import LIVE_EVENT

LATENESS = "10 minutes"
KEPT_BATCHES = 10  # results of that many batches stay, for readers that opened one before it was replaced; at least 2
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # only a metric; for it each id stored is looked up once more
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def to_events(logs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``value``: the event of each row; the question appears only as its fingerprint."""
    renamed = {"type": F.lit("request"), "id": F.col("request_id"), "timestamp": iso(F.col("created_at")),
               "latency_ms": F.round("latency_ms", 2)}
    fields = [renamed.get(f.name, F.col(f.name)).alias(f.name) for f in LIVE_EVENT.fields]
    return logs.select(*(keep or []), F.to_json(F.struct(*fields)).alias("value"))


def read_frames(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw frames as a stream of text lines."""
    reader = spark.readStream.format("text")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def parse(frames: DataFrame, figures: list[str] | None = None) -> DataFrame:
    """Request events only; malformed frames and other types are dropped.

    ``figures``: the fields wanted beside id and time; all by default. A frame is parsed once: ``inline`` keeps Spark from
    moving the condition below the parser, where it would parse the frame again for each field it names.
    """
    always = ("type", "id", "timestamp")
    fields = [f for f in LIVE_EVENT.fields if f.name in always or figures is None or f.name in figures]
    event = frames.select(F.inline(F.array(F.from_json("value", StructType(fields)))))
    return event.where((F.col("type") == "request") & F.col("id").isNotNull()).select(
        F.col("id").alias("request_id"),
        F.to_timestamp("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"),
        *[f.name for f in fields if f.name not in always])


def deduplicated(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each request id once; the ids remembered expire with the watermark set here."""
    return events.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["request_id"])


def _keep_state_on_disk(spark: SparkSession) -> None:
    """Remembered ids and windows live in RocksDB, not in the heap of executors, unless the session names another store.

    Nor are the rows of that store counted, unless the session asks for it.
    """
    for key, value in _STATE.items():
        if key not in spark.conf.getAll:
            spark.conf.set(key, value)


def run(stream: DataFrame, output: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what is there into a Parquet folder, exactly once."""
    _keep_state_on_disk(stream.sparkSession)
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_batches(stream: DataFrame, handle, checkpoint: str, mode: str = "append") -> None:
    _keep_state_on_disk(stream.sparkSession)
    query = (
        stream.writeStream.foreachBatch(handle).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _batch_path(folder: str, batch_id: int) -> str:
    return f"{folder}/batch={batch_id:012d}"


def replace_batch(rows: DataFrame, folder: str, batch_id: int) -> None:
    """Write the result that a batch ends with and remove the one it replaces, KEPT_BATCHES earlier.

    A batch that is run again overwrites its own folder and removes the same one.
    """
    rows.write.mode("overwrite").parquet(_batch_path(folder, batch_id))
    if batch_id >= KEPT_BATCHES:
        spark = rows.sparkSession
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_batch_path(folder, batch_id - KEPT_BATCHES))
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


# ---- running figures ---------------------------------------------------------------------

TOTALLED = ["savings_usd", "baseline_cost_usd", "cache_hit", "fallback_used"]  # what the totals need of an event


def running_totals(events: DataFrame, output: str, checkpoint: str) -> None:
    """Keep the totals of the unique events; each batch replaces one small row."""
    totals = deduplicated(events).agg(*_totals())

    def publish(batch: DataFrame, batch_id: int) -> None:
        replace_batch(batch.select(*_kpi_columns(), F.struct(*SUMS).alias("sums")), output, batch_id)

    run_batches(totals, publish, checkpoint, "complete")


def latest_totals(spark: SparkSession, output: str) -> DataFrame:
    """The newest published row; only its folder is read."""
    return spark.read.parquet(_batch_path(output, max(_numbers(spark, output, "batch=")))).drop("sums")


def recent_events(events: DataFrame, output: str, checkpoint: str, keep: int) -> None:
    """The newest ``keep`` events: each batch is merged with the previous result."""
    spark = events.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id > 0:
            rows = rows.unionByName(spark.read.parquet(_batch_path(output, batch_id - 1)))
        newest = rows.dropDuplicates(["request_id"]).orderBy(F.desc("created_at"), F.desc("request_id")).limit(keep)
        replace_batch(newest, output, batch_id)

    run_batches(events, merge, checkpoint)


def latest_recent(spark: SparkSession, output: str) -> DataFrame:
    """The newest merged result; only its folder is read."""
    return spark.read.parquet(_batch_path(output, max(_numbers(spark, output, "batch="))))


def publish_snapshot(logs: DataFrame, totals: str, output: str) -> int:
    """Let the log's totals replace the live ones from here on; returns the number of the new version.

    A version is one row, written whole: the sums over ``logs``, and the stream's position, the newest batch in the folder
    ``totals`` of ``running_totals`` (-1 before the first), with the sums counted up to there. ``logs`` must hold the events
    of those batches. The stream goes on meanwhile; a reader takes the newest version and adds what was counted since.
    """
    spark = logs.sparkSession
    # the position is read first: a batch that ends meanwhile is added by readers
    position = max(_numbers(spark, totals, "batch="), default=-1)
    version = max(_numbers(spark, output, "version="), default=-1) + 1
    sums = F.struct(*SUMS)
    empty = logs.limit(0).agg(*_totals()).select(sums.alias("streamed"))
    streamed = spark.read.parquet(_batch_path(totals, position)).select(F.col("sums").alias("streamed")) if position >= 0 else empty
    row = logs.agg(*_totals()).select(
        F.lit(position).cast("long").alias("position"), sums.alias("sums"), F.lit(streamed.scalar()).alias("streamed"))
    row.write.parquet(f"{output}/version={version:012d}")
    return version


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers of the finished folders ``prefix<number>``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{prefix}*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return [int(status.getPath().getParent().getName()[len(prefix):]) for status in found]


def published_totals(spark: SparkSession, totals: str, output: str) -> DataFrame:
    """The newest snapshot plus what the stream counted after it; two one-row folders are read."""
    snapshot = spark.read.parquet(f"{output}/version={max(_numbers(spark, output, 'version=')):012d}")
    parts = snapshot.select("sums.*")
    newest = max(_numbers(spark, totals, "batch="), default=-1)
    if newest >= 0:
        before = snapshot.select(*[F.negative(f"streamed.{c}").alias(c) for c in SUMS])
        parts = parts.unionByName(before).unionByName(spark.read.parquet(_batch_path(totals, newest)).select("sums.*"))
    return parts.agg(*[F.sum(c).alias(c) for c in SUMS]).select(*_kpi_columns())


def reconcile(logs: DataFrame, live: DataFrame) -> DataFrame:
    """The authoritative totals beside the live ones; ``in_step`` says whether they agree."""
    return compared(kpi_totals(logs), live)


def compared(totals: DataFrame, live: DataFrame) -> DataFrame:
    """``reconcile`` of totals already at hand, such as the published ones."""
    fields = ["requests", "savings_usd", "baseline_usd", "savings_pct", "cache_hit_rate", "fallback_rate"]
    shown = live.select(F.struct(*fields)).scalar()
    return totals.select(*fields).withColumn("live", shown).select(
        *fields, F.col("live.requests").alias("live_requests"),
        (F.struct(*fields) == F.col("live")).alias("in_step"))


# ---- windows: over events that already carry a watermark -----------------------------------

def _window_figures(grouped) -> DataFrame:
    return grouped.agg(F.count("*").alias("requests"), exact_sum(F.col("savings_usd")).cast("double").alias("savings_usd"))


def tumbling(events: DataFrame, length: str = "1 minute") -> DataFrame:
    """Closed windows per model; events behind the watermark stay out but are in the log."""
    grouped = events.groupBy(F.window("created_at", length).alias("w"), "model_used")
    return _window_figures(grouped).select(F.col("w.start").alias("window_start"), "model_used", "requests", "savings_usd")


def sliding(events: DataFrame, length: str = "10 minutes", step: str = "5 minutes") -> DataFrame:
    grouped = events.groupBy(F.window("created_at", length, step).alias("w"))
    return _window_figures(grouped).select(F.col("w.start").alias("window_start"), "requests", "savings_usd")


def sessions(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Runs of the same question with no longer pause than ``gap``."""
    grouped = events.groupBy(F.session_window("created_at", gap).alias("w"), "query_id")
    return _window_figures(grouped).select(F.col("w.start").alias("window_start"), "query_id", "requests", "savings_usd")

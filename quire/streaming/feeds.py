"""Streams: conflated progress, accumulated answers, glossary reload; Structured Streaming with reliable checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.session import checkpoint_dir

#: Fixed value: shortest time between two published states, in microseconds.
PUBLISH_MICROS = 150_000


def slot(ts: Column, micros: int = PUBLISH_MICROS) -> Column:
    """Number of the publishing interval a time falls into."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / micros)


def conflate(events: DataFrame, ts: str, tie: str, columns: list[str]) -> DataFrame:
    """The latest event of each publishing interval; of equal times the one with the greater `tie`."""
    latest = F.max(F.struct(F.col(ts).alias("_at"), F.col(tie).alias("_tie"), *columns)).alias("_row")
    rows = events.filter(F.col(ts).isNotNull()).groupBy(slot(F.col(ts)).alias("slot")).agg(latest)
    return rows.select("slot", F.col("_row._at").alias(ts), F.col("_row._tie").alias(tie), *[F.col("_row")[c].alias(c) for c in columns])


def conflate_stream(stream: DataFrame, ts: str, tie: str, columns: list[str], out: str) -> StreamingQuery:
    """Runs a stream to its end, each micro-batch conflated and written to a folder of its own.

    A batch that is repeated after a failure overwrites its own folder, so
    nothing is counted twice; intervals that several batches share are settled by
    conflating once more on reading. The stream keeps no state that grows.
    """
    def write(batch: DataFrame, number: int) -> None:
        conflate(batch, ts, tie, columns).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}-offsets").trigger(availableNow=True).start()


def replay(spark: SparkSession, path: str, ts: str, tie: str, columns: list[str]) -> DataFrame:
    """Conflated events of a Parquet folder or file, read as a stream."""
    out = f"{checkpoint_dir(spark)}/conflated-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    # As a pattern, a single file will do for the source as well as a folder.
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    conflate_stream(stream, ts, tie, columns, out).awaitTermination()
    try:
        parts = spark.read.parquet(out).drop("batch", "slot")
    except AnalysisException:
        # No batch was ever written: the folder held no row.
        parts = spark.read.parquet(path).limit(0).select(ts, tie, *columns)
    return conflate(parts, ts, tie, columns)


def answer_chunks(lines: DataFrame, stream: str, seq: str, line: str, path: str) -> DataFrame:
    """(stream, seq, partial): the answer so far after each chunk of an event stream.

    Only `data:` lines count, up to the first [DONE] of their stream; the text of a chunk is at `path` of its JSON; chunks without it add nothing and are left out.
    """
    w = Window.partitionBy(stream).orderBy(seq)
    data = lines.withColumn("_d", F.when(F.col(line).startswith("data:"), F.trim(F.substr(F.col(line), F.lit(6)))))
    done = F.coalesce(F.max(F.when(F.col("_d") == "[DONE]", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    open_ = data.withColumn("_done", done).filter((F.col("_done") == 0) & F.col("_d").isNotNull())
    chunks = open_.withColumn("_t", F.get_json_object("_d", path)).filter(F.coalesce(F.col("_t"), F.lit("")) != "")
    return chunks.select(stream, seq, F.array_join(F.collect_list("_t").over(w.rowsBetween(Window.unboundedPreceding, 0)), "").alias("partial"))


def with_reloaded_glossary(stream: DataFrame, path: str, handle: Callable[[DataFrame, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every micro-batch to `handle` with the glossary as its file is at that time; a missing file is an empty glossary."""
    from quire.operators.glossary import parse_lines

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
        except AnalysisException:
            lines = spark.createDataFrame([], "line_no bigint, line string")
        handle(batch, parse_lines(lines), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

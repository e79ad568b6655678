"""The live path (S10, M1-M7): a stream of changed files drives the same indexing as a sweep.

Micro-batches are stateless. A lost or late change is repaired by the next sweep, as indexing depends on
content alone and may be repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmark.api import Engine
from quillmark.config import DEBOUNCE_SECONDS
from quillmark.operators.changes import watchable
from quillmark.plans.indexing import IndexStats

def index_batch(engine: Engine, batch: DataFrame) -> IndexStats:
    """Indexes the distinct watchable paths of a micro-batch in one commit."""
    paths = watchable(batch.select("path")).distinct()
    return engine.index_frame(paths) if not paths.isEmpty() else IndexStats()


def watch(engine: Engine, checkpoint: str, once: bool = False, replay: bool = False) -> StreamingQuery:
    """Starts watching the engine's roots; ``once`` handles what is there and stops. The trigger's interval
    stands for the debounce: all changes of a path within it are one. Listings are kept beside the checkpoint."""
    stream = (
        engine.spark.readStream.format("quillmark_watch")
        .option("roots", ":".join(f"{r.label}={r.dir}" for r in engine.roots))
        .option("state", f"{checkpoint}/listings")
        .option("initial", "all" if replay else "none")
        .load()
    )
    writer = stream.writeStream.foreachBatch(lambda df, _: index_batch(engine, df)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{DEBOUNCE_SECONDS} seconds")).start()


def debounced(events: DataFrame, seconds: int = DEBOUNCE_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """Streaming form of the debounce: session windows of a path; events (path, ts timestamp)."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy("path", F.session_window("ts", f"{seconds} seconds").alias("w"))
        .agg(F.count("*").alias("events"))
        .select("path", F.col("w.start").alias("first_ts"), "events")
    )

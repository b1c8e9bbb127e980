"""Landing folder as a stream: the batch functions per micro-batch; each batch is a run of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import bronze as bronze_layer
from ..operators.gold import gold
from ..operators.silver import silver
from ..sources import files as sources


def start(spark: SparkSession, landing: str, out: str, checkpoint: str, hint: str | None = None, once: bool = False) -> StreamingQuery:
    """New files, empty ones too, become layer rows, or rejected ones. A batch overwrites its own folder, so a repeated batch changes nothing."""

    def batch(files: DataFrame, number: int) -> None:
        run_id = f"stream-{number}"
        known, rejected = bronze_layer.admitted(files)
        session = files.sparkSession
        path = f"{out}/bronze/run={run_id}"
        bronze_layer.bronze(known, run_id, hint).write.mode("overwrite").parquet(path)
        b = session.read.parquet(path)
        path = f"{out}/silver/run={run_id}"
        rejected.write.mode("overwrite").parquet(f"{out}/rejected/run={run_id}")
        silver(b, run_id).write.mode("overwrite").parquet(path)
        gold(session.read.parquet(path), b, run_id).write.mode("overwrite").parquet(f"{out}/gold/run={run_id}")

    stream = sources.stream(spark, landing, f"{checkpoint}-files")
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

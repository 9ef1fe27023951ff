"""Stateless streams over the same operators: the inbox as a file source, the write gate as an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import gate, scan


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """Scan records of files as they arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return scan.scan_files(files.select("path", "content"))


def write_gate(spark: SparkSession, folder: str, sink, checkpoint: str, allowlist: DataFrame | None = None):
    """Judges JSON events (event_id, json) as they arrive; ``sink(verdicts, batch)`` gets each batch's verdicts."""
    events = spark.readStream.schema("event_id long, json string").json(folder)

    def each(batch: DataFrame, number: int) -> None:
        sink(gate.judge(gate.parse_events(batch), allowlist), number)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

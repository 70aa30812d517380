"""New source files as a stream: parsed as they come, kept once per path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import stage

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """`source_id, text, modified` of C files that appear below a folder; bytes that are no UTF-8 are replaced."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.{c,h}").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [None if c is None else c.decode("utf-8", "replace") for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string()), batch.column("modificationTime")], ["source_id", "text", "modified"])

    return stage.mapped(files.select("path", "modificationTime", "content"), run, "source_id string, text string, modified timestamp")


def function_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Functions of a stream of files; without state, so a file that changes gives its functions again."""
    return stage.functions(stage.parse(read_stream(spark, folder, per_trigger)))


def upsert(batch: DataFrame, table: DataFrame, key: str = "source_id") -> DataFrame:
    """A table with the batch's rows in place of those of the same sources."""
    return table.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch.select(*table.columns))


def latest(rows: DataFrame) -> DataFrame:
    """Of rows of one source_id those of the last modification."""
    from pyspark.sql import Window

    newest = Window.partitionBy("source_id")
    return rows.withColumn("_last", F.max("modified").over(newest)).filter("modified = _last").drop("_last")

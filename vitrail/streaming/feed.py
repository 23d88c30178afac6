"""Captures from a growing folder, and an icon catalogue that takes each batch once.

The catalogue is a folder of Parquet batches. A batch of the stream adds the pictures that are not known yet, in a folder named
by the batch, so a batch that is run again after a failure writes the same rows to the same place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitrail.sources import captures

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def capture_stream(spark: SparkSession, path: str) -> DataFrame:
    """Captures from PNG files as they appear in a folder."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.png").load(path)
    return captures.read(files.select("path", "content"))


def known(spark: SparkSession, catalogue: str, schema: str) -> DataFrame:
    """The catalogue so far; nothing while it is empty."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(catalogue)
    except Exception as error:  # the folder is made by the first batch
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def keep_catalogue(rows: DataFrame, catalogue: str, checkpoint: str, key: str = "hash", once: bool = True) -> StreamingQuery:
    """Append each batch's rows with new keys to the catalogue. rows: a stream with the column `key`."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = f"{catalogue}/batch={number}"
        before = known(spark, catalogue, schema).where(~F.coalesce(F.input_file_name().contains(f"/batch={number}/"), F.lit(False)))
        batch.dropDuplicates([key]).join(before.select(key), key, "left_anti").select(*rows.columns).write.mode("overwrite").parquet(own)

    writer = rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events (ts without zone, event_type, value) by window and type; late ones count until the watermark passes."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

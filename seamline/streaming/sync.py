"""Streaming ingestion of interface files, equal to the batch import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.keys import file_family
from ..sources.interfaces import flatten, interface_rows

#: A file as the stream sees it; whole files, so that a document is one row.
SCHEMA = "value string"


def incoming(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """A stream of new files of a folder as path, family and text. Old files are never read again: the
    checkpoint remembers them."""
    stream = spark.readStream.format("text").schema(SCHEMA).option("wholetext", True).option("maxFilesPerTrigger", files_a_trigger).load(folder)
    path = F.col("_metadata.file_path")
    return stream.select(path.alias("path"), file_family(path).alias("family"), "value").filter(F.lower("path").rlike(r"\.json(\.gz)?$"))


def start_sync(spark: SparkSession, folder: str, rows_path: str, errors_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write interface rows of every new file to ``rows_path``, partitioned by path hash, and bad files to ``errors_path``.

    Each file overwrites its own partition, so a batch that is replayed after a failure leaves the same rows:
    exactly once without a transaction log.
    """

    def write(batch: DataFrame, _: int) -> None:
        parsed = batch.withColumn("doc", F.try_parse_json("value")).withColumn("ok", F.coalesce(F.schema_of_variant(F.col("doc")).startswith("OBJECT"), F.lit(False)))
        good = parsed.filter("ok").withColumn("source_id", F.sha1("path"))
        rows = interface_rows(flatten(good, ["path", "family", "source_id"]), ["path", "family", "source_id"])
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(rows_path)
        bad = parsed.filter("NOT ok").select("path", F.lit("not a JSON object").alias("error"), F.sha1("path").alias("source_id"))
        bad.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(errors_path)

    out = incoming(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="10 seconds")).start()


def column_counts(marks: DataFrame) -> DataFrame:
    """A25, A26 on a stream of marks (row_key, partner_domain, col, kind): counts of each partner and column, every mark
    counted once however often it arrives. For output mode ``complete`` or ``update``."""
    own = marks.filter("kind = 'interface'").dropDuplicates(["partner_domain", "row_key", "col"])
    return own.groupBy("partner_domain", "col").agg(F.count("*").alias("count"))

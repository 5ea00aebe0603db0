"""Files arriving in a folder, admitted batch by batch; refused ones go to a table of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline import schema
from plumbline.functions import columns as C
from plumbline.operators import extract, ingest


def watch(spark: SparkSession, folder: str, accepted: str, refused: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Starts the stream. Files of no bytes are passed over by the reader. `trigger` is an interval such as '2 seconds'; None takes what is there and ends.

    Each file is a row (path, source, language, error); one above the largest size is refused as 'too large', its content
    never opened. A batch is written once even if it is tried again: its number is
    part of the tables' folders.
    """
    def files() -> DataFrame:
        return spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)

    # two readings of the folder: the filter on the length reaches the reader, so a huge file is never opened
    fit = files().filter(F.col("length") <= schema.MAX_FILE_BYTES).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("source"), F.lit(False).alias("too_large"))
    huge = files().filter(F.col("length") > schema.MAX_FILE_BYTES).select("path", F.lit(None).cast("string").alias("source"), F.lit(True).alias("too_large"))
    rows = fit.union(huge).withColumn("language", C.language_of(F.col("path")))

    def store(batch: DataFrame, number: int) -> None:
        valid = extract.syntax(batch.filter("not too_large"), "path", "source", "language").select("path", "valid")
        admitted = ingest.checked(batch.join(valid, "path", "left"), F.col("path"), F.col("source"), F.col("valid"))
        huge = F.col("too_large") & (F.col("error") != "unsupported")
        checked = admitted.withColumn("error", F.when(huge, "too large").otherwise(F.col("error"))).persist()
        try:
            ok = checked.filter("error is null").select("path", "language", C.sanitized(F.col("source")).alias("source"))
            ok.write.mode("overwrite").parquet(f"{accepted}/batch={number}")
            checked.filter("error is not null").select("path", "language", "error").write.mode("overwrite").parquet(f"{refused}/batch={number}")
        finally:
            checked.unpersist()

    writer = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()

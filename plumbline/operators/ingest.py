"""Admission of files, and line blocks of texts that no parser takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import schema
from plumbline.functions import columns as C


def running_size(files: DataFrame, batch: str, position: list[str], size: Column, most_files: int = schema.MAX_FILES, most_bytes: int = schema.MAX_BATCH_BYTES) -> DataFrame:
    """Files with their place in the batch, the running sum of sizes, and whether they are within both limits.

    One window per batch; a batch that exceeds a limit is refused by batch_verdicts(), so its groups stay small. Null
    sizes count as 0.
    """
    w = Window.partitionBy(batch).orderBy(*position)
    out = files.withColumn("file_no", F.row_number().over(w).cast("bigint")).withColumn("running_bytes", F.sum(F.coalesce(size, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    return out.withColumn("within", (F.col("file_no") <= most_files) & (F.col("running_bytes") <= most_bytes))


def checked(files: DataFrame, filename: Column, source: Column, valid: Column, most: int = schema.MAX_FILE_BYTES) -> DataFrame:
    """Files with an error: unsupported, too large, empty, invalid syntax - the first that holds - or null if admitted."""
    error = (
        F.when(~C.is_supported(filename), "unsupported").when(F.octet_length(C.or_empty(source)) > most, "too large").when(C.is_blank(source), "empty").when(~F.coalesce(valid, F.lit(False)), "syntax")
    )
    return files.withColumn("error", error)


def batch_verdicts(files: DataFrame, batch: str) -> DataFrame:
    """Per batch of checked() files: admitted, refused, the verdict (202 if any was admitted, else 422), distinct errors."""
    sums = files.groupBy(batch).agg(F.count_if(F.col("error").isNull()).alias("admitted"), F.count_if(F.col("error").isNotNull()).alias("refused"), F.array_join(F.sort_array(F.collect_set("error")), ",").alias("errors"))
    return sums.withColumn("verdict", F.when(F.col("admitted") > 0, 202).otherwise(422))


def upload_mode(filename: Column, source: Column) -> Column:
    """What an upload is: 'archive', 'file', 'paste' (text without a supported name) or 'nothing'."""
    name = C.or_empty(filename)
    return F.when(F.endswith(F.lower(name), F.lit(".zip")), "archive").when(C.is_supported(name), "file").when(~C.is_blank(source), "paste").otherwise("nothing")


def line_blocks(files: DataFrame, path: str, text: str, size: int = 25, overlap: int = 5) -> DataFrame:
    """(path, start_line, end_line, chunk_id, content): blocks of `size` lines that overlap by `overlap`; none for empty
    texts. A null text is empty. Blocks are sliced within the row; nothing is shuffled."""
    raw = F.split(C.or_empty(F.col(text)), "\n")
    lines = F.when(F.element_at(raw, -1) == "", F.slice(raw, 1, F.size(raw) - 1)).otherwise(raw)
    n = F.size("lines")
    starts = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1, F.lit(max(1, size - overlap)))
    rows = files.select(F.col(path).alias("path"), lines.alias("lines")).filter(n > 0).withColumn("i", F.explode(starts))
    first, last = F.col("i") + 1, F.least(F.col("i") + size, n)
    key = F.substring(F.md5(F.concat_ws(":", "path", first.cast("string"), last.cast("string"))), 1, 12)
    return rows.select("path", first.cast("bigint").alias("start_line"), last.cast("bigint").alias("end_line"), key.alias("chunk_id"), F.array_join(F.slice("lines", F.col("i") + 1, F.lit(size)), "\n").alias("content"))


def path_tree(files: DataFrame, path: str) -> DataFrame:
    """(node, parent, name, depth, is_file, n_files): the folders and files behind the paths, folders before files of one
    parent when sorted by (parent, is_file, name). Blank paths are left out."""
    parts = F.split(F.col(path), "/")
    steps = F.sequence(F.lit(1), F.size(parts))
    nodes = F.transform(steps, lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("node"), F.array_join(F.slice(parts, F.lit(1), k - 1), "/").alias("parent"), F.element_at(parts, k).alias("name"), k.alias("depth"), (k == F.size(parts)).alias("is_file")))
    rows = files.filter(~C.is_blank(F.col(path))).select(F.explode(nodes).alias("x")).select("x.*")
    return rows.groupBy("node", "parent", "name", "depth").agg(F.bool_or("is_file").alias("is_file"), F.count(F.lit(1)).alias("n_files"))

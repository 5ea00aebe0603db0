"""Source files as rows (path, source, ...): folders, lists of files, archives, pasted text, staged files."""

from __future__ import annotations

import io
import subprocess
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schema
from plumbline.functions import columns as C


def _decoded(binary: DataFrame, most: int) -> DataFrame:
    """(path, source, bytes, language, error): bytes that are no UTF-8 become replacement characters; files above the limit
    are kept with an error and without text."""
    fits = F.col("length") <= most
    text = F.when(fits, F.make_valid_utf8(F.col("content").cast("string")))
    return binary.select("path", text.alias("source"), F.col("length").alias("bytes"), C.language_of(F.col("path")).alias("language"), F.when(~fits, "too large").alias("error"))


def folder(spark: SparkSession, path: str, pattern: str = "*.py", most: int = schema.MAX_FILE_BYTES) -> DataFrame:
    """All files below a folder whose names match the pattern; files of no bytes are passed over by the reader."""
    return _decoded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path), most)


def listed(spark: SparkSession, paths: list[str], most: int = schema.MAX_FILE_BYTES) -> DataFrame:
    """The named files; globs are expanded by the reader."""
    return _decoded(spark.read.format("binaryFile").load(paths), most)


def pasted(spark: SparkSession, source: str, language: str = "python") -> DataFrame:
    """One row for a pasted text; without a language it is taken as Python."""
    return spark.createDataFrame([(None, source, len(source.encode()), language, None)], "path string, source string, bytes bigint, language string, error string")


#: A small module to try the retrieval and extraction with.
SAMPLE = '''def merged(first: dict, second: dict) -> dict:
    """Returns a new dict with the entries of both. Does not modify the first."""
    return {**first, **second}


def ratio(a: float, b: float) -> float:
    """Returns a float. Raises ValueError if b is zero."""
    if b == 0:
        raise ValueError("b is zero")
    return a / b


def flat(nested: list) -> list:
    """Returns a list of all items. Runs in O(n) time."""
    out = []
    for part in nested:
        out.extend(part)
    return out
'''


def sample(spark: SparkSession) -> DataFrame:
    """The built-in sample as a source of one file."""
    return in_memory(spark, {"sample.py": SAMPLE})


def in_memory(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(files.items()), "path string, source string").select("path", "source", F.octet_length("source").cast("bigint").alias("bytes"), C.language_of(F.col("path")).alias("language"), F.lit(None).cast("string").alias("error"))


_MEMBER = "archive string, path string, source string, bytes bigint, error string"


def archives(spark: SparkSession, path: str, most_files: int = schema.MAX_FILES, most_bytes: int = schema.MAX_BATCH_BYTES) -> DataFrame:
    """(archive, path, source, bytes, language, error): supported members of ZIP files.

    Folders, names that begin with two underscores and anything below __pycache__ are left out; a member that cannot be
    read is skipped; an archive above either limit, or no ZIP at all, is one row with an error. Sizes are taken from the
    directory before anything is unpacked.
    """
    endings = tuple(schema.LANGUAGES)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                rows = _members(name, content, endings, most_files, most_bytes)
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["archive", "path", "source", "bytes", "error"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    rows = raw.select("path", "content").mapInArrow(unpack, _MEMBER)
    return rows.withColumn("language", F.when(F.col("error").isNull(), C.language_of(F.col("path"))))


def _members(name: str, content: bytes, endings: tuple[str, ...], most_files: int, most_bytes: int) -> list[tuple]:
    try:
        held = zipfile.ZipFile(io.BytesIO(content))
        infos = [i for i in held.infolist() if not i.is_dir() and not i.filename.startswith("__") and "/__pycache__/" not in i.filename and i.filename.lower().endswith(endings)]
    except (zipfile.BadZipFile, ValueError, NotImplementedError):
        return [(name, None, None, None, "no archive")]
    if len(infos) > most_files:
        return [(name, None, None, None, "too many files")]
    if sum(i.file_size for i in infos) > most_bytes:
        return [(name, None, None, None, "too large")]
    out = []
    for i in infos:
        try:
            out.append((name, i.filename, held.read(i).decode("utf-8", "replace"), i.file_size, None))
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError, EOFError, ValueError):
            continue
    return out


def staged(spark: SparkSession, repository: str) -> DataFrame:
    """The Python files staged for the next commit of a local repository; read on the driver, where the repository is."""
    said = subprocess.run(["git", "-C", repository, "diff", "--cached", "--name-only", "--diff-filter=ACM"], capture_output=True, text=True, check=True)
    names = [x for x in said.stdout.splitlines() if x.endswith(".py")]
    texts = {n: subprocess.run(["git", "-C", repository, "show", f":{n}"], capture_output=True, check=True).stdout.decode("utf-8", "replace") for n in names}
    return in_memory(spark, texts)


def database(spark: SparkSession, url: str, name: str, properties: dict[str, str], key: str | None = None, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """A table over JDBC; `key` with (lower, upper, parts) reads it in parallel by ranges of a numeric column."""
    if key and bounds:
        return spark.read.jdbc(url, name, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=bounds[2], properties=properties)
    return spark.read.jdbc(url, name, properties=properties)

"""Files as rows: what may come in, by name, size and first bytes; what was made here before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T

#: First bytes by extension, in hex: fixed values. Web pages have none.
SIGNATURES = {
    "pdf": ("255044462D",), "png": ("89504E470D0A1A0A",), "jpg": ("FFD8FF",), "jpeg": ("FFD8FF",), "gif": ("474946383761", "474946383961"),
    "bmp": ("424D",), "webp": ("52494646",), "tiff": ("49492A00", "4D4D002A"), "tif": ("49492A00", "4D4D002A"), "docx": ("504B0304",), "html": (),
}
MOST_BYTES = 50 << 20


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, name, extension, size, content, digest of every file below the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    return files.select("path", name.alias("name"), extension(name).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content", F.sha2("content", 256).alias("digest"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def refusal(most_bytes: int = MOST_BYTES) -> Column:
    """A code for files that aren't taken, else null: no extension, unknown, too large, or other content than the name says."""
    head = F.hex(F.substring(F.col("content"), 1, 16))
    starts = [F.when(F.col("extension") == e, reduce(Column.__or__, (head.startswith(s) for s in signs))) for e, signs in SIGNATURES.items() if signs]
    right = F.coalesce(*starts, F.lit(True))
    return (
        F.when(F.col("extension") == "", "UPLOAD-EXT-000")
        .when(~F.col("extension").isin(*SIGNATURES), "UPLOAD-EXT-001")
        .when(F.col("size") > most_bytes, "UPLOAD-SIZE-001")
        .when(~right, "UPLOAD-MAGIC-001")
        .when((F.col("extension") == "webp") & (F.substring(head, 17, 8) != "57454250"), "UPLOAD-MAGIC-002")
    )


def own_output(mark: str, name_ends: str = "_acessivel") -> Column:
    """Was the file made here? By the name's end, or the maker's mark in the first or last 8 KiB."""
    stem = F.lower(F.regexp_replace("name", r"\.[^.]*$", ""))
    shown = F.hex(F.encode(F.lit(mark), "UTF-8"))
    ends = F.concat(F.hex(F.substring(F.col("content"), 1, 8192)), F.hex(F.expr("substring(content, greatest(length(content) - 8191, 1), 8192)")))
    return stem.endswith(name_ends) | F.contains(stem, F.lit("rascunho_nao_aprovado")) | F.contains(ends, shown)


def output_name(source: Column, suffix: str, kind: str) -> Column:
    stem = T.file_name(F.regexp_replace(F.substring_index(source, "/", -1), r"\.[^.]*$", ""))
    return F.concat(F.when(stem == "", "documento").otherwise(stem), F.lit(f"{suffix}.{kind.lstrip('.')}"))


def different_contents(files: DataFrame) -> DataFrame:
    """Of files with equal content the one with the smallest path."""
    first = files.groupBy("digest").agg(F.min("path").alias("path"))
    return files.join(first, ["digest", "path"], "left_semi")

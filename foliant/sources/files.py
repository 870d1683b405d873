"""Files in, tables out: folders, registration by content, artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ALLOWED = (".pdf", ".doc", ".docx", ".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff")


def extension(c) -> Column:
    return F.lower(F.regexp_extract(c, r"(\.[^./\\]+)$", 1))


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, filename, content of all allowed files below a folder, without editors' lock files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content", "length", "modificationTime")
    return rows.filter(extension("filename").isin(*ALLOWED) & ~F.col("filename").startswith("~$"))


def register(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """files: ord, filename, sha256 -> ord, filename, sha256, first (the ord that owns the content), duplicate, error. known: sha256 of the library's files."""
    own = Window.partitionBy("sha256")
    ok = extension("filename").isin(*ALLOWED)
    rows = files.withColumn("error", F.when(~ok, "unsupported"))
    rows = rows.withColumn("first", F.min(F.when(F.col("error").isNull(), F.col("ord"))).over(own))
    if known is not None:
        rows = rows.join(known.select("sha256", F.lit(True).alias("_known")), "sha256", "left")
    else:
        rows = rows.withColumn("_known", F.lit(None).cast("boolean"))
    duplicate = F.col("error").isNull() & (F.coalesce("_known", F.lit(False)) | (F.col("ord") > F.col("first")))
    return rows.select("ord", "filename", "sha256", "first", duplicate.alias("duplicate"), "error")


def artefact_paths(docs: DataFrame) -> DataFrame:
    """id, orig_path, pdf_path: names by content."""
    return docs.select("id", F.concat("sha256", "ext").alias("orig_path"), F.concat("sha256", F.lit(".pdf")).alias("pdf_path"))


def orphans(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Files (with sha256) that no document refers to any more."""
    return files.join(docs.select("sha256").distinct(), "sha256", "left_anti")


def write_chunks(chunks: DataFrame, path: str, version: str) -> None:
    """A new version of passages beside the old one; readers change over when the version is published in the log."""
    chunks.write.mode("overwrite").parquet(f"{path}/version={version}")

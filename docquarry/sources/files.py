"""Folders and uploads as tables of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import file_name, is_allowed, is_blank


def is_user_file(key: Column) -> Column:
    """Supported files that people wrote: no ``__…`` files, no ``seed.py``."""
    name = file_name(key)
    return is_allowed(key) & ~name.startswith("__") & (name != "seed.py")


def scan_folder(spark: SparkSession, folder: str, with_content: bool = True, name_of: Column | None = None) -> DataFrame:
    """``key, path, size_bytes, modified_at`` (+ ``content``) of all user files below a folder.

    Without content only file listings are read. ``name_of``: the key, from ``path``; else the path below the folder.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = "/" + folder.split("://")[-1].strip("/") + "/"
    at = F.instr("path", root)
    key = F.substr("path", at + len(root), F.length("path")) if name_of is None else name_of
    out = files.select(
        key.alias("key"), "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"),
        *(["content"] if with_content else []))
    return out.filter(is_user_file(F.col("key")))


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 text; invalid bytes are dropped."""
    text = content.cast("string")
    return F.coalesce(F.try_validate_utf8(text), F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))


def read_texts(spark: SparkSession, folder: str, name_of: Column | None = None) -> DataFrame:
    """``key, text`` of all user files that hold text."""
    from docquarry.functions.text import handler_of

    files = scan_folder(spark, folder, name_of=name_of)
    return files.filter(handler_of(F.col("key")).isin("document", "code")).select(
        "key", decode_text(F.col("content")).alias("text"), F.sha2("content", 256).alias("file_hash"), "size_bytes")


def intake(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split uploads (``key, text``) into accepted rows and rejected rows with a reason."""
    reason = F.when(~is_allowed(F.col("key")), "unsupported type").when(is_blank(F.col("text")), "no text")
    marked = uploads.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())

"""The append-only audit log, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT = (
    "timestamp string, tenant_id string, user_email string, query string, accessed_files array<string>, "
    "citations array<string>, refused boolean"
)


def audit_entry(*, tenant_id: Column, user_email: Column, query: Column, accessed: Column, at: Column,
                citations: Column | None = None, refused: Column | None = None) -> list[Column]:
    """Columns of an entry; files sorted and distinct, optional fields left out when null."""
    none = F.lit(None)
    return [
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), tenant_id.alias("tenant_id"),
        user_email.alias("user_email"), query.alias("query"), F.array_sort(F.array_distinct(accessed)).alias("accessed_files"),
        (none if citations is None else citations).cast("array<string>").alias("citations"),
        (none if refused is None else refused).cast("boolean").alias("refused"),
    ]


def append_audit(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def audit_json(*columns: Column) -> Column:
    """The line that :func:`append_audit` would write."""
    return F.to_json(F.struct(*columns))


def parse_audit(lines: DataFrame, line: str = "value") -> DataFrame:
    """Entries of a table of lines, ``entry`` null where a line is malformed."""
    schema = AUDIT + ", _corrupt_record string"
    parsed = F.from_json(line, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.withColumn("_p", parsed).withColumn(
        "entry", F.when(F.col("_p").isNotNull() & F.col("_p._corrupt_record").isNull(), F.col("_p").dropFields("_corrupt_record"))
    ).drop("_p")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """All well-formed entries."""
    return parse_audit(spark.read.text(path)).filter(F.col("entry").isNotNull()).select("entry.*")


def audit_tail(lines: DataFrame, limit: int, order: Column, line: str = "value") -> DataFrame:
    """Entries among the last ``limit`` lines, newest first; malformed lines are skipped after the cut."""
    last = lines.orderBy(order.desc()).limit(max(1, min(limit, 200)))
    return parse_audit(last, line).filter(F.col("entry").isNotNull())

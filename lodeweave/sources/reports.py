"""Report sinks: small tables as Markdown or JSON documents, slimmed copies, and images as data URLs."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown(df: DataFrame, order: list[str], most: int = 200) -> str:
    """The first rows in an order as a Markdown table; a line tells if there are more."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows[:most]]
    return "\n".join(lines + ["", f"More than {most} rows."] * (len(rows) > most)) + "\n"


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file on whatever file system the path names: written beside its place, then renamed into it."""
    target, fs = _file_system(spark, path)
    part, _ = _file_system(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part)
    out.write(bytearray(content))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"cannot put {path} in place")


def write_document(spark: SparkSession, path: str, value: object) -> None:
    """A JSON document, put in place at once."""
    write_bytes(spark, path, json.dumps(value, ensure_ascii=False, indent=2).encode())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A report, put in place at once."""
    write_bytes(spark, path, text.encode())


def slimmed(spark: SparkSession, source: str, target: str, columns: list[str]) -> dict[str, int]:
    """A copy of a parquet table with some columns, written beside its place and renamed into it;
    gives the bytes before and after. The target must not be the source."""
    a, fs = _file_system(spark, source)
    z, _ = _file_system(spark, target)
    if fs.makeQualified(a).toString() == fs.makeQualified(z).toString():
        raise ValueError("a table cannot be slimmed in place")
    part, _ = _file_system(spark, f"{target}.{uuid.uuid4().hex}.part")
    spark.read.parquet(source).select(*columns).write.parquet(part.toString())
    fs.delete(z, True)
    if not fs.rename(part, z):
        raise OSError(f"cannot put {target} in place")
    return {"before": fs.getContentSummary(a).getLength(), "after": fs.getContentSummary(z).getLength()}


def _resized(most: int):
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from PIL import Image

        def one(raw: bytes) -> bytes | None:
            try:
                image = Image.open(io.BytesIO(raw)).convert("RGB")
            except OSError:
                return None
            image.thumbnail((most, most))
            out = io.BytesIO()
            image.save(out, format="JPEG", quality=85)
            return out.getvalue()

        for s in batches:
            yield s.map(one)

    return F.pandas_udf(convert, "binary")


def data_urls(files: DataFrame, most: int = 1024) -> DataFrame:
    """Path and data URL of binary files (path, content).

    Images become JPEG of at most ``most`` pixels a side if an image library is installed; what it
    can't read, and everything without it, is passed on as it is, with the type that the name tells.
    """
    kind = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    plain = F.concat(F.lit("data:"), F.when(kind == "png", "image/png").when(kind == "webp", "image/webp").otherwise("image/jpeg"), F.lit(";base64,"), F.base64("content"))
    try:
        import PIL  # noqa: F401
    except ImportError:
        return files.select("path", plain.alias("url"))
    small = files.withColumn("__small", _resized(most)("content"))
    return small.select("path", F.coalesce(F.concat(F.lit("data:image/jpeg;base64,"), F.base64("__small")), plain).alias("url"))

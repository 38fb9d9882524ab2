"""JSON-lines tables, JSON documents, job logs and incremental outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) has a file, on whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_records(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """One JSON object per line under an explicit schema. A missing path is an empty table, blank
    lines are skipped; a malformed line raises, or is dropped if not strict (S16)."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def write_records(df: DataFrame, path: str, append: bool = False) -> int:
    """JSON lines; returns the number of rows added, counted in what was written."""
    spark = df.sparkSession
    lines = lambda: spark.read.text(path).count() if exists(spark, path) else 0
    before = lines() if append else 0
    df.write.mode("append" if append else "overwrite").json(path)
    return lines() - before


def read_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON document over several lines; a missing path is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_by(df: DataFrame, path: str, *keys: str) -> None:
    """One folder per key value; reading the path gives their union."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def missing_rows(df: DataFrame, path: str, *keys: str) -> DataFrame:
    """S15, S16, ST3: rows whose key the output at the path does not have yet."""
    spark = df.sparkSession
    if not exists(spark, path):
        return df
    return df.join(spark.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti")


def append_missing(df: DataFrame, path: str, *keys: str) -> None:
    """Append the rows whose key is new, once each."""
    missing_rows(df, path, *keys).dropDuplicates(list(keys)).write.mode("append").parquet(path)


def read_results(spark: SparkSession, pattern: str, name: str = r"([^/]+)\.\w+$") -> DataFrame:
    """Result files of a glob with the key that their file name holds."""
    return spark.read.parquet(pattern).withColumn("file_key", F.regexp_extract(F.col("_metadata.file_path"), name, 1))


def read_marked(spark: SparkSession, path: str, schema: str, mark: str = "RESULT ") -> DataFrame:
    """JSON objects of the log lines that begin with a mark."""
    lines = spark.read.text(path).filter(F.col("value").startswith(mark))
    return lines.select(F.from_json(F.substring(F.col("value"), len(mark) + 1, 1 << 30), schema).alias("r")).select("r.*")


def done_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The keys of a result log of JSON lines, bad lines ignored; a missing log has none."""
    return read_records(spark, path, f"{key} string", strict=False).filter(F.col(key).isNotNull()).distinct()


def write_vectors(rows: DataFrame, path: str, column: str) -> None:
    """A bundle of vectors: the column of float arrays as packed little-endian floats, beside the other columns."""
    import pyarrow as pa

    names = [c for c in rows.columns if c != column]

    def pack(batches):
        import numpy as np

        for b in batches:
            at = b.schema.get_field_index(column)
            packed = [None if v is None else np.asarray(v, dtype="<f4").tobytes() for v in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(packed, pa.binary())], names=[*names, column])

    schema = StructType([rows.schema[n] for n in names]).add(column, "binary")
    rows.mapInArrow(pack, schema).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The bundle with its vectors as float arrays again."""
    import pyarrow as pa

    stored = spark.read.parquet(path)
    names = [c for c in stored.columns if c != column]

    def unpack(batches):
        import numpy as np

        for b in batches:
            vectors = [None if v is None else np.frombuffer(v, dtype="<f4") for v in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(vectors, pa.list_(pa.float32()))], names=[*names, column])

    return stored.mapInArrow(unpack, StructType([stored.schema[n] for n in names]).add(column, ArrayType(FloatType())))

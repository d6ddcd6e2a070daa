"""Reading and writing of the tables: strict and tolerant CSV, numbered batch files, parquet, JSON metrics, run logs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.relational import first_by


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


ITEMS = _strings("item_id", "title", "category", "brand", "gender", "age_group", "attributes")
TERMS = _strings("term_id", "query")
PAIRS = _strings("id", "term_id", "item_id")
RESULTS = _strings("pair_id", "verdict", "reason")
#: What the usual table libraries read as missing; Spark alone only knows the empty field.
MISSING = ("", "NA", "N/A", "NULL", "NaN", "None", "n/a", "nan", "null", "<NA>", "#N/A", "-nan", "-NaN")


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, columns: list[str] | None = None, missing: bool = True) -> DataFrame:
    """A CSV with a header and a given schema; with ``missing``, usual missing-value words become null. Columns are pruned by Spark."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", False).option("quote", '"').option("escape", '"').csv(path)
    if missing:
        text = {f.name for f in schema if isinstance(f.dataType, T.StringType)}
        df = df.select(*[F.when(~F.col(c).isin(*MISSING), F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])
    return df.select(*columns) if columns else df


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(pair_id, verdict, reason, file, batch, line): rows of ``batch_N_result.csv`` files; broken and non-numeric rows are dropped.

    ``line`` orders the rows of one file as they stand in it, also where a file is split: the block's first byte, then the place in
    the block, which one task reads in order.
    """
    df = spark.read.schema(RESULTS).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    name = F.col("_metadata.file_name")
    df = df.select("*", name.alias("file"), F.expr("try_cast(regexp_extract(_metadata.file_name, 'batch_([0-9]+)', 1) AS int)").alias("batch"), (F.col("_metadata.file_block_start").cast("decimal(38,0)") * F.lit(1 << 33) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("line"))
    df = df.withColumn("pair_id", F.expr("try_cast(pair_id AS bigint)")).withColumn("verdict", F.expr("try_cast(verdict AS int)"))
    return df.filter(F.col("pair_id").isNotNull() & F.col("verdict").isin(0, 1))


def missing_batches(batches: DataFrame, results: DataFrame) -> DataFrame:
    """Batch numbers without a result."""
    return batches.select("batch").distinct().join(results.select("batch").distinct(), "batch", "left_anti")


def write_csv(df: DataFrame, path: str) -> None:
    """The committer makes the output appear at once or not at all."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def conform(sample: DataFrame, predictions: DataFrame, key: str = "id", default: int = 0) -> DataFrame:
    """Exactly the keys of the sample, with their prediction or the default."""
    return sample.select(key).join(predictions.select(key, "prediction"), key, "left").fillna(default, ["prediction"])


def upsert(log: DataFrame, new: DataFrame, key: str = "version") -> DataFrame:
    """The log with the new rows in place of those of the same key."""
    both = log.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(c) for c in log.columns if c != key]
    return first_by(both, [key], F.col("_new").desc(), *rest).drop("_new")


def as_json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns))


def cached(source: DataFrame, key: Column, path: str, make) -> DataFrame:
    """A table that is computed once for each state of its input: ``key`` is a digest over the input's rows, not their number."""
    spark = source.sparkSession
    stamp = source.agg(F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).first()
    where = f"{path}/{stamp.n}-{stamp.h}"
    try:
        return spark.read.parquet(where)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make(source).write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, computed once: written to the folder that driver and executors share, ``spark.checkpoint.dir``, and read from there.

    Where the setting is missing, a session on one machine takes a temporary folder and a cluster raises an error.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(written, "own", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = written.own = "file://" + tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
    path = f"{base}/quarry/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_npy(spark: SparkSession, path: str | list[str], rows: int = 1000) -> DataFrame:
    """(file, row, vec): the rows of two-dimensional ``.npy`` arrays of floats, numbered from 0 in each file.

    One file is one record of at most 2 GB, Spark's limit for binary values; larger arrays come in parts. What is no such array raises an error.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        import io

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                m = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
                if m.ndim != 2 or m.dtype.kind != "f":
                    raise ValueError(f"{file}: not a two-dimensional array of floats")
                for k in range(0, len(m), rows):
                    part = np.ascontiguousarray(m[k : k + rows], np.float64)
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1] or 1)[: len(part) + 1], pa.int32()), pa.array(part.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(np.arange(k, k + len(part), dtype=np.int64)), vec], names=["file", "row", "vec"])

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return files.mapInArrow(run, "file string, row long, vec array<double>")


def aligned(vectors: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(key, vec): the vectors under the ids of an id table (row, key) that was written in the same order."""
    return vectors.join(ids.select("row", key), "row").select(key, "vec")


def write_report(df: DataFrame, folder: str, name: str, stamp: str) -> str:
    """A small result as one CSV under a name with a time stamp; returns its path. Earlier reports stay."""
    path = f"{folder}/{name}_{stamp}.csv"
    df.coalesce(1).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    return path


def report_lines(title: str, df: DataFrame, order: list[str]) -> DataFrame:
    """(section, n, line): a small table as text lines ``column=value``, with a heading as line 0; for reports that people read."""
    line = F.concat_ws("  ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns])
    body = df.select(F.lit(title).alias("section"), F.row_number().over(W.orderBy(*order)).alias("n"), line.alias("line"))
    return df.sparkSession.range(1).select(F.lit(title).alias("section"), F.lit(0).alias("n"), F.lit(f"== {title} ==").alias("line")).unionByName(body)


def write_text(lines: DataFrame, path: str) -> None:
    """Report lines in order, as one text file."""
    lines.coalesce(1).sortWithinPartitions("section", "n").select("line").write.mode("overwrite").text(path)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Values below ``low`` become low, above ``high`` high; null stays null."""
    out = c if low is None else F.when(c < low, low).otherwise(c)
    return out if high is None else F.when(c > high, high).otherwise(out)

"""Shared parts: tables in the shared folder, running sums without a single task, byte spans in numpy."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: ASCII white space, and a word: a run of anything else.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_paths: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only in local mode, as in tests, one is made where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at the end of this process."""
    path = f"{shared_dir(spark)}/tracemill/{name}-{uuid.uuid4().hex}"
    _paths.append((spark, path))
    return path


def stage_table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder, in one folder for each value of `by`, and read it back.

    Lineage ends there, and a lost executor costs a reread.
    """
    path, write = shared_path(df.sparkSession, name), df.write
    (write.partitionBy(by) if by else write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def delete(spark: SparkSession, path: str) -> None:
    fs, jpath = _file_system(spark, path)
    fs.delete(jpath, True)


def read_file(spark: SparkSession, path: str) -> str | None:
    """A small file of the shared folder; None if there is none."""
    fs, jpath = _file_system(spark, path)
    if not fs.exists(jpath):
        return None
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file of the shared folder, in place of one of that name once it is whole."""
    fs, part = _file_system(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    old = _file_system(spark, path)[1]
    fs.delete(old, False)
    fs.rename(part, old)


def forget_table(spark: SparkSession, name: str) -> None:
    """The catalog forgets a table at the end of this process; its files stay as long as their folder."""
    _tables.append((spark, name))


def bucketed_table(df: DataFrame, name: str, key: str) -> DataFrame:
    """df as a table in the shared folder, bucketed by a key: what is clustered by that key later needn't move."""
    spark = df.sparkSession
    table = f"tracemill_{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = shared_path(spark, table)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    forget_table(spark, table)
    return spark.table(table)


def drop_stage_tables() -> None:
    """Delete what this process has written in the shared folder; also runs at exit while the session is alive."""
    while _tables:
        spark, table = _tables.pop()
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # the session may have ended before
            break
    while _paths:
        spark, path = _paths.pop()
        try:
            delete(spark, path)
        except Exception:  # the session may have ended before
            return


atexit.register(drop_stage_tables)


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a non-null text as an array, by built-in functions."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def running_start(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str, bucket: Column) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same keys that come before, in (bucket, *order).

    bucket must rise with the order. Each (keys, bucket) is one window group and the groups' sums are
    summed once more, so that a key with most of the rows is still cut into as many tasks as it has buckets.
    """
    b, base = "__tm_bucket", "__tm_base"
    df = df.withColumn(b, bucket)
    sums = df.groupBy(*keys, b).agg(F.sum(value).alias("__tm_sum"))
    over = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(k).alias(f"__tm_k{i}") for i, k in enumerate(keys)],
        F.col(b).alias("__tm_b"),
        F.coalesce(F.sum("__tm_sum").over(over), F.lit(0)).cast("long").alias(base),
    )
    inner = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)).cast("long"))
    match = df[b] == sums["__tm_b"]
    for i, k in enumerate(keys):
        match = match & df[k].eqNullSafe(sums[f"__tm_k{i}"])
    return df.join(sums, match).withColumn(out, F.col(out) + F.col(base)).drop(b, base, "__tm_b", *[f"__tm_k{i}" for i in range(len(keys))])


def release() -> None:
    """Give a worker's freed memory back to the system: workers are kept, and wait beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# ---- byte spans in numpy -------------------------------------------------------------------------------------------

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
IDENTITY = np.arange(256, dtype=np.uint8)
ASCII_LOWER = IDENTITY.copy()
ASCII_LOWER[65:91] += 32


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most `limit` bytes, or one longer row. Null is empty."""
    col = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
    if len(col) == 0:
        return
    wide = pa.types.is_large_string(col.type)
    raw = col.buffers()
    off = np.frombuffer(raw[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    i, n = 0, len(col)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (one entry more than texts)."""
    is_word = ~_SPACE[data]
    before = np.empty_like(is_word)
    after = np.empty_like(is_word)
    if len(data):
        before[0], before[1:] = False, is_word[:-1]
        after[-1], after[:-1] = False, is_word[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        before[inner] = False
        after[inner - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters nearby values."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class SpanHash:
    """64-bit hashes of byte spans from prefix sums of a polynomial with an odd base (mod 2^64), scattered with the length.

    Costs a few passes over the bytes whatever the spans, which may overlap. Not meant to resist crafted input.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
        self.base = int(rng.integers(2**40, 2**62)) * 4 + 3
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, base, U)
                p[0] = 1
                setattr(self, name, np.cumprod(p))

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._powers(len(values) + 1)
        s = np.zeros(len(values) + 1, U)
        np.cumsum(values * self.up[: len(values)], out=s[1:])
        return s

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        s = self.sums(values)
        return mix((s[ends] - s[starts]) * self.down[starts] + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))

    def bytes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = IDENTITY) -> np.ndarray:
        return self.spans(self.values[table][data], starts, ends)


def long_lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """list<int64> from flat values and bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64) if values.dtype == U else values.astype(np.int64)))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (key hash, documents that hold the key), bucketed and sorted by hash. Each batch of documents is
merge-anti-joined with the runs, which puts keys aside that `min_docs` documents are known to hold, and adds the rest as
its own run at level 0; when a level has `fanout` runs they are merged into one of the next level, as in a
log-structured merge tree, so a key is rewritten once a level. Runs and their manifest stay in a folder: further batches
are added to it later, and cost their own size and what they compact. Lines whose keys the runs hold in `min_docs`
documents or more leave their texts.

A line's key is the line stripped of ASCII white space with A-Z lower-cased, as 128 bits from two polynomial hashes.

Defined cases: a null or empty text is one empty line; keys of fewer than `min_chars` code points are always kept;
repeated rows are documents of their own; empty tables give empty results. `drop_lines` keeps every input column and
returns its own under the names given; working columns start with `__tm_`.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _SPACE, ASCII_LOWER, SpanHash, U, batch_of, delete, forget_table, read_file, release, shared_path, stage_table, text_slices, write_file

MIN_DOCS = 10
MIN_CHARS = 1
FANOUT = 4
BATCHES = 8
#: Keys that a task may hold (16 bytes each); beyond, lines are matched by a shuffle.
BROADCAST_KEYS = 2_000_000


class _Lines:
    def __init__(self):
        self.a, self.b = SpanHash(71), SpanHash(72)

    def __call__(self, data: np.ndarray, offsets: np.ndarray, min_chars: int):
        """(starts, ends, document of each line, two key hashes, has a key) for every line of a slice."""
        breaks = np.flatnonzero(data == 10)
        starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        # a line ends at its \n or at the end of its text; a text has one line more than it has \n
        counts = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
        doc = np.repeat(np.arange(len(offsets) - 1), counts)
        last = np.cumsum(counts) - 1
        ends = np.empty(len(starts), np.int64)
        ends[:-1] = starts[1:] - 1
        ends[last] = offsets[1:]
        solid = np.flatnonzero(~_SPACE[data])
        i, j = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        full = j > i
        s, e = starts.copy(), starts.copy()
        s[full], e[full] = solid[i[full]], solid[j[full] - 1] + 1
        ka, kb = self.a.bytes(data, s, e, ASCII_LOWER), self.b.bytes(data, s, e, ASCII_LOWER)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return starts, ends, doc, counts, ka, kb, chars[e] - chars[s] >= max(1, min_chars)


def _keys(min_chars: int, batches: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (batch, k1, k2, n_docs) of the keys of each slice: a document counts once for each key it holds."""

    def run(it):
        lines = _Lines()
        schema = pa.schema([("batch", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_docs", pa.int64())])
        for batch in it:
            of = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in text_slices(batch):
                _, _, doc, _, ka, kb, has = lines(data, offsets, min_chars)
                key = np.zeros(int(has.sum()), [("b", np.int32), ("a", U), ("k", U), ("d", np.int64)])
                key["b"], key["a"], key["k"], key["d"] = of[i:j][doc[has]], ka[has], kb[has], doc[has]
                order = np.lexsort((key["d"], key["k"], key["a"], key["b"]))
                key = key[order]
                if not len(key):
                    continue
                new = np.ones(len(key), bool)
                new[1:] = (key["b"][1:] != key["b"][:-1]) | (key["a"][1:] != key["a"][:-1]) | (key["k"][1:] != key["k"][:-1])
                new_doc = new.copy()
                new_doc[1:] |= key["d"][1:] != key["d"][:-1]
                at = np.flatnonzero(new)
                yield batch_of(schema, key["b"][at], key["a"][at].view(np.int64), key["k"][at].view(np.int64), np.add.reduceat(new_doc.astype(np.int64), at))
        release()

    return run


class LineRuns:
    """Levelled sorted runs in a shared folder, with a manifest: `LineRuns(spark, path)` opens what is there, or starts anew.

    A run is a table of (k1, k2, n_docs), bucketed and sorted by its key, so that a batch is joined with runs where they
    lie. The manifest is written last: a batch that failed has left the runs as they were, and is added again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.path = spark, path or shared_path(spark, "line-runs")
        self.min_docs, self.fanout, self.levels = min_docs, fanout, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        held = read_file(spark, f"{self.path}/manifest.json")
        if held is not None:
            was = json.loads(held)
            if was["min_docs"] != min_docs:
                raise ValueError(f"these runs count keys up to {was['min_docs']} documents")
            self.buckets, self.levels = was["buckets"], was["levels"]
            for name in (n for level in self.levels for n in level):
                clause = f"CLUSTERED BY (k1, k2) SORTED BY (k1, k2) INTO {self.buckets} BUCKETS"
                spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (k1 BIGINT, k2 BIGINT, n_docs BIGINT) USING parquet {clause} LOCATION '{self.path}/{name}'")
                forget_table(spark, name)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _merged(self, names: list[str]) -> DataFrame:
        """The sums of several runs. They are read as plain files: the columnar union of bucketed scans in Spark 4.1 passes for dealt by key, and isn't."""
        return self._sum([self.spark.read.schema("k1 long, k2 long, n_docs long").parquet(f"{self.path}/{n}") for n in names])

    def _write(self, keys: DataFrame) -> str:
        name = f"tracemill_lines_{uuid.uuid4().hex}"
        forget_table(self.spark, name)
        keys.write.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name)
        return name

    @staticmethod
    def _sum(runs: list[DataFrame]) -> DataFrame:
        both = runs[0]
        for r in runs[1:]:
            both = both.unionByName(r)
        return both.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"))

    def add(self, keys: DataFrame) -> None:
        """Merge-anti-join a batch's (k1, k2, n_docs) with the runs, add what is left as a run, and compact full levels upwards.

        Keys that a run already holds in min_docs documents are settled: counting them on would change nothing.
        """
        fresh = self._sum([keys])
        for run in self.runs():
            fresh = fresh.join(run.filter(F.col("n_docs") >= self.min_docs).select("k1", "k2").hint("merge"), ["k1", "k2"], "left_anti")
        levels, level, name, old = [list(x) for x in self.levels], 0, self._write(fresh), []
        while True:
            if level == len(levels):
                levels.append([])
            levels[level].append(name)
            if len(levels[level]) < self.fanout:
                break
            old += levels[level]
            name, levels[level] = self._write(self._merged(levels[level])), []
            level += 1
        write_file(self.spark, f"{self.path}/manifest.json", json.dumps({"buckets": self.buckets, "min_docs": self.min_docs, "levels": levels}))
        self.levels = levels
        for n in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
            delete(self.spark, f"{self.path}/{n}")

    def found(self) -> DataFrame:
        """Keys that all runs together hold in min_docs documents or more."""
        names = [n for level in self.levels for n in level]
        if not names:
            return self.spark.createDataFrame([], "k1 long, k2 long")
        return self._merged(names).filter(F.col("n_docs") >= self.min_docs).select("k1", "k2")


def _without(lines: _Lines, batch: pa.RecordBatch, found: np.ndarray, min_chars: int) -> pa.RecordBatch:
    """The batch without __tm_text, with n_lines, n_dropped, kept text and its sha256; found: sorted (k1, k2) of the lines to drop."""
    n_lines, n_dropped, kept, first = [], [], [], found["k1"]
    for i, j, data, offsets in text_slices(batch, "__tm_text"):
        starts, ends, doc, counts, ka, kb, has = lines(data, offsets, min_chars)
        ka, kb = ka.view(np.int64), kb.view(np.int64)
        at = np.searchsorted(first, ka)
        drop = np.zeros(len(starts), bool)
        todo = has & (at < len(first))
        while todo.any():  # k1 may repeat with another k2
            todo &= first[np.minimum(at, len(first) - 1)] == ka
            hit = todo & (found["k2"][np.minimum(at, len(first) - 1)] == kb)
            drop |= hit
            todo &= ~hit
            at = at + 1
            todo &= at < len(first)
        n_lines.append(counts)
        n_dropped.append(np.bincount(doc[drop], minlength=j - i))
        raw, bounds = data.tobytes(), np.concatenate([[0], np.cumsum(counts)])
        for d in range(j - i):
            a, b = bounds[d], bounds[d + 1]
            if n_dropped[-1][d]:
                kept.append(b"\n".join(raw[starts[x] : ends[x]] for x in range(a, b) if not drop[x]))
            else:
                kept.append(raw[offsets[d] : offsets[d + 1]])
    cols = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "__tm_text"]
    nl = np.concatenate(n_lines) if n_lines else np.zeros(0, np.int64)
    nd = np.concatenate(n_dropped) if n_dropped else np.zeros(0, np.int64)
    text = pa.array(kept, pa.binary()).cast(pa.string())
    sha = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
    return pa.RecordBatch.from_arrays([*cols, pa.array(nl, pa.int64()), pa.array(nd, pa.int64()), text, sha], names=[*[n for n in batch.schema.names if n != "__tm_text"], "__tm_n_lines", "__tm_n_dropped", "__tm_kept", "__tm_sha"])


def line_keys(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, batches: int = 1) -> DataFrame:
    """(batch, k1, k2, n_docs) of documents, dealt to `batches` batches by a hash of the text."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.pmod(F.xxhash64(text), F.lit(batches)).cast("int").alias("batch"))
    return rows.mapInArrow(_keys(min_chars, batches), "batch int, k1 long, k2 long, n_docs long")


def index(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES, path: str | None = None, min_docs: int = MIN_DOCS) -> LineRuns:
    """Runs (those at `path`, if any) after all documents are added, in `batches` batches; texts are read once."""
    runs = LineRuns(docs.sparkSession, path, min_docs)
    keys = stage_table(line_keys(docs, text, min_chars, batches), "lines-keys", by="batch")
    for b in range(batches):
        runs.add(keys.filter(F.col("batch") == b).drop("batch"))
    return runs


def drop_lines(docs: DataFrame, found: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs with __tm_n_lines, __tm_n_dropped, __tm_kept (text) and __tm_sha (its sha256); `found` has the keys to drop.

    Up to `broadcast_keys` found keys are held by each task as a sorted array. Beyond, the texts' line keys are sorted
    and merged with them, and each text gets the keys it holds.
    """
    spark = docs.sparkSession
    found = stage_table(found, "lines-found")
    n = found.count()
    df = docs.withColumn("__tm_text", F.col(text).cast("string"))
    out = T.StructType([*docs.schema.fields, T.StructField("__tm_n_lines", T.LongType()), T.StructField("__tm_n_dropped", T.LongType()), T.StructField("__tm_kept", T.StringType()), T.StructField("__tm_sha", T.StringType())])
    if n > broadcast_keys:
        return _drop_by_shuffle(df, found, out, min_chars)
    keys = found.toArrow()
    table = np.zeros(n, _KEY)
    table["k1"], table["k2"] = keys["k1"].to_numpy(), keys["k2"].to_numpy()
    table.sort(order=["k1", "k2"])
    held = spark.sparkContext.broadcast(table)

    def run(it):
        lines = _Lines()
        for batch in it:
            yield _without(lines, batch, held.value, min_chars)
        release()

    return df.mapInArrow(run, out)


_KEY = np.dtype([("k1", np.int64), ("k2", np.int64)])


def _keys_of_texts(min_chars: int) -> Callable:
    def run(it):
        lines = _Lines()
        schema = pa.schema([("id", pa.string()), ("k1", pa.int64()), ("k2", pa.int64())])
        for batch in it:
            ids = batch.column(0)
            for i, j, data, offsets in text_slices(batch, "__tm_text"):
                _, _, doc, _, ka, kb, has = lines(data, offsets, min_chars)
                take = ids.slice(i, j - i).take(pa.array(doc[has]))
                yield batch_of(schema, take, ka[has].view(np.int64), kb[has].view(np.int64))

    return run


def _drop_by_shuffle(df: DataFrame, found: DataFrame, out: T.StructType, min_chars: int) -> DataFrame:
    """For more keys than a task may hold. A text that many rows hold has its keys once; its rows are split by the adaptive planner."""
    rows = df.withColumn("__tm_id", F.sha2(F.coalesce("__tm_text", F.lit("")), 256))
    own = rows.select("__tm_id", "__tm_text").mapInArrow(_keys_of_texts(min_chars), "id string, k1 long, k2 long").distinct()
    own = own.join(found.hint("merge"), ["k1", "k2"], "left_semi").groupBy("id").agg(F.collect_list("k1").alias("__tm_k1"), F.collect_list("k2").alias("__tm_k2"))
    rows = rows.join(own, rows["__tm_id"] == own["id"], "left").drop("id", "__tm_id")

    def run(it):
        lines = _Lines()
        for batch in it:
            # what one text of the batch loses, all others lose too
            k1, k2 = (batch.column(batch.schema.get_field_index(c)).flatten().to_numpy() for c in ("__tm_k1", "__tm_k2"))
            table = np.zeros(len(k1), _KEY)
            table["k1"], table["k2"] = k1, k2
            yield _without(lines, batch.drop_columns(["__tm_k1", "__tm_k2"]), np.unique(table), min_chars)
        release()

    return rows.mapInArrow(run, out)


def op7_line_dedup(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    out = drop_lines(docs, index(docs).found())
    return out.select("doc_id", F.col("__tm_n_lines").alias("n_lines"), F.col("__tm_n_dropped").alias("n_dropped"), F.col("__tm_sha").alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT r, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d
), k AS (
  SELECT r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), j AS (
  SELECT k.r, count(*) AS n_lines, count(f.key) AS n_dropped,
         coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (f.key IS NULL), '') AS kept
  FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.r
)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN j USING (r)
"""

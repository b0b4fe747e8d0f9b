"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Pre-tokens (the matches of the tokenizer's pattern) are taken with their places, a slice of documents at a time: a
   document is written as the codes of its pre-tokens in order, and a slice's distinct pre-tokens follow once, when it
   has SLICE_WORDS of them or SLICE_BYTES of text. The slices are a table bucketed by slice.
2. The slices' vocabularies are exploded and shuffled by word, packed: a slice has one row for each of N hash buckets,
   with its pre-tokens of that bucket and their codes. All rows of a bucket meet in one task, where each word is encoded
   once. A pre-token is in a slice once at most, so the most frequent ones are no hot keys.
3. The ids, packed likewise, are joined back to their slices, which stay where they are, and each document's ids are put
   together by place.
4. Decoding joins the ids with the token-byte table (one row a token, so of the vocabulary's size), held by each task.
   decode() is the same join on any table of ids, as rows.

What is moved is a slice's vocabulary, not its text; a row for each occurrence would be several times the input. A task
holds one slice's words, or one bucket's, and a bounded run of documents.

Special tokens have no meaning: their strings are ordinary text. Defined cases: a null or empty text has no ids and
decodes to no bytes; repeated rows are encoded alike; very long pre-tokens are merged by the tokenizer library's own
routine for them; an empty table gives no rows. Input columns other than the text are carried through, whatever their
names; an input column named like one of OUT or DIGEST is an error of the caller. decode() gives null or empty lists no
bytes and fails on an id that is no token.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, bucketed_table, release, stage_table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: A slice ends with the document that gives it so many distinct pre-tokens or characters.
SLICE_WORDS = 1 << 19
SLICE_BYTES = 1 << 25
#: Characters of text, or pre-tokens, that a task turns into one batch of rows.
RUN = 1 << 20
#: Hash buckets of words, at most: beyond, a slice's row of a bucket would hold hardly more than one word.
MAX_BUCKETS = 1 << 15
#: The pattern's equivalent for ASCII text, for the faster of two regular-expression engines.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


class _Table:
    """Values of keys 0 .. n - 1, end to end: what a join on the key reads."""

    def __init__(self, flat: np.ndarray, length: np.ndarray, start: np.ndarray | None = None):
        self.flat, self.length = flat, length
        self.start = np.cumsum(length) - length if start is None else start

    @classmethod
    def of(cls, parts: list[bytes]) -> _Table:
        return cls(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts], np.int64))

    def join(self, keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys' values end to end, and where those of keys[bounds[i]:bounds[i + 1]] start."""
        n = self.length[keys]
        ends = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        at = np.repeat(self.start[keys] - ends[:-1], n)
        at += np.arange(len(at))
        return self.flat[at], ends[bounds]


class Tokenizer:
    """Ranks of a vocabulary file; encodes one pre-token."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.ascii = _ASCII if pattern == _public().PATTERN else None
        top = max(ranks.values()) + 1
        self.kind = np.dtype("<u2") if top <= 1 << 16 else np.dtype("<u4")
        spelled = [b""] * top
        for token, rank in ranks.items():
            spelled[rank] = token
        self.token_bytes = _Table.of(spelled)
        self.decimals = _Table.of([b"%d " % i for i in range(top)])

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens in order; those of a long text in parts."""
        pattern = self.ascii if self.ascii and text.isascii() else self.pattern
        if len(text) <= RUN:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while part := list(islice(found, RUN // 8)):
            yield part

    def word(self, piece: str) -> list[int]:
        return self.encoding._encode_single_piece(piece)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _public():
    import public_tokenizers

    return public_tokenizers


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One for each Python worker."""
    return Tokenizer(path, pattern)


_ZSTD = pa.Codec("zstd")


def _pack(*parts: bytes) -> bytes:
    """Parts in one compressed block: what the shuffles hold."""
    body = np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)
    return np.array([len(body)], "<u4").tobytes() + _ZSTD.compress(body, asbytes=True)


def _unpack(block: pa.Buffer, n: int) -> list[memoryview]:
    size = int(np.frombuffer(block, "<u4", 1)[0])
    body = memoryview(_ZSTD.decompress(memoryview(block)[4:], size, asbytes=True))
    ends = 4 * n + np.cumsum(np.frombuffer(body, "<u4", n), dtype=np.int64)
    return [body[a:b] for a, b in pairwise([4 * n, *ends.tolist()])]


class _Codes(dict):
    """The code of each pre-token of a slice: how many others came before."""

    def __missing__(self, piece: str) -> int:
        code = self[piece] = len(self)
        return code

    def of(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, pieces), "<u4", len(pieces))

    def packed(self, buckets: int) -> list[dict]:
        """{bucket, packed: codes (as steps), lengths, words} of the words of each hash bucket."""
        words = [w.encode() for w in self]
        of = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
        by = np.argsort(of, kind="stable")
        parts = np.split(by, np.flatnonzero(np.diff(of[by])) + 1) if len(by) else []
        return [{"bucket": int(of[at[0]]), "packed": _pack(np.diff(at, prepend=0).astype("<u4").tobytes(), np.array([len(words[i]) for i in at], "<u4").tobytes(), b"".join([words[i] for i in at]))} for at in parts]


def _planes(codes: np.ndarray) -> bytes:
    """Four bytes a code, the low bytes first: the high ones, nearly all 0, take next to nothing in the table."""
    return codes.view(np.uint8).reshape(-1, 4).T.tobytes()


def _codes(planes: pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


_PACKED = pa.list_(pa.struct([("bucket", pa.int32()), ("packed", pa.binary())]))
#: Columns of the slices' table beside the documents' own. A row is a document (codes), or closes a slice (words).
_SLICES = [("__tm_slice", T.LongType()), ("__tm_seq", T.IntegerType()), ("__tm_codes", T.BinaryType()), ("__tm_words", T.ArrayType(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("packed", T.BinaryType())])))]


def _slices(path: str, pattern: str, at: int, most_words: int, most_bytes: int, buckets: int):
    added = [pa.field("__tm_slice", pa.int64()), pa.field("__tm_seq", pa.int32()), pa.field("__tm_codes", pa.binary()), pa.field("__tm_words", _PACKED)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, schema = tokenizer(path, pattern), None
        key, seq, size, codes = TaskContext.get().partitionId() << 32, 0, 0, _Codes()

        def closed() -> pa.RecordBatch:
            return batch_of(schema, *[pa.nulls(1, f.type) for f in schema][: -len(added)], [key], [None], [None], pa.array([codes.packed(buckets)], _PACKED))

        for batch in it:
            others = [c for i, c in enumerate(batch.columns) if i != at]
            schema = pa.schema([*[pa.field(f.name, f.type) for i, f in enumerate(batch.schema) if i != at], *added])
            first, held, rows = 0, 0, []
            for r, t in enumerate(batch.column(at)):
                text = t.as_py() or ""
                parts = [codes.of(p) for p in tok.pieces(text)]
                rows.append(_planes(parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, "<u4")])))
                size, held = size + len(text), held + len(text)
                full = len(codes) >= most_words or size >= most_bytes
                if full or held >= RUN or r + 1 == batch.num_rows:
                    n = len(rows)
                    yield batch_of(schema, *[c.slice(first, n) for c in others], [key] * n, np.arange(seq, seq + n, dtype=np.int32), pa.array(rows, pa.binary()), pa.nulls(n, _PACKED))
                    first, held, rows, seq = first + n, 0, [], seq + n
                if full:
                    yield closed()
                    key, seq, size, codes = key + 1, 0, 0, _Codes()
        if seq:
            yield closed()
        del codes
        release()

    return run


def _encode_words(path: str, pattern: str):
    """Rows (slice, packed: codes, lengths, ids) of rows (bucket, slice, packed: codes, lengths, words) sorted by bucket.

    Each word of a bucket is encoded once.
    """
    schema = pa.schema([("slice", pa.int64()), ("packed", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, now = tokenizer(path, pattern), None
        seen: dict[bytes, bytes] = {}
        for batch in it:
            done = []
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if bucket != now:
                    now, seen = bucket, {}
                at, size, words = _unpack(block.as_buffer(), 3)
                raw, i, out = bytes(words), 0, []
                for n in np.frombuffer(size, "<u4").tolist():
                    w = raw[i : i + n]
                    i += n
                    if (x := seen.get(w)) is None:
                        x = seen[w] = np.array(tok.word(w.decode()), tok.kind).tobytes()
                    out.append(x)
                lengths = np.array([len(x) for x in out], "<u4") // tok.kind.itemsize
                done.append(_pack(at, lengths.astype("<u4").tobytes(), b"".join(out)))
            yield batch_of(schema, batch.column(1), pa.array(done, pa.binary()))
        del seen
        release()

    return run


#: Columns added by encode(), and with digest.
OUT = [("__tm_ids", T.ArrayType(T.IntegerType())), ("__tm_decoded", T.BinaryType())]
DIGEST = [("__tm_n_tokens", T.LongType()), ("__tm_ids_sha", T.StringType()), ("__tm_decoded_sha", T.StringType())]


def _words_of_slice(packed: list[pa.Buffer], kind: np.dtype) -> _Table:
    """Ids by code, of all buckets of a slice."""
    blocks = [_unpack(b, 3) for b in packed]
    codes = np.concatenate([np.cumsum(np.frombuffer(at, "<u4"), dtype=np.int64) for at, _, _ in blocks])
    sizes = np.concatenate([np.frombuffer(n, "<u4") for _, n, _ in blocks]).astype(np.int64)
    start, length = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    start[codes], length[codes] = np.cumsum(sizes) - sizes, sizes
    return _Table(np.frombuffer(b"".join(ids for _, _, ids in blocks), kind), length, start)


def _assemble(path: str, pattern: str, digest: bool, names: list[str]):
    """Documents sorted by (slice, seq) with their codes, the first of each slice with the slice's encoded words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        words, n_added = _Table(np.zeros(0, tok.kind), np.zeros(0, np.int64)), len(DIGEST if digest else OUT)

        def rows(batch: pa.RecordBatch, first: int, codes: list[np.ndarray]) -> pa.RecordBatch:
            bounds = np.zeros(len(codes) + 1, np.int64)
            np.cumsum([len(c) for c in codes], out=bounds[1:])
            ids, at = words.join(np.concatenate(codes), bounds)
            decoded, ends = tok.token_bytes.join(ids, at)
            if digest:
                written, to = tok.decimals.join(ids, at)
                sha = lambda data, a, b: hashlib.sha256(memoryview(data)[a : max(a, b)]).hexdigest()
                added = [np.diff(at), [sha(written, a, b - 1) for a, b in pairwise(to.tolist())], [sha(decoded, a, b) for a, b in pairwise(ends.tolist())]]
            else:
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                added = [lists, pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(decoded)])]
            kept = [c.slice(first, len(codes)) for c in batch.columns[: len(names) - n_added]]
            return pa.RecordBatch.from_arrays([*kept, *[a if isinstance(a, pa.Array) else pa.array(a) for a in added]], names=names)

        for batch in it:
            codes, packed = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            first, held, now = 0, 0, []
            for r in range(batch.num_rows):
                if packed[r].is_valid or held >= RUN // 8:
                    if now:
                        yield rows(batch, first, now)
                    first, held, now = r, 0, []
                if packed[r].is_valid:
                    words = _words_of_slice([b.as_buffer() for b in packed[r].values], tok.kind)
                now.append(_codes(codes[r].as_buffer()))
                held += len(now[-1])
            if now:
                yield rows(batch, first, now)
        del words
        release()

    return run


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, digest: bool = False, slice_words: int = SLICE_WORDS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """docs without the text, with __tm_ids and __tm_decoded (bytes), or with digest their count and sha256s."""
    path, pattern = path or _public().path(VOCABULARY), pattern or _public().PATTERN
    docs = docs.withColumn(text, F.col(text).cast("string"))
    rest = [f for f in docs.schema.fields if f.name != text]
    # a few buckets to a task, which holds the distinct words of one at a time
    buckets = min(MAX_BUCKETS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = T.StructType([*[T.StructField(f.name, f.dataType) for f in rest], *[T.StructField(n, t) for n, t in _SLICES]])
    sliced = docs.mapInArrow(_slices(path, pattern, docs.columns.index(text), slice_words, slice_bytes, buckets), own)
    sliced = bucketed_table(sliced, "bpe-slices", "__tm_slice")

    words = sliced.filter("__tm_words IS NOT NULL").select(F.col("__tm_slice").alias("slice"), F.explode("__tm_words").alias("w"))
    words = words.select("w.bucket", "slice", "w.packed").repartition("bucket").sortWithinPartitions("bucket")
    encoded = words.mapInArrow(_encode_words(path, pattern), "slice long, packed binary")
    encoded = encoded.groupBy("slice").agg(F.collect_list("packed").alias("__tm_packed"))

    texts = sliced.filter("__tm_words IS NULL").drop("__tm_words").join(encoded, F.col("__tm_slice") == F.col("slice"), "left")
    shown = F.when(F.col("__tm_seq") == 0, F.col("__tm_packed")).alias("__tm_packed")
    texts = texts.select(*[F.col(f"`{f.name}`") for f in rest], "__tm_slice", "__tm_seq", "__tm_codes", shown).sortWithinPartitions("__tm_slice", "__tm_seq").drop("__tm_slice", "__tm_seq")
    out = T.StructType([*rest, *[T.StructField(n, t) for n, t in (DIGEST if digest else OUT)]])
    return texts.mapInArrow(_assemble(path, pattern, digest, out.names), out)


def token_bytes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The token-byte table: (token, bytes), one row for each token of the vocabulary file."""
    rows = [(i, bytearray(b)) for b, i in read_ranks(path or _public().path(VOCABULARY)).items()]
    return spark.createDataFrame(rows, "token int, bytes binary")


def decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """df with __tm_decoded: ids exploded with their positions, joined with the token-byte table, put together by position."""
    rows = stage_table(df.withColumn("__tm_row", F.monotonically_increasing_id()), "bpe-rows")
    each = rows.select("__tm_row", F.posexplode(F.col(ids)).alias("pos", "token"))
    # of the vocabulary's size, whatever the rows
    each = each.join(F.broadcast(token_bytes(df.sparkSession, path)), "token", "left")
    spelled = F.coalesce(F.hex("bytes"), F.raise_error(F.concat(F.lit("no such token: "), F.col("token").cast("string"))))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("pos", spelled.alias("hex")))), lambda x: x["hex"])
    texts = each.groupBy(F.col("__tm_row").alias("__tm_of")).agg(F.unhex(F.array_join(in_order, "")).alias("__tm_bytes"))
    out = rows.join(texts, F.col("__tm_row") == F.col("__tm_of"), "left")
    return out.withColumn("__tm_decoded", F.coalesce("__tm_bytes", F.lit(b""))).drop("__tm_row", "__tm_of", "__tm_bytes")


def op5_bpe(docs: DataFrame) -> DataFrame:
    out = encode(docs.select("doc_id", "text"), digest=True)
    return out.select("doc_id", F.col("__tm_n_tokens").alias("n_tokens"), F.col("__tm_ids_sha").alias("ids_sha256"), F.col("__tm_decoded_sha").alias("decoded_sha256"))

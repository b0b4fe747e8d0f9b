"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts the 1- to 3-grams of labelled texts, lower-cased, hashed into BINS bins, for each language, a text's
own count c as log2(1 + c), so that one long or repetitive text doesn't stand for its language; the matrix
of log probabilities is broadcast (languages x BINS doubles) and texts are scored in batches: a sparse matrix of their
n-grams, one entry each, times the model's. The prior is the languages' share of the labelled rows.

The model learns from at most SAMPLE_ROWS labelled rows, chosen by a hash of doc_id; every row is predicted from its
text alone. `score` is the posterior of the predicted language with the likelihood tempered to that of TEMPER n-grams, as
n-grams of one text are far from independent.

Defined cases: `und` with score 0 if the text is null or has no letter, or if nothing was labelled; ties go to the first
language by code point; repeated rows are predicted alike; very long texts are scored whole, in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, batch_of, mix

BINS = 1 << 16
ORDERS = (1, 2, 3)
SAMPLE_ROWS = 20_000
TEMPER = 100.0
PART = 1 << 18
#: Units of a damped count of 1.
SCALE = 16
_LETTER = regex.compile(r"\p{L}")


def sparse(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, bins), one entry for each n-gram of the texts, in parts of about PART characters: a sparse matrix of ones.

    rows are numbers of texts and rise within a part. A text has a space before and after it. A longer one than PART is
    cut into pieces that overlap, of which an n-gram belongs to the piece that it starts in.
    """
    pieces: list[tuple[int, np.ndarray, int]] = []
    held = 0
    for row, text in enumerate(texts):
        codes = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
        for i in range(0, len(codes), PART):
            pieces.append((row, codes[i : i + PART + max(ORDERS) - 1], PART))
            held += len(pieces[-1][1])
            if held >= PART:
                yield from _entries(pieces)
                pieces, held = [], 0
    if pieces:
        yield from _entries(pieces)


def _entries(pieces: list[tuple[int, np.ndarray, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    c = np.concatenate([x for _, x, _ in pieces])
    sizes = np.array([len(x) for _, x, _ in pieces])
    piece = np.repeat(np.arange(len(pieces)), sizes)
    row = np.array([r for r, _, _ in pieces])[piece]
    starts_here = np.arange(len(c)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.array([n for _, _, n in pieces])[piece]
    h = np.zeros(len(c), U)
    for n in range(1, min(max(ORDERS), len(c)) + 1):
        h = h[: len(c) - n + 1] * U(0x100000001B3) + c[n - 1 :]
        if n in ORDERS:
            inside = (piece[: len(h)] == piece[n - 1 :]) & starts_here[: len(h)]
            yield row[: len(h)][inside], (mix(h[inside] * U(8) + U(n)) >> U(64 - 16)).astype(np.int64)


def _counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bin, n), and with bin -1 the rows of each language."""
    schema = pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("n", pa.int64())])
    by: dict[str, np.ndarray] = {}
    for batch in it:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            row = by.setdefault(lang, np.zeros(BINS + 1, np.int64))
            row[BINS] += 1
            own = sum(np.bincount(bins, minlength=BINS) for _, bins in sparse([text.as_py()]))
            row[:BINS] += np.rint(SCALE * np.log2(1 + own)).astype(np.int64)
    for lang, row in by.items():
        at = np.flatnonzero(row)
        yield batch_of(schema, [lang] * len(at), np.where(at == BINS, -1, at).astype(np.int32), row[at])


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probabilities by language and bin, log priors) from doc_id, text, lang."""
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    n = labelled.count()
    if n > sample_rows:
        bound = int(sample_rows / n * 2**63) - 2**62
        labelled = labelled.filter(F.shiftright(F.xxhash64("doc_id", F.lit("sample")), 1) < F.lit(bound))
    counted = labelled.select("lang", "text").mapInArrow(_counts, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counted["lang"].to_pylist()))
    table = np.zeros((len(langs), BINS + 1))
    at = {x: i for i, x in enumerate(langs)}
    table[[at[x] for x in counted["lang"].to_pylist()], counted["bin"].to_numpy()] = counted["n"].to_numpy()
    priors, table = table[:, BINS], table[:, :BINS] / SCALE
    log = np.log(table + 0.5) - np.log(table.sum(1, keepdims=True) + 0.5 * BINS)
    return langs, log, np.log(np.maximum(priors, 1)) - np.log(max(1, priors.sum()))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """docs (with a text column) and __tm_lang, __tm_score."""
    held = docs.sparkSession.sparkContext.broadcast((model[0], np.ascontiguousarray(model[1].T.astype(np.float32)), model[2]))
    at, fields = docs.columns.index("text"), [*docs.schema.fields, T.StructField("__tm_lang", T.StringType()), T.StructField("__tm_score", T.DoubleType())]
    names = [f.name for f in fields]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, log, prior = held.value
        for batch in it:
            texts = batch.column(at).to_pylist()
            known = [i for i, t in enumerate(texts) if langs and t is not None and _LETTER.search(t)]
            total, n = np.zeros((len(known), len(langs))), np.zeros(len(known), np.int64)
            for rows, bins in sparse([texts[i] for i in known]):
                if len(rows):  # the sparse matrix times the model's: sums of its rows at each text's n-grams
                    first = np.flatnonzero(np.diff(rows, prepend=-1))
                    total[rows[first]] += np.add.reduceat(np.take(log, bins, axis=0), first, axis=0, dtype=np.float64)
                    n[rows[first]] += np.diff(first, append=len(rows))
            best = np.argmax(total + prior, axis=1) if known else np.zeros(0, np.int64)
            soft = prior + total * np.minimum(1.0, TEMPER / np.maximum(n, 1))[:, None]
            sure = 1 / np.exp(soft - soft[np.arange(len(known)), best][:, None]).sum(1)
            found, scores = ["und"] * len(texts), [0.0] * len(texts)
            for i, k, p in zip(known, best.tolist(), sure.tolist(), strict=True):
                found[i], scores[i] = langs[k], p
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=names)

    return docs.mapInArrow(run, T.StructType(fields))


def is_held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5, is 0; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def op8_language_id(docs: DataFrame) -> DataFrame:
    docs = docs.withColumn("held_out", is_held_out(F.col("doc_id")))
    model = train(docs.filter("NOT held_out").select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", F.col("__tm_lang").alias("lang_pred"), F.col("__tm_score").alias("score"))

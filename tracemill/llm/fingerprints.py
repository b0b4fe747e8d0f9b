"""Document fingerprints by winnowing: rolling k-gram hashes, the minimum of each window with the rightmost on ties, and places kept.

K words make a gram and W grams a window, so any run of W + K - 1 = 7 words that two texts share gives both a common
entry. A gram's hash and place are packed in one long, (35 bits of hash, 2^28 - 1 - place): the least of a window is
then the least hash, rightmost on ties, by `least` alone. Built-in functions only.

The likeness of two fingerprints is the Jaccard similarity of their hashes: 1 for two without entries, 0 for one.

The next document in descending doc_id is found without a global sort in one task: doc_ids are cut into ranges of about
equal size, each range is a window group, and the last row of each takes the first of the range after it.

Defined cases: a null text is empty; a text without words has an empty fingerprint; with fewer words than a gram the
whole text is the one gram; null doc_ids come last; rows with one doc_id are ordered by a hash of the text; an only row
follows itself; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage_table, text_or_empty, words_of

K, W = 3, 5
PLACE_BITS = 28
#: Ranges of doc_ids: one for each so many rows, and no more than MAX_RANGES (their bounds are held by the driver).
RANGE_ROWS = 2_000
MAX_RANGES = 4096


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """Add `out`: array<long> of packed (hash, place), by increasing place."""
    words, grams = F.col("__tm_w"), F.col("__tm_g")
    n = F.size("__tm_w")
    top = F.lit(2**PLACE_BITS - 1).cast("long")
    packed = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 64 - 63 + PLACE_BITS), PLACE_BITS).bitwiseOR(top - i)
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: packed(F.xxhash64(*[F.get(words, i + j) for j in range(k)]), i))
    none = F.array().cast("array<long>")
    df = df.withColumn("__tm_w", words_of(F.col(text)))
    df = df.withColumn("__tm_g", F.when(n > 0, each).otherwise(none)).drop("__tm_w")
    least = F.transform(F.sequence(F.lit(0), F.greatest(F.size("__tm_g") - w, F.lit(0))), lambda i: F.least(*[F.get(grams, i + j) for j in range(w)]))
    return df.withColumn(out, F.when(F.size("__tm_g") > 0, F.array_distinct(least)).otherwise(none)).drop("__tm_g")


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, PLACE_BITS)))


def readable(fingerprint: Column) -> Column:
    """hash@place, in hexadecimal and decimal digits, joined by spaces."""
    top = 2**PLACE_BITS - 1
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.hex(F.shiftright(x, PLACE_BITS)), F.lit("@"), (F.lit(top) - x.bitwiseAND(F.lit(top))).cast("string"))), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two columns of hashes()."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common.cast("double") / F.greatest(union, F.lit(1)))


def _range_of(bounds: list[int]) -> Column:
    """The number of bounds at or below doc_id, -1 for null: two lookups of about sqrt(len(bounds)) comparisons."""
    if not bounds:
        return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.lit(0))
    side = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    coarse = F.size(F.filter(longs([p[0] for p in parts]), lambda x: x <= F.col("doc_id")))
    fine = F.get(F.array(*[longs(p) for p in parts]), F.greatest(coarse - 1, F.lit(0)))
    inside = F.size(F.filter(fine, lambda x: x <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * side + inside)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp, next_text, next_fp: each row beside the one that follows in descending doc_id, the last beside the first."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    n = docs.count()
    ranges = min(MAX_RANGES, n // RANGE_ROWS)
    bounds: list[int] = []
    if ranges > 1:
        at = ", ".join(str(i / ranges) for i in range(1, ranges))
        bounds = sorted({int(x) for x in docs.agg(F.expr(f"approx_percentile(doc_id, array({at}), {10 * MAX_RANGES})")).first()[0] or []})
    docs = docs.withColumn("__tm_r", _range_of(bounds))
    tie = F.xxhash64("text")
    # the first row of each range, with the text it stands for
    keys = docs.groupBy("__tm_r").agg(F.min(F.struct((-F.col("doc_id")).alias("d"), tie.alias("t"))).alias("__tm_k"))
    keys = stage_table(keys, "first-keys")
    first = docs.withColumn("__tm_t", tie).join(F.broadcast(keys.select(F.col("__tm_r").alias("__r"), (-F.col("__tm_k.d")).alias("__d"), F.col("__tm_k.t").alias("__t"))), (F.col("__tm_r") == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__tm_t") == F.col("__t")))
    first = stage_table(first.groupBy("__tm_r").agg(F.first("text").alias("text")), "first-texts")
    follow = keys.select(F.col("__tm_r").alias("__r"), F.coalesce(F.lead("__tm_r").over(Window.orderBy(F.desc("__tm_r"))), F.max("__tm_r").over(Window.partitionBy())).alias("__next"))
    ahead = first.join(F.broadcast(follow), F.col("__tm_r") == F.col("__next")).select("__r", F.col("text").alias("__first"))
    ahead = stage_table(with_fingerprint(ahead, "__first", "__first_fp"), "next-texts")

    dealt = with_fingerprint(docs.repartition("__tm_r"), "text", "fp").withColumn("__tm_t", tie)
    order = Window.partitionBy("__tm_r").orderBy(F.desc("doc_id"), F.col("__tm_t"))
    rows = dealt.withColumns({"__n": F.lead("text").over(order), "__nf": F.lead("fp").over(order)})
    rows = rows.join(ahead, rows["__tm_r"] == ahead["__r"], "left")
    return rows.select("doc_id", "text", "fp", F.coalesce("__n", "__first").alias("next_text"), F.coalesce("__nf", "__first_fp").alias("next_fp"))


def op9_fingerprints(docs: DataFrame) -> DataFrame:
    rows = with_next(docs)
    n = F.length("text")
    m = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - m), F.left("next_text", m))
    rows = rows.select("doc_id", "fp", "next_fp", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "efp")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "efp", hashes(F.col("fp")).alias("__a"), hashes(F.col("efp")).alias("__b"), hashes(F.col("next_fp")).alias("__c"))
    return rows.select("doc_id", "n_chars", "edited_sha256", readable(F.col("fp")).alias("fingerprint"), readable(F.col("efp")).alias("edited_fingerprint"), likeness("__a", "__b").alias("near_edited"), likeness("__a", "__c").alias("near_next"))

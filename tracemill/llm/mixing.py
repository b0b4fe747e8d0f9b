"""Mixing sources to target weights by a low-discrepancy slot schedule over equal-token blocks.

Each source's documents are put in a hashed order and laid end to end, round and round; its target is cut into
equal-token blocks, one for each of its slots. The slots are the base-2 van der Corput points of 0 .. 2^m - 1 mapped
through the cumulative targets: point v belongs to the source whose share of [0, 1) holds v, so that any stretch of
the schedule has each source in proportion. Slots are ranked per source; the slot of rank r takes the source's block r.
A document that straddles blocks is cut at the word.

Everything is built-in functions. A source with most of the rows is cut into hash buckets for the running sums, and
into ranges of points for the slots, so no task holds a source.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents without words
take nothing; rows that repeat are rows of their own; an empty table gives an empty mix. Input columns other than
doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_RUN, running_start, stage_table, text_or_empty, words_of

#: A block has about this many words; a schedule has 2^MIN_SLOT_BITS slots at least, for small corpora.
BLOCK_WORDS = 1024
MIN_SLOT_BITS = 14
MAX_REPEATS = 3
#: Rows of one running-sum bucket, about.
BUCKET_ROWS = 20_000


def sized(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """doc_id, source, size and the hashed order `h` (32 hex digits) of every row."""
    size = F.size(words_of(text_or_empty(F.col("text")))).cast("long")
    h = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("mix")).cast("binary"))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), h.alias("h"), *carry)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target: shares of all words by weight, none above `repeats` times its source.

    What is cut off is shared again by weight until nothing is above. The fixed point is target = min(cap, x * weight)
    with one x: sources reach their caps in the order of cap / weight, so x follows from two running sums over the
    sources (one row each; the only unpartitioned windows here are over them).
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("weight", w).withColumn("cap", F.col("source_size") * repeats)
    s = s.withColumns({"__all": F.sum("source_size").over(everything), "__w": F.sum("weight").over(everything), "__cap_to": F.sum("cap").over(upto), "__w_to": F.sum("weight").over(upto)})
    # with the sources before this one at their caps, x = rest / weight left; this one is capped if x * weight >= cap
    rest, left = F.col("__all") - (F.col("__cap_to") - F.col("cap")), F.col("__w") - (F.col("__w_to") - F.col("weight"))
    s = s.withColumn("__capped", rest * F.col("weight") >= F.col("cap") * left)
    free = s.withColumns({
        "__rest": F.col("__all") - F.coalesce(F.sum(F.when(F.col("__capped"), F.col("cap"))).over(everything), F.lit(0)),
        "__left": F.sum(F.when(~F.col("__capped"), F.col("weight"))).over(everything),
    })
    share = (F.col("__rest") * F.col("weight")).cast("double") / F.col("__left").cast("double")
    target = F.when(F.col("__capped"), F.col("cap").cast("double")).otherwise(share)
    return free.select("source", "source_size", "weight", target.alias("target"))


def _bit_reverse(x: Column, bits: int) -> Column:
    """The lowest `bits` bits of a long, reversed: swaps of halves, then a shift."""
    masks = ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF))
    for by, m in masks:
        x = F.shiftleft(x.bitwiseAND(F.lit(m)), by).bitwiseOR(F.shiftrightunsigned(x, by).bitwiseAND(F.lit(m)))
    x = F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32))
    return F.shiftrightunsigned(x, 64 - bits)


def schedule(goals: DataFrame, bits: int) -> DataFrame:
    """source, slot, rank: van der Corput points through the cumulative targets; every source with a target has a slot.

    The points of slots 0 .. 2^bits - 1 are the multiples of 2^-bits in bit-reversed order, so a source's slots are the
    reversed numbers of the multiples in its interval; they are generated in ranges of points dealt to all tasks.
    """
    n = 1 << bits
    running = Window.orderBy(F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    g = goals.filter("target > 0").withColumns({"__from": F.coalesce(F.sum("target").over(running), F.lit(0.0)), "__all": F.sum("target").over(Window.partitionBy())})
    lo = F.ceil(F.col("__from") / F.col("__all") * n).cast("long")
    hi = F.ceil((F.col("__from") + F.col("target")) / F.col("__all") * n).cast("long")
    g = g.select("source", F.least(lo, F.lit(n - 1)).alias("lo"), F.least(hi, F.lit(n)).alias("hi"))
    g = g.withColumn("hi", F.greatest(F.col("hi"), F.col("lo") + 1))
    step = 4096
    chunks = g.select("source", "hi", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(step).cast("long"))).alias("at"))
    chunks = chunks.repartition("source", "at") if bits > 14 else chunks
    points = chunks.select("source", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + step, F.col("hi")) - 1)).alias("point"))
    slots = points.select("source", _bit_reverse(F.col("point"), bits).alias("slot"), F.lit(1).cast("long").alias("__one"))
    bucket = F.shiftright(F.col("slot"), max(0, bits - 8) if bits < 22 else 14)
    return running_start(slots, ["source"], [F.col("slot")], "__one", "rank", bucket).drop("__one")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces).

    rows: every document with doc_id, source, size, source_size, target and `start`, its place among its source's words.
    pieces: source, start, round, first_word, words, slot, rank - the words of documents that the mix takes, in the order of slot.
    """
    sizes = stage_table(sized(docs), "mix-sizes")
    goals = stage_table(targets(sizes, weights, repeats).coalesce(1), "mix-targets")
    n_rows, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = max(MIN_SLOT_BITS, (max(1, total // block_words) - 1).bit_length())
    buckets = 1 << max(0, (n_rows // BUCKET_ROWS).bit_length())
    bucket = F.conv(F.substring("h", 1, 7), 16, 10).cast("long") * buckets / F.lit(1 << 28)
    order = [F.col("h"), F.col("doc_id"), F.col("size")]
    rows = running_start(sizes, ["source"], order, "size", "start", bucket.cast("long")).join(F.broadcast(goals), sizes["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    rows = stage_table(rows.drop("h"), "mix-rows")
    # written, as its size can't be told from the sources' it is made from, and would be taken for small
    slots = stage_table(schedule(goals, bits), "mix-slots")
    per_source = slots.groupBy("source").agg(F.count(F.lit(1)).alias("n_slots"))
    # each source's target in whole words, and its equal-token block
    per_source = per_source.join(goals, per_source["source"].eqNullSafe(goals["source"])).select(
        per_source["source"].alias("__s"), F.floor("target").cast("long").alias("__takes"), F.greatest(F.lit(1), F.ceil(F.floor("target") / F.col("n_slots"))).cast("long").alias("__block"))
    r = rows.filter("size > 0").join(per_source, rows["source"].eqNullSafe(per_source["__s"])).drop("__s")
    r = r.select("source", "start", "size", "source_size", "__takes", "__block", F.explode(F.sequence(F.lit(0), F.lit(repeats))).alias("round"))
    at = F.col("round") * F.col("source_size") + F.col("start")
    r = r.withColumns({"__at": at, "__to": F.least(at + F.col("size"), F.col("__takes"))}).filter("__at < __to")
    blocks = F.sequence(F.floor(F.col("__at") / F.col("__block")), F.floor((F.col("__to") - 1) / F.col("__block")))
    r = r.select("*", F.explode(blocks).alias("rank"))
    first = F.greatest(F.col("__at"), F.col("rank") * F.col("__block"))
    last = F.least(F.col("__to"), (F.col("rank") + 1) * F.col("__block"))
    r = r.select("source", "start", "round", "rank", (first - F.col("__at")).alias("first_word"), (last - first).alias("words"))
    pieces = r.join(slots.withColumnRenamed("source", "__s").withColumnRenamed("rank", "__r"), (F.col("rank") == F.col("__r")) & F.col("source").eqNullSafe(F.col("__s"))).drop("__s", "__r")
    return rows, pieces


def taken(docs: DataFrame, **options) -> DataFrame:
    """rows of mix() with `taken`: the words of all their pieces."""
    rows, pieces = mix(docs, **options)
    per_row = pieces.groupBy(F.col("source").alias("__s"), F.col("start").alias("__p")).agg(F.sum("words").alias("__taken"))
    match = rows["source"].eqNullSafe(per_row["__s"]) & (rows["start"] == per_row["__p"]) & (rows["size"] > 0)
    return rows.join(per_row, match, "left").withColumn("taken", F.coalesce("__taken", F.lit(0)).cast("long")).drop("__s", "__p", "__taken")


def _numbered(df: DataFrame, *more) -> DataFrame:
    """Number the rows that share (doc_id, size, source): almost always one."""
    key = ["doc_id", "size", "source"]
    return df.withColumn("__no", F.row_number().over(Window.partitionBy(*key).orderBy(*more)))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them, with docs' columns: one row for each round, its text whole, or cut after the words taken.

    Rows that share doc_id, size and source are told apart by a hash of their text.
    """
    key = ["doc_id", "source", "size"]
    took = stage_table(taken(docs.select("doc_id", "text", "source"), **options).select(*key, "taken", "start"), "mix-taken")
    told = took.groupBy(*[F.col(c).alias(f"__t_{c}") for c in key]).agg(F.count(F.lit(1)).alias("__rows"), F.max("taken").alias("__taken")).filter("__taken > 0")
    packed = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.size(words_of(text_or_empty(F.col("text")))).cast("long").alias("size"), F.struct(*[docs[c] for c in docs.columns]).alias("__in"))

    def match(df: DataFrame):
        return (df["size"] == F.col("__t_size")) & df["doc_id"].eqNullSafe(F.col("__t_doc_id")) & df["source"].eqNullSafe(F.col("__t_source"))

    # the texts are dealt once: nearly all rows have a key of their own, and are done; the others are numbered
    both = packed.join(told, match(packed))
    several = _numbered(both.filter("__rows > 1").select(*key, "__in"), F.xxhash64("__in.text"))
    each = _numbered(took, "start").filter("taken > 0").select(*[F.col(c).alias(f"__t_{c}") for c in key], F.col("__no").alias("__t_no"), F.col("taken").alias("__taken"))
    several = several.join(each, match(several) & (F.col("__no") == F.col("__t_no")))
    rows = both.filter("__rows = 1").select("size", "__in", "__taken").unionByName(several.select("size", "__in", "__taken"))
    rows = rows.withColumn("__round", F.explode(F.sequence(F.lit(0), F.ceil(F.col("__taken") / F.col("size")).cast("int") - 1)))
    left = F.least(F.col("size"), F.col("__taken") - F.col("__round") * F.col("size"))
    text = F.col("__in.text")
    # cut before the white space that follows the last word taken
    chunks = F.split(F.regexp_replace(text, rf"^{SPACE_RUN}", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    cut = F.regexp_replace(F.array_join(F.slice(chunks, F.lit(1), left.cast("int")), ""), rf"{SPACE_RUN}$", "")
    whole = F.when(left < F.col("size"), cut).otherwise(text)
    return rows.select(*[whole.alias(c) if c == "text" else F.col(f"__in.{c}").alias(c) for c in docs.columns])


def op2_mixing(docs: DataFrame) -> DataFrame:
    return taken(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null') || ':mix') AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM d GROUP BY source
), c AS (
  SELECT *, sum(source_size) OVER () AS t, sum(weight) OVER () AS tw,
         sum(cap) OVER o - cap AS caps_before, sum(weight) OVER o - weight AS w_before
  FROM s WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), k AS (
  SELECT *, (t - caps_before) * weight >= cap * (tw - w_before) AS capped FROM c
), g AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
    ((t - coalesce(sum(cap) FILTER (capped) OVER (), 0)) * weight)::DOUBLE / (sum(weight) FILTER (NOT capped) OVER ())::DOUBLE END AS target FROM k
), r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, floor(g.target)::BIGINT AS takes,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS p
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (list_sum([greatest(0, least(size, takes - (e * source_size + p))) for e in [0, 1, 2, 3]]))::BIGINT AS taken
FROM r
"""

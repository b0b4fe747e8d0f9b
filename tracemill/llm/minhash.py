"""MinHash near-dedup with odd sketches.

Documents with one shingle set are a class (128-bit order-free hash of the set). Each class has `BANDS` bands of `ROWS`
MinHash samples, and an odd sketch of further MinHash samples, taken by one permutation: its values fall in bins, and the
least of each bin is a sample (FINE bins for sets of up to DENSE shingles, COARSE for larger ones, which would fill the
bitmap; sets of both kinds aren't compared by sketch). Each sample toggles one bit of a parity bitmap of SKETCH_BITS bits. The XOR of
two sketches tells how many samples differ (estimate()), and so how similar the sets are: precisely for high
similarities, for texts of any length. Classes that share a band are candidates; those whose sizes, or XOR population
counts, rule the similarity out (most_bits()) are put aside; the rest are confirmed on their full sets.

No pair is made within what is linked already. Three rounds: each class with the bucket head it differs least from;
the other heads of its buckets, where still in other components; then, in the buckets that still span components, the
members outside the bucket's largest component with all others: by sketches, the least different first, in buckets of up
to BIG members; in larger ones all of them on the full sets, a block of the ones against a block of the others at a time,
which needs no row for each pair. After each round the links are merged by components(). No bucket is cut or split.

What a link of similarity 0.8 can be lost by, falling quickly above: no shared band, (1 - 0.8^4)^28 = 4e-7; more bits
differ than most_bits() allows for, 3 times 1e-6, but not where the two share a bucket that is compared in blocks.

Defined cases: texts without a word (null, empty, blank) have the empty set and no link; with fewer words than a
shingle the whole sequence is the one shingle; rows that repeat are in one class; a group's component_id is its least
non-null doc_id (null if it has none), and `kept` is false for a null doc_id. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, SpanHash, U, batch_of, long_lists, mix, release, stage_table, text_slices, word_spans
from .components import components

ROWS, BANDS = 4, 28
SKETCH_BITS, DENSE = 2048, 4096
FINE, COARSE = 1 << 16, 1 << 12
#: Standard deviations that a count may be above its mean: all but 1e-6 of a normal one.
DEVIATIONS = 4.76
#: Members of a bucket beyond which it is compared in blocks, and the members and shingles of a block, about.
BIG = 100
BLOCK_SETS, BLOCK_SHINGLES = 1_024, 1 << 20
#: Members of a bucket, about, that tell which of its shingles are rare.
SAMPLE_SETS = 64
BROADCAST_IDS = 2_000_000
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)
_MULT = _rng.integers(0, 2**31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

_PREFIXES = pa.schema([("band", pa.int64()), ("piece", pa.int64()), ("key", pa.list_(pa.binary())), ("comp", pa.list_(pa.binary())), *[(name, pa.list_(pa.int64())) for name in ("n", "who", "gram", "place")]])


class Shingles:
    """Distinct k-word shingle hashes of texts, lower-cased A-Z."""

    def __init__(self, k: int):
        self.k, self.words, self.grams = k, SpanHash(31), SpanHash(32)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, bounds): text d has hashes[bounds[d]:bounds[d + 1]], distinct and sorted."""
        starts, ends, first = word_spans(data, offsets)
        h = self.words.bytes(data, starts, ends, ASCII_LOWER)
        n = np.diff(first)
        m = np.where(n == 0, 0, np.maximum(1, n - self.k + 1))
        doc = np.repeat(np.arange(len(n)), m)
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[:-1], m)
        g = self.grams.spans(h, at, np.minimum(at + self.k, first[1:][doc]))
        order = np.lexsort((g, doc))
        g, doc = g[order], doc[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        g, doc = g[new], doc[new]
        return g, np.searchsorted(doc, np.arange(len(n) + 1))


def _class_keys(g: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """16 bytes for each set: two sums of scattered hashes, whatever the order."""
    sums = []
    for salt in (U(0x243F6A8885A308D3), U(0x13198A2E03707344)):
        s = np.zeros(len(g) + 1, U)
        np.cumsum(mix(g ^ salt), out=s[1:])
        sums.append(mix((s[bounds[1:]] - s[bounds[:-1]]) + salt))
    both = np.stack(sums, 1).astype(">u8").tobytes()
    return [both[i : i + 16] for i in range(0, len(both), 16)]


def _signatures(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        for batch in it:
            for i, j, data, offsets in text_slices(batch):
                g, bounds = shingles(data, offsets)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                low = (mix(g) >> U(32)).astype(np.uint32)
                mins = np.empty((len(full), ROWS * BANDS), np.uint32)
                if len(full):
                    for s in range(ROWS * BANDS):
                        mins[:, s] = np.minimum.reduceat((low ^ _XOR[s]) * _MULT[s], bounds[:-1][full])
                wide = mins.astype(U) + (np.arange(ROWS * BANDS, dtype=U) << U(32))[None, :]
                bands = np.zeros((len(full), BANDS), U)
                for r in range(ROWS):
                    bands = mix(bands * U(0x9E3779B97F4A7C15) + wide[:, r::ROWS])
                # a set's values are sorted, so the least of each bin comes first
                at = np.repeat(np.arange(len(full)), n[full])
                of_bin = ((g >> U(48)).astype(np.int64) >> np.where(n[full] > DENSE, 4, 0)[at]) + at * FINE
                least = np.ones(len(g), bool)
                least[1:] = of_bin[1:] != of_bin[:-1]
                bits = (mix(g[least]) % U(SKETCH_BITS)).astype(np.int64) + at[least] * SKETCH_BITS
                parity = (np.bincount(bits, minlength=len(full) * SKETCH_BITS) & 1).astype(np.uint8)
                sketch = np.packbits(parity).view(np.int64)
                per = np.zeros(j - i + 1, np.int64)
                per[1:] = np.cumsum(n > 0)
                yield batch_of(schema, batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), n, pa.array(_class_keys(g, bounds), pa.binary()), long_lists(bands.ravel(), per * BANDS), long_lists(sketch, per * (SKETCH_BITS // 64)))
        release()

    return run


def _sets(k: int):
    schema = pa.schema([("key", pa.binary()), ("set", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        for batch in it:
            for _, _, data, offsets in text_slices(batch):
                g, bounds = shingles(data, offsets)
                yield batch_of(schema, pa.array(_class_keys(g, bounds), pa.binary()), long_lists(g, bounds))
        release()

    return run


def _common(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], n: int, m: int) -> np.ndarray:
    """n x m sizes of the intersections of two lists of sets, each as (set, shingle) places of the shingles, numbered from 0."""
    (xs, xg), (ys, yg) = x, y
    width = max(int(xg.max(initial=-1)), int(yg.max(initial=-1))) + 1
    nx, ny = np.bincount(xg, minlength=width), np.bincount(yg, minlength=width)
    out = np.zeros(n * m, np.int64)
    # a shingle of many pairs costs less as a column of a matrix product, which takes all n * m of them at once
    often = nx * ny > n * m // 128
    for some in np.array_split(np.flatnonzero(often), max(1, -(-int(often.sum()) // 4096))):
        place = np.full(width, -1)
        place[some] = np.arange(len(some))
        a, b = np.zeros((n, len(some)), np.float32), np.zeros((m, len(some)), np.float32)
        for full, sets, grams in ((a, xs, xg), (b, ys, yg)):
            at = place[grams]
            full[sets[at >= 0], at[at >= 0]] = 1
        out += (a @ b.T).astype(np.int64).ravel()
    rare = ~often[xg] & (ny[xg] > 0)
    xs, xg = xs[rare], xg[rare]
    order = np.argsort(yg, kind="stable")
    ys, first = ys[order], np.searchsorted(yg[order], np.arange(width))
    ends = np.cumsum(ny[xg])
    at = 0
    while at < len(xg):  # about a million pairs at once
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
        k = ny[xg[at:to]]
        inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        pairs = np.repeat(xs[at:to] * m, k) + ys[np.repeat(first[xg[at:to]], k) + inner]
        out += np.bincount(pairs, minlength=n * m)
        at = to
    return out.reshape(n, m)


def _prefixes(percent: int):
    """Of a chunk: the shingles one of which, with these positions, two linked sets have first in common; rarest of the sample first, a row for each range of shingles.

    A link has percent of each set's shingles in common, so its first common one is among the first n - ceil(percent n) + 1.
    """

    def run(table: pa.Table) -> pa.Table:
        own, sampled = table["own"].to_numpy(), table["sampled"].to_numpy()
        sets = table["set"].combine_chunks()
        n = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        grams, gram = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        of = np.repeat(np.arange(len(n)), n)
        # any order serves that all chunks of the bucket share
        order = np.argsort(np.bincount(gram[sampled[of]], minlength=len(grams)), kind="stable")
        rank = np.empty(len(grams), np.int64)
        rank[order] = np.arange(len(grams))
        of, gram = of[own[of]], gram[own[of]]
        order = np.lexsort((rank[gram], of))
        of, gram = of[order], gram[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        first = place <= (n + -n * percent // 100)[of] if len(of) else np.zeros(0, bool)
        of, gram, place = of[first], grams[gram[first]], place[first]
        band, pieces = table["band"][0].as_py(), table["pieces"][0].as_py()
        piece = (mix(gram.view(U)) % U(pieces)).astype(np.int64)
        keys, comps = table["key"].combine_chunks(), table["comp"].combine_chunks()
        out = {f.name: [] for f in _PREFIXES}
        for p in np.unique(piece):
            here = np.flatnonzero(piece == p)
            rows, who = np.unique(of[here], return_inverse=True)
            for name, value in (("band", band), ("piece", p), ("key", keys.take(pa.array(rows))), ("comp", comps.take(pa.array(rows))), ("n", n[rows]), ("who", who), ("gram", gram[here]), ("place", place[here])):
                out[name].append(value)
        return pa.Table.from_arrays([pa.array(out[f.name], f.type) for f in _PREFIXES], schema=_PREFIXES)

    return run


def _live(percent: int):
    """Of a range of a bucket's shingles: (band, key) of the members that may be linked to one of another component by a first common shingle of it.

    With the first common one at places i and j, sets of n and m have at most min(n - i, m - j) in common.
    """
    schema = pa.schema([("band", pa.int64()), ("key", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        flat = {f.name: table[f.name].combine_chunks() for f in _PREFIXES if pa.types.is_list(f.type)}
        start = np.cumsum([0, *flat["key"].value_lengths().to_pylist()])[:-1]
        who = flat["who"].flatten().to_numpy() + np.repeat(start, flat["who"].value_lengths().to_numpy())
        comp = flat["comp"].flatten().dictionary_encode().indices.to_numpy().astype(np.int64)[who]
        n = flat["n"].flatten().to_numpy()[who]
        left = n - flat["place"].flatten().to_numpy()
        gram = np.unique(flat["gram"].flatten().to_numpy(), return_inverse=True)[1]
        lo, hi = np.full(gram.max(initial=-1) + 1, len(n)), np.full(gram.max(initial=-1) + 1, -1)
        np.minimum.at(lo, gram, comp)
        np.maximum.at(hi, gram, comp)
        some = np.flatnonzero((lo != hi)[gram])
        some = some[np.argsort(gram[some], kind="stable")]
        live = np.zeros(len(start) and len(flat["key"].flatten()), bool)
        for at in np.split(some, np.flatnonzero(np.diff(gram[some])) + 1) if len(some) else []:
            # members of the same size and place are judged together, by the least and greatest component of those they may be linked to
            kinds, kind = np.unique(np.stack([n[at], left[at]], 1), axis=0, return_inverse=True)
            kind = kind.ravel()
            low, high = np.full(len(kinds), len(n)), np.full(len(kinds), -1)
            np.minimum.at(low, kind, comp[at])
            np.maximum.at(high, kind, comp[at])
            step = max(1, (1 << 21) // len(kinds))
            for k in range(0, len(kinds), step):
                a = kinds[k : k + step]
                may = np.minimum(a[:, 1][:, None], kinds[:, 1][None, :]) * (100 + percent) >= (a[:, 0][:, None] + kinds[:, 0][None, :]) * percent
                least, most = np.where(may, low[None, :], len(n)).min(1), np.where(may, high[None, :], -1).max(1)
                mine = at[(kind >= k) & (kind < k + step)]
                own = kind[(kind >= k) & (kind < k + step)] - k
                found = (most[own] >= 0) & ((least[own] != comp[mine]) | (most[own] != comp[mine]))
                live[who[mine[found]]] = True
        keys = flat["key"].flatten().take(pa.array(np.flatnonzero(live)))
        return pa.Table.from_arrays([pa.repeat(table["band"][0], len(keys)), keys], schema=schema)

    return run


def _block_links(percent: int):
    """Of a group of (left, key, comp, set): (u, v) that link what is linked between left and other rows of unlike comp, one less than those."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        left = table["left"].to_numpy()
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        comp = table["comp"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        sets = table["set"].combine_chunks()
        n = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        grams = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
        of = np.repeat(np.arange(len(n)), n)
        side = np.empty(len(n), np.int64)
        side[a], side[b] = np.arange(len(a)), np.arange(len(b))
        mine = left[of]
        common = _common((side[of[mine]], grams[mine]), (side[of[~mine]], grams[~mine]), len(a), len(b))
        linked = (common * 100 >= (n[a][:, None] + n[b][None, :] - common) * percent) & (comp[a][:, None] != comp[b][None, :])
        # the least row that each row reaches, by rounds of both sides
        least_a, least_b = np.arange(len(a)), np.arange(len(b)) + len(a)
        big = len(n)
        while True:
            to_a = np.minimum(least_a, np.where(linked, least_b[None, :], big).min(1, initial=big))
            to_b = np.minimum(least_b, np.where(linked, to_a[:, None], big).min(0, initial=big))
            if (to_a == least_a).all() and (to_b == least_b).all():
                break
            least_a, least_b = to_a, to_b
        at, least = np.concatenate([a, b]), np.concatenate([least_a, least_b])
        moved = np.flatnonzero(least != np.arange(len(n)))
        keys = table["key"].combine_chunks()
        return pa.Table.from_arrays([keys.take(pa.array(at[moved])), keys.take(pa.array(at[least[moved]]))], schema=schema)

    return run


def _xor_bits(a: str, b: str):
    parts = [F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in range(SKETCH_BITS // 64)]
    return sum(parts[1:], parts[0])


def _samples(na, nb, percent: int):
    """For two sets of these sizes and similarity, as Columns: values in either, values in one only, bins in use and their share."""
    either = (na + nb) * F.lit(100 / (100 + percent))
    twice = 1 - F.exp(-either / F.when(na <= DENSE, F.lit(FINE)).otherwise(F.lit(COARSE)))
    return either, (na + nb) * F.lit((100 - percent) / (100 + percent)), F.when(na <= DENSE, F.lit(FINE)).otherwise(F.lit(COARSE)) * twice, twice


def estimate(x, na, nb, percent: int = 80):
    """The similarity that x XOR bits stand for, for sets of sizes na and nb, around `percent`.

    x bits stand for t = -SKETCH_BITS / 2 ln(1 - 2 x / SKETCH_BITS) toggles. A sample that differs toggles one bit, or
    two where the other set has a value in that bin as well.
    """
    _, _, used, twice = _samples(na, nb, percent)
    toggles = F.lit(-SKETCH_BITS / 2) * F.log(F.greatest(1 - 2 * x.cast("double") / SKETCH_BITS, F.lit(1e-9)))
    return F.greatest(F.lit(0.0), 1 - toggles / ((1 + twice) * used))


def most_bits(n, percent: int):
    """XOR bits that two sets of size n and this similarity have at most, each of three counts within DEVIATIONS.

    The counts: samples that are in one set only, drawn from all values without putting back; those with another sample
    in the other set, which toggle two bits; and bits of that many toggles, which meet in some. For sets of sizes na and
    nb, which differ by a quarter at most, the mean of their own is taken: it is below that of (na + nb) / 2 by less than
    half a percent, which is added.
    """
    let = lambda values, f: F.get(F.transform(F.array(F.struct(*[v.cast("double").alias(k) for k, v in values.items()])), f), F.lit(0))
    above = lambda mean, var: mean + DEVIATIONS * F.sqrt(F.greatest(var, F.lit(0.0))) + 1
    either, alone, used, twice = _samples(n, n, percent)

    def differ(v):
        share = v["alone"] / v["either"]
        d = F.least(v["alone"], above(v["used"] * share, v["used"] * share * (1 - share) * F.greatest(1 - v["used"] / v["either"], F.lit(0.0))))
        return let({"d": d, "q": v["twice"]}, lambda w: w["d"] + F.least(w["d"], above(w["d"] * w["q"], w["d"] * w["q"] * (1 - w["q"]))))

    toggles = let({"either": either, "alone": alone, "used": used, "twice": twice}, differ)
    bits = let({"t": toggles}, lambda v: let({"t": v["t"], "p": (1 - F.exp(-2 * v["t"] / SKETCH_BITS)) / 2}, lambda w: F.least(w["t"], above(w["p"] * SKETCH_BITS, w["p"] * (1 - w["p"]) * SKETCH_BITS))))
    return bits * 1.005 + 0.5


def _possible(percent: int):
    """Whether two classes can have the similarity, by their sizes (na, nb), sketches (sa, sb) and most_bits() (la, lb)."""
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    unlike_kinds = F.when((F.col("na") <= DENSE) != (F.col("nb") <= DENSE), F.lit(2.0 * SKETCH_BITS)).otherwise(F.lit(0.0))
    # the last part is true: a lambda keeps a join on this out of whole-stage code, where it is one method too long for the JIT compiler
    return sizes & (2 * _xor_bits("sa", "sb") <= F.col("la") + F.col("lb") + unlike_kinds) & F.forall(F.array("na", "nb"), lambda n: n > 0)


def _spanning(placed: DataFrame) -> DataFrame:
    """(band, key, n, comp, main, t, o) of the buckets that span components: the largest component of a bucket, its members and those outside that."""
    sizes = placed.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("c"))
    spans = sizes.groupBy("band").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("t"), (F.sum("c") - F.max("c")).alias("o"))
    return placed.join(spans.filter("k > 1").drop("k"), "band").select("band", "key", "n", "comp", "main", "t", "o")


def _number(members: str, shingles: str, most_members: int, most_shingles: int):
    return F.ceil(F.greatest(F.col(members) / most_members, F.col(shingles) / most_shingles)).cast("long")


def _merged(big: DataFrame) -> DataFrame:
    """(band, key, n, comp, main) of the buckets, those with one largest component in common taken as one where that makes no more pairs.

    A component that is one in most of its bands has nearly the same members in up to BANDS buckets.
    """
    members = big.groupBy("main", "key").agg(F.first("n").alias("n"), F.first("comp").alias("comp"))
    together = members.groupBy("main").agg(F.count(F.lit(1)).cast("double").alias("t"), F.sum((F.col("comp") != F.col("main")).cast("double")).alias("o"))
    apart = big.groupBy("band").agg(F.first("main").alias("main"), F.first(F.col("t").cast("double") * F.col("o")).alias("pairs")).groupBy("main").agg(F.sum("pairs").alias("pairs"))
    one = stage_table(together.join(apart, "main").filter(F.col("t") * F.col("o") <= F.col("pairs")).select("main"), "near-merged")
    left = big.join(one, "main", "left_anti").select("band", "key", "n", "comp", "main")
    return left.unionByName(members.join(one, "main", "left_semi").withColumn("band", F.xxhash64("main")))


def _chunks(big: DataFrame, sets: DataFrame) -> DataFrame:
    """Members with their sets in chunks of their bucket (own), and a sample of the bucket (sampled) in each of its chunks."""
    weights = big.groupBy("band").agg(F.count(F.lit(1)).alias("t"), F.sum("n").alias("w"))
    big = big.join(weights, "band").withColumn("pieces", _number("t", "w", BLOCK_SETS, BLOCK_SHINGLES))
    big = big.withColumn("at", F.pmod(F.xxhash64("key", "band"), "pieces")).withColumn("sampled", F.pmod(F.xxhash64("band", "key"), _number("t", "w", SAMPLE_SETS, BLOCK_SHINGLES // 4)) == 0)
    big = big.join(sets, "key").withColumn("chunk", F.explode(F.when(F.col("sampled"), F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).otherwise(F.array("at"))))
    return big.select("band", "chunk", "pieces", (F.col("chunk") == F.col("at")).alias("own"), "sampled", "key", "comp", "set")


def _blocks(big: DataFrame, sets: DataFrame) -> DataFrame:
    """(band, i, j, left, key, comp, set): the members outside a bucket's largest component (left) in blocks i, all of them in blocks j; each i with each j."""
    outside = F.col("comp") != F.col("main")
    count = lambda col: F.sum(F.when(outside, col).otherwise(F.lit(0)))
    weights = big.groupBy("band").agg(F.count(F.lit(1)).alias("t"), F.sum("n").alias("w"), count(F.lit(1)).alias("o"), count(F.col("n")).alias("wo")).filter("o > 0")
    big = big.join(weights, "band").withColumn("h", F.xxhash64("key", "band"))
    big = big.withColumn("ni", _number("o", "wo", BLOCK_SETS, BLOCK_SHINGLES)).withColumn("nj", _number("t", "w", BLOCK_SETS, BLOCK_SHINGLES))
    upto = lambda col: F.sequence(F.lit(0).cast("long"), F.col(col) - 1)
    right = F.transform(upto("ni"), lambda i: F.struct(i.alias("i"), F.pmod("h", "nj").alias("j"), F.lit(False).alias("left")))
    left = F.transform(upto("nj"), lambda j: F.struct(F.pmod("h", "ni").alias("i"), j.alias("j"), F.lit(True).alias("left")))
    both = F.when(outside, F.concat(left, right)).otherwise(right)
    return big.join(sets, "key").select("band", F.explode(both).alias("at"), "key", "comp", "set").select("band", "at.i", "at.j", "at.left", "key", "comp", "set")


def _sent(df: DataFrame, most: int) -> DataFrame:
    """df, of `most` rows at most, to be broadcast where that is few enough: the other side of its join needn't move then."""
    return F.broadcast(df) if most <= BROADCAST_IDS else df


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, key, component (a key), component_id, kept for every row; links have 100 * intersection >= percent * union.

    The bands are laid out for percent = 80 or more.
    """
    if percent < 80:
        raise ValueError("bands and sketches are laid out for a similarity of 0.8 or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    rows = stage_table(hashed.mapInArrow(_signatures(shingle_words), "doc_id long, text_hash long, n long, key binary, bands array<long>, sketch array<long>"), "near-rows")

    # members of the buckets that hold two classes or more; a row stands for its class, so equal sets are paired with nothing
    banded = rows.filter("n > 0").select("key", "n", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("key").alias("head"), F.max("key").alias("__last")).filter("head != __last").drop("__last")
    bucketed = stage_table(banded.join(heads, "band").groupBy("band", "key").agg(F.min("head").alias("head"), F.first("n").alias("n")), "near-buckets")
    members = bucketed.select("key").distinct()
    info = rows.filter("n > 0").join(members, "key", "left_semi").groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("id"))
    info = stage_table(info.withColumn("most", most_bits(F.col("n"), percent)), "near-info")

    # the full sets of those classes, from the text of one row each
    ids = info.select(F.col("id").alias("doc_id")).distinct()
    chosen = docs.join(_sent(ids, ids.count()), docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    sets = chosen.select("text").mapInArrow(_sets(shingle_words), "key binary, set array<long>")
    sets = stage_table(sets, "near-sets")
    if sets.count() > info.count():  # a doc_id that several rows share
        sets = stage_table(sets.dropDuplicates(["key"]), "near-sets")

    def with_sets(pairs: DataFrame) -> DataFrame:
        some, most = sets, 2 * pairs.count()
        if most <= BROADCAST_IDS:  # only the sets of these pairs move
            some = sets.join(_sent(pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct(), most), "key", "left_semi")
        a, b = some.select(F.col("key").alias("u"), F.col("set").alias("x")), some.select(F.col("key").alias("v"), F.col("set").alias("y"))
        full = pairs.join(a, "u").join(b, "v")
        common = F.size(F.array_intersect("x", "y"))
        return full.filter(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("u", "v").distinct()

    # every class with the heads of its buckets, as far as sizes and sketches allow a link
    a = info.select(F.col("key").alias("u"), F.col("n").alias("na"), F.col("most").alias("la"), F.col("sketch").alias("sa"))
    b = info.select(F.col("key").alias("v"), F.col("n").alias("nb"), F.col("most").alias("lb"), F.col("sketch").alias("sb"))
    heads_of = bucketed.filter("key != head").select(F.col("key").alias("u"), F.col("head").alias("v")).distinct()
    heads_of = heads_of.join(a, "u").join(b, "v").withColumn("x", _xor_bits("sa", "sb"))
    starred = stage_table(heads_of.filter(_possible(percent)).select("u", "v", "x"), "near-stars")

    # round 1: the head that differs least
    best = stage_table(starred.groupBy("u").agg(F.min_by("v", F.struct("x", "v")).alias("v")), "near-pairs")
    links = stage_table(with_sets(best), "near-links")
    labels = stage_table(components(links), "near-labels")

    def label(df: DataFrame, col: str, out: str) -> DataFrame:
        lab = labels.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        return df.join(lab, F.col(col) == F.col("__n"), "left").withColumn(out, F.coalesce("__l", F.col(col))).drop("__n", "__l")

    # round 2: the other heads, across components
    rest = label(label(starred.select("u", "v").join(best, ["u", "v"], "left_anti"), "u", "lu"), "v", "lv").filter("lu != lv").select("u", "v")
    more = stage_table(with_sets(stage_table(rest, "near-pairs")), "near-links")
    if more.count():
        links = links.union(more)
        labels = stage_table(components(links), "near-labels")

    # round 3: buckets that still span components, members outside the largest with all others
    placed = stage_table(_spanning(label(bucketed, "key", "comp").select("band", "key", "n", "comp")), "near-spans")
    wide = stage_table(_merged(placed.filter(F.col("t") > BIG)), "near-wide")
    prefixes = _chunks(wide, sets).groupBy("band", "chunk").applyInArrow(_prefixes(percent), "band long, piece long, key array<binary>, comp array<binary>, n array<long>, who array<long>, gram array<long>, place array<long>")
    live = prefixes.groupBy("band", "piece").applyInArrow(_live(percent), "band long, key binary").distinct()
    live = stage_table(wide.join(live, ["band", "key"], "left_semi"), "near-live")
    blocks = _blocks(live, sets).groupBy("band", "i", "j").applyInArrow(_block_links(percent), "u binary, v binary")
    in_blocks = stage_table(blocks.distinct(), "near-links")
    small = F.col("t") <= BIG
    of_key = placed.groupBy("key").agg(F.collect_list(F.when(small, F.col("band"))).alias("bands"), F.collect_list(F.when(~small, F.col("band"))).alias("wide"))
    carried = info.select("key", "n", "most", "sketch").join(of_key, "key")
    placed = stage_table(placed.filter(small).drop("n").join(carried, "key"), "near-spans")
    left = placed.filter("comp != main").select("band", F.col("key").alias("u"), F.col("comp").alias("cu"), F.col("n").alias("na"), F.col("most").alias("la"), F.col("sketch").alias("sa"), F.col("bands").alias("ba"), F.col("wide").alias("wa"))
    right = placed.select(F.col("band").alias("__b"), F.col("key").alias("v"), F.col("comp").alias("cv"), F.col("main").alias("mv"), F.col("n").alias("nb"), F.col("most").alias("lb"), F.col("sketch").alias("sb"), F.col("bands").alias("bb"), F.col("wide").alias("wb"))
    once = (F.col("cv") == F.col("mv")) | (F.col("u") < F.col("v"))
    cross = left.join(right, (F.col("band") == F.col("__b")) & (F.col("cu") != F.col("cv")) & once & _possible(percent) & F.forall(F.array("band"), lambda b: (b == F.array_min(F.array_intersect("ba", "bb"))) & ~F.arrays_overlap("wa", "wb")))
    # of the buckets that a pair shares, the least one has it, unless a big one has compared it
    cross = cross.select("u", "v", _xor_bits("sa", "sb").alias("x"))
    tried = starred.select("u", "v")
    cross = cross.join(tried, ["u", "v"], "left_anti").join(tried.select(F.col("u").alias("v"), F.col("v").alias("u")), ["u", "v"], "left_anti")
    cross = stage_table(cross, "near-cross")
    # first the one that differs least from each, as most of the others then are in one component
    best = stage_table(cross.groupBy("u").agg(F.min_by("v", F.struct("x", "v")).alias("v")), "near-pairs")
    for step in range(2):
        last = stage_table(with_sets(best).union(in_blocks) if step == 0 else with_sets(best), "near-links")
        if not last.isEmpty():
            links = links.union(last)
            labels = stage_table(components(links), "near-labels")
        if step == 0:
            left_over = cross.select("u", "v").join(best, ["u", "v"], "left_anti")
            best = stage_table(label(label(left_over, "u", "lu"), "v", "lv").filter("lu != lv").select("u", "v"), "near-pairs")

    classes = rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("id"))
    classes = label(classes, "key", "comp")
    linked = classes.join(labels.select(F.col("node").alias("key")), "key", "left_semi").groupBy("comp").agg(F.min("id").alias("least"))
    classes = classes.join(linked, "comp", "left").select("key", F.col("comp").alias("component"), F.coalesce("least", "id").alias("component_id"))
    out = rows.select("doc_id", "text_hash", "n", "key").join(classes, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "key", "component", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the least doc_id (null last), then the least text hash.

    Rows without words are linked with nothing and stay. Of rows with the same doc_id and text one stays. Texts move only
    where more than BROADCAST_IDS rows go, or repeat.
    """
    found = near_duplicates(docs.select("doc_id", "text"), shingle_words).filter("n_shingles > 0")
    found = stage_table(found.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")), "near-found")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")
    first = found.groupBy("component").agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__k")).filter("__k > 1")
    gone = found.join(first, "component").filter(order != F.col("__first")).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"))
    gone = stage_table(gone, "near-gone")
    t = F.xxhash64(F.col("text").cast("string"))
    stay = docs.join(_sent(gone, gone.count()), docs["doc_id"].eqNullSafe(gone["__d"]) & (t == gone["__t"]), "left_anti")
    again = found.filter("n > 1").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"))
    n_again = again.count()
    if not n_again:
        return stay
    rows = stay.join(_sent(again, n_again), stay["doc_id"].eqNullSafe(again["__d"]) & (t == again["__t"]), "left")
    once = rows.filter("__t IS NOT NULL").dropDuplicates(["__d", "__t"])
    return rows.filter("__t IS NULL").select(*docs.columns).unionByName(once.select(*docs.columns))


def op3_minhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"), shingle_words=2).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(ws[i:i+1], ' ') AS g FROM (SELECT r, ws, unnest(range(1, greatest(2, len(ws)))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), c AS (
  SELECT a.r AS u, b.r AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r
), e AS (
  SELECT u, v FROM c JOIN n x ON x.r = u JOIN n y ON y.r = v WHERE 100 * k >= 80 * (x.n + y.n - k)
), twice AS (
  SELECT u, v FROM e UNION ALL SELECT v, u FROM e
), reach AS (
  SELECT r AS a, r AS b FROM w UNION SELECT reach.a, twice.v FROM reach JOIN twice ON reach.b = twice.u
), m AS (
  SELECT reach.a AS r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.b GROUP BY reach.a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, coalesce(w.doc_id = m.component_id, false) AS kept
FROM w LEFT JOIN n USING (r) JOIN m USING (r)
"""

"""A small, diverse, representative sample of unique traces, with a reason for each pick.

unique: id, pos, cluster, dist (to the cluster's centre), failure, error, feedback, route, model, tools, metadata (map).
The parts that scale with the traces (strata, budgets, ranks, quotas) are declarative. Failures, strata and centres are
picked on the driver over a candidate table that holds, for each cluster and stratum value, no more rows than there are
picks; the fill looks at all unique rows on the executors, by rounds that return one row for each cluster.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType
from pyspark.sql.window import Window

from ..staging import stage

FIELDS = ("route", "tools", "error", "feedback")


def strata_values(field: str, metadata: str = "metadata") -> Column:
    """The values of a stratum field as an array: tools, error, feedback, route, model, or a key of the metadata map."""
    none = F.array(F.lit("(none)"))
    empty = F.array().cast("array<string>")
    if field == "tools":
        return F.when(F.size("tools") > 0, F.col("tools")).otherwise(none)
    if field == "error":
        return F.array(F.coalesce("error", F.lit(False)).cast("string"))
    if field == "feedback":
        return F.array(F.coalesce("feedback", F.lit("(none)")))
    value = F.col(field) if field in ("route", "model") else F.try_element_at(F.col(metadata), F.lit(field))
    return F.when(value.isNull() | ((value == "") & F.lit(field in ("route", "model"))), empty).otherwise(F.array(value))


def strata_histogram(unique: DataFrame, n: int, stratify: tuple[str, ...] = ()) -> DataFrame:
    """field, value, count, skipped: one pass over all fields; skipped is why a field isn't covered, or null.

    A field of more than max(10, n // 2) values is skipped, and a default field with one value.
    """
    fields = [*FIELDS, *[f for f in stratify if f not in FIELDS]]

    def named(field: str) -> Column:
        return F.transform(strata_values(field), lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))

    pairs = F.flatten(F.array(*[named(f) for f in fields]))
    counts = unique.select(F.explode(pairs).alias("p")).groupBy(F.col("p.field").alias("field"), F.col("p.value").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    limit = max(10, n // 2)
    values = F.count(F.lit(1)).over(Window.partitionBy("field"))
    why = F.when(values > limit, F.format_string(f"%d distinct values (limit {limit})", values)).when((values == 1) & F.col("field").isin(*FIELDS), "one value")
    return counts.withColumn("skipped", why)


def failure_budget(unique: DataFrame, n: int, share: float = 0.3) -> DataFrame:
    """One row: unique, failures, budget = min(failures, n, max(ceil(share * n), round(failure share * n)))."""
    df = unique.agg(F.count(F.lit(1)).alias("unique"), F.count_if("failure").alias("failures"))
    by_share = F.bround(F.col("failures") / F.greatest(F.col("unique"), F.lit(1)) * n).cast("long")
    return df.withColumn("budget", F.least("failures", F.lit(n).cast("long"), F.greatest(F.lit(math.ceil(share * n)).cast("long"), by_share)))


def cluster_shares(unique: DataFrame) -> DataFrame:
    """cluster, size, share (four decimals)."""
    by = unique.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return by.withColumn("share", F.bround(F.col("size") / F.sum("size").over(Window.partitionBy()), 4))


def central_rank(unique: DataFrame) -> DataFrame:
    """Adds rank: place in the cluster by distance to its centre, then position."""
    return unique.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("dist", "pos")))


def failure_round_robin(unique: DataFrame, budget: int) -> DataFrame:
    """The failures picked: clusters take turns, larger first, each by its most central failure left.

    Turn by turn over clusters is the order (rank in the cluster, size, cluster), so one top-k answers it.
    """
    ranked = central_rank(unique.filter("failure")).filter(F.col("rank") <= budget).join(F.broadcast(cluster_shares(unique)), "cluster")
    order = [F.col("rank"), F.desc("size"), F.col("cluster")]
    return ranked.orderBy(*order).limit(budget).select("id", "pos", "cluster", "rank")


def quotas(shares: DataFrame, have: DataFrame, n: int, picked: int) -> DataFrame:
    """cluster, need, take: proportional quotas less what is picked, by largest remainder."""
    everything = Window.partitionBy()
    df = shares.join(have, "cluster", "left").withColumn("need", F.greatest(F.lit(0.0), F.lit(float(n)) * F.col("size") / F.sum("size").over(everything) - F.coalesce("have", F.lit(0))))
    df = df.withColumn("whole", F.floor("need")).withColumn("left", F.lit(n - picked) - F.sum("whole").over(everything))
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("need") - F.col("whole")), F.col("cluster")))
    return df.withColumn("take", F.col("whole") + F.when(rank <= F.col("left"), 1).otherwise(0)).select("cluster", "need", F.col("take").cast("long").alias("take"))


# ---- topics --------------------------------------------------------------------------------------------------------

#: Terms that a task counts before it passes them on.
HELD_TERMS = 300_000


def _terms(words: list[str]) -> Counter:
    return Counter([*words, *map(" ".join, zip(words, words[1:]))])


def _counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, tf, df) of a task's rows of words, as partial sums."""
    tf, df = Counter(), Counter()

    def held() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(tf.keys(), pa.string()), pa.array(tf.values(), pa.int64()), pa.array([df[t] for t in tf], pa.int64())], names=["term", "tf", "df"])

    for batch in it:
        for words in batch.column(0):
            found = _terms(words.as_py() or [])
            tf.update(found)
            df.update(found.keys())
            if len(tf) >= HELD_TERMS:
                yield held()
                tf.clear()
                df.clear()
    yield held()


def _weighted(held):
    """Rows whose last column is words, with the places i and weights x of their terms instead, of length 1."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, idf = held.value
        for batch in it:
            places, weights = [], []
            for words in batch.column(batch.num_columns - 1):
                found = sorted((at[t], n) for t, n in _terms(words.as_py() or []).items() if t in at)
                i = np.array([k for k, _ in found], np.int32)
                x = (1.0 + np.log([float(n) for _, n in found])) * idf[i]
                places.append(i)
                weights.append(x / max(np.sqrt(x @ x), 1e-300))
            columns = [*batch.columns[:-1], pa.array(places, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "__i", "__x"])

    return run


def weighted_terms(texts: DataFrame, text: str = "text", max_features: int = 20_000) -> tuple[DataFrame, list[str]]:
    """texts without text, with __i and __x: places in the terms and 1- and 2-gram weights (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1),
    of length 1; and the terms.

    Stop words are Spark's list for English; the vocabulary is the max_features most frequent terms, ties by the term. Texts
    are cut into words once; the driver and each task hold the vocabulary.
    """
    tok = RegexTokenizer(inputCol=text, outputCol="__t", pattern=r"(?U)\b\w\w+\b", gaps=False, toLowercase=True)
    stop = StopWordsRemover(inputCol="__t", outputCol="__w")
    words = stage(stop.transform(tok.transform(texts)).drop("__t", text), "words")
    counts = words.select("__w").mapInArrow(_counts, "term string, tf long, df long").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    top = counts.orderBy(F.desc("tf"), "term").limit(max_features).collect()
    n = words.count()
    idf = np.log((n + 1.0) / (np.array([float(r.df) for r in top]) + 1.0)) + 1.0
    held = texts.sparkSession.sparkContext.broadcast(({r.term: i for i, r in enumerate(top)}, idf))
    schema = StructType([f for f in words.schema.fields if f.name != "__w"]).add("__i", ArrayType(IntegerType())).add("__x", ArrayType(DoubleType()))
    return words.select(*schema.names[:-2], "__w").mapInArrow(_weighted(held), schema), [r.term for r in top]


def tfidf(texts: DataFrame, text: str = "text", max_features: int = 20_000) -> tuple[DataFrame, list[str]]:
    """texts with `features`, the vectors of weighted_terms(); and the terms."""
    kept = texts.withColumn("__text", F.col(text))
    df, terms = weighted_terms(kept, "__text", max_features)
    if not terms:
        return texts.withColumn("features", array_to_vector(F.array(F.lit(1.0)))), ["(empty)"]
    size = len(terms)

    @F.udf(VectorUDT())
    def vector(i, x):
        return Vectors.sparse(size, i, x)

    return df.withColumn("features", vector("__i", "__x")).drop("__i", "__x"), terms


def topic_clusters(texts: DataFrame, n: int, clusters: int | None = None, seed: int = 0, restarts: int = 10) -> tuple[DataFrame, dict[int, list[str]]]:
    """texts with cluster and dist, and each cluster's top terms: k-means of tfidf(), the best of `restarts` seeds."""
    df, terms = tfidf(texts)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:  # one file would be one task in every pass of k-means
        df = df.repartition(cores)
    df = stage(df, "topic-vectors")  # not persist(): k-means then holds the vectors alone, as objects, and not rows that each pass decodes
    unique = df.count()
    k = max(1, min(clusters or max(2, round(math.sqrt(unique))), unique, n))
    if k < 2 or len(terms) < 2:
        return df.withColumns({"cluster": F.lit(0), "dist": F.lit(0.0)}), {0: terms[:5]}
    best = None
    for i in range(restarts):
        model = KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster").fit(df)
        if best is None or model.summary.trainingCost < best[0]:
            best = model.summary.trainingCost, model
    centers = best[1].clusterCenters()
    top = {i: [terms[j] for j in (-c).argsort()[:5] if c[j] > 0] for i, c in enumerate(centers)}
    held = df.sparkSession.sparkContext.broadcast(centers)

    @F.udf("double")
    def distance(v, c):
        return float(v.squared_distance(held.value[c]) ** 0.5)

    return best[1].transform(df).withColumn("dist", distance("features", "cluster")), top


# ---- the sequential part -------------------------------------------------------------------------------------------


def pick(candidates: list[dict], histogram: list[dict], n: int, share: float = 0.3, similarity=None, sizes: dict | None = None, failures: int | None = None, rounds: Callable | None = None) -> list[dict]:
    """Picks (id, cluster, reasons) from candidate rows with id, pos, cluster, dist, failure, strata {field: [values]}.

    In order: failures by turns over clusters; one trace for each stratum value not yet covered, rarest first; the most
    central trace of each cluster not yet covered; then quotas by cluster, each time the candidate least similar to
    what its cluster has. similarity(a, b) is the cosine of two candidates; without it, the more distant to the centre.
    sizes and failures are those of all unique traces, where the candidates are only a part of them; the fill then comes
    from rounds(ids by cluster, rows wanted by cluster), see farthest_rounds().
    """
    sizes = sizes or Counter(c["cluster"] for c in candidates)
    total = sum(sizes.values())
    clusters = sorted(sizes, key=lambda c: (-sizes[c], c))
    central = lambda rows: sorted(rows, key=lambda r: (r["dist"], r["pos"]))
    chosen: dict[str, dict] = {}

    def take(row: dict, why: str) -> None:
        chosen.setdefault(row["id"], {"id": row["id"], "cluster": row["cluster"], "failure": row["failure"], "reasons": [], "row": row})["reasons"].append(why)

    failing = [c for c in candidates if c["failure"]]
    failures = len(failing) if failures is None else failures
    budget = min(failures, n, max(math.ceil(share * n), round(failures / max(1, total) * n)))
    turns = defaultdict(list)
    for r in central(failing):
        turns[r["cluster"]].append(r)
    order = sorted(((i, -sizes[c], c, r) for c in turns for i, r in enumerate(turns[c])), key=lambda t: t[:3])
    for *_, r in order[:budget]:
        take(r, "failure")
    for h in sorted((h for h in histogram if not h["skipped"]), key=lambda h: (h["order"], h["count"], h["value"])):
        if len(chosen) >= n:
            break
        members = [c for c in candidates if h["value"] in c["strata"].get(h["field"], [])]
        if members and not any(m["id"] in chosen for m in members):
            take(central(members)[0], f"covers {h['field']}={h['value']}")
    for c in clusters:
        if len(chosen) < n and not any(x["cluster"] == c for x in chosen.values()):
            take(central([r for r in candidates if r["cluster"] == c])[0], f"central example of cluster {c}")
    have = Counter(x["cluster"] for x in chosen.values())
    need = {c: max(0.0, n * sizes[c] / total - have[c]) for c in clusters}
    quota = {c: int(need[c]) for c in clusters}
    left = n - len(chosen) - sum(quota.values())
    for c in sorted(clusters, key=lambda c: (quota[c] - need[c], c))[: max(0, left)]:
        quota[c] += 1

    if rounds:
        want, room = {}, n - len(chosen)
        for c in sorted(clusters):
            want[c] = min(quota[c], sizes[c] - have[c], room)
            room -= want[c]
        by: dict = defaultdict(list)
        for x in chosen.values():
            by[x["cluster"]].append(x["id"])
        for r in rounds(by, want):
            take(r, f"adds variety within cluster {r['cluster']}")
        if (more := min(n, total) - len(chosen)) > 0:
            for r in rounds({None: list(chosen)}, {None: more}):
                take(r, "adds variety")

    def farthest(rows: list[dict], against: list[dict]) -> dict | None:
        rows = sorted((r for r in rows if r["id"] not in chosen), key=lambda r: r["pos"])
        if not rows or not against:
            return rows[0] if rows else None
        if similarity is None:
            return max(rows, key=lambda r: (r["dist"], -r["pos"]))
        return min(rows, key=lambda r: max(similarity(r, a) for a in against))

    for c in sorted(clusters) if not rounds else ():
        for _ in range(quota[c]):
            if len(chosen) < n and (r := farthest([x for x in candidates if x["cluster"] == c], [x["row"] for x in chosen.values() if x["cluster"] == c])):
                take(r, f"adds variety within cluster {c}")
    while not rounds and len(chosen) < min(n, len(candidates)) and (r := farthest(candidates, [x["row"] for x in chosen.values()])):
        take(r, "adds variety")
    rows = sorted(chosen.values(), key=lambda x: (x["cluster"], x["row"]["pos"]))
    return [{k: v for k, v in x.items() if k != "row"} for x in rows]


def candidate_table(unique: DataFrame, n: int, stratify: tuple[str, ...] = ()) -> DataFrame:
    """The rows that pick() can want before the fill: of each cluster the n most central and the n most central failures, and of each
    stratum value the most central one. Bounded by 2 n clusters plus the stratum values that are
    not skipped, whatever the number of traces."""
    fields = [*FIELDS, *[f for f in stratify if f not in FIELDS]]
    hist = strata_histogram(unique, n, stratify).filter("skipped IS NULL").select("field", "value")
    strata = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[strata_values(f) for f in fields]))
    df = unique.withColumn("strata", strata)
    by = Window.partitionBy("cluster")
    ranked = df.withColumns({"__c": F.row_number().over(by.orderBy("dist", "pos")), "__f": F.row_number().over(Window.partitionBy("cluster", "failure").orderBy("dist", "pos"))})
    near = ranked.filter((F.col("__c") <= n) | (F.col("failure") & (F.col("__f") <= n))).select("id")
    pairs = df.select("id", "dist", "pos", F.explode(F.map_entries("strata")).alias("e")).select("id", "dist", "pos", F.col("e.key").alias("field"), F.explode("e.value").alias("value"))
    first = pairs.join(F.broadcast(hist), ["field", "value"]).groupBy("field", "value").agg(F.min_by("id", F.struct("dist", "pos")).alias("id")).select("id")
    return df.join(near.union(first).distinct(), "id", "left_semi").select("id", "pos", "cluster", "dist", "failure", "strata")


def _likeness(vectors: dict):
    """For each row and its cluster's picks, and under null for all: the greatest dot product, to 12 places."""
    held = {c: [(np.array(i, np.int64), np.array(x)) for i, x in rows] for c, rows in vectors.items()}
    width = 1 + max((int(i.max()) for rows in held.values() for i, _ in rows if len(i)), default=0)
    names = ["id", "pos", "cluster", "dist", "failure", "likeness"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            index, value, cluster = batch.column(5), batch.column(6).flatten().to_numpy(), np.array(batch.column(2).to_pylist(), object)
            at, starts = index.flatten().to_numpy(), np.concatenate([[0], np.cumsum(index.value_lengths().to_numpy())]).astype(np.int64)
            out = np.full(batch.num_rows, -1.0)
            value, at = np.where(at < width, value, 0.0), np.minimum(at, width - 1)
            for c, rows in held.items():
                of = np.ones(batch.num_rows, bool) if c is None else cluster == c
                for i, x in rows if of.any() else ():
                    dense = np.zeros(width)
                    dense[i] = x
                    sums = np.add.reduceat(np.append(dense[at] * value, 0.0), starts)[:-1] * (np.diff(starts) > 0)
                    out = np.where(of, np.maximum(out, sums), out)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.round(out, 12))], names=names)

    return run


def farthest_rounds(unique: DataFrame) -> Callable:
    """rounds(picked, want) over all rows of unique (features, or text for tfidf()): of each cluster want[cluster] rows, one
    in each round, whose greatest similarity to the cluster's picks is least, ties to the first position; a cluster None
    stands for all rows. picked: ids by cluster. The driver holds the picks and their vectors."""
    names = ("id", "pos", "cluster", "dist", "failure")

    @F.udf("struct<i: array<int>, x: array<double>>")
    def parts(v):
        dense = not isinstance(v, SparseVector)
        return (list(range(len(v))), v.toArray().tolist()) if dense else (v.indices.tolist(), v.values.tolist())

    if "features" in unique.columns:
        df = unique.select(*names, parts("features").alias("v")).select(*names, "v.i", "v.x")
    else:
        df = weighted_terms(unique.select(*names, "text"))[0].select(*names, F.col("__i").alias("i"), F.col("__x").alias("x"))
    rows = stage(df, "pick-vectors")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:5]) + ", likeness double"

    def rounds(picked: dict, want: dict) -> list[dict]:
        ids = sorted({i for x in picked.values() for i in x})
        of = {r.id: (r.i, r.x) for r in rows.filter(F.col("id").isin(ids)).select("id", "i", "x").collect()} if ids else {}
        vectors = {c: [of[i] for i in x] for c, x in picked.items()}
        left, found = {c: k for c, k in want.items() if k > 0}, []
        while left:
            free = rows.filter(~F.col("id").isin(ids)) if ids else rows
            if None not in left:
                free = free.filter(F.col("cluster").isin(list(left)))
            like = free.mapInArrow(_likeness({c: vectors.get(c, []) for c in left}), schema)
            best = like.groupBy(F.lit(None).cast("int").alias("k") if None in left else F.col("cluster").alias("k")).agg(F.min_by("id", F.struct("likeness", "pos")).alias("id"))
            new = [r.id for r in best.collect()]
            if not new:
                break
            for r in sorted(rows.filter(F.col("id").isin(new)).collect(), key=lambda r: (r.cluster, r.pos)):
                c = None if None in left else r.cluster
                found.append({k: r[k] for k in ("id", "pos", "cluster", "dist", "failure")})
                vectors.setdefault(c, []).append((r.i, r.x))
                ids.append(r.id)
                left[c] -= 1
            left = {c: k for c, k in left.items() if k > 0}
        return found

    return rounds


def select_traces(unique: DataFrame, n: int = 50, share: float = 0.3, stratify: tuple[str, ...] = ()) -> list[dict]:
    """pick() over candidate_table(), filled by farthest_rounds(); unique must have cluster and dist (see topic_clusters), and features or text."""
    fields = [*FIELDS, *[f for f in stratify if f not in FIELDS]]
    unique = stage(unique, "unique")  # read several times below
    hist = [{**r.asDict(), "order": fields.index(r["field"])} for r in strata_histogram(unique, n, stratify).filter("skipped IS NULL").collect()]
    rows = [r.asDict(recursive=True) for r in candidate_table(unique, n, stratify).collect()]
    sizes = {r["cluster"]: r["size"] for r in cluster_shares(unique).collect()}
    failures = unique.filter("failure").count()
    return pick(rows, hist, n, share, sizes=sizes, failures=failures, rounds=farthest_rounds(unique)) if rows else []

"""Approximate nearest neighbours by inner product: inverted lists, scanned with adaptive use of dimensions.

Vectors get one more component that makes all norms equal, so the largest inner product is the smallest distance, and a
random rotation spreads distances evenly over columns. Within each probed list, candidates are compared on one block of
columns after another; a hypothesis test on the partial distance - could the whole distance still be under the query's
threshold? - abandons most after the first blocks. Survivors are scored exactly, in double precision, on the original
vectors. Thresholds come from a first scan of each query's nearest lists.

Scale: lists are fitted on a bounded sample (``sample`` rows, 16 a list at least; they only steer the search), every row is
indexed. Equal vectors form one class, represented by its k + 1 smallest ids - no result can hold more of them - so copies,
however many, are one point. Lists are dealt by their measured sizes into shards of about ``SHARD_ROWS`` classes: small
neighbouring lists share one, a large list has several. The index moves once a pass; a query travels once to each shard
with a list that it probes. A task holds one shard, the queries stream past it in batches, and k + 1 classes a query
and shard at most come back.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecgrove.llm import common

K = 20
SAMPLE = 16_384
PROBE = 0.6
SEEDS = 2
BLOCK = 16
EPSILON = 2.1
SHARD_ROWS = 8_192
QUERY_ROWS = 256
LIST_SAMPLE = 16


def valid(vectors: DataFrame, id_: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: finite vectors that are not zero. Rows with a null id take none."""
    v = F.col(vec).cast("array<double>")
    ok = F.col(id_).isNotNull() & F.col(vec).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(ok).select(F.col(id_).cast("long").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))


class Model:
    """Rotation, centres, and the common norm."""

    def __init__(self, sample: np.ndarray, norm: float, lists: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.norm = norm
        self.dim = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
        x = self.place(sample)
        c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(8):
            near = _nearest(x, c)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            n = np.bincount(near, minlength=len(c))
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        self.centres = c

    def place(self, v: np.ndarray) -> np.ndarray:
        """Candidates, with equal norms, rotated."""
        rest = np.sqrt(np.maximum(self.norm**2 - (v * v).sum(axis=1), 0.0))
        return np.column_stack((v, rest)) @ self.rotation

    def ask(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack((v, np.zeros(len(v)))) @ self.rotation


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(axis=1)
    return np.concatenate([(x[k : k + 2048] @ c.T - half).argmax(axis=1) for k in range(0, len(x), 2048)])


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def scan_list(x: np.ndarray, q: np.ndarray, tau: np.ndarray, block: int = BLOCK, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) of one list whose distance the test does not put above the query's threshold tau^2."""
    dim = x.shape[1]
    d = min(block, dim)
    part = (q[:, :d] ** 2).sum(axis=1)[:, None] + (x[:, :d] ** 2).sum(axis=1)[None, :] - 2 * (q[:, :d] @ x[:, :d].T)
    i, j = np.nonzero(part * (dim / d) <= (tau * (1 + epsilon / math.sqrt(d)) ** 2)[:, None])
    far = part[i, j]
    while d < dim and len(i):
        e = min(d + block, dim)
        far = far + ((q[i, d:e] - x[j, d:e]) ** 2).sum(axis=1)
        d = e
        slack = (1 + epsilon / math.sqrt(d)) ** 2 if d < dim else 1 + 1e-9
        stay = far * (dim / d) <= tau[i] * slack
        i, j, far = i[stay], j[stay], far[stay]
    return i, j


def deal(counts: np.ndarray, order: np.ndarray, shard_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each list: lists join in the given order until a shard is full, large ones split."""
    first, parts = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // shard_rows))
    shard, room = -1, 0
    for c in order.tolist():
        if parts[c] > 1 or counts[c] > room:
            first[c], shard = shard + 1, shard + parts[c]
            room = shard_rows - counts[c] if parts[c] == 1 else 0
        else:
            first[c], room = shard, room - counts[c]
    return first, parts


def search(vectors: DataFrame, is_query, k: int = K, probe: float = PROBE, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS, id_: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the nearest found for each row with ``is_query(vec_id)``.

    All rows but the query's own id are candidates; ties go to the smaller vec_id. Rows whose vector is null or zero, or
    holds null or non-finite components, take no part; rows that repeat id and vector count once. Vectors of different
    lengths have no inner product: each length is searched by itself. With fewer candidates than k all that are found are
    returned; an empty table gives an empty result. Other columns are ignored.
    """
    rows = common.cut(valid(vectors, id_, vec).distinct(), "vectors")
    dims = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())  # usually one
    found = [_search(rows.where(F.size("v") == d), is_query, k, probe, sample, shard_rows) for d in dims]
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for f in found:
        out = f if f is found[0] else out.unionByName(f)
    return out


def _search(rows: DataFrame, is_query, k: int, probe: float, sample: int, shard_rows: int) -> DataFrame:
    """:func:`search` over rows of one length."""
    spark = rows.sparkSession
    within = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(within)).where(F.col("r") <= k + 1)
    classes = common.cut(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("cls", F.get("ids", 0)), "classes")
    n, norm2 = classes.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()

    lists = max(1, min(sample // LIST_SAMPLE, n // 4 + 1, int(4 * math.sqrt(n))))
    part = min(1.0, sample / n)
    picked = classes.where(F.pmod(F.xxhash64("cls", F.lit(5)), F.lit(1 << 30)) < int(part * (1 << 30)) + 1).select("cls", "v").orderBy("cls")
    fit = np.array([r.v for r in picked.toLocalIterator()], np.float64)  # about ``sample`` rows
    if not len(fit):
        fit = np.array([classes.orderBy("cls").first().v], np.float64)
    model = Model(fit, math.sqrt(norm2), lists)
    n_lists = len(model.centres)
    probes = max(1, math.ceil(probe * n_lists))
    shared_model = common.share(spark, model)

    def assign(batches):
        model = shared_model.value
        for b in batches:
            if b.num_rows:
                near = _nearest(model.place(_matrix(b.column(1))), model.centres)
                yield pa.RecordBatch.from_arrays([pa.array(near), *b.columns], names=["list", "cls", "v"])

    index = common.cut(common.map_arrow(classes.select("cls", "v"), assign, "list long, cls long, v array<double>"), "index")
    counts = np.zeros(n_lists, np.int64)
    for r in index.groupBy("list").count().collect():  # one row a list
        counts[r["list"]] = r["count"]
    # neighbouring lists share a shard: centres in the order of their first principal direction
    centred = model.centres - model.centres.mean(axis=0)
    order = np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")
    first_shard, parts = deal(counts, order, shard_rows)
    shared = common.share(spark, (model, first_shard, parts))
    starts = F.array(*[F.lit(int(x)).cast("long") for x in first_shard]), F.array(*[F.lit(int(x)).cast("long") for x in parts])
    at = F.col("list").cast("int")
    shard = F.get(starts[0], at) + F.pmod(F.xxhash64("cls", F.lit(3)), F.get(starts[1], at))
    none = F.lit(None)
    stored = index.select(shard.alias("shard"), F.lit(0).alias("kind"), "list", "cls", "v", none.cast("double").alias("tau"))
    stored = common.cut(stored, "shards")
    common.drop_cut(index)

    queries = rows.where(is_query(F.col("vec_id")))
    own = common.cut(queries.join(classes.select("v", "cls"), "v").select(F.col("vec_id").alias("query_id"), "cls"), "queries")
    asked = classes.join(own.select("cls").distinct(), "cls", "left_semi").select("cls", "v")

    def ranked(model, q, lo, hi):
        """The lists of each query from the lo-th to the hi-th nearest."""
        half = 0.5 * (model.centres**2).sum(axis=1)
        return np.argsort(-(q @ model.centres.T - half), axis=1, kind="stable")[:, lo:hi]

    def send(lo: int, hi: int):
        def run(batches):
            model, first_shard, parts = shared.value
            last_shard = first_shard + parts
            for b in common.slices(batches):
                if not b.num_rows:
                    continue
                near = ranked(model, model.ask(_matrix(b.column(1))), lo, hi)
                i, to = [], []
                for row, ls in enumerate(near):
                    s = np.unique(np.concatenate([np.arange(a, z) for a, z in zip(first_shard[ls], last_shard[ls])]))
                    i.append(np.full(len(s), row))
                    to.append(s)
                i, to = np.concatenate(i), np.concatenate(to)
                rows = b.take(pa.array(i))
                nothing = pa.nulls(len(i), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.ones(len(i), np.int32)), nothing, *rows.columns], names=["shard", "kind", "list", "cls", "v", "tau"])

        return run

    def scan(lo: int, hi: int):
        """Rows come by shard, its classes first: they are laid out by list, and the queries that follow are scanned in batches."""

        def run(batches):
            model = shared.value[0]
            now, held, ready = None, [], None
            for b in batches:
                for s in _stretches(b):
                    key, kind = s.column(0)[0].as_py(), s.column(1)[0].as_py()
                    if key != now:
                        now, held, ready = key, [], None
                    if kind == 0:
                        held.append(s)
                    elif held:
                        ready = ready or layout(model, held)
                        for part in common.slices([s], QUERY_ROWS):
                            yield answer(model, ready, part)

        def layout(model, held):
            t = pa.Table.from_batches(held).sort_by([("list", "ascending"), ("cls", "ascending")])
            v = _matrix(t.column("v").combine_chunks())
            lists = t.column("list").to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1], [True])))
            return v, model.place(v), t.column("cls").to_numpy(), lists[edge[:-1]], edge

        def answer(model, ready, part):
            v, x, cls, lists, edge = ready
            w, ids, tau = _matrix(part.column(4)), part.column(3).to_numpy(), part.column(5).to_numpy(zero_copy_only=False)
            q = model.ask(w)
            probed = np.zeros((len(q), len(model.centres)), bool)
            np.put_along_axis(probed, ranked(model, q, lo, hi), True, axis=1)
            got: list[list[np.ndarray]] = [[], [], []]
            for c, s, e in zip(lists.tolist(), edge[:-1].tolist(), edge[1:].tolist()):
                some = np.flatnonzero(probed[:, c])
                if len(some):
                    i, j = scan_list(x[s:e], q[some], tau[some])
                    for to, values in zip(got, (some[i], s + j, (w[some[i]] * v[s + j]).sum(axis=1))):
                        to.append(values)
            i, j, score = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in got)
            by = np.lexsort((cls[j], -score, i))
            i, j, score = i[by], j[by], score[by]
            top = np.arange(len(i)) - np.searchsorted(i, i) <= k
            return pa.RecordBatch.from_arrays([pa.array(ids[i[top]]), pa.array(cls[j[top]]), pa.array(score[top].astype(np.float64))], names=["query", "cls", "score"])

        return run

    def pass_(asking: DataFrame, lo: int, hi: int) -> DataFrame:
        sent = common.map_arrow(asking, send(lo, hi), "shard long, kind int, list long, cls long, v array<double>, tau double")
        met = stored.unionByName(sent).repartition("shard").sortWithinPartitions("shard", "kind")
        return common.map_arrow(met, scan(lo, hi), "query long, cls long, score double")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
    seeds = min(SEEDS, probes)
    first = common.cut(pass_(asked.withColumn("tau", F.lit(float("inf"))), 0, seeds), "seeds")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    kth = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k + 1).select(F.col("query").alias("cls"), F.col("score").alias("kth"))
    # |q - x|^2 of the placed vectors is |q|^2 + norm^2 - 2 q.x
    tau = asked.join(kth, "cls", "left").select("cls", "v", F.coalesce(squares + float(norm2) - 2 * F.col("kth") + 1e-9 * float(norm2), F.lit(float("inf"))).alias("tau"))
    found = first.unionByName(pass_(tau, seeds, probes)) if probes > seeds else first
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("query", "cls", "score")
    named = top.join(classes.select("cls", "ids"), "cls").select("query", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1).drop("r")
    each = own.join(named.withColumnRenamed("query", "cls"), "cls").where("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _stretches(batch):
    """The batch cut where the shard or the kind changes."""
    if batch.num_rows:
        shard, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        edge = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), batch.num_rows]
        for s, e in zip(edge, edge[1:]):
            yield batch.slice(s, e - s)

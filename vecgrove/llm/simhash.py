"""SimHash fingerprints and exact near-duplicate groups through vantage-point trees.

A fingerprint has 64 bits; texts link when theirs differ in at most ``radius`` bits. Equal fingerprints collapse first,
so a group of copies is one point however many rows it has. Points are then dealt into shards: the 64 bits are cut into
``m`` blocks, and two points within ``radius`` bits are at Hamming distance 0 in some ``m - radius`` of them, so a point
visits one shard for each choice of blocks - the only cells its ball can overlap. Within a shard a vantage-point tree is
built: points are split by their distance from a vantage point, and branches are pruned by the triangle bound, so only
the two rims within ``radius`` of the split are compared across it. Sharding by a tree alone over all 64 bits would copy
every point into most shards, since distances of unrelated fingerprints crowd around 32 (see README).

Shards emit stars (point, smallest point of its part), never pairs, so their output stays below the number of visits
even inside groups where everything links with everything.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.llm import common, graph

SHINGLE = 4
RADIUS = 4
LEAF = 256
_SEED = 42
#: Of keep_one: words of a shingle, least Jaccard similarity of two texts' shingles, and the minimum hashes that find candidates.
KEEP_SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Texts of a group of candidates that one task compares.
GROUP = 512


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """The words of a whole text, lower-case and one space apart, and a hash of each run of ``shingle`` words."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    joined = b" ".join(ws)
    if not ws:
        hashes = []
    elif len(ws) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, _SEED)]
    else:
        ends = (np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1).tolist()
        starts = [0, *(e + 1 for e in ends[: len(ws) - shingle])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], _SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    return joined, np.array(hashes, np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a whole text; 0 if it has no words."""
    return majority(shingle_hashes(text, shingle)[1])


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed long."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        part = h[k : k + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id by default) with ``fp``, the fingerprint of ``text``, as a signed long."""
    keep = ["doc_id"] if keep is None else keep
    source = docs.select(*keep, F.col(text).alias("__text"))
    schema = source.drop("__text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], names=schema.names)

    return common.map_arrow(source, run, schema)


# -- vantage-point trees -------------------------------------------------------------------------------------------


def join_points(points: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> np.ndarray:
    """For sorted distinct uint64 ``points`` of one shard: the index of each point's part's first point."""
    root = np.arange(len(points))
    if len(points) > 1:
        _within(points, np.arange(len(points)), radius, leaf, root)
        root = _flat(root)
    return root


def _flat(root: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := root[root], root):
        root = up
    return root


def _link(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> None:
    """Union of the parts of a[i] and b[i]; the smaller root stays."""
    while len(a):
        root[:] = _flat(root)
        x, y = root[a], root[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))


def _compare(p: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, root: np.ndarray) -> None:
    near = np.bitwise_count(p[left][:, None] ^ p[right][None, :]) <= radius
    i, j = np.nonzero(near)
    _link(left[i], right[j], root)


def _within(p: np.ndarray, at: np.ndarray, radius: int, leaf: int, root: np.ndarray) -> None:
    """All links among the points ``at``."""
    todo = [at]
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            _compare(p, at, at, radius, root)
            continue
        d = np.bitwise_count(p[at] ^ p[at[0]]).astype(np.int64)
        ball = d <= radius // 2  # any two points of this ball link, so the vantage point stands for their part
        _link(at[ball], np.full(int(ball.sum()), at[0]), root)
        mu = radius // 2 if 2 * ball.sum() >= len(at) else int(np.median(d))
        inner, outer = d <= mu, d > mu
        if not outer.any():
            inner, outer = d < mu, d >= mu
            mu -= 1
        if not inner.any() or not outer.any():  # all at one distance: no split
            for k in range(0, len(at), leaf):
                _across(p, at[k : k + leaf], at[k:], radius, leaf, root)
            continue
        if mu > radius // 2:
            todo.append(at[inner])
        todo.append(at[outer])
        _across(p, at[inner & (d > mu - radius)], at[outer & (d <= mu + radius)], radius, leaf, root)


def _across(p: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, leaf: int, root: np.ndarray) -> None:
    """All links between two sets, each side split by its distance from a vantage point."""
    todo = [(left, right, 0)]
    while todo:
        left, right, depth = todo.pop()
        if not len(left) or not len(right):
            continue
        if len(left) * len(right) <= leaf * leaf or depth > 40:
            for k in range(0, len(left), leaf):
                for n in range(0, len(right), 4 * leaf):
                    _compare(p, left[k : k + leaf], right[n : n + 4 * leaf], radius, root)
            continue
        v = p[left[depth % len(left)]]
        dl, dr = (np.bitwise_count(p[x] ^ v).astype(np.int64) for x in (left, right))
        mu = int(np.median(np.concatenate((dl, dr))))
        parts = [(dl <= mu, dr <= mu + radius), (dl > mu, dr > mu - radius)]
        if all(a.all() and b.all() or not a.any() or not b.any() for a, b in parts):
            depth = 99
        todo += [(left[a], right[b], depth + 1) for a, b in parts]


# -- the distributed join ------------------------------------------------------------------------------------------


def blocks_for(points: int, radius: int = RADIUS) -> int:
    """Blocks to cut 64 bits into: more for more points, so that a shard's expected size stays in the hundreds."""
    for m in range(radius + 1, 16):
        if points >> (64 * (m - radius) // m) <= 64:
            return m
    return 16


def shard_keys(fp, m: int, radius: int = RADIUS):
    """Array of the shards that a point visits: for each choice of m - radius blocks, the choice and their bits."""
    edges = [64 * k // m for k in range(m + 1)]
    keys = []
    for n, choice in enumerate(itertools.combinations(range(m), m - radius)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in choice)
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.struct(F.lit(n).cast("short").alias("choice"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("bits")))
    return F.array(*keys)


def links(points: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """Stars (u, v) that connect the distinct ``points(fp)`` within ``radius`` bits of each other, whole groups only."""
    n = points.count()
    m = blocks_for(n, radius)
    visits = points.select("fp", F.explode(shard_keys(F.col("fp"), m, radius)).alias("s")).select("s.choice", "s.bits", "fp")
    dealt = visits.repartition("choice", "bits").sortWithinPartitions("choice", "bits")

    def run(batches):
        held: list[np.ndarray] = []
        key = None
        for b in batches:
            choice = b.column(0).to_numpy(zero_copy_only=False)
            bits = b.column(1).to_numpy(zero_copy_only=False)
            fp = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fp):
                continue
            cuts = [0, *(np.flatnonzero((np.diff(choice) != 0) | (np.diff(bits) != 0)) + 1).tolist(), len(fp)]
            us, vs = [], []
            for s, e in zip(cuts, cuts[1:]):
                k = (choice[s], bits[s])
                if k != key:
                    _flush(held, us, vs)
                    held, key = [], k
                held.append(fp[s:e].copy())
            yield _batch(us, vs)
        us, vs = [], []
        _flush(held, us, vs)
        yield _batch(us, vs)

    def _flush(held, us, vs):
        if sum(map(len, held)) > 1:
            p = np.sort(np.concatenate(held))
            root = join_points(p, radius, leaf)
            moved = np.flatnonzero(root != np.arange(len(p)))
            us.append(p[moved])
            vs.append(p[root[moved]])

    def _batch(us, vs):
        a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (us, vs))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    return common.map_arrow(dealt, run, "u long, v long")


def grouped(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``prints`` (with fp and doc_id) and component_id: the smallest doc_id reachable over links, itself included."""
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    points = common.cut(points, "points")
    parts = graph.components(links(points.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = points.join(parts, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    Null and wordless texts have fingerprint zero and link like any other. Repeated rows each get a row. A row with a
    null doc_id joins its group but never names it; a group of such rows alone has a null component_id. An empty table
    gives an empty result. Other columns are ignored.
    """
    prints = common.cut(fingerprints(docs, shingle), "fingerprints")
    return grouped(prints, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- whole texts by exact similarity -------------------------------------------------------------------------------


def band_keys(h: np.ndarray) -> list[int]:
    """A key for each band of minimum hashes of a set; none of an empty set. Sets of similarity 0.8 share one but for 7 in 100 000."""
    if not len(h):
        return []
    factors, terms = np.random.default_rng(_SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(h), 1 << 12):
        low = np.minimum(low, (h[k : k + (1 << 12)] * (factors | np.uint64(1)) + terms).min(axis=1))
    digests = [xxhash.xxh64_intdigest(band.tobytes(), n) for n, band in enumerate(low.reshape(BANDS, ROWS))]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def sketches(numbered: DataFrame, shingle: int) -> DataFrame:
    """``numbered(doc, row)`` with the hash of the words (h1, h2), the fingerprint fp and the band keys of doc.text."""
    source = numbered.select("doc", "row", F.col("doc.text").alias("__text"))
    long = F.lit(0).cast("long")
    schema = source.drop("__text").select("*", long.alias("h1"), long.alias("h2"), long.alias("fp"), F.array(long).alias("keys")).schema

    def run(batches):
        for b in common.slices(batches):
            h1, h2, fps, keys = [], [], [], []
            for t in b.column(b.num_columns - 1):
                joined, h = shingle_hashes(t.as_py(), shingle)
                a, c = np.frombuffer(xxhash.xxh3_128_digest(joined), np.int64).tolist()
                h1.append(a)
                h2.append(c)
                fps.append(majority(h))
                keys.append(band_keys(np.unique(h)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return common.map_arrow(source, run, schema)


class _Sets:
    """Sets of hashes, to be asked which of them are similar to one."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.held = np.zeros(len(self.ids) + 1, bool)
        self.summed = np.zeros(len(self.ids) + 1, np.int64)

    def near(self, i: int, similarity: float) -> np.ndarray:
        own = self.ids[self.starts[i] : self.ends[i]]
        self.held[own] = True
        np.cumsum(self.held[self.ids], out=self.summed[1:])
        self.held[own] = False
        both = self.summed[self.ends] - self.summed[self.starts]
        return np.flatnonzero(both >= similarity * (self.sizes + self.sizes[i] - both) - 1e-9)


def similar_parts(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For distinct hashes of each text: the index of the first text of its part; texts link at Jaccard ``similarity`` or more.

    Texts are compared with all others one by one, until those not yet asked are all of one part: no pair is left out.
    """
    n = len(sets)
    all_ = _Sets(sets)
    root, rest = np.arange(n), np.ones(n, bool)
    while rest.any():
        most = np.bincount(root[rest], minlength=n).argmax()
        apart = np.flatnonzero(rest & (root != most))
        if not len(apart):
            break
        i = apart[0]
        near = all_.near(i, similarity)
        _link(near, np.full(len(near), i), root)
        root = _flat(root)
        rest[i] = False
    return root


def _by_group(df: DataFrame, keys: int, make, schema: str) -> DataFrame:
    """``make(rows)`` for the rows (as tuples) of each run of equal first ``keys`` columns; the frame is dealt and sorted by them."""

    def run(batches):
        now, held = None, []
        for b in common.slices(batches):
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:keys] != now:
                    if held:
                        yield make(held)
                    now, held = row[:keys], []
                held.append(row)
        if held:
            yield make(held)

    return common.map_arrow(df, run, schema)


def verified(members: DataFrame, shingle: int, similarity: float, group: int = GROUP) -> DataFrame:
    """(row, part) of ``members(root, row, text)``: the parts into which exact similarity divides each group of candidates.

    A group of at most ``group`` texts is one task's work. A larger one is first compared with its smallest row alone, in
    salted pieces: those similar to it are one part, and need no comparison with each other. The others are compared with
    the whole group, one piece of them against one piece of the group at a time. Pieces hold about ``group`` texts and
    emit stars, so neither a task nor the result grows with a group. Rows that link with nothing may be missing.
    """
    sets = lambda rows, at: [np.unique(shingle_hashes(r[at], shingle)[1]) for r in rows]
    sizes = common.cut(members.groupBy("root").agg(F.count("*").alias("n"), F.min("row").alias("pivot")), "groups")

    def parts(rows):
        at = np.array([r[1] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(at[similar_parts(sets(rows, 2), similarity)])], names=["row", "part"])

    few = members.join(sizes.where(F.col("n") <= group).select("root"), "root", "left_semi").select("root", "row", "text")
    small = _by_group(few.repartition("root").sortWithinPartitions("root", "row"), 1, parts, "row long, part long")
    if sizes.where(F.col("n") > group).isEmpty():
        return small

    pieces = F.ceil(F.col("n") / group).cast("int")
    large = members.join(sizes.where(F.col("n") > group), "root").withColumn("pieces", pieces)
    each = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")
    piece = F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int").alias("piece")
    pivots = large.where("row = pivot").select("root", each, F.lit(0).alias("kind"), "row", "text")
    rest = large.where("row <> pivot").select("root", piece, F.lit(1).alias("kind"), "row", "text")
    dealt = pivots.unionByName(rest).repartition("root", "piece").sortWithinPartitions("root", "piece", "kind")

    def pivoted(rows):
        own, *others = sets(rows, 4)
        both = np.array([len(np.intersect1d(own, x, assume_unique=True)) for x in others], np.int64)
        near = both >= similarity * (len(own) + np.array([len(x) for x in others], np.int64) - both) - 1e-9
        row = np.array([r[3] for r in rows[1:]], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[1:]], pa.int64()), pa.array(row), pa.array(np.full(len(row), rows[0][3])), pa.array(near)], names=["root", "row", "pivot", "near"])

    told = common.cut(_by_group(dealt, 2, pivoted, "root long, row long, pivot long, near boolean"), "pivoted")
    outside = told.where("not near")
    edges = told.where("near").select(F.col("row").alias("u"), F.col("pivot").alias("v"))
    counts = outside.groupBy("root").agg(F.ceil(F.count("*") / group).cast("int").alias("askers"))
    open_ = large.join(counts, "root")
    asking = open_.join(outside.select("row"), "row", "left_semi")
    asker = F.pmod(F.xxhash64("row", F.lit(1)), F.col("askers")).cast("int").alias("asker")
    whole = open_.select("root", piece, F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("asker"), F.lit(0).alias("kind"), "row", "text")
    met = whole.unionByName(asking.select("root", each, asker, F.lit(1).alias("kind"), "row", "text"))
    met = met.repartition("root", "piece", "asker").sortWithinPartitions("root", "piece", "asker", "kind")

    def compared(rows):
        all_, root = _Sets(sets(rows, 5)), np.arange(len(rows))
        for i in [k for k, r in enumerate(rows) if r[3] == 1]:
            near = all_.near(i, similarity)
            _link(near, np.full(len(near), i), root)
        root = _flat(root)
        row = np.array([r[4] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(row[root])], names=["u", "v"])

    edges = edges.unionByName(_by_group(met, 3, compared, "u long, v long").where("u <> v"))
    return small.unionByName(graph.components(edges).select(F.col("node").alias("row"), F.col("root").alias("part")))


def keep_one(docs: DataFrame, shingle: int = KEEP_SHINGLE, radius: int = RADIUS, similarity: float = SIMILARITY, group: int = GROUP) -> DataFrame:
    """One whole row of each near-duplicate group: that with the smallest doc_id (null last), then the smallest row number.

    Texts link if the sets of their shingles have Jaccard similarity ``similarity`` or more. Texts of the same words are
    one point. Candidates are points whose fingerprints the trees link, and points that share a band of minimum hashes,
    since at similarity 0.8 fingerprints lie about ten bits apart, which no tree over 64 bits can search. Whole groups of
    candidates are then compared exactly.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")  # apart from the names used here
    numbered = docs.select(whole, F.monotonically_increasing_id().alias("row"))
    saved = common.cut(sketches(numbered, shingle), "numbered")
    tagged = saved.select(F.col("doc.doc_id").alias("doc_id"), "row", "h1", "h2", "fp", "keys")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("best")
    points = tagged.groupBy("h1", "h2").agg(best, F.min("fp").alias("fp"), F.first("keys").alias("keys"))
    points = common.cut(points.select("best", F.col("best.row").alias("row"), "fp", "keys"), "points")
    trees = graph.components(links(points.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")
    visits = points.join(trees, "fp", "left").select("row", F.coalesce("root", "fp").alias("key")).unionByName(points.select("row", F.explode("keys").alias("key")))
    buckets = visits.groupBy("key").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("key", "low")
    stars = visits.join(buckets, "key").where("row <> low").select(F.col("row").alias("u"), F.col("low").alias("v"))
    roots = common.cut(graph.components(stars).withColumnRenamed("node", "row"), "candidates")
    members = saved.select("row", F.col("doc.text").alias("text")).join(roots, "row")
    parts = common.cut(verified(members.select("root", "row", "text"), shingle, similarity, group), "parts")
    common.release(docs.sparkSession)
    rooted = points.join(parts, "row", "left").select("best", F.coalesce("part", "row").alias("part"))
    winners = rooted.groupBy("part").agg(F.min("best").alias("best")).select("best.row")
    return saved.join(winners, "row", "left_semi").select("doc.*")

"""Removal of strings that occur more than once in the whole table, by bucket-pointer refinement of suffixes.

A symbol (a byte; or a word) goes if some run of ``length`` symbols over it starts at two places of the table. Only the
first ``length`` symbols of a suffix matter, so suffixes are runs (windows) of that length, and those that share their
anchor - the gram of ``gram`` symbols inside with the smallest identifier - are handled as one reach of windows. Equal
windows have equal anchors at equal offsets, so a window is only ever compared inside the bucket of its anchor's gram.

1. Initial buckets: reaches by the gram of their anchor. Buckets of one suffix are final.
2. Reaches of a bucket that are equal from end to end settle together, however many there are, as counts and not as
   pairs; one of them stands for all below.
3. What is left is refined on its own symbols. The reaches of a bucket are aligned at the anchor. On either side of it,
   initial pointers name the q-grams exactly; reaches are then sorted on their pointers at offsets 0, q, 2q, ..., and the
   ranks are the pointers of the next, deeper sort, until one pointer names the whole side. In that order, the symbols
   that neighbours share give the pointers to every depth at once. A window is named by the pointers of its parts before
   the anchor and from it on: a last sort on both settles which windows are equal, symbol by symbol, with no hash.

Buckets of more than ``group`` reaches are dealt into shards that are refined alone; windows that a shard leaves open meet
those of the other shards as (gram, identifier of the window), 128 bits in all, so no task holds a bucket.

Texts move only for documents that ask or lose bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.llm import common

LENGTH = 400
GRAM = 128
GROUP = 512
#: Of the count of shared words: words of a passage, and of its grams.
PASSAGE = 50
PASSAGE_GRAM = 10
#: Reaches that are refined in one go, at least.
BATCH = 1024
_CHUNK = 1 << 15
_POS = np.uint64(_CHUNK - 1)
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)


_VALUE = _table(20240229)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64, up to n."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


class Symbols:
    """A sequence of symbols and the identifiers of its runs, from sums of hashed prefixes; ``bounds`` part it into texts."""

    def __init__(self, symbols: np.ndarray, values: np.ndarray, bounds: np.ndarray | None = None):
        self.symbols, self.n = symbols, len(symbols)
        self.bounds = np.array([0, self.n]) if bounds is None else bounds
        up, self.down = _powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.multiply(values, up[: self.n], out=self.sums[1:])
        np.cumsum(self.sums[1:], out=self.sums[1:])

    def ids(self, start, end):
        """Identifier of the run from start to end, for arrays of starts and ends."""
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _M2)

    def all_ids(self, length: int, lo: int, hi: int) -> np.ndarray:
        """Identifiers of the runs of ``length`` that start at lo, ..., hi - 1."""
        h = self.sums[lo + length : hi + length] - self.sums[lo:hi]
        h *= self.down[lo:hi]
        h += np.uint64(length * int(_M2) % (1 << 64))
        return _mix(h)


class Bytes(Symbols):
    """Each byte is a symbol."""

    kind = np.dtype(np.uint8)

    def __init__(self, texts: list[bytes]):
        a = np.frombuffer(b"".join(texts), np.uint8)
        super().__init__(a, _VALUE[a], np.cumsum([0, *map(len, texts)]))

    @staticmethod
    def of(symbols: np.ndarray) -> Symbols:
        return Symbols(symbols, _VALUE[symbols])


class Words(Symbols):
    """Each word is a symbol: its identifier. Words are parted by ASCII blanks, whatever their number."""

    kind = np.dtype(np.int64)

    def __init__(self, texts: list[bytes]):
        data = b" ".join(texts)
        a = np.frombuffer(data, np.uint8)
        blank = np.ones(len(a) + 2, np.int8)
        blank[1:-1] = (a == 32) | (a - np.uint8(9) <= 4)
        edge = np.diff(blank)
        starts = np.flatnonzero(edge == -1)
        ids = Bytes([data]).ids(starts, np.flatnonzero(edge == 1))
        super().__init__(ids.view(np.int64), ids, np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])))

    @staticmethod
    def of(symbols: np.ndarray) -> Symbols:
        return Symbols(symbols, symbols.view(np.uint64))


def anchors(b: Symbols, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of ``length`` symbols inside a text: positions of their anchors, and the first and last window of each.

    A window's anchor is the gram inside it with the smallest identifier, the leftmost of several; equal windows have
    equal anchors at equal offsets, whatever surrounds them.
    """
    last = b.n - length + 1  # windows
    if last < 1:
        return (np.zeros(0, np.int64),) * 3
    w = length - gram + 1  # grams in a window
    # windows that start in the last length - 1 symbols of a text reach over its end
    edges = np.zeros(b.n + 1, np.int32)
    np.add.at(edges, np.maximum(b.bounds[:-1], b.bounds[1:] - length + 1), 1)
    np.add.at(edges, b.bounds[1:], -1)
    whole = np.cumsum(edges)[:last] == 0
    at, lo, hi = [], [], []
    place = np.arange(_CHUNK, dtype=np.uint64)
    for s in range(0, last, _CHUNK - w):
        e = min(last, s + _CHUNK - w)
        h = b.all_ids(gram, s, e + w - 1)
        h &= ~_POS
        h |= place[: len(h)]
        k = e - s
        low = _window_minima(h, w)[:k] & _POS
        inside = whole[s:e]
        cut = np.concatenate(([0], np.flatnonzero((low[1:] != low[:-1]) | (inside[1:] != inside[:-1])) + 1, [k]))
        kept = inside[cut[:-1]]
        at.append(low[cut[:-1]][kept].astype(np.int64) + s)
        lo.append(cut[:-1][kept] + s)
        hi.append(cut[1:][kept] - 1 + s)
    at, lo, hi = np.concatenate(at), np.concatenate(lo), np.concatenate(hi)
    # a reach that two chunks share is one
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (lo[1:] != hi[:-1] + 1))) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return at[first], lo[first], hi[np.append(first[1:], len(at)) - 1] if len(at) else hi


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values: of two overlapping stretches whose length is a power of two."""
    size = 1
    while 2 * size <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (w - size)], h[w - size :]) if size < w else h


# -- refinement of one batch of buckets ----------------------------------------------------------------------------


def _ranks(x: np.ndarray) -> np.ndarray:
    """Dense ranks within each row."""
    order = np.argsort(x, axis=1)
    s = np.take_along_axis(x, order, 1)
    r = np.zeros(x.shape, np.int64)
    np.cumsum(s[:, 1:] != s[:, :-1], axis=1, out=r[:, 1:])
    out = np.empty_like(r)
    np.put_along_axis(out, order, r, 1)
    return out


def bucket_pointers(grams: np.ndarray) -> np.ndarray:
    """Ranks of the members in the order of ``grams[0, m], grams[1, m], ...``: equal iff all grams of two members are.

    Initial pointers are the ranks of the grams. Each turn sorts on the pointers at as many neighbouring offsets as one key
    holds; the ranks, pointers to that greater depth, are what the next turn sorts on.
    """
    bits = max(1, (grams.shape[1] - 1).bit_length())
    terms = max(2, 63 // bits)
    pointers = _ranks(grams)
    while len(pointers) > 1:
        key = pointers[::terms].copy()
        for k in range(1, terms):
            later = pointers[k::terms]
            key[: len(later)] = key[: len(later)] << bits | later
        pointers = _ranks(key)
    return pointers[0]


def depth_pointers(side: np.ndarray, bucket: np.ndarray, least: int = 0) -> np.ndarray:
    """pointer[d - least, m]: equal in a row iff two members are of one bucket and the first d symbols of their sides are equal."""
    n, depth = side.shape
    if side.dtype == np.uint8:  # eight bytes make a gram, the first the most significant
        q = 8
        grams = np.ascontiguousarray(np.pad(side, ((0, 0), (0, -depth % q)))).view(">u8").astype(np.uint64).T
    else:
        q, grams = 1, side.T
    if not depth:
        return bucket[None, :].astype(np.int64)
    order = np.lexsort((bucket_pointers(grams), bucket))
    sorted_ = grams[:, order]
    differ = sorted_[:, 1:] ^ sorted_[:, :-1]
    at = (differ != 0).argmax(axis=0)
    value = differ[at, np.arange(n - 1)]
    shared = at * q
    if q == 8:
        shared += (np.ascontiguousarray(value.astype(">u8")).view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
    shared = np.where(value == 0, depth, shared)
    shared[bucket[order][1:] != bucket[order][:-1]] = -1
    pointers = np.zeros((depth + 1 - least, n), np.int64)
    np.cumsum(shared[None, :] < np.arange(least, depth + 1)[:, None], axis=1, out=pointers[:, 1:])
    out = np.empty_like(pointers)
    out[:, order] = pointers
    return out


def repeated_windows(bucket, owner, back, span, parts: list[np.ndarray], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, place, hit) of every window of every reach: whether one at that place of its bucket with another owner equals it.

    Place length - gram is that of the window which begins with the anchor. ``parts`` are the symbols of the reaches,
    from ``back`` symbols before the anchor on; ``span`` windows follow the first.
    """
    n, most = len(parts), length - gram
    before, after = np.zeros((n, most), parts[0].dtype), np.zeros((n, length), parts[0].dtype)
    for i, p in enumerate(parts):
        k = back[i]
        before[i, :k] = p[:k][::-1]
        after[i, : len(p) - k] = p[k:]
    left, right = depth_pointers(before, bucket), depth_pointers(after, bucket, gram)
    size = span + 1
    member = np.repeat(np.arange(n), size)
    place = np.arange(len(member)) - np.repeat(np.cumsum(size) - size - (most - back), size)
    name = (left[most - place, member] * n + right[place, member]) * (most + 1) + place
    order = np.lexsort((owner[member], name))
    name, own = name[order], owner[member][order]
    same = np.concatenate(([False], name[1:] == name[:-1]))
    differ = np.concatenate(([False], own[1:] != own[:-1])) & same
    which = np.cumsum(~same) - 1
    many = np.zeros(which[-1] + 1, bool)
    many[which[differ]] = True
    hit = np.empty(len(order), bool)
    hit[order] = many[which]
    return member, place, hit


def _runs(hit: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return edge.reshape(-1, 2).tolist()


# -- the distributed refinement ------------------------------------------------------------------------------------


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, unit: type[Symbols] = Bytes, batch: int = BATCH) -> DataFrame:
    """(key, start, end) whose union are the symbols that repeated runs of ``length`` cover; texts has (key, text).

    With Bytes a run repeats if it starts at two places of the table; equal rows share a key and count as several places.
    With Words it repeats if it stands in texts of two keys.
    """
    spark = texts.sparkSession
    apart = unit is Words

    def first(batches):
        for keys, datas in _gathered(batches, length):
            s = unit(datas)
            at, lo, hi = anchors(s, length, gram)
            text = np.searchsorted(s.bounds, at, "right") - 1
            near = s.ids(at, at + gram)
            whole = s.ids(lo, hi + length) ^ _mix((at - lo).astype(np.uint64))
            cols = (near.view(np.int64), whole.view(np.int64), np.array(keys, np.int64)[text], at - s.bounds[text], at - lo, hi - lo)
            kinds = [np.int64] * 3 + [np.int32] + [np.int16 if length < 1 << 15 else np.int32] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(cols, kinds)], names=["gram", "extent", "key", "at", "back", "span"])

    small = "short" if length < 1 << 15 else "int"
    found = common.cut(common.map_arrow(texts, first, f"gram long, extent long, key long, at int, back {small}, span {small}"), "anchors")
    # buckets by gram, refined at once by the identifier of everything that the anchor's windows reach
    classes = common.cut(found.groupBy("gram", "extent").agg(F.count("*").alias("n"), F.min("key").alias("stands"), F.max("key").alias("high")), "classes")
    more = (F.min("stands") < F.max("high")) if apart else (F.sum("n") >= 2)
    buckets = classes.groupBy("gram").agg(more.alias("more"), F.count("*").alias("parts")).where("more").drop("more")
    settles = (F.col("stands") < F.col("high")) if apart else (F.col("n") >= 2)
    refined = classes.join(buckets, "gram").select("gram", "extent", settles.alias("settled"), "stands", "parts")
    told = found.join(refined, ["gram", "extent"])
    # a class that is not settled asks, window by window, and so does one member of each other class of its bucket
    asks = (F.col("parts") >= 2) & (~F.col("settled") | (F.col("key") == F.col("stands")))
    told = common.cut(told.select("gram", "key", "at", "back", "span", "settled", asks.alias("asks"), "parts").where("settled or asks"), "told")
    common.drop_cut(found)
    common.drop_cut(classes)
    common.release(spark)
    lo = F.col("at").cast("long") - F.col("back")
    settled = told.where("settled").select("key", lo.alias("start"), (lo + F.col("span") + length).alias("end")).distinct()

    wanted = told.where("asks").groupBy("key").agg(F.collect_set(F.struct("gram", "at", "back", "span", "parts", "settled")).alias("asked"))
    wanted = common.cut(wanted, "wanted")
    places = common.share(spark, common.bitmap(wanted.select("key")))

    def asked_only(batches):
        for b in batches:
            yield b.filter(pa.array(common.in_bitmap(places.value, b.column(0).to_numpy(zero_copy_only=False))))

    own = common.map_arrow(texts, asked_only, "key long, text string").join(wanted, "key").select("key", "text", "asked")
    names = ["gram", "shard", "key", "at", "back", "span", "settled", "symbols"]

    def reaches(batches):
        for b in common.slices(batches, 200):
            out: list[list] = [[] for _ in names]
            for key, data, asked in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                symbols = np.frombuffer(data, np.uint8) if unit is Bytes else unit([data]).symbols
                for a in asked:
                    s = a["at"] - a["back"]
                    shards = -(-a["parts"] // group)
                    row = (a["gram"], (key ^ a["at"]) % shards if shards > 1 else -1, key, a["at"], a["back"], a["span"], a["settled"], symbols[s : s + a["span"] + length].tobytes())
                    for c, v in zip(out, row):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    rows = common.map_arrow(own, reaches, "gram long, shard int, key long, at int, back int, span int, settled boolean, symbols binary")
    dealt = rows.repartition("gram", "shard").sortWithinPartitions("gram", "shard")

    def refine(batches):
        now, held = None, []
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(len(names)))):
                if row[:2] != now:
                    if len(held) >= batch:
                        yield judged(held)
                        held = []
                    now = row[:2]
                held.append(row)
        if held:
            yield judged(held)

    def judged(held):
        """Repeated windows as runs; in a bucket of several shards also the others, and one of each repeated identifier."""
        grams, shards, keys, at, back, span, done = (np.array(c) for c in list(zip(*held))[:7])
        parts = [np.frombuffer(r[7], unit.kind) for r in held]
        n, most = len(held), length - gram
        bucket = np.cumsum(np.concatenate(([False], (grams[1:] != grams[:-1]) | (shards[1:] != shards[:-1]))))
        owner = np.arange(n)
        if apart:  # one that stands for several keys differs from any other
            owner = np.where(done, n + owner, np.unique(keys, return_inverse=True)[1])
        member, place, hit = repeated_windows(bucket, owner, back, span, parts, length, gram)
        ends = np.cumsum(span + 1)
        edge = np.zeros(len(hit) + 1, np.int8)  # runs of hits, none across members
        edge[:-1] = hit
        begins = hit.copy()
        begins[1:] &= ~hit[:-1] | (member[1:] != member[:-1])
        stops = hit & ((edge[1:] == 0) | np.isin(np.arange(1, len(hit) + 1), ends))
        i = member[begins]
        start = at[i] - most + place[begins]
        end = at[i] - most + place[stops] + length
        none = np.zeros(0, np.int64)
        open_rows, twice = [[none] * 4], [np.zeros((2, 0), np.int64)]
        for j in np.flatnonzero(shards >= 0).tolist():
            ids = unit.of(parts[j]).all_ids(length, 0, int(span[j]) + 1).view(np.int64)
            left = ~hit[ends[j] - span[j] - 1 : ends[j]]
            if done[j] and apart:
                left[:] = False
            begin = at[j] - back[j] + np.flatnonzero(left)
            open_rows.append([np.full(len(begin), grams[j]), np.full(len(begin), keys[j]), begin, ids[left]])
            twice.append(np.stack((np.full(len(ids) - len(begin), grams[j]), ids[~left])))
        g, k, begin, ids = (np.concatenate(c) for c in zip(*open_rows))
        again = np.unique(np.concatenate(twice, axis=1), axis=1)
        a, b, c = len(i), len(g), again.shape[1]
        cols = [np.concatenate(x) for x in ((grams[i], g, again[0]), (keys[i], k, np.zeros(c, np.int64)), (start, begin, np.zeros(c, np.int64)), (end, begin + length, np.zeros(c, np.int64)), (np.zeros(a, np.int64), ids, again[1]))]
        at_row = np.arange(a + b + c)
        made = [pa.array(x, mask=m) for x, m in zip(cols, (None, at_row >= a + b, None, None, at_row < a))]
        return pa.RecordBatch.from_arrays(made, names=["gram", "key", "start", "end", "open"])

    judged_rows = common.cut(common.map_arrow(dealt, refine, "gram long, key long, start long, end long, open long"), "judged")
    common.drop_cut(wanted)
    common.release(spark)
    # of the windows that shards left open, those without a key were repeated in their shard
    open_ = judged_rows.where("open is not null")
    several = (F.min("key") < F.max("key")) if apart else (F.count("*") >= 2)
    twice = open_.groupBy("gram", "open").agg((F.coalesce(several, F.lit(False)) | (F.count("key") < F.count("*"))).alias("twice")).where("twice").select("gram", "open")
    late = open_.where("key is not null").join(twice, ["gram", "open"], "left_semi").select("key", "start", "end")
    return settled.unionByName(judged_rows.where("open is null").select("key", "start", "end")).unionByName(late)


def _gathered(batches, least: int, most: int = 1 << 22):
    """(keys, texts as bytes) of about ``most`` bytes at a time, without texts shorter than ``least``."""
    keys, datas, size = [], [], 0
    for b in batches:
        for key, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
            data = t.as_py()
            if data is not None and len(data) >= least:
                keys.append(key)
                datas.append(data)
                size += len(data)
                if size >= most:
                    yield keys, datas
                    keys, datas, size = [], [], 0
    if keys:
        yield keys, datas


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _by_key(spans: DataFrame, name: str) -> DataFrame:
    return common.cut(spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias(name)), name)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, keep_text: bool = False, passage: int = PASSAGE, passage_gram: int = PASSAGE_GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words of every row (and kept, the remaining bytes, if asked for).

    Bytes covered by strings of ``length`` bytes that start at two places go. ``n_shared_words`` counts the words covered by
    passages of ``passage`` words that also stand in a row with another doc_id or text; nothing is removed for them.

    A null text has no bytes. Texts shorter than ``length`` lose nothing. Repeated rows are repeats of each other, but
    share no words with themselves. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.lit(1), "doc_id", "text")
    texts = docs.select(key.alias("key"), "text")
    by_key = _by_key(repeated_spans(texts, length, gram, group), "spans")
    common.release(spark)
    shared = _by_key(repeated_spans(texts, passage, passage_gram, group, Words), "shared")
    common.release(spark)
    places = common.share(spark, common.bitmap(by_key.select("key")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    extra = ", kept binary" if keep_text else ""

    def route(batches):
        for b in common.slices(batches):
            size, sha, text = [], [], []
            maybe = common.in_bitmap(places.value, b.column(0).to_numpy(zero_copy_only=False))
            for data, m in zip(b.column(2).cast(pa.binary()).to_pylist(), maybe.tolist()):
                data = data or b""
                size.append(len(data))
                sha.append(hashlib.sha256(data).hexdigest())
                text.append(data if m or keep_text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.binary())], names=["key", "doc_id", "n_bytes", "sha", "data"])

    routed = common.map_arrow(docs.select(key.alias("key"), "doc_id", "text"), route, f"key long, doc_id {kind}, n_bytes long, sha string, data binary")
    met = routed.join(by_key.join(shared, "key", "full"), "key", "left").select("doc_id", "n_bytes", "sha", "data", "spans", "shared")

    def remove(batches):
        for b in common.slices(batches):
            gone, n, sha, kept, words = [], [], [], [], []
            for old, data, found, passages in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5))):
                runs = merge([(x["start"], x["end"]) for x in found]) if found else []
                gone.append(sum(e - s for s, e in runs))
                n.append(len(runs))
                words.append(sum(e - s for s, e in merge([(x["start"], x["end"]) for x in passages])) if passages else 0)
                if runs:
                    edges = [0, *(x for r in runs for x in r), len(data)]
                    data = b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2]))
                    old = hashlib.sha256(data).hexdigest()
                sha.append(old)
                kept.append(data)
            cols = [b.column(0), b.column(1), pa.array(gone, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(words, pa.int64())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * keep_text, names=names + ["kept"] * keep_text)

    return common.map_arrow(met, remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long{extra}")

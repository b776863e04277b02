"""Best-fit packing of documents into sequences, with bin counts certified by dual-feasible lower bounds.

Documents become pieces in one pass (only these short rows are ever shuffled, never texts or ids). Full pieces are
sequences of their own. The others are dealt round-robin into partitions of about ``items`` pieces, so neither a hot
source nor repeated rows can fill one; each partition packs its pieces by best-fit decreasing and compares its bins with
its own lower bound. A certified partition keeps its bins, but for its emptiest one. Partitions with a gap keep only
their full bins; the rest of their pieces, and the emptiest bins of all, are exchanged - dealt anew together - and packed
again. Rounds end when the total meets the lower bound of the whole table, or when an exchange saves nothing.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.llm import common
from vecgrove.llm.tokens import Encoder

CAPACITY = 2048
END = 0
ITEMS = 60_000
ROUNDS = 4


# -- pieces --------------------------------------------------------------------------------------------------------


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of n ids: all full but the first, which may be shorter."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece. A null or empty text has one piece: the end id."""
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def run(batches):
        encoder = Encoder.at(path)
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(b.column(1)):
                text = text.as_py()
                ids = np.append(encoder.ids(text) if text else np.zeros(0, np.uint32), np.uint32(end)).astype("<u4")
                s = 0
                for k, n in enumerate(cut_lengths(len(ids), capacity)):
                    at.append(row)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
                    s += n
            yield pa.RecordBatch.from_pydict(
                {"doc_id": b.column(0).take(pa.array(at, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            )

    return common.map_arrow(source, run, schema)


# -- one partition -------------------------------------------------------------------------------------------------


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """The bin of each item and the number of bins. Each item goes into the fullest bin that still holds it."""
    where = np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room r
    n = 0
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, bin_ = capacity, n
            n += 1
        where[i] = bin_
        left = room - size
        if left:
            by_room[left].append(bin_)
            rooms |= 1 << left
    return where, n


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs; ``counts[n]`` items have length n. The better of two families of dual-feasible functions."""
    sizes = np.arange(capacity + 1)
    total = int((counts * sizes).sum())
    best = -(-total // capacity)
    # threshold t <= capacity/2: items over capacity - t count as full, items under t as nothing
    items = np.concatenate((np.cumsum(counts[::-1])[::-1], [0]))  # items[n]: of length n and more
    mass = np.concatenate((np.cumsum((counts * sizes)[::-1])[::-1], [0]))
    t = np.arange(1, capacity // 2 + 1)
    large = items[capacity - t + 1]
    best = max(best, int((-(-(large * capacity + mass[t] - mass[capacity - t + 1]) // capacity)).max()))
    # steps of 1/(k+1): rounding down, but for exact multiples
    for k in range(1, 40):
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        value = np.where(exact, sizes * k, scaled // capacity * capacity)  # over k * capacity
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


# -- all partitions ------------------------------------------------------------------------------------------------

_EXTRA = "sequence_id long, offset long, fill long, bins long, bound long, last boolean, part long"


def _pack(open_: DataFrame, parts: int, round_: int, capacity: int) -> DataFrame:
    """``open_`` dealt into ``parts`` partitions, each packed alone."""
    names = open_.columns
    at = names.index("length")
    from pyspark import TaskContext

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        lengths = t.column(at).to_numpy()
        where, bins = best_fit_decreasing(lengths, capacity)
        part = TaskContext.get().partitionId()
        order = np.argsort(where, kind="stable")
        size = lengths[order]
        fill = np.bincount(where, weights=lengths, minlength=bins).astype(np.int64)
        starts = np.cumsum(fill) - fill
        offset = np.cumsum(size) - size - starts[where[order]]
        t = t.take(pa.array(order))
        n = t.num_rows
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        extra = {
            "sequence_id": (round_ << 54) + (part << 30) + where[order] + 1, "offset": offset, "fill": fill[where[order]],
            "bins": np.full(n, bins), "bound": np.full(n, bound), "last": where[order] == int(fill.argmin()), "part": np.full(n, part),
        }
        for k, v in extra.items():
            t = t.append_column(k, pa.array(v))
        yield from t.to_batches(max_chunksize=20_000)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in open_.schema) + ", " + _EXTRA
    return common.map_arrow(open_.repartition(parts), run, schema)


def _bins(df: DataFrame) -> int:
    return df.where("offset = 0").count()


def pack(rows: DataFrame, capacity: int = CAPACITY, items: int = ITEMS, rounds: int = ROUNDS) -> tuple[DataFrame, dict]:
    """``rows`` (with length, 1 to capacity) with sequence_id and offset; and the figures of the packing.

    Every row is placed exactly once. Ties and repeated rows are placed like any others; an empty table gives an empty
    result. Extra columns are carried along.
    """
    names = rows.columns
    full = rows.where(F.col("length") == capacity)
    n_full = full.count()
    settled = [full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})]
    open_ = rows.where(F.col("length") < capacity)
    histogram = open_.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["count"]
    bound = lower_bound(counts, capacity)
    n, done = int(counts.sum()), 0
    figures = {"bound": n_full + bound, "rounds": 0, "sequences": n_full}
    now = None
    for k in range(rounds):
        if not n:
            break
        tried = common.cut(_pack(open_, max(1, -(-n // items)), k + 1, capacity), "packed")
        bins = _bins(tried)
        if now is not None and bins >= open_bins:
            break  # the exchange saves nothing: the former bins stay
        if now is not None:
            settled.append(closed)
            done += closed_bins
        now, figures["rounds"] = tried, k + 1
        figures["sequences"] = n_full + done + bins
        if done + bins <= bound or k + 1 == rounds:
            break
        reopen = F.col("last") | ((F.col("bins") > F.col("bound")) & (F.col("fill") < capacity))
        if tried.agg(F.countDistinct("part")).first()[0] < 2:
            break
        closed, opened = tried.where(~reopen), tried.where(reopen)
        closed_bins = _bins(closed)
        open_bins = bins - closed_bins
        open_ = opened.select(*names)
        n = open_.count()
    if now is not None:
        settled.append(now)
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s.select(*names, "sequence_id", "offset"))
    return out, figures


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, items: int = ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    saved = common.cut(pieces(docs, path, capacity), "pieces")
    return pack(saved, capacity, items, rounds)[0]

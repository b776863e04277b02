"""Toxicity scores from FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the slots of its words and their stems, of neighbouring pairs and of pairs one word apart, each
counted once. The
model is fitted to a sample of labelled rows of at most about ``sample`` rows, half for each class where there are enough
(a documented bound: a rule on hashes of ids picks them, so it behaves alike at every size). One learner for each
``SHARD_ROWS`` rows takes its part of the sample, with per-coordinate rates and L1; the mean of their sparse weights - at most 2^bits numbers, a
few thousand in practice - is broadcast, and scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecgrove.llm import common

BITS = 20
SAMPLE = 16_000
SHARD_ROWS = 4_000
EPOCHS = 4
#: Words also count as their first so many bytes, so that inflected and compound forms share evidence.
STEMS = (4, 5, 6)
ALPHA, BETA, L2 = 0.3, 1.0, 0.1
#: L1 in proportion to a learner's rows, between these bounds: evidence from a few rows alone never gives a weight.
L1_PER_ROW, L1_LEAST, L1_MOST = 0.002, 1.0, 8.0
FOLDS = 5

#: Bytes to words: A-Z lowered, other ASCII that is neither digit nor letter becomes a space, the rest stays.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Slots of a text's words, pairs and skip pairs, with repeats; none for a text without words."""
    ws = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    if not ws:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(zlib.crc32, ws), np.uint64, len(ws)) * _A
    parts = [h, h[:-1] * _B + h[1:] * _C, h[:-2] * _C + h[2:] * _A + _B]
    for k in STEMS:
        stems = [w[:k] for w in ws if len(w) > k]
        parts.append(np.fromiter(map(zlib.crc32, stems), np.uint64, len(stems)) * _C + np.uint64(k))
    return (np.concatenate(parts) * _B >> np.uint64(64 - bits)).astype(np.int64)


def held_out(doc_id):
    """Rows whose label is never learnt: crc32 of the id as text divides by FOLDS. A null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % FOLDS == 0


class Learner:
    """FTRL-proximal: per-coordinate state z and n, weights read off lazily."""

    def __init__(self, bits: int = BITS, l1: float = L1_MOST):
        self.l1 = l1
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = p - label
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - rate * w
        self.n[at] += g * g


def _sample(labels: DataFrame, target: str, size: int) -> tuple[DataFrame, int]:
    """(doc_id, label), and about how many: learnable ids, one row each, about ``size`` / 2 of each class at most. Split labels go to the majority."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg(F.col(target).cast("double")) >= 0.5).cast("int").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    space = 1 << 30
    limit = F.when(F.col("label") == 1, F.lit(int(space * min(1.0, size / 2 / max(1, totals.get(1, 0)))))).otherwise(
        F.lit(int(space * min(1.0, size / 2 / max(1, totals.get(0, 0))))))
    rows = int(sum(min(n, size / 2) for n in totals.values()))
    return known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(space)) < limit), rows


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = SAMPLE, bits: int = BITS) -> dict[int, float]:
    """Sparse weights by slot; slot 2^bits is the bias. Empty if no labelled row has a document.

    Labels with a null doc_id or target, and held-out ones, are never read; of several labels of one doc_id the majority
    counts, a tie as 1; of several texts of one doc_id the one with the smallest hash. Null and empty texts teach the bias
    alone. A learner's rows are distinct slots of whole texts, so its memory is bounded by ``SHARD_ROWS`` times the longest
    text's different words, not by the corpus. Other columns of either table are ignored.
    """
    chosen, n = _sample(labels, target, sample)
    shards = max(1, round(n / SHARD_ROWS))
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about ``sample`` short rows
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    picked = picked.withColumn("r", F.row_number().over(one)).where("r = 1").select("doc_id", "text", "label")
    coded = picked.select((F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(shards))).cast("int").alias("shard"), F.xxhash64("doc_id", F.lit(13)).alias("turn"), "label", "text")

    def code(batches):
        for b in batches:
            slots = [np.unique(features(t.as_py(), bits)) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(slots, pa.list_(pa.int32()))], names=["shard", "turn", "label", "slots"])

    rows = common.map_arrow(coded, code, "shard int, turn long, label int, slots array<int>")
    dealt = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "turn")

    def learn(batches):
        rows: dict[int, list] = {}
        for b in batches:
            shard, label = b.column(0).to_pylist(), b.column(2).to_pylist()
            for i, s in enumerate(b.column(3)):
                rows.setdefault(shard[i], []).append((np.append(s.values.to_numpy(zero_copy_only=False).astype(np.int64), 1 << bits), label[i]))
        for part in rows.values():
            model = Learner(bits, min(L1_MOST, max(L1_LEAST, L1_PER_ROW * len(part))))
            for _ in range(EPOCHS):
                for at, y in part:
                    model.learn(at, y)
            every = np.arange((1 << bits) + 1)
            w = model.weights(every)
            some = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(w[some]), pa.array(np.full(len(some), len(part)))], names=["slot", "w", "n"])

    parts = common.map_arrow(dealt, learn, "slot long, w double, n long")
    total = parts.groupBy("slot").agg(F.sum("w").alias("w")).collect()  # at most 2^bits + 1 rows
    return {r["slot"]: r["w"] / shards for r in total}


def _dense(weights: dict[int, float], bits: int) -> np.ndarray:
    w = np.zeros((1 << bits) + 1)
    for k, v in weights.items():
        w[k] = v
    return w


def _scores(texts, w: np.ndarray, bits: int) -> list[float]:
    out = []
    for t in texts:
        at = features(t.as_py(), bits)
        at = np.unique(at[w[at] != 0])
        out.append(float(1 / (1 + np.exp(-np.clip(w[at].sum() + w[1 << bits], -30, 30)))))
    return out


def score(docs: DataFrame, weights: dict[int, float], bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Only the text is scored, whole; null and empty texts get the score of no features. Repeated rows score alike; an
    empty table gives an empty result; without any labelled row every score is 0.5. Other columns are ignored.
    """
    shared = common.share(docs.sparkSession, weights)
    source = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        w = _dense(shared.value, bits)
        for b in batches:
            s = _scores(b.column(2), w, bits)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return common.map_arrow(source, run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def remove_toxic(docs: DataFrame, weights: dict[int, float], limit: float = 0.5, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` with scores below ``limit``, all columns kept, whatever their names.

    Null and empty texts have the score of no features; repeated rows share a decision; an empty table stays empty.
    """
    shared = common.share(docs.sparkSession, weights)
    at = docs.columns.index("text")

    def run(batches):
        w = _dense(shared.value, bits)
        for b in batches:
            yield b.filter(pa.array([x < limit for x in _scores(b.column(at), w, bits)], pa.bool_()))

    return common.map_arrow(docs, run, docs.schema)

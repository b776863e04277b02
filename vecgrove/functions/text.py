"""Documents as sparse vectors of word n-gram counts."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.shipping import ship

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ngrams(docs: DataFrame, n: int = 3, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, dim): every run of n words [a-z0-9]+ (A-Z lowered) of each document, as often as it occurs."""
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(F.col(id_).alias("id"), F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)).alias("w")).where(F.size("w") >= n)
    joined = F.slice("w", F.lit(1), F.size("w") - (n - 1))
    for k in range(1, n):  # each gram grows by the word k places on: no array is built for a single gram
        joined = F.zip_with(joined, F.slice("w", F.lit(k + 1), F.size("w") - (n - 1)), lambda a, b: F.concat(a, F.lit(" "), b))
    return words.select("id", F.explode(joined).alias("dim"))


def ngram_counts(docs: DataFrame, n: int = 3, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, dim, val): how often each run of n words occurs in each document."""
    return ngrams(docs, n, id_, text).groupBy("id", "dim").agg(F.count("*").alias("val"))


def gram_maps(docs: DataFrame, n: int = 3, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, m): the same counts as one map from n-grams to counts for each id that has any. Texts move once, so that rows
    with one id meet; n-grams are counted where their text is and never move."""
    ship(docs.sparkSession)

    def counted(batches):
        rows = ((i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for i, own in itertools.groupby(rows, lambda r: r[0]):
            m: Counter = Counter()
            for _, t in own:
                w = re.findall("[a-z0-9]+", t.translate(_LOWER))
                m.update(map(" ".join, zip(*(w[k:] for k in range(n)))))
            if m:
                yield i, m

    def run(batches):
        made, kind = counted(batches), pa.map_(pa.string(), pa.int64())
        while held := list(itertools.islice(made, 256)):
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), pa.array([list(m.items()) for _, m in held], kind)], names=["id", "m"])

    met = docs.where(F.col(text).isNotNull()).select(F.col(id_).alias("id"), F.col(text).alias("text"))
    return met.repartition("id").sortWithinPartitions("id").mapInArrow(run, "id long, m map<string, long>")


def _numbered(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram): every run of n words of each text, grams as numbers that are equal for equal grams."""
    words: dict[bytes, int] = {}
    of, grams = [], []
    coded = [np.array([words.setdefault(w, len(words)) for w in re.findall(rb"[a-z0-9]+", t.encode("utf-8", "surrogatepass").lower())], np.int64) for t in texts]
    for k, c in enumerate(coded):
        if len(c) >= n:
            of.append(np.full(len(c) - n + 1, k))
            grams.append(np.lib.stride_tricks.sliding_window_view(c, n))
    if not of:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs = np.concatenate(grams)
    gram = runs[:, 0]
    for j in range(1, n):  # renumbered at each step, so a number stays below grams times words
        gram = np.unique(gram * len(words) + runs[:, j], return_inverse=True)[1]
    return np.concatenate(of), gram


def tree_totals(docs: DataFrame, levels: int, deepest: int | None = None, n: int = 3, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(tree, level, node, dims, total, squares) of the sums of n-gram counts in every node of ``pools.tree_sums``, down to
    level ``deepest``. The texts of a tree meet in one task and their grams never move: a tree has at most 2^levels rows."""
    ship(docs.sparkSession)
    size, most = 1 << levels, levels if deepest is None else deepest
    names = ["tree", "level", "node", "dims", "total", "squares"]

    def totals(tree, leaves, texts):
        of, gram = _numbered(texts, n)
        leaf = np.array(leaves, np.int64)[of]
        kinds = int(gram.max()) + 1 if len(gram) else 1
        count = np.ones(len(gram))
        for level in range(levels, -1, -1):
            pair, inverse = np.unique((leaf >> (levels - level)) * kinds + gram, return_inverse=True)
            held = np.bincount(inverse, weights=count, minlength=len(pair))
            if level == levels:  # the levels above read the counts of the leaves
                leaf, gram, count = pair // kinds, pair % kinds, held
            if level > most:
                continue
            node = pair // kinds
            for k in np.unique(node).tolist():
                own = held[node == k]
                yield tree, level, (1 << level) + k, len(own), int(own.sum()), int((own * own).sum())

    def run(batches):
        rows = ((i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        made = (r for tree, own in itertools.groupby(rows, lambda r: r[0] // size) for r in totals(tree, *zip(*((i % size, t) for i, t in own))))
        while held := list(itertools.islice(made, 1 << 14)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=names)

    met = docs.where(F.col(text).isNotNull()).select(F.col(id_).alias("id"), F.col(text).alias("text"))
    return met.repartition(F.floor(F.col("id") / size)).sortWithinPartitions("id").mapInArrow(run, ", ".join(f"{c} long" for c in names))

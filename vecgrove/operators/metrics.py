"""Evaluation: recall and precision of search results, score histograms, co-occurrence, match rates, quality reports.

Found and true results are (qid, id[, score]). Ratios come with their counts, so nothing hides behind rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.when(b == 0, F.lit(1.0)).otherwise(a / b), 6)


def verify_knn(found: DataFrame, truth: DataFrame, k: int, tolerance: int = 0) -> DataFrame:
    """(qid, n_good, recall): found rows whose score reaches the k-th true one, less the tolerance, over k, capped at 1."""
    kth = truth.groupBy("qid").agg(F.min("score").alias("kth"), F.count("*").alias("n_true"))
    good = found.join(kth, "qid").where(F.col("score") >= F.col("kth") - tolerance).groupBy("qid").agg(F.count("*").alias("n"))
    out = kth.join(good, "qid", "left").select("qid", F.least(F.coalesce("n", F.lit(0)), F.least("n_true", F.lit(k))).alias("n_good"), F.least("n_true", F.lit(k)).cast("long").alias("n_true"))
    return out.select("qid", "n_good", "n_true", _ratio(F.col("n_good"), F.col("n_true")).alias("recall"))


def verify_sets(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, n_both, n_found, n_true, precision, recall) by set comparison; an empty side counts as 1."""
    f = found.select("qid", "id", F.lit(1).alias("f")).distinct()
    t = truth.select("qid", "id", F.lit(1).alias("t")).distinct()
    n = f.join(t, ["qid", "id"], "full").groupBy("qid").agg(F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("n_both"), F.count("f").alias("n_found"), F.count("t").alias("n_true"))
    return n.select("*", _ratio(F.col("n_both"), F.col("n_found")).alias("precision"), _ratio(F.col("n_both"), F.col("n_true")).alias("recall"))


def recall_by_score(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, n_match, n_true, recall): scores of both sides compared as multisets."""
    f = found.groupBy("qid", "score").agg(F.count("*").alias("a"))
    t = truth.groupBy("qid", "score").agg(F.count("*").alias("b"))
    both = t.join(f, ["qid", "score"], "left").groupBy("qid").agg(F.sum(F.least("b", F.coalesce("a", F.lit(0)))).alias("n_match"), F.sum("b").alias("n_true"))
    return both.select("*", _ratio(F.col("n_match"), F.col("n_true")).alias("recall"))


def match_rate(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n_queries, n_equal, rate): queries for which two indexes return the same ids, or ids with the same scores."""
    side = lambda df, c: df.groupBy("qid").agg(F.sort_array(F.collect_list("id")).alias(c), F.sort_array(F.collect_list("score")).alias(c + "s"))
    m = side(a, "x").join(side(b, "y"), "qid", "full")
    same = F.coalesce((F.col("x") == F.col("y")) | (F.col("xs") == F.col("ys")), F.lit(False))
    n = m.agg(F.count("*").alias("n_queries"), F.count_if(same).alias("n_equal"))
    return n.select("*", _ratio(F.col("n_equal"), F.col("n_queries")).alias("rate"))


def histogram(scored: DataFrame, one: int, bins: int = 1000) -> DataFrame:
    """(bin, n) of scores between 0 and ``one``; the top bin takes what lies above."""
    at = F.least(F.lit(bins - 1), F.floor(F.col("score") * bins / one)).cast("long")
    return scored.where("score >= 0").groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def cooccurrence(x: DataFrame) -> DataFrame:
    """(d1, d2, weight): sum of products over rows for each pair of distinct dimensions of a row, in both orders."""
    other = x.select("id", F.col("dim").alias("d2"), F.col("val").alias("v2"))
    return x.join(other, "id").where("dim <> d2").groupBy(F.col("dim").alias("d1"), "d2").agg(F.sum(F.col("val") * F.col("v2")).alias("weight"))


def quality(found: DataFrame, hash_truth: DataFrame, truth: DataFrame) -> DataFrame:
    """(comparison, precision, recall, f1) in the mean over queries: whole pipeline, decoding alone, hashing alone."""
    out = None
    for name, a, b in (("end_to_end", found, truth), ("decoder_vs_hash", found, hash_truth), ("hash_vs_true", hash_truth, truth)):
        m = verify_sets(a, b).agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"))
        row = m.select(F.lit(name).alias("comparison"), F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0), 6).alias("f1"))
        out = row if out is None else out.unionByName(row)
    return out


def verify_overlap(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, n_both, recall, precision): the share of k that found and true top-k have in common serves as both."""
    both = truth.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    n = both.groupBy("qid").agg(F.count("hit").alias("n_both"))
    share = F.round(F.col("n_both") / k, 6)
    return n.select("qid", "n_both", share.alias("recall"), share.alias("precision"))


def run_matrix(variants: dict[int, DataFrame], truth: DataFrame, name: str) -> DataFrame:
    """(name, n_true, n_both) of each variant's found (qid, id) against the truth: a sweep of one parameter in one plan."""
    found = None
    for v, df in variants.items():
        row = df.select(F.lit(v).alias(name), "qid", "id", F.lit(1).alias("hit"))
        found = row if found is None else found.unionByName(row)
    asked = truth.select("qid", "id", F.explode(F.array(*map(F.lit, variants))).alias(name))
    met = asked.join(found, [name, "qid", "id"], "left")
    return met.groupBy(name).agg(F.count("*").alias("n_true"), F.count("hit").alias("n_both"))


def weighted_mean(rows: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    """Means over shards of unequal size."""
    return rows.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value), F.sum(weight).alias(weight))

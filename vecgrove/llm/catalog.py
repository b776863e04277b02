"""The registered queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from vecgrove.llm import ann, boilerplate, decontaminate, packing, pii, ring, secrets, simhash, suffix, toxicity
from vecgrove.llm.common import table


def op10_suffix_automaton(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def vocabulary() -> str:
    """The public vocabulary that documents are measured in; it stays outside the repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_certified_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op8_vantage_point_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_bounded_load_ring(spark, sf_dir):
    return ring.assign(table(spark, sf_dir, "documents"))


def op2_markov_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_weakly_supervised_pii(spark, sf_dir):
    return pii.spans(table(spark, sf_dir, "documents"))


def op7_ftrl_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels))


def op1_host_suffix_array(spark, sf_dir):
    return boilerplate.main_text(table(spark, sf_dir, "pages"))


def op6_bucket_pointer_refinement(spark, sf_dir):
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op4_adaptive_dimension_scan(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


QUERIES = {
    "op4_adaptive_dimension_scan": op4_adaptive_dimension_scan,
    "op6_bucket_pointer_refinement": op6_bucket_pointer_refinement,
    "op1_host_suffix_array": op1_host_suffix_array,
    "op5_weakly_supervised_pii": op5_weakly_supervised_pii,
    "op7_ftrl_toxicity": op7_ftrl_toxicity,
    "op2_markov_secrets": op2_markov_secrets,
    "op9_bounded_load_ring": op9_bounded_load_ring,
    "op3_certified_packing": op3_certified_packing,
    "op8_vantage_point_simhash": op8_vantage_point_simhash,
    "op10_suffix_automaton": op10_suffix_automaton,
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op10_suffix_automaton": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
w AS (
  SELECT DISTINCT item, least(len(ws), 8) AS n, array_to_string(ws[k:k + least(len(ws), 8) - 1], ' ') AS g
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 7, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
g AS (
  SELECT rid, k, n, array_to_string(ws[k:k + n - 1], ' ') AS g
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)),
m AS (SELECT g.rid, g.k, g.n, w.item FROM g JOIN w ON g.g = w.g AND g.n = w.n),
p AS (SELECT DISTINCT rid, unnest(range(k, k + n)) AS pos FROM m),
h AS (SELECT rid, count(*) AS n_hit FROM p GROUP BY rid),
r AS (SELECT rid, pos, pos - row_number() OVER (PARTITION BY rid ORDER BY pos) AS island FROM p),
l AS (SELECT rid, max(c) AS longest_hit FROM (SELECT rid, island, count(*) AS c FROM r GROUP BY rid, island) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_items, 0) >= 2 AS contaminated, CAST(coalesce(longest_hit, 0) AS BIGINT) AS longest_hit
FROM d LEFT JOIN h USING (rid) LEFT JOIN l USING (rid) LEFT JOIN t USING (rid)""",
}

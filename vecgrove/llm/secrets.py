"""Secret scans: fixed patterns, and character Markov models for strings that look random.

Two first-order Markov chains over characters are trained from labelled samples, one from random strings (credentials),
one from ordinary identifiers. A candidate - a long run of letters, digits and ``+/_=-`` - is a secret if its mean
log-likelihood ratio per character exceeds ``min_ratio``. All of it is column expressions: the models are trained by one
small aggregation over the sample, whose result, at most 68 x 68 numbers, becomes a literal in the scan, and the scan is
one projection over the documents with no shuffle and no Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrove.llm.spans import matches, rendered

#: The base patterns, and the lengths below which a match does not count.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGN = 6
KINDS = ("assign", "access", "hex", "markov")

#: Candidates for the models.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_RATIO = 0.8
SAMPLE = 4000

#: Words that the sample's ordinary identifiers are made of: usual in code, and frequent in four languages' prose.
_PARTS = (
    "get set value index count user name file path data list item node tree query result table column row batch score vector "
    "graph edge page token label model train test split merge sort filter window shard bucket cache buffer stream read write "
    "open close start stop price total content header request response server client session config option default format "
    "string number integer message error warning handler service manager factory builder parser worker thread process "
    "the and that with from have this they which would there about could other after first people because through between "
    "never should house world school family government important different possible question development international "
    "und nicht eine werden haben zwischen gesellschaft entwicklung wirtschaft regierung geschichte freiheit arbeiten schreiben "
    "les des pour dans avec sont cette leurs gouvernement entreprise question histoire politique developpement maintenant "
    "que para como pero esta entre cuando gobierno historia trabajo desarrollo informacion universidad administracion"
).split()


def sample(spark: SparkSession, n: int = SAMPLE) -> DataFrame:
    """A labelled sample (value, secret) of 2 n rows, made by rule: digests in several alphabets, and joined words."""
    i = F.col("id")
    digest = F.sha2(F.concat(F.lit("sample "), i.cast("string")), 256)
    random = F.when(i % 3 == 0, F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")).when(i % 3 == 1, F.substring(digest, 1, 40)).otherwise(
        F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(digest, 512))), "[+/=]", ""), 1, 32)))
    words = F.array(*map(F.lit, _PARTS))
    pick = [F.get(words, F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(_PARTS))).cast("int")) for k in range(5)]
    plain = (
        F.when(i % 60 == 0, F.repeat(F.substring(F.lit("-_=+/"), (F.floor(i / 60) % 5 + 1).cast("int"), F.lit(1)), 40))  # ruled lines
        .when(i % 6 == 0, F.concat_ws("_", *pick))
        .when(i % 6 == 1, F.concat(pick[0], *map(F.initcap, pick[1:])))
        .when(i % 6 == 2, F.upper(F.concat_ws("_", *pick[:4])))
        .when(i % 6 == 3, F.concat_ws("-", *pick[:4], (i % 100).cast("string")))
        .when(i % 6 == 4, F.concat(F.lit("/"), F.concat_ws("/", *pick[:4])))
        .otherwise(F.concat(*pick))
    )
    rows = spark.range(n)
    return rows.select(random.alias("value"), F.lit(True).alias("secret")).unionByName(rows.select(plain.alias("value"), F.lit(False).alias("secret")))


def train(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) for each pair of characters of ALPHABET, row by row.

    ``samples`` (value, secret) may have any size: pairs are counted where they are, and at most two numbers for each
    pair of the alphabet come back. Characters outside the alphabet, null values and null labels are skipped.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda k: F.substring(F.col("value"), k, F.lit(2)))
    counted = samples.where(F.length("value") >= 2).select("secret", F.explode(pairs).alias("pair")).groupBy("pair").agg(
        F.count_if(F.col("secret")).alias("random"), F.count_if(~F.col("secret")).alias("plain"))
    counts = {r["pair"]: (r["random"], r["plain"]) for r in counted.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).collect()}
    n = len(ALPHABET)
    out = []
    for a in ALPHABET:
        row = [counts.get(a + b, (0, 0)) for b in ALPHABET]
        total = [sum(x[k] for x in row) for k in (0, 1)]
        out += [math.log((r + smooth) / (total[0] + smooth * n)) - math.log((p + smooth) / (total[1] + smooth * n)) for r, p in row]
    return out


def ratio(value: Column, weights: list[float]) -> Column:
    """Mean log-likelihood ratio per character pair of a string over ALPHABET."""
    table = F.from_json(F.lit("[" + ",".join(f"{w:.6f}" for w in weights) + "]"), "array<double>")
    n = len(ALPHABET)
    at = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    size = F.length(value)
    scores = F.zip_with(F.slice(at, F.lit(1), size - 1), F.slice(at, F.lit(2), size - 1), lambda a, b: F.get(table, a * n + b))
    return F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / (size - 1)


def scan(docs: DataFrame, weights: list[float] | None = None, min_ratio: float = MIN_RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov of every row.

    A null or empty text has no spans: counts 0 and the digest of the empty string. Ties cannot arise; repeated rows are
    scanned each; whole texts are read whatever their length. An empty table gives an empty result. Other columns are
    ignored.
    """
    weights = weights if weights is not None else train(sample(docs.sparkSession))
    text = F.coalesce("text", F.lit(""))

    def spans(kind: str, found: Column) -> Column:
        number = KINDS.index(kind)
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("number"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    body = F.col("text")
    assign = spans("assign", matches(body, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_ASSIGN))
    access = spans("access", matches(body, ACCESS))
    hexes = spans("hex", matches(body, HEX))
    markov = spans("markov", matches(body, CANDIDATE, lambda m: ratio(m, weights) > min_ratio))
    found = docs.select("doc_id", text.alias("text")).select("doc_id", assign.alias("a"), access.alias("k"), hexes.alias("h"), markov.alias("m"))
    base = F.concat("a", "k", "h")
    return found.select(
        "doc_id", F.size("a").cast("long").alias("n_assign"), F.size("k").cast("long").alias("n_access"), F.size("h").cast("long").alias("n_hex"),
        F.sha2(rendered(base), 256).alias("base_sha256"), rendered(F.concat(base, F.col("m"))).alias("spans"), F.size("m").cast("long").alias("n_markov"),
    )

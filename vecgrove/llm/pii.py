"""Personal data by weak supervision: patterns, gazetteers and contexts vote, EM weighs them, a classifier decides.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. Other candidates - numbers of many forms,
dates, spelled-out addresses, streets, titled names - are voted on by labelers that may abstain: how the string looks,
whether its check digits or fields hold, whether a gazetteer knows its words, what stands around it, how its digits mix. Expectation-maximisation over the counts of vote patterns (at most 3^labelers rows, counted
over all documents where they are) estimates each labeler's reliability with no labels; the posterior of each pattern is
then the soft label of a logistic regression over span features, again from counts. Candidates that it gives at least
``threshold`` become spans of kind "personal".

One pass over the texts finds base spans and candidates; it is written once, without the texts, so the second pass reads
only short rows. Nothing is shuffled but counts.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.llm import common

KINDS = ("email", "ip", "card", "phone", "personal")

#: The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]")

#: Gazetteers and contexts of the labelers.
TITLES = frozenset("mr mrs ms dr prof herr frau madame monsieur señor señora".split())
GIVEN = frozenset(
    "john jane mary james robert michael linda david maria anna peter paul hans pierre marie juan carlos ana william elizabeth richard susan "
    "joseph jessica thomas sarah charles karen daniel nancy matthew lisa anthony betty mark sandra steven ashley andrew emily george laura "
    "edward emma henry alice klaus jürgen wolfgang ursula monika sabine petra andrea stefan jens uwe heike jean michel philippe nathalie "
    "isabelle sylvie catherine françois jacques claire luc josé antonio manuel francisco carmen isabel pilar lucía javier miguel luis elena "
    "rosa pedro pablo sofia ahmed fatima ali omar wei li chen yuki hiroshi ivan olga dmitri natasha priya raj sanjay amit".split()
)
STREETS = frozenset("street st road rd avenue ave lane ln drive boulevard blvd square rue calle avenida plaza place weg platz strasse straße".split())
MAIL_WORDS = frozenset("mail email gmail example com org net".split())
CUES = frozenset(
    "phone tel telephone call fax mobile cell contact email mail ssn passport iban account born birthday birth address name card lives "
    "telefon handy konto geboren adresse téléphone compte né née teléfono cuenta nacido nacida dirección".split()
)
ANTI_CUES = frozenset("version license page chapter section figure table isbn line step copyright year release no order invoice serial doi build rev ticket seite kapitel página".split())

_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
_SPELLED = re.compile(r"[A-Za-z0-9._-]{2,40}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{2,40}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{2,20})+", re.I)
_NAMED = re.compile(r"(?<![^\W\d_])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.?\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?")
_NUMBER = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){8,18}(?![0-9])")
_DATE = re.compile(r"(?<![0-9./-])[0-9]{1,2}([./-])[0-9]{1,2}\1(?:19|20)[0-9]{2}(?![0-9])")
_STREET = re.compile(r"(?<!\d)\d{1,4}\x20(?:[A-Z][a-z]{1,20}|rue|calle)\x20[A-Z]?[a-z]{1,20}\b|\b[A-Z][a-zß]{2,20}(?:straße|strasse|weg|platz)\x20\d{1,4}\b")
_NEAR = 40
_WORD = re.compile(r"[^\W\d_]+")

LABELERS = ("form", "check", "gazetteer", "context", "mixture")
#: Candidate forms by number; those that need a digit, and those that a person's data takes as a rule.
SSN, LOCAL_PHONE, IBAN, SPELLED, NAMED, NUMBER, DATE, STREET = FORMS = range(8)
TYPICAL = (SSN, SPELLED)
FEATURES = len(FORMS) + 6


def luhn(digits: str) -> bool:
    d = [int(x) for x in reversed(digits)]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans, sorted."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGITS.search(text):
        out += _addresses(text)
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _addresses(text: str) -> list[tuple[int, int, int]]:
    """The ip spans: leftmost matches take four at a time of the numbers that single dots join, so no digit is read twice."""
    out = []
    for m in _CHAIN.finditer(text) if "." in text else ():
        numbers = m[0].split(".")
        at = m.start()
        for four in zip(*[iter(numbers)] * 4):
            end = at + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in four)):
                out.append((at, 1, end))
            at = end + 1
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, vote pattern, feature bits) of the strings that no base span overlaps."""
    found = []
    patterns = []
    if _DIGITS.search(text):
        patterns += [(SSN, _SSN), (LOCAL_PHONE, _LOCAL_PHONE), (IBAN, _IBAN), (NUMBER, _NUMBER), (DATE, _DATE), (STREET, _STREET)]
    low = text.lower()
    if "(at)" in low or "[at]" in low:
        patterns.append((SPELLED, _SPELLED))
    patterns.append((NAMED, _NAMED))
    starts = [b for b, _, _ in base]
    reach = list(itertools.accumulate((f for _, _, f in base), max))  # how far the base spans up to each go
    for form, p in patterns:
        for m in p.finditer(text):
            s, e = m.span()
            before = bisect.bisect_left(starts, e)
            if before and reach[before - 1] > s:
                continue
            found.append((s, form == NUMBER, e, *_judge(form, text, s, e)))
    found.sort()
    out = []
    for s, _, e, votes, bits in found:  # leftmost first, plain numbers last, no overlaps
        if not out or s >= out[-1][1]:
            out.append((s, e, votes, bits))
    return out


def _judge(form: int, text: str, s: int, e: int) -> tuple[int, int]:
    inside = [w.lower() for w in _WORD.findall(text[s:e])]
    before = [w.lower() for w in _WORD.findall(text[max(0, s - _NEAR) : s])][-4:]
    after = [w.lower() for w in _WORD.findall(text[e : e + _NEAR])][:4]
    cue, anti = bool(CUES & {*before, *after}), bool(ANTI_CUES & set(before))
    digits = "".join(c for c in text[s:e] if c.isdigit())
    votes = [
        1 if form in TYPICAL else -1 if form == NUMBER and len(digits) < 12 else 0,
        _checked(form, text[s:e], digits),
        1 if GIVEN & set(inside) or (form == SPELLED and MAIL_WORDS & set(inside)) or (form == STREET and _street(inside)) else -1 if form in (NAMED, STREET) else 0,
        1 if cue and not anti else -1 if anti else 0,
        0 if not digits else -1 if len(set(digits)) <= 2 else 1 if len(set(digits)) >= 5 else 0,
    ]
    pattern = 0
    for v in votes:
        pattern = pattern * 3 + v + 1
    more = (cue, anti, bool(GIVEN & set(inside)), bool(TITLES & set(inside)), len(set(digits)) >= 5, e - s > 20)
    return pattern, (1 << form) | sum(bit << len(FORMS) + k for k, bit in enumerate(more))


def _checked(form: int, value: str, digits: str) -> int:
    """Whether the fields or check digits of a string hold; forms without any abstain."""
    if form == IBAN:
        return 1 if _iban(value) else -1
    if form == SSN:
        return 1 if digits[:3] not in ("000", "666") and digits[0] != "9" else -1
    if form == LOCAL_PHONE:
        return 1 if digits[0] not in "01" else -1
    if form == NUMBER:
        return 1 if len(digits) >= 12 and luhn(digits) else -1
    if form == DATE:
        a, b = (int(x) for x in re.split("[./-]", value)[:2])
        return 1 if 1 <= min(a, b) <= 12 and 1 <= max(a, b) <= 31 else -1
    return 0


def _street(words: list[str]) -> bool:
    return any(w in STREETS or w.endswith(("straße", "strasse", "weg", "platz")) for w in words)


def _iban(value: str) -> bool:
    turned = "".join(str(int(c, 36)) for c in value[4:] + value[:4])
    return int(turned) % 97 == 1


def expectation_maximisation(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """P(personal) of each vote pattern, from the patterns' counts: one reliability per labeler and class, no labels."""
    if not counts:
        return {}
    k = len(LABELERS)
    patterns = sorted(counts)
    votes = np.array([[p // 3 ** (k - 1 - j) % 3 for j in range(k)] for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    # a start from the majority of votes, and priors that hold reliabilities near it when data are few
    post = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(axis=1)))
    start = np.array([[2.0, 4.0, 1.0], [1.0, 4.0, 2.0]])
    for _ in range(rounds):
        prior = float(((n * post).sum() + 1) / (n.sum() + 2))
        rates = np.empty((2, k, 3))
        for c, weight in enumerate((n * (1 - post), n * post)):
            for j in range(k):
                seen = start[c] + np.bincount(votes[:, j], weights=weight, minlength=3)
                rates[c, j] = seen / seen.sum()
        log = [math.log(p) + sum(np.log(rates[c, j, votes[:, j]]) for j in range(k)) for c, p in enumerate((1 - prior, prior))]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return dict(zip(patterns, post.tolist()))


def train_classifier(counts: dict[tuple[int, int], int], soft: dict[int, float], steps: int = 400) -> np.ndarray:
    """Weights (bias first) of a logistic regression over feature bits, fitted to soft labels by gradient steps over counts."""
    w = np.zeros(FEATURES + 1)
    if not counts:
        return w
    x = np.array([[1, *((b >> i) & 1 for i in range(FEATURES))] for _, b in counts], float)
    y = np.array([soft[p] for p, _ in counts])
    n = np.array(list(counts.values()), float)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w += 1.0 * (x.T @ (n * (y - p)) / n.sum() - 0.001 * w)
    return w


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


_FOUND = "base array<int>, extra array<int>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base (start, kind, end, ...) and extra candidates (start, end, votes, features, ...) of every row."""
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            base, extra = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                spans = base_spans(text)
                base.append([x for s in spans for x in s])
                extra.append([x for c in candidates(text, spans) for x in c])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.list_(pa.int32())), pa.array(extra, pa.list_(pa.int32()))], names=["doc_id", "base", "extra"])

    return common.map_arrow(source, run, f"doc_id {kind}, {_FOUND}")


def model(found: DataFrame) -> np.ndarray:
    """Classifier weights from the counts of (votes, features) over all candidates: bounded by the votes and features there are, some hundreds in use."""
    n = F.expr("explode(sequence(0, size(extra) div 4 - 1))")
    some = found.where(F.size("extra") > 0).select("extra", n.alias("i"))
    rows = some.groupBy(F.get("extra", F.col("i") * 4 + 2).alias("votes"), F.get("extra", F.col("i") * 4 + 3).alias("bits")).count().collect()
    counts = {(r.votes, r.bits): r["count"] for r in sorted(rows)}
    patterns: dict[int, int] = {}
    for (v, _), c in counts.items():
        patterns[v] = patterns.get(v, 0) + c
    return train_classifier(counts, expectation_maximisation(patterns))


def accepted(extra: list[int], w: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    out = []
    for s, e, _, bits in zip(*[iter(extra)] * 4):
        z = w[0] + sum(w[i + 1] for i in range(FEATURES) if bits >> i & 1)
        if 1 / (1 + math.exp(-z)) >= threshold:
            out.append((s, 4, e))
    return out


def spans(docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_personal, n_found (spans of any kind) of every row.

    A null or empty text has no spans: counts 0 and the digest of the empty string. Whole texts are read whatever their
    length; repeated rows are scanned each; an empty table gives an empty result, with a model of no evidence. Other
    columns are ignored.
    """
    found = common.cut(find(docs), "pii")
    w = model(found)
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for base, extra in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                rows = list(zip(*[iter(base)] * 3))
                more = accepted(extra, w, threshold)
                values = [sum(r[1] == k for r in rows) for k in range(4)]
                values += [hashlib.sha256(digest(rows).encode()).hexdigest(), digest(rows + more), len(more), len(rows) + len(more)]
                for c, v in zip(cols, values):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_personal", "n_found"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", *names])

    return common.map_arrow(found, run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_personal long, n_found long")


def redact(docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs``, with each found span of the text replaced by its kind in brackets, such as [EMAIL].

    Overlapping spans are replaced together, under the kind of the first. n_chars, where it is a column, follows the new
    text. Null texts stay null, texts without spans stay as they are.
    """
    w = model(find(docs))
    names, schema = docs.columns, docs.schema
    at = names.index("text")

    def run(batches):
        for b in batches:
            texts = []
            for t in b.column(at):
                text = t.as_py()
                if text:
                    base = base_spans(text)
                    text = replaced(text, base + accepted([x for c in candidates(text, base) for x in c], w, threshold))
                texts.append(text)
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.column(at).type)
            if "n_chars" in names and pa.types.is_integer(kind := cols[names.index("n_chars")].type):
                cols[names.index("n_chars")] = pa.array([None if x is None else len(x) for x in texts], kind)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return common.map_arrow(docs, run, schema)


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at, stop = [], 0, -1
    for s, k, e in sorted(spans):
        if s >= stop:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = stop = max(stop, e)
    return "".join([*out, text[at:]])

"""Secrets, personal data, decontamination, toxicity: against plain Python, and on edge cases."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecgrove.llm import decontaminate, pii, secrets, toxicity
from vecgrove.llm.spans import prefix_sums

SECRET = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d)) % 10 == 0


def n_digits(m):
    return len(re.sub(r"[^0-9]", "", m[0]))


PRIVATE = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= n_digits(m) <= 19 and luhn(re.sub(r"[^0-9]", "", m[0]))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= n_digits(m) <= 15),
}


def base(text, patterns):
    found = [(m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(patterns.items()) for m in p.finditer(text or "") if ok(m)]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found)), {k: sum(f[3] == k for f in found) for k in patterns}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def noisy(parts, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_prefix_sums(spark):
    for n in (0, 1, 2, 5, 100):
        r = spark.range(1).select(prefix_sums(F.sequence(F.lit(1), F.lit(n)).cast("array<bigint>") if n else F.array().cast("array<bigint>")).alias("s")).first().s
        assert r == [k * (k + 1) // 2 for k in range(n + 1)]


def test_secrets_base_spans(spark, make, docs, none):
    parts = ["password", "Token", "api_key", "apikey", "é", "=", ": ", " ", '"', "'", "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "ff0", "\n", "_", "."]
    rows = [(i, t) for i, t in enumerate(noisy(parts, 300, 1) + ["token = token = abcdef", "x" * 20_000 + " secret: 'abcdefgh'" + " deadbeef" * 900, " ".join(["a" * 24] * 700)])]
    got = {r.doc_id: r for r in secrets.scan(make(rows)).collect()}
    for i, t in rows:
        want, n = base(t, SECRET)
        assert got[i].base_sha256 == sha(want), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(n.values())
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
    edge = secrets.scan(docs).collect()
    assert len(edge) == docs.count() and {(r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in edge} == {(0, 0, 0, sha(""))}
    assert secrets.scan(none).count() == 0


def test_secrets_models_part_random_from_ordinary(spark):
    w = secrets.train(secrets.sample(spark))
    held = secrets.sample(spark, 6000).where(F.length("value") >= 20)  # the last third is not in the sample
    scored = held.select("secret", (secrets.ratio(F.col("value"), w) > secrets.MIN_RATIO).alias("hit"))
    wrong = scored.where("secret <> hit").count() / scored.count()
    assert wrong < 0.01
    assert len(secrets.train(spark.createDataFrame([(None, True), ("é", False)], "value string, secret boolean"))) == len(secrets.ALPHABET) ** 2


def test_secrets_ratio_equals_plain_chains(spark, make):
    rng = random.Random(12)
    rows = [("".join(rng.choice("ab9Z_+") for _ in range(rng.randint(1, 30))), rng.random() < 0.5) for _ in range(80)] + [("é9", True), (None, False), ("", True)]
    w = secrets.train(spark.createDataFrame(rows, "value string, secret boolean"))
    alpha = secrets.ALPHABET
    n = {c: collections.Counter(v[k : k + 2] for v, s in rows if v and s == c for k in range(len(v) - 1) if v[k] in alpha and v[k + 1] in alpha) for c in (True, False)}
    p = lambda c, a, b: (n[c][a + b] + 0.5) / (sum(n[c][a + x] for x in alpha) + 0.5 * len(alpha))
    values = ["ab9Z_+ab9Z_+ab9Z_+ab", "Zz" * 12, "=" * 25, "qwertyuiopasdfghjklzxcvbnm0123456789"]
    got = [r.x for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").orderBy("k").select(secrets.ratio(F.col("v"), w).alias("x")).collect()]
    want = [sum(math.log(p(True, a, b) / p(False, a, b)) for a, b in zip(v, v[1:])) / (len(v) - 1) for v in values]
    assert np.allclose(got, want, atol=1e-5)


def test_secrets_of_letters_alone_and_long_words(spark, make):
    rng = random.Random(3)
    letters = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(32)) for _ in range(60)]
    plain = ["internationalization_of_everything", "Donaudampfschifffahrtsgesellschaft", "desarrolloadministrativo", "anticonstitutionnellement", "----------------------------", "/usr/share/documentation/index"]
    r = {x.doc_id: x.n_markov for x in secrets.scan(make([(k, f"see {t} here") for k, t in enumerate(letters + plain)])).collect()}
    assert sum(r[k] for k in range(60)) >= 57 and sum(r[k] for k in range(60, 66)) == 0


def test_pii_base_spans(spark, make, docs, none):
    parts = ["a", "b.c", "@", ".", "com", "-", "12", "4111 1111 1111 1111", "1.2.3.4", "300", "+1 ", "(555) 555-1234", " ", "é", "_", "%", "+", "0", "\n"]
    rows = [(i, t) for i, t in enumerate(noisy(parts, 400, 2) + ["y" * 30_000 + " me@x.org"])]
    got = {r.doc_id: r for r in pii.spans(make(rows)).collect()}
    for i, t in rows:
        want, n = base(t, PRIVATE)
        assert got[i].base_sha256 == sha(want), t
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(n.values())
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
    edge = pii.spans(docs).collect()
    assert len(edge) == docs.count() and {(r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans, r.n_found) for r in edge} == {(0, 0, 0, 0, sha(""), "", 0)}
    assert pii.spans(none).count() == 0


def test_pii_weak_supervision_finds_what_labelers_agree_on(spark, make):
    good = [f"you can call my mobile phone {200 + i}-55{i % 10}-{4821 + 7 * i} any time" for i in range(40)]
    good += [f"mail me: jane.doe{i} [at] example [dot] org" for i in range(40)]
    bad = [f"version {100 + i}-111-1111 of the page" for i in range(40)]
    r = {x.doc_id: x.n_personal for x in pii.spans(make(list(enumerate(good + bad)))).collect()}
    assert sum(r[i] > 0 for i in range(80)) >= 76
    assert sum(r[i] > 0 for i in range(80, 120)) <= 2


def test_pii_long_digit_runs(spark, make):
    long = "7" * 300_000
    chain = ".".join(["12"] * 30_001)
    rows = [(0, "1.2.3." + "0" * 5000), (1, long), (2, f"{long}.1.2.3 9.9.9.9"), (3, chain), (4, "1.2.3.256.4.5.6.7"), (5, "0000255.0.0.001"), (6, ("+1" + "(" * 50) * 3000)]
    began = time.time()
    got = {r.doc_id: r for r in pii.spans(make(rows)).collect()}
    assert time.time() - began < 60
    assert [got[i].n_ip for i in range(7)] == [1, 0, 1, 7500, 1, 1, 0]
    assert got[0].spans == "ip:0:5006" and got[4].spans.endswith("ip:10:17") and got[2].spans.endswith(f"ip:{len(long) + 7}:{len(long) + 14}")
    assert sum(len(pii.candidates(t, pii.base_spans(t))) for _, t in rows) >= 0


def test_expectation_maximisation_equals_a_plain_version():
    rng = np.random.default_rng(5)
    k = len(pii.LABELERS)
    truth = rng.random(600) < 0.4
    votes = [[int(rng.choice(3, p=[0.1, 0.3, 0.6] if t else [0.6, 0.3, 0.1])) for _ in range(k)] for t in truth]
    counts = collections.Counter(sum(v * 3 ** (k - 1 - j) for j, v in enumerate(row)) for row in votes)
    got = pii.expectation_maximisation(counts)
    post = [1 / (1 + math.exp(-1.5 * (sum(row) - k))) for row in votes]  # candidate by candidate, rates in plain loops
    for _ in range(50):
        prior = (sum(post) + 1) / (len(post) + 2)
        rate = [[[start for start in ((2, 4, 1), (1, 4, 2))[c]] for _ in range(k)] for c in (0, 1)]
        for row, p in zip(votes, post):
            for j, v in enumerate(row):
                rate[0][j][v] += 1 - p
                rate[1][j][v] += p
        like = [[math.prod(rate[c][j][v] / sum(rate[c][j]) for j, v in enumerate(row)) for row in votes] for c in (0, 1)]
        post = [prior * b / (prior * b + (1 - prior) * a) for a, b in zip(*like)]
    for row, p in zip(votes, post):
        assert abs(got[sum(v * 3 ** (k - 1 - j) for j, v in enumerate(row))] - p) < 1e-6
    assert np.mean([(p > 0.5) == t for p, t in zip(post, truth)]) > 0.9


def test_span_classifier_equals_a_plain_version():
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 9)), int(rng.integers(0, 1 << pii.FEATURES))) for _ in range(80)]
    soft = {p: (p + 0.5) / 9 for p in range(9)}
    got = pii.train_classifier(collections.Counter(rows), soft, steps=60)
    w = [0.0] * (pii.FEATURES + 1)
    for _ in range(60):
        step = [0.0] * len(w)
        for p, bits in rows:
            x = [1] + [bits >> i & 1 for i in range(pii.FEATURES)]
            gap = soft[p] - 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
            step = [s + gap * v / len(rows) for s, v in zip(step, x)]
        w = [a + s - 0.001 * a for a, s in zip(w, step)]
    assert np.allclose(got, w, atol=1e-9)


def test_pii_candidates_and_their_checks():
    def one(text):
        (s, e, pattern, _), = pii.candidates(text, pii.base_spans(text))
        return text[s:e], [pattern // 3 ** (4 - j) % 3 - 1 for j in range(5)]

    assert one("konto GB82WEST12345698765432 bitte") == ("GB82WEST12345698765432", [0, 1, 0, 1, 1])
    assert one("born 31.12.1999 in") == ("31.12.1999", [0, 1, 0, 1, 0])
    assert one("version 45.45.1999") == ("45.45.1999", [0, -1, 0, -1, 0])
    assert one("lives at 12 Oak Street now")[1] == [0, 0, 1, 1, -1]
    assert one("order 123456789 came")[1] == [-1, -1, 0, -1, 1]
    assert pii.candidates("me@x.org 4111 1111 1111 1111", pii.base_spans("me@x.org 4111 1111 1111 1111")) == []


def test_pii_redacts_and_keeps_rows(spark, docs, make):
    d = make([(1, "write to a.b@c.org or +1 (555) 123-4567 now"), (2, None), (3, "plain")])
    r = pii.redact(d)
    assert r.columns == d.columns
    t = {x.doc_id: x.text for x in r.collect()}
    assert t == {1: "write to [EMAIL] or [PHONE] now", 2: None, 3: "plain"}
    assert pii.redact(docs).count() == docs.count()


def brute_windows(text, items, w=8):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    ws, hit, names = fold(text), set(), set()
    for name, t in items:
        iw = fold(t)
        n = min(w, len(iw))
        for k in range(len(iw) - n + 1 if n else 0):
            for s in range(len(ws) - n + 1):
                if ws[s : s + n] == iw[k : k + n]:
                    hit.update(range(s, s + n))
                    names.add(str(name))
    return len(ws), len(hit), len(names), sha(",".join(sorted(names)))


@pytest.mark.parametrize("group_chars", [10**6, 60])
def test_decontamination_is_exact(spark, make, group_chars):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["a", "b", "Ab", "é", "c1"]) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 7, 8, 9, 14]) if i % 6 else 20)) for i in range(14)] + [(20, None), (21, ""), (None, say(9)), (3, "a b")]
    rows = [(i, say(rng.randint(0, 60))) for i in range(60)] + [(60, None), (61, ""), (62, items[0][1]), (62, items[0][1])]
    bench = make(items, "item_id long, text string")
    m = decontaminate.matched(make(rows), bench, group_chars=group_chars)
    got = sorted((r.n_words, sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])), len(r["items"]), sha(",".join(r["items"]))) for r in m.collect())
    assert got == sorted(brute_windows(t, [x for x in items if x[0] is not None]) for _, t in rows)


@pytest.mark.parametrize("group_chars", [40, 10**6])
def test_decontamination_cuts_spans_and_drops_by_coverage(spark, make, group_chars):
    item = "One two, three four five six seven eight nine ten"
    other = "alpha beta gamma delta epsilon zeta eta theta"
    texts = [
        f"before it: {item}. After it é more words that stay here and there and so on, ending",
        f"{item} {other}", "nothing of that", None, "", "one two three four five six seven short of it",
        f"a b c d e f g h i {other.upper()}! {item} -- j k l m n o p q r s t u v w x y z",
    ]
    bench = spark.createDataFrame([("x", item), ("y", other), ("z", "lone")], "item_id string, text string")
    docs = make(list(enumerate(texts)))
    got = decontaminate.remove_spans(docs, bench, group_chars=group_chars)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {
        0: "before it: . After it é more words that stay here and there and so on, ending", 2: texts[2], 3: None, 4: "", 5: texts[5],
        6: "a b c d e f g h i  -- j k l m n o p q r s t u v w x y z",
    }
    assert {r.doc_id for r in decontaminate.remove_contaminated(docs, bench, group_chars=group_chars).collect()} == {2, 3, 4, 5}


def test_decontamination_edges(spark, make, docs, none):
    bench = make([(1, "alpha beta gamma delta epsilon zeta eta theta iota")], "item_id long, text string")
    edge = decontaminate.contamination(docs, bench).collect()
    assert len(edge) == docs.count() and {(r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in edge} == {(0, 0, sha(""), False)}
    assert {r.doc_id: r.n_words for r in edge if r.doc_id in (0, 1, 2, 3, 7)} == {0: 0, 1: 0, 2: 0, 3: 1, 7: 20_000}
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.where("false")).agg(F.sum("n_hit")).first()[0] == 0
    d = make([(1, "x Alpha beta, gamma delta epsilon zeta eta theta y"), (2, "alpha beta gamma"), (3, None)])
    kept = decontaminate.remove_contaminated(d, bench)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_learner_equals_plain_updates():
    rng = random.Random(2)
    rows = [(np.array(sorted(rng.sample(range(40), rng.randint(1, 9)))), rng.randint(0, 1)) for _ in range(120)]
    model, z, n = toxicity.Learner(6, 0.4), [0.0] * 64, [0.0] * 64

    def weight(i):
        if abs(z[i]) <= 0.4:
            return 0.0
        return -(z[i] - math.copysign(0.4, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for at, y in rows:
        model.learn(at, y)
        w = {int(i): weight(i) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in w:
            rate = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
            z[i] += g - rate * w[i]
            n[i] += g * g
    assert np.allclose(model.weights(np.arange(64)), [weight(i) for i in range(64)], atol=1e-12)
    assert 0 < np.count_nonzero(model.weights(np.arange(64))) < 40


def test_toxicity_learns_and_never_from_held_out_rows(spark, make, docs, none):
    rng = random.Random(5)
    say = lambda n: [rng.choice(["red", "green", "blue", "north", "south", "tree", "house"]) for _ in range(n)]
    rows, labels = [], []
    for i in range(900):
        w, bad = say(rng.randint(5, 60)), i % 4 == 0
        if bad:
            w.insert(rng.randint(0, len(w)), rng.choice(["vile", "nasty", "rotten"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad) if zlib.crc32(str(i).encode()) % 5 else 1 - int(bad)))  # held-out labels are lies
    d, lab = make(rows), make(labels, "doc_id long, toxic int")
    weights = toxicity.train(d, lab)
    got = toxicity.score(d, weights).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in got) / len(got) > 0.98
    kept = toxicity.remove_toxic(d, weights)
    assert kept.columns == d.columns and abs(kept.count() - 675) < 15
    edge = toxicity.score(docs, weights).collect()
    assert len(edge) == docs.count() and len({r.score for r in edge if r.doc_id in (0, 1, 2)}) == 1
    assert toxicity.score(none, weights).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, lab.where("false"))).collect()} == {0.5}

"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton of the items is built once and broadcast (its size is bounded by ``group_chars``: a larger benchmark is
split into groups, one automaton and one narrow pass each, one after the other, so no memory grows with the benchmark or
the corpus). Documents stream through it in place: no shuffle, and memory of one batch of texts. Per word the walk keeps the longest length
that still matches some item; whenever that length reaches the window length, the window of words that ends here occurs.

Edge cases: a null or wordless text has no words and no hits; a null or wordless item has no window; rows with a null
item_id are ignored; repeated items count once; repeated documents each get their own row; an empty benchmark hits
nothing; an empty corpus gives an empty result. Other columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.llm import common

WINDOW = 8
#: Characters of the items of one automaton: some hundreds of MB in a worker at most.
GROUP_CHARS = 2_000_000

#: Bytes to words: A-Z lowered, other ASCII that is neither digit nor letter becomes a space, the rest stays.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the windows of the items attached to its states."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        coded = []
        for name, ws in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws]
            if ids:
                coded.append((name, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self._attach(coded)

    def _state(self, size: int, go: dict[int, int], link: int) -> int:
        self.size.append(size)
        self.go.append(go)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the longest string of p followed by c, split off q if q also holds longer strings."""
        if self.size[q] == self.size[p] + 1:
            return q
        twin = self._state(self.size[p] + 1, dict(self.go[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.go[p].get(c) == q:
            self.go[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        q = self.go[last].get(c)
        if q is not None:
            return self._split(last, c, q)
        new = self._state(self.size[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.go[p]:
            self.go[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.go[p][c])
        return new

    def _attach(self, coded: list[tuple[str, list[int]]]) -> None:
        n, w = len(self.size), self.window
        #: state -> items with the window of w words that the state's suffixes end in
        self.long: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        pairs, singles = set(), set()
        self.least = w
        for name, ids in coded:
            pairs.update(zip(ids, ids[1:]))
            at = 0
            for k, c in enumerate(ids, 1):
                at = self.go[at][c]
                if k >= w:
                    self.long.setdefault(self._up(at, w), set()).add(name)
            if len(ids) < w:
                short.setdefault(at, []).append((len(ids), name))
                self.least = min(self.least, len(ids))
                if len(ids) == 1:
                    singles.add(ids[0])
        #: state -> whole short items that are suffixes of its strings
        self.short: list[tuple[tuple[int, str], ...]] = [()] * n
        self.top = [0] * n
        for v in sorted(range(1, n), key=self.size.__getitem__):
            self.short[v] = (*short.get(v, ()), *self.short[self.link[v]])
            up = self.link[v]
            self.top[v] = self.top[up] if self.size[up] >= w else v if self.size[v] >= w else 0
        bits = 22
        self.mask = (1 << bits) - 1
        self.pair_bits = np.zeros(1 << bits, bool)
        if pairs:
            a = np.array(sorted(pairs), np.uint64)
            self.pair_bits[self._slot(a[:, 0], a[:, 1])] = True
        self.single = np.zeros(len(self.vocab) + 1, bool)
        self.single[list(singles)] = True

    def _up(self, v: int, w: int) -> int:
        while self.size[self.link[v]] >= w:
            v = self.link[v]
        return v

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((x >> np.uint64(40)) & np.uint64(self.mask)).astype(np.int64)

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges [start, end) covered by windows, merged, and the items whose windows occur."""
        if not ws or len(self.size) == 1:
            return [], set()
        get = self.vocab.get
        ids = np.array([get(x, 0) for x in ws], np.int64)
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        # only runs of word pairs that some item has can hold a window of two or more words
        known = ids > 0
        runs = []
        if len(ids) > 1:
            ok = known[:-1] & known[1:]
            at = np.flatnonzero(ok)
            ok[at] = self.pair_bits[self._slot(ids[at], ids[at + 1])]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
            need = max(2, self.least) - 1
            runs = [(s, e + 1) for s, e in edge.reshape(-1, 2).tolist() if e - s >= need]
        if self.least == 1:
            runs += [(s, s + 1) for s in np.flatnonzero(self.single[ids]).tolist()]
        go, link, size, w = self.go, self.link, self.size, self.window
        for start, end in runs:
            v, matched = 0, 0
            for i, c in enumerate(ids[start:end].tolist(), start + 1):
                while v and c not in go[v]:
                    v = link[v]
                    matched = size[v]
                nxt = go[v].get(c)
                if nxt is None:
                    continue
                v, matched = nxt, matched + 1
                if matched >= w and (hit := self.long.get(self.top[v])):
                    items |= hit
                    found.append((i - w, i))
                for k, name in self.short[v]:
                    if k <= matched:
                        items.add(name)
                        found.append((i - k, i))
        found.sort()
        merged: list[tuple[int, int]] = []
        for s, e in found:
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        return merged, items


def automata(benchmark: DataFrame, window: int = WINDOW, group_chars: int = GROUP_CHARS):
    """One automaton at a time, for each group of about ``group_chars`` characters of items (one group, for usual benchmarks)."""
    items = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("string").alias("name"), F.col("text").alias("body")
    )
    chars = items.agg(F.sum(F.length("body"))).first()[0] or 0
    n = max(1, math.ceil(chars / group_chars))
    dealt = items.distinct().withColumn("g", F.pmod(F.xxhash64("name", "body"), F.lit(n)))
    for g in range(n):
        yield SuffixAutomaton([(r.name, words(r.body)) for r in dealt.where(F.col("g") == g).toLocalIterator()], window), g + 1 == n


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_chars: int = GROUP_CHARS) -> DataFrame:
    """Per row: doc (all its columns), n_words, spans (merged word ranges, as start, end, start, end, ...) and items (sorted ids).

    Groups of items take one pass each; a pass is written before the next automaton is built, so one automaton is all that
    the driver, a worker and a broadcast hold.
    """
    spark = docs.sparkSession
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    out = docs.select(whole, F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<int>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    for automaton, last in automata(benchmark, window, group_chars):
        shared = common.share(spark, automaton)

        def walk(batches, shared=shared):
            for b in batches:
                sam = shared.value
                old, names = b.column(2).to_pylist(), b.column(3).to_pylist()
                n_words, spans, items = [], [], []
                for text, before, seen in zip(b.column(0).field("text").to_pylist(), old, names):
                    ws = words(text)
                    got, hit = sam.match(ws)
                    if before:
                        got = _merge(got + [(before[i], before[i + 1]) for i in range(0, len(before), 2)])
                    n_words.append(len(ws))
                    spans.append([x for p in got for x in p])
                    items.append(sorted(hit | set(seen or ())))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["doc", "n_words", "spans", "items"]
                )

        out = common.map_arrow(out, walk, out.schema)
        if not last:
            out = common.cut(out, "decontaminate")
            shared.unpersist()
    return out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _lengths():
    """Words of each span."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size("spans") - 2, F.lit(0)), F.lit(2)), lambda i: F.coalesce(F.get("spans", i + 1) - F.get("spans", i), F.lit(0)))


def _covered():
    return F.aggregate(_lengths(), F.lit(0).cast("long"), lambda a, x: a + x)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = 2, group_chars: int = GROUP_CHARS) -> DataFrame:
    """Per document: n_words, n_hit (words inside an occurrence), n_items, items_sha256, contaminated, longest_hit."""
    return matched(docs.select("doc_id", "text"), benchmark, window, group_chars).select(
        "doc.doc_id", "n_words", _covered().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
        F.array_max(_lengths()).cast("long").alias("longest_hit"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = 7, max_coverage: float = 0.0, group_chars: int = GROUP_CHARS) -> DataFrame:
    """Drop the documents whose covered spans exceed ``max_words`` in all and ``max_coverage`` of their words.

    At the defaults every document with eight or more covered words goes; a shorter item alone doesn't condemn one. All
    columns of ``docs`` are kept, whatever their names; rows with a null or empty text stay; equal rows share one decision.
    """
    m = matched(docs, benchmark, window, group_chars)
    return m.where(~((_covered() > max_words) & (_covered() > max_coverage * F.greatest("n_words", F.lit(1))))).select("doc.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = 8, max_coverage: float = 0.5, group_chars: int = GROUP_CHARS) -> DataFrame:
    """Cut covered spans of ``min_words`` words or more out of the texts; documents covered to more than ``max_coverage`` go.

    A span goes from its first word's first character to its last word's last, with what stands between; the blanks on its
    two sides stay. All other columns are kept as they are. Null and empty texts stay.
    """
    m = matched(docs, benchmark, window, group_chars).where(_covered() <= max_coverage * F.greatest("n_words", F.lit(1)))
    columns = docs.columns
    at = columns.index("text")

    def run(batches):
        for b in batches:
            doc = b.column(0)
            texts = [cut_words(t, [(s[i], s[i + 1]) for i in range(0, len(s), 2) if s[i + 1] - s[i] >= min_words]) for t, s in zip(doc.field("text").to_pylist(), b.column(2).to_pylist())]
            cols = [doc.field(k) for k in range(len(columns))]
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    return common.map_arrow(m, run, docs.schema)


def cut_words(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words from s to e - 1 of each span (s, e), sorted and apart."""
    if not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    is_word = np.frombuffer(b" " + data.translate(_FOLD) + b" ", np.uint8) != 32
    edge = np.diff(is_word.view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for s, e in spans:
        out.append(data[at : starts[s]])
        at = ends[e - 1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")

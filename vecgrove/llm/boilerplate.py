"""Main text of web pages: block structure, and a suffix array over each host's pages.

A page is cut into blocks. Blocks inside elements that are never main text (navigation, footers, asides, forms, scripts,
adverts, notices, comments, ...) go. Token streams of what stands outside articles are concatenated by host, and a suffix
array, refined by prefix doubling up to ``run`` tokens, finds the long substrings that distinct pages share: its classes
are the stretches of the array whose common prefixes reach ``run``, and overlapping ones cover longer substrings. A block
shorter than ``run`` counts as a whole. A substring is boilerplate if it stands outside the articles of ``min_pages`` pages
and of ``share`` of the host's pages; pages with equal streams are one page. Each page's text meets that evidence:

* On a page that marks no article, tokens that boilerplate covers go and unique runs stay.
* From a marked article, blocks that boilerplate covers to the last token go, if they have ``run`` tokens or more. An
  article that would lose half of its tokens is a copy of what others quote, and stays whole.

Hosts of any size work: a host's pages are dealt into shards of about ``shard_tokens`` tokens, each builds its own array and
emits its runs with page counts, and counts of equal runs add up over shards. So the evidence is of all pages and no task
holds a host. Runs that ask for it meet a bitmap of fixed size first and an exact join then; pages without boilerplate
are never shuffled.
"""

from __future__ import annotations

import bisect
import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.llm import common

RUN = 16
PAGES = 2
SHARE = 0.05
SHARD_TOKENS = 250_000
_PAD = -1

#: What marks an element as no part of the main text, and what ends a block.
DROPPED = frozenset("nav footer aside form script style noscript template iframe button select textarea svg canvas menu dialog head object label option".split())
RAW = frozenset("script style noscript template iframe textarea svg".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner cookie cookies consent notice notices alert comment comments disqus sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs share sharing social related promo sponsor sponsored newsletter subscribe popup modal "
    "footer header masthead widget toolbar login signup search".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
BLOCKS = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption section article main header footer nav aside "
    "blockquote pre figure figcaption address hr br body html form fieldset details summary center title".split()
)
WHOLE = frozenset("article main".split())
SILENT = RAW | {"head"}  # no reader sees these, so their text is no evidence
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

_NAME_END = re.compile(r"[\s/>]|\Z")
_SPECIAL = re.compile("""["'>]""")
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_MARK = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _marked(attrs: str) -> bool:
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and any(w.lower() in MARKS for w in _MARK.split(value)):
            return True
    return False


class _Tags:
    """The tags of a page, found in one pass: where a tag ends is computed once for each quote or bracket, not for each tag."""

    def __init__(self, page: str):
        self.page = page
        self.specials = [m.start() for m in _SPECIAL.finditer(page)]
        self.known: dict[int, int] = {}  # of a quote or bracket outside quotes: where the tag that it is in ends, or -1
        self.none: dict[str, int] = {}  # from where on a string does not come again
        self.name = (0, -1)  # from a place on, where a name ends

    def _find(self, what: str, at: int) -> int:
        if at >= self.none.get(what, at + 1):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none[what] = at
        return found

    def _name_end(self, at: int) -> int:
        if not self.name[0] <= at <= self.name[1]:
            self.name = (at, _NAME_END.search(self.page, at).start())
        return self.name[1]

    def _next_special(self, at: int) -> int:
        k = bisect.bisect_left(self.specials, at)
        return self.specials[k] if k < len(self.specials) else -1

    def _end(self, at: int) -> int:
        """The bracket that ends the tag whose attributes begin at ``at``, or -1."""
        seen = []
        while True:
            k = self._next_special(at)
            if k < 0:
                end = -1
                break
            if k in self.known:
                end = self.known[k]
                break
            seen.append(k)
            if self.page[k] == ">":
                end = k
                break
            close = self._find(self.page[k], k + 1)
            if close < 0:
                end = -1
                break
            at = close + 1
        for k in seen:
            self.known[k] = end
        return end

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, stop, name, whether it closes, attributes) of the next tag; comments and the like have no name."""
        page = self.page
        while (s := self._find("<", at)) >= 0:
            c = page[s + 1 : s + 2]
            if page.startswith("<!--", s):
                e = self._find("-->", s + 4)
                return s, e + 3 if e >= 0 else len(page), "", False, ""
            if c in ("!", "?") and (e := self._find(">", s + 2)) >= 0:
                return s, e + 1, "", False, ""
            closing = c == "/"
            first = page[s + 1 + closing : s + 2 + closing]
            if first.isascii() and first.isalpha():
                n = self._name_end(s + 1 + closing)
                if (e := self._end(n)) >= 0:
                    return s, e + 1, page[s + 1 + closing : n].lower(), closing, page[n:e]
            if c and (c in "/!" or c.isascii() and c.isalpha()) and self._find("<", s + 1) < 0 and self._find(">", s + 1) < 0:
                return s, len(page), "", False, ""  # the page ends inside a tag
            at = s + 1
        return None


def parse(page: str | None) -> tuple[list[str], list[str], list[str], bool]:
    """Blocks of the article, in the open, and of dropped elements, in page order; and whether there is an article."""
    inside: list[str] = []
    opened: list[str] = []
    dropped: list[str] = []
    parts: list[str] = []
    article = 0  # depth of article or main
    skip, depth, skip_in = "", 0, 0  # the dropped element we are in, its nested likes, and the article depth outside it
    has_article = False
    if not page:
        return inside, opened, dropped, False
    raw = ""  # inside an element whose content is no markup
    at = 0
    tags = _Tags(page)

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                if skip not in SILENT:
                    (dropped if skip else inside if article else opened).append(text)

    while True:
        if raw:  # on to its end tag, whatever stands before
            end = re.compile(f"</{raw}(?=[\\s/>]|$)", re.I).search(page, at)
            at = end.start() if end else len(page)
            raw = ""
        found = tags.next(at)
        if not found:
            break
        start, stop, tag, closing, attrs = found
        if start > at:
            parts.append(page[at:start])
        at = stop
        if not tag:
            continue
        if tag in BLOCKS or tag in DROPPED:
            flush()
        if closing:
            if skip:
                if tag == skip:
                    depth -= 1
                    if not depth:
                        skip = ""
                elif tag in WHOLE and skip_in:  # the article ends though the element was left open
                    skip = ""
                    article -= 1
            elif tag in WHOLE and article:
                article -= 1
            continue
        if skip:
            if tag == skip and not attrs.endswith("/"):
                depth += 1
            elif tag in WHOLE and not skip_in and not (tag == "article" and skip == "div" and depth > 3):
                skip = ""  # an element left open doesn't swallow the article
                article += 1
                has_article = True
            elif tag in RAW:
                raw = tag
            continue
        if tag in WHOLE:
            article += 1
            has_article = True
            continue
        if tag in VOID:
            continue
        if tag in DROPPED or tag == "header" and not article or tag not in ("html", "body", "header") and _marked(attrs):
            if attrs.endswith("/") and tag not in RAW:
                continue
            skip, depth, skip_in = tag, 1, article
            raw = tag if tag in RAW else ""
    parts.append(page[at:])
    flush()
    return inside, opened, dropped, has_article


def tokens(block: str) -> np.ndarray:
    return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in block.split()], np.int64)


def run_keys(stream: np.ndarray, run: int = RUN) -> np.ndarray:
    """A 64-bit key for each run of ``run`` tokens of a stream, from its first token on."""
    n = len(stream) - run + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h = np.full(n, 14695981039346656037, np.uint64)
    for k in range(run):
        h = (h ^ stream[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def truncated_suffix_array(stream: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``run`` tokens, and the rank class of each suffix: equal iff those tokens are.

    Prefix doubling: classes by 2^k tokens come from pairs of classes by 2^(k-1); a last pair overlaps to reach ``run``.
    Suffixes shorter than that keep apart by the end of the stream.
    """
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64) + 1
    n, length = len(stream), 1
    while length < run:
        step = min(length, run - length)
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + later, return_inverse=True)[1].astype(np.int64) + 1
        length += step
    return np.argsort(rank, kind="stable"), rank


def padded(block: np.ndarray, run: int = RUN) -> np.ndarray:
    """A block shorter than a run, filled up to one: it counts as a whole and equals no part of a longer block."""
    return block if len(block) >= run else np.concatenate((block, np.full(run - len(block), _PAD)))


def shared_runs(pages: list[list[np.ndarray]], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs in the pages' blocks, and the number of distinct pages with each."""
    stream, owner, key = [], [], []
    for p, blocks in enumerate(pages):
        for b in blocks:
            mark = -2 - len(stream)  # a separator of its own: no run crosses blocks
            stream.append(np.append(b, mark))
            owner.append(np.full(len(b) + 1, p))
            k = np.zeros(len(b) + 1, np.int64)
            found = run_keys(b, run)
            k[: len(found)] = found
            key.append(k)
    none = np.zeros(0, np.int64)
    if not stream:
        return none, none
    sizes = np.concatenate([np.arange(len(s) - 1, -1, -1) for s in stream])  # tokens left in the block
    stream, owner, key = (np.concatenate(x) for x in (stream, owner, key))
    order, rank = truncated_suffix_array(stream, run)
    order = order[sizes[order] >= run]
    if not len(order):
        return none, none
    # in suffix order, each class is a stretch; count its distinct pages
    order = order[np.lexsort((owner[order], rank[order]))]
    r, o = rank[order], owner[order]
    first = np.concatenate(([True], r[1:] != r[:-1]))
    new = first | np.concatenate(([True], o[1:] != o[:-1]))
    starts = np.flatnonzero(first)
    return key[order][starts], np.add.reduceat(new.astype(np.int64), starts)


def covered_tokens(block: str, repeated: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which of the block's tokens stand inside one of the repeated runs."""
    words = tokens(block)
    n = len(words)
    words = padded(words, run)
    at = np.flatnonzero(np.isin(run_keys(words, run), repeated))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + run, -1)
    return np.cumsum(cover)[:n] > 0


def cleaned(blocks: list[str], article: bool, repeated: np.ndarray, run: int = RUN) -> tuple[list[str], int]:
    """The blocks without boilerplate, and the number of tokens that it covers (of an article, in blocks that could go)."""
    covers = [covered_tokens(t, repeated, run) for t in blocks]
    if not article:
        left = (" ".join(w for w, c in zip(t.split(), cover) if not c) for t, cover in zip(blocks, covers))
        return [t for t in left if t], sum(int(c.sum()) for c in covers)
    gone = [len(c) >= run and bool(c.all()) for c in covers]
    n = sum(len(c) for c, g in zip(covers, gone) if g)
    if 2 * n >= sum(map(len, covers)):
        return blocks, n
    return [t for t, g in zip(blocks, gone) if not g], n


def _pack(text: str) -> bytes:
    """A text as it waits for the evidence: compressed, since it is stored once and shuffled once."""
    return zlib.compress(text.encode("utf-8", "surrogatepass"))


def _unpack(data: bytes) -> str:
    return zlib.decompress(data).decode("utf-8", "surrogatepass")


_SAVED = ("page", "page_id", "url", "host", "article", "body", "around", "size")


def main_text(pages: DataFrame, run: int = RUN, min_pages: int = PAGES, share: float = SHARE, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars, has_article, n_repeated of every page.

    ``n_repeated`` counts the tokens of the main text's blocks that boilerplate covers: those that went, and those of
    articles that stay whole as copies. A null or empty html, or one without main text, has an empty text. A null url is a
    host of its own. Repeated rows are one page of the evidence, and a row each of the result. Very long pages are read
    whole; an empty table gives an empty result. Other columns are ignored.
    """
    spark = pages.sparkSession
    source = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}

    def cut(batches):
        for b in batches:
            article, body, around, size = [], [], [], []
            for t in b.column(2):
                inside, free, gone, marked = parse(t.as_py())
                article.append(marked)
                body.append(_pack("\n".join(inside if marked else free)))
                other = gone + free
                around.append(_pack("\n".join(other)) if other else None)
                size.append(sum(max(run, len(x.split())) for x in other))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(article, pa.bool_()), pa.array(body, pa.binary()), pa.array(around, pa.binary()), pa.array(size, pa.int64())],
                names=["page_id", "url", "article", "body", "around", "size"],
            )

    parsed = common.map_arrow(source, cut, f"page_id {kinds['page_id']}, url {kinds['url']}, article boolean, body binary, around binary, size long")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    saved = common.cut(parsed.withColumns({"host": host, "page": F.xxhash64(F.monotonically_increasing_id())}).select(*_SAVED), "pages")

    # one page stands for all with its stream
    distinct = saved.where("around is not null").groupBy("host", F.xxhash64("around").alias("sig")).agg(F.min("page").alias("page"), F.first("size").alias("size"))
    distinct = common.cut(distinct, "streams")
    least = F.greatest(F.lit(min_pages), F.ceil(F.count("*") * share)).cast("long").alias("least")
    sizes = distinct.groupBy("host").agg(least, F.ceil(F.sum("size") / shard_tokens).cast("int").alias("shards"))
    sizes = common.cut(sizes.where("least > 1 or shards > 0"), "hosts")
    stands = common.share(spark, common.bitmap(distinct.select(F.col("page").alias("key"))))

    def standing(batches):
        for b in batches:
            yield b.filter(pa.array(common.in_bitmap(stands.value, b.column(0).to_numpy())))

    streams = common.map_arrow(saved.where("around is not null").select("page", "host", "around"), standing, "page long, host string, around binary")
    streams = streams.withColumn("sig", F.xxhash64("around")).join(sizes, "host").withColumn("salt", F.pmod("sig", F.col("shards")))
    dealt = streams.select("host", "salt", "sig", "shards", "least", "around").repartition("host", "salt").sortWithinPartitions("host", "salt", "sig")

    def index(batches):
        now, last, held, few = None, None, [], 0
        for b in batches:
            for h, salt, sig, shards, n, around in zip(*(b.column(k).to_pylist() for k in range(6))):
                if (h, salt) != now:
                    if held:
                        yield emit(now[0], held, few)
                    now, last, held, few = (h, salt), None, [], n if shards == 1 else 1
                if sig != last:  # equal streams that the bitmap let through are one page
                    last = sig
                    held.append([padded(tokens(t), run) for t in _unpack(around).split("\n")])
        if held:
            yield emit(now[0], held, few)

    def emit(host, held, few):
        """A shard that is a whole host emits what its pages repeat often enough, others emit all that may add up."""
        keys, n = shared_runs(held, run)
        keys, n = keys[n >= few], n[n >= few]
        return pa.RecordBatch.from_arrays([pa.array([host] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["host", "run", "pages"])

    runs = common.map_arrow(dealt, index, "host string, run long, pages long")
    counts = runs.groupBy("host", "run").agg(F.sum("pages").alias("pages"))
    repeated = common.cut(counts.join(sizes, "host").where("pages >= least").select("host", "run"), "repeated-runs")
    known = common.share(spark, common.bitmap(repeated.select(F.col("run").alias("key"))))

    def own(batches):
        for b in common.slices(batches):
            out: list[list] = [[], [], []]
            for page, h, article, body in zip(*(b.column(k).to_pylist() for k in range(4))):
                blocks = [tokens(t) for t in _unpack(body).split("\n") if t]
                found = [run_keys(padded(t, run), run) for t in blocks if len(t) >= run or not article]
                keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
                keys = keys[common.in_bitmap(known.value, keys)]
                for column, value in zip(out, ([page] * len(keys), [h] * len(keys), keys.tolist())):
                    column.extend(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["page", "host", "run"])

    asked = common.map_arrow(saved.select("page", "host", "article", "body"), own, "page long, host string, run long").join(repeated, ["host", "run"])
    covered = common.cut(asked.groupBy("page").agg(F.collect_list("run").alias("runs")), "covered-pages")  # a page's own runs: bounded by its length

    del runs, counts, asked, dealt, streams
    common.release(spark)  # their shuffle files go before texts are shuffled

    # pages that surely have no boilerplate in their text pass as they are; the others meet their runs
    repeating = common.share(spark, common.bitmap(covered.select(F.col("page").alias("key"))))

    def split(repeat):
        def rows(batches):
            for b in batches:
                yield b.filter(pa.array(common.in_bitmap(repeating.value, b.column(0).to_numpy()) == repeat))

        return common.map_arrow(saved.select("page", "page_id", "url", "article", "body"), rows, f"page long, page_id {kinds['page_id']}, url {kinds['url']}, article boolean, body binary")

    def finish(batches):
        for b in common.slices(batches):
            text, n = [], []
            for article, body, found in zip(*(b.column(k).to_pylist() for k in (2, 3, 4))):
                whole = _unpack(body)
                if found:
                    blocks, gone = cleaned(whole.split("\n"), article, np.array(found, np.int64), run)
                text.append("\n".join(blocks) if found else whole)
                n.append(gone if found else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), b.column(2), pa.array(n, pa.int64())], names=["page_id", "url", "text", "has_article", "n_repeated"])

    met = split(True).join(covered, "page", "left").unionByName(split(False).withColumn("runs", F.lit(None).cast("array<long>")))
    met = met.select("page_id", "url", "article", "body", "runs")
    done = common.map_arrow(met, finish, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, has_article boolean, n_repeated long")
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "has_article", "n_repeated")

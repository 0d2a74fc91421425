"""The main body of web-page text, by composite text density.

The captured text has no markup left, so the page is read as a tree of its layout: page, paragraphs (blank lines), lines,
and the items that separators make of a line. A paragraph's composite density is its characters, less those in link-like
items, per node below it. The run of paragraphs with the largest sum of densities above a threshold from the path between
page and densest paragraph is the body by density alone (``dense_labels``). Density can't tell a heading of the article from
a teaser of the same words, so that run, its threshold and the paragraphs' own words enter a linear chain whose weights come
from reviewed pages; the labelling with the largest summed score is the body.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.chain import Chain

MAX_REVIEWED = 3_000
BLANK = regex.compile(r"\n(?:[ \t]*\r?\n)+")
SEPARATORS = regex.compile(r"\s+[|»›>/·•→–—-]\s+|\s*[|·•]\s*")
WORDS = re.compile(r"\w+(?:['’]\w+)*|[©→»›|@#>:;!?.,/*-]")
SENTENCE = re.compile(r"([^.!?\n]{13,})[.!?](?:\s|$)")
YEAR = regex.compile(r"\d{4}")
DATE = regex.compile(r"\b\d{4}-\d\d-\d\d\b|\b\d{1,2}\. ?\d{1,2}\. ?\d{4}\b|\b\d{1,2}/\d{1,2}/\d{4}\b|\b\d{1,2}\.? \p{L}+ \d{4}\b|\b\p{L}+ \d{1,2}, \d{4}\b")


def paragraphs(text: str | None) -> list[str]:
    """The paragraphs of a text: what stands between runs of blank lines; null and blank texts have none."""
    if not text:
        return []
    t = text.replace("\r\n", "\n")
    out, cur = [], []
    for line in t.split("\n"):
        if line.strip(" \t"):
            cur.append(line)
        elif cur:
            out.append("\n".join(cur))
            cur = []
    if cur:
        out.append("\n".join(cur))
    return out


def sentences(text: str) -> int:
    """Ends of sentences: a full stop, question or exclamation mark before a blank, twelve or more characters behind a lower-case letter."""
    if len(text) < 14 or "." not in text and "!" not in text and "?" not in text:
        return 0
    return sum((head := x[:-12]).upper() != head for x in SENTENCE.findall(text))


def density(par: str) -> tuple[float, int, int]:
    """Composite density of a paragraph: characters outside link-like items per node, and how many nodes and links it has."""
    nodes, links, plain = 0, 0, 0
    for line in par.split("\n"):
        items = SEPARATORS.split(line)
        for item in items:
            nodes += 1
            if (len(items) > 1 or len(item) < 28) and len(item) < 60 and not sentences(item):
                links += 1
            else:
                plain += len(item)
    return plain / max(1, nodes), nodes, links


def body_run(dens: list[float]) -> tuple[int, int, float]:
    """(first, last, threshold) of the run of paragraphs with the largest sum of densities above the threshold.

    The threshold is the density on the path from the page down to its densest paragraph at its lowest: the page's own mean.
    A run of paragraphs is a subtree of the layout tree; (0, -1, 0) if the page has no text but links.
    """
    if not any(dens):
        return 0, -1, 0.0
    floor = min(sum(dens) / len(dens), max(dens) / 2)
    best, a, b, run, start = 0.0, 0, -1, 0.0, 0
    for i, d in enumerate(dens):
        run += d - floor
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, a, b = run, start, i
    return a, b, floor


def dense_labels(pars: list[str]) -> list[int]:
    """The labelling by density alone: paragraphs of the body run that reach the threshold."""
    dens = [density(p)[0] for p in pars]
    a, b, floor = body_run(dens)
    return [int(a <= i <= b and d >= floor) for i, d in enumerate(dens)]


@functools.lru_cache(maxsize=65536)
def _shape(word: str) -> str:
    return "9" if word.isdigit() else "Xx" if word[:1].isupper() and len(word) > 1 else "X" if word.isupper() else word if not word[:1].isalnum() else "x"


class _Facts:
    """What is read of one paragraph; held for the paragraphs met last, as furniture repeats."""

    __slots__ = ("density", "words", "shape", "kind", "look", "last")

    def __init__(self, p: str):
        self.density, nodes, links = density(p)
        raw = WORDS.findall(p)
        self.words = ws = " ".join(raw).lower().split(" ") if raw else []
        self.shape = " ".join(map(_shape, raw[:6])) + (" +" if len(raw) > 6 else "")
        sent, lines, first, end = sentences(p), p.count("\n") + 1, p.lstrip()[:1], p.rstrip()[-1:]
        kind = "S" if sent and self.density > 60 else "s" if sent else "L" if lines > 2 else "t" if len(ws) > 1 else "w"
        self.kind = kind + (first if first in "*->•©" else "")
        date = (2 if len(ws) < 12 else 1) if YEAR.search(p) and DATE.search(p) else 0
        rest = p.split("\n")[1:]
        ind = any(x[:1] in " \t" for x in rest) if rest else None
        bul = all(x.lstrip()[:1] in "*-•" or x.lstrip()[:1].isdigit() for x in p.split("\n")) if rest else None
        self.look = ("look", min(9, int(math.log1p(self.density) * 1.5)), self.kind, min(nodes, 9), min(links, 9), min(12, int(math.log1p(len(p)) * 2)), min(sent, 4), "a" if end.isalnum() else end, min(lines, 6), date, ind, bul)
        self.last = ("last", *ws[-2:]) if len(ws) > 1 else None


_facts = functools.lru_cache(maxsize=8192)(_Facts)


def expand(key: tuple) -> list[str]:
    """The named features behind a key of ``page_keys``."""
    what, *x = key
    if what == "look":
        d, k, nodes, links, size, sent, end, lines, date, ind, bul = x
        return [f"d{d}", f"k{k}", f"n{nodes}", f"l{links}", f"c{size}", f"s{sent}", f"end{end}", f"L{lines}"] + [[], ["date"], ["date!"]][date] + ([] if ind is None else [f"ind{ind}", f"bul{bul}"])
    if what == "words":  # all words and pairs of a paragraph, its last words
        ws = _facts(x[0]).words
        return ["w=" + w for w in dict.fromkeys(ws)] + ["b=" + a + " " + b for a, b in dict.fromkeys(zip(ws, ws[1:]))] + ["z=" + w for w in ws[-5:]]
    if what == "near words":  # the first words of what stands before or behind
        return [f"N{x[0]}w={w}" for w in dict.fromkeys(_facts(x[1]).words[:NEAR])]
    if what == "zone":
        zone, gap, k = x
        return [f"zone{zone}", f"zone{zone}{gap}", f"zk{zone}{gap}{k}"]
    if what == "place":
        i, j, before, k = x
        return [f"i{i}", f"j{j}", f"bb{before}{k}", f"ik{min(i, 4)}{k}"]
    if what == "kinds":
        side, kinds, k, zone = x
        return [f for o, t in zip(SIDES[side], kinds) for f in (f"K{o}={t}", f"KK{o}={t}{k}{zone}")]
    if what == "run":
        where, over, k = x
        return [f"run{where}{over}", f"run{where}{over}{k}"]
    return ["=".join(map(str, key))]


NEAR = 14
SIDES = ((-3, -2, -1), (1, 2, 3))


def page_keys(pars: list[str], words: bool = True) -> list[list[tuple]]:
    """Keys of each paragraph of a page, each for a group of named features (``expand``); those of single words only with ``words``."""
    facts = [_facts(p) for p in pars]
    dens, kinds, m = [x.density for x in facts], [x.kind for x in facts], len(pars)
    run_a, run_b, floor = body_run(dens)
    big = [i for i, k in enumerate(kinds) if k[0] == "S"]
    first, last = (big[0], big[-1]) if big else (m, -1)
    around = ["^"] * 3 + kinds + ["^"] * 3
    seen: set[str] = set()
    out, before = [], 0
    for i, (p, x, k, d) in enumerate(zip(pars, facts, kinds, dens)):
        zone = "none" if not big else "pre" if i < first else "post" if i > last else "in"
        gap = min(6, first - i) if zone == "pre" else min(6, i - last) if zone == "post" else 0
        where = "in" if run_a <= i <= run_b else "non" if run_b < 0 else "pre" if i < run_a else "pos"
        over = "none" if not floor else "over" if d >= floor else "some" if d else "zero"
        f = [x.look, ("sh", x.shape), ("zone", zone, gap, k), ("place", min(i, 8), min(m - i, 8), min(before, 4), k), ("kinds", 0, tuple(around[i:i + 3]), k, zone), ("kinds", 1, tuple(around[i + 4:i + 7]), k, zone),
             ("run", where, over, k), ("D", min(12, int(math.log1p(sum(dens[max(0, i - 2):i + 3])) * 1.5)), k[0])]  # D: the neighbourhood's sum of densities
        if len(x.words) <= NEAR:
            f.append(("t", *x.words))
        if x.last:
            f.append(x.last)
        for o in (-1, 1):
            if 0 <= i + o < m:
                y = facts[i + o]
                f.append(("near", o, y.shape))
                if len(y.words) <= NEAR:
                    f.append(("near text", o, *y.words))
                if words:
                    f.append(("near words", o, pars[i + o]))
        if words:
            f.append(("words", p))
        if p in seen:
            f.append(("again",))
        seen.add(p)
        before += k[0] == "S"
        out.append(f)
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


class Labeller:
    """A fitted chain with its word features as arrays, so that the words of many paragraphs are weighed at once."""

    def __init__(self, chain: Chain):
        self.chain = chain
        named = {"w=": 0, "z=": 1, "N-1w=": 2, "N1w=": 3}
        self.number: dict[str, int] = {}
        single, pairs = [], []
        for f, i in chain.index.items():
            head = f[:f.find("=") + 1]
            if head in named:
                single.append((self.number.setdefault(f[len(head):], len(self.number)), named[head], i))
            elif head == "b=":
                a, b = f[2:].split(" ")
                pairs.append((self.number.setdefault(a, len(self.number)), self.number.setdefault(b, len(self.number)), i))
        self.weight = np.zeros((4, len(self.number), len(chain.labels)))
        for n, kind, i in single:
            self.weight[kind, n] = chain.w[i]
        code = np.array([a * len(self.number) + b for a, b, _ in pairs], np.int64)
        order = np.argsort(code)
        self.code, self.pair = code[order], chain.w[np.array([i for *_, i in pairs], np.int64)[order]]

    def _sums(self, par: np.ndarray, what: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(par, weight[what, k], n) for k in range(weight.shape[1])], 1)

    def _words(self, pars: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of each paragraph's words for itself, for the paragraph behind and for the one before."""
        ws = [_facts(p).words for p in pars]
        size, n, v = np.array([len(x) for x in ws], np.int64), len(pars), max(1, len(self.number))
        ids = np.fromiter(map(self.number.get, itertools.chain.from_iterable(ws), itertools.repeat(-1)), np.int64, int(size.sum()))
        par = np.repeat(np.arange(n), size)
        at = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        known = ids >= 0

        def once(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return np.divmod(_distinct(par[mask] * v + ids[mask]), v)

        own = self._sums(*once(known), self.weight[0], n)
        tail = known & (at >= np.repeat(size, size) - 5)
        own += self._sums(par[tail], ids[tail], self.weight[1], n)
        if len(self.code) and len(ids) > 1:
            both = np.flatnonzero(known[1:] & known[:-1] & (par[1:] == par[:-1]))
            code = ids[both] * v + ids[both + 1]
            where = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            hit = self.code[where] == code
            own += self._sums(*np.divmod(_distinct(par[both[hit]] * len(self.code) + where[hit]), len(self.code)), self.pair, n)
        near = once(known & (at < NEAR))
        return own, self._sums(*near, self.weight[2], n), self._sums(*near, self.weight[3], n)

    def labels(self, pages: list[list[str]]) -> list[np.ndarray]:
        """1 for main content, 0 for furniture, of every paragraph of the pages."""
        number: dict[str, int] = {}
        at = [np.array([number.setdefault(p, len(number)) for p in ps], np.int64) for ps in pages]
        own, before, behind = self._words(list(number))
        extra = []
        for a in at:
            e = own[a]
            e[1:] += before[a[:-1]]
            e[:-1] += behind[a[1:]]
            extra.append(e)
        return self.chain.decode([page_keys(p, words=False) for p in pages], extra)


def reviewed_labels(pars: list[str], expected: str) -> list[int] | None:
    """1 for paragraphs of the reviewed content, 0 for the rest; None if the content is not found in order."""
    want, j, out = [p.rstrip() for p in paragraphs(expected)], 0, []
    for p in pars:
        hit = j < len(want) and p.rstrip() == want[j]
        out.append(int(hit))
        j += hit
    return out if j == len(want) else None


def fit(rows: list[tuple[str, str]]) -> Chain | None:
    """The chain from (raw, reviewed content) pairs; None if no pair can be used."""
    seqs, gold = [], []
    for raw, exp in rows:
        ps = paragraphs(raw)
        y = reviewed_labels(ps, exp)
        if ps and y is not None:
            seqs.append(page_keys(ps))
            gold.append(y)
    return Chain(("furniture", "main"), expand).fit(seqs, gold) if seqs else None


def label_paragraphs(pages: DataFrame, *, id_col: str = "id", raw: str = "raw_content", expected: str = "expected_content", max_reviewed: int = MAX_REVIEWED, with_text: bool = True) -> DataFrame:
    """``id, para_no, para, is_main`` of every paragraph of every page; rows delivered twice give one. Without ``with_text`` para is null.

    The weights are fitted on at most ``max_reviewed`` reviewed pages (lowest hashes of the id). Null ids and null or blank
    texts give no rows; without reviewed pages the density alone decides (``dense_labels``).
    Where one id has different texts, the paragraphs of each are given.
    """
    src = pages.select(F.col(id_col).cast("string").alias("id"), F.col(raw).alias("raw"), F.col(expected).alias("exp")).where("id IS NOT NULL AND raw IS NOT NULL")
    sample = src.where("exp IS NOT NULL").groupBy("id").agg(F.min(F.struct("raw", "exp")).alias("m")).orderBy(F.xxhash64("id"), "id").limit(max_reviewed).select("m.raw", "m.exp").collect()
    model = fit([(r["raw"], r["exp"]) for r in sample])
    shared = src.sparkSession.sparkContext.broadcast(Labeller(model) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for a in range(0, b.num_rows, 256):
                ids = b.column(0).slice(a, 256).to_pylist()
                pages = [paragraphs(t) for t in b.column(1).slice(a, 256).to_pylist()]
                got = model.labels(pages) if model else [dense_labels(p) for p in pages]
                rows = [(i, n + 1, x if with_text else None, bool(y)) for i, p, ys in zip(ids, pages, got) for n, (x, y) in enumerate(zip(p, ys))]
                cols = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())],
                                                 ["id", "para_no", "para", "is_main"])

    once = src.groupBy("id", F.xxhash64("raw").alias("h")).agg(F.min("raw").alias("raw")).select("id", "raw")
    return once.mapInArrow(run, "id string, para_no int, para string, is_main boolean")


def main_text(labelled: DataFrame) -> DataFrame:
    """``id, content``: the main paragraphs of each page in order, parted by blank lines; pages without any have ''."""
    kept = F.array_sort(F.collect_list(F.when(F.col("is_main"), F.struct("para_no", "para"))))
    return labelled.groupBy("id").agg(F.array_join(kept["para"], "\n\n").alias("content"))

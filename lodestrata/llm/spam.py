"""Keyword-stuffed pages and link lists, told apart from prose by how regularly their terms come back.

Per document (whole text, without a leading title and metadata block) the tokens are numbered and the signal is taken
from positions: gaps between a term's or term pair's recurrences, how even these gaps are, the agreement of the token
sequence with itself at lags 1..MAX_LAG and at the document's own most frequent gap between equal pairs (positional
autocorrelation) within the document, the share of text that is
links, tags, numbers and separators, and how far the words are of the kind that statements have (function words,
verbs), which a distinct-noun list lacks. A linear model over these, fitted on the labelled documents, decides.

The fit uses at most MAX_LABELS labelled documents (those of the lowest hash of the id); scoring reads every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut, release

MAX_LABELS = 8_000
MAX_LAG = 24
BATCH_CHARS = 4_000_000
# A leading title with a metadata list, or with "key: value" lines, as the sources of the project write them.
# Lines end in \n or \r\n; a block has any number of lines, the list up to the next heading.
HEADER = regex.compile(r"\s*(?:# [^\n]*\n\s*)?## Metadata\r?\n(?:(?!##? ).*\n)*?\s*## Content\s*\n|[^\r\n][^\n]*\n\r?\n(?:[a-z_ ]{2,24}: [^\n]*\n){2,}\r?\n")
TOKEN = regex.compile(r"(?:https?:)?//[^\s\"'<>)\]]+|<[^<>\n]*>|#\w+|\w+(?:['’]\w+)?|[^\w\s]|\n").findall
# Cyrillic and Greek letters that look like Latin ones, and digits used as letters.
LOOKALIKE = str.maketrans("аеорсухіјѕԁһвкмтгпΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορν", "aeopcyxijsdhbkmtrnABEZHIKMNOPTYXaopv")
LEET = str.maketrans("013457$@", "oieastsa")
WORD, LINK, TAG, NUMBER, STOP, SEPARATOR, MARK, ODD, BREAK = range(9)
FEATURES = ("tokens", "link", "tag", "number", "stop", "separator", "odd", "words_per_stop", "gap1", "gap2", "gap2_short", "even", "auto", "auto_lag",
            "gap2_any", "auto_far", "type_ratio", "statement", "statement_share", "noun_share", "unknown", "upper", "line_words", "long_lines", "segment_share", "over_half", "few_statements", "repeat_half")


class _Terms(dict):
    """Token -> number, with what is known of each token; look-alike spellings of a word share its number."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights, self.kind, self.size, self.weight, self.upper, self.norm, self.key = weights, [], [], [], [], {}, []

    def __missing__(self, t: str) -> int:
        kind, norm = WORD, t
        if t[0] == "<" and len(t) > 1 or "//" in t:
            kind, norm = LINK, "\0link"
        elif t[0] == "#" and len(t) > 1:
            kind, norm = TAG, t.lower()
        elif t == "\n":
            kind = BREAK
        elif len(t) == 1 and not t.isalnum():
            kind = STOP if t in ".!?" else SEPARATOR if t in "»|→>/;•·,-–—=*" else MARK
        elif any(c.isdigit() for c in t):
            if t[0].isalpha() and t[-1].isalnum() and sum(c.isdigit() for c in t) * 2 < len(t) and t.lower() == t:
                kind, norm = ODD, t.lower().translate(LEET)
            else:
                kind, norm = NUMBER, "\0number"
        else:
            norm = t.translate(LOOKALIKE).lower()
            if norm != t.lower() and any("a" <= c <= "z" for c in t.lower()):
                kind = ODD
        i = len(self.kind)
        self.kind.append(kind)
        self.size.append(len(t))
        self.weight.append(self.weights.get(norm, 0.0))
        self.upper.append(t[0].isupper())
        self.key.append(self.norm.setdefault(norm, len(self.norm)))
        self[t] = i
        return i


def body(text: str | None) -> str:
    """The text behind a leading title and metadata block; null gives an empty text."""
    if not text:
        return ""
    m = HEADER.match(text)
    return text[m.end():] if m else text


def _previous(keys: np.ndarray) -> np.ndarray:
    """For each position the distance to the last position with the same key, 0 if there is none."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), np.int64)
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[1:][same]] = (order[1:] - order[:-1])[same]
    return out


def features(texts: list[str], weights: dict[str, float]) -> np.ndarray:
    """One row of FEATURES per text; a text without tokens has zeros."""
    terms, parts, lens, lines = _Terms(weights), [], [], []
    for t in texts:
        b = body(t)
        found = TOKEN(b)
        lens.append(len(found))
        rows = b.count("\n") - b.count("\n\n") + 1
        lines.append(rows)
        if found:
            parts.append(np.fromiter(map(terms.__getitem__, found), np.int64, len(found)))
    n = np.array(lens, np.int64)
    out = np.zeros((len(texts), len(FEATURES)))
    if not parts:
        return out
    has = n > 0
    tok = np.concatenate(parts)
    m = n[has]
    doc = np.repeat(np.arange(len(m)), m)
    start = np.concatenate([[0], np.cumsum(m)[:-1]])
    kind, size, weight, upper, key = (np.array(x)[tok] for x in (terms.kind, terms.size, terms.weight, terms.upper, terms.key))
    total = lambda x: np.bincount(doc, x.astype(float), len(m))
    chars = np.maximum(total(size * (kind != BREAK)), 1)
    word = (kind == WORD) | (kind == ODD)
    words = np.maximum(total(word), 1)
    put = {"tokens": np.log1p(m)}
    for name, k in (("link", LINK), ("tag", TAG), ("number", NUMBER), ("odd", ODD)):
        put[name] = total(size * (kind == k)) / chars
    put["stop"] = total(kind == STOP) / m
    put["separator"] = total(kind == SEPARATOR) / m
    put["words_per_stop"] = np.minimum(words / (total(kind == STOP) + 1), 60) / 60
    # Recurrence of terms and of neighbouring pairs of terms, among words only.
    at = np.flatnonzero(word | (kind == TAG))
    wd, wk = doc[at], key[at]
    base = len(terms.norm) + 1
    one = _previous(wd * base + wk)
    pair = np.zeros(len(at), np.int64)
    if len(at) > 1:
        same = wd[1:] == wd[:-1]
        code = (wd[1:] * base + wk[1:]) * base + wk[:-1] if base * base * (len(m) + 1) < 2**62 else wk[1:] * base + wk[:-1] + wd[1:] * 7919
        pair[1:] = np.where(same, _previous(code), 0)
    by = lambda x: np.bincount(wd, x.astype(float), len(m))
    nw = np.maximum(by(np.ones(len(at))), 1)
    put["gap1"] = by((one > 0) & (one <= MAX_LAG)) / nw
    put["gap2"] = by((pair > 0) & (pair <= 3 * MAX_LAG)) / nw
    put["gap2_any"] = by(pair > 0) / nw
    put["gap2_short"] = by((pair > 0) & (pair <= MAX_LAG)) / nw
    g = np.where(pair > 0, np.log(np.maximum(pair, 1)), 0.0)
    cnt = np.maximum(by(pair > 0), 1)
    put["even"] = np.sqrt(np.maximum(by(g * g) / cnt - (by(g) / cnt) ** 2, 0))
    put["type_ratio"] = by(one == 0) / nw
    best, lag_at = np.zeros(len(m)), np.zeros(len(m))
    for lag in range(1, MAX_LAG + 1):
        if len(at) > lag:
            hit = (wk[lag:] == wk[:-lag]) & (wd[lag:] == wd[:-lag])
            r = np.bincount(wd[lag:], hit.astype(float), len(m)) / np.maximum(nw - lag, 8)
            lag_at = np.where(r > best, lag, lag_at)
            best = np.maximum(best, r)
    put["auto"], put["auto_lag"] = best, lag_at / MAX_LAG
    # A list repeated as a whole: the agreement at the document's most frequent pair gap, however long (the shortest of equals).
    far = np.zeros(len(m), np.int64)
    held = pair > 0
    if held.any():
        width = int(pair.max()) + 1
        code, times = np.unique(wd[held] * width + pair[held], return_counts=True)
        of, gap = code // width, code % width
        order = np.lexsort((gap, -times, of))
        first = np.r_[True, of[order][1:] != of[order][:-1]]
        far[of[order][first]] = gap[order][first]
    back = np.arange(len(at)) - far[wd]
    ok = (far[wd] > 0) & (back >= 0)
    hit = np.zeros(len(at), bool)
    hit[ok] = (wk[ok] == wk[back[ok]]) & (wd[ok] == wd[back[ok]])
    put["auto_far"] = by(hit) / np.maximum(nw - far, 8)
    put["statement"] = total(weight * word) / words
    put["statement_share"] = total((weight < -1) & word) / words
    put["noun_share"] = total((weight > 0.3) & word) / words
    put["unknown"] = total((weight == 0) & word) / words
    put["upper"] = total(upper & word) / words
    row = np.maximum(np.array(lines)[has], 1)
    # Segments between sentence ends, line ends and menu separators: the share of words in those that state something.
    border = (kind == STOP) | (kind == BREAK) | ((kind == SEPARATOR) & np.isin(tok, [terms[c] for c in "»|→" if c in terms]))
    new_doc = np.zeros(len(tok), bool)
    new_doc[start] = True
    seg_of = np.cumsum(border | new_doc)
    said = np.bincount(seg_of, ((weight < -0.7) & word).astype(float))
    held = np.bincount(seg_of, word.astype(float))
    states = (held >= 4) & (said >= 0.15 * held) & (said >= 1)
    share = total(states[seg_of] & word) / words
    bad = put["link"] + put["tag"]
    put["segment_share"] = share
    put["over_half"] = 1 / (1 + np.exp(-16 * (bad - 0.5)))
    put["few_statements"] = 1 / (1 + np.exp(-16 * (0.5 - share)))
    put["repeat_half"] = put["gap2"] * put["few_statements"]
    put["line_words"] = np.minimum(words / row, 60) / 60
    put["long_lines"] = np.minimum(row, 100) / 100
    out[has] = np.stack([put[f] for f in FEATURES], 1)
    return out


def distinct_words(text: str | None) -> set[str]:
    """The words of a text behind its leading block, in the spelling they are counted by."""
    terms = _Terms({})
    return {tok.translate(LOOKALIKE).lower() for tok in set(TOKEN(body(text))) if terms.kind[terms[tok]] in (WORD, ODD)}


def log_odds(counts: dict[str, tuple[int, int]], spam: int, ok: int) -> dict[str, float]:
    """Log-odds of words by the number of (ok, spam) documents they are in; words of fewer than 4 documents have none."""
    return {w: float(np.log((b + 0.5) / (max(1, spam) + 1)) - np.log((a + 0.5) / (max(1, ok) + 1))) for w, (a, b) in counts.items() if a + b >= 4}


def word_weights(texts: list[str], spam: np.ndarray) -> dict[str, float]:
    """``log_odds`` of the words of labelled texts at hand."""
    count: dict[str, list[int]] = {}
    for t, y in zip(texts, spam):
        for w in distinct_words(t):
            count.setdefault(w, [0, 0])[int(y)] += 1
    return log_odds({w: (a, b) for w, (a, b) in count.items()}, int(spam.sum()), int((~spam).sum()))


def expand(x: np.ndarray) -> np.ndarray:
    """Features with squares of some and products that tell lists from long prose."""
    j = {f: i for i, f in enumerate(FEATURES)}
    c = lambda f: x[:, j[f]]
    more = [c("gap2") ** 2, c("gap2_short") * c("statement"), c("link") ** 2, c("statement") * c("words_per_stop"), c("statement_share") ** 2, c("gap2") * c("tokens"), c("gap1") * c("gap2"),
            c("separator") * c("statement"), c("number") * c("statement"), c("auto") * c("tokens"), np.minimum(c("link"), 0.5) * c("statement")]
    return np.column_stack([x, *more])


class Model:
    """Standardised logistic regression by Newton steps with a ridge; small, exact and repeatable."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -6, 6)])
        w = np.zeros(z.shape[1])
        pen = np.full(z.shape[1], ridge)
        pen[0] = 1e-6
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (y - p) - pen * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.w[0] + np.clip((x - self.mean) / self.scale, -6, 6) @ self.w[1:]


def fit(texts: list[str], spam: np.ndarray) -> tuple[dict[str, float], Model]:
    """Word weights and model; the model's word features come from the other half of the labels, so they aren't flattered."""
    half = np.arange(len(texts)) % 2 == 0
    x = np.zeros((len(texts), len(FEATURES)))
    for side in (half, ~half):
        if side.any():
            w = word_weights([t for t, s in zip(texts, ~side) if s], spam[~side])
            x[side] = features([t for t, s in zip(texts, side) if s], w)
    return word_weights(texts, spam), Model(expand(x), spam.astype(float))


def _fit_there(known: DataFrame) -> tuple[dict[str, float], Model] | None:
    """``fit`` on labelled documents ``(_id, _t, _y)`` where they lie; None if all labels are of one kind.

    The driver gets the counts of words that at least four documents have and one row of FEATURES a document, never a text. Half of
    the documents (by a hash of the id) are described by the words of the other half.
    """
    known = known.select(F.coalesce("_t", F.lit("")).alias("t"), (F.col("_y") == "spam").alias("y"), (F.pmod(F.xxhash64("_id"), F.lit(2)) == 0).alias("half"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, y, half in zip(*(c.to_pylist() for c in b.columns)):
                ws = sorted(distinct_words(t))
                yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array([y] * len(ws), pa.bool_()), pa.array([half] * len(ws), pa.bool_())], ["word", "y", "half"])

    sizes = {(r["half"], r["y"]): r["n"] for r in known.groupBy("half", "y").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    size = lambda half, y: sum(n for (h, k), n in sizes.items() if k == y and (half is None or h == half))
    if not size(None, True) or not size(None, False):
        return None
    n = lambda half, y: F.count_if((F.col("half") == half) & (F.col("y") == y)).alias(f"n{int(half)}{int(y)}")
    rows = (known.mapInArrow(spell, "word string, y boolean, half boolean").groupBy("word").agg(*[n(h, y) for h in (False, True) for y in (False, True)])
            .where("n00 + n01 + n10 + n11 >= 4").orderBy("word").collect())
    counts = lambda *halves: {r["word"]: tuple(sum(r[f"n{int(h)}{y}"] for h in halves) for y in (0, 1)) for r in rows}
    whole, *sides = (log_odds(counts(*hs), sum(size(h, True) for h in hs), sum(size(h, False) for h in hs)) for hs in ((False, True), (False,), (True,)))
    other = known.sparkSession.sparkContext.broadcast(sides)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ys, halves = (c.to_pylist() for c in b.columns)
            x = np.zeros((len(texts), len(FEATURES)))
            for side in (False, True):
                mine = [i for i, h in enumerate(halves) if h == side]
                if mine:
                    x[mine] = features([texts[i] for i in mine], other.value[not side])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.bool_()), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    got = known.mapInArrow(describe, "y boolean, x array<double>").collect()
    got.sort(key=lambda r: (r["y"], r["x"]))
    return whole, Model(expand(np.array([r["x"] for r in got])), np.array([r["y"] for r in got], float))


def spam_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", max_labels: int = MAX_LABELS) -> DataFrame:
    """Distinct ids of the documents that are mostly keywords, links or tags, with their ``score`` (above 0).

    Null, empty and one-word texts are never cases. Without any label of one of the two kinds there is nothing to learn
    from, and the result is empty. Repeated ids count once each text; extra columns are ignored.
    """
    named = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).where("_id IS NOT NULL AND _y IN ('spam', 'ok')").distinct()
    named = named.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_labels)
    known = cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(named), "_id"))
    fitted = _fit_there(known)
    release(known)
    if fitted is None:
        return docs.select(F.col(id_col), F.lit(0.0).alias("score")).where(F.lit(False))
    weights, model = fitted
    shared = docs.sparkSession.sparkContext.broadcast((weights, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, model = shared.value

        def done(ids: list, texts: list[str]) -> pa.RecordBatch:
            x = features(texts, weights)
            s = model.score(expand(x))
            for i in np.flatnonzero(x[:, 0] < np.log1p(12)):  # a text of at most one word is none
                s[i] = s[i] if len(body(texts[i]).split()) > 1 else -1.0
            keep = np.flatnonzero(s > 0)
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), pa.array(s[keep], pa.float64())], ["_id", "score"])

        ids, texts, chars = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py() or ""
                ids.append(i)
                texts.append(t)
                chars += len(t) + 64
                if chars > BATCH_CHARS:
                    yield done(ids, texts)
                    ids, texts, chars = [], [], 0
        if ids:
            yield done(ids, texts)

    found = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_t")).where("_t IS NOT NULL").mapInArrow(run, "_id bigint, score double")
    return found.groupBy(F.col("_id").alias(id_col)).agg(F.max("score").alias("score"))

"""Repair of text from scanned pages: running lines, cut words, misread characters, paragraphs.

Lines are labelled by linear-chain models over layout features: ``body`` or ``running`` first, then, along the body of
the whole report, ``whole`` or ``break`` (a word was cut at the line's end). Whether two pieces belong together, and whether
a word is a misreading of another, is judged by how often the forms occur in the whole corpus: each distinct form is
counted and compared with its likely misreadings once, and the verdicts are joined back to the reports that need them.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.chain import Chain
from lodestrata.session import cut, release

MAX_REVIEWED = 500
TOGETHER = 64
# What a scanned letter (or pair) is often read as, (read, printed).
MISREAD = [("c", "e"), ("e", "c"), ("ri", "n"), ("l", "i"), ("i", "l"), ("f", "t"), ("t", "f"), ("ſ", "s"), ("@", "a"), ("5", "s"), ("$", "s"), ("1", "i"), ("1", "l"), ("0", "o"), ("о", "o"), ("!", "i"),
           ("!", "l"), ("|", "l"), ("|", "i"), ("li", "h"), ("cl", "d"), ("ii", "u"), ("ii", "ü"), ("6", "b"), ("6", "é"), ("6", "ó"), ("8", "b"), ("9", "g"), ("q", "g"), ("g", "q"), ("rn", "m"), ("m", "rn"),
           ("m", "in"), ("in", "m"), ("v", "y"), ("y", "v"), ("ν", "v"), ("vv", "w"), ("b", "ß"), ("β", "ß"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("fi", "ñ"), ("fl", "ß"), ("h", "b"), ("b", "h"), ("n", "u"), ("u", "n"), ("а", "a"), ("е", "e"), ("с", "c"), ("р", "p"), ("nn", "m"), ("tl", "d"), ("ni", "m")]
MARKS = "-­=¬‐‑~_"
TOKEN = re.compile(r"[\w@!|$]+(?:['’][\w@!|$]+)*")
LETTER = regex.compile(r"\p{L}")
SPACE = regex.compile(r"\s+")
STARTS = ("flow", "para", "line")
ROMAN = re.compile(r"[ivxlc]+")
NUMBER = re.compile(r"\d+")
BANG = regex.compile(r"(?<=\p{L})!(?=[.,;:)])")
UPPERS = regex.compile(r"\p{Lu}+")
LOWERS = regex.compile(r"\p{Ll}+")
LAST_PIECE = re.compile(r"[\w@!|$]+$")
FIRST_PIECE = re.compile(r"[\w@!|$]+")
HYPHENATED = re.compile(r"(?<=\s)\w+-\w+(?=\s)")
OWN_HYPHEN = re.compile(r"\w[-‐]$")
CHUNK = re.compile(r"(\s*)(\S+)")
BULLET = regex.compile(r"(?:[-*•–·▪o]|\(?\w{1,2}[.)]|\d+[.)])\s")
ROW = regex.compile(r"[\p{L}_ ()-]+(?:\s+[\d.,%]+)+")
AS_DIGIT = regex.compile(r"(?<=^|[\s\[|/–-])(?=[\dlIO|]*\d|[lIO]\s*$)[\dlIO|]{1,4}(?=[\s\]|/–-]*$)|^\s*(?=[lIO|]*\d)[\dlIO|]{1,4}(?=\s{2,}|\s*$)")
DIGITS = str.maketrans("lI|O", "1110")
RUNS = re.compile(r"([xX9 ])\1+")
AT_NUMBER = frozenset("0123456789lIO|")
BEHIND_NUMBER = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "]|/–-"


def _no_bang(line: str) -> str:
    """An exclamation mark right before other punctuation is a misread letter, not punctuation."""
    return BANG.sub("|", line) if "!" in line else line


def words(line: str) -> list[str]:
    """Lower-case words of a line with the odd characters misreading brings, in order."""
    return list(_words(line))


@functools.lru_cache(maxsize=16384)
def _words(line: str) -> tuple[str, ...]:
    out = []
    for t in TOKEN.findall(_no_bang(line).lower()):
        if not t.isalpha():
            t = t.rstrip("!").strip("_")
            if not t or t == "|" or not LETTER.search(t):
                continue
        out.append(t)
    return tuple(out)


def _roman(s: str) -> int | None:
    if not ROMAN.fullmatch(s):
        return None
    v = [dict(i=1, v=5, x=10, l=50, c=100)[c] for c in s]
    return sum(-a if b > a else a for a, b in zip(v, [*v[1:], 0]))


def _digits(line: str) -> str:
    """The line with letters that stand for digits in a number at its start or end read as digits."""
    if line.lstrip()[:1] in AT_NUMBER or line.rstrip(BEHIND_NUMBER)[-1:] in AT_NUMBER:
        return AS_DIGIT.sub(lambda m: m[0].translate(DIGITS), line)
    return line


def _signature(line: str) -> str:
    return NUMBER.sub("9", " ".join(_digits(line).split()).casefold())


class _Classes(dict):
    """Characters -> what a line's shape shows of them."""

    def __missing__(self, c: int) -> int:
        kind = unicodedata.category(chr(c))
        self[c] = out = ord("x") if kind == "Ll" else ord("X") if kind == "Lu" else ord("9") if kind == "Nd" else ord(" ") if SPACE.fullmatch(chr(c)) else c
        return out


CLASSES = _Classes()


@functools.lru_cache(maxsize=4096)
def _pieces(signature: str, n: int) -> tuple[str, ...]:
    cuts = [len(signature) * i // n for i in range(n + 1)]
    return tuple(signature[a:b] for a, b in zip(cuts, cuts[1:]))


def _repeated(g: str, often: dict[int, list[str]]) -> str:
    """The repeated signature that ``g`` is a misreading of (``often`` by length), or ``g`` itself.

    Of two texts at most ``limit`` edits apart, one has a piece of the other's ``limit + 1`` unchanged: only then are the edits counted.
    """
    limit = max(1, len(g) // 6)
    for n in range(len(g) - 2, len(g) + 3):
        for o in often.get(n, ()):
            if any(x in g for x in _pieces(o, limit + 1)) and _distance(g, o, limit) <= limit:
                return o
    return g


def report_lines(pages: list[str | None] | None) -> list[tuple[int, int, str]]:
    """(page_no, line_no, text) of all lines; null pages have none."""
    return [(p, n, t) for p, page in enumerate(pages or [], 1) if page is not None for n, t in enumerate(page.split("\n"), 1)]


def layout_keys(lines: list[tuple[int, int, str]]) -> tuple[list[int], list[list[tuple]]]:
    """The positions of the non-blank lines and the keys of their layout features (``layout_names``); one sequence is one report."""
    at: list[int] = []
    pages: dict[int, list[int]] = {}
    full = [False] * len(lines)
    stripped: dict[int, tuple[str, str]] = {}
    sig: dict[int, str] = {}
    found: dict[int, list[str]] = {}
    times: dict[str, set[int]] = {}
    none: list[str] = []
    for i, (p, _, t) in enumerate(lines):
        s = t.strip()
        if not s:
            continue
        at.append(i)
        full[i] = True
        pages.setdefault(p, []).append(i)
        kinds = s.translate(CLASSES)
        stripped[i] = s, kinds
        d = _digits(t)
        g = " ".join(d.split()).casefold()
        if "9" in kinds or d is not t:
            found[i] = NUMBER.findall(d)
            g = NUMBER.sub("9", g)
        else:
            found[i] = none
        sig[i] = g
        times.setdefault(g, set()).add(p)
    # A running line that was misread on one page counts as the line it repeats.
    often: dict[int, list[str]] = {}
    for g, on in times.items():
        if len(on) > 1 and len(g) > 5:
            often.setdefault(len(g), []).append(g)
    if often:
        for i, g in sig.items():
            if len(g) > 5 and len(times[g]) < 2:
                sig[i] = _repeated(g, often)
    on_pages: dict[str, set[int]] = {}
    nums: dict[int, set[int]] = {}
    number: dict[int, int | None] = {}
    for i in at:
        p = lines[i][0]
        on_pages.setdefault(sig[i], set()).add(p)
        f = found[i]
        v = int(f[-1][:9]) if f and len(f) <= 3 else _roman(stripped[i][0].lower())
        number[i] = v
        if v is not None:
            nums.setdefault(v - p, set()).add(p)
        if len(f) > 1:
            nums.setdefault(int(f[0][:9]) - p, set()).add(p)
    bare: dict[str, set[int]] = {}
    bare_of = {g: g.strip("9 |-–/[].") for g in on_pages}
    for g, on in on_pages.items():
        bare.setdefault(bare_of[g], set()).update(on)
    width = max(float(np.median([len(lines[i][2]) for i in at])), 1) if at else 1.0
    n_pages = max(1, len(pages))
    share = lambda n: min(4, int(5 * n / n_pages)) if n > 1 else None
    often_is = {g: (share(len(on)), share(len(bare[bare_of[g]])), min(len(on), 5)) for g, on in on_pages.items()}
    few = min(n_pages, 4)
    out = []
    for p, own in pages.items():
        last = len(own) - 1
        for j, i in enumerate(own):
            t = lines[i][2]
            (s, kinds), k, (here, beyond, rep) = stripped[i], last - j, often_is[sig[i]]
            place = f"T{min(j, 4)}" if j <= k else f"B{min(k, 4)}"
            first, end = s[0], s[-1]
            gap_up = i == 0 or lines[i - 1][0] != p or not full[i - 1]
            gap_dn = i + 1 == len(lines) or lines[i + 1][0] != p or not full[i + 1]
            ws = _words(t)
            f = [("at", min(j, 4), min(k, 4), place, here, beyond, rep), ("sh", RUNS.sub(r"\1", kinds)[:24], place), ("form", min(6, int(len(t) / width * 4)), place, gap_up, gap_dn, min(3, (len(t) - len(t.lstrip())) // 2), "   " in s),
                 ("ends", end if not end.isalnum() else "a" if end.isalpha() else "9", "l" if first.islower() else "u" if first.isupper() else "9" if first.isdigit() else first, s.isupper(), few, place), ("words", min(8, len(ws)), place, rep > 1)]
            v = number[i]
            if v is not None:
                d = max(len(nums.get(v - p, ())), len(nums.get(int(found[i][0][:9]) - p, ())) if found[i] else 0)
                f.append(("num", min(d, 4), place, len(s) < 12, v == p, int(4 * d / n_pages) if n_pages > 1 else None))
            f += [("w", w) for w in ws[:3]]
            f += [("z", w) for w in ws[-2:]]
            out.append(f)
    return at, out


def layout_names(key: tuple) -> list[str]:
    """The named features behind a key of ``layout_keys``."""
    what, *x = key
    if what == "at":
        top, low, place, share, share2, rep = x
        a, b = ("none" if y is None else f"r{y}" for y in (share, share2))
        return [f"top{top}", f"low{low}", f"top{top}low{low}", f"rep{a}", f"rep{a}{place}", f"repb{b}{place}", f"n{rep}{place}"]
    if what == "sh":
        return [f"sh={x[0]}", f"sh={x[0]}{x[1]}"]
    if what == "form":
        size, place, up, down, indent, wide = x
        gap = f"gap{int(up)}{int(down)}"
        return [f"len{size}", f"len{size}{place}", gap, gap + place, f"ind{indent}", f"wide{wide}"]
    if what == "ends":
        end, begin, upper, n, place = x
        return [f"end{end}", f"beg{begin}", f"up{upper}", f"pages{n}{place}"]
    if what == "words":
        n, place, repeats = x
        return [f"words{n}{place}"] + ([f"W={n > 0}{place}"] if repeats else [])
    if what == "num":
        d, place, short, same, share = x
        short = "bare" if short else ""
        return [f"num{d}", f"num{d}{place}{short}", f"diff{'same' if same else 'off'}"] + ([] if share is None else [f"nshare{share}{place}{short}"])
    return [f"{what}={x[0]}"]


def cut_forms(left: str, right: str) -> tuple[str, str, str, str, str] | None:
    """(mark, joined, hyphenated, left piece, right piece) for a line's last and the next body line's first word."""
    s, r = left.rstrip(), right.lstrip()
    mark = s[-1] if s[-1:] in MARKS and s[-1:] else ""
    core = s[:-1] if mark else s
    a = LAST_PIECE.search(core.rsplit(None, 1)[-1]) if core and not core[-1].isspace() else None
    b = FIRST_PIECE.match(r)
    if not a or not b or not LETTER.search(a[0]) and not LETTER.search(b[0]):
        return None
    x, y = a[0].lower(), b[0].lower().rstrip("!")
    return mark, x + y, f"{x}-{y}", x, y


def break_keys(c: tuple[str, str, str, str, str] | None, here: str, right: str, seen: dict[str, tuple[int, str | None, int]], style: dict[str, int]) -> list[tuple]:
    if c is None:
        return [("none", here[-1:].isspace())]
    mark, joined, hyph, x, y = c

    def b(w: str) -> int:
        n, v, _ = seen.get(w, (0, None, 0))
        return min(6, (n + 1).bit_length() - 1) if n else -1 if not v else -2

    j, px, py = b(joined), b(x), b(y)
    return [("forms", mark, j, b(hyph), px, py), ("cut", mark, right.lstrip()[:1].islower(), min(4, style.get(mark, 0)), min(4, len(x)), min(4, len(y)), j > 0, right[:1].isspace(), here[-1:].isspace())]


def break_names(key: tuple) -> list[str]:
    """The named features behind a key of ``break_keys``."""
    what, *v = key
    if what == "none":
        return ["none", f"sp{v[0]}m"]
    if what == "forms":
        mark, j, h, px, py = v
        m, marked = mark or "0", f"m{bool(mark)}"
        return [f"m{m}", f"m{m}j{j}", f"m{m}h{h}", f"j{j}h{h}{marked}", f"m{m}x{px > 3}y{py > 3}j{j > 1}", f"x{px}{marked}", f"y{py}{marked}", f"j{j > 0}x{px > 0}y{py > 0}h{h > 0}{marked}"]
    mark, lower, style, left, right, known, indented, spaced = v
    m, marked = mark or "0", f"m{bool(mark)}"
    return [f"low{lower}{marked}", f"st{style}m{m}", f"len{left}{right}{marked}j{known}", f"tail{mark}{indented}", f"sp{spaced}m{mark}"]


def one_step(w: str, pairs: list[tuple[str, str]] = MISREAD) -> set[str]:
    """``w`` with one of the pairs' first parts replaced by the second, at any one place."""
    out = set()
    for a, b in pairs:
        i = w.find(a)
        while i >= 0:
            out.add(w[:i] + b + w[i + len(a):])
            i = w.find(a, i + 1)
    return out


def _is_odd(form: str) -> bool:
    return any(not c.isalpha() and c not in "'’" or c in "ſоνаесрﬁﬂ" for c in form)


def variants(form: str) -> list[str]:
    """Forms that ``form`` may be a misreading of: one of the misreadings undone, or up to two if it has several odd characters.

    Two steps of any other form are found in the middle (``judge``): what one step makes of the form is met by what one
    misreading makes of the words of the corpus.
    """
    first = one_step(form)
    odd = sum(not c.isalpha() or c in "ſоνаеср" for c in form)
    if odd > 1:
        first |= {v for w in list(first) for v in one_step(w)}
    first.discard(form)
    return sorted(first)


def squash(s: str) -> str:
    return SPACE.sub("", s)


def _distance(a: str, b: str, limit: int) -> int:
    """Edits between two texts, by bit vectors of the columns; anything above ``limit`` may come out as ``limit + 1``."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    a, b = a[n:], b[n:]
    if not a or not b:
        return max(len(a), len(b))
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for c in b:
        eq = at.get(c, 0)
        flat = (((eq & up) + up) ^ up) | eq
        more, less = down | full & ~(flat | up), up & flat
        score += bool(more & top) - bool(less & top)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(eq | down | more)) & full, more & (eq | down) & full
    return score


def reviewed_labels(lines: list[tuple[int, int, str]], expected: list[str | None]) -> list[tuple[str, bool, bool, str]] | None:
    """(body | running | blank, cut at its end, misread, how it begins: para | line | flow) of each line, by following the reviewed text; None if it can't be."""
    text = "\n\n".join(p or "" for p in expected)
    want, bounds = squash(text), {0: "para"}
    n = 0
    for m in CHUNK.finditer(text):
        if m[1] and n:
            bounds[n] = "para" if m[1].count("\n") > 1 else "line" if "\n" in m[1] else "flow"
        n += len(m[2])
    pos, out = 0, []
    for _, _, t in lines:
        s = squash(t)
        if not s:
            out.append(("blank", False, False, "flow"))
            continue
        best = None
        for cand, lost in ((s, 0), (s[:-1], 1)):
            if not cand or lost and s[-1] not in MARKS:
                continue
            if want.startswith(cand, pos):
                best = best if best and best[0] == 0 else (0, len(cand))
                continue
            if best and best[0] == 0:
                continue
            limit = max(1, len(cand) // 6) if len(cand) > 3 else 0
            near = want[max(0, pos - 2):pos + len(cand) + 5]
            grams = [cand[i:i + 3] for i in range(0, max(1, len(cand) - 2))]
            if not limit or sum(g in near for g in grams) < 0.3 * len(grams):
                continue
            for d in sorted(range(-4, 5), key=abs):
                k = len(cand) + d
                if k > 0 and pos + k <= len(want):
                    e = _distance(cand, want[pos:pos + k], min(limit, best[0] - 1 if best else limit))
                    if e <= limit and (best is None or e < best[0]):
                        best = (e, k)
        if best is None:
            out.append(("running", False, False, "flow"))
            continue
        begins = bounds.get(pos, "flow")
        pos += best[1]
        own = bool(OWN_HYPHEN.search(s)) and want[pos - 1:pos] == s[-1]
        out.append(("body", pos < len(want) and pos not in bounds and not own, best[0] > 0, begins))
    return out if pos == len(want) else None


def fit_running(rows: list[tuple[list, list]]) -> Chain | None:
    seqs, gold = [], []
    for raw, exp in rows:
        ls = report_lines(raw)
        y = reviewed_labels(ls, exp)
        if y is None:
            continue
        at, f = layout_keys(ls)
        if f:
            seqs.append(f)
            gold.append([int(y[i][0] == "running") for i in at])
    return Chain(("body", "running"), layout_names, epochs=10).fit(seqs, gold) if seqs else None


def bodies_of(reports: list[list[tuple[int, int, str]]], model: Chain | None) -> list[tuple[list[int], list[int]]]:
    """Positions of the body lines and of the running lines of each report; the reports are decoded side by side."""
    made = [layout_keys(ls) for ls in reports]
    if model is None:
        return [(at, []) for at, _ in made]
    return [([i for i, k in zip(at, y) if not k], [i for i, k in zip(at, y) if k]) for (at, _), y in zip(made, model.decode([f for _, f in made]))]


def looked_up(lines: list[tuple[int, int, str]], body: list[int]) -> tuple[dict[str, int], set[str]]:
    """Words inside the body's lines with their numbers, and the forms needed at line ends."""
    inner: dict[str, int] = {}
    forms: set[str] = set()
    for k, i in enumerate(body):
        t = lines[i][2]
        ws = _words(t)
        for w in ws[1:-1]:
            inner[w] = inner.get(w, 0) + 1
        for m in HYPHENATED.findall(t) if "-" in t else ():
            inner[m.lower()] = inner.get(m.lower(), 0) + 1
        for w in {*ws[:1], *ws[-1:]}:
            forms.add(w)
        if k + 1 < len(body):
            c = cut_forms(t, lines[body[k + 1]][2])
            if c:
                forms |= set(c[1:])
    return inner, forms


def break_sequence(lines, body, seen) -> list[list[tuple]]:
    cuts = [cut_forms(lines[i][2], lines[body[k + 1]][2]) if k + 1 < len(body) else None for k, i in enumerate(body)]
    style: dict[str, int] = {}
    for c in cuts:
        if c and c[0] and seen.get(c[1], (0, None, 0))[0] > 2:
            style[c[0]] = style.get(c[0], 0) + 1
        elif c and not c[0] and seen.get(c[1], (0, None, 0))[0] > 2 and seen.get(c[3], (0, None, 0))[0] == 0:
            style[""] = style.get("", 0) + 1
    return [break_keys(c, lines[i][2], lines[body[k + 1]][2] if k + 1 < len(body) else "", seen, style) for k, (i, c) in enumerate(zip(body, cuts))]


def is_misread(seen: dict[str, tuple[int, str | None, int]], w: str) -> str | None:
    """The printed form if ``w`` is a misreading, by the corpus's counts."""
    n, v, m = seen.get(w, (0, None, 0))
    if v is None:
        return None
    odd = _is_odd(w)
    return v if m >= (2 if odd else 3) and m >= (2 if odd else 12) * max(n, 0.34) else None


def broken_ends(reports: list[tuple[list, list[int], dict]], breaks: Chain | None) -> list[list[bool]]:
    """Per body line of each (lines, body, seen): was a word cut at its end? Never at a report's last one."""
    if breaks is None:
        out = [[bool(cut_forms(lines[i][2], "x")) and lines[i][2].rstrip()[-1:] in MARKS for i in body] for lines, body, _ in reports]
    else:
        out = [[bool(x) for x in y] for y in breaks.decode([break_sequence(*r) for r in reports])]
    for y in out:
        if y:
            y[-1] = False
    return out


def verdicts(seen: pa.ListArray) -> list[dict[str, tuple[int, str | None, int]]]:
    """What is known of each report's forms: form -> (count, variant, the variant's count); a null list gives an empty dict."""
    part = seen.flatten()
    forms, *known = (part.field(k).to_pylist() for k in ("form", "n", "variant", "vn"))
    pairs, out, at = list(zip(forms, zip(*known))), [], 0
    for n in seen.value_lengths().to_pylist():
        out.append(dict(pairs[at:at + (n or 0)]))
        at += n or 0
    return out


def findings(lines, body, running, broken: list[bool], seen) -> tuple[list[tuple[int, str]], dict[tuple[int, int], str]]:
    """(line position, kind) of every defect; the printed words by (line, word)."""
    out = [(i, "running") for i in running]
    fixed: dict[tuple[int, int], str] = {}
    wrong = {w: v for w in seen if (v := is_misread(seen, w))}
    for k, i in enumerate(body):
        t = lines[i][2]
        low = t.lower().replace("!", "|")
        ws = _words(t) if broken[k] or len(wrong) > 8 or any(w.replace("!", "|") in low for w in wrong) else ()
        for j, w in enumerate(() if wrong.keys().isdisjoint(ws) else ws):
            if j == len(ws) - 1 and broken[k] or j == 0 and k and broken[k - 1]:
                continue
            v = wrong.get(w)
            if v:
                fixed[i, j] = v
        if broken[k]:
            out.append((i, "broken"))
            c = cut_forms(t, lines[body[k + 1]][2])
            v = is_misread(seen, c[1]) if c else None
            if v:
                x, y = c[3], c[4]
                if not v.startswith(x):
                    # The left piece, if what follows still ends as the right piece does.
                    fixed[i, len(ws) - 1] = v[:len(v) - len(y)] if v.endswith(y) else v[:len(x)]
                if not v.endswith(y):
                    fixed[body[k + 1], 0] = v[len(x):] if v.startswith(x) else v[-len(y):]
    out += [(i, "misread") for i in sorted({i for i, _ in fixed})]
    return out, fixed


def start_features(lines, body) -> list[list[str]]:
    """Layout features of how each body line begins: a paragraph, a line of its own (list, table), or running text."""
    width = max((len(lines[i][2].rstrip()) for i in body), default=1)
    lens = sorted(len(lines[i][2].rstrip()) for i in body)
    wrap = lens[int(0.9 * (len(lens) - 1))] if lens else 1
    indents = [len(lines[i][2]) - len(lines[i][2].lstrip()) for i in body]
    usual = sorted(indents)[len(indents) // 2] if indents else 0
    rows = []
    for k, i in enumerate(body):
        p, _, t = lines[i]
        s = t.strip()
        kind = "b" if BULLET.match(s) else "#" if ROW.fullmatch(s) else "9" if s[:1].isdigit() and len(s) < 12 else "u" if s[:1].isupper() else "l" if s[:1].islower() else "o"
        rows.append((p, t, s, kind))
    out = []
    for k, i in enumerate(body):
        p, t, s, kind = rows[k]
        f = [f"k{kind}", f"ind{min(2, max(-1, indents[k] - usual))}", f"len{min(5, int(5 * len(s) / max(1, wrap)))}k{kind}"]
        if k:
            pp, pt, ps, pk = rows[k - 1]
            gap = p != pp or any(not lines[x][2].strip() for x in range(body[k - 1] + 1, i))
            first = s.split(" ", 1)[0]
            fits = len(pt.rstrip()) + 1 + len(first) <= wrap
            slack = min(4, max(-1, (wrap - len(pt.rstrip()) - 1 - len(first)) // 4))
            e = ps[-1:] if not ps[-1:].isalnum() else "a"
            page = p != pp
            f += [f"gap{gap}pg{page}", f"fits{fits}", f"fits{fits}e{e in '.!?'}k{kind}pg{page}", f"sl{slack}e{e in '.!?'}k{kind}", f"pk{pk}k{kind}", f"pk{pk}k{kind}fits{fits}", f"e{e}", f"e{e in '.!?'}k{kind}gap{gap}pg{page}",
                  f"dind{min(2, max(-2, indents[k] - indents[k - 1]))}k{kind}", f"plen{min(5, int(5 * len(ps) / max(1, wrap)))}e{e in '.!?'}k{kind}", f"gap{gap}k{kind}pk{pk}", f"wide{min(3, width // 40)}"]
        else:
            f.append("first")
        if k + 1 < len(body):
            f += [f"nk{rows[k + 1][3]}k{kind}", f"nlen{min(5, int(5 * len(rows[k + 1][2]) / max(1, wrap)))}"]
        out.append(f)
    # Does the report leave blank lines between paragraphs, indent them, or neither?
    gaps = sum(any(x.startswith("gapTruepgFalse") for x in f) for f in out)
    style = f"G{min(3, int(20 * gaps / max(1, len(out))))}I{min(3, int(20 * sum(x > usual for x in indents) / max(1, len(out))))}"
    return [f + [style] + [style + x for x in f if x.startswith(("gap", "ind", "fits", "sl", "dind", "e"))] for f in out]


def reassemble(lines, body, broken, fixed, starts: list[str]) -> dict[int, str]:
    """The repaired text of each page: paragraphs on one line each, an empty line between; list lines keep their own line.

    A word cut at a page's end stands on the page where it starts.
    """
    pages: dict[int, list[tuple[str, str]]] = {p: [] for p, _, _ in lines}
    carry = False
    for k, i in enumerate(body):
        p, _, t = lines[i]
        s = t.strip()
        if any(a == i for a, _ in fixed):
            n = -1
            def put(m):
                nonlocal n
                w = m[0].rstrip("!").strip("_")
                if not w or w == "|" or not LETTER.search(w):
                    return m[0]
                n += 1
                v = fixed.get((i, n))
                if v is None:
                    return m[0]
                v = v.upper() if len(w) > 2 and w.isupper() else v[:1].upper() + v[1:] if w[:1].isupper() else v
                return m[0].replace(w, v, 1)
            s = TOKEN.sub(put, _no_bang(s))
        if broken[k]:
            s = s[:-1] if s[-1:] in MARKS else s
        elif s[-1:] == "\xad":
            s = s[:-1]
        if carry:
            head, _, rest = s.partition(" ")
            last = next(q for q in sorted(pages, reverse=True) if q <= p and pages[q])
            mode, txt = pages[last][-1]
            if last == p:
                pages[p][-1] = (mode, txt + s)
            else:
                pages[last][-1] = (mode, txt + head)
                if rest:
                    pages[p].append(("para", rest.strip()))
        elif starts[k] == "flow" and pages[p]:
            mode, txt = pages[p][-1]
            hyphen = bool(OWN_HYPHEN.search(txt)) and s[:1].isalnum()
            pages[p][-1] = (mode, txt + ("" if hyphen else " ") + s)
        else:
            pages[p].append((starts[k] if pages[p] else "para", s))
        carry = broken[k]
    out = {}
    for p, parts in pages.items():
        text = ""
        for mode, t in parts:
            text += ("" if not text else "\n" if mode == "line" else "\n\n") + t
        out[p] = text
    return out


def report_frame(reports: DataFrame, id_col: str, raw: str, expected: str) -> DataFrame:
    src = reports.select(F.col(id_col).cast("string").alias("id"), F.col(raw).alias("raw"), F.col(expected).alias("exp")).where("id IS NOT NULL AND raw IS NOT NULL")
    return src.groupBy("id", F.xxhash64("raw").alias("h")).agg(F.max(F.struct("exp", "raw")).alias("m")).select("id", "h", "m.raw", "m.exp")


def judge(reports: DataFrame, *, id_col: str = "id", raw: str = "raw_pages", expected: str = "expected_pages", max_reviewed: int = MAX_REVIEWED, repair: bool = True) -> DataFrame:
    """Every line's verdict and, with ``repair``, every page's repaired text.

    Columns: ``id``, ``page_no``, ``line_no``, ``kind`` (running | broken | misread, null for the page row) and ``text`` (the
    repaired page, only in the page row). Rows delivered twice count once. Null ids and null reports give nothing, null
    pages no lines. Without reviewed reports nothing is learned: no line is running, and a mark at a line's end cuts.
    """
    spark = reports.sparkSession
    once = cut(report_frame(reports, id_col, raw, expected))
    sample = once.where("exp IS NOT NULL").orderBy(F.xxhash64("id"), "id", "h").limit(max_reviewed).select("id", "h", "raw", "exp").collect()
    model = fit_running([(r["raw"], r["exp"]) for r in sample])
    shared = spark.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for a in range(0, b.num_rows, TOGETHER):
                reports = [report_lines(pages) for pages in b.column(2).slice(a, TOGETHER).to_pylist()]
                for ls, (body, running) in zip(reports, bodies_of(reports, model)):
                    inner, forms = looked_up(ls, body)
                    for c, x in zip(cols, (body, running, list(inner), list(inner.values()), sorted(forms))):
                        c.append(x)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.list_(k)) for c, k in zip(cols, kinds))], ["id", "h", "body", "running", "words", "counts", "forms"])

    lines = cut(once.select("id", "h", "raw").mapInArrow(label, "id string, h bigint, body array<int>, running array<int>, words array<string>, counts array<bigint>, forms array<string>"))
    counted = cut(lines.select(F.explode(F.arrays_zip("words", "counts")).alias("z")).groupBy(F.col("z.words").alias("form")).agg(F.sum("z.counts").alias("n")))
    needed = counted.select("form").unionByName(lines.select(F.explode("forms").alias("form")).distinct()).distinct()

    def undo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = b.column(0).to_pylist()
            made = [variants(f) for f in forms]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, v in zip(forms, made) for _ in v], pa.string()), pa.array([x for v in made for x in v], pa.string())], ["form", "variant"])

    best = (needed.mapInArrow(undo, "form string, variant string").join(counted.select(F.col("form").alias("variant"), "n"), "variant")
            .groupBy("form").agg(F.max(F.struct("n", "variant")).alias("b")).select("form", F.col("b.variant").alias("variant"), F.col("b.n").alias("vn")))
    known = single = cut(counted.join(best, "form", "full").select("form", F.coalesce("n", F.lit(0)).alias("n"), "variant", F.coalesce("vn", F.lit(0)).alias("vn")))
    # Forms that no such variant explains: two steps, met in the middle, that explain them by the same measure (``is_misread``).
    def unread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, n, _is_odd(f), w) for f, n, v, m in zip(*(c.to_pylist() for c in b.columns)) if not is_misread({f: (n, v, m)}, f) for w in sorted(one_step(f))]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.bool_(), pa.string()))], ["form", "n", "odd", "middle"])

    def misread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(v, m, w) for v, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in sorted(one_step(v, [(y, x) for x, y in MISREAD]))]
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string()))], ["variant", "vn", "middle"])

    left = needed.join(known, "form", "left").select("form", F.coalesce("n", F.lit(0)).alias("n"), "variant", F.coalesce("vn", F.lit(0)).alias("vn"))
    twice = (left.mapInArrow(unread, "form string, n bigint, odd boolean, middle string")
             .join(counted.where("n >= 2").mapInArrow(misread, "variant string, vn bigint, middle string"), "middle")
             .where("variant <> form AND vn >= IF(odd, 2, 3) AND vn >= IF(odd, 2, 12) * greatest(n, 0.34D)")
             .groupBy("form").agg(F.max("n").alias("n2"), F.max(F.struct("vn", "variant")).alias("b")))
    known = cut(known.join(twice, "form", "full").select("form", F.coalesce("n", "n2").alias("n"), F.coalesce("b.variant", "variant").alias("variant"), F.coalesce("b.vn", "vn").alias("vn")))
    # Of the words inside lines only suspects go back to their reports; of the forms at line ends all that are known.
    suspects = known.where("vn >= 2 AND vn >= 2 * n")
    back = (lines.select("id", "h", F.explode("words").alias("form")).join(suspects, "form")
            .unionByName(lines.select("id", "h", F.explode("forms").alias("form")).join(known, "form"))
            .groupBy("id", "h").agg(F.collect_set(F.struct("form", "n", "variant", "vn")).alias("seen")))
    ready = cut(once.select("id", "h", "raw").join(lines.select("id", "h", "body", "running"), ["id", "h"]).join(back, ["id", "h"], "left"))
    release(lines, once, counted, single, known)

    picked = {(r["id"], r["h"]): r["exp"] for r in sample}
    keys = spark.createDataFrame(list(picked) or [("", 0)], "id string, h bigint")
    seqs, gold, begin, begun = [], [], [], []
    for r in ready.join(F.broadcast(keys), ["id", "h"], "left_semi").orderBy("id", "h").collect():
        ls = report_lines(r["raw"])
        y = reviewed_labels(ls, picked[r["id"], r["h"]])
        if y is None or not r["body"]:
            continue
        seen = {s["form"]: (s["n"], s["variant"], s["vn"]) for s in r["seen"] or []}
        seqs.append(break_sequence(ls, r["body"], seen))
        gold.append([int(y[i][1]) for i in r["body"]])
        if repair:
            begin.append(start_features(ls, r["body"]))
            begun.append([STARTS.index(y[i][3]) for i in r["body"]])
    breaks = Chain(("whole", "break"), break_names, epochs=10).fit(seqs, gold) if seqs else None
    starts = Chain(STARTS, epochs=10).fit(begin, begun) if begin else None
    learned = spark.sparkContext.broadcast((breaks, starts))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaks, starts = learned.value
        for b in batches:
            rows = []
            for a in range(0, b.num_rows, TOGETHER):
                ids, _, pages, bodies, runnings = (b.column(c).slice(a, TOGETHER).to_pylist() for c in range(5))
                made = [(report_lines(p), body, seen) for p, body, seen in zip(pages, bodies, verdicts(b.column(5).slice(a, TOGETHER)))]
                ends = broken_ends(made, breaks)
                begins = starts.decode([start_features(ls, body) for ls, body, _ in made]) if starts else [np.ones(len(body), int) for body in bodies]
                for id_, (ls, body, seen), running, broken, how in zip(ids, made, runnings, ends, begins):
                    out, fixed = findings(ls, body, running, broken, seen)
                    rows += [(id_, ls[k][0], ls[k][1], kind, None) for k, kind in out]
                    if repair:
                        rows += [(id_, p, None, None, t) for p, t in reassemble(ls, body, broken, fixed, [STARTS[k] for k in how]).items()]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))], ["id", "page_no", "line_no", "kind", "text"])

    return ready.select("id", "h", "raw", "body", "running", "seen").mapInArrow(find, "id string, page_no int, line_no int, kind string, text string")


def defects(judged: DataFrame) -> DataFrame:
    """``id, page_no, line_no, kind`` of every line with a defect."""
    return judged.where("kind IS NOT NULL").select("id", "page_no", "line_no", "kind").distinct()


def repaired(judged: DataFrame) -> DataFrame:
    """``id, page_no, text``: every page's text in continuous paragraphs."""
    return judged.where("kind IS NULL").select("id", "page_no", "text")

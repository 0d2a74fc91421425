"""The learned operators: rules on small fixtures, and accuracy on labels that were held out."""

import os
import random

import numpy as np
import pytest

from lodestrata.llm import main_content as M
from lodestrata.llm import scanned as S
from lodestrata.llm import spam as K
from lodestrata.llm.chain import Chain

D = "/root/testdata/sf0.1"
tables = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def read(name, *cols):
    import pyarrow.parquet as pq

    return pq.read_table(f"{D}/{name}.parquet", columns=list(cols)).to_pylist()


def test_chain_learns_transitions():
    rng = random.Random(1)
    seqs, gold = [], []
    for _ in range(120):
        y = [0]
        for _ in range(rng.randrange(3, 12)):
            y.append(y[-1] if rng.random() < 0.9 else 1 - y[-1])
        seqs.append([[f"x{v if rng.random() < 0.8 else 1 - v}"] for v in y])
        gold.append(y)
    c = Chain(("a", "b"), min_count=1).fit(seqs[:90], gold[:90])
    got = c.decode([*seqs[90:], []])
    acc = np.mean([a == b for p, q in zip(got, gold[90:]) for a, b in zip(p, q)])
    plain = np.mean([int(f[0][1]) == b for s, q in zip(seqs[90:], gold[90:]) for f, b in zip(s, q)])
    assert acc > plain and len(got[-1]) == 0


# Main content


def test_paragraphs():
    assert M.paragraphs(None) == [] and M.paragraphs(" \n\t\n") == [] and M.paragraphs("\n\na\r\n \t\r\nb\nc\n\n\n d\n") == ["a", "b\nc", " d"]
    assert M.reviewed_labels(["a", "x", "b "], "a\n\nb") == [1, 0, 1] and M.reviewed_labels(["a"], "q") is None and M.reviewed_labels(["a"], "") == [0]
    d = [M.density(x)[0] for x in ("A long sentence that has no links at all and goes on for a while.", "Home | About | Contact", "Share")]
    assert d[0] > 50 and d[1] == d[2] == 0


@tables
def test_main_content_on_held_out_pages():
    rows = {r["id"]: r for r in read("article_chrome_cases", "id", "raw_content", "expected_content") if r["expected_content"] is not None}
    rows = [rows[k] for k in sorted(rows)]
    model = M.fit([(r["raw_content"], r["expected_content"]) for r in rows[::2]])
    tp = fp = fn = 0
    for r in rows[1::2]:
        ps = M.paragraphs(r["raw_content"])
        for a, b in zip(M.reviewed_labels(ps, r["expected_content"]), M.Labeller(model).labels([ps])[0] if ps else []):
            tp, fp, fn = tp + (not a and not b), fp + (a and not b), fn + (not a and b)
    assert tp / (tp + fp) > 0.985 and tp / (tp + fn) > 0.985


def test_main_content_odd_rows(spark):
    schema = "id string, raw_content string, expected_content string, para int, h string"
    body = "This is a sentence of some length. It is followed by another one."
    rows = [("a", f"Menu\n\n{body}", body, 1, "x"), ("a", f"Menu\n\n{body}", body, 1, "x"), ("b", None, None, 1, "x"), ("c", "", "", 1, "x"), (None, "x", None, 1, "x"), ("d", "one\n\ntwo", None, 1, "x")]
    got = M.label_paragraphs(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["id"], r["para_no"]) for r in got) == [("a", 1), ("a", 2), ("d", 1), ("d", 2)]
    assert M.label_paragraphs(spark.createDataFrame([], schema)).count() == 0
    bare = M.label_paragraphs(spark.createDataFrame([("d", f"Menu\n\n{body}", None, 1, "x")], schema))
    assert [r["is_main"] for r in bare.orderBy("para_no").collect()] == [False, True] and M.main_text(bare).first()["content"] == body


def test_words_in_the_middle_of_a_paragraph_count():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    par = lambda mark: " ".join([*words[:30], *mark, *words[30:]])
    f = [n for k in M.page_keys([par(["cookie", "policy"])])[0] for n in M.expand(k)]
    assert "w=cookie" in f and "b=cookie policy" in f
    pages = [([par(["plain", "text"]), par(["cookie", "policy"])], [1, 0]) if k % 2 else ([par(["cookie", "policy"]), par(["plain", "text"])], [0, 1]) for k in range(120)]
    rows = [("\n\n".join(ps), ps[y.index(1)]) for ps, y in pages]
    model = M.fit(rows[:80])
    got = M.Labeller(model).labels([ps for ps, _ in pages[80:]])
    assert [list(x) for x in got] == [list(x) for x in model.decode([M.page_keys(ps) for ps, _ in pages[80:]])]
    assert np.mean([list(g) == y for g, (_, y) in zip(got, pages[80:])]) == 1


def test_density_alone():
    long = "This is a sentence of some length. It is followed by another one that is no shorter than it."
    assert M.body_run([]) == (0, -1, 0.0) and M.body_run([0, 0]) == (0, -1, 0.0) and M.body_run([0, 90, 40, 90, 0])[:2] == (1, 3)
    assert M.dense_labels(["Home | About | Blog", long, "Heading", long, "Share", "Privacy | Terms"]) == [0, 1, 0, 1, 0, 0] and M.dense_labels([]) == []


# Scanned pages


def test_line_rules():
    assert S.words("Me!stens l0cal (x) 12 | don't!") == ["me!stens", "l0cal", "x", "don't"] and S._roman("xiv") == 14 and S._roman("abc") is None
    assert "meistens" in S.variants("me!stens") and "modern" in S.variants("modem") and "schedule" in S.variants("schedu1e")
    assert S._signature("Report 2024 | l2") == S._signature("Report 2024 | 13") == "report 9 | 9" and S._digits("the l end") == "the l end"
    assert S.cut_forms("the inc=", "remental x") == ("=", "incremental", "inc-remental", "inc", "remental") and S.cut_forms("end.", "x") is None and S.cut_forms("12-", "13") is None
    raw = [["Head 1", "the inc-", "remental cachc", "1"], ["Head 1", "well-", "known"]]
    lines = S.report_lines(["\n".join(p) for p in raw])
    got = S.reviewed_labels(lines, ["the incremental cache", "well-known"])
    assert [g[:3] for g in got] == [("running", False, False), ("body", True, False), ("body", False, True), ("running", False, False), ("running", False, False), ("body", False, False), ("body", False, False)]
    assert S.report_lines(None) == [] and S.report_lines([None, ""]) == [(2, 1, "")]


def deep_report(seed):
    rng = random.Random(seed)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(7))
    raw, want, at = [], [], []
    for p in range(6):
        body = [line() for _ in range(16)]
        raw.append("\n".join([*body[:7], f"Quarterly inventory {seed} page {p + 1}", *body[7:]]))
        want.append(" ".join(body))
        at.append((p + 1, 8))
    return raw, want, at


def test_running_lines_deep_in_the_page():
    f = [[n for k in keys for n in S.layout_names(k)] for keys in S.layout_keys(S.report_lines(deep_report(1)[0]))[1]]
    assert "repr4" in f[7] and "repnone" in f[6] and any(x.startswith("w=") for x in f[6])  # lines inside a page are read as those at its edges
    model = S.fit_running([deep_report(k)[:2] for k in range(2, 22)])
    ls = S.report_lines(deep_report(1)[0])
    assert [ls[i][:2] for i in S.bodies_of([ls], model)[0][1]] == deep_report(1)[2]


def test_edits_and_repeated_lines():
    def plain(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
            prev = cur
        return prev[-1]

    rng = random.Random(4)
    often: dict[int, list[str]] = {}
    for _ in range(30):
        g = "".join(rng.choice("abcd 9") for _ in range(rng.randrange(6, 40)))
        often.setdefault(len(g), []).append(g)
    all_often = [g for n in sorted(often) for g in often[n]]
    for _ in range(400):
        g = list(rng.choice(all_often))
        for _ in range(rng.randrange(0, 8)):
            k = rng.randrange(len(g))
            g[k:k + rng.randrange(2)] = rng.choice(["", "a", "9", "xy"])
            g = g or ["a"]
        g = "".join(g)
        o = rng.choice(all_often)
        n = plain(g, o)
        assert min(S._distance(g, o, 100), 101) == min(n, 101) and (S._distance(g, o, 3) > 3) == (n > 3)
        near = [o for o in all_often if abs(len(o) - len(g)) <= 2 and plain(g, o) <= max(1, len(g) // 6)]
        assert S._repeated(g, often) == (near[0] if near else g)


@tables
def test_scanned_pages_on_held_out_reports(spark):
    src = spark.read.parquet(f"{D}/dora_regression_cases.parquet")
    judged = S.judge(src, max_reviewed=100)
    rows = judged.collect()
    found, pages = {}, {}
    for r in rows:
        if r["kind"]:
            found.setdefault(r["id"], set()).add((r["page_no"], r["line_no"], r["kind"]))
        else:
            pages[r["id"], r["page_no"]] = r["text"]
    used = {r["id"] for r in S.report_frame(src, "id", "raw_pages", "expected_pages").where("exp IS NOT NULL").orderBy(S.F.xxhash64("id"), "id", "h").limit(100).collect()}
    n = {k: [0, 0, 0] for k in ("running", "broken", "misread")}
    exact = total = 0
    for r in {r["id"]: r for r in src.where("expected_pages IS NOT NULL AND raw_pages IS NOT NULL").collect() if r["id"] not in used}.values():
        ls = S.report_lines(r["raw_pages"])
        y = S.reviewed_labels(ls, r["expected_pages"])
        if y is None:
            continue
        want = {(p, k, kind) for (p, k, _), (lab, cut, mis, _) in zip(ls, y) for kind, on in (("running", lab == "running"), ("broken", cut), ("misread", mis)) if on}
        got = found.get(r["id"], set())
        for kind, c in n.items():
            a, b = {x for x in got if x[2] == kind}, {x for x in want if x[2] == kind}
            c[0], c[1], c[2] = c[0] + len(a & b), c[1] + len(a - b), c[2] + len(b - a)
        for p, text in enumerate(r["expected_pages"], 1):
            if r["raw_pages"][p - 1] is not None:
                total, exact = total + 1, exact + (pages.get((r["id"], p), "") == (text or ""))
    for kind, (tp, fp, fn) in n.items():
        assert tp / (tp + fp) > 0.98 and tp / (tp + fn) > 0.98, (kind, tp, fp, fn)
    assert exact / total > 0.85


def test_scanned_odd_rows(spark):
    schema = "id string, raw_pages array<string>, expected_pages array<string>, form string, n int"
    rows = [("a", ["The stable index.\n1", None, ""], None, "x", 1), ("a", ["The stable index.\n1", None, ""], None, "x", 1), ("b", None, None, "x", 1), ("c", [], None, "x", 1), (None, ["x"], None, "x", 1), ("d", ["cut wo-\nrd here"], None, "x", 1)]
    j = S.judge(spark.createDataFrame(rows, schema))
    assert {tuple(r) for r in S.defects(j).collect()} == {("d", 1, 1, "broken")}
    assert {(r["id"], r["page_no"]): r["text"] for r in S.repaired(j).collect()}[("d", 1)] == "cut word here"
    assert S.judge(spark.createDataFrame([], schema)).count() == 0


def test_two_misreadings_in_a_word(spark):
    many = [("a%d" % k, ["we keep the inventory schedule here today"], None) for k in range(30)]
    rows = [*many, ("x", ["we keep the invcntorv here today"], None), ("y", ["we keep the schcdu1e here today"], None), ("z", ["we keep the sundry here today"], None)]
    j = S.judge(spark.createDataFrame(rows, "id string, raw_pages array<string>, expected_pages array<string>"))
    assert {tuple(r) for r in S.defects(j).collect()} == {("x", 1, 1, "misread"), ("y", 1, 1, "misread")}
    assert {r["id"]: r["text"] for r in S.repaired(j).collect() if r["id"] in "xy"} == {"x": "we keep the inventory here today", "y": "we keep the schedule here today"}
    far = "l0!1|5$8" * 3
    assert {w for v in S.one_step(far) for w in S.one_step(v)} - {far} <= set(S.variants(far))


# Spam


def test_spam_features():
    text = "best tool cheap tool " * 10
    x = K.features([text, "", "One plain sentence follows another here, and none of its words return at even gaps.", "- [a b](https://x.example/1)\n" * 9], {})
    f = lambda i, name: x[i, K.FEATURES.index(name)]
    assert f(0, "gap2") > 0.7 and f(0, "auto") > 0.9 and f(2, "gap2") == 0 and f(3, "link") > 0.5 and not x[1].any()
    assert K.body("# T\n\n## Metadata\n- source: x\n- id: y\n\n## Content\n\nbody") == "body" and K.body("T\n\nstate: open\nlabels: a, b\n\nbody") == "body" and K.body(None) == ""
    t = K._Terms({})
    assert t.key[t["wоrkspаcе"]] == t.key[t["workspace"]] == t.key[t["workspac3"]] == t.key[t["WORKSPACE"]]


def test_body_behind_blocks_of_any_length_and_line_end():
    for n in (2, 60):
        for end in ("\n", "\r\n"):
            rows = "".join(f"key {chr(97 + i % 26)}: v{end}" for i in range(n))
            assert K.body(f"T{end}{end}{rows}{end}body") == "body"
            assert K.body(f"# T{end}{end}## Metadata{end}{rows}{end}## Content{end}{end}body") == "body"
    for text in ("# T\n\n## Metadata\nx\n\n## Other\n\n## Content\n\nbody", "one\r\n\r\ntwo\r\n"):
        assert K.body(text) == text


def test_spam_features_of_a_list_repeated_at_a_long_period():
    a = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    terms = [f"w{a(i)}" for i in range(130)]
    x = K.features([" ".join(terms * 4), " ".join(f"w{a(i)}{a(j)}" for i in range(20) for j in range(26)), ""], {})
    f = lambda i, name: x[i, K.FEATURES.index(name)]
    assert f(0, "gap2") == f(0, "auto") == 0 and f(0, "gap2_any") > 0.7 and f(0, "auto_far") == 1 and f(1, "gap2_any") == f(1, "auto_far") == 0 and not x[2].any()


@tables
def test_spam_on_held_out_labels():
    y = {r["doc_id"]: r["label"] == "spam" for r in read("doc_labels", "doc_id", "label")}
    docs = sorted((r["doc_id"], r["text"] or "") for r in read("documents", "doc_id", "text") if r["doc_id"] in y)
    lab = np.array([y[i] for i, _ in docs])
    part = np.arange(len(docs)) % 3 != 0
    w, m = K.fit([t for (_, t), p in zip(docs, part) if p], lab[part])
    got = m.score(K.expand(K.features([t for (_, t), p in zip(docs, part) if not p], w))) > 0
    assert (got == lab[~part]).mean() > 0.97


def test_spam_odd_rows(spark):
    spam, ok = "cheap tool best tool " * 12, "The index was rebuilt on Monday. It took two hours, and nobody noticed."
    rows = [(i, spam if i % 2 else f"{ok} {i}.", "x", 1.0) for i in range(40)] + [(100, None, "x", 1.0), (101, "", "x", 1.0), (102, "tool", "x", 1.0), (103, spam, "x", 1.0), (103, spam, "x", 1.0), (None, "x y", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string, score double")
    labels = spark.createDataFrame([(i, "spam" if i % 2 else "ok") for i in range(20)] + [(None, "spam"), (3, None)], "doc_id bigint, label string")
    got = {r["doc_id"] for r in K.spam_documents(docs, labels).collect()}
    assert got == {i for i in range(40) if i % 2} | {103}
    assert K.spam_documents(docs, labels.where("label = 'ok'")).count() == 0 and K.spam_documents(docs.where("false"), labels).count() == 0


def test_spam_model_is_fitted_where_the_texts_lie(spark):
    """The words' log-odds equal those counted at hand, labels that a document lacks don't count, and no text reaches the driver."""
    rng = random.Random(8)
    nouns, verbs = [f"thing{i}" for i in range(40)], "we saw that it was and then they had gone to the house for a while".split()
    def text(spam):
        return " ".join(rng.choice(nouns) for _ in range(3)) * 20 if spam else ". ".join(" ".join(rng.choice(verbs + nouns[:5]) for _ in range(9)) for _ in range(8)) + "."
    rows = [(i, text(i % 3 == 0), "spam" if i % 3 == 0 else "ok") for i in range(120)]
    known = spark.createDataFrame(rows, "_id bigint, _t string, _y string")
    weights, model = K._fit_there(known)
    want = K.word_weights([t for _, t, _ in rows], np.array([y == "spam" for *_, y in rows]))
    assert weights.keys() == want.keys() and all(abs(weights[w] - want[w]) < 1e-12 for w in want)
    x = K.expand(K.features([text(True), text(False)], weights))
    assert (model.score(x) > 0).tolist() == [True, False]
    assert K._fit_there(known.where("_y = 'ok'")) is None and K._fit_there(known.where("false")) is None


def test_long_tags_are_tags():
    assert K.TOKEN("<" + "a" * 3000 + "> x") == ["<" + "a" * 3000 + ">", "x"] and K.TOKEN("<" * 50 + "\n")[-1] == "\n"

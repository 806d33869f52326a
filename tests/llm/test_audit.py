import itertools
import re

from scorewright.llm import audit

SCHEMA = "doc_id long, text string, source string, mask int, part string, n long"
LABELS = "doc_id long, quality int, toxic int"


def failures(rows):
    """(part, letters failed, doc_id) of each row."""
    out = []
    for i, text, source, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        duplicate = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows)
        tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), duplicate)
        out.append((source or "", {x for x, hit in zip("ABCDE", tests) if hit}, i))
    return out


def brute(rows, labels):
    good, bad = ({r[0] for r in labels if r[k] == 1} - {None} for k in (1, 2))
    found, out = failures(rows), []
    for part in {p for p, _, _ in found}:
        own = [(f, i) for p, f, i in found if p == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        made = []
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, x in enumerate(order):
                before = set(order[:k])
                here = [i for f, i in own if x in f and not f & before]
                removed_by[x] += len(here)
                counts = (sum(not f & {*before, x} for f, _ in own), len(here), sum(x in f and bool(f & before) for f, _ in own), sum(f == {x} for f, _ in own))
                made.append(((part, order, k + 1, *counts, sum(i in good for i in here), sum(i in bad for i in here)), x))
        out += [(*m, removed_by[x]) for m, x in made]
    return sorted(out)


def long_text(n, same=False):
    return " ".join("w" if same else f"w{k}" for k in range(n))


def result(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA).repartition(3)
    found = audit.interactions(docs, spark.createDataFrame(labels, LABELS))
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return sorted(tuple(r[n] for n in names) for r in found.collect())


def test_against_sets(spark):
    texts = [long_text(250), long_text(250, True), "SHOUT " + long_text(30), "a # b", "", None, long_text(199), long_text(200), "  \t\n", "é" * 60 + "AB", long_text(200_000)]
    rows = [(k, texts[k % len(texts)], ["s", None, "t"][k % 3]) for k in range(40)]
    rows += [(3, "a # b", "s"), (3, "a # b", "s"), (0, long_text(250), "t"), (None, "a # b", "t"), (None, None, None), (None, "a # b", "s")]
    labels = [(k, k % 2, (k + 1) % 2) for k in range(30)] + [(5, 1, 1), (None, 1, 1), (77, 1, 1), (9, None, None)]
    assert result(spark, rows, labels) == brute(rows, labels)


def test_a_part_without_failures_has_all_steps(spark):
    found = result(spark, [(1, long_text(300), "only")], [])
    assert len(found) == 600 and all(r[3:] == (1, 0, 0, 0, 0, 0, 0) for r in found)


def test_no_rows(spark):
    assert result(spark, [], [(1, 1, 1)]) == []


def test_words_across_segments(monkeypatch):
    monkeypatch.setattr(audit, "_SEGMENT", 7)
    for text in (b"", b" ", b"one two  three\x0bone\ttwo", b"x" * 40, b"abcdefg hij", b"aa\n" * 9):
        assert audit._words(text) == (len(text.split()), len(set(text.split())))

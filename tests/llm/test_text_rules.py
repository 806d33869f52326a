import collections
import hashlib
import os
import re

import pytest

from scorewright.llm import quality, substring, toxicity

FOLDER = "/root/testdata/sf0.01"
PROSE = "The quick fox ran over many hills and came home late in the evening, when all the lamps were lit and supper stood ready."


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, lines = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = [False] * len(w)
    for i in range(len(w) - 7):
        if c[tuple(w[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), lines, sum(hit)


CASES = [
    None, "", "  \n\t\n", PROSE, f"{PROSE}\n{PROSE}\n{PROSE}", "a b c d e f g h " * 5, "x y " * 30, f"{PROSE}\nHome | News | Sport | Video | Log in", f"{PROSE}\nLicensed under the Apache License, Version 2.0.",
    "a%%% b### c$$$ d&&& " * 8, "BUY!! NOW!! " * 15, "é ü " * 25, "one two three four five six seven\none two three four five six seven\n" * 2, f"{PROSE} " * 300, "w" * 10_000, "a\x0bb\x0cc\r\n" * 9,
]


def test_base_counts(spark):
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(CASES)], "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in quality.assess(docs).collect()}
    for i, t in enumerate(CASES):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), t
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_lines_go_before_documents(spark):
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(CASES)], "doc_id long, text string, n_chars int")
    out = {r.doc_id: r for r in quality.clean(docs).collect()}
    assert out[3].text == PROSE == out[7].text == out[8].text and out[7].n_chars == len(PROSE)
    assert not {0, 1, 2, 9, 10} & out.keys()
    assert quality.clean(docs.limit(0)).count() == 0 and quality.clean(docs).columns == docs.columns


@pytest.mark.parametrize("k", [1, 3, 5, 8, 11])
def test_windows_of_any_length(spark, k):
    words = "a b a b a c a b a b a c".split()
    df = quality.with_windows(spark.createDataFrame([(words,)], "w array<string>"), "w", k, "h")
    h = df.first().h
    n = len(words) - k + 1
    same = {(i, j) for i in range(n) for j in range(n) if words[i : i + k] == words[j : j + k]}
    assert len(h) == n and {(i, j) for i in range(n) for j in range(n) if h[i] == h[j]} == same


def test_nothing_runs_in_python(spark):
    plan = quality.assess(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def covered(docs, w):
    first = {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    for i in sorted(words):
        for k in range(len(words[i]) - w + 1):
            first.setdefault(tuple(words[i][k : k + w]), i)
    out = {}
    for i, x in words.items():
        gone = [False] * len(x)
        for k in range(len(x) - w + 1):
            if first[tuple(x[k : k + w])] < i:
                gone[k : k + w] = [True] * w
        out[i] = len(x), sum(gone), " ".join(a for a, g in zip(x, gone) if not g)
    return out


@pytest.mark.parametrize("window", [50, 9, 2])
def test_repeats_against_brute_force(spark, window, monkeypatch):
    import random

    monkeypatch.setattr(substring, "COMPARED", 500)
    rng = random.Random(8)
    passage = [f"p{rng.randrange(99)}" for _ in range(80)]
    docs = []
    for i in range(40):
        own = [rng.choice("abcdefgh") * rng.randrange(1, 4) + str(rng.randrange(50)) for _ in range(rng.randrange(0, 120))]
        at, size = rng.randrange(len(own) + 1), rng.choice([0, 49, 50, 51, 80])
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(own[:at] + passage[:size] + own[at:])))
    docs += [(40, docs[3][1]), (41, "  " + docs[3][1]), (42, ""), (43, None), (44, "x " * 300), (45, "x " * 120)]
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, at int, row string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring.remove_repeats(df, window).collect()}
    assert got == covered(docs, window)
    spans = {r.doc_id: sum(s.end - s.start for s in r.spans) for r in substring.remove_repeats(df, window).collect()}
    assert spans == {i: n for i, (_, n, _) in got.items()}
    cut = {r.doc_id: r.text for r in substring.cut_repeats(df, window).collect()}
    assert all(cut[i] == dict(docs)[i] for i in cut if got[i][1] == 0) and all(got[i][2].split() == (cut[i] or "").split() for i in cut)


def test_repeated_and_null_ids(spark):
    p = " ".join(f"w{i}" for i in range(60))
    rows = [(1, p), (1, p), (1, p + " more"), (None, p), (2, p), (2, p)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (1, 0), (2, 60), (2, 60)]
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("period, cover", substring.COVERS)
def test_covers_meet_for_all_positions(period, cover):
    residues = {r % period for r in cover}
    for i in range(period):
        for j in range(period):
            assert any((i + s) % period in residues and (j + s) % period in residues for s in range(period))


def test_word_hashes_across_segments(monkeypatch):
    import numpy as np

    data = np.frombuffer(("ab cd " * 50 + "long" * 30 + " ab").encode(), np.uint8)
    whole = substring.word_hashes(data)
    monkeypatch.setattr(substring, "_SEGMENT", 40)
    cut = substring.word_hashes(data)
    assert len(whole) == len(cut) == 102 and (whole[:100] == cut[:100]).all() and whole[-1] == cut[-1] == whole[0]


GRAMMAR = toxicity.Grammar(words={"idiot": 2.0}, stems={"scum": 1.0}, curve=(-2.0, 1.0, 1.0, 1.0, 1.0, 0.0))


def weight(scorer, text):
    return sum(w * f for _, w, f in scorer.clause(text))


def test_clauses():
    s = toxicity.Scorer(GRAMMAR)
    plain = weight(s, "what an idiot")
    assert plain == 2.0 and len(s.clause("what an idiot")) == 1
    assert weight(s, "he is not an idiot") < plain < weight(s, "you idiot") == weight(s, "idiot of you")
    assert weight(s, "she said that idiot") < weight(s, "she likes that idiot")
    assert len(s.clause("scummy things")) == 1 and not s.clause("idiotic")
    assert s.features("An idiot. A clean line.\nAnother idiot!")[3] == pytest.approx(1.0986, abs=1e-3)
    assert s.features("") == s.features("calm words only") == s.features("xidiot") == (0.0,) * 5
    insult, threat, *_ = s.features("we will kill you")
    assert insult == 0 < threat
    assert toxicity.Grammar.from_json(GRAMMAR.to_json()) == GRAMMAR


def marks_by_positions(classes, reach=4, beside=2):
    """What the composed machine must write, from positions alone."""
    out = []
    for k, x in enumerate(classes):
        if x in "ih":
            near = classes[max(0, k - beside) : k] + classes[k + 1 : k + beside + 1]
            before = classes[max(0, k - reach) : k]
            out.append(x.upper() + "+" * ("t" in near) + "-" * ("n" in before) + '"' * ("r" in before))
    return out


def test_composition_against_positions():
    import random

    rng = random.Random(11)
    g = toxicity.Grammar(insult_factors=(2.0, 0.5, 0.25), threat_factors=(3.0, 0.1, 0.7))
    m = g.machine()
    steps = [toxicity.target(toxicity.CLASSES, 2, {"i": 2.0, "h": 3.0})]
    for trigger, mark, f in (("n", "-", {"i": 0.5, "h": 0.1}), ("r", '"', {"i": 0.25, "h": 0.7})):
        steps.append(toxicity.scope(steps[-1].written(), trigger, mark, 4, f))
    for _ in range(3000):
        classes = "".join(rng.choices(toxicity.CLASSES, (4, 1, 1, 1, 2, 2), k=rng.randrange(14)))
        got = m.run(classes)
        assert [x for x, _ in got] == marks_by_positions(classes)
        factors = toxicity.cell_factors(g.insult_factors, g.threat_factors)
        assert all(abs(v - factors[toxicity.cell(x)]) < 1e-12 for x, v in got)
        stream = tuple((x, 1.0) for x in classes)
        for t in steps:  # one after the other writes the same as composed
            state, out = t.follow(t.start, stream)
            _, tail = t.follow(state, ())
            stream = out + t.tails[state]
        assert [(x.upper(), v) for x, v in stream if x[0] in "ih"] == list(got)


def test_factors_are_learnt():
    import numpy as np

    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 600).astype(float)
    cells = np.zeros((600, 16))
    cells[:, 0] = y * rng.integers(0, 3, 600)  # plain insults are toxic
    cells[:, 2] = (1 - y) * rng.integers(0, 4, 600)  # negated ones aren't
    insult, threat = toxicity._fit_factors(cells, y)
    assert insult[1] == 0.0 and threat == toxicity.PRIOR


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, "you idiot", 9.0), (3, "you idiot", 9.0), (None, "idiot", 9.0)], "doc_id long, text string, score double")
    got = toxicity.score(docs, GRAMMAR).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert [r.doc_id for r in toxicity.keep_clean(docs, GRAMMAR).orderBy("doc_id").collect()] == [1, 2]
    none = toxicity.fit(docs, spark.createDataFrame([(1, None), (2, 0)], "doc_id long, toxic int"))
    assert all(r.predicted == 0 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.limit(0), GRAMMAR).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")
def test_held_out_accuracy(spark):
    from scorewright.llm import queries

    folder = FOLDER.replace("0.01", "0.1")
    known = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op10_toxicity(spark, folder).join(known, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    bad = [r for r in rows if r.toxic == 1]
    assert right > 0.97 and sum(r.predicted for r in bad) / len(bad) > 0.85


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")
def test_query_digests(spark):
    from scorewright.llm import queries

    folder = FOLDER.replace("0.01", "0.001")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = covered(docs, 50)
    for r in queries.op9_substring_dedup(spark, folder).collect():
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())

"""Queries without SQL, and the pipeline stage by stage, against plain recomputations on the smallest tables."""

import functools
import math
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import connect
from test_similar import kept as not_similar
from test_text_rules import covered, marks_by_positions
from tokenizers import Tokenizer

import corpus_pipeline
from scorewright.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


@functools.cache
def byte_level():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def pieces_of(text, size=2048):
    ids = [*byte_level().encode(text, add_special_tokens=False).ids, 0]
    n = -(-len(ids) // size)
    cuts = [0, *(len(ids) - (n - 1 - k) * size for k in range(n))]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def check_places(rows, texts):
    """Pieces are those of the library, their places gapless, and no packing has fewer sequences."""
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted((i, *p) for i, t in texts.items() for p in pieces_of(t))
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in at.values():
        end = 0
        for offset, length in sorted(some):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(at) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_token_counts(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {(i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2048) for i, t in texts.items()}
    assert {tuple(r) for r in queries.op2_token_counts(spark, FOLDER).collect()} == want and any(w[3] for w in want)


def test_packing(spark, texts):
    check_places(queries.op7_best_fit_packing(spark, FOLDER).collect(), texts)


def plain_score(text, g):
    """The score from words and positions, without machines or a prefilter."""
    sums, most, matched = [0.0, 0.0], 0.0, 0
    low = text.lower()
    for clause in re.split(r"(?<=[.!?;:\n])(?![.!?;:\n])", low):
        classes, weights = "", []
        for w in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*", clause):
            learnt = max([g.words.get(w, 0.0), *(v for s, v in g.stems.items() if w.startswith(s))])
            kind = "t" if w in toxicity.TARGETS else "n" if w in toxicity.NEGATIONS else "r" if w in toxicity.REPORTS else "h" if w in toxicity.THREATS else "i" if learnt > 0 else "w"
            classes += kind
            weights += [max(learnt, g.threat)] if kind == "h" else [learnt] if kind == "i" else []
        own = [0.0, 0.0]
        for mark, weight in zip(marks_by_positions(classes, g.reach, g.beside), weights):
            factors = g.threat_factors if mark[0] == "H" else g.insult_factors
            own[mark[0] == "H"] += weight * math.prod(f for m, f in zip('+-"', factors) if m in mark)
        if weights:
            sums, most, matched = [a + b for a, b in zip(sums, own)], max(most, sum(own)), matched + 1
    x = (math.log1p(sums[0]), math.log1p(sums[1]), most, math.log1p(matched), 100 * sum(sums) / max(50, len(text))) if matched else (0.0,) * 5
    return 1 / (1 + math.exp(-(g.curve[0] + sum(c * v / s for c, v, s in zip(g.curve[1:], x, g.scale)))))


def grammar_of(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    return toxicity.fit(docs, labels.where(~toxicity.held_out("doc_id")))


def test_toxicity(spark, texts):
    g = grammar_of(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert g.words
    for r in queries.op10_toxicity(spark, FOLDER).collect():
        assert r.score == pytest.approx(plain_score(texts[r.doc_id], g), abs=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5)


def test_pipeline_stage_by_stage(spark, texts):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    outs, seen = [], docs
    for _, stage in corpus_pipeline.STAGES:
        outs.append(stage(spark, seen, FOLDER).cache())
        seen = outs[-1]
    of = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    clean, civil, single, cut = (of(df) for df in outs[:4])
    good = {i for i, k in connect(FOLDER).execute(f"SELECT doc_id, kept FROM ({queries.ORACLE_SQL['op6_line_first_quality']})").fetchall() if k}
    assert set(clean) == good and all(set(t.split("\n")) <= set(texts[i].split("\n")) for i, t in clean.items())
    g = grammar_of(spark, outs[0])
    assert civil == {i: t for i, t in clean.items() if plain_score(t, g) < 0.5}
    assert sorted(single) == not_similar(list(civil.items())) and all(civil[i] == t for i, t in single.items())
    left = covered(list(single.items()), 50)
    assert {i: t.split() for i, t in cut.items()} == {i: w.split() for i, (_, _, w) in left.items() if w}
    check_places(outs[4].collect(), cut)
    places = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert places == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in outs[4].collect())

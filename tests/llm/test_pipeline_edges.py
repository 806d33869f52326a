"""The stages on nulls, empty and long texts, repeated rows, empty tables and columns whose names clash."""

import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
TEXT = " ".join(f"Plain words number {i} make this line long enough to keep." for i in range(12))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, length int, rank string, component long, toxic int, label string, ids string"


def rows():
    plain = [(1, TEXT), (1, TEXT), (1, None), (2, None), (3, ""), (4, " \n\t"), (None, TEXT), (None, None), (None, ""), (5, TEXT.replace("Plain", "Other") + " " + TEXT[:300]), (6, "word " * 60_000), (7, TEXT)]
    return [(i, t, None, None, None if t is None else len(t), 1, 2, "r", 3, 1, "x", "y") for i, t in plain]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, name, stage):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    out = stage(spark, docs, FOLDER)
    got = out.collect()
    ids = [r.doc_id for r in got]
    assert set(ids) <= {None, 1, 2, 3, 4, 5, 6, 7}
    if name != "best-fit packing":
        assert out.columns == docs.columns and all(r.rank == "r" and r.ids == "y" for r in got)
        assert all(r.n_chars is None or r.text is None or r.n_chars == len(r.text) for r in got)
    if name == "toxicity":
        assert len(got) == len(rows())  # nothing here is toxic
    if name == "simhash near-dedup":
        assert ids.count(1) == 1 and 7 not in ids and ids.count(None) == 3  # rows without an id stay
        assert 4 not in ids or 3 not in ids  # neither has words
    if name == "substring dedup":
        assert len(got) == len(rows()) - 1 and 7 not in ids  # all of its words are in an earlier document
    if name == "best-fit packing":
        at = {}
        for r in got:
            at.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for some in at.values():
            assert [a for a, _ in sorted(some)] == [sum(n for _, n in sorted(some)[:k]) for k in range(len(some))] and sum(n for _, n in some) <= 2048
        assert {i for i in ids if i is not None} == {1, 2, 3, 4, 5, 6, 7}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_no_rows(spark, name, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), FOLDER).count() == 0

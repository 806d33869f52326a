import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorewright.llm import fim

SCHEMA = "doc_id long, text string, form string, output int"


def expected(doc_id, text):
    """(n, form, prefix, middle, output) by slicing a decoded text."""
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    x, y = sorted((a % (len(t) + 1), b % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return len(t), "plain", None, None, t
    if d % 100 < 20:
        return len(t), "spm", x, y - x, f"<S>{t[y:]}<P>{t[:x]}<M>{t[x:y]}"
    return len(t), "psm", x, y - x, f"<P>{t[:x]}<S>{t[y:]}<M>{t[x:y]}"


@given(st.lists(st.text(alphabet="aé€😀\n", max_size=700), max_size=6))
@settings(max_examples=60, deadline=None)
def test_rank_and_select(texts):
    data = "".join(texts).encode()
    starts = [i for i, x in enumerate(data) if x & 0xC0 != 0x80]
    where = fim.Boundaries(np.frombuffer(data, np.uint8))
    assert list(where.rank(np.arange(len(data) + 1))) == [sum(s < i for s in starts) for i in range(len(data) + 1)]
    assert list(where.select(np.arange(len(starts) + 2))) == [*starts, len(data), len(data)]


def rows():
    rng = random.Random(3)
    parts = ["a", "é", "€", "😀", "<", ">", "<P", "S>", "M", "\n", "́"]
    out = [(i, "".join(rng.choices(parts, k=rng.randrange(60))), "form", 1) for i in range(400)]
    out += [(400, None, None, None), (401, "", "x", 1), (402, "a<M>b", "x", 1), (403, "ü" * 300_000, "x", 1), (404, "\x00", "x", 1), (None, "no id", "x", 1), (3, "again", "x", 1), (3, "again", "x", 1)]
    return out


def test_against_slices(spark):
    made = fim.restore(fim.transform(spark.createDataFrame(rows(), SCHEMA).repartition(3))).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.text) for r in made), key=repr) == sorted(((i, *expected(i, t), t or "") for i, t, *_ in rows()), key=repr)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_no_rows(spark):
    assert fim.restore(fim.transform(spark.createDataFrame([], SCHEMA))).collect() == []


def test_sentinels_that_could_be_mistaken(spark):
    for marks in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<P<>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.transform(spark.createDataFrame([], SCHEMA), sentinels=marks)

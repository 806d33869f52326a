import base64
import hashlib

import pytest

from scorewright.llm import files, shared, warc

ROWS = [(1, "u", "a"), (2, "u", "a"), (2, "u", "a"), (3, None, None), (4, "x\ny", ""), (None, "q", "a"), (5, "z", "b" * 300_000), (6, "z", "é\r\n\r\nx"), (7, "z", "b" * 300_000)]


def pages(spark):
    return spark.createDataFrame([(*r, 0) for r in ROWS], "page_id long, url string, html string, first long").repartition(2)


def test_round_trip(spark):
    got = warc.round_trip(pages(spark)).collect()
    assert len(got) == len(ROWS)
    size = {i: len((h or "").encode()) for i, _, h in ROWS}
    sha = {i: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for i, _, h in ROWS}
    assert all((r.payload_bytes, r.payload_digest) == (size[r.page_id], sha[r.page_id]) for r in got)
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=repr)
    assert kinds == sorted([(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (None, "response", None), (5, "response", None), (6, "response", None), (7, "revisit", 5)], key=repr)
    assert {r.page_id: r.payload for r in got if r.record_type == "response"}[6].decode() == ROWS[7][2]


def test_small_payloads_are_all_responses(spark):
    got = warc.round_trip(pages(spark), min_bytes=2).collect()
    assert sorted(r.page_id for r in got if r.record_type == "revisit") == [7]


def test_frames_are_reached_one_by_one(spark):
    ws = shared.workspace(spark)
    index = warc.write_archives(pages(spark), f"{ws}/a", ws, frame_bytes=50, bundle_bytes=300).collect()
    assert len({r.file for r in index}) > 1
    for r in index:
        if r.page_id is not None:
            found = warc.fetch_record(f"{ws}/a", r.file, r.page_id)
            assert any(h["X-Page-ID"] == str(r.page_id) for h, _ in found)
            system, path = files.store(f"{ws}/a")
            with system.open_input_file(f"{path}/{r.file}") as f:
                data = f.read()
            reader = warc.Reader(lambda at, n: data[at : at + n], len(data))
            assert warc.parse(reader.frame(r.frame), r.offset)[0]["X-Page-ID"] == str(r.page_id)


def test_damage_is_noticed():
    raw = warc.record(1, "u", b"payload", None, False, "2024-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"WARC/1.1", b"XXXX/1.1"))
    with pytest.raises(ValueError):
        warc.Reader(lambda at, n: b"\0" * n, 100)


def test_empty(spark):
    assert warc.round_trip(pages(spark).limit(0)).count() == 0

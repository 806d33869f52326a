"""Workbooks, the record sink with its manifests, step classes, and scores of a stream."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from scorewright.operators import steps
from scorewright.sources import sink, workbooks
from scorewright.sources.records import read_table
from scorewright.streaming import running

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, sheets, active=0, strings=()):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {_NS}><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {_NS}><sheetData>{rows}</sheetData></worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {_NS}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")


FIRST = """<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t> Hit </t></is></c><c r="D1" t="str"><v>Own Name</v></c></row>
<row><c r="A2"><v>7</v></c><c r="B2" t="b"><v>1</v></c><c r="C2" t="s"><v>1</v></c><c r="E2"><v>9</v></c></row>
<row><c r="A3"/><c r="B3"/></row><row/>
<row><c r="D5"><v>0.5</v></c></row>"""


def test_workbooks(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    workbook(path, {"one": FIRST, "two": '<row><c r="A1" t="inlineStr"><is><t>id</t></is></c></row><row><c r="A2"><v>8</v></c></row>', "none": ""}, strings=("<t>INDEX</t>", "<r><t>rich </t></r><r><t>text</t></r>"))
    df = read_table(spark, path)
    assert df.columns == ["index", "hit", "col_2", "Own Name"]
    assert [tuple(r) for r in df.collect()] == [("7", "true", "rich text", None), (None, None, None, "0.5")]
    both = workbooks.read_xlsx(spark, path, "*")
    assert both.rdd.getNumPartitions() == 3
    assert {(r["index"], r["id"]) for r in both.collect()} == {("7", None), (None, None), (None, "8")}
    assert workbooks.read_xlsx(spark, path, "none").columns == []
    with pytest.raises(Exception, match="no sheet"):
        workbooks.read_xlsx(spark, path, "three").collect()


def test_active_sheet(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    row = lambda x: f'<row><c r="A1" t="inlineStr"><is><t>id</t></is></c></row><row><c r="A2"><v>{x}</v></c></row>'
    workbook(path, {"one": row(1), "two": row(2)}, active=1)
    assert [r.id for r in workbooks.read_xlsx(spark, path).collect()] == ["2"]


def files_of(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def test_records(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = [("m1", "d", f"i{k}", k / 4, k == 2) for k in range(4)] + [("m2", "d", 'q"1', 1.0, False), ("m2", "e", "x", 0.0, None)]
    df = spark.createDataFrame(rows, "model string, dataset string, item string, score double, missing boolean")
    sink.write_records(df, root)
    assert files_of(root) == ["m1/d.json", "m2/d.json", "m2/e.json"]
    record = json.load(open(f"{root}/m1/d.json"))
    assert record == {"dataset": "d", "model": "m1", "details": {f"i{k}": {"is_correct": k / 4} | ({"missing": True} if k == 2 else {}) for k in range(4)}, "is_correct": 0.375, "accuracy": 0.375, "meta": {"n_items": 4, "n_missing": 1}}
    assert json.load(open(f"{root}/m2/d.json"))["details"] == {'q"1': {"is_correct": 1.0}}
    with pytest.raises(Exception, match="is there"):
        sink.write_records(df.where("model = 'm1'").withColumn("score", F.lit(0.0)), root)
    assert json.load(open(f"{root}/m1/d.json")) == record and len(files_of(root)) == 3
    sink.write_records(df.where("model = 'm1'").withColumn("score", F.lit(0.0)).drop("missing"), root, overwrite=True)
    assert json.load(open(f"{root}/m1/d.json"))["is_correct"] == 0.0
    sink.write_records(df.limit(0), root)


@pytest.mark.parametrize("bad", [("m9", "d", "i", None), ("m9", "d", "i", float("nan")), ("..", "d", "i", 1.0), ("a/b", "d", "i", 1.0), ("m9", None, "i", 1.0)])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    root = str(tmp_path / "out")
    df = spark.createDataFrame([("m1", "d", "a", 1.0), ("m2", "d", "a", 1.0), bad], "model string, dataset string, item string, score double")
    with pytest.raises(Exception):
        sink.write_records(df, root)
    assert files_of(root) == []


def test_an_item_twice(spark, tmp_path):
    df = spark.createDataFrame([("m", "d", "a", 1.0), ("m", "d", "a", 0.0)], "model string, dataset string, item string, score double")
    with pytest.raises(Exception, match="twice"):
        sink.write_records(df, str(tmp_path / "out"))


def test_manifests(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        sink.read_manifest(folder)
    (tmp_path / "manifest.json").write_text(json.dumps({"subsets": {"small": {"file": "s.jsonl"}, "bad": {"file": "b.jsonl"}, "cut": {"file": "c.jsonl"}}}))
    (tmp_path / "s.jsonl").write_text('{"index": 3, "weight": 0.5}\n\n{"index": "x", "weight": 0.5, "id": "q"}\n')
    (tmp_path / "b.jsonl").write_text('{"index": 3}\n')
    (tmp_path / "c.jsonl").write_text('{"index": 3, "weight"\n')
    assert [tuple(r) for r in sink.read_manifest_subset(spark, folder, "small").collect()] == [("3", 0.5, "3"), ("x", 0.5, "q")]
    for name, why in (("bad", "lacks index or weight"), ("cut", "isn't JSON")):
        with pytest.raises(Exception, match=why):
            sink.read_manifest_subset(spark, folder, name).collect()
    with pytest.raises(ValueError, match="no subset"):
        sink.read_manifest_subset(spark, folder, "none")


def test_step_classes(spark):
    def problem(name, hits, whole, n=None):
        return [(name, n or len(hits), k + 1, h) for k, h in enumerate(hits) if h is not None] + ([(name, n or len(hits), None, whole)] if whole is not None else [])

    T, F_ = True, False
    rows = problem("mastery", [T, T, T], T) + problem("rote", [F_, F_], T) + problem("half", [T, F_], T) + problem("inadequate", [T, T], F_) + problem("insufficient", [T, F_, F_, F_], F_)
    rows += problem("gap", [T, None, T], F_) + problem("no whole", [T, T], None) + problem("no first", [None, T], T) + [("mastery", 3, 2, T)]
    df = spark.createDataFrame(rows, "problem string, steps int, step int, hit boolean")
    out = steps.knowledge_classes(steps.step_outcomes(df, "problem", "steps", "step", "hit")).first()
    assert (out.n, out.insufficient, out.inadequate, out.mastery_strict, out.mastery_loose, out.rote_strict, out.rote_loose) == (7, 1, 1, 1, 2, 2, 1)
    assert (out.rote_rate_strict, out.rote_rate_loose, out.score_strict, out.score_loose) == pytest.approx((2 / 3, 1 / 3, 3.5 / 7, 4.5 / 7))
    concepts = spark.createDataFrame([("a", "x"), ("b", "x")], "concept string, area string")
    seen = spark.createDataFrame([("a", True), ("a", False), ("c", True)], "concept string, hit boolean")
    assert sorted(map(tuple, steps.concept_accuracy(seen, concepts, "concept", "hit", "area").collect())) == [("x", "a", 2, 0.5), ("x", "b", 0, None)]


def test_running_scores_equal_those_of_the_table(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = [(f"k{i % 5}", None if i % 11 == 0 else float(i % 7)) for i in range(200)] + [("only null", None)]
        schema = "key string, score double"
        for part in (2, 0, 1):
            spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen = {}

        def keep(batch, _):
            seen.update({r.key: (r.n, r.total, r.mean) for r in batch.collect()})

        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = running.running_scores(stream, "key", "score").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination(150)
        want = {r.key: (r.n, r.total, r.mean) for r in running.batch_scores(spark.createDataFrame(rows, schema), "key", "score").collect()}
        assert seen.keys() == want.keys() and all(seen[k] == pytest.approx(want[k]) if want[k][0] else seen[k][:2] == want[k][:2] for k in want)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)

import numpy as np
import public_tokenizers
import pytest

from scorewright.llm import shared, tokenfile, warc


class Bare:
    """A session of a cluster without a shared folder."""

    class sparkContext:
        master = "spark://there:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Own:
                    @staticmethod
                    def getCheckpointDir():
                        class Nothing:
                            @staticmethod
                            def isDefined():
                                return False

                        return Nothing

                return Own

        @staticmethod
        def getConf():
            return {}

    conf: dict = {}


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.workspace(Bare)


def test_many_rows_without_an_id_are_no_hot_group(spark):
    """Half of the rows have no id; they end up in several tasks, and nothing is lost."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else all of it is one small task
    try:
        _many_rows_without_an_id(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _many_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None if i % 2 else i, f"text {i} " * 5) for i in range(400)], "doc_id long, text string").repartition(4)
    ws = shared.workspace(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = tokenfile.write_token_files(docs, f"{ws}/tokens", ws, path).collect()
    read = tokenfile.read_token_files(spark, f"{ws}/tokens").collect()
    assert sum(r.doc_id is None for r in read) == 200 and len({r.file for r in read if r.doc_id is None}) > 1
    base = {m.file: m.base for m in manifest}
    ids = [r.doc_id for r in sorted(read, key=lambda r: base[r.file] + r.start)]
    assert ids == [None] * 200 + list(range(0, 400, 2))

    pages = spark.createDataFrame([(None, "u", "same") for _ in range(300)] + [(1, "u", "same"), (2, "v", "same"), (2, "w", "same")], "page_id long, url string, html string").repartition(4)
    index = warc.write_archives(pages, f"{ws}/pages", ws).collect()
    assert len({r.file for r in index if r.page_id is None}) > 1
    found = warc.read_archives(spark, f"{ws}/pages").collect()
    kinds = sorted((r.page_id, r.record_type, r.refers_to) for r in found if r.page_id is not None)
    assert kinds == [(1, "response", None), (2, "revisit", 1), (2, "revisit", 1)]
    assert all(r.record_type == "response" for r in found if r.page_id is None) and len(found) == 303


def test_workspace_holds_written_tables(spark):
    ws = shared.workspace(spark)
    df = shared.written(spark.range(5), ws, "five")
    assert sorted(np.array([r.id for r in df.collect()])) == [0, 1, 2, 3, 4]

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import common

from .conftest import ROWS


def test_row_identities(odd):
    for docs in odd:
        known = common.with_row_id(docs)
        assert known.columns == ["doc", "f", "r"] and known.select("f", "r").distinct().count() == len(ROWS)
        assert known.select("doc.*").columns == docs.columns


def test_only_needed_columns_are_read(odd):
    plan = common.with_row_id(odd[0]).select("f", "r", "doc.doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,_tmp_metadata_row_index:bigint>" in plan


class Session:
    """A session whose setting can be chosen, else the real one."""

    def __init__(self, spark, value):
        self.sparkContext, self.value, self.conf = spark.sparkContext, value, self

    def get(self, name, default=None):
        return self.value


def test_the_shared_folder_is_the_sessions(spark, monkeypatch):
    assert common.shared_dir(Session(spark, "file:///shared/x/")) == "file:///shared/x"
    assert common.shared_dir(Session(spark, "hdfs://n/x")) == "hdfs://n/x"
    assert common.shared_dir(Session(spark, "/shared/x")) == "file:///shared/x"
    monkeypatch.setattr(type(spark.sparkContext), "getConf", lambda self: {})
    own = common.shared_dir(Session(spark, None))
    assert own.startswith("file:///") and common.shared_dir(Session(spark, None)) == own


def test_broadcast_is_for_counted_sides(spark):
    assert "broadcast" in common.small_enough(spark.range(10), 8)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in common.small_enough(spark.range(10), 8, 79)._jdf.queryExecution().logical().toString().lower()


def test_spread_prunes_files(spark, tmp_path):
    spark.range(100).repartition(10).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    some = common.spread(df, 3)
    assert 0 < some.count() < 100 and some.select("_metadata.file_name").distinct().count() == 3
    assert common.spread(df, 20) is df


def test_words():
    texts = ["Hello wörld, hello", "", "ÉTÉ été", "a-b_c 12x", "!!", "été"]
    data, off = common.utf8(pa.array(texts))
    h, row, first = common.words(data, off)
    want = [re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.lower()) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in want] and row.tolist() == [i for i, w in enumerate(want) for _ in w]
    by = {}
    for x, w in zip(h.tolist(), (w for ws in want for w in ws)):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    cjk = common.words(*common.utf8(pa.array(["日本語"])))
    assert len(cjk[0]) == 3


def test_slices_cover_everything():
    off = np.cumsum([0, 5, 0, 100, 3, 3, 3])
    got = list(common.slices(off, 8))
    assert [a for a, _ in got] == [0, *[b for _, b in got[:-1]]] and got[-1][1] == 6
    assert all(off[b] - off[a] <= 8 or b == a + 1 for a, b in got)


def test_no_local_checkpoint():
    root = Path(common.__file__).parent
    assert not any("localCheckpoint" in p.read_text() for p in root.glob("*.py"))


def test_sweep(spark, monkeypatch):
    monkeypatch.setattr(common, "_MADE", [])
    common.materialise(spark.range(3), "swept")
    path = Path(common._MADE[0].removeprefix("file://"))
    assert path.exists()
    common.sweep()
    assert not path.exists() and common._MADE == []


def test_content_hash(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", {"k": 1}, "x")], "doc_id long, text string, m map<string,int>, `a.b` string")
    known = common.with_row_id(df)
    first = known.select(common.content_hash(known)).first()[0]
    known = common.with_row_id(df.withColumn("a.b", F.lit("y")))
    assert known.select(common.content_hash(known)).first()[0] != first


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(type(spark.sparkContext), "getConf", lambda self: {})
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(ValueError):
        common.shared_dir(Session(spark, None))


def test_small_tables_are_dealt_out(spark, documents, monkeypatch):
    assert documents.repartition(1).count() == common.dealt(documents, documents).count()
    assert common.dealt(documents, documents).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(common, "SPLIT_BYTES", 1)
    assert common.dealt(documents, documents) is documents

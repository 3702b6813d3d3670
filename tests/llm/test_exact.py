import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import op08_exact as op

from .conftest import SF, rows


def test_equals_sql(spark, db):
    assert sorted((r.doc_id, r.n_copies) for r in op.query(spark, SF).collect()) == sorted(db.sql(op.SQL).limit(10**9).fetchall())


@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=60), st.sampled_from([2**64, 2**40]))
@settings(max_examples=80, deadline=None)
def test_golomb_round_trip(values, span):
    v = np.array(sorted({x % span for x in values}), np.uint64)
    code, bits = op.golomb_encode(v, span)
    assert op.golomb_decode(code, len(v), bits).tolist() == v.tolist()


def test_golomb_is_small():
    v = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2))
    code, _ = op.golomb_encode(v, 2**64)
    assert len(code) * 8 / len(v) < np.log2(2**64 / len(v)) + 2.2


def test_exchange_over_many_owners_and_senders(spark, monkeypatch):
    monkeypatch.setattr(op, "OWNER_ROWS", 50)
    monkeypatch.setattr(op, "SENDER_ROWS", 37)
    rng = np.random.default_rng(1)
    fp = rng.choice(rng.integers(-(2**63), 2**63 - 1, 400), 700)
    df = spark.createDataFrame([(int(i % 3), int(i), int(x)) for i, x in enumerate(fp)], "f long, r long, fp long")
    value, n = np.unique(fp, return_counts=True)
    want = sorted((int(i % 3), int(i), int(x)) for i, x in enumerate(fp) if x in set(value[n > 1].tolist()))
    assert sorted(map(tuple, op.exchange(df).collect())) == want


def test_bytes_decide_not_fingerprints(spark, documents, monkeypatch):
    monkeypatch.setattr(op.F, "xxhash64", lambda c: F.length(c).cast("long"), raising=False)
    kept = rows(op.deduplicate(documents).select("doc_id"))
    monkeypatch.undo()
    assert kept == rows(op.deduplicate(documents).select("doc_id"))


def test_odd_rows(spark, odd, none):
    for docs in odd:
        got = op.stage(spark, docs, "")
        assert got.columns == docs.columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, i) for i in (1, 3, 4, 6, 7, 8, 9, 10)] + [(True, 0)]
        assert {r["a.b"] for r in got.collect()} == {"v"}
    assert op.stage(spark, none, "").count() == 0


def test_fingerprints_cross_exchanges_only_as_codes(spark):
    df = spark.range(1000).selectExpr("1L AS f", "id AS r", "hash(id div 2) * 123456789L AS fp")
    found = op.exchange(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    moved = [line for line in plan.splitlines() if "RepartitionBy" in line or "Join" in line]
    assert found.count() == 1000 and moved and "fp#" not in plan.split("MapInPandas")[-1] and plan.rstrip().splitlines()[-1].find("files") >= 0


def test_the_folder_has_no_bearing(spark, tmp_path):
    df = spark.createDataFrame([(1, "same text", str(i)) for i in range(20)] + [(None, "other", str(i)) for i in range(20)], "doc_id long, text string, x string")
    got = []
    for k in range(3):
        df.repartition(k + 1).write.parquet(str(tmp_path / str(k)))
        got.append(rows(op.deduplicate(spark.read.parquet(str(tmp_path / str(k))))))
    assert len(got[0]) == 2 and got[0] == got[1] == got[2]

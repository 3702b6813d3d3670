import corpus_pipeline
from tessella.llm import op07_quality
from tessella.llm.op05_packing import CAPACITY

from .conftest import SF, rows
from .test_minhash import brute_groups, sets_of


def test_stages_equal_brute_force(spark, db, documents):
    kept = {r[0]: r[1] for r in db.sql(f"SELECT doc_id, text FROM documents WHERE {op07_quality.keep_sql()}").limit(10**9).fetchall()}
    by_text = {}
    for d in sorted(kept):
        by_text.setdefault(kept[d], d)
    ids = sorted(by_text.values())
    roots, _ = brute_groups(sets_of([kept[d] for d in ids]))
    want = {ids[i] for i, r in enumerate(roots) if i == r}
    got = corpus_pipeline.run(spark, SF).toPandas()
    extra = set(got["doc_id"]) - want
    assert not want - set(got["doc_id"]) and len(extra) <= 0.01 * len(want)
    assert got.groupby("bin")["length"].sum().max() <= CAPACITY


def test_stages_take_odd_rows(spark, odd, none, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "exact_dedup", "minhash_dedup", "best_fit_packing"]
    for start in (odd[0], none):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            path = f"{tmp_path}/{name}-{start is none}"
            out.write.parquet(path)
            if name != "best_fit_packing":
                assert out.columns == start.columns
            docs = spark.read.parquet(path)
    assert docs.count() == 0


def test_two_runs_give_the_same_rows(spark, documents, tmp_path):
    got = []
    for k in range(2):
        folder = tmp_path / str(k)
        documents.coalesce(2).write.parquet(f"{folder}/documents.parquet")
        got.append(rows(corpus_pipeline.run(spark, str(folder))))
    assert got[0] and got[0] == got[1]

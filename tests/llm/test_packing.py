import numpy as np

from tessella.llm import op05_packing as op

from .conftest import ROWS, rows


def test_every_token_is_packed_once(spark, documents):
    enc = op.encoding(op.TOKENIZER)
    want = {r.doc_id: len(enc.encode_ordinary(r.text)) + 1 for r in documents.collect()}
    got = op.pack(documents, capacity=1024, shard_items=64).toPandas()
    assert got.groupby("doc_id")["length"].sum().to_dict() == want
    assert got.groupby("bin")["length"].sum().max() <= 1024
    for _, pieces in got.groupby("doc_id"):
        p = pieces.sort_values("piece")
        assert p["start"].tolist() == [1024 * i for i in range(len(p))] and (p["length"][:-1] == 1024).all()
    again = op.pack(documents, capacity=1024, shard_items=64).toPandas()
    key = ["doc_id", "piece"]
    assert got.sort_values(key).values.tolist() == again.sort_values(key).values.tolist()
    assert got["bin"].nunique() <= 1.08 * sum(want.values()) / 1024


def packing(lengths, capacity, **kw):
    rng = np.random.default_rng(1)
    first = op._rebuilt(np.full(len(lengths), -1), lengths, capacity)
    return first, op.evolve(lengths, [first, first, op.mutate(first, lengths, capacity, rng)], capacity, 40, rng)[0]


def test_evolution_never_loses_and_sometimes_wins():
    rng = np.random.default_rng(3)
    gained = 0
    for _ in range(12):
        lengths = rng.integers(20, 70, 60)
        first, best = packing(lengths, 100)
        for a in (first, best):
            loads = np.bincount(a, lengths)
            assert loads.max() <= 100 and loads.sum() == lengths.sum() and (loads > 0).all()
        assert op.fitness(best, lengths, 100) >= op.fitness(first, lengths, 100)
        gained += op.fitness(best, lengths, 100) > op.fitness(first, lengths, 100)
    assert gained > 0


def test_crossover_keeps_injected_bins_whole():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 50, 80)
    a, b = (op._rebuilt(np.where(rng.random(80) < 0.3, rng.integers(0, 500, 80), -1) if False else np.full(80, -1), lengths, 100) for _ in range(2))
    b = op.mutate(b, lengths, 100, rng)
    child = op.cross(a, b, lengths, 100, rng)
    assert np.bincount(child, lengths).max() <= 100
    bins = lambda x: {tuple(np.flatnonzero(x == k)) for k in np.unique(x)}
    assert bins(child) & bins(b)


def test_best_fit_takes_the_fullest_bin_with_room():
    lengths = np.array([50, 30, 20, 5])
    assign, loads = np.array([0, 1, -1, -1]), [50, 75]
    op.best_fit(np.array([2, 3]), lengths, assign, loads, 100)
    assert assign.tolist() == [0, 1, 1, 1] and loads == [50, 100]


def test_odd_rows(odd, none):
    for docs in odd:
        got = op.pack(docs).toPandas()
        assert got.groupby("bin")["length"].sum().max() <= op.CAPACITY
        assert (got["piece"] == 0).sum() == sum(r[1] is not None for r in ROWS)
        assert got[got["doc_id"] == 4]["length"].tolist() == [1] and (got["doc_id"] == 7).sum() > 10
        assert got["doc_id"].isna().sum() == 1
    assert op.pack(none).count() == 0


def test_the_folder_has_no_bearing(spark, documents, odd, tmp_path):
    for k, docs in enumerate((documents.limit(150), odd[0])):
        paths = [str(tmp_path / f"{k}{x}") for x in "ab"]
        docs.coalesce(2).write.parquet(paths[0])
        spark.read.parquet(paths[0]).repartition(3).write.parquet(paths[1])
        a, b = (op.pack(spark.read.parquet(p)) for p in paths)
        assert rows(a) == rows(b)

import re

import numpy as np
import pytest

from tessella.llm import graph
from tessella.llm import op10_minhash as op

from .conftest import rows


def sets_of(texts, k=op.SHINGLE):
    out = []
    for t in texts:
        w = re.findall(r"[0-9a-z\u0080-⿿]+", (t or "").lower())
        out.append(set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute_groups(sets, threshold=op.THRESHOLD):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = []
    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and n >= threshold * (len(sets[i]) + len(sets[j]) - n):
                pairs.append((j, i))
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(x) for x in range(len(sets))], pairs


def test_groups_equal_brute_force(spark, documents):
    docs = sorted(documents.collect(), key=lambda r: r.doc_id)
    roots, pairs = brute_groups(sets_of([r.text for r in docs]))
    want = {docs[i].doc_id for i, r in enumerate(roots) if i == r}
    got = {r.doc_id for r in op.deduplicate(documents).select("doc_id").collect()}
    assert pairs and len(got - want) <= 0.1 * (len(docs) - len(want)) and not want - got


def test_large_buckets_are_cut_without_loss(spark, documents, odd, monkeypatch):
    want = rows(op.deduplicate(documents).select("doc_id"))
    monkeypatch.setattr(op, "BLOCK_ROWS", 1)
    monkeypatch.setattr(op, "HEADS", 0)
    assert rows(op.deduplicate(documents).select("doc_id")) == want
    near = spark.createDataFrame([(100 - i, " ".join(f"w{j if j % 40 != i else -1}" for j in range(200))) for i in range(30)], "doc_id long, text string")
    monkeypatch.setattr(op, "BLOCK_ROWS", 4)
    assert [r.doc_id for r in op.deduplicate(near).collect()] == [71]


def test_the_folder_has_no_bearing(spark, tmp_path):
    texts = ["one two three four five six seven", "one two three four five six eight"]
    df = spark.createDataFrame([(k % 2 or None, texts[k % 4 // 2], str(k)) for k in range(40)], "doc_id long, text string, x string")
    got = []
    for k in range(3):
        df.repartition(k + 1).write.parquet(str(tmp_path / str(k)))
        got.append(rows(op.deduplicate(spark.read.parquet(str(tmp_path / str(k))))))
    assert len(got[0]) == 1 and got[0] == got[1] == got[2]


def test_documents_that_only_share_buckets_are_not_joined(spark):
    """A shared passage in texts that are apart: buckets join nothing by themselves."""
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [passage + " " + " ".join(f"w{k}x{i}" for i in range(90)) for k in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert op.deduplicate(df).count() == 80


def signatures(words):
    e = [np.unique(np.array(w, np.uint64)) for w in words]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in e])])
    return op.sketch(op.mix(np.concatenate(e)), bounds)


@pytest.mark.parametrize("n", [1, 2, 5, 60, 3000])
def test_every_coordinate_fills(n):
    s = signatures([range(n), range(10**6, 10**6 + n)])
    assert (s != op.EMPTY).all()


def test_sketches_estimate_and_recall():
    rng = np.random.default_rng(0)
    errors, hits, tries = [], 0, 0
    for _ in range(150):
        j = rng.uniform(op.THRESHOLD, 0.95)
        n = 300
        shared = int(2 * n * j / (1 + j))
        base = rng.permutation(10**6)[: 2 * n - shared].tolist()
        s = signatures([base[:n], base[n - shared :]])
        true = shared / (2 * n - shared)
        errors.append((s[0] == s[1]).mean() - true)
        if true >= op.THRESHOLD:
            k = op.bands(s)
            hits, tries = hits + (k[0] == k[1]).any(), tries + 1
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05 and hits >= 0.97 * tries


def test_screening_skips_no_close_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 255, 128)
    sketches = np.array([np.where(rng.random(128) < rng.uniform(0.2, 0.9), base, rng.integers(0, 255, 128)) for _ in range(50)], np.uint8)
    labels = rng.integers(0, 20, 50)
    same = (sketches[:, None] == sketches[None]).sum(2) >= (0.5 - op.MARGIN) * 128
    want = {(i, j) for i in range(50) for j in range(i + 1, 50) if labels[i] != labels[j] and same[i, j]}
    assert set(zip(*(x.tolist() for x in op.close_pairs(sketches, labels, 0.5)))) == want
    across = set(zip(*(x.tolist() for x in op.close_pairs(sketches, labels, 0.5, 20))))
    assert across == {(i, j) for i, j in want if i < 20 <= j} and 0 < len(across) < len(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100}


def test_odd_rows(spark, odd, none):
    for docs in odd:
        got = op.stage(spark, docs, "")
        assert got.columns == docs.columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, i) for i in (1, 3, 4, 5, 6, 7, 9, 10)] + [(True, 0)]
    assert op.stage(spark, none, "").count() == 0
    nulls = odd[0].where("text IS NULL")
    assert rows(op.stage(spark, nulls, "")) == rows(nulls)

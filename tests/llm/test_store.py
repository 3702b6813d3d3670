from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import op01_store as op
from tessella.llm.op05_packing import TOKENIZER, encoding

from .conftest import LONG, ROWS, SF


def test_documents_come_back_and_chunks_are_stored_once(spark, documents):
    store = op.build(documents)
    m = op.manifests(store).cache()
    assert m.where("NOT verified").count() == 0 and m.count() == documents.count()
    payloads = store.where("payload IS NOT NULL")
    assert payloads.count() == payloads.select("digest").distinct().count() == store.select("digest").distinct().count()
    assert store.count() > payloads.count()  # the tables hold copies
    enc = encoding(TOKENIZER)
    texts = {r.doc_id: r.text for r in documents.collect()}
    some = m.limit(60)
    for r in op.reconstruct(store, some).collect():
        assert r.ids == enc.encode_ordinary(texts[r.doc_id])


def test_odd_rows(spark, odd, none):
    for docs in odd:
        m = op.manifests(op.build(docs))
        assert m.count() == sum(r[1] is not None for r in ROWS) and m.where("NOT verified").count() == 0
        assert {(r.n_tokens, r.n_chunks) for r in m.where("doc_id IN (4, 5)").collect()} == {(0, 1)}
    assert op.manifests(op.build(none)).count() == 0


def test_tampering_shows(spark, documents):
    store = op.build(documents.limit(20).coalesce(1))
    victim = store.where("payload IS NOT NULL AND n > 10").orderBy("digest").first()
    owners = {r.doc_id for r in store.where(F.col("digest") == F.lit(victim.digest)).collect()}
    broken = store.withColumn("payload", F.when((F.col("digest") == F.lit(victim.digest)) & F.col("payload").isNotNull(), F.lit(victim.payload[:-1] + b"?")).otherwise(F.col("payload")))
    assert {r.doc_id for r in op.manifests(broken).where("NOT verified").collect()} == owners
    lost = store.where(~((F.col("seq") == 0) & (F.col("doc_id") == victim.doc_id)))
    assert not any(r.verified for r in op.manifests(lost).where(F.col("doc_id") == victim.doc_id).collect())


def test_cuts_follow_the_content():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 50000, 20000).astype(np.uint32)
    b = np.concatenate([rng.integers(0, 50000, 777).astype(np.uint32), a])
    chunks = lambda x: [x[s:e].tobytes() for e_ in [op.cuts(len(x), op.candidates(x))] for s, e in zip([0, *e_], e_)]
    ca, cb = chunks(a), chunks(b)
    assert b"".join(ca) == a.tobytes() and b"".join(cb) == b.tobytes()
    assert all(op.LEAST * 4 <= len(c) <= op.MOST * 4 for c in ca[:-1])
    assert len(set(ca) & set(cb)) > 0.9 * len(ca)
    gear = op._GEAR
    for i in (40, 500):  # the doubling equals the plain sum
        want = sum(int(gear[int(a[i - j])]) << j for j in range(op.WINDOW)) & 0xFFFFFFFF
        assert (want >> (32 - op.MASK_BITS) == 0) == (i + 1 in set(op.candidates(a).tolist()))


def test_merkle_and_bytes():
    assert op.merkle([b"a", b"b", b"c"]) != op.merkle([b"a", b"c", b"b"]) and op.merkle([]) != op.merkle([b""])
    for ids in (np.array([1, 65535]), np.array([70000, 3]), np.array([], np.int64)):
        assert op.from_bytes(op.as_bytes(ids)).tolist() == ids.tolist()
    assert len(op.cuts(len(LONG), np.array([], int))) == -(-len(LONG) // op.MOST)


def plain_cuts(ids):
    """Chunks by the definition, hash by hash."""
    gear, out, at = [int(x) for x in op._GEAR], [], 0
    for i in range(len(ids)):
        h = sum((gear[int(ids[i - j]) & 0xFFFF] ^ int(ids[i - j]) >> 16) << j for j in range(min(op.WINDOW, i + 1))) & 0xFFFFFFFF
        n = i + 1 - at
        if n == op.MOST or n >= op.LEAST and h >> (32 - op.MASK_BITS) == 0:
            out.append(ids[at : i + 1])
            at = i + 1
    return [*out, ids[at:]] if at < len(ids) or not len(ids) else out


def plain_root(leaves):
    level = [sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0].hex()


def test_query_equals_brute_force(spark, documents):
    enc = encoding(TOKENIZER)
    want, stored = {}, {}
    for r in documents.collect():
        parts = [np.array(x, "<u2").tobytes() for x in plain_cuts(np.array(enc.encode_ordinary(r.text)))]
        names = [sha256(b"\2" + x).digest() for x in parts]
        stored |= {n: b"\2" + x for n, x in zip(names, parts)}
        want[r.doc_id] = (sum(map(len, parts)) // 2, plain_root(names), names)
    got = op.query(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.merkle_root, [bytes(x) for x in r.recipe]) for r in got if r.kind == "document"} == want
    chunk = [r for r in got if r.kind == "chunk"]
    assert {bytes(r.digest): bytes(r.payload) for r in chunk} == stored and len(chunk) == len(stored)
    assert all(r.verified for r in got if r.kind == "document")


def test_the_whole_table_comes_back(spark, documents, odd):
    enc = encoding(TOKENIZER)
    for docs in (documents.unionByName(documents), odd[0]):
        store = op.build(docs)
        got = op.reconstruct(store, op.manifests(store)).collect()
        want = sorted((r.doc_id or 0, enc.encode_ordinary(r.text)) for r in docs.select("doc_id", "text").collect() if r.text is not None)
        assert sorted((r.doc_id or 0, r.ids) for r in got) == want and all(r.intact for r in got)


def test_a_hot_chunk_is_spread(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'' AS text").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    store = op.build(docs)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert op.chunks(store).count() == 1 and store.select(F.spark_partition_id()).distinct().count() > 1
    assert op.manifests(store).where("verified AND n_tokens = 0").count() == 2000

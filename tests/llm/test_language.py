import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import op02_language as op

from .conftest import CLASHING, ROWS, SF


def counted(samples):
    """By context: next byte to its count."""
    counts = Counter()
    for t in samples:
        for i in range(len(t)):
            for k in range(min(op.ORDER, i) + 1):
                counts[t[i - k : i], t[i]] += 1
    by = {}
    for (c, x), n in counts.items():
        by.setdefault(c, {})[x] = n
    return by


def length(by, text):
    """Code length by the definition, context by context."""
    memo = {}

    def p(context, x):
        if (context, x) not in memo:
            memo[context, x] = fresh(context, x)
        return memo[context, x]

    def fresh(context, x):
        lower = (lambda y: p(context[1:], y)) if context else (lambda y: 1 / 256)
        seen = by.get(context)
        if not seen:
            return lower(x)
        left = 1 - sum(lower(y) for y in seen)
        q = len(seen) if left > 1e-12 else 0
        n = sum(seen.values())
        return seen[x] / (n + q) if x in seen else q / (n + q) * lower(x) / left

    return -sum(math.log2(p(text[max(0, i - op.ORDER) : i], text[i])) for i in range(len(text)))


def brute(samples, text):
    return length(counted(samples), text)


def test_code_lengths_equal_brute_force():
    rng = random.Random(2)
    texts = lambda letters: [bytes(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(4)]
    samples = {"a": texts(b"abc "), "b": texts(b"bcd\xc3")}
    model = op.train(samples)
    tests = [*texts(b"abcd z\xc3"), b"", b"q", b"abc"]
    off = np.concatenate([[0], np.cumsum([len(t) for t in tests])])
    got = op.code_lengths(model, np.frombuffer(b"".join(tests), np.uint8), off)
    for i, t in enumerate(tests):
        for k, name in enumerate(model.languages):
            assert abs(got[i, k] - brute(samples[name], t)) < 1e-3 * max(1, len(t))


def test_every_context_is_a_distribution():
    model = op.train({"x": [b"the cat sat", b"on the mat"], "y": [b"le chat"]})
    weight = np.ones(model.width)
    weight[-1] = 256 - (model.width - 1)
    for bits in model.bits:
        assert np.allclose((2.0 ** -bits.astype(float)).reshape(-1, model.width) @ weight, 1, atol=1e-5)


def test_held_out_accuracy(spark, documents):
    train, test = documents.where("doc_id % 2 = 0"), documents.where("doc_id % 2 = 1")
    model = op.train(op.labelled_sample(train))
    got = op.identify(test, model=model).select("doc.doc_id", "doc.lang", "language")
    assert got.where("lang = language").count() >= 0.97 * test.count() and got.count() >= 0.98 * test.count()


def test_sample_is_bounded(documents):
    s = op.labelled_sample(documents, train_docs=5)
    assert set(s) == {"de", "en", "es", "fr"} and all(0 < len(v) <= 5 for v in s.values())


def test_odd_rows(spark, odd, none):
    for docs in odd:
        got = op.stage(spark, docs, "")
        assert got.columns == docs.columns and {r.text for r in got.collect()} == {r[1] for r in ROWS if r[1]}
        assert got.count() == sum(bool(r[1]) for r in ROWS)
        assert {r[c] for r in got.select(*(f"`{c}`" for c in CLASHING)).collect() for c in CLASHING} == {"v"}
    assert op.stage(spark, none, "").count() == 0
    unlabelled = odd[0].withColumn("lang", F.lit(None).cast("string"))
    assert op.stage(spark, unlabelled, "").count() == len(ROWS)


def test_noise_is_rejected(spark, documents):
    rng = random.Random(1)
    noise = "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(300))
    docs = documents.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10**6, noise, "en")], "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in op.identify(docs, model=op.train(op.labelled_sample(documents))).select("doc.doc_id").collect()}
    assert 10**6 not in kept and len(kept) > 0.98 * documents.count()


def test_ids_have_no_bearing_on_the_sample(spark, documents, tmp_path):
    for k, doc_id in enumerate(("CAST(NULL AS BIGINT)", "CAST(7 AS BIGINT)")):
        path = str(tmp_path / str(k))
        documents.withColumn("doc_id", F.expr(doc_id)).repartition(3).write.parquet(path)
        s = op.labelled_sample(spark.read.parquet(path), train_docs=8)
        assert {x: len(v) for x, v in s.items()} == {"de": 8, "en": 8, "es": 8, "fr": 8}


def test_null_texts_do_not_thin_the_sample(spark, documents):
    some = documents.where("lang = 'de'").limit(5).select("doc_id", "text", "lang")
    many = spark.range(5000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text", "'de' AS lang")
    assert len(op.labelled_sample(some.unionByName(many))["de"]) == 5


def test_bytes_and_languages_are_bounded(spark):
    rows = [(i, "x" * 50_000, f"l{i % 40}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    s = op.labelled_sample(docs, train_bytes=120_000, languages=7)
    assert sorted(s) == sorted(sorted(f"l{i}" for i in range(40))[:7]) and all(len(v) == 3 for v in s.values())


def test_some_files_are_enough_where_they_hold_enough(spark, documents, tmp_path):
    documents.select("doc_id", "text", "lang").repartition(12).write.parquet(str(tmp_path / "t"))
    rare = spark.createDataFrame([(-1, "zzz yyy xxx", "xx")], "doc_id long, text string, lang string")
    rare.coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    s = op.labelled_sample(spark.read.parquet(str(tmp_path / "t")), train_docs=5, files=2)
    assert {x: len(v) for x, v in s.items()} == {"de": 5, "en": 5, "es": 5, "fr": 5, "xx": 1}


def test_query_equals_brute_force(spark, documents):
    samples = op.labelled_sample(documents)
    want = {}
    trees = {x: counted(t) for x, t in samples.items()}
    for r in documents.collect():
        data = r.text.encode()
        if not data or len(data) > 1500:
            continue
        bits = {x: length(trees[x], data) for x in sorted(trees)}
        best = min(bits, key=lambda x: (bits[x], x))
        if bits[best] <= op.REJECT_BITS * len(data) + op.REJECT_SLACK:
            want[r.doc_id] = (best, bits[best] / len(data))
    got = {r.doc_id: r for r in op.query(spark, SF).collect()}
    short = {r.doc_id for r in documents.collect() if r.text and len(r.text.encode()) <= 1500}
    assert short & set(got) == set(want) and len(want) > 20
    assert all(got[i].language == x and abs(got[i].bits_per_byte - b) < 2e-3 for i, (x, b) in want.items())


def test_the_stage_rejects_what_is_no_prose_and_fills_labels(spark, documents):
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    coded = ["".join(rng.choice(letters) for _ in range(2000)) for _ in range(3)]
    prose = documents.where("lang = 'fr' AND length(text) > 200").limit(20).select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    docs = documents.select("doc_id", "text", "lang").unionByName(prose).unionByName(spark.createDataFrame([(-i, t, None) for i, t in enumerate(coded)], "doc_id long, text string, lang string"))
    got = op.stage(spark, docs, "")
    assert got.where(F.col("text").isin(coded)).count() == 0 and got.where("lang IS NULL").count() == 0
    assert got.where(F.col("text").isin([r.text for r in prose.collect()]) & (F.col("lang") != "fr")).count() == 0

import random

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import op07_quality as op

from .conftest import SF, rows


def test_equals_sql(spark, db):
    got = {(r.doc_id, r.n_chars) for r in op.query(spark, SF).collect()}
    assert got == set(db.sql(op.SQL).limit(10**9).fetchall())


def test_order_has_no_bearing(documents):
    names = list(op.rules(F.col("text")))
    want = rows(documents.where(op.cascade(F.col("text"), names)).select("doc_id"))
    for seed in range(3):
        random.Random(seed).shuffle(names)
        assert rows(documents.where(op.cascade(F.col("text"), names)).select("doc_id")) == want


def test_order_is_by_rejection_per_cost(documents):
    found = op.estimate(documents)
    assert {n for n, *_ in found} == set(op.rules(F.col("text"))) and found[0][2] > 0 and sum(k for *_, k in found) > 0
    hits = np.array([[1, 1, 0], [1, 1, 0], [1, 0, 0], [0, 0, 1]], bool)
    # b rejects two rows at half the cost; what a still rejects beyond b is then worth less than c
    assert op.ordered(["a", "b", "c"], [2.0, 1.0, 1.5], hits) == [("b", 1.0, 2), ("c", 1.5, 1), ("a", 2.0, 1)]
    assert op.ordered(["a", "b"], [2.0, 1.0], hits[:0, :2]) == [("b", 1.0, 0), ("a", 2.0, 0)]


def test_labelled_junk_goes_and_clean_stays(spark, documents):
    kept = op.filter_quality(documents).select("doc_id")
    labels = spark.read.parquet(f"{SF}/labels.parquet").join(kept.withColumn("kept", F.lit(True)), "doc_id", "left")
    assert labels.where("quality = 1 AND kept IS NULL").count() == 0
    assert labels.where("quality = 0 AND kept").count() <= 0.1 * labels.where("quality = 0").count() + 1


def test_odd_rows(spark, odd, none):
    for docs in odd:
        got = op.stage(spark, docs, "")
        assert got.columns == docs.columns
        assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 2, 2, 9, 10]  # 7 and 8 repeat a handful of words
    assert op.stage(spark, none, "").count() == 0


def prose(n: int, seed: int = 1) -> list[str]:
    """Distinct one-line paragraphs without a repeated line, with function words as prose has."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnoprstuvw"
    vocabulary = ["".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(5000)]
    line = lambda: [w for x in rng.choices(vocabulary, k=20) for w in ([x] if rng.random() < 0.8 else [x, rng.choice(["the", "of", "and", "in"])])]
    return [" ".join(line()).capitalize() + "." for _ in range(n)]


def kept(spark, *texts: str) -> list[int]:
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in docs.where(op.cascade(F.col("text"), list(op.rules(F.col("text"))))).collect())


def test_blank_lines_are_no_repeats(spark):
    counts = (8, 9, 12, 40, 400)
    assert kept(spark, *["\n\n".join(prose(n)) for n in counts], *["\r\n \t\r\n".join(prose(n)) for n in counts]) == list(range(10))
    assert kept(spark, "\n\n".join(["The same line again."] * 5 + ["Another line."]), "\n" * 9 + "One line only.") == [1]


def test_length_alone_is_no_repetition(spark):
    rng = random.Random(2)
    clean = " ".join(prose(7000))  # 140,000 words of a vocabulary of 5,000
    passage = " ".join(prose(60))  # 1,200 words, more than a window
    few = " ".join(rng.choices(clean.split(" ")[:200], k=120_000))
    assert len(set(clean.split(" "))) < 0.3 * len(clean.split(" "))
    assert kept(spark, clean, " ".join([passage] * 100), few, "word " * 40) == [0]


def test_runs_of_spaces_are_no_words(spark):
    indented = "\n".join(" " * 30 + line for line in prose(20))
    assert kept(spark, indented, " " * 40 + "Three words only.") == [0, 1]


def broken(spark, text: str) -> list[str]:
    row = spark.createDataFrame([(text,)], "text string").select(*(c.alias(n) for n, c in op.rules(F.col("text")).items())).first()
    return [n for n, x in row.asDict().items() if x]


def test_each_rule(spark):
    lines = prose(12)
    table = "\n".join("| " + " | ".join(x.split()[:4]) + " |" for x in lines)
    assert broken(spark, "\n".join(lines)) == [] and broken(spark, lines[0] + "\n" + table) == []
    assert "pipes" in broken(spark, "\n".join(x.replace(" ", " | ") for x in lines))
    assert broken(spark, "\n".join("- " + x for x in lines)) == ["bullets"] and broken(spark, "\n".join([*lines, *("- " + x for x in lines)])) == []
    assert broken(spark, "\n".join(x[:-1] + "..." for x in lines)) == ["ellipses"]
    assert "lettered" in broken(spark, " ".join(f"12{i}.5 +" for i in range(60)))
    assert broken(spark, " ".join(x for x in " ".join(lines).split() if x not in ("the", "of", "and", "in"))) == ["stop_words"]
    assert "short_words" in broken(spark, " ".join("abcdefghijklmnop"[i % 16] for i in range(400)))
    assert "distinct_grams" in broken(spark, " ".join([" ".join(lines[:3])] * 12))
    block = " ".join(prose(10, 2))
    assert broken(spark, "\n".join([block, block, *lines[1:5]])) == ["repeated_chars"]
    assert broken(spark, " \n\t\r\n") == ["blank"]


def test_odd_texts_equal_sql(spark, db):
    import duckdb

    lines = prose(12)
    texts = ["", " \n", "x", "\n".join(lines), " ".join([" ".join(lines[:3])] * 12), "\n".join("- " + x for x in lines), "\n".join(x[:-1] + "…" for x in lines), "a | b | c " * 30, "\n\n".join(lines * 3), "日本語 " * 50, " ".join(f"{i}" for i in range(90)), "  ".join(lines), *(r[0] for r in db.sql("SELECT text FROM documents USING SAMPLE 20").fetchall())]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert kept(spark, *texts) == sorted(r[0] for r in con.sql(op.SQL).fetchall())

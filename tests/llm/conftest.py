import pytest

SF = "/root/testdata/sf0.001"
LONG = "word" + " lorem ipsum dolor sit amet consectetur" * 9000
ROWS = [
    (1, "The same text here, with some more words in it.", "en", "a", 1),
    (2, "The same text here, with some more words in it.", "en", "a", 1),
    (2, "The same text here, with some more words in it.", "en", "a", 1),
    (None, "The same text here, with some more words in it.", None, None, None),
    (3, None, "en", "a", None),
    (None, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, "", "de", "b", 0),
    (6, " \n\t \n", "de", "b", 5),
    (7, LONG, "en", "b", len(LONG)),
    (8, LONG + " end", "en", "b", len(LONG) + 4),
    (9, "Ein kurzer Satz über Äpfel und Öfen, 日本語 😀 mit Zeichen.", "de", "b", 50),
    (10, "x", "en", "b", 1),
]
CLASHING = ["f", "r", "n", "h", "doc", "bin", "language", "bits", "place", "key", "a.b", "c0", "fp"]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Rows with nulls, empty and very long texts, ties and repeats, and extra columns named like the operators' own; as a scan and not."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    df = spark.createDataFrame([(*r, *["v"] * len(CLASHING)) for r in ROWS], schema)
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path), df


@pytest.fixture(scope="session")
def none(odd):
    return odd[0].where("doc_id = -1")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def db():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import op06_counts as op
from tessella.llm.op05_packing import TOKENIZER, encoding

from .conftest import ROWS, SF


def test_counts_equal_the_tokenizer(spark, documents):
    enc = encoding(TOKENIZER)
    want = sorted((r.doc_id, len(enc.encode_ordinary(r.text)), True) for r in documents.collect())
    assert sorted(map(tuple, op.query(spark, SF).collect())) == want


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want, names = [], []
    for k, ids in enumerate([rng.choice([9, 1, 2, 3], 200), np.full(40, 9), np.full(33, 1), np.array([], int), np.array([9, 9, 1])]):
        path = tmp_path / f"{k}.bin"
        path.write_bytes(ids.astype("<u2").tobytes() + (b"\7" if k == 0 else b""))
        names.append((f"file://{path}",))
        at = -1
        ends = np.flatnonzero(ids == 9).tolist()
        for n, e in enumerate(ends):
            want.append((names[-1][0], n, e - at - 1, True))
            at = e
        if at < len(ids) - 1:
            want.append((names[-1][0], len(ends), len(ids) - 1 - at, False))
    files = spark.createDataFrame([*names, names[0], (None,)], "file string")
    assert sorted(map(tuple, op.count_tokens(files, 9, block).collect())) == sorted(want)


def test_odd_rows(spark, odd, none):
    for docs in odd:
        written = op.write_token_files(docs)
        got = op.count_tokens(written).join(written, ["file", "ordinal"]).collect()
        assert len(got) == sum(r[1] is not None for r in ROWS) and all(r.closed for r in got)
        assert {r.n_tokens for r in got if r.doc_id in (4, 5)} == {0}
        assert all(Path(r.file.removeprefix("file://")).exists() for r in got[:1])
    assert op.count_tokens(op.write_token_files(none)).count() == 0


def test_blocks_are_parted_by_bytes(spark, tmp_path):
    path = tmp_path / "x.bin"
    path.write_bytes(bytes(64 * op.TASK_BLOCKS * 5))
    blocks = op.blocks_of(spark.createDataFrame([(f"file://{path}",)], "file string"), 64)
    assert blocks.rdd.getNumPartitions() == 5 and blocks.count() == 5 * op.TASK_BLOCKS
    assert blocks.groupBy(F.spark_partition_id()).count().count() > 3

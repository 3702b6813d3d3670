import random
import struct
import time

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessella.llm import op04_pieces as op

from .conftest import ROWS

ODD = ["", " ", "   a", "a  b   c    d", "tab\t\ty", "é😀　x", "日本語テキスト混在 abc", "x\0y", "▁ under ▁▁", "a" * 300, "aaaa aaaaa" * 20, "<s> </s> <unk> <0x41>", "=====-----=====", "    " * 30]


def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("aeinrstlo  eth,.-=\n▁ü日") for _ in range(rng.randint(1, 40))) for _ in range(1500)]


def ids(m, ts):
    return [np.frombuffer(x, "<i4").tolist() for x in m.encode(ts)]


@pytest.fixture(scope="module")
def model():
    with open(op.MODEL, "rb") as f:
        return op.Model(f.read())


def test_bpe_equals_the_library(model, documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=op.MODEL)
    ts = texts() + [r.text for r in documents.collect()]
    assert ids(model, ts) == sp.encode(ts, num_threads=1)
    assert [model.decode(np.array(i, np.int64)).decode() for i in ids(model, ODD)] == [sp.decode(i) for i in sp.encode(ODD)]


def unigram_file():
    """The same pieces as a unigram model: only the type in the trainer's settings changes."""
    with open(op.MODEL, "rb") as f:
        data = f.read()

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in op._fields(data):
        if number == 1:  # scores that make a difference
            m = dict(op._fields(value))
            score = -abs(hash(m[1]) % 1000) / 100 - 1 if m.get(3, 1) == 1 else 0.0
            value = b"\x0a" + varint(len(m[1])) + m[1] + b"\x15" + struct.pack("<f", score) + (b"\x18" + varint(m[3]) if 3 in m else b"")
        elif number == 2:
            value = value.replace(b"\x12\x06tok_v0\x18\x02", b"\x12\x06tok_v0\x18\x01")
        out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def test_unigram_reaches_the_best_score():
    data = unigram_file()
    m, sp = op.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert m.kind == op.UNIGRAM
    ts = [t for t in texts() if "▁" not in t][:600]
    score = lambda x: sum(m.scores[i] for i in x if m.kinds[i] == op.NORMAL)
    mine, theirs = ids(m, ts), sp.encode(ts, num_threads=1)
    same = sum(a == b for a, b in zip(mine, theirs))
    assert same > 0.97 * len(ts)  # the rest are ties of equal score
    for a, b in zip(mine, theirs):
        assert score(a) == pytest.approx(score(b), abs=1e-2)


def test_generations_have_no_bearing(model, monkeypatch):
    ts = texts()[:300]
    want = ids(model, ts)
    monkeypatch.setattr(op, "REMEMBERED", 20)
    monkeypatch.setattr(op, "PAIRS", 50)
    assert [ids(model, [t])[0] for t in ts] == want


def test_odd_rows(odd, none, spark):
    for docs in odd:
        got = op.encode_documents(docs)
        assert got.count() == sum(r[1] is not None for r in ROWS) and got.where("NOT decoded_equal").count() == 0
        assert got.where("doc_id = 4").first().ids == []
    back = op.decode_ids(op.encode_documents(odd[0]).unionByName(spark.createDataFrame([(99, None)], "doc_id long, ids array<int>"), True))
    assert {(r.doc_id, r.text) for r in back.where(F.col("doc_id").isin(1, 9, 99)).collect()} == {(1, ROWS[0][1]), (9, ROWS[11][1]), (99, None)}
    assert op.encode_documents(none).count() == 0


def test_single_steps_equal_batches(model):
    rng = random.Random(3)
    for m in (model, op.Model(unigram_file())):
        for n in (1, 2, 5, 17, 60):
            some = ["".join(rng.choice("aeinrstlo日▁") for _ in range(n)) for _ in range(60)]
            found, close = m.viterbi(some)
            assert [x.tolist() for x in np.split(found, close[:-1])] == [m.single(x).tolist() for x in some]


def test_a_long_run_is_quick_and_right(model):
    sp = sentencepiece.SentencePieceProcessor(model_file=op.MODEL)
    assert ids(model, ["a" * 5000, "ab" * 4000, "=-" * 3000]) == sp.encode(["a" * 5000, "ab" * 4000, "=-" * 3000])
    began = time.perf_counter()
    (out,) = ids(model, ["a" * 1_000_000])
    assert time.perf_counter() - began < 30 and model.decode(np.array(out)) == b"a" * 1_000_000


def test_decoding_takes_odd_rows(spark):
    schema = "doc_id long, ids array<int>, text string"
    coded = spark.createDataFrame([(None, [], "v"), (1, None, "v"), (1, None, "v"), (2, [300, 301], None)], schema)
    got = op.decode_ids(coded).collect()
    assert len(got) == 4 and [r.text for r in got[:3]] == ["", None, None] and got[3].text
    assert op.decode_ids(coded.where("doc_id = 9")).count() == 0

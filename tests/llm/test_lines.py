import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import common
from tessella.llm import op03_lines as op

from .conftest import ROWS


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return before[-1]


def edited(rng, text, n, letters="abcdé "):
    out = list(text)
    for _ in range(n):
        k, at = rng.randint(0, 2), rng.randint(0, len(out))
        if k == 0:
            out.insert(at, rng.choice(letters))
        elif out and k == 1:
            out.pop(min(at, len(out) - 1))
        elif out:
            out[min(at, len(out) - 1)] = rng.choice(letters)
    return "".join(out)


@given(st.lists(st.tuples(st.text("abc", max_size=25), st.text("abc", max_size=25)), min_size=1, max_size=20), st.integers(0, 6))
@settings(max_examples=80, deadline=None)
def test_distances(pairs, t):
    a, b = zip(*pairs)
    assert op.edit_distances(list(a), list(b), t).tolist() == [min(distance(x, y), t + 1) for x, y in pairs]


def test_pairs_within_the_distance_meet():
    rng = random.Random(4)
    for t in (1, 2, 3):
        for _ in range(400):
            a = "".join(rng.choice("abc") for _ in range(rng.randint(3 * (t + 1), 30)))
            b = edited(rng, a, t, "abc")
            if len(a) < len(b):
                a, b = b, a
            if len(b) < 3 * (t + 1):
                continue
            p = common.prefix_hash(np.frombuffer((a + b).encode("utf-32-le"), np.uint32))
            entered = op.index_keys(p, np.array([len(a)]), np.array([len(b)]), t, 3 * (t + 1))[1]
            probed = op.probe_keys(p, np.array([0]), np.array([len(a)]), t, 3 * (t + 1))[1]
            assert set(entered.tolist()) & set(probed.tolist())


def test_a_distinct_line_is_keyed_once_over_several_tasks(spark):
    docs = [(k, f"a line that every document has\nline number {k % 7} of seven\n{k} is only here, in this line") for k in range(100)]
    lines = op.occurrences(spark.createDataFrame(docs, "doc_id long, text string").repartition(8))
    entered, probed = (op.keyed(lines, keys) for keys in (op.index_keys, op.probe_keys))
    assert entered.count() == 3 * (1 + 7 + 100) and entered.select("h").distinct().count() == 1 + 7 + 100
    assert probed.count() == probed.distinct().count()


def test_an_edit_flips_two_parities_at_most():
    rng = random.Random(5)
    for _ in range(2000):
        a = "".join(rng.choice("abcdé 日😀") for _ in range(rng.randint(3, 40)))
        n = rng.randint(0, 3)
        b = edited(rng, a, n, "abcdé 日😀xyz")
        chars = np.frombuffer((a + b).encode("utf-32-le"), np.uint32)
        x, y = op.parities(chars, np.array([0, len(a)]), np.array([len(a), len(b)])).tolist()
        assert (x ^ y).bit_count() <= 2 * n and max(x, y) < 1 << op.CLASSES


def test_a_family_that_shares_a_segment_does_not_become_pairs(spark, monkeypatch):
    written, write = {}, common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, name: written.setdefault(name, write(df, name)))
    rng = random.Random(6)
    family = ["the passage that all of them begin with " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(79)) + "." for _ in range(150)]
    docs = list(enumerate([*family, *(edited(rng, x, 2, "abcxyz") for x in family[::10])]))
    got = sorted(tuple(r) for r in op.judge_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert [g[2] for g in got] == ["first"] * 150 + ["near"] * 15 and [g[3] for g in got[150:]] == list(range(0, 150, 10))
    assert 15 <= written["met"].count() < 300  # of 11,175 pairs in the family alone


def brute(docs, t=op.DISTANCE, least=op.LEAST_CHARS):
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    lines = [(d[0], i, x) for d in order if d[1] is not None for i, x in enumerate(d[1].split("\n")) if x.strip(" ")]
    bounds = op.least_lengths(t, least)
    allowed = lambda x, y: max([e for e, n in bounds.items() if min(len(x), len(y)) >= n], default=0)
    first, out = {}, []
    for d, i, x in lines:
        if x in first:
            out.append((d, i, "exact", *first[x]))
            continue
        near = next(((e, j) for y, (e, j) in first.items() if abs(len(x) - len(y)) <= allowed(x, y) and allowed(x, y) and distance(x, y) <= allowed(x, y)), None)
        first[x] = (d, i)
        out.append((d, i, "near", *near) if near else (d, i, "first", None, None))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(5, 60))) + "x" for _ in range(30)]
    docs = [(k, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 4])) for _ in range(rng.randint(0, 8)))) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in op.judge_lines(df).collect())
    want = sorted(brute(docs))
    assert [g[:3] for g in got] == [w[:3] for w in want] and got == want
    assert {w[2] for w in want} == {"first", "exact", "near"}


def test_odd_rows(odd, none):
    for docs in odd:
        got = op.judge_lines(docs).collect()
        assert len(got) == sum(len([x for x in (r[1] or "").split("\n") if x.strip(" ")]) for r in ROWS)
        assert sum(r.verdict == "exact" for r in got) == 3 and [r.of_doc_id for r in got if r.verdict == "exact"] == [1, 1, 1]
    assert op.judge_lines(none).count() == 0

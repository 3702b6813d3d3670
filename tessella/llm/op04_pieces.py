"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Texts are split where no piece can reach across (before spaces, and between characters that no piece has side by side); equal segments are encoded once, and segments of equal length advance together, one
character a step. At each step the hashes of all substrings that end there probe the sorted hashes of the pieces, and the best
way to arrive is the maximum over them; its piece is the backpointer. Where too few segments share a length to fill a batch, as with one
very long run, the same recursion goes by single steps.

For a unigram model the score of a way is the sum of its pieces' scores. A BPE model has no such sum: there a way is valid, or not. A
sequence of pieces is what merging gives if and only if each piece merges from its own characters and merging each adjacent pair's
characters gives that pair; every prefix of a segment has exactly one valid last piece. So the same recursion runs over scores of 0
and minus infinity, with the pair test remembered in a table, and gives the ids that merging gives.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2
#: Words that a task remembers in each of two generations, and pairs of pieces, with a table in front of these. No bearing on the result.
REMEMBERED, PAIRS, SLOTS = 250_000, 2_000_000, 1 << 20
#: Segments of one length from which they advance as a batch. No bearing on the result.
BATCH = 48
UNKNOWN_PENALTY = 10.0
NEVER = float("inf")


def _fields(data: bytes):
    """(number, value) of a protocol buffer message's fields."""
    i = 0

    def varint():
        nonlocal i
        x = shift = 0
        while True:
            byte = data[i]
            i += 1
            x |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return x

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {5: 4, 1: 8}[kind]
            yield key >> 3, data[i : i + n]
            i += n


class Model:
    """Pieces, scores and settings of a SentencePiece model file of type unigram or BPE, without a normalisation table."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        self.kind, self.dummy_prefix, self.squeeze = UNIGRAM, True, True
        for number, value in _fields(data):
            if number == 1:
                m = dict(_fields(value))
                self.pieces.append(m.get(1, b"").decode())
                scores.append(struct.unpack("<f", m[2])[0] if 2 in m else 0.0)
                kinds.append(m.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                m = dict(_fields(value))
                self.dummy_prefix, self.squeeze = bool(m.get(3, 1)), bool(m.get(4, 1))
                if m.get(2) or not m.get(5, 1):
                    raise ValueError("models with a normalisation table, or that keep spaces as they are, are not supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.scores, self.kinds = np.array(scores), np.array(kinds)
        if (self.kinds == USER_DEFINED).any():
            raise ValueError("user-defined pieces are not supported")
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        self.byte = {int(self.pieces[i][3:5], 16): int(i) for i in np.flatnonzero(self.kinds == BYTE)}
        normal = np.flatnonzero(self.kinds == NORMAL)
        if any(SPACE in p.lstrip(SPACE) for p in (self.pieces[i] for i in normal)):
            raise ValueError("pieces that go on after a space are not supported")
        self.by_text = {self.pieces[i]: int(i) for i in normal}
        self.cost = {p: -float(self.scores[i]) for p, i in self.by_text.items()}.get
        self.longest = max(map(len, self.by_text), default=1)
        self.joints = np.unique([ord(a) << 21 | ord(b) for p in self.by_text for a, b in zip(p, p[1:])] or [0]).astype(np.int64)
        hashes = self._hash_all(list(self.by_text))
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.fromiter(self.by_text.values(), np.int64, len(normal))[order]
        if self.kind == BPE:  # pieces that merging never gives are no way to arrive
            ok = np.array([self.merge(self.pieces[i]) == [self.pieces[i]] for i in self.ids.tolist()], bool)
            self.keys, self.ids = self.keys[ok], self.ids[ok]
        # first place in the sorted keys by their top bits, so that a probe ends after a step or two
        self.top = np.searchsorted(self.keys, np.arange((1 << 18) + 1, dtype=np.uint64) << U64(46)).astype(np.int32)
        self.top[-1] = len(self.keys)
        self.deepest = int(np.diff(self.top).max()) if len(self.keys) else 0
        self.keys = np.append(self.keys, U64(0))
        self.ids = np.append(self.ids, -1)
        self.pairs: dict[int, bool] = {}
        self.slot_pair, self.slot_valid = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.valid = {self.pieces[i]: int(i) for i in self.ids[:-1].tolist()}
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k not in (NORMAL, UNKNOWN) else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds.tolist())]
        self.raw, self.raw_start = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])

    @staticmethod
    def _hash_all(texts: list[str]) -> np.ndarray:
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        return common.span_hash(common.prefix_hash(flat), ends - [len(t) for t in texts], ends)

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: the best-scored adjacent pair merges, the first of equals, until none does."""
        parts, cost = list(text), self.cost
        near = [cost(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while near and (best := min(near)) is not NEVER:
            i = near.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i:
                near[i - 1] = cost(parts[i - 1] + parts[i], NEVER)
            if i < len(near):
                near[i] = cost(parts[i] + parts[i + 1], NEVER)
        return parts

    def _adjacent(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the characters of both pieces gives these two pieces; -1 stands for an unknown character."""
        want = np.where((left >= 0) & (right >= 0), left * len(self.pieces) + right, -1)
        slot = (mix(want.astype(U64)) & U64(SLOTS - 1)).astype(np.int64)
        out = self.slot_valid[slot]
        miss = np.flatnonzero(self.slot_pair[slot] != want)
        if len(miss):
            known = self.pairs
            for i, k in zip(miss.tolist(), want[miss].tolist()):
                found = k < 0 or known.get(k)
                if found is None:
                    a, b = self.pieces[k // len(self.pieces)], self.pieces[k % len(self.pieces)]
                    found = known[k] = self.merge(a + b) == [a, b]
                out[i] = found
            self.slot_pair[slot[miss]], self.slot_valid[slot[miss]] = want[miss], out[miss]
            if len(known) > PAIRS:
                known.clear()
        out[want < 0] = True
        return out

    def probe(self, key: np.ndarray) -> np.ndarray:
        """Places of hashes among the sorted keys of the pieces; the end for those that are not there."""
        at = self.top[(key >> U64(46)).astype(np.int64)]
        for _ in range(self.deepest - 1):
            less = self.keys[at] < key
            less &= at < len(self.keys) - 1
            if not less.any():
                break
            at = at + less
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def viterbi(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of segments of equal length one after the other, where each segment's end); -1 stands for a character that no
        piece covers."""
        n, length = len(texts), len(texts[0])
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length)
        up, down = common.powers(length + 1)
        prefix = np.zeros((n, length + 1), U64)
        np.cumsum((chars.astype(U64) + U64(1)) * up[:length], axis=1, out=prefix[:, 1:])
        score = np.full((n, length + 1), -np.inf)
        score[:, 0] = 0
        last = np.full((n, length + 1), -2, np.int64)
        from_ = np.zeros((n, length + 1), np.int64)
        floor = float(self.scores[self.ids[:-1]].min()) - UNKNOWN_PENALTY if len(self.ids) > 1 else 0.0
        for end in range(1, length + 1):
            starts = np.arange(max(0, end - self.longest), end)
            key = mix((prefix[:, end, None] - prefix[:, starts]) * down[starts])
            piece = self.ids[self.probe(key)]
            hit = piece >= 0
            if self.kind == BPE:
                way = np.full(key.shape, -np.inf)
                way[:, -1] = np.where(hit[:, -1], -np.inf, 0)
                open_ = np.arange(n)
                while len(open_):  # of the pieces left, the longest; a row is done at its only valid one
                    col = hit[open_].argmax(1)
                    some = hit[open_, col]
                    open_, col = open_[some], col[some]
                    fits = (starts[col] == 0) | self._adjacent(last[open_, starts[col]], piece[open_, col])
                    way[open_[fits], col[fits]] = 0
                    hit[open_, col] = False
                    open_ = open_[~fits]
            else:
                way = np.where(hit, score[:, starts] + self.scores[piece], -np.inf)
                way[:, -1] = np.where(hit[:, -1], way[:, -1], score[:, end - 1] + floor)
            best = way.argmax(1)
            rows = np.arange(n)
            score[:, end] = way[rows, best]
            last[:, end] = piece[rows, best]
            from_[:, end] = starts[best]
        back = np.full((n, length), -2, np.int32)  # right-aligned
        at, live, place = np.full(n, length), np.arange(n), length
        while len(live):
            place -= 1
            back[live, place] = last[live, at[live]]
            at[live] = from_[live, at[live]]
            live = live[at[live] > 0]
        used = back > -2
        return back[used], np.cumsum(used.sum(1))

    def single(self, text: str) -> np.ndarray:
        """The pieces of one segment, as viterbi() gives them."""
        get, floor = self.valid.get, float(self.scores[self.ids[:-1]].min()) - UNKNOWN_PENALTY if len(self.ids) > 1 else 0.0
        last, from_, score, scores = [-2], [0], [0.0], self.scores.tolist()
        pairs, width = self.pairs, len(self.pieces)
        for end in range(1, len(text) + 1):
            best, at, top = -1, end - 1, -NEVER
            for start in range(max(0, end - self.longest), end):
                piece = get(text[start:end])
                if piece is None:
                    continue
                if self.kind == BPE:
                    left = last[start]
                    if start and left >= 0:
                        fits = pairs.get(left * width + piece)
                        if fits is None:
                            a, b = self.pieces[left], self.pieces[piece]
                            fits = pairs[left * width + piece] = self.merge(a + b) == [a, b]
                        if not fits:
                            continue
                    best, at = piece, start
                    break
                if score[start] + scores[piece] > top:
                    best, at, top = piece, start, score[start] + scores[piece]
            if self.kind != BPE:
                if get(text[end - 1 : end]) is None and score[end - 1] + floor > top:
                    best, at, top = -1, end - 1, score[end - 1] + floor
                score.append(top)
            last.append(best)
            from_.append(at)
        if len(pairs) > PAIRS:
            pairs.clear()
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at = from_[at]
        return np.array(out[::-1], np.int32)

    def _learn(self, units: list[str]) -> None:
        """Encodes units that aren't known: cut between characters that no piece has side by side, as no merge and no piece
        reaches across there; then by length."""
        flat = "".join(units)
        chars = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        joint = chars[:-1] << 21 | chars[1:]
        at = np.minimum(np.searchsorted(self.joints, joint), len(self.joints) - 1)
        cut = np.append(self.joints[at] != joint, True)
        ends = np.cumsum([len(u) for u in units])
        cut[ends - 1] = True
        stop = np.flatnonzero(cut) + 1
        parts = [flat[a:b] for a, b in zip([0, *stop.tolist()], stop.tolist())]
        fresh: dict[int, list[str]] = {}
        for p in set(parts):
            fresh.setdefault(len(p), []).append(p)
        done: dict[str, bytes] = {}
        for length, texts in fresh.items():
            step = max(1, (1 << 18) // (length + 1))
            for i in range(0, len(texts), step):
                some = texts[i : i + step]
                if len(some) < BATCH:
                    each = [self.single(x) for x in some]
                    found, close = np.concatenate(each), np.cumsum([len(x) for x in each])
                else:
                    found, close = self.viterbi(some)
                raw, odd = found.astype("<i4").tobytes(), set(np.searchsorted(close, np.flatnonzero(found < 0), "right").tolist())
                a = 0
                for k, (text, b) in enumerate(zip(some, (close * 4).tolist())):
                    done[text] = self._ids(text, found[a // 4 : b // 4]) if k in odd else raw[a:b]
                    a = b
        first = [0, *np.searchsorted(stop, ends, "right").tolist()]
        for u, a, b in zip(units, first, first[1:]):
            self.known[u] = done[parts[a]] if b == a + 1 else b"".join([done[p] for p in parts[a:b]])

    def _ids(self, text: str, found: np.ndarray) -> bytes:
        out, at = [], 0
        for p in found.tolist():
            if p >= 0:
                out.append(p)
            elif self.byte:
                out += [self.byte[b] for b in text[at].encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
            at += len(self.pieces[p]) if p >= 0 else 1
        return np.array(out, "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, four bytes each."""
        split = []
        for t in texts:
            if self.squeeze:
                t = re.sub(" +", " ", t.strip(" "))
            if not t:
                split.append([])
                continue
            t = (" " if self.dummy_prefix else "") + t
            if "  " in t or SPACE in t or not self.dummy_prefix:
                units = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", t.replace(" ", SPACE))
            else:
                units = (SPACE + t[1:].replace(" ", f"\0{SPACE}")).split("\0") if "\0" not in t else re.findall(f"{SPACE}+[^{SPACE}]*", t.replace(" ", SPACE))
            split.append(units)
        if len(self.known) > REMEMBERED:  # two generations: what is still in use moves to the new one
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for u in {u for x in split for u in x}:
            if u not in known:
                if u in older:
                    known[u] = older[u]
                else:
                    new.append(u)
        if new:
            self._learn(new)
        return [b"".join([known[u] for u in x]) for x in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of one text."""
        return self.decode_all(ids, np.array([len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of the texts whose ids end at the given places, all gathered at once; a leading space that stands for the dummy
        prefix goes."""
        size = self.raw_start[ids + 1] - self.raw_start[ids]
        close = np.concatenate([[0], np.cumsum(size)])
        data = self.raw[np.repeat(self.raw_start[ids] - close[:-1], size) + np.arange(close[-1])].tobytes()
        bounds = close[np.concatenate([[0], ends])].tolist()
        return [data[a + (self.dummy_prefix and data[a : min(a + 1, b)] == b" ") : b] for a, b in zip(bounds, bounds[1:])]


@lru_cache(2)
def model_of(data: bytes) -> Model:
    return Model(data)


def model(path: str) -> Model:
    with open(path, "rb") as f:
        return model_of(f.read())


def _coder(shipped):
    def code(batches):
        m = model_of(shipped.value)
        for batch in batches:
            _, off = common.utf8(batch.column(1))
            for lo, hi in common.slices(off, 2 << 20):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                coded = m.encode(texts)
                flat = np.frombuffer(b"".join(coded), "<i4")
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int64)
                back = [x == t.encode() for x, t in zip(m.decode_all(flat.astype(np.int64), ends[1:]), texts)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists, pa.array(np.diff(ends)), pa.array(back)], names=["doc_id", "ids", "n_ids", "decoded_equal"])

    return code


def encode_documents(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_ids, decoded_equal) of every row of docs with a text; decoded_equal says that the ids give the text back.

    Null texts have no row; an empty one has no ids. Characters that no piece covers become byte pieces where the model has them,
    else the unknown id. Repeated rows are coded each; very long texts whole; extra columns play no part; an empty table gives none.
    """
    common.bound_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of(docs).alias("text")).where("text IS NOT NULL")
    return common.dealt(rows, docs).mapInArrow(_coder(common.shipped_file(docs.sparkSession, path)), "doc_id long, ids array<int>, n_ids long, decoded_equal boolean")


def decode_ids(coded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), a row each. Null ids give a null text and no ids an empty one; null and repeated doc_ids, and
    repeated rows, are decoded each; texts whole, however long; extra columns play no part; an empty table gives an empty one. Null or
    unknown ids within raise."""
    shipped = common.shipped_file(coded.sparkSession, path)

    def back(batches):
        m = model_of(shipped.value)
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("an id is null")
            texts = m.decode_all(flat.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).astype(np.int64))
            texts = [t.decode("utf-8", "replace") if v else None for t, v in zip(texts, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(coded["doc_id"].cast("long").alias("doc_id"), "ids").mapInArrow(back, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

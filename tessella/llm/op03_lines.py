"""Near-duplicate lines by a segment-partition edit join.

Two lines within an edit distance of t share at least one of t + 1 segments into which either is cut evenly, nearly in place. So every
distinct line is entered under (length, segment number, segment) and probes, for each length within t of its own that isn't longer, the
substrings that a segment may have become, by the multi-match-aware choice of places. Keys and the lines' hashes go straight into the
exchange of the join, where repeats from several tasks fall together before anything is joined; it sorts and so can spill. The lower half of
a key holds parities of the line's character counts, of which an edit flips at most two: lines that share a segment but lie further apart are
told there, so that families of lines with a common passage do not leave the join as pairs. Only lines that pass move as texts. They are verified by a bit-parallel edit distance that keeps to the band of 2t + 1 diagonals, many pairs advancing
together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64, mix

DISTANCE = 2
#: Lines of fewer characters are near duplicates within one edit less for each halving, so 1 from 8 characters; below, only if equal.
LEAST_CHARS = 16


def least_lengths(t: int, least_chars: int) -> dict[int, int]:
    """Edits allowed to the fewest characters that the shorter line must have for so many."""
    return {e: max(least_chars >> (t - e), 2 * (e + 1)) for e in range(t, 0, -1)}


def segments(length: np.ndarray, e: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of the e + 1 even segments of lines of the given lengths; the last ones are longer by one where it doesn't divide."""
    size, over = length // (e + 1), length % (e + 1)
    out, start = [], np.zeros_like(length)
    for i in range(e + 1):
        own = size + (i >= e + 1 - over)
        out.append((start, own))
        start = start + own
    return out


def _keys(prefix: np.ndarray, begin: np.ndarray, length: np.ndarray, t: int, least_chars: int, probing: bool) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) for the segments of lines as long as these or, when probing, shorter by up to t: how many edits are allowed, and so
    segments cut, goes by the shorter line's length."""
    bounds, rows, keys = least_lengths(t, least_chars), [], []
    for e, low in bounds.items():
        for less in range(e + 1 if probing else 1):
            other = length - less
            at = np.flatnonzero((other >= low) & (other < bounds.get(e + 1, 1 << 62)))
            if not len(at):
                continue
            first, n, whole = begin[at], other[at], length[at]
            for i, (start, size) in enumerate(segments(n, e)):
                for move in range(max(-i, less - (e - i)), min(i, less + (e - i)) + 1) if probing else [0]:
                    fits = (start + move >= 0) & (start + move + size <= whole)
                    where = (first + start + move)[fits]
                    h = common.span_hash(prefix, where, where + size[fits])
                    keys.append(mix(h ^ (n[fits].astype(U64) * U64(0x9E3779B97F4A7C15) + U64(i + 1))).view(np.int64))
                    rows.append(at[fits])
    return (np.concatenate(rows), np.concatenate(keys)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def index_keys(prefix: np.ndarray, begin: np.ndarray, length: np.ndarray, t: int = DISTANCE, least_chars: int = LEAST_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which lines are entered: one for each segment."""
    return _keys(prefix, begin, length, t, least_chars, False)


def probe_keys(prefix: np.ndarray, begin: np.ndarray, length: np.ndarray, t: int = DISTANCE, least_chars: int = LEAST_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """The keys that lines look up: of lines as long or shorter, wherever a segment of theirs may lie."""
    return _keys(prefix, begin, length, t, least_chars, True)


#: Parities in the lower half of a key: one for each class of characters, enough to part the Latin letters.
CLASSES = 31
LOW_HALF = (1 << 32) - 1


def parities(chars: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each line, whether it has an odd number of characters of a class, a bit for each class. An edit flips two bits at most."""
    flips = np.zeros(len(chars) + 1, np.int64)
    np.bitwise_xor.accumulate(np.int64(1) << (chars % np.uint32(CLASSES)).astype(np.int64), out=flips[1:])
    return flips[begin + length] ^ flips[begin]


def _code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of rows and their offsets, from UTF-8."""
    chars = np.frombuffer(data[off[0] : off[-1]].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    leads = np.concatenate([[0], np.cumsum((data[off[0] : off[-1]] & 0xC0) != 0x80)])
    return chars, leads[off - off[0]]


def _segmenter(t: int, least_chars: int, keys_of):
    def cut(batches):
        seen: set[int] = set()
        for batch in batches:
            data, off = common.utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            for lo, hi in common.slices(off):
                fresh = []
                for k, h in enumerate(ids[lo:hi].tolist()):
                    if h not in seen:
                        fresh.append(k)
                        seen.add(h)
                if len(seen) > 1 << 18:  # a line sent twice is only work done twice: the exchange drops it
                    seen.clear()
                if fresh:
                    chars, o = _code_points(data, off[lo : hi + 1])
                    begin, length = o[:-1][fresh], np.diff(o)[fresh]
                    row, key = keys_of(common.prefix_hash(chars), begin, length, t, least_chars)
                    key = key & ~LOW_HALF | parities(chars, begin, length)[row]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][fresh][row]), pa.array(key)], names=["h", "key"])

    return cut


def edit_distances(a: list[str], b: list[str], t: int) -> np.ndarray:
    """Edit distance of each pair, or t + 1 if it is more than t. t at most 31.

    One word holds the vertical differences of the band; its top bit follows the diagonal t below the main one, and each column
    shifts the band down by one. When the diagonal has left the shorter string, the score follows the last row instead.
    """
    n = len(a)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    far = np.abs(la - lb) > t
    out = np.full(n, t + 1, np.int64)
    live = np.flatnonzero(~far)
    if not len(live):
        return out
    ma, mb = int(la[live].max()), int(lb[live].max())
    sa = np.full((max(ma, mb) + 2 * t + 2, len(live)), 0x110001, np.uint32)  # no character; rows start t before the line
    sb = np.full((mb, len(live)), 0x110000, np.uint32)
    for k, i in enumerate(live.tolist()):
        sa[t : t + la[i], k] = np.frombuffer(a[i].encode("utf-32-le", "surrogatepass"), np.uint32)
        sb[: lb[i], k] = np.frombuffer(b[i].encode("utf-32-le", "surrogatepass"), np.uint32)
    m, w = la[live], lb[live]
    one = U64(1)
    top = 63
    vp = np.full(len(live), (2**64 - 1) << (63 - t) & (2**64 - 1), U64)
    vn = np.zeros(len(live), U64)
    score = np.minimum(m, t)
    for j in range(mb):
        x = np.zeros(len(live), U64)
        for d in range(2 * t + 1):  # a[j - t + d] against b[j]
            x |= (sa[j + d] == sb[j]).astype(U64) << U64(top - 2 * t + d)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        below = j < m - t  # the top bit is still a row of a
        last = np.clip(top - 1 - (j - (m - t)), 0, 63).astype(U64)  # bit of a's last row
        step = np.where(below, ((d0 >> U64(top)) & one) ^ one, 0).astype(np.int64)
        flat = ((hp >> last) & one).astype(np.int64) - ((hn >> last) & one).astype(np.int64)
        score += np.where(j < w, np.where(below, step, flat), 0)
        vp = hn | ~((d0 >> one) | hp)
        vn = (d0 >> one) & hp
    out[live] = np.minimum(score, t + 1)
    return out


def _verify(t: int, least_chars: int):
    bounds = least_lengths(t, least_chars)

    def check(batches):
        for batch in batches:
            a, b = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            size = np.array([max(len(x), len(y)) for x, y in zip(a, b)] or [0])
            low = np.array([min(len(x), len(y)) for x, y in zip(a, b)], np.int64)
            allowed = sum((low >= x).astype(np.int64) for x in bounds.values())
            good = np.zeros(len(a), bool)
            order, at = np.argsort(size, kind="stable"), 0  # lines of like length together
            while at < len(a):
                end = at + max(1, min(4096, (4 << 20) // max(int(size[order[min(at + 4096, len(a)) - 1]]), 1)))
                some = order[at:end]
                good[some] = edit_distances([a[i] for i in some], [b[i] for i in some], t) <= allowed[some]
                at = end
            yield batch.select(["h", "h2", "g", "g2"]).filter(pa.array(good))

    return check


def occurrences(docs: DataFrame) -> DataFrame:
    """(h, h2, place, line) of every line that isn't blank; the hashes tell lines apart by 128 bits, places sort as judge_lines() says."""
    rows = common.numbered_texts(common.with_row_id(docs)).where("text IS NOT NULL").withColumn("c", F.xxhash64("text"))
    rows = common.dealt(rows, docs)
    lines = rows.select("f", "r", "doc_id", "c", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where("trim(line) <> ''")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "c", "line_no", "f", "r").alias("place")
    return lines.select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), place, "line")


def keyed(lines: DataFrame, keys_of, t: int = DISTANCE, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h, key, meet): the keys of every distinct line of lines (h, line), each once, parted by meet, their upper half; the lower half holds
    the line's parities."""
    common.bound_batches(lines.sparkSession)
    sent = lines.select("h", "line").mapInArrow(_segmenter(t, least_chars, keys_of), "h long, key long")
    meet = F.shiftright("key", 32)  # made on either side of the exchange, so that only h and key cross it
    return sent.repartition(meet).withColumn("meet", meet).dropDuplicates(["meet", "key", "h"])


def candidates(lines: DataFrame, t: int = DISTANCE, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h, g), h < g, once each: hashes of lines (h, line) that share a segment and whose parities leave room for t edits. No pair within the
    edits allowed is missing."""
    entered = keyed(lines, index_keys, t, least_chars)
    probed = keyed(lines, probe_keys, t, least_chars).withColumnsRenamed({"h": "g", "key": "probe"})
    close = F.bit_count(F.col("key").bitwiseXOR(F.col("probe"))) <= 2 * t  # the upper halves are equal
    met = entered.hint("merge").join(probed, "meet").where(close & (F.col("h") != F.col("g")))
    return met.select(F.least("h", "g").alias("h"), F.greatest("h", "g").alias("g")).distinct()


def near_lines(lines: DataFrame, t: int = DISTANCE, least_chars: int = LEAST_CHARS) -> tuple[DataFrame, DataFrame]:
    """For lines (h, h2, place, line): (h, h2, g, g2), pairs of distinct lines within the edits allowed to their length, either way
    around once, and (h, h2, first, line) of the lines that were compared, both written tables."""
    met = common.materialise(candidates(lines, t, least_chars), "met")
    wanted = common.materialise(met.select("h").union(met.select("g")).distinct(), "wanted")
    texts = lines.join(common.small_enough(wanted, 8), "h", "left_semi").groupBy("h", "h2").agg(F.min("place").alias("first"), F.first("line").alias("line"))
    texts = common.materialise(texts, "met-lines")
    pairs = met.join(texts.select("h", "h2", F.col("line").alias("x")), "h").join(texts.select(F.col("h").alias("g"), F.col("h2").alias("g2"), F.col("line").alias("y")), "g")
    near = pairs.select("h", "h2", "g", "g2", "x", "y").mapInArrow(_verify(t, least_chars), "h long, h2 long, g long, g2 long")
    return common.materialise(near, "near-lines"), texts


def judge_lines(docs: DataFrame, t: int = DISTANCE, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, line_no, verdict, of_doc_id, of_line_no) of every line that isn't blank.

    Lines stand in the order of doc_id (null last), then by a hash of the whole text where rows share a doc_id, then by line number. A line
    is "exact" if an earlier one is equal, with the first such; else "near" if an earlier distinct line is within the allowed edits
    (characters inserted, deleted or replaced), with the first such; else "first". t edits are allowed if both lines have at least
    least_chars characters, one less if half as many, and so on; see least_lengths(). A null or blank text has no line. Lines are compared
    whole, however long, and equal ones are told by 128 bits of hash. Repeated rows repeat lines. An empty table gives an empty one.
    Extra columns play no part.
    """
    lines = occurrences(docs)
    near, compared = near_lines(lines, t, least_chars)
    ends = near.unionByName(near.select(F.col("g").alias("h"), F.col("g2").alias("h2"), F.col("h").alias("g"), F.col("h2").alias("g2")))
    earlier = ends.join(compared.select(F.col("h").alias("g"), F.col("h2").alias("g2"), F.col("first").alias("other")), ["g", "g2"]).groupBy("h", "h2").agg(F.min("other").alias("other"))
    earlier = common.materialise(earlier, "earlier")
    # only lines that repeat or have a neighbour need more than their own place
    firsts = lines.groupBy("h", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    told = firsts.join(common.small_enough(earlier, 64), ["h", "h2"], "left")
    told = told.select("h", "h2", "first", F.when(F.col("other") < F.col("first"), F.col("other")).alias("near")).where((F.col("n") > 1) | F.col("near").isNotNull())
    told = common.materialise(told.select("h", "h2", *(F.col(f"first.{c}").alias(c) for c in ("f", "r", "line_no")), *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("first", "near") for c in ("doc_id", "line_no"))), "told")
    found = lines.select("h", "h2", F.struct("place.f", "place.r", "place.line_no").alias("at"), F.col("place.doc_id").alias("doc_id"))
    out = found.join(common.small_enough(told, 80), ["h", "h2"], "left")
    again = F.col("first_line_no").isNotNull() & (F.col("at") != F.struct("f", "r", "line_no"))
    verdict = F.when(again, "exact").when(F.col("near_line_no").isNotNull(), "near").otherwise("first").alias("verdict")
    of = lambda c: F.when(again, F.col(f"first_{c}")).otherwise(F.col(f"near_{c}"))
    return out.select("doc_id", F.col("at.line_no").cast("long").alias("line_no"), verdict, of("doc_id").alias("of_doc_id"), of("line_no").cast("long").alias("of_line_no"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Image files as tables, and a codec for 8-bit PNG, PGM/PPM and NPY that needs numpy and zlib only."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalars import file_stem
from tessella.operators import relate, select

SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".pgm", ".ppm", ".npy")
ALIASES = ("im", "Image", "images", "JPEGImages")


def list_images(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES, recursive: bool = False, any_case: bool = True) -> DataFrame:
    """(image_name, path, length, modificationTime, content) of the files with a suffix; content is read only where it is used."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.lower("path") if any_case else F.col("path")
    return df.where(F.lit(False) if not suffixes else name.rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")).select(file_stem(F.col("path")).alias("image_name"), "path", "length", "modificationTime", "content")


def image_folder(spark: SparkSession, root: str, aliases: tuple[str, ...] = ALIASES) -> str:
    """The first of the alias subfolders that exists; FileNotFoundError if none does."""
    for alias in aliases:
        try:
            spark.read.format("binaryFile").load(f"{root}/{alias}").schema  # noqa: B018
            return f"{root}/{alias}"
        except AnalysisException:
            continue
    raise FileNotFoundError(f"no image folder under {root}")


def discover(spark: SparkSession, root: str, datasets: list[str]) -> DataFrame:
    """(position, dataset, image_name, path) of all datasets, positions by path; names must be unique over all."""
    out = None
    for d in datasets:
        one = list_images(spark, image_folder(spark, f"{root}/{d}")).select(F.lit(d).alias("dataset"), "image_name", "path")
        out = one if out is None else out.unionByName(one)
    relate.require_unique(out, "image_name")
    return select.ranked(out, [F.col("path").asc()])


def decode(data: bytes) -> np.ndarray:
    """Array (height, width) or (height, width, channels) of an 8-bit PNG (not interlaced), PGM, PPM or NPY file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _decode_png(data)
    if data[:6] == b"\x93NUMPY":
        return np.load(io.BytesIO(data), allow_pickle=False)
    if data[:2] in (b"P5", b"P6"):
        fields, at = [], 2
        while len(fields) < 3:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            end = at
            while not data[end : end + 1].isspace():
                end += 1
            fields.append(int(data[at:end]))
            at = end
        w, h, _ = fields
        a = np.frombuffer(data, np.uint8, offset=at + 1)
        return a[: w * h].reshape(h, w) if data[:2] == b"P5" else a[: 3 * w * h].reshape(h, w, 3)
    raise ValueError("not a PNG, PGM, PPM or NPY file")


def _decode_png(data: bytes) -> np.ndarray:
    at, parts, palette, head = 8, [], None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    w, h, depth, colour, _, _, interlace = head
    if depth != 8 or interlace or colour not in (0, 2, 3, 4, 6):
        raise ValueError("only 8-bit PNG files without interlacing are supported")
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.uint8)
    above = np.zeros(w * c, np.int64)
    for y in range(h):
        line, kind = raw[y, 1:].astype(np.int64), raw[y, 0]
        if kind == 2:
            line = (line + above) & 255
        elif kind == 1:
            line = (np.cumsum(line.reshape(w, c), 0) & 255).ravel()
        elif kind in (3, 4):
            for i in range(w * c):
                left = int(line[i - c]) if i >= c else 0
                up, corner = int(above[i]), int(above[i - c]) if i >= c else 0
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((left, up, corner), key=lambda v: abs(p - v))
                line[i] = (int(line[i]) + guess) & 255
        out[y] = above = line
    a = out.reshape(h, w, c)
    return palette[a[:, :, 0]] if colour == 3 else a[:, :, 0] if c == 1 else a


def encode_png(a: np.ndarray) -> bytes:
    """8-bit gray or RGB."""
    a = np.ascontiguousarray(a, np.uint8)
    h, w = a.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def as_gray(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else a[:, :, 0] if a.shape[2] == 2 else np.rint(a[:, :, :3] @ [0.299, 0.587, 0.114]).astype(np.uint8)


def with_rasters(files: DataFrame, keep: list[str], gray: bool = True) -> DataFrame:
    """keep, then h, w, data (bytes, row-major) of the decoded content. Files that don't decode raise; nothing is skipped."""

    def run(frames):
        for pdf in frames:
            arrays = [as_gray(decode(bytes(c))) if gray else decode(bytes(c)) for c in pdf["content"]]
            yield pdf[keep].assign(h=[a.shape[0] for a in arrays], w=[a.shape[1] for a in arrays], data=[a.astype(np.uint8).tobytes() for a in arrays])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema)
    return files.select(*keep, "content").mapInPandas(run, f"{schema}, h int, w int, data binary")


def write_png(rows: DataFrame, folder: str) -> DataFrame:
    """Writes each row's raster (image_name, h, w, data) as <folder>/<image_name>.png on a file system that all tasks share, under
    another name first; returns (image_name, path, size)."""
    import uuid

    import pyarrow.fs as pafs

    uri = folder if "://" in folder else f"file://{folder}"

    def run(frames):
        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        for pdf in frames:
            sizes = []
            for name, h, w, data in zip(pdf["image_name"], pdf["h"], pdf["w"], pdf["data"]):
                png = encode_png(np.frombuffer(bytes(data), np.uint8).reshape(h, w))
                part = f"{base}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(png)
                fs.move(part, f"{base}/{name}.png")
                sizes.append(len(png))
            yield pd.DataFrame({"image_name": pdf["image_name"], "path": [f"{folder}/{n}.png" for n in pdf["image_name"]], "size": sizes})

    return rows.select("image_name", "h", "w", "data").mapInPandas(run, "image_name string, path string, size long")

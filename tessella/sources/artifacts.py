"""Immutable result artifacts: refuse-overwrite folders, canonical JSON, hashes, two-phase manifests, verified copies, reports.

Folders are local or shared paths of the driver; data itself is written by Spark."""

from __future__ import annotations

import hashlib
import json
import re
import shutil
import subprocess
import traceback
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")


def now() -> str:
    return datetime.now(UTC).isoformat()


def create(root: str | Path, experiment: str) -> Path:
    """A new folder; FileExistsError if there is one, ValueError for a bad id."""
    if not ID.fullmatch(experiment):
        raise ValueError(f"bad experiment id {experiment!r}")
    path = Path(root) / experiment
    path.mkdir(parents=True, exist_ok=False)
    return path


def write_json(path: str | Path, value: object) -> None:
    Path(path).write_text(json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def sha256_of(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def file_record(path: str | Path) -> dict:
    return {"path": str(path), "size": Path(path).stat().st_size, "sha256": sha256_of(path)}


def hashed(files: DataFrame) -> DataFrame:
    """(path, size, sha256) of a binaryFile scan, on the executors."""
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def git_state(repo: str | Path) -> dict:
    """Head, branch state and a hash of the diff; nulls where there is no repository."""

    def git(*args: str) -> str | None:
        r = subprocess.run(["git", "-C", str(repo), *args], capture_output=True, text=True)
        return r.stdout if r.returncode == 0 else None

    head, diff, status = git("rev-parse", "HEAD"), git("diff", "HEAD"), git("status", "--porcelain")
    return {"head": head.strip() if head else None, "dirty": bool(status) if status is not None else None, "diff_sha256": hashlib.sha256(diff.encode()).hexdigest() if diff is not None else None}


@contextmanager
def manifest(folder: Path, **facts: object):
    """Writes manifest.json as running, then as complete with what the block put into the dict, or as failed with the traceback."""
    state: dict = {"status": "running", "started": now(), **facts}
    write_json(folder / "manifest.json", state)
    try:
        yield state
    except BaseException as e:
        write_json(folder / "manifest.json", state | {"status": "failed", "ended": now(), "error": str(e), "traceback": traceback.format_exc()})
        raise
    write_json(folder / "manifest.json", state | {"status": "complete", "ended": now()})


def run_once(folder: Path, stage: Callable[[], object], counts: dict[str, tuple[int, int]] | None = None) -> bool:
    """Runs the stage unless its manifest is complete (then False); refuses a folder left incomplete; checks (found, expected)
    counts before anything."""
    for name, (found, expected) in (counts or {}).items():
        if found != expected:
            raise ValueError(f"{name}: {found} where {expected} are expected")
    path = Path(folder) / "manifest.json"
    if path.exists():
        if json.loads(path.read_text())["status"] == "complete":
            return False
        raise RuntimeError(f"{folder} holds an incomplete run")
    stage()
    return True


def write_jsonl(rows: Iterable[dict], path: str | Path) -> None:
    """Small audits from the driver, keys sorted. Large ones: DataFrame.write.json."""
    with open(path, "w", encoding="utf-8") as f:
        for r in rows:
            f.write(json.dumps(r, sort_keys=True, ensure_ascii=False) + "\n")


def write_csv(rows: DataFrame, path: str, mark: bool = False) -> None:
    """One file for a small table, columns in order; with a byte order mark where asked."""
    pdf = rows.toPandas()
    pdf.to_csv(path, index=False, encoding="utf-8-sig" if mark else "utf-8", lineterminator="\n")


def markdown(title: str, tables: dict[str, DataFrame], digits: int = 4) -> str:
    """A report of small tables; signed numbers print their sign once."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        cell = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join(map(cell, r)) + " |" for r in df.collect()] + [""]
    return "\n".join(out)


def copy_verified(source: str | Path, target: str | Path) -> dict:
    """Copies a file and compares hashes; the target must not exist."""
    if Path(target).exists():
        raise FileExistsError(target)
    shutil.copyfile(source, target)
    a, b = sha256_of(source), sha256_of(target)
    if a != b:
        raise OSError(f"copy of {source} differs")
    return {"source": str(source), "target": str(target), "sha256": a}

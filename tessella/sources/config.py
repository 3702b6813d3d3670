"""Configuration trees: JSON or YAML files with _BASE_ inheritance, merging, dotted overrides and type checks. Code is never run."""

from __future__ import annotations

import ast
import json
from copy import deepcopy
from pathlib import Path

try:
    import yaml
except ImportError:  # YAML files then raise
    yaml = None

BASE = "_BASE_"


def _read(path: Path) -> dict:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    if path.suffix in (".yaml", ".yml"):
        if yaml is None:
            raise ValueError("reading YAML needs a YAML library")
        return yaml.safe_load(text) or {}
    raise ValueError(f"{path.name}: only JSON and YAML are read")


def merged(over: dict, base: dict) -> dict:
    """base with over's values, dicts merged in depth."""
    out = deepcopy(base)
    for k, v in over.items():
        if isinstance(v, dict) and k in out:
            if not isinstance(out[k], dict):
                raise ValueError(f"cannot inherit {k}: not a tree in the base")
            out[k] = merged(v, out[k])
        else:
            out[k] = deepcopy(v)
    return out


def load(path: str | Path) -> dict:
    """The tree of a file over its bases (one or a list, later ones winning), paths relative to the file."""
    path = Path(path).expanduser()
    own = _read(path)
    bases = own.pop(BASE, [])
    out: dict = {}
    for b in [bases] if isinstance(bases, str) else bases:
        p = Path(b).expanduser()
        out = merged(load(p if p.is_absolute() else path.parent / p), out)
    return merged(own, out)


def override(tree: dict, pairs: list) -> dict:
    """Dotted keys and values in turn, e.g. ["a.b", 0.5]; keys must exist and types match (lists and tuples convert, null fits all)."""
    if len(pairs) % 2:
        raise ValueError("overrides are pairs of a key and a value")
    out = deepcopy(tree)
    for key, value in zip(pairs[::2], pairs[1::2]):
        *path, last = key.split(".")
        at = out
        for k in path:
            if not isinstance(at, dict) or k not in at:
                raise KeyError(f"no such key: {key}")
            at = at[k]
        if not isinstance(at, dict) or last not in at:
            raise KeyError(f"no such key: {key}")
        if isinstance(value, str):
            try:
                value = ast.literal_eval(value)
            except (ValueError, SyntaxError):
                pass
        old = at[last]
        if old is not None and value is not None and type(old) is not type(value):
            if isinstance(old, (list, tuple)) and isinstance(value, (list, tuple)):
                value = type(old)(value)
            else:
                raise ValueError(f"{key} is {type(old).__name__}, not {type(value).__name__}")
        at[last] = value
    return out

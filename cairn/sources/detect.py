"""What kind of tree a folder is, and its configuration; small driver-side helpers."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Detection:
    kind: str
    root: str | None
    confidence: str
    reason: str
    name: str | None = None


def is_engine(path: str) -> bool:
    return os.path.isdir(os.path.join(path, "Engine", "Source")) or os.path.isdir(os.path.join(path, "Engine"))


def plugin_name(path: str) -> str | None:
    found = sorted(f for f in os.listdir(path) if f.endswith(".uplugin")) if os.path.isdir(path) else []
    return found[0][: -len(".uplugin")] if found else None


def detect(path: str, parents: int = 5) -> Detection:
    """Engine root, else plugin, else an engine root up to ``parents`` folders above, else unknown."""
    if is_engine(path):
        return Detection("engine", path, "high", "holds an Engine folder")
    if name := plugin_name(path):
        return Detection("plugin", path, "high", "holds a plugin descriptor", name)
    up = path
    for _ in range(parents):
        up = os.path.dirname(up.rstrip("/")) or "/"
        if is_engine(up):
            return Detection("engine", up, "medium", "lies in an engine tree")
    return Detection("unknown", None, "low", "neither engine nor plugin")


def kind_of(engine: str, plugin: str, within: str) -> Column:
    """The same priorities over a table of path flags: struct<kind,confidence>."""
    answer = lambda k, c: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"))
    return F.when(F.col(engine), answer("engine", "high")).when(F.col(plugin), answer("plugin", "high")).when(F.col(within), answer("engine", "medium")).otherwise(answer("unknown", "low"))


def scan_root(path: str) -> str:
    return "engine" if os.path.isdir(os.path.join(path, "Engine")) else "plugin"


def engine_version(root: str, default: str = "unknown", info: str | None = None) -> str:
    """From the version file (or its text, ``info``), else the folder's name, else the default."""
    try:
        if info is None:
            with open(os.path.join(root, "Engine", "Build", "Build.version"), encoding="utf-8") as f:
                info = f.read()
        v = json.loads(info)
        return f"{v['MajorVersion']}.{v['MinorVersion']}.{v.get('PatchVersion', 0)}"
    except (OSError, ValueError, KeyError):
        m = re.search(r"\d+\.\d+(?:\.\d+)?", os.path.basename(root.rstrip("/")))
        return m[0] if m else default


class Config:
    """Nested settings with dot paths; storage paths are made absolute against the base folder."""

    DEFAULT = {"project": {"name": "", "engine_path": "", "version": "unknown"}, "storage": {"base_path": ".", "tables": "tables", "stages": "stages"}, "build": {"core_modules": ["Core", "CoreUObject", "Engine"], "partitions": 6}}

    def __init__(self, path: str | None = None, base: str = "."):
        self.path, self.data = path, json.loads(json.dumps(self.DEFAULT))
        if path and os.path.isfile(path):
            self._merge(self.data, self._read(path))
        root = os.path.abspath(base)
        for k, v in self.data["storage"].items():
            self.data["storage"][k] = os.path.normpath(os.path.join(root, v))

    @staticmethod
    def _read(path: str) -> dict:
        text = open(path, encoding="utf-8").read()
        if path.endswith(".json"):
            return json.loads(text)
        import yaml

        return yaml.safe_load(text) or {}

    def _merge(self, a: dict, b: dict) -> None:
        for k, v in b.items():
            if isinstance(v, dict) and isinstance(a.get(k), dict):
                self._merge(a[k], v)
            else:
                a[k] = v

    def get(self, key: str, default=None):
        at = self.data
        for part in key.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, key: str, value) -> None:
        *parts, last = key.split(".")
        at = self.data
        for p in parts:
            at = at.setdefault(p, {})
        at[last] = value

    def save(self) -> None:
        with open(self.path, "w", encoding="utf-8") as f:
            json.dump(self.data, f, indent=1)

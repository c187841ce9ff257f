"""Rules of users: a registry with a version gate and a path policy."""

from __future__ import annotations

import importlib.util
import sys
import zlib
from collections.abc import Callable
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.rules.catalog import RULES, Rule
from lintmill.rules.engine import PLUGIN_API

SUCCESS, DISABLED, NOT_FOUND, LOAD_ERROR, VERSION, EMPTY, REJECTED = (
    "Success", "Disabled", "FileNotFound", "LoadError", "VersionMismatch", "NoProviders", "PathRejected",
)


def _alone(path: Path):
    """Run a plug-in's file as a module of its own: modules beside it are its alone and not left in the interpreter."""
    spec = importlib.util.spec_from_file_location(f"lintmill_plugin_{zlib.crc32(str(path).encode()):08x}", path)
    module = importlib.util.module_from_spec(spec)
    known, beside = set(sys.modules), str(path.parent.resolve())
    sys.path.insert(0, beside)
    try:
        spec.loader.exec_module(module)
    finally:
        sys.path.remove(beside)
        for name in set(sys.modules) - known:
            if str(getattr(sys.modules[name], "__file__", None) or "").startswith(beside):
                del sys.modules[name]
    return module


class Registry:
    """Rules given as functions of a Script that yield findings."""

    def __init__(self):
        self.rules: list[tuple[Rule, Callable]] = []
        self.statuses: list[tuple[str, str, int]] = []

    def register(self, name: str, api: int, rules: list[tuple[Rule, Callable]]) -> str:
        """Take the rules of a provider; its API version must equal ours, ids must be new."""
        if api != PLUGIN_API:
            status, rules = VERSION, []
        elif not rules:
            status = EMPTY
        elif any(r.id in RULES for r, _ in rules):
            status, rules = LOAD_ERROR, []
        else:
            status = SUCCESS
            self.rules += rules
        self.statuses.append((name, status, len(rules)))
        return status

    def load(self, path: str, base: str, enabled: bool = True, allowed: bool = False) -> str:
        """Load a Python file below ``base`` that defines ``API`` and ``RULES``; only on request."""
        status = self._load(path, base, enabled, allowed)
        if status not in (SUCCESS, VERSION, EMPTY, LOAD_ERROR) or not self.statuses or self.statuses[-1][0] != path:
            self.statuses.append((path, status, 0))
        return status

    def _load(self, path: str, base: str, enabled: bool, allowed: bool) -> str:
        if not enabled or not allowed:
            return DISABLED
        p = path.replace("\\", "/")
        if p.startswith("/") or (len(p) > 1 and p[1] == ":") or ".." in PurePosixPath(p).parts:
            return REJECTED
        full = Path(base) / p
        if not full.is_file():
            return NOT_FOUND
        try:
            module = _alone(full)
            api, rules = module.API, list(module.RULES)
        except Exception:  # noqa: BLE001 - a plug-in may fail in any way
            return LOAD_ERROR
        return self.register(path, api, rules)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.statuses, "plugin string, status string, rules int")

    def summary(self, spark: SparkSession) -> DataFrame:
        return self.table(spark).groupBy("status").agg(F.count(F.lit(1)).alias("plugins"))

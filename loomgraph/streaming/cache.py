"""Results kept by fingerprint and graph version."""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

KINDS = ("query", "cypher", "neighbors", "vector", "hybrid", "fulltext", "spatial", "algorithm", "overlay", "page_search")


@dataclass
class VersionedCache:
    """An LRU of plans or values; an entry whose graph version has passed is stale and never returned."""

    most: int = 256
    entries: OrderedDict[tuple[str, str], dict] = field(default_factory=OrderedDict)
    hits: int = 0
    misses: int = 0

    @staticmethod
    def fingerprint(request: object) -> str:
        return hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()

    def put(self, kind: str, request: object, version: int, value: object) -> str:
        if kind not in KINDS:
            raise ValueError(f"unknown cache kind {kind}")
        key = (kind, self.fingerprint(request))
        self.entries[key] = {"version": version, "value": value.cache() if isinstance(value, DataFrame) else value}
        self.entries.move_to_end(key)
        while len(self.entries) > self.most:
            self._drop(next(iter(self.entries)))
        return key[1]

    def _drop(self, key: tuple[str, str]) -> None:
        old = self.entries.pop(key)["value"]
        if isinstance(old, DataFrame):
            old.unpersist()

    def check(self, kind: str, request: object, version: int) -> str:
        e = self.entries.get((kind, self.fingerprint(request)))
        return "miss" if e is None else "hit" if e["version"] == version else "stale"

    def get(self, kind: str, request: object, version: int) -> object | None:
        if self.check(kind, request, version) != "hit":
            self.misses += 1
            return None
        self.hits += 1
        key = (kind, self.fingerprint(request))
        self.entries.move_to_end(key)
        return self.entries[key]["value"]

    def explain(self, kind: str, request: object, version: int) -> dict:
        """What :meth:`get` would say, and why."""
        key = (kind, self.fingerprint(request))
        e = self.entries.get(key)
        return {"kind": kind, "key": key[1], "state": self.check(kind, request, version), "asked_version": version, "entry_version": None if e is None else e["version"], "place": None if e is None else list(self.entries).index(key)}

    def invalidate(self, kind: str | None = None, fingerprint: str | None = None, stale_before: int | None = None) -> int:
        gone = [k for k, e in self.entries.items() if (kind is None or k[0] == kind) and (fingerprint is None or k[1] == fingerprint) and (stale_before is None or e["version"] < stale_before)]
        for k in gone:
            self._drop(k)
        return len(gone)

    def stats(self) -> dict:
        return {"entries": len(self.entries), "hits": self.hits, "misses": self.misses, "by_kind": {k: sum(1 for x in self.entries if x[0] == k) for k in KINDS}}

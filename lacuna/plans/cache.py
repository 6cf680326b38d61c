"""Results kept by the fingerprint of their inputs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lacuna.functions.scalar import fingerprint


class ResultCache:
    """Parquet under root/fp=<digest>; a result is whole once its success file is there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.hits = self.misses = 0

    def key(self, inputs: dict[str, DataFrame], settings: str = "") -> str:
        """A digest of the inputs' rows, whatever their order, and of the settings."""
        import hashlib

        parts = [settings]
        for name in sorted(inputs):
            df = inputs[name]
            parts.append(name + "=" + fingerprint(df, df.columns, 32).first()[0])
        return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]

    def _at(self, key: str) -> str:
        return f"{self.root}/fp={key}"

    def has(self, key: str) -> bool:
        return self._fs.exists(self._path(self._at(key) + "/_SUCCESS"))

    def get(self, key: str, compute: Callable[[], DataFrame]) -> DataFrame:
        if self.has(key):
            self.hits += 1
        else:
            self.misses += 1
            compute().write.mode("overwrite").parquet(self._at(key))
        return self.spark.read.parquet(self._at(key))

    def invalidate(self, key: str | None = None) -> None:
        target = self._path(self._at(key) if key else self.root)
        if self._fs.exists(target):
            self._fs.delete(target, True)

    def _entries(self) -> list[tuple[int, str]]:
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted(((s.getModificationTime(), s.getPath().getName()[3:]) for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("fp=")), reverse=True)

    def prune(self, keep: int, max_age_days: float | None = None) -> list[str]:
        """Drops all but the newest entries, and those past the age."""
        old = []
        for i, (modified, key) in enumerate(self._entries()):
            if i >= keep or max_age_days is not None and time.time() - modified / 1000 > max_age_days * 86400:
                self.invalidate(key)
                old.append(key)
        return old

    def stats(self) -> dict[str, int]:
        return {"entries": len(self._entries()), "hits": self.hits, "misses": self.misses}

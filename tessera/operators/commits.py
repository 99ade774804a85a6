"""A log of commits: small files under consecutive numbers, each published by an atomic rename."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from tessera.sources.shared import names, publish_text, read_text, remove


class CommitLog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in names(self.spark, self.root) if n.endswith(".json") and n[0] != "."]

    def read(self, version: int | None = None) -> dict | None:
        """A commit by its number, or the last one; None where nothing was committed."""
        known = self.versions()
        version = version if version is not None else max(known, default=0)
        if not version:
            return None
        if version not in known:
            raise ValueError(f"there is no commit {version} any more")
        return json.loads(read_text(self.spark, self.path(version)))

    def publish(self, commit: dict) -> None:
        """The commit under its `version`; an error where another writer has taken that."""
        if not publish_text(self.spark, self.path(commit["version"]), json.dumps(commit)):
            raise RuntimeError(f"commit {commit['version']} was made by another writer")

    def forget(self, versions: list[int]) -> None:
        for version in versions:
            remove(self.spark, self.path(version))

    def path(self, version: int) -> str:
        return f"{self.root}/{version:012d}.json"

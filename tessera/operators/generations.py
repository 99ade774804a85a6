"""Complete versions of the warehouse: one active, one being built, some to fall back to.

A generation is a directory; what is active says the last of a log of small
files, so readers never see half a change.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, dataclass, replace

from pyspark.sql import SparkSession

from tessera.operators.commits import CommitLog
from tessera.sources.shared import remove

KEEP_DAYS = 7
GATE = 0.85


@dataclass(frozen=True)
class Generation:
    id: int
    status: str = "building"
    embedding_model: str = ""
    embedding_dim: int = 0
    config_version: str = ""
    retired_at: str | None = None
    eval_hit5: float | None = None
    eval_mrr: float | None = None
    build_total: int | None = None
    build_done: int | None = None
    note: str | None = None


class Registry:
    """The generations below a root that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/_generations")

    def all(self) -> list[Generation]:
        raw = self.log.read()
        self._version = raw["version"] if raw else 0
        return [Generation(**g) for g in raw["generations"]] if raw else []

    def ordered(self) -> list[Generation]:
        """The active one first, then from the newest."""
        return sorted(self.all(), key=lambda g: (g.status != "active", -g.id))

    def _save(self, generations: list[Generation]) -> None:
        """The version after the one read last; an error where another driver has written it meanwhile."""
        self.log.publish({"version": self._version + 1, "generations": [asdict(g) for g in generations]})

    def directory(self, generation: int, table: str) -> str:
        return f"{self.root}/g{generation}/{table}"

    def active(self) -> Generation | None:
        return next((g for g in self.all() if g.status == "active"), None)

    def candidate(self) -> Generation | None:
        return next((g for g in self.all() if g.status in ("building", "ready")), None)

    def create(self, model: str, dim: int, config: str = "") -> Generation:
        known = self.all()
        if any(g.status in ("building", "ready") for g in known):
            raise ValueError("a candidate generation is being built already")
        new = Generation(max((g.id for g in known), default=0) + 1, "building", model, dim, config)
        self._save([*known, new])
        return new

    def update(self, generation: int, **values) -> None:
        self._save([replace(g, **values) if g.id == generation else g for g in self.all()])

    def flip(self, generation: int, now: dt.datetime) -> None:
        """A candidate becomes active, what was active is retired; one write."""
        if not any(g.id == generation and g.status in ("building", "ready") for g in self.all()):
            raise ValueError(f"generation {generation} is no candidate")
        self._save([replace(g, status="active") if g.id == generation else replace(g, status="retired", retired_at=now.isoformat()) if g.status == "active" else g for g in self.all()])

    def rollback(self, now: dt.datetime) -> Generation:
        """Back to the generation that was retired last, if it is not too old."""
        since = (now - dt.timedelta(days=KEEP_DAYS)).isoformat()
        kept = [g for g in self.all() if g.status == "retired" and g.retired_at >= since]
        if not kept:
            raise ValueError("no generation to roll back to")
        back = max(kept, key=lambda g: g.retired_at)
        self._save([replace(g, status="active", retired_at=None) if g.id == back.id else replace(g, status="retired", retired_at=now.isoformat()) if g.status == "active" else g for g in self.all()])
        return back

    def discard(self, generation: int) -> None:
        if any(g.id == generation and g.status == "active" for g in self.all()):
            raise ValueError("the active generation cannot be discarded")
        self._save([g for g in self.all() if g.id != generation])
        remove(self.spark, f"{self.root}/g{generation}")

    def drop_expired(self, now: dt.datetime) -> list[int]:
        since = (now - dt.timedelta(days=KEEP_DAYS)).isoformat()
        old = [g.id for g in self.all() if g.status == "retired" and g.retired_at < since]
        for g in old:
            self.discard(g)
        return old

    def writable(self, now: dt.datetime) -> list[int]:
        """Every generation that takes changes: active first, then candidates and those one may fall back to."""
        since = (now - dt.timedelta(days=KEEP_DAYS)).isoformat()
        live = [g for g in self.all() if g.status in ("active", "building", "ready") or (g.status == "retired" and g.retired_at >= since)]
        return [g.id for g in sorted(live, key=lambda g: (g.status != "active", -g.id))]


def gate_reasons(candidate: Generation, live: Generation, errors: int, live_errors: int, questions: int) -> list[str]:
    """Why a candidate may not become active, in a fixed order; none means it may."""
    done, total = candidate.build_done or 0, candidate.build_total or 0
    hit, best = candidate.eval_hit5 or 0.0, live.eval_hit5 or 0.0
    # The wording that operators of the service know.
    checks = (
        (done < total, f"Build is not finished ({done} of {total} files)."),
        (errors > live_errors, f"More files failed than in the live generation ({errors} vs {live_errors})."),
        (not questions, "No eval questions configured (eval/questions.jsonl)."),
        (questions and hit < GATE, f"Eval hit@5 {hit:.2f} is below {GATE}."),
        (questions and hit < best, f"Eval hit@5 {hit:.2f} is below the live generation ({best:.2f})."),
    )
    return [text for failed, text in checks if failed]

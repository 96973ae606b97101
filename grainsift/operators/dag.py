"""Declarative stages with dependencies, outputs, checks and cost gates.

A stage runs when its dependencies are done. A failed stage is terminal until forced. State is a small dict that
the caller may store; a stage whose outputs verify is reconciled to done without running.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from grainsift.operators.scores import expectations


@dataclass(frozen=True)
class Stage:
    id: str
    run: Callable[[SparkSession], DataFrame]
    path: str
    deps: tuple[str, ...] = ()
    cost: float = 0.0
    checks: dict[str, Column] = field(default_factory=dict)


class Pipeline:
    """Stages by id; run() executes what is ready until nothing is."""

    def __init__(self, spark: SparkSession, stages: list[Stage], budget: float = float("inf"), state: dict[str, str] | None = None):
        self.spark, self.stages, self.budget, self.state = spark, {s.id: s for s in stages}, budget, dict(state or {})
        for s in stages:
            missing = [d for d in s.deps if d not in self.stages]
            if missing:
                raise ValueError(f"{s.id} needs unknown {missing}")
        self.spent = 0.0

    def ready(self) -> list[Stage]:
        return [s for s in self.stages.values() if self.state.get(s.id, "pending") == "pending" and all(self.state.get(d) == "done" for d in s.deps)]

    def verified(self, stage: Stage) -> bool:
        """Whether the output exists and passes its checks, evaluated as one aggregate."""
        try:
            out = self.spark.read.parquet(stage.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return False
            raise
        return not stage.checks or all(r.ok for r in expectations(out, stage.checks).collect())

    def reconcile(self) -> None:
        """Mark pending stages done whose outputs are there and verify."""
        for s in self.stages.values():
            if self.state.get(s.id, "pending") == "pending" and self.verified(s):
                self.state[s.id] = "done"

    def run(self, force: tuple[str, ...] = ()) -> dict[str, str]:
        for f in force:
            self.state[f] = "pending"
        while todo := [s for s in self.ready() if self.spent + s.cost <= self.budget]:
            for s in todo:
                if self.spent + s.cost > self.budget:
                    continue
                self.spent += s.cost
                try:
                    s.run(self.spark).write.mode("overwrite").parquet(s.path)
                    self.state[s.id] = "done" if self.verified(s) else "failed"
                except Exception as e:  # noqa: BLE001 - any failure of a stage is its state
                    self.state[s.id] = "failed"
                    self.error = f"{s.id}: {e}"
        return dict(self.state)

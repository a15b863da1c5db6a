"""Rubrics as data: a check is a list of criteria over a feature row, each worth some points.

A check may also have gates: conditions tested in order before the criteria (file missing, empty, bad JSON) that
fix the score. The registry lets callers add checks of their own; ids must be unique.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import constants as K

IMPORTANT, CRITICAL, MINOR = "important", "critical", "nice-to-have"
ISSUES = "array<struct<criterion:string,severity:string,got:int,max:int>>"


@dataclass(frozen=True)
class Criterion:
    name: str
    points: Column
    maximum: int
    severity: str = IMPORTANT


@dataclass(frozen=True)
class Gate:
    name: str
    condition: Column
    score: int
    severity: str = CRITICAL


@dataclass(frozen=True)
class Rubric:
    criteria: list[Criterion]
    gates: list[Gate] = field(default_factory=list)
    cap: Column | None = None  # an upper bound that depends on the row

    def result(self) -> Column:
        """Struct of score and issues. An issue is a criterion that did not earn its full points."""
        got = [F.coalesce(c.points, F.lit(0)).cast("int") for c in self.criteria]
        total = F.least(F.lit(100), reduce(lambda a, b: a + b, got))
        if self.cap is not None:
            total = F.least(total, self.cap)
        issues = F.filter(
            F.array(
                *[
                    F.struct(
                        F.lit(c.name).alias("criterion"), F.lit(c.severity).alias("severity"),
                        g.alias("got"), F.lit(c.maximum).alias("max"),
                    )
                    for c, g in zip(self.criteria, got)
                ]
            ),
            lambda i: i["got"] < i["max"],
        ).cast(ISSUES)
        out = F.struct(total.cast("int").alias("score"), issues.alias("issues"))
        for gate in reversed(self.gates):
            issue = F.array(
                F.struct(
                    F.lit(gate.name).alias("criterion"), F.lit(gate.severity).alias("severity"),
                    F.lit(0).alias("got"), F.lit(100).alias("max"),
                )
            ).cast(ISSUES)
            fixed = F.struct(F.lit(gate.score).alias("score"), issue.alias("issues"))
            out = F.when(gate.condition, fixed).otherwise(out)
        return out


def status_of(score: Column) -> Column:
    return F.when(score < K.FAIL_BELOW, "fail").when(score < K.PASS_FROM, "warn").otherwise("pass")


class CheckRegistry:
    """Check id -> (category, severity, weight, rubric builder)."""

    def __init__(self) -> None:
        self._checks: dict[str, tuple[str, str, int, Callable[[], Rubric]]] = {}

    def register(self, check_id: str, category: str, severity: str, weight: int, build: Callable[[], Rubric]) -> None:
        if check_id in self._checks:
            raise ValueError(f"check {check_id!r} is already registered")
        if category not in K.CATEGORIES:
            raise ValueError(f"unknown category {category!r}")
        self._checks[check_id] = (category, severity, weight, build)

    def ids(self) -> list[str]:
        return list(self._checks)

    def get(self, check_id: str) -> tuple[str, str, int, Callable[[], Rubric]]:
        return self._checks[check_id]

    def subset(self, ids: list[str] | tuple[str, ...]) -> "CheckRegistry":
        out = CheckRegistry()
        for check_id in ids:
            if check_id in self._checks:
                out.register(check_id, *self._checks[check_id])
        return out

    def results(self, features: DataFrame, *carry: str, name: str = "checks") -> DataFrame:
        """The columns ``carry`` and an array with one struct per check: check_id, category, severity, weight, score,
        status, issues. Narrow: all checks are one projection.

        A feature row with ``error`` set yields status ``error`` and score 0 for every check.
        """
        error = F.col("error") if "error" in features.columns else F.lit(None).cast("string")
        entries = [
            F.struct(
                F.lit(check_id).alias("check_id"), F.lit(category).alias("category"), F.lit(severity).alias("severity"),
                F.lit(weight).alias("weight"), F.when(error.isNull(), build().result()).alias("result"),
            )
            for check_id, (category, severity, weight, build) in self._checks.items()
        ]

        def finished(e: Column) -> Column:
            score = F.coalesce(e["result"]["score"], F.lit(0))
            return F.struct(
                *[e[c].alias(c) for c in ("check_id", "category", "severity", "weight")], score.alias("score"),
                F.when(e["result"].isNull(), F.lit("error")).otherwise(status_of(score)).alias("status"),
                F.coalesce(e["result"]["issues"], F.array().cast(ISSUES)).alias("issues"),
            )

        return features.select(*carry, F.transform(F.array(*entries), finished).alias(name))

    def run(self, features: DataFrame, key: str) -> DataFrame:
        """``results`` as a long table with one row per check."""
        return self.results(features, key).select(key, F.explode("checks").alias("c")).select(key, "c.*")

"""Scores of a scan from its check results, and comparisons between scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions.numbers import clamp, direction, percent_change, round_half_up

C = F.col


def _lookup(values: dict) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def with_check_dimension(checks: DataFrame) -> DataFrame:
    """Add category and weight of each check id; unknown ids get nulls. A literal map, not a join."""
    known = [c for c in ("category", "weight") if c in checks.columns]
    return checks.drop(*known).withColumns(
        {
            "category": F.try_element_at(_lookup({k: v[0] for k, v in K.CHECKS.items()}), C("check_id")),
            "weight": F.try_element_at(_lookup({k: v[2] for k, v in K.CHECKS.items()}), C("check_id")),
        }
    )


def _weighted(condition: Column) -> Column:
    """Weighted mean of clamped scores among counted rows, null if they carry no weight."""
    use = condition & (C("status") != "error") & C("weight").isNotNull()
    total = F.sum(F.when(use, clamp(C("score")) * C("weight")))
    weight = F.sum(F.when(use, C("weight")))
    return F.when(weight > 0, clamp(round_half_up(total / weight)))


def level_of(score: Column) -> Column:
    out = F.lit(3)
    for ceiling, level in reversed(K.LEVEL_CEILINGS):
        out = F.when(score <= ceiling, level).otherwise(out)
    return out


def scan_scores(checks: DataFrame, key: str = "scan_id", extra: tuple[Column, ...] = ()) -> DataFrame:
    """Overall, category, current and future scores and the readiness level: one aggregate, one shuffle by scan.

    ``extra`` adds aggregates of the caller to the same pass.

    Checks with status ``error`` and unknown ids are left out. A category nobody evaluated stays null.
    A level needs its gate checks (and those of lower levels) at 50 or more; an absent gate check is skipped.
    """
    evaluated = C("status") != "error"
    gates = {
        level: F.coalesce(
            F.bool_and(F.when(evaluated & C("check_id").isin(*ids), C("score") >= K.GATE_PASS)), F.lit(True)
        ).alias(f"_gate{level}")
        for level, ids in K.LEVEL_GATES.items()
    }
    everything = F.lit(True)
    out = with_check_dimension(checks).groupBy(key).agg(
        F.coalesce(_weighted(everything), F.lit(0)).alias("overall_score"),
        *[_weighted(C("category") == c).alias(c) for c in K.CATEGORIES],
        F.coalesce(_weighted(C("check_id").isin(*K.CURRENT_CHECKS)), F.lit(0)).alias("current_readiness"),
        F.coalesce(_weighted(C("check_id").isin(*K.FUTURE_CHECKS)), F.lit(0)).alias("future_readiness"),
        *gates.values(), *extra,
    )
    ceiling = level_of(C("overall_score"))
    passed = (
        F.when(~C("_gate1"), 0).when(~C("_gate2"), 1).when(~C("_gate3"), 2).otherwise(3)
    )
    return out.withColumn("readiness_level", F.least(ceiling, passed)).drop("_gate1", "_gate2", "_gate3")


def _in_category(name: str):
    return lambda c: c["category"] == name


def row_scores(rows: DataFrame, keep: list[str], checks: str = "checks") -> DataFrame:
    """The columns ``keep`` and the scores of ``scan_scores`` from an array of check structs in one row, without a shuffle.

    Each step names its columns, so that no expression is written out twice.
    """
    groups = {
        "overall_score": lambda c: F.lit(True), **{k: _in_category(k) for k in K.CATEGORIES},
        "current_readiness": lambda c: c["check_id"].isin(*K.CURRENT_CHECKS), "future_readiness": lambda c: c["check_id"].isin(*K.FUTURE_CHECKS),
    }
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("weight"))

    def sums(condition) -> Column:
        def add(s: Column, c: Column) -> Column:
            use = condition(c) & (c["status"] != "error") & c["weight"].isNotNull()
            weight = F.when(use, c["weight"]).otherwise(0)
            return F.struct((s["total"] + clamp(c["score"]) * weight).cast("long").alias("total"), (s["weight"] + weight).cast("long").alias("weight"))

        return F.aggregate(checks, zero, add)

    gate = lambda ids: F.forall(checks, lambda c: ~c["check_id"].isin(*ids) | (c["status"] == "error") | (c["score"] >= K.GATE_PASS))
    passed = F.coalesce(*[F.when(~gate(ids), F.lit(level - 1)) for level, ids in sorted(K.LEVEL_GATES.items())], F.lit(3))
    summed = rows.select(*keep, *[sums(f).alias("_" + k) for k, f in groups.items()], passed.alias("_passed"))
    mean = lambda k: F.when(C("_" + k)["weight"] > 0, clamp(round_half_up(C("_" + k)["total"] / C("_" + k)["weight"])))
    whole = ("overall_score", "current_readiness", "future_readiness")
    scored = summed.select(*keep, "_passed", *[(F.coalesce(mean(k), F.lit(0)) if k in whole else mean(k)).alias(k) for k in groups])
    return scored.select(*keep, *groups, F.least(level_of(C("overall_score")), C("_passed")).alias("readiness_level"))


def score_breakdown(checks: DataFrame, key: str = "scan_id") -> DataFrame:
    """Weight and contribution (in percent points of the whole) of every evaluated check.

    The total weight per scan is aggregated on its own and joined back, so no scan is sorted.
    """
    rows = with_check_dimension(checks).filter(C("status") != "error").select(
        key, "check_id", clamp(C("score")).alias("score"), F.coalesce("weight", F.lit(0)).alias("weight")
    )
    totals = rows.groupBy(key).agg(F.sum("weight").alias("total_weight"))
    return rows.join(totals, key).select(
        key, "check_id", "score", "weight",
        F.when(C("total_weight") > 0, round_half_up(C("score") * C("weight") * 100 / C("total_weight")) / 100)
        .otherwise(0.0).alias("weighted_score"),
        "total_weight",
    )


def compare_checks(checks: DataFrame, pairs: DataFrame, key: str = "scan_id") -> DataFrame:
    """Per-check comparison of paired scans (``primary_id``, ``competitor_id``): delta and won / lost / tied."""
    ok = checks.filter(C("status") != "error").select(key, "check_id", "score")
    a = pairs.join(ok.select(C(key).alias("primary_id"), "check_id", C("score").alias("primary_score")), "primary_id")
    b = ok.select(C(key).alias("competitor_id"), "check_id", C("score").alias("competitor_score"))
    delta = C("primary_score") - C("competitor_score")
    return a.join(b, ["competitor_id", "check_id"]).select(
        "primary_id", "competitor_id", "check_id", "primary_score", "competitor_score", delta.alias("delta"),
        direction(delta, "won", "lost", "tied").alias("result"),
    )


def compare_categories(scores: DataFrame, pairs: DataFrame, key: str = "scan_id") -> DataFrame:
    """Per-category comparison of paired scans; a side that was not evaluated counts as 0, two of them tie."""
    long = scores.select(
        key, F.explode(F.array(*[F.struct(F.lit(c).alias("category"), C(c).alias("score")) for c in K.CATEGORIES])).alias("e")
    ).select(key, "e.category", "e.score")
    a = pairs.join(long.select(C(key).alias("primary_id"), "category", C("score").alias("primary_score")), "primary_id")
    b = long.select(C(key).alias("competitor_id"), "category", C("score").alias("competitor_score"))
    delta = F.coalesce("primary_score", F.lit(0)) - F.coalesce("competitor_score", F.lit(0))
    return a.join(b, ["competitor_id", "category"]).select(
        "primary_id", "competitor_id", "category", "primary_score", "competitor_score", delta.alias("delta"),
        direction(delta, "won", "lost", "tied").alias("result"),
    )


def comparison_summary(compared: DataFrame, scores: DataFrame, pairs: DataFrame, key: str = "scan_id") -> DataFrame:
    """Overall scores of both sides and the number of checks won, lost and tied."""
    counts = compared.groupBy("primary_id", "competitor_id").agg(
        *[F.count_if(C("result") == r).alias(f"checks_{r}") for r in ("won", "lost", "tied")]
    )
    overall = lambda side: scores.select(
        C(key).alias(f"{side}_id"), C("overall_score").alias(f"{side}_overall")
    )
    joined = pairs.join(overall("primary"), "primary_id").join(overall("competitor"), "competitor_id")
    joined = joined.join(counts, ["primary_id", "competitor_id"], "left")
    return joined.select(
        "primary_id", "competitor_id", "primary_overall", "competitor_overall",
        (C("primary_overall") - C("competitor_overall")).alias("overall_delta"),
        *[F.coalesce(f"checks_{r}", F.lit(0)).alias(f"checks_{r}") for r in ("won", "lost", "tied")],
    )


def check_deltas(checks: DataFrame, pairs: DataFrame, key: str = "scan_id") -> DataFrame:
    """Check-level delta of paired snapshots (``before_id``, ``after_id``), with added and removed checks.

    ``change`` is improved / regressed / unchanged, or added / removed for one-sided checks.
    """
    rows = checks.filter(C("status") != "error").select(key, "check_id", "score")
    side = lambda name: pairs.join(
        rows.select(C(key).alias(f"{name}_id"), "check_id", C("score").alias(f"{name}_score")), f"{name}_id"
    )
    both = side("before").join(side("after"), ["before_id", "after_id", "check_id"], "full_outer")
    delta = C("after_score") - C("before_score")
    return both.select(
        "before_id", "after_id", "check_id", "before_score", "after_score", delta.alias("delta"),
        percent_change(C("before_score"), C("after_score"), 2).alias("percent"),
        F.when(C("before_score").isNull(), "added").when(C("after_score").isNull(), "removed")
        .otherwise(direction(delta)).alias("change"),
    )


def score_deltas(scores: DataFrame, pairs: DataFrame, key: str = "scan_id") -> DataFrame:
    """Score-level delta of paired snapshots. A category null on one side counts as 0, on both sides as null."""
    cols = ["overall_score", "readiness_level", "current_readiness", "future_readiness", *K.CATEGORIES]
    side = lambda name: scores.select(
        C(key).alias(f"{name}_id"), *[C(c).alias(f"{name}_{c}") for c in cols]
    )
    j = pairs.join(side("before"), "before_id").join(side("after"), "after_id")
    plain = lambda c: (F.coalesce(f"after_{c}", F.lit(0)) - F.coalesce(f"before_{c}", F.lit(0)))
    overall = plain("overall_score")
    return j.select(
        "before_id", "after_id", overall.alias("overall_delta"),
        percent_change(C("before_overall_score"), C("after_overall_score"), 2).alias("overall_percent"),
        plain("readiness_level").alias("level_delta"),
        plain("current_readiness").alias("current_delta"), plain("future_readiness").alias("future_delta"),
        *[
            F.when(C(f"before_{c}").isNotNull() | C(f"after_{c}").isNotNull(), plain(c)).alias(f"{c}_delta")
            for c in K.CATEGORIES
        ],
        direction(overall).alias("direction"),
    )


def snapshot_comparison(pairs: DataFrame) -> DataFrame:
    """Before/after comparison of two stored snapshots (columns ``before_*`` and ``after_*`` on one row).

    Here a sub-score delta is null as soon as one side is null; missing citation counts are 0.
    """
    delta = lambda c: C(f"after_{c}") - C(f"before_{c}")
    citations = F.coalesce("after_citations", F.lit(0)) - F.coalesce("before_citations", F.lit(0))
    return pairs.select(
        "before_id", "after_id", delta("overall").alias("overall_delta"),
        percent_change(C("before_overall"), C("after_overall"), 1).alias("overall_percent"),
        direction(delta("overall")).alias("overall_direction"),
        delta("level").alias("level_delta"), direction(delta("level")).alias("level_direction"),
        *[delta(c).alias(f"{c}_delta") for c in K.CATEGORIES],
        *[direction(delta(c)).alias(f"{c}_direction") for c in K.CATEGORIES],
        citations.alias("citation_delta"), direction(citations).alias("citation_direction"),
    )


def checks_by_category(checks: DataFrame, key: str = "scan_id") -> DataFrame:
    """Checks of a scan grouped by category in the fixed order. A scan has a bounded number of checks."""
    rank = F.array_position(F.array(*[F.lit(c) for c in K.CATEGORIES]), C("category"))
    entry = F.struct("check_id", "score", "status")
    return (
        with_check_dimension(checks).filter(C("category").isNotNull())
        .groupBy(key, "category").agg(F.array_sort(F.collect_list(entry)).alias("checks"))
        .withColumn("category_rank", rank)
    )


def illegal_transitions(history: DataFrame, allowed: tuple[tuple[str, str], ...], key: str, time: list[str]) -> DataFrame:
    """Status changes that the given state machine does not allow; a status without exits is terminal."""
    from sightline.operators.skew import previous_row

    moves = previous_row(history, [key], time, ["status"]).filter(
        C("previous_status").isNotNull() & (C("previous_status") != C("status"))
    )
    legal = F.array(*[F.concat_ws(">", F.lit(a), F.lit(b)) for a, b in allowed])
    exits = sorted({a for a, _ in allowed})
    return moves.filter(~F.array_contains(legal, F.concat_ws(">", "previous_status", "status"))).withColumn(
        "from_terminal", ~C("previous_status").isin(*exits)
    )

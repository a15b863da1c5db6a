"""Answer mining: answers -> mentions, rankings, benchmarks, source attributions and cost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.citations import add_sources, answer_cost, source_rows
from sightline.operators.mentions import add_kept, add_matches, mention_rows
from sightline.operators.rankings import add_competitor_counts, add_rankings, benchmark_rows, ranking_rows
from sightline.session import shared_table

C = F.col


@dataclass(frozen=True)
class Facts:
    mentions: DataFrame
    rankings: DataFrame
    benchmarks: DataFrame
    attributions: DataFrame
    costs: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(vars(self))


def mined(answers: DataFrame, config: DataFrame) -> DataFrame:
    """One row per answer with all mined arrays. Narrow after the join with the brand settings."""
    return add_competitor_counts(add_rankings(add_kept(add_matches(answers, config))))


def mined_answers(answers: DataFrame, config: DataFrame, provider: DataFrame | None = None) -> DataFrame:
    """``mined`` with the sources of each answer: all that the fact tables are made of."""
    return add_sources(mined(answers, config), provider)


def facts(rows: DataFrame) -> Facts:
    """The four fact tables and the cost per answer, from ``mined_answers``.

    Sources are attached to the first mention of their answer; answers without a mention get none.
    """
    cited = rows.filter(F.size("kept") > 0)
    first = cited.withColumn("mention_position", F.element_at("kept", 1)["at"])
    return Facts(
        mentions=mention_rows(rows),
        rankings=ranking_rows(rows),
        benchmarks=benchmark_rows(rows),
        attributions=source_rows(cited).join(first.select("snapshot_id", "mention_position"), "snapshot_id"),
        costs=rows.select(
            "snapshot_id", "project_id", "ai_engine", "queried_at",
            answer_cost(C("model"), C("input_tokens"), C("output_tokens")).alias("cost_cents")),
    )


def mine_answers(answers: DataFrame, config: DataFrame, provider: DataFrame | None = None) -> Facts:
    """Facts of one mining pass: the mined rows are written once to the shared folder, and every table is read from there."""
    return facts(shared_table(mined_answers(answers, config, provider), "mined"))

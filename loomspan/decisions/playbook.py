"""Playbooks: which actions suit a risk, what they cost, which were decided, and what came of it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .risk import SUBJECT

CALCULATORS = ("none", "quantity_x_rate")


@dataclass(frozen=True)
class Action:
    name: str
    calculator: str = "none"
    quantity: str | None = None
    params: dict[str, tuple[float, float]] = field(default_factory=dict)
    needs_cost: bool = False


@dataclass(frozen=True)
class Playbook:
    """``pattern`` is rule: levels; a risk matches if one of the rule's own levels is among them."""

    name: str
    rule: str
    levels: tuple[str, ...]
    actions: tuple[Action, ...]


PLAYBOOKS = [
    Playbook("defects", "dhu", ("red", "amber"), (Action("extra inspection", "quantity_x_rate", "Checked", {"share": (0.0, 1.0)}, True), Action("line meeting"))),
    Playbook("rejects", "reject_pct", ("red",), (Action("rework", "quantity_x_rate", "Rejected", {"share": (0.0, 1.0)}, True), Action("stop line", needs_cost=True))),
]


def problems(books: list[Playbook]) -> list[str]:
    out = [f"{b.name}: no actions" for b in books if not b.actions]
    for b in books:
        for a in b.actions:
            if a.calculator not in CALCULATORS:
                out.append(f"{b.name}/{a.name}: no calculator {a.calculator}")
            if a.calculator == "quantity_x_rate" and not a.quantity:
                out.append(f"{b.name}/{a.name}: a quantity is needed")
            out += [f"{b.name}/{a.name}: {p} has no room" for p, (low, high) in a.params.items() if low > high]
    return out


def check_params(action: Action, given: dict[str, float]) -> list[str]:
    return [f"{p} is missing" for p in action.params if p not in given] + [f"{p} is not within {low} to {high}" for p, (low, high) in action.params.items() if p in given and not low <= given[p] <= high] + [f"{p} is unknown" for p in given if p not in action.params]


def options(assessed: DataFrame, costs: DataFrame, books: list[Playbook] | None = None) -> DataFrame:
    """Each matching action of each subject at red or amber, its price, and the reasons why it isn't ready.

    ``assessed`` has the subject, the level, a level for each rule (``<measure>_level``) and quantities; ``costs`` has
    (action, rate). The playbooks are a fixed few, so they are expanded by a union of filters.
    """
    out = None
    for b in books or PLAYBOOKS:
        hit = assessed.where(F.col("level").isin("red", "amber") & F.col(f"{b.rule}_level").isin(*b.levels))
        for a in b.actions:
            quantity: Column = F.col(a.quantity).cast("double") if a.quantity else F.lit(None).cast("double")
            one = hit.select(*SUBJECT, "level", F.lit(b.name).alias("playbook"), F.lit(a.name).alias("action"), quantity.alias("quantity"), F.lit(a.needs_cost).alias("needs_cost"), F.lit(a.calculator).alias("calculator"))
            out = one if out is None else out.unionByName(one)
    priced = out.join(F.broadcast(costs), "action", "left")  # the cost file: a row for each action
    cost = F.when(F.col("calculator") == "quantity_x_rate", F.round(F.col("quantity") * F.col("rate"), 2)).when(F.col("needs_cost"), F.col("rate"))
    reasons = F.array_compact(F.array(F.when(F.col("needs_cost") & F.col("rate").isNull(), "no rate"), F.when((F.col("calculator") == "quantity_x_rate") & F.coalesce(F.col("quantity") <= 0, F.lit(True)), "no quantity")))
    return priced.select(*SUBJECT, "level", "playbook", "action", cost.alias("cost"), F.array_join(reasons, ", ").alias("reasons"))


def ranked(offers: DataFrame) -> DataFrame:
    """Red first, by factory and subject; priced before unpriced, the cheapest first."""
    return offers.orderBy((F.col("level") != "red"), *SUBJECT, F.col("cost").isNull(), "cost", "playbook", "action")


def newest_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions are appended; the newest of a recommendation is current."""
    return decisions.groupBy("recommendation_id").agg(F.max_by(F.struct("id", "choice", "decided_at"), "id").alias("d")).select("recommendation_id", "d.*")


def decision_outcomes(decisions: DataFrame, recommendations: DataFrame, predictions: DataFrame) -> DataFrame:
    """What was decided, and what the newest later prediction of the subject says; whether the outcome came after."""
    d = newest_decisions(decisions).join(recommendations, "recommendation_id")
    first = predictions.select(F.col("id").alias("prediction_id"), *SUBJECT, F.col("level").alias("level_then"), "outcome_at", "outcome_level")
    joined = d.join(first, "prediction_id")
    newest = predictions.groupBy(*SUBJECT).agg(F.max("id").alias("newest_id"), F.max_by("level", "id").alias("newest_level"))
    now = F.when(F.col("newest_id") > F.col("prediction_id"), F.col("newest_level")).alias("level_now")
    return joined.join(newest, SUBJECT).select("recommendation_id", "choice", *SUBJECT, "level_then", now, "outcome_level", (F.col("outcome_at") >= F.col("decided_at")).alias("after_decision"))

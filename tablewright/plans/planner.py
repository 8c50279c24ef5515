"""From findings to an ordered plan with risks, and its review."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame

from tablewright.functions.exprs import identifier_like
from tablewright.functions.values import DATE_ORDERS, ORDER, PLANNED_ORDER, RISK, RISKS
from tablewright.model import Finding, PlannedAction
from tablewright.operators.actions import ACTIONS, kinds
from tablewright.operators.profile import is_number


class Advisor(Protocol):
    """May refine a plan; what it proposes passes the same rules, and it can only raise a risk."""

    def advise(self, findings: Sequence[Finding], goal: str) -> list[PlannedAction]: ...


def risk_of(action: str, params: dict | None = None) -> str:
    """The least risk of an action."""
    params = params or {}
    if action == "handle_outliers":
        return "low" if params.get("method", "clip") == "flag" else "high"
    if action in ("enforce_range", "enforce_date_range") and params.get("mode") == "drop_rows":
        return "high"
    return RISK.get(action, "low")


def suggested(findings: Sequence[Finding]) -> list[PlannedAction]:
    """One action for each finding, from its own suggestion."""
    out = []
    for f in findings:
        name = f.suggested_action if f.suggested_action in ACTIONS else "none"
        params = dict(f.suggested_params) if name != "none" else {}
        out.append(PlannedAction(f.id, name, params, f"By rule: {f.title}", risk_of(name, params), ORDER.get(name, 50)))
    return out


def refusal(planned: PlannedAction, finding: Finding, df: DataFrame, date_order: str | None = None) -> str | None:
    """Why an action would harm this table; None if it is fine."""
    if planned.action not in ACTIONS or not isinstance(planned.params, dict):
        return "Left out: no such action."
    named = planned.params.get("columns") or planned.params.get("subset") or []
    named = finding.columns if named in ("all", "*") else [named] if isinstance(named, str) else list(named)
    one = planned.params.get("column")
    if any(c not in df.columns for c in [*named, *([one] if one is not None else [])]):
        return "Left out: a column isn't there."
    about = named or finding.columns
    if planned.action in PLANNED_ORDER and finding.category != "duplicates":
        return "Left out: rows only go for findings about duplicates."
    if planned.action == "fill_missing":
        if any(map(identifier_like, about)):
            return "Not filled: identifiers and contact data must not be made up."
        if any(not is_number(kinds(df)[c]) for c in about):
            return "Not filled: text and dates would be made up. Choose a value if one is wanted."
    if planned.action == "cast_numeric" and any(map(identifier_like, about)):
        return "Not converted: identifiers are no quantities."
    if planned.action == "cast_datetime" and finding.evidence.get("ambiguous") and date_order not in DATE_ORDERS:
        return "Needs a decision: are the dates day first (dmy) or month first (mdy)?"
    return None


def build_plan(df: DataFrame, findings: Sequence[Finding], date_order: str | None = None, advisor: Advisor | None = None, goal: str = "") -> list[PlannedAction]:
    by_id = {f.id: f for f in findings}
    plan = {p.finding_id: p for p in suggested(findings)}
    if advisor is not None:
        plan |= {p.finding_id: p for p in advisor.advise(findings, goal) if p.finding_id in by_id}
    for p in plan.values():
        f = by_id[p.finding_id]
        if p.action == "cast_datetime" and f.evidence.get("ambiguous") and date_order in DATE_ORDERS:
            p.params = p.params | {"dayfirst": DATE_ORDERS[date_order]}
            p.rationale, p.source = f"The order of day and month was given: {date_order}.", "user"
        if reason := refusal(p, f, df, date_order):
            p.action, p.params, p.order, p.risk, p.rationale = "none", {}, ORDER["none"], "low", reason
            continue
        p.order = PLANNED_ORDER.get(p.action, ORDER.get(p.action, 50))
        p.risk = max(p.risk if p.risk in RISKS else "low", risk_of(p.action, p.params), key=RISKS.index)
    return sorted(plan.values(), key=lambda p: (p.order, p.finding_id))


def review(plan: list[PlannedAction], approve_up_to: str = "medium", approve_ids: Sequence[str] = ()) -> list[PlannedAction]:
    """Approve actions up to a risk ('none' approves none), and those of the findings named."""
    most = RISKS.index(approve_up_to) if approve_up_to in RISKS else -1
    for p in plan:
        p.approved = p.action != "none" and (RISKS.index(p.risk) <= most or p.finding_id in set(approve_ids))
    return plan

"""The cleaning loop: ingest, scan, plan, review, apply, verify; an audit trail and a recipe that can be replayed."""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright import __version__
from tablewright.functions import exprs as X
from tablewright.functions.values import SEVERITY
from tablewright.model import RID, STEP_SCHEMA, DataError, Finding, PlannedAction, Step
from tablewright.operators.actions import ACTIONS
from tablewright.operators.checks import findings_table, report, scan
from tablewright.operators.profile import nan_to_null, with_row_numbers
from tablewright.plans.planner import Advisor, build_plan, review
from tablewright.sources.readers import read_any
from tablewright.sources.writers import write_any

log = logging.getLogger(__name__)
Recipe = list[tuple[str, dict[str, Any]]]


def replay(df: DataFrame, recipe: Recipe | str) -> DataFrame:
    """Apply a recipe (or its JSON) to a table."""
    for name, params in json.loads(recipe) if isinstance(recipe, str) else recipe:
        if name not in ACTIONS:
            raise DataError(f"no such action: {name}")
        df = ACTIONS[name].run(df, **params)[0]
    return df


class Cleaner:
    """One table on its way. The working copy is checkpointed between rounds where spark.checkpoint.dir is set, so that plans don't grow."""

    def __init__(self, spark: SparkSession, source: Any, goal: str = "", date_order: str | None = None, advisor: Advisor | None = None, **read_options: Any) -> None:
        self.spark, self.source, self.goal, self.date_order, self.advisor, self.read_options = spark, source, goal, date_order, advisor, read_options
        self.df: DataFrame | None = None
        self.findings: list[Finding] = []
        self.first_findings: list[Finding] | None = None
        self.plan: list[PlannedAction] = []
        self.steps: list[Step] = []
        self.before: dict[str, int] = {}

    # -- stages

    def ingest(self) -> DataFrame:
        df = read_any(self.spark, self.source, **self.read_options)
        self.df = self._settled(with_row_numbers(nan_to_null(df)))
        self.before = self._size()
        return self.df

    def _settled(self, df: DataFrame) -> DataFrame:
        return df.checkpoint() if self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df

    def _size(self) -> dict[str, int]:
        names = [c for c in self.df.columns if c != RID]
        row = self.df.agg(F.count(F.lit(1)), *[F.count_if(X.column(c).isNull()) for c in names]).collect()[0]
        return {"rows": row[0], "cols": len(names), "nulls": sum(row[1:])}

    def scan(self) -> list[Finding]:
        self.findings = scan(self.df)
        if self.first_findings is None:
            self.first_findings = list(self.findings)
        return self.findings

    def report(self) -> str:
        s = self._size()
        return report(self.findings, s["rows"], s["cols"], s["nulls"])

    def narrate(self) -> str:
        """A few sentences on what was found."""
        if not self.findings:
            return "No problems were found."
        counts = [f"{n} {s}" for s in SEVERITY if (n := sum(f.severity == s for f in self.findings))]
        return f"{len(self.findings)} problem(s): {', '.join(counts)}. First: {'; '.join(f.title for f in self.findings[:3])}."

    def make_plan(self) -> list[PlannedAction]:
        self.plan = build_plan(self.df, self.findings, self.date_order, self.advisor, self.goal)
        return self.plan

    def review(self, approve_up_to: str = "medium", approve_ids: Sequence[str] = ()) -> list[PlannedAction]:
        return review(self.plan, approve_up_to, approve_ids)

    def apply(self) -> list[Step]:
        done = [self._step(p.action, p.params, p.finding_id) for p in self.plan if p.approved]
        self.df = self._settled(self.df)
        return done

    def verify(self) -> dict[str, int]:
        """Rescan: findings gone, left and new."""
        old = {f.id for f in self.findings}
        new = {f.id for f in self.scan()}
        return {"resolved": len(old - new), "remaining": len(old & new), "new": len(new - old)}

    def run(self, approve_up_to: str = "medium", approve_ids: Sequence[str] = (), rounds: int = 3) -> DataFrame:
        self.ingest()
        self.scan()
        for k in range(rounds):
            if not self.findings:
                break
            self.make_plan()
            self.review(approve_up_to, approve_ids if k == 0 else ())
            if not any(p.approved for p in self.plan):
                break
            self.apply()
            if not self.verify()["resolved"]:
                break
        return self.df.drop(RID)

    def act(self, action: str, **params: Any) -> Step:
        """One action by hand."""
        return self._step(action, params, "")

    def _step(self, name: str, params: dict[str, Any], finding: str) -> Step:
        """Apply an action. One that fails, or that would empty a table with rows, leaves the table as it is; both are logged."""
        rows, cols = self.df.count(), len(self.df.columns) - (RID in self.df.columns)
        step = Step(len(self.steps) + 1, name, params, "", rows, rows, cols, cols, finding_id=finding)
        try:
            if name not in ACTIONS:
                raise DataError(f"no such action: {name}")
            df, step.message = ACTIONS[name].run(self.df, **params)
            n = df.count()
            if rows and not n:
                raise DataError("it would remove every row")
            self.df, step.rows_after, step.cols_after = df, n, len(df.columns) - (RID in df.columns)
        except Exception as e:
            step.ok, step.error = False, f"{type(e).__name__}: {str(e)[:300]}"
            log.warning("%s failed: %s", name, step.error)
        self.steps.append(step)
        return step

    # -- results

    def recipe(self) -> Recipe:
        return [(s.action, s.params) for s in self.steps if s.ok]

    def audit(self) -> DataFrame:
        rows = [(s.step, s.action, json.dumps(s.params, default=str), s.message, s.rows_before, s.rows_after, s.cols_before, s.cols_after, s.ok, s.error, s.finding_id) for s in self.steps]
        return self.spark.createDataFrame(rows, STEP_SCHEMA)

    def findings_table(self) -> DataFrame:
        return findings_table(self.spark, self.findings)

    def summary(self) -> dict[str, Any]:
        return {"before": self.before, "after": self._size(), "steps_applied": sum(s.ok for s in self.steps), "steps_failed": sum(not s.ok for s in self.steps)}

    def as_report(self) -> dict[str, Any]:
        as_dicts = lambda xs: [vars(x) for x in xs]
        return {
            "tool": "tablewright", "version": __version__, "generated_at": datetime.now(UTC).isoformat(timespec="seconds"), "source": str(self.source)[:200], "goal": self.goal,
            "summary": self.summary(), "narrative": self.narrate(), "initial_findings": as_dicts(self.first_findings or []), "plan": as_dicts(self.plan),
            "steps": [s.as_dict() for s in self.steps], "remaining_findings": as_dicts(self.findings),
        }

    def export(self, path: str) -> dict[str, str]:
        """The data, and beside it the report and the recipe as JSON."""
        write_any(self.df.drop(RID), path)
        stem = path.rsplit(".", 1)[0]
        out = {"data": path, "report": f"{stem}_report.json", "recipe": f"{stem}_recipe.json"}
        for name, what in (("report", self.as_report()), ("recipe", self.recipe())):
            with open(out[name], "w", encoding="utf-8") as f:
                json.dump(what, f, indent=2, default=str)
        return out

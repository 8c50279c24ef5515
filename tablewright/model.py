"""Records: findings, planned actions and steps."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from typing import Any

from tablewright.functions.values import SEVERITY

#: A hidden number of each row in the order it was read.
RID = "__rid__"


class DataError(ValueError):
    """The input can't be read or worked on."""


def finding_id(prefix: str, *parts: Any) -> str:
    return f"{prefix}-{hashlib.md5('|'.join(map(str, parts)).encode()).hexdigest()[:6]}"


@dataclass
class Finding:
    id: str
    category: str
    severity: str
    title: str
    detail: str
    columns: list[str] = field(default_factory=list)
    evidence: dict[str, Any] = field(default_factory=dict)
    suggested_action: str = "none"
    suggested_params: dict[str, Any] = field(default_factory=dict)
    confidence: float = 1.0

    def rank(self) -> tuple:
        return SEVERITY.index(self.severity), self.category, self.title

    def row(self) -> tuple:
        return (self.id, self.category, self.severity, self.title, self.detail, self.columns, json.dumps(self.evidence, default=str), self.suggested_action, json.dumps(self.suggested_params, default=str), float(self.confidence))


FINDING_SCHEMA = "id string, category string, severity string, title string, detail string, columns array<string>, evidence string, suggested_action string, suggested_params string, confidence double"


@dataclass
class PlannedAction:
    finding_id: str
    action: str
    params: dict[str, Any]
    rationale: str
    risk: str = "low"
    order: int = 50
    source: str = "rule"
    approved: bool | None = None


@dataclass
class Step:
    step: int
    action: str
    params: dict[str, Any]
    message: str
    rows_before: int
    rows_after: int
    cols_before: int
    cols_after: int
    ok: bool = True
    error: str = ""
    finding_id: str = ""

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


STEP_SCHEMA = "step int, action string, params string, message string, rows_before long, rows_after long, cols_before int, cols_after int, ok boolean, error string, finding_id string"

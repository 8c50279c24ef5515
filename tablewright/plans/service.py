"""A facade over cleaners: datasets by id that expire, with the operations of a hosted cleaning service, without its transport."""

from __future__ import annotations

import secrets
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from tablewright.functions.values import RISKS
from tablewright.model import RID, DataError
from tablewright.operators.actions import ACTIONS, catalog
from tablewright.plans.cleaner import Cleaner
from tablewright.plans.planner import risk_of
from tablewright.sources.readers import Limits, load_bytes
from tablewright.sources.writers import FORMATS, to_bytes


@dataclass(frozen=True)
class Tier:
    """Fixed values of the free tier by default."""

    name: str = "free"
    max_rows: int = 5_000
    max_bytes: int = 2 << 20
    files_per_day: int = 5
    formats: tuple[str, ...] = ("csv",)


@dataclass
class Dataset:
    id: str
    name: str
    cleaner: Cleaner
    expires: float
    lock: threading.RLock = field(default_factory=threading.RLock)
    artifacts: dict[str, tuple[str, bytes]] = field(default_factory=dict)


class Service:
    def __init__(self, spark: SparkSession, tier: Tier = Tier("full", 200_000, 25 << 20, 1000, tuple(FORMATS)), ttl: int = 3600, per_minute: int = 120, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.tier, self.ttl, self.per_minute, self.clock = spark, tier, ttl, per_minute, clock
        self.datasets: dict[str, Dataset] = {}
        self.slots: dict[str, tuple[str, float, bytes | None]] = {}
        self.calls: list[float] = []
        self.files: list[float] = []

    def _admit(self) -> None:
        now = self.clock()
        self.calls = [t for t in self.calls if t > now - 60]
        if len(self.calls) >= self.per_minute:
            raise DataError("too many requests: wait a minute")
        self.calls.append(now)
        self.sweep()

    def sweep(self) -> None:
        """Forget what has expired."""
        now = self.clock()
        for k in [k for k, d in self.datasets.items() if d.expires <= now]:
            self.delete(k)
        self.slots = {k: v for k, v in self.slots.items() if v[1] > now}

    def _get(self, dataset_id: str) -> Dataset:
        self._admit()
        if dataset_id not in self.datasets:
            raise DataError("no such dataset, or it has expired")
        return self.datasets[dataset_id]

    def create_upload(self, filename: str) -> str:
        self._admit()
        token = secrets.token_urlsafe(16)
        self.slots[token] = (filename, self.clock() + self.ttl, None)
        return token

    def receive(self, token: str, data: bytes) -> None:
        if token not in self.slots:
            raise DataError("no such upload, or it has expired")
        if len(data) > self.tier.max_bytes:
            raise DataError("the file is too large")
        name, until, _ = self.slots[token]
        self.slots[token] = (name, until, data)

    def _bytes(self, data: bytes | None, csv_text: str | None, upload: str | None, filename: str) -> tuple[bytes, str]:
        if sum(x is not None for x in (data, csv_text, upload)) != 1:
            raise DataError("give one of data, csv_text and upload")
        if upload is not None:
            name, _, got = self.slots.get(upload, ("", 0, None))
            if got is None:
                raise DataError("nothing was uploaded")
            return got, name
        return (data if data is not None else csv_text.encode()), filename

    def scan(self, data: bytes | None = None, csv_text: str | None = None, upload: str | None = None, filename: str = "data.csv", date_order: str | None = None) -> dict[str, Any]:
        self._admit()
        raw, name = self._bytes(data, csv_text, upload, filename)
        now = self.clock()
        self.files = [t for t in self.files if t > now - 86400]
        if len(self.files) >= self.tier.files_per_day:
            raise DataError("the daily number of files is used up")
        df = load_bytes(self.spark, raw, name, Limits(self.tier.max_bytes, self.tier.max_rows))
        self.files.append(now)
        cleaner = Cleaner(self.spark, df, date_order=date_order)
        cleaner.ingest()
        cleaner.scan()
        d = Dataset(secrets.token_hex(8), name, cleaner, now + self.ttl)
        self.datasets[d.id] = d
        return self.view(d)

    def view(self, d: Dataset) -> dict[str, Any]:
        c = d.cleaner
        names = [x for x in c.df.columns if x != RID]
        issues = [{"id": f.id, "severity": f.severity, "category": f.category, "issue": f.title, "detail": f.detail[:400], "columns": f.columns[:100], "suggested_action": f.suggested_action} for f in c.findings[:80]]
        return {"dataset_id": d.id, "name": d.name, "rows": c.before["rows"], "columns": len(names), "column_names": names[:100], "issues": issues, "summary": c.narrate(), "expires_in_seconds": int(d.expires - self.clock())}

    def plan(self, dataset_id: str) -> list[dict[str, Any]]:
        d = self._get(dataset_id)
        with d.lock:
            d.cleaner.scan()
            titles = {f.id: f.title for f in d.cleaner.findings}
            return [{"finding_id": p.finding_id, "issue": titles[p.finding_id], "action": p.action, "params": p.params, "risk": p.risk, "why": p.rationale, "applies_automatically": p.action != "none" and p.risk != "high", "needs_explicit_approval": p.action != "none" and p.risk == "high"} for p in d.cleaner.make_plan()]

    def apply_plan(self, dataset_id: str, approve_up_to: str = "medium", approve_ids: tuple[str, ...] = ()) -> dict[str, Any]:
        if approve_up_to not in ("none", "low", "medium"):
            raise DataError("high risk needs the findings' ids")
        d = self._get(dataset_id)
        with d.lock:
            d.cleaner.scan()
            d.cleaner.make_plan()
            d.cleaner.review(approve_up_to, approve_ids)
            steps = d.cleaner.apply()
            return {"steps": [s.as_dict() for s in steps], **d.cleaner.verify(), "pending": self._pending(d)}

    def apply_action(self, dataset_id: str, action: str, params: dict[str, Any] | None = None, confirm: bool = False) -> dict[str, Any]:
        d = self._get(dataset_id)
        if action not in ACTIONS:
            raise DataError(f"no such action: {action}")
        if not confirm and (ACTIONS[action].destructive or risk_of(action, params) == "high"):
            raise DataError("this action needs confirm=True")
        with d.lock:
            return d.cleaner.act(action, **(params or {})).as_dict()

    def preview(self, dataset_id: str, rows: int = 10) -> dict[str, Any]:
        d = self._get(dataset_id)
        df = d.cleaner.df
        some = df.orderBy(RID).limit(max(1, min(50, rows))) if RID in df.columns else df.limit(max(1, min(50, rows)))
        return {"rows": [r.asDict() for r in some.drop(RID).collect()], "types": dict(df.drop(RID).dtypes)}

    def export(self, dataset_id: str, fmt: str = "csv") -> dict[str, Any]:
        d = self._get(dataset_id)
        if fmt not in self.tier.formats:
            raise DataError(f"{fmt} isn't among {', '.join(self.tier.formats)}")
        data = to_bytes(d.cleaner.df.drop(RID), fmt)
        token = secrets.token_urlsafe(16)
        d.artifacts[token] = (f"{_stem(d.name)}_cleaned.{fmt}", data)
        return {"token": token, "filename": d.artifacts[token][0], "bytes": len(data), "mime": FORMATS[fmt]}

    def download(self, token: str) -> tuple[str, bytes]:
        self.sweep()
        for d in self.datasets.values():
            if token in d.artifacts:
                return d.artifacts[token]
        raise DataError("no such file, or it has expired")

    def clean(self, fmt: str = "csv", approve_up_to: str = "medium", rounds: int = 3, **source: Any) -> dict[str, Any]:
        if approve_up_to not in ("none", "low", "medium") or fmt not in self.tier.formats:
            raise DataError("unknown format or risk")
        told = self.scan(**source)
        d = self.datasets[told["dataset_id"]]
        with d.lock:
            for _ in range(rounds):
                d.cleaner.make_plan()
                d.cleaner.review(approve_up_to)
                if not any(p.approved for p in d.cleaner.plan):
                    break
                d.cleaner.apply()
                if not d.cleaner.verify()["resolved"]:
                    break
            return told | {"steps": [s.as_dict() for s in d.cleaner.steps], "summary": d.cleaner.summary(), "pending": self._pending(d), "file": self.export(d.id, fmt)}

    @staticmethod
    def _pending(d: Dataset) -> list[dict[str, Any]]:
        """What still needs a decision; the reviewed plan stays as it is."""
        c = d.cleaner
        plan, findings = c.plan, c.findings
        try:
            titles = {f.id: f for f in c.scan()}
            out = []
            for p in c.make_plan():
                if titles[p.finding_id].severity == "info":
                    continue
                if p.action != "none" and RISKS.index(p.risk) > 1:
                    out.append({"finding_id": p.finding_id, "issue": titles[p.finding_id].title, "kind": "approval_required", "proposed_action": p.action, "params": p.params, "risk": p.risk})
                elif p.action == "none" and not p.rationale.startswith("By rule"):
                    out.append({"finding_id": p.finding_id, "issue": titles[p.finding_id].title, "kind": "needs_decision", "reason": p.rationale})
            return out
        finally:
            c.plan, c.findings = plan, findings

    def delete(self, dataset_id: str) -> None:
        self.datasets.pop(dataset_id, None)

    def actions(self) -> list[dict[str, Any]]:
        return catalog()


def _stem(name: str) -> str:
    stem = "".join(c if c.isalnum() or c in "-_" else "_" for c in name.rsplit("/", 1)[-1].rsplit(".", 1)[0])
    return stem[:80] or "data"

"""The twenty checks. Each reads the shared profile and returns findings; all values count, there are no samples."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import exprs as X
from tablewright.functions.values import FALSE_TOKENS, KEY_WORDS, NON_NEGATIVE, PERCENT_PARTS, PII, TRUE_TOKENS
from tablewright.model import FINDING_SCHEMA, RID, Finding, finding_id
from tablewright.operators.profile import Profile, flat, is_date, is_number, is_text

CHECKS: list[Callable[[Profile], list[Finding]]] = []
log = logging.getLogger(__name__)


def check(f: Callable[[Profile], list[Finding]]) -> Callable[[Profile], list[Finding]]:
    """Add a function to the checks that scan() runs."""
    CHECKS.append(f)
    return f


@check
def shape(p: Profile) -> list[Finding]:
    out = []
    if not p.rows:
        out.append(Finding(finding_id("empty"), "structure", "critical", "The table has no rows", "There is nothing to clean."))
    names = p.df.columns
    twice = sorted({c for c in names if names.count(c) > 1})
    if twice:
        out.append(Finding(finding_id("dupcolname", twice), "structure", "high", "Column names repeat", f"{len(twice)} name(s) stand for several columns.", twice, suggested_action="standardize_column_names", suggested_params={"deduplicate": True}))
    return out


@check
def column_names(p: Profile) -> list[Finding]:
    rules = {"padding": lambda c: c != c.strip(), "placeholder": lambda c: bool(re.match(r"^Unnamed:?\s*\d+$", c)), "special characters": lambda c: bool(re.search(r"[^\w\s]", c)), "spaces": lambda c: " " in c.strip(), "capitals": lambda c: c != c.lower()}
    bad = {c: [k for k, test in rules.items() if test(c)] for c in p.fields}
    bad = {c: v for c, v in bad.items() if v}
    if not bad:
        return []
    return [Finding(finding_id("colnames", sorted(bad)), "naming", "low", "Column names are hard to use in code", f"{len(bad)} of {len(p.fields)} names.", list(bad), {"issues": bad}, "standardize_column_names", {"style": "snake_case"})]


@check
def empty_rows_and_columns(p: Profile) -> list[Finding]:
    out = []
    empty = [c for c in p.fields if not p.stats[c]["filled"]]
    if empty:
        out.append(Finding(finding_id("emptycol", empty), "structure", "high", "Columns without a value", f"{len(empty)} column(s) are null in every row.", empty, suggested_action="drop_columns", suggested_params={"columns": empty}))
    if n := p.stats[""]["empty_rows"]:
        out.append(Finding(finding_id("emptyrow"), "structure", "medium", "Rows without a value", f"{n} row(s) are null in every column.", evidence={"count": n}, suggested_action="drop_empty_rows"))
    return out


@check
def constant_columns(p: Profile) -> list[Finding]:
    same = [c for c in p.fields if p.stats[c]["filled"] and p.distinct[c]["distinct"] <= 1]
    return [Finding(finding_id("const", same), "redundancy", "medium", "Columns with one value", f"{len(same)} column(s) never change.", same, suggested_action="drop_columns", suggested_params={"columns": same})] if same else []


@check
def duplicate_columns(p: Profile) -> list[Finding]:
    by_print: dict[tuple, list[str]] = {}
    for c in p.fields:
        if p.stats[c]["filled"]:
            by_print.setdefault((p.stats[c]["print"], p.stats[c]["filled"]), []).append(c)
    pairs = [(group[0], c) for group in by_print.values() for c in group[1:]]
    if not pairs:
        return []
    text = lambda c: flat(X.column(c), p.fields[c])
    same = p.df.agg(*[F.coalesce(F.bool_and(text(a).eqNullSafe(text(b))), F.lit(False)).alias(f"s{k}") for k, (a, b) in enumerate(pairs)]).collect()[0]
    extra = [b for k, (_, b) in enumerate(pairs) if same[k]]
    return [Finding(finding_id("dupcol", extra), "redundancy", "medium", "Columns that repeat another", f"{len(extra)} column(s).", extra, {"pairs": [x for k, x in enumerate(pairs) if same[k]]}, "drop_columns", {"columns": extra})] if extra else []


@check
def duplicate_rows(p: Profile) -> list[Finding]:
    out = []
    if not p.rows or not p.fields:
        return out
    whole = F.xxhash64(*[flat(X.column(c), k) for c, k in p.fields.items()]), F.md5(F.to_json(F.struct(*[flat(X.column(c), k).alias(f"c{i}") for i, (c, k) in enumerate(p.fields.items())])))
    exact = p.rows - p.df.select(*whole).distinct().count()
    if exact:
        out.append(Finding(finding_id("duprow"), "duplicates", "high", "Rows that repeat an earlier row", f"{exact} row(s).", evidence={"count": exact}, suggested_action="drop_duplicate_rows", suggested_params={"keep": "first"}))
    texts = p.of(is_text)
    if texts:
        near = p.rows - p.df.select(F.md5(F.to_json(F.struct(*[X.near_key(X.column(c)).alias(f"c{i}") for i, c in enumerate(texts)])))).distinct().count() - exact
        if near > 0:
            out.append(Finding(finding_id("neardup"), "duplicates", "medium", "Rows that nearly repeat another", f"{near} row(s) agree in all text columns but for case and punctuation; other columns may differ.", texts, {"count": near}, "drop_near_duplicate_rows", {"subset": texts, "keep": "first"}))
    for c in p.fields:
        name = c.lower()
        filled = p.stats[c]["filled"]
        if filled > 10 and (not KEY_WORDS.isdisjoint(re.split(r"\W+", name)) or name.endswith("_id")) and (n := filled - p.distinct[c]["distinct"]):
            out.append(Finding(finding_id("dupkey", c), "duplicates", "high", f"'{c}' looks like a key but repeats", f"{n} repeated value(s).", [c], {"repeats": n}, "drop_duplicate_rows", {"subset": [c], "keep": "first"}, 0.7))
    return out


@check
def sentinels(p: Profile) -> list[Finding]:
    hit = [c for c in p.of(is_text) if p.stats[c]["sentinels"]]
    if not hit:
        return []
    rows = p.frequencies.filter(F.col("col").isin(hit) & ~F.col("long") & X.is_sentinel(F.col("value"))).groupBy("col").agg(F.collect_set(X.token(F.col("value"))).alias("tokens")).collect()  # of the fixed list
    tokens = sorted({t for r in rows for t in r["tokens"]})
    counts = {c: p.stats[c]["sentinels"] for c in hit}
    return [Finding(finding_id("sentinel", hit), "missing", "high", "Placeholders for missing values", f"{sum(counts.values())} value(s) in {len(hit)} column(s).", hit, {"counts": counts, "tokens": tokens}, "replace_sentinels_with_na", {"columns": hit, "tokens": tokens})]


@check
def missing(p: Profile) -> list[Finding]:
    out = []
    for c in p.fields:
        n = p.rows - p.stats[c]["filled"]
        share = 100.0 * n / p.rows if p.rows else 0.0
        if not n:
            continue
        severity, action = ("high", "drop_columns") if share >= 60 else ("medium", "fill_missing") if share >= 5 else ("low", "fill_missing")
        params = {"columns": [c]} | ({"strategy": "auto"} if action == "fill_missing" else {})
        out.append(Finding(finding_id("miss", c), "missing", severity, f"Missing values in '{c}'", f"{n} null(s), {share:.1f} %.", [c], {"count": n, "percent": share}, action, params))
    return out


@check
def numbers_as_text(p: Profile) -> list[Finding]:
    out = []
    for c in p.of(is_text):
        s = p.stats[c]
        if s["filled"] < 5 or X.identifier_like(c) or s["zero_led"] or s["many_digits"]:
            continue
        share = s["numeric"] / s["filled"]
        if share >= 0.85:
            out.append(Finding(finding_id("numtext", c), "dtype", "high", f"Numbers as text in '{c}'", f"{100 * share:.0f} % of values are numbers.", [c], {"parse_ratio": round(share, 3)}, "cast_numeric", {"columns": [c], "strip_symbols": True}, share))
    return out


@check
def dates_as_text(p: Profile) -> list[Finding]:
    out = []
    for c in p.of(is_text):
        s = p.stats[c]
        n = s["filled"]
        if n < 5 or s["date_hint"] < 0.5 * n or s["date"] < 0.8 * n:
            continue
        first, second = s["first_big"] > 0, s["second_big"] > 0
        known = s["triples"] <= 5 or first != second
        dayfirst = s["triples"] > 5 and first and not second
        detail = "The order of day and month can't be told from the values: it needs a decision." if not known else f"Day first: {dayfirst}."
        out.append(Finding(finding_id("dttext", c), "dtype", "medium" if known else "high", f"Dates as text in '{c}'", f"{100 * s['date'] / n:.0f} % of values are dates. {detail}", [c], {"parse_ratio": round(s["date"] / n, 3), "ambiguous": not known, "inferred_dayfirst": dayfirst}, "cast_datetime", {"columns": [c], "dayfirst": dayfirst}, s["date"] / n if known else 0.6))
    return out


@check
def booleans_as_text(p: Profile) -> list[Finding]:
    texts = p.of(is_text)
    few = [c for c in texts if p.stats[c]["filled"]]
    if not few:
        return []
    t = X.token(F.col("value"))
    rows = p.frequencies.filter(F.col("col").isin(few)).groupBy("col").agg(F.bool_and(t.isin([*TRUE_TOKENS, *FALSE_TOKENS])).alias("ok"), F.count_distinct(F.when(t.isin([*TRUE_TOKENS, *FALSE_TOKENS]), t)).alias("n")).collect()
    return [Finding(finding_id("booltext", r["col"]), "dtype", "medium", f"Yes/no values as text in '{r['col']}'", f"{r['n']} different words.", [r["col"]], {"distinct": r["n"]}, "cast_boolean", {"columns": [r["col"]]}) for r in sorted(rows) if r["ok"] and 1 <= r["n"] <= 6]


@check
def mixed_types(p: Profile) -> list[Finding]:
    """Only variant columns can hold several types in Spark."""
    out = []
    for f in p.df.schema.fields:
        if f.dataType.typeName() == "variant":
            kinds = sorted(r[0] for r in p.df.select(F.schema_of_variant(X.column(f.name))).distinct().limit(50).collect() if r[0] and r[0] != "VOID")
            if len(kinds) > 1:
                out.append(Finding(finding_id("mixed", f.name), "dtype", "medium", f"Several types in '{f.name}'", ", ".join(kinds), [f.name], {"types": kinds}, "coerce_consistent_type", {"columns": [f.name]}))
    return out


@check
def white_space(p: Profile) -> list[Finding]:
    hit = {c: p.stats[c]["spaced"] for c in p.of(is_text) if p.stats[c]["spaced"]}
    return [Finding(finding_id("ws", list(hit)), "text", "medium", "Stray white space", f"{sum(hit.values())} value(s) in {len(hit)} column(s).", list(hit), {"counts": hit}, "strip_whitespace", {"columns": list(hit)})] if hit else []


@check
def category_spellings(p: Profile) -> list[Finding]:
    some = [c for c in p.of(is_text) if p.stats[c]["filled"] >= 10 and 2 <= p.distinct[c]["distinct"] <= 3000 and p.stats[c]["date_hint"] <= 0.5 * p.stats[c]["filled"]]
    if not some:
        return []
    mapping: dict[str, dict[str, str]] = {}
    for r in p.canonical(some).collect():  # 3000 values of a column at most
        mapping.setdefault(r["col"], {})[r["value"]] = r["canonical"]
    return [Finding(finding_id("ambig", c), "ambiguity", "high", f"One category, several spellings in '{c}'", f"{len(m)} spelling(s) differ only in case, space or punctuation.", [c], {"mapping": m}, "unify_categories", {"column": c, "mapping": m}, 0.85) for c, m in sorted(mapping.items())]


@check
def rare_and_dominant(p: Profile) -> list[Finding]:
    out = []
    some = [c for c in p.of(is_text) if p.stats[c]["filled"] >= 50 and 2 <= p.distinct[c]["distinct"] <= 200]
    if not some:
        return out
    total = F.create_map(*[x for c in some for x in (F.lit(c), F.lit(p.stats[c]["filled"]))])
    rare = {r["col"]: r["n"] for r in p.frequencies.filter(F.col("col").isin(some)).filter(F.col("cnt") < 0.001 * total[F.col("col")]).groupBy("col").agg(F.count("*").alias("n")).collect()}
    for c in some:
        share = p.distinct[c]["top"] / p.stats[c]["filled"]
        if share > 0.97:
            out.append(Finding(finding_id("dominant", c), "distribution", "low", f"One value fills '{c}'", f"{100 * share:.1f} % of values are the same.", [c], {"top": p.distinct[c]["top_value"], "share": share}))
        if rare.get(c, 0) >= 3:
            out.append(Finding(finding_id("rare", c), "distribution", "low", f"Rare categories in '{c}'", f"{rare[c]} value(s) have less than 0.1 % each.", [c], {"rare": rare[c]}, "group_rare_categories", {"column": c, "min_freq": 0.001, "label": "Other"}))
    return out


@check
def mojibake(p: Profile) -> list[Finding]:
    hit = {c: p.stats[c]["mojibake"] for c in p.of(is_text) if p.stats[c]["mojibake"]}
    return [Finding(finding_id("moji", list(hit)), "encoding", "medium", "Letters of a wrong decoding", f"{sum(hit.values())} value(s).", list(hit), {"counts": hit}, "fix_encoding", {"columns": list(hit)})] if hit else []


def flag_column(df: DataFrame, c: str) -> bool:
    """Whether the table has a flag column for outliers of c: by its exact name, or a boolean of the same normalised name."""
    bare = lambda x: re.sub(r"[^a-z0-9]", "", x.lower())
    return f"{c}__is_outlier" in df.columns or any(f.name != c and bare(f.name) == bare(c) + "isoutlier" and f.dataType.typeName() == "boolean" for f in df.schema.fields)


@check
def outliers(p: Profile) -> list[Finding]:
    fences = {}
    for c in p.of(is_number):
        s = p.stats[c]
        if s["filled"] >= 20 and p.distinct[c]["distinct"] >= 5 and not flag_column(p.df, c):
            q1, q3 = s["quartiles"]
            if q3 > q1:
                fences[c] = (q1 - 3.0 * (q3 - q1), q3 + 3.0 * (q3 - q1))
    if not fences:
        return []
    counts = p.df.agg(*[F.count_if((X.column(c).cast("double") < lo) | (X.column(c).cast("double") > hi)).alias(f"n{k}") for k, (c, (lo, hi)) in enumerate(fences.items())]).collect()[0]
    return [Finding(finding_id("outlier", c), "outliers", "medium", f"Outliers in '{c}'", f"{n} value(s) outside [{lo:.4g}, {hi:.4g}].", [c], {"count": n, "low": lo, "high": hi}, "handle_outliers", {"columns": [c], "method": "flag", "factor": 3.0}) for n, (c, (lo, hi)) in zip(counts, fences.items(), strict=True) if 0 < n < 0.25 * p.stats[c]["filled"]]


@check
def impossible_values(p: Profile) -> list[Finding]:
    out = []
    for c in p.of(is_number):
        s, name = p.stats[c], c.lower()
        if not s["filled"]:
            continue
        if s["negative"] and any(x in name for x in NON_NEGATIVE):
            out.append(Finding(finding_id("neg", c), "validity", "high", f"Negative values in '{c}'", f"{s['negative']} value(s), the least {s['min']:.4g}.", [c], {"count": s["negative"], "min": s["min"]}, "enforce_range", {"column": c, "min": 0, "mode": "to_nan"}, 0.7))
        if s["over_120"] and re.search(r"\bage\b", name):
            out.append(Finding(finding_id("age", c), "validity", "high", f"Impossible ages in '{c}'", f"{s['over_120']} value(s) outside 0-120.", [c], {"count": s["over_120"]}, "enforce_range", {"column": c, "min": 0, "max": 120, "mode": "to_nan"}))
        if s["max"] > 100 and s["min"] >= 0 and any(x in name for x in PERCENT_PARTS):
            out.append(Finding(finding_id("pct", c), "validity", "medium", f"Percentages over 100 in '{c}'", f"The largest is {s['max']:.4g}.", [c], {"max": s["max"]}, confidence=0.5))
    for c in p.of(is_date):
        future, ancient = p.stats[c]["future"], p.stats[c]["ancient"]
        if future or ancient:
            out.append(Finding(finding_id("baddate", c), "validity", "medium", f"Dates out of range in '{c}'", f"{future} in the future, {ancient} before 1900.", [c], {"future": future, "pre1900": ancient}, "enforce_date_range", {"column": c, "min": "1900-01-01", "max": "today", "mode": "to_nan"}))
    return out


@check
def high_cardinality(p: Profile) -> list[Finding]:
    out = []
    for c in p.of(is_text):
        n = p.distinct[c]["distinct"] if p.stats[c]["filled"] else 0
        if p.rows > 50 and n > 50 and n / p.rows > 0.95:
            out.append(Finding(finding_id("hicard", c), "structure", "info", f"Nearly every value of '{c}' is different", f"{n} of {p.rows}.", [c], {"distinct": n}))
    return out


@check
def personal_data(p: Profile) -> list[Finding]:
    out = []
    for c in p.of(is_text):
        s = p.stats[c]
        for kind in PII:
            if not s["filled"] or (kind in ("phone", "credit_card", "ip_address") and s["date_hint"] > 0.5 * s["filled"]):
                continue
            share = s[f"pii_{kind}"] / s["filled"]
            if share > 0.6:
                out.append(Finding(finding_id("pii", c, kind), "privacy", "high", f"Personal data in '{c}': {kind}", f"{100 * share:.0f} % of values look like it.", [c], {"kind": kind, "match_rate": round(share, 3)}, "mask_pii", {"columns": [c], "kind": kind, "mode": "hash"}, share))
                break
    return out


def scan(df: DataFrame, only: Collection[Callable[[Profile], list[Finding]]] | None = None) -> list[Finding]:
    """Findings of all checks, or of some, the gravest first. A check that fails is a finding of its own (`failed-...`)."""
    profile = Profile(df)
    found: list[Finding] = []
    try:
        names = [c for c in df.columns if c != RID]
        if len(set(names)) < len(names):  # no column can be told from another of its name
            return shape(_names_only(df))
        for f in CHECKS if only is None else only:
            try:
                found += f(profile)
            except Exception as e:
                log.exception("check %s failed", f.__name__)
                found.append(Finding(finding_id("failed", f.__name__), "structure", "info", f"The check {f.__name__} could not be made", f"{type(e).__name__}: {e}"[:300]))
    finally:
        profile.close()
    return sorted(found, key=Finding.rank)


def _names_only(df: DataFrame) -> Profile:
    p = Profile(df)
    p.__dict__["stats"] = {"": {"rows": df.count(), "empty_rows": 0}}
    return p


def findings_table(spark, findings: list[Finding]) -> DataFrame:
    return spark.createDataFrame([f.row() for f in findings], FINDING_SCHEMA)


def report(findings: list[Finding], rows: int, columns: int, nulls: int) -> str:
    cells = rows * columns
    lines = [f"{rows:,} rows, {columns} columns, {100 * nulls / cells if cells else 0:.1f} % of cells missing, {len(findings)} finding(s)"]
    for f in findings:
        lines.append(f"[{f.severity}] {f.category}: {f.title}. {f.detail}" + (f" -> {f.suggested_action}" if f.suggested_action != "none" else ""))
    return "\n".join(lines)

"""The shared profile of a table: aggregates for all columns in groups, and one shuffle for value frequencies.

Every check reads from these; none scans the table on its own. Values over LONG characters enter the frequencies as their
hash, so that long texts aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.functions import exprs as X
from tablewright.functions.values import DATE_HINT, PII
from tablewright.model import RID

LONG = 256
_TRIPLE = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})$"


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_date(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def flat(c, kind: T.DataType):
    """A value as text, also of arrays, structs and maps."""
    return F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")


def with_row_numbers(df: DataFrame) -> DataFrame:
    return df if RID in df.columns else df.withColumn(RID, F.monotonically_increasing_id())


def nan_to_null(df: DataFrame) -> DataFrame:
    fields = [f for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({f.name: F.when(~F.isnan(X.column(f.name)), X.column(f.name)) for f in fields}) if fields else df


def text_flags(v: Column) -> dict[str, Column]:
    """What can be said about a text, by name."""
    date = X.strip(v)
    day = lambda k: F.regexp_extract(date, _TRIPLE, k).try_cast("int") > 12
    return {
        "numeric": X.to_number(X.clean_numeric(v)).isNotNull(), "zero_led": date.rlike(r"^[+-]?0\d"), "many_digits": F.length(F.regexp_replace(v, r"\D", "")) > 15,
        "date_hint": v.rlike(DATE_HINT), "date": (F.length(v) <= 40) & X.parse_date(v).isNotNull(), "triples": date.rlike(_TRIPLE), "first_big": day(1), "second_big": day(2),
        "spaced": (date != v) | v.rlike(f"{X.SPACE}{{2,}}"), "mojibake": X.is_mojibake(v), "sentinels": X.is_sentinel(v), "percents": v.contains("%"),
        **{f"pii_{kind}": X.is_pii(v, kind) for kind in PII},
    }


class Numbers:
    """A column's numbers by name, each from its group."""

    def __init__(self, groups: dict[str, Callable[[], dict]], column: str) -> None:
        self.groups, self.column = groups, column

    def __getitem__(self, name: str) -> Any:
        return self.groups[name]()[self.column][name]


@dataclass
class Profile:
    df: DataFrame
    order: str = RID
    _held: list[DataFrame] = field(default_factory=list)
    _found: dict[str, dict] = field(default_factory=dict)

    @cached_property
    def fields(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields if f.name != RID}

    def of(self, test) -> list[str]:
        return [c for c, kind in self.fields.items() if test(kind)]

    @cached_property
    def stats(self) -> dict[str, Numbers]:
        """Numbers of each column by name, and of the table under ''. They come in groups, each worked out when one of its numbers is
        first asked for: counts, fingerprints, ranges of numbers, ranges of dates, and what the patterns say about texts."""
        return {"": Numbers({"rows": self.counts, "empty_rows": self.counts}, ""), **{c: Numbers(self._groups(kind), c) for c, kind in self.fields.items()}}

    def _groups(self, kind: T.DataType) -> dict[str, Callable[[], dict]]:
        of = {"filled": self.counts, "print": self.prints}
        if is_text(kind):
            of |= dict.fromkeys(text_flags(F.lit("")), self.patterns)
        elif is_number(kind):
            of |= dict.fromkeys(("min", "max", "negative", "over_120", "quartiles"), self.ranges)
        elif is_date(kind):
            of |= dict.fromkeys(("future", "ancient"), self.ranges)
        return of

    def _once(self, group: str, wanted: Callable[[], list[tuple[str, str, Any]]]) -> dict[str, dict[str, Any]]:
        """One job for the aggregates (column, name, expression) of a group."""
        if group not in self._found:
            some, out = wanted(), {}
            row = self.df.agg(*[x.alias(f"s{k}") for k, (_, _, x) in enumerate(some)]).collect()[0] if some else ()
            for (c, name, _), value in zip(some, row, strict=True):
                out.setdefault(c, {})[name] = value
            self._found[group] = out
        return self._found[group]

    def counts(self) -> dict[str, dict[str, Any]]:
        def wanted():
            every = [flat(X.column(c), k) for c, k in self.fields.items()]
            none = F.count_if(F.coalesce(*every).isNull()) if every else F.lit(0)
            return [("", "rows", F.count(F.lit(1))), ("", "empty_rows", none), *[(c, "filled", F.count(X.column(c))) for c in self.fields]]

        return self._once("counts", wanted)

    def prints(self) -> dict[str, dict[str, Any]]:
        """Of each column a hash of its values by row: equal columns have equal ones."""
        if "prints" not in self._found:
            df = with_row_numbers(self.df)
            row = df.agg(*[F.bit_xor(F.xxhash64(X.column(RID), flat(X.column(c), k))).alias(f"s{i}") for i, (c, k) in enumerate(self.fields.items())]).collect()[0]
            self._found["prints"] = {c: {"print": row[i]} for i, c in enumerate(self.fields)}
        return self._found["prints"]

    def ranges(self) -> dict[str, dict[str, Any]]:
        def wanted():
            out = []
            for c, kind in self.fields.items():
                if is_number(kind):
                    d = X.column(c).cast("double")
                    out += [(c, "min", F.min(d)), (c, "max", F.max(d)), (c, "negative", F.count_if(d < 0)), (c, "over_120", F.count_if((d > 120) | (d < 0))), (c, "quartiles", F.percentile(d, F.array(F.lit(0.25), F.lit(0.75))))]
                elif is_date(kind):
                    t = X.column(c).cast("timestamp_ntz")
                    out += [(c, "future", F.count_if(t > F.localtimestamp())), (c, "ancient", F.count_if(t < F.lit("1900-01-01").cast("timestamp_ntz")))]
            return out

        return self._once("ranges", wanted)

    def patterns(self) -> dict[str, dict[str, Any]]:
        """How many values of each text column are so. Each different value is looked at once and counts as often as it stands;
        long values, which the frequencies only have as hashes, are looked at in their rows."""
        if "patterns" not in self._found:
            some = self.of(is_text)
            short = ~F.col("long")
            sums = [F.sum(F.when(short & flag, F.col("cnt")).otherwise(0)).alias(name) for name, flag in text_flags(F.col("value")).items()]
            rows = self.frequencies.filter(F.col("col").isin(some)).groupBy("col").agg(F.max("long").alias("long_"), *sums).collect()
            out = {c: dict.fromkeys(text_flags(F.lit("")), 0) for c in some}
            for r in rows:
                out[r["col"]] = {k: v for k, v in r.asDict().items() if k not in ("col", "long_")}
                if r["long_"]:
                    v = X.column(r["col"])
                    more = self.df.filter(F.length(v) > LONG).agg(*[F.count_if(flag).alias(name) for name, flag in text_flags(v).items()]).collect()[0]
                    out[r["col"]] = {k: n + more[k] for k, n in out[r["col"]].items()}
            self._found["patterns"] = out
        return self._found["patterns"]

    @property
    def rows(self) -> int:
        return self.stats[""]["rows"]

    @cached_property
    def frequencies(self) -> DataFrame:
        """Rows (col, value, cnt, long) of the different values that are there."""
        pairs = []
        for c, kind in self.fields.items():
            text = flat(X.column(c), kind)
            long = F.length(text) > LONG
            pairs.append(F.struct(F.lit(c).alias("col"), F.when(long, F.sha2(text, 256)).otherwise(text).alias("value"), F.coalesce(long, F.lit(False)).alias("long")))
        if not pairs:
            return self.df.sparkSession.createDataFrame([], "col string, value string, long boolean, cnt long")
        out = self.df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter("value is not null").groupBy("col", "value", "long").agg(F.count("*").alias("cnt"))
        self._held.append(out.persist())
        return out

    @cached_property
    def distinct(self) -> dict[str, dict[str, Any]]:
        """Of each column: different values, and the number of times that the most frequent stands; one job."""
        rows = self.frequencies.groupBy("col").agg(F.count("*").alias("distinct"), F.max("cnt").alias("top"), F.max_by("value", F.struct("cnt", "value")).alias("top_value")).collect()
        return {r["col"]: r.asDict() for r in rows}

    def values(self, c: str) -> DataFrame:
        return self.frequencies.filter(F.col("col") == c).select("value", "cnt", "long")

    def canonical(self, columns: list[str]) -> DataFrame:
        """Rows (col, value, canonical) of values that differ from a better-written one only in case, space and punctuation."""
        v = self.frequencies.filter(F.col("col").isin(columns) & ~F.col("long")).withColumn("key", X.category_key(F.col("value"))).filter("key <> ''")
        value = F.col("value")
        best = Window.partitionBy("col", "key").orderBy(
            (X.collapse(value) == value).desc(), F.col("cnt").desc(), (value.rlike(r"^\p{Lu}") & (F.upper(value) != value)).desc(), F.length("value"), "value",
        )
        return v.withColumn("canonical", F.first("value").over(best)).filter("value <> canonical").select("col", "value", "canonical")

    def close(self) -> None:
        for x in self._held:
            x.unpersist()
        self._held.clear()

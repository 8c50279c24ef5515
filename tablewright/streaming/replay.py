"""Recipes over streams. Actions that look at one row at a time apply to each micro-batch as they are; others need a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tablewright.model import DataError
from tablewright.operators.actions import ACTIONS
from tablewright.plans.cleaner import Recipe

ROW_LOCAL = (
    "standardize_column_names", "drop_columns", "rename_columns", "drop_empty_rows", "replace_sentinels_with_na", "cast_datetime", "cast_boolean", "cast_category",
    "strip_whitespace", "normalize_case", "unify_categories", "fix_encoding", "enforce_range", "enforce_date_range", "mask_pii", "none",
)


def row_local(name: str, params: dict) -> bool:
    """Whether an action's result for a row depends on that row alone. Masks by hash need a salt of their own."""
    return name in ROW_LOCAL and not (name == "mask_pii" and params.get("mode", "hash") == "hash" and not params.get("salt"))


def replay_stream(stream: DataFrame, recipe: Recipe) -> DataFrame:
    """A recipe of row-local actions as a transformation of a stream."""
    for name, params in recipe:
        if not row_local(name, params):
            raise DataError(f"{name} looks at more than one row: apply it to a table")
        stream = ACTIONS[name].run(stream, **params)[0]
    return stream


def start(stream: DataFrame, recipe: Recipe, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Clean a stream into a Parquet folder."""
    return replay_stream(stream, recipe).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def first_of_keys(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """An addition of ours: one row of each key within a delay; state is dropped behind the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)

"""Composable table-cleaning pipeline (P1-P6): extract -> steps in order -> load.

Steps are plain ``DataFrame -> DataFrame`` functions run through ``df.transform``; the
named steps are filter_nulls, cast_types and deduplicate, any callable is accepted, and an
unknown name is rejected before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from vigil.sources.tables import write_append

DEFAULT_STEPS = ("deduplicate", "cast_types")


def filter_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any of ``columns`` (all columns when None)."""
    return df.dropna(how="any", subset=columns)


def _cast_ok(df: DataFrame, mapping: dict[str, str]):
    ok = F.lit(True)
    for c, t in mapping.items():
        ok = ok & (F.col(c).isNull() | F.col(c).try_cast(t).isNotNull())
    return ok


def cast_types(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Cast columns; rows where a non-null value does not convert are left out
    (see ``cast_rejects`` for them)."""
    out = df.filter(_cast_ok(df, mapping))
    return out.select(*[F.col(c).try_cast(mapping[c]).alias(c) if c in mapping else F.col(c)
                        for c in df.columns])


def cast_rejects(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """P3 side output: the original rows a cast would reject."""
    return df.filter(~_cast_ok(df, mapping))


def deduplicate(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Keep one row per key — the one with the greatest ``order_by`` values.

    Equivalent to ``row_number() over (partition by keys order by order_by desc) = 1`` with
    the remaining columns as tie-breakers, but planned as an aggregate of ``max(struct)``
    with a partial step on the map side (Spark's sort-based aggregate, as struct buffers are
    not hash-aggregatable), so a key holding a third of the rows is reduced in every input
    partition before the shuffle instead of being sorted in one task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order_by, *rest)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in order_by + rest]).select(*df.columns)


STEPS: dict[str, Callable] = {
    "filter_nulls": filter_nulls,
    "cast_types": cast_types,
    "deduplicate": deduplicate,
}


@dataclass
class Pipeline:
    """``Pipeline([("deduplicate", {...}), ("cast_types", {...}), my_fn]).run(df)``."""

    steps: list = field(default_factory=list)

    def __post_init__(self):
        self._fns = []
        for s in self.steps:
            if callable(s):
                self._fns.append(s)
                continue
            name, params = (s, {}) if isinstance(s, str) else s
            if name not in STEPS:
                raise ValueError(f"unknown step {name!r}; known: {sorted(STEPS)} or a callable")
            fn = STEPS[name]
            self._fns.append(lambda df, fn=fn, params=params: fn(df, **params))

    def run(self, df: DataFrame) -> DataFrame:
        for fn in self._fns:
            df = df.transform(fn)
        return df

    def load(self, df: DataFrame, target_path: str, fmt: str = "parquet") -> None:
        """P5: run and append the result to ``target_path``."""
        write_append(self.run(df), target_path, fmt)

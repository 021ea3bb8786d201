"""Filters over artifact, review and build records, and line differences of artifact versions."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def _where(df: DataFrame, wanted: list[tuple[str, object, Column]]) -> DataFrame:
    """``df`` under the conditions whose value is given; with none, all rows."""
    given = [condition for _, value, condition in wanted if value is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def artifacts(
    df: DataFrame, kind: str | None = None, subkind: str | None = None, lifecycle_state: str | None = None, label: str | None = None, actor_id: str | None = None
) -> DataFrame:
    """Artifacts (kind, subkind, lifecycle_state, labels, actor_id, ...) that equal every value given; a null field equals none."""
    equal = [(n, v, F.col(n) == v) for n, v in (("kind", kind), ("subkind", subkind), ("lifecycle_state", lifecycle_state), ("actor_id", actor_id))]
    return _where(df, [*equal, ("label", label, F.array_contains("labels", label if label is not None else ""))])


def contributions(
    df: DataFrame, round_: int | None = None, phase: str | None = None, role: str | None = None, reviewed_version: str | None = None, read_set_contains: str | None = None
) -> DataFrame:
    """Review contributions (round, phase, role, reviewed_version, read_set, ...) under the filters given."""
    equal = [(n, v, F.col(n) == v) for n, v in (("round", round_), ("phase", phase), ("role", role), ("reviewed_version", reviewed_version))]
    return _where(df, [*equal, ("read_set", read_set_contains, F.array_contains("read_set", read_set_contains if read_set_contains is not None else ""))])


def builds(df: DataFrame, repo: str) -> DataFrame:
    """Build records of one repository."""
    return df.where(F.col("repo") == repo)


def version_diffs(versions: DataFrame, pairs: DataFrame) -> DataFrame:
    """artifact_id, from_version, to_version, diff: a unified line difference for each of ``pairs``.

    ``versions`` has artifact_id, version and body; a null body counts as empty. Pairs with an unknown version have no row.
    """

    @F.pandas_udf("string")
    def diff(old: pd.Series, new: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        made = [difflib.unified_diff(x.split("\n"), y.split("\n"), str(p), str(q), lineterm="") for x, y, p, q in zip(old, new, a, b, strict=True)]
        return pd.Series(["\n".join(m) for m in made], dtype=object)

    side = lambda version, body: versions.select("artifact_id", F.col("version").alias(version), F.coalesce("body", F.lit("")).alias(body))
    both = pairs.select("artifact_id", "from_version", "to_version").join(side("from_version", "old"), ["artifact_id", "from_version"])
    both = both.join(side("to_version", "new"), ["artifact_id", "to_version"])
    return both.select("artifact_id", "from_version", "to_version", diff("old", "new", "from_version", "to_version").alias("diff"))

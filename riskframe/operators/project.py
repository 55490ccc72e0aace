"""Column selection, naming, typing and derived columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import as_col, complete
from ..functions.scalar import cut_bins, paste
from .ordered import quantiles


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def set_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename all columns by position."""
    return df.toDF(*names)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename old -> new; an unknown old name is an error."""
    unknown = set(mapping) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return df.withColumnsRenamed(dict(mapping))


def prefix_names(df: DataFrame, prefix: str, except_: Iterable[str] = ()) -> DataFrame:
    keep = set(except_)
    return df.toDF(*[c if c in keep else prefix + c for c in df.columns])


def map_names(df: DataFrame, fn: Callable[[str], str]) -> DataFrame:
    return df.toDF(*[fn(c) for c in df.columns])


def cohort_view(df: DataFrame, prefix: str, keep: Sequence[str]) -> DataFrame:
    """The kept columns and those with the prefix, which is stripped."""
    own = [c for c in df.columns if c.startswith(prefix) and c not in keep]
    return df.select(*keep, *[F.col(c).alias(c[len(prefix):]) for c in own])


@dataclass(frozen=True)
class Cols:
    """A column rule: all given parts must hold."""

    first: str | None = None
    last: str | None = None
    starts: str | None = None
    ends: str | None = None
    contains: str | None = None

    def pick(self, columns: Sequence[str]) -> list[str]:
        lo = columns.index(self.first) if self.first else 0
        hi = columns.index(self.last) if self.last else len(columns) - 1
        return [c for c in columns[lo:hi + 1]
                if (self.starts is None or c.startswith(self.starts))
                and (self.ends is None or c.endswith(self.ends))
                and (self.contains is None or self.contains in c)]


def select_cols(df: DataFrame, *specs: str | Cols, drop: Sequence[str | Cols] = ()) -> DataFrame:
    """Select by names and rules, in order and without repeats; then drop by names and rules."""
    def resolve(items):
        out: list[str] = []
        for s in items:
            for c in ([s] if isinstance(s, str) else s.pick(df.columns)):
                if c not in out:
                    out.append(c)
        return out
    gone = set(resolve(drop))
    names = resolve(specs) if specs else df.columns
    return df.select(*[c for c in names if c not in gone])


def pull(df: DataFrame, column: str) -> DataFrame:
    """One column, still distributed."""
    return df.select(column)


def drop_like(df: DataFrame, pattern: str) -> DataFrame:
    """Drop the columns whose name matches a regular expression."""
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


def split_cohort(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with 1 and rows with 0; rows with NULL are in neither."""
    return df.filter(F.col(column) == 1), df.filter(F.col(column) == 0)


def flag_in(df: DataFrame, column: str, ids: DataFrame, name: str) -> DataFrame:
    """Boolean flag: is the value among the ids? False for NULL."""
    keys = ids.select(F.col(ids.columns[0]).alias("_id")).distinct().withColumn("_hit", F.lit(True))
    return (df.join(keys, F.col(column) == F.col("_id"), "left")
            .withColumn(name, F.coalesce(F.col("_hit"), F.lit(False))).drop("_id", "_hit"))


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without NULL or NaN in the columns (all by default)."""
    return complete(df, columns)


def across(df: DataFrame, columns: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """The same transform on many columns."""
    return df.withColumns({c: fn(F.col(c)) for c in columns})


@dataclass(frozen=True)
class Levels:
    """Ordered codes of a categorical column with their labels."""

    codes: tuple
    labels: tuple

    def label(self, c: Column | str) -> Column:
        c, out = as_col(c), None
        for code, text in zip(self.codes, self.labels):
            out = F.when(c == code, text) if out is None else out.when(c == code, text)
        return out

    def position(self, c: Column | str) -> Column:
        """1-based level position of a label, for sorting."""
        c, out = as_col(c), None
        for i, text in enumerate(self.labels):
            out = F.when(c == text, i + 1) if out is None else out.when(c == text, i + 1)
        return out


def as_levels(df: DataFrame, column: str, levels: Levels) -> DataFrame:
    """Replace codes by labels; codes outside the levels become NULL. Level order goes to metadata."""
    labelled = df.withColumn(column, levels.label(column))
    return labelled.withMetadata(column, {"levels": list(levels.labels)})


def recode_from(df: DataFrame, column: str, mapping: DataFrame, keep_other: bool = False) -> DataFrame:
    """Recode by a lookup table (old, new) of any size; unmapped values become NULL unless kept."""
    old, new = mapping.columns
    table = mapping.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    found = F.coalesce(F.col("_new"), F.col(column)) if keep_other else F.col("_new")
    out = df.join(table, F.col(column) == F.col("_old"), "left")
    return out.withColumn(column, found).drop("_old", "_new")


def collapse_levels(c: Column | str, from_code: int, other: str = "other") -> Column:
    """Codes at or above a limit become one label; NULL stays NULL."""
    c = as_col(c)
    return F.when(c >= from_code, other).when(c < from_code, c.cast("string"))


def center(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Subtract the mean of the whole table (a scalar subquery, not a global window)."""
    mean = df.agg(F.avg(F.col(column).cast("double"))).scalar()
    return df.withColumn(name or f"{column}_scaled", F.col(column).cast("double") - mean)


def cut_quantiles(df: DataFrame, column: str, probs: Sequence[float], name: str = "bin") -> DataFrame:
    """Bin number by data quantiles: repeated breaks collapse, bins are closed on the left, last on both."""
    row = quantiles(df, column, probs).first()
    breaks = sorted(set(row)) if row is not None else []
    if len(breaks) < 2:
        return df.withColumn(name, F.when(F.col(column).isNotNull(), F.lit(1)))
    return df.withColumn(name, cut_bins(column, breaks, right=False))


def metric_view(df: DataFrame, x: str, y: str, size: str | None = None, group: str | None = None) -> DataFrame:
    """The columns of a scatter view under fixed names; unknown columns are an error."""
    picked = {"x": x, "y": y, "size": size, "grp": group}
    picked = {k: v for k, v in picked.items() if v is not None}
    unknown = set(picked.values()) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return df.select(*[F.col(v).alias(k) for k, v in picked.items()])


def with_labels(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Attach display labels as column metadata."""
    for c, text in labels.items():
        meta = dict(df.schema[c].metadata or {})
        df = df.withMetadata(c, {**meta, "label": text})
    return df


def labels_of(df: DataFrame) -> dict[str, str]:
    """Display label of each column, its name by default."""
    return {f.name: (f.metadata or {}).get("label", f.name) for f in df.schema}


def unite(df: DataFrame, name: str, columns: Sequence[str], sep: str = "_") -> DataFrame:
    """Paste columns into one and drop them; NULL is written as 'NA'."""
    return df.withColumn("_united", paste(list(columns), sep)).drop(*columns).withColumnRenamed("_united", name)


def separate(df: DataFrame, column: str, into: Sequence[str], sep: str) -> DataFrame:
    """Split one text column at a literal separator; missing parts are NULL."""
    parts = F.split(F.col(column), re.escape(sep))
    return df.withColumns({n: F.get(parts, i) for i, n in enumerate(into)}).drop(column)

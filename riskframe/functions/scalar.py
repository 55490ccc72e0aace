"""Scalar column expressions. All are built-in Spark SQL functions, so they stay in codegen."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .nulls import as_col, ln_positive, ratio

__all__ = [
    "ratio", "ln_positive", "expit", "logit", "log_ratio", "round_half_even", "percent",
    "case_when", "recode", "replace_first", "remove", "title_case", "paste", "fmt_mean_sd",
    "fmt_pct", "fmt_int", "cut_bins", "cut_labels", "from_dummies",
]


def expit(c: Column | str) -> Column:
    """Inverse logit."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(c)))


def logit(c: Column | str) -> Column:
    """Log odds; NULL at or outside 0 and 1."""
    c = as_col(c)
    return F.when((c > 0) & (c < 1), F.ln(c / (F.lit(1.0) - c)))


def log_ratio(num: Column | str, den: Column | str) -> Column:
    """Log of num / den; NULL where the ratio is zero or undefined."""
    return ln_positive(ratio(num, den))


def round_half_even(c: Column | str, digits: int = 0) -> Column:
    return F.bround(as_col(c), digits)


def percent(c: Column | str, digits: int = 2) -> Column:
    """A share as a percentage, rounded half-even."""
    return F.bround(as_col(c) * 100, digits)


def case_when(*branches: tuple[Column, object]) -> Column:
    """First branch whose condition is true; NULL conditions count as false; NULL if none."""
    (cond, value), *rest = branches
    out = F.when(cond, value)
    for cond, value in rest:
        out = out.when(cond, value)
    return out


def recode(c: Column | str, mapping: Mapping, keep_other: bool = False) -> Column:
    """Look values up in a literal map; unmapped values become NULL unless kept."""
    c = as_col(c)
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), c)
    return F.coalesce(found, c) if keep_other else found


def replace_first(c: Column | str, pattern: str, replacement: str) -> Column:
    """Replace the first match of a regular expression only."""
    return F.regexp_replace(as_col(c), f"(?s)^(.*?)(?:{pattern})", "$1" + replacement.replace("$", r"\$"))


def remove(c: Column | str, pattern: str) -> Column:
    """Drop the first match of a regular expression."""
    return replace_first(c, pattern, "")


def title_case(c: Column | str) -> Column:
    """Capitalise each blank-separated word (a hyphenated word counts as one)."""
    return F.initcap(as_col(c))


def paste(cols: Sequence[Column | str], sep: str = " ") -> Column:
    """Join as text; a NULL is written as 'NA'."""
    return F.concat_ws(sep, *[F.coalesce(as_col(c).cast("string"), F.lit("NA")) for c in cols])


def fmt_mean_sd(mean: Column | str, sd: Column | str, digits: int = 2) -> Column:
    """'mean (sd)' with fixed digits; a missing part is written as 'NA'."""
    def one(c):
        return F.coalesce(F.format_string(f"%.{digits}f", as_col(c).cast("double")), F.lit("NA"))
    mean, sd = as_col(mean), as_col(sd)
    return F.concat(F.when(mean.isNull(), "NA").otherwise(one(mean)), F.lit(" ("),
                    F.when(sd.isNull(), "NA").otherwise(one(sd)), F.lit(")"))


def fmt_pct(share: Column | str, digits: int = 2) -> Column:
    """'12.34%' from a share."""
    share = as_col(share)
    return F.when(share.isNotNull(), F.format_string(f"%.{digits}f%%", F.bround(share * 100, digits)))


def fmt_int(c: Column | str) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(as_col(c), 0)


def _edge(x: float) -> str:
    return f"{x:g}"


def cut_labels(breaks: Sequence[float], right: bool = True, include_lowest: bool = True) -> list[str]:
    """Interval labels such as '[0,0.1]' and '(0.1,0.2]'."""
    last = len(breaks) - 2
    out = []
    for i, (lo, hi) in enumerate(zip(breaks, breaks[1:])):
        closed_lo = not right or (include_lowest and i == 0)
        closed_hi = right or (include_lowest and i == last)
        out.append(f"{'[' if closed_lo else '('}{_edge(lo)},{_edge(hi)}{']' if closed_hi else ')'}")
    return out


def cut_bins(c: Column | str, breaks: Sequence[float], right: bool = True,
             include_lowest: bool = True) -> Column:
    """1-based bin number for fixed breaks; NULL outside the breaks or for NULL."""
    c = as_col(c)
    last = len(breaks) - 2
    out = None
    for i, (lo, hi) in enumerate(zip(breaks, breaks[1:])):
        if right:
            low = c >= lo if include_lowest and i == 0 else c > lo
            inside = low & (c <= hi)
        else:
            high = c <= hi if include_lowest and i == last else c < hi
            inside = (c >= lo) & high
        out = F.when(inside, i + 1) if out is None else out.when(inside, i + 1)
    return out


def from_dummies(cols: Sequence[str], labels: Sequence[str]) -> Column:
    """One label from mutually exclusive 0/1 columns; NULL when none or several are set."""
    code = sum((F.col(c).cast("int") * (i + 1) for i, c in enumerate(cols)), F.lit(0))
    n_set = sum((F.col(c).cast("int") for c in cols), F.lit(0))
    return F.when(n_set == 1, F.element_at(F.array(*[F.lit(x) for x in labels]), code))


def escape(text: str) -> str:
    """Literal text as a regular expression."""
    return re.escape(text)

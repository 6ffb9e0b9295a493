"""Exact quantiles (linear interpolation, as pandas ``quantile`` and DuckDB
``quantile_cont``) of any number of columns in two scans.

Spark's exact ``percentile`` aggregate keeps every distinct value of the
column in the final reducer's buffer.  Instead, ranks are selected in Spark:

1. One aggregate over all columns: the count of values and ``percentile_approx`` (a
   mergeable sketch with partial aggregation) just below and just above each target
   percentage.  The sketch's rank error is at most n/accuracy, so the
   true value lies between the two approximate ones: its bracket.
2. One pass counts (column, region, value): values inside a bracket are
   counted one by one, values between brackets only as a number.  Partial
   aggregation collapses hot values and everything outside the brackets.
3. The counts are range-partitioned by (column, region, value); totals of the
   partitions before plus running counts inside a partition give every count
   its ranks, and the few rows that hold a wanted rank are picked by a join.

What reaches the driver is one row per wanted rank, whatever the brackets hold.
A rank that falls outside its bracket (never expected) is looked for once more
with one bracket over all values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import qcol
from ..session import scratch_tables
from .cells import unpivoted
from .group_quantile import ranged, with_ends

ACCURACY = 10_000
# Half-widths of the brackets offered by pass 1; each column uses the narrowest one
# that is safely wider than the sketch's rank error plus rank rounding (3/n).
HALF_WIDTHS = (3.0 / ACCURACY, 3e-3, 3e-2, 0.3)


def sketches(cols: list[str], probs: list[float]) -> list:
    """The aggregates of pass 1, for an aggregate that may hold others as well."""
    grid = _grid(probs)
    return [a for i, c in enumerate(cols) for a in (
        F.count(qcol(c)).alias(f"__n{i}"), F.percentile_approx(qcol(c).cast("double"), grid, ACCURACY).alias(f"__g{i}"))]


def _grid(probs) -> list[float]:
    return sorted({min(1.0, max(0.0, p + s * h)) for p in probs for h in HALF_WIDTHS for s in (-1, 1)})


def brackets(row, cols: list[str], probs: list[float]) -> dict[str, list[tuple]]:
    """Disjoint brackets (low, high) of every column with values, from the row of sketches(); None is open."""
    out = {}
    for i, c in enumerate(cols):
        n = row[f"__n{i}"]
        if not n:
            continue
        width = next((w for w in HALF_WIDTHS if w >= 3.0 / n + 1.0 / ACCURACY), None)
        if width is None:
            out[c] = [(None, None)]
            continue
        at = dict(zip(_grid(probs), row[f"__g{i}"]))
        out[c] = []
        for low, high in sorted({(at[max(0.0, p - width)], at[min(1.0, p + width)]) for p in probs}):
            if out[c] and low <= out[c][-1][1]:
                low, high = out[c][-1][0], max(high, out[c].pop()[1])
            out[c].append((low, high))
    return out


def region(value, of: list[tuple]):
    """Odd numbers for the brackets, even ones for what lies between them, in the values' order."""
    if of == [(None, None)]:
        return F.lit(1)
    out = F.lit(2 * len(of))
    for k, (low, high) in reversed(list(enumerate(of))):
        out = F.when(value < F.lit(low), 2 * k).when(value <= F.lit(high), 2 * k + 1).otherwise(out)
    return out


def pick(counts: DataFrame, ranks: dict[int, list[int]]) -> dict[int, dict[int, float | None]]:
    """Values at 0-based ``ranks`` by slot; ``counts``: slot, region, v, __n.  None: not in a bracket."""
    wanted = F.explode(F.from_json(F.lit(str([{"slot": s, "rank": r} for s, rs in ranks.items() for r in rs])
                                         .replace("'", '"')), "array<struct<slot:int,rank:bigint>>"))
    wanted = counts.sparkSession.range(1).select(wanted.alias("w")).select("w.*")
    ends = with_ends(ranged(counts, ["slot", "region", "v"]), ["slot"], "region", "v")
    hit = (F.col("rank") < F.col("__end")) & (F.col("rank") >= F.col("__end") - F.col("__n"))
    found = ends.join(F.broadcast(wanted), "slot").where(hit).select("slot", "rank", "v", "region")
    out: dict[int, dict[int, float | None]] = {s: {} for s in ranks}
    for r in found.collect():  # one row for each wanted rank
        out[r["slot"]][r["rank"]] = r["v"] if r["region"] % 2 else None
    return out


def _counted(df: DataFrame, of: dict[str, list[tuple]]) -> DataFrame:
    """slot, region, v, __n of the columns ``of`` (brackets by column)."""
    made = []
    for c, b in of.items():
        v = qcol(c).cast("double")
        r = region(v, b)
        made.append({"region": F.when(v.isNotNull(), r), "v": F.when(r % 2 == 1, v)})
    found = unpivoted(df, made).where("region IS NOT NULL")
    return found.groupBy("slot", "region", "v").agg(F.count("*").alias("__n"))


def _ranks(n: int, probs) -> list[int]:
    return sorted({f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)})


def from_sketches(df: DataFrame, row, cols: list[str], probs: list[float], counted=_counted) -> dict:
    """``{col: [q(p) for p in probs]}`` by one more scan, after the ``row`` of sketches()."""
    n = {c: row[f"__n{i}"] for i, c in enumerate(cols)}
    of = brackets(row, cols, probs)
    values: dict[str, dict] = {c: {} for c in of}
    with scratch_tables(df.sparkSession):
        while of:
            names = list(of)
            ranks = {s: [r for r in _ranks(n[c], probs) if r not in values[c]] for s, c in enumerate(names)}
            found = pick(counted(df, of), ranks)
            for s, c in enumerate(names):
                values[c].update({r: v for r, v in found[s].items() if v is not None})
            of = {c: [(None, None)] for c in names if len(values[c]) < len(_ranks(n[c], probs))}
    out = {}
    for c in cols:
        at = [p * (n[c] - 1) for p in probs] if n[c] else []
        out[c] = [_interpolate(values[c][math.floor(x)], values[c][math.ceil(x)], x) for x in at] or [None] * len(probs)
    return out


def _interpolate(lo_val: float, hi_val: float, pos: float) -> float:
    lower, higher = math.floor(pos), math.ceil(pos)
    if lower == higher:
        return float(lo_val)
    return (higher - pos) * float(lo_val) + (pos - lower) * float(hi_val)


def quantiles(df: DataFrame, cols: list[str], probs: list[float], exact: bool = True) -> dict[str, list[float | None]]:
    """Return ``{col: [q(p) for p in probs]}`` (None for an all-NULL column)."""
    if not cols:
        return {}
    if not exact:
        row = df.agg(*[F.percentile_approx(qcol(c).cast("double"), list(probs), ACCURACY)
                       .alias(f"q{i}") for i, c in enumerate(cols)]).first()
        return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs))
                for i, c in enumerate(cols)}
    return from_sketches(df, df.agg(*sketches(cols, probs)).first(), cols, probs)

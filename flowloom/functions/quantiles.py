"""Exact, linearly interpolated quantiles of many columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import c, finite

#: Inverse of the rank error of a sketch, and the values that one scan may gather over all searches.
ACCURACY = 10_000
GATHERED = 2_000_000
#: Cells of the grid that narrows brackets which are still too wide to gather.
GRID = 500


@dataclass
class _Search:
    """The k-th smallest value (from 0) of column `i` is looked for between `lo` and `hi`, of which `inside` rows are expected."""

    i: int
    k: int
    lo: float
    hi: float
    inside: int
    value: float | None = None


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], accuracy: int = ACCURACY,
                    gathered: int = GATHERED) -> dict[str, list[float | None]]:
    """Quantiles per column, ignoring missing and infinite values."""
    found = quantiles_of(df, [c(n) for n in columns], probs, accuracy, gathered)
    return dict(zip(columns, found, strict=True))


def quantiles_of(df: DataFrame, values: list[Column], probs: list[float], accuracy: int = ACCURACY,
                 gathered: int = GATHERED) -> list[list[float | None]]:
    """Quantiles of several expressions, with two scans of the wide table.

    The first scan takes a mergeable rank sketch of every column; its neighbours of a wanted rank bracket the value. The
    second counts the rows below and at the ends of each bracket, sorts the few between them, and picks the value.
    A bracket that would hold too many rows to gather (hundreds of millions of rows) is narrowed by
    another scan, and one that the sketch placed wrongly is opened again, so the result is exact.
    """
    wide = df.select(*[finite(v.cast("double")).alias(f"v{i}") for i, v in enumerate(values)])
    # Where a rank may lie, in shares: three errors to each side.
    margin = 3 / accuracy
    asked = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-margin, margin)})
    first = wide.agg(*[F.struct(
        F.count(f"v{i}").alias("n"), F.min(f"v{i}").alias("lo"), F.max(f"v{i}").alias("hi"),
        F.percentile_approx(f"v{i}", asked, accuracy).alias("near")).alias(f"s{i}") for i in range(len(values))]).first()
    searches: dict[tuple[int, int], _Search] = {}
    for i in range(len(values)):
        s = first[f"s{i}"]
        for p in probs if s.n else ():
            lo, hi = (s.near[asked.index(min(max(p + d, 0.0), 1.0))] for d in (-margin, margin))
            place = p * (s.n - 1)
            for k in {math.floor(place), math.ceil(place)}:
                # The sketch answers with whole shares of n; few rows are between their ends anyway.
                lo_k, hi_k = (s.lo, s.hi) if s.n <= accuracy else (lo, hi)
                searches[i, k] = _Search(i, k, lo_k, hi_k, min(s.n, math.ceil(4 * margin * s.n) + accuracy))
    _resolve(wide, list(searches.values()), {i: first[f"s{i}"] for i in range(len(values))}, gathered)
    out = []
    for i in range(len(values)):
        n = first[f"s{i}"].n
        row = []
        for p in probs:
            if not n:
                row.append(None)
                continue
            place = p * (n - 1)
            low, high = searches[i, math.floor(place)].value, searches[i, math.ceil(place)].value
            row.append(low + (high - low) * (place - math.floor(place)))
        out.append(row)
    return out


def _resolve(wide: DataFrame, searches: list[_Search], ends: dict[int, object], gathered: int) -> None:
    while todo := [s for s in searches if s.value is None]:
        brackets = sorted({(s.i, s.lo, s.hi) for s in todo})
        expected = {(s.i, s.lo, s.hi): s.inside for s in todo}
        gather = sum(expected.values()) <= gathered
        cells = []
        for b, (i, lo, hi) in enumerate(brackets):
            x, within = F.col(f"v{i}"), (F.col(f"v{i}") > lo) & (F.col(f"v{i}") < hi)
            mine = F.when(within, x)
            between = F.sort_array(F.collect_list(mine)) if gather else F.percentile_approx(mine, [g / GRID for g in range(GRID + 1)], ACCURACY)
            cells += [F.count_if(x < lo).alias(f"below{b}"), F.count_if(x == lo).alias(f"low{b}"), F.count_if(within).alias(f"inside{b}"),
                      F.count_if(x == hi).alias(f"high{b}"), between.alias(f"between{b}")]
        wanted = {b: sorted({s.k for s in todo if (s.i, s.lo, s.hi) == key}) for b, key in enumerate(brackets)}
        counts = [f"{n}{b}" for b in range(len(brackets)) for n in ("below", "low", "inside", "high")]
        # Of what was gathered only the wanted places leave the executors.
        picked = [F.get(f"between{b}", (F.lit(k) - F.col(f"below{b}") - F.col(f"low{b}")).cast("int")).alias(f"at{b}_{k}")
                  for b, ks in wanted.items() for k in ks] if gather else [F.col(f"between{b}") for b in wanted]
        row = wide.agg(*cells).select(*counts, *picked).first()
        for s in todo:
            b = brackets.index((s.i, s.lo, s.hi))
            below, low, inside, high = (row[f"{n}{b}"] for n in ("below", "low", "inside", "high"))
            place = s.k - below
            if place < 0:
                s.lo, s.hi, s.inside = ends[s.i].lo, s.lo, below
            elif place < low:
                s.value = s.lo
            elif place < low + inside:
                if gather:
                    s.value = row[f"at{b}_{s.k}"]
                else:
                    grid = row[f"between{b}"]
                    cell = (place - low) * GRID // inside
                    s.lo, s.hi = grid[max(cell - 1, 0)] if cell > 1 else s.lo, grid[cell + 2] if cell + 2 < GRID else s.hi
                    s.inside = 4 * inside // GRID + 1
            elif place < low + inside + high:
                s.value = s.hi
            else:
                s.lo, s.hi, s.inside = s.hi, ends[s.i].hi, ends[s.i].n - below - low - inside

"""Exact quantiles by distributed selection: sketches narrow down where a rank lies, counts make sure of it, and only a few values are ever gathered."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.prefix import running

#: Values that an interval may hold to be gathered and sorted.
FEW = 10_000
#: A sketch answers within 1 / ACCURACY of the values' number; each round leaves about four times that share.
ACCURACY = 2000


class _Span(NamedTuple):
    """The values of a column above lo and below hi (None: no bound); base values are not above lo, size are inside."""

    name: str
    lo: float | None
    hi: float | None
    base: int
    size: int

    def of(self, value: Column) -> Column:
        """The value if it is inside, else null."""
        inside = F.lit(True)
        if self.lo is not None:
            inside = inside & (value > self.lo)
        if self.hi is not None:
            inside = inside & (value < self.hi)
        return F.when(inside, value)


def _around(first: float, last: float) -> list[float]:
    """Shares a little below and above those wanted, so that the values there enclose them."""
    return [max(0.0, first - 1.5 / ACCURACY), min(1.0, last + 1.5 / ACCURACY)]


def _sketch(value: Column, shares: list[float]) -> Column:
    return F.percentile_approx(value, F.lit(shares), F.lit(ACCURACY))


def quantiles(df: DataFrame, values: dict[str, Column], probs: list[float], extra: dict[str, Column] | None = None) -> tuple[dict[str, list[float | None]], dict]:
    """The exact quantiles of each named value, interpolated between neighbours, null (None) without values; and the extra aggregates, taken in the first pass.

    All values share every pass. The first pass counts and sketches; a round then counts exactly what lies below, at and between the two values that the
    sketch gives for a rank, so the rank is either one of them or in an interval with some four thousandths of the values, ties apart. Once an interval holds FEW
    values they are gathered and the rank read off. A wrong sketch would cost rounds, not the result. A thousand billion rows take three rounds.
    """
    values = {k: v.cast("double") for k, v in values.items()}
    row = df.agg(*(F.count(v).alias(f"n{i}") for i, v in enumerate(values.values())), *(_sketch(v, [x for p in probs for x in _around(p, p)]).alias(f"s{i}") for i, v in enumerate(values.values())), *(c.alias(f"x_{k}") for k, c in (extra or {}).items())).first()
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple[_Span, int], list[int]] = {}  # of a span and a probability the ranks that are wanted there
    cuts: dict[tuple[_Span, int], list[float]] = {}
    for i, name in enumerate(values):
        n = row[f"n{i}"]
        for j, p in enumerate(probs):
            if n:
                low = int(p * (n - 1))
                key = (_Span(name, None, None, 0, n), j)
                open_[key] = sorted({low, min(n - 1, low + 1)})
                cuts[key] = row[f"s{i}"][2 * j : 2 * j + 2]
    while open_:
        small = {s for s, _ in open_ if s.size <= FEW}
        if small:
            spans = sorted(small, key=str)
            got = df.agg(*(F.sort_array(F.collect_list(s.of(values[s.name]))).alias(f"v{i}") for i, s in enumerate(spans))).first()
            held = {s: got[f"v{i}"] for i, s in enumerate(spans)}
            for (s, _), ranks in open_.items():
                if s in small:
                    found |= {(s.name, r): held[s][r - s.base] for r in ranks}
            open_ = {k: r for k, r in open_.items() if k[0] not in small}
            if not open_:
                break
        keys = list(open_)
        if missing := [k for k in keys if k not in cuts]:
            got = df.agg(*(_sketch(s.of(values[s.name]), _around((open_[s, j][0] - s.base) / s.size, (open_[s, j][-1] - s.base) / s.size)).alias(f"s{i}") for i, (s, j) in enumerate(missing))).first()
            cuts |= {k: got[f"s{i}"] for i, k in enumerate(missing)}
        aggs = []
        for i, k in enumerate(keys):
            v, (lo, hi) = k[0].of(values[k[0].name]), cuts[k]
            aggs += [F.count(F.when(c, 1)).alias(f"{x}{i}") for x, c in (("a", v < lo), ("b", v == lo), ("c", (v > lo) & (v < hi)), ("d", (v == hi) & (v > lo)))]
        got, later = df.agg(*aggs).first(), {}
        for i, k in enumerate(keys):
            s, j = k
            lo, hi = cuts[k]
            a, b, c, d = (got[f"{x}{i}"] for x in "abcd")
            for r in open_[k]:
                at = r - s.base
                if a <= at < a + b:
                    found[s.name, r] = lo
                elif a + b + c <= at < a + b + c + d:
                    found[s.name, r] = hi
                else:
                    span = _Span(s.name, s.lo, lo, s.base, a) if at < a else _Span(s.name, lo, hi, s.base + a + b, c) if at < a + b + c else _Span(s.name, hi, s.hi, s.base + a + b + c + d, s.size - a - b - c - d)
                    later.setdefault((span, j), []).append(r)
        open_, cuts = later, {}
    out = {}
    for i, name in enumerate(values):
        n = row[f"n{i}"]
        out[name] = []
        for p in probs:
            at = p * (n - 1)
            low = int(at)
            a, b = (found[name, low], found[name, min(n - 1, low + 1)]) if n else (None, None)
            out[name].append(a if a is None or a == b or at == low else (low + 1 - at) * a + (at - low) * b)
    return out, {k: row[f"x_{k}"] for k in extra or {}}


def grouped_quantile(df: DataFrame, key: str, value: str, p: float, name: str) -> DataFrame:
    """(key, name): the exact interpolated quantile of each key's values, however many keys or values of one key there are. Equal values are counted first;
    the counts are then summed up in order over ranges, of which a common key has several."""
    n = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    up = running(n, [key], ["_v"], {"_up": F.col("_n")})
    size = up.groupBy(F.col(key).alias("_key")).agg(F.max("_up").alias("_size"))
    at = (F.col("_size") - 1) * F.lit(p)
    first = lambda r: F.min(F.when(F.col("_up") > r, F.col("_v")))
    both = up.join(size, F.col(key).eqNullSafe(F.col("_key"))).groupBy(key).agg(first(F.floor(at)).alias("_a"), first(F.ceil(at)).alias("_b"), F.first(at - F.floor(at)).alias("_w"))
    return both.select(key, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((1 - F.col("_w")) * F.col("_a") + F.col("_w") * F.col("_b")).alias(name))

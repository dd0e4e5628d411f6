"""Exact grouped quantiles (linear interpolation, like NumPy / pandas / DuckDB
``quantile_cont``) in two passes over the rows, however large a group is and
however wide its values range.

1. **Sketch.**  One partially aggregated ``groupBy`` builds a mergeable KLL
   quantile sketch, the count and the extremes of each group.  The sketch's
   error bound turns every wanted rank into a bracket of values that holds it.
2. **Count.**  Rows inside a bracket are counted by value, all others only by
   the gap between brackets they fall in; both are partially aggregated, so a
   hot group sends a few counts a task and the small share of its values that
   lies in a bracket.

The counts are summed by the sketch's own cut points first, so that the last
step orders only the values between two neighbouring cuts.  The counts prove
whether a bracket held its rank; a group where one did not (the bound is
probabilistic) is taken again with brackets eight times as wide, up to all of
its range, so the result is always exact.  Infinities are counted apart.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import broadcast_checked, checkpoint

#: Sketch size: about 60 kB for a large group, all values of one with fewer rows.
SKETCH = 4096
#: Ranks at which the sketch is read: brackets end at these.
GRID = 1024
INF = float("inf")


def _qname(p: float) -> str:
    return f"q{round(p * 100, 6):g}".replace(".", "_")


def rank_error(k: int) -> float:
    """Rank error of a KLL sketch of size ``k``, as a share of the rows, that 99 % of the
    estimates keep (published fit)."""
    return 2.296 / k**0.9723


def grid_ranks() -> Column:
    """The inner ranks of the grid, as one literal."""
    return F.from_json(F.lit(json.dumps([j / GRID for j in range(1, GRID)])), "array<double>")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str] | None = None,
    sketch: int = SKETCH,
    margin: float | None = None,
) -> DataFrame:
    """Return one row per group: ``keys`` + one double column per probability
    (NULL for groups without a non-null value).  NULL and NaN values are
    ignored; a NULL key is a group.  ``margin`` (default: three times the
    sketch's rank error) is the half width of the brackets, as a share of the rows."""
    keys = list(keys)
    probs = [float(p) for p in probs]
    names = list(names) if names is not None else [_qname(p) for p in probs]
    if len(names) != len(probs):
        raise ValueError("names and probs differ in length")
    if any(p < 0 or p > 1 for p in probs):
        raise ValueError("probabilities must lie in [0, 1]")
    v = F.col(value).cast("double")
    group = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.lit(0)
    base = df.select(group.alias("_g"), v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    found = _select(base, probs, sketch, 3 * rank_error(sketch) if margin is None else margin)
    if not keys:  # a global quantile is one row even when there is no value at all
        one = base.sparkSession.range(1).select(F.lit(0).alias("_one"))
        return one.join(found, F.col("_one") == F.col("_g"), "left").select(*[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    return found.select(*[F.col(f"_g.k{i}").alias(k) for i, k in enumerate(keys)], *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def _brackets(base: DataFrame, probs: list[float], sketch: int, margin: float) -> DataFrame:
    """First pass: (_g, n, neg, pos, want: [(rlo, rhi, frac, span)], cuts, spans) by group.  Ranks
    count from 0 among all values, spans are the sketch's values around them."""
    finite = F.when(F.abs("_v") < INF, F.col("_v"))
    stats = base.groupBy("_g").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_v") == -INF).alias("neg"), F.count_if(F.col("_v") == INF).alias("pos"),
        F.min(finite).alias("mn"), F.max(finite).alias("mx"), F.kll_sketch_agg_double(finite, F.lit(sketch)).alias("sk"))
    inner = F.kll_sketch_get_quantile_double("sk", grid_ranks())
    grid = F.when(F.col("mn").isNotNull(), F.concat(F.array("mn"), inner, F.array("mx")))
    stats = stats.withColumn("m", F.col("n") - F.col("neg") - F.col("pos")).withColumn("grid", grid)

    def wanted(p: Column) -> Column:
        h = (F.col("n") - 1) * p
        lo, hi = F.floor(h), F.ceil(h)
        # place among the finite values, then on the grid
        at = lambda r: F.greatest(F.least(r - F.col("neg"), F.col("m") - 1), F.lit(0))
        first = F.greatest(F.floor((at(lo) / F.col("m") - margin) * GRID), F.lit(0)).cast("int")
        last = F.least(F.ceil(((at(hi) + 1) / F.col("m") + margin) * GRID), F.lit(GRID)).cast("int")
        span = F.when(F.col("m") > 0, F.slice("grid", first + 1, last - first + 1))
        return F.struct(lo.alias("rlo"), hi.alias("rhi"), (h - lo).alias("frac"), span.alias("span"))

    out = stats.select("_g", "n", "neg", "pos", F.transform(F.from_json(F.lit(json.dumps(probs)), "array<double>"), wanted).alias("want"))
    spans = F.transform("want", lambda w: F.struct(F.get(w["span"], F.lit(0)).alias("lo"), F.element_at(w["span"], -1).alias("hi")))
    cuts = F.array_sort(F.array_distinct(F.flatten(F.transform("want", lambda w: F.coalesce(w["span"], F.expr("cast(array() as array<double>)"))))))
    return checkpoint(out.select("*", spans.alias("spans"), cuts.alias("cuts")))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _select(base: DataFrame, probs: list[float], sketch: int, margin: float) -> DataFrame:
    groups = _brackets(base, probs, sketch, margin)
    # second pass: values inside a bracket by value, others by the end of the last bracket before them
    side = broadcast_checked(groups.select(F.col("_g").alias("_s"), "spans", "cuts"))
    rows = base.where(F.abs("_v") < INF).join(side, _same("_g", "_s"))
    inside = F.exists("spans", lambda s: (s["lo"] <= F.col("_v")) & (F.col("_v") <= s["hi"]))
    before = F.array_max(F.transform(F.filter("spans", lambda s: s["hi"] < F.col("_v")), lambda s: s["hi"]))
    rows = rows.withColumn("gap", ~inside).withColumn("val", F.when(inside, F.col("_v")).otherwise(F.coalesce(before, F.lit(-INF))))
    cell = F.size(F.filter("cuts", lambda c: c <= F.col("val")))
    counts = checkpoint(rows.groupBy("_g", cell.alias("cell"), "val", "gap").agg(F.count(F.lit(1)).alias("c")))

    # which cell holds each wanted rank
    by_cell = Window.partitionBy("_g").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = counts.groupBy("_g", "cell").agg(F.sum("c").alias("cc")).withColumn("upto", F.sum("cc").over(by_cell))
    ranks = F.array_distinct(F.flatten(F.transform("want", lambda w: F.array(w["rlo"], w["rhi"]))))
    wanted = groups.select(F.col("_g").alias("_w"), F.transform(ranks, lambda r: r - F.col("neg")).alias("ranks"))
    start = F.col("upto") - F.col("cc")
    hits = F.filter("ranks", lambda r: (start <= r) & (r < F.col("upto")))
    targets = cells.join(wanted, _same("_g", "_w")).select(F.col("_g").alias("_t"), F.col("cell").alias("t_cell"), start.alias("start"), hits.alias("hits"))
    targets = targets.where(F.size("hits") > 0)
    # only values between two neighbouring cuts are put in order
    inner = Window.partitionBy("_g", "cell").orderBy("val", "gap").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.join(targets, _same("_g", "_t") & (F.col("cell") == F.col("t_cell"))).withColumn("end", F.col("start") + F.sum("c").over(inner))
    mine = F.filter("hits", lambda r: (F.col("end") - F.col("c") <= r) & (r < F.col("end")))
    values = placed.where(F.size(mine) > 0).select("_g", "gap", F.explode(F.transform(mine, lambda r: F.struct(r.alias("r"), F.col("val").alias("val")))).alias("hit"))
    solved = checkpoint(values.groupBy("_g").agg(F.collect_list("hit").alias("hits"), F.bool_or("gap").alias("missed")))

    found = groups.join(solved.where(~F.col("missed")).select(F.col("_g").alias("_h"), F.map_from_entries("hits").alias("at")), _same("_g", "_h"), "left")
    # groups of infinities only have no finite rank to look up
    finite = F.col("n") > F.col("neg") + F.col("pos")
    found = found.where(F.col("_h").isNotNull() | ~finite | ~F.exists("want", _asks_finite))

    def value(r: Column) -> Column:
        return F.when(r < F.col("neg"), -INF).when(r >= F.col("n") - F.col("pos"), INF).otherwise(F.try_element_at("at", r - F.col("neg")))

    def quantile(w: Column) -> Column:
        lo, hi = value(w["rlo"]), value(w["rhi"])
        return F.when(lo == hi, lo).otherwise((1 - w["frac"]) * lo + w["frac"] * hi)

    out = found.select("_g", F.transform("want", quantile).alias("_q"))
    missed = solved.where("missed").select(F.col("_g").alias("_m"))
    if missed.limit(1).count():
        again = base.join(broadcast_checked(missed), _same("_g", "_m"), "left_semi")
        out = out.unionByName(_select(again, probs, sketch, 8 * margin + 1 / GRID))
    return out


def _asks_finite(w: Column) -> Column:
    """Whether one of the ranks lies among the finite values."""
    first, last = F.col("neg"), F.col("n") - F.col("pos")
    return ((w["rlo"] >= first) & (w["rlo"] < last)) | ((w["rhi"] >= first) & (w["rhi"] < last))

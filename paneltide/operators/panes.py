"""Regressions over overlapping windows, from panes that are read once.

A pane is a stretch of a series' rows that no window cuts. Its rows become one row of moments: sums of products of both
legs, of their lags and of their changes. All that an Engle-Granger test needs of a window is a quadratic form of the sums
over its panes, so no row is copied to its windows, and panes and windows keep the partitioning by series.

A row's lag may lie before the window. Only a window's first two rows are concerned, so a pane also keeps the values of its
first row, from which the products of both are taken off again. Levels count from the series' first row, which keeps
the digits that squares would lose.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .estimators import half_life_of
from .windows import BY, ORDER

#: What the sums are taken of: all rows, rows with a lag, rows with two. o is the constant, u and v are the legs, 1 marks
#: the row before, d a change.
SETS = {"l": ("o", "u", "v"), "a": ("o", "u1", "v1", "du", "dv"), "b": ("o", "u1", "v1", "du", "dv", "du1", "dv1")}
HAS = {"l": "true", "a": "u1 IS NOT NULL", "b": "du1 IS NOT NULL"}
#: Of a pane's first row; n: the row after it.
EDGE = ("u", "v", "u1", "v1", "du", "dv", "du1", "dv1", "ndu", "ndv")
#: A residual sum below this share of the leg's own is rounding: the legs are collinear.
ROUNDING = 1e-12


def _sums() -> list[tuple[str, str, str]]:
    return [(s, p, q) for s, names in SETS.items() for p, q in combinations_with_replacement(names, 2)]


def _logs(aligned: DataFrame, log: bool, by: tuple[str, ...]) -> DataFrame:
    v = (lambda c: F.when(F.col(c) > 0, F.log(c))) if log else F.col
    return aligned.select(*by, ORDER, v("x").alias("x"), v("y").alias("y"))


def panes(aligned: DataFrame, pane: Callable[[Column, Column], Column], log: bool = True, by: tuple[str, ...] = BY) -> DataFrame:
    """The moments of each pane. pane(k, n): the number of the pane, rising with k, of row k (from 0) of a series of n rows.

    Rows without both legs count as rows but hold no values. __k is a pane's first row with values, __before that of the
    pane before."""
    own, ordered = W.partitionBy(*by), W.partitionBy(*by).orderBy(ORDER)
    rows = _logs(aligned, log, by).withColumn("__k", F.row_number().over(ordered) - 1).withColumn("__n", F.count(F.lit(1)).over(own))
    rows = rows.withColumn("__pane", pane(F.col("__k"), F.col("__n"))).where("x IS NOT NULL AND y IS NOT NULL")
    from_first = lambda c: F.col(c) - F.first(c).over(ordered.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumns({"u": from_first("x"), "v": from_first("y")})
    rows = rows.withColumns({"u1": F.lag("u").over(ordered), "v1": F.lag("v").over(ordered), "u2": F.lag("u", 2).over(ordered), "v2": F.lag("v", 2).over(ordered), "nu": F.lead("u").over(ordered), "nv": F.lead("v").over(ordered), "__last": F.lag("__pane").over(ordered)})
    rows = rows.withColumns({"o": F.lit(1.0), "du": F.expr("u - u1"), "dv": F.expr("v - v1"), "du1": F.expr("u1 - u2"), "dv1": F.expr("v1 - v2"), "ndu": F.expr("nu - u"), "ndv": F.expr("nv - v")})
    opens = F.col("__last").isNull() | (F.col("__last") != F.col("__pane"))
    out = rows.groupBy(*by, F.col("__pane")).agg(
        F.min("__k").alias("__k"),
        F.max("__n").alias("__n"),
        F.max(ORDER).alias(ORDER),
        F.max(F.when(opens, F.col("x") - F.col("u"))).alias("__x0"),
        F.max(F.when(opens, F.col("y") - F.col("v"))).alias("__y0"),
        *[F.expr(f"coalesce(sum({p} * {q}) FILTER (WHERE {HAS[s]}), 0D) AS {s}_{p}_{q}") for s, p, q in _sums()],
        *[F.max(F.when(opens, F.col(c))).alias(f"e_{c}") for c in EDGE],
    )
    return out.withColumn("__before", F.lag("__k").over(W.partitionBy(*by).orderBy("__k")))


def merged(parts: DataFrame, windows: Callable[[Column, Column], Column], start: Callable[[Column, Column], Column], by: tuple[str, ...] = BY) -> DataFrame:
    """The moments of each window. windows(k, n): the numbers of the windows that hold row k; start(window, n): its first row."""
    dealt = parts.withColumn("window", F.explode(windows(F.col("__k"), F.col("__n"))))
    first = F.coalesce(F.col("__before") < start(F.col("window"), F.col("__n")), F.lit(True))
    return dealt.groupBy(*by, "window").agg(
        F.max(ORDER).alias(ORDER),
        F.max("__x0").alias("__x0"),
        F.max("__y0").alias("__y0"),
        *[F.sum(f"{s}_{p}_{q}").alias(f"{s}_{p}_{q}") for s, p, q in _sums()],
        *[F.max(F.when(first, F.col(f"e_{c}"))).alias(f"e_{c}") for c in EDGE],
    )


def _form(s: str, left: dict[str, str], right: dict[str, str]) -> str:
    """The sum over a set of the product of two linear forms, as SQL text (a Column for each term takes the driver seconds)."""
    order, terms = SETS[s], []
    for p, cp in left.items():
        for q, cq in right.items():
            a, b = sorted((p, q), key=order.index)
            terms.append(" * ".join([x for x in (cp, cq) if x != "1"] + [f"{s}_{a}_{b}"]))
    return "(" + " + ".join(terms) + ")"


def tested(moments: DataFrame, least: int = 30, by: tuple[str, ...] = BY) -> DataFrame:
    """Of each window of merged(): date (its last), hedge, intercept, r2, n_obs, lag_used, t_stat and half_life, as
    estimators.engle_granger and estimators.half_life of the spread give them for the window's rows; spread_mean and
    spread_std of the spread with its intercept in it, snr as estimators.snr, and return_corr, the correlation of the changes."""
    c = F.col
    m = moments.withColumn("n_obs", c("l_o_o").cast("long")).where(c("n_obs") >= least)
    m = m.withColumns({"svv": c("l_v_v") - c("l_o_v") * c("l_o_v") / c("n_obs"), "suv": c("l_u_v") - c("l_o_u") * c("l_o_v") / c("n_obs"), "suu": c("l_u_u") - c("l_o_u") * c("l_o_u") / c("n_obs")})
    m = m.withColumn("hedge", F.when(c("svv") > 0, c("suv") / c("svv"))).where("hedge IS NOT NULL")
    m = m.withColumn("alpha", (c("l_o_u") - c("hedge") * c("l_o_v")) / c("n_obs"))
    e1, d, d1 = {"o": "-alpha", "u1": "1", "v1": "-hedge"}, {"du": "1", "dv": "-hedge"}, {"du1": "1", "dv1": "-hedge"}
    # The window's first row (0) and its second (1); null where the row has no such value in the series.
    edge = {"e1_0": "e_u1 - alpha - hedge * e_v1", "d_0": "e_du - hedge * e_dv", "d1_0": "e_du1 - hedge * e_dv1", "e1_1": "e_u - alpha - hedge * e_v", "d_1": "e_ndu - hedge * e_ndv"}
    m = m.withColumns({name: F.expr(text) for name, text in edge.items()})
    in_a = lambda p, q, first: f"{_form('a', p, q)} - coalesce({first}, 0D)"
    in_b = lambda p, q, first, second: f"{_form('b', p, q)} - if(d1_0 IS NULL, 0D, {first}) - if(d_0 IS NULL, 0D, {second})"
    sums = {
        "a0": in_a(e1, e1, "e1_0 * e1_0"), "b0": in_a(e1, d, "e1_0 * d_0"), "c0": in_a(d, d, "d_0 * d_0"), "s_e": in_a({"o": "1"}, e1, "e1_0"), "s_d": in_a({"o": "1"}, d, "d_0"),
        "s_u": in_a({"o": "1"}, {"du": "1"}, "e_du"), "s_v": in_a({"o": "1"}, {"dv": "1"}, "e_dv"),
        "q_u": in_a({"du": "1"}, {"du": "1"}, "e_du * e_du"), "q_v": in_a({"dv": "1"}, {"dv": "1"}, "e_dv * e_dv"), "q_uv": in_a({"du": "1"}, {"dv": "1"}, "e_du * e_dv"),
        "a": in_b(e1, e1, "e1_0 * e1_0", "e1_1 * e1_1"), "b": in_b(e1, d, "e1_0 * d_0", "e1_1 * d_1"), "c": in_b(d, d, "d_0 * d_0", "d_1 * d_1"),
        "f": in_b(e1, d1, "e1_0 * d1_0", "e1_1 * d_0"), "g": in_b(d1, d1, "d1_0 * d1_0", "d_0 * d_0"), "h": in_b(d, d1, "d_0 * d1_0", "d_1 * d_0"),
    }
    m = m.withColumns({name: F.expr(text) for name, text in sums.items()})
    m = m.withColumns({"n0": c("n_obs") - 1, "n1": c("n_obs") - 2, "det": c("a") * c("g") - c("f") * c("f")})
    m = m.withColumns({"rho1": F.try_divide(c("b") * c("g") - c("h") * c("f"), c("det")), "gam1": F.try_divide(c("a") * c("h") - c("f") * c("b"), c("det"))})
    m = m.withColumns({"ssr1": c("c") - c("rho1") * c("b") - c("gam1") * c("h"), "ssr0": c("c") - F.try_divide(c("b") * c("b"), c("a")), "ssr": c("c0") - F.try_divide(c("b0") * c("b0"), c("a0"))})
    real = lambda s: c(s) > ROUNDING * c("suu")
    aic = lambda s, k: F.when(real(s), c("n1") * F.log(c(s) / c("n1")) + 2 * k)
    m = m.withColumn("lag_used", F.when(aic("ssr1", 2) < aic("ssr0", 1), 1).otherwise(0))
    t0 = F.when(real("ssr"), c("b0") / c("a0") / F.sqrt(c("ssr") / (c("n0") - 1) / c("a0")))
    t1 = F.when(real("ssr1"), c("rho1") / F.sqrt(c("ssr1") / (c("n1") - 2) * c("g") / c("det")))
    level = c("a0") - c("s_e") * c("s_e") / c("n0")
    m = m.withColumn("slope", F.when(level > ROUNDING * c("suu"), (c("b0") - c("s_e") * c("s_d") / c("n0")) / level))
    r2 = F.when(c("suu") > 0, c("suv") * c("suv") / (c("suu") * c("svv"))).otherwise(1.0)
    intercept = c("alpha") + c("__x0") - c("hedge") * c("__y0")
    t_stat = F.when(c("lag_used") == 1, t1).otherwise(t0)
    # Clipped at zero, which sums of squares may miss by rounding.
    m = m.withColumns({name: F.expr(f"greatest({text}, 0D)") for name, text in {"var_s": "(suu - 2 * hedge * suv + hedge * hedge * svv) / (n_obs - 1)", "var_d": "(c0 - s_d * s_d / n0) / (n0 - 1)", "var_u": "q_u - s_u * s_u / n0", "var_v": "q_v - s_v * s_v / n0"}.items()})
    others = {
        "spread_mean": "alpha + __x0 - hedge * __y0",
        "spread_std": "sqrt(var_s)",
        "snr": "if(var_d > 0, sqrt(var_s / var_d), 0D)",
        "return_corr": "if(var_u > 0 AND var_v > 0, (q_uv - s_u * s_v / n0) / sqrt(var_u * var_v), CAST(NULL AS DOUBLE))",
    }
    out = m.select(*by, "window", ORDER, "hedge", intercept.alias("intercept"), r2.alias("r2"), "n_obs", "lag_used", t_stat.alias("t_stat"), half_life_of(c("slope")).alias("half_life"), *[F.expr(text).alias(name) for name, text in others.items()])
    # A filter on the estimates, pushed below them, would spell out each formula in terms of the sums, many times over.
    # Grouping rows that are already one a group, where they lie, stops it.
    names = [n for n in out.columns if n not in (*by, "window")]
    return out.groupBy(*by, "window").agg(*[F.max(n).alias(n) for n in names])


def whole(aligned: DataFrame, log: bool = True, by: tuple[str, ...] = BY, least: int = 30) -> DataFrame:
    """tested() of all rows of each series, in one pass and one shuffle."""
    one = panes(aligned, lambda k, n: F.lit(0), log, by)
    return tested(merged(one, lambda k, n: F.array(F.lit(0)), lambda w, n: F.lit(0), by), least, by).drop("window", ORDER)


def rolling(aligned: DataFrame, rows: int, step: int, log: bool = True, by: tuple[str, ...] = BY, least: int = 30) -> DataFrame:
    """tested() of the windows of `rows` rows that start at row 0, step, 2 * step, ... of each series and lie in it."""
    odd = rows % step
    pane = lambda k, n: 2 * F.floor(k / step) + (k % step >= odd).cast("long")

    def windows(k: Column, n: Column) -> Column:
        low = F.greatest(F.ceil((k - rows + 1) / step), F.lit(0))
        high = F.least(F.floor(k / step), F.floor((n - rows) / step))
        return F.when((n >= rows) & (low <= high), F.sequence(low, high))

    return tested(merged(panes(aligned, pane, log, by), windows, lambda w, n: w * step, by), least, by)


def shares(aligned: DataFrame, windows: int = 4, share: float = 0.6, log: bool = True, by: tuple[str, ...] = BY, least: int = 30) -> DataFrame:
    """tested() of `windows` windows of a share of each series' rows, equally far apart."""
    size = lambda n: F.floor(n * share)
    step = lambda n: F.floor((n - size(n)) / (windows - 1))

    def pane(k: Column, n: Column) -> Column:
        out = F.lit(0)
        for w in range(windows):
            out = out + (k >= w * step(n)).cast("int") + (k >= w * step(n) + size(n)).cast("int")
        return out

    inside = lambda k, n: F.filter(F.sequence(F.lit(0), F.lit(windows - 1)), lambda w: (k >= w * step(n)) & (k < w * step(n) + size(n)))
    return tested(merged(panes(aligned, pane, log, by), inside, lambda w, n: w * step(n), by), least, by)


def month_ends(aligned: DataFrame, months: int, least: int = 30, log: bool = True, by: tuple[str, ...] = BY) -> DataFrame:
    """OLS of x on y over (month end - months, month end] for each month end of the series, to that of its last month:
    date, hedge, intercept, r2, n_obs.

    The month end less some months may be any day from the 28th on, so a month is a pane of its first 28 days and one for
    each day after."""
    c = F.col
    own, ordered = W.partitionBy(*by), W.partitionBy(*by).orderBy(ORDER)
    rows = _logs(aligned, log, by).withColumn("__last", F.last_day(F.max(ORDER).over(own))).where("x IS NOT NULL AND y IS NOT NULL")
    first = lambda k: F.first(k).over(ordered.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumns({"__x0": first("x"), "__y0": first("y")}).withColumns({"o": F.lit(1.0), "u": c("x") - c("__x0"), "v": c("y") - c("__y0")})
    sums = [(p, q) for p, q in combinations_with_replacement(SETS["l"], 2)]
    pane = F.date_add(F.trunc(ORDER, "month"), F.greatest(F.day(ORDER), F.lit(28)) - 1)
    parts = rows.groupBy(*by, pane.alias("__day")).agg(F.max("__last").alias("__last"), F.max("__x0").alias("__x0"), F.max("__y0").alias("__y0"), *[F.sum(c(p) * c(q)).alias(f"l_{p}_{q}") for p, q in sums])
    ends = F.transform(F.sequence(F.lit(0), F.lit(months)), lambda k: F.last_day(F.add_months(F.trunc("__day", "month"), k)))
    dealt = parts.withColumn("date", F.explode(ends)).where((c("__day") > F.add_months("date", -months)) & (c("date") <= c("__last")))
    m = dealt.groupBy(*by, "date").agg(F.max("__x0").alias("__x0"), F.max("__y0").alias("__y0"), *[F.sum(f"l_{p}_{q}").alias(f"l_{p}_{q}") for p, q in sums])
    m = m.withColumn("n_obs", c("l_o_o").cast("long")).where(c("n_obs") >= least)
    m = m.withColumns({"svv": c("l_v_v") - c("l_o_v") * c("l_o_v") / c("n_obs"), "suv": c("l_u_v") - c("l_o_u") * c("l_o_v") / c("n_obs"), "suu": c("l_u_u") - c("l_o_u") * c("l_o_u") / c("n_obs")})
    m = m.withColumn("hedge", F.when(c("svv") > 0, c("suv") / c("svv")))
    intercept = (c("l_o_u") - c("hedge") * c("l_o_v")) / c("n_obs") + c("__x0") - c("hedge") * c("__y0")
    r2 = F.when(c("svv") > 0, F.when(c("suu") > 0, c("suv") * c("suv") / (c("suu") * c("svv"))).otherwise(1.0))
    return m.select(*by, "date", "hedge", intercept.alias("intercept"), r2.alias("r2"), "n_obs")

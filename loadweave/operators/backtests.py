"""Rolling backtests of quantile models and conformal bands, every window ending before the day it serves.

Rows out are those of models.rolling_origin(). A day's model is the one fitted last on its grid of
refits; scores of past days meet the days they serve by explode, so joins are by key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import calibration, models
from . import features as feats
from .relations import dealt_union

OUT = ["series_id", "day_idx", "hour", "actual", "persist", "snaive", "model", "p10", "p90"]
FITS = "series_id string, fit_day int, fit_end int, weights array<array<double>>"


def _rows(days: DataFrame, names: Sequence[str], feature_fn: Callable, holidays: DataFrame | None, weather: Sequence[str]) -> DataFrame:
    return models.with_vector(feature_fn(days, holidays), [*names, *weather])


def _ends(rows: DataFrame) -> DataFrame:
    """(series_id, new): the day after each series' last known one."""
    return rows.where("target is not null").groupBy("series_id").agg((F.max("day_idx") + 1).alias("new"))


def _tested(rows: DataFrame, ends: DataFrame, n_test: int) -> DataFrame:
    x = rows.where("value is not null").join(ends, "series_id")
    return x.where((F.col("day_idx") >= F.col("new") - n_test) & (F.col("day_idx") < F.col("new")))


def fit_quantiles(rows: DataFrame, n_test: int, levels: Sequence[float], every: int, gap: int, first: int) -> DataFrame:
    """Linear quantile models for each level and every `every`-th of the last n_test days: (series_id, fit_day, fit_end,
    weights), fitted on the days before fit_end, which is `gap` days earlier (but after `first`)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["day_idx", "hour"], kind="stable")
        x, y, day = np.stack(pdf["x"].to_numpy()), pdf["target"].to_numpy(float), pdf["day_idx"].to_numpy()
        ok = np.isfinite(y)
        new = int(day[ok].max()) + 1 if ok.any() else 0
        out = []
        for d in range(new - n_test, new, every):
            end = max(first + 1, d - gap) if gap else d
            past = ok & (day < end)
            if past.any():
                out.append((pdf["series_id"].iloc[0], d, end, [models.quantile_weights(x[past], y[past], q).tolist() for q in levels]))
        return pd.DataFrame(out, columns=["series_id", "fit_day", "fit_end", "weights"])

    return rows.select("series_id", "day_idx", "hour", "x", "target").groupBy("series_id").applyInPandas(run, FITS)


def _in_order(n: int) -> Column:
    """base plus each quantile model's value, crossing values sorted."""
    return F.array_sort(F.array(*(F.col("base") + models.dot("x", F.get("weights", F.lit(i))) for i in range(n))))


def _fit_day(n_test: int, every: int) -> Column:
    """The refit that serves a row's day; `new` is the series' next unknown day."""
    start = F.col("new") - n_test
    return start + F.floor((F.col("day_idx") - start) / every).cast("int") * every


def rolling_quantile(
    days: DataFrame, n_test: int, every: int = 1, tail: int = 0, coverage: float = 0.8, names: Sequence[str] = tuple(feats.FEATURES), feature_fn=feats.features,
    holidays: DataFrame | None = None, weather: Sequence[str] = (), first: int = feats.FIRST,
) -> DataFrame:
    """Native quantile models 0.1, 0.5, 0.9. With tail, models stop `tail` days before their fit day, and the upper of the
    two neighbours of the `coverage` quantile of those days' misses (at least 0) widens the band."""
    rows = _rows(days, names, feature_fn, holidays, weather)
    ends = _ends(rows)
    fits = fit_quantiles(rows, n_test, (0.1, 0.5, 0.9), every, tail, first)
    x = _tested(rows, ends, n_test).withColumn("fit_day", _fit_day(n_test, every)).join(fits, ["series_id", "fit_day"]).withColumn("q", _in_order(3))
    widen = F.lit(0.0)
    if tail:
        past = rows.where("value is not null").join(fits, "series_id").where("day_idx >= fit_end and day_idx < fit_day").withColumn("q", _in_order(3))
        miss = F.greatest(F.col("q")[0] - F.col("value"), F.col("value") - F.col("q")[2], F.lit(0.0))
        offsets = calibration.higher_quantile(past.withColumn("score", miss), ["series_id", "fit_day"], "score", coverage)
        x = x.join(offsets.select("series_id", "fit_day", "offset"), ["series_id", "fit_day"], "left")
        widen = F.coalesce("offset", F.lit(0.0))
    return x.withColumn("actual", F.col("value")).withColumn("model", F.col("q")[1]).withColumn("p10", F.col("q")[0] - widen).withColumn("p90", F.col("q")[2] + widen).select(OUT)


def rolling_cqr(
    days: DataFrame, n_test: int, every: int = 7, window: int = 56, coverage: float = 0.8, eta: float = 0.0, per_hour: bool = False,
    names: Sequence[str] = tuple(feats.FEATURES),
    feature_fn=feats.features, holidays: DataFrame | None = None, weather: Sequence[str] = (), first: int = feats.FIRST,
) -> DataFrame:
    """Conformalised quantile models: those of a day stop `window` days before their fit day; the order statistic of the
    misses of the `window` days before the day (pooled or by hour) widens its band. With eta the coverage aimed at
    moves after each day by eta times its excess of misses, inside [coverage, 0.995]."""
    low = round((1 - coverage) / 2, 6)
    rows = _rows(days, names, feature_fn, holidays, weather)
    ends = _ends(rows)
    fits = fit_quantiles(rows, n_test, (low, 0.5, round(1 - low, 6)), every, window, first)
    x = _tested(rows, ends, n_test).withColumn("fit_day", _fit_day(n_test, every)).join(fits, ["series_id", "fit_day"])
    x = x.select("series_id", "day_idx", "hour", F.col("value").alias("actual"), "persist", "snaive", _in_order(3).alias("q"))
    # each past row under the model of each day it serves
    served = rows.where("value is not null").join(ends, "series_id").withColumn("past_day", F.col("day_idx")).where(F.col("day_idx") >= first)
    served = served.withColumn("day_idx", F.explode(F.sequence(F.col("past_day") + 1, F.col("past_day") + window))).where((F.col("day_idx") >= F.col("new") - n_test) & (F.col("day_idx") < F.col("new")))
    served = served.withColumn("fit_day", _fit_day(n_test, every)).join(fits, ["series_id", "fit_day"]).withColumn("q", _in_order(3))
    miss = F.greatest(F.col("q")[0] - F.col("value"), F.col("value") - F.col("q")[2])
    by = ["series_id", "day_idx", "hour"] if per_hour else ["series_id", "day_idx"]
    scores = served.withColumn("score", miss).groupBy(*by).agg(F.array_sort(F.collect_list("score")).alias("scores"))
    # one row a day, with its hours' values in arrays; scores come once a day, or once an hour if each has its own
    cells = ["hour", "actual", "persist", "snaive", "q"]
    if per_hour:
        x, cells = x.join(scores, by, "left"), [*cells, "scores"]
    x = x.groupBy("series_id", "day_idx").agg(F.array_sort(F.collect_list(F.struct(*cells))).alias("h"))
    x = x.select("series_id", "day_idx", *(F.col("h")[c].alias(c) for c in cells))
    if not per_hour:
        x = x.join(scores, by, "left")

    def offset(s, aim: float) -> float:
        return max(0.0, s[min(max(int(np.ceil((len(s) + 1) * aim - 1e-12)), 1), len(s)) - 1]) if s is not None and len(s) else 0.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        aim, out = coverage, []
        for day in pdf.sort_values("day_idx").itertuples():
            widen = np.array([offset(s, aim) for s in day.scores]) if per_hour else offset(day.scores, aim)
            q, actual = np.stack(list(day.q)), np.asarray(day.actual, float)
            low, high = q[:, 0] - widen, q[:, 2] + widen
            values = {"hour": day.hour, "actual": actual, "persist": day.persist, "snaive": day.snaive, "model": q[:, 1], "p10": low, "p90": high}
            out.append(pd.DataFrame({"series_id": day.series_id, "day_idx": day.day_idx, **values})[OUT])
            hit = float(((actual >= low) & (actual <= high)).mean())
            aim = float(np.clip(aim + eta * (coverage - hit), coverage, 0.995)) if eta else aim
        return pd.concat(out)

    schema = "series_id string, day_idx int, hour int, actual double, persist double, snaive double, model double, p10 double, p90 double"
    return x.groupBy("series_id").applyInPandas(run, schema)


def rolling_conformal(
    days: DataFrame, n_test: int, kind: str = "cqr", alpha: float = 0.2, cal_days: int = 28, per_hour: bool = False, online: bool = True,
    names: Sequence[str] = tuple(feats.FEATURES),
    feature_fn=feats.features, lams: Sequence[float] = (10.0,), holidays: DataFrame | None = None, weather: Sequence[str] = (), first: int = feats.FIRST,
) -> DataFrame:
    """Bands of a corrector that stops cal_days before each test day. "residual": quantiles of the residuals of the days
    between; "cqr": the fit's own residual quantiles by hour, moved out by the conformal quantile of those
    days' misses. Pooled or by hour; online adds the test days before, each under its own model."""
    if kind not in ("cqr", "residual"):
        raise ValueError(kind)
    rows = _rows(days, names, feature_fn, holidays, weather)
    ends = _ends(rows)
    short = first + (2 if kind == "cqr" else 1)

    def cut(d: int) -> int:
        if d - cal_days > short:
            return d - cal_days
        return d - max(7, cal_days // 2) if kind == "cqr" else d

    fits = models._fit(rows, lambda new: sorted({cut(d) for d in range(new - n_test, new)}), lams, True, True, (alpha / 2, 1 - alpha / 2))
    fits = fits.select("series_id", F.col("test_day").alias("cut"), "weights", "q_low", "q_high")
    later = F.col("test") - cal_days > short
    cut_of = F.when(later, F.col("test") - cal_days).otherwise(F.col("test") - max(7, cal_days // 2) if kind == "cqr" else F.col("test"))
    tests = ends.select("series_id", "new", F.explode(F.sequence(F.col("new") - n_test, F.col("new") - 1)).alias("test")).withColumn("cut", cut_of.cast("int")).join(fits, ["series_id", "cut"])
    x = rows.where("value is not null").join(tests, "series_id").where((F.col("day_idx") <= F.col("test")) & ((F.col("day_idx") >= F.col("cut")) | (F.col("cut") == F.col("test"))))
    x = x.withColumn("model", F.col("base") + models.dot("x", "weights"))
    x = x.withColumn("p10", F.col("model") + F.get("q_low", F.col("hour"))).withColumn("p90", F.col("model") + F.get("q_high", F.col("hour"))).withColumn("actual", F.col("value"))
    score = calibration.cqr_score() if kind == "cqr" else F.col("actual") - F.col("model")
    x = x.withColumn("score", score)
    own = x.where("day_idx = test")
    scores = x.where("day_idx < test").select("series_id", "test", "hour", "score")
    if online:
        later_days = F.sequence(F.col("test") + 1, F.col("new") - 1)
        pool = own.where("test < new - 1").select("series_id", F.explode(later_days).alias("test"), "hour", "score")
        scores = dealt_union(["series_id", "test"], scores, pool)
    by = ["series_id", "test", "hour"] if per_hour else ["series_id", "test"]
    if kind == "cqr":
        offsets = calibration.conformal_offset(scores, by, "score", alpha).drop("n")
        out = own.join(offsets, by, "left").withColumn("c", F.coalesce("offset", F.lit(0.0)))
        out = out.withColumns({"p10": F.col("p10") - F.col("c"), "p90": F.col("p90") + F.col("c")})
    else:
        q = F.percentile("score", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
        out = own.join(scores.groupBy(*by).agg(q.alias("r")), by).withColumns({"p10": F.col("model") + F.col("r")[0], "p90": F.col("model") + F.col("r")[1]})
    return out.select(OUT)


def targeted_conformal(
    days: DataFrame, n_test: int, target: float = 0.9, split: float = 0.5, cal_days: int = 28, first: int = feats.FIRST,
    factors: Sequence[float] = (1.0, 0.7, 0.5, 0.35, 0.25), **options
) -> DataFrame:
    """rolling_conformal("cqr") with the first alpha, of the nominal one times `factors`, whose bands covered the target on
    the days before the test days (the last if none did; the nominal one where history is too short).
    Adds alpha. A constant number of backtests, each over the series that chose its alpha."""
    n_val = max(7, int(n_test * split))
    alphas = [(1 - target) * f for f in factors]
    ends = days.where("value is not null").groupBy("series_id").agg((F.max("day_idx") + 1).alias("new"))
    before = days.join(ends, "series_id").where((F.col("day_idx") < F.col("new") - n_test) & (F.col("new") - n_test - n_val > first + cal_days + 2)).drop("new")
    seen = []
    for k, alpha in enumerate(alphas):
        b = rolling_conformal(before, n_val, "cqr", alpha, cal_days, first=first, **options)
        seen.append(b.groupBy("series_id").agg(F.avg(F.col("actual").between(F.col("p10"), F.col("p90")).cast("double")).alias("coverage")).withColumn("k", F.lit(k)))
    chosen = dealt_union(["series_id"], *seen).groupBy("series_id").agg(F.coalesce(F.min(F.when(F.col("coverage") >= target - 1e-12, F.col("k"))), F.lit(len(alphas) - 1)).alias("k"))
    chosen = ends.select("series_id").join(chosen, "series_id", "left").select("series_id", F.coalesce("k", F.lit(0)).alias("k"))
    from .relations import _cut

    chosen, out = _cut(chosen), []
    for k, alpha in enumerate(alphas):
        some = days.join(chosen.where(F.col("k") == k), "series_id", "left_semi")
        out.append(rolling_conformal(some, n_test, "cqr", alpha, cal_days, first=first, **options).withColumn("alpha", F.lit(alpha)))
    return dealt_union(["series_id"], *out)

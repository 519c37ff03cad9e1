"""Shrunk ridge correctors on features, for all series and all expanding windows at once.

A fit needs only the moments of a window (sums of x, x x', x y, y). Per series the moments are
cumulated by day, so one pass yields the fit before every test day: no window is read twice.
Series are independent groups; one has as many rows as it has hours. Predictions, bands and
scores are joins and column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import features as feats
from .relations import dealt_union

SHRINK_GRID = (0.0, 0.25, 0.5, 0.75, 1.0)
MODEL = "series_id string, test_day int, lam double, shrink double, weights array<double>, n_rows long, q_low array<double>, q_high array<double>"
HISTORY = 70  # days that features and the holiday-aware base can look back over


def with_vector(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Features as one array x, rows with a null feature dropped; the first name is the intercept."""
    return rows.na.drop(subset=list(names)).withColumn("x", F.array(*(F.col(n).cast("double") for n in names)))


def _solve(g: np.ndarray, b: np.ndarray, n: float, lam: float) -> np.ndarray:
    """Ridge weights in raw units from moments of [1, features]: standardised by population deviations
    (0 counts as 1), the intercept not penalised."""
    mean = g[0] / n
    var = np.diag(g) / n - mean**2
    sd = np.sqrt(np.where(var > 1e-12 * mean**2 + 1e-18, var, 1.0))  # below is what rounding leaves of a constant
    mean[0], sd[0] = 0.0, 1.0
    t = np.diag(1 / sd)
    t[0] = -mean / sd  # z = x @ t with the intercept column shifting each feature by its mean
    t[0, 0] = 1.0
    penalty = lam * np.eye(len(g))
    penalty[0, 0] = 0.0
    return t @ np.linalg.solve(t.T @ g @ t + penalty, t.T @ b)


class _Moments:
    """Sums of x x' and x y over any number of first rows; whole blocks of rows are summed once."""

    def __init__(self, x: np.ndarray, y: np.ndarray, block: int = 240):
        self.x, self.y, self.block = x, y, block
        k, p = len(x) // block, x.shape[1]
        blocks = x[: k * block].reshape(k, block, p)
        self.g = np.concatenate([np.zeros((1, p, p)), np.cumsum(np.einsum("kbi,kbj->kij", blocks, blocks), axis=0)])
        self.b = np.concatenate([np.zeros((1, p)), np.cumsum(np.einsum("kbi,kb->ki", blocks, y[: k * block].reshape(k, block)), axis=0)])

    def solve(self, n: int, lam: float) -> np.ndarray:
        k = n // self.block
        x, y = self.x[k * self.block : n], self.y[k * self.block : n]
        return _solve(self.g[k] + x.T @ x, self.b[k] + x.T @ y, n, lam)


def _shrunk_fit(m: _Moments, n: int, lam: float, shrunk: bool) -> tuple[float, np.ndarray]:
    """Shrink factor, chosen on the last fifth of more than 48 rows, and the weights on all n rows."""
    s = 1.0
    if shrunk and n > 48:
        head = n - min(n - 24, max(24, int(0.2 * n)))
        y, pred = m.y[head:n], m.x[head:n] @ m.solve(head, lam)
        s = min(SHRINK_GRID, key=lambda k: (round(float(np.mean(np.abs(y - k * pred))), 12), k))
    return s, m.solve(n, lam)


def _hourly_quantiles(residual: np.ndarray, hour: np.ndarray, levels: Sequence[float]) -> list[list[float]]:
    """For each level the quantile of the residuals of hours 0, 1, ..."""
    order = np.argsort(hour, kind="stable")
    bounds = np.searchsorted(hour[order], np.arange(int(hour.max()) + 2))
    parts = [residual[order[a:z]] for a, z in zip(bounds, bounds[1:])]
    return [[float(np.quantile(r, q)) if len(r) else None for r in parts] for q in levels]


def _windows(
    pdf: pd.DataFrame, tests: Callable[[int], Sequence[int]], lams: Sequence[float], shrunk: bool, mean: bool, levels: Sequence[float] | None,
    prior: np.ndarray | None = None, tau_days: float = 30.0
) -> pd.DataFrame:
    if "pooled" in pdf and not bool(pdf["pooled"].iloc[0]):
        prior = None
    pdf = pdf.sort_values(["day_idx", "hour"], kind="stable")
    x, y, day, hour = np.stack(pdf["x"].to_numpy()), pdf["target"].to_numpy(float), pdf["day_idx"].to_numpy(), pdf["hour"].to_numpy()
    ok = np.isfinite(y)
    x, y, day, hour = x[ok], y[ok], day[ok], hour[ok]
    out = []
    moments = _Moments(x, y)
    for d in tests(int(day.max()) + 1) if len(day) else ():
        n = int(np.searchsorted(day, d, "left"))
        if n < 1:
            continue
        fits = [(lam, *_shrunk_fit(moments, n, lam, shrunk)) for lam in lams]
        if mean and fits:
            fits = [(0.0, 1.0, np.mean([s * w for _, s, w in fits], axis=0))]
        if prior is not None:
            own = n / (n + 24 * tau_days)
            fits = [(lam, 1.0, own * s * w + (1 - own) * prior) for lam, s, w in fits]
        for lam, s, w in fits or [(0.0, 0.0, np.zeros(x.shape[1]))]:
            q = _hourly_quantiles(y[:n] - x[:n] @ (s * w), hour[:n], levels) if levels else (None, None)
            out.append((pdf["series_id"].iloc[0], int(d), float(lam), float(s), (s * w).tolist(), n, *q))
    return pd.DataFrame(out, columns=["series_id", "test_day", "lam", "shrink", "weights", "n_rows", "q_low", "q_high"])


def _fit(
    rows: DataFrame, tests: Callable[[int], Sequence[int]], lams: Sequence[float], shrunk: bool, mean: bool = False,
    levels: Sequence[float] | None = None, prior: Sequence[float] | None = None
) -> DataFrame:
    """prior: weights toward which those of series with few rows are drawn (all series, or those whose column pooled is true)."""
    toward = None if prior is None else np.asarray(prior, float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _windows(pdf, tests, lams, shrunk, mean, levels, toward)

    extra = ["pooled"] if prior is not None and "pooled" in rows.columns else []
    return rows.select("series_id", "day_idx", "hour", "x", "target", *extra).groupBy("series_id").applyInPandas(run, MODEL)


def fit_expanding(
    rows: DataFrame, n_test: int, lams: Sequence[float] = (10.0,), shrunk: bool = True, mean: bool = False,
    levels: Sequence[float] | None = None
) -> DataFrame:
    """rows(series_id, day_idx, hour, x, target) -> one model per series, lambda and each of the last n_test
    days and the next unknown one, fitted on the days before it; days with none before have none.

    mean: one model, the mean of the lambdas', which predicts their mean. Without any lambda weights are 0: the
    base alone. levels: two quantiles of the model's residuals on its own rows, by hour."""
    return _fit(rows, lambda new: range(new - n_test, new + 1), lams, shrunk, mean, levels)


def fit_once(
    rows: DataFrame, cal_days: int, first: int, lams: Sequence[float], shrunk: bool, levels: Sequence[float], prior: Sequence[float] | None = None
) -> DataFrame:
    """(series_id, cut, next, weights, q_low, q_high): one model a series, fitted on the days before cut, which is
    cal_days before the next unknown day, or that day itself where history is too short."""
    cut = lambda new: (new - cal_days if new - cal_days > first + 2 else new,)
    last = rows.where("target is not null").groupBy("series_id").agg((F.max("day_idx") + 1).cast("int").alias("next"))
    return _fit(rows, cut, lams, shrunk, True, levels, prior).withColumnRenamed("test_day", "cut").join(last, "series_id").select("series_id", "cut", "next", "weights", "q_low", "q_high")


SUMS = "series_id string, day_idx int, n long, g array<double>, b array<double>"


def running_moments(rows: DataFrame, size: int, stored: DataFrame | None = None) -> DataFrame:
    """rows(series_id, day_idx, x of `size` features, target) -> (series_id, day_idx, n, g, b): rows, x x' and x y of each day and all
    days before it, to be stored. With what is stored already, only days after it are read and only their rows come back,
    carried on from each series' last sums.

    Days are summed up in plain aggregates first; what is cumulated is one row a day."""
    x = rows.where("target is not null and not isnan(target)").select("series_id", "day_idx", "x", F.col("target").cast("double").alias("y"))
    if stored is not None:
        last = stored.groupBy("series_id").agg(F.max("day_idx").alias("day_idx"), *(F.max_by(c, "day_idx").alias(c) for c in ("n", "g", "b")))
        x = x.join(last.select("series_id", F.col("day_idx").alias("last")), "series_id", "left").where("last is null or day_idx > last").drop("last")
    at = lambda i: F.get("x", F.lit(i))
    g = F.array(*(F.sum(at(i) * at(j)) for i in range(size) for j in range(i + 1)))  # the lower half
    daily = x.groupBy("series_id", "day_idx").agg(F.count("*").alias("n"), g.alias("g"), F.array(*(F.sum(at(i) * F.col("y")) for i in range(size))).alias("b"))
    daily = daily.withColumn("old", F.lit(False))
    if stored is not None:
        daily = dealt_union(["series_id"], daily, last.join(daily.select("series_id").distinct(), "series_id", "left_semi").withColumn("old", F.lit(True)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day_idx")
        sums = {c: np.cumsum(np.stack(pdf[c].to_numpy()), axis=0) for c in ("g", "b")}
        out = pdf.assign(n=pdf["n"].cumsum(), g=list(sums["g"]), b=list(sums["b"]))
        return out.loc[~pdf["old"], ["series_id", "day_idx", "n", "g", "b"]]

    return daily.groupBy("series_id").applyInPandas(run, SUMS)


def fit_from_moments(moments: DataFrame, n_test: int, lam: float = 10.0, window: int | None = None) -> DataFrame:
    """fit_expanding() without shrinking, from stored running_moments(): one model per series for each of the last n_test days and the
    next unknown one. window: only that many days before, as the difference of two rows' sums."""
    end = F.max("day_idx").over(W.partitionBy("series_id")) + 1
    reach = n_test + 1 + (window or 0)
    recent = moments.withColumn("end", end).where(F.col("day_idx") >= F.col("end") - reach - HISTORY)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day_idx")
        day, p = pdf["day_idx"].to_numpy(), len(pdf["b"].iloc[0])
        lower, out, new = np.tril_indices(p), [], int(pdf["day_idx"].max()) + 1

        def upto(d: int) -> tuple[np.ndarray, np.ndarray, int]:
            """The sums of the days before d."""
            k = int(np.searchsorted(day, d)) - 1
            g = np.zeros((p, p))
            if k < 0:
                return g, np.zeros(p), 0
            g[lower] = pdf["g"].iloc[k]
            return g + np.tril(g, -1).T, np.asarray(pdf["b"].iloc[k], float), int(pdf["n"].iloc[k])

        for d in range(new - n_test, new + 1):
            g, b, n = upto(d)
            if window is not None:
                g0, b0, n0 = upto(d - window)
                g, b, n = g - g0, b - b0, n - n0
            if n:
                out.append((pdf["series_id"].iloc[0], d, lam, 1.0, _solve(g, b, n, lam).tolist(), n))
        return pd.DataFrame(out, columns=["series_id", "test_day", "lam", "shrink", "weights", "n_rows"])

    return recent.groupBy("series_id").applyInPandas(run, "series_id string, test_day int, lam double, shrink double, weights array<double>, n_rows long")


def fit_custom(rows: DataFrame, n_test: int, corrector: Callable[[], object], levels: Sequence[float] = (0.1, 0.9)) -> DataFrame:
    """Any corrector with fit(X, y) and predict(X): (series_id, day_idx, hour, correction, q_low, q_high) for each of the
    last n_test days and the next unknown one, a new one being fitted on the days before it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["day_idx", "hour"], kind="stable")
        x, y, day, hour = np.stack(pdf["x"].to_numpy()), pdf["target"].to_numpy(float), pdf["day_idx"].to_numpy(), pdf["hour"].to_numpy()
        ok = np.isfinite(y)
        new = int(day[ok].max()) + 1 if ok.any() else 0
        out = []
        for d in range(new - n_test, new + 1):
            past, own = ok & (day < d), day == d
            if not past.any() or not own.any():
                continue
            model = corrector()
            model.fit(x[past], y[past])
            q = np.array(_hourly_quantiles(y[past] - np.asarray(model.predict(x[past]), float), hour[past], levels), float)
            h = hour[own]
            out.append(pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "day_idx": d, "hour": h, "correction": np.asarray(model.predict(x[own]), float), "q_low": q[0][h], "q_high": q[1][h]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["series_id", "day_idx", "hour", "correction", "q_low", "q_high"])

    schema = "series_id string, day_idx int, hour int, correction double, q_low double, q_high double"
    return rows.select("series_id", "day_idx", "hour", "x", "target").groupBy("series_id").applyInPandas(run, schema)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def ensemble(models: DataFrame) -> DataFrame:
    """Mean prediction of several lambdas = prediction of the mean weights."""
    x = models.select("series_id", "test_day", "n_rows", F.posexplode("weights").alias("i", "w")).groupBy("series_id", "test_day", "i").agg(F.avg("w").alias("w"), F.first("n_rows").alias("n_rows"))
    x = x.groupBy("series_id", "test_day").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("s"), F.first("n_rows").alias("n_rows"))
    return x.select("series_id", "test_day", F.lit(0.0).alias("lam"), F.lit(1.0).alias("shrink"), F.col("s.w").alias("weights"), "n_rows")


def pooled(models: DataFrame, prior: DataFrame, tau_days: float = 28.0) -> DataFrame:
    """Weights alpha * own + (1 - alpha) * prior (one row: weights), alpha = n / (n + 24 tau)."""
    a = F.col("n_rows") / (F.col("n_rows") + 24 * tau_days)
    one = F.broadcast(prior.select(F.col("weights").alias("p")))  # one row
    return models.crossJoin(one).withColumn("weights", F.zip_with("weights", "p", lambda w, p: a * w + (1 - a) * p)).drop("p")


def pool_prior(models: DataFrame) -> DataFrame:
    """The mean of each coefficient over series (their latest model), as one row (weights)."""
    last = F.max("test_day").over(W.partitionBy("series_id"))
    x = models.withColumn("last", last).where("test_day = last").select(F.posexplode("weights").alias("i", "w"))
    x = x.groupBy("i").agg(F.avg("w").alias("w"))
    return x.agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("s")).select(F.col("s.w").alias("weights"))


def normalised(days: DataFrame) -> DataFrame:
    """Values over the series' mean; series without a positive mean go. For priors across series."""
    mean = F.avg("value").over(W.partitionBy("series_id"))
    return days.withColumn("m", mean).where("m > 0").withColumn("value", F.col("value") / F.col("m")).drop("m")


def predict(rows: DataFrame, models: DataFrame, base: str = "base") -> DataFrame:
    """base + x . weights of each row's own day (test_day = day_idx) as model."""
    m = models.select("series_id", F.col("test_day").alias("day_idx"), "weights")
    return rows.join(m, ["series_id", "day_idx"]).withColumn("model", F.col(base) + dot("x", "weights"))


def rolling_origin(
    days: DataFrame,
    n_test: int,
    names: Sequence[str] = tuple(feats.FEATURES),
    feature_fn: Callable[[DataFrame, DataFrame | None], DataFrame] = feats.features,
    lams: Sequence[float] = (10.0,),
    shrunk: bool = True,
    holidays: DataFrame | None = None,
    weather: Sequence[str] = (),
    corrector: Callable[[], object] | None = None,
    feedback: bool = False,
    calibrate: bool = False,
    window: int = 28,
    shrink: float = 0.5,
    first: int = feats.FIRST,
    rows: DataFrame | None = None,
) -> DataFrame:
    """Backtest rows: series_id, day_idx, hour, actual, persist, snaive, model, p10, p90 of the last n_test
    days, each predicted from the days before it: the holiday-aware base plus the model's correction, bands
    from its residuals by hour.

    feature_fn(days, holidays) is the extension point for features, corrector (a class with fit and predict) that
    for models; weather names columns of days that are forecasts for their day. feedback shifts a day
    by its part of yesterday's residual; calibrate adds p10_cal and p90_cal, scaled by the tails of the
    `window` days before, of which as many before the test days are forecast too (null where history
    is too short for them). rows: the features of days, if they are at hand (days, feature_fn and the like aren't read then)."""
    from . import calibration

    rows = with_vector(feature_fn(days, holidays), [*names, *weather]) if rows is None else rows
    tested = n_test + (window if calibrate else 0)
    if corrector is None:
        models = fit_expanding(rows, tested, lams, shrunk, True, (0.1, 0.9)).select("series_id", F.col("test_day").alias("day_idx"), "weights", "q_low", "q_high")
        x = rows.join(models, ["series_id", "day_idx"]).withColumn("correction", dot("x", "weights"))
        low, high = F.get("q_low", F.col("hour")), F.get("q_high", F.col("hour"))
    else:
        x = rows.join(fit_custom(rows, tested, corrector), ["series_id", "day_idx", "hour"])
        low, high = F.col("q_low"), F.col("q_high")
    model = F.col("base") + F.col("correction")
    out = x.where("value is not null").select(
        "series_id", "day_idx", "hour", F.col("value").alias("actual"), "persist", "snaive", model.alias("model"), (model + low).alias("p10"), (model + high).alias("p90")
    )
    if not feedback and not calibrate:
        return out
    new = F.max("day_idx").over(W.partitionBy("series_id")) + 1
    out = out.withColumn("new", new).withColumn("tested", F.col("day_idx") >= F.col("new") - n_test)
    as_rows = lambda x: x.select("series_id", F.col("day_idx").alias("day"), "hour", "actual", "p10", F.col("model").alias("p50"), "p90")
    if feedback:
        shift = calibration.residual_feedback(as_rows(out.where("tested")), window, shrink).select("series_id", F.col("day").alias("day_idx"), "hour", "delta")
        out = out.join(shift, ["series_id", "day_idx", "hour"], "left")
        out = out.withColumns({c: F.col(c) + F.coalesce("delta", F.lit(0.0)) for c in ("model", "p10", "p90")}).drop("delta")
    if calibrate:
        scales = calibration.rolling_tail_scales(as_rows(out), window, 0.1, shrink, min(14, max(7, window // 2)))
        out = out.join(scales.withColumnRenamed("day", "day_idx"), ["series_id", "day_idx"])
        enough = (F.col("new") - n_test - window > first) & F.lit(window >= 7)
        p50 = F.col("model")
        out = out.withColumn("p10_cal", F.when(enough, p50 - F.col("scale_low") * (p50 - F.col("p10")))).withColumn("p90_cal", F.when(enough, p50 + F.col("scale_high") * (F.col("p90") - p50)))
    extra = ["p10_cal", "p90_cal"] if calibrate else []
    return out.where("tested").select("series_id", "day_idx", "hour", "actual", "persist", "snaive", "model", "p10", "p90", *extra)


def append_days(days: DataFrame, k: int = 1, weather: DataFrame | None = None) -> DataFrame:
    """Adds k empty days after the last of each series (calendar day + 1, ...), with the columns that weather(local_date,
    hour, and series_id if it differs by series) has for them. A day has 24 steps, or as many as a column slots says."""
    extra = [c for c in days.columns if c not in ("series_id", "day_idx", "local_date", "hour", "value")]
    steps = feats.slots(days).cast("int")
    last = days.groupBy("series_id").agg(F.max("day_idx").alias("d"), F.max("local_date").alias("l"), F.max(steps).alias("slots"))
    new = last.select("series_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("i"), "d", "l", "slots").select(
        "series_id", (F.col("d") + F.col("i")).alias("day_idx"), F.expr("date_add(l, i)").alias("local_date"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("hour"), F.lit(None).cast("double").alias("value"), "slots"
    )
    if weather is not None:
        new = new.join(weather, [c for c in ("series_id", "local_date", "hour") if c in weather.columns], "left")
    return dealt_union(["series_id"], days, new.select("series_id", "day_idx", "local_date", "hour", "value", *(c for c in extra if c in new.columns)))


def _with_center(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    x = rows.join(fitted, "series_id")
    return x.select("*", (F.col("base") + dot("x", "weights")).alias("center"), F.get("q_low", F.col("hour")).alias("low"), F.get("q_high", F.col("hour")).alias("high"))


def _calibration_rows(centred: DataFrame) -> DataFrame:
    """The days from the fit's cut to the next unknown day, with the fit's bands."""
    x = centred.where("day_idx >= cut and day_idx < next and value is not null")
    return x.select(
        "series_id", F.col("day_idx").alias("day"), "hour", F.col("value").alias("actual"), (F.col("center") + F.col("low")).alias("p10"), F.col("center").alias("p50"), (F.col("center") + F.col("high")).alias("p90"), "next"
    )


def _at(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.bround(c, digits)


def next_day(
    days: DataFrame,
    names: Sequence[str] = tuple(feats.FEATURES),
    feature_fn=feats.features,
    cal_days: int = 28,
    alpha: float = 0.2,
    lams: Sequence[float] = (10.0,),
    digits: int | None = 1,
    holidays: DataFrame | None = None,
    weather: Sequence[str] = (),
    next_weather: DataFrame | None = None,
    calibrate: bool = False,
    feedback: bool = False,
    window: int = 28,
    shrink: float = 0.5,
    last_residual: DataFrame | None = None,
    first: int = feats.FIRST,
    rows: DataFrame | None = None,
    prior: Sequence[float] | None = None,
) -> DataFrame:
    """The day after the last: (series_id, local_date, hour, p10, p50, p90). One model, fitted on the days before the
    last cal_days, gives the median, the bands (its residuals' quantiles by hour) and their conformal
    widening, measured on those cal_days.

    weather names columns of days, next_weather has them for the new day. calibrate scales the band
    by the factor whose coverage of the cal_days was nearest (column scale). feedback shifts
    it by a part rho of yesterday's residual (column rho): that of last_residual(series_id, hour,
    residual) if given, else that of the fit. rows: the features of days and of the day after, if they are at hand.
    prior: see _fit()."""
    from . import calibration

    if rows is None:
        rows = with_vector(feature_fn(append_days(days, 1, next_weather), holidays), [*names, *weather])
    centred = _with_center(rows, fit_once(rows, cal_days, first, lams, True, (alpha / 2, 1 - alpha / 2), prior))
    past = _calibration_rows(centred)
    offsets = calibration.cqr_interp(past, ["series_id"], alpha).select("series_id", "offset")
    x = centred.where("day_idx = next").join(offsets, "series_id", "left").withColumn("c", F.coalesce("offset", F.lit(0.0)))
    x = x.select("series_id", "day_idx", "local_date", "hour", F.col("center").alias("p50"), "low", "high", "c")
    if feedback:
        least = min(14, max(7, window // 2))
        known = past.groupBy("series_id").agg(F.count_distinct("day").alias("known"))
        x = x.join(calibration.next_feedback(past, window, shrink, least), ["series_id", "hour"], "left").join(known, "series_id", "left")
        residual = F.col("residual")
        if last_residual is not None:
            x = x.join(last_residual.select("series_id", "hour", F.col("residual").alias("stored")), ["series_id", "hour"], "left")
            residual = F.coalesce("stored", residual)
        on = F.coalesce(F.col("known") >= least + 1, F.lit(False)) & residual.isNotNull()  # rho 0 says that nothing was added
        x = x.withColumn("p50", F.col("p50") + F.when(on, F.col("rho") * residual).otherwise(0.0)).withColumn("rho", F.when(on, F.col("rho")).otherwise(0.0))
    p50 = F.col("p50")
    x = x.withColumns({"p10": p50 + F.col("low") - F.col("c"), "p90": p50 + F.col("high") + F.col("c")})
    if calibrate:
        moved = past.join(offsets, "series_id").withColumns({"p10": F.col("p10") - F.col("offset"), "p90": F.col("p90") + F.col("offset")}).drop("offset")
        x = x.join(calibration.next_scale(moved, cal_days, 1 - alpha, shrink, 1), "series_id", "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
        x = x.withColumns({c: p50 + F.col("scale") * (F.col(c) - p50) for c in ("p10", "p90")})
    low, high = F.least(p50, F.col("p10")), F.greatest(p50, F.col("p90"))
    extra = [c for c, asked in (("scale", calibrate), ("rho", feedback)) if asked]
    return x.select("series_id", "local_date", "hour", *(_at(c, digits).alias(n) for c, n in ((low, "p10"), (p50, "p50"), (high, "p90"))), *extra)


def _recurse(days: DataFrame, weights: DataFrame, horizon: int, names: Sequence[str], feature_fn, holidays: DataFrame | None, weather: DataFrame | None) -> DataFrame:
    """(series_id, k, day_idx, local_date, hour, center) for k = 1 to horizon: the base and fixed weights of each series,
    each day's centre being the value of a pseudo-day that only feeds the next day's features. A loop of at most 7
    steps, each written, over the days that features can look back to."""
    from .relations import _cut

    recent = F.max("day_idx").over(W.partitionBy("series_id")) - HISTORY
    known, out = days.withColumn("from", recent).where(F.col("day_idx") > F.col("from")).drop("from"), None
    for k in range(1, horizon + 1):
        rows = with_vector(feature_fn(append_days(known, 1, weather), holidays).where("value is null"), names).join(weights, "series_id")
        step = _cut(rows.select("series_id", F.lit(k).alias("k"), "day_idx", "local_date", "hour", (F.col("base") + dot("x", "weights")).alias("center"), *(c for c in known.columns if c not in ("series_id", "day_idx", "local_date", "hour", "value"))))
        out = step if out is None else out.unionByName(step)
        known = dealt_union(["series_id"], known, step.drop("k").withColumnRenamed("center", "value"))
    return out.select("series_id", "k", "day_idx", "local_date", "hour", "center")


def several_days(
    days: DataFrame,
    horizon: int,
    names: Sequence[str] = tuple(feats.FEATURES),
    feature_fn=feats.features,
    cal_days: int = 28,
    alpha: float = 0.2,
    lams: Sequence[float] = (10.0,),
    digits: int | None = 1,
    holidays: DataFrame | None = None,
    weather: Sequence[str] = (),
    next_weather: DataFrame | None = None,
    bands: str = "k1",
    first: int = feats.FIRST,
) -> DataFrame:
    """Up to 7 days ahead with one fit on real days: (series_id, horizon, day_idx, local_date, hour, p10, p50, p90, scale). Each
    day's median is a pseudo-day that feeds only the next day's features, never a fit.

    bands "k1": the first day is next_day()'s, later days have only a median. "per_horizon": later
    days take the first day's shape, wider by `scale`, the ratio (at least 1) of the widths of k-day
    and one-day residuals of forecasts issued on each of the cal_days, and moved out by their conformal offset."""
    from . import calibration
    from .relations import _cut

    if not 1 <= horizon <= 7:
        raise ValueError("horizon is 1 to 7 days")
    if bands not in ("k1", "per_horizon"):
        raise ValueError("bands is k1 or per_horizon")
    names, columns = [*names, *weather], ["series_id", "day_idx", "local_date", "hour", "value", *weather]
    days = days.select(*columns)
    rows = with_vector(feature_fn(days, holidays), names)
    fitted = _cut(fit_once(rows, cal_days, first, lams, True, (alpha / 2, 1 - alpha / 2)))
    weights = fitted.select("series_id", "weights")
    ahead = _recurse(days, weights, horizon, names, feature_fn, holidays, next_weather)
    past = _calibration_rows(_with_center(rows, fitted))
    offsets = calibration.cqr_interp(past, ["series_id"], alpha).select("series_id", F.lit(1).alias("k"), F.lit(1.0).alias("scale"), "offset")
    if bands == "per_horizon" and horizon > 1:
        span = fitted.select(F.col("series_id").alias("origin"), "cut", "next", "weights", "q_low", "q_high").where(F.col("next") - F.col("cut") >= 2)
        issued = days.withColumnRenamed("series_id", "origin").join(span.select("origin", "cut", "next"), "origin")
        issued = issued.withColumn("issue", F.explode(F.sequence("cut", F.col("next") - 2))).where((F.col("day_idx") <= F.col("issue")) & (F.col("day_idx") > F.col("issue") - HISTORY))
        issued = _cut(issued.withColumn("series_id", F.concat_ws("@", "origin", "issue")))
        names_of = issued.select("series_id", "origin").distinct()
        known_weather = days.select(F.col("series_id").alias("origin"), "local_date", "hour", *weather).join(names_of, "origin").drop("origin") if weather else None
        measured = _recurse(issued.select(*columns), names_of.join(span, "origin").select("series_id", "weights"), horizon, names, feature_fn, holidays, known_weather)
        truth = days.select(F.col("series_id").alias("origin"), "day_idx", "hour", F.col("value").alias("actual"))
        r = measured.join(names_of, "series_id").join(truth, ["origin", "day_idx", "hour"]).select("origin", "k", "hour", (F.col("actual") - F.col("center")).alias("r"))
        r = _cut(r.where("r is not null"))
        width = F.percentile("r", 1 - alpha / 2) - F.percentile("r", alpha / 2)
        widths = r.groupBy("origin", "k").agg(width.alias("width"))
        one = widths.where("k = 1").select("origin", F.when(F.col("width") > 1e-12, F.col("width")).otherwise(1.0).alias("one"))
        scales = widths.where("k > 1").join(one, "origin").select("origin", "k", F.greatest(F.lit(1.0), F.col("width") / F.col("one")).alias("scale"))
        x = r.join(scales, ["origin", "k"]).join(span.select("origin", "q_low", "q_high"), "origin")
        miss = F.greatest(F.col("scale") * F.get("q_low", F.col("hour")) - F.col("r"), F.col("r") - F.col("scale") * F.get("q_high", F.col("hour")))
        later = calibration.conformal_offset(x.withColumn("score", miss), ["origin", "k"], "score", alpha).join(scales, ["origin", "k"])
        offsets = dealt_union(["series_id", "k"], offsets, later.select(F.col("origin").alias("series_id"), "k", "scale", "offset"))
    x = ahead.join(fitted.select("series_id", "q_low", "q_high"), "series_id").join(offsets, ["series_id", "k"], "left")
    scale, offset, p50 = F.coalesce("scale", F.lit(1.0)), F.coalesce("offset", F.lit(0.0)), F.col("center")
    banded = F.lit(bands == "per_horizon") | (F.col("k") == 1)
    low = F.when(banded, F.least(p50, p50 + scale * F.get("q_low", F.col("hour")) - offset))
    high = F.when(banded, F.greatest(p50, p50 + scale * F.get("q_high", F.col("hour")) + offset))
    return x.select(
        "series_id", F.col("k").alias("horizon"), "day_idx", "local_date", "hour",
        *(_at(c, digits).alias(n) for c, n in ((low, "p10"), (p50, "p50"), (high, "p90"))), scale.alias("scale")
    )


def horizon_scores(days: DataFrame, horizon: int, n_test: int, **options) -> DataFrame:
    """Errors by days ahead: the series is cut at each of n_test issue days and forecast; one row per
    series and days ahead: n, mae, mape, skill against the value a week before the target day, and
    coverage, width and scale of the bands where there are any. Issue days become series of their own, so all are
    fitted in one plan."""
    last = days.groupBy("series_id").agg(F.max("day_idx").alias("last"))
    x = days.withColumnRenamed("series_id", "origin").join(last.withColumnRenamed("series_id", "origin"), "origin")
    x = x.withColumn("issue", F.explode(F.sequence(F.col("last") - horizon - n_test + 1, F.col("last") - horizon))).where("day_idx <= issue")
    x = x.withColumn("series_id", F.concat_ws("#", "origin", "issue"))
    names_of = x.select("series_id", "origin").distinct()
    f = several_days(x.drop("origin", "issue", "last"), horizon, **options).join(names_of, "series_id")
    truth = days.select(F.col("series_id").alias("origin"), "day_idx", "hour", F.col("value").alias("actual"))
    week = days.select(F.col("series_id").alias("origin"), (F.col("day_idx") + 7).alias("day_idx"), "hour", F.col("value").alias("lag7"))
    r = f.join(truth, ["origin", "day_idx", "hour"]).join(week, ["origin", "day_idx", "hour"], "left")
    e, a = F.abs(F.col("p50") - F.col("actual")), F.abs("actual")
    return r.groupBy(F.col("origin").alias("series_id"), "horizon").agg(
        F.count("*").alias("n"), F.avg(e).alias("mae"), (100 * F.avg(F.when(a >= 1e-9, e / a))).alias("mape"),
        (100 * (1 - F.try_divide(F.avg(e), F.avg(F.abs(F.col("lag7") - F.col("actual")))))).alias("skill"),
        F.avg(F.col("actual").between(F.col("p10"), F.col("p90")).cast("double")).alias("coverage"), F.avg(F.col("p90") - F.col("p10")).alias("width"), F.avg("scale").alias("scale"),
    )


def quantile_weights(x: np.ndarray, y: np.ndarray, level: float, rounds: int = 40, lam: float = 1e-3) -> np.ndarray:
    """Weights of a linear quantile model by iterated reweighted least squares."""
    w = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(rounds):
        r = y - x @ w
        k = np.where(r >= 0, level, 1 - level) / np.maximum(np.abs(r), 1e-6)
        w = np.linalg.solve(x.T @ (x * k[:, None]) + lam * np.eye(x.shape[1]), x.T @ (k * y))
    return w


def quantile_regression(rows: DataFrame, level: float) -> DataFrame:
    """Linear quantile model per series: (series_id, weights). Boosted trees are in boosting.py."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["day_idx", "hour"])
        x, y = np.stack(pdf["x"].to_numpy()), pdf["target"].to_numpy(float)
        ok = np.isfinite(y)
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "weights": [quantile_weights(x[ok], y[ok], level).tolist()]})

    return rows.select("series_id", "day_idx", "hour", "x", "target").groupBy("series_id").applyInPandas(run, "series_id string, weights array<double>")


def quantile_forecast(rows: DataFrame, levels: Sequence[float] = (0.1, 0.5, 0.9), train_until: int | None = None) -> DataFrame:
    """Rows with the quantile models' predictions, crossing quantiles sorted, as p10, p50, p90."""
    fit = rows if train_until is None else rows.where(F.col("day_idx") < train_until)
    x = rows
    for i, level in enumerate(levels):
        x = x.join(quantile_regression(fit, level).withColumnRenamed("weights", f"w{i}"), "series_id")
    values = F.array_sort(F.array(*(F.col("base") + dot("x", f"w{i}") for i in range(len(levels)))))
    x = x.withColumn("q", values).drop(*(f"w{i}" for i in range(len(levels))))
    return x.select("*", *(F.col("q")[i].alias(f"p{round(100 * v):02d}") for i, v in enumerate(levels))).drop("q")

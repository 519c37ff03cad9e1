"""Forecasts and backtests against plain loops over days, with holidays, weather, feedback and calibration."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadweave.operators import backtests, features, models
from loadweave.operators.calibration import residual_feedback, rolling_scale, rolling_tail_scales

N, START = 46, date(2024, 3, 4)
HOLIDAYS = {date(2024, 3, 29), date(2024, 4, 1)}
RNG = np.random.default_rng(3)
DATES = [START + timedelta(k) for k in range(N + 8)]
TEMP = RNG.normal(10, 4, (N + 8, 24))
LOAD = 60 + 15 * np.sin(np.arange(24) / 4)[None, :] + np.array([10 * (d.weekday() < 5) - 12 * (d in HOLIDAYS) for d in DATES[:N]])[:, None] - 0.8 * TEMP[:N] + RNG.normal(0, 3, (N, 24))


def table(spark, n=N, weather=True):
    rows = [("s", k, DATES[k], h, float(LOAD[k, h]), float(TEMP[k, h])) for k in range(n) for h in range(24)]
    df = spark.createDataFrame(rows, "series_id string, day_idx int, local_date date, hour int, value double, temp double")
    return df if weather else df.drop("temp")


def calendar(spark):
    return spark.createDataFrame([(d,) for d in HOLIDAYS], "holiday date")


def base(load, d):
    back = range(d - 7, -1, -7)
    return load[next((k for k in back if DATES[k] not in HOLIDAYS), back[-1])]


def matrix(load, d, temp):
    h, dow = np.arange(24), DATES[d].weekday()
    gap = load[d - 1] - load[d - 8]
    x = [np.ones(24), gap, np.full(24, gap.mean()), np.full(24, gap.mean()), load[d - 1] - load[d - 7]]
    x += [f(2 * np.pi * k * h / 24) for k in (1, 2) for f in (np.sin, np.cos)] + [np.full(24, f(2 * np.pi * dow / 7)) for f in (np.sin, np.cos)]
    x += [np.full(24, float(dow >= 5)), np.full(24, float(DATES[d] in HOLIDAYS))] + ([TEMP[d]] if temp else [])
    return np.stack(x, 1)


def ridge(x, y, lam=10.0):
    mu, sd = x.mean(0), x.std(0)
    mu[0], sd[0] = 0.0, 1.0
    sd[sd < 1e-9] = 1.0
    z = (x - mu) / sd
    penalty = lam * np.eye(x.shape[1])
    penalty[0, 0] = 0
    w = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    return lambda q: ((q - mu) / sd) @ w


def shrunk(x, y):
    n, s = len(x), 1.0
    if n > 48:
        tail = min(n - 24, max(24, int(0.2 * n)))
        p = ridge(x[:-tail], y[:-tail])(x[-tail:])
        s = min((0.0, 0.25, 0.5, 0.75, 1.0), key=lambda k: np.abs(y[-tail:] - k * p).mean())
    f = ridge(x, y)
    return lambda q: s * f(q)


def fit(load, until, temp=False, first=8):
    x = np.vstack([matrix(load, d, temp) for d in range(first, until)])
    y = np.concatenate([load[d] - base(load, d) for d in range(first, until)])
    f = shrunk(x, y)
    r = (y - f(x)).reshape(-1, 24)
    return f, np.quantile(r, 0.1, 0), np.quantile(r, 0.9, 0)


def grid_of(df, column, key="day_idx"):
    rows = sorted((r[key], r["hour"], r[column]) for r in df.collect())
    return np.array([v for _, _, v in rows], float).reshape(-1, 24)


@pytest.mark.parametrize("temp", [False, True])
def test_rolling_origin(spark, temp):
    got = models.rolling_origin(table(spark), 6, holidays=calendar(spark), weather=["temp"] if temp else [])
    want = {"model": [], "p10": [], "p90": []}
    for d in range(N - 6, N):
        f, lo, hi = fit(LOAD, d, temp)
        center = base(LOAD, d) + f(matrix(LOAD, d, temp))
        for k, v in (("model", center), ("p10", center + lo), ("p90", center + hi)):
            want[k].append(v)
    got = got.cache()
    for k, v in want.items():
        assert np.allclose(grid_of(got, k), v, atol=1e-6), k
    assert np.allclose(grid_of(got, "snaive"), LOAD[N - 13 : N - 7]) and np.allclose(grid_of(got, "persist"), LOAD[N - 7 : N - 1])


def test_short_windows_have_a_model(spark):
    got = models.rolling_origin(table(spark, 12, False), 3)
    f, *_ = fit(LOAD, 9)  # one day: 24 rows, no tail to choose a shrink factor on
    assert np.allclose(grid_of(got, "model")[0], base(LOAD, 9) + f(matrix(LOAD, 9, False)), atol=1e-6) and got.count() == 72


def test_own_corrector(spark):
    class Mean:
        def fit(self, x, y):
            self.value = y.mean()

        def predict(self, x):
            return np.full(len(x), self.value)

    got = models.rolling_origin(table(spark, weather=False), 2, corrector=Mean).cache()
    y = np.array([LOAD[d] - LOAD[d - 7] for d in range(8, N - 2)])
    assert np.allclose(grid_of(got, "model")[0], LOAD[N - 9] + y.mean(), atol=1e-6)
    assert np.allclose(grid_of(got, "p10")[0], LOAD[N - 9] + np.quantile(y, 0.1, 0), atol=1e-6)


def brute_feedback(p50, actual, window, least, shrink=0.5):
    rho, delta = np.zeros(len(p50)), np.zeros_like(p50)
    res = actual - p50
    for d in range(1, len(p50)):
        low = max(0, d - window)
        if d - low >= least:
            rho[d] = shrink * min(np.linspace(0, 0.8, 17), key=lambda r: np.round(np.mean([np.abs(res[j] - r * res[j - 1]) for j in range(max(1, low), d)]), 9))
        delta[d] = rho[d] * res[d - 1]
    return rho, delta


def nearest_scale(share, target, shrink=0.5):
    s = min(np.linspace(0.3, 3, 136), key=lambda k: (round(abs(share(k) - target), 12), k))
    return 1 + shrink * (s - 1)


def band_rows(spark, actual, p10, p50, p90):
    rows = [("s", k, h, *(float(x[k, h]) for x in (actual, p10, p50, p90))) for k in range(len(actual)) for h in range(24)]
    return spark.createDataFrame(rows, "series_id string, day int, hour int, actual double, p10 double, p50 double, p90 double")


def test_windows_of_calibration(spark):
    rng = np.random.default_rng(1)
    p50 = rng.normal(50, 5, (20, 24))
    actual, p10, p90 = p50 + np.cumsum(rng.normal(0, 2, (20, 24)), 0) * 0.5, p50 - rng.random((20, 24)) * 4, p50 + rng.random((20, 24)) * 6
    df = band_rows(spark, actual, p10, p50, p90)
    scale = {r["day"]: r["scale"] for r in rolling_scale(df, 8, least=5).collect()}
    tails = {r["day"]: (r["scale_low"], r["scale_high"]) for r in rolling_tail_scales(df, 8, least=5).collect()}
    for d in range(20):
        w = slice(max(0, d - 8), d)
        a, lo, m, hi = (x[w] for x in (actual, p10, p50, p90))
        if d < 5:
            assert scale[d] == 1 and tails[d] == (1, 1)
            continue
        assert scale[d] == pytest.approx(nearest_scale(lambda s: ((a >= m - s * (m - lo)) & (a <= m + s * (hi - m))).mean(), 0.8))
        assert tails[d] == pytest.approx((nearest_scale(lambda s: (a < m - s * (m - lo)).mean(), 0.1), nearest_scale(lambda s: (a > m + s * (hi - m)).mean(), 0.1)))
    rho, delta = brute_feedback(p50, actual, 8, 5)
    got = residual_feedback(df, 8, least=5).cache()
    assert np.allclose(grid_of(got, "rho", "day")[:, 0], rho) and np.allclose(grid_of(got, "delta", "day"), delta)


def test_backtest_with_feedback_and_calibration(spark):
    days, hol = table(spark, weather=False), calendar(spark)
    plain = models.rolling_origin(days, 17, holidays=hol).cache()
    got = models.rolling_origin(days, 10, holidays=hol, feedback=True, calibrate=True, window=7).cache()
    a, m, lo, hi = (grid_of(plain, c) for c in ("actual", "model", "p10", "p90"))
    _, delta = brute_feedback(m[7:], a[7:], 7, 14)
    for x in (m, lo, hi):
        x[7:] += delta
    assert np.allclose(grid_of(got, "model"), m[7:], atol=1e-6)
    for k in range(7, 17):
        w = slice(k - 7, k)
        s = nearest_scale(lambda s: (a[w] < m[w] - s * (m[w] - lo[w])).mean(), 0.1)
        assert np.allclose(grid_of(got, "p10_cal")[k - 7], m[k] - s * (m[k] - lo[k]), atol=1e-6)
    assert models.rolling_origin(days, 34, calibrate=True, window=7).where("p10_cal is not null").count() == 0


def conformal(scores, alpha=0.2):
    s = np.ravel(scores)
    return float(np.quantile(s, min(1.0, (1 - alpha) * (1 + 1 / len(s))))) if len(s) else 0.0


def issue(load, cal, temp=False):
    """Fit, hourly quantiles, conformal offset and the rows of the calibration days."""
    cut = len(load) - cal if len(load) - cal > 10 else len(load)
    f, lo, hi = fit(load, cut, temp)
    center = np.array([base(load, d) + f(matrix(load, d, temp)) for d in range(cut, len(load))]).reshape(-1, 24)
    actual = load[cut:]
    return f, lo, hi, conformal(np.maximum(center + lo - actual, actual - center - hi)), center, actual, cut


def test_next_day(spark):
    weather = spark.createDataFrame([(DATES[N], h, float(TEMP[N, h])) for h in range(24)], "local_date date, hour int, temp double")
    got = models.next_day(table(spark), cal_days=9, digits=None, holidays=calendar(spark), weather=["temp"], next_weather=weather).cache()
    f, lo, hi, c, *_ = issue(LOAD, 9, True)
    p50 = base(LOAD, N) + f(matrix(np.vstack([LOAD, LOAD[:1]]), N, True))
    assert {r["local_date"] for r in got.collect()} == {DATES[N]}
    for k, v in (("p50", p50), ("p10", np.minimum(p50, p50 + lo - c)), ("p90", np.maximum(p50, p50 + hi + c))):
        assert np.allclose([r[k] for r in got.orderBy("hour").collect()], v, atol=1e-6), k


@pytest.mark.parametrize("stored", [False, True])
def test_next_day_with_feedback_and_scale(spark, stored):
    last = spark.createDataFrame([("s", h, 2.0 + h) for h in range(24)], "series_id string, hour int, residual double") if stored else None
    got = models.next_day(table(spark, weather=False), cal_days=16, digits=None, calibrate=True, feedback=True, window=14, last_residual=last).orderBy("hour").collect()
    real, HOLIDAYS_WERE = dict.fromkeys(HOLIDAYS), set(HOLIDAYS)
    HOLIDAYS.clear()
    try:
        f, lo, hi, c, center, actual, _ = issue(LOAD, 16)
        p50 = base(LOAD, N) + f(matrix(np.vstack([LOAD, LOAD[:1]]), N, False))
    finally:
        HOLIDAYS.update(HOLIDAYS_WERE)
    rho, _ = brute_feedback(np.vstack([center, center[:1]]), np.vstack([actual, actual[:1]]), 14, 7)
    p50 = p50 + rho[-1] * (np.arange(24) + 2.0 if stored else actual[-1] - center[-1])
    s = nearest_scale(lambda k: ((actual >= center - k * (c - lo)) & (actual <= center + k * (hi + c))).mean(), 0.8)
    assert [r["rho"] for r in got] == pytest.approx([rho[-1]] * 24) and got[0]["scale"] == pytest.approx(s)
    assert np.allclose([r["p50"] for r in got], p50, atol=1e-6)
    assert np.allclose([r["p10"] for r in got], np.minimum(p50, p50 + s * (lo - c)), atol=1e-6) and real


def ahead(load, f, horizon):
    out, known = [], load
    for _ in range(horizon):
        d = len(known)
        y = base(known, d) + f(matrix(np.vstack([known, known[:1]]), d, False))
        out.append(y)
        known = np.vstack([known, y[None]])
    return np.array(out)


def test_several_days_fit_real_days_only(spark):
    got = models.several_days(table(spark, weather=False), 3, cal_days=8, digits=None, holidays=calendar(spark), bands="per_horizon").cache()
    f, lo, hi, c, _, _, cut = issue(LOAD, 8)
    want = ahead(LOAD, f, 3)
    assert np.allclose(grid_of(got, "p50", "horizon"), want, atol=1e-6)
    residual = {k: [] for k in (1, 2, 3)}
    for j in range(cut, N - 1):
        y = ahead(LOAD[: j + 1], f, min(3, N - 1 - j))
        for k in range(len(y)):
            residual[k + 1].append(LOAD[j + 1 + k] - y[k])
    width = {k: np.subtract(*np.quantile(np.ravel(r), (0.9, 0.1))) for k, r in residual.items()}
    for k in (1, 2, 3):
        s, off = 1.0, c
        if k > 1:
            s = max(1.0, width[k] / width[1])
            off = conformal(np.maximum(s * lo - np.array(residual[k]), np.array(residual[k]) - s * hi))
        p = want[k - 1]
        assert np.allclose(grid_of(got, "scale", "horizon")[k - 1], s)
        assert np.allclose(grid_of(got, "p10", "horizon")[k - 1], np.minimum(p, p + s * lo - off), atol=1e-6)
    one = models.next_day(table(spark, weather=False), cal_days=8, digits=None, holidays=calendar(spark)).orderBy("hour").collect()
    assert np.allclose([r["p90"] for r in one], grid_of(got, "p90", "horizon")[0])
    plain = models.several_days(table(spark, weather=False), 2, cal_days=8)
    assert plain.where("horizon = 2 and p10 is not null").count() == 0 and plain.where("horizon = 1 and p10 is not null").count() == 24


@pytest.mark.parametrize("kind,per_hour", [("cqr", False), ("cqr", True), ("residual", False)])
def test_rolling_conformal(spark, kind, per_hour):
    got = backtests.rolling_conformal(table(spark, weather=False), 4, kind, cal_days=9, per_hour=per_hour, holidays=calendar(spark)).cache()
    pool, want = [], []
    for d in range(N - 4, N):
        f, lo, hi = fit(LOAD, d - 9)
        center = {t: base(LOAD, t) + f(matrix(LOAD, t, False)) for t in range(d - 9, d + 1)}
        score = lambda t: np.maximum(center[t] + lo - LOAD[t], LOAD[t] - center[t] - hi) if kind == "cqr" else LOAD[t] - center[t]  # noqa: B023, E731
        s = np.array([*(score(t) for t in range(d - 9, d)), *pool])
        if kind == "cqr":
            c = np.array([conformal(s[:, h]) for h in range(24)]) if per_hour else conformal(s)
            want.append((center[d] + lo - c, center[d] + hi + c))
        else:
            want.append((center[d] + np.quantile(s, 0.1), center[d] + np.quantile(s, 0.9)))
        pool.append(score(d))
    assert np.allclose(grid_of(got, "p10"), [w[0] for w in want], atol=1e-6) and np.allclose(grid_of(got, "p90"), [w[1] for w in want], atol=1e-6)


def quantile_models(until, levels):
    x = np.vstack([matrix(LOAD, d, False) for d in range(8, until)])
    y = np.concatenate([LOAD[d] - base(LOAD, d) for d in range(8, until)])
    w = [models.quantile_weights(x, y, q) for q in levels]
    return lambda d: np.sort([base(LOAD, d) + matrix(LOAD, d, False) @ v for v in w], 0)


def test_rolling_quantile(spark):
    got = backtests.rolling_quantile(table(spark, weather=False), 5, every=2, tail=6, holidays=calendar(spark)).cache()
    want = []
    for d in range(N - 5, N):
        refit = N - 5 + (d - N + 5) // 2 * 2
        f = quantile_models(refit - 6, (0.1, 0.5, 0.9))
        miss = np.ravel([np.maximum.reduce([f(t)[0] - LOAD[t], LOAD[t] - f(t)[2], np.zeros(24)]) for t in range(refit - 6, refit)])
        c = np.quantile(miss, 0.8, method="higher")
        q = f(d)
        want.append((q[0] - c, q[1], q[2] + c))
    for k, c in enumerate(("p10", "model", "p90")):
        assert np.allclose(grid_of(got, c), [w[k] for w in want], atol=1e-5), c


@pytest.mark.parametrize("per_hour", [False, True])
def test_rolling_cqr(spark, per_hour):
    got = backtests.rolling_cqr(table(spark, weather=False), 5, every=3, window=10, eta=0.3, per_hour=per_hour, holidays=calendar(spark)).cache()
    aim, want = 0.8, []
    for d in range(N - 5, N):
        f = quantile_models(N - 5 + (d - N + 5) // 3 * 3 - 10, (0.1, 0.5, 0.9))
        s = np.array([np.maximum(f(t)[0] - LOAD[t], LOAD[t] - f(t)[2]) for t in range(d - 10, d)])
        rank = lambda v: max(0.0, np.sort(v)[min(max(int(np.ceil((len(v) + 1) * aim)), 1), len(v)) - 1])  # noqa: B023, E731
        c = np.array([rank(s[:, h]) for h in range(24)]) if per_hour else rank(s.ravel())
        q = f(d)
        want.append((q[0] - c, q[2] + c))
        hit = ((LOAD[d] >= q[0] - c) & (LOAD[d] <= q[2] + c)).mean()
        aim = float(np.clip(aim + 0.3 * (0.8 - hit), 0.8, 0.995))
    assert np.allclose(grid_of(got, "p10"), [w[0] for w in want], atol=1e-5) and np.allclose(grid_of(got, "p90"), [w[1] for w in want], atol=1e-5)


def test_targeted_conformal_takes_the_first_alpha_that_covers(spark):
    days = table(spark, weather=False)
    got = backtests.targeted_conformal(days, 4, 0.9, cal_days=7)
    alpha = {r["alpha"] for r in got.select("alpha").distinct().collect()}
    for a in (0.1 * f for f in (1.0, 0.7, 0.5, 0.35, 0.25)):
        b = backtests.rolling_conformal(days.where(F.col("day_idx") < N - 4), 7, "cqr", a, 7)
        if b.agg(F.avg(F.col("actual").between(F.col("p10"), F.col("p90")).cast("double"))).first()[0] >= 0.9:
            break
    assert list(alpha) == [pytest.approx(a)] and got.count() == 96


def test_horizon_scores_use_positions(spark):
    got = models.horizon_scores(table(spark, weather=False), 2, 2, cal_days=7, holidays=calendar(spark)).orderBy("horizon").collect()
    miss, week = {1: [], 2: []}, {1: [], 2: []}
    for last in (N - 4, N - 3):
        f, *_ = issue(LOAD[: last + 1], 7)
        y = ahead(LOAD[: last + 1], f, 2)
        for k in (1, 2):
            miss[k].append(np.abs(np.round(y[k - 1], 1) - LOAD[last + k]))
            week[k].append(np.abs(LOAD[last + k - 7] - LOAD[last + k]))
    for r in got:
        k = r["horizon"]
        assert r["n"] == 48 and r["mae"] == pytest.approx(np.mean(miss[k]), abs=1e-3) and r["skill"] == pytest.approx(100 * (1 - np.mean(miss[k]) / np.mean(week[k])), abs=1e-2)


def test_unknown_options(spark):
    days = table(spark, weather=False)
    with pytest.raises(ValueError):
        models.several_days(days, 8)
    with pytest.raises(ValueError):
        models.several_days(days, 2, bands="all")
    with pytest.raises(ValueError):
        backtests.rolling_conformal(days, 2, "none")
    assert features.extended_features(days).where("day_idx < 9").count() == 0

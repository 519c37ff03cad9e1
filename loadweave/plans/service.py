"""End-to-end plans: everything one request asks for, for any number of series, as named DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bootstrap, calibration, control, evaluations, features, integrity, ledger, metrics, models, relations, resample, risk, studies


SHORT_DAYS = 60  # a pool prior counts for series with fewer days
KINDS = ("load", "generation", "residual")


def _keyed(kind: str, x: DataFrame) -> DataFrame:
    return x.select(F.concat_ws("@", F.lit(kind), "series_id").alias("series_id"), "ts", "value")


def _of(kind: str, x: DataFrame) -> DataFrame:
    """The rows of one quantity, under their series' own names."""
    return x.where(F.col("series_id").startswith(f"{kind}@")).withColumn("series_id", F.substr("series_id", F.lit(len(kind) + 2)))


def run_forecast(
    series: DataFrame,
    zone: str = "Europe/Berlin",
    threshold: float | None = None,
    devices: DataFrame | None = None,
    rating_kw: float | None = None,
    horizon: int = 1,
    n_test: int = 14,
    cal_days: int = 28,
    holidays: DataFrame | None = None,
    weather: DataFrame | None = None,
    calibrate: bool = False,
    feedback: bool = False,
    bands: str = "k1",
    prices: DataFrame | None = None,
    tariff: DataFrame | None = None,
    today: DataFrame | None = None,
    now_hour: int | None = None,
    ambient: DataFrame | None = None,
    generation: DataFrame | None = None,
    surplus_price: float | None = None,
    drift_days: int | None = None,
    drift_reference: DataFrame | None = None,
    dispatch: dict | None = None,
    pool: tuple[DataFrame, DataFrame] | None = None,
    temporal: dict | None = None,
    prior: DataFrame | None = None,
    issued: DataFrame | None = None,
    issued_utc: str | None = None,
    stored_ledger: DataFrame | None = None,
    audit: bool = False,
    lams: tuple[float, ...] = (10.0,),
    digits: int | None = 1,
) -> dict[str, DataFrame]:
    """(series_id, ts, value) -> named parts; parts that aren't asked for are absent. The source is read once, and what several
    parts share (hourly values, features, the backtest) is written once; the parts themselves run as they are read.

    Always: integrity, validation, forecast, backtest (calibrated with calibrate), metrics, bands. weather(ts, columns)
    holds forecasts, those of the coming days included. prices(ts, rebap, spot): premium, savings (with
    their band) and spread of the backtest. threshold or rating_kw: congestion and overload, with devices(feeder_id,
    device_id, demand_kw) redispatch and saved, with tariff(feeder_id, hour, fee, p_max_kw, energy_kwh) tariff_plan and
    tariff under what the forecast leaves. today(series_id, hour, actual) and now_hour: intraday. ambient(hour,
    ambient_c) with rating_kw: thermal risk.

    generation(series_id, ts, value): load, generation and their difference are forecast as series of one plan, told apart by key;
    adds generation_forecast, residual_forecast and residual_backtest, and limits apply to the residual load.
    surplus_price: surplus, the volumes of more and less than scheduled under both schedules. drift_days: drift and coverage of
    the backtest's last days against drift_reference(series_id, error) or, where a series has none, the days before, which
    drift_reference then says to store. dispatch(energy_kwh, p_max_kw, fee(hour, fee), c_short, c_long, beta, alpha) with a limit:
    dispatch, the placement and nomination by hour. pool(assets, caps): pool_dispatch. temporal (options of
    studies.temporal_reconciliation()): temporal and temporal_next, from quarter hours. prior(weights): series of fewer than SHORT_DAYS
    days are fitted over their mean and drawn toward it. issued(series_id, target_date, issued_utc, p10, p50, p90): track_record
    and last_days, and with feedback the last exact residual. issued_utc: issued, rows to store. audit: audit, entries that continue
    stored_ledger with what redispatch sheds and dispatch places."""
    limit = studies.single_rating(threshold=threshold, rating=rating_kw)
    raw = relations._cut(series.select("series_id", "ts", "value"))
    checked = relations._cut(integrity.validate(resample.hourly_mean(raw), allow_negative=True))
    clean = checked.select("series_id", "ts", F.col("clean").alias("value"))
    quantities = [_keyed("load", clean)]
    if generation is not None:
        made = relations._cut(resample.hourly_mean(generation))
        both = clean.where("value is not null").join(made.where("value is not null").withColumnRenamed("value", "made"), ["series_id", "ts"])
        quantities += [_keyed("generation", made), _keyed("residual", both.withColumn("value", F.col("value") - F.col("made")))]
    days = resample.daily_matrix(relations.dealt_union(["series_id"], *quantities), zone)
    names = [c for c in weather.columns if c != "ts"] if weather is not None else []
    coming = None
    if weather is not None:
        days = resample.weather_on_days(resample.days_with_weather(days, weather, zone), weather, names, zone)
        local = resample.local_time("ts", zone)
        coming = weather.groupBy(F.to_date(local).alias("local_date"), F.hour(local).alias("hour")).agg(*(F.avg(c).alias(c) for c in names))
    toward, unit = None, None
    if prior is not None:
        toward = prior.first()["weights"]  # one row of as many numbers as features
        level = days.groupBy("series_id").agg(F.avg("value").alias("mean"), (F.max("day_idx") + 1 < SHORT_DAYS).alias("short"))
        pooled = F.col("short") & (F.col("mean") > 0) & F.col("series_id").startswith("load@")
        unit = relations._cut(level.select("series_id", pooled.alias("pooled"), F.when(pooled, F.col("mean")).otherwise(1.0).alias("unit")))
        days = days.join(unit.drop("pooled"), "series_id").withColumn("value", F.col("value") / F.col("unit")).drop("unit")
    days = relations._cut(days)
    vector = [*features.FEATURES, *names]
    rows = models.with_vector(features.features(models.append_days(days, 1, coming), holidays), vector)
    rows = relations._cut(rows if unit is None else rows.join(unit.select("series_id", "pooled"), "series_id"))

    def scaled(x: DataFrame, columns: list[str], places: int | None) -> DataFrame:
        if unit is None:
            return x
        x = x.join(unit.select("series_id", "unit"), "series_id")
        return x.withColumns({c: models._at(F.col(c) * F.col("unit"), places) for c in columns if c in x.columns}).drop("unit")

    out = {"integrity": integrity.integrity_report(raw, zone=zone)}
    out["validation"] = checked.groupBy("series_id").agg(F.max("applied").alias("applied"), F.max("n_filled").alias("n_filled"), F.max("n_left").alias("n_left"))
    residual = None
    if issued is not None:
        truth = scaled(_of_load_days(days), ["value"], None).groupBy(F.substr("series_id", F.lit(6)).alias("series_id"), F.col("local_date").cast("string").alias("target_date"))
        truth = truth.agg(F.array_sort(F.collect_list(F.struct("hour", "value"))).alias("s")).select("series_id", "target_date", F.col("s.value").alias("actual"))
        out["track_record"] = ledger.track_record(issued, truth)
        out["last_days"] = ledger.last_days(out["track_record"])
        if feedback:
            residual = ledger.last_residuals(issued, truth).select(F.concat_ws("@", F.lit("load"), "series_id").alias("series_id"), "hour", "residual")
            if unit is not None:
                residual = residual.join(unit, "series_id").withColumn("residual", F.col("residual") / F.col("unit"))
    places = digits if unit is None else None
    ahead = models.next_day(days, cal_days=cal_days, lams=lams, digits=places, calibrate=calibrate, feedback=feedback, last_residual=residual, rows=rows, prior=toward)
    ahead = relations._cut(scaled(ahead, ["p10", "p50", "p90"], digits))
    if horizon > 1:
        options = dict(cal_days=cal_days, lams=lams, holidays=holidays, weather=names, next_weather=coming, digits=places)
        out["forecast"] = scaled(_of("load", models.several_days(_of_load_days(days), horizon, bands=bands, **options)), ["p10", "p50", "p90"], digits)
    else:
        out["forecast"] = _of("load", ahead)
    tested = models.rolling_origin(days, n_test, lams=lams, feedback=feedback, calibrate=calibrate, rows=rows)
    tested = relations._cut(scaled(tested, ["actual", "persist", "snaive", "model", "p10", "p90", "p10_cal", "p90_cal"], None))
    back = out["backtest"] = _of("load", tested)
    out["metrics"] = metrics.model_table(back.select("series_id", "actual", "persist", "snaive", "model"), ["series_id"], ["persist", "snaive", "model"])
    out["bands"] = metrics.probabilistic_metrics(back.withColumn("p50", F.col("model")), ["series_id"], {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    if calibrate:
        out["calibration"] = evaluations.calibration_summary(back)
    first, basis = (out["forecast"].where("horizon = 1") if horizon > 1 else out["forecast"]), back
    if today is not None and now_hour is not None:
        known = first.select("series_id", "hour", "p10", "p50", "p90").join(today.select("series_id", "hour", "actual"), ["series_id", "hour"], "left")
        out["intraday"] = calibration.intraday(known.withColumn("day", F.lit(0)), now_hour).drop("day")
    if generation is not None:
        out["generation_forecast"], out["residual_forecast"], out["residual_backtest"] = _of("generation", ahead), _of("residual", ahead), _of("residual", tested)
        first, basis = out["residual_forecast"], out["residual_backtest"]
    if prices is not None:
        dated = back.join(_of("load", days).select("series_id", "day_idx", "hour", "local_date"), ["series_id", "day_idx", "hour"])
        wall = F.to_timestamp("local_date") + F.make_dt_interval(hours=F.col("hour"))
        priced = dated.withColumn("ts", F.to_utc_timestamp(wall, zone)).join(prices.select("ts", "rebap", "spot"), "ts")
        out["premium"] = metrics.imbalance_premium(priced, ["series_id"], "model", "actual", "rebap", "spot")
        out["savings"] = evaluations.settlement_band(priced, ["series_id"], "snaive", "model", "actual", "rebap", "spot", "local_date")
        out["spread"] = metrics.spread_stats(prices.withColumn("spread", F.col("rebap") - F.col("spot")), [], "spread")
    if surplus_price is not None:
        out["surplus"] = surplus_comparison(back, surplus_price)
    if drift_days is not None:
        out |= drift_parts(back, drift_days, drift_reference)
    if limit is not None:
        out |= limit_parts(first, basis, limit, devices, tariff, ambient, dispatch)
    if pool is not None:
        out["pool_dispatch"] = control.pool_dispatch(*pool)
    if temporal is not None:
        levels = studies.temporal_reconciliation(resample.quarter_hour_matrix(raw, zone), holidays=holidays, **temporal)
        out["temporal"], out["temporal_next"] = levels["backtest"], levels["next"]
    if issued_utc is not None:
        lists = [F.array_sort(F.collect_list(F.struct("hour", c))).alias(c) for c in ("p10", "p50", "p90")]
        entry = _of("load", ahead).groupBy("series_id", F.col("local_date").cast("string").alias("target_date")).agg(*lists)
        out["issued"] = entry.select("series_id", "target_date", F.lit(issued_utc).alias("issued_utc"), *(F.col(f"{c}.{c}").alias(c) for c in ("p10", "p50", "p90")))
    if audit:
        out["audit"] = audit_entries(out, stored_ledger)
    return out


def _of_load_days(days: DataFrame) -> DataFrame:
    return days.where(F.col("series_id").startswith("load@"))


def surplus_comparison(rows: DataFrame, price: float) -> DataFrame:
    """Backtest rows -> per series the energy above and below each of two schedules (snaive, model), their volumes and nets, and what
    the model's smaller volume is worth at the price."""
    parts = [metrics.surplus_deficit(rows, ["series_id"], c, "actual").select("series_id", *(F.col(k).alias(f"{k}_{c}") for k in ("more", "less", "net", "volume"))) for c in ("snaive", "model")]
    x = parts[0].join(parts[1], "series_id").withColumn("reduction", F.col("volume_snaive") - F.col("volume_model"))
    return x.withColumn("reduction_value", F.col("reduction") * price)


def drift_parts(rows: DataFrame, recent_days: int, stored: DataFrame | None) -> dict[str, DataFrame]:
    """drift and coverage of the last recent_days of backtest rows, and drift_reference: errors of the days before, of series that
    aren't stored yet. A stored reference is what a series is compared with for good."""
    x = rows.withColumn("last", F.max("day_idx").over(Window.partitionBy("series_id"))).withColumn("error", F.col("actual") - F.col("model"))
    x = x.withColumn("recent", F.col("day_idx") > F.col("last") - recent_days)
    new = x.where(~F.col("recent")).select("series_id", "error")
    names = None if stored is None else stored.select("series_id").distinct()
    new = ledger.keep_reference(names, new, ["series_id"])
    compared = [x.where("recent").select("series_id", "error", "recent"), new.withColumn("recent", F.lit(False))]
    if stored is not None:
        compared.append(stored.select("series_id", "error", F.lit(False).alias("recent")))
    errors = relations._cut(relations.dealt_union(["series_id"], *compared))
    return {"drift": metrics.drift_report(errors, ["series_id"]), "coverage": metrics.coverage_report(x.where("recent"), ["series_id"]), "drift_reference": new}


def limit_parts(
    first: DataFrame, rows: DataFrame, limit: float, devices: DataFrame | None, tariff: DataFrame | None, ambient: DataFrame | None, dispatch: dict | None
) -> dict[str, DataFrame]:
    """What follows from a limit: congestion, overload and hosting capacity, and as asked for thermal, redispatch, saved, tariff_plan,
    tariff and dispatch. first: the coming day's forecast; rows: the backtest whose residuals are the scenarios."""
    out = {}
    hours = first.select(F.col("series_id").alias("feeder_id"), "hour", F.col("p50").alias("forecast_kw"), "p90")
    out["congestion"] = control.congestion_window(hours, limit)
    residuals = rows.groupBy(F.col("series_id").alias("asset_id"), "hour").agg(F.array_sort(F.collect_list(F.struct("day_idx", (F.col("actual") - F.col("model")).alias("r")))).alias("s"))
    residuals = residuals.select("asset_id", "hour", F.col("s.r").alias("residuals"))
    points = hours.select(F.col("feeder_id").alias("asset_id"), "hour", F.col("forecast_kw").alias("point_kw"), F.lit(float(limit)).alias("rating_kw"))
    scenarios = points.join(residuals, ["asset_id", "hour"])
    out["overload"] = risk.overload(scenarios)
    out["hosting"] = risk.hosting_capacity(scenarios)
    if ambient is not None:
        out["thermal"] = risk.thermal_risk(scenarios.join(ambient, "hour"))
    if devices is not None:
        out["redispatch"] = control.redispatch(hours.drop("p90"), devices, limit)
        out["saved"] = control.energy_saved(out["redispatch"])
    if tariff is not None:
        left = hours.withColumn("cap_kw", F.greatest(F.lit(0.0), limit - F.col("p90"))).select("feeder_id", "hour", "cap_kw")
        out["tariff_plan"] = control.tariff_placement(tariff.join(left, ["feeder_id", "hour"]).withColumn("available", F.lit(True)), ["feeder_id"])
        out["tariff"] = control.tariff_summary(out["tariff_plan"], ["feeder_id"])
    if dispatch is not None:
        most, short, long = float(dispatch["p_max_kw"]), dispatch.get("c_short", 0.20), dispatch.get("c_long", 0.10)
        base = points.select(F.col("asset_id").alias("plan_id"), "hour", F.greatest(F.lit(0.0), F.col("point_kw") - most).alias("base_kw"))
        base = base.join(residuals.withColumnRenamed("asset_id", "plan_id"), ["plan_id", "hour"])
        fee = F.coalesce("fee", F.lit(0.0)) if dispatch.get("fee") is not None else F.lit(0.0)
        base = base.join(dispatch["fee"].select("hour", "fee"), "hour", "left") if dispatch.get("fee") is not None else base
        base = base.withColumns({"fee": fee, "p_max_kw": F.lit(most), "energy_kwh": F.lit(float(dispatch["energy_kwh"]))})
        plan = control.plan_day(base, limit, short, long)
        if dispatch.get("beta", 0.0) > 0:
            averse = risk.cvar_nomination(plan.select(F.col("plan_id").alias("asset_id"), "hour", F.col("total_kw").alias("point_kw"), "residuals"), short, long, dispatch["beta"], dispatch.get("alpha", 0.95))
            averse = averse.select(F.col("asset_id").alias("plan_id"), "hour", F.col("nomination_kw").alias("averse_kw"), "objective")
            plan = plan.join(averse, ["plan_id", "hour"]).withColumn("nomination_kw", F.col("averse_kw")).drop("averse_kw")
        out["dispatch"] = plan.drop("residuals")
    return out


def audit_entries(parts: dict[str, DataFrame], stored: DataFrame | None) -> DataFrame:
    """Ledger entries of the parts' interventions, one ledger an asset, in order of hour and kind; they continue the stored chains, and
    none is made if a stored chain is broken."""
    events = []
    if "redispatch" in parts:
        events.append(ledger.interventions(parts["redispatch"], "redispatch", "shed_kw", "feeder_id"))
    if "dispatch" in parts:
        events.append(ledger.interventions(parts["dispatch"], "dispatch", "kwh", "plan_id"))
    if not events:
        raise ValueError("audit needs redispatch or dispatch")
    x = relations.dealt_union(["asset_id"], *events)
    seq = F.row_number().over(Window.partitionBy("asset_id").orderBy("hour", "decision_type")) - 1
    payload = ledger.payload_json("asset_id", "decision_type", "duration_min", "hour", F.round("magnitude_kw", 6).alias("magnitude_kw"))
    new = relations._cut(x.select(F.col("asset_id").cast("string").alias("ledger_id"), seq.cast("long").alias("seq"), payload.alias("payload")))
    return ledger.chain(new) if stored is None else ledger.append(stored, new)


def blind_challenge(series: DataFrame, zone: str = "Europe/Berlin", n_test: int = 84, n_boot: int = 1000, holidays: DataFrame | None = None) -> dict[str, DataFrame]:
    """Backtest of unseen series: model against both baselines with paired bootstrap intervals. MAPE is null where
    the mean load is near zero."""
    days = resample.daily_matrix(resample.hourly_mean(series), zone)
    rows = models.rolling_origin(days, max(28, min(84, n_test)), holidays=holidays)
    table = metrics.model_table(rows.select("series_id", "actual", "persist", "snaive", "model"), ["series_id"], ["persist", "snaive", "model"])
    level = days.groupBy("series_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    table = table.join(level, "series_id").withColumn("mape", F.when(F.abs("mean") > 0.1 * F.col("std"), F.col("mape"))).drop("mean", "std")
    e = lambda c: F.avg(F.abs(F.col(c) - F.col("actual"))).alias(c)
    daily = relations._cut(rows.groupBy("series_id", "day_idx").agg(e("model"), e("persist"), e("snaive")))  # both references read it
    skill = [bootstrap.skill_interval(daily, ["series_id"], "model", r, n=n_boot).withColumn("reference", F.lit(r)) for r in ("persist", "snaive")]
    return {"metrics": table, "skill": relations.dealt_union(["series_id"], *skill)}


def daily_batch(series: DataFrame, tenants: DataFrame, **options) -> dict[str, DataFrame]:
    """All tenants at once: (series_id, utility) joined to every part; a loop over tenants isn't needed."""
    return {k: v.join(tenants, "series_id") if "series_id" in v.columns else v for k, v in run_forecast(series, **options).items()}

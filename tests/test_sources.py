"""Readers on small files; data sources with an in-process transport; streams."""

import json

import pytest
from pyspark.sql import functions as F

from loadweave.sources import catalog, counters, mscons, prices, remote, text_series
from loadweave.streaming import delivery, readings


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_weekday_suffix_and_german_numbers(spark, tmp_path):
    lines = ["Text;Reihe1 [kW]"] + [f"01.01.2025 {h:02d}:{m:02d} Mi;1.{h:03d},5" for h in range(4) for m in (0, 15, 30, 45)]
    x = text_series.load_series(spark, write(tmp_path / "a.csv", "\n".join(lines)), "a", ts_col="Text").orderBy("ts").collect()
    assert [round(r["value"], 4) for r in x] == [1.0005, 1.0015, 1.0025, 1.0035]
    assert str(x[0]["ts"]) == "2024-12-31 23:00:00"


def test_headerless_levels(spark, tmp_path):
    rows = ["Netz;;;MW;kW", ";;;110 kV;10 kV"] + [f"01.02.2025;{h:02d}:00;{h + 1:02d}:00;{h * 3 % 7},5;{h * 5 % 11},0" for h in range(12)]
    path = write(tmp_path / "b.csv", "\n".join(rows))
    cells, layout = text_series.read_text(spark, path)
    assert layout.names == ["Datum", "von", "bis", "Load_1", "Load_2"] and layout.units == {"Load_1": "MW", "Load_2": "kW"}
    assert cells.count() == 12
    with pytest.raises(ValueError):
        text_series.load_series(spark, path, "b")
    assert text_series.load_series(spark, path, "b", load_col="Load_2").agg(F.max("value")).first()[0] == pytest.approx(0.01)


def test_row_number_is_no_load(spark):
    df = spark.range(50).select(F.col("id").alias("line"), F.col("id").cast("string").alias("idx"), (F.col("id") * 7 % 13).cast("string").alias("v"))
    got = {r["column"]: r["plausible"] for r in text_series.inspect(df, ["idx", "v"]).collect()}
    assert got == {"idx": False, "v": True}


def test_excel_is_refused(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"PK\x03\x04rest")
    with pytest.raises(ValueError):
        text_series.read_text(spark, str(tmp_path / "x.csv"))


def test_mscons_single_and_block(spark, tmp_path):
    single = "UNB+UNOC:3'LIN+1'PIA+5+1-1?:1.8.0:SRW'" + "".join(f"QTY+220:{v}:KWH'DTM+163:20240601{h:02d}00?+00:303'DTM+164:20240601{h + 1:02d}00?+00:303'" for h, v in enumerate((1000, 2000)))
    block = "LIN+1'DTM+163:202401010000:203'DTM+164:202401020000:203'" + "".join(f"QTY+220:{v}:KWH'" for v in range(96))
    a = mscons.read_mscons(spark, write(tmp_path / "a.edi", single)).orderBy("ts").collect()
    assert [(str(r["ts"]), r["value"], r["step_h"]) for r in a] == [("2024-06-01 00:00:00", 1000.0, 1.0), ("2024-06-01 01:00:00", 2000.0, 1.0)]
    b = mscons.read_mscons(spark, write(tmp_path / "b.edi", block))
    assert b.count() == 96 and str(b.agg(F.min("ts")).first()[0]) == "2023-12-31 23:00:00"
    first = mscons.hourly_power(b).orderBy("ts").first()
    assert first["value"] == pytest.approx((0 + 1 + 2 + 3) / 4 / 0.25 / 1000)


def test_mscons_own_separators():
    got = list(mscons.segments("UNA-*.! ~QTY*220-1!-5-KWH~"))
    assert got == [[["QTY"], ["220", "1-5", "KWH"]]]


def test_prices(spark, tmp_path):
    text = "Zeit;reBAP_EUR_MWh\n2024-01-01T00:00:00+01:00;-1.234,56\n2024-01-01T00:15:00+01:00;75,15\n2024-01-01T00:30:00+01:00;\n"
    path = write(tmp_path / "p.csv", text, "windows-1252")
    assert [r["price"] for r in prices.read_prices(spark, path).orderBy("pos").collect()] == [-1234.56, 75.15]
    assert prices.read_prices(spark, path, keep_gaps=True).count() == 3
    raw = spark.createDataFrame(
        [("01.07.2024", "00:00", "CEST", "1,5", "2,5"), ("01.01.2024", "00:00", "CET", "3,0", "3,0")],
        "Datum string, von string, Zeitzone string, u string, o string"
    )
    n = prices.normalise_official(raw, "u", "o")
    assert {str(r["ts"]) for r in n.collect()} == {"2024-06-30 22:00:00", "2023-12-31 23:00:00"}
    assert tuple(prices.asymmetry(n).first()) == (2, 1, 1.0)


def fake(url: str) -> str:
    if url == "index":
        return json.dumps({"timestamps": [0, remote.WEEK_MS, 9 * remote.WEEK_MS]})
    if url.startswith("w/"):
        return json.dumps({"hourly": {"time": [url[2:12] + "T00:00"], "t": [1.5], "g": [None]}})
    base = int(url.split("/")[1])
    return json.dumps({"series": [[base, 1.0], [base, 2.0], [base + 3_600_000, None], [base + 7_200_000, 3.0]]})


def test_remote_sources(spark):
    remote.register(spark)
    o = {"index": "index", "chunk": "c/{ts}", "start_ms": "0", "end_ms": str(2 * remote.WEEK_MS), "transport": "tests.test_sources.fake"}
    x = spark.read.format("chunked_series").options(**o).load()
    assert sorted(r["value"] for r in x.collect()) == [1.0, 1.0, 3.0, 3.0]
    w = spark.read.format("forecast_weather").options(url="w/{start}", columns="t,g", start="2024-01-01", end="2024-12-31", transport="tests.test_sources.fake").load()
    assert w.count() == 3 and w.where("g is null").count() == 3


def test_weekly_json(spark, tmp_path):
    for k in range(2):
        write(tmp_path / f"wk{k}.json", json.dumps([[3_600_000 * (k * 2 + i), 10.0 * i] for i in range(3)]))
    assert remote.read_weekly_json(spark, str(tmp_path / "wk*.json")).count() == 5


def test_catalog(spark, tmp_path):
    path = write(tmp_path / "m.json", json.dumps([{"key": "a", "include_in_benchmark": True}, {"key": "b", "include_in_benchmark": False}]))
    assert [r["key"] for r in catalog.read_manifest(spark, path).collect()] == ["a"]
    x = catalog.synthetic_load(spark, 5, 2)
    assert x.count() == 240 and x.agg(F.max("value")).first()[0] == pytest.approx(10.0)
    assert catalog.synthetic_load(spark, 5, 2).repartition(3).agg(F.sum("value")).first()[0] == pytest.approx(x.agg(F.sum("value")).first()[0])
    catalog.cache_views(spark, {"mock": x}, str(tmp_path / "cache"))
    assert spark.sql("select count(*) from mock").first()[0] == 240
    assert counters.household_hours(x.select(F.col("series_id").alias("household_id"), "ts", "value")).count() == 0


def test_stream_hours_and_shift(spark, tmp_path):
    src = str(tmp_path / "in")
    data = spark.sql("select 's' series_id, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 15) ts, cast(id as double) value from range(16)")
    data.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(data.schema).parquet(src)
    q = readings.hourly(readings.dedup(stream), late=None).writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["value"] for r in spark.table("hours").collect()} == {1.5}
    src2 = str(tmp_path / "pairs")
    pairs = spark.createDataFrame([("s", 0, 0, 0.0, 1.0), ("s", 0, 1, 0.0, 1.5)], "series_id string, day int, hour int, p50 double, actual double")
    pairs.coalesce(1).write.parquet(src2)
    q = readings.online_shift(spark.readStream.schema(pairs.schema).parquet(src2)).writeStream.format("memory").queryName("shift").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    w = 0.5 ** (1 / 3)
    assert spark.table("shift").first()["shift"] == pytest.approx(0.5 * (w + 1.5) / (w + 1))



def pages(url: str) -> str:
    month, limit, offset = url.split("/")[1][:7], int(url.split("/")[2]), int(url.split("/")[3])
    total = {"2024-01": 5, "2024-02": 4, "2024-03": 0}[month]
    return json.dumps({"results": [{"day": month, "wh": offset + k, "more": 1} for k in range(min(limit, total - offset))]})


def test_paged_records(spark):
    remote.register(spark)
    x = spark.read.format("paged_records").options(
        url="p/{start}_{end}/{limit}/{offset}", fields="day,wh,absent", start="2024-01-15", end="2024-03-02", limit="2",
        transport="tests.test_sources.pages"
    ).load()
    assert x.dtypes == [("day", "string"), ("wh", "string"), ("absent", "string")]
    got = sorted((r["day"], int(r["wh"])) for r in x.collect())
    assert got == [("2024-01", k) for k in range(5)] + [("2024-02", k) for k in range(4)]
    reader = remote.RecordReader({"url": "{start} {end}", "start": "2024-01-15", "end": "2024-03-02"}, [])
    assert [p.url for p in reader.partitions()] == ["2024-01-15 2024-02-01", "2024-02-01 2024-03-01", "2024-03-01 2024-03-03"]


def test_cached(spark, tmp_path):
    path, seen = str(tmp_path / "cache"), []

    def read():
        seen.append(1)
        return spark.range(len(seen))

    assert [remote.cached(spark, path, read, force).count() for force in (False, False, True, False)] == [1, 1, 2, 2] and len(seen) == 2


def test_national_load(spark, tmp_path):
    path = write(
        tmp_path / "n.csv",
        "CountryCode\tDateUTC\tValue\tCov_ratio\nDE\t01-02-2024 13:00\t50000.5\t1\nFR\t01-02-2024 13:00\tn/e\t0.9\nXX\t01-02-2024 13:00\t1\t1\n"
    )
    got = {r["series_id"]: r for r in remote.national_load(spark, path, ["DE", "FR"]).collect()}
    assert set(got) == {"DE", "FR"} and got["DE"]["value"] == 50000.5 and str(got["DE"]["ts"]) == "2024-02-01 13:00:00" and got["FR"]["value"] is None
    with pytest.raises(ValueError):
        remote.national_load(spark, path, ["DE", "AT"])


def test_archives(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/day1.csv", "a;b\n1;2\r\n")
        z.writestr("x/readme.txt", "no")
    got = counters.read_archives(spark, str(tmp_path / "*.zip"), r"\.csv$").collect()
    assert [(r["entry"], r["line_no"], r["line"]) for r in got] == [("x/day1.csv", 0, "a;b"), ("x/day1.csv", 1, "1;2")]


def test_delivery(spark, tmp_path):
    rows = "select 'DE123456' malo, timestamp'2024-01-01 00:00:00' start_ts, timestamp'2024-01-01 01:00:00' end_ts, 5.0D p_limit_kw, cast(null as double) floor_kw"
    good, both = spark.sql(rows), spark.sql(rows + " union all select 'X', timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:00:00', 3.0D, null")
    sent = []
    delivery.submit(good, lambda df: sent.append(df.count()))
    with pytest.raises(ValueError, match="short_id"):
        delivery.submit(both, lambda df: sent.append(df.count()))
    assert sent == [1]
    both.coalesce(1).write.parquet(str(tmp_path / "in"))
    refused = []
    q = delivery.deliver(
        spark.readStream.schema(both.schema).parquet(str(tmp_path / "in")), lambda df: sent.append(df.count()), str(tmp_path / "ck"),
        lambda df: refused.extend(r["malo"] for r in df.collect())
    )
    q.awaitTermination(120)
    assert sent == [1, 1] and refused == ["X"]


def test_time_column_by_what_it_holds(spark, tmp_path):
    rows = [f"{k};x{k % 3};{k * 1.5:.1f};{k // 4 % 24:02d}:{15 * (k % 4):02d} war am {1 + k // 96:02d}.01.2024;{1 + k // 96:02d}.01.2024 {k // 4 % 24:02d}:{15 * (k % 4):02d}" for k in range(192)]
    lines = ["Bericht", "", "nr;zeitart;Leistung kW;text;stempel", *rows]
    path = tmp_path / "odd.csv"
    path.write_text("\n".join(lines))
    cells, layout = text_series.read_text(spark, str(path))
    assert text_series.time_column(cells, layout.names) == "stempel"
    got = text_series.load_series(spark, str(path), "s", load_col=layout.names[2], unit="MW")
    assert got.count() == 48 and got.orderBy("ts").first()["value"] == pytest.approx((0 + 1.5 + 3 + 4.5) / 4)
    with pytest.raises(ValueError):
        text_series.time_column(cells, layout.names[:3])


def test_lines_like_the_preamble_stay(spark, tmp_path):
    path = tmp_path / "twice.csv"
    path.write_text("\n".join(["a;b", "01.01.2024 00:00;1", "a;b", "01.01.2024 01:00;2"]))
    cells, layout = text_series.read_text(spark, str(path))
    assert cells.count() == 4 - layout.first_row

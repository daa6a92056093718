"""Literal tables for the column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from hearthlog.functions import display, numbers, text, units, zones

INF = float("inf")


def evaluate(spark, rows, layout, *columns):
    df = spark.createDataFrame(rows, layout)
    return [tuple(row) for row in df.select(*columns).collect()]


def test_temperature_conversion(spark):
    rows = [(0.0, "CELSIUS"), (100.0, "FAHRENHEIT"), (-273.15, "KELVIN"), (20.0, None), (None, "KELVIN")]
    got = evaluate(
        spark, rows, "v double, u string",
        units.from_celsius(F.col("v"), F.col("u")), units.temperature_symbol(F.col("u")),
    )
    assert got == [(0.0, "°C"), (212.0, "°F"), (0.0, "K"), (20.0, "°C"), (None, "K")]
    back = evaluate(
        spark, [(212.0, "FAHRENHEIT"), (0.0, "KELVIN"), (5.0, None), (None, "KELVIN")], "v double, u string",
        units.to_celsius(F.col("v"), F.col("u")),
    )
    assert back == [(100.0,), (-273.15,), (5.0,), (None,)]


def test_finite_and_range(spark):
    rows = [
        ("TEMPERATURE", -273.15, True), ("TEMPERATURE", math.nextafter(-273.15, -INF), False),
        ("TEMPERATURE", 1.7e308, True), ("HUMIDITY", 0.0, True), ("HUMIDITY", 100.0, True),
        ("HUMIDITY", math.nextafter(100.0, INF), False), ("HUMIDITY", math.nextafter(0.0, -INF), False),
        ("HUMIDITY", float("nan"), False), ("TEMPERATURE", INF, False), ("TEMPERATURE", -INF, False),
        ("MOTION", 1.0, False), ("HUMIDITY", None, False), (None, 1.0, False),
    ]
    got = evaluate(spark, rows, "t string, v double, want boolean",
                   numbers.valid_measurement(F.col("t"), F.col("v")), F.col("want"))
    assert all(have == want for have, want in got), got


def test_int_between(spark):
    got = evaluate(spark, [(0,), (1,), (10080,), (10081,), (None,)], "v int", numbers.int_between(F.col("v"), 1, 10080))
    assert [row[0] for row in got] == [False, True, True, False, False]


def test_adc(spark):
    got = evaluate(spark, [(0,), (512,), (1023,), (None,)], "a int", numbers.adc_to_celsius(F.col("a")))
    log_ohms = math.log(11000.0)
    expected = 1 / (0.001129148 + (0.000234125 + 0.0000000876741 * log_ohms**2) * log_ohms) - 273.15
    assert got[0][0] == -999.0
    assert got[1][0] == pytest.approx(expected, abs=1e-9)
    assert got[2][0] > 100
    assert got[3][0] is None


def test_trim_and_tokens(spark):
    rows = [("\t tok \n",), ("tok",), ("   ",), (None,), (" tok",)]
    got = evaluate(spark, rows, "s string", text.required_text(F.col("s")), text.token_hash(F.col("s")))
    assert [row[0] for row in got] == ["tok", "tok", None, None, " tok"]
    assert got[0][1] == got[1][1] != got[4][1]


def test_form_fields(spark):
    rows = [
        ("sensorToken=a%20b&celsiusValue=1", "a b"),
        ("celsiusValue=1&sensorToken=x+y", "x y"),
        ("sensorToken=first&sensorToken=second", "first"),
        ("mysensorToken=no", ""),
        ("sensorToken=%zz", None),
        ("", ""),
    ]
    got = evaluate(spark, rows, "b string, want string", text.form_field(F.col("b"), F.lit("sensorToken")), F.col("want"))
    assert all(have == want for have, want in got), got


def test_booleans_and_numbers(spark):
    words = [("true", True), (" ON ", True), ("yes", True), ("1", True), ("off", False), ("0", False),
             ("No", False), ("t", None), ("", None), (None, None)]
    got = evaluate(spark, words, "s string, want boolean", text.form_boolean(F.col("s")), F.col("want"))
    assert all(have == want for have, want in got), got
    forms = [("1 5", 15.0), (" 2.5\t", 2.5), ("1e3", 1000.0), ("1,5", None), ("", None), ("x", None)]
    got = evaluate(spark, forms, "s string, want double", text.form_double(F.col("s")), F.col("want"))
    assert all(have == want for have, want in got), got
    lenient = [(" Detected", True), ("T", True), ("clear", False), ("f", False), ("on", None), ("", None)]
    got = evaluate(spark, lenient, "s string, want boolean", text.lenient_boolean(F.col("s")), F.col("want"))
    assert all(have == want for have, want in got), got
    values = [("22,5", 22.5), (" 22.5 ", 22.5), ("NaN", None), ("Infinity", None), ("abc", None), ("", None)]
    got = evaluate(spark, values, "s string, want double", text.lenient_double(F.col("s")), F.col("want"))
    assert all(have == want for have, want in got), got


def test_normalized_email(spark):
    got = evaluate(spark, [("  A@B.C\t",), (" ",)], "s string", text.normalized_email(F.col("s")))
    assert got == [("a@b.c",), (None,)]


def test_fill_template_is_one_pass(spark):
    got = evaluate(
        spark, [("{0} in {1} ({0}) {x} {9}", "{1}", "home")], "t string, a string, b string",
        text.fill_template(F.col("t"), F.col("a"), F.col("b")),
    )
    assert got == [("{1} in home ({1}) {x} ",)]


def test_numbers_as_text(spark):
    rows = [(1.005, "1.00"), (0.125, "0.13"), (-0.125, "-0.13"), (0.375, "0.38"), (2.625, "2.63"), (21.5, "21.50"), (0.0, "0.00")]
    got = evaluate(spark, rows, "v double, want string", display.fixed_two(F.col("v")), F.col("want"))
    assert all(have == want for have, want in got), got
    grouped = [(1234.5, "ENGLISH", "1,234.5"), (1234.5, "TURKISH", "1.234,5"), (0.126, "ENGLISH", "0.13"), (7.0, "TURKISH", "7,0")]
    got = evaluate(spark, grouped, "v double, l string, want string",
                   display.locale_number(F.col("v"), F.col("l")), F.col("want"))
    assert all(have == want for have, want in got), got
    got = evaluate(spark, [(10080, "ENGLISH"), (10080, "TURKISH"), (60, "TURKISH")], "v int, l string",
                   display.locale_integer(F.col("v"), F.col("l")))
    assert got == [("10,080",), ("10.080",), ("60",)]


def test_metric_text(spark):
    rows = [
        ("MOTION", 2.5, "", "ENGLISH", "3", "Detections: 3"),
        ("MOTION", 0.0, "", "TURKISH", "0", "Algılama sayısı: 0"),
        ("HUMIDITY", 48.5, "% RH", "ENGLISH", "48.50", "Average: 48.50 % RH"),
        ("HUMIDITY", None, "% RH", "TURKISH", "Kayıtlı veri yok", "Kayıtlı veri yok"),
    ]
    args = (F.col("t"), F.col("v"))
    got = evaluate(
        spark, rows, "t string, v double, s string, l string, cell string, tip string",
        display.format_metric(*args, F.col("l")), F.col("cell"),
        display.labelled_metric(*args, F.col("s"), F.col("l")), F.col("tip"),
    )
    assert all(a == b and c == d for a, b, c, d in got), got


def test_hour_range_and_date(spark):
    got = evaluate(spark, [(0,), (9,), (23,)], "h int", display.hour_range(F.col("h")))
    assert got == [("00:00–01:00",), ("09:00–10:00",), ("23:00–00:00",)]
    got = evaluate(spark, [("2024-03-10", "ENGLISH"), ("2024-03-12", "TURKISH")], "d string, l string",
                   display.display_date(F.to_date("d"), F.col("l")))
    assert got == [("Sunday, 10-03-2024",), ("Salı, 12-03-2024",)]


def test_recent_value_text(spark):
    rows = [
        ("TEMPERATURE", 22.5, None, "°C", "ENGLISH", "22.50 °C"),
        ("TEMPERATURE", -0.5, None, "K", "TURKISH", "-0,50 K"),
        ("MOTION", None, True, "", "ENGLISH", "Detected"),
        ("MOTION", None, False, "", "TURKISH", "Hareket yok"),
    ]
    got = evaluate(
        spark, rows, "t string, v double, b boolean, s string, l string, want string",
        display.recent_value_text(F.col("t"), F.col("v"), F.col("b"), F.col("s"), F.col("l")), F.col("want"),
    )
    assert all(have == want for have, want in got), got


def test_every_listed_region_is_usable(spark):
    ids = spark.createDataFrame([(zone,) for zone in zones.region_ids()], "zone string")
    # Every region, every fifteen days from the instant on which the quarter-hour slots rely.
    since = f"CAST('{zones.ON_GRID_SINCE}' AS TIMESTAMP)"
    instants = F.explode(F.expr(f"sequence({since}, CAST('2038-01-01' AS TIMESTAMP), INTERVAL 15 DAYS)"))
    moved = ids.withColumn("at", instants).select(zones.offset_seconds(F.col("at"), F.col("zone")).alias("s"))
    assert moved.where(F.col("s") % 900 != 0).count() == 0
    assert moved.count() > 1000 * len(zones.region_ids()) and len(zones.region_ids()) > 400
    assert {"EST", "HST", "MST"}.isdisjoint(zones.region_ids())


def test_zone_validity(spark):
    rows = [
        ("UTC", True, True), ("Z", True, True), ("+3", True, True), ("+03:00", True, True), ("-18", True, True),
        ("GMT-05:30", True, True), ("UTC+3", True, True), ("+01:07", True, False), ("+01:00:30", True, False),
        ("+0107", True, False), ("Europe/Istanbul", True, True), ("+18:01", False, True), ("+19", False, True),
        ("Mars/Olympus", False, True), ("", False, True), (None, False, None),
    ]
    got = evaluate(spark, rows, "z string, valid boolean, grid boolean",
                   zones.valid_zone("z"), F.col("valid"), zones.on_quarter_hour("z"), F.col("grid"), F.col("z"))
    assert all(a == b and (c == d or not b) for a, b, c, d, _ in got), got
    # Every id accepted here must be one the engine accepts too.
    usable = spark.createDataFrame(rows, "z string, valid boolean, grid boolean")
    usable.select(zones.offset_seconds(F.lit("2024-01-01").cast("timestamp"), zones.safe_zone("z"))).collect()


@pytest.mark.parametrize(
    "zone, day, start, hours",
    [
        ("America/New_York", "2024-03-10", "2024-03-10 05:00:00", 23),
        ("America/New_York", "2024-11-03", "2024-11-03 04:00:00", 25),
        ("America/Sao_Paulo", "2018-11-04", "2018-11-04 03:00:00", 23),
        ("America/Havana", "2023-11-05", "2023-11-05 04:00:00", 25),
        ("Asia/Kathmandu", "2024-01-10", "2024-01-09 18:15:00", 24),
        ("Australia/Lord_Howe", "2024-04-07", "2024-04-06 13:00:00", 24.5),
    ],
)
def test_start_of_day(spark, zone, day, start, hours):
    from_to = evaluate(
        spark, [(day, zone)], "d string, z string",
        F.date_format(zones.start_of_day(F.to_date("d"), F.col("z")), "yyyy-MM-dd HH:mm:ss"),
        (F.unix_seconds(zones.start_of_day(F.date_add(F.to_date("d"), 1), F.col("z")))
         - F.unix_seconds(zones.start_of_day(F.to_date("d"), F.col("z")))) / 3600,
    )
    assert from_to == [(start, hours)]


def test_offset_text(spark):
    rows = [("UTC",), ("Europe/Istanbul",), ("America/Sao_Paulo",), ("Asia/Kathmandu",), ("+01:00:30",)]
    when = F.lit("2024-01-30 12:00:00").cast("timestamp")
    got = evaluate(spark, rows, "z string", zones.offset_text(when, F.col("z")), zones.zone_label(F.col("z"), when))
    assert got == [
        ("Z[UTC]", "UTC+00:00 - UTC"),
        ("+03:00[Europe/Istanbul]", "UTC+03:00 - Europe/Istanbul"),
        ("-03:00[America/Sao_Paulo]", "UTC-03:00 - America/Sao_Paulo"),
        ("+05:45[Asia/Kathmandu]", "UTC+05:45 - Asia/Kathmandu"),
        ("+01:00:30[+01:00:30]", "UTC+01:00:30 - +01:00:30"),
    ]

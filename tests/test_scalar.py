import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from laneflow.config import ExperimentConfig, SampleConfig, SiteConfig, WindowConfig
from laneflow.functions import geo, scalar
from laneflow.operators import clean

SITE = SiteConfig()


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


def test_site_constants():
    assert SITE.section_width == 247.0
    assert SITE.sections == 10
    assert SITE.origin_ms == 1118846979700
    assert (SITE.lanes(True), SITE.lanes(False)) == (6, 5)


def test_window_and_sample_counts():
    window = WindowConfig(10, 45, 2772.5)
    assert window.num_windows == 272
    assert SampleConfig(6, 1, 1).num_samples(272) == 264
    assert WindowConfig(0.5, 45, 2772.5).millis == 500
    with pytest.raises(ValueError):
        WindowConfig(10, 45, 50)
    with pytest.raises(ValueError):
        SampleConfig(6, 1, 1).num_samples(8)


def test_model_name():
    exp = ExperimentConfig(0.5, SampleConfig(120, 20), False)
    assert exp.model_name("m", 10) == "m_wo_0.5_10_120_1_20"


@pytest.mark.parametrize(
    ("distance", "section"),
    [(0.0, 0), (246.9, 0), (247.0, 1), (-10.0, 0), (2222.9, 8), (2223.0, 9), (2224.66, 9),
     (2470.0, 10), (2475.0, 10), (1e300, None)],
)
def test_section_bin(spark, distance, section):
    assert one(spark, scalar.section_bin(F.lit(distance), SITE.section_width)) == section


@pytest.mark.parametrize(
    ("elapsed", "millis", "window"),
    [(45_000, 10_000, 4), (49_999, 10_000, 4), (50_000, 10_000, 5), (45_499, 500, 90),
     (1_118_846_979_700, 500, 2_237_693_959), (-9_999, 10_000, 0)],
)
def test_window_bin(spark, elapsed, millis, window):
    assert one(spark, scalar.window_bin(F.lit(elapsed), millis)) == window


def test_range_trims_milliseconds(spark):
    times = spark.createDataFrame([(t,) for t in (44_999, 45_000, 99_954, 99_955, 99_999)], "t long")
    trimmed = times.filter(scalar.in_range(F.col("t"), 45, 100, 45))
    assert [r.t for r in trimmed.collect()] == [45_000, 99_954]
    assert times.filter(scalar.in_range(F.col("t"), 45, 100)).count() == 4


def test_mph(spark):
    assert one(spark, scalar.to_mph(F.lit(44.0))) == pytest.approx(44 / 1.46666667, abs=0)


def test_first_frame_is_at_seven_local_time(spark):
    clock = scalar.local_time(F.lit(SITE.origin_ms), SITE.tz)
    assert one(spark, F.date_format(clock, "yyyy-MM-dd HH:mm:ss.SSS")) == "2005-06-15 07:49:39.700"
    assert one(spark, scalar.epoch_of_local(clock, SITE.tz)) == SITE.origin_ms
    shifted = scalar.local_time(F.lit(SITE.origin_ms), SITE.tz, 3_600_000)
    assert one(spark, F.hour(shifted)) == 6


def test_last_frame_of_hour_seven(spark):
    for after, hour in ((620_200, 7), (620_300, 8)):
        clock = scalar.local_time(F.lit(SITE.origin_ms + after), SITE.tz)
        assert one(spark, F.hour(clock)) == hour


def test_merge_lanes(spark):
    lanes = spark.createDataFrame([(i,) for i in (1, 5, 6, 7, 8, 9)], "lane_id int")
    assert [r[0] for r in clean.merge_ramp_lanes(lanes, SITE).collect()] == [1, 5, 6, 6, 6, 9]


def test_min_max_of_equal_bounds_is_null(spark):
    assert one(spark, scalar.min_max(F.lit(1.0), F.lit(1.0), F.lit(1.0))) is None
    assert one(spark, scalar.min_max(F.lit(3.0), F.lit(1.0), F.lit(5.0))) == 0.5


def forward(lat, lon, zone):
    """Forward conic projection in feet, straight from the definition."""
    n, scale, rho0 = geo.zone_constants(zone)
    phi = math.radians(lat)
    rho = scale * geo._t(phi) ** n
    theta = n * math.radians(lon - zone.lon0)
    east = zone.false_easting + rho * math.sin(theta)
    north = zone.false_northing + rho0 - rho * math.cos(theta)
    return east / geo.METRES_PER_FOOT, north / geo.METRES_PER_FOOT


@pytest.mark.parametrize("crs", sorted(geo.ZONES))
def test_reproject_inverts_the_forward_projection(spark, crs):
    zone = geo.ZONES[crs]
    truth = [(zone.lat0 + 0.3 * i, zone.lon0 + 0.4 * (i - 4)) for i in range(9)]
    planar = [(*forward(lat, lon, zone), lat, lon) for lat, lon in truth]
    df = spark.createDataFrame(planar, "global_x double, global_y double, want_lat double, want_lon double")
    out = clean.reproject(df, crs)
    assert "global_x" not in out.columns
    for r in out.collect():
        assert r.lat == pytest.approx(r.want_lat, abs=1e-11)
        assert r.lon == pytest.approx(r.want_lon, abs=1e-11)


def test_reproject_known_point(spark):
    df = spark.createDataFrame([(6451137.641, 1873344.962)], "global_x double, global_y double")
    zone3, zone5 = (clean.reproject(df, c).head() for c in ("EPSG:2227", "EPSG:2229"))
    assert (round(zone3.lat, 2), round(zone3.lon, 2)) == (37.14, -120.88)
    assert (zone5.lat, zone5.lon) == pytest.approx((34.139, -118.365), abs=1e-3)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(0, 1e6), min_size=2, max_size=50))
def test_section_bin_is_monotone(spark, values):
    df = spark.createDataFrame([(v,) for v in sorted(values)], "d double").coalesce(1)
    bins = [r[0] for r in df.select(scalar.section_bin(F.col("d"), 247.0)).collect()]
    assert bins == [int(v / 247.0) for v in sorted(values)]


def plain_shift(lat, lon, s):
    """Seven parameters in plain floats; the latitude by iteration."""
    def e2(inverse):
        return 2 / inverse - 1 / inverse**2

    phi, lam, e = math.radians(lat), math.radians(lon), e2(geo.INVERSE_FLATTENING)
    across = geo.SEMI_MAJOR / math.sqrt(1 - e * math.sin(phi) ** 2)
    x, y, z = across * math.cos(phi) * math.cos(lam), across * math.cos(phi) * math.sin(lam), across * (1 - e) * math.sin(phi)
    rx, ry, rz = (math.radians(r / 3600) for r in (s.rx, s.ry, s.rz))
    k = 1 + s.ppm * 1e-6
    x, y, z = s.dx + k * (x - rz * y + ry * z), s.dy + k * (rz * x + y - rx * z), s.dz + k * (-ry * x + rx * y + z)
    e = e2(geo.WGS84_INVERSE_FLATTENING)
    for _ in range(30):
        across = geo.WGS84_SEMI_MAJOR / math.sqrt(1 - e * math.sin(phi) ** 2)
        phi = math.atan2(z + e * across * math.sin(phi), math.hypot(x, y))
    return math.degrees(phi), math.degrees(math.atan2(y, x))


@pytest.mark.parametrize(
    "shift", [geo.DatumShift(-0.99, 1.9, 0.52, 0.026, 0.009, 0.012, -0.0006), geo.DatumShift(100.0, -200.0, 300.0, 1.0, -2.0, 3.0, 5.0)]
)
def test_datum_shift_equals_plain_code(spark, shift):
    points = [(37.5, -122.25), (34.1, -118.3), (-60.0, 170.0), (0.0, 0.0), (89.0, 45.0)]
    df = spark.createDataFrame(points, "lat double, lon double")
    lat, lon = geo.shifted(F.col("lat"), F.col("lon"), shift)
    for (a, b), row in zip(points, df.select(lat.alias("lat"), lon.alias("lon")).collect(), strict=True):
        want = plain_shift(a, b, shift)
        assert row.lat == pytest.approx(want[0], abs=1e-9) and row.lon == pytest.approx(want[1], abs=1e-9)


def test_no_datum_shift_changes_nothing(spark):
    df = spark.createDataFrame([(6042000.0, 2133000.0), (None, 1.0)], "global_x double, global_y double")
    today = clean.reproject(df, "EPSG:2227").collect()
    assert clean.reproject(df, "EPSG:2227", geo.DatumShift()).collect() == today
    assert clean.reproject(df, "EPSG:2227", geo.DatumShift(dx=1.0)).collect()[1].lat is None

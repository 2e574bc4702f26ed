import pytest
from pyspark.sql import functions as F

from recordloom.functions import geo, scalars
from recordloom.functions.text import stem


def test_years(values):
    cases = {
        "1900 f.kr": -1899, "1 f.kr": 0, "0 f.kr": None, "-1 f.kr": None, "1900 a.kr": None, "1900 e.kr": 1900,
        "0 e.kr": 0, "-1997-05-03": -1997, "1900 F.Kr": -1899, "2010": 2010, "2010-02-30": None, "2010-13-01": None,
        "2012-02-29": 2012, "2010-01-02T10:11": 2010, "x": None, "": None, None: None, "2010-366": None, "2012-366": 2012,
        "9999999999": None, "400-200": 400,
    }
    assert values(list(cases), scalars.year_of("v")) == list(cases.values())


def test_tidy_year(values):
    cases = {"19000": "1900", "900": "900", "-1000": "-1000", "-10000": "-9999"}
    assert values(list(cases), scalars.tidy_year("v")) == list(cases.values())


def test_decade_and_century(values):
    decades = {1987: 1980, 154: 150, 4: 0, -4: -10, -54: -60, -154: -160, -20: -30, 0: 0}
    centuries = {1987: 1900, 54: 0, -54: -100, -154: -200}
    assert values(list(decades), scalars.decade("v"), "int") == list(decades.values())
    assert values(list(centuries), scalars.century("v"), "int") == list(centuries.values())


def expanded(first, last):
    """Plain reading of the interval rule, for comparison."""
    def down(year, size):
        return int(year / size) * size - (size if year < 0 else 0)

    def tidy(text):
        return "-9999" if len(text) > 5 and text[0] == "-" else text[:4] if len(text) > 4 and text[0] != "-" else text

    first, last = first or last, last or first
    start, stop = max(int(tidy(first)), -1999), min(int(tidy(last)), 2010)
    out, d, c = [], down(start, 10), down(start, 100)
    for i, year in enumerate(range(start, stop + 1, 10)):
        d = down(year, 10)
        out.append(("decade", d))
        if i % 10 == 0:
            c = down(year, 100)
            out.append(("century", c))
    if d != down(stop, 10) and stop > -1999:
        out.append(("decade", down(stop, 10)))
    if c != down(stop, 100) and stop > -1999:
        out.append(("century", down(stop, 100)))
    return sorted(out)


@pytest.mark.parametrize("first,last", [
    ("1540", None), (None, "1540"), ("1895", "1912"), ("-5", "7"), ("-12345", "-1995"), ("2005", "2044"), ("1900", "1850"),
    ("-2500", "-2100"), ("15401", "1550"),
])
def test_interval(spark, first, last):
    row = spark.createDataFrame([(first, last)], "f string, t string").select(scalars.decades_between("f", "t").alias("e"))
    assert sorted((e["index"], e["value"]) for e in row.first().e) == expanded(first, last)


def test_interval_that_is_no_year(spark):
    row = spark.createDataFrame([("soon", None), (None, None)], "f string, t string")
    assert [r.e for r in row.select(scalars.decades_between("f", "t").alias("e")).collect()] == [None, None]


def test_versions(values):
    cases = {
        "0.97": "1.0", "1.0": "1.0", "1.0.0": "1.0", "1.1": "1.1", "1.1.0": "1.1", "1.11": "1.11", "1.2": "1.2.0",
        "1.2.0": "1.2.0", "1.3.0": "1.3.0", "1.4": None, "1": None, "1.x": None, "1.0.1": None, "0.0": "1.0", None: None,
    }
    assert values(list(cases), scalars.rule_set("v")) == list(cases.values())


def test_query_map(values):
    got = values(["a=1&b=x%20y&c=&d=p=q&a=2", "", None, "k"], scalars.query_map("v"))
    assert got == [{"a": "2", "b": "x y", "d": "p=q"}, {}, None, {}]


def test_texts(values):
    assert values([" a\t", " \n ", None], scalars.blank_to_null("v")) == ["a", None, None]
    assert values(["50%_*?\\"], scalars.like_escape("v")) == ["50\\%\\_%_\\\\"]
    assert scalars.like_pattern("50%_*?\\") == "50\\%\\_%_\\\\"
    assert values(["http://a/b/c", "c"], scalars.insert_format("v", F.lit("xml"))) == ["http://a/b/xml/c", "xml/c"]
    assert values(["p/01", "p/x1", "q/1"], scalars.suffix_after("v", "p/", number=True)) == ["1", "x1", None]
    paths = values(["/o/s/1", "/o/s/XML/1", "/o/1", "/o/s/x.y"], scalars.path_parts("v"))
    assert [p and tuple(p) for p in paths] == [("o/s/1", None), ("o/s/1", "xml"), None, None]


def test_run_figures(values):
    assert values([999, 10_000], scalars.speed(F.lit(25), "v"), "long") == [25.0, 2.5]
    assert values([0, 50], scalars.remaining(F.lit(1000), "v", F.lit(200)), "long") == [-1, 3000]
    assert values([3_661_999], scalars.duration("v"), "long") == ["01:01:01"]


def test_swedish_stems(values):
    # words of the published sample vocabulary of the stemmer
    cases = {
        "jaktkarlarne": "jaktkarl", "jaktkarlens": "jaktkarl", "klok": "klok", "klokare": "klok", "klokaste": "klok",
        "klostrets": "klostret", "kloster": "klost", "friskt": "frisk", "fullt": "full", "bilar": "bil", "ö": "ö",
    }
    got = dict(zip(cases, values(list(cases), stem("v"))))
    assert got["klokare"] == "klok" and got["klokaste"] == "klok" and got["bilar"] == "bil" and got["ö"] == "ö"
    assert got["jaktkarlarne"] == "jaktkarl" and got["jaktkarlens"] == "jaktkarl"


def test_projection_of_known_points(spark):
    # published check point of the national survey: lat 66, lon 24 in both systems
    rows = spark.createDataFrame([(3006, 909_000.0, 7_339_000.0)], "epsg int, x double, y double")
    lon, lat = geo.to_wgs84_any("x", "y", "epsg")
    got = rows.select(lon.alias("lon"), lat.alias("lat")).first()
    east, north = forward(got.lon, got.lat, 3006)
    assert abs(east - 909_000) < 0.01 and abs(north - 7_339_000) < 0.01
    assert 23 < got.lon < 25 and 65 < got.lat < 67


def forward(lon, lat, code):
    """Forward projection of the same series, to check the inverse."""
    import math

    p = geo.PROJECTIONS[code]
    f = 1 / 298.257222101
    e2, n = f * (2 - f), f / (2 - f)
    unit = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    a, b = e2, (5 * e2**2 - e2**3) / 6
    c, d = (104 * e2**3 - 45 * e2**4) / 120, 1237 * e2**4 / 1260
    beta = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280,
    ]
    phi, dl = math.radians(lat), math.radians(lon - p.meridian)
    s = math.sin(phi)
    phi_s = phi - s * math.cos(phi) * (a + b * s**2 + c * s**4 + d * s**6)
    xi, eta = math.atan2(math.tan(phi_s), math.cos(dl)), math.atanh(math.cos(phi_s) * math.sin(dl))
    north = xi + sum(k * math.sin(2 * i * xi) * math.cosh(2 * i * eta) for i, k in enumerate(beta, 1))
    east = eta + sum(k * math.cos(2 * i * xi) * math.sinh(2 * i * eta) for i, k in enumerate(beta, 1))
    return p.scale * unit * east + p.false_easting, p.scale * unit * north + p.false_northing


@pytest.mark.parametrize("lon,lat,code", [(18.07, 59.33, 3006), (11.97, 57.71, 3006), (15.81, 58.0, 3021), (20.2, 67.8, 3021)])
def test_projection_round_trip(spark, lon, lat, code):
    x, y = forward(lon, lat, code)
    out = spark.range(1).select(*[c.alias(n) for c, n in zip(geo.to_wgs84(F.lit(x), F.lit(y), code), ("lon", "lat"))]).first()
    assert abs(out.lon - lon) < 1e-7 and abs(out.lat - lat) < 1e-7


def test_wgs84_point_is_kept(spark):
    point = spark.range(1).select(*geo.to_wgs84(F.lit(18.072394042188), F.lit(59.3270266104628), "WGS84")).first()
    assert tuple(point) == (18.072394042188, 59.3270266104628)
    with pytest.raises(ValueError):
        geo.epsg_code("EPSG:9999")


def test_bounds_of_decades_are_parameters(values):
    def found(low, high, **bounds):
        entries = values([(low, high)], scalars.decades_between(F.col("v._1"), F.col("v._2"), **bounds), "struct<_1:string,_2:string>")[0]
        return [(e["index"], e["value"]) for e in entries]

    assert found("2015", "2015") == []  # the default bounds are those of the older system
    assert found("2015", "2021", last_year=2100) == [("decade", 2010), ("century", 2000), ("decade", 2020)]
    assert found("1015", "1021", first_year=1020) == [("decade", 1020), ("century", 1000)]

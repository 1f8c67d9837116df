from pyspark.sql import functions as F

from casegraph.functions import text as tx
from casegraph.functions import values as vl
from casegraph.operators.govern import INFO_GRADES, SOURCE_GRADES, grade
from casegraph.operators.graph import parse_kind, risk_band


def column(spark, make, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_fingerprints(spark):
    assert column(spark, tx.short_ref, "abc", "João Silva", "") == ["01510db89efd", "bb52b868792e", f"{1469598103934665603 & (1 << 48) - 1:012x}"]
    assert column(spark, tx.short_token, " João Silva ") == ["26c92e"]


def test_chain_hash_is_the_64_bit_hash(spark):
    h = 1469598103934665603
    for b in "genesisé|x".encode():
        h = ((h ^ b) * 1099511628211) & (1 << 64) - 1
    assert column(spark, lambda v: tx.chain_hash(F.lit("genesis"), v), "é|x") == [f"{h:016x}"]


def test_indicators(spark):
    got = column(spark, tx.indicators, "see (https://a.example/x), me@b.example; 1.2.3.4 | report.txt 300.1.1.1 0x" + "a" * 40 + " " + "f" * 32)[0]
    assert [(r["kind"], r["raw"]) for r in got] == [("url", "https://a.example/x"), ("account", "me@b.example"), ("ip", "1.2.3.4"), ("domain", "report.txt"), ("wallet", "0x" + "a" * 40), ("media", "f" * 32)]


def test_value_classes(spark):
    cells = ["$1,250.00", "2026-01-05T10:11:00Z", "a@b.example", "10.0.0.1", "", "2026-01-05", "-1234.56", "123.456.789-01", "0", "report.txt", "Ann Lee", "42", "some words here 4"]
    assert column(spark, vl.classify_value, *cells) == ["money", "date", "email", "ip", "empty", "phone", "date", "national_id", "boolean", "domain", "person_name", "number", "free_text"]


def test_hosts(spark):
    assert column(spark, tx.url_host, "https://https://CDN.example.net/f", "www.x.org?q", "localhost/x") == ["cdn.example.net", "x.org", None]
    assert column(spark, tx.registrable_domain, "m.a.example.co.uk", "example.org.", "one") == ["co.uk", "example.org", ""]
    assert column(spark, tx.ip_scope, "127.0.0.1", "172.16.0.1", "172.32.0.1", "169.254.1.1", "x") == ["loopback", "private", "public", "link-local", "unknown"]


def test_times(spark):
    assert column(spark, tx.time_bucket, "2026-01-05T10:11:00Z", "05/01/2026", "1999-01-01", "x") == [228634, None, -(-(((-1 * 365 + 31 + 1) * 24) * 60) // 60), None]
    assert column(spark, tx.iso_hour, "2026-01-05T09:11", "2026-01-05 23:00", "2026-01-05T25:00", "x") == ["09", "23", None, None]


def test_similarity(spark):
    pair = lambda f, a, b: spark.range(1).select(f(F.lit(a), F.lit(b)).alias("x")).first()["x"]
    assert pair(tx.jaccard, "a b c", "c b d") == 0.5
    assert pair(tx.edit_sim, "abcdef", "abcxef") == 1 - 1 / 6
    assert pair(tx.edit_sim, "ab", "abcdef") == 0.0
    assert pair(tx.str_sim, "John Smith", "Jon Smyth") == 0.8
    assert pair(tx.hex_distance, "0xff00", "0f00") == 4
    assert pair(tx.hex_distance, "ff", "ff00") is None
    assert abs(spark.range(1).select(tx.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("x")).first()["x"] - 111.195080) < 1e-6


def test_plain(spark):
    assert column(spark, tx.plain, "  João  da SILVA-x! ") == ["joao da silvax"]


def test_geo(spark):
    df = spark.createDataFrame([({"GPS Latitude": "10.5", "Longitude": "20,x"},), ({"place": "1.5, 2.5"},), ({"lat": "100", "lon": "1"},), ({"a": "b"},)], "m map<string,string>")
    assert [(g and (g["lat"], g["lon"])) for g in (r["g"] for r in df.select(tx.geo_of(F.col("m")).alias("g")).collect())] == [(10.5, 20.0), (1.5, 2.5), None, None]


def test_masks(spark):
    got = column(spark, tx.mask_value, "Ann Lee", "call +1-555-123-4567 now", "id 123-45-6789", "mail a@b.example")
    assert got[0].startswith("PERSON-") and got[1] == "call [phone] now" and got[2] == "id [id]" and got[3].startswith("mail [email:")


def test_check_digits(spark):
    assert column(spark, vl.valid_cpf, "52998224725", "52998224724", "11111111111", "x") == [True, False, False, False]
    assert column(spark, vl.valid_ssn, "123-45-6789", "000-45-6789", "123-00-6789") == [True, False, False]


def test_grades_keep_the_order_of_tests(spark):
    assert column(spark, lambda v: grade(v, SOURCE_GRADES), "not usually reliable", "D", "unreliable", "?") == ["B", "D", "E", None]
    assert column(spark, lambda v: grade(v, INFO_GRADES), "unconfirmed", "doubtful") == ["1", "4"]


def test_kinds_and_bands(spark):
    assert column(spark, parse_kind, "CVE", " ship ", "person", "?") == ["vulnerability", "vessel", "person", "unknown"]
    assert column(spark, lambda v: risk_band(v.cast("double")), "0.85", "0.6", "0.35", "0.1") == ["critical", "high", "medium", "low"]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r["x"], 6) for r in df.select(tx.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [0.707107, 0.0, 0.0]

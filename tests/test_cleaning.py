import pytest
from pyspark.sql import functions as F

from kinweave.functions import cleaning as C
from kinweave.functions.similarity import jaro_winkler_of, jw_distance, nysiis_of, register, soundex_key


def values(spark, data, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", column.alias("o")).orderBy("i").select("o").collect()]


def test_clean_name(spark):
    assert values(spark, ["OTTO ULM SR", "  IDA   HAL-EZ II ", "EDITH Quilez", None, ""], C.clean_name(F.col("v"))) == ["OTTO ULM", "IDA HALEZ", "EDITH Q", "", ""]


def test_checks(spark):
    assert values(spark, ["\tulm ", " b7", None], C.check(F.col("v"), "")) == ["\tULM", "B7", ""]
    assert values(spark, ["-4.5", "70", "7 years", None], C.check(F.col("v"), "Numeric")) == ["-4.5", "70", "", ""]
    assert values(spark, ["71-2-28", "03-12-9", "71-2-30", None], C.check(F.col("v"), "Date - %y-%m-%d")) == ["1971-02-28", "2003-12-09", "", ""]
    assert values(spark, ["4/1/1961", "21/04/1961", "02/29/1900"], C.check(F.col("v"), "Date - %m/%d/%Y")) == ["1961-04-01", "", ""]
    assert values(spark, ["x", "y", "xy", ""], C.check(F.col("v"), "y,x")) == ["x", "y", "", ""]


def test_set_missing_and_drops(spark):
    data = ["hello", "NA", "0000", None]
    assert values(spark, data, C.set_missing(F.col("v"), ["NA", "0000"])) == ["hello", "", "", ""]
    assert values(spark, data, C.in_drop_list(F.col("v"), ["NA"])) == [False, True, False, False]
    assert values(spark, data, C.auto_drop([{"v": "NA"}, {"v": "x"}])) == [False, True, False, False]


def test_geography(spark):
    assert values(spark, ["1,2", "12", "", None], C.geo_single(F.col("v"))) == ["1,2", "", "", ""]
    assert values(spark, [" 1", None], C.geo_pair(F.col("v"), F.lit("3"))) == ["1,3", ""]


@pytest.mark.parametrize(
    "text,expected",
    [("123 Main St.", ("123", "main", "street")), ("123 Broadway", ("123", "broadway", "")), ("", ("", "", "")), ("123 MAIN STREET", ("123", "main", "street")), ("Twelve Forbes Ave", ("12", "forbes", "avenue")), ("REDACTED", ("", "", "")), (None, ("", "", ""))],
)
def test_parse_address(spark, text, expected):
    assert tuple(values(spark, [text], C.parse_address(F.col("v")))[0]) == expected


def test_keys(spark):
    b = values(spark, ["SAM::LEE::1990-01-02"], C.name_part(F.col("v")))[0]
    assert b == "SAM::LEE"
    assert values(spark, ["SAM::LEE::1990-01-02"], C.date_part(F.col("v"))) == ["1990-01-02"]
    assert values(spark, ["7"], C.record_key("a", F.col("v"))) == ["a__7"]
    assert values(spark, ["MC COY-LEE"], C.last_name_prep(F.col("v"))) == ["MCCOY LEE"]


def test_jaro_winkler():
    assert jaro_winkler_of("", "") == 1.0 and jaro_winkler_of("A", "") == 0.0
    # a window of half the shorter string, the similarity rounded half to even
    assert round(1 - round(jaro_winkler_of("hicks", "hacks"), 2), 2) == 0.12
    assert round(1 - round(jaro_winkler_of("poplar", "forbes"), 2), 2) == 0.44
    assert round(1 - round(jaro_winkler_of("marcus", "mark"), 2), 2) == 0.18
    assert round(1 - round(jaro_winkler_of("1665", "1865"), 2), 2) == 0.15
    assert abs(jaro_winkler_of("MARTHA", "MARHTA", 2) - 0.9611) < 1e-4


def test_codes(spark):
    known = {"WORTHY": "WARTY", "OGATA": "OGAT", "MONTGOMERY": "MANTGANARY", "CATHERINE": "CATARAN", "KATERINA": "CATARAN", "JONATHAN": "JANATAN", "TERESA": "TARAS", "MACARTHUR": "MCARTAR", "PHEENARD": "FANAD", "KNOKO": "NAC", "": ""}
    assert {n: nysiis_of(n) for n in known} == known
    assert values(spark, ["1665", "Robert", "RUPERT"], soundex_key(F.col("v"))) == ["1000", "R163", "R163"]
    df = spark.createDataFrame([("PETER", "PETER"), (None, "A")], "a string, b string")
    assert [r[0] for r in df.select(jw_distance("a", "b")).collect()] == [0.0, None]
    register(spark)
    assert spark.sql("SELECT kw_nysiis('TERESA') = kw_nysiis('THERESA')").first()[0]
    texts = ["OTTO ULM SR", " IDA  HAL-EZ II ", "12 Elm Road", "Seven Oak Ter", "7 Oak St.", "redacted", "", None]
    df = spark.createDataFrame([(x,) for x in texts], "v string")
    df.createOrReplaceTempView("typed_texts")
    want = df.select(C.clean_name(F.col("v")), C.parse_address(F.col("v"))).collect()
    assert [tuple(r) for r in spark.sql("SELECT kw_clean_name(v), kw_parse_address(v) FROM typed_texts").collect()] == [tuple(r) for r in want]

import pytest

from kinweave.llm.streets import address_parts, split_address, street_types


@pytest.mark.parametrize(
    "text,towns,expected",
    [
        ("25 midinizam street nogopoham 100001", {"NOGOPOHAM"}, ("25", "", "MIDINIZAM", "STREET", "100001")),
        ("NO 25 MIDINIZAM STR", set(), ("25", "", "MIDINIZAM", "STREET", "")),
        ("12 St. Tetobofir Boulevard, 100003", set(), ("12", "", "SAINTTETOBOFIR", "BOULEVARD", "100003")),
        ("Five North Lwr Fid-itatus Rd; Apt. 3", set(), ("5", "N", "LOWERFIDITATUS", "ROAD", "")),
        ("11 Road 60", set(), ("60", "", "11TH", "ROAD", "")), ("45 Third Ave", set(), ("45", "", "3RD", "AVENUE", "")), ("01622 N. Binabozu Avenue, Unit 1A", set(), ("1622", "N", "BINABOZU", "AVENUE", "")),
        ("no fixed address", set(), ("", "", "", "", "")), ("", set(), ("", "", "", "", "")), (None, set(), ("", "", "", "", "")),
    ],
)
def test_split_address(text, towns, expected):
    assert split_address(text, towns) == expected


def test_types_of_the_helper_table(spark):
    table = spark.createDataFrame([("Mews", "mws"), ("Street", "strasse"), ("Road", "STREET"), (None, "x"), ("Gate", None)], "type_name string, written string")
    types = street_types(table)
    assert types["MWS"] == "MEWS" and types["STRASSE"] == "STREET" and types["STREET"] == "STREET" and types["AVE"] == "AVENUE"
    assert address_parts("7 Oak Mws", types=types)[3] == "MEWS" and address_parts("7 Oak Mws")[3] == "" and street_types(None)["ST"] == "STREET"

import pytest

from tessera.functions import text

NAMES = [
    ("Raab Modern Treasury, LLC", "raab modern treasury llc", "raab modern treasury", "llc", 0),
    ("raabmoderntreasury.com", "raabmoderntreasury", "raabmoderntreasury", "", 1),
    ("Reliable Digital Collective P.L.L.C.", "reliable digital collective pllc", "reliable digital collective", "pllc", 0),
    ("-- Holloway Peak Inc Seafood", "holloway peak inc seafood", "holloway peak seafood", "inc", 0),
    ("Indo 5ky Energy", "indo sky energy", "indo sky energy", "", 0),
    ("Tavozephdelta dba Perfect Technology Pvt Ltd", "perfect technology pvt ltd", "perfect technology", "ltd pvt", 0),
    ("<< Team Ecole", "team ecole", "team ecole", "", 0),
    ("ELDER & (PUCKETT)", "elder and puckett", "elder puckett", "", 0),
    ("Payne Énterprises", "payne enterprises", "payne enterprises", "", 0),
    ("The And Of LLC", "the and of llc", "the and of llc", "llc", 0),
    (None, "", "", "", 0),
]
ADDRESSES = [
    ("2670- DUMBLE SAINT, TX, ALVIN", "US", "2670 dumble st alvin", "2670", "2670", "dumble", "alvin", "tx"),
    ("PITTSFIEDL, ME, 01466 MAIN ST", "US", "pittsfiedl 1466 main st", "1466", "1466", "main", "pittsfiedl", "me"),
    ("##1138 Jamison Ave, Roanoke City, Virginia", "US", "1138 jamison ave roanoke city", "1138", "1138", "jamison", "roanoke", "va"),
    ("32623 224st Pl, Black Diamond, Washington", "US", "32623 224 pl black diamond", "32623 224", "32623", "", "black diamond", "wa"),
    ("3315 FREMONT ST, null, PEORIA, IL", "US", "3315 fremont st peoria", "3315", "3315", "fremont", "peoria", "il"),
    ("29 Bd. De La Libération, Saint-nazaire", "France", "29 blvd de la liberation st nazaire", "29", "29", "de la liberation", "nazaire", ""),
    ("12 All. Jean-jacques Rousseau, Saint-nazaire, Pays de la Loire", "France", "12 allee jean jacques rousseau st nazaire", "12", "12", "jean jacques rousseau", "nazaire", "pdl"),
    ("10, New Delhi, DL", "India", "10", "10", "10", "", "", "dl"),
    ("10, New Delhi, DL", None, "10 dl", "10", "10", "", "dl", "dl"),
    ("", "US", "", "", "", "", "", ""),
    (None, None, "", "", "", "", "", ""),
]


def test_names(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(NAMES)], "i int, raw string")
    for r in text.normalise_names(df, "raw").collect():
        assert (r.name_clean, r.name_core, r.legal, r.is_domain) == NAMES[r.i][1:], NAMES[r.i][0]
    first = text.normalise_names(df.where("i = 0"), "raw").first()
    assert (first.name_sorted, first.name_concat) == ("modern raab treasury", "raabmoderntreasury")


def test_addresses(spark):
    df = spark.createDataFrame([(i, x[0], x[1]) for i, x in enumerate(ADDRESSES)], "i int, raw string, country string")
    for r in text.normalise_addresses(df, "raw", "country").collect():
        assert (r.addr_clean, r.addr_nums, r.house, r.street, r.city, r.state) == ADDRESSES[r.i][2:], ADDRESSES[r.i][0]
        assert r.postcode == ""


def test_postcode_is_the_first_six_digit_token(spark):
    df = spark.createDataFrame([("Plot 7, Pune 411001 400002, MH",)], "raw string")
    assert text.normalise_addresses(df, "raw").first().postcode == "411001"


def test_a_six_digit_house_is_a_postcode_only_where_codes_have_six_digits(spark):
    df = spark.createDataFrame([("120000 Main St, TX", "US"), ("120000 Rue Foch", "France"), ("Plot 7, Pune 411001", "India")], "raw string, country string")
    assert [(r.house, r.postcode) for r in text.normalise_addresses(df, "raw", "country").collect()] == [("120000", ""), ("120000", ""), ("7", "411001")]


@pytest.mark.parametrize(("raw", "latin"), [("abc", True), ("é", True), ("दिल्ली", False)])
def test_is_latin(spark, raw, latin):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(text.is_latin(df.x)).first()[0] is latin


def test_learned_tokens_come_before_the_fallback(spark):
    assert text.to_latin("दिल्ली, x", {"दिल्ली": "delhi"}) == "delhi, x"
    assert text.to_latin("नाडु", {"नाडु": "nadu"}) == "tamil nadu"
    assert text.to_latin("αβ", {}).isascii()

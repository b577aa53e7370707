"""Text, rule and money functions on literal cases."""

import re

import pytest
from pyspark.sql import functions as F

from bazaarflow import vocab
from bazaarflow.functions import money, rules, text
from bazaarflow.operators import geo
from bazaarflow.plans import normalise

L = F.lit


def test_strip_html(one):
    html = "<div><script>if (a<b) {}</script><style>p{}</style>Fish &amp; chips<br>\n <b>today</b>&nbsp;!</div>"
    assert one(text.strip_html(L(html))) == "Fish & chips today !"
    assert one(text.page_text(L("<nav>menu</nav><p>Hello</p><footer>x</footer><!-- c -->"))) == "Hello"


def test_control_characters(one):
    assert one(text.drop_control(L("a\x00b\x07c\td"))) == "abc\td"


def test_titles(one):
    assert one(text.marketing_title(L("Rome Tour 2024 | Viator"))) == "Rome Tour"
    assert one(text.navigation_title(L("Home > Old Town Walk"))) == "Old Town Walk"
    assert one(text.navigation_title(L("Menu"))) == ""
    assert one(text.is_good_title(L("1234567890 12345"))) is False


def test_description_noise(one):
    d = "A long walk through the old town with friends. Short one. Book now and save a lot of money today. More text here to read."
    assert one(text.clean_description(L(d))) == "A long walk through the old town with friends"


def test_noise_equals_plain_chain(spark):
    """The word test before each pattern never changes the result."""
    texts = ["Free   cancellation up to now", "we say BOOK NOW here", "from $5 per person and more", "nothing of the kind",
             "best food in Rome 2024 and updated March 2023", "what's included: all", "free from $5 per person cancellation x"]
    patterns = (*vocab.BOOKING_NOISE, *vocab.SEO_NOISE)
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.blank_patterns(F.col("t"), patterns).alias("v"))
    for row in out.collect():
        expected = row["t"]
        for p in patterns:
            expected = re.sub(p, " ", expected, flags=re.IGNORECASE)
        assert row["v"] == expected


def test_fold_and_slug(one):
    assert one(text.fold(L("Tromsø Évora São"))) == "Troms Evora Sao"
    assert one(text.slug_text(L(" L'Été à Fès! "))) == "l ete a fes"


@pytest.mark.parametrize("url,expected", [
    ("https://www.Shop.example/a?b", "shop.example"), ("shop.example?x=1", "shop.example"), ("http://m.shop.example#t", "m.shop.example"), (None, "")])
def test_host(one, url, expected):
    assert one(text.host(L(url).cast("string"))) == expected


def test_english(one):
    assert one(text.is_likely_english(L("a guided tour of the old city"))) is True
    assert one(text.is_likely_english(L("visite guidée avec vue sur mer"))) is False
    assert one(text.is_likely_english(L("été à é"))) is False


def test_words_next_to_accents_do_not_count(one):
    assert one(text.ascii_words(L("musée museum étoile"), 3)) == ["museum"]


@pytest.mark.parametrize("raw,amount,currency", [
    ("45€", 45.0, "EUR"), ("From $120", 120.0, "USD"), ("USD 99.00", 99.0, "USD"), ("120 TND", 120.0, "TND"), ("", None, "EUR"), (None, None, "EUR"), ("0.5 €", None, "EUR")])
def test_parse_price(one, raw, amount, currency):
    got = one(money.parse_price(L(raw).cast("string")))
    assert (got["amount"], got["currency"]) == (amount, currency)


def test_durations(one):
    assert one(money.minutes_first(L("1.5 hours"))) == 90
    assert one(money.minutes_first(L("2 days"))) == 960
    assert one(money.minutes_sum(L("1 hour 30 minutes"))) == 90
    assert one(money.minutes_sum(L("2 days"))) == 2880
    assert one(money.minutes_sum(L("soon"))) is None


def test_process_price(spark):
    rows = [(1, 100.0, "USD", ""), (2, 5500.0, "EUR", ""), (3, 7000.0, "EUR", "only €20"), (4, None, None, "only €20"), (5, 2.0, "EUR", ""), (6, None, "EUR", "free")]
    df = spark.createDataFrame(rows, "id int, price double, currency string, body string")
    got = {r["id"]: (r["eur"], r["estimated"]) for r in money.process_price(df, "price", "currency", F.col("body")).collect()}
    assert got == {1: (92.0, False), 2: (5500.0, True), 3: (None, True), 4: (20.0, False), 5: (None, True), 6: (None, True)}


def test_conversion_is_fixed_point(spark):
    df = spark.createDataFrame([(1, 230.1, "usd"), (2, 10.0, "XYZ"), (3, None, "EUR")], "id int, amount double, currency string")
    out = {r["id"]: r["eur"] for r in money.to_eur(df, money.rates_table(spark), "amount", "currency").collect()}
    assert out == {1: 211.69, 2: 10.0, 3: None}


def test_rule_order_and_word_match(one):
    assert one(rules.first_label(L("airport transfer with museum entry"), vocab.ACTIVITY_RULES, "EXCURSION")) == "TRANSFER"
    assert one(rules.first_label(L("nothing"), vocab.ACTIVITY_RULES, "EXCURSION")) == "EXCURSION"
    assert one(rules.has_any(L("a party"), ["art"])) is True
    assert one(rules.has_any(L("a party"), ["art"], "word")) is False
    assert one(rules.has_any(L(None).cast("string"), ["art"] * 20)) is False


def test_long_rules_equal_short_rules(spark):
    """Both forms of first_label agree."""
    texts = ["museum of art", "boat and wine", "golf", "spa yoga", "", "transfer to museum"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    long = [r[0] for r in df.select(rules.first_label(F.col("t"), vocab.CATEGORY_RULES, "NONE")).collect()]
    expected = [next((label for kws, label in vocab.CATEGORY_RULES if any(k in t for k in kws)), "NONE") for t in texts]
    assert long == expected


def test_service_by_score(one):
    assert one(rules.scored_label(L("scuba diving and snorkeling adventure"), vocab.SERVICE_VOCABULARY, 0.02, "TOUR")) == "EXPERIENCE"
    assert one(rules.scored_label(L("x"), vocab.SERVICE_VOCABULARY, 0.02, "TOUR")) == "TOUR"


def test_garbage_cities(spark):
    cases = {"Rome": False, "Tours": True, "Morocco": True, "XX": True, "Louvre museum": True, "museum": False, "": True, None: True}
    df = spark.createDataFrame([(k,) for k in cases], "c string").select("c", geo.is_garbage_city(F.col("c")).alias("g"))
    assert {r["c"]: r["g"] for r in df.collect()} == cases


def test_route(one):
    r = one(normalise.route_of(L("Private transfer from Rome City to Naples now"), L("TRANSFER")))
    assert (r["origin"], r["destination"], r["signature"]) == ("Rome City", "Naples", "Rome City → Naples")
    assert one(normalise.route_of(L("from a to b "), L("TICKET")))["origin"] is None


def test_corrections(spark):
    df = spark.createDataFrame([("EXCURSION", "NAUTIQUE", "Oslo", "Italy", 9999.0, "Golf in Stockholm"), ("TICKET", "CULTUREL", "", "France", 5.0, "Museum ticket")],
                               "activity string, category string, city string, country string, price double, body string")
    a, b = normalise.correct_labels(df).collect()
    assert (a["category"], a["country"], a["price"], a["corrections"]) == ("SPORT", "Sweden", 2000.0, ["category", "country", "price"])
    assert (b["category"], b["was_corrected"]) == ("HISTORIQUE", True)


def test_address_split(one):
    got = one(geo.split_country_city(L("Italie - Rome")))
    assert (got["city"], got["country"]) == ("Rome", "Italie")
    assert one(geo.fill_from_address(L(""), L(""), L("Rome, Italy"))).asDict() == {"city": "Rome", "country": "Italy"}
    assert one(geo.numeric_or_null(L("12.5"))) == 12.5
    assert one(geo.numeric_or_null(L("n/a"))) is None


@pytest.mark.parametrize("line, good", [
    ("de señales abcdefgh ijkl", False), ("menué of the day today", False), ("ſkip to main abcdefg", False), ("bacK to abcdefg hijk", False),
    ("de\u000bse abcdefgh ijklmn", True), ("12 results\r", True), ("de se abcdefgh ijklmn", False), ("de sella abcdefgh ijkl", True)])
def test_noise_patterns_are_read_as_in_sql(one, line, good):
    import duckdb

    from bazaarflow.plans.sqltext import any_match

    assert one(text.is_good_title(L(line))) is good
    assert one(rules.matches_any(L(line), vocab.NAVIGATION_NOISE, "(?i)")) is not good
    assert duckdb.execute(f"SELECT {any_match('x', vocab.NAVIGATION_NOISE, 'i')} FROM (SELECT $1 AS x)", [line]).fetchone()[0] is not good


def test_words_a_route_pattern_needs():
    from bazaarflow import vocab
    from bazaarflow.functions import rules

    needed = [rules.required_choices(p) for p in vocab.ROUTE_PATTERNS]
    assert ["transfer", "transport", "shuttle", "navette"] in needed[0]
    assert ["airport"] in needed[1] and ["to", "à", "→"] in needed[1]
    assert needed[2][0] == ["transfer", "transport"]
    assert rules.required_choices("(?:ab|cd)?x") == rules.required_choices("(?i)abc") == rules.required_choices("abc|def") == []

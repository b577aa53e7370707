"""Scoring functions: known cases and properties."""

import itertools

import pytest
from pyspark.sql import functions as F

from bazaarflow.functions import similarity as sim

L = F.lit


def text(x):
    return F.lit(x).cast("string")


def test_title_cases(one):
    assert one(sim.title_score(L("Transfer from Fiumicino Airport to Rome"), L("Transfer Fiumicino-Rome"),
                               L("Transfer Fiumicino Airport to Rome hotel"), L("EXCURSION"))) > 0.6
    assert one(sim.title_score(L("Arctic Fox Safari Tromsø"), L("Marrakech Medina Walk"), L("Marrakech Medina Walking Tour"), L("EXCURSION"))) < 0.3


def test_opposite_transfer_directions(one):
    arrival, departure = L("Transfer from Fiumicino Airport to Rome"), L("Transfer from Rome to Fiumicino Airport")
    assert one(sim.title_score(arrival, departure, text(None), L("TRANSFER"))) == pytest.approx(0.1)
    assert one(sim.title_score(arrival, arrival, text(None), L("TRANSFER"))) == 1.0


@pytest.mark.parametrize("title,way", [
    ("Transfer from Fiumicino Airport to Rome", "ARRIVAL"), ("Departure Transfer Rome Hotel to Airport", "DEPARTURE"),
    ("Transfer from Paris to CDG Airport", "DEPARTURE"), ("Rome City Tour", "UNKNOWN")])
def test_direction(one, title, way):
    assert one(sim.transfer_direction(L(title))) == way


@pytest.mark.parametrize("a,b,low,high", [
    ("Rome", "Rome", 1, 1), ("Rome", "Roma", 0.8, 1), ("Fes", "Fez", 0.6, 1), ("Tromsø", "Tromso", 0.8, 1), ("Paris", "Paris CDG", 0.7, 1),
    ("Rome", "Paris", 0, 0), ("", "Paris", 0, 0), (None, "Paris", 0, 0), ("Évora", "EVORA", 1, 1)])
def test_city(spark, a, b, low, high):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    score = sim.with_city_score(df, "a", "b").first()["city_score"]
    assert low <= score <= high


@pytest.mark.parametrize("a,b,expected", [
    ("HISTORIQUE", "CULTUREL", 0.6), ("NATURE", "AVENTURE", 0.6), ("TRANSPORT", "HISTORIQUE", 0), ("CULTUREL", "CULTUREL", 1),
    ("CULTUREL", "City Tour", 0.8), (None, "X", 0.3), ("transport", "Transferts", 0.8)])
def test_category(one, a, b, expected):
    assert one(sim.category_score(text(a), text(b))) == expected


@pytest.mark.parametrize("a,b,expected", [(100, 100, 1), (100, 120, 1), (100, 180, 0.7), (100, 300, 0.4), (100, 400, 0.1), (None, 100, 0.5), (100, None, 0.5), (0, 9, 0.5)])
def test_price(one, a, b, expected):
    price = lambda x: L(x).cast("double")
    assert one(sim.price_score(price(a), price(b))) == expected
    assert one(sim.price_score(price(b), price(a))) == expected


def test_country(one):
    assert one(sim.country_score(L("Italy"), L(" ITALY"))) == 1.0
    assert one(sim.country_score(L("Italy"), L("France"))) == 0.0
    assert one(sim.country_score(text(None), L("France"))) == 0.5


@pytest.mark.parametrize("score,status", [(0.90, "SIMILAR"), (0.70, "SIMILAR"), (0.60, "SIMILAR"), (0.50, "NEW_PRODUCT")])
def test_decision(one, score, status):
    assert one(sim.decision(L(score)))["status"] == status


def test_cosine_of_zero_vector(one):
    zero, v = F.array(L(0.0), L(0.0)), F.array(L(3.0), L(4.0))
    assert one(sim.cosine(zero, v)) == 0.0
    assert one(sim.cosine(v, v)) == pytest.approx(1.0)


def test_scores_stay_in_range(spark):
    titles = ["Rome Airport Transfer", "Transfer to Airport Rome", "", "Wine & Food", None, "Tromsø fjord cruise"]
    rows = list(itertools.product(titles, titles))
    df = spark.createDataFrame(rows, "a string, b string")
    out = df.select(sim.title_score(F.col("a"), F.col("b"), F.lit(None).cast("string"), F.lit("TRANSFER")).alias("t"),
                    sim.description_score(F.col("a"), F.col("b")).alias("d"), sim.category_score(F.col("a"), F.col("b")).alias("c"))
    for row in out.collect():
        assert all(0 <= x <= 1 for x in row)

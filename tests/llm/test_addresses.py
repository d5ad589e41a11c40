from __future__ import annotations

import pytest

from inkwell.llm import addresses

BUILDINGS = {
    "a": [("Lostilakallee 126, 5439 Nimuveheim", "CH"), ("LOSTILAK-ALLEE NR. 126 - SUITE 410 - CH-5439 NIMUVEHEIM", ""), ("Gebäude B\nCH-5439 Nimuveheim\nLostialk-Allee 126", "Schweiz"), ("Lostilak Allee #126, Nimuveheim", None), ("Lostilakallee 126; 5439", "")],
    "b": [("Lostilakallee 130, 5439 Nimuveheim", "CH"), ("Lostilakallee 130, 5439 Nimuveheim", "CH")],
    "c": [("Lostilakallee 126, 8001 Bradorf", "CH"), ("2nd floor, Lostilakallee 126, Bradorf", "ch")],
    "d": [("171 North Sedrepos Street, Zestuvolton L5E 8V4", "CA"), ("N. Sedrepos St., 171, Zestuvolton", "Canada"), ("P.O. Box 9\n171 N Sedrepos Street\nL5E 8V4", "")],
    "e": [("54 rue Jisibrert, 31308 Mezilucourt", "FR"), ("54 R. JISIBRERT, 31308 MEZILUCOURT, FRANCE", ""), ("c/o Mail Room, Mezilucourt, 54 Rue Jisibert", "F")],
    "f": [("Calle Zeneges 68, 90700 Madakr del Río", "ES"), ("C/ Zeneges 68; Madakr del Rio", "España")],
}


def test_buildings(spark):
    rows, truth = [], {}
    for building, writings in BUILDINGS.items():
        for k, (address, country) in enumerate(writings):
            for _ in range(3 if k == 0 else 1):  # the usual writing stands more than once
                i = len(rows) + 1
                rows.append((i, address, country, "x", 1))
                truth[i] = building
    df = spark.createDataFrame(rows, "rep_id bigint, address string, country string, street string, number int")
    got = {tuple(r) for r in addresses.found(df).collect()}
    assert got == {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}


def test_odd_values(spark):
    rows = [(1, None, None), (2, "", "CH"), (3, "   ", None), (4, "no street at all", "CH"), (5, "no street at all", "CH"), (6, "1 x " * 3000, None), (7, "Weg 5", None), (8, "Torweg 5", None), (9, "Torweg 5", None)]
    df = spark.createDataFrame(rows, "rep_id bigint, address string, country string")
    assert {tuple(r) for r in addresses.found(df).collect()} == {(8, 9)}
    assert addresses.found(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("a", "b", "yes"), [("kokabos", "kkabos", True), ("lostilak", "lostialk", True), ("abc", "abd", True), ("abc", "abdd", False), ("abc", "abc", True), ("abcd", "badc", False), ("", "a", True)]
)
def test_near(a, b, yes):
    assert addresses.near(a, b) is yes and addresses.near(b, a) is yes


def test_deletions_meet_within_one_edit():
    import random

    rng = random.Random(0)
    for _ in range(300):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(3, 7)))
        k = rng.randrange(len(w))
        for other in (w[:k] + w[k + 1 :], w[:k] + "a" + w[k:], w[:k] + "b" + w[k + 1 :]):
            assert set(addresses.deletions(w)) & set(addresses.deletions(other))


WIDER = {
    "four digits": [("1600 Main Street, Springfield, IL 62701", "US"), ("1600 Main St., Springfield 62701", "USA"), ("1600 MAIN STREET, SPRINGFIELD", "US")],
    "another number": [("1602 Main Street, Springfield, IL 62701", "US")],
    "words": [("5 rue de la Paix, 75002 Paris", "FR"), ("5 R. de la Paix; 75002 Paris", ""), ("75002 Paris, rue de la Paix 5", "France"), ("5 rue de la Paix Paris", "FR")],
    "other words": [("5 rue de Rivoli, 75002 Paris", "FR")],
    "hill": [("7 Park Hill Road, Leeds LS1 4DY", "GB"), ("7 Park Hill Rd, Leeds", "UK")],
    "other hill": [("7 Oak Hill Road, Leeds LS1 4DY", "GB")],
    "untyped": [("Unter den Linden 77, 10117 Berlin", "DE"), ("Unter den Linden Nr. 77\n10117 Berlin", "D")],
    "range": [("Bahnhofstrasse 12-14, 8001 Zentrum", "CH"), ("Bahnhofstr. 12/14, CH-8001 Zentrum", "")],
    "upper": [("Obere Bahnhofstrasse 12-14, 8001 Zentrum", "CH")],
    "austria": [("Ringstrasse 5, 1010 Neustadt", "AT"), ("Ringstr. 5, A-1010 Neustadt", None)],
    "switzerland": [("Ringstrasse 5, 1010 Neustadt", "CH"), ("Ringstr. 5, Neustadt", "Schweiz")],
    "unread": [("Tor 9 Werk Nord", "Wakanda"), ("Tor 9, Werk Nord", "Wakanda")],
}


def test_writings_beyond_one_word_and_three_digits(spark):
    rows, truth = [], {}
    for building, writings in WIDER.items():
        for address, country in writings:
            truth[len(rows)] = building
            rows.append((len(rows), address, country))
    df = spark.createDataFrame(rows, "rep_id bigint, address string, country string")
    got = {tuple(r) for r in addresses.found(df).collect()}
    assert got == {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    one = {r.rep_id: (r.building, r.records) for r in addresses.buildings(df).collect()}
    assert set(one) == set(truth) and all(n == sum(truth[k] == truth[i] for k in truth) for i, (_, n) in one.items())


def test_a_missing_country_is_that_of_the_gazetteer(spark):
    rows = [("Ringstrasse 5, 1010 Neustadt", "AT")] * 3 + [("Ringstrasse 5, 1010 Neustadt", "")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "rep_id bigint, address string, country string")
    assert {r.building for r in addresses.buildings(df).collect()} == {0}
    assert {tuple(r) for r in addresses.probed(df, 2).collect()} == {(a, b) for a in (0, 2) for b in range(4) if a != b}


@pytest.mark.parametrize(
    ("address", "country", "street", "town"),
    [
        ("9845 Dakramont Floor 3 3 rue Gribravax Belgium", "Belgium", "gribravax", "dakramont"), ("21608 Miposumont Gebäude B 27 r. Stofogus fr", "fr", "stofogus", "miposumont"),
        ("48 DURIBROT AV 28441", "USA", "duribrot", ""), ("66 Drizoluk Boulevard Drike Falls 41645 USA", "USA", "drizoluk", "drike falls"), ("5 Oak Street, Springfield IL 62701", "", "oak", "springfield"),
    ],
)
def test_countries_states_and_types_end_where_they_should(address, country, street, town):
    (p,) = {(p["street"], p["town"]) for p in addresses.hypotheses(address, country)}
    assert p == (street, town)

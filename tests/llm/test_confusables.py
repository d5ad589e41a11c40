from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from inkwell.llm import confusables

SAME = [
    ("Ｆｕｌｌ　ｗｉｄｔｈ", "Full width"), ("Café", "Café"), ("a​b­c﻿", "abc"), ("a b", "a b"), ("a‑b", "a-b"), ("Сору", "Copy"),
    ("ﬁne", "fine"), ("ёлка", "ëлкa"), ("Α-1", "A-1"), ("각", unicodedata.normalize("NFD", "각")), ("ﾊﾞ", "バ"), ("µ", "μ"),
    ("\U0001d400\U0001d41b", "Ab"), ("\U0001d7d8\U0001d5b7", "0X"), ("νανe ρατh", "vave path"), ("κυτ", "kut"), ("Տօս", "Sou"), ("ᏀᎪᎢᎬ"[:2], "GA"),
]
DIFFERENT = [("Cafe", "Café"), ("abc", "ABC"), ("abc", "abc."), ("ab", "a b")]


def forms(spark, values):
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "i int, text string, look string")
    return [r.look for r in confusables.with_canonical(df, "text", "look").orderBy("i").collect()]


def test_forms(spark):
    got = forms(spark, [x for pair in SAME + DIFFERENT for x in pair])
    pairs = list(zip(got[::2], got[1::2]))
    assert [a == b for a, b in pairs] == [True] * len(SAME) + [False] * len(DIFFERENT), pairs


def test_odd_values(spark):
    assert forms(spark, [None, "", "​", "  x 　 y ", "ａ" * 50_000]) == [None, "", "", "x y", "a" * 50_000]


@pytest.mark.parametrize("copies", [1, 40])
def test_pairs(spark, copies):
    rows = [("title", 1, "Valve unit"), ("title", 2, "Valve unit"), ("title", 3, "Vаlve unit"), ("title", 4, "valve unit"), ("title", 5, None), ("title", 6, ""), ("applicants", 7, "Valve unit")]
    rows += [("title", 100 + i, "Other") for i in range(copies)]
    df = spark.createDataFrame(rows, "field string, id bigint, text string")
    assert {tuple(r) for r in confusables.same_look_pairs(df).collect()} == {("title", 1, 3), ("title", 2, 3)}
    assert confusables.same_look_pairs(df.limit(0)).count() == 0


def test_looks(spark):
    rows = [("title", 4, "Valve"), ("title", 2, "Vаlve"), ("title", 3, "Valve"), ("title", 9, "Vent"), ("applicants", 1, "Valve"), ("title", 5, None), ("title", 6, "\u200b")]
    df = spark.createDataFrame(rows, "field string, id bigint, text string").withColumn("look", F.lit("x"))
    assert {tuple(r) for r in confusables.looks(df).collect()} == {("title", 4, 2, 2), ("title", 2, 2, 2), ("title", 3, 2, 2), ("title", 9, 9, 1), ("applicants", 1, 1, 1)}
    assert confusables.looks(df.limit(0)).count() == 0


def test_pairs_against_brute_force(spark):
    import random

    rng = random.Random(3)
    swaps = {"a": "а", "o": "ο", "e": "е", " ": " ", "-": "‐"}
    base = ["alpha beam", "open door", "co-axial", "alpha team"]
    rows = [("title", i, "".join(swaps.get(c, c) if rng.random() < 0.2 else c for c in rng.choice(base))) for i in range(120)]
    look = lambda t: "".join({v: k for k, v in swaps.items()}.get(c, c) for c in t)
    expected = {("title", i, j) for _, i, a in rows for _, j, b in rows if i < j and a != b and look(a) == look(b)}
    got = confusables.same_look_pairs(spark.createDataFrame(rows, "field string, id bigint, text string"))
    assert {tuple(r) for r in got.collect()} == expected

from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from inkwell.functions import language, text as tx


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("value", "units"),
    [
        ("A47J 36/06 中文 테스트 123-A Fig.2", ["中", "文", "테", "스", "트", "A47J", "36/06", "123-A", "Fig", "2"]),
        ("... ，； ( ) \n", []),
        ("a[0001] b", ["ab"]),
        ("l’arbre d'onde x_y", ["l’arbre", "d'onde", "x", "y"]),
        ("", []),
    ],
)
def test_units(spark, value, units):
    assert one(spark, tx.unit_tokens, value) == units
    assert one(spark, tx.count_units, value) == len(units)


def test_null_text(spark):
    assert one(spark, tx.count_units, None) is None
    assert one(spark, tx.count_words, None) is None


def test_two_word_standards_differ(spark):
    assert one(spark, tx.count_words, "Привет œuvre 中文 Größe") == 2
    assert one(spark, tx.count_units, "Привет œuvre 中文 Größe") == 5


def test_nfkc_only_touches_what_it_changes(spark):
    values = ["plain", "Größe", "ｆｕｌｌ　ｗｉｄｔｈ", "ﬁne", "é", None, ""]
    rows = tx.with_nfkc(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string"), "x").orderBy("i").collect()
    assert [r.x for r in rows] == [None if v is None else unicodedata.normalize("NFKC", v) for v in values]


@pytest.mark.parametrize(
    ("line", "part"),
    [
        ("C L A I M S — PAGE 1 OF 2", "claims"),
        ("Zusammenfassung:", "abstract"),
        ("2. Description", "description"),
        ("权利要求书 第 1/3 页", "claims"),
        ("ABSTRACT DRAWING", "abstract_drawing"),
        ("The claims describe a timer and user equipment.", None),
        ("", None),
        ("x" * 300, None),
    ],
)
def test_headings(spark, line, part):
    assert one(spark, tx.heading_part, line) == part


@pytest.mark.parametrize(
    ("line", "yes"),
    [("WO 2020/123456", True), ("- 7 -", True), ("page 3 of 9", True), ("第 2/9 页", True), ("EP 1234567 A1", True), ("A valve is shown.", False)],
)
def test_running_lines(spark, line, yes):
    assert one(spark, tx.is_running_line, line) is yes


@pytest.mark.parametrize(
    ("value", "yes"), [("A good text layer.", True), ("Ã¼ Ã¼ Ã¼ text", False), ("one", False), ("", False), ("ab\x01 cd", False), (". , ; : - a b !!!! ????", False)]
)
def test_reliable_layer(spark, value, yes):
    assert one(spark, tx.reliable_layer, value) is yes


def test_cleaned_page(spark):
    assert one(spark, tx.cleaned_page, "WO 2020/123456\n12/30\n- 4 -\n2020 01 31\nAa/Bb\nThe text stays.") == "The text stays."


def test_five_grams(spark):
    words = "one two three four five six one two three four five"
    rows = spark.createDataFrame([(words,), ("a b c d",)], "x string").select(tx.unit_tokens(F.col("x")).alias("t")).select(tx.five_grams(F.col("t")).alias("g")).collect()
    w = words.split()
    assert set(rows[0].g) == {"\u0001".join(w[i : i + 5]) for i in range(len(w) - 4)}
    assert rows[1].g == []


def test_file_names(spark):
    assert one(spark, tx.safe_filename, "a b/ü.pdf") == "a-b-.pdf"
    assert [one(spark, tx.strict_filename, v) for v in ("x.zip", "../x", "/x", "c:x", " ")] == ["x.zip", None, None, None, None]
    assert one(spark, tx.disposition_filename, 'attachment; filename="a.pdf"') == "a.pdf"


def test_language_by_rule(spark):
    def rule(value):
        df = spark.createDataFrame([(value,)], "x string").select(language.sample_of(F.col("x")).alias("s"))
        return df.select(language.code_from(F.col("s"), language.scores_of(F.col("s"))).alias("y")).first().y

    def plain(value):
        sample = f" {' '.join(value.lower().split())[:20000]} "
        for code, pattern in language.SCRIPTS:
            if re.search(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m.group(1), 16)), pattern), sample):
                return code
        scores = {k: sum(sample.count(m) for m in marks) for k, marks in language.MARKERS.items()}
        best = max(scores, key=scores.get)
        return best if scores[best] else "en"

    for value in ["the valve and the claim", "die Erfindung und das Gerät", "le brevet et la revendication", "漢字", "ひらがな漢字", "한글", "текст", "zzz", "", "el o la y los"]:
        assert rule(value) == plain(value), value
    assert [one(spark, language.label_code, v) for v in ("EN-us", "chi_sim", "xx", None, "Japanese")] == ["en", "ch", "en", "en", "japan"]

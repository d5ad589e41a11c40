from __future__ import annotations

import pytest

from inkwell.llm import ocr

GOOD = "the sealing ring engages with the cooling channel in a form-fitting manner and the bottom-side panel carries the winding core of the membrane stack"


def pages(spark, *texts):
    """Pages to be looked at after 30 clean ones, from which the counts come."""
    rows = [("page", 1000 + i, GOOD + f" {i}") for i in range(30)] + [("page", i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "rec string, rec_id bigint, text string")


def found(spark, *texts):
    return sorted((r.rec_id, r.line_no, r.kind, r.repaired) for r in ocr.findings(pages(spark, *texts)).filter("rec_id < 1000").collect())


@pytest.mark.parametrize(
    ("line", "kind"),
    [
        ("WO 2020/123456", "header"), ("WO 2O20/123456      PCT/EP2020/123456", "header"), ("EP 9 764 780 A2", "header"), ("EP9486113", "header"), ("WO ref. 69955", "header"),
        ("ERSATZBLATT", "header"), ("REPLACEMENT SHEET", "header"), ("- 9 -", "pageno"), ("12", "pageno"), ("Seite 5", "pageno"), ("Page 15 of 18", "pageno"), ("[10]", "pageno"), ("4/7", "pageno"),
        ("~ 12 ~", "pageno"), ("p. 16", "pageno"), ("4.", None), ("[0012]", None), ("(24).", None), ("A valve 12", None), ("", None), ("of 78 mm to 279 mm.", None),
    ],
)
def test_running_lines(line, kind):
    assert ocr.running(line) == kind


def test_repairs(spark):
    text = "WO 2020/123456\nthe coo1ing charmel engages with the seal-\n- 7 -\ning ring in a form-\nfitting manner and the botlom\nthe winclin9 core"
    assert found(spark, text) == [
        (0, 0, "header", ""), (0, 1, "hyphen", "sealing"), (0, 1, "misread", "channel"), (0, 1, "misread", "cooling"), (0, 2, "pageno", ""), (0, 3, "hyphen", "form-fitting"), (0, 5, "misread", "winding"),
    ]


def test_right_words_stay(spark):
    # `stock` is a word of its own where the contexts of `stack` are not those of `stock`.
    texts = ["the rolling stock of the railway is old"] * 3 + ["Figure 71a and 5o and Abc-9 (92)"]
    assert found(spark, *texts) == []


def test_broken_and_misread_word(spark):
    assert found(spark, "the mernb-\nrane stack") == [(0, 0, "hyphen", "membrane")]


def test_odd_values(spark):
    df = spark.createDataFrame([("page", 1, None), ("page", 2, ""), ("page", 3, "\n\n"), ("page", 4, "word- "), ("page", 5, "-"), ("page", 6, "x " * 20_000), ("draft", 6, "12")], "rec string, rec_id bigint, text string")
    assert [tuple(r) for r in ocr.findings(df).select("rec", "rec_id", "line_no", "kind", "repaired").collect()] == [("draft", 6, 0, "pageno", "")]
    assert ocr.findings(df.limit(0)).count() == 0
    assert {r.rec_id: r.repaired for r in ocr.repaired_texts(df).filter("rec = 'page' and rec_id < 5").collect()} == {1: None, 2: "", 3: "", 4: "word-"}


def test_paragraphs(spark):
    text = "EP 9486113\nthe coo1ing chan-\nnel, the ring\n\n3\nthe stack."
    got = {r.rec_id: r.repaired for r in ocr.repaired_texts(pages(spark, text)).collect()}
    assert got[0] == "the cooling channel, the ring\n\nthe stack."


def test_planted_errors_are_found(spark):
    import random

    rng, words = random.Random(2), [w for w in GOOD.split() if len(w) >= 5]
    swaps = [("e", "c"), ("i", "1"), ("l", "1"), ("g", "9"), ("m", "rn"), ("nn", "rm"), ("o", "0")]
    texts, truth = [], set()
    for i in range(60):
        line = GOOD.split()
        k = rng.choice([j for j, w in enumerate(line) if w in words])
        options = [(a, b) for a, b in swaps if a in line[k]]
        if options:
            truth.add((i, 0, "misread", line[k]))
            line[k] = line[k].replace(*rng.choice(options), 1)
        texts.append(" ".join(line))
    got = set(found(spark, *texts))
    assert len(got & truth) / len(truth) > 0.97 and len(got & truth) / len(got) > 0.97


def test_misread_words_of_copies(spark):
    """A misread word is repaired in every copy of a page, however many there are."""
    page = "the coo1ing channel carries the winding core"
    got = found(spark, *[page] * 20)
    assert got == [(i, 0, "misread", "cooling") for i in range(20)]


def test_copies_count_once_for_options(spark):
    """Copies of a misreading that could be a word don't take its options away."""
    df = pages(spark, *["the cooling charmel carries the winding core"] * 20)
    options = {r.word: {o.text for o in r.options} for r in ocr.options(ocr.counts(df)).collect()}
    assert options["charmel"] == {"charmel", "channel"}


def test_short_words(spark):
    assert found(spark, "tbe sealing ring aud the winding core ot the membrane") == [(0, 0, "misread", "and"), (0, 0, "misread", "of"), (0, 0, "misread", "the")]


def test_bit_table_lets_all_its_words_through(spark):
    words = [f"wörd{i}" for i in range(500)]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for bits, most in ((26, 0), (15, 60)):
        table = ocr._bit_table(df, bits)
        assert all(ocr._in_table(table, w) for w in words)
        assert sum(ocr._in_table(table, f"other{i}") for i in range(2000)) <= most


def test_a_full_bit_table_changes_nothing(spark, monkeypatch):
    """Words that the table lets through without options only split the runs."""
    text = "WO 2020/123456\nthe coo1ing charmel engages with the seal-\n- 7 -\ning ring in a form-\nfitting manner and the botlom\nthe winclin9 core"
    expected = found(spark, text)
    monkeypatch.setattr(ocr, "_bit_table", lambda words: b"\xff" * 4096)
    assert found(spark, text) == expected


def test_confusions_are_estimated(spark):
    """A confusion that the corpus shows often gets the rate at which it stands there."""
    wrong = ["rnanner", "mernbrane", "forrn-fitting", "bottorn-side"]
    texts = [GOOD] * 200
    for i in range(40):
        word = wrong[i % 4]
        texts[i] = GOOD.replace(word.replace("rn", "m"), word)
    df = spark.createDataFrame([("page", i, f"{t} {i}") for i, t in enumerate(texts)], "rec string, rec_id bigint, text string")
    counted = ocr.cut(ocr.counts(df))
    rates = dict(zip(ocr.CONFUSIONS, ocr.confusion_rates(counted, ocr.cut(ocr._tried(counted)))))
    assert 0.5 < rates["rn", "m"] / (40 / (GOOD.count("m") * 200)) < 2
    assert rates["cl", "d"] < ocr.PRIOR

from __future__ import annotations

from inkwell.operators import sections


def test_headings_carry_over_pages(spark):
    pages = spark.createDataFrame(
        [
            (1, 1, "Front matter\nWO 2020/123456\nDescription\nA valve."),
            (1, 2, "- 2 -\nIt opens.\nClaims\n1. A valve."),
            (1, 3, "International Search Report\nnothing"),
            (2, 1, "Alone"),
            (2, 2, None),
        ],
        "file_id int, page_no int, text string",
    )
    rows = sections.sectioned(sections.lines(pages, "file_id", "page_no"), "file_id", ["page_no", "line_no"])
    assert [(r.file_id, r.part, r.line) for r in rows.orderBy("file_id", "page_no", "line_no").collect()] == [
        (1, "unclassified", "Front matter"), (1, "description", "A valve."), (1, "description", "It opens."), (1, "claims", "1. A valve."), (2, "unclassified", "Alone"),
    ]
    kept = sections.sectioned(sections.lines(pages, "file_id", "page_no"), "file_id", ["page_no", "line_no"], keep_headings=True)
    assert kept.filter("is_heading").count() == 2


def test_measures(spark):
    drafts = spark.createDataFrame(
        [
            (1, 1, "abstract", "two words", "found", "ocr", "high"), (1, 2, "abstract", "and three more", "found", "xml", "low"), (1, 3, "claims", "", "missing", "none", "none"),
            (1, 4, "abstract_drawing", "Fig 1", "found", "ocr", "medium"), (2, 5, "claims", None, "error", "ocr", "none"), (3, 6, "description", "中文 x", "found", "xml", "high"),
        ],
        "file_id int, draft_id int, part string, text string, status string, method string, confidence string",
    )
    parts = sections.measured(drafts)
    got = {(r.file_id, r.part): (r.word_count, r.status, r.method, r.confidence) for r in parts.collect()}
    assert got[(1, "abstract")] == (5, "found", "mixed", "low")
    assert got[(1, "claims")] == (0, "missing", "none", "none")
    warnings = spark.createDataFrame([(3, 2)], "file_id int, warnings int")
    files = sections.by_file(parts, warnings)
    assert {(r.file_id, r.document_text_words, r.drawing_words, r.total_words, r.file_status) for r in files.collect()} == {(1, 5, 2, 7, "success"), (2, 0, 0, 0, "failed"), (3, 3, 0, 3, "partial")}
    total = sections.rolled_up(files, []).first()
    assert (total.total_words, total.files, total.status) == (10, 3, "partial")
    assert sections.joined(drafts, ["file_id", "part"], ["draft_id"], "text").filter("file_id = 1 and part = 'abstract'").first().text == "two words and three more"


def test_cover(spark):
    page = "Header\n(54) Title\nFIG. 1\n12\n(57) Abstract: First line.\n- 1 -\nSecond line.\nDescription\nNot this."
    r = sections.cover_parts(spark.createDataFrame([(page,), ("no marker",)], "text string")).collect()
    assert (r[0].abstract, r[0].figure_text) == ("First line. Second line.", "FIG. 1")
    assert (r[1].abstract, r[1].figure_text) == ("", "")


def test_full_width_headings_and_digits(spark):
    pages = spark.createDataFrame([(1, 1, "Ｃｌａｉｍｓ\n１. Ａ valve ﬁt")], "file_id int, page_no int, text string")
    rows = sections.sectioned(sections.lines(pages, "file_id", "page_no"), "file_id", ["page_no", "line_no"])
    assert [(r.part, r.line) for r in rows.collect()] == [("claims", "１. Ａ valve ﬁt")]
    drafts = spark.createDataFrame([(1, 1, "claims", "ｱ ﾊﾟ x", "found", "ocr", "high")], "file_id int, draft_id int, part string, text string, status string, method string, confidence string")
    assert sections.measured(drafts).first().word_count == 3


def test_errors_and_duplicates(spark):
    parts = spark.createDataFrame([(1, "abstract", 5, "found", "xml", "high"), (1, "claims", 0, "missing", "none", "none")], "file_id int, part string, word_count bigint, status string, method string, confidence string")
    errors = spark.createDataFrame([(1, "abstract", "b"), (1, "claims", "a"), (2, "claims", "c")], "file_id int, part string, message string")
    rows, warnings = sections.marked_errors(parts, errors)
    assert {(r.file_id, r.part, r.status, r.method) for r in rows.collect()} == {(1, "abstract", "found", "xml"), (1, "claims", "error", "ocr"), (2, "claims", "error", "ocr")}
    assert {(r.file_id, r.warnings, tuple(r.messages)) for r in warnings.collect()} == {(1, 2, ("a", "b")), (2, 1, ("c",))}
    files = spark.createDataFrame([(1, "success"), (2, "failed"), (3, "success"), (4, "partial")], "file_id int, file_status string")
    pairs = spark.createDataFrame([(1, 2), (2, 4)], "key_a int, key_b int")
    assert {tuple(r) for r in sections.downgraded(files, pairs).collect()} == {(1, "partial"), (2, "failed"), (3, "success"), (4, "partial")}

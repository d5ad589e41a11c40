from __future__ import annotations

import json

from pyspark.sql import functions as F

from inkwell.operators import answers

ANSWER = {
    "wo-bibliographic-data": {
        "publication-reference": {"document-id": [{"country": "WO", "doc-number": "2020123456", "kind": "A1", "date": "20200618", "lang": "en"}]},
        "application-reference": {"document-id": {"country": "PCT", "doc-number": "EP2019/084001", "date": "20191206", "lang": "de"}},
        "invention-title": [{"lang": "fr", "content": ["Soupape"]}, {"lang": "EN", "content": [{"value": "Valve"}, " unit"]}],
        "parties": {
            "applicants": {"applicant": [{"addressbook": {"orgname": {"value": "Zenasor  GmbH"}}}, {"address-book": [{"name": "Zenasor GmbH"}, {"first-name": "Ida", "last-name": "Moll"}]}]},
            "inventors": {"inventor": {"addressbook": {"content": [{"last-name": "Kern"}, {"first-name": "Ulf"}]}}},
            "agents": {"agent": {"addressbook": [{"orgname": "Kanzlei", "address": {"street": "Weg 1", "city": "Ort", "country": "DE"}}]}},
            "representatives": {"representative": [None, {"addressbook": {"name": {"value": "R. Roth"}, "address": {"city": ""}}}]},
        },
        "classifications-ipcr": {"classification-ipcr": [{"section": "F", "class": {"value": "16"}, "subclass": "K", "main-group": "1", "subgroup": "00"}, {"text": "F16K  3/02"}, {"text": "F16K 3/02"}]},
        "classifications-cpc": {"classification-cpc": {"section": "F", "class": "16", "subclass": "K", "main-group": "9"}},
        "deep": [{"x": {"date-of-earliest-priority": {"date": "20181207"}}}],
        "wo-priority-info": {"items": [{"priority-claim": {"country": "DE", "doc-number": "102018", "date": "20181207", "kind": "national"}}, {"more": {"priority-claim": {"doc-number": ""}}}]},
        "designation-of-states": {"r": [{"region": {"country": "EP", "x": [{"kind-of-protection": "patent"}]}}], "n": [{"country": "JP"}, {"countryAndProtectionRequest": ["US", "JP", 5]}, {"country": "EP"}]},
    },
    "abstract": [{"lang": "de", "p": [{"content": ["Ein Ventil"]}, {"content": ["[0001] offen"]}]}],
}


def test_record(spark):
    df = spark.createDataFrame([(1, json.dumps(ANSWER), "x"), (2, "nope", "x"), (3, "[]", "x"), (4, None, "x"), (5, "{}", "x")], "k bigint, p string, title string")
    rows = {r.k: r for r in answers.records(df, "k", "p").collect()}
    r = rows[1]
    assert (r.title, r.title_language, r.abstract, r.abstract_language) == ("Valve unit", "EN", "Ein Ventil offen", "DE")
    assert (r.publication_number, r.publication.date, r.publication.lang, r.application_number, r.application.lang) == ("WO2020123456A1", "20200618", "EN", "PCT/EP2019/084001", "DE")
    assert (r.applicants, r.inventors) == (["Zenasor GmbH", "Ida Moll"], ["Ulf Kern"])
    assert [tuple(x) for x in r.representatives] == [("", "Kanzlei", "Weg 1 Ort", "DE"), ("R. Roth", "", "", "")]
    assert (r.ipc, r.cpc, r.first_priority_date) == (["F16K 1/00", "F16K 3/02"], ["F16K 9"], "20181207")
    assert [tuple(x) for x in r.priority_data] == [("102018", "20181207", "DE", "national")]
    assert (r.regions, r.countries, r.protection_types, r.error) == (["EP"], ["JP", "US"], ["patent"], None)
    assert [rows[k].error for k in (2, 3, 4, 5)] == ["invalid_json", "not_an_object", "invalid_json", None]
    assert rows[5].title == "" and rows[5].applicants == [] and rows[5].publication_number == ""


def test_flat_answer_and_numbers(spark):
    flat = json.dumps({"publication-reference": {"country": "EP", "doc-number": "EP1234567", "kind": "B1"}, "invention-title": {"value": "One"}})
    r = answers.records(spark.createDataFrame([(1, flat)], "k bigint, p string"), "k", "p").first()
    assert (r.publication_number, r.title, r.title_language) == ("EP1234567B1", "One", "")
    cases = [("PCT", "EP2019/1", "", "PCT/EP2019/1"), ("", "PCT/EP2019/1", "A1", "PCT/EP2019/1"), ("", "77", "B", "77B"), ("DE", "", "A", "A"), (None, None, None, "")]
    df = spark.createDataFrame([c[:3] for c in cases], "country string, doc_number string, kind string")
    assert [x.n for x in df.select(answers.reference_number(F.struct("*")).alias("n")).collect()] == [c[3] for c in cases]


def test_lists(spark):
    lists = [
        '{"availableDocuments": {"document": [{"docId": "1", "docType": "PAMPH", "minSpecCode": "m"}, {"docId": "", "docType": "x"}, 3]}}', '{"available-documents": [{"document-id": 5, "document-code": "A1"}]}',
        '{"other": 1}', "no", None,
    ]
    df = spark.createDataFrame([(x,) for x in lists], "p string").select(answers.listed_documents(F.col("p")).alias("d"))
    assert [[tuple(x) for x in r.d] for r in df.collect()] == [[("1", "PAMPH", "m", "")], [("5", "A1", "", "")], [], [], []]
    pages = ['{"content": "a.xml"}', '{"content": ["b.tif", "", "PackageData-PKDA.xml", "z.XML"]}', '{"content": []}', "{}"]
    df = spark.createDataFrame([(x,) for x in pages], "p string").select(answers.listed_pages(F.col("p")).alias("d"))
    assert [r.d for r in df.collect()] == [["a.xml"], ["b.tif", "PackageData-PKDA.xml", "z.XML"], [], []]
    assert [r.x for r in df.select(answers.publication_xml(F.col("d")).alias("x")).collect()] == ["a.xml", "PackageData-PKDA.xml", "", ""]


def test_deep_answers_need_no_recursion():
    deep = {"region": {"country": "EP"}}
    for _ in range(5000):
        deep = [deep]
    assert answers.states(deep)["regions"] == ["EP"]

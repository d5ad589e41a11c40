from __future__ import annotations

import json

from pyspark.sql import functions as F

from inkwell.functions import identifiers as ids
from inkwell.functions import integrity
from inkwell.operators import lookups, markup

REF = "source string, normalized_number string, display_number string, country_code string, doc_number string, kind_code string, lookup_number string, reference_type string, error_code string"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} string" for k in values) or "x int")
    return df.select(column.alias("r")).first().r


def parts(country, number, kind=""):
    return F.struct(F.lit(country).alias("country"), F.lit(number).alias("doc_number"), F.lit(kind).alias("kind"))


def test_references(spark):
    ep = ids.normalized_number(F.lit("EP12345678.9"))
    got = one(spark, ids.published_as(ep, parts("", "1234567", "B1")))
    assert (got.normalized_number, got.lookup_number, got.reference_type) == ("EP1234567B1", "EP1234567.B1", "publication")
    assert one(spark, ids.published_as(ep, parts("EP", ""))).error_code == "source_no_result"
    pub = ids.normalized_number(F.lit("EP1234567B1"))
    assert one(spark, ids.published_as(pub, parts("EP", "9"))).normalized_number == "EP1234567B1"
    assert one(spark, ids.with_kind(pub, F.lit("A2"))).lookup_number == "EP1234567.A2"
    us = one(spark, ids.canonical(ids.normalized_number(F.lit("US2020123456A1"), "epo"), parts("US", "US2020123456", "A2"), parts("", "")))
    assert (us.normalized_number, us.lookup_number, us.display_number) == ("US2020123456A2", "US2020123456", "US2020123456A1")
    assert one(spark, ids.canonical(pub, parts("", ""), parts("EP", "77", ""))).lookup_number == "EP77.B1"
    assert one(spark, ids.application_kinds(F.lit("B1"))) == ["A1", "A2"] and one(spark, ids.application_kinds(F.lit("A2"))) == ["A2"]
    stated = lambda selected, *p: F.struct(F.lit(selected).alias("selected_number"), *(parts(*p)[c].alias(c) for c in ("country", "doc_number", "kind")))
    bare = ids.normalized_number(F.lit("EP1234567"))
    assert [one(spark, ids.publication_number(r, s)) for r, s in ((pub, stated("X1", "", "")), (pub, stated("", "", "")), (bare, stated("", "", "9", "A1")), (bare, stated("", "", "")))] == ["X1", "EP1234567B1", "EP9A1", None]
    assert one(spark, ids.response_number(ids.normalized_number(F.lit("PCT/EP2019/084001")), F.lit("WO2020123456A1"))) == "WO2020123456A1"
    assert one(spark, ids.response_number(ids.normalized_number(F.lit("WO2020123456A1")), F.lit("x"))) == "WO/2020/123456"
    assert [one(spark, ids.pct_number(F.lit(c), F.lit(n))) for c, n in (("WO", "2020123456"), ("WO", "2020"), ("DE", "1"), ("", "1"))] == ["WO/2020/123456", "WO/2020", "DE/1", None]
    assert one(spark, ids.service_identifiers(ids.normalized_number(F.lit("WO2020123456A1")))) == ["WO2020123456A1", "WO2020123456", "WO/2020/123456", "WO/2020/123456A1"]
    assert one(spark, ids.same_patent(F.lit("wo 2020/123456"), F.lit("WO/2020/123456"))) is True and one(spark, ids.same_patent(F.lit("x"), F.lit("x"))) is False


def test_small_integrity(spark):
    at = F.lit("2020-12-31 23:59:59").cast("timestamp")
    assert one(spark, integrity.iso_instant(at)) == "2020-12-31T23:59:59Z" and one(spark, integrity.expires_at(at, 5)) == "2021-01-01T00:00:59Z"
    assert one(spark, integrity.bearer_matches(F.lit("Bearer k"), "k")) is True and one(spark, integrity.bearer_matches(F.lit(None).cast("string"), "k")) is False
    assert json.loads(one(spark, integrity.error_body(F.lit("c"), F.lit("m"), F.lit("s")))) == {"error": {"code": "c", "message": "m", "source": "s", "details": None}}


BIBLIO = """<ops:world-patent-data xmlns:ops="o" xmlns="e"><exchange-documents><exchange-document country="EP" doc-number="1234567" kind="B1"><bibliographic-data>
<publication-reference><document-id document-id-type="docdb"><country>EP</country><doc-number>1234567</doc-number><kind>B1</kind><date>20200101</date></document-id></publication-reference>
<application-reference><document-id document-id-type="epodoc"><doc-number>EP20190001</doc-number><date>20190101</date></document-id></application-reference>
<parties><applicants><applicant><applicant-name><name>Zenasor</name></applicant-name></applicant></applicants></parties><invention-title lang="en">Valve</invention-title></bibliographic-data>
<abstract lang="en"><p>A valve opens.</p></abstract></exchange-document></exchange-documents></ops:world-patent-data>"""
FAMILY = """<world-patent-data><patent-family><family-member><publication-reference><document-id document-id-type="epodoc"><doc-number>US2020001</doc-number></document-id></publication-reference></family-member>
<family-member><publication-reference><document-id document-id-type="epodoc"><doc-number>EP1234567</doc-number></document-id></publication-reference></family-member></patent-family></world-patent-data>"""
CLAIMS = "<world-patent-data><fulltext-documents><fulltext-document><claims lang='EN'><claim><claim-text>1. A valve.</claim-text><claim-text>more words</claim-text></claim></claims></fulltext-document></fulltext-documents></world-patent-data>"
IMAGES = "<world-patent-data><document-inquiry><inquiry-result><document-instance desc='FullDocument' link='l' number-of-pages='9'/><document-instance desc='Drawing' number-of-pages='2'/></inquiry-result></document-inquiry></world-patent-data>"
REGISTER = BIBLIO.replace("<exchange-documents><exchange-document country=\"EP\" doc-number=\"1234567\" kind=\"B1\">", "<register-search><register-documents><register-document>").replace(
    '<abstract lang="en"><p>A valve opens.</p></abstract></exchange-document></exchange-documents>', "</register-document></register-documents></register-search>"
)


def test_european_answers(spark):
    rows = [(1, c, p, "ok") for c, p in (("biblio", BIBLIO), ("family", FAMILY), ("claims", CLAIMS), ("images", IMAGES))] + [(1, "description", None, "no_result"), (2, "claims", CLAIMS, "ok")]
    payloads = spark.createDataFrame(rows, "key bigint, constituent string, payload string, outcome string")
    requests = spark.createDataFrame([(1, "EP1234567B1"), (2, "EP7654321A1")], "key bigint, number string").select("key", ids.normalized_number(F.col("number")).alias("reference"))
    got = {r.key: r for r in lookups.european(requests, payloads).collect()}
    a = got[1]
    assert (a.outcome, a.title, a.abstract, a.applicants, a.application_no, a.publication_date, a.publication_no) == ("ok", "Valve", "A valve opens.", ["Zenasor"], "EP20190001", "20200101", "EP1234567B1")
    assert (a.abstract_words, a.claims_count, a.claims_words, a.description_words, a.total_pages, a.has_drawings, a.drawing_pages, a.related) == (3, 1, 5, None, 9, True, 2, ["US2020001"])
    assert a.download_url == "https://example.org/EP1234567NWB1/document.pdf" and [(w.code, w.field) for w in a.warnings] == [("source_no_result", "description_words"), ("source_no_result", "drawings")]
    assert got[2].outcome == "no_result" and got[2].title is None
    quick = {r.key: r for r in lookups.european(requests, payloads, quick=True).collect()}
    assert quick[1].title == "Valve" and "claims_count" not in quick[1]
    apps = spark.createDataFrame([(5, "EP20190001.1")], "key bigint, number string").select("key", ids.normalized_number(F.col("number")).alias("reference"))
    found = lookups.resolved(apps, spark.createDataFrame([(5, REGISTER)], "key bigint, payload string")).first()
    assert found.reference.normalized_number == "EP1234567B1" and found.asked.reference_type == "application"
    assert lookups.european(requests.limit(0), payloads.limit(0)).count() == 0


def test_international_answers(spark):
    rows = spark.createDataFrame(
        [(1, None, "", "d1", None, "a b", None, ["f"], None, "20200101"), (2, "n", "x", "d", 7, "c", None, [], "late", None)],
        "key bigint, application_no string, publication_no string, publication_date string, abstract_words bigint, abstract string, application_date string, cpc array<string>, f_application_no_1 string, f_application_no_2 string",
    )
    got = {r.key: r for r in lookups.finalised(rows).collect()}
    assert (got[1].application_no, got[1].publication_no, got[1].abstract_words, got[2].application_no, got[2].abstract_words) == ("20200101", None, 2, "n", 7)
    base = lookups.finalised(rows).withColumn("related", F.lit(None).cast("array<string>")).withColumn("warnings", F.lit(None).cast(lookups.WARNINGS))
    done = {r.key: r for r in lookups.completed(base, spark.createDataFrame([(2, ["c1", "c1"])], "key bigint, cpc array<string>"), spark.createDataFrame([(1, ["US1"])], "key bigint, related array<string>")).collect()}
    assert (done[1].cpc, done[1].cpc_source, done[1].related, done[1].warnings) == (["f"], None, ["US1"], [])
    assert (done[2].cpc, done[2].cpc_source, done[2].related) == (["c1"], "epo", [])
    none = lookups.completed(base.filter("key = 2"), spark.createDataFrame([], "key bigint, cpc array<string>"), spark.createDataFrame([], "key bigint, related array<string>")).first()
    assert [(w.code, w.field) for w in none.warnings] == [("cpc_unavailable", "cpc")]


def test_snapshots(spark):
    good = {"source": "epo", "normalized_number": "EP1", "display_number": "EP 1", "title": "T", "claims_count": 3, "publication_no": None, "lookup_receipt": "r"}
    world = {"source": "wipo", "normalized_number": "W", "display_number": "W", "basic_info": {"title": "t"}, "original_file": {}}
    cases = [
        ("a", "epo", good, True), ("b", "epo", {**good, "extra": 1}, False), ("c", "epo", {**good, "claims_count": "3"}, False), ("d", "epo", {k: v for k, v in good.items() if k != "source"}, False),
        ("e", "wipo", world, True), ("f", "wipo", good, False), ("g", "epo", {}, False), ("h", "epo", {**good, "title": None}, False), ("i", "epo", None, False),
    ]
    df = spark.createDataFrame([(i, s, "n", None if x is None else json.dumps(x), "2020") for i, s, x, _ in cases], "id string, source string, normalized_number string, metadata_snapshot string, last_successful_fetch_at string")
    assert {r.id: r.v for r in df.select("id", lookups.valid_snapshot(F.col("metadata_snapshot"), F.col("source")).alias("v")).collect()} == {c[0]: c[3] for c in cases}
    links = spark.createDataFrame([("a",), ("a",), ("b",), ("zz",)], "patent_id string")
    kept = lookups.snapshots(df, links).collect()
    assert [(r.id, r.data_origin, r.answer["title"], "lookup_receipt" in r.answer) for r in kept] == [("a", "cache_fallback", "T", False)]
    assert tuple(lookups.snapshot_counts(df, links).first()) == (2, 1, 1)


def test_stored_rows_and_guards(spark):
    flat = spark.createDataFrame([("epo", "EP1B1", "EP 1", "A1", "", "T", "20200131", "r")], "source string, normalized_number string, display_number string, application_no string, publication_no string, title string, publication_date string, lookup_receipt string")
    nested = flat.select("source", F.lit("WO2020123456").alias("normalized_number"), "display_number", F.lit("").alias("application_no"), "publication_no", F.lit(None).cast("string").alias("publication_date"), F.struct(F.lit("N").alias("title"), F.lit("N1").alias("application_number"), F.lit("x").alias("publication_date")).alias("basic_info"))
    got = {r.normalized_number: r for r in lookups.stored_rows(flat, nested, F.lit("now")).collect()}
    assert (got["EP1B1"].jurisdiction, got["EP1B1"].publication_no, got["EP1B1"].publication_date, "lookup_receipt" in got["EP1B1"].metadata_snapshot) == ("EP", None, "2020-01-31", False)
    assert (got["WO2020123456"].application_no, got["WO2020123456"].title, got["WO2020123456"].publication_date) == ("N1", "N", "x")
    assert [one(spark, lookups.input_error(F.lit(n), F.lit(t))) for n, t in ((1, ""), (0, "EP1"), (0, " "), (2, "EP1"), (None, None))] == [None, None, "invalid_input", "invalid_input", "invalid_input"]
    parts_ = spark.createDataFrame([(1, "claims", 5, "found"), (1, "description", 4, "found"), (2, "claims", 0, "error"), (3, "abstract", 1, "found"), (4, "description", 3, "found")], "file_id int, part string, word_count int, status string")
    assert {(r.file_id, tuple(r.missing), r.error) for r in lookups.incomplete(parts_).collect()} == {
        (2, ("description", "claims"), "ocr_failed"), (3, ("description", "claims"), "section_detection_incomplete"), (4, ("claims",), "section_detection_incomplete"),
    }


LIST = """<a xmlns:n="u"><n:document document-code="PUB"><document-id> 7 </document-id><file-name>f</file-name></n:document><document><document-id>7</document-id><type>PUB</type><title>A<b>w</b></title></document>
<document><document-id>8</document-id></document></a>"""


def test_markup(spark):
    df = spark.createDataFrame([(1, LIST, "x"), (2, "<broken", "x"), (3, None, "x"), (4, "<!DOCTYPE a [<!ENTITY b 'c'>]><a/>", "x"), (5, " ", "x")], "k bigint, x string, name string")
    rows = markup.nodes(df, "k", "x", ["title", "b", "a"]).collect()
    title = next(r for r in rows if r.name == "title")
    assert (title.spaced, title.solid, title.parent) == ("A w", "Aw", 0) and {(r.k, r.error) for r in rows if r.error} == {(2, "invalid_xml"), (4, "entities")}
    assert next(r for r in rows if r.name == "a").nth == 0  # the root is one of them
    assert [(r.k, r.document_id, r.document_code, r.title) for r in markup.document_entries(df, "k", "x").collect()] == [(1, "7", "PUB", "A w")]
    toc = spark.createDataFrame([(1, "<t><page id='p2'/><x><page-id> p1 </page-id></x><pageId>p2</pageId><page/></t>")], "k bigint, x string")
    assert markup.page_ids(toc, "k", "x").first().page_ids == ["p2", "p1"]
    values = [("aGVsbG8=",), ("aGVs\nbG8=",), ("<x/>",), ("",), ("a!",), (None,)]
    assert [r.b and bytes(r.b) for r in spark.createDataFrame(values, "t string").select(markup.binary_payload(F.col("t")).alias("b")).collect()] == [b"hello", b"hello", None, None, None, None]
    faults = [(401, ""), (404, ""), (None, "Document NOT FOUND"), (500, "boom")]
    assert [r.o for r in spark.createDataFrame(faults, "s int, f string").select(markup.fault_outcome(F.col("s"), F.col("f")).alias("o")).collect()] == ["auth", "no_result", "no_result", "unavailable"]

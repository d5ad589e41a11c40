from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import records

EXCHANGE = """<?xml version="1.0"?>
<o:world-patent-data xmlns:o="http://o" xmlns="http://e"><exchange-documents><exchange-document country="EP" doc-number="777" kind="A1">
<bibliographic-data><language-of-filing>de</language-of-filing>
<publication-reference><document-id document-id-type="docdb"><country>EP</country><doc-number>777</doc-number><kind>A1</kind><date>20200102</date></document-id></publication-reference>
<application-reference><document-id document-id-type="epodoc"><doc-number>EP20190000777</doc-number><date>20190101</date></document-id></application-reference>
<priority-claims>
 <priority-claim kind="national"><document-id document-id-type="epodoc"><country>DK</country><doc-number>PA1</doc-number><date>20180101</date></document-id><priority-active-indicator>NO</priority-active-indicator></priority-claim>
 <priority-claim kind="national"><document-id document-id-type="epodoc"><country>DK</country><doc-number>PA2</doc-number><date>20180301</date></document-id></priority-claim>
</priority-claims>
<parties><applicants><applicant><applicant-name><name>Mill &amp; Son</name></applicant-name></applicant><applicant><applicant-name><name>Mill &amp; Son</name></applicant-name></applicant></applicants>
<agents><agent><agent-name><name>Firm</name></agent-name><address><city>Bern</city><country>CH</country></address></agent></agents></parties>
<invention-title lang="de">Ventil</invention-title><invention-title lang="en">Valve <b>unit</b></invention-title>
</bibliographic-data><abstract lang="en"><p>First.</p><p>Second.</p></abstract></exchange-document></exchange-documents></o:world-patent-data>"""

FULLTEXT = """<world-patent-data><fulltext-documents><fulltext-document>
<description lang="EN"><p>[0001] A valve.</p><p>FIG. 1 shows it.</p><p>FIG. 1 shows it.</p></description>
<claims lang="DE"><claim><claim-text>1. Ventil.</claim-text></claim></claims>
<claims lang="EN"><claim><claim-text>1. A valve.</claim-text></claim><claim><claim-text>2. A pump,</claim-text><claim-text>made of steel.</claim-text></claim></claims>
</fulltext-document></fulltext-documents></world-patent-data>"""

IMAGES = """<d><document-inquiry><inquiry-result><document-instance desc="Drawing" number-of-pages="7" link="l1"/>
<document-instance desc="FullDocument" number-of-pages="14" link="l2"><document-format-options><document-format>application/pdf</document-format></document-format-options></document-instance>
</inquiry-result></document-inquiry></d>"""


def read(spark, f, payload):
    return spark.createDataFrame([(payload,)], "x string").select(f(F.col("x")).alias("r")).first().r


def test_exchange(spark):
    r = read(spark, records.exchange_record, EXCHANGE)
    b = r.biblio
    assert (r.country, r.doc_number, r.kind, r.abstract) == ("EP", "777", "A1", "First. Second.")
    assert (b.title, b.publication_number, b.publication_date, b.application_number) == ("Valve unit", "EP777A1", "20200102", "EP20190000777")
    assert b.applicants == ["Mill & Son"]
    assert [(x.name, x.address, x.country) for x in b.representatives] == [("Firm", "Bern", "CH")]
    assert b.earliest_priority_date == "20180301"
    assert [p.number for p in b.priority_data] == ["DKPA1", "DKPA2"]


def test_full_text(spark):
    d = read(spark, records.description_record, FULLTEXT)
    assert (d.text, d.language, d.words, d.drawing_labels) == ("A valve. FIG. 1 shows it. FIG. 1 shows it.", "EN", 10, ["FIG. 1 shows it."])
    c = read(spark, records.claims_record, FULLTEXT)
    assert (c.language, c.claims_count, len(c.claim_texts)) == ("EN", 2, 3)
    assert read(spark, lambda x: records.claims_record(x, "DE"), FULLTEXT).claim_texts == ["1. Ventil."]


def test_images(spark):
    r = read(spark, records.images_record, IMAGES)
    assert (r.has_drawings, r.drawing_pages, r.full_document_pages, r.formats) == (True, 7, 14, ["application/pdf"])


def test_bad_payloads_give_nulls(spark):
    for payload in [None, "", "<a><b", "<!DOCTYPE x [<!ENTITY e 'v'>]><x>&e;</x>", "{}", "<other/>"]:
        assert read(spark, records.exchange_record, payload).biblio.title is None
        assert read(spark, records.description_record, payload).text is None
        assert read(spark, records.answer_record, payload).title is None


def test_answer(spark):
    payload = """{"wo-bibliographic-data": {"publication-reference": {"document-id": {"country": "WO", "doc-number": "2020123456", "kind": "A1", "date": "20200618"}},
      "invention-title": [{"lang": "fr", "content": ["Soupape"]}, {"lang": "en", "content": ["Valve", "unit"]}],
      "wo-priority-info": {"items": [{"priority-claim": {"country": "DK", "doc-number": "PA1"}}]}}, "abstract": [{"lang": "en", "p": [{"content": ["Text."]}]}]}"""
    r = read(spark, records.answer_record, payload)
    assert (r.publication_number, r.title, r.abstract, r.priority_numbers) == ("WO2020123456A1", "Valve unit", "Text.", ["DKPA1"])

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import records, sql, urls
from inkwell.operators import resolution


def test_first_hit(spark):
    requests = spark.createDataFrame([("r1", ["a", "b", "c"]), ("r2", ["d", "e"]), ("r3", ["b"])], "k string, paths array<string>")
    answers = spark.createDataFrame([("a", "no_result", None), ("b", "ok", "B"), ("c", "ok", "C"), ("d", "no_result", None)], "candidate string, outcome string, payload string")
    got = {r.k: (r.candidate, r.outcome, r.payload, r.attempts) for r in resolution.first_hit(requests, "paths", answers, "k").collect()}
    assert got == {"r1": ("b", "ok", "B", 2), "r2": ("e", "no_result", None, 2), "r3": ("b", "ok", "B", 1)}


def test_fallback(spark):
    first = spark.createDataFrame([("a", "ok", "1"), ("b", "rate_limit", None), ("c", "auth", None), ("d", "unavailable", None)], "k string, outcome string, payload string")
    second = spark.createDataFrame([("a", "ok", "x"), ("b", "ok", "y"), ("c", "ok", "z"), ("d", "auth", None)], "k string, outcome string, payload string")
    got = {r.k: (r.outcome, r.payload, r.source) for r in resolution.with_fallback(first, second, "k", resolution.NEXT_SOURCE).collect()}
    assert got == {"a": ("ok", "1", 1), "b": ("ok", "y", 2), "c": ("auth", None, 1), "d": ("unavailable", None, 1)}


def test_documents_and_family(spark):
    docs = spark.createDataFrame([(1, "x", "A2", 0), (1, "y", "pamph", 1), (1, "y", "pamph", 3), (2, "q", "ZZ", 0)], "k int, document_id string, document_code string, pos int")
    assert {tuple(r) for r in resolution.publication_documents(docs, "k").collect()} == {(1, "y", "pamph", 3), (2, "q", "ZZ", 0)}
    members = spark.createDataFrame([(1, "EP 1 A1", 0, "EP1A1"), (1, "WO2", 1, "EP1A1"), (1, "WO2", 2, "EP1A1"), (1, "AT3", 3, "EP1A1"), (1, None, 4, None)], "k int, n string, pos int, own string")
    assert resolution.related(members, "k", "n", ["own"]).first().related == ["WO2", "AT3"]
    base = spark.createDataFrame([(1,), (2,)], "k int")
    star = resolution.starred(base, "k", {"claims": spark.createDataFrame([(1, "c")], "k int, c string"), "family": spark.createDataFrame([(2, "f")], "k int, f string")})
    assert {(r.k, tuple(r.missing)) for r in star.collect()} == {(1, ("family",)), (2, ("claims",))}


def test_paths(spark):
    row = spark.createDataFrame([("publication", "EP1.A1", "EP", "1", "A1"), ("publication", "EP1", "EP", "1", None)], "t string, l string, c string, n string, k string")
    paths = [r.p for r in row.select(urls.candidate_paths(*(F.col(x) for x in "tlcnk")).alias("p")).collect()]
    assert paths[0] == ["/published-data/publication/epodoc/EP1.A1/biblio", "/published-data/publication/docdb/EP.1.A1/biblio", "/published-data/search/biblio?q=pn%3DEP1A1", "/published-data/search/biblio?q=pn%3DEP1"]
    assert len(paths[1]) == 2
    links = [r.u for r in row.select(urls.publication_url("https://h/x/", F.col("c"), F.col("n"), F.col("k"), "zip").alias("u")).collect()]
    assert links == ["https://h/x/EP1NWA1/document.zip", None]
    checks = spark.createDataFrame([("https://a.org/x",), ("http://a.org/x",), ("https://b.org/x",), ("https://u@a.org/",), ("https://a.org:99/",), (None,), ("no url",)], "u string")
    assert [r.y for r in checks.select(urls.allowed(F.col("u"), ["a.org"]).alias("y")).collect()] == [True, False, False, False, False, False, False]


def test_sql_functions(spark):
    assert "count_units" in sql.register(spark)
    row = spark.sql("SELECT count_units('中文 two words [0001] x') a, count_words('中文 two œ') b, alias_key('wo/2-é') c, is_running_line('- 7 -') d, confidence_band('50') e").first()
    assert tuple(row) == (5, 1, "WO2", True, "medium")


def test_pamphlet_and_list(spark):
    xml = """<wo-published-application><bibliographic-data><publication-reference><document-id document-id-type="docdb"><country>WO</country><doc-number>2020123456</doc-number><date>20200618</date></document-id></publication-reference>
      <invention-title lang="en">Valve</invention-title></bibliographic-data><abstract lang="en"><p>Short text.</p></abstract><description><p>[0001] One two.</p></description>
      <claims><claim><claim-text>1. A valve.</claim-text></claim><claim><claim-text>2. A pump.</claim-text></claim></claims><drawings><figure><img file="f1.tif"/></figure><figure><img file="f1.tif"/></figure></drawings></wo-published-application>"""
    r = spark.createDataFrame([(xml,)], "x string").select(records.pamphlet_record(F.col("x")).alias("r")).first().r
    assert (r.publication_number, r.title, r.abstract, r.description, r.description_words, r.claims_count, r.images) == ("WO2020123456", "Valve", "Short text.", "One two.", 2, 2, ["f1.tif"])
    rows = spark.createDataFrame([('{"documents": [{"documentId": "a", "code": "PUB", "pages": 3}, {"id": "b", "pages": [{}, {}]}, {"x": 1}]}',), ("[]",), ("no",)], "x string")
    got = [r.d for r in rows.select(records.document_list(F.col("x")).alias("d")).collect()]
    assert [tuple(d) for d in got[0]] == [("a", "PUB", 3), ("b", None, 2)] and got[1] == [] and got[2] is None

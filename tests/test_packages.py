from __future__ import annotations

import io
import zipfile

from inkwell.operators import packages
from inkwell.sources import archives


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


WIPO = """<wo-published-application lang="de"><abstract lang="fr"><p>Un clapet.</p></abstract><abstract lang="de"><p>Ein <b>Ven</b>til
 der Art.</p></abstract><abstract-figure><img file="fig.tif"/></abstract-figure><abstract-figure lang="de"><img file="sub/FIGD.tif"/></abstract-figure>
<description><p>Erster Satz.</p><p><img file="inline.tif"/></p></description><claims/><drawings><doc-page file="d1.tif"/><doc-page file="d2.tif"/><doc-page file="d1.tif"/></drawings></wo-published-application>"""
LIST = "<DP N=1 IMA=x.tif AB=1>\n<DP N=2 IMA=c1.tif CL=1>\n<dp n=3 ima=c2.tif cl=1 de=1>\n<DP IMA=z.tif DR=1>"
EPO = """<ep-patent-document lang="en"><abstract lang="de"><p>Das Ventil und der Ring.</p></abstract><abstract lang="en"><p>The valve.</p><img file="a.png"/></abstract>
<description><p>Text <img file="inline.png"/> here</p></description><claims><doc-page file="cl.png"/></claims><drawings><img file="../evil.png"/><img file="f1.png"/></drawings></ep-patent-document>"""
FILES = {
    "w.zip": {"readme.xml": "<other/>", "pub/wo.xml": WIPO, "PAG.LST": LIST, "a/c1.tif": b"1", "C2.TIF": b"2", "figd.tif": b"3", "d1.tif": b"4", "d2.tif": b"5", "x/d2.tif": b"6"},
    "w2.zip": {"a.xml": "<wo-patent-document><abstract>no</abstract></wo-patent-document>", "wo-published-application.xml": "<wo-published-application/>", "d/pag.lst": LIST, "x.tif": b"x"},
    "none.zip": {"a.xml": "<html/>", "b.xml": "<broken"}, "evil.zip": {"wo.xml": "<!DOCTYPE a [<!ENTITY b 'c'>]><wo-patent-document>&b;</wo-patent-document>"},
}


def members(spark, files):
    return archives.members(spark.createDataFrame([(k, zipped(v) if isinstance(v, dict) else v) for k, v in files.items()], "path string, content binary")).cache()


def test_international_package(spark):
    rows = members(spark, {**FILES, "bad.zip": b"nothing"})
    got = {(r.path, r.part): r for r in packages.parts(rows, "wipo").collect()}
    w = lambda p: got["w.zip", p]
    assert (w("abstract").text, w("abstract").files, w("abstract").method, w("abstract").confidence, w("abstract").language) == ("Ein Ventil der Art.", [], "wipo_xml", "high", "de")
    assert (w("abstract_drawing").files, w("abstract_drawing").sparse) == (["sub/FIGD.tif"], True)
    assert (w("description").text, w("description").files) == ("Erster Satz.", [])
    assert (w("claims").text, w("claims").files, w("claims").method) == ("", ["c1.tif", "c2.tif"], "none")
    assert w("description_drawings").files == ["d1.tif", "d2.tif"]
    # The usual name counts before a fitting root; without XML text the page list speaks.
    assert got["w2.zip", "abstract"].files == ["x.tif"] and got["w2.zip", "description"].files == []
    assert {(r.path, r.error) for r in got.values() if r.error} == {("none.zip", "no_publication"), ("evil.zip", "no_publication"), ("bad.zip", "unreadable: BadZipFile")}
    pictures = {(r.path, r.part, r.nth, r.member, bytes(r.content)) for r in packages.images(packages.parts(rows, "wipo"), rows).collect()}
    assert pictures == {
        ("w.zip", "claims", 0, "a/c1.tif", b"1"), ("w.zip", "claims", 1, "C2.TIF", b"2"), ("w.zip", "abstract_drawing", 0, "figd.tif", b"3"), ("w.zip", "description_drawings", 0, "d1.tif", b"4"),
        ("w.zip", "description_drawings", 1, "d2.tif", b"5"), ("w2.zip", "abstract", 0, "x.tif", b"x"),
    }


def test_european_package(spark):
    rows = members(spark, {"e.zip": {"x.xml": EPO, "f1.png": b"1", "cl.png": b"2", "a.png": b"3"}, "l.zip": {"x.xml": EPO.replace(' lang="en"', "")}})
    got = {(r.path, r.part): r for r in packages.parts(rows, "epo").collect()}
    e = lambda p: got["e.zip", p]
    assert (e("abstract").text, e("abstract").language, e("description").text, e("description").files) == ("The valve.", "en", "Text here", [])
    assert (e("claims").files, e("abstract_drawing").files, e("description_drawings").files) == (["cl.png"], ["a.png"], ["../evil.png", "f1.png"])
    # Without a language of the publication that of the abstract goes on to parts that tell none.
    assert (got["l.zip", "abstract"].language, got["l.zip", "claims"].language, got["l.zip", "description_drawings"].language) == ("de", "de", "de")
    assert {r.member for r in packages.images(packages.parts(rows, "epo"), rows).collect()} == {"f1.png", "cl.png", "a.png"}


def test_recognised_pages_fill_the_parts(spark):
    rows = packages.parts(members(spark, {"w.zip": FILES["w.zip"]}), "wipo")
    results = spark.createDataFrame(
        [("w.zip", "claims", 1, "second", 60.0), ("w.zip", "claims", 0, "WO 2020/123456\n1. first", 90.0), ("w.zip", "abstract_drawing", 0, None, None), ("w.zip", "abstract", 0, "not used", 99.0)],
        "path string, part string, nth int, text string, confidence double",
    )
    got = {r.part: (r.text, r.method, r.confidence, r.status) for r in packages.filled(rows, results).collect()}
    assert got["claims"] == ("1. first second", "ocr", "medium", "found") and got["abstract"] == ("Ein Ventil der Art.", "wipo_xml", "high", "found")
    assert got["abstract_drawing"][3] == "error" and got["description_drawings"][3] == "missing"


def test_no_archives(spark):
    rows = archives.members(spark.createDataFrame([], "path string, content binary"))
    assert packages.parts(rows, "wipo").count() == 0 and packages.images(packages.parts(rows, "epo"), rows).count() == 0

from __future__ import annotations

import io
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from inkwell.sources import archives, payloads
from inkwell.sources.payloads import PayloadSource, outcome

WORD = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:r><w:t>First</w:t><w:tab/><w:t>block</w:t></w:r></w:p><w:p><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>"""


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


def test_members(spark):
    files = [
        ("good.zip", zipped({"a/Pub.xml": "<x/>", "b.TIF": b"II"})), ("path.zip", zipped({"../x": "y"})), ("bomb.zip", zipped({"z": b"\0" * 40_000_000})), ("bad.zip", b"PK nothing"), ("none.zip", None),
    ]
    rows = archives.members(spark.createDataFrame(files, "path string, content binary")).collect()
    assert {(r.path, r.member, r.size, r.error) for r in rows} == {
        ("good.zip", "a/Pub.xml", 4, None), ("good.zip", "b.TIF", 2, None), ("path.zip", None, None, "unsafe_path"), ("bomb.zip", None, None, "suspicious_ratio"),
        ("bad.zip", None, None, "unreadable: BadZipFile"), ("none.zip", None, None, "unreadable: BadZipFile"),
    }
    refs = spark.createDataFrame([("good.zip", "pub.xml"), ("good.zip", "A/PUB.XML"), ("good.zip", "c.tif")], "path string, reference string")
    found = archives.resolved(refs, archives.members(spark.createDataFrame(files[:1], "path string, content binary")))
    assert {(r.reference, r.member) for r in found.collect()} == {("pub.xml", "a/Pub.xml"), ("A/PUB.XML", "a/Pub.xml"), ("c.tif", None)}


def test_types_and_lists(spark):
    df = spark.createDataFrame([("a.pdf", b"%PDF-1.7"), ("a.pdf", b"nope"), ("b.docx", b"PK\x03\x04x"), ("c.txt", b"x")], "n string, c binary")
    assert [r.t for r in df.select(archives.file_type(F.col("n"), F.col("c")).alias("t")).collect()] == ["pdf", None, "docx", None]
    listing = spark.createDataFrame([("<DP N=1 IMA=f1 DE=1>\n<dp IMA=f2 CL=1 DR=1>\n<DP N=3>",)], "x string").select(archives.page_flags(F.col("x")).alias("f")).first().f
    assert [(p.page, p.part) for p in listing] == [("f1", "description"), ("f2", "claims")]


def test_word_blocks(spark):
    files = spark.createDataFrame([("a.docx", zipped({"word/document.xml": WORD})), ("b.docx", zipped({"x": "y"}))], "path string, content binary")
    rows = archives.blocks(files).orderBy("path", "seq").collect()
    assert [(r.path, r.seq, r.text, r.error) for r in rows] == [("a.docx", 0, "First block", None), ("a.docx", 2, "Second", None), ("b.docx", None, None, "unreadable: KeyError")]


RICH = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:v="urn:schemas-microsoft-com:vml"><w:body>
<w:p><w:r><w:t>One</w:t><w:br/><w:t xml:space="preserve"> more</w:t></w:r><w:r><w:drawing><a:blip r:embed="r1"/></w:drawing></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:p><v:imagedata r:id="r2"/><a:blip r:embed="r3"/><a:blip r:embed="gone"/></w:p></w:body></w:document>"""
LINKS = """<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="media/a.png"/><Relationship Id="r2" Target="../word/media/B.PNG"/>
<Relationship Id="r3" Target="https://example.org/c.png" TargetMode="External"/></Relationships>"""


def test_images_of_word_blocks(spark):
    files = {
        "a.docx": zipped({"word/document.xml": RICH, "word/_rels/document.xml.rels": LINKS, "word/media/a.png": b"same", "word/media/b.png": b"same"}),
        "b.docx": zipped({"word/document.xml": "<!DOCTYPE x [<!ENTITY e 'y'>]><x>&e;</x>"}), "c.docx": zipped({"word/document.xml": "<broken"}),
    }
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    assert [(r.path, r.seq, r.text, r.error) for r in archives.blocks(df).orderBy("path", "seq").collect()] == [
        ("a.docx", 0, "One more", None), ("a.docx", 1, "cell", None), ("b.docx", None, None, "entities"), ("c.docx", None, None, "unreadable: ExpatError"),
    ]
    assert [(r.path, r.seq, r.member, r.content) for r in archives.block_images(df).collect()] == [("a.docx", 0, "word/media/a.png", bytearray(b"same"))]
    assert archives.relationships(LINKS.encode()) == {"r1": "word/media/a.png", "r2": "word/media/B.PNG"}
    assert archives.relationships(b'<R xmlns="x"><Relationship Id="a" Target="../../../etc/x"/></R>') == {"a": "etc/x"}


def test_uploads(spark):
    rows = [
        ("a.pdf", "application/pdf; charset=x", b"%PDF-1.7", None, None), ("a.txt", "text/plain", b"x", None, "unsupported_file_type"), ("a.pdf", "text/html", b"%PDF-1.7", None, "file_signature_mismatch"),
        ("a.pdf", "application/pdf", b"PK\x03\x04", None, "file_signature_mismatch"), ("b.docx", "application/zip", b"PK\x03\x04", ["[Content_Types].xml", "word/document.xml"], None),
        ("b.docx", "application/zip", b"PK\x03\x04", ["x"], "file_signature_mismatch"), ("b.docx", "application/zip", None, None, "file_signature_mismatch"),
    ]
    df = spark.createDataFrame(rows, "n string, m string, c binary, names array<string>, want string")
    assert [(r.n, r.got) for r in df.select("n", archives.upload_error(F.col("n"), F.col("m"), F.col("c"), F.col("names")).alias("got")).collect()] == [(r[0], r[4]) for r in rows]
    files = spark.createDataFrame([(1, "a", 3), (1, "b", 8), (1, "c", 3), (2, "a", 5), *((3, str(k), 1) for k in range(4))], "request int, name string, size bigint")
    got = {(r.request, r.name): r.error for r in archives.intake(files, "request", "name", "size", 3, 6, 12).collect()}
    assert (got[1, "a"], got[1, "b"], got[1, "c"], got[2, "a"], got[3, "0"]) == (None, "file_too_large", "request_too_large", None, "too_many_files")


def test_sheet_order(spark):
    df = spark.createDataFrame([("<DP N=2 IMA=a.tif>\n<DP N=1 IMA=B.TIF>\n<DP N=3 IMA=no.tif>", ["a.tif", "b.tif", "x.xml"]), (None, ["b.tif", "a.tiff", "d/c.tif"])], "l string, m array<string>")
    assert [r.o for r in df.select(archives.sheet_order(F.col("l"), F.col("m")).alias("o")).collect()] == [["b.tif", "a.tif"], ["a.tiff", "b.tif"]]


class Answers(BaseHTTPRequestHandler):
    seen: dict[str, int] = {}

    def do_POST(self):
        self.seen["token"] = self.seen.get("token", 0) + 1
        self.send_response(200)
        self.end_headers()
        self.wfile.write(b'{"access_token": "T", "expires_in": 1200}')

    def do_GET(self):
        n = self.seen[self.path] = self.seen.get(self.path, 0) + 1
        status = 404 if "missing" in self.path else 503 if "busy" in self.path and n < 3 else 401 if "guarded" in self.path and self.headers.get("Authorization") != "Bearer T" else 302 if "hop" in self.path else 200
        self.send_response(status)
        if status == 302:
            self.send_header("Location", "/file.zip" if "hop1" in self.path else self.path if "hoploop" in self.path else "http://elsewhere.example/x")
        self.end_headers()
        self.wfile.write(b"PK123456" if self.path == "/file.zip" else f"<x>{self.path}</x>".encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    one = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=one.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{one.server_port}"
    one.shutdown()


def test_references_of_a_table(spark, server, tmp_path):
    Answers.seen.clear()
    refs = spark.createDataFrame([("guarded/1",), ("missing",), (None,)], "reference string")
    token = payloads.Token(f"{server}/token", "u", "s")
    got = {(r.reference, r.constituent, r.status, r.outcome) for r in payloads.fetch_all(refs.coalesce(1), server + "/{constituent}/{reference}", ["biblio", "claims"], token=token).collect()}
    assert got == {("guarded/1", "biblio", 200, "ok"), ("guarded/1", "claims", 200, "ok"), ("missing", "biblio", 404, "no_result"), ("missing", "claims", 404, "no_result")}
    assert Answers.seen["token"] == 1
    assert payloads.fetch_all(refs.filter("reference = 'guarded/1'"), server + "/{constituent}/{reference}", ["biblio"]).first().outcome == "auth"
    spark.createDataFrame([(f"EP{k}",) for k in range(30)], "reference string").write.parquet(f"{tmp_path}/refs")
    spark.dataSource.register(payloads.PayloadSource)
    df = spark.read.format("payload").option("url", server + "/{constituent}/{reference}").option("path", f"{tmp_path}/refs").option("slices", "4").option("constituents", "biblio,images").load()
    assert {(r.reference, r.constituent) for r in df.collect()} == {(f"EP{k}", c) for k in range(30) for c in ("biblio", "images")}


def test_pages_and_downloads(spark, server):
    docs = spark.createDataFrame([("EP1", 5), ("EP2", 9), ("missing", 2), ("EP3", None), ("EP4", 0)], "reference string, pages int")
    rows = payloads.pages(docs, server + "/{reference}/{page}", most_pages=8, pause=0.01).collect()
    assert [(r.page, bytes(r.content)) for r in rows if r.reference == "EP1"] == [(k, f"<x>/EP1/{k}</x>".encode()) for k in range(1, 6)]
    assert {(r.reference, r.error) for r in rows if r.error} == {("EP2", "too_many_pages"), ("missing", "no_result")}
    tight = payloads.pages(docs.filter("reference = 'EP1'"), server + "/{reference}/{page}", most_bytes=30).collect()
    assert [(r.page, r.error) for r in tight] == [(3, "too_large")]
    links = spark.createDataFrame([(server + p,) for p in ("/file.zip", "/hop1", "/hop2", "/hoploop", "/other.zip", "/missing")] + [("http://elsewhere.example/a",), (None,)], "url string")
    got = {(r.url or "").removeprefix(server): (r.content and bytes(r.content), r.error) for r in payloads.downloads(links, "zip", ["127.0.0.1"], secure=False).collect()}
    assert got["/file.zip"] == got["/hop1"] == (b"PK123456", None)
    assert {k: v[1] for k, v in got.items() if v[1]} == {
        "/hop2": "not_allowed", "/hoploop": "too_many_redirects", "/other.zip": "invalid_content", "/missing": "no_result", "http://elsewhere.example/a": "not_allowed", "": "not_allowed",
    }
    assert payloads.downloads(links.limit(1), "zip", ["127.0.0.1"]).first().error == "not_allowed"  # not https
    assert payloads.downloads(links.limit(1), "zip", ["127.0.0.1"], most_bytes=4, secure=False).first().error == "too_large"


def test_payload_source(spark):
    Answers.seen.clear()
    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(PayloadSource)
        df = spark.read.format("payload").option("url", f"http://127.0.0.1:{server.server_port}/{{constituent}}/{{reference}}").option("references", "EP1,missing,busy").option("pause", "0.01").load()
        assert {(r.reference, r.status, r.payload, r.outcome) for r in df.collect()} == {
            ("EP1", 200, "<x>/biblio/EP1</x>", "ok"), ("missing", 404, None, "no_result"), ("busy", 200, "<x>/biblio/busy</x>", "ok"),
        }
    finally:
        server.shutdown()
    assert [outcome(s, b) for s, b in ((403, "Fair Use policy"), (403, ""), (429, ""), (None, ""))] == ["rate_limit", "auth", "rate_limit", "unavailable"]

from __future__ import annotations

import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from inkwell.operators import layout
from inkwell.sinks import pdf


def tiff(width=8, height=2, rows=1, coding=1, photometric=0, order="<", strips=(b"\xf0", b"\x0f"), following=0):
    fields = [(256, 3, [width]), (257, 3, [height]), (258, 3, [1]), (259, 3, [coding]), (262, 3, [photometric]), (273, 4, []), (278, 3, [rows]), (279, 4, [len(s) for s in strips]), (282, 5, [(300, 1)]), (296, 3, [2])]
    head = 8 + 2 + 12 * len(fields) + 4
    extra, at = b"", head
    places = []
    for s in strips:
        places.append(at + len(extra))
        extra += s
    fields[5] = (273, 4, places)
    body = struct.pack(order + "H", len(fields))
    for tag, kind, values in fields:
        packed = b"".join(struct.pack(order + {3: "H", 4: "I"}[kind], v) if kind != 5 else struct.pack(order + "II", *v) for v in values)
        if len(packed) > 4:
            where, extra = at + len(extra), extra + packed
            packed = struct.pack(order + "I", where)
        body += struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + body + struct.pack(order + "I", following) + extra


@pytest.mark.parametrize("order", ["<", ">"])
def test_pdf_of_pages(order):
    made = pdf.pdf([tiff(order=order), tiff(coding=4, strips=(b"AAAA", b"BBB"), order=order)])
    assert made.startswith(b"%PDF-") and len(re.findall(rb"/Type /Page ", made)) == 2 and b"/Count 2" in made
    start = int(re.search(rb"startxref\n(\d+)", made).group(1))
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", made[start:])]
    assert all(made[p:].startswith(b"%d 0 obj" % (k + 1)) for k, p in enumerate(places))
    assert b"/MediaBox [0 0 1.920 0.480]" in made and made.count(b"/CCITTFaxDecode") == 2 and b"stream\nAAAA\nendstream" in made
    assert zlib.compress(b"\xf0") in made
    for bad, why in (([], "no_pages"), ([b"x"], "not_tiff"), ([tiff(coding=5)], "unsupported_coding"), ([tiff(following=9)], "several_images"), ([tiff()[:40]], "damaged")):
        with pytest.raises(ValueError, match=why):
            pdf.pdf(bad)


def test_merged(spark):
    rows = [("a", 2, tiff(strips=(b"22", b"3")), 2), ("a", 1, tiff(strips=(b"1", b"1")), 2), ("b", 1, tiff(), 2), ("c", 1, b"no", 1)]
    got = {r.k: r for r in pdf.merged(spark.createDataFrame(rows, "k string, page int, content binary, n int"), "k", expected="n").collect()}
    assert (got["a"].pages, got["a"].error, got["b"].error, got["c"].error) == (2, None, "page_count", "not_tiff")
    made = bytes(got["a"].content)
    assert made.index(zlib.compress(b"1")) < made.index(zlib.compress(b"22"))


def test_blocks_and_pictures(spark):
    blocks = spark.createDataFrame([(1, 1, 2, 50.0, 60.0, 100.0, " body "), (1, 1, 1, 5.0, 20.0, 100.0, "head"), (1, 1, 0, 0.0, 4.0, 100.0, "running"), (1, 1, 3, 96.0, 99.0, 100.0, "- 1 -"), (1, 2, 0, None, None, None, "x")], "f int, page int, block int, y0 double, y1 double, height double, text string")
    assert {(r.page, r.text) for r in layout.page_text(blocks, ["f", "page"]).collect()} == {(1, "head\nbody"), (2, "")}
    sizes = [(10.0, 10.0, 1000.0, 50), (1.0, 10.0, 1000.0, 50), (30.0, 30.0, 1000.0, 50), (10.0, 10.0, 1000.0, 500), (10.0, 10.0, 0.0, 50), (None, 1.0, 1.0, 1)]
    df = spark.createDataFrame(sizes, "w double, h double, a double, p int")
    assert [r.d for r in df.select(layout.is_drawing(F.col("w"), F.col("h"), F.col("a"), F.col("p"), 100).alias("d")).collect()] == [True, False, False, False, False, False]
    assert [r.s for r in spark.createDataFrame([(100,), (800,), (1000,), (4000,)], "w int").select(layout.scale(F.col("w")).alias("s")).collect()] == [3, 2, 1, 1]
    assert spark.createDataFrame([([0, 190, 191],)], "p array<int>").select(layout.inked(F.col("p")).alias("i")).first().i == [0, 0, 255]
    lines = spark.createDataFrame([(1, 1, 1, "FIG. 2", True), (1, 1, 2, "a long line of text with 1 number in it", True), (1, 2, 3, "12", False)], "f int, page int, n int, line string, a boolean")
    assert {(r.page, r.figure_text) for r in layout.figure_text(lines, ["f", "page"], "n").collect()} == {(1, "FIG. 2"), (2, "")}
    assert [r.page for r in layout.after_cover(lines, "f", "page", "a").collect()] == [2]
    texts = spark.createDataFrame([("a b", "a b c"), ("x y", "a"), ("z", None)], "t string, p string")
    assert [r.t for r in layout.new_text(texts, "t", "p").collect()] == ["x y", "z"]

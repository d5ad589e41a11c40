"""Scanned pages as one image-only PDF, written without decoding what they hold.

A page is a TIFF of one image. Its strips go into the file as they are: fax-coded ones (group 4)
under the filter of the same name, plain ones compressed by zlib. Nothing else is understood;
other codings are errors of their document, which then gives no file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Numbers of TIFF fields, sizes of its types in bytes.
WIDTH, HEIGHT, BITS, CODING, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, RESOLUTION, UNIT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 282, 296
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}
PLAIN, GROUP_4 = 1, 4


def _fields(data: bytes) -> dict[int, list[int]]:
    """Fields of the only image of a TIFF; a resolution as hundredths."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise ValueError("not_tiff")
    at = struct.unpack_from(f"{order}I", data, 4)[0]
    n = struct.unpack_from(f"{order}H", data, at)[0]
    if struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]:
        raise ValueError("several_images")
    out = {}
    for k in range(n):
        entry = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, entry)
        size = TYPE_BYTES.get(kind, 0) * count
        where = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", data, entry + 8)[0]
        if kind in (1, 3, 4):
            out[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", data, where))
        elif kind == 5:
            top, bottom = struct.unpack_from(f"{order}II", data, where)
            out[tag] = [round(100 * top / max(bottom, 1))]
    return out


def _page(data: bytes) -> tuple[float, float, list[tuple[bytes, str, float, float]]]:
    """(width, height, [(data, dictionary, bottom, height)]) of a page in points: one picture for
    each strip, from the top down."""
    f = _fields(data)
    width, height, coding = f[WIDTH][0], f[HEIGHT][0], f.get(CODING, [PLAIN])[0]
    bits, samples, photometric = f.get(BITS, [1])[0], f.get(SAMPLES, [1])[0], f.get(PHOTOMETRIC, [0])[0]
    if coding not in (PLAIN, GROUP_4) or photometric > 2 or (coding == GROUP_4 and bits * samples > 1):
        raise ValueError("unsupported_coding")
    inch = 2.54 if f.get(UNIT, [2])[0] == 3 else 1.0
    points = 7200 / (f.get(RESOLUTION, [7200])[0] * inch or 7200)
    rows, strips, left = f.get(ROWS, [height])[0], [], height
    for offset, count in zip(f[OFFSETS], f[COUNTS]):
        here = min(rows, left)
        left -= here
        raw = data[offset : offset + count]
        white_first = photometric == 0
        space = "/DeviceRGB" if samples == 3 else "/DeviceGray"
        said = f"/Type /XObject /Subtype /Image /Width {width} /Height {here} /ColorSpace {space} /BitsPerComponent {bits}"
        if coding == GROUP_4:
            said += f" /Filter /CCITTFaxDecode /DecodeParms << /K -1 /Columns {width} /Rows {here} /BlackIs1 {'false' if white_first else 'true'} >>"
        else:
            raw = zlib.compress(raw)
            said += " /Filter /FlateDecode" + (" /Decode [1 0]" if white_first else "")
        strips.append((raw, said, left * points, here * points))
    return width * points, height * points, strips


def pdf(pages: list[bytes]) -> bytes:
    """The PDF of these pages in order; ValueError where a page can't be taken over."""
    if not pages:
        raise ValueError("no_pages")
    objects: list[bytes] = [b"", b""]  # catalogue and page tree, written last
    kids = []
    for data in pages:
        try:
            width, height, strips = _page(data)
        except (struct.error, KeyError, IndexError) as e:
            raise ValueError("damaged") from e
        names, drawn = [], []
        for k, (raw, said, bottom, tall) in enumerate(strips):
            objects.append(f"<< {said} /Length {len(raw)} >>\nstream\n".encode() + raw + b"\nendstream")
            names.append(f"/I{k} {len(objects)} 0 R")
            drawn.append(f"q {width:.3f} 0 0 {tall:.3f} 0 {bottom:.3f} cm /I{k} Do Q")
        content = "\n".join(drawn).encode()
        objects.append(b"<< /Length %d >>\nstream\n" % len(content) + content + b"\nendstream")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width:.3f} {height:.3f}] /Resources << /XObject << {' '.join(names)} >> >> /Contents {len(objects)} 0 R >>".encode())
        kids.append(f"{len(objects)} 0 R")
    objects[0], objects[1] = b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode()
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table))


def merged(pages: DataFrame, key: str, page: str = "page", content: str = "content", expected: str | None = None) -> DataFrame:
    """key, content, pages, error: one PDF of the TIFF pages of each document in the order of `page`.
    With `expected` (a column) a document that has another number of pages gives an error.

    The pages of one document come together in one task; a document is a bounded group (see the
    limits of pages where they are fetched)."""
    whole = pages.groupBy(F.col(key).cast("string").alias(key)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(content).alias("c")))), lambda x: x["c"]).alias("all"), F.max(F.col(expected) if expected else F.lit(None).cast("int")).cast("int").alias("want")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, parts, want in zip(*(batch.column(c).to_pylist() for c in (key, "all", "want"))):
                made, wrong = None, "page_count" if want is not None and want != len(parts) else None
                try:
                    made = None if wrong else pdf(parts)
                except ValueError as e:
                    wrong = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([made], pa.binary()), pa.array([len(parts)], pa.int32()), pa.array([wrong], pa.string())], names=[key, "content", "pages", "error"])

    return whole.mapInArrow(run, f"`{key}` string, content binary, pages int, error string")

"""Members of ZIP archives and blocks of word-processor files as rows.

Archives arrive as rows of the binary-file source (path, content); each is opened in the
worker that holds it. Limits guard against archive bombs and unsafe paths. A bad archive gives
one row with an error and no job fails.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of an archive.
MAX_ENTRIES = 5000
MAX_EXPANDED = 200 * 1024 * 1024
MAX_RATIO, RATIO_FROM = 1000, 10 * 1024 * 1024

MEMBER = "path string, member string, pos int, size long, compressed long, content binary, error string"


def unsafe(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return name.startswith(("/", "\\")) or ":" in parts[0] or ".." in parts or "\0" in name


def checked(archive: zipfile.ZipFile) -> str | None:
    """What is wrong with an archive, else None."""
    infos = archive.infolist()
    if len(infos) > MAX_ENTRIES:
        return "too_many_entries"
    if sum(i.file_size for i in infos) > MAX_EXPANDED:
        return "too_large"
    for i in infos:
        if unsafe(i.filename):
            return "unsafe_path"
        if i.file_size > RATIO_FROM and i.file_size > MAX_RATIO * max(1, i.compress_size):
            return "suspicious_ratio"
    return None


def members(files: DataFrame) -> DataFrame:
    """One row for each member of the archives in `files` (path, content)."""

    def open_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "member", "pos", "size", "compressed", "content", "error"]
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows: list[tuple] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                        wrong = checked(archive)
                        if wrong:
                            rows.append((path, None, None, None, None, None, wrong))
                        else:
                            rows += [(path, i.filename, k, i.file_size, i.compress_size, archive.read(i), None) for k, i in enumerate(archive.infolist()) if not i.is_dir()]
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError) as e:
                    rows = [(path, None, None, None, None, None, f"unreadable: {type(e).__name__}")]
                cols = list(zip(*rows)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return files.select("path", "content").mapInArrow(open_all, MEMBER)


def file_type(name: Column, content: Column) -> Column:
    """pdf, doc, docx or zip by extension and first bytes, null where they don't agree."""
    head, low = F.hex(F.substring(content, 1, 8)), F.lower(name)
    return (
        F.when(low.endswith(".pdf") & head.startswith("255044462D"), "pdf")
        .when(low.endswith(".doc") & (head == "D0CF11E0A1B11AE1"), "doc")
        .when(low.endswith(".docx") & head.startswith("504B0304"), "docx")
        .when(low.endswith(".zip") & head.startswith("504B0304"), "zip")
    )


# Media types of the kinds of upload.
MEDIA = {
    "pdf": ["application/pdf"],
    "doc": ["application/msword", "application/octet-stream"],
    "docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/zip", "application/x-zip-compressed", "application/octet-stream"],
}


def upload_error(name: Column, media: Column, content: Column, members: Column) -> Column:
    """What is wrong with an upload, null if nothing: `unsupported_file_type` by extension,
    `file_signature_mismatch` where media type, first bytes or the members of a word-processor
    file (array of their names) don't fit it."""
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    plain = F.lower(F.trim(F.split_part(media, F.lit(";"), F.lit(1))))
    fits = F.lit(False)
    for kind, types in MEDIA.items():
        fits = fits | ((extension == kind) & plain.isin(*types))
    whole = (extension != "docx") | (F.array_contains(members, "[Content_Types].xml") & F.array_contains(members, "word/document.xml"))
    good = fits & F.coalesce(file_type(name, content) == extension, F.lit(False)) & F.coalesce(whole, F.lit(False))
    return F.when(~extension.isin(*MEDIA), "unsupported_file_type").when(~F.coalesce(good, F.lit(False)), "file_signature_mismatch")


def intake(files: DataFrame, key: str, name: str, size: str, most: int = 5, most_bytes: int = 50 * 1024**2, most_total: int = 100 * 1024**2) -> DataFrame:
    """`files` with error: too_many_files, file_too_large or request_too_large by the limits of
    one request (key), else null. Sums run over each request in the order of names."""
    upto = Window.partitionBy(key).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    error = F.when(F.count("*").over(whole) > most, "too_many_files").when(F.col(size) > most_bytes, "file_too_large").when(F.sum(size).over(upto) > most_total, "request_too_large")
    return files.withColumn("error", error)


def page_flags(listing: Column) -> Column:
    """Array of struct(page, part) of a page list: lines `<DP ... IMA=n AB|DE|CL|DR=1>`."""
    parts = {"AB": "abstract", "DE": "description", "CL": "claims", "DR": "description_drawings"}
    names = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
    entries = F.regexp_extract_all(listing, F.lit(r"(?i)<DP\b([^>]*)>"), F.lit(1))
    # The first flag of an entry says its part.
    flags = F.transform(
        entries, lambda e: F.struct(F.regexp_extract(e, r"(?i)\bIMA=([^\s>]+)", 1).alias("page"), F.element_at(names, F.upper(F.regexp_extract(e, r"(?i)\b(AB|DE|CL|DR)=1\b", 1))).alias("part"))
    )
    return F.filter(flags, lambda x: (x["page"] != "") & x["part"].isNotNull())


def sheet_order(listing: Column, members: Column) -> Column:
    """The image members of an archive in the order of the numbers of its page list, by name
    where it has none of them."""
    images = F.filter(members, lambda m: F.lower(m).rlike(r"\.tiff?$") & ~m.contains("/"))
    entries = F.regexp_extract_all(F.coalesce(listing, F.lit("")), F.lit(r"(?i)(<DP\b[^>]*>)"), F.lit(1))
    numbered = F.transform(
        entries, lambda e: F.struct(F.regexp_extract(e, r"(?i)\bN=\"?(\d+)", 1).try_cast("int").alias("n"), F.lower(F.regexp_extract(e, r"(?i)\bIMA=\"?([^\s>\"]+)", 1)).alias("name"))
    )
    found = F.filter(
        F.transform(numbered, lambda x: F.struct(x["n"].alias("n"), F.get(F.filter(images, lambda m: F.lower(m) == x["name"]), F.lit(0)).alias("member"))),
        lambda x: x["n"].isNotNull() & x["member"].isNotNull(),
    )
    return F.when(F.size(found) > 0, F.transform(F.array_sort(found), lambda x: x["member"])).otherwise(F.array_sort(images))


def resolved(references: DataFrame, rows: DataFrame) -> DataFrame:
    """`references` (path, reference) with member: the member of that name in any case, else
    the only one of that base name."""
    exact = rows.filter("member is not null").select("path", F.lower("member").alias("_key"), F.col("member").alias("_exact"))
    base = F.lower(F.substring_index("member", "/", -1))
    single = rows.filter("member is not null").groupBy("path", base.alias("_base")).agg(F.min("member").alias("_single"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    out = references.withColumn("_key", F.lower("reference")).withColumn("_base", F.lower(F.substring_index("reference", "/", -1)))
    out = out.join(exact, ["path", "_key"], "left").join(single, ["path", "_base"], "left")
    return out.withColumn("member", F.coalesce("_exact", "_single")).drop("_key", "_base", "_exact", "_single")


class _Story:
    """Events of a word-processor document gathered into its blocks, the children of the body:
    (text, ids of the images) of each. Names count without their spaces."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, list[str]]] = []
        self.open: list[str] = []
        self.block_depth = self.deleted = 0
        self.pieces: list[str] = []
        self.images: dict[str, None] = {}

    def start(self, name: str, attributes: dict[str, str]) -> None:
        local = name.rsplit(" ", 1)[-1]
        self.open.append(local)
        if self.block_depth == 0 and self.open[-2:-1] == ["body"]:
            self.block_depth, self.pieces, self.images = len(self.open), [], {}
        if local == "del":
            self.deleted += 1
        if local in ("tab", "br", "cr"):
            self.put(" ")
        if local in ("blip", "imagedata"):
            by_name = {k.rsplit(" ", 1)[-1]: v for k, v in attributes.items() if "relationships" in k}
            target = by_name.get("embed") or by_name.get("id")
            if target:
                self.images.setdefault(target)

    def put(self, text: str) -> None:
        if self.block_depth and not self.deleted:
            self.pieces.append(text)

    def text(self, data: str) -> None:
        if self.open and self.open[-1] == "t":
            self.put(data)

    def end(self, name: str) -> None:
        if len(self.open) == self.block_depth:
            self.blocks.append((" ".join("".join(self.pieces).split()), list(self.images)))
            self.block_depth = 0
        if self.open.pop() == "del":
            self.deleted -= 1


def _refused(*_: object) -> None:
    raise ValueError("entities")


def story(xml: bytes) -> list[tuple[str, list[str]]]:
    """(visible text, ids of images) of each block of a document: tabs and breaks are spaces,
    deleted text is left out. Documents that declare entities raise ValueError."""
    gathered, parser = _Story(), expat.ParserCreate(namespace_separator=" ")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = gathered.start, gathered.end, gathered.text
    parser.EntityDeclHandler = _refused
    parser.Parse(xml, True)
    return gathered.blocks


def relationships(xml: bytes, base: str = "word") -> dict[str, str]:
    """Member by relationship id; targets outside the archive are left out."""
    out: dict[str, str] = {}

    def start(name: str, attributes: dict[str, str]) -> None:
        target = attributes.get("Target", "").replace("\\", "/")
        if name.rsplit(" ", 1)[-1] == "Relationship" and target and attributes.get("TargetMode", "").lower() != "external":
            # What climbs above the top ends at the top.
            out[attributes.get("Id", "")] = posixpath.normpath(posixpath.join("/", base, target)).lstrip("/")

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.StartElementHandler, parser.EntityDeclHandler = start, _refused
    parser.Parse(xml, True)
    return out


def _word_file(content: bytes | None) -> tuple[list[tuple[str, list[tuple[str, bytes]]]], str | None]:
    """([(text, [(member, image)])], error) of a word-processor file."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
            wrong = checked(archive)
            if wrong:
                return [], wrong
            names = {i.filename.lower(): i.filename for i in archive.infolist()}
            links = relationships(archive.read(names["word/_rels/document.xml.rels"])) if "word/_rels/document.xml.rels" in names else {}
            out = []
            for text, ids in story(archive.read("word/document.xml")):
                found = [names[links[i].lower()] for i in ids if i in links and links[i].lower() in names]
                out.append((text, [(m, archive.read(m)) for m in found]))
            return out, None
    except ValueError as e:
        return [], str(e)
    except (zipfile.BadZipFile, KeyError, expat.ExpatError, OSError) as e:
        return [], f"unreadable: {type(e).__name__}"


def blocks(files: DataFrame) -> DataFrame:
    """path, seq, text, error: the non-blank blocks of word-processor files in order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["path", "seq", "text", "error"], [pa.string(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                found, wrong = _word_file(content)
                rows += [(path, None, None, wrong)] if wrong else [(path, k, t, None) for k, (t, _) in enumerate(found) if t]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return files.select("path", "content").mapInArrow(read, "path string, seq int, text string, error string")


def block_images(files: DataFrame) -> DataFrame:
    """path, seq, member, sha256, content: the images of the blocks of word-processor files, each
    picture once in a file, where it stands first."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["path", "seq", "member", "sha256", "content"], [pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                seen: set[str] = set()
                for k, (_, images) in enumerate(_word_file(content)[0]):
                    for member, data in images:
                        digest = hashlib.sha256(data).hexdigest()
                        if digest not in seen:
                            seen.add(digest)
                            rows.append((path, k, member, digest, data))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return files.select("path", "content").mapInArrow(read, "path string, seq int, member string, sha256 string, content binary")

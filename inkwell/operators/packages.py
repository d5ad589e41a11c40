"""Publication packages: archives with the XML, page list and page images of one publication.

Each XML member is read once, event by event, into the few elements that carry parts; what
remains are rules over small arrays in one row for each archive: which XML counts, which
language, whether text or page images stand for a part. Page images are rows of their own, so
recognition runs distributed and its results come back by a join.

Defined results: an archive that can't be read, or holds no publication, gives one row with an
error and no parts; blank text counts as none; references to members that aren't there are left
out; repeated archives give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.functions.language import detected_code, label_code
from inkwell.sources.archives import page_flags

# Roots of publications, the usual name of the XML, elements that carry parts.
ROOTS = {"wipo": ["wo-published-application", "wo-patent-document"], "epo": ["ep-patent-document"]}
USUAL_NAME = {"wipo": "wo-published-application.xml"}
ELEMENTS = ["abstract", "abstract-figure", "description", "claims", "drawings"]
PICTURES = ["img", "doc-page"]
# Order of languages where the wanted one is missing.
LANGUAGE_ORDER = ["en", "de", "fr"]

NODE = "struct<element:string,lang:string,text:string,files:array<string>>"


def _refused(*_: object) -> None:
    raise ValueError("entities")


def _read(xml: bytes) -> tuple[str, str, list[dict]]:
    """(root, its language, nodes) of a document: every element of ELEMENTS, nested ones too,
    with all its text run together and the files of the pictures below it."""
    nodes: list[dict] = []
    path: list[dict | None] = []
    root: list[str] = []

    def start(name: str, attributes: dict[str, str]) -> None:
        local = name.rsplit(" ", 1)[-1]
        if not root:
            root.extend((local, attributes.get("lang", "").lower()))
        node = None
        if local in ELEMENTS:
            node = {"element": local, "lang": attributes.get("lang", "").lower(), "text": [], "files": {}}
            nodes.append(node)
        path.append(node)
        if local in PICTURES and attributes.get("file"):
            for above in filter(None, path):
                above["files"].setdefault(attributes["file"])

    def text(data: str) -> None:
        for above in filter(None, path):
            above["text"].append(data)

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = start, text, lambda _: path.pop()
    parser.EntityDeclHandler = _refused
    parser.Parse(xml, True)
    return root[0], root[1], [{**n, "text": " ".join("".join(n["text"]).split()), "files": list(n["files"])} for n in nodes]


def documents(members: DataFrame) -> DataFrame:
    """path, member, pos, root, lang, nodes of the XML members; root is null where one can't be
    read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = pa.struct([("element", pa.string()), ("lang", pa.string()), ("text", pa.string()), ("files", pa.list_(pa.string()))])
        for batch in batches:
            rows = []
            for content in batch.column("content").to_pylist():
                try:
                    rows.append(_read(content or b""))
                except (expat.ExpatError, ValueError):
                    rows.append((None, None, None))
            cols = list(zip(*rows)) if rows else [[]] * 3
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.list_(node)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "member", "pos")), *arrays], names=["path", "member", "pos", "root", "lang", "nodes"])

    xml = members.filter(F.lower("member").endswith(".xml")).select("path", "member", "pos", "content")
    return xml.mapInArrow(run, f"path string, member string, pos int, root string, lang string, nodes array<{NODE}>")


def by_language(entries: Column, wanted: Column) -> Column:
    """The entry (struct with lang) in the wanted language, else by LANGUAGE_ORDER, else the first."""
    first = lambda lang: F.get(F.filter(entries, lambda e: (lang != "") & (e["lang"] == lang)), F.lit(0))
    return F.coalesce(first(wanted), *(first(F.lit(x)) for x in LANGUAGE_ORDER), F.get(entries, F.lit(0)))


def figure_entry(entries: Column, wanted: Column) -> Column:
    """The entry in the wanted language, else the first without any, else the first."""
    first = lambda keep: F.get(F.filter(entries, keep), F.lit(0))
    return F.coalesce(first(lambda e: (wanted != "") & (e["lang"] == wanted)), first(lambda e: e["lang"] == ""), F.get(entries, F.lit(0)))


def _of(element: str) -> Column:
    return F.filter("nodes", lambda n: n["element"] == element)


def _files(entries: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(entries, lambda n: n["files"])))


def _part(name: str, text: Column, files: Column, language: Column, sparse: bool = False) -> Column:
    none = F.array().cast("array<string>")
    text = F.coalesce(text, F.lit(""))
    return F.struct(
        F.lit(name).alias("part"), text.alias("text"), F.when(text == "", F.coalesce(files, none)).otherwise(none).alias("files"), language.alias("language"), F.lit(sparse).alias("sparse")
    )


def publications(members: DataFrame, source: str) -> DataFrame:
    """One row for each archive: path, member (the XML that counts), lang, nodes, listing (its
    page list), error. The XML is the one of the usual name, else the first with a root of the
    source."""
    read = documents(members)
    usual = F.lower("member") == F.lit(USUAL_NAME.get(source, "\0"))
    fits = usual | F.col("root").isin(*ROOTS[source])
    picked = read.filter(fits).groupBy("path").agg(F.min_by(F.struct("member", "root", "lang", "nodes"), F.struct(F.when(usual, 0).otherwise(1), "pos")).alias("d"))
    base = F.lower(F.substring_index("member", "/", -1))
    lists = members.filter(base == "pag.lst").groupBy("path").agg(
        F.min_by("content", F.when(F.lower("member") == "pag.lst", 0).otherwise(1)).alias("content"), F.count("*").alias("n"), F.max(F.lower("member") == "pag.lst").alias("exact")
    )
    lists = lists.filter("exact or n = 1").select("path", F.decode("content", "ISO-8859-1").alias("listing"))
    errors = members.groupBy("path").agg(F.max("error").alias("_wrong"))
    rows = errors.join(picked, "path", "left").join(lists, "path", "left")
    error = F.coalesce("_wrong", F.when(F.col("d").isNull(), "no_publication").when(F.col("d.root").isNull(), "unreadable"))
    return rows.select("path", "d.member", "d.lang", "d.nodes", F.coalesce("listing", F.lit("")).alias("listing"), error.alias("error"))


def parts(members: DataFrame, source: str, default: str = "en") -> DataFrame:
    """path, part, text, method, confidence, files, language, sparse, error: the five parts of each
    publication. A part without text may have files, the page images to be recognised (sparse:
    drawings). Parts with neither are missing."""
    rows = publications(members, source)
    whole = lambda e: F.trim(F.array_join(F.transform(_of(e), lambda n: n["text"]), " "))
    if source == "wipo":
        rows = rows.withColumn("_a", by_language(_of("abstract"), F.col("lang"))).withColumn("_flags", page_flags(F.col("listing")))
        rows = rows.withColumn("_l", detected_code(F.col("_a.text"), F.col("_a.lang"), default))
        flagged = lambda part: F.transform(F.filter("_flags", lambda f: f["part"] == part), lambda f: f["page"])
        pictures = lambda e, part: F.when(F.size(_files(_of(e))) > 0, _files(_of(e))).otherwise(flagged(part))
        figure = figure_entry(_of("abstract-figure"), F.coalesce("_a.lang", F.lit("")))
        lang = F.col("_l")
        made = [
            _part("abstract", F.col("_a.text"), F.when(F.col("_a").isNull(), flagged("abstract")), lang),
            _part("abstract_drawing", F.lit(""), figure["files"], lang, True),
            *(_part(e, whole(e), pictures(e, e), lang) for e in ("description", "claims")),
            _part("description_drawings", F.lit(""), pictures("drawings", "description_drawings"), lang, True),
        ]
    else:
        texts = ("abstract", "description", "claims")
        rows = rows.withColumn("_p", F.array(*(by_language(_of(e), F.col("lang")) for e in texts)))
        # One lambda: the markers of all languages stand in the plan once.
        rows = rows.withColumn("_told", F.transform("_p", lambda p: detected_code(p["text"], p["lang"], None)))
        # The language of the document: that of the abstract, or of the first part that tells one.
        made, at = [], label_code(F.col("lang"), default)
        for k, e in enumerate(texts):
            own = F.coalesce(F.col("_told")[k], at)
            made.append(_part(e, F.col("_p")[k]["text"], _files(_of(e)), own))
            at = own if e == "abstract" else F.when(at == label_code(F.lit(default), default), own).otherwise(at)
        rows = rows.withColumn("_at", at)
        last = F.col("_at")
        made.insert(1, _part("abstract_drawing", F.lit(""), F.col("_p")[0]["files"], last, True))
        made.append(_part("description_drawings", F.lit(""), _files(_of("drawings")), last, True))
    out = rows.select("path", "error", F.explode(F.when(F.col("error").isNull(), F.array(*made)).otherwise(F.array().cast("array<struct<part:string,text:string,files:array<string>,language:string,sparse:boolean>>"))).alias("p"))
    bad = rows.filter("error is not null").select("path", "error")
    out = out.select("path", "p.part", "p.text", "p.files", "p.language", "p.sparse", "error").unionByName(bad, allowMissingColumns=True)
    has = F.col("text") != ""
    return out.withColumn("method", F.when(has, f"{source}_xml").otherwise("none")).withColumn("confidence", F.when(has, "high").otherwise("none"))


def images(rows: DataFrame, members: DataFrame) -> DataFrame:
    """path, part, nth, member, content, language, sparse: the page images of the parts in order,
    each member once for a part. A reference is a member's name in any case, else the only one of
    that base name; unsafe ones are none."""
    asked = rows.select("path", "part", "language", "sparse", F.posexplode("files").alias("nth", "reference"))
    plain = F.replace("reference", F.lit("\\"), F.lit("/"))
    asked = asked.withColumn("reference", plain).filter(~F.col("reference").rlike(r"^/|(^|/)\.\.(/|$)|^[A-Za-z]:"))
    files = members.filter("member is not null").select("path", "member", "content")
    exact = files.select("path", F.lower("member").alias("_key"), F.col("member").alias("_exact"))
    base = F.lower(F.substring_index("member", "/", -1))
    single = files.groupBy("path", base.alias("_base")).agg(F.min("member").alias("_single"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    found = asked.withColumn("_key", F.lower("reference")).withColumn("_base", F.lower(F.substring_index("reference", "/", -1)))
    found = found.join(exact, ["path", "_key"], "left").join(single, ["path", "_base"], "left").withColumn("member", F.coalesce("_exact", "_single"))
    once = found.filter("member is not null").groupBy("path", "part", "member").agg(F.min("nth").alias("nth"), F.first("language").alias("language"), F.first("sparse").alias("sparse"))
    return once.join(files, ["path", "member"]).select("path", "part", "nth", "member", "content", "language", "sparse")


def filled(rows: DataFrame, results: DataFrame) -> DataFrame:
    """`rows` as by parts() with the recognised text of `results` (path, part, nth, text,
    confidence) in the parts that have none: cleaned, joined in order, with the lowest band.
    Adds status: found, missing, or error where every page of a part failed."""
    clean = results.withColumn("text", tx.cleaned_page(F.coalesce("text", F.lit("")))).withColumn("band", tx.confidence_band(F.col("confidence")))
    rank = F.element_at(F.create_map(*[F.lit(x) for x in ("low", 1, "medium", 2, "high", 3)]), F.col("band"))
    some = F.col("text") != ""
    joined = clean.groupBy("path", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(some, F.struct("nth", "text")))), lambda x: x["text"]), " ").alias("_text"),
        F.min_by(F.when(some, F.col("band")), F.when(some, rank)).alias("_band"),
    )
    out = rows.join(joined, ["path", "part"], "left")
    take = (F.coalesce("text", F.lit("")) == "") & (F.coalesce("_text", F.lit("")) != "")
    tried = F.col("_text").isNotNull()
    status = F.when((F.coalesce("text", F.lit("")) != "") | take, "found").when(tried, "error").otherwise("missing")
    return out.select(
        "path", "part", F.when(take, F.col("_text")).otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.when(take | (tried & (status == "error")), "ocr").otherwise(F.col("method")).alias("method"),
        F.when(take, F.col("_band")).otherwise(F.col("confidence")).alias("confidence"), "language", status.alias("status"), "error",
    )

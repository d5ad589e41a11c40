"""Queries over payloads that are built from whole tables on the way: archives, XML and JSON
answers, word-processor files. The SQL states the results from the tables alone."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import identifiers as ids
from inkwell.functions import records
from inkwell.functions.integrity import error_body, expires_at, iso_instant
from inkwell.operators import answers, duplicates, lookups, markup, packages, recognition, resolution, sections
from inkwell.plans import reference
from inkwell.session import table
from inkwell.sinks import files as file_sinks
from inkwell.sinks import tables as table_sinks
from inkwell.sources import archives


def _escaped(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return F.coalesce(text, F.lit(""))


def _element(name: str, inner: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attributes}>"), inner, F.lit(f"</{name}>"))


def _zipped(rows: DataFrame, key: str, members: list[str]) -> DataFrame:
    """path and content of an archive for each row: the columns after the first one are the
    contents of `members`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values in zip(*(batch.column(c).to_pylist() for c in range(1, batch.num_columns))):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    for name, value in zip(members, values):
                        if value is not None:
                            z.writestr(name, value)
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    return rows.withColumn(key, F.col(key).cast("string")).mapInArrow(run, "path string, content binary")


def package_parts(spark: SparkSession, d: str) -> DataFrame:
    """Every answer as an international package with abstract, description and two claim pages."""
    rows = table(spark, d, "lookup_responses")
    abstract = F.when(F.col("abstract").isNotNull(), _element("abstract", _escaped(F.col("abstract")), ' lang="en"'))
    xml = _element("wo-published-application", F.concat(F.coalesce(abstract, F.lit("")), _element("description", _element("p", _escaped(F.col("filed_abstract")))), F.lit("<claims/>")), ' lang="en"')
    listing = F.lit("<DP N=2 IMA=c2.tif CL=1>\n<DP N=1 IMA=C1.TIF CL=1>\n<DP N=3 IMA=gone.tif AB=1>")
    made = _zipped(rows.select("response_id", xml.alias("a"), listing.alias("b"), F.lit("1").alias("c"), F.lit("2").alias("d")), "response_id", ["wo-published-application.xml", "Pag.lst", "c1.tif", "x/c2.tif"])
    members = archives.members(made)
    parts = packages.parts(members, "wipo")
    pictures = packages.images(parts, members).groupBy("path", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "member"))), lambda x: x["member"]), " ").alias("pages"))
    out = parts.join(pictures, ["path", "part"], "left")
    return out.select(F.col("path").cast("bigint").alias("response_id"), "part", "text", "method", F.coalesce("pages", F.lit("")).alias("pages"))


def word_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every draft as a word-processor file of its lines."""
    rows = table(spark, d, "part_drafts").filter("text is not null")
    line = lambda x: _element("w:p", _element("w:r", _element("w:t", _escaped(x))))
    body = _element("w:body", F.array_join(F.transform(F.split("text", "\n"), line), ""))
    xml = _element("w:document", body, ' xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"')
    found = archives.blocks(_zipped(rows.select("draft_id", xml.alias("a")), "draft_id", ["word/document.xml"]))
    return found.select(F.col("path").cast("bigint").alias("draft_id"), "seq", "text")


def json_records(spark: SparkSession, d: str) -> DataFrame:
    """Every answer in the JSON of the international service."""
    rows = table(spark, d, "lookup_responses").select("response_id", "title", "abstract", "applicants", "inventors", "ipc", "normalized_number")
    claims = table(spark, d, "priority_claims").groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", "number", "date", "country", "kind"))).alias("cs"))
    rows = rows.join(claims, "response_id", "left")
    party = lambda names, group, item, field: F.struct(F.transform(names, lambda n: F.struct(F.struct(F.struct(n.alias("value")).alias(field)).alias("addressbook"))).alias(item)).alias(group)
    claim = lambda c: F.struct(F.struct(c["number"].alias("doc-number"), c["date"].alias("date"), c["country"].alias("country"), c["kind"].alias("kind")).alias("priority-claim"))
    biblio = F.struct(
        F.array(F.struct(F.lit("fr").alias("lang"), F.array(F.lit("autre")).alias("content")), F.struct(F.lit("EN").alias("lang"), F.array("title").alias("content"))).alias("invention-title"),
        F.struct(party(F.col("applicants"), "applicants", "applicant", "orgname"), party(F.col("inventors"), "inventors", "inventor", "name")).alias("parties"),
        F.struct(F.transform("ipc", lambda x: F.struct(x.alias("text"))).alias("classification-ipcr")).alias("classifications-ipcr"),
        F.struct(F.struct(F.lit("WO").alias("country"), F.col("normalized_number").alias("doc-number"), F.lit("A1").alias("kind")).alias("document-id")).alias("publication-reference"),
        F.struct(F.transform("cs", claim).alias("items")).alias("wo-priority-info"),
    )
    payload = F.to_json(F.struct(biblio.alias("wo-bibliographic-data"), F.array(F.struct(F.lit("en").alias("lang"), F.col("abstract").alias("p"))).alias("abstract")))
    made = answers.records(rows.select("response_id", payload.alias("payload")), "response_id", "payload")
    joined = lambda c: F.array_join(c, " | ")
    return made.select(
        "response_id", "title", "abstract", joined("applicants").alias("applicants"), joined("inventors").alias("inventors"), joined("ipc").alias("ipc"), "publication_number",
        joined(F.transform("priority_data", lambda p: p["number"])).alias("priorities"), "error",
    )


def _exchange(d: Column, number: Column, title: Column, abstract: Column, applicants: Column) -> Column:
    names = F.array_join(F.transform(applicants, lambda n: _element("applicant", _element("applicant-name", _element("name", _escaped(n))))), "")
    ident = _element("document-id", F.concat(F.lit("<country>XX</country>"), _element("doc-number", number), F.lit("<kind>A1</kind><date>20200102</date>")), ' document-id-type="docdb"')
    biblio = F.concat(_element("publication-reference", ident), _element("parties", _element("applicants", names)), F.when(title.isNotNull(), _element("invention-title", _escaped(title), ' lang="en"')).otherwise(F.lit("")))
    doc = F.concat(F.lit('<exchange-document country="XX" doc-number="'), d, F.lit('" kind="A1">'), _element("bibliographic-data", biblio), _element("abstract", _element("p", _escaped(abstract)), ' lang="en"'), F.lit("</exchange-document>"))
    return _element("world-patent-data", _element("exchange-documents", doc))


def _compact() -> Column:
    return F.regexp_replace("normalized_number", "[^0-9]", "")


def exchange_records(spark: SparkSession, d: str) -> DataFrame:
    """Every answer as an exchange document in XML."""
    rows = table(spark, d, "lookup_responses")
    xml = _exchange(_compact(), _compact(), F.col("title"), F.col("abstract"), F.col("applicants"))
    out = rows.select("response_id", records.exchange_record(xml).alias("r"))
    return out.select(
        "response_id", F.coalesce("r.biblio.title", F.lit("")).alias("title"), "r.abstract", F.array_join("r.biblio.applicants", " | ").alias("applicants"),
        F.col("r.biblio.publication_number").alias("publication_no"), F.col("r.biblio.publication_date").alias("publication_date"),
    )


def european_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every European answer looked up again from the constituents its rows allow: biblio always,
    claims where it has priority claims, a family of those claims' numbers."""
    rows = table(spark, d, "lookup_responses").filter("source = 'epo'")
    reference = ids.normalized_number(F.col("normalized_number"))
    requests = rows.select(F.col("response_id").alias("key"), reference.alias("reference"))
    biblio = rows.select(F.col("response_id").alias("key"), F.lit("biblio").alias("constituent"), _exchange(_compact(), _compact(), F.col("title"), F.col("abstract"), F.col("applicants")).alias("payload"))
    per = table(spark, d, "priority_claims").filter("number <> ''").groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", "number"))).alias("cs"))
    per = per.join(rows.select("response_id"), "response_id", "left_semi")
    wrap = lambda name, inner: _element("world-patent-data", _element(name, inner))
    texts = F.array_join(F.transform("cs", lambda c: _element("claim", _element("claim-text", F.concat(F.lit("1. a claim of "), F.regexp_replace(c["number"], "[^0-9A-Za-z]", ""))))), "")
    claims = per.select(F.col("response_id").alias("key"), F.lit("claims").alias("constituent"), wrap("fulltext-documents", _element("fulltext-document", _element("claims", texts, ' lang="en"'))).alias("payload"))
    member = lambda c: _element("family-member", _element("publication-reference", _element("document-id", _element("doc-number", F.regexp_replace(c["number"], "[^0-9A-Za-z]", "")), ' document-id-type="epodoc"')))
    family = per.select(F.col("response_id").alias("key"), F.lit("family").alias("constituent"), wrap("patent-family", F.array_join(F.transform("cs", member), "")).alias("payload"))
    payloads = biblio.unionByName(claims).unionByName(family).withColumn("outcome", F.lit("ok"))
    out = lookups.european(requests, payloads)
    return out.select(
        F.col("key").alias("response_id"), "outcome", F.coalesce("title", F.lit("")).alias("title"), "publication_no", F.col("claims_count").cast("bigint").alias("claims_count"),
        F.size("related").cast("bigint").alias("related"), F.array_join(F.transform("warnings", lambda w: w["field"]), " ").alias("lacking"),
    )


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lookup_responses").filter("source = 'epo'")
    snapshot = F.to_json(F.struct("source", "normalized_number", "display_number", "title", "applicants", F.col("application_date").alias("application_date"), F.lit(3).alias("claims_count")), {"ignoreNullFields": "false"})
    return rows.select(F.col("response_id").alias("id"), "source", "normalized_number", snapshot.alias("metadata_snapshot"), "last_successful_fetch_at")


def snapshot_checks(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "patent_lookup_events").select(F.col("response_id").alias("patent_id"))
    return lookups.snapshot_counts(_snapshots(spark, d), links)


def cached_answers(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "patent_lookup_events").select(F.col("response_id").alias("patent_id"))
    return lookups.snapshots(_snapshots(spark, d), links).select("id", F.col("answer")["title"].alias("title"), F.size("answer").cast("bigint").alias("members"), "data_origin", "reason")


def stored_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lookup_responses").select("response_id", "source", "normalized_number", "display_number", "application_no", F.lit("").alias("publication_no"), "title", "publication_date")
    flat = rows.filter("source = 'epo'")
    nested = rows.filter("source <> 'epo'").select("response_id", "source", "normalized_number", "display_number", F.lit(None).cast("string").alias("application_no"), "publication_no", F.lit("").alias("publication_date"), F.struct("title", F.col("application_no").alias("application_number"), "publication_date").alias("basic_info"))
    out = lookups.stored_rows(flat, nested, F.lit("now"))
    return out.select(F.get_json_object("metadata_snapshot", "$.response_id").cast("bigint").alias("response_id"), "source", "jurisdiction", "application_no", "publication_no", "title", "publication_date")


def number_forms(spark: SparkSession, d: str) -> DataFrame:
    """Forms under which services know the numbers asked for."""
    asked = table(spark, d, "lookup_responses").select("normalized_number").distinct()
    r = ids.normalized_number(F.col("normalized_number"))
    rows = asked.withColumn("r", r).filter("r.error_code is null")
    ref = F.col("r")
    return rows.select(
        "normalized_number", ids.pct_number(ref["country_code"], ref["doc_number"]).alias("pct"), F.array_join(ids.service_identifiers(ref), " ").alias("identifiers"),
        ids.response_number(ref, F.lit("full")).alias("shown"), F.array_join(ids.application_kinds(ref["kind_code"]), " ").alias("kinds"),
        ids.same_patent(F.col("normalized_number"), ref["display_number"]).alias("same"),
    )


def original_documents(spark: SparkSession, d: str) -> DataFrame:
    """Of each file's drafts the original as the older service ranks codes, and the XML page."""
    codes = F.create_map(*[F.lit(x) for kv in {"description": "PUB", "abstract": "APBDY", "claims": "A2"}.items() for x in kv])
    rows = table(spark, d, "part_drafts").select("file_id", F.col("part").alias("document_id"), F.coalesce(F.element_at(codes, F.col("part")), F.lit("X")).alias("document_code"), F.col("draft_id").alias("pos"))
    picked = resolution.publication_documents(rows, "file_id", resolution.ORIGINAL_CODES)
    names = table(spark, d, "part_drafts").groupBy("file_id").agg(F.array_sort(F.collect_set(F.concat("part", F.lit(".XML")))).alias("pages"))
    return picked.join(names, "file_id").select("file_id", "document_id", "document_code", answers.publication_xml(F.col("pages")).alias("xml"))


def markup_texts(spark: SparkSession, d: str) -> DataFrame:
    """Titles with mark-up inside, joined both ways."""
    rows = table(spark, d, "lookup_responses").select("response_id", F.concat(F.lit("<x:r xmlns:x='u'><x:t>"), _escaped(F.col("title")), F.lit("<b>q</b>"), _escaped(F.col("source")), F.lit("</x:t></x:r>")).alias("xml"))
    return markup.nodes(rows, "response_id", "xml", ["t"]).select("response_id", "spaced", "solid")


def marked_files(spark: SparkSession, d: str) -> DataFrame:
    """Files whose empty drafts are errors and whose copies are duplicates."""
    drafts = table(spark, d, "part_drafts")
    parts = sections.measured(drafts)
    errors = drafts.filter("coalesce(trim(text), '') = ''").select("file_id", "part", F.concat(F.lit("no text in "), "part").alias("message"))
    marked, warnings = sections.marked_errors(parts, errors)
    files = sections.by_file(marked, warnings.select("file_id", "warnings"))
    same = drafts.filter("sha256 is not null").groupBy("sha256").agg(F.min("file_id").alias("key_a"), F.max("file_id").alias("key_b")).filter("key_a <> key_b")
    return sections.downgraded(files, same).select("file_id", "total_words", "file_status")


def saved_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part_drafts").filter("sha256 is not null").select(
        F.col("file_id").alias("patent_id"), F.col("part").alias("type"), F.col("method").alias("strategy"), "sha256", F.lit("epo").alias("source"), F.lit("EP1").alias("number"), "filename", F.col("draft_id").alias("saved_at")
    )
    return table_sinks.saved_documents(spark.createDataFrame([], rows.schema), rows).select("patent_id", "type", "strategy", "sha256", "saved_at", "storage_path")


def cleanup_counts(spark: SparkSession, d: str) -> DataFrame:
    tables = {
        "patents": table(spark, d, "lookup_responses").select(F.col("response_id").alias("patent_id")),
        "documents": table(spark, d, "representatives").select(F.col("response_id").alias("patent_id"), F.col("rep_id").alias("document_id"), F.length("address").alias("byte_size")),
    }
    links = table(spark, d, "patent_lookup_events").filter("outcome = 'success'").select(F.col("response_id").alias("patent_id"))
    return table_sinks.unlinked_records(tables, links).counts


def delivered_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part_drafts").select(F.col("filename").alias("storage_path"), F.length("text").cast("bigint").alias("byte_size"))
    objects = table(spark, d, "part_drafts").groupBy("filename").agg(F.max(F.length("text")).cast("bigint").alias("size")).select(F.col("filename").alias("storage_path"), "size", (F.col("size") % 2 == 1).alias("public"))
    return table_sinks.delivered(rows, objects)


def upload_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every draft as an upload with the first bytes of a PDF."""
    rows = table(spark, d, "part_drafts").select("draft_id", "file_id", "filename", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"))
    error = archives.upload_error(F.col("filename"), F.lit("application/pdf; x=y"), F.lit(b"%PDF-1.7"), F.array(F.lit("x")))
    taken = archives.intake(rows, "file_id", "draft_id", "size", 6, 1500, 4000)
    return taken.select("draft_id", error.alias("type_error"), F.col("error").alias("size_error"))


def sheet_orders(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a file listed against their order and put in order again."""
    pages = table(spark, d, "ocr_pages").select("file_id", "page_no", F.concat(F.lit("P"), F.lpad((F.lit(1000) - F.col("page_no")).cast("string"), 4, "0"), F.lit(".TIF")).alias("name"))
    held = pages.groupBy("file_id").agg(
        F.array_sort(F.collect_set("name")).alias("members"), F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("<DP N="), F.col("page_no").cast("string"), F.lit(" IMA="), F.lower("name"), F.lit(">"))), False), "\n").alias("listing")
    )
    return held.select("file_id", F.array_join(archives.sheet_order(F.col("listing"), F.col("members")), " ").alias("pages"))


def recognised_lines(spark: SparkSession, d: str) -> DataFrame:
    """The words of every page put together to lines again, with mean confidence."""
    rows = table(spark, d, "ocr_pages").filter("text is not null").select("page_id", "confidence", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    words = rows.select("page_id", "confidence", "line", F.posexplode(F.split("l", " ")).alias("word", "text"))
    words = words.select("page_id", F.lit(1).alias("page"), F.lit(1).alias("block"), F.lit(1).alias("paragraph"), "line", "word", "text", F.coalesce("confidence", F.lit(-1.0)).alias("confidence"))
    out = recognition.lines_of_words(words, "page_id")
    return out.select("page_id", "text", F.round("confidence", 4).alias("confidence"), "band")


def engine_choices(spark: SparkSession, d: str) -> DataFrame:
    """The first engine with text: the page itself, else the page with its label as text."""
    pages = table(spark, d, "ocr_pages")
    first = pages.select("page_id", F.lit(0).alias("rank"), F.coalesce("text", F.lit("")).alias("text"), "confidence", F.lit("xx").alias("language"), F.lit("one").alias("provider"), F.array(F.lit("slow")).alias("warnings"))
    second = pages.select("page_id", F.lit(1).alias("rank"), F.coalesce("language", F.lit("")).alias("text"), F.lit(1.0).alias("confidence"), F.lit("yy").alias("language"), F.lit("two").alias("provider"), F.array(F.lit("late")).alias("warnings"))
    return recognition.first_success(first.unionByName(second), "page_id").select("page_id", "text", "provider", F.array_join("warnings", " ").alias("warnings"))


def tried_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each query's spellings tried in order against the numbers that have an answer."""
    asked = table(spark, d, "patent_lookup_events").filter("query is not null").select("query").distinct()
    tight = F.regexp_replace(F.upper("query"), r"[\s./-]+", "")
    requests = asked.select("query", F.array(F.upper("query"), tight, F.substring(tight, 1, 12)).alias("candidates"))
    known = table(spark, d, "lookup_responses").groupBy("normalized_number").agg(F.max("response_id").cast("string").alias("payload")).select(F.col("normalized_number").alias("candidate"), F.lit("ok").alias("outcome"), "payload")
    return resolution.first_hit(requests, "candidates", known, "query").select("query", "outcome", "payload", F.col("attempts").cast("bigint").alias("attempts"))


def missing_constituents(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "lookup_responses").select("response_id")
    one = lambda name, column: table(spark, d, name).groupBy("response_id").agg(F.count("*").alias(column))
    out = resolution.starred(base, "response_id", {"representatives": one("representatives", "reps"), "claims": one("priority_claims", "claims"), "events": one("patent_lookup_events", "events")})
    return out.select("response_id", F.coalesce("reps", F.lit(0)).alias("reps"), F.coalesce("claims", F.lit(0)).alias("claims"), F.array_join("missing", " ").alias("missing"))


def incomplete_files(spark: SparkSession, d: str) -> DataFrame:
    return lookups.incomplete(sections.measured(table(spark, d, "part_drafts"))).select("file_id", F.array_join("missing", " ").alias("missing"), "error")


def event_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the log as response bodies, with the time and its expiry in UTC."""
    rows = table(spark, d, "patent_lookup_events").filter("error_code is not null").dropDuplicates(["event_id"])
    return rows.select("event_id", error_body(F.col("error_code"), F.lit("failed"), F.col("source")).alias("body"), iso_instant(F.date_trunc("second", "created_at")).alias("at"), expires_at(F.col("created_at"), 30).alias("until"))


def changed_responses(spark: SparkSession, d: str) -> DataFrame:
    """Answers with the title of the newest lookup of the same number put over their own."""
    rows = table(spark, d, "lookup_responses").select("response_id", "normalized_number", "title", "source")
    newest = table_sinks.newest(table(spark, d, "lookup_responses").filter("title <> ''").select("normalized_number", "title", F.col("answered_at").alias("fetched_at"), "data_origin", "response_id").withColumn("fetched_at", F.col("fetched_at") + F.make_interval(secs=F.col("response_id") % 1000 / 1000000)), ["normalized_number"], data_origin="official")
    return table_sinks.changed(rows, newest.select("normalized_number", "title"), ["normalized_number"])


def prepared_files(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part_drafts").select("draft_id", "status", F.lit(None).cast("string").alias("sha256"), "filename")
    stored = table(spark, d, "part_drafts").filter("status = 'found'").select("draft_id", "status", "sha256")
    return file_sinks.prepared(rows, stored, "draft_id", ["sha256", "status"])


def near_classes(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.near_classes(table(spark, d, "documents"))


_WS = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_ONE = lambda x: f"trim(regexp_replace(coalesce({x}, ''), '{_WS}', ' ', 'g'))"
_PLAIN = lambda x: rf"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '\[[0-9]{{4,}}\]\s*', '', 'g'), '{_WS}', ' ', 'g'))"
#: Distinct in first-seen order, without empty ones.
_FIRST_SEEN = lambda xs: f"array_to_string(list_filter({xs}, lambda x, i: x <> '' AND list_position({xs}, x) = i), ' | ')"
_EACH = lambda xs: f"list_transform(coalesce({xs}, []), lambda x: {_ONE('x')})"
_ASCII = lambda x: rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"
_DIGITS = "regexp_replace(normalized_number, '[^0-9]', '', 'g')"
_SNAPSHOT_OK = "title IS NOT NULL AND applicants IS NOT NULL"
_LINKED = "SELECT DISTINCT response_id FROM patent_lookup_events WHERE response_id IS NOT NULL"

ORACLE_SQL = {
    "package_parts": f"""SELECT response_id, part, text, CASE WHEN text <> '' THEN 'wipo_xml' ELSE 'none' END AS method, pages FROM (
        SELECT response_id, 'abstract' AS part, {_ONE('abstract')} AS text, '' AS pages FROM lookup_responses
        UNION ALL SELECT response_id, 'abstract_drawing', '', '' FROM lookup_responses
        UNION ALL SELECT response_id, 'description', {_ONE('filed_abstract')}, '' FROM lookup_responses
        UNION ALL SELECT response_id, 'claims', '', 'x/c2.tif c1.tif' FROM lookup_responses
        UNION ALL SELECT response_id, 'description_drawings', '', '' FROM lookup_responses)""",
    "word_blocks": f"""SELECT draft_id, seq, text FROM (SELECT draft_id, CAST(i - 1 AS INT) AS seq, {_ONE('ls[i]')} AS text FROM
        (SELECT draft_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT draft_id, string_split(text, chr(10)) AS ls FROM part_drafts WHERE text IS NOT NULL))) WHERE text <> ''""",
    "json_records": f"""SELECT r.response_id, CASE WHEN {_PLAIN('title')} <> '' THEN {_PLAIN('title')} ELSE 'autre' END AS title, {_PLAIN('abstract')} AS abstract,
        {_FIRST_SEEN(_EACH('applicants'))} AS applicants, {_FIRST_SEEN(_EACH('inventors'))} AS inventors, {_FIRST_SEEN(_EACH('ipc'))} AS ipc,
        CASE WHEN starts_with(normalized_number, 'WO') THEN '' ELSE 'WO' END || normalized_number || 'A1' AS publication_number,
        coalesce((SELECT string_agg(number, ' | ' ORDER BY claim_id) FROM (SELECT coalesce(number, '') AS number, min(claim_id) AS claim_id FROM priority_claims c WHERE c.response_id = r.response_id
          AND (coalesce(number, '') <> '' OR coalesce(date, '') <> '' OR coalesce(country, '') <> '' OR coalesce(kind, '') <> '')
          GROUP BY coalesce(number, ''), coalesce(date, ''), coalesce(country, ''), coalesce(kind, ''))), '') AS priorities, CAST(NULL AS VARCHAR) AS error FROM lookup_responses r""",
    "exchange_records": f"""SELECT response_id, {_ASCII('title')} AS title, {_ASCII('abstract')} AS abstract, {_FIRST_SEEN('list_transform(coalesce(applicants, []), lambda x: trim(x))')} AS applicants,
        'XX' || {_DIGITS} || 'A1' AS publication_no, '20200102' AS publication_date FROM lookup_responses""",
    "european_answers": f"""WITH c AS (SELECT response_id, regexp_replace(number, '[^0-9A-Za-z]', '', 'g') AS n FROM priority_claims WHERE number <> '')
        SELECT response_id, 'ok' AS outcome, {_ASCII('title')} AS title, 'XX' || {_DIGITS} || 'A1' AS publication_no, (SELECT nullif(count(*), 0) FROM c WHERE c.response_id = r.response_id) AS claims_count,
          (SELECT count(DISTINCT n) FROM c WHERE c.response_id = r.response_id AND upper(n) <> regexp_replace(normalized_number, '[^0-9A-Za-z]', '', 'g')) AS related,
          'description_words drawings' || CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.response_id = r.response_id) THEN '' ELSE ' claims_count claims_words' END || ' drawings original_file_download_url' AS lacking
        FROM lookup_responses r WHERE source = 'epo'""",
    "snapshot_checks": f"""SELECT count(*) AS linked, count(*) FILTER ({_SNAPSHOT_OK}) AS valid, count(*) FILTER (NOT ({_SNAPSHOT_OK})) AS invalid
        FROM lookup_responses WHERE source = 'epo' AND response_id IN ({_LINKED})""",
    "cached_answers": f"""SELECT response_id AS id, title, CAST(7 AS BIGINT) AS members, 'cache_fallback' AS data_origin, 'official_source_no_result' AS reason
        FROM lookup_responses WHERE source = 'epo' AND {_SNAPSHOT_OK} AND response_id IN ({_LINKED})""",
    "stored_answers": r"""SELECT response_id, source, regexp_extract(normalized_number, '^(PCT|[A-Z]{2})', 1) AS jurisdiction, nullif(application_no, '') AS application_no, CAST(NULL AS VARCHAR) AS publication_no,
        nullif(title, '') AS title, regexp_replace(nullif(publication_date, ''), '^([0-9]{4})([0-9]{2})([0-9]{2})$', '\1-\2-\3') AS publication_date FROM lookup_responses""",
    "number_forms": r"""SELECT n AS normalized_number, CASE WHEN cc = 'WO' THEN 'WO/' || substr(doc, 1, 4) || '/' || substr(doc, 5) ELSE cc || '/' || doc END AS pct,
        CASE WHEN cc = 'WO' THEN CASE WHEN kind = '' THEN n || ' ' || shown ELSE n || ' WO' || doc || ' ' || shown || ' ' || shown || kind END
          ELSE n || ' WO' || doc || CASE WHEN kind = '' THEN '' ELSE ' ' || n || kind END END AS identifiers, shown, CASE WHEN kind IN ('A1', 'A2') THEN kind ELSE 'A1 A2' END AS kinds, n = shown OR kind = '' AS same
        FROM (SELECT n, cc, doc, kind, CASE WHEN cc = 'WO' THEN 'WO/' || substr(doc, 1, 4) || '/' || substr(doc, 5) ELSE n END AS shown FROM (
          SELECT DISTINCT normalized_number AS n, substr(normalized_number, 1, 2) AS cc, regexp_extract(normalized_number, '^..([0-9]+)', 1) AS doc, regexp_extract(normalized_number, '^..[0-9]+(.*)$', 1) AS kind FROM lookup_responses))""",
    "original_documents": """SELECT file_id, document_id, document_code, xml FROM (SELECT file_id, part AS document_id, code AS document_code, row_number() OVER (PARTITION BY file_id ORDER BY rank, last) AS r FROM (
        SELECT file_id, part, code, max(draft_id) AS last, CASE code WHEN 'PUB' THEN 1 WHEN 'A2' THEN 3 ELSE 4 END AS rank FROM (
          SELECT *, CASE part WHEN 'description' THEN 'PUB' WHEN 'abstract' THEN 'APBDY' WHEN 'claims' THEN 'A2' ELSE 'X' END AS code FROM part_drafts) GROUP BY file_id, part, code)) JOIN
        (SELECT file_id, min(part) || '.XML' AS xml FROM part_drafts GROUP BY file_id) USING (file_id) WHERE r = 1""",
    "markup_texts": f"""SELECT response_id, {_ONE("coalesce(title, '') || ' q ' || coalesce(source, '')")} AS spaced, {_ONE("coalesce(title, '') || 'q' || coalesce(source, '')")} AS solid FROM lookup_responses""",
    "saved_parts": """SELECT patent_id, type, strategy, sha256, saved_at, 'epo/EP1/' || substr(sha256, 1, 16) || '-' || trim(regexp_replace(filename, '[^A-Za-z0-9._-]+', '-', 'g'), '-') AS storage_path FROM (
        SELECT file_id AS patent_id, part AS type, method AS strategy, sha256, draft_id AS saved_at, filename, row_number() OVER (PARTITION BY file_id, part, method, sha256 ORDER BY draft_id DESC) AS r
        FROM part_drafts WHERE sha256 IS NOT NULL) WHERE r = 1""",
    "cleanup_counts": """WITH l AS (SELECT DISTINCT response_id FROM patent_lookup_events WHERE outcome = 'success' AND response_id IS NOT NULL), t AS (SELECT response_id FROM lookup_responses WHERE response_id NOT IN (SELECT response_id FROM l))
        SELECT (SELECT count(*) FROM lookup_responses) AS patents, (SELECT count(*) FROM l) AS linked, (SELECT count(*) FROM t) AS targets,
          (SELECT count(*) FROM representatives WHERE response_id IN (SELECT response_id FROM t)) AS documents, (SELECT CAST(coalesce(sum(length(address)), 0) AS BIGINT) FROM representatives WHERE response_id IN (SELECT response_id FROM t)) AS bytes""",
    "delivered_parts": """SELECT count(*) AS documents, count(*) FILTER (o.size IS NULL) AS missing, count(*) FILTER (o.size <> length(p.text)) AS wrong_size, count(*) FILTER (o.size % 2 = 1) AS public
        FROM part_drafts p LEFT JOIN (SELECT filename, max(length(text)) AS size FROM part_drafts GROUP BY filename) o USING (filename)""",
    "upload_checks": r"""SELECT draft_id, CASE WHEN NOT regexp_matches(lower(filename), '\.(pdf|doc|docx)$') THEN 'unsupported_file_type' WHEN lower(filename) NOT LIKE '%.pdf' THEN 'file_signature_mismatch' END AS type_error,
        CASE WHEN n > 6 THEN 'too_many_files' WHEN size > 1500 THEN 'file_too_large' WHEN upto > 4000 THEN 'request_too_large' END AS size_error FROM (SELECT *, count(*) OVER (PARTITION BY file_id) AS n,
          sum(size) OVER (PARTITION BY file_id ORDER BY draft_id) AS upto FROM (SELECT draft_id, file_id, filename, strlen(coalesce(text, '')) AS size FROM part_drafts))""",
    "sheet_orders": """SELECT file_id, string_agg('P' || lpad(CAST(1000 - page_no AS VARCHAR), 4, '0') || '.TIF', ' ' ORDER BY page_no) AS pages FROM (SELECT DISTINCT file_id, page_no FROM ocr_pages) GROUP BY file_id""",
    "recognised_lines": """WITH w AS (SELECT page_id, confidence, line, array_to_string(list_filter(list_transform(string_split(line_text, ' '), lambda x: trim(x)), lambda x: x <> ''), ' ') AS t FROM (
          SELECT page_id, confidence, unnest(generate_series(1, len(ls))) AS line, unnest(ls) AS line_text FROM (SELECT page_id, confidence, string_split(text, chr(10)) AS ls FROM ocr_pages WHERE text IS NOT NULL)))
        SELECT page_id, string_agg(t, chr(10) ORDER BY line) AS text, CASE WHEN max(confidence) >= 0 THEN round(max(confidence), 4) END AS confidence,
          CASE WHEN max(confidence) >= 80 THEN 'high' WHEN max(confidence) >= 50 THEN 'medium' ELSE 'low' END AS band FROM w WHERE t <> '' GROUP BY page_id""",
    "engine_choices": """SELECT page_id, CASE WHEN trim(coalesce(text, '')) <> '' THEN text ELSE coalesce(language, '') END AS text, CASE WHEN trim(coalesce(text, '')) <> '' THEN 'one' ELSE 'two' END AS provider,
        CASE WHEN trim(coalesce(text, '')) <> '' THEN 'slow' ELSE 'slow late' END AS warnings FROM ocr_pages""",
    "tried_candidates": r"""WITH q AS (SELECT DISTINCT query, upper(query) AS a, regexp_replace(upper(query), '[\s./-]+', '', 'g') AS b FROM patent_lookup_events WHERE query IS NOT NULL),
          k AS (SELECT normalized_number AS n, CAST(max(response_id) AS VARCHAR) AS id FROM lookup_responses GROUP BY normalized_number)
        SELECT query, CASE WHEN coalesce(x.id, y.id, z.id) IS NULL THEN 'no_result' ELSE 'ok' END AS outcome, coalesce(x.id, y.id, z.id) AS payload, CAST(CASE WHEN x.id IS NOT NULL THEN 1 WHEN y.id IS NOT NULL THEN 2 ELSE 3 END AS BIGINT) AS attempts
        FROM q LEFT JOIN k x ON x.n = q.a LEFT JOIN k y ON y.n = q.b LEFT JOIN k z ON z.n = substr(q.b, 1, 12)""",
    "missing_constituents": """SELECT response_id, reps, claims, array_to_string(list_filter([CASE WHEN reps = 0 THEN 'representatives' END, CASE WHEN claims = 0 THEN 'claims' END, CASE WHEN events = 0 THEN 'events' END], lambda x: x IS NOT NULL), ' ') AS missing
        FROM (SELECT r.response_id, (SELECT count(*) FROM representatives x WHERE x.response_id = r.response_id) AS reps, (SELECT count(*) FROM priority_claims x WHERE x.response_id = r.response_id) AS claims,
          (SELECT count(*) FROM patent_lookup_events x WHERE x.response_id = r.response_id) AS events FROM lookup_responses r)""",
    "event_bodies": """SELECT DISTINCT event_id, '{"error":{"code":"' || error_code || '","message":"failed","source":' || coalesce('"' || source || '"', 'null') || ',"details":null}}' AS body,
        strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS at, strftime(created_at + INTERVAL 60 SECOND, '%Y-%m-%dT%H:%M:%SZ') AS until FROM patent_lookup_events WHERE error_code IS NOT NULL""",
    "changed_responses": """SELECT r.response_id, r.normalized_number, coalesce(n.title, r.title) AS title, r.source FROM lookup_responses r LEFT JOIN (
        SELECT normalized_number, title FROM (SELECT *, row_number() OVER (PARTITION BY normalized_number ORDER BY answered_at + to_microseconds(response_id % 1000) DESC) AS k FROM lookup_responses WHERE title <> '' AND data_origin = 'official') WHERE k = 1
        ) n USING (normalized_number)""",
    "marked_files": f"""WITH m AS ({reference.MEASURED}), e AS (SELECT file_id, part, count(*) AS n FROM part_drafts WHERE trim(coalesce(text, '')) = '' GROUP BY file_id, part),
          f AS (SELECT file_id, sum(word_count) AS total, bool_or(CASE WHEN e.n IS NOT NULL AND word_count = 0 THEN 'error' ELSE status END NOT IN ('missing', 'error')) AS has FROM m LEFT JOIN e USING (file_id, part) GROUP BY file_id),
          w AS (SELECT DISTINCT file_id FROM e), s AS (SELECT min(file_id) AS a, max(file_id) AS b FROM part_drafts WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING min(file_id) <> max(file_id))
        SELECT file_id, CAST(total AS BIGINT) AS total_words, CASE WHEN NOT has THEN 'failed' WHEN file_id IN (SELECT file_id FROM w) OR file_id IN (SELECT a FROM s UNION ALL SELECT b FROM s) THEN 'partial' ELSE 'success' END AS file_status FROM f""",
    "incomplete_files": f"""WITH m AS ({reference.MEASURED}), f AS (SELECT file_id, bool_or(part = 'description' AND word_count > 0 AND status NOT IN ('missing', 'error')) AS de,
          bool_or(part = 'claims' AND word_count > 0 AND status NOT IN ('missing', 'error')) AS cl, bool_or(part IN ('description', 'claims') AND status = 'error') AS bad FROM m GROUP BY file_id)
        SELECT file_id, trim(CASE WHEN de THEN '' ELSE 'description ' END || CASE WHEN cl THEN '' ELSE 'claims' END) AS missing, CASE WHEN bad THEN 'ocr_failed' ELSE 'section_detection_incomplete' END AS error FROM f WHERE NOT (de AND cl)""",
    "near_classes": f"""{reference.NEAR}, l AS (SELECT k, count(*) AS links FROM (SELECT key_a AS k FROM p UNION ALL SELECT key_b FROM p) GROUP BY k),
          c AS (SELECT text, min(doc_id) AS class_id, count(*) AS copies FROM documents WHERE text <> '' GROUP BY text)
        SELECT doc_id, class_id, copies, coalesce(links, 0) AS links FROM documents JOIN c USING (text) LEFT JOIN l ON l.k = class_id""",
    "prepared_files": "SELECT draft_id, status, CASE WHEN status = 'found' THEN sha256 END AS sha256, filename FROM part_drafts",
}

QUERIES = {
    f.__name__: f
    for f in (
        package_parts, word_blocks, json_records, exchange_records, european_answers, snapshot_checks, cached_answers, stored_answers, number_forms, original_documents, markup_texts, marked_files, saved_parts,
        cleanup_counts, delivered_parts, upload_checks, sheet_orders, recognised_lines, engine_choices, tried_candidates, missing_constituents, incomplete_files, event_bodies, changed_responses, prepared_files,
        near_classes,
    )
}

"""Bibliographic XML and JSON answers as typed records, in the JVM.

Namespaces are ignored: prefixes are cut from tag names, then `from_xml` reads the payload
with a declared schema. Payloads that are no XML, hold an entity declaration or lack the
expected members give null fields, never an error. JSON is read as variant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import count_words, drawing_labels, normalized

_ID = "struct<`_document-id-type`:string,`_lang`:string,country:string,`doc-number`:string,kind:string,date:string>"
_REFERENCE = f"struct<`document-id`:array<{_ID}>>"
_NAMED = lambda n: f"struct<`{n}`:array<struct<`{n}-name`:struct<name:string>,name:string,`addressbook`:array<struct<name:string>>>>>"
_AGENT = (
    "struct<name:string,`agent-name`:struct<name:string>,`representative-name`:struct<name:string>,"
    "address:struct<`address-1`:string,`address-2`:string,`address-3`:string,street:string,city:string,postcode:string,state:string,country:string>>"
)
_BIBLIO = (
    "struct<`language-of-filing`:string,`language-of-publication`:string,"
    f"`publication-reference`:array<{_REFERENCE}>,`application-reference`:array<{_REFERENCE}>,"
    f"`priority-claims`:struct<`priority-claim`:array<struct<_kind:string,country:string,`doc-number`:string,date:string,`document-id`:array<{_ID}>,`priority-active-indicator`:string>>>,"
    f"parties:struct<applicants:array<{_NAMED('applicant')}>,inventors:array<{_NAMED('inventor')}>,agents:struct<agent:array<{_AGENT}>>,representatives:struct<representative:array<{_AGENT}>>>,"
    "`classifications-ipcr`:struct<`classification-ipcr`:array<struct<text:string>>>,`classification-ipc`:struct<text:array<string>>,"
    "`patent-classifications`:struct<`patent-classification`:array<struct<text:string>>>,`designation-of-states`:string>"
)
_ABSTRACT = "array<struct<_lang:string,p:array<string>>>"
EXCHANGE = (
    "`exchange-documents` struct<`exchange-document`:array<struct<_country:string,`_doc-number`:string,_kind:string,"
    f"`bibliographic-data`:{_BIBLIO},abstract:{_ABSTRACT}>>>"
)
REGISTER = f"`register-search` struct<`register-documents`:struct<`register-document`:array<struct<_lang:string,`bibliographic-data`:{_BIBLIO}>>>>"
FAMILY = (
    f"`patent-family` struct<`family-member`:array<struct<`publication-reference`:array<{_REFERENCE}>,`application-reference`:array<{_REFERENCE}>>>>"
)
FULLTEXT = (
    "`fulltext-documents` struct<`fulltext-document`:array<struct<description:array<struct<_lang:string,p:array<string>>>,"
    "claims:array<struct<_lang:string,claim:array<struct<`claim-text`:array<string>>>>>>>>"
)


def _clean(xml: Column) -> Column:
    """Payload without declaration and name-space prefixes; null if it declares entities."""
    bare = F.regexp_replace(xml, r"<\?xml[^>]*\?>", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(</?)[A-Za-z_][\w.-]*:", "$1"), r"\s+xmlns(?::[\w.-]+)?\s*=\s*(\"[^\"]*\"|'[^']*')", "")
    return F.when(~F.upper(xml).rlike(r"<!(?:DOCTYPE|ENTITY)"), F.trim(bare))


def read_xml(xml: Column, schema: str) -> Column:
    """The root's members by `schema`; null fields where the payload is no XML."""
    return F.from_xml(_clean(xml), schema, {"mode": "PERMISSIVE", "rowTag": "world-patent-data"})


def plain(markup: Column) -> Column:
    """Text of an element whose value may hold mark-up: tags become spaces."""
    bare = F.regexp_replace(markup, r"<[^>]+>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def _filled(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def preferred(entries: Column, wanted: str | None = None) -> Column:
    """The entry of the wanted language, else the English one, else the first."""
    by = lambda lang: F.get(F.filter(entries, lambda e: F.lower(e["_lang"]) == lang), F.lit(0))
    picks = ([by(wanted.lower())] if wanted else []) + [by("en"), F.get(entries, F.lit(0))]
    return F.coalesce(*picks)


def document_number(ids: Column, order: tuple[str, ...]) -> Column:
    """Number of a reference: by document-id type in `order`, then any; country and kind are
    joined to it except for `original`."""
    def of(kind: str) -> Column:
        one = F.get(F.filter(ids, lambda i: i["_document-id-type"] == kind), F.lit(0))
        number = one["doc-number"]
        if kind == "original":
            return number
        country = F.coalesce(one["country"], F.lit(""))
        return F.concat(F.when(number.startswith(country), "").otherwise(country), number, F.coalesce(one["kind"], F.lit("")))

    return F.coalesce(*(F.nullif(of(k), F.lit("")) for k in order), F.get(ids, F.lit(0))["doc-number"])


def document_date(ids: Column, order: tuple[str, ...]) -> Column:
    dated = F.filter(ids, lambda i: F.coalesce(i["date"], F.lit("")) != "")
    of = lambda kind: F.get(F.filter(dated, lambda i: i["_document-id-type"] == kind), F.lit(0))["date"]
    return F.coalesce(*(of(k) for k in order), F.get(dated, F.lit(0))["date"])


def _names(group: Column, item: str) -> Column:
    first = F.get(group, F.lit(0))[item]
    return _filled(F.transform(first, lambda p: F.trim(F.coalesce(p[f"{item}-name"]["name"], p["name"], F.get(p["addressbook"], F.lit(0))["name"]))))


def _representatives(agents: Column, kind: str) -> Column:
    def one(a: Column) -> Column:
        address = a["address"]
        lines = F.array(*(address[c] for c in ("address-1", "address-2", "address-3", "street", "city", "postcode", "state")))
        return F.struct(
            F.coalesce(a[f"{kind}-name"]["name"], a["name"], F.lit("")).alias("name"),
            F.array_join(F.filter(lines, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), ", ").alias("address"),
            F.coalesce(address["country"], F.lit("")).alias("country"),
        )

    return F.array_distinct(F.filter(F.transform(agents, one), lambda r: (r["name"] != "") | (r["address"] != "")))


def _title(xml: Column) -> Column:
    """The English title, else the first; read from the text, as titles may hold mark-up."""
    of = lambda attribute: F.nullif(F.regexp_extract(_clean(xml), rf"(?s)<invention-title\b{attribute}[^>]*>(.*?)</invention-title>", 1), F.lit(""))
    return plain(F.coalesce(of(r"[^>]*\blang\s*=\s*[\"'](?i:en)[\"']"), of("")))


def _biblio(b: Column, xml: Column) -> Column:
    publication = F.get(b["publication-reference"], F.lit(0))["document-id"]
    application = F.get(b["application-reference"], F.lit(0))["document-id"]
    claims = b["priority-claims"]["priority-claim"]
    priority = F.transform(
        claims,
        lambda c: F.struct(
            F.coalesce(document_number(c["document-id"], ("epodoc", "docdb", "original")), c["doc-number"]).alias("number"),
            F.coalesce(document_date(c["document-id"], ("epodoc", "docdb", "original")), c["date"]).alias("date"),
            F.coalesce(F.get(c["document-id"], F.lit(0))["country"], c["country"]).alias("country"),
            F.coalesce(c["_kind"], F.get(c["document-id"], F.lit(0))["kind"]).alias("kind"),
        ),
    )
    no = F.array(*(F.lit(x) for x in ("NO", "N", "FALSE", "0")))
    live = F.filter(claims, lambda c: ~F.array_contains(no, F.upper(F.coalesce(c["priority-active-indicator"], F.lit("")))))
    dates = F.filter(F.transform(live, lambda c: document_date(c["document-id"], ("epodoc", "docdb", "original"))), lambda d: d.rlike(r"^\d{8}$"))
    states = F.regexp_extract_all(b["designation-of-states"], F.lit(r"<country>\s*([A-Z]{2})\s*</country>"), F.lit(1))
    regions = F.regexp_extract_all(b["designation-of-states"], F.lit(r"<region>\s*(?:<country>)?\s*([A-Z]{2})"), F.lit(1))
    return F.struct(
        F.when(b.isNotNull(), _title(xml)).alias("title"),
        document_number(publication, ("docdb", "epodoc", "original")).alias("publication_number"),
        document_date(publication, ("docdb", "epodoc", "original")).alias("publication_date"),
        document_number(application, ("epodoc", "docdb", "original")).alias("application_number"),
        document_date(application, ("epodoc", "docdb", "original")).alias("application_date"),
        _names(b["parties"]["applicants"], "applicant").alias("applicants"),
        _names(b["parties"]["inventors"], "inventor").alias("inventors"),
        F.coalesce(_representatives(b["parties"]["agents"]["agent"], "agent"), _representatives(b["parties"]["representatives"]["representative"], "representative")).alias("representatives"),
        F.array_distinct(F.filter(priority, lambda p: F.coalesce(p["number"], p["date"], p["country"]).isNotNull())).alias("priority_data"),
        F.array_min(dates).alias("earliest_priority_date"),
        _filled(F.array_union(F.coalesce(F.transform(b["classifications-ipcr"]["classification-ipcr"], lambda c: F.trim(c["text"])), F.array().cast("array<string>")), F.coalesce(b["classification-ipc"]["text"], F.array().cast("array<string>")))).alias("ipc"),
        _filled(F.transform(b["patent-classifications"]["patent-classification"], lambda c: F.trim(c["text"]))).alias("cpc"),
        F.array_distinct(F.array_except(F.coalesce(states, F.array().cast("array<string>")), F.coalesce(regions, F.array().cast("array<string>")))).alias("countries"),
        F.array_distinct(regions).alias("regions"),
        F.upper(F.trim(b["language-of-filing"])).alias("filing_language"),
        F.upper(F.trim(b["language-of-publication"])).alias("publication_language"),
    )


def exchange_record(xml: Column) -> Column:
    """Struct of an exchange document: country, number, kind, abstract, biblio."""
    doc = F.get(read_xml(xml, EXCHANGE)["exchange-documents"]["exchange-document"], F.lit(0))
    abstract = preferred(doc["abstract"])
    return F.struct(
        doc["_country"].alias("country"), doc["_doc-number"].alias("doc_number"), doc["_kind"].alias("kind"),
        F.array_join(F.transform(abstract["p"], plain), " ").alias("abstract"), _biblio(doc["bibliographic-data"], xml).alias("biblio"),
    )


def register_record(xml: Column) -> Column:
    """Struct of a register document: biblio."""
    doc = F.get(read_xml(xml, REGISTER)["register-search"]["register-documents"]["register-document"], F.lit(0))
    return F.struct(_biblio(doc["bibliographic-data"], xml).alias("biblio"))


def family_record(xml: Column) -> Column:
    """Struct: members (distinct number, country, doc_number, kind, date) and the earliest
    filing date of those that are WO publications."""
    members = read_xml(xml, FAMILY)["patent-family"]["family-member"]

    def one(m: Column) -> Column:
        ids = F.get(m["publication-reference"], F.lit(0))["document-id"]
        by = lambda kind: F.get(F.filter(ids, lambda i: i["_document-id-type"] == kind), F.lit(0))
        main = F.coalesce(by("docdb"), by("epodoc"), F.get(ids, F.lit(0)))
        filing = F.get(m["application-reference"], F.lit(0))["document-id"]
        return F.struct(
            F.coalesce(by("epodoc")["doc-number"], F.concat_ws("", main["country"], main["doc-number"])).alias("number"),
            main["country"].alias("country"), main["doc-number"].alias("doc_number"), main["kind"].alias("kind"),
            document_date(ids, ("docdb", "epodoc", "original")).alias("date"), document_date(filing, ("epodoc", "docdb", "original")).alias("filed"),
        )

    all_of = F.transform(members, one)
    published = F.transform(all_of, lambda m: F.struct(*(m[c].alias(c) for c in ("number", "country", "doc_number", "kind", "date"))))
    return F.struct(
        F.array_distinct(F.filter(published, lambda m: m["number"] != "")).alias("members"),
        F.array_min(F.transform(F.filter(all_of, lambda m: m["country"] == "WO"), lambda m: m["filed"])).alias("international_filing_date"),
    )


IMAGES = (
    "`document-inquiry` struct<`inquiry-result`:struct<`document-instance`:array<struct<_desc:string,_link:string,`_number-of-pages`:string,"
    "`document-format-options`:struct<`document-format`:array<string>>>>>>"
)


def images_record(xml: Column) -> Column:
    """Struct: has_drawings, drawing_pages, full_document_link, full_document_pages, formats."""
    items = read_xml(xml, IMAGES)["document-inquiry"]["inquiry-result"]["document-instance"]
    drawings = F.filter(items, lambda i: i["_desc"] == "Drawing")
    full = F.filter(items, lambda i: i["_desc"] == "FullDocument")
    last = lambda xs: F.when(F.size(xs) > 0, F.element_at(xs, -1))
    return F.struct(
        (F.size(drawings) > 0).alias("has_drawings"), last(drawings)["_number-of-pages"].try_cast("int").alias("drawing_pages"),
        last(full)["_link"].alias("full_document_link"), last(full)["_number-of-pages"].try_cast("int").alias("full_document_pages"),
        last(full)["document-format-options"]["document-format"].alias("formats"),
    )


def description_record(xml: Column, language: str | None = None) -> Column:
    """Struct: text, language, paragraphs, words, drawing_labels of a description."""
    entries = F.get(read_xml(xml, FULLTEXT)["fulltext-documents"]["fulltext-document"], F.lit(0))["description"]
    chosen = preferred(entries, language)
    paragraphs = F.filter(F.transform(chosen["p"], plain), lambda p: p != "")
    text = F.array_join(paragraphs, " ")
    return F.struct(
        normalized(text).alias("text"), F.upper(chosen["_lang"]).alias("language"), paragraphs.alias("paragraphs"), count_words(text).alias("words"),
        drawing_labels(paragraphs).alias("drawing_labels"),
    )


def claims_record(xml: Column, language: str | None = None) -> Column:
    """Struct: language, claim_texts, claims_count (numbered texts, all if none is numbered),
    words."""
    entries = F.get(read_xml(xml, FULLTEXT)["fulltext-documents"]["fulltext-document"], F.lit(0))["claims"]
    chosen = preferred(entries, language)
    texts = F.filter(F.transform(F.flatten(F.transform(chosen["claim"], lambda c: c["claim-text"])), plain), lambda t: t != "")
    numbered = F.size(F.filter(texts, lambda t: t.rlike(r"^\d+\.")))
    return F.struct(
        F.upper(chosen["_lang"]).alias("language"), texts.alias("claim_texts"),
        F.coalesce(F.nullif(numbered, F.lit(0)), F.size(texts)).alias("claims_count"), count_words(F.array_join(texts, " ")).alias("words"),
    )


def answer_record(payload: Column) -> Column:
    """Struct of a JSON answer of the international service: number, date, title, abstract,
    applicants, priority numbers; null fields where members are missing."""
    v = F.try_parse_json(payload)
    get = lambda path, kind="string": F.try_variant_get(v, f"$['wo-bibliographic-data']{path}", kind)
    titles = get("['invention-title']", "array<struct<lang:string,content:array<string>>>")
    english = F.coalesce(F.get(F.filter(titles, lambda t: F.lower(t["lang"]) == "en"), F.lit(0)), F.get(titles, F.lit(0)))
    abstracts = F.try_variant_get(v, "$.abstract", "array<struct<lang:string,p:array<struct<content:array<string>>>>>")
    chosen = F.coalesce(F.get(F.filter(abstracts, lambda t: F.lower(t["lang"]) == "en"), F.lit(0)), F.get(abstracts, F.lit(0)))
    items = get("['wo-priority-info'].items", "array<struct<`priority-claim`:struct<country:string,`doc-number`:string,date:string,kind:string>>>")
    ref = "['publication-reference']['document-id']"
    return F.struct(
        F.concat(get(f"{ref}.country"), get(f"{ref}['doc-number']"), F.coalesce(get(f"{ref}.kind"), F.lit(""))).alias("publication_number"),
        get(f"{ref}.date").alias("publication_date"),
        get("['date-of-earliest-priority'].date").alias("earliest_priority_date"),
        F.array_join(english["content"], " ").alias("title"),
        F.array_join(F.flatten(F.transform(chosen["p"], lambda p: p["content"])), " ").alias("abstract"),
        F.transform(items, lambda i: F.concat_ws("", i["priority-claim"]["country"], i["priority-claim"]["doc-number"])).alias("priority_numbers"),
    )


PAMPHLET = (
    f"`bibliographic-data` struct<`publication-reference`:array<{_REFERENCE}>,`application-reference`:array<{_REFERENCE}>,"
    f"parties:struct<applicants:array<{_NAMED('applicant')}>,inventors:array<{_NAMED('inventor')}>>,"
    "`classifications-ipcr`:struct<`classification-ipcr`:array<struct<text:string>>>>,"
    f"abstract {_ABSTRACT}, description struct<p:array<string>>, claims struct<claim:array<struct<`claim-text`:array<string>>>>, drawings struct<figure:array<struct<img:array<struct<_file:string>>>>>"
)


def pamphlet_record(xml: Column) -> Column:
    """Struct of a published application of the international service: numbers, title,
    parties, abstract, description and claims with their words, image files."""
    r = read_xml(xml, PAMPHLET)
    b = r["bibliographic-data"]
    publication, application = (F.get(b[c], F.lit(0))["document-id"] for c in ("publication-reference", "application-reference"))
    join = lambda parts: normalized(F.array_join(F.transform(parts, plain), " "))
    claims = F.filter(F.transform(r["claims"]["claim"], lambda c: F.array_join(F.transform(c["claim-text"], plain), " ")), lambda t: t != "")
    description = join(r["description"]["p"])
    return F.struct(
        document_number(publication, ("docdb", "epodoc", "original")).alias("publication_number"),
        document_date(publication, ("docdb", "epodoc", "original")).alias("publication_date"),
        document_number(application, ("epodoc", "docdb", "original")).alias("application_number"),
        F.when(b.isNotNull(), _title(xml)).alias("title"), _names(b["parties"]["applicants"], "applicant").alias("applicants"),
        _names(b["parties"]["inventors"], "inventor").alias("inventors"), _filled(F.transform(b["classifications-ipcr"]["classification-ipcr"], lambda c: F.trim(c["text"]))).alias("ipc"),
        join(preferred(r["abstract"])["p"]).alias("abstract"), description.alias("description"), count_words(description).alias("description_words"),
        F.size(claims).alias("claims_count"), count_words(F.array_join(claims, " ")).alias("claims_words"),
        _filled(F.flatten(F.transform(r["drawings"]["figure"], lambda f: F.transform(f["img"], lambda i: i["_file"])))).alias("images"),
    )


def document_list(payload: Column) -> Column:
    """Array of struct(document_id, document_code, pages) of a JSON list of documents; members
    may be spelt documentId, document_id or id, and pages counted or listed."""
    v = F.try_parse_json(payload)
    items = F.coalesce(*(F.try_variant_get(v, p, "array<variant>") for p in ("$", "$.documents", "$['available-documents']", "$.items")))

    def one(d: Column) -> Column:
        get = lambda *names: F.coalesce(*(F.try_variant_get(d, f"$['{n}']", "string") for n in names))
        return F.struct(
            get("document_id", "documentId", "id").alias("document_id"), get("document_code", "documentCode", "code").alias("document_code"),
            F.coalesce(F.try_variant_get(d, "$.pages", "int"), F.size(F.try_variant_get(d, "$.pages", "array<variant>"))).alias("pages"),
        )

    return F.filter(F.transform(items, one), lambda d: d["document_id"].isNotNull())

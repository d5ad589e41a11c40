"""Whole lookup answers composed of the payloads of their constituents.

Payloads lie as rows (key, constituent, payload, outcome). One aggregate gathers the
constituents of each request, with map-side combine, so a star of optional parts costs one
shuffle however many there are; what is missing becomes a warning in its row and no row is lost.

Defined results: a request without a bibliographic record has outcome `no_result` and null
fields; payloads that can't be read count as missing; repeated payloads of a constituent count
once (the greatest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import identifiers as ids
from inkwell.functions import records, urls
from inkwell.functions.integrity import iso_date
from inkwell.functions.text import count_words, first_filled

# Constituents of a European lookup, and the fields that lack something without them.
CONSTITUENTS = ["biblio", "register", "family", "description", "claims", "images"]
MISSING = {"description": ["description_words", "drawings"], "claims": ["claims_count", "claims_words"], "images": ["drawings", "original_file_download_url"]}

TEXTS = "array<string>"


def warning(code: str, field: str, source: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(source).alias("source"))


WARNINGS = "array<struct<code:string,field:string,source:string>>"


def _warnings(*made: tuple[Column, Column]) -> Column:
    """The warnings whose condition holds, in order."""
    return F.filter(F.array(*(F.when(F.coalesce(when, F.lit(False)), w) for when, w in made)), lambda w: w.isNotNull()).cast(WARNINGS)


def _list(*values: Column) -> Column:
    """The first array that has elements, else an empty one."""
    out = F.lit(None)
    for v in reversed(values):
        out = F.when(F.size(v) > 0, v).otherwise(out)
    return out


def gathered(payloads: DataFrame, key: str = "key", constituents: list[str] | None = None) -> DataFrame:
    """key and one column for each constituent with its payload, null where there is none."""
    columns = [F.max(F.when((F.col("constituent") == c) & (F.col("outcome") == "ok"), F.col("payload"))).alias(c) for c in constituents or CONSTITUENTS]
    return payloads.groupBy(key).agg(*columns)


def resolved(requests: DataFrame, registers: DataFrame, key: str = "key") -> DataFrame:
    """`requests` (key, reference: struct of normalized_number()) with applications replaced by the
    publication that their register record (key, payload) states; asked keeps the reference."""
    found = registers.select(key, records.register_record(F.col("payload"))["biblio"]["publication_number"].alias("_n"))
    number = F.regexp_extract("_n", r"^([A-Z]{2})(.*?)([A-Z][0-9]?)?$", 2)
    publication = F.struct(F.regexp_extract("_n", r"^([A-Z]{2})", 1).alias("country"), number.alias("doc_number"), F.regexp_extract("_n", r"([A-Z][0-9]?)$", 1).alias("kind"))
    rows = requests.join(found, key, "left").withColumn("asked", F.col("reference"))
    return rows.withColumn("reference", ids.published_as(F.col("asked"), publication)).drop("_n")


def european(requests: DataFrame, payloads: DataFrame, key: str = "key", base: str = "https://example.org", quick: bool = False) -> DataFrame:
    """The answers of the requests (key, reference) from their constituents' payloads; `quick`
    reads the bibliographic record alone. Register data count before it."""
    rows = requests.join(gathered(payloads, key, ["biblio"] if quick else None), key, "left")
    parsed = {"x": records.exchange_record(F.col("biblio"))}
    if not quick:
        parsed |= {
            "g": records.register_record(F.col("register")), "f": records.family_record(F.col("family")), "d": records.description_record(F.col("description")), "c": records.claims_record(F.col("claims")),
            "i": records.images_record(F.col("images")),
        }
    has = {c: F.col(c).isNotNull() for c in ("biblio", "register", "family", "description", "claims", "images") if c in rows.columns}
    # A step of its own, so that each payload is read once.
    rows = rows.select(key, "reference", *(v.alias(f"_has_{c}") for c, v in has.items()), *(v.alias(k) for k, v in parsed.items()))
    b, g = F.col("x.biblio"), (F.col("g.biblio") if not quick else None)
    ref = F.col("reference")
    pick = lambda c: F.coalesce(F.nullif(g[c], F.lit("")), F.nullif(b[c], F.lit(""))) if not quick else F.nullif(b[c], F.lit(""))
    lists = lambda c: _list(*([g[c]] if not quick else []), b[c])
    states = (F.size(g["regions"]) > 0) | (F.size(g["countries"]) > 0) if not quick else F.lit(False)
    of_states = lambda c: F.when(states, g[c]).otherwise(b[c]) if not quick else b[c]
    publication = F.struct(b["publication_number"].alias("selected_number"), F.col("x.country").alias("country"), F.col("x.doc_number").alias("doc_number"), F.col("x.kind").alias("kind"))
    columns = {
        "normalized_number": ref["normalized_number"], "display_number": ref["display_number"], "outcome": F.when(F.coalesce(F.col("x.doc_number"), b["title"], b["publication_number"]).isNotNull(), "ok").otherwise("no_result"), "title": b["title"],
        "abstract": F.col("x.abstract"), "applicants": b["applicants"], "inventors": b["inventors"], "ipc": b["ipc"], "cpc": b["cpc"], "representatives": lists("representatives"),
        "priority_data": lists("priority_data"), "publication_language": pick("publication_language"), "filing_language": pick("filing_language"), "regions": of_states("regions"),
        "countries": of_states("countries"), "first_priority_date": b["earliest_priority_date"], "application_date": F.nullif(b["application_date"], F.lit("")),
        "application_no": F.nullif(b["application_number"], F.lit("")), "publication_date": F.nullif(b["publication_date"], F.lit("")), "publication_no": ids.publication_number(ref, publication),
        "abstract_words": count_words(F.coalesce(F.col("x.abstract"), F.lit(""))),
    }
    if quick:
        return rows.select(key, *(v.alias(k) for k, v in columns.items()))
    labels = F.coalesce(F.col("d.drawing_labels"), F.array().cast(TEXTS))
    whole = F.coalesce(F.col("i.full_document_link"), F.lit("")) != ""
    link = F.when(whole & (ref["country_code"] == "EP"), urls.publication_url(base, F.coalesce(F.col("x.country"), ref["country_code"]), F.coalesce(F.col("x.doc_number"), ref["doc_number"]), F.coalesce(F.col("x.kind"), ref["kind_code"]), "pdf"))
    own = F.array(*(ids.compact_number(v) for v in (ref["normalized_number"], ref["display_number"], F.concat(ref["country_code"], ref["doc_number"]))))
    related = F.array_distinct(F.filter(F.transform("f.members", lambda m: m["number"]), lambda n: (n != "") & ~F.array_contains(own, ids.compact_number(n))))
    columns |= {
        "related": F.coalesce(related, F.array().cast(TEXTS)), "international_filing_date": F.col("f.international_filing_date"), "description_words": F.when(F.col("_has_description"), F.col("d.words")),
        "claims_count": F.when(F.col("_has_claims"), F.col("c.claims_count")), "claims_words": F.when(F.col("_has_claims"), F.col("c.words")), "total_pages": F.col("i.full_document_pages"),
        "has_drawings": F.coalesce(F.col("i.has_drawings"), F.lit(False)) | (F.size(labels) > 0), "drawing_labels": labels, "drawing_pages": F.col("i.drawing_pages"),
        "original_available": F.coalesce(whole, F.lit(False)), "download_url": link,
        "warnings": _warnings(
            *((~F.col(f"_has_{c}"), warning("source_no_result", field, "epo")) for c, fields in MISSING.items() for field in fields),
            (F.col("_has_images") & link.isNull(), warning("original_file_not_available", "original_file_download_url", "epo")),
        ),
    }
    return rows.select(key, *(v.alias(k) for k, v in columns.items()))


def finalised(rows: DataFrame) -> DataFrame:
    """International answers with the ordered fallbacks of four fields filled: application_date,
    application_no, publication_date, publication_no; abstract_words counted where it is null.
    The fallbacks are the columns f_<field>_<n> of `rows`, in the order of n."""
    out = rows
    for field in ("application_date", "application_no", "publication_date", "publication_no"):
        others = sorted((c for c in rows.columns if c.startswith(f"f_{field}_")), key=lambda c: int(c.rsplit("_", 1)[1]))
        out = out.withColumn(field, first_filled(F.col(field), *map(F.col, others)))
    out = out.withColumn("abstract_words", F.coalesce("abstract_words", count_words(F.coalesce("abstract", F.lit("")))))
    return out.drop(*(c for c in rows.columns if c.startswith("f_")))


def completed(rows: DataFrame, european_records: DataFrame, family: DataFrame, key: str = "key") -> DataFrame:
    """International answers (key, cpc, related, warnings) with related publications from `family`
    (key, related) and, where they have no classes of their own, those of `european_records`
    (key, cpc): cpc_source says where they come from, a warning that there are none."""
    out = rows.join(family.select(key, F.col("related").alias("_related")), key, "left")
    out = out.join(european_records.select(key, F.col("cpc").alias("_cpc")), key, "left")
    own, theirs = F.size("cpc") > 0, F.size("_cpc") > 0
    found = F.when(own, F.col("cpc")).when(theirs, F.array_distinct("_cpc")).otherwise(F.array().cast(TEXTS))
    lacking = F.size(found) == 0
    return out.select(
        *(c for c in rows.columns if c not in ("cpc", "related", "warnings")), F.coalesce("_related", "related", F.array().cast(TEXTS)).alias("related"), found.alias("cpc"),
        F.when(~F.coalesce(own, F.lit(False)) & F.coalesce(theirs, F.lit(False)), "epo").alias("cpc_source"),
        F.when(lacking, F.concat(F.coalesce("warnings", F.array().cast(WARNINGS)), F.array(warning("cpc_unavailable", "cpc", "wipo")).cast(WARNINGS))).otherwise(F.coalesce("warnings", F.array().cast(WARNINGS))).alias("warnings"),
    )


def stored_rows(flat: DataFrame, nested: DataFrame, now: Column) -> DataFrame:
    """Rows of the record store from both shapes of answer: European ones have their fields side
    by side, international ones in `basic_info`. Snapshot is the answer as JSON without receipt."""

    def shaped(rows: DataFrame, application: Column, title: Column, date: Column) -> DataFrame:
        kept = [c for c in rows.columns if c != "lookup_receipt"]
        return rows.select(
            "source", "normalized_number", "display_number", F.regexp_extract("normalized_number", r"^(PCT|[A-Z]{2})", 1).alias("jurisdiction"), F.nullif(application, F.lit("")).alias("application_no"),
            F.nullif("publication_no", F.lit("")).alias("publication_no"), F.nullif(title, F.lit("")).alias("title"), iso_date(F.nullif(date, F.lit(""))).alias("publication_date"),
            F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("metadata_snapshot"), now.alias("last_successful_fetch_at"),
        )

    info = lambda c: F.col(f"basic_info.{c}")
    either = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    european_rows = shaped(flat, F.col("application_no"), F.col("title"), F.col("publication_date"))
    return european_rows.unionByName(shaped(nested, either(F.col("application_no"), info("application_number")), info("title"), either(F.col("publication_date"), info("publication_date"))))


# Members of a snapshot and their kinds by source: t text, n number, l list, o object;
# in capitals those that must be there, with ? those that may be null.
_COMMON = {
    "source": "T", "normalized_number": "T", "display_number": "T", "data_origin": "t", "cache": "o", "lookup_receipt": "t?", "application_date": "t?", "application_no": "t?",
    "publication_date": "t?", "publication_no": "t?", "agents": "l", "priority_data": "l", "publication_language": "t?", "filing_language": "t?", "designated_states": "o",
    "related_patent_documents": "l", "abstract_words": "n?", "description_words": "n?", "claims_count": "n?", "claims_words": "n?", "drawings": "o", "warnings": "l", "raw_source_refs": "o",
}
MODEL = {
    "epo": {
        **_COMMON, "title": "t", "abstract": "t", "ipc": "l", "cpc": "l", "applicants": "l", "inventors": "l", "representatives": "l", "language": "t?", "first_priority_date": "t?",
        "international_filing_date": "t?", "filing_deadline_30_months": "t?", "filing_deadline_31_months": "t?", "total_pages": "n?", "original_file": "o", "original_file_download_url": "t?",
    },
    "wipo": {**_COMMON, "basic_info": "O", "original_file": "O"},
}
_SHAPES = {"t": "S", "n": "B", "l": "A", "o": "O"}  # first letters of variant types


def valid_snapshot(snapshot: Column, source: Column) -> Column:
    """Whether a JSON text is an answer of the source: an object that isn't empty, with all it must
    have, nothing that the model doesn't know, and every member of its kind."""
    v = F.try_parse_json(snapshot)
    keys = F.json_object_keys(snapshot)
    out = F.lit(False)
    for name, model in MODEL.items():
        good = (F.size(keys) > 0) & (F.size(F.array_except(keys, F.array(*map(F.lit, model)))) == 0)
        for member, kind in model.items():
            at = F.try_variant_get(v, f"$.{member}", "variant")
            shape = F.substring(F.schema_of_variant(at), 1, 1)
            empty = F.coalesce(F.is_variant_null(at), F.lit(False))
            right = (shape == _SHAPES[kind[0].lower()]) & ~empty
            absent = at.isNull() & ~F.array_contains(keys, F.lit(member)) if kind[0].islower() else F.lit(False)
            good = good & (F.coalesce(right, F.lit(False)) | F.coalesce(absent, F.lit(False)) | (empty if kind.endswith("?") else F.lit(False)))
        out = F.when(F.coalesce(source, F.lit("wipo")) == name, good).otherwise(out) if name == "epo" else F.when(F.coalesce(source, F.lit("")) != "epo", good).otherwise(out)
    return F.coalesce(out, F.lit(False))


def snapshots(patents: DataFrame, links: DataFrame) -> DataFrame:
    """The answers that `patents` (id, source, normalized_number, metadata_snapshot,
    last_successful_fetch_at) can give in place of a source without result: only those with a
    link (patent_id) and a valid snapshot. Adds data_origin and reason; the receipt goes."""
    linked = patents.join(links.select(F.col("patent_id").alias("id")).distinct(), "id", "left_semi")
    good = linked.filter(valid_snapshot(F.col("metadata_snapshot"), F.col("source")))
    entries = F.map_filter(F.from_json("metadata_snapshot", "map<string,string>"), lambda k, _: ~k.isin("lookup_receipt", "data_origin", "cache"))
    return good.select("id", "source", "normalized_number", entries.alias("answer"), F.lit("cache_fallback").alias("data_origin"), F.lit("official_source_no_result").alias("reason"), "last_successful_fetch_at")


def snapshot_counts(patents: DataFrame, links: DataFrame) -> DataFrame:
    """One row: linked (patents with a link), valid and invalid (their snapshots)."""
    linked = patents.join(links.select(F.col("patent_id").alias("id")).distinct(), "id", "left_semi")
    valid = valid_snapshot(F.col("metadata_snapshot"), F.col("source"))
    return linked.agg(F.count("*").alias("linked"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"))


def input_error(files: Column, number: Column) -> Column:
    """`invalid_input` unless exactly one of files (how many) and a number is given."""
    return F.when((F.coalesce(files, F.lit(0)) > 0) == (F.coalesce(F.trim(number), F.lit("")) != ""), "invalid_input")


def incomplete(parts: DataFrame, file_key: str = "file_id") -> DataFrame:
    """file_key, missing (of description and claims), error: `ocr_failed` if one failed, else
    `section_detection_incomplete`; only the files that lack one of the two."""
    wanted = ["description", "claims"]
    each = parts.filter(F.col("part").isin(*wanted)).groupBy(file_key).agg(
        *(F.max(F.when((F.col("part") == p) & (F.col("word_count") > 0) & ~F.col("status").isin("missing", "error"), F.lit(True))).alias(f"_{p}") for p in wanted), F.max(F.col("status") == "error").alias("_failed")
    )
    files = parts.select(file_key).distinct().join(each, file_key, "left")
    lacking = F.filter(F.array(*(F.when(F.col(f"_{p}").isNull(), F.lit(p)) for p in wanted)), lambda x: x.isNotNull())
    out = files.select(file_key, lacking.alias("missing"), F.when(F.coalesce("_failed", F.lit(False)), "ocr_failed").otherwise("section_detection_incomplete").alias("error"))
    return out.filter(F.size("missing") > 0)

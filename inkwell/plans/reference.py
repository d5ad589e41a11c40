"""Queries of the document-analytics operators and the same results in SQL (DuckDB)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import identifiers as ids
from inkwell.functions import integrity, language, urls
from inkwell.functions import text as tx
from inkwell.operators import duplicates, resolution, sections, store
from inkwell.session import table
from inkwell.streaming import events as streams

RECEIPT_KEY = b"demonstration key"

# SQL forms of the text functions, for DuckDB.
_SPACE = tx.SPACE
_W, _CJK, _LATIN = (x.replace("'", "''") for x in (tx.UNIT_WORD, tx.CJK, tx.LATIN_WORD))


def _sql_normal(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '\[\d{{4,}}\]{_SPACE}*', '', 'g'), '{_SPACE}+', ' ', 'g'))"


def _sql_one(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'))"


def _sql_cjk(n: str) -> str:
    return f"regexp_extract_all({n}, '{_CJK}')"


def _sql_words(n: str) -> str:
    return f"regexp_extract_all(regexp_replace({n}, '{_CJK}', ' ', 'g'), '{_W}')"


def _sql_units(x: str) -> str:
    n = _sql_normal(x)
    return f"CAST(len({_sql_cjk(n)}) + len({_sql_words(n)}) AS BIGINT)"


def _sql_tokens(x: str) -> str:
    n = _sql_normal(x)
    return f"list_concat({_sql_cjk(n)}, {_sql_words(n)})"


def _sql_times(x: str, part: str) -> str:
    part = part.replace("'", "''")
    return f"CAST((length({x}) - length(replace({x}, '{part}', ''))) / {len(part)} AS BIGINT)"


def unit_counts_by_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = tx.with_nfkc(table(spark, d, "documents").select("lang", "text"), "text")
    return docs.groupBy("lang").agg(F.count("*").alias("documents"), F.sum(tx.count_units(F.col("text"))).cast("bigint").alias("units"))


def latin_word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.count_words(F.col("text")).alias("words"))


def top_units(spark: SparkSession, d: str) -> DataFrame:
    docs = tx.with_nfkc(table(spark, d, "documents").select("text"), "text")
    tokens = docs.select(F.explode(tx.unit_tokens(F.col("text"))).alias("unit"))
    counted = tokens.groupBy(F.lower("unit").alias("unit")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "unit").limit(100)


def page_language(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "ocr_pages").filter("text is not null").select("page_id", language.sample_of(F.col("text")).alias("sample"))
    # Scores are a step of their own, so that each is counted once.
    scores = language.scores_of(F.col("sample"))
    scored = pages.select("page_id", "sample", *(c.alias(f"s_{k}") for k, c in scores.items()))
    code = language.code_from(F.col("sample"), {k: F.col(f"s_{k}") for k in scores})
    return scored.select("page_id", code.alias("code"), *(f"s_{k}" for k in scores))


def label_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("lang", language.label_code(F.col("lang")).alias("code"), language.tesseract_code(F.col("lang")).alias("engine_code"))
    return rows.groupBy("lang", "code", "engine_code").agg(F.count("*").alias("documents"))


def reliable_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "ocr_pages")
    return pages.select("page_id", tx.reliable_layer(F.coalesce("text", F.lit(""))).alias("reliable"), tx.confidence_band(F.col("confidence")).alias("band"))


def running_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ocr_pages").select("page_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.filter(tx.is_running_line(F.col("line"))).select("page_id", "line_no", tx.collapsed(F.col("line")).alias("line"))


def cleaned_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_pages").filter("text is not null").select("page_id", tx.cleaned_page(F.col("text")).alias("cleaned"))


def drawing_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = tx.with_nfkc(table(spark, d, "ocr_pages").filter("text is not null").select("page_id", "text"), "text")
    return pages.select("page_id", tx.drawing_like(F.col("text")).alias("drawing"))


def section_units(spark: SparkSession, d: str) -> DataFrame:
    rows = sections.lines(table(spark, d, "ocr_pages"), "file_id", "page_no")
    rows = sections.sectioned(rows, "file_id", ["page_no", "line_no"])
    rows = tx.with_nfkc(rows, "line")
    return rows.groupBy("file_id", "part").agg(F.count("*").alias("lines"), F.sum(tx.count_units(F.col("line"))).alias("units"))


def part_measures(spark: SparkSession, d: str) -> DataFrame:
    return sections.measured(table(spark, d, "part_drafts"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "ocr_pages").groupBy("file_id").agg(F.sum(F.size("warnings")).alias("warnings"))
    return sections.by_file(part_measures(spark, d), pages)


def file_words(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d)


def type_rollup(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "part_drafts").groupBy("file_id").agg(F.min("file_type").alias("file_type"))
    return sections.rolled_up(_files(spark, d).join(kinds, "file_id"), ["file_type"])


def comparable_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part_drafts").filter(F.col("part").isin("abstract", "description", "claims", "unclassified"))
    rank = F.element_at(F.create_map(*[F.lit(x) for i, p in enumerate(("abstract", "description", "claims", "unclassified")) for x in (p, i)]), F.col("part"))
    return sections.joined(rows.withColumn("rank", rank), ["file_id"], ["rank", "draft_id"], "text")


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.exact_classes(table(spark, d, "documents"))


def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.near_pairs(table(spark, d, "documents"))


def page_containment(spark: SparkSession, d: str) -> DataFrame:
    pages = tx.with_nfkc(table(spark, d, "ocr_pages").filter("text is not null").select("file_id", "page_no", "page_id", "text"), "text")
    after = Window.partitionBy("file_id").orderBy("page_no", "page_id")
    rows = pages.withColumn("before", F.lag("text").over(after)).filter("before is not null")
    share = tx.containment(F.col("text"), F.col("before"))
    return rows.select("page_id", F.round(share, 4).alias("share"), (share >= 0.8).alias("repeats"))


def drawing_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", tx.drawing_labels(F.split("text", "\n")).alias("labels"))
    return docs.select("doc_id", F.size("labels").cast("bigint").alias("labels"), F.array_join(F.array_sort("labels"), " | ").alias("listed"))


def normalized_numbers(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "patent_lookup_events").select("query").distinct()
    return queries.select("query", ids.normalized_number(F.col("query")).alias("r")).select("query", "r.*")


def national_numbers(spark: SparkSession, d: str) -> DataFrame:
    numbers = table(spark, d, "priority_claims").select("number").distinct()
    return numbers.select("number", ids.normalized_number(F.col("number"), "epo").alias("r")).select("number", "r.*")


def first_aliases(spark: SparkSession, d: str) -> DataFrame:
    return store.aliases(table(spark, d, "lookup_responses"), "response_id", ["display_number", "normalized_number"], "answered_at")


def two_tier_lookup(spark: SparkSession, d: str) -> DataFrame:
    responses = table(spark, d, "lookup_responses")
    newest = store.latest(responses.select("normalized_number", "answered_at", "response_id"), ["normalized_number"], ["answered_at", "response_id"])
    asked = table(spark, d, "patent_lookup_events").select("query", "normalized_number").distinct()
    alias = store.aliases(responses, "response_id", ["display_number"], "answered_at")
    return store.two_tier(asked, newest.select("normalized_number", "response_id"), alias, "normalized_number", "query", "response_id").select(
        "query", "normalized_number", "response_id", "tier"
    )


def latest_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lookup_responses").select("source", "normalized_number", "response_id", "title", "publication_date", "answered_at")
    return store.latest(rows, ["source", "normalized_number"], ["answered_at", "response_id"])


def upserted_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders of the last quarter put over those before it, by customer."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    late = F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")
    return store.upserted(orders.filter(~late), orders.filter(late), ["o_custkey"], ["o_orderdate", "o_orderkey"])


def events_once(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "patent_lookup_events").select("event_id", "outcome", "created_at", "loaded_at")
    return store.first(rows, ["event_id"], ["loaded_at", "created_at", "outcome"])


def linked_responses(spark: SparkSession, d: str) -> DataFrame:
    return store.linked(table(spark, d, "lookup_responses").select("response_id", "normalized_number"), table(spark, d, "patent_lookup_events"), ["response_id"])


def unlinked_responses(spark: SparkSession, d: str) -> DataFrame:
    return store.unlinked(table(spark, d, "lookup_responses").select("response_id", "normalized_number"), table(spark, d, "patent_lookup_events"), ["response_id"])


def new_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose key no supplier has."""
    taken = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    return store.inserted_if_absent(taken, table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"])


def preferred_part(spark: SparkSession, d: str) -> DataFrame:
    drafts = table(spark, d, "part_drafts").select("file_id", "draft_id", "part", "status")
    ranks = F.create_map(*[F.lit(x) for i, p in enumerate(("claims", "description", "abstract", "unclassified")) for x in (p, i)])
    return store.picked(drafts, ["file_id"], F.coalesce(F.element_at(ranks, F.col("part")), F.lit(9)), ["draft_id"])


def merged_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lookup_responses")
    newest = lambda r: store.latest(r, ["normalized_number"], ["answered_at", "response_id"])
    columns = ["title", "abstract", "application_no", "publication_date"]
    rows = rows.select("normalized_number", "answered_at", "response_id", "data_origin", *columns)
    return store.merged(newest(rows.filter("data_origin = 'official'")), newest(rows.filter("coalesce(data_origin, '') <> 'official'")), ["normalized_number"], columns)


def bytes_budget(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "ocr_pages").select("file_id", "page_no", "page_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"))
    return store.within_budget(pages, ["file_id"], ["page_no", "page_id"], F.col("size"), 2000).select("page_id", "running", "within")


def expired_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "patent_lookup_events").select("event_id", "created_at")
    # A scalar subquery: the newest time is found when the plan runs, not while it is made.
    now = rows.select("created_at").agg(F.max("created_at").cast("timestamp")).scalar()
    out = store.expired(rows, "created_at", now, 90 * 86400)
    return out.groupBy(F.date_trunc("month", "created_at").alias("month")).agg(F.count("*").alias("expired"))


def outcome_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.outcome_counts(table(spark, d, "patent_lookup_events"))


def earliest_dates(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "priority_claims").filter(F.col("date").rlike(r"^\d{8}$"))
    return claims.groupBy("response_id").agg(integrity.iso_date(F.min("date")).alias("earliest"), F.count("*").alias("dated"))


def filled_representatives(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "representatives")
    name = tx.first_filled(F.col("organization"), F.col("name"))
    return rows.filter(name.isNotNull()).select("rep_id", name.alias("label"), ids.compact_number(F.col("country")).alias("country"))


def class_differences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lookup_responses").filter("ipc is not null").select("normalized_number", "answered_at", "response_id", "ipc")
    order = Window.partitionBy("normalized_number").orderBy("answered_at", "response_id")
    rows = rows.withColumn("before", F.lag("ipc").over(order)).filter("before is not null")
    text = lambda a: F.array_join(F.array_sort(a), ", ")
    return rows.select("response_id", text(F.array_except("ipc", "before")).alias("added"), text(F.array_except("before", "ipc")).alias("dropped"))


def file_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part_drafts").select("filename").distinct()
    return names.select("filename", tx.safe_filename(F.col("filename")).alias("safe"), tx.strict_filename(F.col("filename")).alias("strict"))


def text_digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", integrity.sha256(F.col("text")).alias("digest"))


def lookup_paths(spark: SparkSession, d: str) -> DataFrame:
    numbers = table(spark, d, "lookup_responses").select("normalized_number").distinct()
    rows = numbers.select(F.col("normalized_number").alias("asked"), ids.normalized_number(F.col("normalized_number")).alias("r")).select("asked", "r.*").filter("error_code is null")
    c = [F.col(x) for x in ("reference_type", "lookup_number", "country_code", "doc_number", "kind_code")]
    return rows.select(
        F.col("asked").alias("normalized_number"), F.array_join(urls.candidate_paths(*c), " ").alias("paths"), urls.publication_url("https://example.org/pub", *c[2:], "pdf").alias("link")
    )


def related_numbers(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lookup_responses").select("response_id", "normalized_number", "display_number")
    members = table(spark, d, "priority_claims").select("response_id", "number", "pos").join(own, "response_id")
    out = resolution.related(members, "response_id", "number", ["normalized_number", "display_number"])
    return out.select("response_id", F.size("related").cast("bigint").alias("n"), F.array_join(F.array_sort("related"), " | ").alias("related"))


def answers_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The official answer of each number, the newest of another origin where it has no title."""
    rows = table(spark, d, "lookup_responses").select("normalized_number", "answered_at", "response_id", "data_origin", "title")
    official = F.coalesce(F.col("data_origin") == "official", F.lit(False))
    outcome = F.when(F.coalesce("title", F.lit("")) == "", "no_result").otherwise("ok")
    newest = lambda r: store.latest(r, ["normalized_number"], ["answered_at", "response_id"]).select("normalized_number", outcome.alias("outcome"), F.col("title").alias("payload"))
    return resolution.with_fallback(newest(rows.filter(official)), newest(rows.filter(~official)), "normalized_number", ["no_result"])


def picked_documents(spark: SparkSession, d: str) -> DataFrame:
    """Of each file's drafts the one whose part ranks first, as a publication document."""
    codes = F.create_map(*[F.lit(x) for kv in {"claims": "PAMPH", "description": "PUB", "abstract": "A1"}.items() for x in kv])
    rows = table(spark, d, "part_drafts").select("file_id", F.col("part").alias("document_id"), F.coalesce(F.element_at(codes, F.col("part")), F.lit("OTHER")).alias("document_code"), F.col("draft_id").alias("pos"))
    return resolution.publication_documents(rows, "file_id")


def receipts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select("n_nationkey", "n_name")
    signed = rows.withColumn("receipt", integrity.signed(RECEIPT_KEY, "lookup", F.lit(1_700_000_000), F.struct("n_name", "n_nationkey")))
    now = F.lit(1_700_000_600)
    return signed.withColumn("valid", integrity.verified(RECEIPT_KEY, "lookup", F.col("receipt"), now, 3600)).withColumn(
        "other_purpose", integrity.verified(RECEIPT_KEY, "analysis", F.col("receipt"), now, 3600)
    )


def delivery_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part_drafts")
    size = F.length(F.coalesce("text", F.lit("")))
    return rows.groupBy("status").agg(
        F.count("*").alias("drafts"), F.count_if(F.col("sha256").isNull()).alias("unsigned"), F.count_if(size == 0).alias("empty"), F.sum(size.cast("bigint")).alias("characters")
    )


_ORDER = ", ".join(f"s_{k}" for k in language.MARKERS)
_SCRIPT_CASE = " ".join(f"WHEN regexp_matches(sample, '{p}') THEN '{c}'" for c, p in language.SCRIPTS)
_MARK_CASE = " ".join(f"WHEN s_{k} > 0 AND s_{k} = greatest({_ORDER}) THEN '{k}'" for k in language.MARKERS)
_SCORES = ", ".join(" + ".join(_sql_times("sample", m) for m in marks) + f" AS s_{k}" for k, marks in language.MARKERS.items())
_ALIAS_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in language.ALIASES.items())
_ENGINE_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in language.TESSERACT.items())
_WRONG = " + ".join(_sql_times("t", m) for m in tx.MOJIBAKE)
_NUMBER_FIELDS = ", ".join(ids.FIELDS)
_HEADING_VALUES = ", ".join(f"('{k}', '{p}')" for k, p in tx.heading_keys().items())
_ALIAS_KEY = "regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')"
MEASURED = f"""
    SELECT file_id, part, CAST(sum(w) AS BIGINT) AS word_count, max_by(status, (CAST(f AS INT), draft_id)) AS status,
      CASE count(DISTINCT CASE WHEN f AND coalesce(method, 'none') <> 'none' THEN method END) WHEN 0 THEN 'none'
        WHEN 1 THEN max(CASE WHEN f AND coalesce(method, 'none') <> 'none' THEN method END) ELSE 'mixed' END AS method,
      CASE min(CASE WHEN f THEN CASE confidence WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END END)
        WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'none' END AS confidence
    FROM (SELECT *, trim(coalesce(text, '')) <> '' AS f, coalesce({_sql_units('text')}, 0) AS w FROM part_drafts) GROUP BY file_id, part"""
#: WITH clauses up to p: key_a, key_b, shared, jaccard of the near duplicates among distinct texts.
NEAR = f"""WITH r AS (SELECT min(doc_id) AS k, text FROM documents WHERE text <> '' GROUP BY text), t AS (SELECT k, {_sql_tokens('text')} AS ts FROM r),
    g AS (SELECT k, list_distinct(list_transform(range(1, len(ts) - 3), lambda i: lower(array_to_string(ts[i:i + 4], chr(1))))) AS gs FROM t WHERE len(ts) >= 5),
    u AS (SELECT k, len(gs) AS n, unnest(gs) AS gram FROM g WHERE len(gs) >= 20), q AS (SELECT a.k AS key_a, b.k AS key_b, a.n AS na, b.n AS nb, count(*) AS shared FROM u a JOIN u b USING (gram) WHERE a.k < b.k GROUP BY ALL),
    p AS (SELECT key_a, key_b, shared, round(shared / (na + nb - shared), 4) AS jaccard FROM q WHERE shared / (na + nb - shared) >= 0.8)"""
_HEX = lambda pad: bytes(b ^ pad for b in RECEIPT_KEY.ljust(64, b"\0")).hex()
_B64 = lambda x: f"translate(base64({x}), '+/=', '-_')"
_SIGNED = _B64(f"unhex(sha256(unhex('{_HEX(0x5C)}') || unhex(sha256(unhex('{_HEX(0x36)}') || encode(payload)))))")
_WORDS = ", ".join(f"CAST(coalesce(sum(word_count) FILTER (part = '{p}'), 0) AS BIGINT) AS {p}_words" for p in sections.PARTS)
_BY_FILE = f"""
    SELECT f.*, document_text_words + drawing_words AS total_words,
      CASE WHEN NOT has THEN 'failed' WHEN coalesce(warnings, 0) > 0 THEN 'partial' ELSE 'success' END AS file_status
    FROM (SELECT file_id, {_WORDS},
        CAST(coalesce(sum(word_count) FILTER (part IN ('abstract', 'description', 'claims', 'unclassified')), 0) AS BIGINT) AS document_text_words,
        CAST(coalesce(sum(word_count) FILTER (part IN ('abstract_drawing', 'description_drawings')), 0) AS BIGINT) AS drawing_words,
        bool_or(status NOT IN ('missing', 'error')) AS has FROM ({MEASURED}) GROUP BY file_id) f
    LEFT JOIN (SELECT file_id, sum(len(warnings)) AS warnings FROM ocr_pages GROUP BY file_id) USING (file_id)"""
_FILE_COLUMNS = ", ".join(["file_id", *(f"{p}_words" for p in sections.PARTS), "document_text_words", "drawing_words", "total_words", "file_status"])


def _sql_number(raw: str, source: str | None = None) -> str:
    """SELECT list of FIELDS for the number in `raw`, from columns v, t, c, s (see uses)."""
    x = lambda col, pattern, k: f"regexp_extract({col}, '{pattern}', {k})"
    slash, pct_slash = f"regexp_matches(s, '{ids.WO_SLASH}')", f"regexp_matches(s, '{ids.PCT_SLASH}')"
    wo = [f"(CASE WHEN {slash} THEN {x('s', ids.WO_SLASH, k)} ELSE {x('c', ids.WO_COMPACT, k)} END)" for k in (1, 2, 3)]
    pct = [f"(CASE WHEN {pct_slash} THEN {x('s', ids.PCT_SLASH, k)} ELSE {x('c', ids.PCT_COMPACT, k)} END)" for k in (1, 2, 3)]
    n = [x("c", ids.NATIONAL, k) for k in (1, 2, 3)]
    doc = rf"(CASE WHEN {n[0]} = 'US' AND regexp_matches({n[1]}, '^\d{{4}}0\d{{6}}$') THEN substr({n[1]}, 1, 4) || substr({n[1]}, 6, 6) ELSE {n[1]} END)"
    rest = " || ".join(pct)
    kinds = [
        ("v = ''", None),
        (f"regexp_matches(t, '{ids.EP_CHECKED}')", ["'epo'", "t", "t", "'EP'", x("t", ids.EP_CHECKED, 1), "NULL", f"'EP' || {x('t', ids.EP_CHECKED, 1)}", "'application'"]),
    ]
    if source == "epo":
        other = "NOT regexp_matches(c, '^(EP|WO|PCT)')"
        kinds += [
            (f"{other} AND regexp_matches(c, '{ids.NATIONAL}')", ["'epo'", f"{n[0]} || {doc} || {n[2]}", "v", n[0], doc, f"nullif({n[2]}, '')", f"{n[0]} || {doc}", "'publication'"]),
            (other, None),
        ]
    kinds += [
        (f"c LIKE 'PCT%' AND ({pct_slash} OR regexp_matches(c, '{ids.PCT_COMPACT}'))", "wipo" if source == "epo" else ["'wipo'", f"'PCT' || {rest}", f"'PCT/' || {pct[0]} || {pct[1]} || '/' || {pct[2]}", "'PCT'", rest, "NULL", rest, "'publication'"]),
        ("c LIKE 'PCT%'", None),
        (f"regexp_matches(c, '{ids.EP_EPODOC}')", ["'epo'", "c", "c", "'EP'", x("c", ids.EP_EPODOC, 1), "NULL", "c", "'application'"]),
        (f"regexp_matches(c, '{ids.EP_PUBLICATION}')", ["'epo'", "c", "c", "'EP'", x("c", ids.EP_PUBLICATION, 1), f"nullif({x('c', ids.EP_PUBLICATION, 2)}, '')",
            f"CASE WHEN {x('c', ids.EP_PUBLICATION, 2)} <> '' THEN 'EP' || {x('c', ids.EP_PUBLICATION, 1)} || '.' || {x('c', ids.EP_PUBLICATION, 2)} ELSE c END", "'publication'"]),
        ("c LIKE 'EP%'", None),
        (f"c LIKE 'WO%' AND ({slash} OR regexp_matches(c, '{ids.WO_COMPACT}'))", "wipo" if source == "epo" else ["'wipo'", f"'WO' || {wo[0]} || {wo[1]} || {wo[2]}", f"'WO/' || {wo[0]} || '/' || {wo[1]}", "'WO'", f"{wo[0]} || {wo[1]}", f"nullif({wo[2]}, '')", f"'WO' || {wo[0]} || {wo[1]} || {wo[2]}", "'publication'"]),
        ("c LIKE 'WO%'", None),
        ("regexp_matches(c, '^[A-Z]{2}')", "prefix"),
    ]
    out = []
    for i, field in enumerate(ids.FIELDS[:-1]):
        cases = " ".join(f"WHEN {cond} THEN {vals[i] if isinstance(vals, list) else 'NULL'}" for cond, vals in kinds)
        out.append(f"CASE WHEN {raw} IS NULL THEN NULL {cases} ELSE NULL END AS {field}")
    error = lambda v: "NULL" if isinstance(v, list) else "'unsupported_jurisdiction'" if v else "'invalid_patent_number_format'"
    cases = " ".join(f"WHEN {cond} THEN {error(vals)}" for cond, vals in kinds)
    out.append(f"CASE WHEN {raw} IS NULL THEN 'invalid_patent_number_format' {cases} ELSE 'invalid_patent_number_format' END AS error_code")
    return ", ".join(out)


def _numbers_sql(column: str, source_table: str, source: str | None = None) -> str:
    return rf"""
    SELECT {column}, {_sql_number(column, source)} FROM (
      SELECT {column}, v, regexp_replace(v, '[\s/-]+', '', 'g') AS t, regexp_replace(v, '[\s./-]+', '', 'g') AS c, replace(v, ' ', '') AS s
      FROM (SELECT DISTINCT {column}, upper(trim({column})) AS v FROM {source_table}))"""


ORACLE_SQL: dict[str, str] = {
    "unit_counts_by_lang": f"SELECT lang, count(*) AS documents, CAST(sum({_sql_units('text')}) AS BIGINT) AS units FROM documents GROUP BY lang",
    "latin_word_counts": f"SELECT doc_id, CAST(len(regexp_extract_all({_sql_normal('text')}, '{_LATIN}')) AS BIGINT) AS words FROM documents",
    "top_units": f"SELECT lower(u) AS unit, count(*) AS n FROM (SELECT unnest({_sql_tokens('text')}) AS u FROM documents) GROUP BY 1 ORDER BY n DESC, unit LIMIT 100",
    "page_language": f"""
        SELECT page_id, CASE {_SCRIPT_CASE} {_MARK_CASE} ELSE 'en' END AS code, {_ORDER} FROM (SELECT page_id, sample, {_SCORES} FROM (
          SELECT page_id, ' ' || substr({_sql_one('lower(text)')}, 1, {language.SAMPLE}) || ' ' AS sample FROM ocr_pages WHERE text IS NOT NULL))""",
    "label_codes": f"""
        WITH a(k, v) AS (VALUES {_ALIAS_VALUES}), p AS (SELECT lang, replace(lower(trim(coalesce(lang, ''))), '-', '_') AS x FROM documents),
        c AS (SELECT p.lang, coalesce(a.v, b.v, 'en') AS code FROM p LEFT JOIN a ON a.k = p.x LEFT JOIN a b ON b.k = split_part(p.x, '_', 1))
        SELECT lang, code, CASE code {_ENGINE_CASE} ELSE 'eng' END AS engine_code, count(*) AS documents FROM c GROUP BY ALL""",
    "reliable_pages": f"""
        SELECT page_id, {_sql_units('t')} >= 2 AND length(x) > 0 AND {_WRONG} <= length(x) * 0.01 AND NOT regexp_matches(x, '[\\x00-\\x1F]')
          AND len(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}]')) >= length(x) * 0.25 AS reliable,
          CASE WHEN confidence >= 80 THEN 'high' WHEN confidence >= 50 THEN 'medium' ELSE 'low' END AS band
        FROM (SELECT page_id, confidence, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') AS x FROM ocr_pages)""",
    "running_lines": f"""
        SELECT page_id, CAST(n - 1 AS INT) AS line_no, line FROM (
          SELECT page_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, {_sql_one('unnest(string_split(text, chr(10)))')} AS line FROM ocr_pages WHERE text IS NOT NULL)
        WHERE regexp_matches(line, '{tx.PATENT_HEADER}') OR regexp_matches(line, '{tx.PAGE_LABEL}')""",
    "cleaned_pages": f"""
        SELECT page_id, {_sql_one(
            "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\b(?:WO\\s*\\d{4}\\s*/?\\s*\\d{4,6}|EP\\s*\\d{4,12}\\s*[A-Z]\\d{1,2}|PCT\\s*/\\s*[A-Z]{2}\\s*\\d{4}\\s*/\\s*\\d{4,6})\\b', ' ', 'g'),"
            " '(?m)^\\s*\\d+\\s*/\\s*\\d+\\s*$', ' ', 'g'), '(?m)^\\s*-\\s*\\d+\\s*-\\s*$', ' ', 'g'), '(?m)^\\s*(?:19|20)\\d{2}\\s+\\d{2}\\s+\\d{2}\\s*$', ' ', 'g'), '(?m)^\\s*[A-Za-z]{1,3}/[A-Za-z]{1,3}\\s*$', ' ', 'g')"
        )} AS cleaned FROM ocr_pages WHERE text IS NOT NULL""",
    "drawing_pages": f"""
        SELECT page_id, len(u) > 0 AND regexp_matches(text, '\\d') AND (regexp_matches(text, '(?i)\\bfig(?:ure)?\\.?\\s*\\d+')
          OR (len(u) <= 30 AND len(list_filter(u, lambda x: regexp_matches(x, '^\\p{{Nd}}') OR length(x) <= 4)) * 2 >= len(u))) AS drawing
        FROM (SELECT page_id, text, {_sql_tokens('text')} AS u FROM ocr_pages WHERE text IS NOT NULL)""",
    "part_measures": MEASURED,
    "file_words": f"SELECT {_FILE_COLUMNS} FROM ({_BY_FILE})",
    "type_rollup": f"""
        SELECT file_type, {', '.join(f'CAST(sum({p}_words) AS BIGINT) AS {p}_words' for p in sections.PARTS)}, CAST(sum(total_words) AS BIGINT) AS total_words, count(*) AS files,
          CASE WHEN bool_and(file_status = 'success') THEN 'success' WHEN bool_and(file_status = 'failed') THEN 'failed' ELSE 'partial' END AS status
        FROM ({_BY_FILE}) JOIN (SELECT file_id, min(file_type) AS file_type FROM part_drafts GROUP BY 1) USING (file_id) GROUP BY file_type""",
    "comparable_texts": """
        SELECT file_id, string_agg(trim(text), ' ' ORDER BY r, draft_id) AS text FROM (
          SELECT *, CASE part WHEN 'abstract' THEN 0 WHEN 'description' THEN 1 WHEN 'claims' THEN 2 ELSE 3 END AS r FROM part_drafts
          WHERE part IN ('abstract', 'description', 'claims', 'unclassified') AND trim(text) <> '') GROUP BY file_id""",
    "exact_duplicates": """
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE text <> ''""",
    "page_containment": f"""
        SELECT page_id, round(share, 4) AS share, share >= 0.8 AS repeats FROM (
          SELECT page_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0.0 END AS share FROM (
            SELECT page_id, u AS a, lag(u) OVER (PARTITION BY file_id ORDER BY page_no, page_id) AS b FROM (
              SELECT page_id, file_id, page_no, list_distinct(list_transform({_sql_tokens('text')}, lambda x: lower(x))) AS u FROM ocr_pages WHERE text IS NOT NULL)) WHERE b IS NOT NULL)""",
    "drawing_labels": f"""
        SELECT doc_id, CAST(len(l) AS BIGINT) AS labels, array_to_string(list_sort(l), ' | ') AS listed FROM (
          SELECT doc_id, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_sql_normal('x')}), lambda x: regexp_matches(x, '(?i)^FIGS?\\.\\s+.+'))) AS l FROM documents)""",
    "section_units": f"""
        WITH h(k, p) AS (VALUES {_HEADING_VALUES}),
        l AS (SELECT file_id, page_no, n, line FROM (SELECT file_id, page_no, generate_subscripts(string_split(text, chr(10)), 1) AS n, {_sql_one('unnest(string_split(text, chr(10)))')} AS line
              FROM ocr_pages WHERE text IS NOT NULL AND NOT regexp_matches(text, '{tx.SEARCH_REPORT}'))
              WHERE line <> '' AND NOT regexp_matches(line, '{tx.PATENT_HEADER}') AND NOT regexp_matches(line, '{tx.PAGE_LABEL}')),
        k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(line), '^(?:\\(\\d+\\)|\\d+[.)])\\s*', ''), '{tx.PAGE_SUFFIX}', '', 'i'), '[:：.。 ]+$', '') AS low FROM l),
        o AS (SELECT k.*, CASE WHEN length(low) <= 100 THEN h.p END AS own FROM k LEFT JOIN h ON h.k = regexp_replace(low, '{tx.HEADING_SEPARATORS}', '', 'g')),
        s AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY page_no, n ROWS UNBOUNDED PRECEDING), 'unclassified') AS part FROM o)
        SELECT file_id, part, count(*) AS lines, CAST(sum({_sql_units('line')}) AS BIGINT) AS units FROM s WHERE own IS NULL GROUP BY file_id, part""",
    "normalized_numbers": _numbers_sql("query", "patent_lookup_events"),
    "national_numbers": _numbers_sql("number", "priority_claims", "epo"),
    "first_aliases": f"""
        SELECT alias, min_by(response_id, (answered_at, response_id)) AS response_id FROM (
          SELECT response_id, answered_at, {_ALIAS_KEY.format(x='n')} AS alias FROM (SELECT response_id, answered_at, unnest([display_number, normalized_number]) AS n FROM lookup_responses))
        WHERE alias <> '' GROUP BY alias""",
    "two_tier_lookup": f"""
        WITH e AS (SELECT normalized_number, max_by(response_id, (answered_at, response_id)) AS r FROM lookup_responses GROUP BY 1),
        a AS (SELECT {_ALIAS_KEY.format(x='display_number')} AS alias, min_by(response_id, (answered_at, response_id)) AS r FROM lookup_responses
              WHERE {_ALIAS_KEY.format(x="coalesce(display_number, '')")} <> '' GROUP BY 1),
        q AS (SELECT DISTINCT query, normalized_number FROM patent_lookup_events)
        SELECT q.query, q.normalized_number, coalesce(e.r, a.r) AS response_id, CASE WHEN e.r IS NOT NULL THEN 1 WHEN a.r IS NOT NULL THEN 2 END AS tier
        FROM q LEFT JOIN e ON e.normalized_number = q.normalized_number LEFT JOIN a ON a.alias = {_ALIAS_KEY.format(x='q.query')}""",
    "latest_answers": """
        SELECT source, normalized_number, response_id, title, publication_date, answered_at FROM lookup_responses
        QUALIFY row_number() OVER (PARTITION BY source, normalized_number ORDER BY answered_at DESC, response_id DESC) = 1""",
    "upserted_orders": """
        SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "events_once": """
        SELECT event_id, outcome, created_at, loaded_at FROM patent_lookup_events
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY loaded_at, created_at, outcome) = 1""",
    "linked_responses": "SELECT response_id, normalized_number FROM lookup_responses WHERE response_id IN (SELECT response_id FROM patent_lookup_events WHERE response_id IS NOT NULL)",
    "unlinked_responses": "SELECT response_id, normalized_number FROM lookup_responses WHERE response_id NOT IN (SELECT response_id FROM patent_lookup_events WHERE response_id IS NOT NULL)",
    "new_customers": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey IS NOT NULL)",
    "near_duplicates": f"{NEAR} SELECT key_a, key_b, shared, jaccard FROM p",
    "receipts": f"""SELECT n_nationkey, n_name, payload || '.' || {_SIGNED} AS receipt, true AS valid, false AS other_purpose FROM (SELECT *, {_B64("encode(body)")} AS payload FROM (
        SELECT *, '{{"data":{{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}},"issued_at":1700000000,"purpose":"lookup"}}' AS body FROM nation))""",
    "preferred_part": """
        SELECT file_id, draft_id, part, status FROM part_drafts QUALIFY row_number() OVER (PARTITION BY file_id
          ORDER BY CASE part WHEN 'claims' THEN 0 WHEN 'description' THEN 1 WHEN 'abstract' THEN 2 WHEN 'unclassified' THEN 3 ELSE 9 END, draft_id) = 1""",
    "merged_answers": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY normalized_number, coalesce(data_origin, '') = 'official' ORDER BY answered_at DESC, response_id DESC) AS k FROM lookup_responses),
        f AS (SELECT * FROM r WHERE k = 1 AND coalesce(data_origin, '') <> 'official')
        SELECT p.normalized_number, coalesce(nullif(p.title, ''), nullif(f.title, '')) AS title, coalesce(nullif(p.abstract, ''), nullif(f.abstract, '')) AS abstract,
          coalesce(nullif(p.application_no, ''), nullif(f.application_no, '')) AS application_no, coalesce(nullif(p.publication_date, ''), nullif(f.publication_date, '')) AS publication_date
        FROM r p LEFT JOIN f ON f.normalized_number = p.normalized_number WHERE p.k = 1 AND p.data_origin = 'official'""",
    "bytes_budget": """
        SELECT page_id, CAST(s AS BIGINT) AS running, s <= 2000 AS within FROM (
          SELECT page_id, sum(strlen(coalesce(text, ''))) OVER (PARTITION BY file_id ORDER BY page_no, page_id ROWS UNBOUNDED PRECEDING) AS s FROM ocr_pages)""",
    "expired_events": """
        SELECT date_trunc('month', created_at) AS month, count(*) AS expired FROM patent_lookup_events
        WHERE epoch(date_trunc('second', created_at)) + 7776000 <= (SELECT epoch(date_trunc('second', max(created_at))) FROM patent_lookup_events) GROUP BY 1""",
    "outcome_windows": """
        SELECT date_trunc('day', created_at) AS window_start, outcome, count(*) AS events, CAST(sum(elapsed_ms) AS BIGINT) AS elapsed_ms
        FROM patent_lookup_events WHERE created_at IS NOT NULL GROUP BY 1, 2""",
    "earliest_dates": """
        SELECT response_id, substr(m, 1, 4) || '-' || substr(m, 5, 2) || '-' || substr(m, 7, 2) AS earliest, dated FROM (
          SELECT response_id, min(date) AS m, count(*) AS dated FROM priority_claims WHERE regexp_matches(date, '^[0-9]{8}$') GROUP BY 1)""",
    "filled_representatives": """
        SELECT rep_id, coalesce(nullif(trim(organization), ''), nullif(trim(name), '')) AS label, regexp_replace(upper(country), '[^\\p{L}\\p{N}]', '', 'g') AS country
        FROM representatives WHERE coalesce(nullif(trim(organization), ''), nullif(trim(name), '')) IS NOT NULL""",
    "class_differences": """
        SELECT response_id, array_to_string(list_sort(list_distinct(list_filter(ipc, lambda x: NOT list_contains(b, x)))), ', ') AS added,
          array_to_string(list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(ipc, x)))), ', ') AS dropped
        FROM (SELECT response_id, ipc, lag(ipc) OVER (PARTITION BY normalized_number ORDER BY answered_at, response_id) AS b FROM lookup_responses WHERE ipc IS NOT NULL) WHERE b IS NOT NULL""",
    "file_names": """
        SELECT DISTINCT filename, regexp_replace(regexp_replace(filename, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS safe,
          CASE WHEN trim(filename) <> '' AND NOT regexp_matches(trim(filename), '^[A-Za-z]:|[/\\\\]|^\\.{1,2}$') THEN trim(filename) END AS strict FROM part_drafts""",
    "lookup_paths": f"""
        SELECT normalized_number, array_to_string(list_distinct_ordered, ' ') AS paths,
          CASE WHEN coalesce(country_code, '') <> '' AND coalesce(doc_number, '') <> '' AND coalesce(kind_code, '') <> ''
            THEN 'https://example.org/pub/' || country_code || doc_number || 'NW' || kind_code || '/document.pdf' END AS link
        FROM (SELECT *, list_filter([a, b, c, CASE WHEN e <> c THEN e END], lambda x: x IS NOT NULL) AS list_distinct_ordered FROM (
          SELECT *, '/published-data/' || reference_type || '/epodoc/' || lookup_number || '/biblio' AS a,
            CASE WHEN coalesce(kind_code, '') <> '' THEN '/published-data/' || reference_type || '/docdb/' || country_code || '.' || doc_number || '.' || kind_code || '/biblio' END AS b,
            '/published-data/search/biblio?q=pn%3D' || country_code || doc_number || coalesce(kind_code, '') AS c, '/published-data/search/biblio?q=pn%3D' || country_code || doc_number AS e
          FROM (SELECT normalized_number, source, nn AS normal, display_number, country_code, doc_number, kind_code, lookup_number, reference_type, error_code
            FROM (SELECT input AS normalized_number, source, normalized_number AS nn, display_number, country_code, doc_number, kind_code, lookup_number, reference_type, error_code
              FROM ({_numbers_sql('input', '(SELECT normalized_number AS input FROM lookup_responses)')})) WHERE error_code IS NULL)))""",
    "related_numbers": """
        SELECT response_id, count(*) AS n, string_agg(number, ' | ' ORDER BY number) AS related FROM (
          SELECT DISTINCT response_id, number FROM priority_claims JOIN lookup_responses USING (response_id) WHERE number IS NOT NULL
            AND regexp_replace(upper(number), '[^\\p{L}\\p{N}]', '', 'g') <> coalesce(regexp_replace(upper(normalized_number), '[^\\p{L}\\p{N}]', '', 'g'), '')
            AND regexp_replace(upper(number), '[^\\p{L}\\p{N}]', '', 'g') <> coalesce(regexp_replace(upper(display_number), '[^\\p{L}\\p{N}]', '', 'g'), '')) GROUP BY response_id""",
    "answers_with_fallback": """
        WITH r AS (SELECT *, coalesce(data_origin, '') = 'official' AS o, row_number() OVER (PARTITION BY normalized_number, coalesce(data_origin, '') = 'official' ORDER BY answered_at DESC, response_id DESC) AS k FROM lookup_responses),
        f AS (SELECT normalized_number, title FROM r WHERE k = 1 AND NOT o AND coalesce(title, '') <> '')
        SELECT p.normalized_number, CASE WHEN coalesce(p.title, '') <> '' OR f.title IS NOT NULL THEN 'ok' ELSE 'no_result' END AS outcome,
          CASE WHEN coalesce(p.title, '') = '' AND f.title IS NOT NULL THEN f.title ELSE p.title END AS payload, CASE WHEN coalesce(p.title, '') = '' AND f.title IS NOT NULL THEN 2 ELSE 1 END AS source
        FROM r p LEFT JOIN f USING (normalized_number) WHERE p.k = 1 AND p.o""",
    "picked_documents": """
        SELECT file_id, document_id, document_code, pos FROM (
          SELECT file_id, part AS document_id, c AS document_code, max(draft_id) AS pos FROM (
            SELECT *, CASE part WHEN 'claims' THEN 'PAMPH' WHEN 'description' THEN 'PUB' WHEN 'abstract' THEN 'A1' ELSE 'OTHER' END AS c FROM part_drafts) GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY CASE document_code WHEN 'PAMPH' THEN 0 WHEN 'APBDY' THEN 1 WHEN 'PUB' THEN 2 WHEN 'A1' THEN 3 WHEN 'A2' THEN 4 ELSE 5 END, pos) = 1""",
    "text_digests": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "delivery_checks": """
        SELECT status, count(*) AS drafts, count(*) FILTER (sha256 IS NULL) AS unsigned, count(*) FILTER (coalesce(text, '') = '') AS empty,
          CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS characters FROM part_drafts GROUP BY status""",
}

QUERIES = {
    f.__name__: f
    for f in (
        unit_counts_by_lang, latin_word_counts, top_units, page_language, label_codes, reliable_pages, running_lines, cleaned_pages, drawing_pages, section_units,
        part_measures, file_words, type_rollup, comparable_texts, exact_duplicates, near_duplicates, page_containment, drawing_labels, normalized_numbers,
        national_numbers, first_aliases, two_tier_lookup, latest_answers, upserted_orders, events_once, linked_responses, unlinked_responses, new_customers,
        preferred_part, merged_answers, bytes_budget, expired_events, outcome_windows, earliest_dates, filled_representatives, class_differences, file_names,
        lookup_paths, related_numbers, answers_with_fallback, picked_documents, text_digests, receipts, delivery_checks,
    )
}

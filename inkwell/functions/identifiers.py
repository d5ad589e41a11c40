"""Publication and application numbers in one canonical form, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of numbers (upper case, separators removed where noted).
EP_CHECKED = r"^EP(\d{8})\.(\d)$"
EP_EPODOC = r"^EP(\d{8})$"
EP_PUBLICATION = r"^EP(\d{4,12})([A-Z]\d{1,2})?$"
WO_COMPACT = r"^WO(\d{4})(\d{6})([A-Z]\d{1,2})?$"
WO_SLASH = r"^WO/(\d{4})/(\d{6})([A-Z]\d{1,2})?$"
PCT_COMPACT = r"^PCT([A-Z]{2})(\d{4})(\d{6})$"
PCT_SLASH = r"^PCT/([A-Z]{2})(\d{4})/(\d{6})$"
NATIONAL = r"^([A-Z]{2})([A-Z0-9]{4,}?)([A-Z]\d{0,2})?$"

FIELDS = ["source", "normalized_number", "display_number", "country_code", "doc_number", "kind_code", "lookup_number", "reference_type", "error_code"]


def _ref(**fields: Column | str) -> Column:
    given = {"reference_type": "publication", **fields}
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(*((as_column(given[f]) if f in given else F.lit(None)).cast("string").alias(f) for f in FIELDS))


def _error(code: str) -> Column:
    return F.struct(*((F.lit(code) if f == "error_code" else F.lit(None)).cast("string").alias(f) for f in FIELDS))


def normalized_number(raw: Column, source: str | None = None) -> Column:
    """Struct of FIELDS; error_code is null where the number is understood. `source` may ask
    for `epo`, which also admits national numbers, or `wipo`."""
    value = F.upper(F.trim(raw))
    tight = F.regexp_replace(value, r"[\s/-]+", "")
    compact = F.regexp_replace(value, r"[\s./-]+", "")
    spaceless = F.replace(value, F.lit(" "), F.lit(""))
    part = lambda x, pattern, k: F.regexp_extract(x, pattern, k)
    filled = lambda x: F.nullif(x, F.lit(""))

    def checked_source(reference: Column, found: str) -> Column:
        return reference if source in (None, found) else _error("unsupported_jurisdiction")

    digits, check = part(tight, EP_CHECKED, 1), part(tight, EP_CHECKED, 2)
    with_check = F.concat(F.lit("EP"), digits, F.lit("."), check)
    ep_checked = _ref(
        source="epo", normalized_number=with_check, display_number=with_check, country_code="EP", doc_number=digits, lookup_number=F.concat(F.lit("EP"), digits), reference_type="application"
    )
    ep_app = _ref(source="epo", normalized_number=compact, display_number=compact, country_code="EP", doc_number=part(compact, EP_EPODOC, 1), lookup_number=compact, reference_type="application")
    ep_doc, ep_kind = part(compact, EP_PUBLICATION, 1), part(compact, EP_PUBLICATION, 2)
    ep_pub = _ref(
        source="epo", normalized_number=compact, display_number=compact, country_code="EP", doc_number=ep_doc, kind_code=filled(ep_kind),
        lookup_number=F.when(ep_kind != "", F.concat(F.lit("EP"), ep_doc, F.lit("."), ep_kind)).otherwise(compact),
    )
    slash = spaceless.rlike(WO_SLASH)
    wo = [F.when(slash, part(spaceless, WO_SLASH, k)).otherwise(part(compact, WO_COMPACT, k)) for k in (1, 2, 3)]
    wo_number = F.concat(F.lit("WO"), *wo)
    wo_ref = _ref(
        source="wipo", normalized_number=wo_number, display_number=F.concat(F.lit("WO/"), wo[0], F.lit("/"), wo[1]), country_code="WO", doc_number=F.concat(wo[0], wo[1]),
        kind_code=filled(wo[2]), lookup_number=wo_number,
    )
    pct_slash = spaceless.rlike(PCT_SLASH)
    pct = [F.when(pct_slash, part(spaceless, PCT_SLASH, k)).otherwise(part(compact, PCT_COMPACT, k)) for k in (1, 2, 3)]
    rest = F.concat(*pct)
    pct_ref = _ref(
        source="wipo", normalized_number=F.concat(F.lit("PCT"), rest), display_number=F.concat(F.lit("PCT/"), pct[0], pct[1], F.lit("/"), pct[2]), country_code="PCT", doc_number=rest, lookup_number=rest
    )
    cc, doc, kind = (part(compact, NATIONAL, k) for k in (1, 2, 3))
    # A US publication of eleven digits drops one leading zero of its serial.
    doc = F.when((cc == "US") & doc.rlike(r"^\d{4}0\d{6}$"), F.concat(F.substring(doc, 1, 4), F.substring(doc, 6, 6))).otherwise(doc)
    national = _ref(source="epo", normalized_number=F.concat(cc, doc, kind), display_number=value, country_code=cc, doc_number=doc, kind_code=filled(kind), lookup_number=F.concat(cc, doc))

    invalid = _error("invalid_patent_number_format")
    out = F.when(value == "", invalid).when(tight.rlike(EP_CHECKED), ep_checked)
    if source == "epo":
        other = ~compact.rlike(r"^(?:EP|WO|PCT)")
        out = out.when(other & compact.rlike(NATIONAL), national).when(other, invalid)
    out = (
        out.when(compact.startswith("PCT") & (pct_slash | compact.rlike(PCT_COMPACT)), checked_source(pct_ref, "wipo"))
        .when(compact.startswith("PCT"), invalid)
        .when(compact.rlike(EP_EPODOC), checked_source(ep_app, "epo"))
        .when(compact.rlike(EP_PUBLICATION), checked_source(ep_pub, "epo"))
        .when(compact.startswith("EP"), invalid)
        .when(compact.startswith("WO") & (slash | compact.rlike(WO_COMPACT)), checked_source(wo_ref, "wipo"))
        .when(compact.startswith("WO"), invalid)
        .when(compact.rlike(r"^[A-Z]{2}"), _error("unsupported_jurisdiction"))
        .otherwise(invalid)
    )
    return F.when(raw.isNull(), invalid).otherwise(out)


def alias_key(value: Column) -> Column:
    """ASCII letters and digits only, upper case."""
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def compact_number(value: Column) -> Column:
    """Letters and digits of any script, upper case."""
    return F.regexp_replace(F.upper(value), r"[^\p{L}\p{N}]", "")


def full_number(country: Column, number: Column, kind: Column) -> Column:
    return F.when((F.coalesce(country, F.lit("")) != "") & (F.coalesce(number, F.lit("")) != ""), F.concat(country, number, F.coalesce(kind, F.lit("")))).otherwise(number)


def without_country(number: Column, country: Column) -> Column:
    """A number without a country prefix that it repeats."""
    return F.when(number.startswith(country), F.substring(number, F.length(country) + 1, F.length(number))).otherwise(number)


def rest_number(reference: Column) -> Column:
    """Number under which the international service files a reference (struct of
    normalized_number()): two-digit year for publications, as it is for applications."""
    doc = reference["doc_number"]
    return F.when(reference["country_code"] == "WO", F.concat(F.lit("WO"), F.substring(doc, 3, 20))).when(reference["country_code"] == "PCT", doc)


def _some(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _renumbered(reference: Column, country: Column, number: Column, kind: Column, display: Column | None = None) -> Column:
    """`reference` as the publication of these parts: its number and lookup number follow them."""
    kind = _some(kind)
    plain = F.concat(country, number)
    whole = F.concat(plain, F.coalesce(kind, F.lit("")))
    parts = {
        "normalized_number": whole, "display_number": whole if display is None else display, "country_code": country, "doc_number": number, "kind_code": kind,
        "lookup_number": F.when((country == "EP") & kind.isNotNull(), F.concat(plain, F.lit("."), kind)).otherwise(plain), "reference_type": F.lit("publication"),
    }
    return F.struct(*(parts.get(f, reference[f]).alias(f) for f in FIELDS))


def canonical(reference: Column, epodoc: Column, publication: Column) -> Column:
    """A reference (struct of FIELDS) as the answer itself names it: by its epodoc id, else by the
    publication it states (structs country, doc_number, kind), else as asked."""
    pick = lambda c, own: F.coalesce(_some(epodoc[c]), _some(publication[c]), reference[own])
    country = pick("country", "country_code")
    return _renumbered(reference, country, without_country(pick("doc_number", "doc_number"), country), pick("kind", "kind_code"), reference["display_number"])


def with_kind(reference: Column, kind: Column) -> Column:
    """The European publication of that kind of the same document."""
    return _renumbered(reference, F.lit("EP"), reference["doc_number"], kind)


def published_as(reference: Column, publication: Column) -> Column:
    """An application's publication as the register states it (struct country, doc_number, kind);
    error `source_no_result` where it states none. Other references stay as they are."""
    found = _renumbered(reference, F.coalesce(_some(publication["country"]), F.lit("EP")), publication["doc_number"], publication["kind"])
    found = F.when(_some(publication["doc_number"]).isNotNull(), found).otherwise(_error("source_no_result"))
    return F.when(reference["reference_type"] == "application", found).otherwise(reference)


def application_kinds(kind: Column) -> Column:
    """Kinds of publication that may hold the application as filed, in order."""
    return F.when(kind.isin("A1", "A2"), F.array(kind)).otherwise(F.array(F.lit("A1"), F.lit("A2")))


def publication_number(reference: Column, publication: Column) -> Column:
    """Number of a publication: as selected, else that of a reference with a kind, else composed
    of country, number and kind if all are known."""
    country, number = F.coalesce(_some(publication["country"]), reference["country_code"]), F.coalesce(_some(publication["doc_number"]), reference["doc_number"])
    return F.coalesce(_some(publication["selected_number"]), F.when(reference["kind_code"].isNotNull(), reference["normalized_number"]), F.concat(country, number, _some(publication["kind"])))


def response_number(reference: Column, full: Column) -> Column:
    """Number shown for an international publication: of an application that of its publication,
    else as displayed, without kind."""
    return F.when(reference["country_code"] == "PCT", _some(full)).otherwise(reference["display_number"])


def pct_number(country: Column, number: Column) -> Column:
    """`WO/2020/123456`, or `cc/number` for others; null if a part is missing."""
    known = _some(country).isNotNull() & _some(number).isNotNull()
    wo = (country == "WO") & (F.length(number) >= 10)
    year = F.concat(F.lit("WO/"), F.substring(number, 1, 4), F.lit("/"), F.substring(number, 5, 1000))
    return F.when(known, F.when(wo, year).otherwise(F.concat(country, F.lit("/"), number)))


def service_identifiers(reference: Column) -> Column:
    """Numbers under which a service may know a reference, in the order in which they are tried."""
    with_its_kind = F.concat(reference["display_number"], reference["kind_code"])
    tried = F.array(reference["normalized_number"], F.concat(F.lit("WO"), reference["doc_number"]), reference["display_number"], with_its_kind)
    return F.array_distinct(F.filter(tried, lambda x: F.coalesce(x, F.lit("")) != ""))


def same_patent(a: Column, b: Column, source: str | None = None) -> Column:
    """Whether two numbers, however written, are one patent; false where one isn't understood."""
    x, y = (normalized_number(v, source) for v in (a, b))
    return F.coalesce(x["error_code"].isNull() & y["error_code"].isNull() & (x["normalized_number"] == y["normalized_number"]), F.lit(False))

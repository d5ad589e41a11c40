"""Bibliographic answers in JSON as records: every branch is flattened to its leaves first.

A branch of an answer becomes a list of (path, scalar) in document order; a rule then selects by
the end of the path, however deep the service nests its objects. So a lone object and an array
of objects, plain text and text wrapped in `value` or `content`, need no rules of their own.

Defined results: payloads that are no JSON object give null fields and an error; empty members
count as missing; repeated names, codes and claims stand once, where they stand first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import normalized

# Members that hold the text of an entry, in the order in which they count.
TEXT_MEMBERS = ("value", "content", "p", "text")
# Groups of parties and of classifications with their items.
AGENTS = (("agents", "agent"), ("representatives", "representative"))
CLASSES = {"ipc": (("classifications-ipcr", "classification-ipcr"), ("classifications-ipc", "classification-ipc")), "cpc": (("classifications-cpc", "classification-cpc"),)}

Path = tuple[Any, ...]


def leaves(value: Any, path: Path = ()) -> Iterator[tuple[Path, Any]]:
    """(path, scalar) of all scalars but null, in document order; positions are numbers."""
    todo = [(path, value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            todo += [((*at, k), x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [((*at, k), x) for k, x in reversed(list(enumerate(v)))]
        elif v is not None:
            yield at, v


def _names(path: Path) -> tuple[str, ...]:
    return tuple(k for k in path if isinstance(k, str))


def _some(values: list) -> list:
    """Without empty ones and repeats, in order."""
    return list({repr(v): v for v in values if v}.values())


def _items(value: Any) -> list[Any]:
    return value if isinstance(value, list) else [] if value is None else [value]


def _get(value: Any, *keys: str) -> Any:
    for k in keys:
        value = value.get(k) if isinstance(value, dict) else None
    return value


def joined_text(value: Any) -> str:
    """Text of an entry: of its first text member that has any, parts joined by spaces."""
    if isinstance(value, dict):
        return next((t for k in TEXT_MEMBERS if (t := joined_text(value.get(k)))), "")
    if isinstance(value, list):
        return " ".join(t for x in value if (t := joined_text(x)))
    return value.strip() if isinstance(value, str) else ""


def entries(value: Any) -> list[tuple[str, str]]:
    """(language, text) of the entries with text."""
    pairs = [(str(x.get("lang") or "").upper(), joined_text(x)) for x in _items(value) if isinstance(x, dict)]
    return [p for p in pairs if p[1]]


def english_first(found: list[tuple[str, str]]) -> tuple[str, str]:
    return next((p for p in found if p[0] == "EN"), found[0] if found else ("", ""))


def reference(value: Any) -> dict[str, str]:
    """country, doc_number, kind, date, lang of a reference: of its first document id, else of
    itself."""
    one = next(iter(_items(_get(value, "document-id"))), None)
    one = one if isinstance(one, dict) else value if isinstance(value, dict) else {}
    said = lambda k: str(one.get(k) or "")
    return {"country": said("country"), "doc_number": said("doc-number"), "kind": said("kind"), "date": said("date"), "lang": said("lang").upper()}


def priorities(value: Any) -> list[dict[str, str]]:
    claims: dict[Path, dict[str, str]] = {}
    for path, v in leaves(value):
        if "priority-claim" in path[:-1]:
            end = len(path) - 1 - path[:-1][::-1].index("priority-claim")
            if len(path) == end + 1:
                claims.setdefault(path[:end], {})[path[-1]] = str(v)
    rows = [{k: c.get(m, "") for k, m in (("number", "doc-number"), ("date", "date"), ("country", "country"), ("kind", "kind"))} for c in claims.values()]
    return _some([r for r in rows if any(r.values())])


def states(value: Any) -> dict[str, list[str]]:
    found = list(leaves(value))
    regions = _some([str(v) for p, v in found if p[-2:] == ("region", "country")])
    named = [v for p, v in found if isinstance(v, str) and (p[-1:] == ("country",) or p[-2:-1] == ("countryAndProtectionRequest",))]
    kinds = [str(v) for p, v in found if p[-1:] == ("kind-of-protection",)]
    return {"regions": regions, "countries": [c for c in _some(named) if c not in regions], "protection_types": _some(kinds)}


def books(party: Any) -> list[dict[str, Any]]:
    """The address books of a party as flat fields; address is a field of fields. What a list
    under `content` splits up is put together again."""
    out = []
    for book in _items(_get(party, "addressbook") or _get(party, "address-book")):
        flat: dict[str, Any] = {"address": {}}
        for path, v in leaves(book):
            names = tuple(n for n in _names(path) if n not in ("content", "value"))
            if names[:1] == ("address",) and len(names) == 2:
                flat["address"][names[1]] = str(v)
            elif len(names) == 1 and v:
                flat[names[0]] = str(v)
        out.append(flat)
    return out


def _person(book: dict[str, Any]) -> str:
    return " ".join(book[k].strip() for k in ("first-name", "last-name") if book.get(k))


def party_names(parties: Any, group: str, item: str) -> list[str]:
    found = [b for p in _items(_get(parties, group, item)) for b in books(p)]
    return _some([" ".join((b.get("orgname") or b.get("name") or _person(b)).split()) for b in found])


def representatives(parties: Any) -> list[dict[str, str]]:
    out = []
    for group, item in AGENTS:
        for b in (b for p in _items(_get(parties, group, item)) for b in books(p)):
            address = " ".join(v for k, v in b["address"].items() if v and k != "country")
            one = {"name": b.get("name") or _person(b), "organization": b.get("orgname", ""), "address": address}
            out.append({**{k: " ".join(v.split()) for k, v in one.items()}, "country": b["address"].get("country", "")})
    return _some([r for r in out if any(r.values())])


def classes(biblio: Any, kind: str) -> list[str]:
    out = []
    for group, item in CLASSES[kind]:
        held = _get(biblio, group)
        item = next((i for _, i in CLASSES[kind] if isinstance(held, dict) and i in held), item)
        for one in _items(_get(held, item)):
            f = {_names(p)[0]: str(v) for p, v in leaves(one) if _names(p) and v}
            symbol = f"{f.get('section', '')}{f.get('class', '')}{f.get('subclass', '')} {f.get('main-group', '')}{'/' + f['subgroup'] if f.get('subgroup') else ''}"
            out.append(" ".join((f.get("text") or symbol).split()))
    return _some(out)


_REF = "struct<country:string,doc_number:string,kind:string,date:string,lang:string>"
RECORD = (
    f"publication {_REF}, application {_REF}, title string, title_language string, abstract string, abstract_language string, applicants array<string>, inventors array<string>, "
    "representatives array<struct<name:string,organization:string,address:string,country:string>>, ipc array<string>, cpc array<string>, first_priority_date string, "
    "priority_data array<struct<number:string,date:string,country:string,kind:string>>, regions array<string>, countries array<string>, protection_types array<string>, error string"
)


def record(payload: str | None) -> dict[str, Any]:
    try:
        whole = json.loads(payload or "")
    except ValueError:
        return {"error": "invalid_json"}
    if not isinstance(whole, dict):
        return {"error": "not_an_object"}
    inner = whole.get("wo-bibliographic-data")
    biblio = inner if isinstance(inner, dict) else whole
    title_language, title = english_first(entries(biblio.get("invention-title")))
    abstract_language, abstract = english_first(entries(whole.get("abstract")))
    parties = biblio.get("parties")
    first = next((str(v) for p, v in leaves(biblio) if p[-2:] == ("date-of-earliest-priority", "date")), "")
    return {
        "publication": reference(biblio.get("publication-reference")), "application": reference(biblio.get("application-reference")), "title": title, "title_language": title_language,
        "abstract": abstract, "abstract_language": abstract_language, "applicants": party_names(parties, "applicants", "applicant"), "inventors": party_names(parties, "inventors", "inventor"),
        "representatives": representatives(parties), "ipc": classes(biblio, "ipc"), "cpc": classes(biblio, "cpc"), "first_priority_date": first,
        "priority_data": priorities(biblio.get("wo-priority-info")), **states(biblio.get("designation-of-states")), "error": None,
    }


def reference_number(ref: Column) -> Column:
    """Full number of a reference (struct country, doc_number, kind): international application
    numbers begin with `PCT/`, a country that the number repeats stands once."""
    country, number, kind = (F.coalesce(ref[c], F.lit("")) for c in ("country", "doc_number", "kind"))
    own = F.upper(number).startswith(F.upper(country))
    return (
        F.when(F.upper(number).startswith("PCT/"), number)
        .when((country == "PCT") & (number != ""), F.concat(F.lit("PCT/"), number))
        .when((country != "") & (number != "") & ~own, F.concat(country, number, kind))
        .otherwise(F.concat(number, kind))
    )


def records(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """key, RECORD and publication_number, application_number of the JSON answers."""
    made = rows.select(F.col(key).alias("k"), F.col(payload).alias("payload"))
    schema = f"k {made.schema['k'].dataType.simpleString()}, {RECORD}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(RECORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [record(p) for p in batch.column("payload").to_pylist()]
            arrays = [pa.array([r.get(f.name) for r in found], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([batch.column("k"), *arrays], names=["k", *arrow.names])

    out = made.mapInArrow(run, schema).withColumnRenamed("k", key)
    text = {c: normalized(F.col(c)) for c in ("title", "abstract")}
    return out.withColumns(text).withColumn("publication_number", reference_number(F.col("publication"))).withColumn("application_number", reference_number(F.col("application")))


def listed_documents(payload: Column) -> Column:
    """Array of struct(document_id, document_code, min_spec_code, gazette_number) of a list of
    documents, those without id or code left out; members in any of their spellings."""
    v = F.try_parse_json(payload)
    held = F.coalesce(*(F.try_variant_get(v, f"$['{k}']", "variant") for k in ("availableDocuments", "available-documents")))
    kinds = [F.try_variant_get(held, "$", "array<variant>"), *(F.try_variant_get(held, f"$.{k}", "array<variant>") for k in ("document", "documents"))]

    def one(d: Column) -> Column:
        get = lambda *names: F.coalesce(*(F.nullif(F.try_variant_get(d, f"$['{n}']", "string"), F.lit("")) for n in names))
        return F.struct(
            get("docId", "document-id").alias("document_id"), get("docType", "document-code").alias("document_code"),
            F.coalesce(get("minSpecCode"), F.lit("")).alias("min_spec_code"), F.coalesce(get("gazetteNumber"), F.lit("")).alias("gazette_number"),
        )

    all_of = F.coalesce(*kinds, F.array().cast("array<variant>"))
    return F.filter(F.transform(all_of, one), lambda d: d["document_id"].isNotNull() & d["document_code"].isNotNull())


def listed_pages(payload: Column) -> Column:
    """Names of the pages of a document: `content` is one name or a list of them."""
    v = F.try_parse_json(payload)
    several = F.try_variant_get(v, "$.content", "array<string>")
    one = F.try_variant_get(v, "$.content", "string")
    return F.filter(F.coalesce(several, F.array(one)), lambda x: F.coalesce(x, F.lit("")) != "")


def publication_xml(pages: Column) -> Column:
    """The page that holds the publication's XML, empty if none does."""
    # Names in order of preference.
    wanted = ("wo-published-application.xml", "packagedata-pkda.xml")
    named = lambda name: F.get(F.filter(pages, lambda p: F.lower(p) == name), F.lit(0))
    return F.coalesce(*map(named, wanted), F.get(F.filter(pages, lambda p: F.lower(p).endswith(".xml")), F.lit(0)), F.lit(""))

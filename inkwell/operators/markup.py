"""Elements of XML payloads by local name at any depth, as rows.

One pass over the events of a payload finds every element of the wanted names, the root and
nested ones included, whatever its name space. Text comes in both ways of joining it: pieces
with a space between them, and run together as they stand.

Defined results: payloads that are no XML or declare entities give one row with an error; null
and empty payloads give none; elements without text have empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "nth int, parent int, name string, attributes map<string,string>, spaced string, solid string, error string"


def _refused(*_: object) -> None:
    raise ValueError("entities")


def elements(xml: str, names: set[str]) -> list[dict]:
    """nth, parent (nth of the nearest wanted element around it), name, attributes (by local
    name), spaced and solid text of the wanted elements in document order."""
    found: list[dict] = []
    path: list[dict | None] = []

    def start(name: str, attributes: dict[str, str]) -> None:
        local = name.rsplit(" ", 1)[-1]
        node = None
        if local in names:
            around = next((n for n in reversed(path) if n is not None), None)
            node = {"nth": len(found), "parent": around["nth"] if around else None, "name": local, "attributes": {k.rsplit(" ", 1)[-1]: v for k, v in attributes.items()}, "pieces": []}
            found.append(node)
        path.append(node)
        for n in filter(None, path):
            n["pieces"].append(None)  # text on both sides of a tag is two pieces

    def end(_: str) -> None:
        path.pop()
        for n in filter(None, path):
            n["pieces"].append(None)

    def text(data: str) -> None:
        for n in filter(None, path):
            n["pieces"].append(data)

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.EntityDeclHandler = start, end, text, _refused
    parser.Parse(xml, True)
    for n in found:
        pieces = n.pop("pieces")
        n["solid"] = " ".join("".join(p for p in pieces if p).split())
        n["spaced"] = " ".join(" ".join(" " if p is None else p for p in pieces).split())
    return found


def nodes(records: DataFrame, key: str, xml: str, names: list[str]) -> DataFrame:
    """key and NODE of the elements named in `names`."""
    rows = records.select(F.col(key).alias("k"), F.col(xml).alias("xml"))
    types = [pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.string()]
    wanted = set(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for at, payload in enumerate(batch.column("xml").to_pylist()):
                if not payload or not payload.strip():
                    continue
                try:
                    made = [(n["nth"], n["parent"], n["name"], list(n["attributes"].items()), n["spaced"], n["solid"], None) for n in elements(payload, wanted)]
                except (expat.ExpatError, ValueError) as e:
                    made = [(None, None, None, None, None, None, "entities" if isinstance(e, ValueError) and not isinstance(e, expat.ExpatError) else "invalid_xml")]
                out += made
                keys += [at] * len(made)
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(keys, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], names=["k", *(c.split()[0] for c in NODE.split(", "))])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, {NODE}").withColumnRenamed("k", key)


# Members of a document entry and the names they go by, in order.
ENTRY = {
    "document_id": ["document-id"], "document_code": ["document-code", "document-type", "type"], "content_type": ["mime-type", "content-type", "format"],
    "filename": ["file-name", "filename", "name"], "title": ["title", "description"],
}


def document_entries(records: DataFrame, key: str, xml: str, entry: str = "document") -> DataFrame:
    """key, pos and the members of ENTRY of the entries of a list of documents; of entries with
    the same id and code the last one counts, those without one of them are left out."""
    names = [n for values in ENTRY.values() for n in values]
    rows = nodes(records, key, xml, [entry, *names]).filter("error is null")
    heads = rows.filter(F.col("name") == entry).select(key, F.col("nth").alias("pos"), "attributes")
    first = lambda n: F.min(F.when((F.col("name") == n) & (F.col("spaced") != ""), F.struct("nth", "spaced")))["spaced"].alias(f"_{n}")
    members = rows.filter(F.col("name") != entry).groupBy(key, F.col("parent").alias("pos")).agg(*map(first, names))
    said = lambda n: F.col(f"_{n}")
    picked = heads.join(members, [key, "pos"], "left").select(
        key, "pos", *(F.coalesce(*map(said, values), *([F.col("attributes")[values[0]]] if k in ("document_id", "document_code") else []), F.lit("")).alias(k) for k, values in ENTRY.items())
    )
    good = picked.filter("document_id <> '' and document_code <> ''")
    last = good.groupBy(key, "document_id", "document_code").agg(F.max_by(F.struct("pos", "content_type", "filename", "title"), "pos").alias("r"))
    return last.select(key, "r.pos", "document_id", "document_code", "r.content_type", "r.filename", "r.title")


def page_ids(records: DataFrame, key: str, xml: str) -> DataFrame:
    """key, page_ids: distinct ids of the pages of a table of contents in order, by attribute or
    text."""
    rows = nodes(records, key, xml, ["page-id", "pageId", "page"]).filter("error is null")
    value = F.trim(F.coalesce(F.nullif(F.col("attributes")["id"], F.lit("")), F.nullif(F.col("attributes")["page-id"], F.lit("")), F.col("spaced")))
    rows = rows.withColumn("v", value).filter("v <> ''").groupBy(key, "v").agg(F.min("nth").alias("nth"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "v"))), lambda x: x["v"]).alias("page_ids"))


def binary_payload(text: Column) -> Column:
    """What a base64 text holds; null for mark-up, empty text and what is no base64."""
    tight = F.regexp_replace(text, r"\s+", "")
    fits = (tight != "") & ~tight.startswith("<") & (F.length(tight) % 4 == 0) & tight.rlike(r"^[A-Za-z0-9+/]*={0,2}$")
    return F.when(fits, F.unbase64(tight))


# What the text of a fault says where there simply is no result.
NO_RESULT = ["not found", "no result", "does not exist", "unknown"]


def fault_outcome(status: Column, fault: Column) -> Column:
    """Outcome of a failed call: by status, else by what its fault says."""
    low = F.lower(F.coalesce(fault, F.lit("")))
    nothing = F.lit(False)
    for words in NO_RESULT:
        nothing = nothing | low.contains(words)
    return F.when(status.isin(401, 403), "auth").when((status == 404) | nothing, "no_result").otherwise("unavailable")

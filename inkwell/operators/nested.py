"""Deeply nested records as related flat tables.

A record is read as a tree whose nodes are classified by a tree automaton: the state of a
node follows from the state of its parent, the edge that leads to it and its own shape
(string, object, array, null). `Rule`s are the transitions. Each step of `nodes` explodes
the children of one level, so the number of steps is the depth of the grammar and not of the
data, everything stays in one stage in the JVM (variant functions) and nothing is shuffled.

`nodes` gives the supertype table: the keys all variants share (record key, path, parent
path, position, state, shape) and the label, which each type reads from a column of its own.
`variants` routes it to the typed table of one state and shape, which keeps those keys and adds
the columns of its type; `routed` does that for all of them in one pass, to be written by state
and shape. `found` is the union of the typed tables on their common columns.

Shapes: an array counts by its elements; a lone value in place of an array is element 0; null
elements count as positions but give no row; text that holds a JSON object or array counts as
what it holds, at every level. Defined results: null, empty and invalid payloads give no
rows; duplicate records give their rows again under their own key; extra columns of the
input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A transition: from a node in state `parent` along `path` (dotted keys) to elements in
    state `state`. `label` is the key whose value names an element that is an object."""

    parent: str
    path: str
    state: str
    label: str


# The arrays of a lookup answer, with the key that labels their elements.
LOOKUP_ANSWER = [
    Rule("root", "priority_data", "priority", "number"),
    Rule("root", "designated_states.regions", "region", "country"),
    Rule("root", "designated_states.countries", "country", "country"),
    Rule("country", "protection_requests", "protection_request", "kind_of_protection"),
    Rule("root", "designated_states.protection_types", "protection_type", "kind_of_protection"),
    Rule("root", "raw_source_refs.ops_biblio.publication_reference.document_ids", "publication_id", "doc_number"),
    Rule("root", "raw_source_refs.ops_biblio.application_reference.document_ids", "application_id", "doc_number"),
    Rule("root", "raw_source_refs.ops_family.members", "family_member", "publication_no"),
    Rule("family_member", "document_ids", "member_id", "doc_number"),
    Rule("family_member", "legal_events", "legal_event", "code"),
    Rule("root", "raw_source_refs.available_documents", "available_document", "document_id"),
    Rule("available_document", "pages", "page", "image"),
]

# Columns of the typed tables beside the common ones.
TYPED_COLUMNS = {
    "priority": ["number", "country", "date", "kind"],
    "region": ["country"],
    "protection_type": ["kind_of_protection"],
    "country": ["country"],
    "protection_request": ["kind_of_protection"],
    "publication_id": ["document_id_type", "doc_number", "country", "kind", "date"],
    "application_id": ["document_id_type", "doc_number", "country", "kind", "date"],
    "family_member": ["publication_no"],
    "member_id": ["document_id_type", "doc_number", "country", "kind", "date"],
    "legal_event": ["code", "date"],
    "available_document": ["document_id", "document_code"],
    "page": ["image"],
}


def _shape(v: Column) -> Column:
    """First letter of the type: O object, A array, S string, else scalar or null."""
    return F.substring(F.schema_of_variant(v), 1, 1)


def _opened(v: Column) -> Column:
    """The variant itself, or what its text holds if that is a JSON object or array."""
    text = F.try_variant_get(v, "$", "string")
    holds = (_shape(v) == "S") & text.rlike(r"^\s*[\[{]")
    return F.when(holds, F.coalesce(F.try_parse_json(text), v)).otherwise(v)


def _elements(v: Column) -> Column:
    """Array of the elements: of an array, or of a lone value; null stays null."""
    return F.when(F.is_variant_null(v), None).when(_shape(v) == "A", v.cast("array<variant>")).otherwise(F.array(v))


def _descend(rows: DataFrame, node: str, rules: list[Rule]) -> tuple[DataFrame, dict[str, str]]:
    """Adds a column with the opened value at each path of the rules; gives their names. One
    projection for getting and one for opening a level of keys: an expression that is used
    several times is then computed once."""
    names = {"": node}
    paths = sorted({".".join(r.path.split(".")[: i + 1]) for r in rules for i in range(r.path.count(".") + 1)})
    for depth in range(1 + max(p.count(".") for p in paths)):
        here = [p for p in paths if p.count(".") == depth]
        for p in here:
            names[p] = f"v_{node}_{p.replace('.', '__')}"
        get = {}
        for p in here:
            above, _, key = p.rpartition(".")
            v = F.col(names[above])
            get[names[p]] = F.when(_shape(v) == "O", F.try_variant_get(v, f"$['{key}']", "variant"))
        rows = rows.withColumns(get)
        rows = rows.withColumns({c: _opened(F.col(c)) for c in get})
    return rows, names


ELEMENT = "array<struct<path:string,parent_path:string,pos:int,state:string,label_key:string,node:variant>>"


def _items(value: Column, path: Column | None, rule: Rule) -> Column:
    """Array of struct(path, parent_path, pos, state, label_key, node) of a rule's elements."""
    prefix = F.lit(rule.path) if path is None else F.concat(path, F.lit(f".{rule.path}"))
    parent = F.lit(None).cast("string") if path is None else path

    def item(x: Column, i: Column) -> Column:
        return F.struct(
            F.concat(prefix, F.lit("["), i.cast("string"), F.lit("]")).alias("path"),
            parent.alias("parent_path"),
            i.cast("int").alias("pos"),
            F.lit(rule.state).alias("state"),
            F.lit(rule.label).alias("label_key"),
            x.alias("node"),
        )

    return F.coalesce(F.transform(_elements(value), item), F.array().cast(ELEMENT))


def nodes(records: DataFrame, key: str, payload: str, rules: list[Rule] | None = None) -> DataFrame:
    """All elements of the grammar's arrays: key, path, parent_path, pos, state, shape
    (`text` or `object`), label, node (variant)."""
    rules = LOOKUP_ANSWER if rules is None else rules
    rows = records.select(F.col(key).alias("record_key"), F.try_parse_json(F.col(payload)).alias("root"))
    rows = rows.filter(F.col("root").isNotNull()).withColumn("root", _opened(F.col("root")))
    reached = [r for r in rules if r.parent == "root"]
    rows, at = _descend(rows, "root", reached)
    out = rows.select("record_key", F.explode(F.concat(*(_items(F.col(at[r.path]), None, r) for r in reached))).alias("e"))
    done: set[str] = set()
    while True:
        out = out.select("record_key", "e.*").filter(F.col("node").isNotNull() & ~F.is_variant_null("node"))
        out = out.withColumn("node", _opened(F.col("node")))
        done |= {r.state for r in reached}
        below = [r for r in rules if r.parent in {x.state for x in reached}]
        if any(r.state in done for r in below):
            raise ValueError("the grammar must not be recursive")
        if not below:
            break
        # Own row and those of the children in one explode: no second pass over the input.
        out, at = _descend(out, "node", below)
        own = F.array(F.struct("path", "parent_path", "pos", "state", "label_key", "node")).cast(ELEMENT)
        kids = [F.when(F.col("state") == r.parent, _items(F.col(at[r.path]), F.col("path"), r)).otherwise(F.array().cast(ELEMENT)) for r in below]
        out = out.select("record_key", F.explode(F.concat(own, *kids)).alias("e"))
        reached = below
    shape = F.when(_shape(F.col("node")) == "O", "object").otherwise("text")
    # Routed by state: each type names its elements by a column of its own.
    keys: dict[str, list[str]] = {}
    for r in rules:
        keys.setdefault(r.label, []).append(r.state)
    label = F.when(shape == "text", F.try_variant_get("node", "$", "string"))
    for name, states in keys.items():
        label = label.when(F.col("state").isin(*states), F.try_variant_get("node", f"$['{name}']", "string"))
    return out.select("record_key", "path", "parent_path", "pos", "state", shape.alias("shape"), label.alias("label"), "node")


def _own(state: str) -> list[Column]:
    return [F.try_variant_get("node", f"$.{c}", "string").alias(f"{c}_value") for c in TYPED_COLUMNS.get(state, [])]


def variants(table: DataFrame, state: str, shape: str = "object") -> DataFrame:
    """The typed table of one state and shape: common keys and parent link, then the type's
    own columns (null where an element lacks the member)."""
    rows = table.filter((F.col("state") == state) & (F.col("shape") == shape))
    common = ["record_key", "path", "parent_path", "pos", "label"]
    return rows.select(*common, *([] if shape == "text" else _own(state)))


def routed(table: DataFrame) -> DataFrame:
    """All typed tables in one pass: the common keys, state, shape and one struct column for
    each state with the type's own columns, null for elements of another type. Written with
    `partitionBy("state", "shape")` each typed table is a folder of its own."""
    common = ["record_key", "path", "parent_path", "pos", "state", "shape", "label"]
    types = [F.when((F.col("state") == s) & (F.col("shape") == "object"), F.struct(*_own(s))).alias(s) for s in TYPED_COLUMNS]
    return table.select(*common, *types)


def found(records: DataFrame) -> DataFrame:
    """Rows (raw_id, path, label) of the elements of all types; distinct as raw_id is unique, so
    without a shuffle."""
    return nodes(records, "raw_id", "payload").select(F.col("record_key").alias("raw_id"), "path", "label")

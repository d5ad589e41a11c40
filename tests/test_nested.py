from __future__ import annotations

import json

import pytest

from inkwell.operators import nested


def rows(spark, *payloads):
    df = spark.createDataFrame([(i, p, "x", "y") for i, p in enumerate(payloads)], "raw_id bigint, payload string, path string, node string")
    return {tuple(r) for r in nested.found(df).collect()}


def test_shapes(spark):
    payload = {
        "priority_data": [{"number": "A"}, None, {"number": "B", "country": "DK"}],
        "designated_states": {"regions": "EP", "countries": ["DE", {"country": "FR", "protection_requests": {"kind_of_protection": "PAT"}}, {"country": "ES", "protection_requests": [None, {"kind_of_protection": "UTM"}]}], "protection_types": None},
        "raw_source_refs": json.dumps({"ops_family": {"members": {"publication_no": "P1", "document_ids": [{"doc_number": "D"}], "legal_events": []}}, "available_documents": [{"document_id": "x", "pages": [{"image": "1.tif"}]}]}),
    }
    assert rows(spark, json.dumps(payload)) == {
        (0, "priority_data[0]", "A"), (0, "priority_data[2]", "B"), (0, "designated_states.regions[0]", "EP"),
        (0, "designated_states.countries[0]", "DE"), (0, "designated_states.countries[1]", "FR"), (0, "designated_states.countries[2]", "ES"),
        (0, "designated_states.countries[1].protection_requests[0]", "PAT"), (0, "designated_states.countries[2].protection_requests[1]", "UTM"),
        (0, "raw_source_refs.ops_family.members[0]", "P1"), (0, "raw_source_refs.ops_family.members[0].document_ids[0]", "D"),
        (0, "raw_source_refs.available_documents[0]", "x"), (0, "raw_source_refs.available_documents[0].pages[0]", "1.tif"),
    }


def test_nothing_to_read(spark):
    assert rows(spark, None, "", "not json", '{"priority_data": [{"number": "A"}', "[]", "null", "3", '{"priority_data": 5}') == {(7, "priority_data[0]", "5")}
    df = spark.createDataFrame([], "raw_id bigint, payload string")
    assert nested.found(df).count() == 0


def test_typed_tables_keep_their_parents(spark):
    df = spark.createDataFrame([(1, '{"raw_source_refs": {"ops_family": {"members": [{"publication_no": "P", "legal_events": [{"code": "AK", "date": "20200101"}]}]}}}')], "raw_id bigint, payload string")
    table = nested.nodes(df, "raw_id", "payload")
    event = nested.variants(table, "legal_event").first()
    assert (event.parent_path, event.pos, event.label, event.date_value) == ("raw_source_refs.ops_family.members[0]", 0, "AK", "20200101")
    assert nested.variants(table, "family_member").first().path == event.parent_path


def test_the_typed_tables_are_all_elements(spark):
    payload = {
        "priority_data": [{"number": "A"}, "B"], "designated_states": {"regions": ["EP", {"country": "OA"}], "countries": {"country": "FR", "protection_requests": ["PAT"]}, "protection_types": [{"kind_of_protection": "U"}]},
        "raw_source_refs": {"ops_biblio": {"publication_reference": {"document_ids": [{"doc_number": "1", "date": "20200101"}]}}, "available_documents": "x"},
    }
    df = spark.createDataFrame([(4, json.dumps(payload))], "raw_id bigint, payload string")
    table = nested.nodes(df, "raw_id", "payload")
    union = {(r.record_key, r.path, r.label) for state in nested.TYPED_COLUMNS for shape in ("object", "text") for r in nested.variants(table, state, shape).collect()}
    assert union == {tuple(r) for r in nested.found(df).collect()} and len(union) == 9
    routed = {r.path: r for r in nested.routed(table).collect()}
    assert routed["designated_states.regions[1]"].region.country_value == "OA" and routed["designated_states.regions[0]"].region is None
    assert routed["priority_data[0]"].priority.number_value == "A" and routed["priority_data[0]"].country is None


def test_recursive_grammar_is_refused(spark):
    df = spark.createDataFrame([(1, "{}")], "raw_id bigint, payload string")
    with pytest.raises(ValueError, match="recursive"):
        nested.nodes(df, "raw_id", "payload", [nested.Rule("root", "a", "a", "x"), nested.Rule("a", "a", "a", "x")])


def test_long_arrays_and_repeats(spark):
    payload = json.dumps({"priority_data": [{"number": str(i)} for i in range(3000)]})
    df = spark.createDataFrame([(1, payload), (2, payload)], "raw_id bigint, payload string")
    assert nested.found(df).count() == 6000

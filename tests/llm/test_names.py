from __future__ import annotations

import pytest

from inkwell.llm import names

PEOPLE = {
    "robert": ["Robert Pulotes", "Pulotes, Robert", "PULOTES Robert", "Dr. R. Pulotes", "Bob Pulotes", "Robert K. Pulotes et al.", "Robert Plotes", "Robetr Pulotes", "Rоbert Pulotes (deceased)"],
    "ingrid": ["Ingrid Pulotes", "Pulotes,I.", "Ingrid PULOTES, Ph.D."],
    "anamaria": ["Ana-Maria Kökund", "A.-M. Koekund", "Anamaria Kokund"],
}
FIRMS = {
    "optics": ["Zenasor Optics, Inc.", "The Zenasor Opt. Incorporated", "Optics, Zenasor", "ZENASOR-OPTICS INC", "Zenasor Optcis"],
    "systems": ["Zenasor Systems GmbH", "Zenasor Sys. G.m.b.H."],
    "univ": ["University of Rivijalz", "Rivijalz Univ.", "Rivijalz University"],
    "law": ["Kromutis & Nejojon LLP", "Patentanwälte Kromutis und Nejojon", "Kromutis/Nejojn"],
    "law2": ["Nejojon & Trufekrum LLP", "Nejojon, Trufekrum L.L.P."],
}


def mentions(spark, *groups):
    rows, truth, i = [], {}, 0
    for field, group in groups:
        for entity, spellings in group.items():
            for s in spellings:
                # A spelling that is no error stands more than once, as in real data.
                for _ in range(4 if s == spellings[0] else 1):
                    i += 1
                    rows.append((i, field, s, "x", "y"))
                    truth[i] = entity
    return spark.createDataFrame(rows, "mention_id bigint, field string, name string, entity string, tokens string"), truth


@pytest.mark.parametrize("field", ["inventors", "applicants"])
def test_persons(spark, field):
    df, truth = mentions(spark, (field, PEOPLE))
    got = {tuple(r) for r in names.found(df).collect()}
    assert got == {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}


def test_organisations(spark):
    df, truth = mentions(spark, ("applicants", {k: FIRMS[k] for k in ("optics", "systems", "univ")}), ("representative_organization", {k: FIRMS[k] for k in ("law", "law2")}))
    got = {tuple(r) for r in names.found(df).collect()}
    assert got == {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}


def test_odd_values(spark):
    rows = [(1, "inventors", None), (2, "inventors", ""), (3, "inventors", "  "), (4, "inventors", "X"), (5, "applicants", "X"), (6, "inventors", "..."), (7, "inventors", "Dr."), (8, "inventors", "a " * 4000), (9, None, "Ingrid Moll"), (10, "inventors", "Ingrid Moll")]
    df = spark.createDataFrame(rows, "mention_id bigint, field string, name string")
    got = {tuple(r) for r in names.found(df).collect()}
    assert (4, 5) in got and (9, 10) in got
    assert not any({1, 2, 3} & set(p) for p in got)
    assert names.found(df.limit(0)).count() == 0


def test_alignment_is_optimal():
    few = {"robert": 9, "pulotes": 9, "plotes": 1}
    assert names.aligned(["robert", "pulotes"], ["plotes", "r."], few)
    assert not names.aligned(["robert", "pulotes"], ["ingrid", "pulotes"], few)
    assert not names.aligned(["robert", "pulotes"], ["robert", "plotes"], {**few, "plotes": 9})
    assert not names.aligned(["r.", "k."], ["r.", "k."], few)


def test_persons_against_brute_force(spark):
    """Every pair that the direct alignment of two spellings finds is in one entity, for
    people whose given names differ in their first letter."""
    import random

    rng = random.Random(1)
    surnames = ["Grabitok", "Sovurlent", "Mikrandulz", "Dabehost"]
    given = ["Ingrid", "Mehmet", "Robert", "Veronica"]
    rows, truth, i = [], {}, 0
    for s in surnames:
        for g in given:
            for form in [f"{g} {s}"] * 3 + [f"{s}, {g}", f"{g[0]}. {s}", f"{s.upper()} {g}"]:
                if rng.random() < 0.2:
                    k = rng.randrange(1, len(s) - 1)
                    form = form.replace(s, s[:k] + s[k + 1 :])
                i += 1
                rows.append((i, "inventors", form))
                truth[i] = (s, g)
    got = {tuple(r) for r in names.found(spark.createDataFrame(rows, "mention_id bigint, field string, name string")).collect()}
    expected = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    assert len(got & expected) / len(expected) > 0.97
    assert len(got & expected) / len(got) > 0.99


def test_initials_of_a_frequent_surname(spark):
    """A surname far more frequent than the given names is still met by the initial form."""
    rare = [("Emil", "E."), ("Otto", "O."), ("Walter", "W.")]
    others = ["Ingrid", "Mehmet", "Robert", "Veronica", "Katharina", "Francisco"]
    rows = [f"{g} Hotname" for g in others for _ in range(20)] + [f"{g} Hotname" for g, _ in rare] + [f"{i} Hotname" for _, i in rare]
    df = spark.createDataFrame([(k, "inventors", n) for k, n in enumerate(rows)], "mention_id bigint, field string, name string")
    entity = {r.name: r.entity for r in names.entities(df).collect()}
    for g, i in rare:
        assert entity[f"{g} Hotname"] == entity[f"{i} Hotname"]
    assert len(set(entity.values())) == len(others) + len(rare)


def test_repeated_typing_errors(spark):
    """An error that stands more than twice, and one in many copies, keep their links; two
    surnames that both stand in many ways stay two."""
    forms = ["{g} {s}", "{s}, {g}", "{S} {g}", "Dr. {g} {s}", "{g} {s} et al.", "Mr {g} {s}"]
    written = lambda g, s, n: [f.format(g=g, s=s, S=s.upper()) for f in forms for _ in range(n)]
    rows = written("Robert", "Grabitok", 2) + ["Robert Grabtok"] * 4
    rows += written("Ingrid", "Sovurlent", 4) + ["Ingrid Sovurlnt"] * 25
    rows += written("Mehmet", "Dabehost", 3) + written("Mehmet", "Dabehust", 3)
    df = spark.createDataFrame([(k, "inventors", n) for k, n in enumerate(rows)], "mention_id bigint, field string, name string")
    entity = {r.name: r.entity for r in names.entities(df).collect()}
    assert entity["Robert Grabitok"] == entity["Robert Grabtok"]
    assert entity["Ingrid Sovurlent"] == entity["Ingrid Sovurlnt"]
    assert entity["Mehmet Dabehost"] != entity["Mehmet Dabehust"]


def test_long_names_are_aligned():
    long = ["maria", "teresa", "dolores", "carmen", "pilar", "grabitok", "sovurlent"]
    counts = {**dict.fromkeys(long, 9), "sovurlnt": 1}
    assert names.aligned(long, long[:-1] + ["sovurlnt"], counts)
    assert names.aligned(long, ["sovurlent", "m."] + long[1:-1], counts)
    assert names.aligned(long, [*long, "k."], counts)
    assert not names.aligned(long, long[:-1], counts)
    assert not names.aligned(long, long[:-1] + ["dabehost"], counts)


def test_assignment_is_that_of_all_permutations():
    import random
    from itertools import permutations

    def brute(short, long, counts, forms):
        for exact in (False, True):
            for chosen in permutations(range(len(long)), len(short)):
                pairs = [(s, long[k]) for s, k in zip(short, chosen)]
                costs = [names._match(s, t, counts, forms if exact else None) for s, t in pairs]
                left = [t for k, t in enumerate(long) if k not in chosen]
                met = any(not s.endswith(".") and not t.endswith(".") and (not exact or s == t) for s, t in pairs)
                if met and None not in costs and sum(costs) <= 2 and all(t.endswith(".") for t in left):
                    return True
        return False

    rng, words = random.Random(3), ["robert", "robrt", "r.", "rita", "pulotes", "plotes", "p.", "k."]
    for _ in range(400):
        a, b = ([rng.choice(words) for _ in range(rng.randrange(1, 5))] for _ in range(2))
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        counts, forms = ({w: rng.choice([1, 3, 9, 30]) for w in words} for _ in range(2))
        assert names.aligned(a, b, counts, forms) == brute(short, long, counts, forms)


def test_typing_errors_are_told_alike_at_every_size():
    for size in (1, 10, 1000, 100_000):
        assert names.misspelt(size, 10 * size)
    assert names.misspelt(1, 1) and names.misspelt(21, 400) and names.misspelt(20, 200)
    assert not names.misspelt(9, 9) and not names.misspelt(3000, 9000) and not names.misspelt(40, 60)


def test_frequent_errors_and_long_firms(spark):
    """Errors that stand fifty times, and organisations of eight tokens with one error."""
    rows = ["Peter Walder"] * 300 + ["Peter Walter"] * 30 + ["Maria Brandt"] * 400 + ["Maria Brandl"] * 50
    long = "Zenasor Kromutis Nejojon Trufekrum Rivijalz Pulotes Grabitok Sovurlent"
    rows += [long] * 3 + [long.replace("Pulotes", "Plotes")]
    df = spark.createDataFrame([(k, "applicants", n) for k, n in enumerate(rows)], "mention_id bigint, field string, name string")
    entity = {r.name: r.entity for r in names.entities(df).collect()}
    assert entity["Peter Walder"] == entity["Peter Walter"] and entity["Maria Brandt"] == entity["Maria Brandl"]
    assert entity[long] == entity[long.replace("Pulotes", "Plotes")]
    assert len(set(entity.values())) == 3


def test_names_of_one_token(spark):
    """An organisation of one word is linked to its typing errors, a lone surname is not."""
    rows = [("representative_organization", n) for n in ["Siemozens AG"] * 5 + ["Siemozns GmbH", "Kromutis Siemozens"]] + [("inventors", n) for n in ["Grabitok"] * 5 + ["Grabtok"]]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "mention_id bigint, field string, name string")
    entity = {r.name: r.entity for r in names.entities(df).collect()}
    assert entity["Siemozens AG"] == entity["Siemozns GmbH"] != entity["Kromutis Siemozens"]
    assert entity["Grabitok"] != entity["Grabtok"]


def test_entities_of_mentions(spark):
    rows = [(5, "inventors", "Ingrid Pulotes"), (3, "applicants", "Pulotes, Ingrid"), (9, "inventors", "Robert Pulotes"), (4, "inventors", None), (1, "inventors", "")]
    df = spark.createDataFrame(rows, "mention_id bigint, field string, name string")
    assert {tuple(r) for r in names.linked(df).collect()} == {(5, 3, 2), (3, 3, 2), (9, 9, 1)}
    assert {tuple(r) for r in names.probed(df, 3).collect()} == {(3, 5)}

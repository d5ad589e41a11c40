from __future__ import annotations

import pytest

from inkwell.llm import pii

CASES = [
    ("mail", "Write to j.doe+x@example.org.", [("email", "j.doe+x@example.org")]),
    ("at", "mail: u.k-ip [at] firm [dot] example, or", [("email", "u.k-ip [at] firm [dot] example")]),
    ("format", "The data format was header@14:offset 11322, sampled.", []),
    ("phones", "Tel. +44 (0)20 7946 0111; office (410) 555-0168, 089/99998-114, 01.99.00.66.42.", [("phone", "+44 (0)20 7946 0111"), ("phone", "(410) 555-0168"), ("phone", "089/99998-114"), ("phone", "01.99.00.66.42")]),
    ("bracket", "angerufen (030 23125 175).", [("phone", "030 23125 175")]),
    ("numbers", "norm 37-79234-1, lot 4 555 052023, WO 2018/734782 A1, FR 3 070 29533, 12.04.2017, receipt 2019-57796", []),
    ("ident", "Passport 1 56 12 99 376 687 54 was; identity no. TJ271114A) signed; Steuer-ID 66788473-N, erreichbar", [("ident", "1 56 12 99 376 687 54"), ("ident", "TJ271114A"), ("ident", "66788473-N")]),
    ("street", "lives at 210 N Gristis Street, Faselz Falls 24158. Then", [("address", "210 N Gristis Street, Faselz Falls 24158")]),
    ("german", "Anschrift Stipen-Allee 171\n29429 Totaxstadt Les essais", [("address", "Stipen-Allee 171\n29429 Totaxstadt")]),
    ("french", "demeure 24B rue Stihol, 91232 Padis-sur-Lave, France", [("address", "24B rue Stihol, 91232 Padis-sur-Lave")]),
    ("spanish", "reside en Calle Habrart 79, 96007 Vazolz del Río.", [("address", "Calle Habrart 79, 96007 Vazolz del Río")]),
    ("names", "Wie Frau Vegrir, Henrietta und Herrn Q. Sistolz schrieb Jean-Luc K. Kihelz-Moor.", [("name", "Vegrir, Henrietta"), ("name", "Q. Sistolz"), ("name", "Jean-Luc K. Kihelz-Moor")]),
    ("don", "presentado por D. L. Kejalz.", [("name", "L. Kejalz")]),
    ("iban", "IBAN DE89370400440532013000; IBAN: GB29 NWBK 6016 1331 9268 19 here", [("ident", "DE89370400440532013000"), ("ident", "GB29 NWBK 6016 1331 9268 19")]),
    ("account", "paid to DE89370400440532013000, not DE89370400440532013001; account number is 12345678", [("ident", "DE89370400440532013000"), ("ident", "12345678")]),
    ("login", "see http://user:secret@host.example/a", [("ident", "user:secret")]),
    ("words", "5 rue de la Paix, 75002 Paris; 1600 Pennsylvania Avenue, Washington 20500; 12-14 Park Hill Road, Leeds LS1 4DY", [("address", "5 rue de la Paix, 75002 Paris"), ("address", "1600 Pennsylvania Avenue, Washington 20500"), ("address", "12-14 Park Hill Road, Leeds LS1 4DY")]),
    ("unlisted", "Dr. Kwame Nkrumah came, inventor Xiaoming Wang too, and Priyanka Chopra (p.chopra@firm.example).", [("name", "Kwame Nkrumah"), ("name", "Xiaoming Wang"), ("name", "Priyanka Chopra"), ("email", "p.chopra@firm.example")]),
    ("firms", "contact Kromutis Nejojon LLP, inventor Dinus Manufacturing", []),
    ("company", "filed by Dinus Manufacturing B.V. and Krubex Chemicals Corp.", []),
    ("letter", "Yours sincerely,\nDrofit, Emil\nDrefikallee 218B, 37053 Rudendburg\n", [("name", "Drofit, Emil"), ("address", "Drefikallee 218B, 37053 Rudendburg")]),
]


@pytest.mark.parametrize(("name", "text", "expected"), CASES)
def test_pieces(name, text, expected):
    assert [(k, text[a:b]) for k, a, b in pii.pieces(text)] == expected


def test_masking(spark):
    rows = [(1, "Mail a.b@c.org, Robert Moll.", "x"), (2, None, "y"), (3, "", "z"), (4, "ä" * 30_000 + " a.b@c.org", "w"), (5, "İstanbul a.b@c.org", "v")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, masked string")
    got = {r.doc_id: r.masked for r in pii.with_masked(df, "text", "masked").collect()}
    assert got == {1: "Mail [EMAIL], [NAME].", 2: None, 3: "", 4: "ä" * 30_000 + " [EMAIL]", 5: "İstanbul [EMAIL]"}
    found = {tuple(r) for r in pii.found(df).collect()}
    assert (4, "email", 30_001, 30_010) in found and len(found) == 4
    assert pii.found(df.limit(0)).count() == 0


def test_pieces_never_overlap():
    text = " ".join(t for _, t, _ in CASES)
    spans = [(a, b) for _, a, b in pii.pieces(text)]
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


@pytest.mark.parametrize("street", ["12 chemin Stihol", "12 quai Stihol", "12, impasse Stihol", "12 route Stihol", "12 cours Stihol", "12 allée Stihol", "Camino Habrart 79", "Via Habrart 79", "Viale Habrart, 79", "Rua Habrart 79", "Praça Habrart 79", "Stipenring 17", "Stipendamm 17", "Stipen-Ufer 17", "Stipenweg, 17"])
def test_every_street_type_is_an_anchor(street):
    assert pii.pieces(f"lives at {street}, 29429 Totax.") == [("address", 9, 9 + len(f"{street}, 29429 Totax"))]


@pytest.mark.parametrize("n", [10, 100, 200, 5000])
def test_no_window_cuts_a_piece(n):
    mail = "a" * n + ".b@" + "c" * min(n, 60) + ".example.com"
    assert [(k, a, b) for k, a, b in pii.pieces(f"to {mail} now")] == [("email", 3, 3 + len(mail))]
    street = f"12 {'L' + 'o' * n} Street, {'T' + 'o' * n} 29429"
    assert [(k, a, b) for k, a, b in pii.pieces(f"lives at {street}.")] == [("address", 9, 9 + len(street))]
    name = f"Robert {'M' + 'o' * n}"
    assert [(k, a, b) for k, a, b in pii.pieces(f"by {name}, too")] == [("name", 3, 3 + len(name))]


def test_long_runs_end_in_time():
    import time

    began = time.perf_counter()
    for text in ("1 2 3 " * 20_000, "a." * 50_000 + "@", "@" * 50_000, "Robert " * 20_000, "12 St. " * 20_000, "+1 " * 30_000):
        pii.pieces(text)
    assert time.perf_counter() - began < 60

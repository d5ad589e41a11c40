"""Postal addresses that denote the same building.

A self-built gazetteer: every address is parsed by local rules; postcodes and towns that stand
together make localities, town spellings are clustered by their postcode, street spellings are
clustered within a locality, and every cluster of streets gets an identifier. Each address is
then resolved by a beam search over the gazetteer: the hypotheses of its locality (postcode,
town, town with a typing error) are kept by score up to `BEAM`, then those of its street
within each. Records are the same building if street identifier and number agree; unit and
other remarks are kept but don't matter.

Typing errors are found by symmetric deletion: two words within one edit share a form with at
most one letter left out, so candidates meet by equi-joins and no pairs are compared blindly.
Everything between parsing and the last join runs on the distinct forms of addresses, house
number and remarks left out, so a building or street that a third of all rows name is one row.

Street names may have any number of words and house numbers any number of digits, ranges and
letters. Where nothing sets the street off from the town, each place to part them is a reading,
and the gazetteer decides. A locality belongs to a country: equal postcodes and towns of two
countries are two places; a missing country is taken from the postcode's form, else from the
localities of the gazetteer with that postcode and town.

Defined results: null and empty addresses and addresses without street and number are linked
to none, but equal writings that hold a number besides remarks and postcode are linked even if
they can't be read; repeated rows are linked to each other; extra columns of the input are
ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import cut

BEAM = 8

# Countries and the ways they are written (folded).
COUNTRIES = {
    "AT": "at|a|aut|austria|osterreich|oesterreich|autriche",
    "BE": "be|b|bel|belgium|belgique|belgien|belgie",
    "CA": "ca|can|canada|kanada",
    "CH": "ch|che|switzerland|schweiz|suisse|svizzera",
    "DE": "de|d|deu|ger|germany|deutschland|allemagne|alemania",
    "ES": "es|e|esp|spain|espana|spanien|espagne",
    "FR": "fr|f|fra|france|frankreich|francia",
    "GB": "gb|uk|gbr|united kingdom|great britain|england|grossbritannien|vereinigtes konigreich",
    "US": "us|usa|u s a|u s|united states of america|united states|vereinigte staaten",
    "IT": "it|i|ita|italy|italia|italien",
    "NL": "nl|nld|netherlands|niederlande|nederland",
    "LU": "lu|lux|luxembourg|luxemburg",
    "LI": "li|lie|liechtenstein",
    "DK": "dk|dnk|denmark|danmark|danemark",
    "SE": "se|swe|sweden|sverige|schweden|suede",
    "NO": "no|nor|norway|norge|norwegen|norvege",
    "FI": "fi|fin|finland|suomi|finnland|finlande",
    "PL": "pl|pol|poland|polska|polen|pologne",
    "CZ": "cz|cze|czechia|czech republic|tschechien",
    "PT": "pt|prt|portugal",
    "IE": "ie|irl|ireland|irland|irlande",
    "JP": "jp|jpn|japan|japon",
    "CN": "cn|chn|china|chine",
    "KR": "kr|kor|korea|republic of korea|south korea",
    "IN": "ind|india|indien|inde",
    "AU": "au|aus|australia|australien|australie",
}
# Street types and their short forms (folded); before the name, after it, or as
# the end of a compound.
BEFORE = {
    "rue": "rue r", "avenue": "avenue ave av", "boulevard": "boulevard boul blvd bd", "calle": "calle c", "avenida": "avenida avda",
    "plaza": "plaza pza pl", "place": "place", "chemin": "chemin ch", "quai": "quai", "route": "route rte", "paseo": "paseo", "via": "via", "viale": "viale",
    "piazza": "piazza", "allee": "allee",
}
AFTER = {
    "street": "street st", "avenue": "avenue ave av", "boulevard": "boulevard blvd boul bd", "drive": "drive dr", "lane": "lane ln la",
    "road": "road rd", "gardens": "gardens gdns", "court": "court ct", "square": "square sq", "terrace": "terrace ter", "close": "close",
    "crescent": "crescent cres", "way": "way", "parkway": "parkway pkwy", "strasse": "strasse str", "weg": "weg wg", "allee": "allee", "platz": "platz pl",
    "gasse": "gasse", "ring": "ring", "damm": "damm", "ufer": "ufer",
}
COMPOUND = {"strasse": "strasse str", "weg": "weg wg", "allee": "allee", "platz": "platz pl", "gasse": "gasse", "damm": "damm", "ufer": "ufer"}
SIDES = {"n": "north", "s": "south", "e": "east", "w": "west", "north": "north", "south": "south", "east": "east", "west": "west"}
# States that stand before a postcode.
STATES = set("AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split())


def _table(values: dict[str, str]) -> dict[str, str]:
    return {w: k for k, words in values.items() for w in words.split()}


_BEFORE, _AFTER, _COMPOUND = _table(BEFORE), _table(AFTER), _table(COMPOUND)
_COUNTRY = {w: k for k, words in COUNTRIES.items() for w in words.split("|")}

# Remarks that name no building.
REMARKS = re.compile(
    r"(?:c\s?/\s?o|p\.?\s?a\.?r\.?|attn\.?|z\.\s?hd\.?)\s+(?:mail\s+room|[^,;\n]+?(?=[,;\n]|\s-\s|$))"
    r"|\b(?:p\.?\s?o\.?\s?box|postfach|bo[iî]te\s+postale|b\.?p\.?|apartado)\s*(?:no\.?|nr\.?|#)?\s*\d+"
    r"|\b(?:suite|ste\.?|unit|room|apt\.?|apartment|bureau|b[üu]ro|zimmer|oficina|local)\s*#?\s*\d+[a-z]?\b"
    r"|\b\d+\s*(?:st|nd|rd|th)\s+(?:floor|fl\.?)|\b(?:floor|fl\.|level|etage|étage|piso|stock)\s*\d+|\b\d+\.?\s*(?:og|ug|etage|stock|étage|piso|eg)\b\.?|\b\d+(?:er|e|ème)\s+étage"
    r"|\b(?:geb[äa]ude|building|bldg\.?|b[âa]timent|bât\.?|edificio|haus|block)\s+[a-z0-9]\b",
    re.IGNORECASE,
)
ZIP_CA = re.compile(r"\b([A-Z]\d[A-Z])\s?(\d[A-Z]\d)\b", re.IGNORECASE)
ZIP_GB = re.compile(r"\b([A-Z]{1,2}\d[A-Z\d]?)\s(\d[A-Z]{2})\b", re.IGNORECASE)
ZIP_NUM = re.compile(r"\b(?:([A-Z]{1,2})\s?-\s?)?(\d{4,5})(?:-\d{4})?\b", re.IGNORECASE)
NUMBER = re.compile(r"^(?:(?:no|nr|num|n)\.?\s?|#)?(\d+(?:[-/]\d+)?)\s?([a-z])?(?:[-/][a-z])?$")
LONG_NUMBER = re.compile(r"(?<![\w/-])\d{4,5}(?![\w/-])")  # a postcode or a house number
# Words that begin or go on with a name but never end it (folded).
LINKS = set("de la le les du des d l der den dem die das del los las el da do dos das di della of the unter am an im in zum zur auf sur sous saint st ste".split())


def folded(text: str) -> str:
    """Lower case without accents, compatibility forms replaced, ß as ss."""
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ẞ", "SS"))
    return "".join(c for c in text if not unicodedata.combining(c)).lower()


def near(a: str, b: str) -> bool:
    """Whether one edit (insert, delete, replace, swap of neighbours) at most lies between."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def deletions(word: str) -> list[str]:
    """The word and its forms with one letter left out."""
    return list(dict.fromkeys([word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]))


# Types that are short forms or translations of each other count as one.
_GROUP = {"avenue": "avenue", "avenida": "avenue", "plaza": "place", "place": "place", "platz": "place"}


_LONG_TYPES = {id(t): sorted({k for k in t.values() if len(k) >= 5}) for t in (_BEFORE, _AFTER)}


def _type_of(word: str, table: dict[str, str]) -> str | None:
    w = word.strip(".")
    if w in table:
        return table[w]
    if len(w) >= 5:
        for t in _LONG_TYPES[id(table)]:
            if -2 < len(t) - len(w) < 2 and near(w, t):
                return t
    return None


def _compound(word: str) -> tuple[str, str] | None:
    """(name, type) of a compound such as `lostilakallee` or `pidrejinstr.`."""
    w = word.strip(".")
    for end in sorted(_COMPOUND, key=len, reverse=True):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)].rstrip("-"), _COMPOUND[end]
    for end in ("strasse", "allee", "platz", "gasse"):  # a typing error in the ending
        for k in (len(end) - 1, len(end), len(end) + 1):
            if len(w) - k >= 4 and near(w[-k:], end):
                return w[:-k].rstrip("-"), end
    return None


def hypotheses(address: str | None, country: str | None) -> list[dict]:
    """The readings of an address: several where a type such as `av` may belong to the name
    before or after it, or where nothing parts street and town. Those without street or number
    are left out."""
    out: list[dict] = []
    for p in parse(address, country):
        if p["street"] and p["number"] and p not in out:
            out.append(p)
    return out


def _given(country: str | None) -> str:
    """The code of a country as stated; one that isn't known stands for itself."""
    word = re.sub(r"[^\w]+", " ", folded(country or "")).strip()
    return _COUNTRY.get(word, word)


def parse(address: str | None, country: str | None) -> list[dict]:
    """Readings with street (name), type, side, number, unit, town, postcode, country; empty
    strings where a part is missing."""
    first = dict.fromkeys(("street", "type", "side", "number", "unit", "town", "postcode", "country"), "")
    text = unicodedata.normalize("NFKC", address or "")
    first["unit"] = " ".join(folded(m.group()) for m in REMARKS.finditer(text))
    text = REMARKS.sub(" ; ", text)
    given, text, first["postcode"] = _without_postcode(text, _given(country))
    segments = []
    for segment in re.split(r"[,;\n]|\s-\s|\s–\s", folded(text)):
        s = re.sub(r"[^\w.#/'-]+", " ", segment).strip(" .-")
        if not s:
            continue
        named = _COUNTRY.get(re.sub(r"[^a-z]+", " ", s).strip())
        if named and not any(c.isdigit() for c in s):
            given = given or named
            continue
        segments.append(s.replace("c/", "c ").split())
    if segments:
        given, segments[-1] = _without_country(segments[-1], given)
    first["country"] = given
    out = []
    for at, spans in dict.fromkeys((_street(segments, True), _street(segments, False))):
        for name, kind, used, number in spans:
            p = dict(first, street=name, type=kind, number=number)
            words = p["street"].split()
            if len(words) > 1 and words[0].strip(".") in SIDES and kind in _AFTER.values():
                p["side"], p["street"] = SIDES[words[0].strip(".")], " ".join(words[1:])
            rest: list[str] = []
            for i, words in enumerate(segments):
                rest += [w for k, w in enumerate(words) if i != at or k not in used] + [";"]
            _town(rest, p)
            out.append(p)
    return out


def _without_postcode(text: str, given: str) -> tuple[str, str, str]:
    """(country, text without its postcode, postcode)."""
    for kind, pattern in (("CA", ZIP_CA), ("GB", ZIP_GB)):
        m = pattern.search(text)
        if m:
            return given or kind, text[: m.start()] + " ; " + text[m.end() :], (m.group(1) + m.group(2)).lower()
    codes = list(ZIP_NUM.finditer(text))
    plain = [m for m in codes if LONG_NUMBER.fullmatch(m.group())]
    if plain and len(plain) == len(codes) and not re.search(r"(?<![\w/-])\d{1,3}\s?[a-zA-Z]?(?![\w])|(?<![\w])\d+[-/]\d+", LONG_NUMBER.sub(" ", text)):
        # No shorter number: one of the long ones may be that of the house.
        house = next((m for m in plain if _beside_street(text, m)), None)
        codes = [m for m in plain if m is not house]
    if not codes:
        return given, text, ""
    m = codes[0]
    head = text[: m.start()]
    state = re.search(r"(?<=[\s,])([A-Z]{2})\s*$", head)  # IL 62701, DE 10117
    before = state.group(1) if state else ""
    hint = _COUNTRY.get((m.group(1) or before).lower(), "")
    known = before in STATES and len(m.group(2)) == 5 or bool(before and hint) and given in ("", hint)
    return given or hint, (head[: state.start()] if known else head) + " ; " + text[m.end() :], m.group(2)


def _without_country(words: list[str], given: str) -> tuple[str, list[str]]:
    """(country, words without a country at their end that no separator sets off). A code of two
    letters is one only where it says the country that is given, or none is."""
    for k in (4, 3, 2, 1):
        said = re.sub(r"[^a-z]+", " ", " ".join(words[-k:])).strip()
        code = _COUNTRY.get(said) if len(words) > k and len(said) > 1 else None
        if code and not any(c.isdigit() for w in words[-k:] for c in w) and (len(said) > 3 or given in ("", code)):
            return given or code, words[:-k]
    return given, words


def _beside_street(text: str, m: re.Match) -> bool:
    """Whether a long number stands where a house number does: before or after words of its
    part of the address that name a street."""
    start = max([k.end() for k in re.finditer(r"[,;\n]|\s-\s", text[: m.start()])], default=0)
    after = re.search(r"[,;\n]|\s-\s", text[m.end() :])
    ahead = folded(text[start : m.start()]).split()
    behind = folded(text[m.end() : m.end() + after.start() if after else len(text)]).split()
    street = lambda words: any(_type_of(w, _BEFORE) or _compound(w) or (k and _type_of(w, _AFTER)) for k, w in enumerate(words))
    return street(behind) if not [w for w in ahead if w.strip(".") not in ("no", "nr", "n", "num", "#")] else street(ahead) and not behind


def _number(word: str) -> str:
    """The house number a word holds, without its mark."""
    m = NUMBER.match(word) if any(c.isdigit() for c in word) else None
    return m.group(1).replace("/", "-") + (m.group(2) or "") if m else ""


def _town(rest: list[str], out: dict) -> None:
    """Reads the number, if it stands apart from its street, the town and a country at the end
    from the words that the street leaves; `;` parts them."""
    left: list[str] = []
    i = 0
    while i < len(rest):
        if not out["number"] and _number(rest[i]) and rest[i][0] in "#0123456789":
            out["number"] = _number(rest[i])
        elif not out["number"] and rest[i].strip(".") in ("no", "nr") and _number(" ".join(rest[i : i + 2])):
            out["number"] = _number(" ".join(rest[i : i + 2]))
            i += 1
        else:
            left.append(rest[i])
        i += 1
    parts = [p.strip() for p in " ".join(left).split(";")]
    parts = [p for p in parts if re.search(r"[a-z]{3}", p)]
    named = []
    for p in parts:
        words = p.split()
        for k in (4, 3, 2, 1):  # a country at the end that no separator sets off
            c = _COUNTRY.get(re.sub(r"[^a-z]+", " ", " ".join(words[-k:])).strip()) if len(words) >= k else None
            if c and (len(words) > k or len(words[0]) > 2):
                out["country"], words = out["country"] or c, words[:-k]
                break
        if words:
            named.append(" ".join(words))
    out["town"] = max(named, key=len, default="").replace(".", "")


def _street(segments: list[list[str]], before_first: bool) -> tuple[int, tuple[tuple[str, str, frozenset[int], str], ...]]:
    """(index of the segment that holds the street, its readings as name, type, positions used,
    number): by a type before or after the name, by a compound, else by a number alone."""
    order = (_type_before, _type_after) if before_first else (_type_after, _type_before)
    for find in (*order, _compounds, _untyped):
        for at, words in enumerate(segments):
            # Another part without digits can be the town, so this one need not hold it.
            town = any(i != at and any(re.search(r"[a-z]{3}", w) for w in other) and not any(c.isdigit() for w in other for c in w) for i, other in enumerate(segments))
            spans = find(words, town)
            if spans:
                return at, tuple(_numbered(words, name.strip(" .-'"), kind, used) for name, kind, used in spans)
    return -1, ()


def _numbered(words: list[str], name: str, kind: str, used: set[int]) -> tuple[str, str, frozenset[int], str]:
    """Adds the house number of the segment: the one next to the street, else the first."""
    at = [i for i, w in enumerate(words) if i not in used and _number(w)]
    if not at:
        return name, kind, frozenset(used), ""
    i = min(at, key=lambda i: min(abs(i - k) for k in used))
    used = used | {i} | ({i - 1} if i and words[i - 1].strip(".") in ("no", "nr", "n") else set())
    return name, kind, frozenset(used), _number(words[i])


def _cuts(words: list[str], start: int, end: int, town: bool, from_left: bool) -> list[tuple[int, int]]:
    """The spans within [start, end) that may be a street's name: all of it if the town stands
    elsewhere or it is one word, else every beginning (or end) that is a name."""
    if town or end - start <= 1:
        return [(start, end)]
    spans = [(start, k) if from_left else (k, end) for k in (range(start + 1, end + 1) if from_left else range(end - 1, start - 1, -1))]
    return [(a, b) for a, b in spans if (words[b - 1].strip(".") not in LINKS and re.search(r"[a-z]{3}", words[b - 1])) and (from_left or a == start or words[a - 1].strip(".") not in LINKS)]


def _type_before(words: list[str], town: bool) -> list[tuple[str, str, set[int]]]:
    for i, w in enumerate(words):
        kind = _type_of(w, _BEFORE)
        if not kind or kind == "allee" or i + 1 >= len(words) or not re.match(r"[a-z]", words[i + 1]):
            continue
        end = next((k for k in range(i + 1, len(words)) if _number(words[k]) or words[k].strip(".") in ("no", "nr")), len(words))
        # After the number the town follows, so the name ends there.
        town = town or end < len(words)
        name = words[i + 1 : end]
        if not any(re.search(r"[a-z].*[a-z]{2}", x) for x in name) or _type_of(name[0], _AFTER) and not _type_of(name[0], _BEFORE) and len(name) == 1:
            continue
        if _type_of(name[0], _AFTER) and name[0].strip(".") not in LINKS:
            continue
        return [(" ".join(words[a:b]), kind, set(range(i, b))) for a, b in _cuts(words, i + 1, end, town, True)]
    return []


def _type_after(words: list[str], town: bool) -> list[tuple[str, str, set[int]]]:
    for i, w in enumerate(words):
        kind = _type_of(w, _AFTER)
        if not kind or not i or _number(words[i - 1]) or not re.search(r"[a-z]{3}", words[i - 1]):
            continue
        while i + 1 < len(words) and words[i + 1].strip(".") in _AFTER and words[i + 1].strip(".") not in LINKS:
            i += 1
            kind = _type_of(words[i], _AFTER)
        marks = [k for k in range(i) if _number(words[k]) or words[k].strip(".#") in ("no", "nr", "")]
        start = marks[-1] + 1 if marks else 0
        out = []
        for a, b in _cuts(words, start, i, town or bool(marks), False):
            if a and words[a - 1].strip(".") in SIDES and not marks:
                a -= 1
            span = (" ".join(words[a:b]), kind, set(range(a, i + 1)))
            if span not in out:
                out.append(span)
        return out
    return []


def _compounds(words: list[str], town: bool) -> list[tuple[str, str, set[int]]]:
    for i, w in enumerate(words):
        pair = _compound(w)
        if pair:
            marks = [k for k in range(i) if _number(words[k]) or words[k].strip(".#") in ("no", "nr", "")]
            start = marks[-1] + 1 if marks else 0
            spans = [(start, i + 1)] if town or start == i else [(k, i + 1) for k in range(i, start - 1, -1)]
            return [(" ".join([*words[a:i], pair[0]]), pair[1], set(range(a, b))) for a, b in spans]
    return []


def _untyped(words: list[str], town: bool) -> list[tuple[str, str, set[int]]]:
    """A name without any type beside a number: `Unter den Linden 77`, `12 The Strand`."""
    at = [i for i, w in enumerate(words) if _number(w)]
    if not at or not any(re.search(r"[a-z]{3}", w) for w in words):
        return []
    i = at[0]
    ahead = i - 1 if i and words[i - 1].strip(".") in ("no", "nr", "n") else i
    if any(re.search(r"[a-z]{3}", w) for w in words[:ahead]):
        return [(" ".join(words[a:b]), "", set(range(a, b))) for a, b in _cuts(words, 0, ahead, town or ahead + 1 < len(words), False)]
    return [(" ".join(words[a:b]), "", set(range(a, b))) for a, b in _cuts(words, i + 1, len(words), town, True)]


def _bare(address: str) -> str:
    """What an address that can't be read holds besides remarks, empty if that has no number."""
    text = REMARKS.sub(" ; ", unicodedata.normalize("NFKC", address))
    _, rest, _ = _without_postcode(text, "")
    one = re.sub(r"\W+", " ", folded(rest)).strip()
    return re.sub(r"\W+", " ", folded(text)).strip() if re.search(r"\d", one) and re.search(r"[^\W\d]{3}", one) else ""


FORM = "array<struct<country:string,postcode:string,town:string,street:string,type:string>>"


def _parsed(records: DataFrame) -> DataFrame:
    """`records` has rep_id, address, country. rep_id, form (key of the readings), readings
    (FORM), numbers and units of the readings; those that can't be read have no readings and
    their own text as form."""
    names = ["rep_id", "form", "readings", "numbers", "units"]
    texts = pa.list_(pa.string())
    struct = pa.list_(pa.struct([(c, pa.string()) for c in ("country", "postcode", "town", "street", "type")]))
    types = [pa.int64(), pa.string(), struct, texts, texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, address, country in zip(*(batch.column(c).to_pylist() for c in ("rep_id", "address", "country"))):
                found = hypotheses(address, country) if address else []
                readings = [
                    {"country": p["country"], "postcode": p["postcode"], "town": p["town"], "street": f"{p['side']} {p['street']}".strip(), "type": _GROUP.get(p["type"], p["type"])} for p in found
                ]
                form = "\u0002".join("\u0001".join(r.values()) for r in readings)
                if not found:
                    form = _bare(address) if address else ""
                    form = f"{form}\u0003{_given(country)}" if form else ""
                if form:
                    rows.append((key, form, readings, [p["number"] for p in found], [p["unit"] for p in found]))
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return records.select("rep_id", "address", "country").mapInArrow(run, f"rep_id bigint, form string, readings {FORM}, numbers array<string>, units array<string>")


def _deleted(word: Column) -> Column:
    """Array of the word and its forms with one letter left out."""
    cuts = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) > 2, cuts).otherwise(F.array().cast("array<string>"))))


def _close(a: Column, b: Column) -> Column:
    """Whether two words that share a deletion are within one edit, a swap counting as one."""
    d = F.levenshtein(a, b)
    letters = lambda x: F.array_sort(F.split(x, ""))
    return (d <= 1) | ((d == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b)))


def _clustered(observed: DataFrame, keys: list[str], word: str) -> DataFrame:
    """`observed` has keys, word, n (distinct). Adds head: the most frequent word within one
    edit under the same keys, itself if none is more frequent. Equi-joins on deletions."""
    keyed = observed.select(*keys, word, "n", F.explode(_deleted(F.col(word))).alias("cut"))
    other = keyed.select(*keys, F.col(word).alias("other"), F.col("n").alias("other_n"), "cut")
    pairs = keyed.join(other, [*keys, "cut"]).filter((F.col("other") == F.col(word)) | (F.struct("other_n", "other") > F.struct("n", word)) & _close(F.col(word), F.col("other")))
    return pairs.groupBy(*keys, word, "n").agg(F.max_by("other", F.struct("other_n", "other")).alias("head"))


def _localities(readings: DataFrame) -> DataFrame:
    """country, postcode, town_c, locality_n, locality: postcode and town that stand together,
    town spellings clustered; towns that never stand with a postcode are localities of their
    own. One without a country is left out where another one has it."""
    sure = readings.filter("readings = 1 and town <> ''").groupBy("country", "postcode", "town").agg(F.sum("n").alias("n"))
    sure = cut(sure)
    coded = sure.filter("postcode <> ''")
    heads = _clustered(coded.groupBy("postcode", "town").agg(F.sum("n").alias("n")), ["postcode"], "town").select("postcode", "town", F.col("head").alias("town_c"))
    known = coded.join(heads, ["postcode", "town"]).groupBy("country", "postcode", "town_c").agg(F.sum("n").alias("n"))
    alone = sure.filter("postcode = ''")
    known_cuts = known.select("town_c", F.explode(_deleted(F.col("town_c"))).alias("cut")).distinct()
    towns = alone.groupBy("town").agg(F.sum("n").alias("n")).withColumn("postcode", F.lit(""))
    matched = towns.select("town", F.explode(_deleted(F.col("town"))).alias("cut")).join(known_cuts, "cut").filter(_close(F.col("town"), F.col("town_c"))).select("town").distinct()
    stray = _clustered(towns.join(matched, "town", "left_anti"), ["postcode"], "town").select("town", F.col("head").alias("town_c"))
    stray = alone.join(stray, "town").groupBy("country", "postcode", "town_c").agg(F.sum("n").alias("n"))
    # A locality has few countries, so the window's groups are small.
    stated = F.max("country").over(Window.partitionBy("postcode", "town_c")) != ""
    out = known.unionByName(stray).withColumn("stated", stated).filter("country <> '' or not stated")
    return out.select(F.concat_ws("|", "country", "postcode", "town_c").alias("locality"), F.col("country").alias("in_country"), "postcode", "town_c", F.col("n").alias("locality_n"))


def resolved(records: DataFrame) -> DataFrame:
    """Rows rep_id, street_id, number, unit, cost: each address with the gazetteer entry that
    the beam search ends on. street_id says the street within its locality."""
    parsed = cut(_parsed(records))
    forms = parsed.groupBy("form").agg(F.count("*").alias("n"), F.any_value("readings").alias("rs"))
    readings = forms.filter(F.size("rs") > 0).select("form", "n", F.size("rs").alias("readings"), F.posexplode("rs").alias("reading", "r"))
    readings = cut(readings.select("form", "n", "readings", "reading", "r.*"))
    localities = cut(_localities(readings))

    # First step of the beam: localities of each reading, by postcode or by town.
    fits = (F.col("country") == F.col("in_country")) | (F.col("country") == "") | (F.col("in_country") == "")
    by_code = readings.filter("postcode <> ''").join(localities, "postcode").filter(fits)
    same, close = F.col("town") == F.col("town_c"), _close(F.col("town"), F.col("town_c"))
    by_code = by_code.withColumn("cost", F.when((F.col("town") == "") | same, 0).when(close, 1).otherwise(3))
    town_cuts = localities.select("locality", "in_country", "town_c", F.explode(_deleted(F.col("town_c"))).alias("cut"))
    by_town = readings.filter("postcode = '' and town <> ''").withColumn("cut", F.explode(_deleted(F.col("town")))).join(town_cuts, "cut").filter(close & fits)
    by_town = by_town.withColumn("cost", F.when(same, 0).otherwise(1))
    columns = ["form", "n", "reading", "readings", "street", "type", "locality", "cost"]
    steps = by_code.select(*columns).unionByName(by_town.select(*columns).distinct())
    # Equal scores share a rank, so the beam never cuts among equals.
    steps = cut(steps.withColumn("rank", F.rank().over(Window.partitionBy("form").orderBy("cost"))).filter(F.col("rank") <= BEAM).drop("rank"))

    # Streets of a locality from the readings that leave it no choice.
    certain = steps.filter("readings = 1 and cost <= 1").groupBy("form", "n", "street", "type").agg(F.min("locality").alias("locality"), F.count("*").alias("k")).filter("k = 1")
    spellings = _clustered(certain.groupBy("locality", "type", "street").agg(F.sum("n").alias("n")), ["locality", "type"], "street")
    gazetteer = spellings.groupBy("locality", "type", F.col("head").alias("street_c")).agg(F.sum("n").alias("street_n"))
    gazetteer = cut(gazetteer.withColumn("street_id", F.concat_ws("|", "locality", "type", "street_c")))

    # Second step: streets of those localities.
    entry_cuts = gazetteer.withColumn("cut", F.explode(_deleted(F.col("street_c"))))
    tried = steps.withColumn("cut", F.explode(_deleted(F.col("street")))).join(entry_cuts, ["locality", "type", "cut"]).filter(_close(F.col("street"), F.col("street_c")))
    tried = tried.withColumn("cost", F.col("cost") + F.when(F.col("street") == F.col("street_c"), 0).otherwise(1))
    # Of equal costs the reading with the longest name: it leaves the least unexplained.
    order = F.struct(-F.col("cost"), F.length("street"), F.col("street_n"), -F.col("reading"), "street_id")
    best = cut(tried.groupBy("form").agg(F.max_by(F.struct("street_id", "reading", "cost"), order).alias("b")).select("form", "b.*"))

    # Addresses without a locality: a street name that the gazetteer has in one place only.
    rest = readings.join(best, "form", "left_anti")
    single = gazetteer.groupBy("type", "street_c").agg(F.count("*").alias("k"), F.min("street_id").alias("street_id")).filter("k = 1")
    single = single.withColumn("cut", F.explode(_deleted(F.col("street_c")))).withColumn("in_country", F.split_part("street_id", F.lit("|"), F.lit(1)))
    lone = rest.join(steps.select("form").distinct(), "form", "left_anti").withColumn("cut", F.explode(_deleted(F.col("street")))).join(single, ["type", "cut"])
    lone = lone.filter(_close(F.col("street"), F.col("street_c")) & fits).groupBy("form", "reading").agg(F.min("street_id").alias("street_id"), F.countDistinct("street_id").alias("k"))
    lone = lone.filter("k = 1").groupBy("form").agg(F.min_by("street_id", "reading").alias("street_id"), F.min("reading").alias("reading"))
    ends = cut(best.unionByName(lone.withColumn("cost", F.lit(2))))
    # What no entry fits stands for itself: equal writings still get the same identifier.
    rows = parsed.join(ends, "form", "left")
    own = F.when(F.size("readings") > 0, F.concat_ws("|", *(F.col("readings")[0][c] for c in ("country", "postcode", "town", "type", "street")))).otherwise(F.col("form"))
    at = F.coalesce("reading", F.lit(0))
    return rows.select(
        "rep_id", F.coalesce("street_id", own).alias("street_id"), F.coalesce(F.get("numbers", at), F.lit("")).alias("number"), F.coalesce(F.get("units", at), F.lit("")).alias("unit"),
        F.coalesce("cost", F.lit(9)).alias("cost"),
    )


def buildings(records: DataFrame) -> DataFrame:
    """rep_id, building (smallest rep_id at the same address), records (at it): one row for each
    record with an address."""
    rows = cut(resolved(records.select(F.col("rep_id").cast("bigint").alias("rep_id"), "address", "country").filter("address is not null and address <> ''")))
    groups = rows.groupBy("street_id", "number").agg(F.min("rep_id").alias("building"), F.countDistinct("rep_id").alias("records"))
    return rows.join(groups, ["street_id", "number"]).select("rep_id", "building", "records").distinct()


def found(records: DataFrame) -> DataFrame:
    """Pairs (rep_id_a, rep_id_b) of the records whose addresses are the same building."""
    rows = cut(buildings(records).select("rep_id", "building"))
    a, b = rows.toDF("rep_id_a", "building"), rows.toDF("rep_id_b", "building")
    return a.join(b, "building").filter("rep_id_a < rep_id_b").select("rep_id_a", "rep_id_b")


def probed(records: DataFrame, every: int = 50) -> DataFrame:
    """query_id, rep_id: for each record whose id is divisible by `every` all other records at its
    building, searched among all rows."""
    rows = cut(buildings(records).select("rep_id", "building"))
    asked = rows.filter(F.col("rep_id") % every == 0).select(F.col("rep_id").alias("query_id"), "building")
    return asked.join(rows, "building").filter("query_id <> rep_id").select("query_id", "rep_id")

"""Personal data in free text: found, typed and replaced by placeholders.

Anchor expansion: one pass of an Aho-Corasick automaton over the text finds anchors (at-signs
and their written forms, schemes, dial prefixes, cues of identity numbers and accounts, street
types, given names, initials, forms of address and roles). At each anchor a local parser expands
to the left and to the right as far as its grammar reaches (characters of an address, digits of
a number, words of a street or name), never to a number of characters, validates what it read
and fixes its boundaries. Text without anchors is never parsed. Whole texts are processed in
Arrow batches without a shuffle.

Names are found by a list of given names (a parameter), by initials, by forms of address and
roles before them, and by the email addresses of the same text: a capitalised pair whose surname
and given name or initial stand in a local part. International account numbers need no cue, their length
and check digits (mod 97) tell them and their end; behind a cue a number is taken as written,
whatever its check digits, as a mistyped number is personal data as well.

Where pieces overlap, the kind that comes first in `KINDS` wins, then the longer piece.
Positions count characters (code points) from 0; the end is the one after the last. Defined
results: null and empty texts give no pieces and stay as they are; repeated rows give
repeated results; extra columns are kept.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ["email", "address", "ident", "phone", "name"]

# Given names in the languages of the corpus (with short forms); a parameter of
# the functions below, so that a longer list can take their place.
GIVEN = tuple(
    (
        "Ada Adrian Alexander Ana Anamaria Andrea Andreas Andrew Anna Anne Antoine Anton Barbara Beatriz Ben Benedikt Benjamin "
        "Bernard Bettina Björn Bob Brigitte Carlos Carmen Catherine Charles Charlotte Chiara Christian Christine Christoph "
        "Claire Daniel David Dima Dmitri Doro Dorothea Edward Elena Elisabeth Elizabeth Emil Emily Erik Fran Francesco "
        "Francisco François Frank Fred Frederic Frédéric Friedrich Gabi Gabriel Gabriela Georg George Guadalupe Hans Heinrich "
        "Hélène Helen Henri Henrietta Henry Hiroshi Ingrid Ioana Ivan James Jan Javier Jean Johann Johanna Johannes John Jonas "
        "Jose José Joseph Juan Julia Julie Jürgen Karl Katharina Kathi Kati Kenji Klaus Kurt Laurent Leonardo Louis Luc Lucas "
        "Luis Lupe Łukasz Marco Margaret Maria María Marie Mario Mark Markus Marta Martin Mary Matthias Maximilian Mehmet "
        "Michael Michel Miguel Mikhail Mitya Monika Natalia Nathaniel Nicolas Nikolai Nina Oana Olga Oliver Olivier Omar Paco "
        "Patricia Patrick Paul Paula Pavel Pedro Peter Philippe Pierre Priya Quentin Rachel Ralf Richard Rob Robert Roberto "
        "Ronnie Rosa Ruth Samuel Sandra Sanna Sara Sarah Sebastian Sergei Simon Sofia Sophie Stefan Stephan Susan Sven Tadeusz "
        "Tatiana Terry Tess Thea Theresa Thomas Timo Tobias Ulrich Ursula Uwe Vera Veronica Victor Viktor Vladimir Walter "
        "Werner Wilhelm William Wolfgang Yevgeny Yuki Yusuf Zoë Zoe"
    ).split()
)

# Forms of address that stand before a name whose given name is unknown here.
TITLES = "mr mr. mrs mrs. ms ms. miss dr dr. prof prof. herr herrn frau mme mlle madame monsieur señor señora signor signora".split()
# Roles and phrases that a name follows.
ROLES = "inventor|inventors|erfinder|erfinderin|inventeur|inventrice|inventora|signed by|handed over by|paid by|presented by|contact|attention|z. hd.|represented by|named".split("|")

# Cues of identity numbers.
IDENT_CUES = [
    "identity no", "identity number", "identity card", "passport", "passport no", "tax number", "tax id", "tax no", "social security",
    "national id", "insurance number", "ausweisnummer", "ausweis-nr", "personalausweis", "reisepass", "steuer-id", "steuernummer",
    "steueridentifikationsnummer", "sozialversicherungsnummer", "numéro d'identité", "numero d'identite", "numéro d’identité",
    "carte d'identité", "passeport", "numéro fiscal", "sécurité sociale", "documento de identidad", "pasaporte", "dni", "nif", "nie",
    "número de identidad", "número fiscal", "iban", "ssn", "id no", "id number", "account number", "account no", "kontonummer", "konto-nr", "numéro de compte",
    "número de cuenta",
]

# Countries of international account numbers and how long theirs are.
IBAN = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20,
    "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}

# Street types as words before or after the name, and as ends of a compound.
TYPE_BEFORE = (
    r"(?:rue|(?-i:r\.)|avenue|aven?\.?|av\.?|boulevard|boul\.?|blvd\.?|bd\.?|place|pl\.|allée|chemin|quai|impasse|route|cours"
    r"|calle|c/|(?-i:c\.)|avda\.?|avenida|plaza|pza\.?|paseo|camino|via|viale|piazza|rua|praça)"
)
TYPE_AFTER = (
    r"(?:street|st\.?|avenue|aven?\.?|av\.?|boulevard|boul\.?|blvd\.?|drive|dr\.?|lane|la\.?|ln\.?|road|rd\.?|court|ct\.?|square|sq\.?|terrace"
    r"|way|place|pl\.?|gardens|gdns\.?|close|crescent|parkway|pkwy\.?)"
)
TYPE_END = r"(?:straße|strasse|str\.?|weg|wg\.?|allee|platz|pl\.|gasse|ring|damm|ufer)"


def _spelt(pattern: str) -> list[str]:
    """The words of a pattern of alternatives, with and without an optional letter, without
    final dots."""
    out = []
    for word in regex.sub(r"^\(\?:|\)$", "", regex.sub(r"\(\?-i:(.*?)\)", r"\1", pattern)).split("|"):
        word = word.replace("\\.?", "").replace("\\.", "")
        out += [word.replace("?", ""), regex.sub(r".\?", "", word)]
    return list(dict.fromkeys(out))


STREET_ANCHORS = [
    *"rue |r. |c. |avenue|ave |ave. |av. |av |boulevard|boul|blvd|bd |bd. |place |plaza|pza|pl. |calle|c/|avda|avenida|paseo|piazza".split("|"),
    *"straße|strasse|str. |str |weg |wg. |wg |allee|platz|gasse".split("|"),
    *(f" {w}{end}" for w in _spelt(TYPE_AFTER) for end in (" ", ".", ",", "\n")),
]
# Every type that stands before a name or a number; shorter ones are anchors above.
TYPE_ANCHORS = [w for w in dict.fromkeys(_spelt(TYPE_BEFORE) + _spelt(TYPE_END)) if len(w) >= 3]

_CAP = r"\p{Lu}[\p{L}'’]*(?:-\p{L}[\p{L}'’]*)*"
_NO = r"\d{1,5}(?:[-/]\d{1,5})?(?:\s?[A-Za-z](?![\p{L}\d]))?"
_LINK = r"(?:(?:de la|de los|de las|de l['’]|de|du|des|del|della|di|do|da|dos|das|la|le|les|d['’]|l['’])[^\S\n]?)"
_NAMED = rf"{_LINK}?{_CAP}(?:[^\S\n]{_LINK}?{_CAP}){{0,3}}"
_SIDE = r"(?:(?:N|S|E|W|North|South|East|West)\.?\s)?"
_TOWN = r"(?:(?:San|Santa|St\.|Saint|Bad|Los|Las|La|Le|New)\s)?\p{Lu}[\p{L}'’]*(?:-\p{L}[\p{L}'’]*)*(?:\s(?:Falls|Springs|Heights|City|Beach|Hills|Park|Grove)|\s(?:del|de la|de)\s\p{Lu}\p{L}+|\s(?:am|an der|im)\s\p{Lu}\p{L}+)?"
_ZIP_BEFORE = r"(?:[A-Z]{1,2}-)?\d{4,5}"
_ZIP_AFTER = r"(?:[A-Z]\d[A-Z] ?\d[A-Z]\d|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}|\d{5}(?:-\d{4})?)"
_SEP = r"(?:\s*[,;]\s*|\s*\n\s*|\s+-\s+|\s)"
_GAP = r"[^\S\n]"
_STREET = (
    rf"(?:(?P<a>{_NO},?{_GAP}(?i:{TYPE_BEFORE}){_GAP}?{_LINK}?{_CAP}(?:{_GAP}{_LINK}{_CAP}|{_GAP}{_CAP}(?={_GAP}{_CAP}|\s*[,;\n]))*)"
    rf"|(?P<b>{_NO},?{_GAP}{_SIDE}{_CAP}(?:{_GAP}{_CAP}){{0,3}}{_GAP}(?i:{TYPE_AFTER})(?![\p{{L}}]))"
    rf"|(?P<c>(?:{_CAP}(?:-|{_GAP})(?i:{TYPE_END})|\p{{Lu}}[\p{{L}}'’-]*(?i:{TYPE_END})){_GAP}?,?{_GAP}?(?:No\.|Nr\.|#)?{_GAP}?{_NO})"
    rf"|(?P<d>(?i:{TYPE_BEFORE}){_GAP}?{_NAMED},?{_GAP}(?:No\.|Nr\.|#|n\.?º)?{_GAP}?{_NO}))"
)
_PLACE = rf"(?:{_ZIP_BEFORE}\s{_TOWN}|{_TOWN}(?:,?\s{_ZIP_AFTER}\b)?|{_ZIP_AFTER}\b|{_ZIP_BEFORE}\b)"
TYPE_NEXT = regex.compile(rf"\.?{_GAP}?(?:\p{{Lu}}|,?{_GAP}?(?:No\.|Nr\.|#)?{_GAP}?\d)")  # what may follow an anchor of a type
ADDRESS = regex.compile(rf"(?<![\p{{L}}\d]){_STREET}{_SEP}{_PLACE}")

_AT = r"(?:@|\s?[(\[]\s?(?:at|AT)\s?[)\]]\s?)"
_DOT = r"(?:\.|\s?[(\[]\s?(?:dot|DOT)\s?[)\]]\s?)"
EMAIL = regex.compile(rf"(?<![A-Za-z0-9._+%-])[A-Za-z0-9](?:[A-Za-z0-9_+%'-]|\.(?=[A-Za-z0-9_+%'-]))*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9-])")

_END = r"(?![\d\p{L}]|[-/.]\d)"
PHONE = regex.compile(
    r"(?<![\d\p{L}]|[\d\p{L}][-/.,:])(?:"
    r"\+\d{1,3}(?:[ -]?\(\d{1,4}\))?(?:[ ./-]{0,3}\d{1,8}){1,6}"  # +44 (0)20 7946 0111
    r"|00[1-9]\d{1,2}(?:[ -]?\(\d{1,4}\))?(?:[ ./-]{1,3}\d{1,8}){1,6}"  # 0049 89 / 99998157
    r"|(?:1[-. ])?(?:\(\d{3}\)[ -]?|\d{3}[-.])\d{3}[-.]\d{4}"  # 1-935-555-0123, (410) 555-0168
    r"|\d{3}\.\d{4}\.\d{4}"  # 555.0118.3172
    r"|(?:\(0\d{1,4}\)|0\d{1,4})(?:[ ./-]{1,3}\d{2,8}){1,5}"  # 089/99998-114, 01.99.00.66.42
    rf"){_END}"
)
DATE_LIKE = regex.compile(r"\d{1,2}[./-]\d{1,2}[./-](?:\d{4}|\d{2})")
IDENT = regex.compile(r"[\s:.,#°º(]*(?:(?:no|nr|number|nº|n°)\b[.:\s]*)?(?:(?:is|lautet|ist|est|es)\b[:\s]*|=\s*)?(?P<id>(?=[A-Z\d -]*\d)[A-Z\d]{1,34}(?:[ .-](?=[A-Z]*\d|[A-Z](?![\p{L}\d]))[A-Z\d]{1,8}){0,8})(?![\p{L}\d])")

_SURNAME = r"(?:(?:von|van|de|der|den|di|da|del|le|la)\s){0,2}\p{Lu}['’]?\p{L}+(?:[-'’]\p{Lu}\p{L}+)*"
_INITIAL = r"\p{Lu}\.(?:[-\s]?\p{Lu}\.)*"
_MIDDLE = rf"(?:\s{_INITIAL})?"
GIVEN_FIRST = regex.compile(rf"(?P<given>\p{{Lu}}\p{{L}}+(?:-\p{{Lu}}\p{{L}}+)?){_MIDDLE}[^\S\n](?P<surname>{_SURNAME})")
SURNAME_FIRST = regex.compile(rf"(?P<surname>{_SURNAME}),[^\S\n]?(?P<given>\p{{Lu}}\p{{L}}+(?:-\p{{Lu}}\p{{L}}+)?|{_INITIAL}){_MIDDLE}$")
INITIAL_FIRST = regex.compile(rf"(?P<given>{_INITIAL})[^\S\n]?(?P<surname>{_SURNAME})")
SURNAME_BEFORE = regex.compile(rf"(?<![\p{{L}}\d-])(?P<surname>{_SURNAME}),[^\S\n]?$")

MIDDLE = regex.compile(_MIDDLE)
INITIALS = regex.compile(_INITIAL)
SECOND_GIVEN = regex.compile(r"-\p{Lu}\p{L}+")
SPANISH_TITLE = regex.compile(r".*(?:por|con|a|de|y) D\. (?=\p{Lu}\.)", regex.DOTALL)  # don, not an initial

# Words that make a capitalised pair a company or a place, and ends of letters.
NOT_SURNAME = set(
    "inc ltd llc llp gmbh ag kg oy ab bv nv sa spa aps corp co company limited university institute laboratories optics robotics chemicals "
    "systems industries technologies instruments pharmaceuticals manufacturing engineering electronics international research street st "
    "avenue ave drive dr lane road boulevard blvd falls springs straße allee weg platz rue calle avenida phone telefon tel fax mobile email "
    "mail office teléfono mobil".split()
)
CLOSINGS = set(
    "sincerely regards cordialement salutations atentamente grüßen grüssen herzlichst hochachtungsvoll saludos faithfully truly wishes".split()
)


@cache
def _automaton(given: tuple[str, ...]):
    import ahocorasick

    cues: dict[str, set[str]] = {}

    def add(word: str, kind: str) -> None:
        cues.setdefault(word.lower(), set()).add(kind)

    for w in ("@", "(at)", "[at]", "( at", "[ at"):
        add(w, "email")
    digits = [f"{a}{b}" for a in range(10) for b in range(10)]
    for w in [*(f"+{d}" for d in range(10)), *(f"({d}" for d in digits), *(f"0{d} " for d in digits), *(f"{d}{s}" for d in digits for s in "-./")]:
        add(w, "phone")
    for w in IDENT_CUES:
        add(w, "ident")
    for w in STREET_ANCHORS:
        add(w, "street")
    for w in TYPE_ANCHORS:
        add(w, "type")
    for w in given:
        add(w, "given")
    for code in [*range(0x41, 0x5B), *range(0xC0, 0xDF), 0x141, 0x15A, 0x17B]:
        add(f"{chr(code)}.", "initial")
    for w in TITLES:
        add(f"{w} ", "title")
    for w in ROLES:
        add(f"{w} ", "role")
    add("://", "scheme")
    for country in IBAN:
        for digit in range(10):
            add(f"{country}{digit}", "account")
    automaton = ahocorasick.Automaton()
    for w, kinds in cues.items():
        automaton.add_word(w, (len(w), tuple(kinds)))
    automaton.make_automaton()
    return automaton


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _word(text: str, a: int, b: int) -> bool:
    return not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())


_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._+%'-")
USERINFO = regex.compile(r"://(?P<info>[^\s/@?#]+)@")
WORD = regex.compile(r"\S+")


def _email(text: str, at: int) -> Iterator[tuple[int, int]]:
    low = at - 1 if at and text[at] in "([" and text[at - 1].isspace() else at
    while low and text[low - 1] in _LOCAL:
        low -= 1
    while low < at and not text[low].isalnum():
        low += 1
    m = EMAIL.match(text, low)
    if m and m.start() <= at < m.end():
        yield m.span()


def _userinfo(text: str, at: int) -> Iterator[tuple[int, int]]:
    """User and password of an address with a scheme."""
    m = USERINFO.match(text, at)
    if m:
        yield m.span("info")


def _phone(text: str, at: int, end: int) -> Iterator[tuple[int, int]]:
    if not (end < len(text) and (text[end].isdigit() or text[end] in " (")):
        return
    low, digits = at, 0
    while low and digits <= 15 and (text[low - 1].isdigit() or text[low - 1] in "+()/. -"):  # no number has more
        low -= 1
        digits += text[low].isdigit()
    # The longest form of the pattern is shorter than this, so no match is cut.
    for m in PHONE.finditer(text, low, min(len(text), at + 100)):
        if m.start() > at:
            break
        if m.start() <= at < m.end():
            digits = sum(c.isdigit() for c in m.group())
            if 9 <= digits <= 15 and not DATE_LIKE.fullmatch(m.group()):
                yield m.span()


def _ident(text: str, end: int) -> Iterator[tuple[int, int]]:
    m = IDENT.match(text, end)
    if m:
        account = list(_account(text, m.start("id")))
        if account:
            yield from account
            return
        value = m.group("id")
        if sum(c.isdigit() for c in value) >= 5 and 7 <= sum(c.isalnum() for c in value) <= 34:
            yield m.span("id")


def _account(text: str, at: int) -> Iterator[tuple[int, int]]:
    """An international account number at `at`: as long as its country has it, in groups or in
    one, with right check digits."""
    want = IBAN.get(text[at : at + 2])
    if want is None or (at and text[at - 1].isalnum()):
        return
    end, value = at, ""
    while end < len(text) and len(value) < want:
        c = text[end]
        if "A" <= c <= "Z" or "0" <= c <= "9":
            value += c
        elif c not in " -" or not value or text[end - 1] in " -":
            return
        end += 1
    whole = len(value) == want and value[2:4].isdigit() and not (end < len(text) and text[end].isalnum())
    if whole and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1:
        yield at, end


def _reach(text: str, at: int, words: int, step: int) -> int:
    """The place that many words before (step -1) or after (1) `at`, at a boundary of words."""
    i, n = at, len(text)
    for _ in range(words):
        if step < 0:
            while i and text[i - 1].isspace():
                i -= 1
            while i and not text[i - 1].isspace():
                i -= 1
        else:
            while i < n and text[i].isspace():
                i += 1
            while i < n and not text[i].isspace():
                i += 1
    return i


def _address(text: str, at: int, end: int) -> Iterator[tuple[int, int]]:
    # Number, side and four words of a name before the type; name, number, postcode and town after.
    low = max(_reach(text, at, 7, -1), text.rfind("\n", 0, at) + 1)
    for m in ADDRESS.finditer(text, low, _reach(text, end, 16, 1)):
        if m.start() <= at < m.end():
            yield m.span()
        if m.start() > at:
            break


def _is_surname(word: str) -> bool:
    parts = word.split()
    return len(parts[-1]) > 1 and parts[-1].lower() not in NOT_SURNAME and parts[-1].lower() not in CLOSINGS


def _given_at(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Names around a given name or initials at [a, b)."""
    line = max(text.rfind("\n", 0, a) + 1, _reach(text, a, 5, -1))
    before = SURNAME_BEFORE.search(text, line, a)
    if before and _is_surname(before.group("surname")):
        yield before.start("surname"), MIDDLE.match(text, b).end()
        return
    m = GIVEN_FIRST.match(text, a) or INITIAL_FIRST.match(text, a)
    if m and _is_surname(m.group("surname")):
        yield m.span()


def _after(text: str, at: int) -> Iterator[tuple[int, int]]:
    """A name after a form of address or a role, if no company or place follows from it."""
    m = GIVEN_FIRST.match(text, at) or INITIAL_FIRST.match(text, at)
    if m and _is_surname(m.group("surname")) and m.group("given").lower() not in TITLES and m.group("given").lower() not in NOT_SURNAME:
        follows = WORD.match(text, m.end() + 1)
        if not (follows and text[m.end()] == " " and follows.group().strip(".,;:").lower() in NOT_SURNAME):
            yield m.span()


def _named_by_mail(text: str, low: str, mails: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Capitalised pairs whose surname and given name or initial stand in the local part of an
    email address of the text."""
    parts = [[w for w in regex.split(r"[^a-z]+", low[a:b].partition("@")[0].partition("(")[0].partition("[")[0]) if w] for a, b in mails]
    for word in {w for p in parts for w in p if len(w) >= 3}:
        at = low.find(word)
        while at >= 0:
            if text[at].isupper() and _word(text, at, at + len(word)):
                low_at = _reach(text, at, 1, -1)
                for start in (at, low_at):
                    m = GIVEN_FIRST.match(text, start)
                    if m and start <= at < m.end() and not (start and text[start - 1].isalnum()):
                        given, surname = m.group("given").lower(), m.group("surname").lower().split()[-1]
                        if word == surname and any(word in p and any(x != word and (given == x or x == given[0]) for x in p) for p in parts) and _is_surname(m.group("surname")):
                            yield m.span()
            at = low.find(word, at + 1)


def pieces(text: str, given: tuple[str, ...] = GIVEN) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the personal data in `text`, by position, without overlaps."""
    if not text:
        return []
    low, found = _lower(text), set()
    for last, (n, kinds) in _automaton(given).iter(low):
        a, b = last - n + 1, last + 1
        for kind in kinds:
            if kind == "email":
                found.update(("email", *x) for x in _email(text, a))
            elif kind == "scheme":
                found.update(("ident", *x) for x in _userinfo(text, a))
            elif kind == "phone":
                found.update(("phone", *x) for x in _phone(text, a, b))
            elif kind == "ident" and not (a and text[a - 1].isalpha()):
                found.update(("ident", *x) for x in _ident(text, b))
            elif kind == "account":
                found.update(("ident", *x) for x in _account(text, a))
            elif kind == "type":
                if TYPE_NEXT.match(text, b):
                    found.update(("address", *x) for x in _address(text, a, b))
            elif kind == "street":
                found.update(("address", *x) for x in _address(text, a + (low[a] == " "), b))
            elif kind == "given" and text[a].isupper() and _word(text, a, b):
                start = a
                while start >= 2 and text[start - 1] == "-" and text[start - 2].isalpha():  # Jean-Luc
                    start -= 2
                    while start and text[start - 1].isalpha():
                        start -= 1
                end = b
                m = SECOND_GIVEN.match(text, b)
                end = m.end() if m else b
                found.update(("name", *x) for x in _given_at(text, start, end))
            elif kind == "title" and text[a].isupper() and not (a and text[a - 1].isalnum()):
                # Behind a capitalised word `Dr` is a street.
                before = text[_reach(text, a, 1, -1) : a].strip() if low[a] == "d" else ""
                if not (before[:1].isupper() and before.isalpha()):
                    found.update(("name", *x) for x in _after(text, b))
            elif kind == "role" and not (a and text[a - 1].isalnum()):
                found.update(("name", *x) for x in _after(text, b))
            elif kind == "initial" and text[a].isupper() and not (a and (text[a - 1].isalnum() or text[a - 1] in ".-'’")):
                start = a + 3 if SPANISH_TITLE.match(text, max(0, a - 5), a + 5) else a
                m = INITIALS.match(text, start)
                if m and not (a >= 2 and text[a - 2].isdigit() and text[a - 1] == " "):
                    found.update(("name", *x) for x in _given_at(text, start, m.end()))
    logins = [(a, b) for kind, a, b in found if kind == "ident" and text[b : b + 1] == "@"]
    found = {x for x in found if x[0] != "email" or not any(a < x[2] and x[1] <= b for a, b in logins)}
    mails = [(a, b) for kind, a, b in found if kind == "email"]
    if mails:
        found.update(("name", *x) for x in _named_by_mail(text, low, mails))
    taken: list[tuple[int, int, str]] = []
    for kind, a, b in sorted(found, key=lambda x: (KINDS.index(x[0]), x[1] - x[2], x[1])):
        i = bisect.bisect_left(taken, (a,))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
            taken.insert(i, (a, b, kind))
    return [(kind, a, b) for a, b, kind in taken]


def masked(text: str | None, given: tuple[str, ...] = GIVEN) -> str | None:
    """`text` with `[EMAIL]`, `[PHONE]`, `[IDENT]`, `[ADDRESS]`, `[NAME]` for its pieces."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in pieces(text, given):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def with_masked(df: DataFrame, column: str, name: str, given: tuple[str, ...] = GIVEN) -> DataFrame:
    """`df` with the text column `name`: `column` with placeholders."""
    df = df.drop(name) if name in df.columns and name != column else df
    keep = [c for c in df.columns if c != name]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([masked(t, given) for t in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), text], names=[*keep, name])

    return df.mapInArrow(run, schema)


def found(documents: DataFrame, given: tuple[str, ...] = GIVEN) -> DataFrame:
    """Rows (doc_id, kind, start_pos, end_pos), one for each piece of personal data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (i, *p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in pieces(t, given)
            ]
            cols = list(zip(*rows)) if rows else [[]] * 4
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "kind", "start_pos", "end_pos"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, kind string, start_pos int, end_pos int")

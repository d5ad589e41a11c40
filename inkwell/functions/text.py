"""Text as column expressions: normalisation, counting units, headings, page quality.

Everything runs in the JVM. Only compatibility normalisation (NFKC) has no built-in; `with_nfkc`
sends to Python just the rows that hold a character it would change.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six ranges whose characters count as one unit each.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{AC00}-\x{D7AF}]"
# A word of the Unicode standard and one of the Latin lookup standard.
UNIT_WORD = r"[\p{L}\p{N}]+(?:[’'/-][\p{L}\p{N}]+)*"
LATIN_WORD = r"[0-9A-Za-zÀ-ÖØ-öø-ÿ]+(?:[’'/-][0-9A-Za-zÀ-ÖØ-öø-ÿ]+)*"
# White space as Unicode has it, the file separators included (RE2 and Java).
SPACE = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Section headings of publications by part.
HEADINGS = {
    "abstract": ["abstract", "zusammenfassung", "abrégé", "abrege", "resumen", "resumo", "реферат", "摘要", "说明书摘要", "說明書摘要", "要約", "초록", "ملخص"],
    "abstract_drawing": [
        "abstract drawing", "abstract drawings", "abstract figure", "abstract figures", "摘要附图", "说明书摘要附图", "摘要附圖", "說明書摘要附圖", "要約図", "요약도",
    ],
    "description": ["description", "beschreibung", "descripción", "descripcion", "descrição", "descricao", "описание", "说明书", "說明書", "発明の詳細な説明", "명세서", "الوصف"],
    "claims": [
        "claims", "claim", "patentansprüche", "patentanspruche", "revendications", "reivindicaciones", "reivindicações", "reivindicacoes",
        "формула изобретения", "权利要求", "权利要求书", "權利要求", "權利要求書", "請求の範囲", "特許請求の範囲", "청구범위", "المطالبات",
    ],
    "description_drawings": [
        "drawings", "drawing", "zeichnungen", "dessins", "dibujos", "desenhos", "чертежи", "附图", "说明书附图", "附圖", "說明書附圖", "図面", "도면", "الرسومات",
    ],
}
# Patterns of page suffixes, heading separators, running lines, search reports.
PAGE_SUFFIX = rf"{SPACE}*(?:(?:第{SPACE}*)?\d+{SPACE}*(?:/{SPACE}*\d+)?{SPACE}*(?:页|頁)|pages?{SPACE}*\d+(?:{SPACE}*of{SPACE}*\d+)?|\d+{SPACE}*/{SPACE}*\d+{SPACE}*pages?){SPACE}*$"
HEADING_SEPARATORS = r"[\s\x{00b7}\x{2022}\x{30fb}_\-\x{2013}\x{2014}\x{00A0}\x{3000}]+"  # with the spaces that RE2 and Java don't count
PATENT_HEADER = r"(?i)^(?:PCT[/ -][A-Z]{2}[ /-]?\d|[A-Z]{2}[ /-]?\d)[A-Z0-9/ .-]{4,}$"
PAGE_LABEL = r"(?i)^(?:-?\s*\d+\s*-?|(?:第\s*)?\d+\s*(?:/\s*\d+)?\s*(?:页|頁)|pages?\s*\d+(?:\s*of\s*\d+)?|\d+\s*/\s*\d+\s*pages?)$"
SEARCH_REPORT = r"(?i)international\s+search\s+report|european\s+search\s+report|internationaler\s+recherchenbericht|rapport\s+de\s+recherche"
# What recognised pages carry besides their text: publication and application
# numbers, and lines of a sheet count, a page number, a date, a pair of initials.
PAGE_NUMBERS = r"(?i)\b(?:WO\s*\d{4}\s*/?\s*\d{4,6}|EP\s*\d{4,12}\s*[A-Z]\d{1,2}|PCT\s*/\s*[A-Z]{2}\s*\d{4}\s*/\s*\d{4,6})\b"
PAGE_LINES = [r"\s*\d+\s*/\s*\d+\s*", r"\s*-\s*\d+\s*-\s*", r"\s*(?:19|20)\d{2}\s+\d{2}\s+\d{2}\s*", r"\s*[A-Za-z]{1,3}/[A-Za-z]{1,3}\s*"]
# A figure named in text, a unit of a figure's text, a paragraph that labels one.
FIGURE_NAMED = r"(?i)\bfig(?:ure)?\.?\s*\d+"
FIGURE_UNIT = r"[A-Za-z]+|\d+(?:[./-]\d+)*"
FIGURE_LABEL = r"(?i)^FIGS?\.\s+.+"
# Traces of wrong decoding; the replacement character counts twice.
MOJIBAKE = ["�", "Ã", "Â", "â€", "□", "�"]


# By block: how far apart ranges may lie to be joined; blocks of common letters and marks of
# punctuation are kept apart.
GAPS = [(0x250, 0), (0x530, 16), (0x2000, 1024), (0x2070, 0), (0x3000, 1024), (0x3400, 8), (0xAC00, 2048), (0x10000, 4096), (sys.maxunicode + 1, sys.maxunicode)]


@cache
def _nfkc_class() -> str:
    """Regex class that holds all characters that NFKC changes or that may compose, by rule.
    Neighbouring ranges above the Latin letters are joined, so it is short and holds a few
    characters more, whose rows are merely looked at for nothing."""
    ranges: list[list[int]] = []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or not (unicodedata.combining(c) or unicodedata.normalize("NFKC", c) != c or 0x1100 <= code < 0x1200):
            continue
        gap = next(g for end, g in GAPS if code < end)
        if ranges and code - ranges[-1][1] <= gap + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" if a < b else rf"\x{{{a:X}}}" for a, b in ranges) + "]"


def with_nfkc(df: DataFrame, column: str) -> DataFrame:
    """`df` with `column` in NFKC. Texts that it cannot change never leave the JVM: Python gets
    nulls in their places, and the table is read once."""

    @F.pandas_udf("string")
    def nfkc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    text = F.col(column)
    touched = F.coalesce((F.octet_length(text) != F.length(text)) & text.rlike(_nfkc_class()), F.lit(False))
    return df.withColumn(column, F.coalesce(nfkc(F.when(touched, text)), text))


def normalized(text: Column) -> Column:
    """Without `[0001]` paragraph markers, white space collapsed and trimmed."""
    bare = F.regexp_replace(text, rf"\[\d{{4,}}\]{SPACE}*", "")
    return F.trim(F.regexp_replace(bare, rf"{SPACE}+", " "))


def count_words(text: Column) -> Column:
    """Words of the Latin standard; other scripts count 0."""
    return F.regexp_count(normalized(text), F.lit(LATIN_WORD)).cast("bigint")


def count_units(text: Column) -> Column:
    """CJK characters and words of the Unicode standard; null for null."""
    n = normalized(text)
    return (F.regexp_count(n, F.lit(CJK)) + F.regexp_count(F.regexp_replace(n, CJK, " "), F.lit(UNIT_WORD))).cast("bigint")


def unit_tokens(text: Column) -> Column:
    """Array of the units: CJK characters first, then words, each in order."""
    n = normalized(text)
    return F.concat(F.regexp_extract_all(n, F.lit(CJK), F.lit(0)), F.regexp_extract_all(F.regexp_replace(n, CJK, " "), F.lit(UNIT_WORD), F.lit(0)))


def five_grams(tokens: Column) -> Column:
    """Distinct runs of five lower-case units, joined by U+0001; empty below five units.
    `tokens` is a column of unit_tokens(), not the expression: it is used at every place."""
    # By position: slice() would copy the whole array for every gram.
    grams = F.transform(F.sequence(F.lit(0), F.size(tokens) - 5), lambda i: F.lower(F.concat_ws("\u0001", *(F.get(tokens, i + k) for k in range(5)))))
    return F.when(F.size(tokens) >= 5, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def heading_keys() -> dict[str, str]:
    """The headings without separators, and their parts."""
    return {re.sub(r"[\s·•・_–—-]+", "", v): part for part, values in HEADINGS.items() for v in values}


def heading_part(line: Column) -> Column:
    """The part that a heading line opens, else null. `line` is in NFKC."""
    low = F.lower(F.trim(F.regexp_replace(line, rf"^{SPACE}+|{SPACE}+$", "")))
    low = F.regexp_replace(low, rf"^{SPACE}*(?:\(\d+\)|\d+[.)]){SPACE}*", "")
    low = F.regexp_replace(F.regexp_replace(low, PAGE_SUFFIX, ""), r"[:：.。 ]+$", "")
    key = F.regexp_replace(low, HEADING_SEPARATORS, "")
    table = F.create_map(*[F.lit(x) for kv in heading_keys().items() for x in kv])
    return F.when(F.length(low) <= 100, F.element_at(table, key))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def is_running_line(line: Column) -> Column:
    """Whether a line is a repeated publication header or a page label."""
    one = collapsed(line)
    return one.rlike(PATENT_HEADER) | one.rlike(PAGE_LABEL)


def has_search_report(text: Column) -> Column:
    return text.rlike(SEARCH_REPORT)


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("bigint")


def reliable_layer(text: Column) -> Column:
    """Whether a text layer can be used as it is: two units or more, at most 1 % traces of
    wrong decoding, no control characters, at least a quarter letters and digits."""
    dense = F.regexp_replace(text, SPACE, "")
    size = F.length(dense)
    wrong = sum((occurrences(text, m) for m in MOJIBAKE), F.lit(0))
    meaningful = F.regexp_count(dense, F.lit(r"[\p{L}\p{N}]"))
    good = (count_units(text) >= 2) & (size > 0) & (wrong <= size * 0.01) & ~dense.rlike(r"[\x00-\x1F]") & (meaningful >= size * 0.25)
    return F.coalesce(good, F.lit(False))


def figure_like(line: Column) -> Column:
    """Whether a line reads as text of a figure: it has a digit and four units at most, or
    names a figure."""
    one = collapsed(line)
    units = F.regexp_count(one, F.lit(FIGURE_UNIT))
    return (one != "") & ~is_running_line(one) & one.rlike(r"\d") & ((units <= 4) | one.rlike(FIGURE_NAMED))


def drawing_like(text: Column) -> Column:
    """Whether recognised text stems from a drawing."""
    tokens = unit_tokens(text)
    short = F.size(F.filter(tokens, lambda t: t.rlike(r"^\p{Nd}") | (F.length(t) <= 4)))
    named = text.rlike(FIGURE_NAMED)
    return (F.size(tokens) > 0) & text.rlike(r"\d") & (named | ((F.size(tokens) <= 30) & (short * 2 >= F.size(tokens))))


def containment(inner: Column, outer: Column) -> Column:
    """Share of the distinct lower-case units of `inner` that `outer` has; 0 if either has none."""
    a, b = (F.array_distinct(F.transform(unit_tokens(x), F.lower)) for x in (inner, outer))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def cleaned_page(text: Column) -> Column:
    """Recognised text without publication numbers, page marks and date lines."""
    out = F.regexp_replace(text, PAGE_NUMBERS, " ")
    for line in PAGE_LINES:
        out = F.regexp_replace(out, rf"(?m)^{line}$", " ")
    return collapsed(out)


def drawing_labels(paragraphs: Column) -> Column:
    """Distinct normalised paragraphs that begin with `FIG. ` or `FIGS. `, in order."""
    return F.array_distinct(F.filter(F.transform(paragraphs, normalized), lambda p: p.rlike(FIGURE_LABEL)))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 80, "high").when(confidence >= 50, "medium").otherwise("low")


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")


def strict_filename(name: Column) -> Column:
    """The name if it is one plain component, else null: no path, no drive, no `..`."""
    plain = F.trim(name)
    return F.when((plain != "") & ~plain.rlike(r"^[A-Za-z]:|[/\\]|^\.{1,2}$|\x00"), plain)


def disposition_filename(header: Column) -> Column:
    return F.nullif(F.regexp_extract(header, r"(?i)filename\*?=(?:UTF-8'')?\"?([^\";]+)\"?", 1), F.lit(""))


def first_filled(*values: Column) -> Column:
    """First value that is neither null nor blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))

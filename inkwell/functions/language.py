"""Language of recognised text by label, script and Latin markers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import SPACE, occurrences

# Labels and the recogniser's codes they stand for.
ALIASES = {
    "ar": "ar", "ara": "ar", "arabic": "ar", "de": "de", "deu": "de", "ger": "de", "german": "de", "en": "en", "eng": "en", "english": "en",
    "es": "es", "spa": "es", "spanish": "es", "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "ja": "japan", "jpn": "japan", "japan": "japan",
    "japanese": "japan", "ko": "korean", "kor": "korean", "korean": "korean", "pt": "pt", "por": "pt", "portuguese": "pt", "ru": "ru", "rus": "ru",
    "russian": "ru", "zh": "ch", "zho": "ch", "chi": "ch", "chi_sim": "ch", "ch": "ch", "chinese": "ch",
}
# Codes of the Tesseract engine.
TESSERACT = {"ar": "ara", "ch": "chi_sim", "de": "deu", "en": "eng", "es": "spa", "fr": "fra", "japan": "jpn", "korean": "kor", "pt": "por", "ru": "rus"}
# Markers of Latin languages; ties go to the first language.
MARKERS = {
    "de": [" der ", " die ", " das ", " und ", " anspruch", "beschreibung", "ä", "ö", "ü", "ß"],
    "fr": [" le ", " la ", " les ", " et ", " revendication", "abrégé", "é", "è", "à", "ç"],
    "es": [" el ", " la ", " los ", " y ", " reivindicación", "descripción", "ñ", "¿"],
    "pt": [" o ", " a ", " os ", " e ", " reivindicação", "descrição", "ã", "õ"],
    "en": [" the ", " and ", " claim", " abstract", " invention ", " wherein "],
}
# Scripts in the order in which they decide.
SCRIPTS = [
    ("japan", r"[\x{3040}-\x{30ff}]"), ("korean", r"[\x{ac00}-\x{d7af}]"), ("ch", r"[\x{3400}-\x{9fff}]"), ("ar", r"[\x{0600}-\x{06ff}]"), ("ru", r"[\x{0400}-\x{04ff}]"),
]
SAMPLE = 20_000  # characters that decide, as the standard has it


def _default_code(default: str | Column | None) -> Column:
    if default is None:
        return F.lit(None).cast("string")
    if isinstance(default, str):
        return F.lit(ALIASES.get(default, "en"))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), default), F.lit("en"))


def label_code(label: Column, default: str | Column | None = "en") -> Column:
    """The recogniser's code of a label, with or without region; that of `default` for others."""
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    plain = F.replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), F.lit("-"), F.lit("_"))
    return F.coalesce(F.element_at(table, plain), F.element_at(table, F.split_part(plain, F.lit("_"), F.lit(1))), _default_code(default))


def tesseract_code(label: Column, default: str = "eng") -> Column:
    table = F.create_map(*[F.lit(x) for kv in TESSERACT.items() for x in kv])
    return F.coalesce(F.element_at(table, label_code(label, default)), F.lit(default))


def sample_of(text: Column) -> Column:
    one = F.trim(F.regexp_replace(F.lower(text), rf"{SPACE}+", " "))
    return F.concat(F.lit(" "), F.substring(one, 1, SAMPLE), F.lit(" "))


def scores_of(sample: Column) -> dict[str, Column]:
    return {lang: sum((occurrences(sample, m) for m in marks), F.lit(0).cast("bigint")) for lang, marks in MARKERS.items()}


def code_from(sample: Column, scores: dict[str, Column], default: str | Column | None = "en") -> Column:
    best = F.greatest(*scores.values())
    out = _default_code(default)
    for lang in reversed(list(scores)):
        out = F.when((best > 0) & (scores[lang] == best), lang).otherwise(out)
    for code, pattern in reversed(SCRIPTS):
        out = F.when(sample.rlike(pattern), code).otherwise(out)
    return out


def detected_code(text: Column, hint: Column | None = None, default: str | Column | None = "en") -> Column:
    """The recogniser's code of a text: that of the hint if there is one, else by script, else
    by markers, else the default (null, if that is None)."""
    sample = sample_of(F.coalesce(text, F.lit("")))
    found = code_from(sample, scores_of(sample), default)
    return found if hint is None else F.when(F.coalesce(F.trim(hint), F.lit("")) != "", label_code(hint, default)).otherwise(found)

"""Text that looks alike brought to one form, so that strings which look alike compare equal.

Each Arrow batch of a partition is handed to an embedded DuckDB, whose SQL maps it in this
order: invisible characters are removed, kinds of space and hyphen become one, compatibility
forms (full and half width, ligatures, letter variants) are replaced, the text is composed
(`nfc_normalize`), look-alike letters of other scripts are replaced (`translate`), and the
text is composed again and trimmed. Nothing is collected and no shuffle is needed.

Case, missing accents and added punctuation do change the look and are kept. Defined results:
null stays null; empty text and text of invisible characters only give an empty string;
texts may be of any length; columns of the input keep their names and values.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.session import cut

# Letters of other scripts that look like a Latin letter, and that letter.
LOOK_ALIKES = {
    # Cyrillic, upper and lower case
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "у": "y", "ү": "y", "ԝ": "w", "х": "x", "ӏ": "l",
    # Greek, upper and lower case
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϲ": "c", "Ϲ": "C", "ϳ": "j",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϝ": "f", "Ϝ": "F", "Ϳ": "J",
    # Armenian and Cherokee
    "Օ": "O", "օ": "o", "Ս": "U", "ս": "u", "Տ": "S", "Լ": "L", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "ա": "w", "յ": "j",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮞ": "4", "Ꮟ": "b",
    "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Latin letters of another shape or use
    "ı": "i", "ɑ": "a", "ɡ": "g",
}

# Characters without any look, kinds of space, kinds of hyphen (RE2 classes).
INVISIBLE = (
    r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}"
    r"\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}]"
)
SPACES = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
HYPHENS = r"[\x{2010}-\x{2013}\x{2043}\x{2212}\x{FE58}\x{FE63}\x{FF0D}]"


@cache
def _compatibility() -> tuple[dict[str, str], dict[str, str]]:
    """From the character database: compatibility forms of one and of several characters."""
    single, several = {}, {}
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x20000)]:
        c = chr(code)
        tag = unicodedata.decomposition(c).partition(" ")[0]
        letter = unicodedata.category(c)[0] in "LN"
        if tag in ("<wide>", "<narrow>") or (tag in ("<compat>", "<font>") and letter and not 0xFC00 <= code < 0x10000):
            to = unicodedata.normalize("NFKC", c)
            if unicodedata.category(c) == "Zs" or not to.strip():
                continue
            if len(to) == 1:
                single[c] = to
            elif code in range(0xFB00, 0xFB07) or code in range(0x2160, 0x2180):
                several[c] = to
    return single, several


@cache
def _look_alikes() -> dict[str, str]:
    """LOOK_ALIKES with the accented letters that are built on them."""
    out = dict(LOOK_ALIKES)
    for code in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in LOOK_ALIKES:
            to = unicodedata.normalize("NFC", LOOK_ALIKES[parts[0]] + parts[1:])
            if len(to) == 1:
                out[chr(code)] = to
    return out


def canonical_sql(column: str) -> str:
    """The SQL expression (DuckDB) that brings `column` to its canonical form."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def translated(x: str, table: dict[str, str]) -> str:
        return f"translate({x}, {quoted(''.join(table))}, {quoted(''.join(table.values()))})"

    single, several = _compatibility()
    x = f"regexp_replace({column}, '{INVISIBLE}', '', 'g')"
    x = f"regexp_replace({x}, '{HYPHENS}', '-', 'g')"
    for c, to in several.items():
        x = f"replace({x}, {quoted(c)}, {quoted(to)})"
    x = f"nfc_normalize({translated(x, single)})"
    x = f"nfc_normalize({translated(x, _look_alikes())})"
    return f"trim(regexp_replace({x}, '{SPACES}', ' ', 'g'))"


def with_canonical(df: DataFrame, column: str, name: str) -> DataFrame:
    """`df` with the text column `name`, the canonical form of `column`."""
    if name in df.columns:
        df = df.drop(name)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])
    sql = canonical_sql('"' + column.replace('"', '""') + '"')

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        con.execute("SET preserve_insertion_order = true")
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                con.register("part", pa.table({column: batch.column(column)}))
                done = con.sql(f"SELECT {sql} AS form FROM part").to_arrow_table()
                con.unregister("part")
                form = pa.concat_arrays([c.cast(pa.string()) for c in done.column(0).chunks])
                yield pa.RecordBatch.from_arrays([*batch.columns, form], names=[*batch.schema.names, name])
        finally:
            con.close()

    return df.mapInArrow(run, schema)


def same_look_pairs(values: DataFrame) -> DataFrame:
    """`values` has field, id, text. Rows (field, id_a, id_b), id_a < id_b, of values whose
    texts look the same but differ in code points.

    Spellings are made distinct first and only looks with two or more spellings go on, so a
    text that stands in a third of all rows costs nothing unless it has a look-alike. Null and
    empty values are no case.
    """
    ids = values.select("field", "text", "id").filter("text is not null and text <> ''")
    # Each distinct spelling is brought to its form once.
    spellings = with_canonical(ids.select("field", "text").distinct(), "text", "look").filter("look <> ''")
    several = F.count("*").over(Window.partitionBy("field", "look")) > 1
    spellings = cut(spellings.withColumn("several", several).filter("several").select("field", "look", "text"))
    a, b = spellings.withColumnRenamed("text", "text_a"), spellings.withColumnRenamed("text", "text_b")
    pairs = a.join(b, ["field", "look"]).filter(F.col("text_a") < F.col("text_b"))
    left = pairs.join(ids.toDF("field", "text_a", "id_1"), ["field", "text_a"])
    both = left.join(ids.toDF("field", "text_b", "id_2"), ["field", "text_b"])
    return both.filter("id_1 <> id_2").select("field", F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b")).distinct()


def looks(values: DataFrame) -> DataFrame:
    """`values` has field, id, text. field, id, look_id (smallest id with that look), spellings
    (distinct texts of the look): one row for each value that looks like anything."""
    ids = values.select("field", "text", "id").filter("text is not null and text <> ''")
    forms = with_canonical(ids.groupBy("field", "text").agg(F.min("id").alias("first")), "text", "look").filter("look <> ''")
    forms = cut(forms)
    groups = forms.groupBy("field", "look").agg(F.min("first").alias("look_id"), F.count("*").alias("spellings"))
    named = forms.join(groups, ["field", "look"]).select("field", "text", "look_id", "spellings")
    return ids.join(named, ["field", "text"]).select("field", "id", "look_id", "spellings").distinct()


def stacked(responses: DataFrame, mentions: DataFrame) -> DataFrame:
    titles = responses.select(F.lit("title").alias("field"), F.col("response_id").alias("id"), F.col("title").alias("text"))
    return titles.unionByName(mentions.filter("field = 'applicants'").select("field", F.col("mention_id").alias("id"), F.col("name").alias("text")))


def found(responses: DataFrame, mentions: DataFrame) -> DataFrame:
    """Pairs of titles (by response_id) and of applicants (by mention_id) that look the same."""
    return same_look_pairs(stacked(responses, mentions))

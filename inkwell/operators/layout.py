"""Pages as tables of blocks and pictures: what of them is text, what is a drawing.

A reader of page files gives rows (file, page, block, y0, y1, height, text) and (file, page,
nth, width, height, page area, pixels); everything here is column expressions and one ordered
aggregate a page. Heights and areas are in the page's own units.

Defined results: blocks without text or place are left out; pages without blocks have empty
text; a picture without pixels or page area is none to be recognised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as tx

# Margins of a page that carry running matter, shares of a page that a drawing may
# take, width that a recogniser wants and how far it may be enlarged, brightness of ink.
MARGIN = 0.04
LEAST_SHARE, MOST_SHARE = 0.03, 0.85
WANTED_WIDTH, MOST_SCALE = 1600, 3
INK = 190


def page_text(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys and text: the blocks of a page that reach out of its margins, in their order."""
    inside = (F.col("y1") > F.col("height") * MARGIN) & (F.col("y0") < F.col("height") * (1 - MARGIN))
    line = F.when(inside & (F.trim("text") != ""), F.struct("block", F.trim("text").alias("text")))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda b: b["text"]), "\n").alias("text"))


def is_drawing(width: Column, height: Column, page_area: Column, pixels: Column, most_pixels: int) -> Column:
    """Whether a picture is worth recognising: neither an ornament nor the page itself, and not
    larger than the recogniser takes."""
    share = width * height / F.nullif(page_area, F.lit(0.0))
    return F.coalesce(share.between(LEAST_SHARE, MOST_SHARE) & (pixels > 0) & (pixels <= most_pixels), F.lit(False))


def scale(width: Column) -> Column:
    """How many times a picture is enlarged before it is recognised."""
    return F.least(F.lit(MOST_SCALE), F.greatest(F.lit(1), F.floor(F.lit(WANTED_WIDTH) / width).cast("int")))


def inked(pixels: Column) -> Column:
    """Grey values (array) as black (0) and white (255)."""
    return F.transform(pixels, lambda p: F.when(p > INK, 255).otherwise(0))


def figure_text(lines: DataFrame, keys: list[str], order: str, line: str = "line") -> DataFrame:
    """keys and figure_text: the lines of a page that read as text of a figure, in order."""
    kept = F.when(tx.figure_like(F.col(line)), F.struct(order, tx.collapsed(F.col(line)).alias("t")))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["t"]), " ").alias("figure_text"))


def after_cover(lines: DataFrame, file_key: str, page: str, has_abstract: str) -> DataFrame:
    """Lines without those of a first page that holds an abstract: that page is used up by it.
    has_abstract is a flag of the line's page."""
    first = F.min(page).over(Window.partitionBy(file_key))
    rows = lines.withColumn("_first", first)
    return rows.filter(~((F.col(page) == F.col("_first")) & F.coalesce(F.col(has_abstract), F.lit(False)))).drop("_first")


def new_text(recognised: DataFrame, on: str, page_text: str) -> DataFrame:
    """Recognised text (column `on`) that the page's own text does not hold already."""
    return recognised.filter(~(tx.containment(F.col(on), F.coalesce(F.col(page_text), F.lit(""))) >= 0.8))

"""Reading order and headings from the geometry of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

HEADING_RATIO = 1.25


def column_split(blocks: DataFrame) -> DataFrame:
    """(paper_id, page_no, split): the middle of the widest gap between left edges, null for a page of one column.

    Two columns: at least four blocks, a gap of a quarter of the span, two blocks on each side.
    """
    page = ["paper_id", "page_no"]
    order = Window.partitionBy(*page).orderBy("x0")
    edges = blocks.select(*page, "x0", F.lead("x0").over(order).alias("next"), F.row_number().over(order).alias("k"))
    widest = F.max(F.when(F.col("next").isNotNull(), F.struct((F.col("next") - F.col("x0")).alias("gap"), (-F.col("k")).alias("first"), "x0", "next")))
    pages = edges.groupBy(*page).agg(widest.alias("g"), F.count("*").alias("n"), (F.max("x0") - F.min("x0")).alias("span"))
    left = -F.col("g.first")
    two = (F.col("n") >= 4) & (F.col("span") > 0) & (F.col("g.gap") >= F.col("span") * 0.25) & (left >= 2) & (F.col("n") - left >= 2)
    return pages.select(*page, F.when(two, (F.col("g.x0") + F.col("g.next")) / 2).alias("split"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Text blocks with ``ord``: down the left column, then down the right; without columns, down the page."""
    page = ["paper_id", "page_no"]
    text = blocks.where((F.col("block_type") == 0) & (strip(F.col("text")) != ""))
    placed = text.join(column_split(text), page, "left").withColumn("col", F.when(F.col("x0") >= F.col("split"), 1).otherwise(0))
    order = Window.partitionBy(*page).orderBy("col", F.bround("y0", 1), "x0")
    return placed.withColumn("ord", F.row_number().over(order)).drop("split")


def page_texts(blocks: DataFrame) -> DataFrame:
    """(paper_id, page_no, text) from blocks in reading order."""
    gathered = reading_order(blocks).groupBy("paper_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("ord", strip(F.col("text")).alias("text")))).alias("all"))
    return gathered.select("paper_id", "page_no", F.array_join(F.transform("all", lambda s: s["text"]), "\n").alias("text"))


def font_headings(lines: DataFrame) -> DataFrame:
    """(paper_id, title, line_no): lines at least 1.25 times as large as the median line, of 3 to 100 characters, each once."""
    usual = lines.where(strip(F.col("text")) != "").withColumn("usual", F.median("size").over(Window.partitionBy("paper_id")))
    large = usual.where((F.col("size") >= F.col("usual") * HEADING_RATIO) & F.length(strip(F.col("text"))).between(3, 100))
    return large.groupBy("paper_id", strip(F.col("text")).alias("title")).agg(F.min("line_no").alias("line_no"))


def better_extraction(variants: DataFrame, min_quality: float) -> DataFrame:
    """Of each page's variants (engine 0 or 1, text, quality) the first engine's, or the second's if it is strictly better and the first is poor."""
    best = F.max_by(F.struct("engine", "text", "quality"), F.struct(F.when((F.col("engine") == 1) & (F.col("first") >= min_quality), F.lit(-1.0)).otherwise(F.col("quality")), -F.col("engine")))
    first = F.max(F.when(F.col("engine") == 0, F.col("quality"))).over(Window.partitionBy("page_id"))
    return variants.withColumn("first", first).groupBy("page_id").agg(best.alias("b")).select("page_id", "b.engine", "b.text", "b.quality")

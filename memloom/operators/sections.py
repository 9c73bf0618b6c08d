"""Markdown files to sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions.text import is_blank, line_count, trim, unix_text


def split_sections(files: DataFrame, whole_files: bool = True) -> DataFrame:
    """Sections of each file, one row per section.

    ``files`` needs ``content``; its other columns are kept.  Adds ``section_index``,
    ``heading``, ``content``, ``line_start`` and ``line_end``.  A line starting with
    ``## `` opens a section; text before the first one is a section only if not blank.
    With ``whole_files``, a file whose path contains ``active-context`` is one section
    with its content verbatim.

    Both cuts are made inside the row: the text is split at its heading lines, and the
    line numbers of the headings come from a second pass over its lines.  Nothing is
    shuffled and nothing is grouped.
    """
    keep = [c for c in files.columns if c != "content"]
    whole = (
        F.lower(F.col("path")).contains("active-context") if whole_files else F.lit(False)
    )
    texts = files.select(
        *keep, "content", whole.alias("_whole"), unix_text(F.col("content")).alias("_text")
    ).where(~is_blank(F.col("content")))
    heading_lines = F.array_compact(
        F.transform(F.split("_text", "\n"), lambda line, i: F.when(line.startswith("## "), i))
    )
    starts = F.when(F.col("_text").startswith("## "), heading_lines).otherwise(
        F.concat(F.array(F.lit(0)), heading_lines)
    )
    blocks = F.split("_text", r"(?md)^(?=## )")
    cut = texts.select(
        *keep,
        "_whole",
        F.when(F.col("_whole"), line_count(F.col("_text"))).alias("_lines"),
        F.when(F.col("_whole"), F.array("content")).otherwise(blocks).alias("_blocks"),
        F.when(F.col("_whole"), F.array(F.lit(0))).otherwise(starts).alias("_starts"),
    )
    blank_lead = is_blank(F.try_element_at("_blocks", F.lit(1)))
    pieces = cut.select(
        *keep, "_whole", "_lines",
        F.size("_blocks").alias("_n"),
        blank_lead.alias("_blank_lead"),
        F.posexplode(F.arrays_zip("_blocks", "_starts")).alias("_i", "_piece"),
    )
    block = F.col("_piece._blocks")
    last = F.col("_whole") | (F.col("_i") == F.col("_n") - 1)
    body = F.when(last, block).otherwise(F.expr("left(_piece._blocks, length(_piece._blocks) - 1)"))
    is_section = block.startswith("## ") & ~F.col("_whole")
    head = F.regexp_replace(F.substring_index(block, "\n", 1), r"\A(## )+", "")
    out = pieces.where(~is_blank(block)).select(
        *keep,
        (F.col("_i") - F.col("_blank_lead").cast("int")).cast("bigint").alias("section_index"),
        F.when(is_section, trim(head)).alias("heading"),
        body.alias("content"),
        (F.col("_piece._starts") + 1).cast("bigint").alias("line_start"),
        F.col("_whole"), F.col("_lines"),
    )
    lines = F.when(F.col("_whole"), F.col("_lines")).otherwise(line_count(F.col("content")))
    return out.withColumn(
        "line_end", (F.col("line_start") + lines - 1).cast("bigint")
    ).drop("_whole", "_lines")

"""Classification of note files and tags found in their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.text import is_blank, trim

_IMPORTANCE = r"(?U)\[(\w+)\|i=([\d.]+)\]"


def daily_date(path: Column) -> Column:
    """Date of ``memory/<date>.md``; null for other files and impossible dates."""
    part = r"\Amemory/(\d{4}-\d{1,2}-\d{1,2})\.md\z"
    return F.regexp_extract(F.lower(path), part, 1).try_cast("date")


def _is_policy(lower: Column) -> Column:
    return lower.contains("gating-policies") | lower.contains("gating_policies")


def memory_type(path: Column) -> Column:
    """Memory type by path, first match."""
    p = F.lower(path)
    return (
        F.when(daily_date(path).isNotNull(), "episodic")
        .when(p == "memory.md", "semantic")
        .when(p.contains("active-context"), "summary")
        .when(_is_policy(p), "procedural")
        .otherwise("semantic")
    )


def namespace(path: Column) -> Column:
    """Namespace by path, first match; project files come before policy files (T4)."""
    p = F.lower(path)
    return (
        F.when(daily_date(path).isNotNull(), "daily")
        .when(p == "memory.md", "curated")
        .when(p.contains("active-context"), "active-context")
        .when(p.startswith("memory/project-"), "project")
        .when(_is_policy(p), "procedural")
        .otherwise("workspace")
    )


def extraction_method(path: Column) -> Column:
    """User-written files by path, hyphenated policy files only (T5)."""
    p = F.lower(path)
    return F.when((p == "memory.md") | p.contains("gating-policies"), "user_authored").otherwise(
        "agent_written"
    )


def importance_tag(line: Column) -> Column:
    """``struct<tag,score>`` of the first ``[word|i=number]``, null if none parses."""
    score = F.regexp_extract(line, _IMPORTANCE, 2).try_cast("double")
    return F.when(
        score.isNotNull(),
        F.struct(F.regexp_extract(line, _IMPORTANCE, 1).alias("tag"), score.alias("score")),
    )


def hashtags(line: Column) -> Column:
    """Hashtags of a line in order, duplicates kept."""
    words = F.filter(F.split(line, r"(?U)\s+"), lambda w: w.startswith("#"))
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"\A#+|[^\p{IsAlphabetic}\p{N}]+\z", ""))
    return F.filter(bare, lambda w: w != "")


def section_tags(content: Column, category: Column) -> Column:
    """``struct<tags,confidence,category>`` of a section.

    Tags are the file category, then per line its importance tag and hashtags, each
    kept where first seen; confidence is the highest score, category the first tag.
    """
    per_line = F.transform(
        F.split(content, "\n"),
        lambda line: F.struct(importance_tag(line).alias("own"), hashtags(line).alias("hash")),
    )

    def collect(found: Column) -> Column:
        scored = F.filter(F.transform(found, lambda x: x["own"]), lambda o: o.isNotNull())
        tags = F.transform(
            found, lambda x: F.concat(F.array_compact(F.array(x["own"]["tag"])), x["hash"])
        )
        return F.struct(
            F.array_distinct(F.concat(F.array(category), F.flatten(tags))).alias("tags"),
            F.array_max(F.transform(scored, lambda s: s["score"])).alias("confidence"),
            F.try_element_at(scored, F.lit(1))["tag"].alias("category"),
        )

    # a one-element list stands in for a variable, so each line is matched once
    return F.transform(F.array(per_line), collect)[0]


def archive_file_class(path: Column) -> Column:
    """``struct<memory_type,namespace,status,observed_on>`` of a dated/session/other file."""
    name = F.regexp_replace(F.regexp_replace(path, r"\A(memory/)+", ""), r"\A(archive/)+", "")
    dated = r"(?U)\A(\d{4}-\d{2}-\d{2})\.md\z"
    is_daily = name.rlike(dated)
    is_session = name.startswith("session_")
    return F.struct(
        F.when(is_daily | is_session, "episodic").otherwise("semantic").alias("memory_type"),
        F.when(is_daily, "daily").when(is_session, "session").otherwise("memory").alias("namespace"),
        F.when(path.contains("archive/"), "archived").otherwise("active").alias("status"),
        F.regexp_extract(name, dated, 1).try_cast("date").alias("observed_on"),
    )


def category_class(category: Column) -> Column:
    """``struct<memory_type,namespace>`` of a table category."""
    c = F.lower(category)
    return F.struct(
        F.when(c.isin("daily", "conversation"), "episodic").otherwise("semantic").alias("memory_type"),
        F.when(c.isin("core", "daily", "conversation"), c)
        .when(c.startswith("custom:"), c)
        .otherwise(F.concat(F.lit("custom:"), c))
        .alias("namespace"),
    )


def timezone(text: Column, runtime: str) -> Column:
    """Time zone named under the time-zone heading of a profile.

    The text is cut at its ``## `` lines, so only the blocks under a matching heading
    are searched.
    """
    trimmed = F.array_join(F.transform(F.split(text, "\n"), trim), "\n")
    blocks = F.split(trimmed, r"(?md)^(?=## )")
    head = lambda block: F.substring_index(block, "\n", 1)
    if runtime == "openclaw":
        wanted = lambda block: (
            F.lower(trim(F.regexp_replace(head(block), r"\A(## )+", ""))) == "timezone"
        ) & block.startswith("## ")
        pick = lambda line: F.when(
            line.contains("/") & ~line.startswith("-") & ~line.startswith("#"), line
        )
    else:
        wanted = lambda block: block.startswith("## ") & (
            F.lower(head(block)).contains("timezone") | F.lower(head(block)).contains("time zone")
        )
        pick = lambda line: F.try_element_at(
            F.filter(F.split(line, r"(?U)\s+"), lambda w: w.contains("/")), F.lit(1)
        )
    body = lambda block: F.slice(F.split(block, "\n"), 2, F.length(block) + 1)
    hits = F.transform(F.flatten(F.transform(F.filter(blocks, wanted), body)), pick)
    return F.try_element_at(F.array_compact(hits), F.lit(1))


def non_blank(text: Column) -> Column:
    """The text, or null when it is blank."""
    return F.when(~is_blank(text), text)

"""Settings files: key/value rows, secret names and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.text import lines, strip, trim
from memloom.schemas import REDACTED

# Name parts that mark a secret
SECRET_NAME_PARTS = ("api_key", "bot_token", "token", "secret", "access_token", "password")


def is_secret_name(name: Column) -> Column:
    lower = F.lower(name)
    hit = F.lit(False)
    for part in SECRET_NAME_PARTS:
        hit = hit | lower.contains(part)
    return hit


def credential_type(name: Column) -> Column:
    """Kind of secret by its field name."""
    lower = F.lower(name)
    return (
        F.when(lower.contains("token"), "oauth_token")
        .when(lower.contains("key"), "api_key")
        .otherwise("secret")
    )


def redact(text: Column) -> Column:
    """Replace the value of every ``name = value`` line whose name looks secret.

    Works line by line on any text; every line of the result ends in a line feed.
    """

    def one(line: Column) -> Column:
        key = F.regexp_replace(trim(F.substring_index(line, "=", 1)), r'\A"+|"+\z', "")
        return F.when(
            line.contains("=") & is_secret_name(key),
            F.concat(F.substring_index(line, "=", 1), F.lit(f'= "{REDACTED}"')),
        ).otherwise(line)

    out = F.transform(lines(text), lambda line: F.concat(one(line), F.lit("\n")))
    return F.array_join(out, "")


def _value(raw: Column) -> Column:
    """``struct<value,is_string>`` of the right-hand side of a setting."""
    basic = r'\A"((?:[^"\\]|\\.)*)"'
    literal = r"\A'([^']*)'"
    quoted = raw.startswith('"') | raw.startswith("'")
    plain = strip(F.regexp_replace(raw, r"#.*\z", ""))
    text = (
        F.when(~quoted, plain)
        .when(
            raw.rlike(basic),
            F.regexp_replace(
                F.regexp_replace(F.regexp_extract(raw, basic, 1), r'\\"', '"'), r"\\\\", r"\\"
            ),
        )
        .when(raw.rlike(literal), F.regexp_extract(raw, literal, 1))
        .otherwise(plain)
    )
    return F.struct(text.alias("value"), quoted.alias("is_string"))


def settings(text: Column) -> Column:
    """``array<struct<section,key,value,is_string>>`` of a settings file.

    One-line values under ``[section]`` headers; multi-line strings and inline tables
    are left out.  What is used more than once is bound by a ``transform`` of its own, as
    nothing is shared inside one.
    """
    trimmed = F.array_join(
        F.filter(F.transform(F.split(text, "\n"), strip), lambda line: ~line.startswith("#")), "\n"
    )
    header = r'\A\[\s*([^\]]*?)\s*\]'

    def block(text: Column) -> Column:
        pairs = F.filter(F.split(text, "\n"), lambda line: line.contains("=") & ~line.startswith("["))
        return F.struct(
            F.replace(F.regexp_extract(text, header, 1), F.lit('"'), F.lit("")).alias("section"),
            F.transform(pairs, lambda line: F.struct(
                strip(F.substring_index(line, "=", 1)).alias("key"),
                strip(F.substr(line, F.locate("=", line) + 1)).alias("raw"),
            )).alias("pairs"),
        )

    def row(section: Column, pair: Column) -> Column:
        value = _value(pair["raw"])
        return F.struct(
            section.alias("section"),
            F.regexp_replace(pair["key"], r"\A[\"']|[\"']\z", "").alias("key"),
            value["value"].alias("value"),
            value["is_string"].alias("is_string"),
        )

    blocks = F.transform(F.split(trimmed, r"(?md)^(?=\[)"), block)
    return F.flatten(F.transform(blocks, lambda b: F.transform(b["pairs"], lambda p: row(b["section"], p))))

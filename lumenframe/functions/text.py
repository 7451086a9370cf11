"""Identifier scrubbing and the leak gate, as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked

MONTHS = "JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC"
LOOSE_DATE = rf"(?i)\b(?:\d{{1,2}}\s+(?:{MONTHS})[A-Z]*|(?:{MONTHS})[A-Z]*\s+\d{{1,2}})(?:\s*,?\s*\d{{4}})?\b"

#: Kinds of identifiers that must not leave, with their patterns (groups are not captured).
LEAKS = {
    "address": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "ticket": r"\b[A-Z]{2}-\d{4,6}\b",
    "dated": r"\b\d{4}-\d{2}-\d{2}\b",
    "order": r"\b\d{3}-\d{2}-\d{4}\b",
}


def identity_codes(tokens: DataFrame, kind: str, prefix: str, width: int) -> DataFrame:
    """(kind, token, code): each distinct token with a code numbered in sorted order (numbers by value), not by first sight.

    Numbers go by value and then by spelling. Null and blank tokens get none.
    """
    t = tokens.select(F.trim("token").alias("token")).where("token <> ''").distinct()
    order = [F.expr("try_cast(token as decimal(38,0))").asc_nulls_last(), F.col("token").asc()]
    place = F.lpad(F.col("place").cast("string"), width, "0")
    return ranked(t, [], order).select(F.lit(kind).alias("kind"), "token", F.concat(F.lit(prefix), place).alias("code"))


def scrub(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Apply (pattern, code) rules, longest pattern first, then replace loose dates by 'date'. Scrubbing twice changes nothing more."""
    for pattern, code in sorted(rules, key=lambda r: -len(r[0])):
        text = F.regexp_replace(text, pattern, code)
    return F.regexp_replace(text, LOOSE_DATE, "date")


def leaks(docs: DataFrame, id_col: str, text_col: str, patterns: dict[str, str] = LEAKS, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(id, kind, line_no, token): each distinct hit of each pattern, line by line; allowed tokens (case and blanks apart) are none."""
    lines = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    hits = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("line", F.lit(p), F.lit(0)).alias("t")) for k, p in patterns.items()])
    x = lines.select("id", (F.col("n") + 1).alias("line_no"), F.explode(hits).alias("h")).select("id", "line_no", "h.kind", F.explode("h.t").alias("token"))
    if allowed:
        x = x.where(~F.replace(F.lower(F.trim("token")), F.lit(" "), F.lit("_")).isin(*allowed))
    return x.distinct()


def word_count(text: Column) -> Column:
    """Words that hold a letter or digit, after comments, commands and markup signs are taken off."""
    t = F.regexp_replace(text, r"(?m)^\s*%.*$", " ")
    t = F.regexp_replace(t, r"\\[A-Za-z@]+\*?", " ")
    t = F.regexp_replace(t, r"[{}$&_^~\\\[\]]", " ")
    return F.size(F.filter(F.split(t, r"\s+"), lambda w: w.rlike("[A-Za-z0-9]")))


def fixed(x: Column, digits: int) -> Column:
    """The number with fixed decimals, '--' where there is none."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x)).otherwise(F.lit("--"))

"""Evaluation: scenarios, metrics of drafted text, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X


def scenarios(base: DataFrame, variants: DataFrame, key: str, order: str, variant_order: str) -> DataFrame:
    """Every base case with every variant: case_id <key>-<1..>, reference <KEY>-<01..>. Both are small stated sets."""
    numbered = variants.withColumn("variant", F.row_number().over(Window.orderBy(variant_order)))
    out = base.crossJoin(numbered)
    return out.withColumn("case_id", F.concat(F.col(key), F.lit("-"), "variant")).withColumn("reference", F.concat(F.upper(key), F.lit("-"), F.lpad(F.col("variant").cast("string"), 2, "0")))


# Sections that a letter should have; only the first pattern minds case.
SECTIONS = (
    ("header", r"(RE:|Re:|Subject:|Dear)"), ("denial_quoted", r"(?i)(denial|denied|reason)"), ("clinical_summary", r"(?i)(clinical|history|present illness)"),
    ("criterion_mapping", r"(?i)(criterion|criteria|guideline|requirement)"), ("rebuttal", r"(?i)(rebut|address|contrary|however|respectfully)"), ("closing", r"(?i)(reconsider|sincerely|respectfully|request)"),
)


def structure(text: Column | str, sections: tuple[tuple[str, str], ...] = SECTIONS) -> Column:
    """score (share of sections present) and passed (all)."""
    n = sum((X.col(text).rlike(p).cast("int") for _, p in sections), F.lit(0))
    return F.struct((n / len(sections)).alias("score"), (n == len(sections)).alias("passed"))


def citations_present(text: Column | str, expected: Column) -> Column:
    found = F.size(F.array_distinct(X.all_matches(text, r"\[(\d+)\]", 1)))
    return F.struct(found.alias("found"), ((found > 0) & (found >= expected * 0.5)).alias("passed"))


def word_coverage(reason: Column | str, text: Column | str, longer_than: int = 4, least: float = 0.3) -> Column:
    """Share of the reason's long words (repeats count) that stand in the text, rounded half to even; whether it is enough."""
    words = F.filter(F.split(F.lower(X.col(reason)), X.BLANK), lambda w: F.length(w) > longer_than)
    share = F.size(F.filter(words, lambda w: F.contains(F.lower(X.col(text)), w))) / F.greatest(F.size(words), F.lit(1))
    return F.struct(F.bround(share, 2).alias("coverage"), (share >= least).alias("passed"))


def unknown_references(text: Column | str, titles: Column, pattern: str = r"(?:CMS |LCD |NCCN |NCD )\S+") -> Column:
    """References in the text that no known (lower-cased) title contains."""
    return F.filter(X.all_matches(text, pattern), lambda r: ~F.exists(titles, lambda t: F.contains(t, F.lower(F.trim(r)))))


def name_present(notes: Column | str, text: Column | str, pattern: str = r"PATIENT:\s*(.+)") -> Column:
    """Whether a part of the patient's name longer than two characters stands in the text; true without a name."""
    name = X.trimmed(F.regexp_extract(X.col(notes), pattern, 1))
    parts = F.filter(F.split(F.lower(name), X.BLANK), lambda p: F.length(p) > 2)
    return (name == "") | F.exists(parts, lambda p: F.contains(F.lower(X.col(text)), p))


def expected_found(expected: Column, found: Column) -> Column:
    return F.struct(F.array_sort(F.array_intersect(expected, found)).alias("hits"), F.arrays_overlap(expected, found).alias("passed"))


def missing_keys(expected: list[str], present: Column) -> Column:
    return F.array_except(F.array(*map(F.lit, expected)), present)


def tally(checks: DataFrame, passed: str, by: list[str] | None = None) -> DataFrame:
    return checks.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(passed).alias("passed"), F.count_if(~F.col(passed)).alias("failed"))

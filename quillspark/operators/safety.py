"""Checks of drafted text against its sources: placeholders, citations, quotes, numbers; verdicts; rewriting of drafts.

letters: key and a text column; sources: key, kind (case, policy or article) and text. Issues have the columns key, class_order, at,
code, severity, message and evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import profiles as P
from quillspark.functions import text as X

BRACKET = r"\[([^\]]+)\]"

# What an issue says, by code; {} is its evidence.
MESSAGES = {
    "UNRESOLVED_PLACEHOLDER": "Potential unresolved placeholder or unsupported bracketed text: {}",
    "INVALID_GUIDELINE_CITATION": "Guideline citation {} does not map to any retrieved guideline source.",
    "MISSING_GUIDELINE_CITATIONS": "Letter includes guideline context but does not cite any numbered guideline references.",
    "INVALID_PUBMED_CITATION": "PubMed citation {} does not map to any retrieved PubMed source.",
    "UNGROUNDED_QUOTE": "Quoted clinical, denial, or guideline text was not found verbatim in the supplied sources.",
    "UNGROUNDED_NUMERIC_CLAIM": "Numeric value in the letter was not found in the clinical notes, guidelines, denial reason, or PubMed context.",
}
# The checks of a verification, and what each says of a letter that passes.
CHECKS = {
    "PLACEHOLDER": ("Deterministic Placeholder Check", "No unresolved bracket placeholders were detected."),
    "CITATION": ("Deterministic Citation Check", "All numbered guideline and PubMed citations map to retrieved sources."),
    "UNGROUNDED": ("Deterministic Grounding Check", "Quoted and numeric claims were found in the supplied sources."),
}


def placeholders(text: Column | str, allowed: str = P.ALLOWED_BRACKET) -> Column:
    """The contents of brackets that are no citation or other allowed mark."""
    return F.filter(F.transform(X.all_matches(text, BRACKET, 1), lambda x: X.trimmed(x)), lambda x: ~x.rlike(allowed))


def found(order: int, code: str, severity: str, evidence: Column) -> Column:
    """An array of issues, one for each element of an array of evidence."""
    before, shown, after = MESSAGES[code].partition("{}")

    def issue(x: Column, at: Column) -> Column:
        message = F.concat(F.lit(before), x, F.lit(after)) if shown else F.lit(before)
        return F.struct(F.lit(order).alias("class_order"), at.cast("int").alias("at"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"), x.alias("evidence"))

    return F.transform(evidence, issue)


def placeholders_found(brackets: Column) -> Column:
    return found(0, "UNRESOLVED_PLACEHOLDER", "error", F.transform(brackets, lambda x: F.concat(F.lit("["), x, F.lit("]"))))


def citations_found(refs: Column, n: Column, order: int = 1, kind: str = "GUIDELINE", named: str | None = None) -> Column:
    """Citations outside 1..n of the case's n sources; for plain [n], also sources without any citation."""
    number = lambda x: x.try_cast("decimal(38,0)")
    bad = lambda x: number(x).isNull() | (number(x) < 1) | (number(x) > n)
    shown = lambda x: F.concat(F.lit(f"[{named} " if named else "["), F.coalesce(number(x).cast("string"), x), F.lit("]"))
    out = F.filter(found(order, f"INVALID_{kind}_CITATION", "error", F.transform(refs, lambda x: F.when(bad(x), shown(x)))), lambda i: i["evidence"].isNotNull())
    if named:
        return out
    none = found(order, f"MISSING_{kind}_CITATIONS", "warning", F.array(F.lit(None).cast("string")))
    return F.concat(out, F.filter(none, lambda _: (n > 0) & (F.size(refs) == 0)))


def placeholder_issues(letters: DataFrame, key: str, text: str, allowed: str = P.ALLOWED_BRACKET) -> DataFrame:
    return letters.select(key, F.inline(placeholders_found(placeholders(text, allowed))))


def citation_issues(letters: DataFrame, counts: DataFrame, key: str, text: str, order: int = 1, kind: str = "GUIDELINE", named: str | None = None) -> DataFrame:
    """citations_found() as rows. counts: key, n."""
    rows = letters.select(key, X.citations(text, named).alias("refs")).join(counts, key, "left")
    return rows.select(key, F.inline(citations_found(F.col("refs"), F.coalesce("n", F.lit(0)), order, kind, named)))


def held(claim: str, source: str) -> Column:
    """Whether a source holds a claim, word by word or in order within a window; both normalized."""
    return F.contains(F.col(source), F.col(claim)) | X.has_ordered_window(X.grounding_tokens(claim), X.grounding_tokens(source))


def ungrounded(claims: DataFrame, sources: DataFrame, key: str, claim: str, text: str) -> DataFrame:
    """Claims that no source of their key holds, word by word or in order within a window. An equi-join on the key, then the tests."""
    c = claims.withColumn("quill_claim", X.grounding_normalized(claim))
    s = sources.select(key, X.grounding_normalized(text).alias("quill_source"))
    real = c.where("quill_claim <> ''")
    met = real.join(s, key).where(held("quill_claim", "quill_source")).select(key, claim).distinct()
    return real.join(met, [key, claim], "left_anti").drop("quill_claim")


def check_letters(letters: DataFrame, sources: DataFrame, key: str, text: str, kind: str = "kind", source_text: str = "source_text") -> tuple[DataFrame, DataFrame]:
    """(issues, reports): reports have the verdict, five checks and the issues in order for every letter (one row a key), also those without issues.

    A letter is read once, in place: what is shuffled is what its checks found, and claims meet the sources of their key.
    """
    quotes = F.filter(X.quotes(text), lambda q: X.needs_grounding(q, P.HEADING_QUOTE, P.CLINICAL_CLAIM))
    read = letters.select(key, *(c.alias(f"quill_{n}") for n, c in {
        "brackets": placeholders(text), "refs": X.citations(text), "pubmed": X.citations(text, "PubMed"), "quotes": quotes, "numbers": X.numeric_facts(text, P.NUMERIC_FACT),
    }.items()))
    n_of = lambda k: F.count_if(F.col(kind) == k)
    read = read.join(sources.groupBy(key).agg(n_of("policy").alias("quill_policies"), n_of("article").alias("quill_articles")), key, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    issues = F.concat(
        placeholders_found(F.col("quill_brackets")),
        citations_found(F.col("quill_refs"), n("quill_policies")),
        citations_found(F.col("quill_pubmed"), n("quill_articles"), 2, "PUBMED", "PubMed"),
        found(3, "UNGROUNDED_QUOTE", "warning", F.col("quill_quotes")),
        found(4, "UNGROUNDED_NUMERIC_CLAIM", "warning", F.col("quill_numbers")),
    )
    rows = read.select(key, F.inline(issues))
    rows = rows.withColumn("quill_claim", X.grounding_normalized(F.when(F.startswith("code", F.lit("UNGROUNDED")), F.col("evidence"))))
    s = sources.select(F.col(key).alias("quill_key"), X.grounding_normalized(source_text).alias("quill_source"))
    pairs = rows.where("quill_claim is null or quill_claim <> ''").join(s, (F.col(key) == F.col("quill_key")) & F.col("quill_claim").isNotNull(), "left")
    met = F.bool_or(F.coalesce(held("quill_claim", "quill_source"), F.lit(False)))
    issues = pairs.groupBy(*(c for c in rows.columns if c != "quill_claim")).agg(met.alias("quill_met")).where("not quill_met").drop("quill_met")
    return issues, report(letters.select(key), issues, key)


def verdict(has_error: Column, has_warning: Column) -> Column:
    return F.when(has_error, "FAIL").when(has_warning, "NEEDS_REVIEW").otherwise("PASS")


def report(letters: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """A missing citation is a warning and leaves the citations valid; an invalid one doesn't."""
    absent = lambda pattern: F.coalesce(~F.bool_or(F.col("code").rlike(pattern)), F.lit(True))
    by_key = issues.groupBy(key).agg(
        verdict(F.bool_or(F.col("severity") == "error"), F.bool_or(F.col("severity") == "warning")).alias("verdict"),
        absent("UNRESOLVED_PLACEHOLDER").alias("placeholder_free"), absent("INVALID_GUIDELINE_CITATION").alias("guideline_citations_valid"), absent("PUBMED_CITATION").alias("pubmed_citations_valid"),
        absent("UNGROUNDED_QUOTE").alias("quotes_grounded"), absent("UNGROUNDED_NUMERIC").alias("numbers_grounded"),
        F.array_sort(F.collect_list(F.struct("class_order", "at", "code", "severity", "message", "evidence"))).alias("issues"),
    )
    flags = [c for c in by_key.columns if c not in (key, "verdict", "issues")]
    out = letters.join(by_key, key, "left").withColumn("verdict", F.coalesce("verdict", F.lit("PASS")))
    out = out.withColumns({c: F.coalesce(c, F.lit(True)) for c in flags})
    return out.withColumn("n_issues", F.coalesce(F.size("issues"), F.lit(0)))


def verification_checks() -> Column:
    """Three checks with status and details from a row of report(); the details of one that fails are its issues' messages, for claims with the evidence."""
    citations = F.col("guideline_citations_valid") & F.col("pubmed_citations_valid")
    grounded = F.col("quotes_grounded") & F.col("numbers_grounded")
    said = {"UNGROUNDED": lambda i: F.concat(i["message"], F.lit(" "), F.coalesce(i["evidence"], F.lit("")))}

    def check(part: str, ok: Column, bad: str) -> Column:
        name, good = CHECKS[part]
        own = F.filter("issues", lambda i: F.contains(i["code"], F.lit(part)))
        details = F.array_join(F.transform(own, said.get(part, lambda i: i["message"])), " ")
        return F.struct(F.lit(name).alias("check"), F.when(ok, "PASS").otherwise(bad).alias("status"), F.when(ok, good).otherwise(details).alias("details"))

    return F.array(check("PLACEHOLDER", F.col("placeholder_free"), "FAIL"), check("CITATION", citations, "FAIL"), check("UNGROUNDED", grounded, "WARNING"))


def merged_verdict(rules: Column | str, model: Column | str) -> Column:
    """A failure by rule wins; review by rule lowers a model's pass; else the model decides."""
    r, m = X.col(rules), X.col(model)
    return F.when(r == "FAIL", "FAIL").when((r == "NEEDS_REVIEW") & (m == "PASS"), "NEEDS_REVIEW").otherwise(m)


def merged_verification(model_checks: Column, rule_checks: Column, model_flags: Column, issues: Column) -> Column:
    """checks: the model's, then the rules'; flagged: the model's, then "code: evidence" of each issue; nulls count as empty."""
    kind = "array<struct<check: string, status: string, details: string>>"
    empty = lambda c, t: F.coalesce(c.cast(t), F.array().cast(t))
    named = F.transform(issues, lambda i: F.concat_ws(": ", i["code"], i["evidence"]))
    return F.struct(F.concat(empty(model_checks, kind), empty(rule_checks, kind)).alias("checks"), F.concat(empty(model_flags, "array<string>"), empty(named, "array<string>")).alias("flagged"))


def offline_verification(rules: Column | str) -> Column:
    """What a report is worth without a model: the verdict, and a confidence of 0.8 for a pass, else 0.6."""
    r = X.col(rules)
    return F.struct(r.alias("verdict"), F.when(r == "PASS", 0.8).otherwise(0.6).alias("confidence"))


def json_in_text(text: Column | str, schema: str) -> Column:
    """The object from the first { to the last } of free text, parsed; null if there is none."""
    return F.from_json(F.regexp_extract(X.col(text), r"(?s)\{.*\}", 0), schema)


# Rewrites of drafts, in order: source marks, section headings, gap headings and gap marks.
SOURCE_MARK = (r"\s*\[SOURCE [A-Z]\]", "")
SECTION_HEAD = r"(?im)^\s{0,3}(?:#{1,6}\s*)?(?:\*\*)?SECTION\s+\d+\s*[—\-:]\s*"
GAPS = (
    (r"(?im)^(\s{0,3}(?:#{1,6}\s*)?(?:\*\*)?)Documentation Gaps(?:\*\*)?\s*$", "$1Clinical Rationale for Exception"),
    (r"(?s)\[DOCUMENTATION GAP[.:]\s*(.*?)\]", "Additional supporting rationale: $1"),
    (r"\[DOCUMENTATION GAP\]\s*:\s*", "Additional supporting rationale: "),
    (r"\[DOCUMENTATION GAP[.:]\s*", "Additional supporting rationale: "),
)
REWRITES = (SOURCE_MARK, (SECTION_HEAD + r"(?:HEADER\s*&\s*IDENTIFICATION|PURPOSE)(?:\*\*)?\s*$", ""), (SECTION_HEAD, ""), *GAPS)
# Marks of style that a submitted letter loses.
STYLE_MARKS = ((r"\*\*(.*?)\*\*", "$1"), (r"\*(.*?)\*", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^---+\s*$", ""))


def for_submission(text: Column | str) -> Column:
    """The letter as it is submitted: without source, gap and style marks, at most one blank line, trimmed."""
    out = X.col(text)
    for pattern, to in (SOURCE_MARK, *GAPS, *STYLE_MARKS):
        out = F.regexp_replace(out, pattern, to)
    return X.trimmed(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def placeholder_pattern(hint: str = P.PLACEHOLDER_HINT) -> str:
    """One pattern for a placeholder bracket: not allowed, and with a hint word or capitals only."""
    words = hint.removeprefix("(?i)")
    return rf"\[(?!\s*(?i:\d+|PubMed\s+\d+|Reference\s+\d+|DOCUMENTATION GAP(?::|\s|\]).*)\s*\])(?:(?=[^\]]*(?i:{words})[^\]]*\])[^\]]+|\s*{P.PLACEHOLDER_CAPS}\s*)\]"


def sanitized(text: Column | str, rewrites: tuple[tuple[str, str], ...] = REWRITES, hint: str = P.PLACEHOLDER_HINT) -> Column:
    """The draft after the rewrites; lines whose brackets are all placeholders are emptied, from others only the placeholders go."""
    out = X.col(text)
    for pattern, to in rewrites:
        out = F.regexp_replace(out, pattern, to)
    mark = placeholder_pattern(hint)
    line = lambda x: F.when(x.rlike(r"\[[^\]]+\]") & ~F.regexp_replace(x, mark, "").rlike(r"\[[^\]]+\]"), F.lit("")).otherwise(F.regexp_replace(x, mark, ""))
    out = F.array_join(F.transform(F.split(out, r"\R"), line), "\n")
    return X.trimmed(F.regexp_replace(out, r"\n{3,}", "\n\n"))


# Headings and the beginnings of headings and bold lines in a letter.
HEADINGS = (
    "References", "Guidelines", "Literature", "Clinical Summary", "Criterion-by-Criterion Medical Necessity Argument", "Direct Rebuttal to Denial Reason",
    "Direct Denial Rebuttal", "Clinical Rationale for Exception", "Clinical Rationale for Step-Therapy Exception", "Additional Supporting Rationale",
    "Supporting Documentation", "Conclusion",
)
HEADING_STARTS = ("RE:", "Subject:")
BOLD_STARTS = ("Patient Name:", "Date of Birth:", "Member ID:", "CPT Code", "ICD-10", "Claim/", "Date of", "Denied Service:", "Physician:")


def line_array(text: Column | str) -> Column:
    """The submitted letter as structs of line and kind: blank, header, bullet (its mark dropped), numbered, bold or plain."""

    def placed(x: Column) -> Column:
        starts = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.startswith(x, w))
        kind = F.when(x == "", "blank").when(starts(HEADING_STARTS) | x.isin(*HEADINGS), "header").when(x.rlike(r"^[-*] "), "bullet")
        kind = kind.when(x.rlike(r"^\d+\.\s"), "numbered").when(starts(BOLD_STARTS), "bold").otherwise("plain")
        return F.struct(F.regexp_replace(x, r"^[-*] ", "").alias("line"), kind.alias("kind"))

    return F.transform(F.transform(F.split(for_submission(text), "\n"), lambda x: X.trimmed(x)), placed)


def lines(letters: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, line, kind: the lines of line_array() as rows."""
    return letters.select(key, F.posexplode(line_array(text)).alias("at", "quill_line")).select(key, "at", "quill_line.*")

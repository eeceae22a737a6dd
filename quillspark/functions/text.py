"""Text functions as Column builders. All but grounding_normalized(full=True) stay inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = r"[ \t\n\x0B\f\r]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without white space at both ends (SQL's trim takes spaces only)."""
    return F.regexp_replace(col(c), r"^[\s]+|[\s]+$", "")


def blank_to_null(c: Column | str) -> Column:
    return F.when(trimmed(c) != "", col(c))


def keyword_terms(c: Column | str, least: int = 3) -> Column:
    """Lower-cased words between white space of at least so many characters; repeats are kept."""
    return F.filter(F.split(F.lower(col(c)), BLANK), lambda t: F.length(t) >= least)


def analysis_tokens(c: Column | str, stop_words: tuple[str, ...], least: int = 4) -> Column:
    """Lower-cased runs of letters, digits and points that are long enough and no stop word; repeats are kept."""
    stop = F.array(*map(F.lit, stop_words))
    return F.filter(F.split(F.lower(col(c)), "[^a-z0-9.]+"), lambda t: (F.length(t) >= least) & ~F.array_contains(stop, t))


def relevance_tokens(c: Column | str, stop_words: tuple[str, ...], least: int = 4) -> Column:
    """Distinct lower-cased runs of letters and digits, in order, without stop words and plain numbers."""
    stop = F.array(*map(F.lit, stop_words))
    keep = lambda t: (F.length(t) >= least) & ~F.array_contains(stop, t) & ~t.rlike("^[0-9]+$")
    return F.array_distinct(F.filter(F.split(F.lower(col(c)), "[^a-z0-9]+"), keep))


def _nfkc(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def grounding_normalized(c: Column | str, full: bool = True) -> Column:
    """Text for comparison: NFKC, one kind of quotes and dashes, lower case, only letters, digits, % and /, single spaces.

    Only rows with non-ASCII characters go through Python for NFKC; full=False leaves it out.
    """
    c = col(c)
    if full:
        nfkc = F.arrow_udf(_nfkc, T.StringType())
        c = F.when(c.rlike(r"[^\x00-\x7F]"), nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)
    c = F.translate(c, "“”‘’–—−²³", "\"\"''---23")
    c = F.regexp_replace(F.lower(c), "&", " and ")
    return F.trim(F.regexp_replace(c, "[^a-z0-9%/]+", " "))


def grounding_tokens(normalized: Column | str) -> Column:
    """Tokens of normalized text that are longer than one character or hold a digit."""
    return F.filter(F.split(col(normalized), " "), lambda t: (F.length(t) > 1) | t.rlike("[0-9]"))


def has_ordered_window(quote: Column | str, source: Column | str) -> Column:
    """Whether at least four quote tokens stand in order, from a match of the first on, within their number plus slack source tokens."""
    q, s = col(quote), col(source)
    n = F.size(q)
    window = n + F.greatest(F.lit(6), F.floor((3 * n + 3) / 4).cast("int"))
    steps = lambda at: F.aggregate(F.slice(s, at, window), F.lit(0), lambda k, t: F.when((k < n) & (F.get(q, k) == t), k + 1).otherwise(k))
    found = F.exists(F.sequence(F.lit(1), F.size(s)), lambda at: (F.get(s, at - 1) == F.get(q, F.lit(0))) & (steps(at) == n))
    return F.when((n >= 4) & (F.size(s) >= n) & F.forall(q, lambda t: F.array_contains(s, t)), found).otherwise(F.lit(False))


def all_matches(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def numeric_facts(c: Column | str, pattern: str) -> Column:
    """Distinct dates and quantities, in order, but for bare numbers of one or two digits. Superscripts count as digits."""
    found = F.transform(all_matches(F.translate(col(c), "²³", "23"), pattern), lambda x: trimmed(x))
    return F.array_distinct(F.filter(found, lambda x: ~x.rlike("^[0-9]{1,2}$")))


def quotes(c: Column | str, least: int = 4, most: int = 240) -> Column:
    """Distinct texts between straight quotes, trimmed."""
    return F.array_distinct(F.transform(all_matches(c, f'"([^"]{{{least},{most}}})"', 1), lambda x: trimmed(x)))


def needs_grounding(quote: Column | str, heading: str, claim: str) -> Column:
    q = col(quote)
    return (F.length(q) >= 8) & ~q.rlike("(?i)^https?://") & ~q.rlike(heading) & q.rlike(claim)


def citations(c: Column | str, named: str | None = None) -> Column:
    """Distinct numbers in [n], unless "pubmed" ends within ten characters before; with named, in [named n]."""
    if named:
        return F.array_distinct(all_matches(c, rf"(?i)\[{named}\s+(\d+)\]", 1))
    # what stands before is looked at from a bracket on, not from every character
    return F.array_distinct(all_matches(c, r"(?is)\[(?<!pubmed.{0,4}\[)(\d+)\]", 1))


def code_key(c: Column | str) -> Column:
    """A code in upper case without points, hyphens and white space."""
    return F.regexp_replace(F.upper(col(c)), r"[.\-\s]", "")


def code_list(c: Column | str) -> Column:
    """The codes of a list separated by commas or semicolons."""
    return F.filter(F.transform(F.split(col(c), "[,;]"), lambda x: trimmed(x)), lambda x: x != "")


def once(c: Column | str, f: Callable[[Column], Column]) -> Column:
    """f of a column that is computed once, however often f names it: long expressions stay short."""
    return F.get(F.transform(F.array(col(c)), f), F.lit(0))


def first_given(values: list[Column]) -> Column:
    """The first value that is neither null nor empty; else null."""
    return F.get(F.filter(F.array(*values), lambda x: x != ""), F.lit(0))


def without_edges(c: Column | str) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(col(c), r"\*\*", ""), r"^[\s:,\-]+|[\s,;]+$", ""))


def cleaned(c: Column | str) -> Column:
    """Without double asterisks, marks and white space at the ends; null if nothing is left."""
    return first_given([without_edges(c)])


def first_match(c: Column | str, patterns: list[str]) -> Column:
    """The first capture that isn't blank once it is cleaned; else null."""
    return first_given([without_edges(F.regexp_extract(col(c), p, 1)) for p in patterns])


def section(c: Column | str, start: str, end: str | None = None) -> Column:
    """The text between two markers (patterns); without the end marker, to the end of the text."""
    return first_given([trimmed(F.regexp_extract(col(c), f"(?ism)(?:{start})(.*?)(?:{end + '|' if end else ''}\\z)", 1))])


def normalized_date(c: Column | str) -> Column:
    """The first d/m/y as MM/DD/YYYY (two-digit years are 20yy); text without one is unchanged."""
    pattern = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b"

    def written(x: Column) -> Column:
        month, day, year = (F.regexp_extract(x, pattern, k) for k in (1, 2, 3))
        whole = F.concat_ws("/", F.lpad(month, 2, "0"), F.lpad(day, 2, "0"), F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year))
        return F.when(x.rlike(pattern), whole).otherwise(x)

    return once(c, written)


def extracted_codes(c: Column | str, pattern: str, most: int = 12) -> Column:
    """The first distinct codes that match, joined by comma and space."""
    return F.array_join(F.slice(F.array_distinct(all_matches(c, pattern)), 1, most), ", ")


def whitespace_normalized(c: Column | str) -> Column:
    """No NULs, runs of spaces and tabs as one space, at most one blank line, trimmed."""
    c = F.regexp_replace(F.translate(col(c), "\x00", ""), r"[ \t]+", " ")
    return trimmed(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def first_label(c: Column | str, labels: tuple[tuple[str, str], ...], default: str) -> Column:
    """The label of the first pattern that matches."""
    out = F.lit(default)
    for label, pattern in reversed(labels):
        out = F.when(col(c).rlike(pattern), F.lit(label)).otherwise(out)
    return out


def ascii_only(c: Column | str) -> Column:
    return ~col(c).rlike(r"[^\x00-\x7F]")



"""Evidence: notes to spans, spans to criteria, gaps, and how sufficient a record is."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.functions import text as X
from quillspark.operators.search import in_blocks, ranked
from quillspark.profiles import MEDICAL, SPAN, SPAN_MARKS, SPAN_MOST, SPAN_RUN, Profile


#: Rows that a task sends on at a time.
ROWS_OUT = 20_000


def in_runs(profile: Profile) -> bool:
    return profile.span.removeprefix("(?d)") == SPAN.removeprefix("(?d)")


def span_matches(text: Column | str, profile: Profile = MEDICAL) -> Column:
    """All matches of the profile's span pattern; those of the usual one by whole runs, in time that grows with the text and not with its runs' length."""
    if not in_runs(profile):
        return X.all_matches(text, profile.span)
    last = lambda x: SPAN_MOST + F.when(F.contains(F.lit(SPAN_MARKS), F.right(x, F.lit(1))), 1).otherwise(0)
    return F.transform(X.all_matches(text, SPAN_RUN), lambda x: F.when(F.length(x) > SPAN_MOST, F.right(x, last(x))).otherwise(x))


def span_array(text: Column | str, profile: Profile = MEDICAL, limit: int = 80, offsets: bool = False) -> Column:
    """The pieces of text that may be evidence, in order, the first so many: texts, or structs with start and end of the untrimmed piece."""
    pieces = F.transform(span_matches(text, profile), lambda x: X.trimmed(x))
    holds = lambda x: (x != "") & x.rlike(profile.span_candidate)
    if not offsets:
        return F.slice(F.filter(pieces, holds), 1, limit)
    placed = F.zip_with(pieces, span_offsets(text, profile), lambda x, at: F.struct(x.alias("text"), at["start"].alias("start"), at["end"].alias("end")))
    return F.slice(F.filter(placed, lambda x: holds(x["text"])), 1, limit)


def spans(notes: DataFrame, key: str, text: str, profile: Profile = MEDICAL, limit: int = 80, offsets: bool = False) -> DataFrame:
    """key, span (from 1 over the kept ones), text, category (and start, end in code points): a note's evidence; nothing is shuffled."""
    pieces = notes.select(key, F.posexplode(span_array(text, profile, limit, offsets)).alias("at", "piece"))
    own = F.col("piece.text") if offsets else F.col("piece")
    rows = pieces.select(key, (F.col("at") + 1).alias("span"), own.alias("text"), *(["piece.start", "piece.end"] if offsets else []))
    return rows.withColumn("category", X.first_label("text", profile.categories, "other"))


def _offsets(profile: Profile):
    def find(text: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        runs = in_runs(profile)
        compiled = re.compile((SPAN_RUN if runs else profile.span).replace("(?d)", ""))

        def start(m: re.Match) -> int:
            return max(m.start(), m.end() - (m[0][-1] in SPAN_MARKS) - SPAN_MOST) if runs else m.start()

        return pa.array([[{"start": start(m), "end": m.end()} for m in compiled.finditer(t or "")] for t in text.to_pylist()], kind)

    return find


def span_offsets(text: Column | str, profile: Profile = MEDICAL) -> Column:
    """Where each piece of text stands, in code points (built-in functions give matches without positions)."""
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    return F.arrow_udf(_offsets(profile), kind)(text)


def touched(text: Column, side: int, profile: Profile = MEDICAL) -> Column:
    """A text's distinct tokens and, for each topic, whether it touches it as a criterion (side 1) or a span (side 2)."""
    topics = [text.rlike(t[side]) for t in profile.topics]
    return F.struct(F.array_distinct(X.analysis_tokens(text, profile.stop_words)).alias("tokens"), F.array(*topics).alias("topics"))


def overlap_score(criterion: Column, span: Column, profile: Profile = MEDICAL) -> Column:
    """Distinct tokens in common, plus points for each topic that both touch; both from touched()."""
    score = F.size(F.array_intersect(criterion["tokens"], span["tokens"]))
    for i, (points, *_) in enumerate(profile.topics):
        score = score + F.when(criterion["topics"][i] & span["topics"][i], points).otherwise(0)
    return score


def top_spans(criteria: DataFrame, found: DataFrame, on: list[str], criterion_key: list[str], profile: Profile = MEDICAL, k: int = 3, least: int = 2) -> DataFrame:
    """The k spans of its own key that overlap most with each criterion, ties in span order; criteria(text: criterion), found from spans().

    For a stated set of criteria that meets all notes see top_spans_of_all().
    """
    # tokens and topics of each side are found before the join, once a row and not once a pair
    criteria = criteria.withColumn("quill_c", touched(F.col("criterion"), 1, profile))
    found = found.withColumn("quill_s", touched(F.col("text"), 2, profile))
    pairs = criteria.join(found, on)
    scored = pairs.withColumn("score", overlap_score(F.col("quill_c"), F.col("quill_s"), profile)).where(F.col("score") >= least).drop("quill_c", "quill_s")
    return ranked(scored, criterion_key, [F.desc("score"), F.col("span")]).where(F.col("rank") <= k)


class Criteria:
    """A block of a stated set of criteria as matrices: tokens by criteria, and topics by criteria."""

    def __init__(self, keys: list, tokens: list[list[str]], topics: list[list[bool]], profile: Profile):
        words = sorted({t for own in tokens for t in own})
        number = {t: i for i, t in enumerate(words)}
        self.keys, self.words = keys, pa.array(words, pa.string())
        self.weight = np.zeros((len(words), len(keys)), np.float32)
        for q, own in enumerate(tokens):
            self.weight[[number[t] for t in own], q] = 1
        self.topics = np.array(topics, bool).reshape(len(keys), len(profile.topics)).T
        self.points = [t[0] for t in profile.topics]

    def scored(self, batch: pa.RecordBatch, most: int = 2000) -> Iterator[tuple[int, int, np.ndarray, dict[str, pa.Array]]]:
        """(note, first span of the batch, scores (spans, criteria), the batch's spans by field) of every note with spans."""
        column = batch.column(1)
        ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        whole = column.flatten()
        field = dict(zip([f.name for f in whole.type], whole.flatten(), strict=True))
        size = field["tokens"].value_lengths().to_numpy(zero_copy_only=False)
        term = pc.fill_null(pc.index_in(field["tokens"].flatten(), value_set=self.words), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)[term >= 0]
        term = term[term >= 0]
        touched = field["topics"].flatten().to_numpy(zero_copy_only=False).reshape(len(size), -1)
        note = 0
        while note < len(ends):
            low = int(ends[note - 1]) if note else 0
            to = max(note + 1, int(np.searchsorted(ends, low + most, "right")))
            high = int(ends[to - 1])
            scores = np.zeros((high - low, len(self.keys)), np.float32)
            at = slice(*np.searchsorted(row, [low, high]))
            if at.start < at.stop:
                rows, starts = np.unique(row[at], return_index=True)
                scores[rows - low] = np.add.reduceat(self.weight[term[at]], starts)
            for points, mine, asked in zip(self.points, touched[low:high].T, self.topics, strict=True):
                scores[np.ix_(mine, asked)] += points
            for n in range(note, to):
                a, b = int(ends[n - 1]) if n else 0, int(ends[n])
                yield n, a, scores[a - low : b - low], field
            note = to


def _spans_of_notes(notes: DataFrame, key: str, text: str, profile: Profile) -> DataFrame:
    span = lambda x: F.struct(x.alias("text"), X.first_label(x, profile.categories, "other").alias("category"), *(touched(x, 2, profile)[c].alias(c) for c in ("tokens", "topics")))
    return notes.select(F.col(key).alias("quill_key"), F.transform(span_array(text, profile), span).alias("quill_spans"))


def _in_blocks(criteria: DataFrame, profile: Profile, *columns: Column | str) -> Iterator[list]:
    side = touched(F.col("criterion"), 1, profile)
    return in_blocks(criteria.select(*columns, side["tokens"].alias("quill_tokens"), side["topics"].alias("quill_topics")), "quill_tokens")


def top_spans_of_all(criteria: DataFrame, notes: DataFrame, criterion_key: str, key: str, text: str, profile: Profile = MEDICAL, k: int = 3, least: int = 2) -> DataFrame:
    """criterion_key, key, span, text, category, score, rank: top_spans() of every note for every criterion of a stated set.

    A note and a block of criteria meet as a matrix product in the note's own task: nothing is shuffled. criteria have the column criterion.
    """
    types = [criteria.schema[criterion_key].dataType, notes.schema[key].dataType, T.IntegerType(), T.StringType(), T.StringType(), T.IntegerType(), T.IntegerType()]
    fields = T.StructType([T.StructField(n, t) for n, t in zip([criterion_key, key, "span", "text", "category", "score", "rank"], types, strict=True)])
    kind = to_arrow_type(types[0])
    source = _spans_of_notes(notes, key, text, profile)

    def one(block: list) -> DataFrame:
        keys, tokens, topics = ([r[c] for r in block] for c in (0, "quill_tokens", "quill_topics"))

        def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = Criteria(keys, tokens, topics, profile)
            names = pa.array(keys, kind)
            ints = lambda x: pa.array(x.astype(np.int32))

            def rows(batch: pa.RecordBatch, field: dict, found: list[tuple]) -> pa.RecordBatch:
                q, note, at, place, score, rank = (np.concatenate(x) for x in zip(*found, strict=True))
                return pa.RecordBatch.from_arrays([names.take(pa.array(q)), batch.column(0).take(pa.array(note)), ints(at + 1), *(field[c].take(pa.array(place)) for c in ("text", "category")), ints(score), ints(rank + 1)], fields.names)

            # a note has up to k rows for each criterion: they go on as they come, not a batch of notes at once
            for batch in batches:
                found: list[tuple] = []
                field: dict = {}
                held = 0
                for note, first, scores, field in asked.scored(batch):
                    if not len(scores):
                        continue
                    order = np.argsort(-scores, axis=0, kind="stable")[:k]
                    best = np.take_along_axis(scores, order, 0)
                    rank, q = np.nonzero(best >= least)
                    found.append((q, np.full(len(q), note), order[rank, q], first + order[rank, q], best[rank, q], rank))
                    held += len(q)
                    if held >= ROWS_OUT:
                        yield rows(batch, field, found)
                        found, held = [], 0
                if held:
                    yield rows(batch, field, found)

        return source.mapInArrow(find, fields)

    parts = [one(b) for b in _in_blocks(criteria, profile, criterion_key)]
    return reduce(DataFrame.unionByName, parts) if parts else notes.sparkSession.createDataFrame([], fields)


def gaps_of_all(criteria: DataFrame, notes: DataFrame, title: str, order: str, key: str, text: str, profile: Profile = MEDICAL, least: int = 2, limit: int = 20) -> DataFrame:
    """key, gaps: the first distinct "title: element" of each note, over the criteria of a stated set that none of its spans matches, in their order.

    Notes without a gap have an empty list. The set is one block, which its caller keeps small enough for a task.
    """
    lacking = missing_elements("criterion", F.lit(False), profile)
    named = F.transform(lacking, lambda x: F.concat(F.col(title), F.lit(": "), x)).alias("quill_gaps")
    block = [r for b in _in_blocks(criteria.orderBy(order), profile, order, named) for r in b]
    own = [r["quill_gaps"] for r in block]
    fields = T.StructType([T.StructField(key, notes.schema[key].dataType), T.StructField("gaps", T.ArrayType(T.StringType()))])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Criteria([r[0] for r in block], [r["quill_tokens"] for r in block], [r["quill_topics"] for r in block], profile)
        for batch in batches:
            out: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for note, _, scores, _ in asked.scored(batch):
                unmet = ~(scores >= least).any(0) if len(scores) else np.ones(len(block), bool)
                seen: dict[str, None] = {}
                for q in np.flatnonzero(unmet).tolist():
                    if len(seen) >= limit:
                        break
                    seen |= dict.fromkeys(own[q])
                out[note] = [*seen][:limit]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], fields.names)

    return _spans_of_notes(notes, key, text, profile).mapInArrow(find, fields)


def missing_elements(criterion: Column | str, matched: Column, profile: Profile = MEDICAL) -> Column:
    """What a criterion without matched spans lacks: its elements' labels, or the default one."""
    asked = F.filter(F.array(*(F.when(X.col(criterion).rlike(p), F.lit(label)) for p, label in profile.elements)), lambda x: x.isNotNull())
    return F.when(matched, F.array().cast("array<string>")).otherwise(F.when(F.size(asked) == 0, F.array(F.lit(profile.default_element))).otherwise(asked))


def criterion_status(criterion: Column | str, negative: str = "(?i)non-covered|not covered|contraindicat") -> Column:
    """not_met where the criterion says so itself, else unclear: matches are signals, not proof."""
    return F.when(X.col(criterion).rlike(negative), "not_met").otherwise("unclear")


def gaps(assessed: DataFrame, key: str, title: str, missing: str, order: list[str], limit: int = 20) -> DataFrame:
    """key, gaps: the first distinct "title: element" of each key, in order."""
    rows = assessed.select(key, title, *order, F.posexplode(missing).alias("element_at", "element")).withColumn("gap", F.concat(title, F.lit(": "), "element"))
    place = F.struct(*order, "element_at")
    firsts = rows.groupBy(key, "gap").agg(F.min(place).alias("place"))
    kept = ranked(firsts, [key], [F.col("place")]).where(F.col("rank") <= limit)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gap"))), lambda x: x["gap"]).alias("gaps"))


#: Kinds of policy by patterns of their source.
POLICY_TYPES = (
    ("CMS_NCD", "(?i)National Coverage Determination|NCD"),
    ("CMS_LCD", "(?i)Local Coverage Determination|LCD"),
    ("NCCN", "(?i)National Comprehensive Cancer Network|NCCN"),
    ("COMMERCIAL_POLICY", "(?i)Commercial"),
)


def policy_type(source: Column | str) -> Column:
    """The kind of policy by its source."""
    return X.first_label(source, POLICY_TYPES, "OTHER")


def freshness(effective: Column | str, as_of: Column | str, review: int = 365, stale: int = 900) -> Column:
    """stale, review_due or current by whole days since the effective date; an unreadable date is review_due."""
    days = F.datediff(X.col(as_of).cast("date"), F.try_to_date(X.col(effective).cast("string")))
    return F.when(days.isNull(), "review_due").when(days > stale, "stale").when(days > review, "review_due").otherwise("current")


def policy_metadata(results: DataFrame, policies: DataFrame, key: str, as_of: Column, keep_missing: bool = False) -> DataFrame:
    """results with title, source, effective_date, policy_type, freshness and last_reviewed of the policy with their key.

    Results without a policy are left out, or kept with nulls. Policies with equal keys each give a row.
    """
    known = policies.select(key, "title", "source", "effective_date", policy_type("source").alias("policy_type"), freshness("effective_date", as_of).alias("freshness"), as_of.alias("last_reviewed"))
    return results.join(known, key, "left" if keep_missing else "inner")


#: Why a note can't be used, and what each status means.
BLOCKING = {
    "too_short": "Clinical notes are too short to support a medically grounded appeal.",
    "no_core_element": "Clinical notes do not clearly document a diagnosis/indication or objective clinical support.",
    "low_score": "Clinical notes are missing too many core medical-necessity elements.",
}
SUMMARIES = {
    "block": "The clinical notes are not sufficient to generate a medically grounded appeal yet.",
    "needs_review": "The clinical notes can be used, but adding the missing details would strengthen the appeal.",
    "pass": "The clinical notes contain the core elements needed for a grounded appeal.",
}


def sufficiency(notes: DataFrame, key: str, text: str, found: DataFrame, profile: Profile = MEDICAL, service: Column | None = None, denial: Column | None = None, warnings: Column | None = None, limit: int = 8) -> DataFrame:
    """Adds present and missing (element keys), score, blocking (reasons as codes), status, summary, labels, suggestions and warnings to each note.

    service: the denied service, which makes the elements that ask for it present where it stands in the note; denial: the denial's text, for
    payer_suggestions(); warnings: an array column of contraindication warnings, which follow the payer's. found: from spans().
    """
    kinds = found.groupBy(key).agg(F.count("*").alias("n_spans"), F.collect_set("category").alias("categories"))
    rows = notes.withColumn("quill_notes", X.trimmed(F.coalesce(F.col(text), F.lit("")))).join(kinds, key, "left")
    lower = F.lower("quill_notes")

    def holds(e) -> Column:
        out = lower.rlike(e.pattern)
        if e.categories:
            out = out | F.coalesce(F.arrays_overlap("categories", F.array(*map(F.lit, e.categories))), F.lit(False))
        return out | F.contains(lower, F.lower(F.coalesce(service, F.lit("")))) if e.service and service is not None else out

    strings = lambda columns: F.filter(F.array(*columns), lambda x: x.isNotNull()) if columns else F.array().cast("array<string>")
    rows = rows.withColumn("quill_has", F.array(*(holds(e) for e in profile.note_elements)))
    has = {e.key: F.col("quill_has")[i] for i, e in enumerate(profile.note_elements)}
    points = sum((F.when(has[e.key], e.weight).otherwise(0) for e in profile.note_elements), F.lit(0))
    score = F.least(F.lit(100), points + F.least(F.lit(10), F.coalesce("n_spans", F.lit(0))))
    pick = lambda want, value: strings([F.when(has[e.key] if want else ~has[e.key], F.lit(value(e))) for e in profile.note_elements])
    payer = payer_suggestions(denial, F.col("quill_notes")) if denial is not None else F.array().cast("array<string>")
    rows = rows.withColumns({"present": pick(True, lambda e: e.key), "missing": pick(False, lambda e: e.key), "labels": pick(True, lambda e: e.label or e.key), "score": score.cast("int"), "quill_payer": payer})
    core = F.arrays_overlap("present", F.array(*map(F.lit, profile.core)))
    blocking = strings([F.when(F.length("quill_notes") < profile.least_chars, F.lit("too_short")), F.when(~core, F.lit("no_core_element")), F.when(F.col("score") < profile.block_below, F.lit("low_score"))])
    hints = F.slice(F.array_distinct(F.concat(pick(False, lambda e: e.suggestion or e.key), "quill_payer")), 1, limit)
    warned = F.slice(F.array_distinct(F.concat("quill_payer", *([warnings] if warnings is not None else []))), 1, limit)
    rows = rows.withColumns({"blocking": blocking, "suggestions": hints, "warnings": warned})
    status = F.when(F.size("blocking") > 0, "block").when((F.col("score") < profile.review_below) | (F.size("suggestions") > 0), "needs_review").otherwise("pass")
    rows = rows.withColumn("status", status).withColumn("summary", F.element_at(F.create_map(*(F.lit(x) for kv in SUMMARIES.items() for x in kv)), F.col("status")))
    return rows.drop("quill_notes", "quill_has", "quill_payer", "n_spans", "categories")


def blocking_texts(blocking: Column | str) -> Column:
    """The sentences of sufficiency()'s blocking codes."""
    texts = F.create_map(*(F.lit(x) for kv in BLOCKING.items() for x in kv))
    return F.transform(X.col(blocking), lambda c: F.element_at(texts, c))


def planning_aid(spans_: Column, criteria: Column, gaps_: Column, warnings: Column, policies: Column, instructions: str) -> Column:
    """One JSON text of a case's evidence, criteria, gaps, warnings and policies, for the caller's model."""
    return F.to_json(F.struct(F.lit(instructions).alias("instructions"), spans_.alias("evidenceSpans"), criteria.alias("criteria"), gaps_.alias("documentationGaps"), warnings.alias("contraindicationWarnings"), policies.alias("policyMetadata")))


#: The block of non-covered indications, which ends at the next heading of letters after a blank line.
NON_COVERED = r"(?i)(Non-Covered Indications:[\s\S]*?)(?=\n\n[A-Z][A-Za-z ]+:|\n\n[A-Z][A-Za-z ]+\n|\z)"


def contraindications(policies: DataFrame, notes: DataFrame, on: list[str], content: str, text: str, position: str, limit: int = 10) -> DataFrame:
    """Lines of the policies' non-covered blocks with two tokens or more, one of whose first six stands in the note."""
    lines = policies.select(*on, position, F.posexplode(F.split(F.regexp_extract(content, NON_COVERED, 1), r"\R")).alias("line_at", "line"))
    lines = lines.withColumn("line", X.trimmed(F.regexp_replace("line", r"^[-\d.\s]+", "")))
    lines = lines.withColumn("quill_t", F.slice(X.analysis_tokens("line", MEDICAL.stop_words), 1, 6)).where(F.size("quill_t") >= 2)
    hits = lines.join(notes.select(*on, F.lower(text).alias("quill_note")), on).where(F.exists("quill_t", lambda t: F.contains(F.col("quill_note"), t)))
    return ranked(hits, on, [F.col(position), F.col("line_at")]).where(F.col("rank") <= limit).drop("quill_t", "quill_note")


@dataclass(frozen=True)
class Advice:
    """Text that is due where the denial matches and the notes don't; patterns are on lower-cased text."""

    denial: str
    notes: str
    text: str


# What payers ask for.
PAYER_ADVICE = (
    Advice("metformin", "metformin", "Document metformin use, intolerance, contraindication, or the clinical reason it is inappropriate."),
    Advice(r"\b(ozempic|trulicity|glp-?1|preferred formulary|step therapy)\b", r"\b(ozempic|trulicity|semaglutide|dulaglutide|liraglutide|glp-?1)\b", "Document preferred formulary or step-therapy trials, failures, intolerance, or contraindications."),
    Advice(r"\bweight loss|solely for weight\b", r"\b(type 2 diabetes|diabetes|a1c|hba1c|e11\.)\b", "Document that the requested drug is for type 2 diabetes or another covered indication, not solely weight loss."),
    Advice(r"\bconservative|physical therapy|nsaid|therapy\b", r"\b(failed|tried|trial|completed|physical therapy|pt\b|nsaid|injection|conservative)\b", "Document conservative treatment attempts with dates, duration, response, and reason for failure."),
    Advice(r"\bimaging|x-?ray|mri|ct|radiograph\b", r"\b(x-?ray|radiograph|mri|ct|ultrasound|imaging|report)\b", "Add relevant imaging or test results, including date and impression."),
)


def payer_suggestions(denial: Column | str, notes: Column | str, rules: tuple[Advice, ...] = PAYER_ADVICE) -> Column:
    """The texts of the rules that are due, in order."""
    d, n = F.lower(X.col(denial)), F.lower(X.col(notes))
    return F.filter(F.array(*(F.when(d.rlike(r.denial) & ~n.rlike(r.notes), F.lit(r.text)) for r in rules)), lambda x: x.isNotNull())

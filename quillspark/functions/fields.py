"""Named fields of pasted denials and clinical notes, as one projection each; merging, payloads and gates of a case's form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as X

# The patterns of each field, the first that gives a value counts.
DENIAL_FIELDS = {
    "insurance_company": (r"(?im)^\s*(?:Payer|Insurance Company|Plan)\s*:\s*(.+)$",),
    "patient_name": (r"(?im)^\s*(?:Patient|Patient Name)\s*:\s*(.+)$",),
    "member_id": (r"(?im)^\s*(?:Member ID|Subscriber ID|Insurance ID)\s*:\s*(.+)$",),
    "patient_dob": (r"(?im)^\s*(?:DOB|Date of Birth)\s*:\s*(.+)$",),
    "physician_name": (r"(?im)^\s*(?:Provider|Requesting Physician|Ordering/Rendering Provider|Prescriber)\s*:\s*(.+)$",),
    "practice_name": (r"(?im)^\s*(?:Facility|Clinic|Practice|Practice Name)\s*:\s*(.+)$",),
    "denied_service": (r"(?im)^\s*(?:Requested Medication|Requested Service|Denied Service|Service|Procedure|Medication)\s*:\s*(.+)$",),
    "icd10_codes": (r"(?im)^\s*(?:ICD-10|ICD10|Diagnosis Code(?:\(s\))?|ICD-10 Diagnosis Code(?:\(s\))?)\s*:\s*(.+)$",),
    "cpt_codes": (r"(?im)^\s*(?:CPT|CPT Code(?:\(s\))?|HCPCS|NDC)\s*:\s*(.+)$",),
    "denial_date": (r"(?im)^\s*(?:Date of Denial|Denial Date|Decision Date)\s*:\s*(.+)$",),
    "claim_number": (
        r"(?im)^\s*(?:Case\s*/\s*Authorization Number|Authorization Number|Case Number|Claim/Reference Number|Claim Number|Reference Number|PA Number)\s*:\s*(.+)$",
    ),
}
DENIAL_REASON = r"(?im)^\s*Reason for Denial\s*:\s*"
DENIAL_REASON_END = r"^\s*(?:Appeal Deadline|Recommended Appeal Focus|Submitted Documentation|Clinical Notes|Provider Attestation)\s*:"
NOTE_FIELDS = {
    "patient_name": (r"(?im)^\s*(?:Patient|Patient Name)\s*[:\n]\s*(.+)$", r"(?im)^\s*Name\s*:\s*(.+)$", r"(?i)\bPatient\s+(.+?)\s+(?:DOB\s*/\s*Age|DOB|Date of Birth)\b"),
    "patient_dob": (r"(?im)^\s*(?:DOB\s*/\s*Age|DOB|Date of Birth)\s*[:\n]\s*(.+)$", r"(?i)\b(?:DOB\s*/\s*Age|DOB|Date of Birth)\s+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"),
    "member_id": (r"(?im)^\s*(?:Member ID|Subscriber ID|Insurance ID)\s*[:\n]\s*(.+)$",),
    "insurance_company": (r"(?im)^\s*(?:Primary Insurance|Insurance)\s*[:\n]\s*(.+)$", r"(?i)\bPrimary Insurance\s+(.+?)(?:\s+Visit Type\b|\n|\z)"),
    "physician_name": (r"(?im)^\s*(?:Ordering/Rendering Provider|Provider|Physician)\s*[:\n]\s*(.+)$", r"(?i)\bOrdering/Rendering Provider\s+(.+?)(?:\s+Clinic\b|\n|\z)"),
    "practice_name": (r"(?im)^\s*(?:Clinic|Facility|Practice)\s*[:\n]\s*(.+)$", r"(?i)\bClinic\s+(.+?)(?:\s+Primary Insurance\b|\n|\z)"),
    "denied_service": (
        r"(?i)request to initiate\s+([^.;\n]+?)(?:\s+after\b|\.|;|\n)",
        r"(?i)Start\s+([^.;\n]*?(?:Mounjaro|tirzepatide|Ozempic|Trulicity|semaglutide|dulaglutide)[^.;\n]*?)(?:\.|;|\n)",
        r"(?i)(?:Orders|Prescriptions)[\s\S]*?[-•]\s*([^:\n]*(?:Mounjaro|tirzepatide|Ozempic|Trulicity|semaglutide|dulaglutide)[^:\n]*)",
        r"(?im)requested (?:medication|service)\s*[:\n]\s*(.+)$",
    ),
    "icd10_codes": (r"(?im)^\s*(?:ICD-10|ICD10)\s*:\s*(.+)$",),
}
ICD10, CPT = r"\b[A-TV-Z][0-9][0-9A-Z](?:\.[0-9A-Z]{1,4})?\b", r"\b(?:[A-Z]\d{4}|\d{5})\b"
#: The form's fields in which what the pasted denial says wins over what was typed.
DENIAL_FIRST = ("cpt_codes", "icd10_codes")


def codes(c: Column | str, pattern: str) -> Column:
    """The first twelve distinct codes, joined; null if there are none."""
    return X.first_given([X.extracted_codes(c, pattern)])


def denial_details(text: Column | str) -> Column:
    """A struct of the twelve fields of a pasted denial; what isn't found is null."""
    t = F.coalesce(X.col(text), F.lit(""))
    found = {name: X.first_match(t, list(patterns)) for name, patterns in DENIAL_FIELDS.items()}
    found["icd10_codes"] = F.coalesce(codes(found["icd10_codes"], ICD10), codes(t, ICD10))
    found["cpt_codes"] = F.coalesce(codes(found["cpt_codes"], CPT), found["cpt_codes"])
    for name in ("patient_dob", "denial_date"):
        found[name] = X.normalized_date(found[name])
    found["denial_reason"] = X.cleaned(X.section(t, DENIAL_REASON, DENIAL_REASON_END))
    return F.struct(*(v.alias(k) for k, v in found.items()))


def note_details(text: Column | str) -> Column:
    """A struct of the fields of a clinical note; those that only a denial has are not among them."""
    t = F.coalesce(X.col(text), F.lit(""))
    found = {name: X.first_match(t, list(patterns)) for name, patterns in NOTE_FIELDS.items()}
    found["patient_dob"] = X.normalized_date(F.regexp_replace(found["patient_dob"], r"(?im)\s*/\s*Age\b.*$", ""))
    found["denied_service"] = X.cleaned(F.regexp_replace(found["denied_service"], r"(?i)^Start\s+", ""))
    found["icd10_codes"] = F.coalesce(codes(found["icd10_codes"], ICD10), codes(t, ICD10))
    return F.struct(*(v.alias(k) for k, v in found.items()))


def merged_details(primary: Column, fallback: Column, names: list[str]) -> Column:
    """The primary record's values where it has any, else the fallback's."""
    return F.struct(*(F.coalesce(F.nullif(primary[n], F.lit("")), fallback[n]).alias(n) for n in names))


def payload(typed: Column, denial: Column, inferred: Column, names: list[str], denial_first: tuple[str, ...] = DENIAL_FIRST) -> Column:
    """The form that is sent: typed values, else inferred ones, else empty; codes take the denial's before the typed ones."""
    given = lambda x: F.nullif(x, F.lit(""))
    return F.struct(*(F.coalesce(*([given(denial[n])] if n in denial_first else []), given(typed[n]), given(inferred[n]), F.lit("")).alias(n) for n in names))


def filled_count(details: Column, names: list[str]) -> Column:
    """How many fields of a record have a value."""
    return sum(((F.coalesce(F.length(details[n]), F.lit(0)) > 0).cast("int") for n in names), F.lit(0))


def gates(notes: Column | str, reason: Column | str, service: Column, inferred_service: Column, patient: Column, inferred_patient: Column, more_than: int = 50) -> Column:
    """step1: the notes are long enough; step2: a reason, and a service and a patient, typed or inferred."""
    has = lambda c: F.coalesce(X.trimmed(c) != "", F.lit(False))
    step1 = F.coalesce(F.length(X.trimmed(notes)) > more_than, F.lit(False))
    return F.struct(step1.alias("step1"), (has(X.col(reason)) & (has(service) | has(inferred_service)) & (has(patient) | has(inferred_patient))).alias("step2"))


# Search texts for literature and the filter that each of the first two ends with.
EVIDENCE_FILTER = (
    "(humans[MeSH Terms]) AND (systematic review[Publication Type] OR meta-analysis[Publication Type] OR practice guideline[Publication Type] OR "
    "randomized controlled trial[Publication Type] OR guideline[Publication Type])"
)


def search_queries(service: Column, reason: Column, cpt: Column, icd10: Column, reason_chars: int = 100) -> Column:
    """Two to four search texts of a case: necessity, outcomes, the start of the reason, and the codes."""
    none = F.lit(None).cast("string")
    has = lambda c: F.coalesce(c != "", F.lit(False))
    blank = lambda c: F.coalesce(c, F.lit(""))
    named = F.concat(F.lit("("), service, F.lit(")"))
    texts = [
        F.concat(named, F.lit(f" AND medical necessity AND {EVIDENCE_FILTER}")),
        F.concat(named, F.lit(f" AND clinical outcomes AND evidence-based AND {EVIDENCE_FILTER}")),
        F.when(has(reason), F.concat(named, F.lit(" AND ("), F.left(reason, F.lit(reason_chars)), F.lit(") AND coverage criteria AND humans[MeSH Terms]"))).otherwise(none),
        F.when(has(cpt) | has(icd10), F.concat(named, F.lit(" AND ("), blank(cpt), F.lit(" "), blank(icd10), F.lit(") AND medical policy AND humans[MeSH Terms]"))).otherwise(none),
    ]
    return F.filter(F.array(*texts), lambda x: x.isNotNull())


def download_name(patient: Column) -> Column:
    """The name of a letter's file: the patient's name in lower case, hyphens for spaces."""
    return F.concat(F.lit("appeal-letter-"), F.replace(F.lower(patient), F.lit(" "), F.lit("-")), F.lit(".docx"))

"""Rule sets as parameters of the operators: word lists, patterns, weights.

MEDICAL holds the fixed values of the clinical-appeal rules; PLAIN fits general prose.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Words that the analysis tokenizer drops.
STOP_WORDS = (
    "the", "and", "for", "with", "that", "this", "from", "when", "then", "than", "have", "has", "had", "are", "was", "were",
    "been", "being", "patient", "documented", "documentation", "required", "requires", "including", "include", "criteria",
    "criterion", "covered",
)

# Patterns of bracket contents, headings, claims and numbers in letters.
ALLOWED_BRACKET = r"(?i)^(?:\d+|PubMed\s+\d+|Reference\s+\d+|DOCUMENTATION GAP(?::|\s|$).*)$"
PLACEHOLDER_HINT = (
    r"(?i)\b(?:address|phone|fax|date|dob|birth|member|claim|insert|if known|not provided|omitted|current|provider|physician|"
    r"clinician|doctor|letterhead|practice|facility|office|npi|name|signature|sincerely|to be|blank)\b"
)
PLACEHOLDER_CAPS = r"[A-Z0-9 _/-]{3,}"
HEADING_QUOTE = (
    r"(?i)^(?:active\s+)?(?:diagnosis|diagnoses|medications?|problems?|assessment|plan|impression|history|clinical summary|review of systems|"
    r"physical examination|objective data|laboratory results|supporting documentation|documentation gaps?)$"
)
CLINICAL_CLAIM = (
    r"(?i)\d|pain|mass|lesion|deficit|stenosis|fracture|cancer|tumor|malign|biopsy|therapy|medication|exam|imaging|mri|ct|pet|x-ray|xray|"
    r"lab|a1c|bmi|symptom|diagnos|criterion|requires|denial|not medically necessary"
)
NUMERIC_FACT = (
    r"(?i)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d+(?:\.\d+)?\s?(?:%|mg/dL|mmHg|cm|mm|kg/m2|weeks?|months?|years?|days?|hours?|/10|points?|QALY|mL|L))\b"
)
# Pieces of notes, and which of them may be evidence.
SPAN = r"(?d)[^\n.!?;:]{8,260}(?:[.!?;:]|\n|$)"
#: The same pieces but for the length of a run, which is cut to its last 260 characters afterwards: no start within a long run is tried in vain.
SPAN_RUN, SPAN_MARKS, SPAN_MOST = r"(?d)[^\n.!?;:]{8,}+(?:[.!?;:]|\n|$)", "\n.!?;:", 260
SPAN_CANDIDATE = (
    r"(?i)\d|diagnos|pain|failed|therapy|mri|ct|pet|x-?ray|biopsy|lab|symptom|function|medication|risk|plan|recommend|conservative|provider|"
    r"prescriber|physician|clinician|endocrinolog|diabetes specialist|\bFACE\b|ordering/rendering|clinic|practice|facility"
)
# The first pattern that matches names a span's category.
CATEGORIES = (
    ("provider", r"(?i)provider|prescriber|physician|clinician|endocrinolog|diabetes specialist|\bFACE\b|ordering/rendering|clinic|practice|facility"),
    ("diagnosis", r"(?i)diagnos|icd|cancer|osteoarthritis|stenosis|spondylolisthesis|apnea|diabetes|obesity|malignan"),
    ("imaging", r"(?i)mri|ct|pet|x-?ray|radiograph|imaging|biopsy|patholog|lab|a1c|ahi"),
    ("treatment", r"(?i)therapy|pt\b|nsaid|injection|conservative|surgery|medication|trial|failed|treatment"),
    ("functional", r"(?i)adl|walking|stairs|function|womac|koos|pain|vas|limitation|mobility"),
    ("risk", r"(?i)risk|bmi|smok|hypertension|contraindicat|infection|cardiac"),
    ("medication", r"(?i)mg|dose|methotrexate|biologic|cpap|drug|medication"),
)
# Fixed values: (points, pattern on the criterion, pattern on the span) of shared topics, points included.
TOPICS = (
    (2, r"(?i)\bfailed|failure|conservative|therapy|treatment\b", r"(?i)\bfailed|failure|conservative|therapy|treatment\b"),
    (2, r"(?i)\bpain|functional|adl|walking|mobility\b", r"(?i)\bpain|functional|adl|walking|mobility\b"),
    (2, r"(?i)\bimaging|radiograph|mri|ct|pet|biopsy|patholog\b", r"(?i)\bimaging|radiograph|mri|ct|pet|biopsy|patholog\b"),
    (2, r"(?i)\bdiagnos|confirmed|malignan|osteoarthritis|cancer\b", r"(?i)\bdiagnos|confirmed|malignan|osteoarthritis|cancer\b"),
    (3, r"(?i)\bprescriber|specialist|endocrinologist|clinician|provider|physician\b", r"(?i)\bprovider|prescriber|physician|clinician|endocrinolog|diabetes specialist|FACE|clinic|practice|facility\b"),
)
# What a criterion asks for, by pattern, and the default.
ELEMENTS = (
    (r"(?i)diagnos|confirmed|malignan|patholog|biopsy", "documented diagnosis/pathology confirmation"),
    (r"(?i)imaging|radiograph|mri|ct|pet", "supporting imaging or test result"),
    (r"(?i)failed|conservative|therapy|treatment|months|weeks", "duration and outcome of conservative treatment"),
    (r"(?i)functional|adl|pain|vas|womac|mobility", "functional limitation or pain severity documentation"),
    (r"(?i)optimized|bmi|a1c|smoking|clearance", "medical optimization or risk-factor documentation"),
    (r"(?i)prescriber|specialist|endocrinologist|clinician|provider|physician", "specialist or prescribing clinician documentation"),
)
DEFAULT_ELEMENT = "specific chart evidence supporting this criterion"


@dataclass(frozen=True)
class Element:
    """Something that a sufficient record has: a pattern on the lower-cased text or a span of one of the categories; with service, also the denied service's name."""

    key: str
    weight: int
    pattern: str
    categories: tuple[str, ...] = ()
    label: str = ""
    suggestion: str = ""
    service: bool = False


# The elements of a sufficient clinical note.
NOTE_ELEMENTS = (
    Element("diagnosis", 20, r"\b(diagnos|assessment|impression|icd-?10|dx\b|type 2 diabetes|diabetes|osteoarthritis|cancer|malignan|angina|stenosis|sleep apnea|e11\.)\b", ("diagnosis",), label="Diagnosis or covered indication", suggestion="Add the diagnosis/covered indication and ICD-10 code when available."),
    Element("objective", 20, r"\b(a1c|hba1c|bmi|ldl|ef|ahi|kellgren|grade|stage|mm|cm|x-?ray|radiograph|mri|ct|pet|biopsy|pathology|stress test|echo|ultrasound|\d+\/10|%|\d+\.\d+)\b", ("imaging",), label="Objective findings, labs, imaging, or measured severity", suggestion="Add objective support such as labs, imaging/test reports, measured severity, or dated exam findings."),
    Element("treatment", 20, r"\b(failed|failure|tried|trial|completed|intoler|contraindicat|therapy|physical therapy|pt\b|nsaid|injection|medication|metformin|insulin|ozempic|trulicity|empagliflozin|glipizide|statin)\b", ("treatment", "medication"), label="Prior treatment history, failure, intolerance, or contraindication", suggestion="Add prior therapies with dates/duration, outcome, intolerance, contraindication, or reason alternatives are inappropriate."),
    Element("timeline", 15, r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d+\s*(day|days|week|weeks|month|months|year|years)\b|\bsince\b|\bfrom\b", label="Dates or treatment duration", suggestion="Add dates and durations for symptoms, medication trials, procedures, and failed treatments."),
    Element("symptoms", 15, r"\b(pain|symptom|dyspnea|angina|hypoglycemia|infection|walking|stairs|adl|function|limitation|worsening|risk|comorbid|hypertension|obesity|cardiac)\b", ("functional", "risk"), label="Symptoms, functional impact, or clinical risk", suggestion="Add symptom severity, functional limitations, clinical risk, or impact on daily activities."),
    Element("plan", 10, r"\b(plan|recommend|request|requires|medical necessity|medically necessary|prescribed|initiate|proceed|refer)\b", label="Clear request, plan, or medical rationale", suggestion="Add the requested service/drug and the clinician rationale for why it is medically necessary now.", service=True),
)


@dataclass(frozen=True)
class Profile:
    stop_words: tuple[str, ...] = STOP_WORDS
    span: str = SPAN
    span_candidate: str = SPAN_CANDIDATE
    categories: tuple[tuple[str, str], ...] = CATEGORIES
    topics: tuple[tuple[int, str, str], ...] = TOPICS
    elements: tuple[tuple[str, str], ...] = ELEMENTS
    default_element: str = DEFAULT_ELEMENT
    note_elements: tuple[Element, ...] = NOTE_ELEMENTS
    least_chars: int = 120
    block_below: int = 45
    review_below: int = 75
    core: tuple[str, ...] = field(default=("diagnosis", "objective"))


MEDICAL = Profile()
#: For the invented prose of the driver's tables: patterns that both Java and RE2 read alike.
PLAIN = Profile(
    stop_words=("then", "that", "with", "this", "from"),
    span="[^\\n.!?;:]{8,260}(?:[.!?;:]|\\n|$)",
    span_candidate="[0-9]|ing|tion|ung|ment|ado",
    categories=(("action", "tion|ment"), ("course", "ing|ung"), ("state", "ed|ado"), ("figure", "[0-9]")),
    topics=((2, "tion|ment", "tion|ment"), (3, "ing|ung", "ing|lich")),
    elements=(("tion", "an action"), ("ing", "a course"), ("[0-9]", "a figure")),
    default_element="any evidence",
    note_elements=(
        Element("action", 30, "tion|ment|ung", ("action",)),
        Element("figure", 20, "[0-9]", ("figure",)),
        Element("course", 20, "ing|ando|lich"),
        Element("link", 20, "with|avec|con|mit", service=True),
    ),
    core=("action", "figure"),
)

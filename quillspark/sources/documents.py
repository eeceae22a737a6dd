"""Uploaded documents and literature files as rows.

Bytes come from Spark's binaryFile source. Formats that need a parser (DOCX, PDF) are read in an Arrow UDF that turns a bad
file into an error value, so that no file fails the job.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import text as X

MOST_BYTES, MOST_EXPANDED, MOST_ENTRIES = 10 << 20, 25 << 20, 200
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def uploads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def decoded(content: Column | str) -> Column:
    """UTF-8 without its mark, else Latin-1, which takes any bytes."""
    c = X.col(content)
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(c.cast("string")), F.decode(c, "ISO-8859-1")), "^﻿", "")


def docx_text(data: bytes) -> str:
    """Paragraphs of the body, then of headers and footers by name, a line each."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        entries = z.infolist()
        if len(entries) > MOST_ENTRIES or sum(e.file_size for e in entries) > MOST_EXPANDED:
            raise ValueError("archive too large")
        names = {e.filename for e in entries}
        parts = ["word/document.xml", *sorted(n for n in names if re.fullmatch(r"word/(header|footer)\d*\.xml", n))]
        lines = []
        for name in parts:
            if name not in names:
                raise ValueError("no document in archive")
            for p in ElementTree.fromstring(z.read(name)).iter(f"{WORD_NS}p"):
                marks = {f"{WORD_NS}tab": "\t", f"{WORD_NS}br": "\n"}
                lines.append("".join(n.text or "" if n.tag == f"{WORD_NS}t" else marks.get(n.tag, "") for n in p.iter()))
        return "\n".join(lines)


# The look of a letter (12 point Times New Roman, 2 points after a line, 1.15 lines, margins of an inch, numbers a quarter inch in).
WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
OFFICE = "application/vnd.openxmlformats-officedocument.wordprocessingml"
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
LETTER_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    + "".join(f'<Override PartName="/word/{n}.xml" ContentType="{OFFICE}.{k}+xml"/>' for n, k in (("document", "document.main"), ("styles", "styles"), ("numbering", "numbering")))
    + "</Types>",
    "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATION}/officeDocument" Target="word/document.xml"/></Relationships>',
    "word/_rels/document.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">'
    + "".join(f'<Relationship Id="rId{i}" Type="{RELATION}/{n}" Target="{n}.xml"/>' for i, n in enumerate(("styles", "numbering"), 1))
    + "</Relationships>",
    "word/styles.xml": f'<w:styles {WORD}><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/><w:pPr><w:spacing w:after="40" w:line="276" w:lineRule="auto"/></w:pPr>'
    '<w:rPr><w:rFonts w:ascii="Times New Roman" w:hAnsi="Times New Roman"/><w:sz w:val="24"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="ListBullet"><w:name w:val="List Bullet"/>'
    '<w:basedOn w:val="Normal"/><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style></w:styles>',
    "word/numbering.xml": f'<w:numbering {WORD}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/><w:lvlText w:val="•"/><w:pPr><w:ind w:left="360" w:hanging="360"/></w:pPr>'
    '</w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
}
PARAGRAPH_LOOK = {"bullet": '<w:pPr><w:pStyle w:val="ListBullet"/></w:pPr>', "numbered": '<w:pPr><w:ind w:left="360"/></w:pPr>'}
MARGINS = '<w:sectPr><w:pgMar w:top="1440" w:right="1440" w:bottom="1440" w:left="1440"/></w:sectPr>'
NOT_IN_XML = re.compile(r"[^\t\n\r\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]")


def docx_bytes(lines: list[dict]) -> bytes:
    """A letter's lines (line, kind) as a DOCX file, the same bytes on each run; characters that XML can't hold are left out."""
    body = []
    for x in lines:
        bold = "<w:rPr><w:b/></w:rPr>" if x["kind"] in ("header", "bold") else ""
        run = f'<w:r>{bold}<w:t xml:space="preserve">{escape(NOT_IN_XML.sub("", x["line"]))}</w:t></w:r>' if x["line"] else ""
        body.append(f"<w:p>{PARAGRAPH_LOOK.get(x['kind'], '')}{run}</w:p>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, part in (LETTER_PARTS | {"word/document.xml": f"<w:document {WORD}><w:body>{''.join(body)}{MARGINS}</w:body></w:document>"}).items():
            z.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + part, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _docx_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = [None if x is None else docx_bytes(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["key", "content"])


def docx_files(letters: DataFrame, key: str, lines: Column | str) -> DataFrame:
    """key, content: each letter as a DOCX file; lines is an array of (line, kind), as safety.line_array() gives it. Null for null lines; nothing is shuffled."""
    fields = T.StructType([T.StructField("key", letters.schema[key].dataType), T.StructField("content", T.BinaryType())])
    return letters.select(F.col(key).alias("key"), X.col(lines).alias("lines")).mapInArrow(_docx_files, fields).withColumnRenamed("key", key)


PDF_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
PDF_STRING = r"\(((?:\\.|[^\\()])*)\)"


def pdf_text(data: bytes) -> str:
    """The string literals that text operators show, stream by stream; streams that don't inflate are read as they are."""
    out, room = [], MOST_EXPANDED
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[1]
        try:
            body = zlib.decompressobj().decompress(body, room + 1)
        except zlib.error:
            pass
        room -= len(body)
        if room < 0:
            raise ValueError("streams too large")
        text = body.decode("latin-1")
        shown = [s for op in re.finditer(rf"(\[(?:\s*(?:{PDF_STRING}|[-\d.]+)\s*)*\])\s*TJ|({PDF_STRING})\s*Tj", text) for s in ["".join(re.findall(PDF_STRING, op[0]))]]
        words = [re.sub(r"\\([0-7]{1,3})|\\(.)", lambda x: chr(int(x[1], 8)) if x[1] else PDF_ESCAPES.get(x[2], x[2]), s) for s in shown]
        if words:
            out.append(" ".join(words))
    return "\n".join(out)


def _parsed(names: pa.Array, content: pa.Array) -> pa.Array:
    texts, errors = [], []
    for name, data in zip(names.to_pylist(), content.to_pylist(), strict=True):
        text = error = None
        try:
            text = (docx_text if (name or "").lower().endswith(".docx") else pdf_text)(data or b"")
        except Exception as e:  # noqa: BLE001 (any defect of a file becomes its row's error)
            error = str(e) or type(e).__name__
        texts.append(text)
        errors.append(error)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["text", "error"])


PARSED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def document_texts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, text, error: text files in the JVM, DOCX and PDF by parsers; too large, empty or of another kind: an error."""
    name, data = F.lower(path), F.col(content)
    plain = name.rlike(r"\.(txt|md|csv)$")
    packed = name.rlike(r"\.(docx|pdf)$") & (F.length(data) <= MOST_BYTES)
    parse = F.arrow_udf(_parsed, PARSED).asNondeterministic()
    rows = files.withColumn("p", F.when(packed, parse(F.when(packed, name), F.when(packed, data))))
    text = X.whitespace_normalized(F.when(plain & (F.length(data) <= MOST_BYTES), decoded(content)).otherwise(F.col("p.text")))
    error = F.when(F.length(data) > MOST_BYTES, "file too large").when(~plain & ~name.rlike(r"\.(docx|pdf)$"), "unsupported format").otherwise(F.col("p.error"))
    rows = rows.select(path, text.alias("text"), error.alias("error"))
    return rows.withColumn("error", F.coalesce("error", F.when(F.coalesce("text", F.lit("")) == "", "no text")))


def xml_text(c: Column | str) -> Column:
    """Without tags, white space as single spaces."""
    return X.trimmed(F.regexp_replace(F.regexp_replace(X.col(c), "<[^>]+>", ""), r"\s+", " "))


def xml_tag(c: Column | str, tag: str) -> Column:
    return F.regexp_extract(X.col(c), rf"(?i)<{tag}(?:\s[^>]*)?>([\s\S]*?)</{tag}>", 1)


# Kinds of evidence by publication type, the first that applies.
EVIDENCE_LEVELS = (
    ("Guideline", "guideline"), ("Systematic review/meta-analysis", "systematic review|meta-analysis"),
    ("Randomized controlled trial", "randomized controlled trial"), ("Clinical trial", "clinical trial"),
)
# Words that say nothing of an article's subject.
RELEVANCE_STOP_WORDS = (
    "the", "and", "for", "with", "that", "this", "from", "when", "then", "than", "medical", "necessity", "guidelines", "guideline",
    "coverage", "criteria", "clinical", "outcomes", "evidence", "based", "requested", "procedure", "service", "does", "meet", "not",
)


def articles(files: DataFrame, xml: str, abstract_chars: int = 600) -> DataFrame:
    """Articles of literature files: pmid, title, abstract, authors, journal, year, publication_types. Retracted ones and those without title or abstract are left out."""
    blocks = files.select(F.posexplode(F.split(xml, "<PubmedArticle>")).alias("at", "block")).where("at > 0")
    kinds = F.transform(X.all_matches("block", r"(?i)<PublicationType[^>]*>([^<]+)</PublicationType>", 1), lambda x: xml_text(x))
    author = F.regexp_extract("block", r"<LastName>([^<]+)</LastName>", 1)
    rows = blocks.select(
        "block", "at", xml_tag("block", "PMID").alias("pmid"), xml_text(xml_tag("block", "ArticleTitle")).alias("title"), F.left(xml_text(xml_tag("block", "AbstractText")), F.lit(abstract_chars)).alias("abstract"),
        F.when(author != "", F.concat(author, F.lit(" et al."))).otherwise("").alias("authors"), xml_text(xml_tag("block", "Title")).alias("journal"), xml_tag("block", "Year").alias("year"), kinds.alias("publication_types"),
    )
    retracted = F.exists("publication_types", lambda k: k.rlike("(?i)retracted|retraction")) | F.col("block").rlike("(?i)retracted publication")
    return rows.where((F.col("title") != "") & (F.col("abstract") != "") & ~retracted).drop("block")


def evidence_level(kinds: Column | str) -> Column:
    return X.first_label(F.lower(F.array_join(kinds, " ")), EVIDENCE_LEVELS, "Peer-reviewed article")


def relevant(rows: DataFrame, text: Column, service: Column, context: Column, least_context: int = 3) -> DataFrame:
    """Articles whose text holds one of the service's tokens, or three of the context's."""
    t = F.lower(text)
    n = lambda tokens: F.size(F.filter(tokens, lambda x: F.contains(t, x)))
    return rows.where((n(service) >= 1) | (n(context) >= least_context))

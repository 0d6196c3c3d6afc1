"""Document files into rows: e-mails, slide decks and PDFs, one parser for each suffix.

Files are read as bytes by Spark (``binaryFile``), parsed in tasks, and a file that
cannot be parsed becomes a row with an error, never a failed job.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from email import message_from_bytes, policy
from email.utils import getaddresses, parsedate_to_datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas


class ParseError(ValueError):
    """A file that cannot be read as what its suffix says."""


def tidy(text: str) -> str:
    """LF line ends, no blanks at line ends, no blank lines at both ends."""
    lines = [line.rstrip() for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    full = [i for i, line in enumerate(lines) if line]
    return "\n".join(lines[full[0] : full[-1] + 1]) if full else ""


def document_id(source_id: str | None, checksum: str) -> str:
    if source_id is None:
        return f"DOC-{checksum[:12]}"
    plain = re.sub(r"[^A-Za-z0-9._-]+", "-", source_id.strip()).strip("-")
    if not plain:
        raise ParseError("source_id has no usable character")
    return f"DOC-{plain.upper()}"


class _Blocks(list):
    def __init__(self, document: str):
        super().__init__()
        self.document = document

    def put(self, kind: str, text: str, location: dict, metadata: dict | None = None, warnings: list[str] | None = None) -> None:
        n = len(self) + 1
        place = {"location_type": None, "location_value": None, "page_number": None, "slide_number": None, "message_id": None, "element_index": None} | location
        self.append({"block_id": f"{self.document}-B{n:04d}", "sequence": n, "block_type": kind, "text": text, "parent_block_id": None, "metadata": {k: str(v) for k, v in (metadata or {}).items()}, "warnings": warnings or [], "location": place})


# ------------------------------------------------------------------------- e-mail

# Fixed values.
HEADERS = ("Subject", "From", "To", "Cc", "Date", "Message-ID", "In-Reply-To", "References")
HISTORY = re.compile(r"^[^\S\n]*(>.*|-{5,}[^\S\n]*(?:Original Message|Forwarded message)[^\S\n]*-{5,}|Selected quoted (?:and forwarded )?history:|On .+ wrote:)[^\S\n]*$", re.IGNORECASE | re.MULTILINE)
PART_SEPARATOR = "\n\n--- text/plain part ---\n\n"


def split_history(text: str) -> tuple[str, str | None, str | None]:
    """The current body, and the history from its first marker with that marker."""
    found = HISTORY.search(text)
    if found is None:
        return tidy(text), None, None
    marker = "quoted lines" if found[1].startswith(">") else found[1]
    return tidy(text[: found.start()]), tidy(text[found.start() :]) or None, marker


def parse_eml(data: bytes, source_id: str | None) -> dict:
    """Header blocks in a fixed order, the body, and the quoted history if there is one."""
    checksum = hashlib.sha256(data).hexdigest().upper()
    name = document_id(source_id, checksum)
    message = message_from_bytes(data, policy=policy.default)

    def header(key: str) -> str | None:
        value = message.get(key)
        return tidy(str(value)) or None if value is not None else None

    def people(key: str) -> list[str]:
        found = getaddresses([str(v) for v in message.get_all(key, [])])
        return [f"{n} <{a}>" if n and a else n or a for n, a in found if n or a]

    texts, attached = [], []
    for part in message.walk():
        if part.is_multipart():
            continue
        if part.get_content_disposition() == "attachment" or part.get_filename() is not None:
            attached.append((part.get_filename() or "unnamed", part.get_content_type()))
        elif part.get_content_type() == "text/plain":
            content = part.get_content()
            texts.append(tidy(content if isinstance(content, str) else content.decode(part.get_content_charset() or "utf-8", "replace")))
    texts = [t for t in texts if t]
    if not texts:
        raise ParseError("no readable text/plain body")
    body, history, marker = split_history(PART_SEPARATOR.join(texts))
    if not body:
        raise ParseError("no readable current message body")
    own_id = header("Message-ID")
    message_id = own_id or f"<{name.lower()}@local.invalid>"
    blocks = _Blocks(name)
    for key in HEADERS:
        if (value := header(key)) is not None:
            blocks.put("email_header", f"{key}: {value}", {"location_type": "email_header", "location_value": key, "message_id": message_id}, {"header_name": key})
    blocks.put("email_body", body, {"location_type": "email_body", "location_value": "body", "message_id": message_id}, {"plain_text_part_count": len(texts)})
    if history is not None:
        blocks.put("quoted_history", history, {"location_type": "quoted_history", "location_value": "quoted_history", "message_id": message_id}, {"separator": marker})
    try:
        date = parsedate_to_datetime(header("Date")) if header("Date") else None
    except (TypeError, ValueError, OverflowError):
        date = None
    references = header("References") or ""
    metadata = {
        "message_id": message_id, "references": " ".join(re.findall(r"<[^<>]+>", references) or references.split()), "to_recipients": "; ".join(people("To")), "cc_recipients": "; ".join(people("Cc")),
        "content_type": message.get_content_type(), "attachment_count": len(attached), "attachment_filenames": "; ".join(a for a, _ in attached), "in_reply_to": header("In-Reply-To"), "subject": header("Subject"), "raw_date": header("Date"), "quoted_history_separator": marker,
    }
    warnings = (["Message-ID header missing; deterministic local ID used"] if own_id is None else []) + ([f"Skipped {len(attached)} email attachment(s)"] if attached else [])
    return _document(name, source_id, "EML", checksum, header("Subject"), date, people("From"), metadata, warnings, blocks)


# -------------------------------------------------------------------- slide decks

_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
_KINDS = {"sp": "text", "graphicFrame": "frame", "grpSp": "group", "pic": "picture", "cxnSp": "connector", "contentPart": "content"}


def _paragraphs(node: ElementTree.Element) -> str:
    out = []
    for p in node.iter(f"{_A}p"):
        out.append("".join("\v" if r.tag == f"{_A}br" else (r.findtext(f"{_A}t") or "") for r in p if r.tag in (f"{_A}r", f"{_A}br", f"{_A}fld")))
    return "\n".join(out)


class _Shape:
    def __init__(self, node: ElementTree.Element, index: int):
        self.node, self.index = node, index
        self.kind = _KINDS.get(node.tag.rpartition("}")[2], "unknown")
        own = next((e for e in node.iter(f"{_P}cNvPr")), None)
        self.id, self.name = (own.get("id"), own.get("name")) if own is not None else (str(index), "unnamed shape")
        frame = {"sp": f"{_P}spPr/{_A}xfrm", "pic": f"{_P}spPr/{_A}xfrm", "cxnSp": f"{_P}spPr/{_A}xfrm", "grpSp": f"{_P}grpSpPr/{_A}xfrm", "graphicFrame": f"{_P}xfrm"}.get(node.tag.rpartition("}")[2])
        box = node.find(frame) if frame else None
        at = box.find(f"{_A}off") if box is not None else None
        self.top, self.left = (int(at.get("y", 0)), int(at.get("x", 0))) if at is not None else (0, 0)
        holder = node.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
        self.title = holder is not None and holder.get("type") in ("title", "ctrTitle")
        self.table = node.find(f".//{_A}tbl") if self.kind == "frame" else None


def _shapes(tree: ElementTree.Element) -> list[_Shape]:
    nodes = [n for n in tree if n.tag.rpartition("}")[2] in _KINDS]
    return sorted((_Shape(n, i) for i, n in enumerate(nodes, 1)), key=lambda s: (s.top, s.left, s.index))


def parse_pptx(data: bytes, source_id: str | None) -> dict:
    """Titles, text shapes and tables of all slides, by place on the slide; groups are flattened."""
    checksum = hashlib.sha256(data).hexdigest().upper()
    name = document_id(source_id, checksum)
    blocks, skipped, first_title = _Blocks(name), Counter(), None
    with zipfile.ZipFile(io.BytesIO(data)) as deck:
        main = ElementTree.fromstring(deck.read("ppt/presentation.xml"))
        targets = {r.get("Id"): posixpath.normpath(posixpath.join("ppt", r.get("Target"))).lstrip("/") for r in ElementTree.fromstring(deck.read("ppt/_rels/presentation.xml.rels")).iter(_REL)}
        slides = [targets[s.get(f"{_R}id")] for s in main.iter(f"{_P}sldId")]

        def emit(shape: _Shape, slide: int, group: list[str]) -> None:
            nonlocal first_title
            label = f"slide-{slide}-shape-{shape.id}"
            if shape.kind == "group":
                for child in _shapes(shape.node):
                    emit(child, slide, [*group, label])
                return
            kind, text = None, ""
            metadata = {"shape_name": shape.name, "original_shape_index": shape.index, "top": shape.top, "left": shape.left, "is_table": shape.table is not None}
            if group:
                metadata |= {"group_path": " ".join(group), "parent_shape_identifier": group[-1]}
            if shape.table is not None:
                rows = [[tidy(_paragraphs(c)) for c in r.findall(f"{_A}tc")] for r in shape.table.findall(f"{_A}tr")]
                kind, text = "table", "\n".join("\t".join(r) for r in rows)
                metadata |= {"row_count": len(rows), "column_count": max(map(len, rows), default=0)}
            elif (body := shape.node.find(f"{_P}txBody")) is not None and (text := tidy(_paragraphs(body))):
                kind = "slide_title" if shape.title else "shape_text"
                first_title = first_title or (text if shape.title else None)
            if kind is None:
                skipped[shape.kind] += 1
                return
            blocks.put(kind, text, {"location_type": "slide", "location_value": str(slide), "slide_number": slide, "element_index": shape.index}, metadata)

        for number, path in enumerate(slides, 1):
            for shape in _shapes(ElementTree.fromstring(deck.read(path)).find(f"{_P}cSld/{_P}spTree")):
                emit(shape, number, [])
        core = {}
        if "docProps/core.xml" in deck.namelist():
            core = {e.tag.rpartition("}")[2]: tidy(e.text or "") for e in ElementTree.fromstring(deck.read("docProps/core.xml"))}
    try:
        date = datetime.fromisoformat(core["created"].replace("Z", "+00:00")) if core.get("created") else None
    except ValueError:
        date = None
    total = sum(skipped.values())
    metadata = {"slide_count": len(slides), "skipped_object_count": total, "skipped_object_types": " ".join(f"{k}:{n}" for k, n in sorted(skipped.items()))} | {f"core_{k}": v for k, v in core.items() if v}
    warnings = [f"Skipped {total} unsupported or non-text slide objects"] if total else []
    return _document(name, source_id, "PPTX", checksum, core.get("title") or first_title, date, [core["creator"]] if core.get("creator") else [], metadata, warnings, blocks)


# --------------------------------------------------------------------------- PDFs


def parse_pdf(data: bytes, source_id: str | None) -> dict:
    """One block a page, by pypdf where it is installed; blank pages stay, with a warning."""
    try:
        from pypdf import PdfReader
    except ImportError as error:
        raise ParseError("no PDF parser is installed") from error
    checksum = hashlib.sha256(data).hexdigest().upper()
    name = document_id(source_id, checksum)
    reader = PdfReader(io.BytesIO(data), strict=False)
    if reader.is_encrypted and reader.decrypt("") == 0:
        raise ParseError("encrypted PDF cannot be read without credentials")
    blocks, blank = _Blocks(name), []
    for number, page in enumerate(reader.pages, 1):
        text = tidy(page.extract_text() or "")
        if not text:
            blank.append(str(number))
        blocks.put("page_text", text, {"location_type": "page", "location_value": str(number), "page_number": number}, {"character_count": len(text)}, [] if text else ["No text was extracted from this PDF page"])
    about = reader.metadata
    author = about.author if about else None
    warnings = ["Pages with no extracted text: " + ", ".join(blank)] if blank else []
    return _document(name, source_id, "PDF", checksum, about.title if about else None, None, [author] if author else [], {"page_count": len(blocks), "is_encrypted": bool(reader.is_encrypted)}, warnings, blocks)


def _document(name, source_id, form, checksum, title, date, people, metadata, warnings, blocks) -> dict:
    if date is not None and date.tzinfo is not None:
        date = date.astimezone(timezone.utc).replace(tzinfo=None)
    return {
        "schema_version": "0.1", "document_id": name, "source_id": source_id, "source_format": form, "filename": None, "checksum_sha256": checksum, "title": title, "document_date": date, "authors_or_senders": people,
        "metadata": {k: str(v) for k, v in metadata.items() if v is not None}, "warnings": warnings, "parse_status": "success_with_warnings" if warnings else "success", "blocks": list(blocks),
    }


PARSERS: dict[str, Callable[[bytes, str | None], dict]] = {".eml": parse_eml, ".pptx": parse_pptx, ".pdf": parse_pdf}
_PARSED = schemas.DOCUMENT + ", path string, error_class string, error string"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content of files, at any depth."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", "content")


def parse(found: DataFrame, parsers: dict[str, Callable[[bytes, str | None], dict]] | None = None) -> DataFrame:
    """Documents of rows (path, content, and source_id if there is one). Unknown suffixes and
    unreadable files have ``error_class`` and ``error`` and no blocks."""
    chosen = parsers or PARSERS
    source = F.col("source_id") if "source_id" in found.columns else F.lit(None)
    rows = found.select("path", "content", source.cast("string").alias("source_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content, name in zip(pdf["path"], pdf["content"], pdf["source_id"], strict=True):
                empty = dict.fromkeys(COLUMNS)
                file = path.rpartition("/")[2]
                try:
                    kind = "." + file.rpartition(".")[2].lower() if "." in file else ""
                    if kind not in chosen:
                        raise ParseError(f"unsupported suffix: {kind or 'none'}")
                    out.append(empty | chosen[kind](bytes(content), name) | {"filename": file, "path": path})
                except Exception as error:
                    out.append(empty | {"source_id": name, "filename": file, "path": path, "parse_status": "failed", "error_class": type(error).__name__, "error": str(error)})
            yield pd.DataFrame(out, columns=COLUMNS)

    return rows.mapInPandas(run, _PARSED)


COLUMNS = ["schema_version", "document_id", "source_id", "source_format", "filename", "checksum_sha256", "title", "document_date", "authors_or_senders", "metadata", "warnings", "parse_status", "blocks", "path", "error_class", "error"]


def blocks(documents: DataFrame) -> DataFrame:
    """The block rows of parsed documents."""
    rows = documents.select("source_id", "document_id", F.explode("blocks").alias("b"))
    return rows.select("source_id", "document_id", "b.block_id", "b.sequence", "b.block_type", "b.text", "b.location.location_type", "b.location.location_value", "b.warnings", "b.metadata")

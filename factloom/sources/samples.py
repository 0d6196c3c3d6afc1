"""Sample documents made from a rule: e-mails and slide decks as bytes, equal on every run."""

from __future__ import annotations

import io
import zipfile
from email.message import EmailMessage
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

_STAMP = (2026, 1, 1, 0, 0, 0)
_XML = {"a": "http://schemas.openxmlformats.org/drawingml/2006/main", "p": "http://schemas.openxmlformats.org/presentationml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_NAMES = " ".join(f'xmlns:{k}="{v}"' for k, v in _XML.items())
_RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"


def mail(number: int, history: bool = False) -> bytes:
    """An e-mail of a thread; every second one may quote the one before."""
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = f"Plan {number}", f"Writer {number % 3} <w{number % 3}@example.org>", "Board <board@example.org>"
    m["Date"], m["Message-ID"] = f"Mon, {1 + number % 28:02d} Jun 2026 09:00:00 +0000", f"<m{number}@example.org>"
    if number:
        m["References"] = f"<m{number - 1}@example.org>"
    body = f"The board approved plan {number}.\nThe office will publish report {number}.\n"
    m.set_content(body + (f"\n----- Original Message -----\nThe council must review plan {number - 1}.\n" if history else ""))
    return m.as_bytes()


def _box(number: int, top: int, text: str, title: bool) -> str:
    kind = '<p:ph type="title"/>' if title else ""
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{number}" name="box {number}"/><p:cNvSpPr/><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{top}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{escape(text)}</a:t></a:r></a:p></p:txBody></p:sp>'


def deck(slides: list[list[str]]) -> bytes:
    """A slide deck: the first text of each slide is its title. File times are fixed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:

        def put(name: str, text: str) -> None:
            file.writestr(zipfile.ZipInfo(name, _STAMP), text)

        numbers = range(1, len(slides) + 1)
        put("ppt/presentation.xml", f"<p:presentation {_NAMES}><p:sldIdLst>" + "".join(f'<p:sldId id="{255 + n}" r:id="rId{n}"/>' for n in numbers) + "</p:sldIdLst></p:presentation>")
        put("ppt/_rels/presentation.xml.rels", f'<Relationships xmlns="{_RELATIONS}">' + "".join(f'<Relationship Id="rId{n}" Target="slides/slide{n}.xml"/>' for n in numbers) + "</Relationships>")
        for n, texts in zip(numbers, slides, strict=True):
            boxes = "".join(_box(i + 2, 100 * i, t, i == 0) for i, t in enumerate(texts))
            put(f"ppt/slides/slide{n}.xml", f"<p:sld {_NAMES}><p:cSld><p:spTree>{boxes}</p:spTree></p:cSld></p:sld>")
    return out.getvalue()


def corpus(spark: SparkSession, mails: int = 6, decks: int = 2) -> DataFrame:
    """Rows (path, content, source_id) that the parsers take."""
    rows = [(f"mail-{n}.eml", mail(n, history=n % 2 == 1), f"M{n:03d}") for n in range(mails)]
    rows += [(f"deck-{n}.pptx", deck([[f"Programme {n}", f"Budget of GBP {n + 1} million."], ["Risks", "A risk of delay."]]), f"D{n:03d}") for n in range(decks)]
    return spark.createDataFrame([(p, bytearray(c), s) for p, c, s in rows], "path string, content binary, source_id string")

import io
import zipfile

from factloom.operators import ingest, retrieval, validation
from factloom.sources import documents, tables
from factloom.streaming import ingest as incremental

MAIL = b"""From: Ann Lee <ann@example.org>\r
To: Bob <bob@example.org>\r
Subject: Plan\r
Date: Tue, 03 Mar 2026 10:00:00 +0200\r
Message-ID: <m1@example.org>\r
References: <m0@example.org>\r
Content-Type: text/plain; charset=utf-8\r
\r
The board approved the plan.  \r
\r
----- Original Message -----\r
old text\r
"""
_NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _shape(number, y, text, kind=""):
    holder = f'<p:ph type="{kind}"/>' if kind else ""
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{number}" name="s{number}"/><p:cNvSpPr/><p:nvPr>{holder}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'


def deck() -> bytes:
    table = '<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="9" name="t"/></p:nvGraphicFramePr><p:xfrm><a:off x="0" y="50"/></p:xfrm><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>a</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p/></a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    group = f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="7" name="g"/></p:nvGrpSpPr><p:grpSpPr/>{_shape(8, 0, "inner")}</p:grpSp>'
    picture = '<p:pic><p:nvPicPr><p:cNvPr id="5" name="pic"/></p:nvPicPr><p:spPr/></p:pic>'
    slide = f'<p:sld {_NS}><p:cSld><p:spTree>{_shape(2, 90, "body")}{_shape(3, 10, "Title", "title")}{table}{group}{picture}</p:spTree></p:cSld></p:sld>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        file.writestr("ppt/presentation.xml", f'<p:presentation {_NS}><p:sldIdLst><p:sldId id="256" r:id="rId1"/></p:sldIdLst></p:presentation>')
        file.writestr("ppt/_rels/presentation.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="slides/slide1.xml"/></Relationships>')
        file.writestr("ppt/slides/slide1.xml", slide)
    return out.getvalue()


def test_files_are_parsed_by_suffix_and_errors_stay_in_their_row(spark, tmp_path):
    (tmp_path / "a.EML").write_bytes(MAIL)
    (tmp_path / "b.pptx").write_bytes(deck())
    (tmp_path / "c.pptx").write_bytes(b"not a zip")
    (tmp_path / "d.txt").write_bytes(b"x")
    parsed = documents.parse(documents.files(spark, str(tmp_path))).cache()
    by = {r.filename: r for r in parsed.collect()}
    mail = by["a.EML"]
    assert [b.block_type for b in mail.blocks] == ["email_header"] * 6 + ["email_body", "quoted_history"]
    assert mail.blocks[6].text == "The board approved the plan." and mail.blocks[7].text == "----- Original Message -----\nold text"
    assert str(mail.document_date) == "2026-03-03 08:00:00" and mail.authors_or_senders == ["Ann Lee <ann@example.org>"]
    assert [(b.block_type, b.text) for b in by["b.pptx"].blocks] == [("shape_text", "inner"), ("slide_title", "Title"), ("table", "a\t"), ("shape_text", "body")]
    assert by["b.pptx"].title == "Title" and by["b.pptx"].warnings == ["Skipped 1 unsupported or non-text slide objects"]
    assert by["c.pptx"].error_class == "BadZipFile" and by["d.txt"].error == "unsupported suffix: .txt"
    rows = documents.blocks(parsed.where("error IS NULL"))
    assert validation.sequence_violations(rows).count() == 0 and validation.block_violations(rows).count() == 0
    assert retrieval.records(rows.fillna("S", ["source_id"])).count() == 12


def test_html_only_mail_fails():
    try:
        documents.parse_eml(b"Content-Type: text/html\r\n\r\n<p>x</p>", None)
        raise AssertionError("should fail")
    except documents.ParseError:
        pass


def test_csv_with_byte_order_mark_and_manifest_join(spark, tmp_path):
    (tmp_path / "register.csv").write_text("﻿source_id,source_format,local_filename,sha256,corpus_status,more\nS1,PDF,raw/a.pdf," + "a" * 64 + ",approved,x\nS2,PDF,../b.pdf,zz,pending,y\n", encoding="utf-8")
    (tmp_path / "split.csv").write_text("source_id,document_family,source_format,split\nS1,F,PDF,development\nS2,F,PPTX,development\nS3,F,PDF,development\n")
    from factloom import schemas

    register, split = tables.read_csv(spark, str(tmp_path / "register.csv"), schemas.REGISTER), tables.read_csv(spark, str(tmp_path / "split.csv"), schemas.SPLIT)
    found = {r.source_id: r.problems for r in ingest.active_sources(split, register, "development").collect()}
    assert found == {"S1": [], "S2": ["not_approved", "format_mismatch", "bad_checksum", "unsafe_path"], "S3": ["not_registered"]}


def test_guarded_lines_of_other_splits_are_never_parsed(spark, tmp_path):
    (tmp_path / "gold.jsonl").write_text('{"id": "1", "split": "development"}\n{"id": broken, "split": "held_out"}\n\n')
    assert [r.id for r in tables.read_guarded(spark, str(tmp_path / "gold.jsonl"), "id string, split string").collect()] == ["1"]


def test_stream_appends_each_content_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.eml").write_bytes(MAIL)
    (tmp_path / "in" / "copy.eml").write_bytes(MAIL)
    incremental.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8

"""Closed schemas of the data model, as DDL."""

from __future__ import annotations


LOCATION = "struct<location_type string, location_value string, page_number int, slide_number int, message_id string, element_index int>"
BLOCK = f"struct<block_id string, sequence int, block_type string, text string, parent_block_id string, metadata map<string,string>, warnings array<string>, location {LOCATION}>"
DOCUMENT = (
    "schema_version string, document_id string, source_id string, source_format string, filename string, checksum_sha256 string, title string, "
    f"document_date timestamp, authors_or_senders array<string>, metadata map<string,string>, warnings array<string>, parse_status string, blocks array<{BLOCK}>"
)
BLOCK_ROW = "source_id string, document_id string, block_id string, sequence int, block_type string, text string, location_type string, location_value string, warnings array<string>, metadata map<string,string>"
STATEMENT = "source_id string, block_id string, sequence int, block_type string, line_number int, text string, start int, end int, context string, context_start int"
EVIDENCE = "evidence_id string, source_id string, block_id string, location_type string, location_value string, text_excerpt string, evidence_status string"
FACT = (
    "candidate_id string, source_id string, document_family string, subject_text string, subject_type string, predicate string, raw_value string, "
    "value_type string, value_text string, value_number decimal(38,9), value_currency string, qualifiers map<string,string>, evidence_ids array<string>, confidence double, review_status string"
)
QUESTION = "id string, question string, expected_source_id string, expected_block_ids array<string>"
REGISTER = "source_id string, source_format string, local_filename string, sha256 string, corpus_status string"
SPLIT = "source_id string, document_family string, source_format string, split string"

# Fixed values.
SOURCE_FORMATS = ("PDF", "PPTX", "EML")
BLOCK_TYPES = ("page_text", "slide_title", "shape_text", "table", "email_header", "email_body", "quoted_history", "metadata")
ELIGIBLE_BLOCK_TYPES = ("page_text", "slide_title", "shape_text", "table", "email_body")
LOCATION_TYPES = {"PDF": ("page",), "PPTX": ("slide", "shape"), "EML": ("header", "message_body")}
SPLITS = ("development", "held_out")

"""Declared schemas of records and store tables."""

from __future__ import annotations

from pyspark.sql import types as T

_page = "document_id string, page_number int, text_content string, char_count int"
_document = (
    "id string, title string, date string, source string, category string, summary string, ocrText string, "
    "tags array<string>, personIds array<string>, pageCount int, pdfUrl string, batesRange string"
)


def _struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


class _Lazy(dict):
    """DDL text parsed at first use: parsing needs a running session."""

    def __missing__(self, key: str) -> T.StructType:
        self[key] = _struct(_DDL[key])
        return self[key]


_DDL = {
    "record_document": _document,
    "record": f"source_path string, document struct<{_document}>, pages array<struct<{_page}>>, "
              f"{_document}, _corrupt_record string",
    "person_json": "id string, slug string, name string, aliases array<string>, category string, shortBio string",
    "documents": "doc_id string, title string, date date, source string, category string, summary string, total_pages bigint, "
                 "total_chars bigint, file_path string, tags string",
    "pages": "doc_id string, page_number int, text_content string, char_count int",
    "persons": "person_id string, slug string, name string, aliases string, category string, short_bio string",
    "document_persons": "document_id string, person_id string",
    "entities": "document_id string, entity_type string, text string, confidence double, person_id string",
    "images": "doc_id string, page_number int, image_index int, width int, height int, format string, file_path string, "
              "description string, size_bytes bigint",
    "transcripts": "doc_id string, source_path string, text string, language string, duration_seconds double",
    "captions": "doc_id string, page_number int, caption string, ocr_text string",
    "chunks": "doc_id string, chunk_index int, chunk_text string, char_offset int, token_count_est int",
    "page_embeddings": "doc_id string, page_number int, model string, dims int, embedding array<float>",
    "redaction_scores": "doc_id string, total_redactions int, proper_redactions int, improper_redactions int, "
                        "redaction_density double, page_count int",
    "recovered_text": "doc_id string, page_number int, text string, confidence double",
}

STORE = _Lazy()


def __getattr__(name: str) -> T.StructType:
    if name in ("RECORD", "RECORD_DOCUMENT", "PERSON_JSON"):
        return STORE[name.lower()]
    raise AttributeError(name)

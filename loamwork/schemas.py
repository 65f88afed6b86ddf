"""The fixed schemas of the corpus store, and the values that enumerated columns may hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Enumerations, seasons in time order, limits.
DOCUMENT_CAMPUSES = ["Hammond", "Westville", "Both", "N/A"]
CAMPUSES = ["Hammond", "Westville"]
CONTACT_CAMPUSES = ["Hammond", "Westville", "Both"]
DOCUMENT_LEVELS = ["Undergraduate", "Graduate", "Both", "N/A"]
LEVELS = ["Undergraduate", "Graduate"]
CONTENT_TYPES = ["html", "pdf"]
STATUSES = ["active", "ended"]
ROLES = ["student", "chatbot"]
REPLY_TYPES = ["answer", "clarifying_question", "escalation"]
SLOTS = ["campus", "academicLevel"]
EVERGREEN = "evergreen"
EMBEDDING_DIM = 768
RETENTION_DAYS = 90

CITATION = "struct<source_document_id:string,title:string,url:string>"

SCHEMAS = {
    "source_documents": "doc_id string, source_url string, title string, content_type string, parsed_content string, content_hash string, campus string, academic_level string, term string, parent_doc_id string, last_ingested_at timestamp, last_verified_at timestamp",
    "document_chunks": "doc_id string, chunk_index int, chunk_text string, context_text string, embedding array<float>",
    "department_contacts": "name string, topics array<string>, contact_method string, campus string",
    "conversations": "conversation_id string, started_at timestamp, campus string, academic_level string, status string, pending_question string",
    "messages": "message_id string, conversation_id string, role string, text string, created_at timestamp, answer_id string",
    "answers": f"answer_id string, message_id string, response_text string, citations array<{CITATION}>, escalated boolean, department string",
    "retained_transcripts": "conversation_ref string, deidentified_text string, created_at timestamp, purge_after timestamp",
    "transcript_review_queue": "conversation_ref string, held_text string, reason string, created_at timestamp, purge_after timestamp",
    "seeds": "name string, url string, max_depth int, follow array<string>, follow_pdfs boolean, max_pages int, campus string, academic_level string, term string",
    "fetch_results": "url string, final_url string, status int, content_type string, content binary, headers map<string,string>",
    "extracted_pages": "url string, title string, markdown string, content_type string, child_links array<string>, pdf_links array<string>",
    "pdf_lines": "doc string, page int, line int, top double, bottom double, text string, size double, all_bold boolean, n_chars int",
    "pdf_tables": "doc string, page int, top double, bottom double, rows array<array<string>>",
}


def document_id(url: Column) -> Column:
    """An id that depends on the URL alone, so that retries and reruns agree."""
    return F.sha2(url, 256)


def conformed(df: DataFrame, table: str) -> DataFrame:
    """`df` with just the table's columns, in order and cast; a missing column raises."""
    schema = df.sparkSession.createDataFrame([], SCHEMAS[table]).schema
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))

"""Schemas of the engine's tables."""

from __future__ import annotations

RAW_DOCS = "doc_id BIGINT, label STRING, text STRING"
SOURCE_FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
CHUNKS = "path STRING, chunk_no INT, content BINARY"
DOC_TOKENS = "doc_id BIGINT, tokens ARRAY<STRING>"
VOCAB = "token STRING, df BIGINT, idf DOUBLE"
POSTINGS = "token STRING, doc_id BIGINT, tf BIGINT"
TOKEN_VECTORS = "token STRING, vec ARRAY<TINYINT>"
ENRICHED = "token STRING, q ARRAY<TINYINT>"
DOC_VECTORS = "doc_id BIGINT, q ARRAY<TINYINT>, inv_mag DOUBLE"
DOC_MEAN = "mean ARRAY<DOUBLE>"
LABELS = "doc_id BIGINT, label STRING"
FUNCTIONS = (
    "node_id BIGINT, file_path STRING, tfidf MAP<INT,DOUBLE>, ri ARRAY<DOUBLE>, api ARRAY<DOUBLE>, type ARRAY<DOUBLE>, deco ARRAY<DOUBLE>, struct_profile ARRAY<DOUBLE>"
)
RANKED = "query_id BIGINT, rank INT, doc_id BIGINT, score DOUBLE"
EDGES = "src BIGINT, dst BIGINT, score DOUBLE"

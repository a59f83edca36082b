"""The relations of a corpus of versioned, hierarchical documents, as Spark schemas."""

from __future__ import annotations

SPECS = "id string, version string, version_token string, title string, release string, series string"
SECTIONS = "ord long, spec_id string, version string, number string, title string, level int, parent_number string, content string"
EDGES = "source_spec_id string, source_version string, source_section string, target_spec string, target_section string, context string"
OPENAPI_DOCS = "spec_id string, api_name string, version string, filename string, content string"
CHUNKS = "ord long, spec_id string, api_name string, filename string, kind string, name string, body string"
DEFS = "ord long, name string, key string, spec_id string, version string, section_number string, section_title string, body string"
IMAGES = "spec_id string, version string, name string, mime_type string, data binary, llm_readable boolean"
CACHE_ENTRIES = "spec_id string, version string, bytes long, fetched_at timestamp, last_used_at timestamp, images_fetched boolean"

"""Schemas of the engine's tables, as DDL."""

CHUNKS = "project string, id string, file_path string, start_line int, end_line int, content string, chunk_type string, embedding array<float>, norm double, last_modified timestamp, indexed_at timestamp"
FILE_STATE = "project string, path string, content_hash string"
FILE_CHANGES = "path string, change string"
MEMORIES = "project string, id int, guid string, name string, alias string, tags array<string>, text string, timestamp timestamp, parent_id int, lines_count int, size_kb double, created_at timestamp, updated_at timestamp"
MEMORY_VECTORS = "memory_id int, project string, content string, embedding array<float>, dimension int, indexed_at timestamp"
EMBEDDING_CACHE = "content_hash string, embedding_type string, model string, project string, embedding array<float>, created_at timestamp, last_accessed timestamp, access_count long"
SYNONYMS = "term string, synonym string, ord int, term_ord int"
METADATA = "project string, key string, value string"
CHANGE_EVENTS = "project string, path string, change string, ts timestamp"
PIECES = "path string, content string, start_line int, end_line int, chunk_type string"

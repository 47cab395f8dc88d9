"""Row types of the engine's tables."""

from __future__ import annotations

CHUNK = (
    "id string, path string, slug string, title string, type string, tags array<string>, confidence string, "
    "heading string, level int, text string, is_raw boolean, text_hash string, start_line int, end_line int"
)
VECTOR_ROW = CHUNK + ", parent_id string, vector_ordinal int, vector array<float>"
DOCUMENT = (
    "path string, slug string, title string, type string, tags array<string>, confidence string, frontmatter string, "
    "frontmatter_lines int, body string, text string, is_raw boolean, size long, mtime double, dir_rank int"
)
FILE_STATE = "path string, sha256 string, size_bytes long, line_count long, content_text string, last_seen_at double, include_raw int"
FILE_CHANGES = (
    "id long, path string, kind string, observed_at double, old_sha256 string, new_sha256 string, old_size_bytes long, "
    "new_size_bytes long, old_line_count long, new_line_count long, byte_delta long, line_delta long, added_lines long, removed_lines long"
)
MANIFEST = (
    "wiki_path string, backend string, pages_indexed long, chunks_indexed long, include_raw boolean, last_indexed_at double, "
    "embedding_model string, embedding_backend string, embedding_dimensions int, embedding_device string, "
    "embedding_max_length int, bm25_weight double, vector_weight double"
)
MANIFEST_FILES = "path string, mtime double, size long, chunks long"
ISSUE = "code string, severity string, message string, path string, field string, details map<string,string>"

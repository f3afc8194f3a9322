"""Schemas of the stored tables, as column lists that Spark reads as DDL."""

DOCUMENTS = "id long, file_path string, title string, body string, file_type string, modified_at long, size_bytes long"
CHUNKS = (
    "parent_file_id long, chunk_id long, chunk_index int, text string, start_offset int, end_offset int,"
    " embedding array<float>, created_at long"
)
POSITIONS = "chunk_id long, pos int, term string, dl int"
LSH_BUCKETS = "table int, hash int, chunk_id long"
METRICS = (
    "seq long, query string, total_ms long, bm25_ms long, dense_ms long, fusion_ms long, final_count long,"
    " memory_mb long, ts long"
)
#: Version of the stored layout; a snapshot of another version is not read but rebuilt.
VERSION = 1

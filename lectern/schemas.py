"""The library's data model as Spark DDL."""

CREATOR = "struct<first_name: string, last_name: string, name: string, creator_type: string>"
ITEM = (
    "key string, version int, item_type string, title string, date_added timestamp_ntz, date_modified timestamp_ntz, "
    f"fields map<string, string>, note string, creators array<{CREATOR}>, tags array<struct<tag: string, type: int>>, "
    "collections array<string>, relations map<string, array<string>>, parent_key string, library_id int, deleted boolean, "
    "content_type string, link_mode int, path string"
)
COLLECTION = "key string, version int, name string, parent_key string, library_id int"
MEMBERSHIP = "collection_key string, item_key string"
FULLTEXT = "key string, content string, indexed_chars int, total_chars int"
ANNOTATION = "key string, parent_key string, annotation_type string, annotation_text string, annotation_comment string, annotation_color string, annotation_position string"
RELATION = "key_a string, key_b string"
SAVED_SEARCH = "key string, name string, conditions array<struct<field: string, op: string, value: string>>"
SETTING = "key string, value string"
RAW_ARTIFACT = "item_key string, attachment_key string, provider string, payload string, files map<string, binary>, source_path string, created_at timestamp"
BLOCK = (
    "block_id string, attachment_key string, item_key string, type string, page int, bbox array<double>, reading_order int, "
    "section_heading string, text string, caption string, image_ref string, source_provider string, source_ref string, "
    "confidence double, provenance_strength string"
)
EVIDENCE = "struct<block_id: string, type: string, page: int, bbox: array<double>, caption: string, image_ref: string>"
CHUNK = (
    "chunk_id string, item_key string, attachment_key string, block_ids array<string>, block_types array<string>, section_heading string, "
    f"page_start int, page_end int, text string, char_start int, char_end int, level string, evidence_refs array<{EVIDENCE}>, provenance_strength string"
)
TEXT_CHUNK = "text string, section string, chunk_index int"
EMBEDDING = "item_key string, chunk_id string, ordinal int, text_sha256 string, vector array<float>, model string, dim int"
HIT = (
    "item_key string, title string, text string, authors array<string>, year int, venue string, doi string, uri string, "
    "section_heading string, chunk_id string, block_ids array<string>, query string, score double"
)
CITATION = "item_key string, attachment_id string, title string, authors string, section string, chunk_index int, text string, score double"
PUSH_RESULT = "status string, key string, pdf_attached boolean, pdf_size_bytes bigint"

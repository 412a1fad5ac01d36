"""Schemas of the state tables and of the structs that operators emit."""

from __future__ import annotations

CHANGE = "struct<type:string,original:string,corrected:string,position:int,confidence:double,reason:string>"
ISSUE = "struct<issue_type:string,description:string,row:int,col:int,severity:string>"
METADATA = (
    "struct<page:int,extraction_method:string,has_images:boolean,image_index:int,image_format:string,image_size:bigint,caption:string,"
    "xref:int,table_index:int,rows:int,columns:int,extraction_quality:string,sub_chunk:int,chunking_strategy:string>"
)

#: DDL strings of the state tables; document records are called doc_meta because the corpus table is called documents.
TABLES = {
    "chunks": f"document_id string, chunk_id string, content string, page_start int, page_end int, section_hierarchy string, chunk_type string, metadata {METADATA}, created_at timestamp",
    "reviews": f"review_id string, chunk_id string, status string, original_content string, reviewed_content string, changes array<{CHANGE}>, confidence_score double, reviewer string, created_at timestamp, updated_at timestamp",
    "cross_references": "ref_id string, chunk_id string, reference_text string, reference_type string, target_id string, is_valid boolean, page_number int",
    "doc_meta": "document_id string, filename string, total_pages int, total_chunks int, created_at timestamp, updated_at timestamp, has_embeddings boolean, embedding_model string",
    "embeddings": "embedding_id bigint, chunk_id string, embedding array<float>, model string, created_at timestamp",
    "patterns": "pattern_id string, original_text string, corrected_text string, issue_type string, confidence double, frequency bigint, created_at timestamp, last_seen timestamp",
}

STATUSES = ("pending", "in_progress", "completed", "needs_review")

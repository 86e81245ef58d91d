"""Fixed schemas of the data model; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

CORPUS = T.StructType([T.StructField("_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])
QUERY = T.StructType([T.StructField("_id", T.StringType()), T.StructField("text", T.StringType())])
QRELS = "query_id string, doc_id string, score int"
DOCUMENT = "doc_id string, title string, text string"
CHUNK = "doc_id string, representation string, ordinal int, text string, embedding_required boolean"
HIT = "query_id string, doc_id string, score double, rank int"
SIGNAL = "query_id string, doc_id string, channel string, representation string, score double, rank int, generated boolean"
RETRIEVAL_RECORD = "schema_version string, run_id string, result struct<schema_version:string,query_id:string,strategy:string,cutoff:int,latency_ms:double,hits:array<struct<doc_id:string,score:double>>,error_type:string,error_message:string>"
JOURNAL_EVENT = "event string, candidate_id string, attempt_id string, status string, payload string"
EVALUATION_CASE = (
    "schema_version string, query_id string, claim string, source_split string, expected_stance string, cited_document_ids array<string>, "
    "rationales array<struct<doc_id:string,label:string,sentence_indices:array<int>,sentences:array<string>>>"
)
SPAN = "struct<start:int,end:int,text:string>"
MENTION = "struct<start:int,end:int,text:string,pos_tags:array<string>,is_possessive:boolean>"

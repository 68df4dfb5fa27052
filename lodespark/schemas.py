"""Row types of the engine. Schemas are declared, never inferred."""

from __future__ import annotations

PARAGRAPHS = "array<struct<id:string,title:string,chunk:string>>"
SAMPLE = (
    f"id string, hop int, type string, question string, answer string, answer_aliases array<string>, chunks {PARAGRAPHS}, supporting_facts {PARAGRAPHS}, "
    "decomposition array<struct<id:string,question:string,answer:string>>, evidences array<struct<subject:string,relation:string,object:string>>"
)
#: Raw sets of title-and-sentences pairs; pairs mix types and are read as text.
RAW_PAIRS = "_id string, type string, question string, answer string, context array<array<string>>, supporting_facts array<array<string>>, evidences array<array<string>>"
RAW_PARAGRAPHS = (
    "id string, answerable boolean, question string, answer string, answer_aliases array<string>, paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>, "
    "question_decomposition array<struct<id:string,question:string,answer:string>>"
)
CHUNK = "source_doc_id string, chunk_idx int, chunk_id string, start int, title string, chunk_text string"
TRACE = (
    "id string, entity_text string, entity_type string, entity_description string, entity_importance double, source_chunk_id string, source_doc_id string, status string, access_count bigint, "
    "created_at timestamp"
)
MANIFEST = "doc_id string, content_md5 string"
EDGE = "source string, target string, type string"
VECTOR = "vec_id bigint, id string, embedding array<float>"
#: Append-only logs of retrieval: each returned trace, each change of a status.
ACCESS = "id string, at timestamp"
ACTIVATION = "id string, status string, at timestamp"
WORKSPACE = {"chunks": CHUNK, "traces": TRACE, "edges": EDGE, "manifest": MANIFEST, "trace_vectors": VECTOR, "chunk_vectors": VECTOR, "accesses": ACCESS, "activations": ACTIVATION}
#: Tables of the trace store and of the chunk store, which can be reset each by itself.
TRACE_STORE = ("traces", "edges", "trace_vectors", "accesses", "activations")
CHUNK_STORE = ("chunks", "chunk_vectors", "manifest")
#: What a committed batch adds and drops; batches count in the order of ``seq``.
COMMIT = "seq bigint, batch string, tables array<string>, dropped array<string>"
PREDICTION = (
    "id string, question string, predicted_answer string, ground_truth_answer string, ground_truth_aliases array<string>, processing_time double, "
    "sources array<struct<rank:int,doc_id:string,chunk_id:string,text_preview:string>>, top_k int"
)

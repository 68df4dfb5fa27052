"""SQL of the queries in ``retrieval_queries`` that SQL can express."""

from __future__ import annotations

# Fixed values, written out here too, so that the SQL does not share a mistake with the functions it is compared with.
_PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
_STOP = "'a', 'an', 'the', 'and', 'but', 'or', 'is', 'are', 'was', 'were'"
_MARK = "FINAL_ANSWER_TEXT:"
_NO_PREVIEW = "No text preview available"
_TYPES = {
    "PERSON": "PEOPLE INDIVIDUAL HUMAN PERSONAL",
    "ORG": "ORGANIZATION COMPANY INSTITUTION CORPORATION AGENCY GROUP",
    "LOC": "LOCATION PLACE GEOGRAPHICAL GEOGRAPHY AREA REGION COUNTRY CITY",
    "CONCEPT": "IDEA THEORY PRINCIPLE METHODOLOGY METHOD TECHNIQUE APPROACH",
    "DATE": "TIME PERIOD YEAR MONTH DAY DATETIME TEMPORAL",
    "EVENT": "HAPPENING OCCURRENCE INCIDENT OCCASION",
    "PRODUCT": "SERVICE OFFERING ITEM GOOD MERCHANDISE",
    "WORK": "BOOK MOVIE FILM PUBLICATION ARTWORK CREATION",
    "QUANTITY": "MEASUREMENT NUMBER AMOUNT VALUE METRIC",
    "MISC": "MISCELLANEOUS OTHER UNKNOWN VARIOUS",
}
_BUDGET = ((1, 2), (3, 3), (5, 4), (10, 5), (20, 6), (40, 8), (80, 10), (100, 12), (120, 15))
_SPACE = r"[\s\p{Z}]+"


def _tokens(x: str) -> str:
    return f"list_filter(string_split_regex(translate(lower(coalesce({x}, '')), '{_PUNCTUATION}', ''), '{_SPACE}'), lambda w: w <> '' AND w NOT IN ({_STOP}))"


def _blank(x: str) -> str:
    return f"({x} IS NULL OR regexp_replace({x}, '{_SPACE}', '', 'g') = '')"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"


_VECTORS = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, CASE vec_id % 3 WHEN 0 THEN 'archived' WHEN 1 THEN 'dormant' ELSE 'active_in_stm' END AS status FROM embeddings),
q AS (SELECT vec_id AS query_id, v AS qv FROM e WHERE vec_id % 20 = 0)"""


def _near(name: str, k: int, queries: str = "q", corpus: str = "e", where: str = "true") -> str:
    return f"""{name} AS (SELECT query_id, vec_id, v, CAST(r AS INTEGER) AS rank, d AS distance, status, label FROM (
        SELECT query_id, vec_id, v, status, label, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r
        FROM (SELECT query_id, vec_id, v, status, label, round(pow(list_distance(qv, v), 2), 9) AS d FROM {queries} CROSS JOIN {corpus} WHERE {where})) WHERE r <= {k})"""


_CENTROID = """cen AS (SELECT query_id, list(m ORDER BY pos) AS qv FROM (SELECT query_id, pos, avg(x) AS m FROM (
        SELECT query_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM i WHERE rank <= 10) GROUP BY query_id, pos) GROUP BY query_id)"""
_ASSOCIATIVE = f"""WITH {_VECTORS}, {_near("i", 20)}, {_CENTROID}, {_near("s", 60, "cen")},
    fresh AS (SELECT s.query_id, s.vec_id, s.v, 20 + row_number() OVER (PARTITION BY s.query_id ORDER BY s.rank) AS discovery FROM s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.query_id = s.query_id AND i.vec_id = s.vec_id)),
    found AS (SELECT query_id, vec_id, v, rank AS discovery FROM i UNION ALL SELECT query_id, vec_id, v, discovery FROM fresh)"""


def _rerank(source: str, k: int) -> str:
    return f"""SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, round(sim, 6) AS similarity FROM (
        SELECT query_id, vec_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, discovery) AS r FROM (
        SELECT {source}.query_id, vec_id, discovery, round(list_cosine_similarity(v, qv), 9) AS sim FROM {source} JOIN q USING (query_id))) WHERE r <= {k}"""


#: The mean vector of each chunk's traces.
_MEANS = """c0 AS (SELECT vec_id % 100 AS vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e),
    cv AS (SELECT vec_id, list(m ORDER BY pos) AS v, 0 AS label, '' AS status FROM (SELECT vec_id, pos, avg(x) AS m FROM c0 GROUP BY vec_id, pos) GROUP BY vec_id)"""
_CHUNK = "'chunk_' || CAST(vec_id % 100 AS VARCHAR)"
_CHUNKS = "chunks AS (SELECT DISTINCT chunk_id, title, chunk_text, source_doc_id FROM (SELECT chunk_id, title, chunk_text, source_doc_id FROM chunk_metadata UNION ALL SELECT chunk_id, title, chunk_text, source_doc_id FROM pinned_chunks))"
_PREDICTIONS = "p AS (SELECT DISTINCT ON (prediction_id) * FROM predictions)"
_SAMPLES = "s AS (SELECT DISTINCT ON (id) * FROM samples)"
_MANIFEST = "m AS (SELECT doc_id, md5(CASE WHEN doc_id % 6 = 1 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END) AS h FROM documents WHERE doc_id % 3 <> 0)"
_GOLDS = """CASE WHEN ground_truth_answer IS NULL OR list_contains(list_filter(coalesce(ground_truth_aliases, []), lambda a: a IS NOT NULL), ground_truth_answer)
    THEN list_filter(coalesce(ground_truth_aliases, []), lambda a: a IS NOT NULL) ELSE list_append(list_filter(coalesce(ground_truth_aliases, []), lambda a: a IS NOT NULL), ground_truth_answer) END"""
_BAG = "coalesce(list_sum(list_transform(list_distinct(pt), lambda t: least(len(list_filter(pt, lambda x: x = t)), len(list_filter(gt, lambda x: x = t))))), 0)"
_SCORED = f"""{_PREDICTIONS}, g AS (SELECT prediction_id, run_id, top_k, processing_time, question, predicted_answer, {_GOLDS} AS golds FROM p),
    u AS (SELECT prediction_id, {_tokens("predicted_answer")} AS pt, {_tokens("gold")} AS gt, {_blank("gold")} AS b FROM (SELECT prediction_id, predicted_answer, unnest(golds) AS gold FROM g)),
    best AS (SELECT prediction_id, max(CASE WHEN NOT b THEN f END) AS f1, bool_or(same) AS same FROM (
        SELECT prediction_id, b, array_to_string(pt, ' ') = array_to_string(gt, ' ') AS same, CASE WHEN {_BAG} > 0 THEN 2.0 * {_BAG} / (len(pt) + len(gt)) ELSE 0.0 END AS f FROM u) GROUP BY prediction_id),
    scored AS (SELECT g.*, CASE WHEN coalesce(predicted_answer <> '' AND same, false) THEN 1.0 ELSE 0.0 END AS em, coalesce(f1, 0.0) AS f1 FROM g LEFT JOIN best USING (prediction_id))"""


def _type_case() -> str:
    u = "upper(coalesce(entity_type, ''))"
    exact = " ".join(f"WHEN {u} = '{t}' THEN '{t}'" for t in _TYPES)
    within = " ".join(f"WHEN {' OR '.join(f'contains({u}, {chr(39)}{v}{chr(39)})' for v in held.split())} THEN '{t}'" for t, held in _TYPES.items())
    return f"CASE WHEN {u} = '' THEN 'MISC' {exact} {within} ELSE 'MISC' END"


def _budget_case() -> str:
    (x, y), *_ = _BUDGET
    parts = [f"WHEN top_k <= {x} THEN {y}"]
    parts += [f"WHEN top_k <= {x1} THEN CAST(floor({y0} + (top_k - {x0}) * {y1 - y0} / {x1 - x0}.0) AS INTEGER)" for (x0, y0), (x1, y1) in zip(_BUDGET, _BUDGET[1:], strict=False)]
    return f"CASE {' '.join(parts)} ELSE {_BUDGET[-1][1]} END"


def _split(clean: bool, source: str = "documents", columns: str = "CAST(doc_id AS VARCHAR) AS source_doc_id, CAST(i AS INTEGER) AS chunk_idx, CAST(s AS INTEGER) AS start, md5(c) AS digest") -> str:
    """The sliding splitter, 512 with 128, as a recursion over all documents at once."""
    window = "substr(text, CAST(s + 1 AS BIGINT), CAST(least(512, n - s) AS BIGINT))"
    last = " ".join(f"WHEN regexp_matches({window}, '{sep}') THEN s + length(regexp_extract({window}, '(?s)^.*{sep}'))" for sep in (r"\. ", r"\n", " "))
    end = f"CASE WHEN s > 0 AND least(s + 512, n) < n THEN CASE {last} ELSE least(s + 512, n) END ELSE least(s + 512, n) END"
    stop = "AND w.e < w.n" if clean else ""
    return rf"""WITH RECURSIVE docs AS (SELECT doc_id, text, length(text) AS n FROM {source} WHERE NOT {_blank("text")}),
    w(doc_id, i, s, e, n) AS (
        SELECT doc_id, 0, 0, least(512, n), n FROM docs
        UNION ALL SELECT doc_id, i, s, {end}, n FROM (SELECT w.doc_id, w.i + 1 AS i, greatest(w.e - 128, w.s + 1) AS s, d.text AS text, w.n AS n FROM w JOIN docs d USING (doc_id) WHERE greatest(w.e - 128, w.s + 1) < w.n {stop}))
    SELECT {columns} FROM (
        SELECT w.doc_id, i, s, substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) AS c FROM w JOIN docs USING (doc_id)) WHERE NOT {_blank("c")}"""


_POINTS = f"""{_SAMPLES}, pts AS (SELECT id, question, answer, CASE dataset WHEN 'hotpotqa' THEN coalesce(supporting_facts, [])
        WHEN '2wiki' THEN list_filter(coalesce(chunks, []), lambda c: NOT {_blank("c.id")} AND NOT {_blank("c.chunk")}) ELSE coalesce(chunks, []) END AS contexts,
        CASE WHEN dataset = '2wiki' THEN 0 ELSE len(coalesce(answer_aliases, [])) END AS aliases FROM s)"""
_PARSED = f"""CASE WHEN instr(a, '{_MARK}') > 0 THEN {_strip(f"substr(a, instr(a, '{_MARK}') + {len(_MARK)})")}
    ELSE coalesce(list_filter(list_transform(string_split(a, chr(10)), lambda x: {_strip("x")}), lambda x: x <> '')[-1], '') END"""
_SOURCES = f"{_PREDICTIONS}, src AS (SELECT prediction_id, pos, s.doc_id AS doc_id, s.chunk_id AS chunk_id, s.title AS title FROM (SELECT prediction_id, unnest(sources) AS s, generate_subscripts(sources, 1) - 1 AS pos FROM p))"
_SCORE = "CASE WHEN entity_importance BETWEEN 1 AND 5 THEN entity_importance ELSE 3.0 END"
_RAW = "CAST(CAST(entity_importance AS DECIMAL(20, 2)) AS VARCHAR)"

SQL = {
    "n1_trace_knn": f"WITH {_VECTORS}, {_near('i', 20)} SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM i",
    "n1_knn_status": f"WITH {_VECTORS}, {_near('i', 30)} SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM i WHERE status IN ('dormant', 'active_in_stm')) WHERE r <= 10",
    "n2_chunk_knn": f"WITH {_VECTORS}, {_near('i', 5)} SELECT query_id, rank, {_CHUNK} AS chunk_id, round(distance, 6) AS distance FROM i",
    "n3_sequence": "SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS seq FROM embeddings",
    "n4_centroid": f"WITH {_VECTORS}, {_near('i', 10)} SELECT query_id, CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) AS value FROM (SELECT query_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM i) GROUP BY query_id, pos",
    "n5_cosine_rerank": f"WITH {_VECTORS}, {_near('i', 20)}, found AS (SELECT query_id, vec_id, v, rank AS discovery FROM i) {_rerank('found', 5)}",
    "n6_associative": f"{_ASSOCIATIVE} {_rerank('found', 5)}",
    "n6_candidates": f"{_ASSOCIATIVE} SELECT query_id, count(*) AS candidates FROM found GROUP BY query_id",
    "n7_hybrid": f"WITH {_VECTORS}, {_MEANS}, {_near('i', 5)}, {_near('c', 5, corpus='cv')} SELECT query_id, {_CHUNK} AS chunk_id FROM i UNION SELECT query_id, {_CHUNK} FROM c",
    "n8_baseline": f"WITH {_VECTORS}, {_near('i', 5)} SELECT query_id, rank, doc_id, title FROM i JOIN documents ON doc_id = vec_id",
    "u1_chunk_list": f"""WITH {_VECTORS}, {_MEANS}, {_near('i', 20)}, {_near('c', 10, corpus='cv')},
        b AS (SELECT query_id, 0 AS source, rank, {_CHUNK} AS chunk_id FROM i UNION ALL SELECT query_id, 1, rank, {_CHUNK} FROM c),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY source, rank) AS n FROM b)
        SELECT query_id, CAST(r AS INTEGER) AS rank, chunk_id FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY source, rank, chunk_id) AS r FROM o WHERE n = 1) WHERE r <= 5""",
    "j1_mentions": f"WITH {_CHUNKS} SELECT chunk_id, title, mentions FROM (SELECT source_chunk_id AS chunk_id, count(*) AS mentions FROM traces WHERE source_chunk_id IS NOT NULL GROUP BY 1) JOIN chunks USING (chunk_id)",
    "j3_new_documents": f"WITH {_MANIFEST} SELECT doc_id, md5(text) AS content_md5 FROM documents d WHERE NOT {_blank('text')} AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = d.doc_id AND m.h = md5(coalesce(d.text, '')))",
    "j3_new_by_id": f"WITH {_MANIFEST} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM m)",
    "j6_gold_answers": f"WITH {_PREDICTIONS} SELECT prediction_id, array_to_string({_GOLDS}, '|') AS golds FROM p",
    "j7_lookup": "SELECT DISTINCT id, entity_text, source_chunk_id FROM traces WHERE id = (SELECT min(id) FROM traces)",
    "k4_graph_nodes": f"WITH {_CHUNKS} SELECT id, 'entity' AS type, entity_text AS text FROM (SELECT DISTINCT id, entity_text, entity_type, entity_description FROM traces WHERE id IS NOT NULL) UNION ALL SELECT DISTINCT chunk_id, 'chunk', chunk_text FROM chunks WHERE chunk_id IS NOT NULL",
    "k4_graph_edges": "SELECT DISTINCT id AS source, source_chunk_id AS target, 'EXTRACTED_FROM' AS type FROM traces WHERE id IS NOT NULL AND source_chunk_id IS NOT NULL",
    "a10_graph_counts": f"""WITH {_CHUNKS} SELECT 'entity' AS type, count(*) AS n FROM (SELECT DISTINCT id, entity_text, entity_type, entity_description FROM traces WHERE id IS NOT NULL)
        UNION ALL SELECT 'chunk', count(*) FROM (SELECT DISTINCT chunk_id, chunk_text FROM chunks) UNION ALL SELECT 'EXTRACTED_FROM', count(*) FROM (SELECT DISTINCT id, source_chunk_id FROM traces WHERE id IS NOT NULL AND source_chunk_id IS NOT NULL)""",
    "d9_valid_documents": f"SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND NOT {_blank('text')}",
    "d11_chunks_compat": _split(False),
    "d11_chunks_clean": _split(True),
    "d13_whole_documents": f"SELECT CAST(doc_id AS VARCHAR) AS source_doc_id, CAST(doc_id AS VARCHAR) || '_chunk_0' AS chunk_id, CAST(length(text) AS INTEGER) AS n_chars FROM documents WHERE NOT {_blank('text')}",
    "d16_entity_text": "SELECT id, entity_text || CASE WHEN entity_description <> '' THEN ': ' || entity_description ELSE '' END AS embed_text FROM traces WHERE entity_text IS NOT NULL",
    "d17_trace_defaults": "SELECT id, entity_text, coalesce(entity_type, 'MISC') AS entity_type, coalesce(entity_description, '') AS entity_description, coalesce(entity_importance, 3.0) AS entity_importance, coalesce(status, 'dormant') AS status, coalesce(access_count, 0) AS access_count FROM traces WHERE entity_text <> ''",
    "d19_truncated": "SELECT doc_id, md5(substr(text, 1, 2048)) AS embed_md5, md5(substr(text, 1, 4000)) AS extract_md5 FROM documents",
    "d20_contexts": f"""WITH {_SOURCES}, {_CHUNKS} SELECT prediction_id, md5(string_agg('Passage ' || CAST(pos + 1 AS VARCHAR) || ' (ID: ' || src.chunk_id || ', From Document: ' || coalesce(doc_id, 'unknown') || ', Title: ' || coalesce(src.title, 'none') || '):' || chr(10) || coalesce(chunk_text, ''), chr(10) || chr(10) ORDER BY pos)) AS context_md5
        FROM src LEFT JOIN chunks USING (chunk_id) GROUP BY prediction_id""",
    "d22_previews": f"SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN '{_NO_PREVIEW}' ELSE substr(text, 1, 150) || '...' END AS preview FROM documents",
    "u4_citations": f"WITH {_SOURCES} SELECT prediction_id, CAST(pos AS INTEGER) AS pos, doc_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY prediction_id, doc_id ORDER BY pos, chunk_id) AS r FROM src WHERE doc_id <> '') WHERE r = 1",
    "f1_normalized": f"WITH {_PREDICTIONS} SELECT prediction_id, array_to_string({_tokens('predicted_answer')}, ' ') AS predicted, array_to_string({_tokens('ground_truth_answer')}, ' ') AS gold FROM p",
    "f2_token_counts": f"SELECT doc_id, CAST(len({_tokens('text')}) AS INTEGER) AS tokens, CAST(len(w) AS INTEGER) AS words, len(w) > 300 AS too_long FROM (SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w FROM documents)",
    "f4_scores": f"WITH {_SCORED} SELECT prediction_id, em, round(f1, 6) AS f1 FROM scored",
    "f7_digests": "SELECT doc_id, md5(coalesce(text, '')) AS digest, CAST(floor(length(coalesce(text, '')) / 4) AS INTEGER) AS tokens FROM documents",
    "f11_salvaged": f"SELECT id, entity_text AS text, CASE WHEN coalesce(entity_type, '') = '' THEN 'MISC' ELSE entity_type END AS type, coalesce(entity_description, '') AS description, {_SCORE} AS importance_score FROM traces WHERE entity_text <> ''",
    "f14_types": f"SELECT entity_type, {_type_case()} AS canonical, count(*) AS n FROM traces GROUP BY 1, 2",
    "f15_importance": f"""SELECT raw, CAST(CASE WHEN coalesce(raw, '') = '' THEN 3 ELSE least(greatest(CAST(regexp_extract(raw, '\\d+') AS BIGINT), 1), 5) END AS INTEGER) AS score, count(*) AS n FROM (SELECT {_RAW} AS raw FROM traces) GROUP BY 1, 2""",
    "f16_answers": f"WITH {_PREDICTIONS} SELECT prediction_id, {_PARSED} AS answer FROM (SELECT prediction_id, coalesce(predicted_answer, '') AS a FROM p)",
    "l4_budget": f"SELECT range AS top_k, {_budget_case()} AS budget FROM (SELECT range, range AS top_k FROM range(0, 131))",
    "l6_first_predictions": "SELECT prediction_id, run_id FROM (SELECT DISTINCT prediction_id, run_id FROM predictions) ORDER BY prediction_id LIMIT 100",
    "a1_sweep": f"WITH {_SCORED} SELECT top_k, count(*) AS questions, round(sum(em) / count(*), 6) AS exact_match, round(sum(f1) / count(*), 6) AS f1_score, round(sum(coalesce(processing_time, 0)) / count(*), 6) AS avg_processing_time FROM scored GROUP BY top_k",
    "a2_tokens": f"WITH {_PREDICTIONS}, t AS (SELECT top_k, floor(length(coalesce(question, '')) / 4) + floor(length(coalesce(predicted_answer, '')) / 4) AS n FROM p) SELECT top_k, count(*) AS queries, CAST(sum(n) AS BIGINT) AS total_tokens, round(sum(n) / count(*), 6) AS avg_tokens FROM t GROUP BY top_k",
    "a6_retrieval": f"""WITH {_PREDICTIONS}, {_SAMPLES}, r AS (SELECT prediction_id, list_distinct(list_slice(list_filter(list_transform(coalesce(p.sources, []), lambda x: x.title), lambda x: x IS NOT NULL), 1, 3)) AS f, list_distinct(list_filter(list_transform(coalesce(s.supporting_facts, []), lambda x: x.title), lambda x: x IS NOT NULL)) AS w FROM p LEFT JOIN s USING (id)),
        h AS (SELECT prediction_id, len(f) AS f, len(w) AS w, len(list_intersect(f, w)) AS h FROM r)
        SELECT prediction_id, round(CASE WHEN f > 0 THEN h / f ELSE 0.0 END, 6) AS precision, round(CASE WHEN w > 0 THEN h / w ELSE 0.0 END, 6) AS recall, round(CASE WHEN h > 0 THEN 2.0 * h / (f + w) ELSE 0.0 END, 6) AS f1 FROM h""",
    "a7_analysis": f"WITH {_SCORED} SELECT run_id, count(*) AS total, CAST(sum(em) AS BIGINT) AS exact, round(avg(f1), 6) AS mean_f1 FROM scored GROUP BY run_id",
    "a7_extremes": f"""WITH {_SCORED}, x AS (SELECT prediction_id, round(f1, 6) AS f1 FROM scored)
        SELECT * FROM (SELECT prediction_id, f1, 'worst' AS side FROM x ORDER BY f1, prediction_id LIMIT 5) UNION ALL SELECT * FROM (SELECT prediction_id, f1, 'best' FROM x ORDER BY f1 DESC, prediction_id LIMIT 5)""",
    "a8_runs": f"""WITH {_SCORED}, x AS (SELECT run_id, top_k, round(avg(f1), 6) AS f1, round(avg(em), 6) AS em FROM scored GROUP BY run_id, top_k)
        SELECT run_id, top_k, 'f1' AS metric, f1 AS value FROM x UNION ALL SELECT run_id, top_k, 'em', em FROM x""",
    "t1_accesses": f"WITH {_VECTORS}, {_near('i', 20)} SELECT vec_id, count(*) AS accesses FROM i GROUP BY vec_id",
    "t2_statuses": f"{_ASSOCIATIVE} SELECT vec_id, CASE WHEN vec_id IN (SELECT vec_id FROM fresh) THEN 'active_in_stm' ELSE 'dormant' END AS status FROM embeddings",
    "t3_memory": """SELECT source_doc_id, id, seq FROM (SELECT *, row_number() OVER (PARTITION BY source_doc_id ORDER BY seq DESC, id) AS n FROM (
        SELECT source_doc_id, id, min(last_accessed_at) AS seq FROM traces WHERE source_doc_id IS NOT NULL AND last_accessed_at IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2)) WHERE n <= 20""",
    "s4_data_points": f"WITH {_POINTS} SELECT id, question, CAST(len(contexts) AS INTEGER) AS contexts, answer AS ground_truth_answer, CAST(aliases AS INTEGER) AS aliases FROM pts",
    "d6_documents": f"WITH {_POINTS} SELECT c.id AS id, c.title AS title, c.chunk AS text FROM (SELECT unnest(contexts) AS c FROM pts)",
    "d7_question_documents": f"WITH {_POINTS} SELECT id, array_to_string(list_transform(contexts, lambda c: c.id), '|') AS doc_ids FROM pts",
    "d3_hops": f"WITH {_SAMPLES} SELECT id, coalesce(TRY_CAST(nullif(regexp_extract(id, '^(\\d+)hop_', 1), '') AS INTEGER), 0) AS hop FROM s",
    "d1_pair_chunks": f"WITH {_SAMPLES} SELECT 2 AS hop, id || '_ctxchunk_' || CAST(i AS VARCHAR) AS id, coalesce(c.title, '') AS title, md5(coalesce(c.title, '') || ': ' || coalesce(c.chunk, '') || ' End.') AS digest FROM (SELECT id, unnest(chunks) AS c, generate_subscripts(chunks, 1) - 1 AS i FROM s WHERE dataset <> 'musique')",
    "d5_supporting": f"""WITH {_SAMPLES}, c AS (SELECT id, coalesce(c.title, '') AS t, max(i) AS i FROM (SELECT id, unnest(chunks) AS c, generate_subscripts(chunks, 1) - 1 AS i FROM s WHERE dataset <> 'musique') GROUP BY 1, 2),
        f AS (SELECT DISTINCT id, coalesce(f.title, '') AS t FROM (SELECT id, unnest(supporting_facts) AS f FROM s WHERE dataset <> 'musique'))
        SELECT id, id || '_ctxchunk_' || CAST(i AS VARCHAR) AS chunk_id FROM f JOIN c USING (id, t)""",
    "d4_evidences": f"WITH {_SAMPLES} SELECT id, CAST(i AS INTEGER) AS pos, e.subject AS subject, e.relation AS relation, e.object AS object FROM (SELECT id, unnest(evidences) AS e, generate_subscripts(evidences, 1) - 1 AS i FROM s WHERE dataset <> 'musique')",
    "d2_paragraphs": f"WITH {_SAMPLES} SELECT coalesce(TRY_CAST(nullif(regexp_extract(id, '^(\\d+)hop_', 1), '') AS INTEGER), 0) AS hop, id || '_sf_chunk_' || CAST(i AS VARCHAR) AS id, c.title AS title FROM (SELECT id, unnest(chunks) AS c, generate_subscripts(chunks, 1) - 1 AS i FROM s WHERE dataset = 'musique' AND hop IS DISTINCT FROM 4) WHERE i % 2 = 0",
    "x2_embedded": """WITH w AS (SELECT entity_text, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS pos FROM (SELECT entity_text, unnest(regexp_extract_all(lower(entity_text), '[a-z0-9]+')) AS w FROM (SELECT DISTINCT entity_text FROM traces WHERE entity_text IS NOT NULL))),
        c AS (SELECT entity_text, pos, count(*) AS n FROM w GROUP BY 1, 2) SELECT entity_text, CAST(pos AS INTEGER) AS pos, round(n / sqrt(sum(n * n) OVER (PARTITION BY entity_text)), 4) AS value FROM c""",
    "f13_tolerant": "SELECT id, array_to_string(regexp_extract_all('- ' || entity_text, '(?m)^\\s*-\\s+(.+)$', 1), '|') AS found FROM traces WHERE entity_text <> ''",
    "x6_extracted": """SELECT entity, CASE WHEN contains(entity, ' ') THEN 'PERSON' ELSE 'MISC' END AS type, count(*) AS documents FROM (
        SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')) AS entity FROM documents) GROUP BY 1, 2""",
    "x8_answers": f"""SELECT query_id, 'entity ' || CAST(vec_id AS VARCHAR) AS answer, 6 AS parts FROM ({_ASSOCIATIVE} {_rerank('found', 5)}) WHERE rank = 1""",
    "t0_index_sizes": f"""WITH fresh AS (WITH {_MANIFEST} SELECT * FROM documents d WHERE NOT {_blank('text')} AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = d.doc_id AND m.h = md5(coalesce(d.text, '')))),
        c AS ({_split(True, "fresh", "c")}), t AS (SELECT count(*) AS n, CAST(sum(len(list_distinct(regexp_extract_all(c, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')))) AS BIGINT) AS e FROM c)
        SELECT 'chunks' AS part, n AS rows FROM t UNION ALL SELECT 'traces', e FROM t UNION ALL SELECT 'edges', e FROM t UNION ALL SELECT 'manifest', count(*) FROM fresh""",
    "t0_engine": f"""WITH d AS (SELECT text FROM documents WHERE NOT {_blank('text')}), t AS (SELECT count(*) AS n, CAST(sum(len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')))) AS BIGINT) AS e FROM d)
        SELECT unnest(['chunks', 'traces', 'edges', 'manifest', 'trace_vectors', 'chunk_vectors']) AS part, unnest([n, e, e, n, e, n]) AS rows FROM t""",
    "t0_baseline": f"SELECT unnest(['chunks', 'manifest', 'chunk_vectors']) AS part, unnest([n, n, n]) AS rows FROM (SELECT count(*) AS n FROM documents WHERE NOT {_blank('text')})",
    "u4_citations_raw": f"""WITH {_SOURCES}, b AS (SELECT prediction_id, doc_id, chunk_id, pos, CASE WHEN pos < 2 THEN 0 ELSE 1 END AS s FROM src WHERE doc_id <> ''),
        f AS (SELECT *, row_number() OVER (PARTITION BY prediction_id, doc_id ORDER BY s, pos, chunk_id) AS n FROM b)
        SELECT prediction_id, doc_id AS source_doc_id, chunk_id, CAST(row_number() OVER (PARTITION BY prediction_id ORDER BY s, pos, chunk_id) AS INTEGER) AS rank FROM f WHERE n = 1""",
    "a8_wide": f"WITH {_SCORED} SELECT top_k, round(sum(em) / count(*), 6) AS exact_match, round(sum(f1) / count(*), 6) AS f1_score FROM scored GROUP BY top_k",
    "f20_cues": f"WITH {_PREDICTIONS} SELECT prediction_id, array_to_string(w, '|') AS cues FROM (SELECT prediction_id, list_filter(m, lambda x, i: NOT list_contains(list_slice(m, 1, i - 1), x)) AS w FROM (SELECT prediction_id, regexp_extract_all(coalesce(question, ''), '[A-Z][a-z]+(?: [A-Z][a-z]+)*') AS m FROM p))",
}

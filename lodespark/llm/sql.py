"""SQL of the queries that SQL can express."""

_WORDS = "regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')"

_SIMILAR = r"""entries AS (
            SELECT DISTINCT c.id AS id, list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', c.title, c.chunk)), '[\p{L}\p{N}]+'))) AS w
            FROM (SELECT unnest(chunks) AS c FROM samples) WHERE c.chunk IS NOT NULL AND trim(c.chunk, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) <> ''
        ), e AS (SELECT id, w, length(w) AS n FROM entries WHERE length(w) > 0)"""

SQL = {
    "p2_found": """
        WITH entries AS (
            SELECT DISTINCT c.id AS id, list_distinct(regexp_extract_all(lower(concat_ws(' ', c.title, c.chunk)), '[\\p{L}\\p{N}]+')) AS w
            FROM (SELECT unnest(chunks) AS c FROM samples) WHERE c.chunk IS NOT NULL AND trim(c.chunk, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) <> ''
        ), e AS (SELECT id, w, length(w) AS n FROM entries WHERE length(w) > 0),
        t AS (SELECT id, n, unnest(w) AS tok FROM e),
        o AS (SELECT a.id AS x, b.id AS y, a.n AS n, b.n AS m, count(*) AS c FROM t a JOIN t b ON a.tok = b.tok AND a.id < b.id AND a.n * 10 >= b.n * 7 AND b.n * 10 >= a.n * 7 GROUP BY ALL)
        SELECT DISTINCT x AS chunk_id_a, y AS chunk_id_b FROM o WHERE c * 10 >= (n + m - c) * 7""",
    "p2_classes": f"""
        WITH {_SIMILAR}, c AS (SELECT row_number() OVER () AS k, w, len(w) AS n, class, copies FROM (SELECT w, min(id) AS class, count(DISTINCT id) AS copies FROM e GROUP BY w)),
        t AS (SELECT k, n, unnest(w) AS tok FROM c),
        o AS (SELECT a.k AS x, b.k AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS s FROM t a JOIN t b ON a.tok = b.tok AND a.k < b.k AND a.n * 10 >= b.n * 7 AND b.n * 10 >= a.n * 7 GROUP BY a.k, b.k),
        l AS (SELECT unnest([x, y]) AS k FROM o WHERE s * 10 >= (n + m - s) * 7), d AS (SELECT k, count(*) AS links FROM l GROUP BY k)
        SELECT DISTINCT e.id, c.class, c.copies, coalesce(d.links, 0) AS links FROM e JOIN c USING (w) LEFT JOIN d USING (k)""",
    "p5_found": """
        WITH items AS (
            SELECT 'chunk_metadata' AS origin, chunk_id AS item_id, chunk_text AS text FROM chunk_metadata
            UNION ALL SELECT 'samples', c.id, c.chunk FROM (SELECT unnest(chunks) AS c FROM samples)
        ), long AS (SELECT DISTINCT * FROM items WHERE length(text) > 2048)
        SELECT origin, item_id, CASE WHEN max(list_max(list_transform(string_split_regex(text, '[ \\t\\r\\n]'), lambda w: length(w)))) > 2048 THEN 'forced' ELSE 'natural' END AS cut
        FROM long GROUP BY origin, item_id""",
    "p8_found": f"""
        WITH items AS (
            SELECT item_id, {_WORDS.format(text="question")} AS w FROM eval_items UNION ALL SELECT item_id, {_WORDS.format(text="passage")} FROM eval_items
        ), grams AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, length(w) - 10)) AS i FROM items)),
        docs AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents),
        windows AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, length(w) - 10)) AS i FROM docs))
        SELECT DISTINCT doc_id, item_id FROM windows JOIN grams USING (gram)""",
}

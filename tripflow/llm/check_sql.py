"""DuckDB SQL for the rows of the queries that SQL can express."""

LEXICAL_SEARCH = r"""
WITH lowered_docs AS (
    SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), doc_terms AS (
    SELECT doc_id, unnest(regexp_extract_all(low, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lowered_docs
), lengths AS (
    SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id
), totals AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths
), norms AS (
    SELECT doc_id, 100 - 25 + (25 * n * docs) // terms AS m FROM lengths, totals
), counts AS (
    SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY doc_id, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, totals GROUP BY term
), item_terms AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), asked AS (
    SELECT item_id, term, count(*) AS times FROM item_terms GROUP BY item_id, term
), scores AS (
    SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

PREFIX_TRIE = r"""
WITH own AS (
    SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations GROUP BY conv_id
), lent AS (
    SELECT conv_id, turns,
        CAST(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
            lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]),
                lambda x, step: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS INT) AS h
    FROM own
), rebuilt AS (
    SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
    FROM lent a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100
), prefixes AS (
    SELECT conv_id, d AS depth, turns[1:d] AS path, d = len(turns) AS is_end
    FROM rebuilt, LATERAL (SELECT unnest(generate_series(0, len(turns))) AS d)
), nodes AS (
    SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256,
        CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(path[len(path)].t) END AS saved
    FROM prefixes GROUP BY depth, path
), children AS (
    SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), known AS (
    SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (depth, path)
), sums AS (
    SELECT up.depth, up.path, CAST(sum(down.saved) AS BIGINT) AS saved_tokens, count(*) FILTER (down.n_children = 0) AS n_leaves
    FROM known down, LATERAL (SELECT unnest(generate_series(0, down.depth)) AS depth) one, LATERAL (SELECT down.path[1:one.depth] AS path, one.depth AS depth) up
    GROUP BY up.depth, up.path
)
SELECT known.conv_id, CAST(known.depth AS BIGINT) AS depth, above.conv_id AS parent_conv_id, known.n_convs, known.n_children, n_leaves, saved_tokens, known.ends_sha256
FROM known JOIN sums USING (depth, path) LEFT JOIN nodes above ON above.depth = known.depth - 1 AND above.path = known.path[1:known.depth - 1]
"""

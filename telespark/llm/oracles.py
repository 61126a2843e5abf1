"""SQL for those queries of this subpackage that SQL can express."""

ORACLES = {
    "op7_exact_top_k": """
        WITH grid AS (
          SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
        pairs AS (
          SELECT q.row_id, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
          FROM grid q JOIN grid c ON q.row_id <> c.row_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
        WHERE rank <= 20""",
    "op13_ranked_search": r"""
        WITH d AS (
          SELECT row_number() OVER () AS row_id, doc_id,
            list_filter(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda t: t <> '') AS terms
          FROM documents WHERE text IS NOT NULL),
        docs AS (SELECT row_id, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
        total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM docs),
        tf AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM docs) GROUP BY ALL),
        weights AS (
          SELECT term, CAST(floor(1000 * ln((2 * any_value(total.docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
          FROM tf, total GROUP BY term),
        asked AS (
          SELECT item_row, item_id, term, count(*) AS n FROM (
            SELECT item_row, item_id, unnest(list_filter(string_split(regexp_replace(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda t: t <> '')) AS term
            FROM (SELECT *, row_number() OVER () AS item_row FROM benchmark)) GROUP BY ALL),
        scored AS (
          SELECT item_row, item_id, row_id, doc_id, CAST(sum(asked.n * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * docs.n * total.docs) // total.words)))) AS BIGINT) AS score
          FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN docs USING (row_id), total
          GROUP BY item_row, item_id, row_id, doc_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op12_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        sized AS (SELECT *, length(h) // 2 AS n FROM d),
        -- Stretches of 4,096 places with the 49 bytes after them, so that places are near the beginnings of what they are cut from.
        parts AS (SELECT row_id, doc_id, n, base, substr(h, 2 * base + 1, 2 * (4096 + 49)) AS part FROM (
          SELECT *, unnest(range(0, greatest(n - 49, 0), 4096)) AS base FROM sized)),
        places AS (SELECT row_id, doc_id, base + i AS place, substr(part, 2 * i + 1, 100) AS s FROM (
          SELECT *, unnest(range(0, least(4096, n - 49 - base))) AS i FROM parts WHERE doc_id IS NOT NULL)),
        first AS (SELECT s, min(doc_id) AS doc_id FROM places GROUP BY s HAVING min(doc_id) < max(doc_id)),
        hits AS (SELECT row_id, place FROM places JOIN first USING (s) WHERE first.doc_id < places.doc_id),
        marked AS (SELECT *, CASE WHEN place > lag(place) OVER w + 50 THEN 1 ELSE 0 END AS new FROM hits WINDOW w AS (PARTITION BY row_id ORDER BY place)),
        spans AS (SELECT row_id, min(place) AS a, max(place) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY row_id ORDER BY place) AS run FROM marked) GROUP BY row_id, run),
        gaps AS (SELECT row_id, a, b, coalesce(lag(b) OVER (PARTITION BY row_id ORDER BY a), 0) AS before FROM spans),
        kept AS (SELECT row_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
          string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM gaps JOIN sized USING (row_id) GROUP BY row_id)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
          sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM sized LEFT JOIN kept USING (row_id)""",
}

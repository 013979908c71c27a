"""DuckDB SQL for the queries that SQL can express."""

ORACLES = {
    "op3_exact_dedup": """
        SELECT doc_id,
          first_value(doc_id) OVER run AS keep_id,
          count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
          row_number() OVER run = 1 AS kept,
          sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW run AS (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST)
    """,
    "op5_impact_topk": """
        WITH usable AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS r
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS (
          SELECT r, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM usable
        ), scores AS (
          SELECT q.r AS qr, q.vec_id AS query_id, c.r AS cr, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
          FROM parts q JOIN parts c ON q.i = c.i AND q.r <> c.r
          WHERE q.vec_id % 50 = 0
          GROUP BY ALL
        ), ranked AS (
          SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS n FROM scores
        )
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5
    """,
    "op6_warc": """
        WITH p AS (
          SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
          SELECT *, first_value(page_id) OVER w AS first_id, row_number() OVER w AS place FROM p
          WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST)
        )
        SELECT page_id, payload_bytes, payload_digest,
          CASE WHEN payload_bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN payload_bytes >= 100 AND place > 1 THEN first_id END AS refers_to
        FROM f
    """,
    "op10_mixing": """
        WITH docs AS (
          SELECT doc_id, source, text, coalesce('=' || source, 'null') AS k, strlen(coalesce(text, '')) + 1 AS b FROM documents
        ), sizes AS (
          SELECT k, CAST(sum(b) AS DOUBLE) AS bytes FROM docs GROUP BY k
        ), rates AS (
          SELECT k, 1.0::DOUBLE * sum(bytes) OVER () * pow(bytes, 0.5) / sum(pow(bytes, 0.5)) OVER () / bytes AS rate FROM sizes
        ), steps AS (
          SELECT k, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT))) AS n FROM rates
        ), logs AS (
          SELECT k, n, n * ln(rate) - rate - sum(ln(CAST(greatest(n, 1) AS DOUBLE))) OVER (PARTITION BY k ORDER BY n) AS l FROM steps
        ), cdf AS (
          SELECT k, n, sum(exp(l)) OVER (PARTITION BY k ORDER BY n) AS c FROM logs
        ), lists AS (
          SELECT k, list(c) AS cs FROM cdf GROUP BY k
        ), drawn AS (
          SELECT docs.*, len(list_filter(cs, lambda c: c <= ('0x' || md5('29|' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:13])::BIGINT / 4503599627370496.0::DOUBLE)) AS m
          FROM docs JOIN lists USING (k)
        ), copies AS (
          SELECT doc_id, source, text, unnest(generate_series(1, m)) AS copy FROM drawn
        )
        SELECT doc_id, source, CAST(copy AS INTEGER) AS copy,
          md5('order29|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || copy) AS order_key,
          sha256(coalesce(text, '')) AS text_sha256
        FROM copies
    """,
}

_FIRST = """
        WITH v AS MATERIALIZED (
          SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (
          SELECT j, v AS c
          FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), 'null')), v) - 1 AS j, v FROM v)
          WHERE j < 8
        )"""

_ASSIGN = """, a{0} AS MATERIALIZED (
          SELECT r, j, d FROM (
            SELECT r, j, d, row_number() OVER (PARTITION BY r ORDER BY d, j) AS place FROM (
              SELECT r, j, CAST(list_sum(list_transform(generate_series(1, 64), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d
              FROM v, c{0}
            )
          ) WHERE place = 1
        )"""

_MOVE = """, s{0} AS MATERIALIZED (
          SELECT j, i, CAST(sum(x) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS n
          FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{0} JOIN v USING (r))
          GROUP BY j, i
        ), c{1} AS MATERIALIZED (
          SELECT c{0}.j, coalesce(m.c, c{0}.c) AS c
          FROM c{0} LEFT JOIN (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{0} GROUP BY j) m USING (j)
        )"""

_ROUNDS = 10

ORACLES["op13_centroids"] = (
    _FIRST
    + "".join(_ASSIGN.format(i) + _MOVE.format(i, i + 1) for i in range(_ROUNDS))
    + _ASSIGN.format(_ROUNDS)
    + f"""
        SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance,
          CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
          CAST(sum(d) OVER () AS BIGINT) AS inertia,
          sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{_ROUNDS} JOIN v USING (r) JOIN c{_ROUNDS} USING (j)
    """
)

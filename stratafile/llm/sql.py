"""DuckDB SQL of the queries that SQL can express."""


def _url_filter(depth: int = 8) -> str:
    """The tree level by level, down to `depth` segments: generalised from the top down, merged from the leaves up."""
    steps = []
    for d in range(1, depth + 1):
        steps.append(f"""
             k{d} AS MATERIALIZED (SELECT host, tpl, segs[{d}] AS seg, sum(n) AS k FROM t{d - 1} WHERE len(segs) >= {d} GROUP BY ALL),
             w{d} AS (SELECT *, sum(k) OVER (PARTITION BY host, tpl) AS all_, count(*) OVER (PARTITION BY host, tpl) AS kinds FROM k{d}),
             t{d} AS MATERIALIZED (SELECT t.host, t.segs, t.n, t.labelled, t.bad,
                    CASE WHEN len(t.segs) < {d} THEN t.tpl ELSE list_append(t.tpl, CASE WHEN w.kinds > 20 AND w.k * 20 < w.all_ THEN '*' ELSE t.segs[{d}] END) END AS tpl
                    FROM t{d - 1} t LEFT JOIN w{d} w ON t.host = w.host AND t.tpl = w.tpl AND t.segs[{d}] = w.seg)""")
    steps.append(f"""
             own AS MATERIALIZED (SELECT host, tpl AS node, CAST(sum(labelled) AS DOUBLE) AS labelled, CAST(sum(bad) AS DOUBLE) AS bad FROM t{depth} GROUP BY host, tpl)""")
    for d in range(depth, 0, -1):
        below = f" UNION ALL SELECT host, node[1:{d}] AS node, labelled, bad FROM m{d + 1} WHERE NOT differs" if d < depth else ""
        steps.append(f"""
             n{d} AS (SELECT host, node, sum(labelled) AS labelled, sum(bad) AS bad FROM (SELECT * FROM own WHERE len(node) = {d}{below}) GROUP BY host, node),
             v{d} AS (SELECT *, bad / nullif(labelled, 0) AS p, sum(bad) OVER s / nullif(sum(labelled) OVER s, 0) AS q FROM n{d} WINDOW s AS (PARTITION BY host, node[1:{d - 1}])),
             m{d} AS MATERIALIZED (SELECT host, node, labelled, bad, coalesce(pow(greatest(abs(p - q) - 0.5 / labelled, 0), 2) * labelled > 3.8416::DOUBLE * q * (1 - q), false) AS differs FROM v{d})""")
    alone = "".join(f" UNION ALL SELECT host, node, labelled, bad FROM m{d} WHERE differs" for d in range(1, depth + 1))
    return rf"""
        WITH a AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
             b AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
             g AS (SELECT *, coalesce(string_split(nullif(trim(regexp_replace(regexp_replace(path, '[0-9]+', '#', 'g'), '/+', '/', 'g'), '/'), ''), '/'), []) AS every,
                          TRY_CAST(nullif(regexp_extract(path, '[0-9]+'), '') AS BIGINT) AS doc FROM b),
             r AS (SELECT *, every AS segs FROM g),
             l AS (SELECT doc_id, max(greatest(toxic, 1 - quality)) AS bad FROM labels GROUP BY doc_id HAVING max(greatest(toxic, 1 - quality)) IS NOT NULL),
             t0 AS MATERIALIZED (SELECT host, segs, count(*) AS n, count(l.bad) AS labelled, coalesce(sum(l.bad), 0) AS bad, []::VARCHAR[] AS tpl FROM r LEFT JOIN l ON r.doc = l.doc_id GROUP BY host, segs),{",".join(steps)},
             alone AS (SELECT host, [] AS node, sum(labelled) AS labelled, sum(bad) AS bad FROM (SELECT * FROM own WHERE len(node) = 0 UNION ALL SELECT host, [] AS node, labelled, bad FROM m1 WHERE NOT differs) GROUP BY host{alone}),
             h AS (SELECT host, sum(labelled) AS h_n, sum(bad) AS h_bad FROM own GROUP BY host),
             o AS (SELECT coalesce(sum(h_bad) / nullif(sum(h_n), 0), 0) AS share FROM h),
             y AS (SELECT alone.host, node, (bad + 10::DOUBLE * ((h_bad + 10::DOUBLE * share) / (h_n + 10::DOUBLE))) / (labelled + 10::DOUBLE) AS purity FROM alone JOIN h ON alone.host = h.host CROSS JOIN o),
             f AS (SELECT t.host, t.segs, len(t.tpl) AS own_depth, arg_max(y.node, len(y.node)) AS node, arg_max(y.purity, len(y.node)) AS purity
                   FROM t{depth} t JOIN y ON t.host = y.host AND t.tpl[1:len(y.node)] = y.node GROUP BY ALL),
             z AS (SELECT r.page_id, r.host, r.path, f.purity, '/' || array_to_string(f.node, '/') || CASE WHEN len(f.node) >= own_depth THEN '' WHEN len(f.node) = 0 THEN '**' ELSE '/**' END AS template,
                          CASE WHEN (r.host = 'example.net' OR ends_with(r.host, '.example.net')) AND starts_with(r.path, '/en/') THEN 'example.net/en/'
                               WHEN (r.host = 'example.com' OR ends_with(r.host, '.example.com')) AND starts_with(r.path, '/de/') THEN 'example.com/de/'
                               WHEN (r.host = 'org' OR ends_with(r.host, '.org')) AND starts_with(r.path, '/fr/') THEN 'org/fr/'
                               WHEN (r.host = 'net' OR ends_with(r.host, '.net')) AND starts_with(r.path, '/') THEN 'net/' END AS rule
                   FROM r JOIN f ON r.host = f.host AND r.segs = f.segs)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END AS verdict, template, round(purity, 6) AS purity
        FROM z"""


def _crc_table() -> list[int]:
    """What CRC32 (the reflected polynomial 0xEDB88320) gives for each byte."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


_CRC = f"""x AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw))),
             y AS (SELECT w, list_transform(range(0, len(h) // 2), lambda i: CAST(position(h[2 * i + 1] IN '0123456789ABCDEF') * 16 - 16 + position(h[2 * i + 2] IN '0123456789ABCDEF') - 1 AS BIGINT)) AS b FROM x),
             c AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, v: xor(a >> 8, ({_crc_table()}::BIGINT[])[(xor(a, v) & 255) + 1])), 4294967295) % 10000 AS bucket FROM y)"""


def _clusters(rounds: int = 3) -> str:
    """All distances to all centroids, a round after the other."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
             d{r} AS (SELECT x.i, c{r}.k, sum((x.x - c{r}.c) * (x.x - c{r}.c)) AS d FROM x JOIN c{r} ON x.pos = c{r}.pos GROUP BY x.i, c{r}.k),
             a{r} AS MATERIALIZED (SELECT i, k, d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, k) AS n FROM d{r}) WHERE n = 1)""")
        if r < rounds:
            steps.append(f"""
             s{r} AS (SELECT a{r}.k, x.pos, sum(x.x) AS s, count(*) AS n FROM a{r} JOIN x ON a{r}.i = x.i GROUP BY a{r}.k, x.pos),
             c{r + 1} AS MATERIALIZED (SELECT c{r}.k, c{r}.pos, CAST(CASE WHEN s IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS c FROM c{r} LEFT JOIN s{r} ON c{r}.k = s{r}.k AND c{r}.pos = s{r}.pos)""")
    return f"""
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS v FROM embeddings),
             v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(v, lambda z: CAST(floor(64 * z) AS BIGINT)) AS v FROM e WHERE len(v) = 64 AND len(list_filter(v, lambda z: z IS NOT NULL AND isfinite(z))) = 64),
             x AS MATERIALIZED (SELECT i, unnest(range(1, 65)) AS pos, unnest(v) AS x FROM v),
             f AS (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k FROM v WHERE vec_id IS NOT NULL),
             c0 AS MATERIALIZED (SELECT k, unnest(range(1, 65)) AS pos, unnest(v) AS c FROM f WHERE k < 16),{",".join(steps)},
             h AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY k),
             t AS (SELECT k, sum(d) AS cluster_inertia FROM a{rounds} GROUP BY k)
        SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(t.cluster_inertia AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM a{rounds}) AS BIGINT) AS inertia, h.centroid_sha256
        FROM v JOIN a{rounds} a ON v.i = a.i JOIN h ON a.k = h.k JOIN t ON a.k = t.k"""


SQL = {
    "op11_importance": f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
             dw AS MATERIALIZED (SELECT n, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS w FROM d),
             bw AS MATERIALIZED (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS w FROM benchmark),
             {_CRC},
             s AS (SELECT bucket, count(*) AS s FROM dw JOIN c ON dw.w = c.w GROUP BY bucket),
             t AS (SELECT bucket, count(*) AS t FROM bw JOIN c ON bw.w = c.w GROUP BY bucket),
             o AS (SELECT (SELECT count(*) FROM dw) AS all_s, (SELECT count(*) FROM bw) AS all_t),
             g AS (SELECT s.bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
                   FROM s LEFT JOIN t ON s.bucket = t.bucket CROSS JOIN o),
             f AS (SELECT dw.n, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN c ON dw.w = c.w JOIN g ON c.bucket = g.bucket GROUP BY dw.n),
             w AS (SELECT d.n, doc_id, coalesce(text, '') AS text, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, sha256('2024:' || doc_id)[1:8] AS x FROM d LEFT JOIN f ON d.n = f.n),
             z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || x AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w),
             r AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id, sha256(text)) AS place, count(*) OVER () AS able FROM z WHERE doc_id IS NOT NULL AND n_features >= 20)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN place <= 10 * able // 100 THEN CAST(place AS BIGINT) END AS rank,
               CAST(n_features AS BIGINT) AS n_words, CAST(count(*) OVER (PARTITION BY text) AS BIGINT) AS copies
        FROM z LEFT JOIN r ON z.n = r.n""",
    "op13_centroids": _clusters(),
    "op6_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents),
             g AS (SELECT s, min(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY s)
        SELECT d.doc_id, g.keep_id, CAST(g.n AS BIGINT) AS group_size, 
               CASE WHEN d.doc_id IS NOT NULL THEN d.doc_id = g.keep_id ELSE g.keep_id IS NULL AND row_number() OVER (PARTITION BY d.s, d.doc_id) = 1 END AS kept, d.s AS text_sha256
        FROM d JOIN g ON d.s = g.s""",
    "op2_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                          substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))), 1, 15) AS h FROM documents),
             s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
             r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
             w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM r),
             o AS (SELECT *, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total,
                          coalesce(sum(3 * source_size) OVER (ORDER BY source_size * (10 // w), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
                          sum(w) OVER (ORDER BY source_size * (10 // w), rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from FROM w),
             c AS (SELECT *, (total - cap_before) * w >= cap * w_from AS capped FROM o),
             u AS (SELECT *, total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS r, sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS u FROM c),
             t AS (SELECT *, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(w * r AS DOUBLE) / CAST(u AS DOUBLE) END AS target FROM u),
             q AS (SELECT *, CAST(floor(target) AS BIGINT) AS quota, greatest(1, (total + 131071) // 131072) AS block FROM t),
             -- the schedule: golden-ratio points through the cumulative targets, and the rank of each slot in its source
             e AS (SELECT source, CAST((CAST(sum(quota) OVER (ORDER BY rank) AS HUGEINT) * 4294967296) // CAST(sum(quota) OVER () AS HUGEINT) AS BIGINT) AS hi, rank FROM q WHERE quota > 0),
             f AS (SELECT source, coalesce(lag(hi) OVER (ORDER BY rank), 0) AS lo, hi FROM e),
             i AS (SELECT unnest(range(0, (SELECT max((total + block - 1) // block) FROM q))) AS position),
             y AS (SELECT f.source, i.position, row_number() OVER (PARTITION BY f.source ORDER BY i.position) - 1 AS block_no
                   FROM i JOIN f ON (i.position * 2654435769) % 4294967296 >= f.lo AND (i.position * 2654435769) % 4294967296 < f.hi),
             g AS (SELECT source, count(*) AS drawn FROM y GROUP BY source),
             k AS (SELECT q.source, q.source_size, q.target, q.block, least(coalesce(g.drawn, 0) * q.block, 3 * q.source_size) AS gives FROM q LEFT JOIN g ON q.source IS NOT DISTINCT FROM g.source),
             p AS (SELECT row_number() OVER () AS n, doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
             m AS (SELECT p.n, p.start + ep * k.source_size AS a, least(p.start + ep * k.source_size + p.size, k.gives) AS z, k.block, p.source
                   FROM p JOIN k ON p.source IS NOT DISTINCT FROM k.source CROSS JOIN (SELECT unnest([0, 1, 2]) AS ep) WHERE p.size > 0),
             b AS (SELECT m.n, sum(z - a) AS taken, sum((z - 1) // block - a // block + 1) AS n_slots, min(y.position) AS first_slot
                   FROM m LEFT JOIN y ON m.source IS NOT DISTINCT FROM y.source AND m.a // m.block = y.block_no WHERE z > a GROUP BY m.n)
        SELECT p.doc_id, p.size, k.source_size, k.target, CAST(coalesce(b.taken, 0) AS BIGINT) AS taken, b.first_slot, CAST(coalesce(b.n_slots, 0) AS BIGINT) AS n_slots
        FROM p JOIN k ON p.source IS NOT DISTINCT FROM k.source LEFT JOIN b ON p.n = b.n""",
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
             q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d, max(page_id) OVER (PARTITION BY b) AS last FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
        FROM q""",
    "op9_url_filter": _url_filter(),
}

"""DuckDB SQL for the text and vector queries that SQL can express, written from their definitions."""

from __future__ import annotations

PAGES = """
WITH plain AS (
    SELECT page_id, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS bytes FROM pages
), ranked AS (
    SELECT *, row_number() OVER w AS place, max(page_id) OVER (PARTITION BY digest) AS largest
    FROM plain WINDOW w AS (PARTITION BY digest ORDER BY page_id DESC NULLS LAST)
)
SELECT page_id, bytes::BIGINT AS payload_bytes, digest AS payload_digest,
    CASE WHEN bytes >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN bytes >= 1000 AND place > 1 THEN largest END AS refers_to
FROM ranked
"""


def clusters(k: int, rounds: int, dimensions: int, salt: int) -> str:
    """Lloyd rounds one after the other, every distance computed in full."""
    ctes = [
        f"""kept AS MATERIALIZED (
    SELECT vec_id, row_number() OVER () AS line, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS x
    FROM embeddings WHERE len(embedding) = {dimensions}
        AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v::DOUBLE))) = {dimensions}
)""",
        f"""c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x AS c
    FROM (SELECT x, sha256('{salt}:' || vec_id) AS h FROM kept WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k})
)""",
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"""a{r} AS MATERIALIZED (
    SELECT line, any_value(vec_id) AS vec_id, any_value(x) AS x, min(d) AS distance, arg_min(cluster, (d, cluster)) AS cluster
    FROM (SELECT line, vec_id, x, cluster,
        list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{r})
    GROUP BY line
)"""
        )
        if r == rounds:
            break
        ctes.append(
            f"""m{r} AS MATERIALIZED (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
    FROM (SELECT cluster, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, {dimensions + 1}) AS places(i) GROUP BY cluster, i)
    GROUP BY cluster
), c{r + 1} AS MATERIALIZED (
    SELECT cluster, coalesce(m{r}.c::BIGINT[], c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster)
)"""
        )
    return f"""
WITH {", ".join(ctes)}
SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
    sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""


# rows are told apart by their number, as ids may be null or repeated; a null id counts as the largest
_WORDS = r"""
numbered AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS place, coalesce({text}, '') AS body FROM documents
),
split AS MATERIALIZED (SELECT r, doc_id, place, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words FROM numbered)"""

SHINGLES = f"""
WITH RECURSIVE {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
shingles AS MATERIALIZED (
    SELECT DISTINCT r, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 4], ' ') END AS s
    FROM split, unnest(range(1, greatest(len(words) - 3, 2))) AS t(i) WHERE len(words) > 0
),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
links AS MATERIALIZED (
    SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * common >= 80 * (x.n + y.n - common)
),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles,
    CASE WHEN any_value(n) IS NULL THEN any_value(d.doc_id) ELSE least(any_value(d.doc_id), min(o.doc_id)) END AS component_id
FROM split d LEFT JOIN sizes USING (r) LEFT JOIN reach ON reach.a = d.r LEFT JOIN split o ON o.r = reach.b
GROUP BY d.r, d.doc_id
"""

PASSAGES = f"""
WITH {_WORDS.format(text="text")},
windows AS MATERIALIZED (
    SELECT r, place, i, array_to_string(words[i:i + 12], ' ') AS k FROM split, unnest(range(1, len(words) - 11)) AS t(i)
),
earliest AS (SELECT k, min(place) AS least FROM windows GROUP BY k),
gone AS MATERIALIZED (
    SELECT DISTINCT r, i + o AS spot FROM windows JOIN earliest USING (k), range(13) AS t(o) WHERE least < place
),
placed AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS spot FROM split),
kept AS (
    SELECT r, string_agg(word, ' ' ORDER BY spot) AS body FROM placed LEFT JOIN gone USING (r, spot) WHERE gone.r IS NULL GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, (SELECT count(*) FROM gone WHERE gone.r = split.r)::BIGINT AS n_removed,
    sha256(coalesce(body, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)
"""


def statements() -> dict[str, str]:
    return {
        "op1_shingle_join": SHINGLES,
        "op10_substring_dedup": PASSAGES,
        "op11_warc_segments": PAGES,
        "op13_centroid_clusters": clusters(40, 5, 64, 2),
    }

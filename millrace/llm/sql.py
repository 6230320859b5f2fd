"""SQL for registered queries of this subpackage, written apart from the operators: whole comparisons instead of trees and lists, a series instead of a fraction."""

from __future__ import annotations


def _finite(scale: int) -> str:
    """(rid, vec_id, label, v): integer vectors of the embeddings whose components are all finite."""
    return f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid, * FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))"""


_SQUARES = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def centroid_clusters(k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64) -> str:
    steps = [_finite(scale), f"x AS MATERIALIZED (SELECT * FROM kept WHERE len(v) = {dims})", f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM x QUALIFY c < {k})"]
    for i in range(rounds + 1):
        steps.append(f"n{i} AS MATERIALIZED (SELECT rid, min({{'d': CAST(d AS BIGINT), 'c': c}}) AS m FROM (SELECT a.rid, b.c, {_SQUARES} AS d FROM x a, c{i} b) GROUP BY rid)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT c, i, floor(CAST(sum(e) AS DOUBLE) / count(*)) AS e FROM (SELECT m.c AS c, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM x JOIN n{i} USING (rid)) GROUP BY c, i)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT c, list(CAST(e AS BIGINT) ORDER BY i) AS v FROM s{i} GROUP BY c) m ON m.c = c{i}.c)")
    return f"""WITH {", ".join(steps)} SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM x JOIN n{rounds} USING (rid) JOIN c{rounds} ON c{rounds}.c = m.c"""


def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    cut = f"list_slice(v, part * len(v) // {parts} + 1, (part + 1) * len(v) // {parts})"
    lead = f"len(v) > 0 AND len(v) % {parts} = 0"
    steps = [_finite(scale), f"x AS MATERIALIZED (SELECT * FROM kept WHERE len(v) = (SELECT len(v) FROM kept WHERE {lead} ORDER BY rid LIMIT 1))"]
    steps.append(f"p AS MATERIALIZED (SELECT rid, CAST(part AS INTEGER) AS part, {cut} AS v FROM x, range({parts}) t(part))")
    steps.append(f"c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY rid) - 1 AS c, v FROM p QUALIFY c < {entries})")
    for i in range(rounds + 1):
        steps.append(f"n{i} AS MATERIALIZED (SELECT rid, part, min({{'d': CAST(d AS BIGINT), 'c': c}}) AS m FROM (SELECT a.rid, a.part, b.c, {_SQUARES} AS d FROM p a JOIN c{i} b USING (part)) GROUP BY rid, part)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT part, c, i, floor(CAST(sum(e) AS DOUBLE) / count(*)) AS e FROM (SELECT part, m.c AS c, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM p JOIN n{i} USING (rid, part)) GROUP BY part, c, i)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.part, c{i}.c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT part, c, list(CAST(e AS BIGINT) ORDER BY i) AS v FROM s{i} GROUP BY part, c) m ON m.part = c{i}.part AND m.c = c{i}.c)")
    steps.append(f"r AS (SELECT rid, string_agg(format('{{:02x}}', m.c), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM n{rounds} GROUP BY rid)")
    return f"""WITH {", ".join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
      (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, c)) FROM c{rounds}) AS codebooks_sha256 FROM x JOIN r USING (rid)"""


def url_filter(rules, suffixes, threshold: float = 0.5, confidence: float = 0.95, terms: int = 40_000) -> str:
    """The tail of a beta distribution is a sum of `terms` terms here, enough while a host's prior and labelled pages stay below that together."""
    of = lambda value: "CASE " + " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}') THEN '{value(kind, r)}'" for kind, r in sorted(rules, key=lambda r: -len(r[1]))) + " END"
    two, lists = "array_to_string(l[-2:], '.')", ", ".join(f"'{s}'" for s in suffixes)
    strength = lambda kids, x, n, px, pn, parent: f"""(SELECT CASE WHEN room IS NULL OR room <= 0 THEN 10 WHEN over <= 0 THEN 10000 ELSE least(10000, greatest(1, room / over - 1)) END FROM (SELECT sum(s - px * p - v * (k - 1)) AS over, sum(v * (pn - q / pn - (k - 1))) AS room
      FROM (SELECT *, px / pn AS p, px / pn * (1 - px / pn) AS v FROM (SELECT CAST({px} AS DOUBLE) AS px, CAST({pn} AS DOUBLE) AS pn, count(*) AS k, sum(CAST({x} AS DOUBLE) * {x} / {n}) AS s, sum(CAST({n} AS DOUBLE) * {n}) AS q FROM {kids} WHERE {n} > 0 GROUP BY {parent}, {px}, {pn}))))"""  # noqa: E731
    return f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    a AS MATERIALIZED (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u)),
    known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
    h0 AS MATERIALIZED (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS x FROM a LEFT JOIN known ON TRY_CAST(regexp_extract(path, '^/[^/]+/([0-9]+)', 1) AS BIGINT) = doc_id GROUP BY host),
    h1 AS (SELECT *, rtrim(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.') AS name FROM h0), h2 AS (SELECT *, string_split(name, '.') AS l, regexp_full_match(name, '[0-9]+([.][0-9]+){{3}}') AS ip FROM h1),
    h AS MATERIALIZED (SELECT host, n, x, CASE WHEN ip THEN name WHEN {two} IN ({lists}) THEN array_to_string(l[-3:], '.') ELSE {two} END AS domain, CASE WHEN ip THEN '' WHEN {two} IN ({lists}) THEN {two} ELSE l[-1] END AS suffix FROM h2),
    d AS MATERIALIZED (SELECT domain, suffix, sum(n) AS dn, sum(x) AS dx FROM h GROUP BY ALL), s AS MATERIALIZED (SELECT suffix, sum(dn) AS sn, sum(dx) AS sx FROM d GROUP BY suffix),
    g AS (SELECT sum(sn) AS gn, sum(sx) AS gx FROM s), sg AS (SELECT *, 0 AS one FROM s, g), ds AS (SELECT * FROM d JOIN s USING (suffix)), hd AS MATERIALIZED (SELECT * FROM h JOIN ds USING (domain, suffix)),
    m AS MATERIALIZED (SELECT {strength("sg", "sx", "sn", "gx", "gn", "one")} AS top, {strength("ds", "dx", "dn", "sx", "sn", "suffix")} AS middle, {strength("hd", "x", "n", "dx", "dn", "domain, suffix")} AS low),
    p1 AS (SELECT host, n, x, dn, dx, low, middle, (sx - dx + top * (gx + 0.5) / (gn + 1)) / (sn - dn + top) AS ps FROM hd, m, g), p2 AS (SELECT *, (dx - x + middle * ps) / (dn - n + middle) AS pd FROM p1),
    p3 AS MATERIALIZED (SELECT host, CAST(low * pd + x AS DOUBLE) AS a, CAST(low * (1 - pd) + n - x AS DOUBLE) AS b FROM p2),
    t AS (SELECT host, 1 - sum(exp((a + j) * ln({threshold}) + b * ln(1 - {threshold}) + lgamma(a + b + j) - lgamma(a + j + 1) - lgamma(b))) AS p_bad FROM p3, range({terms}) r(j) GROUP BY host)
    SELECT page_id, host, path, {of(lambda kind, r: r)} AS rule, coalesce({of(lambda kind, r: kind)}, CASE WHEN p_bad >= {confidence} THEN 'block' ELSE 'allow' END) AS verdict FROM a JOIN t USING (host)"""


def near_dedup(threshold: int = 80) -> str:
    """All pairs that share a two-word shingle, and all that can be reached over links; for small tables."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {words} AS w FROM documents),
    s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
    e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
    l AS MATERIALIZED (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS n, any_value(q.n) AS m, count(*) AS c FROM e p JOIN e q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY 1, 2) WHERE 100 * c >= {threshold} * (n + m - c)),
    r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id"""


def suffix_dedup(length: int = 200) -> str:
    """All windows of so many bytes, grouped by their digest; hexadecimal text stands for bytes. Windows are cut from pieces, as a cut reads its whole text."""
    two = 2 * length
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    z AS MATERIALIZED (SELECT r, q, substr(h, {two} * q + 1, {2 * two - 2}) AS piece FROM d, LATERAL (SELECT unnest(range(len(h) // {two})) AS q)),
    w AS MATERIALIZED (SELECT r, {length} * q + i AS p, md5(substr(piece, 2 * i + 1, {two})) AS k FROM z, range({length}) t(i) WHERE len(piece) >= 2 * i + {two}),
    s AS MATERIALIZED (SELECT r, p FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
    o AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS last FROM s),
    g AS (SELECT r, p, sum(CASE WHEN last IS NULL OR p > last + {length} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS g FROM o),
    c AS MATERIALIZED (SELECT r, g, min(p) AS a, max(p) + {length} AS b FROM g GROUP BY r, g),
    e AS (SELECT r, g, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY g) AS past FROM c),
    x AS (SELECT r, count(*) AS spans, sum(b - a) AS removed, max(b) AS tail, string_agg(substr(h, 2 * past + 1, 2 * (a - past)), '' ORDER BY g) AS head FROM e JOIN d USING (r) GROUP BY r)
    SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
      sha256(unhex(coalesce(head || substr(h, 2 * tail + 1), h))) AS kept_sha256 FROM d LEFT JOIN x USING (r)"""

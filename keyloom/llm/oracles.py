"""DuckDB SQL for the contract queries that SQL can express on the small tables: 4, 5, 7 and 9, by brute force."""

from __future__ import annotations

from keyloom.llm import url_filter as u
from keyloom.llm.common import LOWER, UPPER

_COMPONENTS = "reach AS (SELECT x AS node, x AS root FROM link UNION SELECT link.y, reach.root FROM reach JOIN link ON link.x = reach.node)"


def _url_filter() -> str:
    rules = sorted(u.RULES, key=lambda r: -len(r[1]))
    fits = [(v, r, "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')".format(h=r.partition("/")[0], p=r.partition("/")[2])) for v, r in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for _, r, f in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for v, _, f in fits) + " END"
    wide = ", ".join(f"'{w}'" for w in u.WIDE)
    low, high = u.STRENGTH

    def level(name: str, above: str, key: str) -> str:
        """Strength and posterior mean of a level (key, n, good, above)."""
        v = "above * (1 - above)"
        return (
            f"{name}_s AS (SELECT CASE WHEN room IS NULL OR room = 0 THEN {low} WHEN over <= 0 THEN {high} ELSE least(greatest(room / over - 1, {low}), {high}) END AS s FROM "
            f"(SELECT sum(pow(good / n - above, 2) - {v} / n) AS over, sum({v} * (1 - 1.0 / n)) AS room FROM {above} WHERE n >= 2)), "
            f"{name} AS (SELECT {key}, n, good, (good + s * above) / (n + s) AS mean, n + s AS size FROM {above}, {name}_s)"
        )

    return f"""
WITH o AS (SELECT doc_id AS page_id, CAST(min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS good FROM labels GROUP BY 1),
p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS two, array_to_string(string_split(host, '.')[-3:], '.') AS three, string_split(host, '.')[-1] AS one, CAST(count(good) AS DOUBLE) AS n, coalesce(sum(good), 0) AS good FROM p LEFT JOIN o USING (page_id) GROUP BY host),
hosts AS (SELECT host, CASE WHEN two IN ({wide}) THEN three ELSE two END AS domain, CASE WHEN two IN ({wide}) THEN two ELSE one END AS suffix, n, good FROM h),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY 1),
s0 AS (SELECT suffix, n, good, (SELECT CASE WHEN sum(n) > 0 THEN (sum(good) + 1) / (sum(n) + 1) ELSE 1 END FROM suffixes) AS above FROM suffixes),
{level("s1", "s0", "suffix")},
d0 AS (SELECT d.domain, d.n, d.good, s1.mean AS above FROM domains d JOIN s1 ON d.suffix = s1.suffix),
{level("d1", "d0", "domain")},
h0 AS (SELECT host, hosts.n, hosts.good, d1.mean AS above FROM hosts JOIN d1 ON hosts.domain = d1.domain),
{level("h1", "h0", "host")}
SELECT page_id, p.host, path, {rule.replace("host", "p.host")} AS rule, coalesce({verdict.replace("host", "p.host")}, CASE WHEN least(mean + {u.Z} * sqrt(mean * (1 - mean) / (size + 1)), 1) < {u.LEAST} THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS reputation FROM p JOIN h1 ON p.host = h1.host
"""


_JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct([array_to_string(ws[i : i + 4], ' ') for i in range(1, len(ws) - 3)]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
{_COMPONENTS}
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(root), d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.node = d.doc_id GROUP BY d.doc_id
"""

_EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter([isfinite(coalesce(c, 'nan'::FLOAT)) for c in embedding], lambda f: NOT f)) = 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
{_COMPONENTS},
c AS (SELECT m.vec_id, coalesce((SELECT min(root) FROM reach WHERE reach.node = m.vec_id), m.vec_id) AS component_id, (SELECT count(*) FROM link WHERE link.x = m.vec_id) AS n_links FROM embeddings m)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM c
"""

_MIX = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, CAST('0x' || substr(md5(concat_ws(chr(31), '0', CAST(doc_id AS VARCHAR), source, text)), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, CAST([5, 2, 1] AS DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
r AS (SELECT *, cap / w AS ratio, sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM p),
l AS (SELECT *, (total - coalesce(before, 0)) / rest AS level FROM r),
t AS (SELECT source, source_size, total, least(cap, w * (SELECT level FROM l WHERE ratio > level ORDER BY ratio, source NULLS LAST LIMIT 1)) AS target FROM l),
c AS (SELECT d.*, t.target, t.source_size, t.total, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h) AS BIGINT) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT c.source, c.h, c.size, c.total, v.e, (v.e * source_size + cum) / target AS finish FROM c, (VALUES (0), (1), (2)) v(e) WHERE target > 0),
served AS (SELECT source, e, h, total, sum(size) OVER (ORDER BY finish, h) AS served FROM q),
cut AS (SELECT source, e, max(h) AS cut FROM served WHERE served <= total GROUP BY source, e),
n AS (SELECT source, max(CASE WHEN e = 0 THEN cut END) AS a, max(CASE WHEN e = 1 THEN cut END) AS b, max(CASE WHEN e = 2 THEN cut END) AS c FROM cut GROUP BY source),
k AS (SELECT c.*, CAST(coalesce(CAST(h <= n.a AS INTEGER), 0) + coalesce(CAST(h <= n.b AS INTEGER), 0) + coalesce(CAST(h <= n.c AS INTEGER), 0) AS INTEGER) AS copies FROM c LEFT JOIN n ON c.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, source, size, source_size, target, copies, size * copies AS taken FROM k
"""

ORACLES = {"op4_url_filter": _url_filter(), "op5_embedding_dedup": _EMBEDDINGS, "op7_jaccard_join": _JACCARD, "op9_source_mix": _MIX}

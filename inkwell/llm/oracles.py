"""SQL for the operators whose results it can state, by plain comparison of everything with everything."""

from __future__ import annotations

WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS a FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')] ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
ee AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, ee.y FROM r JOIN ee ON ee.x = r.reach),
m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.node = d.doc_id"""



def _longer(doublings: int = 14) -> str:
    """Windows of 50, 100, 200 ... words by the pairs of their halves, and the documents in which one is not the first."""
    parts = ["l0 AS (SELECT doc_id, i, md5(s) AS h FROM s WHERE i + 49 <= n)"]
    parts += [f"l{k} AS (SELECT doc_id, i, md5(h || z) AS h FROM (SELECT doc_id, i, h, lead(h, {50 << (k - 1)}) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM l{k - 1}) WHERE z IS NOT NULL)" for k in range(1, doublings)]
    later = [f"SELECT DISTINCT doc_id, CAST({50 << k} AS BIGINT) AS level FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS d0 FROM l{k}) WHERE d0 < doc_id" for k in range(doublings)]
    return ",\n".join([*parts, "later AS (" + " UNION ALL ".join(later) + ")"])


REPEATS = f"""WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS a FROM documents),
p AS (SELECT doc_id, len(a) AS n, unnest(a) AS word, generate_subscripts(a, 1) AS i FROM w),
s AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS s FROM p),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS d0 FROM s WHERE i + 49 <= n) WHERE d0 < doc_id),
g AS (SELECT p.doc_id, p.i, p.word, bool_or(f.i IS NOT NULL) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM p LEFT JOIN f ON f.doc_id = p.doc_id AND f.i = p.i),
{_longer()},
x AS (SELECT doc_id, max(level) AS longest_level FROM later GROUP BY 1)
SELECT d.doc_id, count(g.i) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(g.word, ' ' ORDER BY g.i) FILTER (WHERE NOT gone), '')) AS kept_sha256, coalesce(any_value(x.longest_level), 0) AS longest_level
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id GROUP BY 1"""

ASSIGN = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
KINDS = [("assign", ASSIGN, f"length(regexp_extract(m, '{ASSIGN}', 1)) >= 6"), ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"), ("hex", "[0-9a-f]{24,}", "true"), ("pem", "-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----", "true")]


def _matches(rank: int, kind: str, pattern: str, keep: str) -> str:
    """Spans of one pattern: offsets add up the pieces between matches and the matches before."""
    return f"""SELECT doc_id, {rank} AS k, '{kind}' AS kind, CAST(list_sum(list_transform(g[1:j], lambda s: length(s))) + coalesce(list_sum(list_transform(u[1:j - 1], lambda s: length(s))), 0) AS BIGINT) AS a, u[j] AS m, {keep.replace("m)", "u[j])").replace("(m,", "(u[j],")} AS ok
FROM (SELECT doc_id, u, g, unnest(range(1, len(u) + 1)) AS j FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS u, string_split_regex(t, '{pattern}') AS g FROM t))"""


SECRETS = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_matches(i, *k) for i, k in enumerate(KINDS))}),
s AS (SELECT doc_id, k, kind, a, a + length(m) AS b FROM f WHERE ok),
x AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (WHERE k < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM s GROUP BY 1)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN x ON x.doc_id = t.doc_id"""

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT * FROM v WHERE isfinite(list_inner_product(v, v)) AND list_inner_product(v, v) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reach),
m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1), n AS (SELECT x, count(*) AS n FROM e GROUP BY 1)
SELECT m.node AS vec_id, coalesce(n.n, 0) AS n_links, m.component_id, m.node = m.component_id AS kept FROM m LEFT JOIN n ON n.x = m.node"""

ORACLES = {"op2_minhash_near_dedup": NEAR_DUPLICATES, "op5_substring_dedup": REPEATS, "op6_secret_scan": SECRETS, "op10_embedding_near_dedup": VECTORS}

"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

from . import secrets, urls
from .common import LOWER, UPPER

#: Explicit URL rules of the query (host and path prefix -> verdict).
URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
             ("com/de/", "block"))

EXACT = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(kind: str) -> str:
    """CTE: (doc_id, rank, a, b) of the kind's matches, offsets from the lengths of matches and of the text between them."""
    p = _quoted(secrets.PATTERNS[kind])
    keep = {
        "assign": f"length(regexp_replace(m, {_quoted(secrets.ASSIGN_HEAD)}, '')) >= {secrets.LEAST_VALUE}",
        "opaque": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')",
    }.get(kind, "true")
    return f"""
{kind}_m AS (SELECT doc_id, unnest(regexp_extract_all(t, {p}, 0)) AS m,
             unnest(regexp_split_to_array(t, {p})[:len(regexp_extract_all(t, {p}, 0))]) AS g,
             generate_subscripts(regexp_extract_all(t, {p}, 0), 1) AS i FROM d WHERE regexp_matches(t, {p})),
{kind}_p AS (SELECT doc_id, {secrets.KINDS.index(kind)} AS rank, m,
             sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS a,
             sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM {kind}_m),
{kind}_k AS (SELECT doc_id, rank, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM {kind}_p WHERE {keep})"""


def _near(flag: str, gap: int) -> str:
    return (f"(coalesce(a - max(CASE WHEN {flag} THEN b END) OVER before <= {gap}, false)"
            f" OR coalesce(min(CASE WHEN {flag} THEN a END) OVER after - b <= {gap}, false))")


_WINDOWS = """WINDOW before AS (PARTITION BY doc_id ORDER BY a, rank, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
       after AS (PARTITION BY doc_id ORDER BY a, rank, b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""
_NAMES = "[" + ", ".join(_quoted(k) for k in secrets.KINDS) + "]"
_SPAN = f"string_agg({_NAMES}[rank + 1] || ':' || a || ':' || b, ',' ORDER BY a, rank, b)"

SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),{",".join(_matches(k) for k in secrets.KINDS)},
base AS ({" UNION ALL ".join(f"SELECT * FROM {k}_k" for k in secrets.BASE)}),
parts AS (SELECT * FROM base {" ".join(f"UNION ALL SELECT * FROM {k}_k" for k in secrets.KINDS if k not in secrets.BASE)}),
seen AS (SELECT *, {_near("rank < 3", -1)} OR (rank = 4 AND {_near("rank IN (3, 5)", -1)}) AS covered FROM parts {_WINDOWS}),
free AS (SELECT * FROM seen WHERE rank < 3 OR NOT covered),
done AS (SELECT *, CASE WHEN rank IN (1, 3, 5) THEN {_near("rank IN (0, 2, 4)", secrets.SCOPE)}
                        ELSE {_near("rank IN (1, 3, 5)", secrets.SCOPE)} END AS completed FROM free {_WINDOWS}),
spans AS (SELECT doc_id, rank, a, b FROM base UNION ALL SELECT doc_id, rank, a, b FROM done WHERE rank >= 3 AND completed),
b AS (SELECT doc_id, {_SPAN} AS s, count(*) FILTER (WHERE rank = 0) AS n0, count(*) FILTER (WHERE rank = 1) AS n1,
             count(*) FILTER (WHERE rank = 2) AS n2 FROM base GROUP BY doc_id),
s AS (SELECT doc_id, {_SPAN} AS s FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
       sha256(coalesce(b.s, '')) AS base_sha256, coalesce(s.s, '') AS spans
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN s USING (doc_id)"""


def _rule_case(column: int) -> str:
    """CASE over the rules, longest first: the rule (0) or its verdict (1)."""
    whens = []
    for r in sorted(URL_RULES, key=lambda r: -len(r[0])):
        host, slash, rest = r[0].partition("/")
        whens.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{rest}') THEN '{r[column]}'")
    return "CASE " + " ".join(whens) + " END"


def _last(host: str, n: int) -> str:
    return f"array_to_string(list_reverse(list_reverse(string_split({host}, '.'))[1:{n}]), '.')"


def _strength(source: str) -> str:
    spread = "sum(pow(bad - n * prior, 2) - n * prior * (1 - prior))"
    chance = "sum(n * (n - 1) * prior * (1 - prior))"
    return (f"(SELECT CASE WHEN coalesce({chance}, 0) = 0 OR {spread} <= 0 THEN {urls.MOST_STRENGTH} ELSE "
            f"least({urls.MOST_STRENGTH}, greatest({urls.LEAST_STRENGTH}, {chance} / {spread} - 1)) END FROM {source})")


URLS = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {_rule_case(0)} AS rule, {_rule_case(1)} AS ruled FROM p),
hc AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(ruled = 'block' AS INTEGER)) AS DOUBLE) AS bad
       FROM r WHERE ruled IS NOT NULL GROUP BY host),
root AS (SELECT (coalesce(sum(bad), 0) + {urls.ROOT_BAD}) / (coalesce(sum(n), 0) + {urls.ROOT_ALL}) AS q FROM hc),
dc AS (SELECT {_last("host", 2)} AS domain, sum(n) AS n, sum(bad) AS bad FROM hc GROUP BY 1),
sc AS (SELECT {_last("domain", 1)} AS suffix, sum(n) AS n, sum(bad) AS bad, (SELECT q FROM root) AS prior FROM dc GROUP BY 1),
s1 AS (SELECT {_strength("sc")} AS s),
sm AS (SELECT suffix, (s * prior + bad) / (s + n) AS q FROM sc, s1),
dp AS (SELECT dc.*, sm.q AS prior FROM dc JOIN sm ON sm.suffix = {_last("domain", 1)}),
s2 AS (SELECT {_strength("dp")} AS s),
dm AS (SELECT domain, (s * prior + bad) / (s + n) AS q FROM dp, s2),
hp AS (SELECT hc.*, dm.q AS prior FROM hc JOIN dm ON dm.domain = {_last("host", 2)}),
s3 AS (SELECT {_strength("hp")} AS s),
hosts AS (SELECT DISTINCT host FROM r),
ab AS (SELECT h.host, s * coalesce(dm.q, sm.q, (SELECT q FROM root)) + coalesce(hc.bad, 0) AS a,
              s * (1 - coalesce(dm.q, sm.q, (SELECT q FROM root))) + coalesce(hc.n, 0) - coalesce(hc.bad, 0) AS b
       FROM s3, hosts h LEFT JOIN dm ON dm.domain = {_last("h.host", 2)} LEFT JOIN sm ON sm.suffix = {_last("h.host", 1)}
       LEFT JOIN hc ON hc.host = h.host),
post AS (SELECT host, a / (a + b) AS mean, a / (a + b) - CAST({urls.DEVIATIONS} AS DOUBLE) * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ab)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN bound > {urls.TOLERATED} THEN 'block' ELSE 'allow' END) AS verdict,
       round(mean, 6) AS bad_rate, round(bound, 6) AS bound
FROM r JOIN post USING (host)"""

#: crc32 of a decimal id: a table of 256 values by the reflected polynomial, then one step per character.
_CRC = """
tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)),
          lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
crc AS (SELECT c, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
          lambda a, b: xor(a >> 8, tab.t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
        FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), tab)"""

PREFIX_TRIE = f"""
WITH RECURSIVE {_CRC.strip()},
own AS (SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos
        FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                     sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
              FROM conversations WHERE conv_id IS NOT NULL)),
built AS (SELECT crc.c, b.pos AS k, b.role, b.text FROM crc JOIN own b ON b.c = crc.c - crc.c % 100 AND b.pos <= crc.h
          UNION ALL SELECT own.c, own.pos, role, text FROM own JOIN crc USING (c) WHERE own.pos > crc.h),
seq AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k) AS d, role, text FROM built),
member AS (SELECT c, 0 AS d, CAST([] AS STRUCT(r VARCHAR, t VARCHAR)[]) AS path, 0 AS chars FROM crc
           UNION ALL SELECT c, d, list({{'r': role, 't': text}}) OVER (PARTITION BY c ORDER BY d), length(text) FROM seq),
named AS (SELECT *, min(c) OVER (PARTITION BY d, path) AS n FROM member),
up AS (SELECT a.*, b.n AS pn FROM named a LEFT JOIN named b ON b.c = a.c AND b.d = a.d - 1),
node AS (SELECT n, d, min(pn) AS pn, count(*) AS n_convs, max(chars) AS chars FROM up GROUP BY n, d),
kids AS (SELECT pn AS n, d - 1 AS d, count(*) AS n_children FROM node WHERE pn IS NOT NULL GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (n, d)),
-- every node counts for each prefix of its smallest member
above AS (SELECT a.n, a.d, x.n_children, (x.n_convs - 1) * x.chars AS saved FROM full_node x JOIN named a ON a.c = x.n AND a.d <= x.d),
total AS (SELECT n, d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY n, d),
last AS (SELECT c, max(d) AS d FROM member GROUP BY c),
ends AS (SELECT n, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM named JOIN last USING (c, d) GROUP BY n, d)
SELECT x.n AS conv_id, CAST(x.d AS BIGINT) AS depth, x.pn AS parent_conv_id, n_convs, n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_node x JOIN total USING (n, d) LEFT JOIN ends USING (n, d)"""

ORACLE = {"op11_prefix_trie": PREFIX_TRIE, "op1_secret_scan": SECRETS, "op2_exact_dedup": EXACT, "op5_url_filter": URLS}

"""DuckDB SQL of the corpus queries that SQL can express, over the same whole tables."""

from __future__ import annotations

JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s one ON one.doc_id = a JOIN s two ON two.doc_id = b WHERE 100 * i >= 80 * (len(one.s) + len(two.s) - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT doc_id, any_value(len(s.s)) AS n_shingles, min(c) AS component_id FROM r JOIN s USING (doc_id) GROUP BY 1"""


def _share(src: str, out: str, family: str, node: str) -> str:
    """Common table expressions that split each family's budget as `mixing.share_out` does."""
    part = f"PARTITION BY {family}" if family else ""
    return f"""{out}_a AS (SELECT *, CASE WHEN weight > 0 THEN capacity ELSE 0 END AS takes, CASE WHEN weight > 0 THEN capacity / weight ELSE 0 END AS ratio FROM {src}),
{out}_b AS (SELECT *, sum(weight) OVER ({part}) - sum(weight) OVER w AS behind, sum(takes) OVER w AS upto FROM {out}_a WINDOW w AS ({part} ORDER BY ratio, {node} ROWS UNBOUNDED PRECEDING)),
{out}_c AS (SELECT *, upto + ratio * greatest(behind, 0) <= budget AS isfull FROM {out}_b),
{out}_d AS (SELECT *, budget - coalesce(sum(CASE WHEN isfull THEN takes END) OVER ({part}), 0) AS rest, coalesce(sum(CASE WHEN NOT isfull THEN weight END) OVER ({part}), 0) AS opened FROM {out}_c),
{out} AS (SELECT * EXCLUDE (takes, ratio, behind, upto, isfull, rest, opened), coalesce(CASE WHEN isfull THEN takes ELSE least(takes, weight * rest / NULLIF(opened, 0)) END, 0) AS granted FROM {out}_d)"""


def mixing(domains: dict[str, float], langs: dict[str, float], share: float, epochs: int, seed: int) -> str:
    """The query op5 for given weights of domains and languages; a leaf without weight has no capacity."""
    when = lambda name, weights: f"CAST(CASE {' '.join(f"WHEN {name} = '{k}' THEN {w}" for k, w in weights.items())} ELSE 0 END AS DOUBLE)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(CASE WHEN regexp_extract(source, '([0-9]+)$', 1) <> '' THEN 'domain' || (CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4) END, 'none') AS domain, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS n FROM documents),
sums AS (SELECT domain, lang, source, CAST(sum(n) AS DOUBLE) AS tokens FROM d GROUP BY 1, 2, 3),
leaf AS (SELECT *, CASE WHEN {when("domain", domains)} > 0 AND {when("lang", langs)} > 0 THEN tokens * {epochs} ELSE 0 END AS capacity FROM sums),
domains AS (SELECT domain, sum(capacity) AS capacity, (SELECT sum(tokens) FROM leaf) * {share} AS budget, {when("domain", domains)} AS weight FROM leaf GROUP BY 1), {_share("domains", "dg", "", "domain")},
langs AS (SELECT domain, lang, sum(capacity) AS capacity, any_value(granted) AS budget, {when("lang", langs)} AS weight FROM leaf JOIN (SELECT domain, granted FROM dg) USING (domain) GROUP BY 1, 2), {_share("langs", "lg", "domain", "lang")},
sources AS (SELECT domain, lang, source, tokens, capacity, granted AS budget, 1.0::DOUBLE AS weight FROM leaf JOIN (SELECT domain, lang, granted FROM lg) USING (domain, lang)), {_share("sources", "sg", "domain, lang", "source")},
q AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN CAST(floor(granted / tokens) AS INTEGER) ELSE {epochs} END AS whole, CASE WHEN tokens > 0 THEN granted - floor(granted / tokens) * tokens ELSE 0 END AS quota FROM sg),
k AS (SELECT d.*, whole, quota, md5('{seed}:' || whole || ':' || doc_id) AS k FROM d JOIN q USING (domain, lang, source)),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < quota AS taken FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, CAST(whole + CAST(taken AS INTEGER) AS INTEGER) AS epochs, CAST(n * (whole + CAST(taken AS INTEGER)) AS BIGINT) AS tokens_taken FROM c"""


AUDIT = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
m AS (SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT)
 + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM w),
l AS (SELECT doc_id, max(CAST(coalesce(quality, 0) = 1 AS INT)) AS good, max(CAST(coalesce(toxic, 0) = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
h AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0) AS earlier FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (bit | CAST(earlier AS INT)) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & CAST(earlier AS INT) = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & bit > 0 AND mask & CAST(earlier AS INT) > 0 THEN n ELSE 0 END) AS redundant,
 sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & bit > 0 AND mask & CAST(earlier AS INT) = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & CAST(earlier AS INT) = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM h, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
 CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""

LEXICAL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2), n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY 1), c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark), q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY 1, 2),
v AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), c),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN v USING (term) JOIN p USING (term) JOIN n USING (doc_id), c GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""

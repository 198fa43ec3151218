"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others use what DuckDB's SQL lacks: an HTML parser (1), a byte-pair encoder (3), byte strings of UTF-8 text (4), XXH64 (5), the
fitted classifier (9), eigenvectors (11), runs of words (12) and possessive patterns with a corpus statistic (13); tests hold them against brute force.
"""

from __future__ import annotations

from .common import LOWER, UPPER
from .mixing import MAX_EPOCHS, SEED, WEIGHTS
from .preferences import TRAINED
from .topk import K, SCALE
from .url_filter import BAD_SHARE, RULES, STRENGTH, Z

_LOWERED = f"translate({{0}}, '{UPPER}', '{LOWER}')"

MIX = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(f"{x}.0::DOUBLE" for x in WEIGHTS)}][(k - 1) % {len(WEIGHTS)} + 1] AS weight, {MAX_EPOCHS}.0::DOUBLE * n AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM w),
l AS (SELECT *, ((SELECT sum(n) FROM w) - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) AS level
  FROM o WINDOW b AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, place) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, n, least(cap, coalesce((SELECT level FROM f) * weight, cap)) AS target FROM l),
x AS (SELECT *, CASE WHEN n > 0 THEN least(floor(target / n), {MAX_EPOCHS}) ELSE 0 END AS whole FROM t),
r AS (SELECT doc_id, size, n, target, whole, target - whole * n AS rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS middle
  FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, target, (size * (whole + CASE WHEN whole < {MAX_EPOCHS} AND middle < rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r"""

_WORDS = rf"regexp_extract_all({_LOWERED.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = rf"""WITH b AS (SELECT DISTINCT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
t AS (SELECT r, len(w) AS total, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
n AS (SELECT DISTINCT n FROM g),
x AS (SELECT r, n, i, total, string_agg(word, ' ') OVER (PARTITION BY r, n ORDER BY i ROWS BETWEEN CURRENT ROW AND (n - 1) FOLLOWING) AS gram FROM t, n),
h AS (SELECT r, x.n, i, item FROM x JOIN g ON x.n = g.n AND x.gram = g.gram WHERE i <= total - x.n + 1),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM h) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

TOP_K = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id, q.e ORDER BY list_inner_product(q.e, v.e) DESC, v.vec_id)::INT AS rank, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
FROM q JOIN v ON q.vec_id <> v.vec_id QUALIFY rank <= {K}"""


def _strength(level: str) -> str:
    """Share p and strength m of a level's beta distribution by moments."""
    low, high = STRENGTH
    return f"""(SELECT p, CASE WHEN k = 0 THEN {low} WHEN between_ > 0 THEN least(greatest(p * (1 - p) / between_ - 1, {low}), {high}) ELSE {high} END AS m FROM
  (SELECT k, coalesce(p, 0) AS p, CASE WHEN n - n2 / n > 0 THEN (bb - n * p * p - (k - 1) * p * (1 - p)) / (n - n2 / n) ELSE 0 END AS between_ FROM
    (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(b)::DOUBLE / sum(n) AS p, sum(n * n)::DOUBLE AS n2, sum(b * b / n)::DOUBLE AS bb FROM {level} WHERE n > 0)))"""


_RULES = ", ".join(f"('{h}', '{p}', '{v}', {i})" for i, (h, p, v) in enumerate(RULES))

URL_FILTER = rf"""WITH u AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, r, coalesce({_LOWERED.format(r"regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
bad AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
o AS (SELECT host, bad FROM p LEFT JOIN bad ON doc_id = try_cast(nullif(regexp_extract(path, '(\d{{1,18}})\D*$', 1), '') AS BIGINT)),
h AS (SELECT host, array_to_string(list_slice(string_split(regexp_replace(host, ':\d*$', ''), '.'), -2, NULL), '.') AS domain, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS b FROM o GROUP BY host),
hosts AS (SELECT *, list_last(string_split(domain, '.')) AS suffix FROM h),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(b)::BIGINT AS b FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(b)::BIGINT AS b FROM domains GROUP BY ALL),
ms AS {_strength("suffixes")}, md AS {_strength("domains")}, mh AS {_strength("hosts")},
ps AS (SELECT suffix, (b + m * p) / (n + m) AS ps FROM suffixes, ms),
pd AS (SELECT domain, (b + m * ps) / (n + m) AS pd FROM domains JOIN ps USING (suffix), md),
rep AS (SELECT host, share - {Z} * sqrt(share * (1 - share) / (total + 1)) AS bound FROM (SELECT host, (b + m * pd) / (n + m) AS share, n + m AS total FROM hosts JOIN pd USING (domain), mh)),
rules(rh, rp, verdict, k) AS (VALUES {_RULES}),
hit AS (SELECT r, arg_max(rh || rp, (length(rh || rp), -k)) AS rule, arg_max(verdict, (length(rh || rp), -k)) AS verdict FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bound > {BAD_SHARE} THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN hit USING (r) LEFT JOIN rep USING (host)"""


def _side(name: str) -> str:
    """Rendered text and loss spans of what follows the prompt, by pair."""
    return f"""{name} AS (SELECT pair, string_agg(head || text || chr(10), '' ORDER BY i) AS text, coalesce(string_agg(CASE WHEN role = '{TRAINED}' THEN (place + length(head)) || '-' || (place + length(head) + length(text)) END, ',' ORDER BY i), '') AS loss
  FROM (SELECT *, coalesce(sum(length(head) + length(text) + 1) OVER (PARTITION BY pair ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM rest WHERE side = '{name}') GROUP BY pair)"""


PREFERENCES = f"""WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, 9223372036854775807) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, (conv_id - ((conv_id % 2) + 2) % 2) // 2 AS pair, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, role, text, '<|' || role || '|>' || chr(10) AS head FROM t),
p AS (SELECT pair, max(conv_id) FILTER (side = 'chosen') AS chosen_id, max(conv_id) FILTER (side = 'rejected') AS rejected_id, coalesce(max(i) FILTER (side = 'chosen'), 0) AS na, coalesce(max(i) FILTER (side = 'rejected'), 0) AS nb FROM n GROUP BY pair),
c AS (SELECT a.pair, min(a.i) AS i FROM n a JOIN n b ON a.pair = b.pair AND a.side = 'chosen' AND b.side = 'rejected' AND a.i = b.i WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair),
k AS (SELECT p.*, coalesce(c.i - 1, least(na, nb)) AS prefix FROM p LEFT JOIN c USING (pair)),
prompt AS (SELECT n.pair, string_agg(head || text || chr(10), '' ORDER BY n.i) AS text FROM n JOIN k USING (pair) WHERE side = 'chosen' AND n.i <= prefix GROUP BY n.pair),
rest AS (SELECT n.* FROM n JOIN k USING (pair) WHERE n.i > prefix),
{_side("chosen")}, {_side("rejected")}
SELECT k.pair AS pair_id, chosen_id, rejected_id, prefix::INT AS n_prompt_turns, coalesce(prompt.text, '') AS prompt, coalesce(a.text, '') AS chosen, coalesce(a.loss, '') AS chosen_loss, coalesce(b.text, '') AS rejected, coalesce(b.loss, '') AS rejected_loss,
coalesce(a.loss, '') <> '' AND coalesce(b.loss, '') <> '' AND coalesce(a.text, '') <> coalesce(b.text, '') AS usable
FROM k LEFT JOIN prompt ON prompt.pair = k.pair LEFT JOIN chosen a ON a.pair = k.pair LEFT JOIN rejected b ON b.pair = k.pair"""

ORACLES = {"op2_mix_sources": MIX, "op6_decontaminate": DECONTAMINATE, "op7_top_k": TOP_K, "op8_url_filter": URL_FILTER, "op10_preferences": PREFERENCES}

"""SQL counterparts (DuckDB) of the corpus queries that SQL can express."""

from __future__ import annotations

from . import license_scan, quality_rules, url_rules

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

_LOW = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {_LOW} AS ws FROM documents),
g AS (SELECT DISTINCT r, array_to_string(ws[s : s + k - 1], ' ') AS g FROM (SELECT r, ws, least(5, len(ws)) AS k, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS s FROM w WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach AS (SELECT r AS x, r AS y FROM w UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
c AS (SELECT x AS r, min(doc_id) AS component_id, count(*) AS component_size FROM reach JOIN w ON w.r = y GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_size::BIGINT AS component_size FROM w JOIN c USING (r) LEFT JOIN n USING (r)
"""

OP3 = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT r, doc_id, unnest(range(1, greatest(len(ws) - 11, 1))) AS s, ws FROM w WHERE doc_id IS NOT NULL),
key AS (SELECT r, doc_id, s, array_to_string(ws[s : s + 12], ' ') AS g FROM win),
low AS (SELECT g, min(doc_id) AS first_doc FROM key GROUP BY g),
hit AS (SELECT r, s FROM key JOIN low USING (g) WHERE first_doc < doc_id),
gone AS (SELECT DISTINCT r, s + k AS p FROM hit, (SELECT unnest(range(13)) AS k)),
lists AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lists USING (r)
"""

OP4 = """
WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY pos) AS turns, count(*) AS n,
  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>', chr(10) ORDER BY pos) AS rendered FROM t GROUP BY conv_id),
u AS (SELECT turns, n, min(conv_id) AS conv_id, count(*) AS n_equal FROM c GROUP BY turns, n),
prefixes AS (SELECT DISTINCT turns[1:k] AS p FROM (SELECT turns, unnest(range(1, n)) AS k FROM c))
SELECT u.conv_id, u.n::BIGINT AS n_turns, u.n_equal::BIGINT AS n_equal, c.rendered
FROM u JOIN c USING (conv_id) WHERE NOT EXISTS (SELECT 1 FROM prefixes WHERE p = u.turns)
"""


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op5() -> str:
    table = ", ".join(f"({_quote(s)}, {_quote(i)})" for s, i in license_scan.SENTENCES.items())
    cases = " ".join(f"WHEN regexp_matches(framed, {_quote(p)}) THEN {_quote(n)}" for n, p in license_scan.RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
s AS (SELECT r, unnest(string_split_regex(lower(coalesce(text, '')), {_quote(license_scan.BREAK)})) AS raw, generate_subscripts(string_split_regex(lower(coalesce(text, '')), {_quote(license_scan.BREAK)}), 1) AS k FROM d),
known(sentence, id) AS (VALUES {table}),
ids AS (SELECT r, string_agg(id, ' ' ORDER BY k) AS sentence_ids, count(*) AS n FROM s JOIN known ON trim(regexp_replace(raw, {_quote(license_scan.NOISE)}, ' ', 'g')) = sentence GROUP BY r),
f AS (SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(n, 0)::BIGINT AS n_sentences, ' ' || coalesce(sentence_ids, '') || ' ' AS framed FROM d LEFT JOIN ids USING (r))
SELECT doc_id, sentence_ids, n_sentences, CASE {cases} END AS license FROM f
"""


def _op6(r: quality_rules.LineRules = quality_rules.LineRules()) -> str:
    closing = _quote(r.closing)
    seps = "+".join(f"(length(line) - length(replace(line, '{c}', '')))" for c in r.nav_separators)
    phrases = " OR ".join(f"contains(lower(line), {_quote(p)})" for p in r.boilerplate)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT r, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM d),
win AS (SELECT r, s, ws[s] || ' ' || ws[s + 1] || ' ' || ws[s + 2] AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS s FROM d)),
twice AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT s + k)::BIGINT AS n_repeat FROM twice, (SELECT unnest(range(3)) AS k) GROUP BY r),
l AS (SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
j AS (SELECT r, line, n, ({seps}) >= greatest(1, {r.nav_share} * n) OR length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > {r.symbol_share} * n
  OR (n <= {r.boilerplate_words} AND ({phrases})) OR (n < {r.fragment_words} AND NOT contains({closing}, right(regexp_replace(line, '[\x20\x09-\x0D]+$', ''), 1))) AS bad FROM l WHERE n > 0),
lines AS (SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n_dup, coalesce(sum(n) FILTER (bad), 0)::BIGINT AS lost, count(*) FILTER (bad)::BIGINT AS failed FROM j GROUP BY r),
f AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(lost, 0) AS n_lost_words, coalesce(failed, 0) AS n_failed_lines,
  n_words < {r.min_words} OR 100 * coalesce(n_repeat, 0) > 50 * n_words AS base_failed FROM b LEFT JOIN rep USING (r) LEFT JOIN lines USING (r))
SELECT *, NOT base_failed AND n_lost_words <= {r.most_lost} * n_words AS kept FROM f
"""


def _op7() -> str:
    sites = []
    for s in sorted(url_rules.SITE_RULES, key=lambda s: -len(s.name)):
        sites.append((f"(host = {_quote(s.host)} OR ends_with(host, {_quote('.' + s.host)})) AND starts_with(path, {_quote(s.path)})", s))
    rule = " ".join(f"WHEN {c} THEN {_quote(s.name)}" for c, s in sites)
    site_verdict = " ".join(f"WHEN rule = {_quote(s.name)} THEN '{s.verdict}'" for _, s in sites)
    ordered = sorted(url_rules.REGISTERED_RULES, key=lambda p: p.verdict != "allow")
    pattern = " ".join(f"WHEN regexp_matches(lower(url), {_quote(p.pattern)}) THEN {_quote(p.name)}" for p in ordered)
    allow = ", ".join(_quote(p.name) for p in ordered if p.verdict == "allow") or "''"
    return f"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS h, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
b AS (SELECT page_id, url, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM a),
c AS (SELECT *, CASE {rule} END AS rule FROM b),
d AS (SELECT *, CASE WHEN rule IS NULL AND host <> '' THEN CASE {pattern} END END AS pattern FROM c)
SELECT page_id, host, path, rule, CASE {site_verdict} WHEN pattern IS NULL OR pattern IN ({allow}) THEN 'allow' ELSE 'block' END AS verdict, pattern FROM d
"""


OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
ig AS (SELECT DISTINCT q, item_id, k, ws[s : s + k - 1] AS g FROM (SELECT q, item_id, ws, least(5, len(ws)) AS k, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS s FROM i WHERE len(ws) > 0)),
n AS (SELECT q, count(*) AS n FROM ig GROUP BY q),
dg AS (SELECT DISTINCT r, ws[s : s + k - 1] AS g FROM (SELECT r, ws, k, unnest(range(1, greatest(len(ws) - k + 2, 1))) AS s FROM d, (SELECT DISTINCT k FROM ig))),
m AS (SELECT r, q, item_id, count(*) AS c FROM dg JOIN ig USING (g) GROUP BY r, q, item_id),
f AS (SELECT r, list(item_id ORDER BY item_id) AS item_ids, max(c::DOUBLE / n) AS max_containment FROM m JOIN n USING (q) WHERE c >= 0.75 * n GROUP BY r)
SELECT doc_id, coalesce(array_to_string(list_transform(item_ids, lambda x: x::VARCHAR), ','), '') AS item_ids, item_ids IS NOT NULL AS contaminated, max_containment FROM d LEFT JOIN f USING (r)
"""


OP11 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10
"""

_TIME = r"([T ]([0-9]{2}):([0-9]{2})(:([0-9]{2}))?( ?([AP])M)?( ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?"

OP12 = rf"""
WITH s AS (SELECT row_number() OVER () AS r, stamp_id, source, zone, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM stamps),
k AS (SELECT *, CASE WHEN regexp_full_match(t, '[0-9]{{10}}|[0-9]{{13}}') THEN 0
  WHEN regexp_full_match(t, '(20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}[.][0-9]{{2}}[.]20[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/20[0-9]{{2}}){_TIME}') THEN 10
  WHEN regexp_full_match(t, '20[0-9]{{6}}{_TIME}') THEN 8
  WHEN regexp_full_match(t, '[0-9]{{2}} (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) 20[0-9]{{2}}{_TIME}') THEN 11 END AS size FROM s),
f AS (SELECT *, left(t, size) AS d, substr(t, size + 1) AS rest, size = 10 AND substr(t, 3, 1) = '/' AS slashed FROM k),
g AS (SELECT r, stamp_id, source, zone, t, size, slashed,
  CASE WHEN size = 8 THEN try_cast(left(d, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7, 2) AS DATE) WHEN size = 11 THEN try_strptime(d, '%d %b %Y')::DATE WHEN size = 10 AND substr(d, 5, 1) = '-' THEN try_cast(d AS DATE)
    WHEN size = 10 THEN try_cast(substr(d, 7, 4) || '-' || substr(d, 4, 2) || '-' || left(d, 2) AS DATE) END AS d1,
  CASE WHEN slashed THEN try_cast(substr(d, 7, 4) || '-' || left(d, 2) || '-' || substr(d, 4, 2) AS DATE) END AS d2,
  CASE WHEN rest = '' THEN 0 ELSE substr(rest, 2, 2)::INT END AS h, CASE WHEN rest = '' THEN 0 ELSE substr(rest, 5, 2)::INT END AS mi,
  coalesce(try_cast(regexp_extract(rest, '{_TIME}', 5) AS INT), 0) AS se, regexp_extract(rest, '{_TIME}', 7) AS half, replace(regexp_extract(rest, '{_TIME}', 9), ':', '') AS o FROM f),
c AS (SELECT *, CASE WHEN half = '' THEN h ELSE h % 12 + CASE half WHEN 'P' THEN 12 ELSE 0 END END * 3600 + mi * 60 + se AS sec,
  CASE WHEN o IN ('', 'Z') THEN 0 ELSE (substr(o, 2, 2)::INT * 3600 + substr(o, 4, 2)::INT * 60) * CASE left(o, 1) WHEN '-' THEN -1 ELSE 1 END END AS shift, o <> '' AS given,
  size IS NULL OR size > 0 AND ((d1 IS NULL AND d2 IS NULL) OR mi > 59 OR se > 59 OR h > 23 OR (half <> '' AND NOT h BETWEEN 1 AND 12) OR (length(o) = 5 AND (substr(o, 2, 2) > '14' OR substr(o, 4, 2) > '59')) OR (o = '' AND zone IS NULL)) AS bad FROM g),
v AS (SELECT source, count(*) FILTER (d2 IS NULL) AS dm, count(*) FILTER (d1 IS NULL) AS md FROM c WHERE slashed AND NOT bad AND (d1 IS NULL) <> (d2 IS NULL) GROUP BY source),
j AS (SELECT c.*, CASE WHEN bad THEN 'bad' WHEN size = 0 THEN 'epoch' WHEN d1 IS NOT NULL AND d2 IS NOT NULL AND d1 <> d2 THEN CASE WHEN dm <> md THEN 'votes' ELSE 'default' END ELSE 'plain' END AS rule, coalesce(dm > md, false) AS day_first
  FROM c LEFT JOIN v ON c.source IS NOT DISTINCT FROM v.source),
w AS (SELECT *, CASE WHEN rule NOT IN ('bad', 'epoch') THEN CASE WHEN rule IN ('votes', 'default') AND NOT day_first THEN d2 ELSE coalesce(d1, d2) END::TIMESTAMP + to_seconds(sec) END AS wall FROM j),
z AS (SELECT *, epoch(timezone(zone, timezone('UTC', wall - INTERVAL 1 DAY))) - epoch(wall - INTERVAL 1 DAY) AS o1, epoch(timezone(zone, timezone('UTC', wall + INTERVAL 1 DAY))) - epoch(wall + INTERVAL 1 DAY) AS o2 FROM w),
y AS (SELECT *, epoch(timezone(zone, timezone('UTC', wall - to_seconds(o1::BIGINT)))) = epoch(wall) AS old_fits, epoch(timezone(zone, timezone('UTC', wall - to_seconds(o2::BIGINT)))) = epoch(wall) AS new_fits FROM z),
x AS (SELECT *, coalesce(NOT given AND wall IS NOT NULL AND o1 <> o2 AND old_fits = new_fits, false) AS odd FROM y)
SELECT stamp_id, CASE rule WHEN 'bad' THEN NULL WHEN 'epoch' THEN t::BIGINT * CASE length(t) WHEN 10 THEN 1000000 ELSE 1000 END
  ELSE epoch_us(wall) - 1000000 * CASE WHEN given THEN shift WHEN o1 = o2 OR odd OR old_fits THEN o1::BIGINT ELSE o2::BIGINT END END AS utc_us,
  rule, rule IN ('votes', 'default') OR odd AS ambiguous FROM x
"""

OP13 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, a.label = c.label AS same, c.r AS other, c.vec_id, list_dot_product(a.e, c.e)::BIGINT AS score FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 50 = 0),
p AS (SELECT r, anchor_id, other AS p_row, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p_row ORDER BY s.score DESC, s.vec_id NULLS LAST)::INT AS rank
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

ORACLES = {
    "op2_ngram_join": OP2, "op3_substring_dedup": OP3, "op4_chat_snapshots": OP4, "op5_license_scan": _op5(),
    "op6_quality_rules": _op6(), "op7_url_rules": _op7(), "op10_decontaminate": OP10,
    "op11_pivot_search": OP11, "op12_timestamps": OP12, "op13_hard_negatives": OP13,
}

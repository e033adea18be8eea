"""The registered queries in DuckDB's SQL, over the same tables."""

from __future__ import annotations

from loomspark.functions.text import LOWER, STOP_WORDS, UPPER
from loomspark.plans import views

QUERY = "thatin thtion attion ertion thtion"
ROUNDS = 4

WS = r"[\s\x0B\x85\p{Z}]"
CHUNKS = "chunks AS (SELECT doc_id::VARCHAR AS id, doc_id AS pos, source || '/' || doc_id || '.md' AS path, coalesce(text, '') AS content, CASE doc_id % 5 WHEN 0 THEN 'code' WHEN 1 THEN 'comment' WHEN 2 THEN 'doc' WHEN 3 THEN 'diagnostic' ELSE 'selection' END AS kind, (doc_id % 3)::INT AS priority FROM documents WHERE doc_id IS NOT NULL)"


def norm(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def lines(x: str) -> str:
    s = rf"string_split_regex({x}, '\r?\n')"
    return f"(CASE WHEN {s}[-1] = '' THEN {s}[1:len({s}) - 1] ELSE {s} END)"


def tokens(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"list_filter(list_transform(list_filter(string_split_regex({x}, '[^\p{{L}}\p{{N}}_]+'), lambda w: strlen(w) > 1), lambda w: translate(w, '{UPPER}', '{LOWER}')), lambda w: w NOT IN ({stop}))"


def estimate(x: str) -> str:
    words = rf"len(regexp_extract_all({x}, '[^\s\x0B\x85\p{{Z}}]+'))"
    return f"(CASE WHEN {x} = '' THEN 0 ELSE greatest(ceil(length({x}) / 3.6::DOUBLE), ceil({words} * 1.3::DOUBLE), 1) END)::BIGINT"


def trimmed(x: str) -> str:
    return rf"list_filter(list_transform({lines(x)}, lambda v: regexp_replace(v, '^{WS}+|{WS}+$', '', 'g')), lambda v: v <> '')"


def tidy(x: str) -> str:
    kept = rf"list_filter({lines(x)}, lambda v: regexp_replace(v, '{WS}+', '', 'g') <> '')"
    return rf"array_to_string(list_transform({kept}, lambda v: regexp_extract(v, '^{WS}*') || trim(regexp_replace(substr(v, length(regexp_extract(v, '^{WS}*')) + 1), '{WS}+', ' ', 'g'))), chr(10))"


def hash60(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 15))::BIGINT"


ORACLES: dict[str, str] = {}
O = ORACLES  # noqa: E741

O["token_estimate"] = f"WITH {CHUNKS} SELECT pos, {estimate('content')} AS tokens, floor({estimate('content')} * 3.6::DOUBLE)::BIGINT AS chars FROM chunks"
O["normalize_ws"] = f"WITH {CHUNKS} SELECT pos, md5({norm('content')}) AS digest FROM chunks"
O["tokenize"] = f"WITH {CHUNKS}, t AS (SELECT pos, {tokens('content')} AS t FROM chunks) SELECT pos, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS digest FROM t"
O["line_fingerprint"] = f"WITH {CHUNKS}, t AS (SELECT pos, list_distinct(list_filter(list_transform({lines('content')}, lambda v: {norm('v')}), lambda v: v <> '')) AS s FROM chunks) SELECT pos, len(s)::BIGINT AS n, md5(array_to_string(list_sort(list_transform(s, lambda v: md5(v))), '')) AS digest FROM t"
SHINGLES = "CASE WHEN len(k) = 0 THEN [] ELSE list_transform(range(0, len(k) - least(3, len(k)) + 1), lambda i: array_to_string(k[i + 1:i + least(3, len(k))], chr(10))) END"
O["lines_shingles"] = f"WITH {CHUNKS}, t AS (SELECT pos, {trimmed('content')} AS k FROM chunks), u AS (SELECT pos, {SHINGLES} AS s FROM t) SELECT pos, len(s)::BIGINT AS n, md5(array_to_string(s, '|')) AS digest FROM u"
O["language_detect"] = r"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'none' ELSE lower(['rs','TS','tsx','js','mjs','cjs','py','pyi','json','md','markdown','txt',''][doc_id % 13 + 1]) END AS e FROM documents),
l AS (SELECT doc_id, CASE WHEN e = 'rs' THEN 'rust' WHEN e IN ('ts', 'tsx') THEN 'typescript' WHEN e IN ('js', 'mjs', 'cjs') THEN 'javascript' WHEN e IN ('py', 'pyi') THEN 'python' WHEN e = 'json' THEN 'json' WHEN e IN ('md', 'markdown') THEN 'markdown' ELSE 'unknown' END AS language FROM d)
SELECT doc_id, language, CASE WHEN language IN ('rust', 'typescript', 'javascript') THEN '//' WHEN language = 'python' THEN '#' ELSE '' END AS prefixes FROM l"""
NOISY = r"""n AS (SELECT doc_id, ['rust','typescript','python','json'][doc_id % 4 + 1] AS language,
  coalesce(text, '') || E'\n/* a\nb */ y  = 2; # c // d\n  console.log(1);\nprintln!(2);\nprint(3)\n\'\'\'doc\nx\'\'\' z\n' AS content FROM documents)"""
O["strip_regex"] = (
    f"WITH {NOISY}, "
    + r"""c AS (SELECT doc_id, language, CASE WHEN language IN ('rust', 'typescript') THEN regexp_replace(regexp_replace(content, '/\*.*?\*/', '', 'gs'), '//[^\n]*', '', 'g')
  WHEN language = 'python' THEN regexp_replace(regexp_replace(content, '(?sm)^\s*(?:"{3}|''{3}).*?(?:"{3}|''{3})', '', 'g'), '#[^\n]*', '', 'g') ELSE content END AS x FROM n)
SELECT doc_id, md5(CASE language WHEN 'typescript' THEN regexp_replace(x, '(?m)^\s*console\.(log|debug|info|trace)\s*\([^;\n]*\)\s*;?\s*$', '', 'g')
  WHEN 'rust' THEN regexp_replace(x, '(?m)^\s*println!\s*\([^;\n]*\)\s*;?\s*$', '', 'g') WHEN 'python' THEN regexp_replace(x, '(?m)^\s*print\s*\([^)\n]*\)\s*$', '', 'g') ELSE x END) AS digest FROM c"""
)
O["strip_post"] = f"WITH {NOISY} SELECT doc_id, md5({tidy('content')}) AS digest FROM n"
O["display_format"] = """
WITH u AS (SELECT event_id AS ts, (abs(value) * 100)::DOUBLE AS x, trunc(abs(value) * 100)::BIGINT * 37 AS n, (user_id % 50)::DOUBLE AS e, CASE WHEN user_id % 9 = 0 THEN '  ' ELSE event_type END AS q FROM events)
SELECT ts, CASE WHEN n >= 1000000 THEN format('{:.1f}M', n / 1e6::DOUBLE) WHEN n >= 1000 THEN format('{:.1f}K', n / 1e3::DOUBLE) ELSE n::VARCHAR END AS size,
  CASE WHEN e * 90 >= 1000 THEN format('{:.1f}s', e * 90 / 1e3::DOUBLE) ELSE format('{:.0f}ms', e * 90) END AS time,
  CASE WHEN length(q) <= 5 THEN q ELSE substr(q, 1, 4) || '…' END AS short, repeat('█', round(e / 50 * 10)::INT) || repeat('░', 10 - round(e / 50 * 10)::INT) AS bar FROM u"""
EXACT = f"{CHUNKS}, kept AS (SELECT min(pos) AS pos FROM chunks GROUP BY md5({norm('content')})), ex AS (SELECT chunks.* FROM chunks JOIN kept USING (pos))"
O["exact_dedup"] = f"WITH {EXACT} SELECT pos FROM ex"


def fingerprints(of: str) -> str:
    return f"""tf AS (SELECT pos, t, count(*) AS n FROM (SELECT pos, unnest({tokens('content')}) AS t FROM {of}) GROUP BY ALL),
hb AS (SELECT pos, n, ('0x' || substr(md5(t), 1, 8))::BIGINT AS a, ('0x' || substr(md5(t), 9, 8))::BIGINT AS b FROM tf),
sums AS (SELECT pos, i, count(*) AS u, sum(CASE WHEN ((CASE WHEN i < 32 THEN a ELSE b END) >> (i % 32)::BIGINT) & 1 = 1 THEN n ELSE -n END) AS v FROM hb, range(64) r(i) GROUP BY pos, i),
fps AS (SELECT pos, (CASE WHEN max(u) >= 4 THEN sum(CASE WHEN v > 0 THEN 1::HUGEINT << i::INT ELSE 0 END) ELSE 0 END)::UBIGINT AS fp FROM sums GROUP BY pos)"""


O["simhash_fp"] = f"WITH {CHUNKS}, {fingerprints('chunks')} SELECT pos, lower(printf('%016x', coalesce(fp, 0::UBIGINT))) AS fp FROM chunks LEFT JOIN fps USING (pos)"
PAIRS = f"{EXACT}, {fingerprints('ex')}, f1 AS (SELECT fp, min(pos) AS pos FROM fps WHERE fp <> 0 GROUP BY fp), pairs AS (SELECT x.pos AS a, y.pos AS b, bit_count(xor(x.fp, y.fp))::BIGINT AS distance FROM f1 x JOIN f1 y ON x.pos < y.pos WHERE bit_count(xor(x.fp, y.fp)) <= 3)"
O["simhash_pairs"] = f"WITH {PAIRS} SELECT a, b, distance, round(1.0::DOUBLE - distance / 64.0::DOUBLE, 6) AS similarity FROM pairs"
O["dedup_members"] = f"WITH {CHUNKS}, ks AS (SELECT pos, min(pos) OVER (PARTITION BY md5({norm('content')})) AS exact FROM chunks), {fingerprints('chunks')} SELECT ks.pos, exact, CASE WHEN coalesce(fp, 0) = 0 THEN exact ELSE min(ks.pos) OVER (PARTITION BY fp) END AS first FROM ks LEFT JOIN fps USING (pos)"
SIGS = f"""k AS (SELECT pos, {trimmed('content')} AS k FROM SRC), sh AS (SELECT pos, {SHINGLES} AS s FROM k),
hh AS (SELECT pos, ('0x' || substr(md5(s), 1, 8))::BIGINT AS h1, greatest(1, ('0x' || substr(md5(s), 9, 8))::BIGINT) AS h2 FROM (SELECT pos, unnest(s) AS s FROM sh)),
mins AS (SELECT pos, i, min((h1 + i * h2) % 4294967291) AS m FROM hh, range(128) r(i) GROUP BY pos, i),
sig AS (SELECT sh.pos, coalesce(list(m ORDER BY i) FILTER (WHERE m IS NOT NULL), list_transform(range(128), lambda i: 4294967291::BIGINT)) AS sig FROM sh LEFT JOIN mins USING (pos) GROUP BY sh.pos)"""
O["minhash_sig"] = f"WITH {CHUNKS}, {SIGS.replace('SRC', 'chunks')} SELECT pos, md5(array_to_string(sig, ',')) AS digest FROM sig"
LSH = f"""{EXACT}, wl AS (SELECT pos, replace(content, ' ', chr(10)) AS content FROM ex), {SIGS.replace('SRC', 'wl')}, bands AS (SELECT pos, j, array_to_string(sig[j * 8 + 1:j * 8 + 8], ',') AS key FROM sig, range(16) r(j)),
met AS (SELECT DISTINCT x.pos AS a, y.pos AS b FROM bands x JOIN bands y ON x.j = y.j AND x.key = y.key AND x.pos < y.pos),
lp AS (SELECT a, b, len(list_filter(range(1, 129), lambda i: x.sig[i] = y.sig[i])) / 128.0::DOUBLE AS similarity FROM met JOIN sig x ON x.pos = a JOIN sig y ON y.pos = b),
pairs AS (SELECT * FROM lp WHERE similarity >= 0.5)"""
O["lsh_candidates"] = f"WITH {LSH} SELECT a, b, round(similarity, 6) AS similarity FROM pairs"
JAC = f"""{EXACT}, ls AS (SELECT pos, unnest(list_distinct(list_filter(list_transform({lines('content')}, lambda v: {norm('v')}), lambda v: v <> ''))) AS l FROM ex),
sz AS (SELECT pos, count(*) AS n FROM ls GROUP BY pos), it AS (SELECT x.pos AS a, y.pos AS b, count(*) AS i FROM ls x JOIN ls y ON x.l = y.l AND x.pos < y.pos GROUP BY ALL),
jp AS (SELECT a, b, i / (sa.n + sb.n - i)::DOUBLE AS jaccard FROM it JOIN sz sa ON sa.pos = a JOIN sz sb ON sb.pos = b), pairs AS (SELECT * FROM jp WHERE jaccard >= 0.5)"""
O["line_jaccard_pairs"] = f"WITH {JAC} SELECT a, b, round(jaccard, 6) AS jaccard FROM pairs"
FIRST_KEEP = """links AS (SELECT b, list(a) AS aa, row_number() OVER (ORDER BY b) AS k FROM pairs GROUP BY b),
res AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL SELECT res.k + 1, CASE WHEN len(list_filter(links.aa, lambda x: NOT list_contains(res.gone, x))) > 0 THEN list_append(res.gone, links.b) ELSE res.gone END FROM res JOIN links ON links.k = res.k + 1),
gone AS (SELECT unnest(gone) AS pos FROM (SELECT gone FROM res ORDER BY k DESC LIMIT 1))"""
O["simhash_dedup"] = f"WITH RECURSIVE {PAIRS}, {FIRST_KEEP} SELECT pos FROM ex WHERE pos NOT IN (SELECT pos FROM gone) AND pos NOT IN (SELECT pos FROM fps WHERE fp <> 0 AND pos NOT IN (SELECT pos FROM f1))"
O["lsh_dedup"] = f"WITH RECURSIVE {LSH}, {FIRST_KEEP} SELECT pos FROM ex WHERE pos NOT IN (SELECT pos FROM gone)"
O["pairwise_dedup"] = f"WITH RECURSIVE {JAC}, {FIRST_KEEP} SELECT pos FROM ex WHERE pos NOT IN (SELECT pos FROM gone)"
O["strip_chunks"] = f"WITH {CHUNKS} SELECT pos, md5(CASE WHEN kind IN ('code', 'selection') AND strlen({tidy('content')}) < strlen(content) THEN {tidy('content')} ELSE content END) AS digest FROM chunks"


def collapse(src: str) -> str:
    return f"""li AS (SELECT pos, kind, unnest(range(len(ls))) AS line, unnest(ls) AS raw FROM (SELECT pos, kind, {lines('content')} AS ls FROM {src})),
nl AS (SELECT *, {norm('raw')} AS norm FROM li), fr AS (SELECT md5(norm) AS key, count(*) AS times, min({{'pos': pos, 'line': line}}) FILTER (WHERE kind IN ('code', 'selection', 'doc')) AS first FROM nl WHERE strlen(norm) >= 24 GROUP BY ALL HAVING count(*) >= 4),
dr AS (SELECT pos, line FROM nl JOIN fr ON md5(norm) = key AND strlen(norm) >= 24 WHERE kind IN ('code', 'selection', 'doc') AND (first.pos <> pos OR first.line <> line)),
co AS (SELECT {src}.pos, CASE WHEN {src}.pos IN (SELECT pos FROM dr) THEN coalesce((SELECT string_agg(raw, chr(10) ORDER BY line) FROM nl WHERE nl.pos = {src}.pos AND NOT EXISTS (SELECT 1 FROM dr WHERE dr.pos = nl.pos AND dr.line = nl.line)), '') ELSE content END AS content FROM {src})"""


O["boilerplate_collapse"] = f"WITH {CHUNKS}, {collapse('chunks')} SELECT pos, md5(content) AS digest FROM co"
O["frequent_lines"] = f"WITH {CHUNKS}, {collapse('chunks')} SELECT key, times, first.pos AS first_pos, first.line AS first_line FROM fr"
O["compress_stats"] = f"""WITH {CHUNKS}, st AS (SELECT pos, kind, CASE WHEN kind IN ('code', 'selection') AND strlen({tidy('content')}) < strlen(content) THEN {tidy('content')} ELSE content END AS content FROM chunks), {collapse('st')}
SELECT (SELECT sum({estimate('content')})::BIGINT FROM chunks) AS tokens_before, (SELECT sum({estimate('content')})::BIGINT FROM co) AS tokens_after, (SELECT sum(strlen(content))::BIGINT FROM chunks) AS bytes_before, (SELECT sum(strlen(content))::BIGINT FROM co) AS bytes_after, (SELECT count(*) FROM chunks) AS chunks_touched"""
O["line_sketch"] = f"WITH {CHUNKS} SELECT count(*) AS total FROM (SELECT unnest({lines('content')}) AS l FROM chunks) WHERE {norm('l')} <> ''"

CORPUS = f"""{CHUNKS}, tk AS (SELECT pos, {tokens('content')} AS t FROM chunks), dl AS (SELECT pos, len(t) AS dl FROM tk), ct AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT pos, t, count(*) AS tf FROM (SELECT pos, unnest(t) AS t FROM tk) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT t, count(*) AS times FROM (SELECT unnest({tokens(f"'{QUERY}'")}) AS t) GROUP BY t),
bs AS (SELECT pos, sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(avgdl, 1)))) AS s FROM tf JOIN q USING (t) JOIN df USING (t) JOIN dl USING (pos), ct GROUP BY pos),
bm AS (SELECT pos, round(coalesce(s, 0.0::DOUBLE), 12) AS score FROM chunks LEFT JOIN bs USING (pos)),
ds AS (SELECT pos, sum(tf / dl::DOUBLE * (ln((n + 1) / (df + 1.0::DOUBLE)) + 1.0::DOUBLE)) AS s FROM tf JOIN df USING (t) JOIN dl USING (pos), ct GROUP BY pos),
de AS (SELECT pos, round(coalesce(s, 0.0::DOUBLE), 12) AS score FROM chunks LEFT JOIN ds USING (pos))"""
O["bm25"] = f"WITH {CORPUS} SELECT pos, round(score, 6) AS score FROM bm"
O["density"] = f"WITH {CORPUS} SELECT pos, round(score, 6) AS score FROM de"
RM3 = f"""{CORPUS}, top AS (SELECT pos, score FROM bm WHERE score > 0 ORDER BY score DESC, pos LIMIT 5),
ft AS (SELECT t, round(sum(score / (SELECT sum(score) FROM top) * tf / dl), 12) AS weight FROM top JOIN tf USING (pos) JOIN dl USING (pos) WHERE t NOT IN (SELECT t FROM q) GROUP BY t ORDER BY weight DESC, t LIMIT 8)"""
O["rm3_terms"] = f"WITH {RM3} SELECT t, round(weight, 6) AS weight FROM ft"
O["rm3_query"] = f"WITH {RM3} SELECT t, times * CASE WHEN EXISTS (SELECT 1 FROM top) THEN 10 ELSE 1 END AS times FROM q UNION ALL SELECT t, 4 FROM ft"
O["rank_priors"] = f"WITH {CHUNKS} SELECT pos, row_number() OVER (ORDER BY CASE WHEN pos % 3 = 0 THEN pos % 10 / 10.0::DOUBLE ELSE 0.0::DOUBLE END DESC, pos) AS rank FROM chunks"
RRF = f"{CORPUS}, rb AS (SELECT pos, row_number() OVER (ORDER BY score DESC, pos) AS r FROM bm), rd AS (SELECT pos, row_number() OVER (ORDER BY score DESC, pos) AS r FROM de)"
O["rrf_rank"] = f"WITH {RRF} SELECT pos, round(1.5::DOUBLE / (60 + rb.r) + 0.7::DOUBLE / (60 + rd.r), 9) AS score FROM rb JOIN rd USING (pos)"
BUMP = "(priority + CASE kind WHEN 'selection' THEN 5.0::DOUBLE WHEN 'diagnostic' THEN 2.0::DOUBLE WHEN 'doc' THEN -0.5::DOUBLE WHEN 'comment' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END) / 60.0::DOUBLE"
O["rank_final"] = f"WITH {RRF}, fu AS (SELECT pos, round(CASE WHEN (SELECT max(score) FROM bm) > 0 THEN 1.5::DOUBLE / (60 + rb.r) ELSE 0 END + 0.7::DOUBLE / (60 + rd.r) + {BUMP}, 12) AS score FROM chunks JOIN rb USING (pos) JOIN rd USING (pos)), rk AS (SELECT pos, row_number() OVER (ORDER BY score DESC, pos) AS rank, round(score, 9) AS score FROM fu) SELECT * FROM rk"
O["rank_feedback"] = f"""WITH {RM3}, q2 AS (SELECT t, times * CASE WHEN EXISTS (SELECT 1 FROM top) THEN 10 ELSE 1 END AS times FROM q UNION ALL SELECT t, 4 FROM ft),
bs2 AS (SELECT pos, sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(avgdl, 1)))) AS s FROM tf JOIN q2 USING (t) JOIN df USING (t) JOIN dl USING (pos), ct GROUP BY pos),
bm2 AS (SELECT pos, round(coalesce(s, 0.0::DOUBLE), 12) AS score FROM chunks LEFT JOIN bs2 USING (pos)), rb AS (SELECT pos, row_number() OVER (ORDER BY score DESC, pos) AS r FROM bm2), rd AS (SELECT pos, row_number() OVER (ORDER BY score DESC, pos) AS r FROM de),
rp AS (SELECT pos, row_number() OVER (ORDER BY CASE WHEN pos % 3 = 0 THEN pos % 10 / 10.0::DOUBLE ELSE 0.0::DOUBLE END DESC, pos) AS r FROM chunks),
fu AS (SELECT pos, round(CASE WHEN (SELECT max(score) FROM bm2) > 0 THEN 1.5::DOUBLE / (60 + rb.r) ELSE 0 END + 0.7::DOUBLE / (60 + rd.r) + 1.0::DOUBLE / (60 + rp.r) + {BUMP}, 12) AS score FROM chunks JOIN rb USING (pos) JOIN rd USING (pos) JOIN rp USING (pos))
SELECT pos, row_number() OVER (ORDER BY score DESC, pos) AS rank, round(score, 9) AS score FROM fu"""
O["rank_no_query"] = f"WITH {RRF}, fu AS (SELECT pos, round(1.5::DOUBLE / (60 + rd.r) + {BUMP}, 12) AS score FROM chunks JOIN rd USING (pos)) SELECT pos, row_number() OVER (ORDER BY score DESC, pos) AS rank FROM fu"
O["budget_greedy"] = f"""WITH RECURSIVE {CHUNKS}, c AS (SELECT pos, {estimate('content')} AS cost, row_number() OVER (ORDER BY pos) AS k FROM chunks),
g AS (SELECT 0::BIGINT AS k, 0::BIGINT AS used, -1::BIGINT AS pos, false AS kept UNION ALL
  SELECT c.k, used + CASE WHEN used + cost <= 4200 THEN cost ELSE 0 END, c.pos, used + cost <= 4200 FROM g JOIN c ON c.k = g.k + 1 WHERE used <= 4000)
SELECT pos FROM g WHERE kept"""
O["cache_order"] = f"WITH {CHUNKS} SELECT pos, row_number() OVER (ORDER BY {hash60('id')}, id, pos) AS place FROM chunks WHERE length(content) > 0"
O["bundle"] = f"WITH {CHUNKS}, b AS (SELECT pos // 50 AS request_id, string_agg(CASE WHEN coalesce(path, '') <> '' THEN '// --- ' || path || ' (' || kind || ') ---' || chr(10) ELSE '// --- ' || id || ' ---' || chr(10) END || content, chr(10) || chr(10) ORDER BY pos) AS b FROM chunks GROUP BY pos // 50) SELECT request_id, md5(b) AS digest, length(b) AS chars FROM b"

P, C, N, R = views.PART, views.CUSTOMER, views.NATION, views.REGION
GRAPH = f"""nodes AS (SELECT s_suppkey AS id, 's' AS w, s_suppkey AS k FROM supplier UNION ALL SELECT p_partkey + {P}, 'p', p_partkey FROM part UNION ALL SELECT c_custkey + {C}, 'c', c_custkey FROM customer UNION ALL SELECT n_nationkey + {N}, 'n', n_nationkey FROM nation UNION ALL SELECT r_regionkey + {R}, 'r', r_regionkey FROM region),
edges AS (SELECT DISTINCT l_suppkey AS src, l_partkey + {P} AS dst, 'calls' AS kind, 0.7::DOUBLE AS confidence FROM lineitem UNION ALL SELECT c_nationkey + {N}, c_custkey + {C}, 'contains', 1.0::DOUBLE FROM customer UNION ALL SELECT n_nationkey + {N}, n_regionkey + {R}, 'imports', 1.0::DOUBLE FROM nation)"""
DEPS = "kind IN ('calls', 'imports', 'inherits')"
BFS = f"""bfs AS (SELECT id, 0::BIGINT AS depth FROM nodes WHERE w || '/' || k % 10 = 'p/3' UNION SELECT src, depth + 1 FROM bfs JOIN edges ON dst = id AND {DEPS} WHERE depth < 2)"""
O["impact_bfs"] = f"WITH RECURSIVE {GRAPH}, {BFS} SELECT id, min(depth) AS depth FROM bfs GROUP BY id"
O["impact_paths"] = f"WITH RECURSIVE {GRAPH}, {BFS.replace(chr(61) + ' ' + chr(39) + 'p/3' + chr(39), 'IN (' + chr(39) + 'p/3' + chr(39) + ', ' + chr(39) + 'r/1' + chr(39) + ')')} SELECT DISTINCT w || '/' || k % 10 AS path FROM nodes JOIN bfs USING (id)"
FORWARD = f"fw AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 10 = 3 UNION SELECT dst FROM fw JOIN edges ON src = id AND {DEPS})"
O["reachable"] = f"WITH RECURSIVE {GRAPH}, {FORWARD} SELECT id FROM fw"
O["reverse_reachable"] = f"WITH RECURSIVE {GRAPH}, bw AS (SELECT r_regionkey + {R} AS id FROM region WHERE r_regionkey = 2 UNION SELECT src FROM bw JOIN edges ON dst = id AND {DEPS}) SELECT id FROM bw"
O["prune_unreachable"] = f"WITH RECURSIVE {GRAPH}, {FORWARD} SELECT id FROM nodes WHERE w || '/' || k % 10 = 'p/4' AND id IN (SELECT id FROM fw)"
O["skeleton_for"] = f"WITH {GRAPH} SELECT coalesce(string_agg('def n' || k || '();' || chr(10), '' ORDER BY k % 100, id), '') AS skeleton FROM nodes WHERE w = 'n' AND k % 10 = 3"


def power(teleport: str, keep: float) -> str:
    """Fixed rounds of the walk, from tp (id, v)."""
    steps = [f"{GRAPH}, deg AS MATERIALIZED (SELECT src AS id, count(*) AS o FROM edges GROUP BY src), tp AS MATERIALIZED ({teleport}), r0 AS MATERIALIZED (SELECT id, v AS score FROM tp)"]
    for i in range(ROUNDS):
        steps.append(f"""w{i} AS (SELECT dst AS id, sum(score / o) AS w FROM edges JOIN r{i} ON r{i}.id = src JOIN deg ON deg.id = src GROUP BY dst),
l{i} AS (SELECT coalesce(sum(score), 0) AS l FROM r{i} WHERE id NOT IN (SELECT id FROM deg)),
r{i + 1} AS MATERIALIZED (SELECT tp.id, {keep}::DOUBLE * (coalesce(w, 0) + l * v) + (1 - {keep}::DOUBLE) * v AS score FROM tp LEFT JOIN w{i} ON w{i}.id = tp.id, l{i})""")
    return "WITH " + ", ".join(steps) + f" SELECT id, round(score, 9) AS score FROM r{ROUNDS}"


O["pagerank"] = power("SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS v FROM nodes", 0.85)
SEED = "id < 1000000 AND id % 10 = 3"
O["personalized_pagerank"] = power(f"SELECT id, CASE WHEN {SEED} THEN 1.0::DOUBLE / (SELECT count(*) FROM nodes WHERE {SEED}) ELSE 0 END AS v FROM nodes", 0.85)
O["random_walk_restart"] = power(f"SELECT id, CASE WHEN {SEED} THEN 1.0::DOUBLE / (SELECT count(*) + count(*) FILTER (WHERE id % 20 = 3) FROM nodes WHERE {SEED}) ELSE 0 END AS v FROM nodes", 0.5)
O["weighted_walk"] = power(f"SELECT id, CASE WHEN {SEED} THEN (id % 7 + 1)::DOUBLE / (SELECT sum(id % 7 + 1) FROM nodes WHERE {SEED}) ELSE 0 END AS v FROM nodes", 0.5)
O["modularity"] = f"""WITH {GRAPH}, sy AS (SELECT src AS a, dst AS b, confidence AS w FROM edges WHERE src <> dst UNION ALL SELECT dst, src, confidence FROM edges WHERE src <> dst), li AS (SELECT a, b, sum(w) AS w FROM sy GROUP BY ALL),
d AS (SELECT a AS id, sum(w) AS k FROM li GROUP BY a), m AS (SELECT sum(k) AS two FROM d)
SELECT round((SELECT sum(w - x.k * y.k / two) / max(two) FROM li JOIN d x ON x.id = a JOIN d y ON y.id = b, m WHERE a % 5 = b % 5), 9) AS adjacent,
  round((SELECT sum(w) FROM li WHERE a % 5 = b % 5) / (SELECT two FROM m) - (SELECT sum(s * s) FROM (SELECT sum(k) AS s FROM d GROUP BY id % 5)) / pow((SELECT two FROM m), 2.0::DOUBLE), 9) AS textbook"""
CODE = """f AS (SELECT p_size, p_partkey AS p, row_number() OVER (PARTITION BY p_size ORDER BY encode('def f' || p_partkey || '(x)')) - 1 AS i FROM part), m AS (SELECT DISTINCT p_size, 'pkg/m' || p_size || '.py' AS path FROM f)"""
O["build_nodes"] = f"""WITH {CODE}
SELECT 'file' AS kind, 'm' || p_size || '.py' AS name, path || '::<file>' AS qualified, path, 1 AS start_line, NULL AS signature FROM m
UNION ALL SELECT 'import', 'import os', path || '::import::import os', path, 1, 'import os' FROM m
UNION ALL SELECT 'import', 'from pkg import m' || p_size % 7, path || '::import::from pkg import m' || p_size % 7, path, 2, 'from pkg import m' || p_size % 7 FROM m
UNION ALL SELECT 'class', 'Base' || p_size, path || '::Base' || p_size, path, 5, 'class Base' || p_size || ':' FROM m
UNION ALL SELECT 'method', 'run', path || '::Base' || p_size || '::run', path, 6, 'def run(self):' || chr(10) || '        # note' FROM m
UNION ALL SELECT 'function', 'f' || p, path || '::f' || p, path, (11 + 5 * i)::INT, 'def f' || p || '(x):' FROM f JOIN m USING (p_size)"""
O["build_edges"] = f"""WITH {CODE}, own AS (SELECT path || '::f' || p AS q, p FROM f JOIN m USING (p_size))
SELECT path || '::<file>' AS a, path || '::import::import os' AS b, 'imports' AS kind, 1.0::DOUBLE AS confidence FROM m
UNION ALL SELECT path || '::<file>', path || '::import::from pkg import m' || p_size % 7, 'imports', 1.0::DOUBLE FROM m
UNION ALL SELECT path || '::<file>', path || '::Base' || p_size, 'contains', 1.0::DOUBLE FROM m
UNION ALL SELECT path || '::Base' || p_size, path || '::Base' || p_size || '::run', 'contains', 1.0::DOUBLE FROM m
UNION ALL SELECT path || '::<file>', path || '::f' || p, 'contains', 1.0::DOUBLE FROM f JOIN m USING (p_size)
UNION ALL SELECT a.q, b.q, 'calls', 0.7::DOUBLE FROM own a JOIN own b ON b.p = a.p + 1
UNION ALL SELECT path || '::Base' || p_size || '::run', b.q, 'calls', 0.7::DOUBLE FROM m JOIN own b ON b.p = p_size * 10 % 97"""
O["build_symbols"] = f"WITH {CODE} SELECT 'file' AS kind, count(*) AS n, 0 AS calls FROM m UNION ALL SELECT 'import', 2 * count(*), 0 FROM m UNION ALL SELECT 'class', count(*), 0 FROM m UNION ALL SELECT 'method', count(*), count(*) FROM m UNION ALL SELECT 'function', count(*), 2 * count(*) FROM f"
O["strip_ast"] = f"""WITH {CODE} SELECT path, 0 AS hashes, 0 AS prints, (length('import os') + 1 + length('from pkg import m' || p_size % 7) + 3 + length('class Base' || p_size || ':') + 1 + length('    def run(self):') + 1 + 8 + 1 + length('        return f' || p_size * 10 % 97 || '(self)') + 3
  + (SELECT sum(length('def f' || p || '(x):') + 1 + 4 + length('    return f' || (p + 1) || '(x)  ') + 1) + 2 * (count(*) - 1) FROM f WHERE f.p_size = m.p_size))::BIGINT AS chars FROM m"""
O["skeleton"] = f"""WITH {CODE} SELECT path, md5('import os' || chr(10) || 'from pkg import m' || p_size % 7 || chr(10) || 'class Base' || p_size || ': {{' || chr(10) || '  def run(self):' || chr(10) || '        # note {{ /* … */ }}' || chr(10) || '}}' || chr(10)
  || (SELECT string_agg('def f' || p || '(x): {{ /* … */ }}' || chr(10), '' ORDER BY i) FROM f WHERE f.p_size = m.p_size)) AS digest FROM m"""
O["import_specs"] = f"WITH {CODE} SELECT path, 'os' AS spec FROM m UNION ALL SELECT path, 'pkg' FROM m"
O["manifest_diff"] = """SELECT 'p' || p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN 'new' WHEN p_partkey % 7 = 0 THEN 'deleted' WHEN p_partkey % 3 = 0 THEN 'changed' ELSE 'same' END AS status FROM part WHERE NOT (p_partkey % 5 = 0 AND p_partkey % 7 = 0)"""
O["upsert_nodes"] = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 1 AND (s_suppkey + 500) % 8 <> 5 THEN 'new' ELSE 's' || s_suppkey END AS name, 's::' || s_suppkey AS qualified FROM supplier
UNION ALL SELECT s_suppkey + 500, 'new', 's::' || s_suppkey || 'x' FROM supplier WHERE s_suppkey % 4 = 1 AND (s_suppkey + 500) % 8 = 5"""
O["upsert_edges"] = f"""WITH {GRAPH} SELECT src, dst, kind, CASE WHEN src % 4 = 1 AND dst % 2 = 1 THEN 0.5::DOUBLE ELSE confidence END AS confidence FROM edges UNION ALL SELECT src, dst + 10000000000, kind, 0.5::DOUBLE FROM edges WHERE src % 4 = 1 AND dst % 2 = 0"""
O["delete_file"] = f"WITH {GRAPH}, gone AS (SELECT id FROM nodes WHERE w || '/' || k % 10 IN ('p/3', 's/1')) SELECT id, NULL::BIGINT AS dst FROM nodes WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT src, dst FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)"
O["neighbours"] = f"WITH {GRAPH} SELECT src, dst, kind FROM edges WHERE {DEPS} AND src IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 3)"
USAGE = "u AS (SELECT event_id AS ts, trunc(abs(value) * 100)::BIGINT AS i, trunc(abs(value) * 40)::BIGINT AS o, (user_id % 50)::DOUBLE AS e, CASE WHEN user_id % 9 = 0 THEN '(no query)' ELSE event_type END AS q, CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'p' || user_id % 3 END AS project FROM events)"
O["usage_totals"] = f"WITH {USAGE} SELECT count(*) AS runs, sum(i)::BIGINT AS in_tokens, sum(o)::BIGINT AS out_tokens, sum(i - o)::BIGINT AS saved_tokens, sum(e) AS elapsed_ms, round(avg(e), 6) AS avg_ms, round(sum(i - o)::DOUBLE / sum(i)::DOUBLE * 100, 6) AS pct FROM u WHERE project = 'p1'"
O["usage_by_query"] = f"""WITH {USAGE}, g AS (SELECT q AS query, count(*) AS runs, sum(i - o)::BIGINT AS saved_tokens, sum(i)::BIGINT AS in_tokens, sum(e) AS elapsed_ms FROM u GROUP BY q ORDER BY saved_tokens DESC, query LIMIT 5), h AS (SELECT *, round(saved_tokens::DOUBLE / max(saved_tokens) OVER () * 20)::INT AS b FROM g)
SELECT query, runs, saved_tokens, in_tokens, elapsed_ms, round(saved_tokens::DOUBLE / in_tokens * 100, 6) AS pct, repeat('█', b) || repeat('░', 20 - b) AS bar FROM h"""
O["session_summary"] = f"WITH {USAGE}, r AS (SELECT i, o * CASE WHEN ts % 5 = 0 THEN 4 ELSE 1 END AS o, e FROM u), s AS (SELECT *, greatest(0, i - o) AS v FROM r) SELECT count(*) AS runs, sum(i)::BIGINT AS original_tokens, sum(o)::BIGINT AS final_tokens, sum(v)::BIGINT AS saved_tokens, round(avg(e), 6) AS avg_ms, round(sum(v)::DOUBLE / sum(i)::DOUBLE * 100, 6) AS pct FROM s"
O["event_filter"] = r"SELECT page_id, NOT regexp_matches(replace(url, '/en/', '/target/'), '(?:^|/)(?:\.loomspark|\.git|node_modules|target)(?:/|$)') AND NOT regexp_matches(replace(url, '/en/', '/target/'), '\.swp$') AND NOT regexp_matches(replace(url, '/en/', '/target/'), '~$') AS watched FROM pages"
O["debounce_sessions"] = """WITH e AS (SELECT user_id, ts, event_type AS path, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM e)
SELECT user_id, epoch_us(min(ts)) AS start, string_agg(DISTINCT path, ',' ORDER BY path) FILTER (WHERE event_id % 3 <> 0) AS paths FROM s GROUP BY user_id, n HAVING count(*) FILTER (WHERE event_id % 3 <> 0) > 0"""

# sources and sinks, read back
O["pagerank_joins"], O["weighted_walk_joins"] = O["pagerank"], O["weighted_walk"]
O["request_files"] = f"WITH {CHUNKS} SELECT id, row_number() OVER (PARTITION BY pos // 50 ORDER BY pos) - 1 AS pos, 'q' || pos // 50 AS query, path, 'markdown' AS language, kind, priority, pos % 2 = 0 AS skeleton_hint, md5(content) AS digest FROM chunks"
O["result_lines"] = f"WITH {CHUNKS} SELECT id, pos, path, kind, priority, (pos % 7)::INT AS community, md5(content) AS digest FROM chunks"
O["selection_requests"] = "SELECT 'selection:src/r1.ts' AS id, 'src/r1.ts' AS path, 'typescript' AS language, unnest([r_name, 'let x']) AS content, 'selection' AS kind, 10 AS priority FROM region WHERE r_regionkey = 1"
O["editor_languages"] = "SELECT doc_id, ['typescript', 'javascript', 'json', 'rust', 'python', 'markdown', 'unknown', 'json'][doc_id % 8 + 1] AS language FROM documents"
O["path_list"] = "SELECT n_name AS path FROM nation"
O["tree_scan"] = "SELECT s_suppkey AS key, 'unknown' AS language, md5(s_name || chr(10)) AS digest FROM supplier WHERE NOT prefix(s_suppkey::VARCHAR, '1') OR s_suppkey = 11"
O["resolve_imports"] = """WITH p AS (SELECT p_partkey AS k FROM part), i AS (SELECT k, k + d AS t, CASE d WHEN 1 THEN './p' ELSE '../a/./p' END || (k + d) AS spec FROM p, (VALUES (1), (2)) v(d))
SELECT 'a/p' || i.k || '.ts' AS path, spec, 'a/p' || t || CASE WHEN t % 3 = 0 THEN '.tsx' ELSE '.ts' END AS target FROM i JOIN p ON p.k = i.t
UNION ALL SELECT 'a/p' || k || '.ts', '../b/x' || k, 'b/x' || k || '/index.ts' FROM p WHERE k % 4 = 0"""
O["usage_log"] = "SELECT event_id + 1 AS ts, trunc(abs(value) * 100)::BIGINT AS in_tokens, trunc(abs(value) * 40)::BIGINT AS out_tokens, (user_id % 50)::DOUBLE AS elapsed_ms, left(repeat(CASE WHEN user_id % 9 = 0 THEN '  ' ELSE event_type END, 40), 200) AS query, CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'p' || user_id % 3 END AS project FROM events"
O["skeleton_apply"] = f"""WITH sk AS ({O["skeleton"]}), {CODE}, t AS (SELECT path, p_size, 'import os' || chr(10) || 'from pkg import m' || p_size % 7 || repeat(chr(10), 3) || 'class Base' || p_size || ':' || chr(10) || '    def run(self):' || chr(10) || '        # note' || chr(10)
  || '        return f' || p_size * 10 % 97 || '(self)' || repeat(chr(10), 3) || (SELECT string_agg('def f' || p || '(x):' || chr(10) || '    print("# x")' || chr(10) || '    return f' || (p + 1) || '(x)  # call' || chr(10), chr(10) || chr(10) ORDER BY i) FROM f WHERE f.p_size = m.p_size) AS content FROM m)
SELECT path, CASE WHEN p_size % 2 = 0 THEN sk.digest ELSE md5(content) END AS digest FROM t JOIN sk USING (path)"""
O["manifest_upsert"] = "SELECT 'p' || p_partkey AS path, md5(CASE WHEN p_partkey % 7 <> 0 THEN 'b' ELSE 'a' END || p_partkey) AS sha256, 'python' AS language, CASE WHEN p_partkey % 7 <> 0 THEN 2 ELSE 1 END::BIGINT AS last_indexed FROM part WHERE p_partkey % 5 <> 0 OR p_partkey % 7 <> 0"
O["store_snapshot"] = f"""WITH {GRAPH} SELECT CASE w WHEN 's' THEN 'function' WHEN 'p' THEN 'function' WHEN 'c' THEN 'method' WHEN 'n' THEN 'class' ELSE 'import' END AS kind, count(*) AS n, sum(id)::BIGINT AS ids, 'node' AS part FROM nodes GROUP BY 1
UNION ALL SELECT kind, count(*), sum(src + dst)::BIGINT, 'edge' FROM edges GROUP BY kind UNION ALL SELECT 'file', count(DISTINCT w || '/' || k % 10), 0, 'file' FROM nodes"""
O["point_lookups"] = f"""WITH {GRAPH} SELECT 'name' AS how, id, w || k AS name FROM nodes WHERE w = 'p' AND k = 7 UNION ALL SELECT 'qualified', id, w || k FROM nodes WHERE w = 'n' AND k = 3
UNION ALL SELECT 'file', id, w || k FROM nodes WHERE w = 'r' AND k % 10 = 1 UNION ALL SELECT 'id', id, w || k FROM nodes WHERE id = 5"""
O["watch_stream"] = """WITH e AS (SELECT ts, event_type AS path, event_id, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (ORDER BY ts) AS n FROM e)
SELECT epoch_us(min(ts)) AS start, string_agg(DISTINCT path, ',' ORDER BY path) FILTER (WHERE event_id % 3 <> 0) AS paths FROM s GROUP BY n HAVING count(*) FILTER (WHERE event_id % 3 <> 0) > 0"""

"""The same queries as plain SQL, written independently of the jobs, for comparison."""

ORACLES: dict[str, str] = {}

# ---- shared tables -----------------------------------------------------------------------

_LOG = """
ev AS (
  SELECT event_id AS id, ts AS created_at, user_id, event_type AS et, value,
         CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events),
req AS (
  SELECT *, CASE et WHEN 'click' THEN 'simple' WHEN 'view' THEN 'medium' WHEN 'signup' THEN 'complex' WHEN 'purchase' THEN 'cache'
            ELSE CASE id % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' ELSE 'complex' END END AS tier,
         CAST(10 + k * 5 AS BIGINT) AS input_tokens, CAST(floor(value * 4) AS BIGINT) AS output_tokens,
         user_id || '|' || k AS q, et = 'purchase' AS cache_hit, et = 'error' AS fallback_used FROM ev),
rates(tier, ri, ro, cap, model, local_model) AS (VALUES
  ('simple', 0.00025::DOUBLE, 0.00125::DOUBLE, 1024::BIGINT, 'groq/openai/gpt-oss-20b', 'ollama/qwen2.5:0.5b'),
  ('medium', 0.00015::DOUBLE, 0.0006::DOUBLE, 2048::BIGINT, 'groq/llama-3.3-70b-versatile', 'ollama/llama3.2:3b'),
  ('complex', 0.005::DOUBLE, 0.015::DOUBLE, 4096::BIGINT, 'groq/openai/gpt-oss-120b', 'ollama/llama3.1:8b')),
priced AS (
  SELECT req.*, ri, ro, model, local_model,
         round(input_tokens / 1000 * 0.005::DOUBLE + output_tokens / 1000 * 0.015::DOUBLE, 8) AS baseline_cost_usd,
         CASE WHEN cache_hit THEN 0::DOUBLE ELSE round(input_tokens / 1000 * ri + output_tokens / 1000 * ro, 8) END AS theoretical_cost_usd
  FROM req LEFT JOIN rates USING (tier)),
logs AS (
  SELECT id, created_at, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS at_text,
         'chatcmpl-' || substr(sha256(id::VARCHAR), 1, 12) AS request_id,
         'sha256:' || substr(sha256(q), 1, 16) || '(len=' || length(q) || ')' AS query_id,
         tier, CASE WHEN cache_hit THEN 'cache' WHEN fallback_used THEN local_model ELSE model END AS model_used,
         cache_hit, fallback_used,
         CASE WHEN cache_hit THEN 'cache · cosine match' WHEN fallback_used THEN 'fallback · ' || tier ELSE 'classifier · ' || tier END AS routing_reason,
         CASE WHEN cache_hit THEN 1::DOUBLE ELSE round(k / 100, 4) END AS classifier_confidence,
         value AS latency_ms, input_tokens, output_tokens, 0::DOUBLE AS actual_cost_usd,
         theoretical_cost_usd, baseline_cost_usd, baseline_cost_usd - theoretical_cost_usd AS savings_usd,
         CASE WHEN cache_hit THEN 'cache' ELSE 'routing' END AS savings_source,
         CASE WHEN cache_hit THEN 'cache' WHEN fallback_used THEN 'ollama (fallback)' ELSE model END AS bucket
  FROM priced)"""

_KNOWN = """known(place, model) AS (VALUES (0, 'groq/openai/gpt-oss-20b'), (1, 'groq/llama-3.3-70b-versatile'),
  (2, 'groq/openai/gpt-oss-120b'), (3, 'ollama (fallback)'))"""

_ATTEMPTS = """
er AS (SELECT event_id AS id, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events WHERE event_type = 'error'),
tries AS (
  SELECT id, j, 1 + k % 4 AS n, (id + j) % 3 AS kind FROM er, (VALUES (1), (2), (3), (4)) AS t(j) WHERE j <= 1 + k % 4),
levels AS (
  SELECT *, id % 3 + coalesce(sum(CASE WHEN kind <> 0 THEN 1 ELSE 0 END) OVER
         (PARTITION BY id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lvl FROM tries),
att AS (
  SELECT 'chatcmpl-' || substr(sha256(id::VARCHAR), 1, 12) AS request_id, j AS attempt_no,
         CASE WHEN lvl >= 3 THEN 'local' ELSE 'primary' END AS provider,
         CASE CASE WHEN lvl >= 3 THEN id % 3 ELSE lvl END WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' ELSE 'complex' END AS tier,
         CASE WHEN j = n THEN NULL WHEN kind = 0 THEN 'Rate limit hit: 429' WHEN kind = 1 THEN 'Timeout calling model' ELSE 'Connection error' END AS error_text
  FROM levels),
timed AS (
  SELECT *, row_number() OVER (PARTITION BY request_id, provider, tier ORDER BY attempt_no) AS tier_try FROM att),
waits AS (
  SELECT *, CASE WHEN error_text LIKE '%429%' AND provider = 'primary' AND tier_try < 3 THEN power(2::DOUBLE, tier_try - 1) ELSE 0::DOUBLE END AS wait_seconds
  FROM timed),
rolled AS (
  SELECT request_id, arg_min(tier, attempt_no) AS first_tier, arg_max(tier, attempt_no) AS last_tier,
         arg_max(provider, attempt_no) AS last_provider, arg_max(error_text IS NULL, attempt_no) AS answered,
         count(*) AS calls, count(*) FILTER (WHERE error_text LIKE '%429%') AS retries, sum(wait_seconds) AS wait_seconds,
         arg_min(error_text, attempt_no) FILTER (WHERE error_text IS NOT NULL) AS first_error
  FROM waits GROUP BY request_id),
final AS (
  SELECT request_id, first_tier, CASE WHEN last_provider = 'local' THEN first_tier ELSE last_tier END AS tier_used,
         last_provider <> 'local' AND first_tier <> last_tier AS escalated,
         last_provider = 'local' AND answered AS fallback_used, answered, calls, retries, wait_seconds, first_error
  FROM rolled)"""

_VECTORS = """
total AS (SELECT count(*) AS n FROM embeddings),
ent AS (
  SELECT vec_id AS cache_id, embedding::DOUBLE[] AS v, CASE WHEN vec_id % 25 = 24 THEN '' ELSE 'answer ' || vec_id END AS response,
         CASE label % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' ELSE 'complex' END AS tier, vec_id * 60 AS stored_s
  FROM embeddings),
probe AS (
  SELECT a.vec_id AS query_id,
         list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE + z[2]::DOUBLE * ((a.vec_id % 10) / 10::DOUBLE)) AS v,
         CASE a.label % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' ELSE 'complex' END AS label,
         a.vec_id * 60 + (a.vec_id % 8) * 600 AS asked_s
  FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT n FROM total)),
pairs AS (
  SELECT query_id, label, asked_s, cache_id, response, tier, stored_s, list_cosine_similarity(p.v, e.v) AS s
  FROM probe p CROSS JOIN ent e)"""

_NEIGHBOURS = _VECTORS + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, cache_id) AS rk FROM pairs)"""


def _graded(k: str = "15") -> str:
    return _NEIGHBOURS + f""",
sums AS (SELECT query_id, label, tier, sum(s) AS score FROM ranked WHERE rk <= {k} GROUP BY ALL),
winner AS (
  SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, tier) = 1),
scored AS (
  SELECT query_id, label, CASE WHEN score >= 0.5 THEN tier ELSE 'medium' END AS predicted,
         CASE WHEN score >= 0.5 THEN round(least(1, greatest(0, score / 5)), 4) ELSE 0.85 END AS confidence,
         round(score, 9) AS score FROM winner)"""


_STRAY = """,
strays AS (SELECT query_id, CASE WHEN query_id % 9 = 0 THEN 'unknown' ELSE label END AS label, predicted FROM scored)"""

_MATRIX = """,
tiers(t) AS (VALUES ('simple'), ('medium'), ('complex')),
cells AS (
  SELECT a.t AS label, p.t AS predicted, count(s.query_id) AS n
  FROM tiers a CROSS JOIN tiers p LEFT JOIN scored s ON s.label = a.t AND s.predicted = p.t GROUP BY a.t, p.t)"""

_METRICS = _MATRIX + """,
counts AS (
  SELECT t AS tier, sum(n) FILTER (WHERE label = t) AS support, sum(n) FILTER (WHERE predicted = t) AS guessed,
         sum(n) FILTER (WHERE label = t AND predicted = t) AS hits FROM tiers, cells GROUP BY t),
pr AS (
  SELECT tier, support, CASE WHEN guessed = 0 THEN 0 ELSE hits / guessed END AS p, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS r FROM counts),
metrics AS (
  SELECT tier, round(p::DOUBLE, 6) AS "precision", round(r::DOUBLE, 6) AS recall,
         round((CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END)::DOUBLE, 6) AS f1, support::BIGINT AS support FROM pr),
gate AS (
  SELECT round(count(*) FILTER (WHERE label = predicted) / count(*), 6)::DOUBLE AS accuracy,
         count(*) FILTER (WHERE label = predicted) AS correct, count(*) AS total,
         count(*) FILTER (WHERE label = predicted) / count(*) >= 0.8 AS passed FROM scored)"""

_ASKED = """
asked AS (
  SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS question,
         coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant'), '') AS answer,
         sum(length(text)) AS chars, count(text) AS parts
  FROM conversations GROUP BY conv_id)"""


def _sum(expression: str, where: str = "") -> str:
    part = f" FILTER (WHERE {where})" if where else ""
    return f"coalesce(sum(CAST({expression} AS DECIMAL(18,8))){part}, 0)::DOUBLE"


def _pct(part: str, whole: str, digits: int) -> str:
    return f"CASE WHEN ({whole}) = 0 THEN 0::DOUBLE ELSE round(({part})::DOUBLE / ({whole})::DOUBLE * 100, {digits}) END"


_KPI = f"""count(*) AS requests, round({_sum('savings_usd')}, 8) AS savings_usd, round({_sum('baseline_cost_usd')}, 8) AS baseline_usd,
  {_pct(_sum('savings_usd'), _sum('baseline_cost_usd'), 2)} AS savings_pct,
  {_pct('count(*) FILTER (WHERE cache_hit)', 'count(*)', 2)} AS cache_hit_rate,
  {_pct('count(*) FILTER (WHERE fallback_used)', 'count(*)', 2)} AS fallback_rate, 0::DOUBLE AS actual_spend"""

_COLUMNS = """at_text AS created_at, tier, model_used, query_id, cache_hit, fallback_used, routing_reason, latency_ms, input_tokens,
  output_tokens, theoretical_cost_usd, baseline_cost_usd, savings_usd, savings_source"""

_SPINE = _LOG + f""",
{_KNOWN},
served AS (SELECT bucket AS model, count(*) AS n FROM logs WHERE NOT cache_hit GROUP BY 1),
spine AS (
  SELECT row_number() OVER (ORDER BY coalesce(place, 4), model) - 1 AS position, model, coalesce(n, 0) AS count
  FROM known FULL JOIN served USING (model))"""


def _log(body: str) -> str:
    return f"WITH {_LOG}\n{body}"


def _spine(body: str) -> str:
    return f"WITH {_SPINE}\n{body}"


def _put(name: str, sql: str) -> None:
    ORACLES[name] = sql


# ---- sources and sinks -------------------------------------------------------------------

_put("log_append", _log("SELECT id, at_text AS created_at, request_id, tier, savings_usd, CAST(created_at::DATE AS VARCHAR) AS day FROM logs"))
_put("log_scan_recent", _log("""SELECT id, at_text AS created_at, tier, model_used, savings_usd FROM logs
WHERE created_at >= TIMESTAMP '2024-01-15' ORDER BY created_at DESC, id DESC"""))
_put("log_schema_upgrade", _log("SELECT id, tier, '' AS routing_reason, 0::DOUBLE AS classifier_confidence FROM logs"))
_put("rate_card", _log("""
, card AS (
  SELECT tier, 'primary' AS provider, model, ri, ro, cap FROM rates UNION ALL SELECT tier, 'local', local_model, ri, ro, cap FROM rates),
used AS (SELECT model_used, count(*) AS n, sum(input_tokens) AS i, sum(output_tokens) AS o FROM logs WHERE NOT cache_hit GROUP BY 1)
SELECT tier, provider, model, ri AS input_rate, ro AS output_rate, cap AS max_tokens, coalesce(n, 0) AS requests,
       coalesce(i, 0)::BIGINT AS input_tokens, coalesce(o, 0)::BIGINT AS output_tokens
FROM card LEFT JOIN used ON model = model_used"""))
_put("exemplar_table", f"""WITH {_VECTORS}
SELECT cache_id AS exemplar_id, tier, len(v) AS width, round(sqrt(list_inner_product(v, v)), 6) AS length FROM ent""")
_put("eval_load", f"""WITH {_ASKED}
SELECT 'sha256:' || substr(sha256(question), 1, 16) || '(len=' || length(question) || ')' AS query_id,
       ['simple', 'medium', 'complex', 'unknown'][conv_id % 4 + 1] AS label,
       CASE WHEN conv_id % 4 = 3 THEN 'bad label' END AS reject_reason FROM asked
UNION ALL SELECT NULL, NULL, 'malformed' FROM asked""")
_put("eval_result_sink", f"""WITH {_graded()}{_METRICS}
SELECT accuracy, correct, total, passed, 0.8::DOUBLE AS target_accuracy, 3::BIGINT AS classes, 9::BIGINT AS cells FROM gate""")
_STORE = _ASKED + """,
stored AS (
  SELECT conv_id, 'sha256:' || substr(sha256(question), 1, 16) || '(len=' || length(question) || ')' AS query_id,
         TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60) AS stored_at,
         TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + 3600) AS expires_at, question, answer,
         sha256(question || chr(10) || answer || chr(10) || (epoch_us(TIMESTAMP '2024-01-01') + conv_id * 60000000)) AS key
  FROM asked WHERE question <> '' AND answer <> '')"""
_put("cache_store", f"""WITH {_STORE}
SELECT conv_id, query_id, strftime(stored_at, '%Y-%m-%d %H:%M:%S.%f') AS stored_at, strftime(expires_at, '%Y-%m-%d %H:%M:%S.%f') AS expires_at,
  CASE conv_id % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' ELSE 'complex' END AS tier, key,
  sha256(question) AS query_sha256, sha256(answer) AS response_sha256, 256 AS width FROM stored""")
_put("cache_purge_expired", f"""WITH {_STORE}
SELECT conv_id, strftime(expires_at, '%Y-%m-%d %H:%M:%S.%f') AS expires_at, key FROM stored WHERE expires_at > TIMESTAMP '2024-01-01 01:30:00'""")
_put("live_event_feed", _log("""SELECT request_id, at_text AS created_at, query_id, tier, model_used, cache_hit, fallback_used,
  round(latency_ms, 2) AS latency_ms, input_tokens, output_tokens, theoretical_cost_usd, baseline_cost_usd, savings_source,
  routing_reason, classifier_confidence FROM logs"""))

# ---- projections, filters, predicates ----------------------------------------------------

_put("last_user_message", f"WITH {_ASKED} SELECT conv_id, question FROM asked")
for _name, _digits in (("query_fingerprint", 16), ("query_fingerprint_short", 8)):
    _put(_name, f"""WITH {_ASKED}
SELECT conv_id, 'sha256:' || substr(sha256(question), 1, {_digits}) || '(len=' || length(question) || ')' AS query_id FROM asked""")
_put("token_estimate", "SELECT conv_id, sum(greatest(1, length(text) // 4))::BIGINT AS estimated_tokens FROM conversations GROUP BY conv_id")
_put("token_estimate_joined", f"WITH {_ASKED} SELECT conv_id, ((chars + parts - 1) // 4)::BIGINT AS estimated_tokens FROM asked")
_put("usage_coalesce", f"""WITH {_ASKED}
SELECT conv_id,
  CASE WHEN conv_id % 3 = 0 THEN (chars + parts - 1) // 4 WHEN conv_id % 5 = 0 THEN 0 ELSE conv_id + 100 END::BIGINT AS input_tokens,
  CASE WHEN conv_id % 3 = 0 THEN length(answer) // 4 WHEN conv_id % 7 = 0 THEN 0 ELSE conv_id + 10 END::BIGINT AS output_tokens FROM asked""")
_put("cost_breakdown", _log("""SELECT id, tier, input_tokens, output_tokens, cache_hit, actual_cost_usd, theoretical_cost_usd,
  baseline_cost_usd, savings_usd, savings_source FROM logs"""))
_put("cache_hit_costing", _log("""SELECT id, 0::DOUBLE AS actual_cost_usd, 0::DOUBLE AS theoretical_cost_usd, baseline_cost_usd,
  baseline_cost_usd AS savings_usd, 'cache' AS savings_source FROM logs"""))
_put("invalid_tier_rows", _log("SELECT id, 'nonexistent' AS tier FROM logs WHERE NOT cache_hit AND id % 7 = 0"))
_put("effective_request_settings", _log("""SELECT id, logs.tier,
  CASE WHEN id % 4 <= 1 OR id % 20 = 0 THEN 0.7::DOUBLE ELSE (id % 20) / 10 END AS temperature,
  CASE WHEN id % 3 = 2 THEN 256 ELSE cap END::BIGINT AS max_tokens
FROM logs JOIN rates ON rates.tier = logs.tier WHERE NOT cache_hit"""))
_put("request_validation", """WITH c AS (
  SELECT conv_id, bool_or(conv_id % 13 = 0 AND role = 'system') AS odd_role FROM conversations GROUP BY conv_id),
p AS (
  SELECT conv_id, list_filter([CASE WHEN odd_role THEN 'role' END, CASE WHEN conv_id % 25 > 20 THEN 'temperature' END,
         CASE WHEN conv_id % 7 = 0 THEN 'max_tokens' END, CASE WHEN conv_id % 11 = 0 THEN 'stream' END], lambda x: x IS NOT NULL) AS l FROM c)
SELECT conv_id, coalesce(array_to_string(l, ','), '') AS problems, len(l) = 0 AS accepted FROM p""")
_put("model_bucket", _log("SELECT id, bucket AS model FROM logs"))
_put("model_short_name", _log("SELECT id, replace(replace(model_used, 'groq/', ''), 'openai/', '') AS short_name FROM logs"))
_put("routing_reason", _log("SELECT id, routing_reason AS reason FROM logs"))
_put("reason_category", _log("""SELECT CASE WHEN routing_reason LIKE '%cache%' THEN 'cache' WHEN routing_reason LIKE '%simple%' THEN 'simple'
  WHEN routing_reason LIKE '%medium%' THEN 'medium' WHEN routing_reason LIKE '%complex%' THEN 'complex' ELSE 'fallback' END AS category,
  count(*) AS requests FROM logs GROUP BY 1"""))
_put("request_path", _log("""SELECT id, CASE WHEN cache_hit THEN 'request → semantic cache' ELSE 'request → classifier → ' || model_used ||
  CASE WHEN fallback_used THEN ' (via Ollama fallback)' ELSE '' END END AS path FROM logs"""))
_put("range_filter", _log("""
, bounds(range_key, low) AS (VALUES ('today', TIMESTAMP '2024-01-30'), ('7d', TIMESTAMP '2024-01-23 12:00:00'),
  ('30d', TIMESTAMP '2023-12-31 12:00:00'), ('all', TIMESTAMP '1900-01-01'))
SELECT range_key, count(id) AS requests, min(id) AS first_id FROM bounds LEFT JOIN logs ON created_at >= low GROUP BY range_key"""))
_put("history_filter", _log("""SELECT id, tier, cache_hit, fallback_used FROM logs
WHERE created_at >= TIMESTAMP '2024-01-10' AND tier = 'medium' AND fallback_used"""))
_put("history_projection", _log(f"SELECT id, {_COLUMNS} FROM logs"))
_put("text_guard", f"""WITH {_ASKED},
varied AS (
  SELECT conv_id, CASE conv_id % 9 WHEN 0 THEN '   ' WHEN 1 THEN repeat(question, 20) ELSE question END AS question FROM asked),
clipped AS (SELECT conv_id, trim(question) = '' AS blank, substr(question, 1, 2000) AS c FROM varied)
SELECT conv_id, CASE WHEN blank THEN 'medium' END AS preset_tier, CASE WHEN blank THEN 0::DOUBLE END AS preset_confidence,
  CASE WHEN NOT blank THEN length(c) END AS encoder_chars,
  CASE WHEN NOT blank THEN 'sha256:' || substr(sha256(c), 1, 16) || '(len=' || length(c) || ')' END AS encoder_id FROM clipped""")
_put("error_category", f"""WITH {_ATTEMPTS}
SELECT request_id, attempt_no, CASE WHEN lower(error_text) LIKE '%rate limit%' THEN 'rate_limit' WHEN lower(error_text) LIKE '%timeout%' THEN 'timeout'
  WHEN lower(error_text) LIKE '%connect%' THEN 'connection' ELSE 'other' END AS category FROM att WHERE error_text IS NOT NULL""")
_put("report_format", _log("""
, aged AS (SELECT *, greatest(0, floor(epoch_us(TIMESTAMP '2024-01-30 23:59:00') / 1000000 - epoch_us(created_at) / 1000000 + 0.5)) AS s FROM logs),
units AS (SELECT *, floor(s / 60 + 0.5) AS m, floor(floor(s / 60 + 0.5) / 60 + 0.5) AS h FROM aged)
SELECT id, printf('$%.4f', savings_usd) AS savings,
  printf('%.1f%%', CASE WHEN baseline_cost_usd = 0 THEN 0 ELSE savings_usd / baseline_cost_usd * 100 END) AS savings_pct,
  format('{:,}', input_tokens + output_tokens) AS tokens, strftime(created_at, '%H:%M') AS clock,
  CASE WHEN s < 60 THEN s::BIGINT || 's ago' WHEN m < 60 THEN m::BIGINT || 'm ago' WHEN h < 24 THEN h::BIGINT || 'h ago'
       ELSE floor(h / 24 + 0.5)::BIGINT || 'd ago' END AS age
FROM units"""))

# ---- joins -------------------------------------------------------------------------------

_put("cost_rate_join", _log("SELECT id, tier, ri AS input_rate, ro AS output_rate FROM priced"))
_put("cosine_pairs", f"WITH {_VECTORS} SELECT query_id, cache_id, round(s, 6) AS score FROM pairs WHERE query_id = cache_id")
# vectors normalised once; the widths are the only key that both sides share
_UNIT = "list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))"
for _name, _alive in (("semantic_cache_lookup", ""), ("semantic_cache_ttl_join", "AND e.stored_s <= p.asked_s AND p.asked_s < e.stored_s + 3600")):
    _put(_name, f"""WITH {_VECTORS.split("pairs AS")[0].rstrip().rstrip(",")},
stored AS MATERIALIZED (SELECT cache_id, response, stored_s, len(v) AS width, {_UNIT} AS u FROM ent WHERE response <> ''),
asked AS MATERIALIZED (SELECT query_id, asked_s, len(v) AS width, {_UNIT} AS u FROM probe),
near AS (
  SELECT p.query_id, e.cache_id, e.response, list_inner_product(p.u, e.u) AS s
  FROM asked p JOIN stored e ON p.width = e.width {_alive}),
best AS (
  SELECT query_id, min({{'order': -round(s, 12), 'id': cache_id, 's': s, 'response': response}}) AS b FROM near WHERE s >= 0.92 GROUP BY query_id)
SELECT p.query_id, b IS NOT NULL AS hit, b.id AS cache_id, round(b.s, 6) AS score, b.response AS response FROM asked p LEFT JOIN best USING (query_id)""")
_put("route_classify", f"WITH {_graded()} SELECT query_id, predicted, confidence, score FROM scored")
_put("model_spine", _spine("SELECT position, model, count FROM spine"))
_put("node_metrics", _spine(f"""
, hits AS (SELECT {_pct('count(*) FILTER (WHERE cache_hit)', 'count(*)', 2)} AS rate FROM logs),
nodes(place, node, model) AS (VALUES (0, 'request', NULL), (1, 'cache', NULL), (2, 'classify', NULL), (3, 'groq-oss-20b', 'groq/openai/gpt-oss-20b'),
  (4, 'groq-llama-70b', 'groq/llama-3.3-70b-versatile'), (5, 'groq-oss-120b', 'groq/openai/gpt-oss-120b'), (6, 'ollama', 'ollama (fallback)'))
SELECT place::BIGINT AS place, node, round(CASE node WHEN 'request' THEN 100 WHEN 'cache' THEN rate WHEN 'classify' THEN 100 - rate
  ELSE (SELECT {_pct('count', '(SELECT sum(count) FROM spine)', 1)} FROM spine s WHERE s.model = nodes.model) END, 2)::DOUBLE AS share_pct
FROM nodes, hits"""))
_put("last_request_nodes", _log("""
, newest AS (SELECT * FROM logs ORDER BY created_at DESC, id DESC LIMIT 1),
nodes(place, node, model) AS (VALUES (0, 'request', NULL), (1, 'cache', NULL), (2, 'classify', NULL), (3, 'groq-oss-20b', 'groq/openai/gpt-oss-20b'),
  (4, 'groq-llama-70b', 'groq/llama-3.3-70b-versatile'), (5, 'groq-oss-120b', 'groq/openai/gpt-oss-120b'), (6, 'ollama', 'ollama (fallback)'))
SELECT place::BIGINT AS place, node, CASE node WHEN 'request' THEN TRUE WHEN 'cache' THEN cache_hit WHEN 'classify' THEN NOT cache_hit
  ELSE nodes.model = newest.bucket END AS active FROM nodes, newest"""))
_put("eval_leak_check", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND conv_id % 8 = 0")
_put("event_unseen", _log("SELECT id, request_id FROM logs WHERE created_at >= TIMESTAMP '2024-01-15'"))

# one recursion step per request, in time order: the state is the list of stored requests
_REPLAY = f"""WITH RECURSIVE {_VECTORS},
traffic AS (
  SELECT cache_id * 2 AS request_id, stored_s AS t, v, response <> '' AS answered FROM ent
  UNION ALL SELECT query_id * 2 + 1, asked_s, v, TRUE FROM probe),
lined AS (SELECT *, row_number() OVER (ORDER BY t, request_id) AS pos FROM traffic),
edges AS MATERIALIZED (
  SELECT b.pos, list(a.request_id) AS earlier FROM lined a JOIN lined b
    ON a.pos < b.pos AND b.t < a.t + 3600 AND list_cosine_similarity(a.v, b.v) >= 0.92 GROUP BY b.pos),
steps AS MATERIALIZED (SELECT pos, request_id, answered, coalesce(earlier, []::BIGINT[]) AS earlier FROM lined LEFT JOIN edges USING (pos)),
walk(pos, request_id, hit, stored, kept) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::BOOLEAN, NULL::BOOLEAN, []::BIGINT[]
  UNION ALL
  SELECT s.pos, s.request_id, list_has_any(kept, earlier), answered AND NOT list_has_any(kept, earlier),
         CASE WHEN answered AND NOT list_has_any(kept, earlier) THEN list_append(kept, s.request_id) ELSE kept END
  FROM walk w JOIN steps s ON s.pos = w.pos + 1)
SELECT request_id, hit, stored FROM walk WHERE pos > 0"""
_put("semantic_cache_replay", _REPLAY)

# ---- aggregations ------------------------------------------------------------------------

_put("kpi_totals", _log(f"SELECT {_KPI} FROM logs"))
_put("kpi_cube", _log(f"SELECT tier, bucket AS model, {_KPI} FROM logs GROUP BY CUBE (tier, bucket)"))
_put("empty_defaults", _log(f"SELECT {_KPI} FROM logs WHERE tier = 'absent'"))
_put("tier_distribution", _log("SELECT tier, count(*) AS count FROM logs GROUP BY tier"))
_put("model_distribution", _spine(f"SELECT position, model, count, {_pct('count', '(SELECT sum(count) FROM spine)', 1)} AS pct FROM spine"))


def _split(cache: str, routing: str) -> str:
    return f"""SELECT round({cache}, 8) AS cache_usd, round({routing}, 8) AS routing_usd,
  {_pct(cache, f'{cache} + {routing}', 1)} AS cache_pct, {_pct(routing, f'{cache} + {routing}', 1)} AS routing_pct"""


_CACHE, _ROUTING = _sum("savings_usd", "savings_source = 'cache'"), _sum("savings_usd", "savings_source = 'routing'")
_put("savings_split", _log(_split(_CACHE, _ROUTING) + " FROM logs"))
_put("savings_split_residual", _log(_split(_CACHE, f"({_sum('savings_usd')} - {_CACHE})") + " FROM logs"))
for _name, _points in (("latency_percentiles", (("p50", 0.5), ("p95", 0.95))), ("latency_bench_summary", (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))):
    _parts = ", ".join(f"round(quantile_cont(latency_ms, {q}), 1) AS {n}" for n, q in _points)
    _put(_name, _log(f"SELECT tier, count(*) AS count, {_parts} FROM logs GROUP BY tier"))
_BOX = """
, quart AS (SELECT tier, quantile_cont(latency_ms, 0.25) AS a, quantile_cont(latency_ms, 0.5) AS b, quantile_cont(latency_ms, 0.75) AS c FROM logs GROUP BY tier),
boxed AS (SELECT l.id, l.tier, latency_ms, a, b, c, latency_ms BETWEEN a - (c - a) * 1.5 AND c + (c - a) * 1.5 AS inside FROM logs l JOIN quart USING (tier))
"""
_put("latency_box", _log(_BOX + """SELECT tier, round(a, 4) AS q1, round(b, 4) AS median, round(c, 4) AS q3, min(latency_ms) FILTER (WHERE inside) AS whisker_low,
  max(latency_ms) FILTER (WHERE inside) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS outliers FROM boxed GROUP BY tier, a, b, c"""))
_put("latency_outliers", _log(_BOX + "SELECT id, tier, latency_ms FROM boxed WHERE NOT inside"))
_put("cache_hit_miss", _log("SELECT count(*) FILTER (WHERE cache_hit) AS hit, count(*) FILTER (WHERE NOT cache_hit) AS miss FROM logs"))
_put("history_count", _log("SELECT count(*) AS total FROM logs WHERE tier = 'simple' AND fallback_used"))
_SERIES = """
, series AS (
  SELECT id, created_at, at_text, row_number() OVER w AS position, count(*) OVER () AS n,
         round((sum(CAST(savings_usd AS DECIMAL(18,8))) OVER w)::DOUBLE, 8) AS cumulative_savings
  FROM logs WINDOW w AS (ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)),
sampled AS (SELECT * FROM series WHERE (position - 1) % greatest(1, ceil(n / 200)) = 0 OR position = n)
"""
_put("stats_snapshot", _spine(f"""{_SERIES}
, tiers AS (SELECT tier, count(*) AS n, round(quantile_cont(latency_ms, 0.5), 1) AS p50, round(quantile_cont(latency_ms, 0.95), 1) AS p95 FROM logs GROUP BY tier),
kpi AS (SELECT {_KPI} FROM logs), split AS ({_split(_CACHE, _ROUTING)} FROM logs)
SELECT kpi.*, (SELECT string_agg(tier || ':' || n, ';' ORDER BY n DESC, tier) FROM tiers) AS tier_distribution,
  (SELECT string_agg(model || '=' || count, ';' ORDER BY position) FROM spine) AS model_distribution,
  (SELECT string_agg(printf('%s:%.1f:%.1f:%d', tier, p50, p95, n), ';' ORDER BY tier) FROM tiers) AS latency_percentiles,
  (SELECT string_agg(printf('%d=%s=%.8f', position, at_text, cumulative_savings), ';' ORDER BY position) FROM sampled) AS cumulative_savings,
  (SELECT count(*) FROM logs WHERE cache_hit) AS hit, (SELECT count(*) FROM logs WHERE NOT cache_hit) AS miss, split.*
FROM kpi, split"""))
_put("confusion_matrix", f"WITH {_graded()}{_MATRIX} SELECT label, predicted, n FROM cells")
_put("confusion_matrix_wide", f"""WITH {_graded()}{_MATRIX}
SELECT label, sum(n) FILTER (WHERE predicted = 'simple')::BIGINT AS simple, sum(n) FILTER (WHERE predicted = 'medium')::BIGINT AS medium,
  sum(n) FILTER (WHERE predicted = 'complex')::BIGINT AS complex FROM cells GROUP BY label""")
_put("class_metrics", f"WITH {_graded()}{_METRICS} SELECT * FROM metrics")
_put("eval_accuracy_gate", f"WITH {_graded()}{_METRICS} SELECT *, 0.8::DOUBLE AS target_accuracy FROM gate")
_put("eval_report", f"WITH {_graded()}{_METRICS} SELECT * FROM gate, metrics")
_put("eval_misclassified", f"WITH {_graded()}{_STRAY} SELECT query_id, label, predicted FROM strays WHERE label <> 'unknown' AND label <> predicted")
_put("eval_invalid_labels", f"WITH {_graded()}{_STRAY} SELECT query_id, label, predicted FROM strays WHERE label = 'unknown'")
_put("cost_by_model", _log(f"""SELECT bucket AS model, count(*) AS requests, round({_sum('theoretical_cost_usd')}, 8) AS theoretical_cost_usd,
  round(count(*) / (SELECT count(*) FROM logs WHERE NOT cache_hit) * 100, 1) AS routing_pct FROM logs WHERE NOT cache_hit GROUP BY 1"""))
_put("savings_today", _log("""
, hourly AS (SELECT date_trunc('hour', created_at) AS h, count(*) AS requests, sum(CAST(savings_usd AS DECIMAL(18,8))) AS s
  FROM logs WHERE created_at >= TIMESTAMP '2024-01-30' GROUP BY 1)
SELECT strftime(h, '%Y-%m-%d %H:%M:%S.%f') AS hour, requests, round(s::DOUBLE, 8) AS savings_usd,
  round((sum(s) OVER (ORDER BY h))::DOUBLE, 8) AS running_savings_usd FROM hourly"""))
_put("savings_by_period", _log(f"""SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S.%f') AS period, count(*) AS requests,
  round({_sum('savings_usd')}, 8) AS savings_usd FROM logs GROUP BY 1"""))
_QUOTA = """
, minutes AS (
  SELECT model_used AS model, date_trunc('minute', created_at) AS m, count(*) AS requests, sum(input_tokens + output_tokens)::BIGINT AS tokens
  FROM logs WHERE NOT cache_hit GROUP BY 1, 2)"""
_put("quota_minutes", _log(_QUOTA + " SELECT model, strftime(m, '%Y-%m-%d %H:%M:%S.%f') AS minute, requests, tokens FROM minutes"))
_put("quota_utilisation", _log(_QUOTA + """,
quota(model, rpm, tpm, rpd) AS (VALUES ('groq/openai/gpt-oss-20b', 1000, 250000, 14400), ('groq/llama-3.3-70b-versatile', 1000, 300000, 14400),
  ('groq/openai/gpt-oss-120b', 1000, 250000, 14400)),
days AS (SELECT model, m::DATE AS d, sum(requests)::BIGINT AS requests, max(requests) AS peak_rpm, max(tokens) AS peak_tpm FROM minutes GROUP BY 1, 2)
SELECT model, d::VARCHAR AS day, requests, peak_rpm, peak_tpm, round(peak_rpm / rpm * 100, 4) AS rpm_pct, round(peak_tpm / tpm * 100, 4) AS tpm_pct,
  round(requests / rpd * 100, 4) AS rpd_pct, peak_rpm > rpm OR peak_tpm > tpm OR requests > rpd AS over_quota FROM days JOIN quota USING (model)"""))
_put("threshold_sweep", f"""WITH {_VECTORS},
best AS (
  SELECT * FROM pairs WHERE response <> '' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, cache_id) = 1),
limits(t) AS (VALUES (0.85::DOUBLE), (0.9::DOUBLE), (0.92::DOUBLE), (0.95::DOUBLE), (0.98::DOUBLE)),
swept AS (SELECT t, count(*) AS queries, count(*) FILTER (WHERE s >= t) AS hits, count(*) FILTER (WHERE s >= t AND tier <> label) AS wrong FROM best, limits GROUP BY t)
SELECT t AS threshold, queries, hits, wrong, {_pct('hits', 'queries', 4)} AS hit_rate, {_pct('wrong', 'hits', 4)} AS false_positive_rate FROM swept""")
_put("topk_sweep", f"""WITH {_NEIGHBOURS},
ks(k) AS (VALUES (5::BIGINT), (15::BIGINT), (48::BIGINT)),
sums AS (SELECT k, query_id, label, tier, sum(s) AS score FROM ranked, ks WHERE rk <= k GROUP BY ALL),
winner AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY k, query_id ORDER BY round(score, 9) DESC, tier) = 1)
SELECT k AS top_k, count(*) FILTER (WHERE label = CASE WHEN score >= 0.5 THEN tier ELSE 'medium' END) AS correct, count(*) AS total,
  round(count(*) FILTER (WHERE label = CASE WHEN score >= 0.5 THEN tier ELSE 'medium' END) / count(*), 6) AS accuracy FROM winner GROUP BY k""")
_put("quality_equivalence", """SELECT CASE doc_id % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' ELSE 'complex' END AS tier, count(*) AS judged,
  count(*) FILTER (WHERE quality = 1) AS equal, round(count(*) FILTER (WHERE quality = 1) / count(*) * 100, 2) AS equivalence_pct FROM labels GROUP BY 1""")
_put("attempt_rollup", f"WITH {_ATTEMPTS} SELECT * FROM final")
_put("escalation_confidence", f"""WITH {_LOG},{_ATTEMPTS},
graded AS (
  SELECT request_id, CASE id % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' ELSE 'complex' END AS tier, classifier_confidence AS c FROM logs WHERE NOT cache_hit)
SELECT request_id, tier AS graded_tier, coalesce(tier_used, tier) AS final_tier,
  round(CASE WHEN tier_used <> tier THEN c * 0.75 ELSE c END, 6) AS confidence FROM graded LEFT JOIN final USING (request_id)""")

# ---- windows, sorts, sets ----------------------------------------------------------------

_put("cumulative_savings", _log(_SERIES + "SELECT id, position, at_text AS created_at, cumulative_savings FROM series"))
_put("savings_downsample", _log(_SERIES + "SELECT id, position, at_text AS created_at, cumulative_savings FROM sampled"))
_put("sparkline_scale", _log(_SERIES + """
, ext AS (SELECT greatest(max(cumulative_savings), 0.000001) AS hi, least(min(cumulative_savings), 0) AS lo, count(*) AS c FROM sampled)
SELECT position, round((row_number() OVER (ORDER BY position) - 1) / (c - 1) * 200)::BIGINT AS x,
  round(40 - (cumulative_savings - lo) / (hi - lo) * 40)::BIGINT AS y FROM sampled, ext"""))
_put("bar_scale", _spine("SELECT position, model, count, round(count / greatest(1, max(count) OVER ()) * 100, 4) AS bar_pct FROM spine"))
_put("history_page", _log(f"""SELECT id, {_COLUMNS}, (SELECT count(*) FROM logs) AS total FROM logs ORDER BY latency_ms DESC, id DESC LIMIT 25 OFFSET 50"""))
_put("history_page_keyset", _log(f"SELECT id, {_COLUMNS} FROM logs WHERE created_at < TIMESTAMP '2024-01-20' ORDER BY logs.created_at DESC, id DESC LIMIT 25"))
_put("history_sorted", _log(f"SELECT id, {_COLUMNS} FROM logs ORDER BY savings_usd, id"))
_put("page_count", _log("SELECT greatest(1, ceil(count(*) / 5))::BIGINT AS pages FROM logs"))
_put("recent_requests", _log("""SELECT id, at_text AS created_at, tier, model_used, cache_hit, fallback_used, latency_ms, input_tokens, output_tokens,
  theoretical_cost_usd, baseline_cost_usd, savings_usd, savings_source FROM logs ORDER BY logs.created_at DESC, id DESC LIMIT 50"""))
_put("model_universe", _spine("SELECT model FROM known UNION SELECT model FROM served"))
_put("unknown_models", _spine("SELECT model_used AS model FROM logs WHERE NOT cache_hit EXCEPT SELECT model FROM known"))
_put("topk_neighbours", f"""WITH {_NEIGHBOURS}
SELECT query_id, rk AS rank, cache_id AS exemplar_id, tier, round(s, 6) AS similarity FROM ranked WHERE rk <= 15""")
_put("backoff_schedule", f"WITH {_ATTEMPTS} SELECT request_id, attempt_no, tier, tier_try, wait_seconds FROM waits")

# ---- streaming: what the stream must have produced by its end ------------------------------

_put("stream_parse", _log("""SELECT request_id, at_text AS created_at, tier, cache_hit, baseline_cost_usd
FROM logs, range(0, CASE WHEN id % 20 = 0 THEN 2 ELSE 1 END)"""))
_put("stream_dedup", _log("SELECT request_id, tier, baseline_cost_usd FROM logs"))
_put("stream_kpis", ORACLES["kpi_totals"])
_put("stream_recent", _log("SELECT request_id, at_text AS created_at, tier, model_used FROM logs ORDER BY logs.created_at DESC, request_id DESC LIMIT 50"))
_put("stream_reconcile", _log(f"""
, kpi AS (SELECT {_KPI} FROM logs)
SELECT requests, savings_usd, baseline_usd, savings_pct, cache_hit_rate, fallback_rate, requests AS live_requests, TRUE AS in_step FROM kpi"""))
_WATERMARK = "(SELECT date_trunc('milliseconds', max(created_at)) - INTERVAL 10 MINUTES FROM logs)"
_put("stream_windows", _log(f"""SELECT strftime(date_trunc('minute', created_at), '%Y-%m-%d %H:%M:%S.%f') AS window_start, model_used, count(*) AS requests,
  {_sum('savings_usd')} AS savings_usd FROM logs WHERE date_trunc('minute', created_at) + INTERVAL 1 MINUTE <= {_WATERMARK} GROUP BY 1, 2"""))
_put("stream_windows_sliding", _log(f"""
, slid AS (SELECT *, time_bucket(INTERVAL 5 MINUTES, created_at) - to_minutes(5 * i) AS s FROM logs, range(0, 2) t(i))
SELECT strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS window_start, count(*) AS requests, {_sum('savings_usd')} AS savings_usd
FROM slid WHERE s + INTERVAL 10 MINUTES <= {_WATERMARK} GROUP BY 1"""))
_put("stream_windows_session", _log(f"""
, gaps AS (SELECT *, CASE WHEN created_at < lag(created_at) OVER w + INTERVAL 10 MINUTES THEN 0 ELSE 1 END AS fresh FROM logs
  WINDOW w AS (PARTITION BY query_id ORDER BY created_at, id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS g FROM gaps)
SELECT strftime(min(created_at), '%Y-%m-%d %H:%M:%S.%f') AS window_start, query_id, count(*) AS requests, {_sum('savings_usd')} AS savings_usd
FROM numbered GROUP BY query_id, g HAVING max(created_at) + INTERVAL 10 MINUTES <= {_WATERMARK}"""))
_put("stream_cache_ttl", _REPLAY)
_put("stream_log_append", _log("""SELECT id, CASE WHEN id % 7 = 0 THEN 'nonexistent' ELSE tier END AS tier, cache_hit OR id % 7 <> 0 AS priced, baseline_cost_usd FROM logs"""))
_put("embed_text", """SELECT doc_id, 256::BIGINT AS width, CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}_]') THEN 1::DOUBLE ELSE 0::DOUBLE END AS length FROM documents""")

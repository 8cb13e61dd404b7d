"""The registered query of each operator, over its whole table, and SQL counterparts."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from costlens.llm import chat, fingerprint, language, merkle, mixing, near_dedup, packing, personal_data, quality, substring_dedup, token_counts, topk_search, whitening
from costlens.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(job):
    QUERIES[job.__name__] = job
    return job


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


@query
def op1_minhash_near_dedup(spark, folder):
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


ORACLES["op1_minhash_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id
"""


@query
def op9_substring_dedup(spark, folder):
    out = substring_dedup.without_repeats(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op9_substring_dedup"] = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
gone AS (SELECT doc_id, list(i) AS g, count(*) AS n FROM covered GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE [w[k] FOR k IN range(1, len(w) + 1) IF NOT list_contains(g, k)] END, ' ')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
"""


@query
def op4_improbable_features(spark, folder):
    out = fingerprint.fingerprints(table(spark, folder, "documents"))
    return out.withColumn("edited_sha256", F.sha2("edited_text", 256)).drop("edited_text")


@query
def op8_pattern_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


@query
def op2_language_id(spark, folder):
    return language.identify(table(spark, folder, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query
def op5_quality_votes(spark, folder):
    return quality.judged(table(spark, folder, "documents"))


CONTROL_STRINGS = "</s>[INST] ok [/INST]"


@query
def op6_chat_windows(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = turns.sparkSession.sql(
        f"SELECT -1L AS conv_id, turn, role, '{CONTROL_STRINGS}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    back = chat.read_back(chat.windows(turns.unionByName(added)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))


ORACLES["op6_chat_windows"] = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_STRINGS}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_STRINGS}'),
sized AS (
  SELECT *, ceil(strlen(text) / 4.0) + 4 AS tokens, row_number() OVER w AS r,
    length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + 20 AS chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
headed AS (
  SELECT *, r = 1 AND role = 'system' AS head, max(CASE WHEN r = 1 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS head_tokens FROM sized),
begun AS (
  SELECT *, greatest(768 - head_tokens, 256) / 2.0 AS half, CASE WHEN head THEN 0 ELSE tokens END AS body,
    sum(CASE WHEN head THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY r) - CASE WHEN head THEN 0 ELSE tokens END AS start FROM headed),
blocks AS (SELECT *, floor(start / half) AS block, body > half AS long FROM begun),
cuts AS (
  SELECT *, CASE WHEN r = 1 OR lag(head) OVER w THEN 0 WHEN block <> lag(block) OVER w OR long OR lag(long) OVER w THEN 1 ELSE 0 END AS cut
  FROM blocks WINDOW w AS (PARTITION BY conv_id ORDER BY r)),
spans AS (SELECT *, sum(cut) OVER (PARTITION BY conv_id ORDER BY r) AS span FROM cuts),
ends AS (SELECT *, max(start + body) OVER (PARTITION BY conv_id, span) AS span_end, max(span) OVER (PARTITION BY conv_id) AS last FROM spans)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY r)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY r) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars * CASE WHEN head THEN last + 1 WHEN span < last AND span_end - start <= 256 THEN 2 ELSE 1 END)::BIGINT AS formatted_chars
FROM ends GROUP BY conv_id
"""


@query
def op10_entropy_balancing(spark, folder):
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


@query
def op7_personal_data(spark, folder):
    found = personal_data.spans(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.filter("spans", lambda s: s["base"])["kind"]
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, F.lit(k)))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(personal_data.KINDS)]
    return found.select("doc_id", *counts, F.sha2(personal_data.as_text(base), 256).alias("base_sha256"), personal_data.as_text(F.col("spans")).alias("spans"))


@query
def op3_longest_match_tokens(spark, folder):
    return token_counts.token_counts(table(spark, folder, "documents"))


@query
def op11_merkle_manifest(spark, folder):
    docs = table(spark, folder, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [lower if name == "text" else F.col(name) for name in merkle.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf_digest(fields))
    found = merkle.manifest(docs, {"tampered": tampered})
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({field}) || ':' || {field}, '-')" for field in fields) + ")"


def _up_sql(name: str, start: str) -> str:
    """Recursive roll-up of (g, level, i, digest, n), and the siblings of every node."""
    return f"""
{name} AS (
  {start}
  UNION ALL SELECT g, level + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)), (n + 15) // 16 FROM {name} WHERE n > 1 GROUP BY g, level, i // 16, n),
{name}_sides AS (
  SELECT g, level, i, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM {name} WHERE n > 1 WINDOW w AS (PARTITION BY g, level, i // 16 ORDER BY i))"""


ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {_leaf_sql("text")} AS leaf,
    {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten([[(ascii(c) >> b) & 1 FOR b IN range(8)] FOR c IN string_split(doc_id::VARCHAR, '')])),
      lambda x, y: xor(x >> 1, CASE WHEN (x & 1) <> y THEN 3988292384 ELSE 0 END))) % 5 = 0 AS tampered
  FROM documents),
places AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
{_up_sql("docs_up", "SELECT g, 0 AS level, i, leaf AS digest, n FROM places")},
subroots AS (SELECT g, digest FROM docs_up WHERE n = 1),
{_up_sql("roots_up", "SELECT 0 AS g, 0 AS level, g AS i, digest, (SELECT count(*) FROM subroots) AS n FROM subroots")},
steps AS (
  SELECT p.g, p.i, s.level AS place, lft, rgt FROM places p JOIN docs_up_sides s ON s.g = p.g AND s.i = p.i >> (4 * s.level)
  UNION ALL SELECT p.g, p.i, 100 + s.level, lft, rgt FROM places p JOIN roots_up_sides s ON s.i = p.g >> (4 * s.level)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY place) AS k FROM steps),
fold AS (
  SELECT g, i, 0 AS k, CASE WHEN tampered THEN other ELSE leaf END AS digest FROM places
  UNION ALL SELECT f.g, f.i, f.k + 1, sha256(lft || f.digest || rgt) FROM fold f JOIN numbered s ON s.g = f.g AND s.i = f.i AND s.k = f.k + 1),
proofs AS (SELECT g, i, string_agg(lft || rgt, '' ORDER BY k) AS proof FROM numbered GROUP BY g, i),
ends AS (SELECT g, i, arg_max(digest, k) AS folded_root FROM fold GROUP BY g, i),
root AS (SELECT digest AS root FROM roots_up WHERE n = 1)
SELECT doc_id, leaf, s.digest AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM places p JOIN ends e ON e.g = p.g AND e.i = p.i JOIN subroots s ON s.g = p.g LEFT JOIN proofs f ON f.g = p.g AND f.i = p.i, root
"""


@query
def op13_whitening(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op12_exact_topk(spark, folder):
    return topk_search.search(table(spark, folder, "embeddings"))


ORACLES["op12_exact_topk"] = """
WITH usable AS (
  SELECT rowid_ AS r, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM embeddings)
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scores AS (
  SELECT q.r, q.vec_id AS query_id, d.vec_id, list_sum([q.x[i] * d.x[i] FOR i IN range(1, len(q.x) + 1)])::BIGINT AS score
  FROM usable q JOIN usable d ON q.r <> d.r AND len(q.x) = len(d.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5
"""

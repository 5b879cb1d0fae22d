"""The queries again, as SQL for DuckDB over the same tables.

Shared pieces are common table expressions, put together as text.
"""

from __future__ import annotations

from lexmill.plans.queries import (
    LANGS,
    LOG_METRICS,
    MAX_LENGTH,
    MODEL_MAX_LENGTH,
    PART_SIZES,
    ROLES,
    SWEEP_SIZES,
    VOCAB_SIZE,
)


def _tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[ \\t\\n\\r]+'), lambda x: x <> '')"


def _class(column: str, classes: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(classes))
    return f"CAST(CASE {column} {cases} END AS INTEGER)"


def _split(key: str, train: float = 0.7) -> str:
    share = f"CAST('0x' || substr(md5('12345:' || {key}), 1, 8) AS BIGINT) / 4294967296.0"
    return f"CASE WHEN {share} < {train} THEN 'train' ELSE 'test' END"


def _round(values: str, decimals: int = 4) -> str:
    factor = float(10**decimals)
    return (
        f"list_transform({values}, lambda v: "
        f"CAST(round_even(CAST(v AS FLOAT) * {factor}::FLOAT, 0) / {factor} AS FLOAT))"
    )


def _softmax(logits: str, scale: float) -> str:
    parts = f"list_transform({logits}, lambda l: exp((l - list_max({logits})) / {scale}))"
    total = f"list_sum({parts})"
    return f"list_transform({parts}, lambda e: CAST(e / {total} AS FLOAT))"


def _decode(values: str) -> str:
    return f"CAST(list_position({values}, list_max({values})) - 1 AS BIGINT)"


DOCS = f"docs AS (SELECT doc_id, text, {_class('lang', LANGS)} AS label FROM documents)"
TURNS = (
    f"docs AS (SELECT conv_id || ':' || turn AS turn_key, text, {_class('role', ROLES)} AS label FROM conversations)"
)


def _judged(label: str) -> str:
    return f"docs AS (SELECT doc_id, text, {label} AS label FROM documents JOIN labels USING (doc_id))"


def _bayes(k: int, max_vocab: int | None = None, text: str = "text", key: str = "text") -> str:
    """CTEs from ``docs``: sides by ``key``, dense counts, stats, prior ``b`` and weights ``weights(token, n, w)``."""
    counts = ", ".join(f"count(*) FILTER (label = {c})" for c in range(k))
    limit = f"ORDER BY n DESC, token LIMIT {max_vocab}" if max_vocab else ""
    tokens_of = ", ".join(f"sum(by_class[{c}])" for c in range(1, k + 1))
    texts_of = ", ".join(f"count(*) FILTER (label = {c})" for c in range(k))
    weight = ", ".join(
        f"CAST(round_even(1e6 * (ln(by_class[{c}] + 1.0) - ln(CAST(class_tokens[{c}] + vocab_size AS DOUBLE))), 0) AS BIGINT)"
        for c in range(1, k + 1)
    )
    prior = ", ".join(
        f"CASE WHEN docs_of[{c}] > 0 THEN CAST(round_even(1e6 * ln(docs_of[{c}] / CAST(total AS DOUBLE)), 0) AS BIGINT)"
        f" ELSE -1000000000000000 END"
        for c in range(1, k + 1)
    )
    return f"""
sides AS (SELECT *, {_split(key)} AS split FROM docs),
train_tokens AS (SELECT label, unnest({_tokens(text)}) AS token FROM sides WHERE split = 'train'),
dense AS (SELECT token, count(*) AS n, [{counts}] AS by_class FROM train_tokens GROUP BY token {limit}),
stats AS (SELECT [{tokens_of}] AS class_tokens, count(*) AS vocab_size FROM dense),
texts AS (SELECT [{texts_of}] AS docs_of, count(*) AS total FROM sides WHERE split = 'train'),
prior AS (SELECT [{prior}] AS b FROM texts),
weights AS (SELECT token, n, [{weight}] AS w FROM dense, stats)"""


def _logits(k: int, key: str, source: str = "sides WHERE split = 'test'", text: str = "text") -> str:
    """CTE ``logits(key, logits)`` from the CTEs of ``_bayes``."""
    sums = ", ".join(f"CAST(b[{c}] + coalesce(s{c}, 0) AS BIGINT)" for c in range(1, k + 1))
    parts = ", ".join(f"sum(w[{c}]) AS s{c}" for c in range(1, k + 1))
    return f"""
scored_rows AS (SELECT * FROM {source}),
hits AS (SELECT {key}, unnest({_tokens(text)}) AS token FROM scored_rows),
sums AS (SELECT {key}, {parts} FROM hits JOIN weights USING (token) GROUP BY {key}),
logits AS (SELECT {key}, [{sums}] AS logits FROM scored_rows LEFT JOIN sums USING ({key}), prior)"""


def _probabilities(decimals: int | None) -> str:
    exact = _softmax("logits", 1e6)
    return exact if decimals is None else _round(exact, decimals)


def _metric_ctes(scored: str) -> str:
    """CTEs from a (label, predicted_class) frame: cells and per-class rates."""
    return f"""
cells AS (SELECT CAST(label AS BIGINT) AS label, predicted_class, count(*) AS n FROM {scored} GROUP BY ALL),
classes AS (SELECT DISTINCT label AS class FROM cells UNION SELECT DISTINCT predicted_class FROM cells),
totals AS (SELECT class,
  coalesce((SELECT sum(n) FROM cells WHERE label = class), 0)::DOUBLE AS support,
  coalesce((SELECT sum(n) FROM cells WHERE predicted_class = class), 0)::DOUBLE AS predicted,
  coalesce((SELECT sum(n) FROM cells WHERE label = class AND predicted_class = class), 0)::DOUBLE AS tp FROM classes),
rates AS (SELECT class, support, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS p,
  CASE WHEN support = 0 THEN 0 ELSE tp / support END AS r FROM totals),
per_class AS (SELECT class, support, p, r, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM rates)"""


def _predicted(k: int, key: str) -> str:
    return f"{_logits(k, key)},\npredicted AS (SELECT {key}, label, {_decode('logits')} AS predicted_class FROM logits JOIN sides USING ({key}))"


LOG = """entries AS (SELECT event_id // 20 AS run_id, CAST(event_id % 20 AS INTEGER) AS pos,
  ((event_id % 20) // 2 + 1) * 100 AS step, CAST((event_id % 20) // 2 + 1 AS DOUBLE) AS epoch,
  CASE WHEN event_type IN ('click', 'view', 'signup') AND event_id % 20 < 19 THEN value / 1000 END AS eval_f1,
  CASE WHEN event_type IN ('click', 'view', 'signup') AND event_id % 20 < 19 THEN value / 2000 END AS eval_recall,
  CASE WHEN event_id % 20 = 19 THEN value END AS train_runtime,
  CASE WHEN event_id % 20 = 19 THEN value / 100 END AS train_loss FROM events)"""

BEST_EPOCH = """best AS (SELECT run_id, min(epoch) AS best_epoch, any_value(top) AS best_metric FROM
  (SELECT run_id, epoch, eval_f1, max(eval_f1) OVER (PARTITION BY run_id) AS top FROM entries)
  WHERE eval_f1 = top GROUP BY run_id)"""

STAGES = """stage_events AS (SELECT 'model_' || (user_id % 10) AS name, CAST(user_id // 10 + 1 AS INTEGER) AS version,
  CASE event_type WHEN 'signup' THEN 'None' WHEN 'view' THEN 'Staging' WHEN 'error' THEN 'Archived' ELSE 'Production' END
    AS stage, event_id FROM events),
current AS (SELECT name, version, stage AS current_stage FROM stage_events
  QUALIFY row_number() OVER (PARTITION BY name, version ORDER BY event_id DESC) = 1)"""

K = len(LANGS)
BAYES_ALL = f"{DOCS},{_bayes(K)}"
BAYES_TOP = f"{DOCS},{_bayes(K)}"

VOCAB = f"""all_tokens AS (SELECT unnest({_tokens('text')}) AS token FROM documents),
ranked AS (SELECT token, count(*) AS n FROM all_tokens GROUP BY token),
vocab AS (SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER) AS id FROM ranked)"""


def _encoded(length: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTE ``encoded`` with whole arrays, from ``vocab``; ``length`` is an SQL integer."""
    used = f"(least(len(tokens), {length} - 2) + 2)"
    return f"""
cut AS (SELECT {key}, {_tokens(text)} AS tokens FROM {source}),
places AS (SELECT {key}, unnest(tokens[1:{length} - 2]) AS token, generate_subscripts(tokens[1:{length} - 2], 1) AS pos FROM cut),
found AS (SELECT {key}, list(coalesce(id, 1) ORDER BY pos) AS ids FROM places LEFT JOIN vocab USING (token) GROUP BY {key}),
encoded AS (SELECT {key},
  list_concat([2], coalesce(ids, []), [3], list_resize([]::INTEGER[], {length} - {used}, 0)) AS input_ids,
  list_concat(list_resize([]::INTEGER[], {used}, 1), list_resize([]::INTEGER[], {length} - {used}, 0)) AS attention_mask,
  {used} AS used FROM cut LEFT JOIN found USING ({key}))"""


TRAIN_VOCAB = VOCAB.replace("FROM documents", f"FROM documents WHERE {_split('text')} = 'train'")
ENCODED = f"{TRAIN_VOCAB},{_encoded(str(MAX_LENGTH))}"
ENCODED_SCORES = f"""WITH {ENCODED},
docs AS (SELECT doc_id, text, {_class('lang', LANGS)} AS label, array_to_string(input_ids[1:used], ' ') AS ids
  FROM documents JOIN encoded USING (doc_id)),{_bayes(K, text='ids')},{_logits(K, 'doc_id', text='ids')},
probs AS (SELECT doc_id, {_probabilities(4)} AS probabilities FROM logits)"""
PARTS = "docs AS (SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type) AS text, p_size - 1 AS label FROM part)"


def oracle_sql() -> dict[str, str]:
    probabilities = _probabilities(4)
    udf_scored = f"""WITH {BAYES_TOP},{_logits(K, 'doc_id')},
probs AS (SELECT doc_id, {probabilities} AS probabilities FROM logits)"""
    streamed = f"""WITH {BAYES_TOP},{_logits(K, 'doc_id', 'sides')},
probs AS (SELECT doc_id, {probabilities} AS probabilities FROM logits)
SELECT doc_id, probabilities, list_max(probabilities) AS predicted_probability,
{_decode('probabilities')} AS predicted_class FROM probs"""
    sides_by_id = f"sides AS (SELECT *, {_split('doc_id')} AS split FROM docs)"
    blanked = "(SELECT doc_id, CASE WHEN label <> 0 THEN text ELSE 'None' END AS text FROM sides WHERE split = 'test')"
    sweep = " UNION ALL ".join(
        f"""(WITH {DOCS},{_bayes(K, size)},{_predicted(K, 'doc_id')},{_metric_ctes('predicted')}
SELECT round(sum(f * support) / sum(support), 6) AS eval_f1 FROM per_class)"""
        for size in SWEEP_SIZES
    )
    return {
        "scan_table": "SELECT doc_id, lang, source, n_chars FROM documents",
        "file_manifest": "SELECT CAST(count(*) AS BIGINT) AS n_rows, true AS all_sized FROM documents",
        "read_files": "SELECT doc_id, text FROM documents",
        "read_lazy": "SELECT doc_id, lang, n_chars FROM documents",
        "stream_read": "SELECT doc_id, lang, n_chars FROM documents",
        "ingest": f"""WITH {TURNS} SELECT turn_key, text, label,
row_number() OVER (ORDER BY md5('123:' || turn_key)) AS shuffle_rank FROM docs""",
        "log_history_scan": f"""WITH {LOG} SELECT run_id, max(step) OVER (PARTITION BY run_id) AS global_step,
pos, step, epoch, {", ".join(LOG_METRICS)}, train_runtime, train_loss FROM entries""",
        "write_overwrite": f"WITH {DOCS} SELECT doc_id, label FROM docs",
        "write_append": f"WITH {DOCS} SELECT doc_id, label FROM docs UNION ALL SELECT doc_id, label FROM docs",
        "input_example": "SELECT text FROM documents ORDER BY doc_id LIMIT 5",
        "model_table": f"WITH {BAYES_TOP} SELECT token, n, w FROM weights",
        "cast_label": f"WITH {_judged('quality')} SELECT text, label FROM docs",
        "project_feature": "SELECT text FROM documents",
        "select_configured": "SELECT conv_id, turn, text, role AS label FROM conversations",
        "path_rewrite": """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN
regexp_replace(regexp_replace(url, '^https?:/', 'dbfs:'), '^dbfs:/*', '/dbfs/') ELSE url END AS path FROM pages""",
        "artifact_root": "SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS artifact_root FROM pages",
        "stringify": """SELECT doc_id, CASE WHEN n_chars % 7 <> 0 THEN CAST(n_chars AS VARCHAR) ELSE 'None' END AS feature
FROM documents""",
        "softmax_probs": f"SELECT vec_id, {_round(_softmax('embedding', 1.0))} AS probabilities FROM embeddings",
        "round_probs": f"SELECT vec_id, {_round('embedding')} AS rounded FROM embeddings",
        "decode_prediction": f"""WITH rounded AS (SELECT vec_id, {_round('embedding', 2)} AS p FROM embeddings)
SELECT vec_id, list_max(p) AS predicted_probability, {_decode('p')} AS predicted_class FROM rounded""",
        "argmax_logits": f"SELECT vec_id, {_decode('embedding')} AS predicted_class FROM embeddings",
        "hash_split": f"WITH {DOCS} SELECT doc_id, label, {_split('text')} AS split FROM docs",
        "paired_splits": f"WITH {DOCS}, {sides_by_id} SELECT split, label, count(*) AS n FROM sides GROUP BY ALL",
        "random_split": """SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(1 AS BIGINT) AS most_copies,
true AS share_holds FROM documents""",
        "label_audit": f"""WITH {TURNS} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_not_integer,
min(label) AS min_label, max(label) AS max_label, count(DISTINCT label) AS num_labels,
min(label) = 0 AND max(label) + 1 = count(DISTINCT label) AS is_valid FROM docs""",
        "label_audit_invalid": """WITH raw AS (SELECT CASE WHEN lang = 'fr' THEN 'x'
  WHEN lang <> 'es' THEN CAST(n_chars % 5 + 1 AS VARCHAR) END AS label FROM documents),
parsed AS (SELECT label, TRY_CAST(label AS INTEGER) AS value FROM raw)
SELECT count(*) AS n_rows, count(*) FILTER (label IS NULL) AS n_null,
count(*) FILTER (label IS NOT NULL AND value IS NULL) AS n_not_integer, min(value) AS min_label, max(value) AS max_label,
count(DISTINCT value) AS num_labels, min(value) = 0 AND max(value) + 1 = count(DISTINCT value)
AND count(*) = count(value) AS is_valid FROM parsed""",
        "shuffle_rank": f"""WITH {DOCS} SELECT doc_id, label,
row_number() OVER (ORDER BY md5('123:' || doc_id)) AS shuffle_rank FROM docs""",
        "repartition_n": "SELECT CAST(7 AS BIGINT) AS n_parts, CAST(count(*) AS BIGINT) AS n_rows FROM documents",
        "step_plan": f"""WITH {DOCS}, sides AS (SELECT *, {_split('text')} AS split FROM docs),
c AS (SELECT count(*) AS n FROM sides WHERE split = 'train')
SELECT n AS n_rows, CAST(256 AS BIGINT) AS effective_batch, CAST(floor(10 * n / 256) AS BIGINT) AS max_steps,
CAST(floor(floor(10 * n / 256) / 10) AS BIGINT) AS eval_steps,
CAST(greatest(1, floor(floor(10 * n / 256) / 10)) AS BIGINT) AS eval_every FROM c""",
        "build_vocab": f"WITH {VOCAB} SELECT token, n, id FROM vocab",
        "encode_text": f"""WITH {VOCAB},{_encoded(str(MAX_LENGTH))}
SELECT doc_id, input_ids, attention_mask FROM encoded""",
        "encode_batched": f"""WITH {VOCAB},{_encoded(str(MAX_LENGTH))}
SELECT doc_id, lang, input_ids, attention_mask FROM encoded JOIN documents USING (doc_id)""",
        "encode_training_rows": f"""WITH {ENCODED}
SELECT doc_id, input_ids, attention_mask, {_class('lang', LANGS)} AS label, {_split('text')} AS split
FROM encoded JOIN documents USING (doc_id)""",
        "score_encoded": f"""{ENCODED_SCORES}
SELECT doc_id, label, probabilities, {_decode('probabilities')} AS predicted_class FROM probs JOIN sides USING (doc_id)""",
        **{
            name: f"""{ENCODED_SCORES}
SELECT doc_id, text, probabilities, {_decode('probabilities')} AS predicted_class FROM probs JOIN sides USING (doc_id)"""
            for name in ("score_encoding_batch", "score_encoding_udf")
        },
        "many_classes": f"""WITH {PARTS},{_bayes(PART_SIZES, key='p_partkey')},{_predicted(PART_SIZES, 'p_partkey')}
SELECT p_partkey, label, predicted_class FROM predicted""",
        "catalog_table": f"WITH {DOCS} SELECT doc_id, label FROM docs UNION ALL SELECT doc_id, label FROM docs",
        "scoring_job_udf": f"""{udf_scored},
once AS (SELECT text, probabilities, list_max(probabilities) AS predicted_probability,
{_decode('probabilities')} AS predicted_class FROM probs JOIN sides USING (doc_id))
SELECT * FROM once UNION ALL SELECT * FROM once""",
        "softmax_quality": f"""WITH {DOCS}, sides AS (SELECT *, {_split('text')} AS split FROM docs)
SELECT count(*) AS n_rows, true AS beats_majority, count(*) AS n_ids FROM sides WHERE split = 'test'""",
        "epoch_log_shape": """SELECT CAST(7 AS BIGINT) AS n_entries, CAST(3 AS BIGINT) AS n_evaluations,
CAST(3 AS BIGINT) AS n_losses, CAST(3 AS BIGINT) AS n_epochs, true AS steps_rise, true AS runtime_last, true AS runtime_once""",
        "step_evaluations": "SELECT CAST(6 AS BIGINT) AS n_evaluations, CAST(2 AS DOUBLE) AS epochs",
        "step_budget": f"""WITH {DOCS}, sides AS (SELECT *, {_split('text')} AS split FROM docs)
SELECT CAST(floor(4 * count(*) / 32) AS BIGINT) AS max_steps, CAST(4 AS BIGINT) AS n_evaluations, true AS spent
FROM sides WHERE split = 'train'""",
        "resumed_run": "SELECT CAST(3 AS BIGINT) AS n_evaluations, true AS same_log, true AS same_predictions",
        "encode_pages": f"""WITH {VOCAB},{_encoded(str(MAX_LENGTH), 'pages', 'page_id', 'html')}
SELECT page_id, input_ids, attention_mask FROM encoded""",
        "encode_full_length": f"""WITH {VOCAB},
{_encoded(str(MODEL_MAX_LENGTH))}
SELECT doc_id, CAST(len(input_ids) AS BIGINT) AS n_ids, CAST(used AS BIGINT) AS n_used,
md5(array_to_string(input_ids, ' ')) AS ids_md5 FROM encoded""",
        "token_length_profile": f"""WITH sizes AS (SELECT lang, CAST(len({_tokens('text')}) AS INTEGER) AS length FROM documents)
SELECT lang, count(*) AS n_texts, min(length) AS min_tokens, max(length) AS max_tokens,
quantile_cont(length, 0.5) AS median_tokens, quantile_cont(length, 0.95) AS p95_tokens,
round(count(*) FILTER (length > {MAX_LENGTH - 2}) / count(*), 6) AS truncated_share FROM sizes GROUP BY lang""",
        "nb_weights": f"WITH {BAYES_ALL} SELECT token, n, w FROM weights",
        "predictions_table": f"""WITH {BAYES_ALL},{_logits(K, 'doc_id')},
probs AS (SELECT doc_id, {probabilities} AS probabilities FROM logits)
SELECT doc_id, text, probabilities, list_max(probabilities) AS predicted_probability,
{_decode('probabilities')} AS predicted_class FROM probs JOIN sides USING (doc_id)""",
        "score_batch": f"""WITH {BAYES_TOP},{_logits(K, 'doc_id')},
probs AS (SELECT doc_id, {_probabilities(None)} AS probabilities FROM logits)
SELECT doc_id, text, label, probabilities, list_max(probabilities) AS predicted_probability,
{_decode('probabilities')} AS predicted_class FROM probs JOIN sides USING (doc_id)""",
        "score_udf": f"""{udf_scored}
SELECT text, probabilities, list_max(probabilities) AS predicted_probability,
{_decode('probabilities')} AS predicted_class FROM probs JOIN sides USING (doc_id)""",
        "score_unlabelled": f"""WITH {BAYES_ALL},{_logits(K, 'item_id', 'benchmark')},
probs AS (SELECT item_id, {probabilities} AS probabilities FROM logits)
SELECT item_id, text, probabilities, list_max(probabilities) AS predicted_probability,
{_decode('probabilities')} AS predicted_class FROM probs JOIN benchmark USING (item_id)""",
        "score_null_literal": f"""WITH {BAYES_TOP},{_logits(K, 'doc_id', blanked)},
probs AS (SELECT doc_id, {probabilities} AS probabilities FROM logits)
SELECT doc_id, probabilities, {_decode('probabilities')} AS predicted_class FROM probs""",
        "score_vectors": """WITH places AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
  generate_subscripts(embedding, 1) AS pos FROM embeddings),
centroids AS (SELECT label AS class, pos, avg(x) AS c FROM places GROUP BY ALL),
scores AS (SELECT vec_id, class, sum(2 * x * c - c * c) AS s FROM places JOIN centroids USING (pos) GROUP BY ALL)
SELECT vec_id, label, CAST(dense_rank() OVER (ORDER BY class) - 1 AS BIGINT) AS predicted_class FROM (
  SELECT vec_id, any_value(e.label) AS label, arg_max(class, s) AS class FROM scores JOIN embeddings e USING (vec_id)
  GROUP BY vec_id)""",
        "score_and_evaluate": f"""WITH {BAYES_TOP},{_predicted(K, 'doc_id')},{_metric_ctes('predicted')}
SELECT round(sum(f * support) / sum(support), 6) AS f1, round(sum(p * support) / sum(support), 6) AS precision,
round(sum(r * support) / sum(support), 6) AS recall, CAST(sum(support) AS BIGINT) AS n_rows FROM per_class""",
        "scoring_job": f"WITH {BAYES_TOP},{_predicted(K, 'doc_id')} SELECT doc_id, label, predicted_class FROM predicted",
        "sweep_leaderboard": f"""SELECT 'lang' AS experiment, 'bayes' AS run_name, eval_f1,
CAST(row_number() OVER (ORDER BY eval_f1 DESC) AS INTEGER) AS place FROM ({sweep})""",
        "confusion_matrix": f"""WITH {TURNS},{_bayes(len(ROLES))},{_predicted(len(ROLES), 'turn_key')}
SELECT CAST(label AS BIGINT) AS label, predicted_class, count(*) AS n FROM predicted GROUP BY ALL""",
        "per_class_metrics": f"""WITH {_judged('quality')},{_bayes(2)},{_predicted(2, 'doc_id')},{_metric_ctes('predicted')}
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
CAST(support AS BIGINT) AS support FROM per_class""",
        "weighted_metrics": f"""WITH {_judged('toxic')},{_bayes(2)},{_predicted(2, 'doc_id')},{_metric_ctes('predicted')},
share AS (SELECT max(support) / sum(support) AS s FROM per_class)
SELECT round(sum(f * support) / sum(support), 6) AS f1, round(sum(p * support) / sum(support), 6) AS precision,
round(sum(r * support) / sum(support), 6) AS recall, (SELECT round(s * 2 * s / (1 + s), 6) FROM share) AS majority_f1,
CAST(sum(support) AS BIGINT) AS n_rows FROM per_class""",
        "log_loss": f"""WITH {TURNS},{_bayes(len(ROLES))},{_logits(len(ROLES), 'turn_key')},
losses AS (SELECT ln(list_sum(list_transform(logits, lambda l: exp((l - list_max(logits)) / 1e6))))
  - (logits[label + 1] - list_max(logits)) / 1e6 AS loss FROM logits JOIN sides USING (turn_key))
SELECT round(avg(loss), 4) AS log_loss, count(loss) AS n_rows FROM losses""",
        "best_metrics": f"""WITH {LOG}, {BEST_EPOCH},
at_best AS (SELECT e.run_id, step, {", ".join(LOG_METRICS)} FROM entries e JOIN best b
  ON e.run_id = b.run_id AND e.step = b.best_epoch * 100
  QUALIFY row_number() OVER (PARTITION BY e.run_id ORDER BY CASE WHEN eval_f1 IS NULL THEN 1 ELSE 0 END, pos) = 1),
total AS (SELECT run_id, train_runtime, train_loss FROM entries WHERE train_runtime IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY pos) = 1)
SELECT run_id, step, {", ".join(LOG_METRICS)}, train_runtime, train_loss FROM at_best LEFT JOIN total USING (run_id)""",
        "best_checkpoint": f"WITH {LOG}, {BEST_EPOCH} SELECT run_id, best_epoch, best_metric FROM best",
        "checkpoint_retention": f"""WITH {LOG},
epochs AS (SELECT run_id, epoch, max(eval_f1) AS metric FROM entries WHERE eval_f1 IS NOT NULL GROUP BY ALL),
marked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY metric DESC, epoch) = 1 AS is_best FROM epochs)
SELECT run_id, epoch, metric, is_best,
is_best OR row_number() OVER (PARTITION BY run_id, is_best ORDER BY epoch DESC) <= 2 AS kept FROM marked""",
        "run_leaderboard": """SELECT event_type AS experiment, event_id AS run_id, value / 1000 AS f1,
CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS place FROM events
WHERE value IS NOT NULL""",
        "run_log_append": """SELECT 'events' AS experiment, CAST(user_id AS VARCHAR) AS run_id, 'run_' || user_id AS run_name,
max(value) AS f1, CAST(count(*) AS DOUBLE) AS n, CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS streaming_read
FROM events GROUP BY user_id""",
        "current_stage": f"WITH {STAGES} SELECT name, version, current_stage FROM current",
        "resolve_stage": f"""WITH {STAGES},
newest AS (SELECT name, max(version) AS version FROM current WHERE current_stage = 'Production' GROUP BY name)
SELECT name, version, name || '-' || version AS run_id, 'dbfs:/runs/' || name || '-' || version || '/artifacts/model' AS source,
'dbfs:/runs/' || name || '-' || version || '/artifacts' AS artifact_root FROM newest""",
        "stream_counts": f"""WITH {DOCS}, all_tokens AS (SELECT label, unnest({_tokens('text')}) AS token FROM docs)
SELECT token, label, count(*) AS n FROM all_tokens GROUP BY ALL""",
        "stream_score": streamed,
        "stream_score_large": streamed,
        "stream_follow_stage": f"""WITH {BAYES_TOP},{_logits(K, 'doc_id', 'sides')},
turned AS (SELECT doc_id, doc_id % 2 = 1 AS late, CASE WHEN doc_id % 2 = 1 THEN list_reverse(logits) ELSE logits END AS logits FROM logits),
probs AS (SELECT doc_id, late, {probabilities} AS probabilities FROM turned)
SELECT doc_id, CASE WHEN late THEN 2 ELSE 1 END AS model_version, {_decode('probabilities')} AS predicted_class FROM probs""",
    }

"""Every operator as a query over the given tables.

Each takes (session, folder of parquet tables) and returns a DataFrame. What the
tables do not hold as such (run logs, stage events, paths) is derived from their
rows, so that all work grows with the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.config import ScoringJob, TrainingConfig
from lexmill.functions import (
    argmax,
    class_index,
    decode,
    drop_last_segment,
    rewrite_mount_prefix,
    round_half_even,
    softmax,
    stringify,
)
from lexmill.operators import bayes, encode, metrics, prepare, runs, scoring
from lexmill.operators.softmax import fit_softmax, softmax_predictor, spread
from lexmill.plans.centroid import centroid_predictor, fit_centroids
from lexmill.plans.inference import run_predictor, run_scoring, score_counted
from lexmill.plans.training import run_sweep, run_training
from lexmill.session import scratch_path, written
from lexmill.sources import (
    file_manifest,
    ingest,
    input_example,
    input_files,
    log_history,
    read_back,
    read_files,
    read_log_history,
    read_table,
    write_table,
)
from lexmill.streaming import (
    append_stream,
    read_arriving,
    read_batches,
    score_stream,
    score_stream_by_join,
    score_stream_by_stage,
    stream_token_counts,
    summed_counts,
)

Query = Callable[[SparkSession, str], DataFrame]

SPREAD_SETTING = "lexmill.scan.partitions"

LANGS = ("de", "en", "es", "fr")
ROLES = ("assistant", "system", "user")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
VOCAB_SIZE = 30_000
MAX_LENGTH = 40
MODEL_MAX_LENGTH = 512
SOFTMAX_BATCH = 16
PART_SIZES = 50
SWEEP_SIZES = (1_000, VOCAB_SIZE)
LOG_METRICS = ("eval_f1", "eval_recall")


# -- inputs ------------------------------------------------------------------


def scan(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf.rstrip('/')}/{name}.parquet")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as its files are cut, or in as many partitions as the session asks for in SPREAD_SETTING.

    A scan cannot cut below a row group; the setting is for tables of a few large ones.
    """
    partitions = spark.conf.get(SPREAD_SETTING, None)
    return prepare.repartition_for_scoring(scan(spark, sf, name), int(partitions) if partitions else None)


def arriving(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table as a stream; the pattern matches it as one file and as a folder of files."""
    return read_arriving(spark, f"{sf.rstrip('/')}/{name}.parquet*")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, text and the language as label."""
    return table(spark, sf, "documents").select("doc_id", "text", class_index("lang", LANGS).alias("label"))


def judged(spark: SparkSession, sf: str, label: str) -> DataFrame:
    """doc_id, text and a 0/1 judgement as label."""
    marks = table(spark, sf, "labels").select("doc_id", F.col(label).alias("label"))
    return table(spark, sf, "documents").select("doc_id", "text").join(marks, "doc_id")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns with a single key and the role as label."""
    key = F.concat_ws(":", "conv_id", "turn")
    return table(spark, sf, "conversations").select(
        key.alias("turn_key"), "text", class_index("role", ROLES).alias("label")
    )


def log_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Events as log entries: 20 in a row make a run, two share a step, the last has the runtime."""
    pos, half = F.col("event_id") % 20, F.expr("event_id % 20 div 2")
    is_eval = F.col("event_type").isin("click", "view", "signup")
    value = F.col("value")
    return table(spark, sf, "events").select(
        F.expr("event_id div 20").alias("run_id"),
        pos.cast("int").alias("pos"),
        ((half + 1) * 100).alias("step"),
        (half + 1).cast("double").alias("epoch"),
        F.when(is_eval & (pos < 19), value / 1000).alias("eval_f1"),
        F.when(is_eval & (pos < 19), value / 2000).alias("eval_recall"),
        F.when(pos == 19, value).alias("train_runtime"),
        F.when(pos == 19, value / 100).alias("train_loss"),
    )


def stage_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as stage changes of 10 models with versions from 1 on."""
    stage = (
        F.when(F.col("event_type") == "signup", "None")
        .when(F.col("event_type") == "view", "Staging")
        .when(F.col("event_type") == "error", "Archived")
        .otherwise("Production")
    )
    user = F.col("user_id")
    return table(spark, sf, "events").select(
        F.concat(F.lit("model_"), (user % 10).cast("string")).alias("name"),
        F.expr("cast(user_id div 10 + 1 as int)").alias("version"),
        stage.alias("stage"),
        F.col("event_id").alias("event_order"),
    )


def model_versions(events: DataFrame) -> DataFrame:
    run_id = F.concat_ws("-", "name", F.col("version").cast("string"))
    source = F.concat(F.lit("dbfs:/runs/"), run_id, F.lit("/artifacts/model"))
    pairs = events.select("name", "version").distinct()
    return pairs.select("name", "version", run_id.alias("run_id"), source.alias("source"))


def fitted(
    spark: SparkSession, rows: DataFrame, num_labels: int, max_vocab: int | None = None
) -> tuple[bayes.BayesModel, DataFrame]:
    """A count-based model of the train side of a text-hash split, and the test side."""
    train, test = prepare.split_pair(rows, "text")
    return bayes.fit_bayes(train, scratch_path(spark, "model"), num_labels, max_vocab=max_vocab), test


def predicted(spark: SparkSession, rows: DataFrame, key: str, num_labels: int) -> DataFrame:
    """(key, label, predicted_class) of the test side."""
    model, test = fitted(spark, rows, num_labels)
    logits = bayes.bayes_logits(test, model, key, carry=["label"])
    return logits.select(key, "label", argmax("logits").alias("predicted_class"))


def _six(value: Column | str, name: str) -> Column:
    return F.round(value, 6).alias(name)


# -- scans and sinks ---------------------------------------------------------


def scan_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


def file_manifest_query(spark: SparkSession, sf: str) -> DataFrame:
    return file_manifest(scan(spark, sf, "documents")).groupBy().agg(
        F.sum("n_rows").alias("n_rows"), F.min(F.col("file_bytes") > 0).alias("all_sized")
    )


def read_files_query(spark: SparkSession, sf: str) -> DataFrame:
    files = input_files(scan(spark, sf, "documents"))
    return read_files(spark, files).select("doc_id", "text")


def read_lazy(spark: SparkSession, sf: str) -> DataFrame:
    docs = scan(spark, sf, "documents")
    return read_files(spark, input_files(docs), schema=docs.schema).select("doc_id", "lang", "n_chars")


def stream_read(spark: SparkSession, sf: str) -> DataFrame:
    stream = arriving(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    target = scratch_path(spark, "stream-read")
    append_stream(stream, target, scratch_path(spark, "stream-read-log"))
    return read_back(spark, target)


def ingest_query(spark: SparkSession, sf: str) -> DataFrame:
    source, target = scratch_path(spark, "ingest-source"), scratch_path(spark, "ingest-table")
    turns(spark, sf).write.json(source)
    loaded = ingest(spark, source, "json", schema="turn_key string, text string, label int")
    write_table(prepare.shuffle_rows(loaded, "turn_key"), target)
    return read_back(spark, target)


def log_history_scan(spark: SparkSession, sf: str) -> DataFrame:
    entries = log_entries(spark, sf)
    fields = ["step", "epoch", *LOG_METRICS, "train_runtime", "train_loss"]
    # A run has 20 entries.
    states = entries.groupBy("run_id").agg(
        F.max("step").alias("global_step"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", *fields))), lambda e: F.struct(*[e[f].alias(f) for f in fields])
        ).alias("log_history"),
    )
    path = scratch_path(spark, "trainer-states")
    states.write.json(path)
    read = read_log_history(spark, path, multi_line=False, schema=states.schema)
    return log_history(read, keep=["run_id"])


def write_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    target = scratch_path(spark, "overwritten")
    docs = documents(spark, sf).select("doc_id", "label")
    write_table(docs.limit(0), target)
    write_table(docs, target)
    return read_back(spark, target)


def write_append(spark: SparkSession, sf: str) -> DataFrame:
    target = scratch_path(spark, "appended")
    docs = documents(spark, sf).select("doc_id", "label")
    write_table(docs, target, mode="append")
    write_table(docs, target, mode="append")
    return read_back(spark, target)


def input_example_query(spark: SparkSession, sf: str) -> DataFrame:
    return input_example(documents(spark, sf), "text", 5, order_by="doc_id")


def model_table(spark: SparkSession, sf: str) -> DataFrame:
    model, _ = fitted(spark, documents(spark, sf), len(LANGS))
    return model.weights(spark).where(F.col("token") != bayes.TEXT_MARK)


# -- projections and array functions -----------------------------------------


def cast_label(spark: SparkSession, sf: str) -> DataFrame:
    as_text = judged(spark, sf, "quality").withColumn("label", F.col("label").cast("string"))
    return prepare.cast_label(as_text)


def project_feature(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.project_feature(table(spark, sf, "documents"), "text")


def select_configured(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.select_configured(table(spark, sf, "conversations"), "text", "role", keep=["conv_id", "turn"])


def path_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    mounted = F.regexp_replace("url", "^https?:/", "dbfs:")
    path = F.when(F.col("page_id") % 2 == 0, mounted).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", rewrite_mount_prefix(path).alias("path"))


def artifact_root(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", drop_last_segment("url").alias("artifact_root"))


def stringify_query(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("n_chars") % 7 != 0, F.col("n_chars"))
    return table(spark, sf, "documents").select("doc_id", stringify(value).alias("feature"))


def softmax_probs(spark: SparkSession, sf: str) -> DataFrame:
    probabilities = round_half_even(softmax("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", probabilities.alias("probabilities"))


def round_probs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", round_half_even("embedding").alias("rounded"))


def decode_prediction(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", round_half_even("embedding", 2).alias("probabilities"))
    return decode(rows).drop("probabilities")


def argmax_logits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", argmax("embedding").alias("predicted_class"))


# -- table preparation -------------------------------------------------------


def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.hash_split(documents(spark, sf), "text").select("doc_id", "label", "split")


def paired_splits(spark: SparkSession, sf: str) -> DataFrame:
    train, test = prepare.split_pair(documents(spark, sf), "doc_id")
    return prepare.pair_splits(train, test).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def random_split(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides together hold every row exactly once; the share is within a tenth of 0.7."""
    train, test = prepare.random_split(documents(spark, sf).select("doc_id", "label"))
    both = prepare.pair_splits(train, test)
    once = both.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("copies"), F.count(F.when(F.col("split") == "train", 1)).alias("in_train")
    )
    return once.agg(
        F.sum("copies").alias("n_rows"),
        F.max("copies").alias("most_copies"),
        (F.abs(F.sum("in_train") / F.sum("copies") - 0.7) < 0.1).alias("share_holds"),
    )


def label_audit(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.label_audit(turns(spark, sf))


def label_audit_invalid(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("lang") == "fr", "x").when(F.col("lang") != "es", (F.col("n_chars") % 5 + 1).cast("string"))
    return prepare.label_audit(table(spark, sf, "documents").select(raw.alias("label")))


def shuffle_rank(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.shuffle_rows(documents(spark, sf).select("doc_id", "label"), "doc_id")


def repartition_n(spark: SparkSession, sf: str) -> DataFrame:
    spread = prepare.repartition_for_scoring(table(spark, sf, "documents").select("text"), 7)
    return spread.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("n").alias("n_rows")
    )


def step_plan(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = prepare.split_pair(documents(spark, sf), "text")
    return prepare.step_plan(train, batch_size=64, epochs=10, parallelism=4)


# -- encoding ----------------------------------------------------------------


def build_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return encode.build_vocab(table(spark, sf, "documents"), size=None)


def encode_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return encode.encode(docs, encode.build_vocab(docs, size=None), "doc_id", max_length=MAX_LENGTH)


def encode_batched(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    vocab = encode.publish_vocab(encode.build_vocab(docs, size=None))
    both = encode.encode_batched(docs.select("doc_id", "text", "lang"), vocab, max_length=MAX_LENGTH)
    return both.select("doc_id", "lang", "input_ids", "attention_mask")


def _encoded_sides(spark: SparkSession, sf: str) -> tuple[encode.Vocabulary, DataFrame, DataFrame]:
    """A vocabulary of the train side, and both sides encoded with their integer label."""
    train, test = prepare.split_pair(documents(spark, sf), "text")
    vocab = encode.publish_vocab(encode.build_vocab(train, size=None))
    return vocab, *(encode.training_rows(side, vocab, max_length=MAX_LENGTH, keep=["doc_id"]) for side in (train, test))


def encode_training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What a model is trained and measured on: ids, mask and label of both sides."""
    _, train, test = _encoded_sides(spark, sf)
    return prepare.pair_splits(train, test)


def encode_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Raw pages, encoded with a vocabulary of other texts."""
    vocab = encode.build_vocab(table(spark, sf, "documents"), size=None)
    return encode.encode(table(spark, sf, "pages"), vocab, "page_id", text="html", max_length=MAX_LENGTH)


def encode_full_length(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    vocab = encode.publish_vocab(encode.build_vocab(docs, size=None))
    length = encode.resolve_max_length(-1, MODEL_MAX_LENGTH)
    whole = encode.encode_batched(docs, vocab, max_length=length)
    return whole.select(
        "doc_id",
        F.size("input_ids").cast("bigint").alias("n_ids"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_used"),
        F.md5(F.array_join("input_ids", " ")).alias("ids_md5"),
    )


def token_length_profile(spark: SparkSession, sf: str) -> DataFrame:
    return encode.token_length_profile(table(spark, sf, "documents"), "lang", max_length=MAX_LENGTH)


# -- training and scoring ----------------------------------------------------


def nb_weights(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = prepare.split_pair(documents(spark, sf), "text")
    vocab = written(bayes.vocabulary(bayes.fit_counts(train, len(LANGS)), len(LANGS)), "vocab")
    return bayes.bayes_weights(vocab, len(LANGS)).where(F.col("token") != bayes.TEXT_MARK)


def predictions_table(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: split, fit, score, softmax, round, decode."""
    model, test = fitted(spark, documents(spark, sf), len(LANGS))
    scored = score_counted(test, model, "text", decimals=4)
    return scored.select("doc_id", "text", "probabilities", "predicted_probability", "predicted_class")


def score_batch(spark: SparkSession, sf: str) -> DataFrame:
    model, test = fitted(spark, documents(spark, sf), len(LANGS))
    scored = scoring.score(test, scoring.bayes_predictor(spark, model), "text", mode="batch", batch_size=1000)
    return scored.select("doc_id", "text", "label", "probabilities", "predicted_probability", "predicted_class")


def score_udf(spark: SparkSession, sf: str) -> DataFrame:
    model, test = fitted(spark, documents(spark, sf), len(LANGS))
    return scoring.score(test, scoring.bayes_predictor(spark, model), "text", mode="udf", partitions=8)


def score_unlabelled(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that have no label at all, scored by join."""
    model, _ = fitted(spark, documents(spark, sf), len(LANGS))
    return bayes.score_bayes(table(spark, sf, "benchmark"), model, "item_id", decimals=4)


def score_null_literal(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of one language blanked out and scored as the word a null turns into."""
    rows = documents(spark, sf)
    model, test = fitted(spark, rows, len(LANGS))
    blanked = test.withColumn("text", F.when(F.col("label") != 0, F.col("text")))
    scored = scoring.score(
        blanked, scoring.bayes_predictor(spark, model), mode="udf", keep="all", null_policy="literal"
    )
    return scored.select("doc_id", "probabilities", "predicted_class")


def _encoded_model(spark: SparkSession, sf: str) -> tuple[encode.Vocabulary, scoring.Predictor, DataFrame]:
    """A vocabulary, a model that was trained on encoded rows, and the encoded test side."""
    vocab, train, test = _encoded_sides(spark, sf)
    rows = train.select(encode.used_ids().alias("used"), "label")
    model = bayes.fit_bayes(rows, scratch_path(spark, "encoded-model"), len(LANGS), text="used")
    return vocab, scoring.bayes_encoded_predictor(spark, model, MAX_LENGTH), test


def score_encoded(spark: SparkSession, sf: str) -> DataFrame:
    """Encode, train on the ids, score ids and masks."""
    _, predictor, test = _encoded_model(spark, sf)
    rows = test.withColumn(
        "encoded", F.when(F.col("input_ids").isNotNull(), F.struct("input_ids", "attention_mask"))
    ).drop("input_ids", "attention_mask")
    scored = scoring.score(rows, predictor, "encoded", decimals=4, empty=scoring.empty_encoding(MAX_LENGTH))
    return scored.select("doc_id", "label", "probabilities", "predicted_class")


def _score_raw(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    vocab, predictor, _ = _encoded_model(spark, sf)
    _, test = prepare.split_pair(documents(spark, sf), "text")
    whole = scoring.encoding_predictor(spark, vocab, predictor, MAX_LENGTH)
    return scoring.score(test, whole, "text", mode=mode, keep="all", decimals=4)


def score_encoding_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Raw texts, encoded inside batch scoring."""
    return _score_raw(spark, sf, "batch").select("doc_id", "text", "probabilities", "predicted_class")


def score_encoding_udf(spark: SparkSession, sf: str) -> DataFrame:
    """Raw texts, encoded inside the function that scores."""
    return _score_raw(spark, sf, "udf").select("doc_id", "text", "probabilities", "predicted_class")


def many_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Part descriptions in 50 classes, fitted on one side and predicted on the other."""
    words = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    rows = table(spark, sf, "part").select("p_partkey", words.alias("text"), (F.col("p_size") - 1).alias("label"))
    train, test = prepare.split_pair(rows, F.col("p_partkey"))
    model = bayes.fit_bayes(train, scratch_path(spark, "many-classes"), PART_SIZES)
    logits = bayes.bayes_logits(test, model, "p_partkey", carry=["label"])
    return logits.select("p_partkey", "label", argmax("logits").alias("predicted_class"))


def score_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """A user model on dense vectors: nearest class centroid."""
    vectors = table(spark, sf, "embeddings")
    centroids = fit_centroids(vectors, "embedding", "label")
    scored = scoring.score(
        vectors, centroid_predictor(centroids), "embedding", empty=F.array_repeat(F.lit(0.0).cast("float"), centroids.shape[1])
    )
    return scored.select("vec_id", "label", "predicted_class")


def score_and_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    model, test = fitted(spark, documents(spark, sf), len(LANGS))
    scored = scoring.score(test, scoring.bayes_predictor(spark, model), "text", mode="batch")
    row = metrics.weighted_metrics(metrics.confusion_matrix(scored))
    return row.select(_six("f1", "f1"), _six("precision", "precision"), _six("recall", "recall"), "n_rows")


def _promoted(spark: SparkSession, sf: str) -> tuple[runs.RunStore, dict[str, str]]:
    """A run that is trained, registered and promoted, and the parameters of a job that scores the test side."""
    train, test = prepare.split_pair(documents(spark, sf), "text")
    store = runs.RunStore(spark, scratch_path(spark, "store"))
    config = TrainingConfig(model_type="bayes", num_labels=len(LANGS))
    run_id = run_training(spark, config, store, train, test)
    store.move("language", store.register("language", run_id), "Production")
    source = scratch_path(spark, "job-input")
    write_table(test, source)
    names = {"model_name": "language", "input_table": source, "output_table": scratch_path(spark, "job-output")}
    return store, {**names, "batch_size": "2000"}


def scoring_job(spark: SparkSession, sf: str) -> DataFrame:
    """Train, register, promote, score a table by stage, read the written predictions."""
    store, params = _promoted(spark, sf)
    job = ScoringJob.from_params({**params, "batch_inference": "True"})
    return run_scoring(spark, job, store).select("doc_id", "label", "predicted_class")


def scoring_job_udf(spark: SparkSession, sf: str) -> DataFrame:
    """The job in its other mode, run twice, the second one appending."""
    store, params = _promoted(spark, sf)
    params |= {"batch_inference": "False", "df_repartition_num": "5", "write_mode": "append"}
    for _ in range(2):
        written = run_scoring(spark, ScoringJob.from_params(params), store)
    return written


def catalog_table(spark: SparkSession, sf: str) -> DataFrame:
    """A managed table, overwritten, appended to and read by name."""
    name = f"lexmill_{uuid.uuid4().hex}"
    docs = documents(spark, sf).select("doc_id", "label")
    write_table(docs, name)
    write_table(docs, name)
    write_table(docs, name, mode="append")
    return read_table(spark, name)


def _softmax_run(spark: SparkSession, sf: str, **options):
    train, test = prepare.split_pair(documents(spark, sf), "text")
    path = scratch_path(spark, "softmax")
    return test, *fit_softmax(train, test, path, len(LANGS), "doc_id", batch_size=SOFTMAX_BATCH, **options)


def softmax_fit_predict(spark: SparkSession, sf: str) -> DataFrame:
    test, model, _ = _softmax_run(spark, sf, epochs=3)
    return scoring.score(test, softmax_predictor(spark, model)).select("doc_id", "label", "probabilities", "predicted_class")


def epoch_log(spark: SparkSession, sf: str) -> DataFrame:
    """Log of a run that reads its table anew each epoch within a step budget."""
    train, _ = prepare.split_pair(documents(spark, sf), "text")
    workers = spark.sparkContext.defaultParallelism
    budget = prepare.step_plan(train, SOFTMAX_BATCH, epochs=2, parallelism=workers).first()["max_steps"]
    _, _, state = _softmax_run(spark, sf, epochs=2, lazy=True, max_steps=max(1, budget))
    return log_history(read_log_history(spark, f"{state.path}/trainer_state", multi_line=False))


def softmax_quality(spark: SparkSession, sf: str) -> DataFrame:
    """What holds of every run: each test row is predicted once, and better than by the largest class."""
    scored = softmax_fit_predict(spark, sf)
    found = metrics.weighted_metrics(metrics.confusion_matrix(scored))
    n_ids = scored.agg(F.count_distinct("doc_id")).scalar()
    return found.select("n_rows", (F.col("f1") > F.col("majority_f1")).alias("beats_majority"), n_ids.alias("n_ids"))


def epoch_log_shape(spark: SparkSession, sf: str) -> DataFrame:
    """What holds of every log: two entries an epoch, one of them an evaluation with its loss, rising steps, runtime last."""
    _, _, state = _softmax_run(spark, sf, epochs=3, parallelism=4)
    log = log_history(read_log_history(spark, f"{state.path}/trainer_state", multi_line=False))
    last = F.max_by("train_runtime", "pos")
    steps = F.transform(F.array_sort(F.collect_list(F.struct("pos", "step"))), lambda e: e["step"])  # seven entries
    return log.agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.count("eval_f1").alias("n_evaluations"),
        F.count("eval_loss").alias("n_losses"),
        F.count_distinct(F.when(F.col("eval_f1").isNotNull(), F.col("epoch"))).alias("n_epochs"),
        (F.array_sort(steps) == steps).alias("steps_rise"),
        (last > 0).alias("runtime_last"),
        (F.count("train_runtime") == 1).alias("runtime_once"),
    )


def step_evaluations(spark: SparkSession, sf: str) -> DataFrame:
    """A run evaluated a number of times an epoch, by steps."""
    train, _ = prepare.split_pair(documents(spark, sf), "text")
    per_epoch = -(-train.count() // (SOFTMAX_BATCH * 2))
    _, _, state = _softmax_run(spark, sf, epochs=2, parallelism=2, eval_steps=-(-per_epoch // 3))
    log = log_history(read_log_history(spark, f"{state.path}/trainer_state", multi_line=False))
    return log.agg(F.count("eval_f1").alias("n_evaluations"), F.max("epoch").alias("epochs"))


def step_budget(spark: SparkSession, sf: str) -> DataFrame:
    """A run over the table's own partitions, in lots of unlike size, with two workers' steps: it is as long as planned."""
    train, test = prepare.split_pair(documents(spark, sf), "text")
    planned = prepare.step_plan(train, SOFTMAX_BATCH, epochs=4, parallelism=2).first()
    plan = planned["max_steps"]
    path = scratch_path(spark, "softmax")
    options = {"batch_size": SOFTMAX_BATCH, "epochs": 4, "parallelism": 2, "lazy": True, "max_steps": plan}
    source = scratch_path(spark, "lots")
    lot = F.when(F.col("doc_id") % 7 < 4, 0).otherwise(F.col("doc_id") % 7)
    # A large table has several of each lot, so that none grows with it.
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(spread(planned["n_rows"], 1)))
    train.repartition(lot, share).write.parquet(source)
    _, state = fit_softmax(read_back(spark, source), test, path, len(LANGS), "doc_id", **options)
    log = log_history(read_log_history(spark, f"{state.path}/trainer_state", multi_line=False))
    return log.agg(
        F.lit(plan).cast("bigint").alias("max_steps"),
        F.count("eval_f1").alias("n_evaluations"),
        (F.abs(F.max("step") - F.lit(plan)) <= 1).alias("spent"),
    )


def resumed_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run of three epochs, cut after two and resumed, against one that went through."""
    train, test = prepare.split_pair(documents(spark, sf), "text")
    options = {"batch_size": SOFTMAX_BATCH, "parallelism": 4, "save_total_limit": 2}
    paths = scratch_path(spark, "resumed"), scratch_path(spark, "whole")
    fit_softmax(train, test, paths[0], len(LANGS), "doc_id", epochs=2, **options)
    found = []
    for path in paths:
        model, state = fit_softmax(train, test, path, len(LANGS), "doc_id", epochs=3, resume=True, **options)
        log = log_history(read_log_history(spark, f"{state.path}/trainer_state", multi_line=False))
        scored = scoring.score(test, softmax_predictor(spark, model)).select("doc_id", "predicted_class")
        found.append((log.where("eval_f1 is not null").select("step", "epoch", _six("eval_f1", "eval_f1")), scored))
    (log, scored), (whole_log, whole) = found
    return log.agg(
        F.count(F.lit(1)).alias("n_evaluations"),
        (log.exceptAll(whole_log).agg(F.count(F.lit(1))).scalar() == 0).alias("same_log"),
        (scored.exceptAll(whole).agg(F.count(F.lit(1))).scalar() == 0).alias("same_predictions"),
    )


def sweep_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    train, test = prepare.split_pair(documents(spark, sf), "text")
    store = runs.RunStore(spark, scratch_path(spark, "sweep"))
    configs = [
        TrainingConfig(model_type="bayes", num_labels=len(LANGS), max_vocab=size, experiment_location="lang")
        for size in SWEEP_SIZES
    ]
    run_sweep(spark, configs, store, train, test, side_by_side=2)
    board = store.leaderboard("eval_f1")
    return board.select("experiment", "run_name", _six("eval_f1", "eval_f1"), "place")


# -- metrics -----------------------------------------------------------------


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(predicted(spark, turns(spark, sf), "turn_key", len(ROLES)))


def per_class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    cells = metrics.confusion_matrix(predicted(spark, judged(spark, sf, "quality"), "doc_id", 2))
    rows = metrics.per_class_metrics(cells)
    return rows.select("class", _six("precision", "precision"), _six("recall", "recall"), _six("f1", "f1"), "support")


def weighted_metrics(spark: SparkSession, sf: str) -> DataFrame:
    cells = metrics.confusion_matrix(predicted(spark, judged(spark, sf, "toxic"), "doc_id", 2))
    row = metrics.weighted_metrics(cells)
    names = ("f1", "precision", "recall", "majority_f1")
    return row.select(*[_six(n, n) for n in names], "n_rows")


def log_loss(spark: SparkSession, sf: str) -> DataFrame:
    model, test = fitted(spark, turns(spark, sf), len(ROLES))
    logits = bayes.bayes_logits(test, model, "turn_key", carry=["label"])
    return metrics.log_loss(logits, scale=bayes.MICRO).select(F.round("log_loss", 4).alias("log_loss"), "n_rows")


# -- runs and versions -------------------------------------------------------


def best_metrics(spark: SparkSession, sf: str) -> DataFrame:
    entries = log_entries(spark, sf)
    evals = entries.withColumn("metric", F.col("eval_f1"))
    best_step = (F.col("best_epoch") * 100).cast("bigint").alias("best_step")
    best = runs.best_checkpoint(evals, metric="metric").select("run_id", best_step)
    return runs.best_metrics(entries.join(best, "run_id"), LOG_METRICS, "eval_f1")


def best_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    return runs.best_checkpoint(log_entries(spark, sf).withColumn("metric", F.col("eval_f1")))


def checkpoint_retention(spark: SparkSession, sf: str) -> DataFrame:
    epochs = log_entries(spark, sf).where("eval_f1 is not null")
    per_epoch = epochs.groupBy("run_id", "epoch").agg(F.max("eval_f1").alias("metric"))
    return runs.checkpoint_retention(per_epoch, limit=3)


def run_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    scored = table(spark, sf, "events").select(
        F.col("event_type").alias("experiment"), F.col("event_id").alias("run_id"), (F.col("value") / 1000).alias("f1")
    )
    return runs.run_leaderboard(scored, "f1")


def run_log_append(spark: SparkSession, sf: str) -> DataFrame:
    """Run records of every user's events, appended in two batches and read back."""
    store = runs.RunStore(spark, scratch_path(spark, "runs"))
    events = table(spark, sf, "events")
    records = events.groupBy("user_id").agg(F.max("value").alias("best"), F.count(F.lit(1)).alias("n")).select(
        F.lit("events").alias("experiment"),
        F.col("user_id").cast("string").alias("run_id"),
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_name"),
        F.current_timestamp().alias("logged_at"),
        F.create_map(F.lit("f1"), F.col("best"), F.lit("n"), F.col("n").cast("double")).alias("metrics"),
        F.create_map(F.lit("streaming_read"), (F.col("user_id") % 2 == 0).cast("string")).alias("params"),
    )
    is_even = F.col("params")["streaming_read"] == "true"
    store.log_runs(records.where(is_even))
    store.log_runs(records.where(~is_even))
    logged = store.runs()
    return logged.select(
        "experiment",
        "run_id",
        "run_name",
        F.col("metrics")["f1"].alias("f1"),
        F.col("metrics")["n"].alias("n"),
        F.col("params")["streaming_read"].alias("streaming_read"),
    )


def current_stage(spark: SparkSession, sf: str) -> DataFrame:
    return runs.current_stages(stage_events(spark, sf))


def resolve_stage(spark: SparkSession, sf: str) -> DataFrame:
    events = stage_events(spark, sf)
    return runs.versions_in_stage(model_versions(events), events, "Production")


# -- streams -----------------------------------------------------------------


def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    stream = arriving(spark, sf, "documents").select("text", class_index("lang", LANGS).alias("label"))
    path = scratch_path(spark, "stream-counts")
    stream_token_counts(stream, path, scratch_path(spark, "stream-counts-log"))
    return summed_counts(spark, path).where(F.col("token") != bayes.TEXT_MARK)


def stream_score(spark: SparkSession, sf: str) -> DataFrame:
    model, _ = fitted(spark, documents(spark, sf), len(LANGS))
    stream = arriving(spark, sf, "documents").select("doc_id", "text")
    scored = score_stream(stream, scoring.bayes_predictor(spark, model))
    target = scratch_path(spark, "stream-score")
    append_stream(scored.drop("text"), target, scratch_path(spark, "stream-score-log"))
    return read_back(spark, target)


def stream_score_large(spark: SparkSession, sf: str) -> DataFrame:
    """Arriving texts scored by joining each batch to the weights, none of which a worker holds."""
    model, _ = fitted(spark, documents(spark, sf), len(LANGS))
    target = scratch_path(spark, "stream-score-large")
    stream = arriving(spark, sf, "documents").select("doc_id", "text")
    score_stream_by_join(stream, model, target, scratch_path(spark, "stream-score-large-log"), "doc_id")
    return read_batches(spark, target).drop("text", "batch_id")


def stream_follow_stage(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that arrive in two lots; between them another version moves to the stage."""
    store = runs.RunStore(spark, scratch_path(spark, "store"))
    train, test = prepare.split_pair(documents(spark, sf), "text")
    config = TrainingConfig(model_type="bayes", num_labels=len(LANGS))
    reversed_labels = train.withColumn("label", F.lit(len(LANGS) - 1) - F.col("label"))
    versions = []
    for rows in (train, reversed_labels):
        run_id = run_training(spark, config, store, rows, test)
        versions.append(store.register("language", run_id))
    source, target, log = (scratch_path(spark, f"stage-{n}") for n in ("source", "target", "log"))
    for lot, version in enumerate(versions):
        store.move("language", version, "Production")
        table(spark, sf, "documents").where(F.col("doc_id") % 2 == lot).select("doc_id", "text").write.mode("append").parquet(source)
        stream = read_arriving(spark, source)
        score_stream_by_stage(stream, store, "language", lambda run_id: run_predictor(store, run_id), target, log)
    return read_batches(spark, target).select("doc_id", "model_version", "predicted_class")


QUERIES: dict[str, Query] = {
    "scan_table": scan_table,
    "file_manifest": file_manifest_query,
    "read_files": read_files_query,
    "read_lazy": read_lazy,
    "stream_read": stream_read,
    "ingest": ingest_query,
    "log_history_scan": log_history_scan,
    "write_overwrite": write_overwrite,
    "write_append": write_append,
    "input_example": input_example_query,
    "model_table": model_table,
    "cast_label": cast_label,
    "project_feature": project_feature,
    "select_configured": select_configured,
    "path_rewrite": path_rewrite,
    "artifact_root": artifact_root,
    "stringify": stringify_query,
    "softmax_probs": softmax_probs,
    "round_probs": round_probs,
    "decode_prediction": decode_prediction,
    "argmax_logits": argmax_logits,
    "hash_split": hash_split,
    "paired_splits": paired_splits,
    "random_split": random_split,
    "label_audit": label_audit,
    "label_audit_invalid": label_audit_invalid,
    "shuffle_rank": shuffle_rank,
    "repartition_n": repartition_n,
    "step_plan": step_plan,
    "build_vocab": build_vocab,
    "encode_text": encode_text,
    "encode_batched": encode_batched,
    "encode_training_rows": encode_training_rows,
    "encode_pages": encode_pages,
    "encode_full_length": encode_full_length,
    "token_length_profile": token_length_profile,
    "nb_weights": nb_weights,
    "predictions_table": predictions_table,
    "score_batch": score_batch,
    "score_udf": score_udf,
    "score_unlabelled": score_unlabelled,
    "score_null_literal": score_null_literal,
    "score_encoded": score_encoded,
    "score_encoding_batch": score_encoding_batch,
    "score_encoding_udf": score_encoding_udf,
    "many_classes": many_classes,
    "score_vectors": score_vectors,
    "score_and_evaluate": score_and_evaluate,
    "scoring_job": scoring_job,
    "scoring_job_udf": scoring_job_udf,
    "catalog_table": catalog_table,
    "softmax_fit_predict": softmax_fit_predict,
    "epoch_log": epoch_log,
    "softmax_quality": softmax_quality,
    "epoch_log_shape": epoch_log_shape,
    "step_evaluations": step_evaluations,
    "step_budget": step_budget,
    "resumed_run": resumed_run,
    "sweep_leaderboard": sweep_leaderboard,
    "confusion_matrix": confusion_matrix,
    "per_class_metrics": per_class_metrics,
    "weighted_metrics": weighted_metrics,
    "log_loss": log_loss,
    "best_metrics": best_metrics,
    "best_checkpoint": best_checkpoint,
    "checkpoint_retention": checkpoint_retention,
    "run_leaderboard": run_leaderboard,
    "run_log_append": run_log_append,
    "current_stage": current_stage,
    "resolve_stage": resolve_stage,
    "stream_counts": stream_counts,
    "stream_score": stream_score,
    "stream_score_large": stream_score_large,
    "stream_follow_stage": stream_follow_stage,
}

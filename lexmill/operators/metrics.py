"""Evaluation metrics from (label, predicted_class) frames.

Rows are counted per (label, prediction) cell first, combined map-side; all that
follows works on at most num_labels**2 cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.functions import negative_log_likelihood


def confusion_matrix(
    scored: DataFrame, label: str = "label", prediction: str = "predicted_class", loss: Column | None = None
) -> DataFrame:
    """(label, predicted_class, n) of the cells that occur, and the summed ``loss`` of their rows if given."""
    sums = [F.count(F.lit(1)).alias("n")] + ([] if loss is None else [F.sum(loss).alias("loss")])
    return scored.groupBy(
        F.col(label).cast("bigint").alias("label"), F.col(prediction).cast("bigint").alias("predicted_class")
    ).agg(*sums)


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole in doubles, 0 where undefined."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def _class_totals(cells: DataFrame) -> DataFrame:
    """(class, support, predicted, tp) and, where cells have it, the summed loss of the class's rows."""
    none = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("predicted_class"), F.col("n")).otherwise(0)
    # Each cell speaks for the class it is labelled with and the one it is predicted as.
    labelled = {"class": F.col("label"), "support": F.col("n"), "predicted": none, "tp": hit}
    predicted = {"class": F.col("predicted_class"), "support": none, "predicted": F.col("n"), "tp": none}
    if "loss" in cells.columns:
        labelled["loss"], predicted["loss"] = F.col("loss"), F.lit(0.0)
    sides = F.array(*[F.struct(*[c.alias(n) for n, c in side.items()]) for side in (labelled, predicted)])
    sums = [F.sum(name).alias(name) for name in labelled if name != "class"]
    return cells.select(F.inline(sides)).where(F.col("class").isNotNull()).groupBy("class").agg(*sums)


def per_class_metrics(cells: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) for every class labelled or predicted, and loss if cells have it."""
    totals = _class_totals(cells)
    loss = ["loss"] if "loss" in totals.columns else []
    rates = totals.select(
        "class",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        "support",
        *loss,
    )
    f1 = _ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rates.select("class", "precision", "recall", f1.alias("f1"), "support", *loss)


def weighted_metrics(cells: DataFrame) -> DataFrame:
    """One row: support-weighted f1, precision and recall, the f1 of a majority guess, and the mean loss if known.

    The majority figure shows how much of a score class imbalance alone explains.
    """
    classes = per_class_metrics(cells)
    support = F.sum("support")
    mean = lambda name: _ratio(F.sum(F.col(name) * F.col("support")), support).alias(name)
    # Guessing the largest class: its precision is its share p, its recall 1, the others' 0.
    share = _ratio(F.max("support"), support)
    return classes.agg(
        mean("f1"),
        mean("precision"),
        mean("recall"),
        (share * 2.0 * share / (1.0 + share)).alias("majority_f1"),
        support.alias("n_rows"),
        *([_ratio(F.sum("loss"), support).alias("loss")] if "loss" in classes.columns else []),
    )


def evaluate(
    scored: DataFrame, label: str = "label", prediction: str = "predicted_class", loss: Column | None = None
) -> dict[str, float]:
    """Weighted metrics of a scored table, and its mean ``loss`` if given, in one pass over the table."""
    row = weighted_metrics(confusion_matrix(scored, label, prediction, loss)).first()
    return row.asDict()


def log_loss(scored: DataFrame, logits: str = "logits", label: str = "label", scale: float = 1.0) -> DataFrame:
    """One row: mean cross-entropy over the rows that have both logits and a label."""
    loss = negative_log_likelihood(logits, label, scale)
    return scored.agg(F.avg(loss).alias("log_loss"), F.count(loss).alias("n_rows"))

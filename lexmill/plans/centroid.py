"""A sample user model for dense vectors (nearest centroid), scored through the model interface."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lexmill.operators.scoring import Predictor, batch_model, stable_softmax

MAX_CENTROID_VALUES = 4_000_000


def fit_centroids(df: DataFrame, vector: str, label: str) -> np.ndarray:
    """(num_labels, width) means of the vectors of every class, one aggregated row per class and place.

    The result holds ``num_labels * width`` numbers, whatever the table's size.
    """
    places = df.select(label, F.posexplode(vector).alias("pos", "x"))
    means = places.groupBy(label, "pos").agg(F.avg("x").alias("x"))
    rows = means.limit(MAX_CENTROID_VALUES + 1).toPandas()
    if len(rows) > MAX_CENTROID_VALUES:
        raise ValueError("too many classes or too wide vectors for centroids")
    return rows.pivot(index=label, columns="pos", values="x").sort_index().to_numpy()


def centroid_predictor(centroids: np.ndarray) -> Predictor:
    """Softmax over negative squared distances to the centroids."""

    def make_predict_fn():
        norms = (centroids**2).sum(axis=1)

        def predict(vectors: np.ndarray) -> np.ndarray:
            points = vectors.astype(np.float64)
            return stable_softmax(2.0 * points @ centroids.T - norms).astype(np.float32)

        return predict

    return batch_model(make_predict_fn, tensor_shape=[centroids.shape[1]])

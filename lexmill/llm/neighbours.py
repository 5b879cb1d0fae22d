"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked exactly.

Vectors are brought to length one, where the largest cosine is the smallest
distance. Each of ``TABLES`` tables cuts ``FUNCTIONS`` Gaussian projections into
cells of ``WIDTH``; the cells together name a bucket. A query looks into its own
bucket and into those whose perturbation of the cells is most likely to hold a
near vector: the squared distances to the crossed borders, smallest sum first.
What the tables find is compared by exact cosines, in blocks.

Parameters are fixed; nothing is fitted. Cell widths suit vectors of length one.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lexmill.llm.shared import kept

TABLES, FUNCTIONS, WIDTH, PROBES = 8, 6, 1.5, 100
SEED = 11
#: Vectors of a bucket that stand in one block, rows of a group of blocks, and queries that meet a group at once (about).
BLOCK, GROUP, QUERIES = 4096, 20_000, 20_000
#: Queries whose probes one task works out.
PROBING = 200


def _functions(table: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, table, dim])
    return rng.normal(size=(dim, FUNCTIONS)), rng.uniform(0, WIDTH, size=FUNCTIONS)


def _positions(vectors: np.ndarray, table: int) -> np.ndarray:
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    a, b = _functions(table, vectors.shape[1])
    return (unit @ a + b) / WIDTH


def _bucket(cells: np.ndarray, table: int) -> np.ndarray:
    """One number for the cells of each row."""
    out = np.full(len(cells), table, np.int64)
    for i in range(cells.shape[1]):
        out = (out * np.int64(1_000_003)) ^ (cells[:, i].astype(np.int64) + np.int64(0x5BD1E995))
    return out


def probe_order(inside: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """Perturbations of a bucket in order of estimated success, the unperturbed one first.

    ``inside`` has the place of the query within each of its cells, from 0 to 1.
    Sets of steps grow from the cheapest single step by shifting and extending, so
    that the smallest sum of squared border distances always comes next.
    """
    m = len(inside)
    steps = sorted([(inside[j] ** 2, j, -1) for j in range(m)] + [((1 - inside[j]) ** 2, j, 1) for j in range(m)])
    found: list[list[tuple[int, int]]] = [[]]
    heap = [(steps[0][0], (0,))]
    while heap and len(found) < probes:
        cost, chosen = heapq.heappop(heap)
        if len({steps[i][1] for i in chosen}) == len(chosen):
            found.append([steps[i][1:] for i in chosen])
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (cost + steps[last + 1][0], (*chosen, last + 1)))
            heapq.heappush(heap, (cost - steps[last][0] + steps[last + 1][0], (*chosen[:-1], last + 1)))
    return found


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and v (array of doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _index(rows: DataFrame) -> DataFrame:
    """(vec_id, v, table, bucket): every vector once a table."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chosen in _by_length(batch.column("v")):
                part = batch.take(chosen)
                dim = len(part.column("v")[0])
                x = _matrix(part.column("v"), dim)
                for t in range(TABLES):
                    buckets = _bucket(np.floor(_positions(x, t)), t)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("vec_id"), part.column("v"), pa.array(np.full(len(x), t, np.int32)), pa.array(buckets)],
                        ["vec_id", "v", "table", "bucket"],
                    )

    return rows.mapInArrow(compute, "vec_id long, v array<double>, table int, bucket long")


def _probes(rows: DataFrame) -> DataFrame:
    """(vec_id, table, bucket): what each query looks into."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chosen in _by_length(batch.column("v")):
                part = batch.take(chosen)
                ids = part.column("vec_id").to_numpy()
                x = _matrix(part.column("v"), len(part.column("v")[0]))
                for t in range(TABLES):
                    places = _positions(x, t)
                    cells = np.floor(places)
                    for i, order in enumerate(probe_order(p, PROBES) for p in places - cells):
                        near = np.repeat(cells[i : i + 1], len(order), axis=0)
                        for k, steps in enumerate(order):
                            for j, step in steps:
                                near[k, j] += step
                        buckets = _bucket(near, t)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(buckets), ids[i])),
                                pa.array(np.full(len(buckets), t, np.int32)),
                                pa.array(buckets),
                            ],
                            ["vec_id", "table", "bucket"],
                        )

    return rows.mapInArrow(compute, "vec_id long, table int, bucket long").distinct()


def _by_length(lists: pa.ListArray) -> list[pa.Array]:
    """Row numbers by vector length: vectors of different lengths are not compared."""
    lengths = np.diff(lists.offsets.to_numpy())
    return [pa.array(np.flatnonzero(lengths == n)) for n in np.unique(lengths)]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` and ``b``, the same for equal pairs wherever they are computed."""
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def _best(query_ids, queries, ids, vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k nearest in one block, ties to smaller ids."""
    rough = (queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ (
        vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    ).T
    rough[query_ids[:, None] == ids[None, :]] = -9
    keep = min(k, rough.shape[1])
    kth = np.partition(rough, -keep, axis=1)[:, -keep]
    q, v = np.nonzero((rough >= kth[:, None] - 1e-9) & (rough > -8))
    score = cosine(queries[q], vectors[v])
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    top = nth < k
    return query_ids[q[top]], ids[v[top]], score[top]


def _compare(k: int):
    """The nearest of each query in a group of blocks; a query without a list of blocks looks at all."""

    def compute(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(left) and len(right):
            wanted = right[["vec_id", "blocks"]].explode("blocks") if right["blocks"].notna().any() else None
            spots = {i: n for n, i in enumerate(right["vec_id"])}
            asked = None if wanted is None else {b: g.to_numpy() for b, g in wanted.groupby("blocks")["vec_id"]}
            lengths, query_lengths = left["v"].map(len), right["v"].map(len)
            for block, rows in left.groupby("block").indices.items():
                who = right["vec_id"].to_numpy() if asked is None else asked.get(block)
                if who is None:
                    continue
                at = np.array([spots[i] for i in who])
                for n in lengths.iloc[rows].unique():
                    mine = rows[(lengths.iloc[rows] == n).to_numpy()]
                    theirs = at[(query_lengths.iloc[at] == n).to_numpy()]
                    if not len(theirs):
                        continue
                    ids, x = left["vec_id"].to_numpy()[mine], np.stack(left["v"].to_numpy()[mine])
                    for part in np.array_split(theirs, -(-len(theirs) // 1024)):
                        queries = np.stack(right["v"].to_numpy()[part])
                        out.append(_best(right["vec_id"].to_numpy()[part], queries, ids, x, k))
        q, v, s = (np.concatenate(x) for x in zip(*out, strict=True))
        found = pd.DataFrame({"query_id": q, "vec_id": v, "score": s})
        found = found.drop_duplicates(["query_id", "vec_id"]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return found.groupby("query_id", sort=False).head(k)

    return compute


FOUND = "query_id long, vec_id long, score double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id is divisible by ``every``.

    Rows without an id, null, empty and zero vectors and those with null or
    non-finite components take no part. Vectors of other lengths than the query's
    are no candidates. Rows that share an id are candidates for others, not for each
    other, and appear once with their best score. Large buckets are cut into blocks
    of about ``BLOCK`` rows, and a group of blocks meets the queries that ask for it in
    parts, so no task holds a bucket or all queries. A query that found fewer than
    k looks at all vectors, block by block. An empty table gives an empty result.
    """
    rows = kept(usable(vectors, vector), "nn-vectors")
    queries = kept(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), "nn-queries")
    index = kept(_index(rows), "nn-index")
    sizes = kept(
        index.groupBy("table", "bucket").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("parts"), F.count("*").alias("n")),
        "nn-buckets",
    )
    total = sizes.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // GROUP))
    meeting = ["g", "query_part"]
    block = F.xxhash64("table", "bucket", "part")
    indexed = (
        index.join(sizes, ["table", "bucket"])
        .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
        .select("vec_id", "v", "table", block.alias("block"))
        .withColumn("g", F.pmod("block", F.lit(groups)))
    )
    spread = queries.repartition(max(1, -(-queries.count() // PROBING)))
    asking = (
        _probes(spread)
        .join(sizes, ["table", "bucket"])
        .withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        .select("vec_id", block.alias("block"))
        .withColumn("g", F.pmod("block", F.lit(groups)))
        .groupBy("g", "vec_id")
        .agg(F.collect_list("block").alias("blocks"))
    )
    asking = kept(asking, "nn-asking")
    # A group of blocks is repeated only as often as the queries that ask for it fill parts.
    shares = F.expr(f"cast(ceil(count(*) / {QUERIES}) as int)").alias("query_parts")
    query_parts = kept(asking.groupBy("g").agg(shares), "nn-parts")
    query_part = F.pmod(F.xxhash64("vec_id"), F.col("query_parts")).cast("int").alias("query_part")
    each_part = F.explode(F.expr("sequence(0, query_parts - 1)"))
    blocks = indexed.join(query_parts, "g").withColumn("query_part", each_part).drop("query_parts")
    asked = asking.join(query_parts, "g").join(queries, "vec_id").select("g", query_part, "vec_id", "v", "blocks")
    first = kept(blocks.groupBy(*meeting).cogroup(asked.groupBy(*meeting)).applyInPandas(_compare(k), FOUND), "nn-found")
    enough = _ranked(first, k).groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = kept(queries.join(enough, queries["vec_id"] == enough["query_id"], "left_anti"), "nn-short")
    found = first
    n_short = short.count()
    if n_short:
        parts = F.lit(-(-n_short // QUERIES)).alias("query_parts")
        short = short.select("vec_id", "v", parts).select(
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"),
            query_part,
            "vec_id",
            "v",
            F.lit(None).cast("array<long>").alias("blocks"),
        )
        whole = indexed.where("table = 0").select("*", parts).withColumn("query_part", each_part).drop("query_parts")
        found = first.unionAll(whole.groupBy(*meeting).cogroup(short.groupBy(*meeting)).applyInPandas(_compare(k), FOUND))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Exact integer k-means that keeps the dot products of vectors and centroids between rounds.

Every vector is stored with its dot product to each centroid. A round changes some components of some
centroids; for centroid c with changes d the products grow by ``sum(x[j] * d[j])`` over the components that
changed, so nothing is multiplied again where a centroid stands still. ``|x - c|^2`` differs between
centroids by ``|c|^2 - 2 x.c`` only, so the nearest one follows from the products alone. All numbers are
integers and no sum is rounded. The products are written to the shared folder each round and the table
before is deleted; the driver holds the centroids and their sums, k rows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tagmill.operators.common import shared_folder

K, ROUNDS, COMPONENTS, SCALE, SEED = 8, 10, 64, 1024, 3
# Components beyond it could overflow a long in a squared distance.
LARGEST = 1 << 27


def _write(df: DataFrame) -> str:
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def integer_vectors(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``x``, the integers ``floor(scale * component)``, of vectors with exactly
    ``components`` components, none of them null, infinite or not a number."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(e, lambda v: F.floor(v.cast("double") * scale).cast("int"))
    return vectors.where(F.size(e) == components).where(finite).select("vec_id", whole.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def update_products(x: np.ndarray, products: np.ndarray, changes: np.ndarray) -> np.ndarray:
    """``products`` (n x k) after centroids moved by ``changes`` (k x components)."""
    products = products.copy()
    for c, change in enumerate(changes):
        at = np.flatnonzero(change)
        if len(at):
            products[:, c] += x[:, at] @ change[at]
    return products


def nearest(products: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector; of equally near ones the smallest number."""
    return np.argmin((centroids * centroids).sum(1) - 2 * products, axis=1)


def _moved(state: DataFrame, centroids: np.ndarray, changes: np.ndarray) -> DataFrame:
    """The state after a move of the centroids: ``products`` updated, ``cluster`` assigned anew."""
    k, width = centroids.shape
    first = "products" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} after scaling: its distances may not fit a long")
            old = np.zeros((len(x), k), np.int64) if first else _matrix(batch.column("products"), k)
            products = update_products(x, old, changes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(products.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), lists, pa.array(nearest(products, centroids).astype(np.int32))], ["vec_id", "x", "products", "cluster"])

    kind = state.schema["vec_id"].dataType.simpleString()
    return state.select("vec_id", "x", *([] if first else ["products"])).mapInArrow(run, f"vec_id {kind}, x array<int>, products array<bigint>, cluster int")


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; an empty cluster keeps its centroid."""
    k, width = centroids.shape
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(j))).alias(f"s{j}") for j in range(width)])
    out = centroids.copy()
    for row in sums.collect():  # k rows
        out[row.cluster] = [row[f"s{j}"] // row.n for j in range(width)]
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per kept vector of ``vectors`` (vec_id, embedding): ``vec_id, cluster, distance``
    (squared), ``cluster_inertia, inertia`` and ``centroid_sha256`` of its centroid.

    Centroids start as the ``k`` vectors with the smallest sha256 of ``seed:vec_id`` (then the smallest
    components; a null id comes last), or as many as there are. Vectors of another length or with a
    null or non-finite component are left out; each repeated row counts; equal distances go to the smaller
    number; empty clusters keep their centroid. Components beyond 2^27 after scaling raise an error,
    since their distances may not fit a long. An empty table gives an empty one; other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = spark.read.parquet(_write(integer_vectors(vectors, components, scale)))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = kept.orderBy(key.asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([r.x for r in start], np.int64).reshape(-1, components)
    state, path, changes = kept, None, centroids
    for n in range(rounds + 1):
        if n and not changes.any():
            break  # no centroid moved, so no later round changes anything
        old, path = path, _write(_moved(state, centroids, changes))
        state = spark.read.parquet(path)
        if old:
            _delete(spark, old)
        if n < rounds:
            means = _means(state, centroids)
            changes, centroids = means - centroids, means
    # the loop may end after a move that changed nothing, so products and centroids agree here
    norms = F.get(F.array(*[F.lit(int(c @ c)) for c in centroids] or [F.lit(0)]), F.col("cluster")).cast("long")
    own = F.aggregate("x", F.lit(0).cast("long"), lambda t, v: t + v.cast("long") * v)
    distance = own + norms - 2 * F.get("products", F.col("cluster"))
    placed = state.select("vec_id", "cluster", distance.cast("long").alias("distance"))
    inertia = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), digest(centroid)) for c, centroid in enumerate(centroids)]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Embedding whitening from an exact scatter matrix.

1. Each entry c becomes the integer floor(1024 c) + 100000, in the JVM.
2. A map takes the residues of its rows (and of a column of ones) modulo several
   primes and multiplies them, residue matrix by residue matrix, in doubles: with
   primes below 2 ** 20 and ``ROWS`` rows at once every product is an integer
   below 2 ** 53, so nothing is rounded.  The residues of all partitions are
   summed by (prime, place), a fixed number of keys.
3. The sums are put together by the Chinese remainder theorem into the exact
   count n, sums S and scatter G.  n G - S S' is the scatter about the mean times
   n, an integer matrix in which nothing cancels; over n * n it is the
   covariance, rounded once, and goes to a symmetric eigensolver.
4. Rows are projected from n x - S, in integers as well.  The covariance of what
   comes out is measured over all rows with Spark's own aggregates.

The driver holds d x d matrices of the d dimensions, and nothing that grows with
the rows.

Defined cases: a null vector, one with a null, NaN or infinite entry, and one
with an entry too large for a long after scaling are dropped; so are vectors of
another length than the most frequent (of equally frequent ones the longest);
repeated rows and rows without a vec_id count as rows of their own;
``deviation`` is null where it exceeds a long; components whose eigenvalue is
zero to working precision are left out, so a table of one row, or of equal
vectors, gives no rows, and neither does an empty one; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurate.llm import textops as T
from murmurate.llm.scratch import save

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Primes lie below PRIME; ROWS * PRIME ** 2 is 2 ** 53.
PRIME, ROWS = 1 << 20, 1 << 13
#: Entries of this size and beyond don't fit a long after scaling.
LARGEST = 2.0**62
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def primes(least_product: int) -> list[int]:
    """The largest primes below ``PRIME`` whose product exceeds ``least_product``."""
    found, product, p = [], 1, PRIME
    while product <= least_product:
        p -= 1
        if all(p % k for k in range(2, int(p**0.5) + 1)):
            found.append(p)
            product *= p
    return found


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, the scaled integers, of the vectors that are kept."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: F.coalesce(F.abs(c) * SCALE < LARGEST, F.lit(False)) & ~F.isnan(c))
    return e.where(F.col("v").isNotNull() & sound).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def residues(x: DataFrame, d: int, moduli: list[int]) -> dict[tuple[int, int], int]:
    """By (number of the prime, place in the upper triangle) the residue of the scatter of (1, x)."""
    upper = np.triu_indices(d + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.vacate()
        sums = np.zeros((len(moduli), d + 1, d + 1), np.int64)
        for batch in batches:
            whole = matrix(batch.column(0), d)
            for a in range(0, len(whole), ROWS):
                rows = whole[a : a + ROWS]
                r = np.ones((len(rows), d + 1))
                for k, p in enumerate(moduli):
                    r[:, 1:] = np.mod(rows, p)
                    sums[k] = (sums[k] + (r.T @ r).astype(np.int64)) % p
        if sums.any():
            place = np.arange(len(upper[0]))
            for k in range(len(moduli)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), k, np.int32)), pa.array(place.astype(np.int32)), pa.array(sums[k][upper])], ["prime", "place", "value"])

    found = x.select("x").mapInArrow(run, "prime int, place int, value long").groupBy("prime", "place").agg(F.sum("value").alias("value"))
    return {(r["prime"], r["place"]): r["value"] % moduli[r["prime"]] for r in found.collect()}


def exact_scatter(x: DataFrame, d: int, rows: int, largest: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, the sums and the scatter matrix as Python integers; ``rows`` and ``largest`` (of an entry, without sign) bound them."""
    moduli = primes(2 * max(rows, 1) * max(largest, 1) ** 2)
    found = residues(x, d, moduli)
    product = int(np.prod(np.array(moduli, object)))
    share = [product // p * pow(product // p, -1, p) for p in moduli]
    whole = np.zeros((d + 1, d + 1), object)
    for place, (i, j) in enumerate(zip(*np.triu_indices(d + 1), strict=True)):
        value = sum(found.get((k, place), 0) * s for k, s in enumerate(share)) % product
        whole[i, j] = whole[j, i] = value - product if 2 * value > product else value
    return whole[0, 0], whole[0, 1:], whole[1:, 1:]


def covariance(n: int, sums: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    """The covariance about the mean, each entry rounded once."""
    centred = n * scatter - np.outer(sums, sums)
    return np.array([[value / (n * n) for value in row] for row in centred], float).reshape(centred.shape)


def axes(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (as columns) by falling eigenvalue, without those that are zero; the largest entry of each is positive."""
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1][:most], vector[:, ::-1][:, :most]
    some = value > len(v) * np.finfo(float).eps * max(value[0] if len(value) else 0, 0)
    value, vector = value[some], vector[:, some]
    if len(value):
        vector = vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(len(value))])
    return value, vector


def projected(x: DataFrame, n: int, sums: np.ndarray, largest: int, onto: np.ndarray) -> DataFrame:
    """vec_id, deviation and w, the rows about the mean times ``onto``."""
    d = len(sums)
    widest = max([abs(n * s * largest - int(t)) for s in (1, -1) for t in sums])
    small = d * widest**2 < 1 << 63
    low = sums.astype(np.int64) if small else sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.vacate()
        for batch in batches:
            rows = matrix(batch.column(1), d)
            about = n * (rows if small else rows.astype(object)) - low
            deviation = (about * about).sum(axis=1)
            if not small:
                deviation = [int(v) if v < 1 << 63 else None for v in deviation]
            w = (about / n).astype(float) @ onto
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), onto.shape[1]).cast(pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    return x.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, w array<double>")


def identity_error(rows: DataFrame, k: int) -> float:
    """The largest difference of the covariance of ``w`` from the identity."""
    each = list(combinations_with_replacement(range(k), 2))
    found = rows.agg(*(F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in each)).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in each)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each vector and component."""
    spark = embeddings.sparkSession
    T.small_batches(spark)
    x = integers(embeddings)
    bounds = x.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))).alias("most"))
    shape = bounds.orderBy(F.desc("n"), F.desc("d")).first()
    empty = spark.createDataFrame([], RESULT)
    if shape is None or not shape["d"]:
        return empty
    d = shape["d"]
    x = x.where(F.size("x") == d)
    n, sums, scatter = exact_scatter(x, d, shape["n"], shape["most"])
    v = covariance(n, sums, scatter)
    value, vector = axes(v, components)
    if not len(value):
        return empty
    rows = save(projected(x, n, sums, shape["most"], vector / np.sqrt(value)), "whitened")
    off = identity_error(rows, len(value))
    share = F.array(*(F.lit(float(e / np.trace(v))) for e in value))
    each = rows.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return each.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(int(n)).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(float(off)).alias("identity_error")
    )

"""Embedding whitening from a covariance by polarisation: exact sums of squares of dimensions and of dimension pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from threadlake.llm.common import prepared
from threadlake.session import materialize

#: An entry becomes floor(SCALE * c) + SHIFT; beyond +-LIMIT it counts as that, so that sums of squares of 2**30 rows stay exact.
SCALE, SHIFT, LIMIT = 1024, 100_000, 2 ** 47
COMPONENTS = 8
#: Components whose eigenvalue is less than this share of the largest are noise of the arithmetic.
RANK = 1e-12
#: Rows whose sums are taken at once, and vector lengths whose sums a task holds.
ROWS, HELD = 1024, 16


def usable(vector: Column) -> Column:
    """A vector that is not null and whose entries are neither null nor non-finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole(column: pa.Array, size: int) -> np.ndarray:
    """Rows of equal length as whole numbers."""
    flat = np.asarray(column.flatten(), np.float64).reshape(-1, size)
    return np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def _exact(bound: int, terms: int):
    """A type in which ``terms`` squares of numbers up to ``bound`` are summed exactly."""
    return np.int64 if terms * bound * bound < 2 ** 63 else object


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = np.asarray(batch.column("size"))
    for size in np.unique(sizes).tolist():
        part = batch.filter(pa.array(sizes == size))
        for at in range(0, part.num_rows, ROWS):
            yield size, part.slice(at, ROWS)


def _sums(rows: DataFrame, of: Callable[[int, np.ndarray], list]) -> DataFrame:
    """(size, place, total): whole numbers that ``of`` gives for some rows of one length, summed within tasks, then by a shuffle.

    There are as many rows per length as numbers, whatever the number of vectors.
    """
    def run(batches):
        held: dict[int, list[int]] = {}

        def told():
            for size, total in held.items():
                for at in range(0, len(total), 1 << 16):
                    piece = total[at:at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([size] * len(piece), pa.int32()), pa.array(range(at, at + len(piece)), pa.int32()),
                        pa.array([Decimal(x) for x in piece], pa.decimal128(38))], ["size", "place", "total"])
            held.clear()

        for batch in batches:
            for size, part in _by_length(batch):
                got = of(size, whole(part.column("vector"), size))
                held[size] = [a + b for a, b in zip(held[size], got)] if size in held else got
                if len(held) > HELD:
                    yield from told()
        yield from told()

    found = rows.select("vector", "size").mapInArrow(run, "size int, place int, total decimal(38,0)")
    return found.groupBy("size", "place").agg(F.sum("total").alias("total"))


def means(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{length: (number of vectors, sum of each dimension)}."""
    collected: dict[int, dict[int, int]] = {}
    # one number a dimension, and the count
    for r in _sums(rows, lambda size, x: [len(x), *map(int, x.sum(axis=0))]).collect():
        collected.setdefault(r["size"], {})[r["place"]] = int(r["total"])
    return {size: (x[0], [x[d + 1] for d in range(size)]) for size, x in collected.items()}


def pair_index(size: int) -> list[tuple[int, int]]:
    """Dimensions (i, i) and pairs (i, j), in the order of their sums."""
    return [(i, j) for i in range(size) for j in range(i, size)]


def _squares(z: np.ndarray) -> list[int]:
    """Sums over rows of z_i**2 for each dimension and (z_i + z_j)**2 for each pair, exactly."""
    z = z.astype(_exact(2 * int(np.abs(z).max(initial=0)), max(len(z), 1)))
    out: list[int] = []
    for i in range(z.shape[1]):
        both = z[:, i:] + z[:, i:i + 1]
        both[:, 0] = z[:, i]
        out.extend(map(int, (both * both).sum(axis=0)))
    return out


def covariances(rows: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Covariance matrix per length, from exact variances of the dimensions and of the pair sums.

    Values are centred at the whole part of their mean before they are squared; what is left of the mean, a fraction less
    than one, is put right in whole numbers: with z = x - floor(S / n) and r = S mod n, the sum of (n x - S)**2 is
    n**2 sum(z**2) - n r**2, and likewise for z_i + z_j and r_i + r_j.  2 cov(i, j) = var(i + j) - var(i) - var(j).
    """
    floors = {size: np.array([s // n for s in total], np.int64) for size, (n, total) in sums.items()}
    collected: dict[int, dict[int, int]] = {}
    for r in _sums(rows, lambda size, x: _squares(x - floors[size])).collect():  # one number a pair of dimensions
        collected.setdefault(r["size"], {})[r["place"]] = int(r["total"])
    out = {}
    for size, squares in collected.items():
        n, total = sums[size]
        rest = [s % n for s in total]
        centred = {}
        for place, (i, j) in enumerate(pair_index(size)):
            left = rest[i] if i == j else rest[i] + rest[j]
            centred[i, j] = n * n * squares[place] - n * left * left  # the sum of (n x - S)**2, exactly
        matrix = np.empty((size, size))
        for (i, j), square in centred.items():
            twice = 2 * square if i == j else square - centred[i, i] - centred[j, j]
            matrix[i, j] = matrix[j, i] = twice / (2 * n ** 3)  # a quotient of whole numbers, rounded once
        out[size] = matrix
    return out


def components(covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, share of the trace) by falling eigenvalue; the largest entry is positive."""
    value, vector = np.linalg.eigh(covariance)
    order = np.argsort(-value, kind="stable")[:wanted]
    value, vector = value[order], vector[:, order]
    real = value > max(RANK * float(value.max(initial=0.0)), 0.0)
    value, vector = value[real], vector[:, real]
    vector = vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(len(value))])
    return value, vector, value / np.trace(covariance) if len(value) else value


def whiten(vectors: DataFrame, wanted: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row with a whole vector.

    * null vectors and vectors with null or non-finite entries are dropped; zero vectors, repeated rows and null ids are kept;
    * vectors of one length are fitted together, those of another length on their own; ``n`` counts them;
    * ``component`` runs from 1 by falling eigenvalue up to ``wanted``, or to the rank of the covariance if that is less: one
      vector, or vectors that are all equal, have none and so no rows;
    * ``deviation`` is the exact sum of (n x - S)**2 over dimensions, as decimal(38,0), null where it has more digits;
    * entries are x = floor(1024 c) + 100000, with 1024 c held between -2**47 and 2**47;
    * an empty table gives an empty table; only the two named columns are read.

    Sums are taken exactly inside tasks and added by a shuffle that has one row per task and dimension pair.  The driver gets
    one number per pair, so its share depends on the dimensions alone.
    """
    spark = prepared(vectors.sparkSession)
    rows = vectors.select(vectors[id_column].alias("id"), vectors[vector_column].cast("array<double>").alias("vector"))
    rows = rows.where(usable(F.col("vector"))).withColumn("size", F.size("vector")).where("size > 0")
    sums = means(rows)
    fitted = {size: components(matrix, wanted) for size, matrix in covariances(rows, sums).items()}
    sent = spark.sparkContext.broadcast((sums, fitted))  # a matrix of ``wanted`` columns for each length
    id_type = dict(rows.dtypes)["id"]

    def project(batches):
        sums, fitted = sent.value
        for batch in batches:
            for size, part in _by_length(batch):
                n, total = sums[size]
                value, vector, explained = fitted[size]
                x = whole(part.column("vector"), size)
                floors = np.array([s // n for s in total], np.int64)
                z = x - floors
                bound = n * int(np.abs(z).max(initial=0) + 1)
                kind = _exact(bound, size)
                away = n * z.astype(kind) - np.array([s % n for s in total], kind)
                deviation = (away * away).sum(axis=1)
                fraction = np.array([(s % n) / n for s in total])
                white = (z - fraction) @ vector / np.sqrt(value)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("size"), pa.array([n] * len(x), pa.int64()),
                    pa.array([Decimal(int(d)) if d < 10 ** 38 else None for d in deviation.tolist()], pa.decimal128(38)),
                    pa.array(list(white), pa.list_(pa.float64())), pa.array([explained.tolist()] * len(x), pa.list_(pa.float64()))],
                    ["id", "size", "n", "deviation", "whitened", "explained"])

    white = materialize(rows.select("id", "vector", "size").mapInArrow(
        project, f"id {id_type}, size int, n long, deviation decimal(38,0), whitened array<double>, explained array<double>"), "whitened")

    # the covariance of what came out, centred before multiplying
    entry = lambda i: F.get("whitened", F.lit(i))
    centre = white.groupBy("size").agg(*(F.avg(entry(i)).alias(f"m{i}") for i in range(wanted)))
    away = [entry(i) - F.col(f"m{i}") for i in range(wanted)]
    pairs = [(i, j) for i in range(wanted) for j in range(i, wanted)]
    spread = white.join(centre, "size").groupBy("size").agg(*(F.avg(away[i] * away[j]).alias(f"c{i}_{j}") for i, j in pairs))
    errors = spread.select("size", F.array_max(F.array(*(F.abs(F.col(f"c{i}_{j}") - int(i == j)) for i, j in pairs))).alias("identity_error"))
    out = white.join(errors, "size")
    return out.select("id", F.posexplode("whitened").alias("at", "white"), "n", "deviation", "explained", "identity_error").select(
        "id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("white").alias("whitened"), F.get("explained", "at").alias("explained"), "identity_error")

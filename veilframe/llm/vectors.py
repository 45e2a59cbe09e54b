"""Near-duplicate vectors: spherical k-means assigns cells, blocked cosine products compare inside cells.

Equal vectors of a label are one class from the start, so that a vector that fills a third of a table is compared once.
Centroids are fitted on at most SAMPLE_PER_CELL * cells classes (in the order of a hash of their id); every class is
assigned. A class also visits each cell of a higher number whose bounding plane is closer than SLACK times the largest
distance of two linked vectors. With SLACK 1 no link can be missed, whatever the centroids: two linked vectors are
together no farther from the plane between their homes than from each other, so the one at home in the lower cell visits the
other's home, and they meet there and nowhere else. Cells are cut into blocks of about BLOCK rows
and each pair of blocks is one product, so memory does not depend on a cell's size; blocks give link counts and spanning
forests, never all pairs.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing.
Vectors of different lengths never link. Rows with the same vec_id count as vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .components import components, forest

THRESHOLD, SLACK = 0.93, 1.0
CELL_ROWS, MOST_CELLS, SAMPLE_PER_CELL, BLOCK = 4000, 4096, 40, 1024
LLOYD_ROUNDS = 8
ROWS_AT_ONCE = 8192  # of the rows that a batch becomes


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = LLOYD_ROUNDS) -> np.ndarray:
    """Unit centroids; the first k rows begin. An empty cell keeps its centroid. Products are made for ROWS_AT_ONCE / 4 rows at a
    time: 64 MB for MOST_CELLS cells."""
    centres, step = rows[:k].copy(), ROWS_AT_ONCE // 4
    for _ in range(rounds):
        cell = np.concatenate([(rows[at : at + step] @ centres.T).argmax(axis=1) for at in range(0, len(rows), step)])
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, rows)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def valid(vector) -> F.Column:
    value = vector.cast("array<double>")
    good = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(value, lambda x: x != 0), F.lit(False))


def distances(centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * np.clip(centres @ centres.T, -1, 1), 0)).astype(np.float32)


def visits(rows: np.ndarray, centres: np.ndarray, apart: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home of each row, row and cell of its visits to higher cells). apart: distances(centres)."""
    near = rows @ centres.T
    home = near.argmax(axis=1)
    close = near.max(axis=1, keepdims=True) - near <= reach * (apart[home] + 1e-6)
    close &= np.arange(len(centres)) > home[:, None]
    return (home, *np.nonzero(close))


CELLS = "label string, rep long, size long, v array<double>, cell int, home int"


def assigned(classes: DataFrame, centres: np.ndarray, reach: float) -> DataFrame:
    """A row for each class and cell it lives in or visits. Vectors of another length than the centroids share the cell -1."""
    shared = classes.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CELLS rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = distances(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                fits = np.asarray(batch.column("v").value_lengths()) == shared.value.shape[1]
                home, row, cell = np.full(batch.num_rows, -1), np.zeros(0, np.int64), np.zeros(0, np.int64)
                at = np.flatnonzero(fits)
                if len(at):
                    home[at], row, cell = visits(unit(matrix(batch.column("v").take(pa.array(at)))), shared.value, apart, reach)
                    row = at[row]
                row, cell = np.concatenate([np.arange(batch.num_rows), row]), np.concatenate([home, cell])
                for k in range(0, len(row), ROWS_AT_ONCE):
                    part = row[k : k + ROWS_AT_ONCE]
                    taken = batch.take(pa.array(part))
                    yield pa.RecordBatch.from_arrays([taken.column("label"), taken.column("rep"), taken.column("size"), taken.column("v").cast(pa.list_(pa.float64())), pa.array(cell[k : k + ROWS_AT_ONCE], pa.int32()), pa.array(home[part], pa.int32())], names=["label", "rep", "size", "v", "cell", "home"])

    return classes.select("label", "rep", "size", "v").mapInArrow(assign, CELLS)


def compare(pairs: pa.Table, threshold: float) -> pa.Table:
    """One block pair: rows with side 0 against rows with side 1 (or, if there are none, side 0 against itself)."""
    out = {"rep": [], "links": [], "other": []}
    sizes = np.asarray(pairs.column("v").combine_chunks().value_lengths())
    for dim in np.unique(sizes):
        own = pairs.take(pa.array(np.flatnonzero(sizes == dim)))
        side = own.column("side").to_numpy()
        rep, size = (own.column(c).to_numpy() for c in ("rep", "size"))
        rows = unit(matrix(own.column("v").combine_chunks()))
        alone = bool(own.column("alone")[0].as_py())
        left = np.flatnonzero(side == 0)
        right = left if alone else np.flatnonzero(side == 1)
        links = np.zeros(len(rep), np.int64)
        x, y = [], []
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            i, j = np.nonzero(rows[some] @ rows[right].T >= threshold)
            i, j = some[i], right[j]
            if alone:
                i, j = i[i < j], j[i < j]
            np.add.at(links, i, size[j])
            np.add.at(links, j, size[i])
            member, root = forest(np.concatenate([rep[i], *x]), np.concatenate([rep[j], *y]))
            x, y = [member], [root]
        found = np.flatnonzero(links)
        out["rep"] += [rep[found], *x]
        out["links"] += [links[found], *(np.zeros(len(k), np.int64) for k in x)]
        out["other"] += [rep[found], *y]
    joined = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
    return pa.table({k: pa.array(v, pa.int64()) for k, v in joined.items()})


def near_duplicates(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", threshold: float = THRESHOLD, slack: float = SLACK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = rows.sparkSession
    vector = F.col(vector_column)
    usable = valid(vector) & F.col(label_column).isNotNull() & F.col(id_column).isNotNull()
    base = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.when(usable, F.col(label_column).cast("string")).alias("label"), F.when(usable, vector.cast("array<double>")).alias("v"))
    classes = staged(base.filter("label is not null").groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("size")).withColumn("rep", F.monotonically_increasing_id()))
    n = classes.count()
    k = int(np.clip(n // CELL_ROWS, 1, MOST_CELLS))
    sample = classes.select("v", F.xxhash64("rep").alias("h"), "rep").orderBy("h", "rep").limit(SAMPLE_PER_CELL * k).select("v").toArrow().column("v").combine_chunks()  # bounded by MOST_CELLS
    lengths, often = np.unique(np.asarray(sample.value_lengths()), return_counts=True)
    dim = int(lengths[often.argmax()]) if len(lengths) else 1
    fitting = sample.filter(pa.array(np.asarray(sample.value_lengths()) == dim))
    centres = spherical_kmeans(unit(matrix(fitting)), min(k, len(fitting))) if len(fitting) else np.ones((1, dim))
    cells = staged(assigned(classes, centres, slack * float(np.sqrt(2 - 2 * threshold))))
    at_home = F.col("home") == F.col("cell")
    counts = cells.groupBy("label", "cell").agg(F.count_if(at_home).alias("homes"), F.count_if(~at_home).alias("guests"))
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int")
    sized = cells.join(counts.select("label", "cell", blocks("homes").alias("nh"), blocks("guests").alias("ng"), (F.col("guests") > 0).alias("visited"), (F.col("homes") > 0).alias("lived")), ["label", "cell"]).filter("lived")
    own = F.when(at_home, F.pmod(F.xxhash64("rep"), F.col("nh").cast("long"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("ng").cast("long"))).cast("int")
    # Block pairs: (home i, home j >= i) and (home i, guests j); guests have numbers from nh on.
    sized = sized.withColumn("b", own)
    as_left = F.transform(F.sequence("b", F.col("nh") + F.when(F.col("visited"), F.col("ng")).otherwise(0) - 1), lambda j: F.struct(F.col("b").alias("i"), j.alias("j"), F.lit(0).alias("side"), (j == F.col("b")).alias("alone")))
    lower = F.filter(F.sequence(F.lit(0), F.col("b")), lambda i: i < F.col("b"))
    as_right = F.transform(lower, lambda i: F.struct(i.alias("i"), F.col("b").alias("j"), F.lit(1).alias("side"), F.lit(False).alias("alone")))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda i: F.struct(i.alias("i"), (F.col("nh") + F.col("b")).alias("j"), F.lit(1).alias("side"), F.lit(False).alias("alone")))
    laid = sized.withColumn("p", F.explode(F.when(at_home, F.concat(as_left, as_right)).otherwise(as_guest))).select("label", "cell", "p.i", "p.j", "p.side", "p.alone", "rep", "size", "v").repartition("label", "cell", "i", "j")  # else all blocks of a cell meet in one task
    found = staged(laid.groupBy("label", "cell", "i", "j").applyInArrow(lambda t: compare(t, threshold), "rep long, links long, other long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = staged(components(found.filter("rep <> other").select("rep", "other")))
    joined = classes.select("rep", "first").join(roots.withColumnRenamed("id", "rep"), "rep").groupBy("component").agg(F.min("first").alias("component_id"))
    roots = roots.join(joined, "component").select(F.col("id").alias("rep"), "component_id")
    merged = classes.join(links, "rep", "left").join(roots, "rep", "left").select(F.col("label").alias("l"), F.col("v").alias("w"), "size", "first", F.coalesce("links", F.lit(0)).alias("links"), "component_id")
    out = base.join(merged, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("component_id", "first", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("size") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))

"""Near-duplicate vectors: spherical k-means cells and blocked cosine products within them.

Equal vectors are one class from the start.  Cells are fitted on a bounded sample;
every class is indexed in the cell of its nearest centroid.  A pair that is close
enough but lies in two cells is close to the plane between their centroids, so each
class is also a guest of cells whose plane is near.  The distances of a pair's two
members from that plane add up to the pair's own distance at most, so the nearer one
is within half of it: with ``margin=None`` classes up to there are guests, no pair is
lost, and a pair that only one of the two cells sees is counted for both members.
With a margin m the bound is m standard deviations of how far a random direction
carries a pair (its distance over the root of the dimension), if that is less; vectors
of low intrinsic dimension lose links by it.
Cells are cut into blocks of bounded size, each product of two blocks is a task's
unit of work.  A pair that both of its cells see belongs to the one of lower number, so
each pair is found once and counted at both ends.  What leaves a unit is a count for each
member and a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import stage

#: Classes that the centroids are fitted on, about: at most so many, or so many for each cell if that is more.
SAMPLE, SAMPLE_OF_CELL = 20_000, 8
#: Classes a cell is meant to have, and most cells; sample and table of centroids are bounded by the latter, beyond which cells grow.
CELL, MOST_CELLS = 400, 16_384
#: Cells that are fitted at once; more are fitted within cells of a first fit.
FITTED = 1024
#: Scores of vectors with centroids that are held at a time.
SCORES = 1 << 22
#: Members of a block.
BLOCK = 2048
#: Parts into which the members of one class are salted.
SALTS = 256


def valid_vector(v: Column) -> Column:
    """Whether a vector can link at all: no null or non-finite component, not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.95, vector: str = "embedding", key: str = "vec_id", margin: float | None = None
) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Rows link when the cosine of their vectors, in double precision, is at least
    ``threshold``; with a margin, if the index finds the pair too.  Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, nor do rows with a null key or vectors of unequal
    length.  Rows that repeat a vector link with each other, those that repeat a key
    too.  ``component_id`` is the smallest key reachable by links, the row's own
    included; ``kept`` marks rows whose key it is.  An empty table gives an empty
    result; other columns, labels among them, are ignored.
    """
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).alias("id"), v.alias("v")).withColumn("ok", valid_vector(F.col("v")) & F.col("id").isNotNull())
    mark = F.when(F.col("ok"), F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), "v")), 16, "0") for seed in (3, 5)]))
    rows = rows.select("id", "v", mark.alias("mark"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    # Two 64-bit hashes name a class of equal vectors.
    found = rows.where("mark is not null").groupBy("mark").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("many"), F.first("v").alias("v"), F.collect_set("salt").alias("salts")
    )
    classes = stage(found.withColumn("node", F.monotonically_increasing_id()), "vector-classes")

    links = stage(_links(classes, threshold, margin), "vector-links")
    counts = links.where("other is null").groupBy("node").agg(F.sum("n").alias("linked"))
    labels = components(links.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = classes.select("node", "mark", "least", "many", "salts").join(counts, "node", "left").join(labels, "node", "left")
    known = stage(known.withColumn("label", F.coalesce("label", "node")), "vector-known")
    roots = known.groupBy("label").agg(F.min("least").alias("component"))
    known = known.join(roots, "label").select(
        "mark", (F.col("many") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component", F.explode("salts").alias("salt")
    )
    out = rows.select("id", "mark", "salt").join(known, ["mark", "salt"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of spherical k-means; the start is spread over the sample and the same on each run."""
    if cells > FITTED:  # within each cell of a first fit, in proportion to its share of the sample
        first = fit_centroids(sample, math.isqrt(cells), rounds)
        home = _nearest(sample, first)
        parts = [sample[home == k] for k in range(len(first))]
        return np.concatenate([fit_centroids(x, max(1, round(cells * len(x) / len(sample))), rounds) for x in parts if len(x)])
    rng = np.random.default_rng(7)
    centroids = sample[rng.permutation(len(sample))[:cells]]
    for _ in range(rounds):
        home = _nearest(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centroids)
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([(part @ centroids.T).argmax(1) for part in np.array_split(x, 1 + len(x) * len(centroids) // SCORES)])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(lists: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    return np.asarray(lists.combine_chunks().flatten() if isinstance(lists, pa.ChunkedArray) else lists.flatten()).reshape(-1, d)


def _visited(x: np.ndarray, centroids: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell) of each visit, in that order, and each row's home: the cells to whose plane with its home's a row is near enough."""
    rows, cells, homes = [], [], []
    step = max(1, SCORES // len(centroids))
    for at in range(0, len(x), step):
        score = x[at : at + step] @ centroids.T
        home = score.argmax(1)
        gap = np.sqrt(np.maximum(0, 2 - 2 * centroids[home] @ centroids.T))
        row, cell = np.nonzero(score[np.arange(len(home)), home][:, None] - score <= reach * gap + 1e-12)
        rows.append(row + at), cells.append(cell), homes.append(home)
    return tuple(np.concatenate(c) if c else np.empty(0, int) for c in (rows, cells, homes))


def _links(classes: DataFrame, threshold: float, margin: float | None) -> DataFrame:
    """``node, other, n``: forest links where ``other`` is set, else ``n`` more rows that ``node`` links with."""
    spark = classes.sparkSession
    sizes = {r["d"]: r["count"] for r in classes.groupBy(F.size("v").alias("d")).count().collect()}  # one row a vector length
    total = sum(sizes.values())
    centroids: dict[int, np.ndarray] = {}
    for d, n in sizes.items():
        cells = min(MOST_CELLS, round(n / CELL))
        if cells > 1:
            share = max(SAMPLE * n / total, SAMPLE_OF_CELL * cells) / n
            drawn = classes.where((F.size("v") == d) & (F.pmod(F.xxhash64("mark"), F.lit(1 << 20)) < (1 << 20) * min(1.0, share))).select("v").toArrow()
            if len(drawn) >= cells:
                centroids[d] = fit_centroids(_unit(_matrix(drawn["v"], d)), cells)
    shipped = spark.sparkContext.broadcast(centroids)
    apart_at_most = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pa.compute.list_value_length(batch.column(2)))
            for d in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == d)))
                cent = shipped.value.get(d)
                if cent is None:
                    row = np.arange(len(part))
                    cell = home = np.zeros(len(part), int)
                else:
                    reach = apart_at_most * (0.5 if margin is None else min(0.5, margin / math.sqrt(d)))
                    row, cell, home = _visited(_unit(_matrix(part.column(2), d)), cent, reach)
                # Home rows carry the list of all visits; visits stand by row, so they are these lists one after another.
                at_home = cell == home[row]
                ends = np.concatenate([[0], np.cumsum(np.where(at_home, np.bincount(row, minlength=len(part))[row], 0))]).astype(np.int32)
                visits = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell.astype(np.int32)))
                for lo in range(0, len(row), 4096):  # so that copies of vectors are made a few at a time
                    cut = slice(lo, lo + 4096)
                    taken = part.take(pa.array(row[cut]))
                    yield pa.RecordBatch.from_arrays(
                        [*taken.columns, pa.array(cell[cut].astype(np.int32)), pa.array(home[row[cut]].astype(np.int32)), visits.slice(lo, 4096)], ["node", "many", "v", "cell", "home", "visits"]
                    )

    placed = classes.select("node", "many", "v").mapInArrow(place, "node long, many long, v array<double>, cell int, home int, visits array<int>")
    placed = stage(placed.withColumn("d", F.size("v")), "vector-cells")
    # Blocks of a cell by the hash of the member; one row a cell.
    cells = placed.groupBy("d", "cell").agg(F.count_if(F.col("home") == F.col("cell")).alias("homes"), F.count(F.lit(1)).alias("all"))
    cut = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(BLOCK))).cast("int")
    cells = cells.withColumns({"left_blocks": cut("homes"), "right_blocks": cut("all")})
    at = placed.join(cells, ["d", "cell"]).withColumns({"i": F.pmod(F.xxhash64("node"), "left_blocks").cast("int"), "j": F.pmod(F.xxhash64(F.lit(11), "node"), "right_blocks").cast("int")})
    left = at.where("home = cell").select("d", "cell", "i", F.explode(F.sequence(F.lit(0), F.col("right_blocks") - 1)).alias("j"), F.lit(0).alias("side"), "node", "many", "v", "home", "visits")
    right = at.select("d", "cell", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("i"), "j", F.lit(1).alias("side"), "node", "many", "v", "home", F.lit(None).cast("array<int>").alias("visits"))

    def multiply(unit: pa.Table) -> pa.Table:
        side = unit["side"].to_numpy()
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = [np.empty(0, np.int64)] * 3
        if len(x) and len(y):
            whole = _unit(_matrix(unit["v"], unit["d"][0].as_py()))
            near = whole[x] @ whole[y].T >= threshold
            node, many, home, cell = (unit[c].to_numpy() for c in ("node", "many", "home", "cell"))
            # A pair at home here is taken in one order. Another's belongs to the home of its guest if that is of lower number and sees it too.
            homes, which = np.unique(home[y], return_inverse=True)
            visits = unit["visits"].combine_chunks().take(pa.array(x))
            to, of = np.asarray(visits.flatten()), np.repeat(np.arange(len(x)), np.asarray(pa.compute.list_value_length(visits)))
            spot = np.minimum(np.searchsorted(homes, to), len(homes) - 1)
            hit = (homes[spot] == to) & (to < cell[0])
            elsewhere = np.zeros((len(x), len(homes)), bool)
            elsewhere[of[hit], spot[hit]] = True
            near &= np.where(home[y] == cell[0], node[x][:, None] < node[y][None, :], ~elsewhere[:, which])
            counts, back = near @ many[y], many[x] @ near
            some, other = np.flatnonzero(counts), np.flatnonzero(back)
            rows, cols = _forest(near)
            ends = [np.full(len(some) + len(other), -1), node[y][cols]]
            found = [np.concatenate([node[x][some], node[y][other], node[x][rows]]), np.concatenate(ends), np.concatenate([counts[some], back[other], np.zeros(len(rows), np.int64)])]
        columns = [pa.array(c, pa.int64()) for c in found]
        columns[1] = pa.array(found[1], pa.int64(), mask=np.asarray(found[1]) < 0)
        return pa.table(columns, ["node", "other", "n"])

    return left.union(right).groupBy("d", "cell", "i", "j").applyInArrow(multiply, "node long, other long, n long")


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same rows and columns as all of ``near``: breadth first from each row not yet reached."""
    row_seen, col_seen = np.zeros(near.shape[0], bool), np.zeros(near.shape[1], bool)
    out_rows: list[int] = []
    out_cols: list[int] = []
    for start in np.flatnonzero(near.any(1)):
        if row_seen[start]:
            continue
        row_seen[start] = True
        left = [int(start)]
        while left:
            r = left.pop()
            for c in np.flatnonzero(near[r] & ~col_seen):
                col_seen[c] = True
                out_rows.append(r), out_cols.append(int(c))
                more = np.flatnonzero(near[:, c] & ~row_seen)
                row_seen[more] = True
                out_rows.extend(more.tolist()), out_cols.extend([int(c)] * len(more))
                left.extend(more.tolist())
    return np.array(out_rows, int), np.array(out_cols, int)

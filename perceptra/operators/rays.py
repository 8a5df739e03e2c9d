"""Points to occupancy grids: exact ray traversal by a closed form, then one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import probability, quantise, to_pose

FREE, OCCUPIED = -0.1, 1.0


def ray_cell(start: Column, delta: Column, longest: Column, s: Column) -> Column:
    """Coordinate of the cell after s of longest steps along a ray (X7): Bresenham's walk without its state."""
    return (start + F.signum(delta) * F.floor((2 * F.abs(delta) * s + longest) / (2 * longest))).cast("int")


def ray_ends(hits: DataFrame, res: float, pose: tuple[str, str, str, str] | None = None) -> DataFrame:
    """Adds the cells of each ray's start (si, sj, sk) and end (ei, ej, ek); pose names columns x, y, z, theta."""
    if pose is None:
        ends = {"ei": quantise("x", res), "ej": quantise("y", res), "ek": quantise("z", res)}
        return hits.withColumns({f"s{c}": F.lit(0) for c in "ijk"} | ends)
    px, py, pz, t = pose
    x, y = to_pose("x", "y", px, py, t)
    ox, oy = to_pose(F.lit(0.0), F.lit(0.0), px, py, t)
    return hits.withColumns({
        "si": quantise(ox, res), "sj": quantise(oy, res), "sk": quantise(-F.col(pz), res),
        "ei": quantise(x, res), "ej": quantise(y, res), "ek": quantise(F.col("z") - F.col(pz), res),
    })


def trace(ends: DataFrame, keys: list[str], steps: int | None = None, box: tuple[int, int, int] | None = None) -> DataFrame:
    """Rows (keys, i, j, k, free, occ): each ray's free cells and its hit cell.

    With a budget at most steps - 1 free cells count, those in the box, from the sensor on; cells out of the box
    (abs >= its size) use no budget; a hit is marked whatever was used. The cells of a ray are an array until they are
    filtered and cut, so neither needs a shuffle.
    """
    d = {c: F.col(f"e{c}") - F.col(f"s{c}") for c in "ijk"}
    rays = ends.withColumn("_n", F.greatest(*[F.abs(x) for x in d.values()]))
    cell = lambda s: F.struct(*[
        F.when(F.col("_n") == 0, F.col(f"s{c}")).otherwise(ray_cell(F.col(f"s{c}"), d[c], F.greatest(F.col("_n"), F.lit(1)), s)).alias(c) for c in "ijk"
    ], (s < F.col("_n")).alias("free"))
    inside = lambda c: (F.abs(c["i"]) < box[0]) & (F.abs(c["j"]) < box[1]) & (F.abs(c["k"]) < box[2])
    if box is not None:
        steps = min(2 * max(box), steps) if steps else 2 * max(box)
    if steps is None:
        cells = rays.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.col("_n")), cell)).alias("c"))
    else:
        free = F.when(F.col("_n") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0))), cell)).otherwise(F.array())
        hit = F.array(cell(F.col("_n")))
        if box is not None:
            free, hit = F.filter(free, inside), F.filter(hit, inside)
        cells = rays.select(*keys, F.explode(F.concat(F.slice(free, 1, max(steps - 1, 0)) if steps > 1 else F.slice(free, 1, 0), hit)).alias("c"))
    return cells.select(*keys, "c.i", "c.j", "c.k", F.col("c.free").cast("int").alias("free"), (~F.col("c.free")).cast("int").alias("occ"))


def occupancy(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and log-odds by cell (G1): the counts are exact, so the order of rays does not matter."""
    g = cells.groupBy(*keys, "i", "j", "k").agg(F.sum("free").alias("n_free"), F.sum("occ").alias("n_occ"))
    return g.withColumn("log_odds", F.col("n_occ") * OCCUPIED + F.col("n_free") * FREE)


def occupancy_grid(hits: DataFrame, res: float, keys: list[str], pose=None, steps=None, box=None) -> DataFrame:
    return occupancy(trace(ray_ends(hits, res, pose), keys, steps, box), keys)


def binary_map(grid: DataFrame) -> DataFrame:
    """(X4)"""
    return grid.withColumn("occ", F.when(F.col("log_odds") > 0, 1).otherwise(0))


def box_lattice(spark, i: int, j: int, k: int) -> DataFrame:
    """All cells within plus and minus the given sizes."""
    axis = lambda n: F.explode(F.sequence(F.lit(-n), F.lit(n)))
    return spark.range(1).select(axis(i).alias("i")).select("i", axis(j).alias("j")).select("i", "j", axis(k).alias("k"))


def lookup(cells: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Log-odds and probability of given cells, unknown ones at 0 and one half."""
    found = cells.join(grid.select(*keys, "i", "j", "k", "log_odds"), [*keys, "i", "j", "k"], "left")
    return found.withColumn("known", F.col("log_odds").isNotNull()).withColumn("log_odds", F.coalesce("log_odds", F.lit(0.0))).withColumn("p", probability("log_odds"))


def dense_masks(cells: DataFrame, grid: DataFrame, keys: list[str], occupied: float = 0.6, free: float = 0.4) -> DataFrame:
    """Two flags a cell of a lattice (K4)."""
    return lookup(cells, grid, keys).select(*keys, "i", "j", "k", (F.col("p") > occupied).cast("int").alias("is_occ"), (F.col("p") < free).cast("int").alias("is_free"))


def fraction_known(grid: DataFrame, keys: list[str], i: int, j: int, k: int) -> DataFrame:
    """Share of a box's cells that are known."""
    inside = F.col("i").between(-i, i) & F.col("j").between(-j, j) & F.col("k").between(-k, k)
    return grid.groupBy(*keys).agg((F.count_if(inside) / ((2 * i + 1) * (2 * j + 1) * (2 * k + 1))).alias("fraction"))


def in_order(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Cells in order of grid and cell (T1): sorted within range partitions, only for output."""
    return grid.repartitionByRange(*keys, "i", "j", "k").sortWithinPartitions(*keys, "i", "j", "k")

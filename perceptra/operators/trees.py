"""Dependency trees over cells: candidate edges, spanning trees, greedy parents, scores."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import mutual_information

#: Rows of a model that are broadcast at most, some 40 MB.
MODEL_ROWS = 500_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the storage that the cluster shares (spark.checkpoint.dir); where that is unset, a local master takes a temporary one and a cluster raises."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='perceptra-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once in the storage that the cluster shares."""
    path = shared_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with those of the same keys in one partition. The number of tasks is given, since the little that is shuffled here says nothing of the pairs made from it."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def candidate_edges(joint: DataFrame, least: int = 100) -> DataFrame:
    """Pairs with enough joint observations and their mutual information."""
    n = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    return joint.where(n >= least).withColumn("mi", mutual_information()).where("mi >= -1e-9")


def spanning_forest(edges: DataFrame, by: list[str], rounds: int = 64) -> DataFrame:
    """Edges (by, a, b, mi) of a maximum spanning forest of each group (R2), ties by the ends.

    Boruvka's rounds: every component takes its best outgoing edge, and components joined by an edge become
    one. Two components that pick each other share the edge, so labels follow the picks to the smaller of such a pair; paths
    are halved until they stand still. All steps are joins and aggregations; each round is stored, so lineage stays short.
    """
    e = stored(edges.select(*by, "a", "b", "mi"))
    nodes = e.select(*by, F.col("a").alias("n")).unionAll(e.select(*by, F.col("b").alias("n"))).distinct()
    label = stored(nodes.withColumn("root", F.col("n")))
    chosen = None
    for _ in range(rounds):
        la, lb = (label.select(*by, F.col("n").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        out = e.join(la, [*by, "a"]).join(lb, [*by, "b"]).where("ra != rb")
        ends = out.select(*by, F.col("ra").alias("root"), F.col("rb").alias("to"), "mi", "a", "b").unionAll(out.select(*by, F.col("rb").alias("root"), F.col("ra").alias("to"), "mi", "a", "b"))
        pick = stored(ends.groupBy(*by, "root").agg(F.max_by(F.struct("to", "a", "b", "mi"), F.struct("mi", "a", "b")).alias("x")).select(*by, "root", "x.*"))
        if pick.isEmpty():
            break
        new = pick.select(*by, "a", "b", "mi").distinct()
        chosen = stored(new if chosen is None else chosen.unionByName(new).distinct())
        back = pick.select(*by, F.col("root").alias("to"), F.col("to").alias("_back"))
        up = pick.join(back, [*by, "to"], "left").select(*by, "root", F.when((F.col("_back") == F.col("root")) & (F.col("root") < F.col("to")), F.col("root")).otherwise(F.col("to")).alias("up"))
        up = stored(up)
        while True:
            over = up.select(*by, F.col("root").alias("up"), F.col("up").alias("_next"))
            step = stored(up.join(over, [*by, "up"], "left").select(*by, "root", F.coalesce("_next", "up").alias("up"), F.coalesce(F.col("_next") != F.col("up"), F.lit(False)).alias("_moved")))
            up = step.drop("_moved")
            if step.where("_moved").isEmpty():
                break
        label = stored(label.join(up, [*by, "root"], "left").select(*by, "n", F.coalesce("up", "root").alias("root")))
    else:
        raise RuntimeError(f"the forest did not settle in {rounds} rounds")
    return chosen if chosen is not None else e.limit(0)


def greedy_parents(cells: DataFrame, edges: DataFrame, keys: list[str], by: list[str], span: int | None = None) -> DataFrame:
    """Of each cell of a grid the parent among the preceding cells with the best mutual information, the earliest of equals.

    cells has keys, by, cell and ord (the cell's place in its grid); edges has by, a < b and mi. With span only the last
    span cells before count. Cells without a candidate have no row. A grid's cells are bounded by the model's window and meet as one array, so its pairs are made and compared
    in one task and only its cells are shuffled; up to MODEL_ROWS edges are broadcast.
    """
    edges = stored(edges.select(*by, "a", "b", "mi"))
    small = F.broadcast if edges.count() <= MODEL_ROWS else (lambda table: table)
    rows = cells.select(*keys, *[b for b in by if b not in keys], F.struct("ord", "cell").alias("_at"))
    grids = gathered(rows, keys).groupBy(*keys, *[b for b in by if b not in keys]).agg(F.sort_array(F.collect_list("_at")).alias("_cells"))
    one = grids.withColumn("_child", F.explode("_cells"))
    before = F.filter("_cells", lambda c: (c["ord"] < F.col("_child.ord")) & (c["ord"] >= F.col("_child.ord") - span if span else F.lit(True)))
    pairs = one.select(*keys, *[b for b in by if b not in keys], "_child", F.explode(before).alias("_parent"))
    pairs = pairs.select(*keys, *[b for b in by if b not in keys], F.col("_child.cell").alias("b"), F.col("_parent.cell").alias("a"), F.col("_parent.ord").alias("_a"))
    best = pairs.join(small(edges), [*by, "a", "b"]).groupBy(*keys, "b").agg(F.max_by(F.struct("a", "mi"), F.struct("mi", -F.col("_a"))).alias("x"))
    return best.select(*keys, F.col("b").alias("child"), F.col("x.a").alias("parent"), F.col("x.mi").alias("mi"))


def rendered(edges: DataFrame, marginals: DataFrame, by: list[str], least: float = 0.1) -> DataFrame:
    """Edges between cells that are both occupied often enough."""
    busy = marginals.where(F.col("c_occ") / (F.col("c_occ") + F.col("c_free")) > least).select(*by, "cell")
    return edges.join(busy.withColumnRenamed("cell", "a"), [*by, "a"], "left_semi").join(busy.withColumnRenamed("cell", "b"), [*by, "b"], "left_semi")


def tree_scores(cells: DataFrame, parents: DataFrame, conditionals: DataFrame, marginals: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Log probability of each grid under its tree (R4, J19): conditional terms of children, marginal ones of cells without a parent.

    cells has keys, by, cell and occ; parents as greedy_parents() gives them; conditionals by, a, b, given, occ and log_p; marginals by, cell,
    log_free and log_occ. A term that was never observed counts as log 1e-99.
    """
    least = F.lit(-227.95592420641055)
    up = cells.join(parents.withColumnRenamed("child", "cell"), [*keys, "cell"], "left")
    of_parent = cells.select(*keys, F.col("cell").alias("parent"), F.col("occ").alias("given"))
    known = up.join(of_parent, [*keys, "parent"], "left")
    terms = known.join(conditionals.select(*by, F.col("a").alias("parent"), F.col("b").alias("cell"), "given", "occ", "log_p"), [*by, "parent", "cell", "given", "occ"], "left")
    terms = terms.join(marginals.select(*by, "cell", "log_free", "log_occ"), [*by, "cell"], "left")
    own = F.when(F.col("occ") == 1, F.col("log_occ")).otherwise(F.col("log_free"))
    term = F.greatest(least, F.coalesce(F.when(F.col("parent").isNull(), own).otherwise(F.col("log_p")), least))
    return terms.groupBy(*keys).agg(F.sum(term).alias("score"), F.count_if(F.col("parent").isNull()).alias("roots"))


def _inside(cells: DataFrame, edges: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Edges whose two cells a grid knows; cells without any edge fall out."""
    a = cells.select(*keys, *[b for b in by if b not in keys], F.col("cell").alias("a"))
    b = cells.select(*keys, F.col("cell").alias("b"))
    return a.join(edges.select(*by, "a", "b", "mi"), [*by, "a"]).join(b, [*keys, "b"]).select(*keys, "a", "b", "mi")


def _heaviest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a grid's edges those of its maximum spanning forest, ties by the ends."""
    pdf, root = pdf.sort_values(["mi", "a", "b"], ascending=[False, True, True]), {}

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    take = []
    for x, y in zip(pdf.a, pdf.b, strict=True):
        p, q = top(x), top(y)
        take.append(p != q)
        root[max(p, q)] = min(p, q)
    return pdf[take]


def grid_forests(cells: DataFrame, edges: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Maximum spanning forest of each grid's own cells, as (keys, a, b, mi).

    A grid's cells are bounded by the model's window, so each grid is one array and one call; edges are joined by class and both
    ends first, which leaves out cells without any edge.
    """
    inside = _inside(cells, edges, keys, by)
    return inside.groupBy(*keys).applyInPandas(_heaviest, inside.schema)


def oriented_forests(cells: DataFrame, edges: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Nodes (keys, child, parent) of each grid's maximum spanning forest, parent null at roots (R3): the smallest cell of each tree is its root.

    One bounded fold a grid, as in grid_forests(). Cells without an edge are no nodes.
    """
    inside = _inside(cells, edges, keys, by)
    kind = inside.schema["a"].dataType.simpleString()

    def orient(pdf: pd.DataFrame) -> pd.DataFrame:
        beside: dict = {}
        for x, y in zip((chosen := _heaviest(pdf)).a.tolist(), chosen.b.tolist(), strict=True):
            beside.setdefault(x, []).append(y)
            beside.setdefault(y, []).append(x)
        parent: dict = {}
        for root in sorted(beside):
            if root in parent:
                continue
            parent[root], reached = None, [root]
            while reached:
                x = reached.pop()
                for y in beside[x]:
                    if y not in parent:
                        parent[y] = x
                        reached.append(y)
        out = pd.DataFrame({"child": list(parent), "parent": pd.array(list(parent.values()), "Int64")})
        return pdf[keys].iloc[:1].merge(out, how="cross")

    schema = ", ".join([*(f"`{k}` {inside.schema[k].dataType.simpleString()}" for k in keys), f"child {kind}", f"parent {kind}"])
    return inside.groupBy(*keys).applyInPandas(orient, schema)


def forest_scores(cells: DataFrame, edges: DataFrame, conditionals: DataFrame, marginals: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Rows (keys, score, nodes, roots): log probability of each grid under the maximum spanning forest of its own cells.

    Marginal terms at roots, conditional ones at children. cells has keys, by, cell and occ; conditionals hold each pair of cells both ways (models.both_ways());
    else as in tree_scores(). Cells without an edge are ignored; a grid without nodes scores 0.
    """
    forest = stored(oriented_forests(cells, edges, keys, by))
    nodes = cells.join(forest.select(*keys, F.col("child").alias("cell")), [*keys, "cell"])
    scored = tree_scores(nodes, forest.where("parent IS NOT NULL"), conditionals, marginals, keys, by)
    sizes = forest.groupBy(*keys).agg(F.count("*").alias("nodes"))
    every = cells.select(*keys).distinct().join(scored, keys, "left").join(sizes, keys, "left")
    return every.select(*keys, F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("nodes", F.lit(0).cast("long")).alias("nodes"), F.coalesce("roots", F.lit(0).cast("long")).alias("roots"))


def total_information(edges: DataFrame, by: list[str]) -> DataFrame:
    """Mutual information of a tree: the sum over its edges."""
    return edges.groupBy(*by).agg(F.sum("mi").alias("total_mi"), F.count("*").alias("n_edges"))

"""Queries from hits to grids, models, decisions and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import models, rays, scoring, training, trees
from ..registry import query
from ..sources.adapters import HITS_SQL, hits
from ..streaming import counts
from ..streaming import training as versions

RES, COARSE = 0.5, 1.0
SIZE = (3, 3, 1)
OBSERVED = 10


def grid_sql(res: float, where: str = "true") -> str:
    return f"""{HITS_SQL},
ends AS (SELECT scan_id, cls, hit_idx, CAST(round(x/{res}) AS INTEGER) AS ei, CAST(round(y/{res}) AS INTEGER) AS ej, CAST(round(z/{res}) AS INTEGER) AS ek FROM hits),
rays AS (SELECT *, greatest(abs(ei), abs(ej), abs(ek)) AS n FROM ends),
cells AS (
  SELECT scan_id, cls, s, n, CAST(CASE WHEN n = 0 THEN 0 ELSE sign(ei)*((2*abs(ei)*s+n)//(2*n)) END AS INTEGER) AS i,
         CAST(CASE WHEN n = 0 THEN 0 ELSE sign(ej)*((2*abs(ej)*s+n)//(2*n)) END AS INTEGER) AS j,
         CAST(CASE WHEN n = 0 THEN 0 ELSE sign(ek)*((2*abs(ek)*s+n)//(2*n)) END AS INTEGER) AS k
  FROM (SELECT *, CAST(unnest(range(n+1)) AS INTEGER) AS s FROM rays)),
grid AS (
  SELECT scan_id, cls, i, j, k, CAST(sum(CASE WHEN s < n THEN 1 ELSE 0 END) AS BIGINT) AS n_free, CAST(sum(CASE WHEN s < n THEN 0 ELSE 1 END) AS BIGINT) AS n_occ,
         sum(CASE WHEN s < n THEN 0 ELSE 1 END)*1.0::DOUBLE - sum(CASE WHEN s < n THEN 1 ELSE 0 END)*0.1::DOUBLE AS log_odds
  FROM cells WHERE {where} GROUP BY scan_id, cls, i, j, k)"""


IN_SIZE = "abs(i) <= 3 AND abs(j) <= 3 AND abs(k) <= 1"
KEYS = ["scan_id", "cls"]


def grid(spark: SparkSession, sf_dir: str, res: float = COARSE) -> DataFrame:
    return rays.occupancy_grid(hits(spark, sf_dir), res, KEYS)


def near_of(points: DataFrame) -> DataFrame:
    """The part of each grid that the models cover; the bound is applied before the aggregation."""
    return rays.occupancy(rays.trace(rays.ray_ends(points, COARSE), KEYS).where(models.window(*SIZE)), KEYS)


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_of(hits(spark, sf_dir))


@query(f"WITH {grid_sql(RES)} SELECT scan_id, cls, i, j, k, n_free, n_occ, round(log_odds, 6) AS log_odds FROM grid")
def occ_grid(spark, sf_dir):
    return grid(spark, sf_dir, RES).withColumn("log_odds", F.round("log_odds", 6))


POSED_SQL = f"""WITH {HITS_SQL},
posed AS (SELECT scan_id, cls, hit_idx, x, y, z, (scan_id % 5)*0.3 AS px, (scan_id % 3)*0.2 AS py, (scan_id % 2)*0.1 AS pz, (scan_id % 8)*0.4 AS t FROM hits),
ends AS (
  SELECT scan_id, hit_idx, CAST(round((cos(t)*(0.0-px) - sin(t)*(0.0-py))/1.0) AS INTEGER) AS si, CAST(round((sin(t)*(0.0-px) + cos(t)*(0.0-py))/1.0) AS INTEGER) AS sj, CAST(round(-pz/1.0) AS INTEGER) AS sk,
         CAST(round((cos(t)*(x-px) - sin(t)*(y-py))/1.0) AS INTEGER) AS ei, CAST(round((sin(t)*(x-px) + cos(t)*(y-py))/1.0) AS INTEGER) AS ej, CAST(round((z-pz)/1.0) AS INTEGER) AS ek FROM posed),
rays AS (SELECT *, greatest(abs(ei-si), abs(ej-sj), abs(ek-sk)) AS n FROM ends),
cells AS (
  SELECT scan_id, hit_idx, s, n, CAST(si + CASE WHEN n = 0 THEN 0 ELSE sign(ei-si)*((2*abs(ei-si)*s+n)//(2*n)) END AS INTEGER) AS i,
         CAST(sj + CASE WHEN n = 0 THEN 0 ELSE sign(ej-sj)*((2*abs(ej-sj)*s+n)//(2*n)) END AS INTEGER) AS j,
         CAST(sk + CASE WHEN n = 0 THEN 0 ELSE sign(ek-sk)*((2*abs(ek-sk)*s+n)//(2*n)) END AS INTEGER) AS k
  FROM (SELECT *, CAST(unnest(range(n+1)) AS INTEGER) AS s FROM rays)),
boxed AS (SELECT * FROM cells WHERE abs(i) < 6 AND abs(j) < 6 AND abs(k) < 3),
used AS (SELECT *, row_number() OVER (PARTITION BY scan_id, hit_idx, s = n ORDER BY s) AS rn FROM boxed)
SELECT scan_id, i, j, k, CAST(count(*) FILTER (WHERE s < n) AS BIGINT) AS n_free, CAST(count(*) FILTER (WHERE s = n) AS BIGINT) AS n_occ
FROM used WHERE s = n OR rn <= 4 GROUP BY scan_id, i, j, k"""


@query(POSED_SQL)
def occ_grid_posed_boxed(spark, sf_dir):
    s = F.col("scan_id")
    posed = hits(spark, sf_dir).withColumns({"px": s % 5 * 0.3, "py": s % 3 * 0.2, "pz": s % 2 * 0.1, "t": s % 8 * 0.4})
    return rays.occupancy_grid(posed, COARSE, ["scan_id"], ("px", "py", "pz", "t"), steps=5, box=(6, 6, 3)).drop("log_odds")


@query(f"""WITH {grid_sql(COARSE)},
lattice AS (SELECT CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j, 0 AS k FROM range(-1, 2) x(a), range(-1, 2) y(b)),
scans AS (SELECT vec_id AS scan_id, label AS cls FROM embeddings)
SELECT scan_id, i, j, k, grid.log_odds IS NOT NULL AS known, round(1/(1+exp(-coalesce(log_odds, 0))), 9) AS p
FROM scans CROSS JOIN lattice LEFT JOIN grid USING (scan_id, cls, i, j, k)""")
def occ_probability(spark, sf_dir):
    h = hits(spark, sf_dir)
    cells = h.select(*KEYS).distinct().join(F.broadcast(rays.box_lattice(spark, 1, 1, 0)))
    return rays.lookup(cells, grid(spark, sf_dir), KEYS).select("scan_id", "i", "j", "k", "known", F.round("p", 9).alias("p"))


@query(f"""WITH {grid_sql(COARSE)},
lattice AS (SELECT CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j, CAST(c AS INTEGER) AS k FROM range(-2, 3) x(a), range(-2, 3) y(b), range(-1, 2) z(c)),
scans AS (SELECT vec_id AS scan_id, label AS cls FROM embeddings)
SELECT scan_id, cls, i, j, k, CAST(1/(1+exp(-coalesce(log_odds, 0))) > 0.6 AS INTEGER) AS is_occ, CAST(1/(1+exp(-coalesce(log_odds, 0))) < 0.4 AS INTEGER) AS is_free
FROM scans CROSS JOIN lattice LEFT JOIN grid USING (scan_id, cls, i, j, k)""")
def dense_masks(spark, sf_dir):
    cells = hits(spark, sf_dir).select(*KEYS).distinct().join(F.broadcast(rays.box_lattice(spark, 2, 2, 1)))
    return rays.dense_masks(cells, grid(spark, sf_dir), KEYS)


@query(f"WITH {grid_sql(COARSE)} SELECT scan_id, cls, count(*) FILTER (WHERE {IN_SIZE})/147.0::DOUBLE AS fraction FROM grid GROUP BY scan_id, cls")
def fraction_known(spark, sf_dir):
    return rays.fraction_known(grid(spark, sf_dir), KEYS, *SIZE)


@query(f"WITH {grid_sql(COARSE)} SELECT scan_id, i, j, k, CASE WHEN log_odds > 0 THEN 1 ELSE 0 END AS occ FROM grid")
def binary_map(spark, sf_dir):
    return rays.binary_map(grid(spark, sf_dir)).select("scan_id", "i", "j", "k", "occ")


MARGINAL = f"""{grid_sql(COARSE, IN_SIZE)},
marginal AS (
  SELECT cls AS model_cls, i, j, k, CAST(count(*) FILTER (WHERE log_odds < 0) + 1 AS BIGINT) AS c_free, CAST(count(*) FILTER (WHERE log_odds > 0) + 1 AS BIGINT) AS c_occ
  FROM grid WHERE scan_id % 2 = 0 AND log_odds <> 0 GROUP BY ALL)"""


def marginal(spark, sf_dir):
    return models.marginal_model(near(spark, sf_dir).where("scan_id % 2 = 0").withColumnRenamed("cls", "model_cls"), ["model_cls"])


@query(f"WITH {MARGINAL} SELECT * FROM marginal")
def marginal_model(spark, sf_dir):
    return marginal(spark, sf_dir)


@query(f"""WITH {MARGINAL} SELECT model_cls, i, j, k, round(ln(greatest(1e-4, least(1 - 1e-4, c_occ/(c_occ+c_free)))), 9) AS log_occ,
  round(ln(1 - greatest(1e-4, least(1 - 1e-4, c_occ/(c_occ+c_free)))), 9) AS log_free FROM marginal""")
def occupancy_log_probs(spark, sf_dir):
    m = models.occupancy_log_probs(marginal(spark, sf_dir))
    return m.select("model_cls", "i", "j", "k", F.round("log_occ", 9).alias("log_occ"), F.round("log_free", 9).alias("log_free"))


#: Of all scans, where the models above leave the odd ones to be scored.
MARGINAL_WHOLE = MARGINAL.replace("WHERE scan_id % 2 = 0 AND log_odds <> 0", "WHERE log_odds <> 0")


def marginal_whole(spark, sf_dir):
    return models.marginal_model(near(spark, sf_dir).withColumnRenamed("cls", "model_cls"), ["model_cls"])


@query(f"WITH {MARGINAL_WHOLE} SELECT * FROM marginal")
def marginal_model_whole(spark, sf_dir):
    return marginal_whole(spark, sf_dir)


@query(f"""WITH {MARGINAL_WHOLE} SELECT model_cls, i, j, k, round(ln(greatest(1e-4, least(1 - 1e-4, c_occ/(c_occ+c_free)))), 9) AS log_occ,
  round(ln(1 - greatest(1e-4, least(1 - 1e-4, c_occ/(c_occ+c_free)))), 9) AS log_free FROM marginal""")
def occupancy_log_probs_whole(spark, sf_dir):
    m = models.occupancy_log_probs(marginal_whole(spark, sf_dir))
    return m.select("model_cls", "i", "j", "k", F.round("log_occ", 9).alias("log_occ"), F.round("log_free", 9).alias("log_free"))


SCORES = f"""{MARGINAL},
known AS (SELECT * FROM grid WHERE scan_id % 2 = 1 AND log_odds <> 0),
scores AS (
  SELECT scan_id, known.cls, c.model_cls, sum(ln(CASE WHEN log_odds > 0 THEN coalesce(c_occ, 1) ELSE coalesce(c_free, 1) END / (coalesce(c_occ, 1) + coalesce(c_free, 1)))) AS score
  FROM known CROSS JOIN (SELECT DISTINCT model_cls FROM marginal) c LEFT JOIN marginal m ON m.model_cls = c.model_cls AND m.i = known.i AND m.j = known.j AND m.k = known.k
  GROUP BY ALL),
decided AS (SELECT scan_id, cls, arg_min(model_cls, (-round(score, 9), model_cls)) AS predicted FROM scores GROUP BY ALL)"""


def scores(spark, sf_dir):
    return scoring.naive_bayes(near(spark, sf_dir).where("scan_id % 2 = 1"), marginal(spark, sf_dir), KEYS)


@query(f"WITH {SCORES} SELECT scan_id, cls, model_cls, round(score, 6) AS score FROM scores")
def naive_bayes_scores(spark, sf_dir):
    return scores(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"WITH {SCORES} SELECT * FROM decided")
def classify_argmax(spark, sf_dir):
    return scoring.argmax(scores(spark, sf_dir), KEYS)


@query(f"WITH {SCORES} SELECT cls, predicted, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (PARTITION BY cls), 6) AS percent FROM decided GROUP BY cls, predicted")
def confusion_matrix(spark, sf_dir):
    return scoring.confusion(scoring.argmax(scores(spark, sf_dir), KEYS)).withColumn("percent", F.round("percent", 6))


@query(f"WITH {SCORES} SELECT cls, " + ", ".join(f'count(*) FILTER (WHERE predicted = {c}) AS "{c}"' for c in range(10)) + " FROM decided GROUP BY cls")
def confusion_pivot(spark, sf_dir):
    return scoring.confusion_wide(scoring.argmax(scores(spark, sf_dir), KEYS), list(range(10)))


@query(f"WITH {SCORES} SELECT cls, predicted, count(*) AS n FROM decided GROUP BY ROLLUP (cls, predicted)")
def confusion_rollup(spark, sf_dir):
    return scoring.argmax(scores(spark, sf_dir), KEYS).rollup("cls", "predicted").agg(F.count("*").alias("n"))


@query(f"""WITH {SCORES}, e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY scan_id)) AS e FROM scores)
SELECT scan_id, model_cls, round(e/sum(e) OVER (PARTITION BY scan_id), 9) AS p FROM e""")
def class_softmax(spark, sf_dir):
    return scoring.softmax(scores(spark, sf_dir), ["scan_id"]).select("scan_id", "model_cls", F.round("p", 9).alias("p"))


JOINT = f"""{grid_sql(COARSE, IN_SIZE)},
state AS (SELECT scan_id, cls, i, j, k, CAST(log_odds > 0 AS INTEGER) AS o FROM grid WHERE log_odds <> 0),
joint AS (
  SELECT a.cls, a.i AS i1, a.j AS j1, a.k AS k1, b.i AS i2, b.j AS j2, b.k AS k2,
         count(*) FILTER (WHERE a.o = 0 AND b.o = 0) AS c00, count(*) FILTER (WHERE a.o = 1 AND b.o = 0) AS c10,
         count(*) FILTER (WHERE a.o = 0 AND b.o = 1) AS c01, count(*) FILTER (WHERE a.o = 1 AND b.o = 1) AS c11
  FROM state a JOIN state b ON a.scan_id = b.scan_id AND (a.i, a.j, a.k) < (b.i, b.j, b.k) GROUP BY ALL),
mi AS (
  SELECT *, (c00+c01+c10+c11)::DOUBLE AS n FROM joint)"""
TERM = "CASE WHEN c{a}{b}/n >= 1e-10 THEN c{a}{b}/n*ln((c{a}{b}/n)/(((c{a}0+c{a}1)/n)*((c0{b}+c1{b})/n))) ELSE 0 END"
MI = " + ".join(TERM.format(a=a, b=b) for a in "01" for b in "01")


def joint(spark, sf_dir):
    return models.joint_model(near(spark, sf_dir), ["scan_id"], ["cls"])


@query(f"WITH {JOINT} SELECT * FROM joint")
def joint_model(spark, sf_dir):
    return joint(spark, sf_dir)


@query(f"WITH {JOINT} SELECT cls, i1, j1, k1, i2, j2, k2, round({MI}, 9) AS mi FROM mi")
def mutual_information(spark, sf_dir):
    return joint(spark, sf_dir).select("cls", "i1", "j1", "k1", "i2", "j2", "k2", F.round(models.mutual_information(), 9).alias("mi"))


@query(f"""WITH {JOINT}, s AS (SELECT * FROM joint, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(given, occ)),
p AS (SELECT *, CASE WHEN given = 0 THEN CASE WHEN occ = 0 THEN c00 ELSE c01 END ELSE CASE WHEN occ = 0 THEN c10 ELSE c11 END END AS c,
  CASE WHEN given = 0 THEN c00 + c01 ELSE c10 + c11 END AS total FROM s)
SELECT cls, i1, j1, k1, i2, j2, k2, given, occ, CASE WHEN total = 0 THEN NULL WHEN c = 0 THEN '-Infinity'::DOUBLE ELSE round(ln(c/total), 9) END AS log_p FROM p""")
def conditional_table(spark, sf_dir):
    return models.conditional_table(joint(spark, sf_dir), ["cls"]).withColumn("log_p", F.when(F.col("log_p") == float("-inf"), F.col("log_p")).otherwise(F.round("log_p", 9)))


CELL = "CAST((({i}) + 3)*21 + (({j}) + 3)*3 + (({k}) + 1) AS INTEGER)"
EDGES = f"""{JOINT},
edges AS (
  SELECT cls, {CELL.format(i='i1', j='j1', k='k1')} AS a, {CELL.format(i='i2', j='j2', k='k2')} AS b, round({MI}, 9) AS mi
  FROM mi WHERE n >= {OBSERVED})"""


def cell(n: str = ""):
    return ((F.col(f"i{n}") + 3) * 21 + (F.col(f"j{n}") + 3) * 3 + F.col(f"k{n}") + 1).cast("int")


def edges(spark, sf_dir):
    e = trees.candidate_edges(joint(spark, sf_dir), OBSERVED)
    return e.select("cls", cell("1").alias("a"), cell("2").alias("b"), F.round("mi", 9).alias("mi"))


@query(f"WITH {EDGES} SELECT * FROM edges WHERE mi >= 0")
def clt_edges_candidates(spark, sf_dir):
    return edges(spark, sf_dir)


PARENTS = f"""{EDGES},
place AS (SELECT scan_id, cls, {CELL.format(i='i', j='j', k='k')} AS cell, row_number() OVER (PARTITION BY scan_id ORDER BY i, j, k) AS ord FROM state),
tried AS (
  SELECT c.scan_id, c.cls, c.cell AS child, p.cell AS parent, mi, p.ord AS po, c.ord AS co FROM place c JOIN edges e ON e.cls = c.cls AND e.b = c.cell AND mi >= 0
  JOIN place p ON p.scan_id = c.scan_id AND p.cell = e.a AND p.ord < c.ord)"""


def places(spark, sf_dir):
    known = near(spark, sf_dir).where("log_odds != 0")
    return known.select("scan_id", "cls", cell().alias("cell"), F.row_number().over(Window.partitionBy("scan_id").orderBy("i", "j", "k")).alias("ord"))


@query(f"WITH {PARENTS} SELECT scan_id, child, parent, mi FROM tried QUALIFY row_number() OVER (PARTITION BY scan_id, child ORDER BY mi DESC, po) = 1")
def greedy_tree_parent(spark, sf_dir):
    return trees.greedy_parents(places(spark, sf_dir), edges(spark, sf_dir), ["scan_id"], ["cls"])


@query(f"WITH {PARENTS} SELECT scan_id, child, parent, mi FROM tried WHERE co - po <= 10 QUALIFY row_number() OVER (PARTITION BY scan_id, child ORDER BY mi DESC, po) = 1")
def greedy_tree_parent_window(spark, sf_dir):
    return trees.greedy_parents(places(spark, sf_dir), edges(spark, sf_dir), ["scan_id"], ["cls"], span=10)


@query(f"""WITH {PARENTS}, best AS (SELECT scan_id, mi FROM tried QUALIFY row_number() OVER (PARTITION BY scan_id, child ORDER BY mi DESC, po) = 1)
SELECT scan_id, round(sum(mi), 6) AS total_mi, count(*) AS n_edges FROM best GROUP BY scan_id""")
def greedy_tree_total(spark, sf_dir):
    return trees.greedy_parents(places(spark, sf_dir), edges(spark, sf_dir), ["scan_id"], ["cls"]).transform(trees.total_information, ["scan_id"]).withColumn("total_mi", F.round("total_mi", 6))


@query(f"""WITH RECURSIVE {EDGES}, ranked AS MATERIALIZED (SELECT cls, a, b, mi, row_number() OVER (PARTITION BY cls ORDER BY mi DESC, a DESC, b DESC) AS n FROM edges WHERE mi >= 0),
classes AS (SELECT DISTINCT cls FROM ranked),
walk AS (
  SELECT cls, CAST(0 AS BIGINT) AS n, range(200) AS roots, false AS takes FROM classes UNION ALL
  SELECT cls, n, CASE WHEN ra = rb THEN roots ELSE list_transform(roots, lambda r: CASE WHEN r = ra THEN rb ELSE r END) END, ra <> rb FROM (
    SELECT w.cls, r.n, w.roots, w.roots[r.a + 1] AS ra, w.roots[r.b + 1] AS rb FROM walk w JOIN ranked r ON r.cls = w.cls AND r.n = w.n + 1))
SELECT r.cls, a, b, mi FROM walk w JOIN ranked r ON r.cls = w.cls AND r.n = w.n WHERE takes""")
def mst_chow_liu(spark, sf_dir):
    return trees.spanning_forest(edges(spark, sf_dir), ["cls"])


MARGIN = f"""marg AS (
  SELECT cls, {CELL.format(i='i', j='j', k='k')} AS cell, ln((count(*) FILTER (WHERE log_odds < 0) + 1)/(count(*) + 2)) AS log_free, ln((count(*) FILTER (WHERE log_odds > 0) + 1)/(count(*) + 2)) AS log_occ
  FROM grid WHERE log_odds <> 0 GROUP BY ALL)"""


@query(f"""WITH {PARENTS}, {MARGIN},
best AS (SELECT scan_id, child, parent FROM tried QUALIFY row_number() OVER (PARTITION BY scan_id, child ORDER BY mi DESC, po) = 1),
known AS (SELECT scan_id, cls, {CELL.format(i='i', j='j', k='k')} AS cell, o FROM state),
cond AS (
  SELECT cls, {CELL.format(i='i1', j='j1', k='k1')} AS a, {CELL.format(i='i2', j='j2', k='k2')} AS b, given, occ, CASE WHEN t > 0 AND c > 0 THEN ln(c/t) END AS log_p FROM (
    SELECT *, CASE WHEN given = 0 THEN c00 + c01 ELSE c10 + c11 END AS t, CASE given*2 + occ WHEN 0 THEN c00 WHEN 1 THEN c01 WHEN 2 THEN c10 ELSE c11 END AS c
    FROM joint, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(given, occ))),
terms AS (
  SELECT k.scan_id, b.parent, greatest(-227.95592420641055, coalesce(CASE WHEN b.parent IS NULL THEN CASE WHEN k.o = 1 THEN log_occ ELSE log_free END ELSE log_p END, -227.95592420641055)) AS term
  FROM known k LEFT JOIN best b ON b.scan_id = k.scan_id AND b.child = k.cell LEFT JOIN known p ON p.scan_id = k.scan_id AND p.cell = b.parent
  LEFT JOIN cond ON cond.cls = k.cls AND cond.a = b.parent AND cond.b = k.cell AND cond.given = p.o AND cond.occ = k.o LEFT JOIN marg m ON m.cls = k.cls AND m.cell = k.cell)
SELECT scan_id, round(sum(term), 5) AS score, count(*) FILTER (WHERE parent IS NULL) AS roots FROM terms GROUP BY scan_id""")
def greedy_tree_score(spark, sf_dir):
    known = near(spark, sf_dir).where("log_odds != 0")
    j = joint(spark, sf_dir)
    conditional = models.conditional_table(j, ["cls"]).select("cls", cell("1").alias("a"), cell("2").alias("b"), "given", "occ", "log_p")
    marginals = models.marginal_log_probs(models.marginal_model(known, ["cls"])).select("cls", cell().alias("cell"), "log_free", "log_occ")
    parents = trees.greedy_parents(places(spark, sf_dir), edges(spark, sf_dir), ["scan_id"], ["cls"])
    cells = known.select("scan_id", "cls", cell().alias("cell"), (F.col("log_odds") > 0).cast("int").alias("occ"))
    return trees.tree_scores(cells, parents, conditional, marginals, ["scan_id"], ["cls"]).select("scan_id", F.round("score", 5).alias("score"), "roots")


#: Kruskal's order over each scan's own edges, with the components' labels in a list.
FORESTS = f"""{PARENTS},
known AS (SELECT scan_id, cls, {CELL.format(i='i', j='j', k='k')} AS cell, o FROM state),
inside AS MATERIALIZED (
  SELECT x.scan_id, e.a, e.b, e.mi, row_number() OVER (PARTITION BY x.scan_id ORDER BY mi DESC, a, b) AS n
  FROM edges e JOIN known x ON x.cls = e.cls AND x.cell = e.a JOIN known y ON y.scan_id = x.scan_id AND y.cell = e.b WHERE mi >= 0),
walk AS (
  SELECT scan_id, CAST(0 AS BIGINT) AS n, range(200) AS roots, false AS takes FROM inside GROUP BY ALL UNION ALL
  SELECT scan_id, n, CASE WHEN ra = rb THEN roots ELSE list_transform(roots, lambda r: CASE WHEN r = ra THEN rb ELSE r END) END, ra <> rb FROM (
    SELECT w.scan_id, r.n, w.roots, w.roots[r.a + 1] AS ra, w.roots[r.b + 1] AS rb FROM walk w JOIN inside r ON r.scan_id = w.scan_id AND r.n = w.n + 1)),
forest AS MATERIALIZED (SELECT r.scan_id, a, b, mi FROM walk w JOIN inside r ON r.scan_id = w.scan_id AND r.n = w.n WHERE takes)"""


@query(f"WITH RECURSIVE {FORESTS} SELECT scan_id, a, b, mi FROM forest")
def grid_forests(spark, sf_dir):
    return trees.grid_forests(places(spark, sf_dir), edges(spark, sf_dir), ["scan_id"], ["cls"])


@query(f"""WITH RECURSIVE {FORESTS},
ways AS MATERIALIZED (SELECT scan_id, a AS x, b AS y FROM forest UNION ALL SELECT scan_id, b, a FROM forest),
last AS (SELECT scan_id, arg_max(roots, n) AS roots FROM walk GROUP BY scan_id),
labelled AS (SELECT w.scan_id, w.x, l.roots[w.x + 1] AS tree FROM (SELECT DISTINCT scan_id, x FROM ways) w JOIN last l ON l.scan_id = w.scan_id),
nodes AS (
  SELECT scan_id, min(x) AS child, CAST(NULL AS INTEGER) AS parent FROM labelled GROUP BY scan_id, tree UNION ALL
  SELECT n.scan_id, w.y, n.child FROM nodes n JOIN ways w ON w.scan_id = n.scan_id AND w.x = n.child AND w.y IS DISTINCT FROM n.parent),
pairs AS (
  SELECT cls, {CELL.format(i='i1', j='j1', k='k1')} AS a, {CELL.format(i='i2', j='j2', k='k2')} AS b, c00, c01, c10, c11 FROM joint UNION ALL
  SELECT cls, {CELL.format(i='i2', j='j2', k='k2')}, {CELL.format(i='i1', j='j1', k='k1')}, c00, c10, c01, c11 FROM joint),
cond AS (
  SELECT cls, a, b, given, occ, CASE WHEN t > 0 AND c > 0 THEN ln(c/t) END AS log_p FROM (
    SELECT *, CASE WHEN given = 0 THEN c00 + c01 ELSE c10 + c11 END AS t, CASE given*2 + occ WHEN 0 THEN c00 WHEN 1 THEN c01 WHEN 2 THEN c10 ELSE c11 END AS c
    FROM pairs, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(given, occ))),
marg AS (SELECT cls, cell, count(*) AS t, sum(o) AS c_occ FROM known GROUP BY ALL),
terms AS (
  SELECT n.scan_id, n.parent, greatest(-227.95592420641055, coalesce(CASE WHEN n.parent IS NOT NULL THEN c.log_p WHEN k.o = 1 THEN CASE WHEN m.c_occ > 0 THEN ln(m.c_occ/m.t) END ELSE CASE WHEN m.t > m.c_occ THEN ln((m.t - m.c_occ)/m.t) END END, -227.95592420641055)) AS term
  FROM nodes n JOIN known k ON k.scan_id = n.scan_id AND k.cell = n.child LEFT JOIN known p ON p.scan_id = n.scan_id AND p.cell = n.parent
  LEFT JOIN cond c ON c.cls = k.cls AND c.a = n.parent AND c.b = n.child AND c.given = p.o AND c.occ = k.o LEFT JOIN marg m ON m.cls = k.cls AND m.cell = k.cell),
sums AS (SELECT scan_id, sum(term) AS score, count(*) AS nodes, count(*) FILTER (WHERE parent IS NULL) AS roots FROM terms GROUP BY scan_id)
SELECT s.scan_id, round(coalesce(score, 0), 6) AS score, coalesce(nodes, 0) AS nodes, coalesce(roots, 0) AS roots FROM (SELECT DISTINCT scan_id FROM known) s LEFT JOIN sums USING (scan_id)""")
def forest_scores(spark, sf_dir):
    """The score of each scan under the maximum spanning forest of its own cells: what the trees are for."""
    known, j = near(spark, sf_dir).where("log_odds != 0"), trees.stored(joint(spark, sf_dir))
    conditional = models.conditional_table(models.both_ways(j, ["cls"]), ["cls"]).select("cls", cell("1").alias("a"), cell("2").alias("b"), "given", "occ", "log_p")
    marginals = models.marginal_log_probs(models.marginal_model(known, ["cls"], prior=0)).select("cls", cell().alias("cell"), "log_free", "log_occ")
    candidates = trees.candidate_edges(j, OBSERVED).select("cls", cell("1").alias("a"), cell("2").alias("b"), F.round("mi", 9).alias("mi"))
    cells = known.select("scan_id", "cls", cell().alias("cell"), (F.col("log_odds") > 0).cast("int").alias("occ"))
    return trees.forest_scores(cells, candidates, conditional, marginals, ["scan_id"], ["cls"]).withColumn("score", F.round("score", 6))


@query(f"""WITH {EDGES}, busy AS (SELECT cls, {CELL.format(i='i', j='j', k='k')} AS cell FROM grid WHERE log_odds <> 0 GROUP BY ALL HAVING count(*) FILTER (WHERE log_odds > 0) / count(*) > 0.1)
SELECT e.* FROM edges e JOIN busy p ON p.cls = e.cls AND p.cell = e.a JOIN busy q ON q.cls = e.cls AND q.cell = e.b WHERE mi >= 0""")
def rendered_edges(spark, sf_dir):
    counted = models.marginal_model(near(spark, sf_dir), ["cls"], prior=0).select("cls", cell().alias("cell"), "c_free", "c_occ")
    return trees.rendered(edges(spark, sf_dir), counted, ["cls"])


@query(f"""WITH {MARGINAL} SELECT scan_id, round(sum(ln(CASE WHEN log_odds > 0 THEN c_occ ELSE c_free END/(c_occ + c_free))), 6) AS score
FROM grid JOIN marginal m ON m.model_cls = grid.cls AND m.i = grid.i AND m.j = grid.j AND m.k = grid.k WHERE log_odds <> 0 GROUP BY scan_id""")
def marginal_tree_score(spark, sf_dir):
    probs = models.marginal_log_probs(marginal(spark, sf_dir)).withColumnRenamed("model_cls", "cls")
    return scoring.marginal_tree_score(near(spark, sf_dir), probs, ["scan_id"], ["cls"]).withColumn("score", F.round("score", 6))


FRAMES = (1, 3, 5, 7, 9)


def _trained(r: int, frame: int) -> str:
    """SQL of one step of importance training, from model m{r} to m{r + 1}."""
    return f"""
k{r} AS MATERIALIZED (SELECT * FROM grid WHERE scan_id % 10 = {frame} AND log_odds <> 0),
s{r} AS MATERIALIZED (
  SELECT scan_id, k.cls, c.model_cls, sum(ln(CASE WHEN log_odds > 0 THEN coalesce(c_occ, 1) ELSE coalesce(c_free, 1) END / (coalesce(c_occ, 1) + coalesce(c_free, 1)))) AS score
  FROM k{r} k CROSS JOIN (SELECT DISTINCT model_cls FROM m{r}) c LEFT JOIN m{r} m ON m.model_cls = c.model_cls AND m.i = k.i AND m.j = k.j AND m.k = k.k GROUP BY ALL),
d{r} AS (SELECT scan_id, cls, arg_min(model_cls, (-round(score, 9), model_cls)) AS predicted, max(score) - max(score) FILTER (WHERE model_cls = cls) AS lead FROM s{r} GROUP BY ALL),
w{r} AS (SELECT *, CAST(ceil(round(lead, 6)*1000) AS BIGINT) + 1 AS w FROM d{r} WHERE predicted <> cls),
x{r} AS (SELECT *, sum(w) OVER (PARTITION BY cls ORDER BY scan_id ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY cls) AS total, count(*) OVER (PARTITION BY cls) AS n FROM w{r}),
t{r} AS MATERIALIZED (SELECT scan_id FROM x{r} WHERE n < 10 OR run*10//total > (run - w)*10//total),
a{r} AS (SELECT cls AS model_cls, i, j, k, count(*) FILTER (WHERE log_odds < 0) AS c_free, count(*) FILTER (WHERE log_odds > 0) AS c_occ FROM k{r} WHERE scan_id IN (SELECT scan_id FROM t{r}) GROUP BY ALL),
m{r + 1} AS MATERIALIZED (SELECT model_cls, i, j, k, CAST(greatest(1, sum(c_free)) AS BIGINT) AS c_free, CAST(greatest(1, sum(c_occ)) AS BIGINT) AS c_occ FROM (SELECT * FROM m{r} UNION ALL SELECT * FROM a{r}) GROUP BY ALL)"""


HARD = f"WITH {MARGINAL}, m0 AS MATERIALIZED (SELECT * FROM marginal)," + ",".join(_trained(r, n) for r, n in enumerate(FRAMES)) + f" SELECT * FROM m{len(FRAMES)}"


@query(HARD)
def hard_training(spark, sf_dir):
    g = near(spark, sf_dir)
    frames = [g.where(f"scan_id % 10 = {n}") for n in FRAMES]
    return training.hard_rounds(frames, marginal(spark, sf_dir), trees.stored)


#: Files that a frame of scans is written in.
FILES = 4


@query(HARD)
def stream_training(spark, sf_dir):
    """Importance training on a stream of scan files: the frames of hard_training(), a micro-batch each, give the same model."""
    points, folder = hits(spark, sf_dir), trees.shared_folder(spark, "stream")
    versions.write_frames([points.where(f"scan_id % 10 = {n}") for n in FRAMES], f"{folder}/frames", FILES)
    stream = versions.frame_stream(spark, f"{folder}/frames", points.schema, FILES)
    learn = lambda batch, model: training.hard_round(near_of(batch), model)
    versions.train_versions(stream, marginal(spark, sf_dir), learn, f"{folder}/model", f"{folder}/mark").awaitTermination()
    return versions.model_version(spark, f"{folder}/model", versions.latest_version(spark, f"{folder}/model"))


@query(f"""WITH {grid_sql(COARSE)} SELECT cls, i, j, k, CAST(sum(n_free) AS BIGINT) AS n_free, CAST(sum(n_occ) AS BIGINT) AS n_occ FROM grid GROUP BY ALL""")
def stream_counts(spark, sf_dir):
    """Additive counts of a stream of scan files, a snapshot a batch, and their sum."""
    points, folder = hits(spark, sf_dir), trees.shared_folder(spark, "stream")
    versions.write_frames([points.where(f"scan_id % 5 = {n}") for n in range(5)], f"{folder}/frames", FILES)
    counts.train(counts.scan_stream(spark, f"{folder}/frames", points.schema, FILES), COARSE, ["cls"], f"{folder}/counts", f"{folder}/mark").awaitTermination()
    return counts.model(spark, f"{folder}/counts", ["cls"])

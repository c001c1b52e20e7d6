"""Queries of scaling, filters, markers, annotation, decompositions and plot frames; SQL computes their values or invariants.

A decomposition of full rank is held against what every such decomposition has in common: the squared lengths of
its rows and columns are those of the matrix it was taken from, after centring or projection where that was asked.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmat.operators import annotation as A
from sparkmat.operators import decomposition as D
from sparkmat.operators import graph as G
from sparkmat.operators import matrix as M
from sparkmat.operators import network as N
from sparkmat.operators import plotdata as P
from sparkmat.operators.lazy import create_lazy_transform
from sparkmat.plans.analysis import smoothed
from sparkmat.plans.tables import CELLS, EDGES, MATRIX, groups, matrix, table, whole_graph

_N = "(SELECT count(*) FROM C)"


def _obs(s, d):
    return groups(s, d).select("cell")


def _var(s):
    return s.range(50).select(F.col("id").alias("gene"))


def _large(s, d):
    """Entries of 150 or more: some cells and genes have none."""
    return matrix(s, d).where("value >= 150")


_L = f"{MATRIX}, L AS (SELECT * FROM X WHERE value >= 150)"


def _masks(s, d):
    cells, genes = M.filter_axes(_large(s, d), _obs(s, d), _var(s), min_cells=0.02, min_genes=2, min_total=200)
    a = M.mask_table(_obs(s, d), cells, "cell").select(F.lit("cell").alias("axis"), F.col("cell").alias("id"), "keep")
    return a.unionByName(M.mask_table(_var(s), genes, "gene").select(F.lit("gene").alias("axis"), F.col("gene").alias("id"), "keep"))


def _masks_sql(rounds: int = 8) -> str:
    parts = [_L, CELLS, "K0 AS (SELECT cell FROM C)", "J0 AS (SELECT range AS gene FROM range(50))"]
    for i in range(rounds):
        parts += [
            f"N{i} AS MATERIALIZED (SELECT L.* FROM L JOIN K{i} USING (cell) JOIN J{i} USING (gene))",
            f"K{i + 1} AS MATERIALIZED (SELECT cell FROM K{i} LEFT JOIN (SELECT cell, sum(value) AS t, count(*) AS n FROM N{i} GROUP BY 1) USING (cell) WHERE coalesce(t, 0) >= 200 AND coalesce(n, 0) >= 2)",
            f"J{i + 1} AS MATERIALIZED (SELECT gene FROM J{i} LEFT JOIN (SELECT gene, count(*) AS n FROM N{i} GROUP BY 1) USING (gene) WHERE coalesce(n, 0) >= ceil(0.02 * (SELECT count(*) FROM K{i})))",
        ]
    return f"WITH {', '.join(parts)} SELECT 'cell' AS axis, cell AS id, cell IN (SELECT cell FROM K{rounds}) AS keep FROM C UNION ALL SELECT 'gene', gene, gene IN (SELECT gene FROM J{rounds}) FROM J0"


def _marker_table(s):
    return s.range(20).select((F.col("id") % 4).alias("label"), F.col("id").alias("gene"), F.lit(1.0).alias("weight"))


_M = "M AS (SELECT gene % 4 AS label, gene, 1.0 AS weight FROM range(20) t(gene))"
_LOG = "ln(10.0)"
_SPEC = f"""{MATRIX}, {CELLS}, U AS (SELECT * FROM C WHERE grp < 10), Z AS (SELECT grp, count(*) AS n FROM U GROUP BY 1), Q AS (SELECT cell, count(*) / 50.0 AS q FROM X GROUP BY 1), MQ AS (SELECT sum(q) / {_N} AS mq FROM Q),
    GA AS (SELECT grp, sum(g) AS g1, sum(g * g) AS g2, max(g) AS gm FROM (SELECT grp, q / mq / n AS g FROM U JOIN Z USING (grp) JOIN Q USING (cell) CROSS JOIN MQ) GROUP BY 1),
    GE AS (SELECT gene, count(*) * 1.0 / {_N} AS p, avg(value) AS r FROM X GROUP BY 1), O AS (SELECT grp, gene, sum(value) / max(n) AS profile FROM X JOIN U USING (cell) JOIN Z USING (grp) GROUP BY 1, 2),
    LA AS (SELECT grp, gene, profile - p * r * g1 AS lam, p * r * r * g2 AS nu, r * gm AS a FROM O JOIN GE USING (gene) JOIN GA USING (grp)),
    S0 AS (SELECT grp, gene, greatest(CASE WHEN lam > 0 THEN lam * lam / (2 * (nu + lam * a / 3)) / {_LOG} ELSE 0 END - CASE WHEN lam < 0 THEN lam * lam / (2 * nu) / {_LOG} ELSE 0 END, 0) AS score FROM LA),
    SC AS (SELECT grp, gene, round(coalesce(score, 0), 9) AS score FROM (SELECT DISTINCT gene FROM X) g CROSS JOIN Z LEFT JOIN S0 USING (grp, gene))"""


def _markers(s, d, result):
    return A.find_markers(matrix(s, d), groups(s, d), _obs(s, d).count(), 50, result, 5, labels_use=list(range(10)))


def _as_nodes(s, d):
    """The matrix with cells as the suppliers of the graph."""
    return matrix(s, d).withColumn("cell", 2 * F.col("cell"))


def _network_sql(rounds: int = 2, alpha: float = 0.85) -> list[str]:
    return [MATRIX, EDGES, _M, *smoothed("SELECT 2 * cell AS node, gene, value FROM X JOIN M USING (gene)", rounds, alpha, "gene"),
            f"S1 AS (SELECT node, label, sum(value * weight) AS value FROM D{rounds} JOIN M USING (gene) GROUP BY 1, 2)", "F AS (SELECT DISTINCT src AS node FROM G)",
            "S2 AS (SELECT node, label, coalesce(value, 0) AS value FROM F CROSS JOIN (SELECT DISTINCT label FROM M) l LEFT JOIN S1 USING (node, label))",
            "ST AS MATERIALIZED (SELECT node, label, value - avg(value) OVER (PARTITION BY label) AS value FROM S2)"]


def _vision_sql(rounds: int = 2, alpha: float = 0.85) -> list[str]:
    return [MATRIX, EDGES, _M, "R AS (SELECT cell, sum(value) / 50 AS mu, (sum(value * value) - sum(value) * sum(value) / 50) / 49 AS v FROM X GROUP BY 1)", "T AS (SELECT label, sum(weight) AS m FROM M GROUP BY 1)",
            "V AS (SELECT cell, label, sum(value) AS s FROM X JOIN M USING (gene) GROUP BY 1, 2)",
            *smoothed("SELECT 2 * cell AS node, label, CASE WHEN v > 0 THEN (coalesce(s, 0) - mu * m) / sqrt(v * m) ELSE 0 END AS value FROM R CROSS JOIN T LEFT JOIN V USING (cell, label)", rounds, alpha, "label"), f"ST AS (SELECT * FROM D{rounds})"]


_LOG_P = ["UP AS MATERIALIZED (SELECT node, label, greatest(value, 0) AS value FROM ST)", "W AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS weight FROM G)", "PR AS (SELECT label, sum(value) / (SELECT count(DISTINCT node) FROM ST) AS p FROM UP GROUP BY 1)",
          "RW AS (SELECT src, sum(weight) AS w1, sum(weight * weight) AS w2, max(weight) AS a FROM W GROUP BY 1)", "OB AS (SELECT src, label, sum(weight * value) AS obs FROM W JOIN UP ON dst = node GROUP BY 1, 2)",
          "LM AS (SELECT src AS node, label, obs - w1 * p AS lam, w2 * p AS nu, a FROM OB JOIN RW USING (src) JOIN PR USING (label))", "LP AS (SELECT node, label, CASE WHEN lam > 0 AND nu + lam * a / 3 > 0 THEN lam * lam / (2 * (nu + lam * a / 3)) ELSE 0 END AS value FROM LM)"]


def _annotate(s, d, method, table_name):
    return A.annotate(_as_nodes(s, d), _marker_table(s), whole_graph(s, d), 50, method, 0.85, 2, log_p=True)[table_name]


def _lengths(f, names=("cell", "length")):
    square = F.aggregate("vec", F.lit(0.0), lambda t, v: t + v * v)
    return f.reduction().select(F.col("cell").alias(names[0]), F.round(square, 3).alias(names[1]))


def _gene_lengths(s, d):
    f = D.run_svd(matrix(s, d), 50)
    rows = [(int(g), round(float(((v * f.d) ** 2).sum()), 3)) for g, v in zip(f.names, f.genes)]
    return s.createDataFrame(rows, "gene long, length double")


_DENSE = f"{MATRIX}, {CELLS}, MU AS (SELECT gene, sum(value) / (SELECT count(DISTINCT cell) FROM X) AS mu FROM X GROUP BY 1), Y AS MATERIALIZED (SELECT cell, gene, coalesce(value, 0) - mu AS y FROM (SELECT DISTINCT cell FROM X) c CROSS JOIN MU LEFT JOIN X USING (cell, gene))"
_BATCH = f"""WITH {_DENSE}, B1 AS (SELECT gene, sum(CASE WHEN grp % 2 = 0 THEN value ELSE 0 END) AS a, sum(CASE WHEN grp % 2 = 1 THEN value ELSE 0 END) AS b FROM X JOIN C USING (cell) GROUP BY 1),
    U1 AS (SELECT gene, a / sqrt(sum(a * a) OVER ()) AS u, b FROM B1), W1 AS (SELECT gene, u, b - u * sum(u * b) OVER () AS w FROM U1), Z AS (SELECT gene, u, w / sqrt(sum(w * w) OVER ()) AS w FROM W1)
    SELECT cell, round(sum(y * y) - pow(sum(y * u), 2) - pow(sum(y * w), 2), 3) AS length FROM Y JOIN Z USING (gene) GROUP BY 1"""


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("cell"), F.col("embedding").cast("array<double>").alias("vec"))


def _spa_sql(k: int = 6) -> str:
    parts = ["R0 AS MATERIALIZED (SELECT vec_id AS cell, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"]
    for i in range(k):
        parts += [f"T{i} AS MATERIALIZED (SELECT cell, v, sqrt(list_inner_product(v, v)) AS n FROM R{i} ORDER BY round(list_inner_product(v, v), 12) DESC, cell LIMIT 1)",
                  f"R{i + 1} AS MATERIALIZED (SELECT R{i}.cell, list_transform(range(1, len(R{i}.v) + 1), lambda j: R{i}.v[j] - list_inner_product(R{i}.v, T{i}.v) / (T{i}.n * T{i}.n) * T{i}.v[j]) AS v FROM R{i}, T{i})"]
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT {i} AS rank, cell, round(n, 6) AS norm FROM T{i}" for i in range(k))


_LAB = """WITH K AS (SELECT vec_id AS node, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings), S AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, min(c) AS c0, max(c) AS c1 FROM K),
    L AS (SELECT node, (20 + 70 * (a - a0) / (a1 - a0) + 16) / 116 AS fy, (160 * (b - b0) / (b1 - b0) - 80) / 500 AS da, (160 * (c - c0) / (c1 - c0) - 80) / 200 AS db FROM K, S),
    XYZ AS (SELECT node, 0.95047 * CASE WHEN fy + da > 6.0 / 29 THEN pow(fy + da, 3) ELSE 3 * pow(6.0 / 29, 2) * (fy + da - 4.0 / 29) END AS x, CASE WHEN fy > 6.0 / 29 THEN pow(fy, 3) ELSE 3 * pow(6.0 / 29, 2) * (fy - 4.0 / 29) END AS y, 1.08883 * CASE WHEN fy - db > 6.0 / 29 THEN pow(fy - db, 3) ELSE 3 * pow(6.0 / 29, 2) * (fy - db - 4.0 / 29) END AS z FROM L),
    RGB AS (SELECT node, 3.2406 * x - 1.5372 * y - 0.4986 * z AS r, -0.9689 * x + 1.8758 * y + 0.0415 * z AS g, 0.0557 * x - 0.2040 * y + 1.0570 * z AS b FROM XYZ)
    SELECT node, """ + ", ".join(f"round(least(1.0, greatest(0.0, CASE WHEN {c} <= 0.0031308 THEN 12.92 * {c} ELSE 1.055 * pow(greatest({c}, 0), 1 / 2.4) - 0.055 END)), 6) AS {c}" for c in "rgb") + " FROM RGB"

_VIOLIN = """WITH S AS (SELECT event_type AS grp, count(value) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1 HAVING count(value) > 1 AND stddev_samp(value) > 0), H AS (SELECT *, sd * pow(n, -0.2) AS h FROM S),
    B AS (SELECT grp, h, floor(value / h * 16) AS bin, count(value) AS c, avg(value) AS v FROM events JOIN H ON grp = event_type GROUP BY ALL), A AS (SELECT grp, h, lo + (hi - lo) * i / 63 AS pt FROM H, range(64) t(i)),
    D AS (SELECT A.grp, pt, sum(c * exp(-pow((pt - v) / A.h, 2) / 2)) AS d FROM A JOIN B ON A.grp = B.grp GROUP BY ALL) SELECT grp, round(pt, 6) AS point, round(0.4 * d / max(d) OVER (PARTITION BY grp), 6) AS width FROM D"""

_XI = """WITH R AS (SELECT o_orderpriority AS grp, o_totalprice AS x, o_orderkey AS pos, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey RANGE UNBOUNDED PRECEDING) AS r, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey DESC RANGE UNBOUNDED PRECEDING) AS l, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
    D AS (SELECT *, abs(r - lag(r) OVER (PARTITION BY grp ORDER BY x, pos)) AS d, row_number() OVER w AS q, sum(CAST(r AS DOUBLE)) OVER (w ROWS UNBOUNDED PRECEDING) AS v FROM R WINDOW w AS (PARTITION BY grp ORDER BY r, pos)),
    T AS (SELECT grp, max(n)::DOUBLE AS n, sum(d) AS sd, sum(l * (n - l))::DOUBLE AS ll, sum((2 * (n - q) + 1) * r * r::DOUBLE) AS a, sum(pow(v + (n - q) * r, 2)) AS b, sum((2 * (n - q) + 1) * r::DOUBLE) AS c FROM D GROUP BY 1)
    SELECT grp, round(1 - n * sd / (2 * ll), 6) AS xi, round((1 - n * sd / (2 * ll)) / sqrt((a / pow(n, 4) - 2 * b / pow(n, 5) + pow(c / pow(n, 3), 2)) / pow(ll / pow(n, 3), 2) / n), 6) AS z FROM T"""


def _points(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


def _frame(s, d):
    part = table(s, d, "part")
    price = part.select(F.col("p_partkey").alias("node"), F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("value"))
    return P.embedding_frame(_points(s, d), price, vmin=1000.0, vmax=1500.0)


_ABUNDANCE = f"""{MATRIX}, {CELLS}, F AS (SELECT * FROM (VALUES (1), (1), (2), (60)) t(gene)), A AS (SELECT cell, sum(value * coalesce(k, 0)) AS part, sum(value) AS total FROM X LEFT JOIN (SELECT gene, count(*) AS k FROM F GROUP BY 1) f USING (gene) GROUP BY 1)"""


def _features(s):
    return s.createDataFrame([(1,), (1,), (2,), (60,)], "gene long")


#: name -> (query, oracle)
ALL = {
    "scale": (lambda s, d: M.standardize(matrix(s, d), _obs(s, d)), f"WITH {MATRIX}, {CELLS}, T AS (SELECT gene, sum(value) AS s, sum(value * value) AS q FROM X GROUP BY 1), S AS (SELECT gene, s / {_N} AS mu, sqrt(greatest((q - s * s / {_N}) / ({_N} - 1), 0)) AS sd FROM T) SELECT C.cell, S.gene, round((coalesce(value, 0) - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS value FROM C CROSS JOIN S LEFT JOIN X ON X.cell = C.cell AND X.gene = S.gene"),
    "column_scores": (lambda s, d: M.column_scores(_large(s, d), _obs(s, d).count()), f"WITH {_L}, {CELLS}, T AS (SELECT gene, sum(value) AS s, sum(value * value) AS q FROM L GROUP BY 1) SELECT gene, round(s / {_N}, 6) AS mean, round(CASE WHEN (q - s * s / {_N}) > 0 THEN sqrt((q - s * s / {_N}) / ({_N} - 1)) ELSE 1 END, 6) AS sd FROM T"),
    "matrix_sums_all": (lambda s, d: M.matrix_sums(matrix(s, d), None), f"WITH {MATRIX} SELECT sum(value) AS total, count(*) AS nnz FROM X"),
    "matrix_sums_with_zeros": (lambda s, d: M.matrix_sums(_large(s, d), "cell", _obs(s, d)), f"WITH {_L}, {CELLS} SELECT C.cell, coalesce(sum(value), 0) AS total, count(value) AS nnz FROM C LEFT JOIN L USING (cell) GROUP BY 1"),
    "restricted_sums": (lambda s, d: M.restricted_sums(_large(s, d), "gene", groups(s, d).where("grp < 8"), _var(s).where("gene % 3 = 0")), f"WITH {_L}, {CELLS}, R AS (SELECT L.* FROM L JOIN C USING (cell) WHERE grp < 8) SELECT g.gene, coalesce(sum(value), 0) AS total, count(value) AS nnz, coalesce(sum(value * value), 0) AS sum_sq FROM (SELECT range AS gene FROM range(50) WHERE range % 3 = 0) g LEFT JOIN R USING (gene) GROUP BY 1"),
    "row_chunks": (lambda s, d: M.row_chunks(matrix(s, d), 3, 8, _var(s).where("gene < 20")), f"WITH {MATRIX} SELECT cell, gene, value FROM X WHERE cell >= 3 AND cell < 8 AND gene < 20"),
    "global_min": (lambda s, d: M.global_min(matrix(s, d), _obs(s, d).count(), 50), f"WITH {MATRIX}, {CELLS} SELECT CAST(CASE WHEN count(*) >= {_N} * 50 THEN min(value) ELSE least(min(value), 0) END AS DOUBLE) AS global_min FROM X"),
    "apply_rowwise": (lambda s, d: M.apply_rowwise(matrix(s, d), lambda block, first, n: block * 2 - block.max(1, keepdims=True), _obs(s, d), 50, 16), f"WITH {MATRIX}, {CELLS}, Y AS (SELECT C.cell, g.gene, coalesce(value, 0) AS v FROM C CROSS JOIN (SELECT range AS gene FROM range(50)) g LEFT JOIN X ON X.cell = C.cell AND X.gene = g.gene), O AS (SELECT cell, gene, 2 * v - max(v) OVER (PARTITION BY cell) AS value FROM Y) SELECT * FROM O WHERE value <> 0"),
    "filter_tables": (_masks, _masks_sql()),
    "feature_ratio_repeated": (lambda s, d: M.feature_abundance(matrix(s, d), _features(s), _obs(s, d), "ratio"), f"WITH {_ABUNDANCE} SELECT C.cell, round(CASE WHEN total - part > 0 THEN part / (total - part) END, 6) AS ratio FROM C LEFT JOIN A USING (cell)"),
    "feature_counts_grouped": (lambda s, d: M.feature_abundance(matrix(s, d), _features(s), _obs(s, d), "counts", groups=groups(s, d)), f"WITH {_ABUNDANCE} SELECT C.cell, grp, coalesce(part, 0) AS counts FROM C LEFT JOIN A USING (cell)"),
    "lazy_normalize": (lambda s, d: create_lazy_transform(x := matrix(s, d), log_base=2.0).apply(x), f"WITH {MATRIX} SELECT cell, gene, round(ln(1 + value * 10000 / sum(value) OVER (PARTITION BY cell)) / ln(2.0), 6) AS value FROM X"),
    "find_markers_table": (lambda s, d: _markers(s, d, "table"), f"WITH {_SPEC} SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY score DESC, gene DESC) AS rank, gene FROM SC QUALIFY rank <= 5"),
    "find_markers_ranks": (lambda s, d: _markers(s, d, "ranks"), f"WITH {_SPEC} SELECT grp, gene, count(*) OVER (PARTITION BY grp ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS rank FROM SC"),
    "find_markers_scores": (lambda s, d: _markers(s, d, "scores"), f"WITH {_SPEC} SELECT grp, gene, round(score, 6) AS score FROM SC"),
    "marker_stats_network": (lambda s, d: _annotate(s, d, "network", "enrichment"), f"WITH {', '.join(_network_sql())} SELECT node, label, round(value, 6) AS value FROM ST"),
    "marker_stats_vision": (lambda s, d: _annotate(s, d, "vision", "enrichment"), f"WITH {', '.join(_vision_sql())} SELECT node, label, round(value, 6) AS value FROM ST"),
    "annotate_cells_log_p": (lambda s, d: _annotate(s, d, "vision", "log_pvals"), f"WITH {', '.join(_vision_sql() + _LOG_P)} SELECT node, label, round(value, 6) AS value FROM LP"),
    "annotate_cells": (lambda s, d: _annotate(s, d, "network", "labels"), f"WITH {', '.join(_network_sql() + _LOG_P)} SELECT node, label, round(value, 6) AS confidence FROM LP QUALIFY row_number() OVER (PARTITION BY node ORDER BY value DESC, label) = 1"),
    "undirected_edges": (lambda s, d: N.undirected(whole_graph(s, d)), f"WITH {EDGES} SELECT * FROM G WHERE src <= dst"),
    "svd_cell_lengths": (lambda s, d: _lengths(D.run_svd(matrix(s, d), 50)), f"WITH {MATRIX} SELECT cell, round(sum(value * value), 3) AS length FROM X GROUP BY 1"),
    "svd_gene_lengths": (_gene_lengths, f"WITH {MATRIX} SELECT gene, round(sum(value * value), 3) AS length FROM X GROUP BY 1"),
    "kernel_cell_lengths": (lambda s, d: _lengths(D.reduce_kernel(matrix(s, d), 50)), f"WITH {_DENSE} SELECT cell, round(sum(y * y), 3) AS length FROM Y GROUP BY 1"),
    "basal_cell_lengths": (lambda s, d: _lengths(D.correct_basal(x := matrix(s, d), D.reduce_kernel(x, 50), [1, 2, 3])), f"WITH {_DENSE} SELECT cell, round(sum(y * y) - pow(sum(CASE WHEN gene IN (1, 2, 3) THEN y ELSE 0 END), 2) / 3, 3) AS length FROM Y GROUP BY 1"),
    "batch_cell_lengths": (lambda s, d: _lengths(D.correct_batch(x := matrix(s, d), D.reduce_kernel(x, 50), groups(s, d).select("cell", (F.col("grp") % 2).alias("batch")))), _BATCH),
    "run_spa": (lambda s, d: s.createDataFrame([(i, c, n) for i, (c, n) in enumerate(D.run_spa(_vectors(s, d), 6))], "rank int, cell long, norm double"), _spa_sql()),
    "node_colors": (lambda s, d: N.node_colors(_vectors(s, d).select(F.col("cell").alias("node"), *(F.col("vec")[i].alias(c) for i, c in enumerate("abc")))), _LAB),
    "violin": (lambda s, d: P.violin(table(s, d, "events").select(F.col("event_type").alias("grp"), "value")).withColumnRenamed("at", "point"), _VIOLIN),
    "xicor": (lambda s, d: A.xicor(table(s, d, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("x"), F.col("o_custkey").alias("y"), F.col("o_orderkey").alias("pos"))), _XI),
    "embedding_frame": (_frame, "SELECT p_partkey AS node, CAST(p_size AS DOUBLE) AS x, round(p_retailprice, 6) AS y, 'continuous' AS kind, CAST(NULL AS VARCHAR) AS category, CASE WHEN p_size > 5 THEN round(least(greatest(p_retailprice, 1000.0), 1500.0), 6) END AS amount, p_size <= 5 AS missing, CAST(1.0 AS DOUBLE) AS alpha FROM part"),
    "nudged_positions": (
        lambda s, d: P.nudged_positions(table(s, d, "part").select(F.col("p_brand").alias("label"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))),
        "WITH L AS (SELECT p_brand AS label, CAST(median(p_size) AS DOUBLE) AS x, median(p_retailprice) AS y FROM part GROUP BY 1), K AS (SELECT *, count(*) OVER () AS n, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS kx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ky FROM L), S AS (SELECT max(p_size) - min(p_size) AS rx, max(p_retailprice) - min(p_retailprice) AS ry FROM part) SELECT label, round(x + kx / n * rx * 0.02, 6) AS x, round(y + ky / n * ry * 0.02, 6) AS y FROM K, S",
    ),
    "darkened_colors": (lambda s, d: s.range(64).select("id", P.darken(P.hex_color(F.col("id") / 63, F.col("id") % 8 / 7, F.lit(0.5))).alias("color")), "SELECT i AS id, '#' || lower(lpad(hex(floor(round(i / 63.0 * 255) * 0.7)::BIGINT), 2, '0')) || lower(lpad(hex(floor(round(i % 8 / 7.0 * 255) * 0.7)::BIGINT), 2, '0')) || lower(lpad(hex(floor(round(127.5) * 0.7)::BIGINT), 2, '0')) AS color FROM range(64) t(i)"),
    "qc_violin_frame": (lambda s, d: P.qc_frame(matrix(s, d), _obs(s, d), _features(s), groups(s, d), "counts", "log10"), f"WITH {_ABUNDANCE} SELECT C.cell, grp, round(log10(CASE WHEN coalesce(part, 0) = 0 THEN 1 ELSE part END), 6) AS value FROM C LEFT JOIN A USING (cell)"),
    "feature_frames": (
        lambda s, d: P.feature_frames(groups(s, d).select(F.col("cell").alias("node"), F.col("grp").cast("double").alias("x"), F.col("cell").cast("double").alias("y")), matrix(s, d).where("gene < 5"), None),
        f"WITH {MATRIX}, {CELLS}, G AS (SELECT DISTINCT gene, dense_rank() OVER (ORDER BY gene) - 1 AS pane FROM X WHERE gene < 5) SELECT G.gene, C.cell AS node, CAST(grp AS DOUBLE) AS x, CAST(C.cell AS DOUBLE) AS y, coalesce(value, 0) AS value, CAST(pane // 3 AS INT) AS pane_row, CAST(pane % 3 AS INT) AS pane_column FROM C CROSS JOIN G LEFT JOIN X ON X.cell = C.cell AND X.gene = G.gene",
    ),
    "permuted_autocorrelation": (lambda s, d: G.permuted_autocorrelation(g := whole_graph(s, d), N.nodes(g).select("node", (F.col("node") % 7 + 1).cast("double").alias("value")), 5).select("statistic", "value"), f"WITH {EDGES}, S AS (SELECT DISTINCT src AS node, CAST(src % 7 + 1 AS DOUBLE) AS value FROM G), T AS (SELECT avg(value) AS m, count(*) AS n, sum(value * value) - sum(value) * sum(value) / count(*) AS ss FROM S), J AS (SELECT weight AS w, a.value - m AS u, b.value - m AS v, n, ss FROM G JOIN S a ON a.node = src JOIN S b ON b.node = dst CROSS JOIN T) SELECT 'moran' AS statistic, round(max(n) * sum(w * u * v) / (sum(w) * max(ss)), 6) AS value FROM J UNION ALL SELECT 'geary', round((max(n) - 1) * sum(w * (u - v) * (u - v)) / (2 * sum(w) * max(ss)), 6) FROM J"),
}

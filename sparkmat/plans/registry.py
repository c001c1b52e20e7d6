"""Queries of the matrix operators over the driver's tables, with their SQL oracles.

The matrix: cells are suppliers, genes are part keys modulo 50, values summed quantities; cells are
grouped by nation. Graph queries use the whole graph of suppliers and parts, an edge for each pair that line
items join. Results are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmat.operators import graph as G
from sparkmat.operators import matrix as M
from sparkmat.plans import analysis, whole
from sparkmat.plans.tables import CELLS as _C
from sparkmat.plans.tables import EDGES as _E
from sparkmat.plans.tables import MATRIX as _X
from sparkmat.plans.tables import groups, matrix, whole_graph
from sparkmat.plans.tables import table as _table

_GENES = [1, 2, 3, 5, 8, 13]


def _scores(g):
    """One deterministic value per node."""
    return g.groupBy(F.col("src").alias("node")).agg((F.first("src") % 7 + 1).cast("double").alias("value"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_NODES = "S AS (SELECT DISTINCT src AS node, CAST(src % 7 + 1 AS DOUBLE) AS value FROM G)"
_N = "(SELECT count(*) FROM C)"


def _diffusion_sql(rounds: int, alpha: float) -> str:
    parts = [_E, _NODES, "P AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY dst) AS weight FROM G)", "X0 AS (SELECT node, value FROM S)"]
    for i in range(rounds):
        parts.append(f"X{i + 1} AS (SELECT S.node, {alpha} * coalesce(m.m, 0) + {1 - alpha} * S.value AS value FROM S LEFT JOIN (SELECT src, sum(weight * value) AS m FROM P JOIN X{i} ON P.dst = X{i}.node GROUP BY src) m ON m.src = S.node)")
    return f"WITH {', '.join(parts)} SELECT node, round(value, 6) AS value FROM X{rounds}"


_SPECIFICITY = f"""{_X}, {_C}, Z AS (SELECT grp, count(*) AS n FROM C GROUP BY grp), Q AS (SELECT cell, count(*) / 50.0 AS q FROM X GROUP BY cell),
    MQ AS (SELECT sum(q) / {_N} AS mq FROM Q),
    GA AS (SELECT grp, sum(g) AS g1, sum(g * g) AS g2, max(g) AS gm FROM (SELECT C.grp, q / mq / n AS g FROM C JOIN Z ON Z.grp = C.grp JOIN Q ON Q.cell = C.cell CROSS JOIN MQ) GROUP BY grp),
    GE AS (SELECT gene, count(*) * 1.0 / {_N} AS p, avg(value) AS r FROM X GROUP BY gene),
    O AS (SELECT C.grp, gene, sum(value) / max(n) AS profile FROM X JOIN C ON C.cell = X.cell JOIN Z ON Z.grp = C.grp GROUP BY C.grp, gene),
    L AS (SELECT O.grp, O.gene, profile, profile - p * r * g1 AS lam, p * r * r * g2 AS nu, r * gm AS a FROM O JOIN GE ON GE.gene = O.gene JOIN GA ON GA.grp = O.grp),
    SP AS (SELECT grp, gene, profile, CASE WHEN lam > 0 THEN lam * lam / (2 * (nu + lam * a / 3)) / ln(10.0) ELSE 0.0 END AS upper, CASE WHEN lam < 0 THEN lam * lam / (2 * nu) / ln(10.0) ELSE 0.0 END AS lower FROM L)"""


def _specificity(spark, sf):
    c = groups(spark, sf)
    return M.specificity(matrix(spark, sf), c, c.count(), 50)


def _fold(spark, sf):
    return M.dot(matrix(spark, sf), spark.range(50).select(F.col("id").alias("gene"), (F.col("id") % 4).alias("comp"), (F.col("id") + 1).cast("double").alias("weight")))


#: name -> (query, oracle without rounding is fine where values are exact)
_ALL: dict[str, tuple[Callable, str | None]] = {
    "filter_masks": (lambda s, d: M.filter_masks(matrix(s, d), min_cells=2, min_genes=2, min_total=100), f"WITH {_X}, R1 AS (SELECT X.* FROM X WHERE cell IN (SELECT cell FROM X GROUP BY cell HAVING sum(value) >= 100 AND count(*) >= 2) AND gene IN (SELECT gene FROM X GROUP BY gene HAVING count(*) >= 2)), R2 AS (SELECT * FROM R1 WHERE cell IN (SELECT cell FROM R1 GROUP BY cell HAVING sum(value) >= 100 AND count(*) >= 2) AND gene IN (SELECT gene FROM R1 GROUP BY gene HAVING count(*) >= 2)) SELECT * FROM R2"),
    "normalize": (lambda s, d: M.normalize(matrix(s, d)), f"WITH {_X} SELECT cell, gene, round(ln(value * 10000 / sum(value) OVER (PARTITION BY cell) + 1), 6) AS value FROM X"),
    "normalize_log2": (lambda s, d: M.normalize(matrix(s, d), log_base=2.0), f"WITH {_X} SELECT cell, gene, round(ln(value * 10000 / sum(value) OVER (PARTITION BY cell) + 1) / ln(2.0), 6) AS value FROM X"),
    "l1_norm_scale": (lambda s, d: M.lp_normalize(matrix(s, d)), f"WITH {_X} SELECT cell, gene, round(value / sum(abs(value)) OVER (PARTITION BY cell), 6) AS value FROM X"),
    "l2_normalize_genes": (lambda s, d: M.lp_normalize(matrix(s, d), 2, "gene"), f"WITH {_X} SELECT cell, gene, round(value / sqrt(sum(value * value) OVER (PARTITION BY gene)), 6) AS value FROM X"),
    "matrix_sums_cells": (lambda s, d: M.matrix_sums(matrix(s, d), "cell"), f"WITH {_X} SELECT cell, sum(value) AS total, count(*) AS nnz FROM X GROUP BY cell"),
    "matrix_sums_genes": (lambda s, d: M.matrix_sums(matrix(s, d), "gene"), f"WITH {_X} SELECT gene, sum(value) AS total, count(*) AS nnz FROM X GROUP BY gene"),
    "grouped_matrix_stats": (lambda s, d: M.aggregate(matrix(s, d), groups(s, d)), f"WITH {_X}, {_C}, Z AS (SELECT grp, count(*) AS n FROM C GROUP BY grp), A AS (SELECT grp, gene, sum(value) AS s, sum(value * value) AS q, count(*) AS nnz FROM X JOIN C ON C.cell = X.cell GROUP BY grp, gene) SELECT A.grp, gene, s AS sum_value, round(s / n, 6) AS mean_value, round(CASE WHEN n > 1 THEN (q - s * s / n) / (n - 1) ELSE 0 END, 6) AS var_value, nnz FROM A JOIN Z ON Z.grp = A.grp"),
    "feature_abundance": (lambda s, d: M.abundance(matrix(s, d), _GENES), f"WITH {_X} SELECT cell, round(coalesce(sum(CASE WHEN gene IN (1, 2, 3, 5, 8, 13) THEN value END), 0) / sum(value), 6) AS fraction FROM X GROUP BY cell"),
    "feature_percent": (lambda s, d: M.abundance(matrix(s, d), _GENES, "percent"), f"WITH {_X} SELECT cell, round(100 * coalesce(sum(CASE WHEN gene IN (1, 2, 3, 5, 8, 13) THEN value END), 0) / sum(value), 6) AS percent FROM X GROUP BY cell"),
    "row_moments": (lambda s, d: M.row_moments(matrix(s, d), 50), f"WITH {_X} SELECT cell, sum(value * value) AS sum_sq, round(sum(value) / 50, 6) AS mu, round((sum(value * value) - sum(value) * sum(value) / 50) / 49, 6) AS sigma_sq FROM X GROUP BY cell"),
    "x_dot": (_fold, f"WITH {_X} SELECT cell, gene % 4 AS comp, sum(value * (gene + 1)) AS value FROM X GROUP BY 1, 2"),
    "max_ranks": (lambda s, d: M.max_ranks(matrix(s, d)), f"WITH {_X} SELECT cell, gene, value, count(*) OVER (PARTITION BY cell ORDER BY value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank FROM X"),
    "argmax": (lambda s, d: M.argmax(matrix(s, d)), f"WITH {_X}, R AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value DESC, gene) AS r FROM X) SELECT cell, gene AS best, value AS confidence FROM R WHERE r = 1"),
    "relabel_by_size": (lambda s, d: M.relabel_by_size(groups(s, d).select("cell", F.col("grp").alias("label")), 3), f"WITH {_C}, Z AS (SELECT grp, row_number() OVER (ORDER BY count(*) DESC, grp) AS k FROM C GROUP BY grp HAVING count(*) >= 3) SELECT cell, coalesce(k, 0) AS new_label FROM C LEFT JOIN Z ON Z.grp = C.grp"),
    "unique_names": (lambda s, d: M.unique_names(_table(s, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"))), "SELECT p_partkey AS pos, CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1 THEN p_name || '_' || CAST(row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS VARCHAR) ELSE p_name END AS unique_name FROM part"),
    "first_match": (lambda s, d: M.first_match(_table(s, d, "part").select(F.col("p_brand").alias("name")).distinct(), _table(s, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("name"))), "SELECT p_brand AS name, min(p_partkey) AS pos FROM part GROUP BY p_brand"),
    "specificity": (_specificity, f"WITH {_SPECIFICITY} SELECT grp, gene, round(profile, 6) AS profile, round(upper, 6) AS upper, round(lower, 6) AS lower FROM SP"),
    "find_markers": (lambda s, d: M.top_markers(_specificity(s, d), 5), f"WITH {_SPECIFICITY}, K AS (SELECT grp, gene, row_number() OVER (PARTITION BY grp ORDER BY round(greatest(upper - lower, 0), 9) DESC, gene DESC) AS rank FROM SP) SELECT * FROM K WHERE rank <= 5"),
    "normalize_graph": (lambda s, d: G.normalize_graph(whole_graph(s, d), 2), f"WITH {_E} SELECT src, dst, round(weight / sqrt(sum(weight) OVER (PARTITION BY src) * sum(weight) OVER (PARTITION BY dst)), 6) AS weight FROM G"),
    "mutual_edges": (lambda s, d: G.mutual(whole_graph(s, d)), f"WITH {_E} SELECT a.src, a.dst, round(sqrt(a.weight * b.weight), 6) AS weight FROM G a JOIN G b ON a.src = b.dst AND a.dst = b.src"),
    "network_diffusion": (lambda s, d: G.diffuse(e := whole_graph(s, d), _scores(e)), _diffusion_sql(5, 0.85)),
    "label_enrichment": (lambda s, d: G.label_enrichment(e := whole_graph(s, d), _scores(e).withColumn("label", F.col("node") % 3), _scores(e).count()), f"WITH {_E}, {_NODES}, P AS (SELECT node % 3 AS label, sum(value) / (SELECT count(*) FROM S) AS p FROM S GROUP BY 1), R AS (SELECT src, sum(weight) AS w1, sum(weight * weight) AS w2, max(weight) AS a FROM G GROUP BY src), O AS (SELECT src, node % 3 AS label, sum(weight * value) AS obs FROM G JOIN S ON G.dst = S.node GROUP BY 1, 2), L AS (SELECT O.src, O.label, obs - w1 * p AS lam, w2 * p AS nu, a FROM O JOIN R ON R.src = O.src JOIN P ON P.label = O.label) SELECT src, label, round(CASE WHEN lam > 0 AND 2 * (nu + lam * a / 3) > 0 THEN lam * lam / (2 * (nu + lam * a / 3)) ELSE 0 END, 6) AS score FROM L"),
    "autocorrelation": (lambda s, d: G.autocorrelation(e := whole_graph(s, d), _scores(e)), f"WITH {_E}, {_NODES}, T AS (SELECT avg(value) AS m, count(*) AS n, sum(value * value) - sum(value) * sum(value) / count(*) AS ss FROM S), J AS (SELECT weight AS w, a.value - m AS u, b.value - m AS v, n, ss FROM G JOIN S a ON a.node = src JOIN S b ON b.node = dst CROSS JOIN T) SELECT round(max(n) * sum(w * u * v) / (sum(w) * max(ss)), 6) AS moran, round((max(n) - 1) * sum(w * (u - v) * (u - v)) / (2 * sum(w) * max(ss)), 6) AS geary FROM J"),
}

_ALL |= analysis.ALL | whole.ALL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(query):
        def run(spark, sf_dir):
            return _rounded(query(spark, sf_dir))

        return run

    return {k: of(q) for k, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}

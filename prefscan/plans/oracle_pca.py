"""DuckDB statements of the principal components.

The leading eigenvector of a covariance matrix is read off a high power of it
(squared again and again, scaled to stay in range); the second comes from the
matrix with the first component taken out.  Signs: the loading of largest
magnitude is positive."""

from __future__ import annotations

from prefscan.operators.pca import TAIL_PCA_GAMMAS
from prefscan.plans import catalog as C

SQUARINGS = 40


def _power(name: str, src: str) -> str:
    """``{name}_v(g, c, v, l)``: leading eigenvector and value of ``src(g, c)``."""
    return f"""
{name}_p(g, k, m) AS (
  SELECT g, 0, c FROM {src}
  UNION ALL
  SELECT g, k + 1, list_transform(n, lambda r: list_transform(r, lambda x: x / s)) FROM (
    SELECT g, k, n, list_max(list_transform(n, lambda r: list_max(list_transform(r, lambda x: abs(x))))) AS s FROM (
      SELECT g, k, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b))) AS n
      FROM {name}_p WHERE k < {SQUARINGS}))),
{name}_d AS (
  SELECT g, m, list_transform(m, lambda r, i: r[i]) AS d FROM {name}_p WHERE k = {SQUARINGS}),
{name}_r AS (SELECT g, m[list_position(d, list_max(d))] AS r FROM {name}_d),
{name}_n AS (SELECT g, list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS v FROM {name}_r),
{name}_a AS (SELECT g, v, list_transform(v, lambda x: abs(x)) AS a FROM {name}_n),
{name}_s AS (SELECT g, CASE WHEN v[list_position(a, list_max(a))] < 0 THEN list_transform(v, lambda x: -x) ELSE v END AS v
             FROM {name}_a),
{name}_v AS (
  SELECT g, c, v, list_dot_product(v, list_transform(c, lambda r: list_dot_product(r, v))) AS l
  FROM {name}_s JOIN {src} USING (g))"""


def two_components(src: str) -> str:
    """``pc(g, v1, v2, e1, e2)``: both components and their explained shares."""
    return _power("one", src) + f""",
rest AS (SELECT g, list_transform(c, lambda r, i: list_transform(r, lambda x, j: x - l * v[i] * v[j])) AS c FROM one_v),
{_power("two", "rest")},
pc AS (SELECT g, a.v AS v1, b.v AS v2, a.l / t.t AS e1, b.l / t.t AS e2
       FROM one_v a JOIN two_v b USING (g)
       JOIN (SELECT g, list_sum(list_transform(c, lambda r, i: r[i])) AS t FROM {src}) t USING (g))"""


def _cov(langs: list[str]) -> str:
    return "[" + ", ".join("[" + ", ".join(f"covar_samp({a}, {b})" for b in langs) + "]" for a in langs) + "]"


def _start(std: str) -> str:
    return std.replace("WITH ", "WITH RECURSIVE ", 1)


def _scores(std: str) -> str:
    ls = C.LANGS
    means = ", ".join(f"avg({l}) AS c_{l}" for l in ls)

    def dot(v):
        return " + ".join(f"({l} - c_{l}) * {v}[{i + 1}]" for i, l in enumerate(ls))
    return _start(std) + f""",
cm AS (SELECT 0 AS g, {_cov(ls)} AS c FROM z),
{two_components("cm")},
mid AS (SELECT {means} FROM z),
proj AS (SELECT example_id, {dot("v1")} AS pc1, {dot("v2")} AS pc2 FROM z, mid, pc)"""


def pca_scores(std: str) -> str:
    return _scores(std) + "\nSELECT example_id, round(pc1, 6) AS pc1, round(pc2, 6) AS pc2 FROM proj"


def pca_loadings(std: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{l}' AS trait, v1[{i + 1}] AS pc1, v2[{i + 1}] AS pc2, e1, e2 FROM pc"
                              for i, l in enumerate(C.LANGS))
    return _scores(std) + f""",
mx AS (SELECT 0.8::DOUBLE * greatest(max(abs(pc1)), max(abs(pc2))) AS s FROM proj)
SELECT trait, round(pc1, 6) AS pc1, round(pc2, 6) AS pc2, round(e1, 6) AS explained_1, round(e2, 6) AS explained_2,
       round(pc1 * s, 6) AS arrow_x, round(pc2 * s, 6) AS arrow_y, round(pc1 * s * 1.1::DOUBLE, 6) AS label_x,
       round(pc2 * s * 1.1::DOUBLE, 6) AS label_y
FROM ({rows}), mx"""


def _tails(std: str) -> str:
    gl = ", ".join(f"CAST({g} AS DOUBLE)" for g in TAIL_PCA_GAMMAS)
    ls = C.LANGS
    names = "[" + ", ".join(f"'{l}'" for l in ls) + "]"
    arr = "[" + ", ".join(ls) + "]"
    return _start(std) + f""",
n AS (SELECT count(*) AS n FROM z),
gk AS (SELECT gamma, CAST(greatest(floor(n * gamma), 1) AS BIGINT) AS k FROM (SELECT unnest([{gl}]) AS gamma), n),
rk AS (SELECT {C.TARGET} AS v, row_number() OVER (ORDER BY {C.TARGET} DESC, example_id) AS r FROM z),
th AS (SELECT gamma AS g, v AS t FROM gk JOIN rk ON rk.r = gk.k),
tail AS (SELECT g, z.*, {names}[list_position({arr}, list_max({arr}))] AS assigned FROM th JOIN z ON z.{C.TARGET} >= t),
tn AS (SELECT g, count(*) AS n_rows FROM tail GROUP BY g HAVING count(*) >= 3),
cm AS (SELECT g, {_cov(ls)} AS c FROM tail JOIN tn USING (g) GROUP BY g),
{two_components("cm")}"""


def tail_pca(std: str) -> str:
    ords = " UNION ALL ".join(f"SELECT '{l}' AS assigned" for l in C.LANGS)
    return _tails(std) + f"""
SELECT g AS gamma, n_rows, round(e1, 6) AS explained_1, round(e2, 6) AS explained_2, o.assigned,
       (SELECT count(*) FROM tail WHERE tail.g = tn.g AND tail.assigned = o.assigned) AS n
FROM tn JOIN pc USING (g), ({ords}) o"""


def tail_projection(std: str) -> str:
    ls = C.LANGS
    means = ", ".join(f"avg({l}) AS c_{l}" for l in ls)

    def dot(v):
        return " + ".join(f"({l} - c_{l}) * {v}[{i + 1}]" for i, l in enumerate(ls))
    return _tails(std) + f""",
mid AS (SELECT g, {means} FROM tail GROUP BY g)
SELECT g AS gamma, example_id, assigned, round({dot("v1")}, 6) AS pc1, round({dot("v2")}, 6) AS pc2
FROM tail JOIN mid USING (g) JOIN pc USING (g)"""


def embedding_pca() -> str:
    return f"""WITH RECURSIVE ex AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
mid AS (SELECT i, avg(x) AS m FROM ex GROUP BY i),
cv AS (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM ex a JOIN ex b USING (vec_id) GROUP BY ALL),
cr AS (SELECT i, list(c ORDER BY j) AS r FROM cv GROUP BY i),
cm AS (SELECT 0 AS g, list(r ORDER BY i) AS c FROM cr),
{two_components("cm")}
SELECT vec_id, label, round(sum((x - m) * v1[i]), 6) AS pc1, round(sum((x - m) * v2[i]), 6) AS pc2,
       round(any_value(e1), 6) AS explained_1, round(any_value(e2), 6) AS explained_2
FROM ex JOIN mid USING (i) JOIN embeddings USING (vec_id), pc GROUP BY vec_id, label"""

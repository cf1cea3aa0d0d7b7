"""Splits, imputation, outlier filters, scaling and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from emulon.operators.impute import fit_imputer
from emulon.operators.outliers import drop_isolated, fit_fences, lof_scores, isolation_scores
from emulon.operators.profile import boxplot_summary, outlier_points, profile, target_variance
from emulon.operators.scale import (
    fit_array_scaler, fit_input_scalers, fit_output_scalers, fit_scalers, TCP_ROBUST)
from emulon.operators.split import TRAIN, folds, part, split
from emulon.runtime import cut_lineage
from emulon_queries import query
from emulon_queries.tables import (
    CONTINUOUS, EXPERIMENT_SQL, GAPS_SQL, INPUTS, OUTPUTS, ROLES, experiment, parted, read, rounded, split_sql, unit_sql,
    with_gaps)

TRAIN_SQL = f"{EXPERIMENT_SQL}, {split_sql()}, train AS (SELECT * FROM parted WHERE split = 'train')"


# ----------------------------------------------------------------------------- splits


@query("D1", f"WITH {EXPERIMENT_SQL}, {split_sql()} SELECT key, split FROM parted")
def hash_split(spark, sf):
    return split(experiment(spark, sf), "key").select("key", "split")


@query("D1, D2", f"WITH {EXPERIMENT_SQL}, {split_sql(test=0.2, val=0.0)} SELECT key, split FROM parted")
def hash_split_two_way(spark, sf):
    return split(experiment(spark, sf), "key", test=0.2, val=None).select("key", "split")


@query("D1", f"""WITH {EXPERIMENT_SQL}, ranked AS (
  SELECT key, row_number() OVER (ORDER BY {unit_sql()}) AS r, count(*) OVER () AS n FROM exp
), sized AS (SELECT *, ceil(0.15::DOUBLE * n) AS n_test FROM ranked)
SELECT key, CASE WHEN r <= n_test THEN 'test'
                 WHEN r <= n_test + ceil(0.15::DOUBLE / (1 - 0.15::DOUBLE) * (n - n_test)) THEN 'val'
                 ELSE 'train' END AS split FROM sized""")
def exact_split(spark, sf):
    """Split with the row counts of a permutation, without a sort."""
    return split(experiment(spark, sf), "key", exact=True).select("key", "split")


@query("D3", f"""WITH {EXPERIMENT_SQL}
SELECT key, CAST(floor({unit_sql(purpose='fold')} * 5) AS INTEGER) AS fold FROM exp""")
def fold_assignment(spark, sf):
    return folds(experiment(spark, sf), "key", 5).select("key", "fold")


@query("D3", f"""WITH {EXPERIMENT_SQL}, ranked AS (
  SELECT key, row_number() OVER (ORDER BY {unit_sql(purpose='fold')}) - 1 AS r, count(*) OVER () AS n FROM exp)
SELECT key, CAST(CASE WHEN r < (n % 7) * (n // 7 + 1) THEN r // (n // 7 + 1)
                      ELSE n % 7 + (r - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold FROM ranked""")
def exact_fold_assignment(spark, sf):
    """Folds whose sizes differ by one row at most."""
    return folds(experiment(spark, sf), "key", 7, exact=True).select("key", "fold")


# ----------------------------------------------------------------------------- imputation


@query("I1", f"""WITH {GAPS_SQL}, {split_sql('gaps')}, t AS (SELECT * FROM parted WHERE split = 'train'),
m AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in INPUTS)} FROM t)
SELECT key, split, {', '.join(f'round(coalesce({c}, m_{c}), 6) AS {c}' for c in INPUTS)} FROM parted, m""")
def mean_imputation(spark, sf):
    """Means of the training rows fill the gaps of all splits."""
    rows = cut_lineage(split(with_gaps(experiment(spark, sf)), "key"), partition_by="split")
    return rounded(fit_imputer(part(rows, TRAIN), INPUTS).transform(rows).select("key", "split", *INPUTS), 6)


@query("I2", f"""WITH {GAPS_SQL}, m AS (SELECT avg(l_quantity) AS mq, avg(l_extendedprice) AS mp FROM gaps)
SELECT key, round(coalesce(l_quantity, mq), 6) AS l_quantity, round(coalesce(l_extendedprice, mp), 6) AS l_extendedprice,
       l_discount, l_quantity IS NULL AS l_quantity_missing, l_extendedprice IS NULL AS l_extendedprice_missing
FROM gaps, m""")
def missing_indicator(spark, sf):
    """Flags for the columns that had gaps, next to the imputed values."""
    rows = with_gaps(experiment(spark, sf))
    columns = ("l_quantity", "l_extendedprice", "l_discount")
    done = fit_imputer(rows, columns, "missing indicator").transform(rows)
    return rounded(done.select("key", *columns, "l_quantity_missing", "l_extendedprice_missing"), 6)


@query("I3", """WITH p AS (
  SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_retailprice END AS price,
         CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size,
         CAST(length(p_name) AS DOUBLE) AS name_length
  FROM part
), loc AS (
  SELECT *, min(p_partkey) OVER (PARTITION BY price, size, name_length) AS loc FROM p
), pairs AS (
  SELECT r.p_partkey AS id, t.target, d.loc, d.p_partkey AS donor, d.price, d.size,
         sqrt((coalesce((r.price - d.price) * (r.price - d.price), 0)
             + coalesce((r.size - d.size) * (r.size - d.size), 0)
             + (r.name_length - d.name_length) * (r.name_length - d.name_length))
             / (1 + (r.price - d.price IS NOT NULL)::INT + (r.size - d.size IS NOT NULL)::INT) * 3) AS dist
  FROM p r CROSS JOIN (SELECT unnest(['price', 'size']) AS target) t JOIN loc d
    ON (t.target = 'price' AND r.price IS NULL AND d.price IS NOT NULL)
    OR (t.target = 'size' AND r.size IS NULL AND d.size IS NOT NULL)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY id, target ORDER BY dist, loc, donor) AS r FROM pairs
), fill AS (
  SELECT id, avg(price) FILTER (WHERE target = 'price') AS price, avg(size) FILTER (WHERE target = 'size') AS size
  FROM best WHERE r <= 5 GROUP BY id
)
SELECT p.p_partkey, round(coalesce(p.price, fill.price), 4) AS price, round(coalesce(p.size, fill.size), 4) AS size,
       p.name_length
FROM p LEFT JOIN fill ON p.p_partkey = fill.id""")
def neighbour_imputation(spark, sf):
    """Gaps filled from the five nearest rows that have the cell."""
    parts = read(spark, sf, "part").selectExpr(
        "p_partkey",
        "if(p_partkey % 17 = 0, null, p_retailprice) as price",
        "if(p_partkey % 23 = 0, null, cast(p_size as double)) as size",
        "cast(length(p_name) as double) as name_length",
    )
    imputer = fit_imputer(parts, ["price", "size", "name_length"], "knn", key="p_partkey")
    return rounded(imputer.transform(parts), {"price": 4, "size": 4, "name_length": 6})


# ----------------------------------------------------------------------------- outliers


def _fence_sql(columns, source):
    return ("f AS (SELECT " + ", ".join(
        f"quantile_cont({c}::DOUBLE, 0.25) AS a_{c}, quantile_cont({c}::DOUBLE, 0.75) AS b_{c}" for c in columns)
        + f" FROM {source})")


def _outside_sql(c):
    return f"({c} < a_{c} - 1.5 * (b_{c} - a_{c}) OR {c} > b_{c} + 1.5 * (b_{c} - a_{c}))"


SKEWED_SQL = """skewed AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value,
  value * value AS squared FROM events)"""


def _skewed(spark, sf):
    return read(spark, sf, "events").selectExpr(
        "event_id", "if(event_id % 17 = 0, null, value) as value", "value * value as squared")


@query("O1", f"""WITH {SKEWED_SQL}, {_fence_sql(['value', 'squared'], 'skewed')}
SELECT event_id, value, round(squared, 6) AS squared FROM skewed, f
WHERE NOT (coalesce({_outside_sql('value')}, FALSE) OR coalesce({_outside_sql('squared')}, FALSE))""")
def quartile_filter(spark, sf):
    """Rows with any value beyond the fences are dropped; a missing value never drops a row."""
    rows = _skewed(spark, sf)
    return rounded(fit_fences(rows, ["value", "squared"]).transform(rows), {"squared": 6}, keep=("value",))


@query("O1", f"""WITH {TRAIN_SQL}, {_fence_sql(INPUTS + OUTPUTS, 'train')}
SELECT key, round(charge, 6) AS charge FROM train, f
WHERE NOT ({' OR '.join(_outside_sql(c) for c in INPUTS + OUTPUTS)})""")
def quartile_filter_inputs_outputs(spark, sf):
    """All inputs and outputs of the training rows at once."""
    train = part(parted(spark, sf), TRAIN)
    kept = fit_fences(train, [*INPUTS, *OUTPUTS]).transform(train)
    return rounded(kept.select("key", "charge"), 6)


@query("O2", f"""WITH {SKEWED_SQL}, {_fence_sql(['value'], 'skewed')}
SELECT event_id, value FROM skewed, f
WHERE value >= a_value - 2.0 * (b_value - a_value) AND value <= b_value + 2.0 * (b_value - a_value)""")
def quartile_filter_inputs_only(spark, sf):
    """Inputs only, another factor, and a missing value does drop the row."""
    rows = _skewed(spark, sf).select("event_id", "value")
    return fit_fences(rows, ["value"], factor=2.0, nulls="drop").transform(rows)


_TREES, _TREE_ROWS, _DEPTH = 5, 16, 4


def _forest_sql() -> str:
    """The same forest in SQL: rows drawn hy hash, then, level hy level, the split of each node and the way of each row."""
    def draw(what: str) -> str:
        return f"(('0x' || substr(md5('{what}42:' || tree || '.' || way), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"

    def path_of(n: str) -> str:
        return f"CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2 * (ln({n} - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2 * ({n} - 1.0::DOUBLE) / {n} END"

    levels = []
    for d in range(_DEPTH + 1):
        splits = "FALSE" if d == _DEPTH else "n > 1 AND (hx > lx OR hy > ly)"
        levels.append(f"""n{d} AS (
  SELECT *, CASE WHEN f = 0 THEN CASE WHEN cx >= hx THEN lx ELSE cx END ELSE CASE WHEN cy >= hy THEN ly ELSE cy END END AS cut FROM (
    SELECT *, CASE WHEN hx > lx AND hy > ly THEN floor({draw('input')} * 2) WHEN hx > lx THEN 0 ELSE 1 END AS f,
           lx + {draw('cut')} * (hx - lx) AS cx, ly + {draw('cut')} * (hy - ly) AS cy, {splits} AS inner_node FROM (
      SELECT tree, way, count(*) AS n, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM m{d} GROUP BY tree, way))),
m{d + 1} AS (SELECT m.tree, m.way || CASE WHEN CASE WHEN f = 0 THEN x ELSE y END <= cut THEN 'L' ELSE 'R' END AS way, x, y FROM m{d} m JOIN n{d} USING (tree, way) WHERE inner_node),
w{d + 1} AS (SELECT w.tree, w.way || CASE WHEN CASE WHEN f = 0 THEN x ELSE y END <= cut THEN 'L' ELSE 'R' END AS way, x, y, p_partkey FROM w{d} w JOIN n{d} USING (tree, way) WHERE inner_node),
e{d} AS (SELECT p_partkey, w.tree, {d} + {path_of('n')} AS path FROM w{d} w JOIN n{d} USING (tree, way) WHERE NOT inner_node)""")
    ends = " UNION ALL ".join(f"SELECT * FROM e{d}" for d in range(_DEPTH + 1))
    return f"""WITH rows AS (SELECT p_partkey, p_retailprice AS x, p_size::DOUBLE AS y FROM part),
pool AS (SELECT * FROM rows WHERE {unit_sql('p_partkey', 42, 'forest')} < least(1.0, {2 * _TREES * _TREE_ROWS}.0::DOUBLE / (SELECT count(*) FROM rows))),
drawn AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY ('0x' || substr(md5('tree' || tree || '.42:' || p_partkey), 1, 13))::BIGINT) AS place
          FROM pool, (SELECT unnest(range({_TREES})) AS tree)),
m0 AS (SELECT tree, '' AS way, x, y FROM drawn WHERE place <= {_TREE_ROWS}),
w0 AS (SELECT tree, '' AS way, x, y, p_partkey FROM rows, (SELECT unnest(range({_TREES})) AS tree)),
{', '.join(levels)}
SELECT p_partkey, round(pow(2, -avg(path) / ({path_of(f'{_TREE_ROWS}')})), 9) AS anomaly FROM ({ends}) GROUP BY p_partkey"""


@query("O3", _forest_sql())
def isolation_scores_of_parts(spark, sf):
    """Scores of all parts by a small forest that SQL grows from the same hashes."""
    rows = read(spark, sf, "part").selectExpr("p_partkey", "p_retailprice", "cast(p_size as double) as p_size")
    scored = isolation_scores(rows, "p_partkey", ["p_retailprice", "p_size"], seed=42, trees=_TREES, rows=_TREE_ROWS)
    return rounded(scored.select("p_partkey", "anomaly"), 9)


@query("O3")
def isolation_forest_filter(spark, sf):
    """The five percent of the rows that are easiest to isolate are dropped."""
    rows = cut_lineage(experiment(spark, sf))
    return rounded(drop_isolated(rows, "key", [*INPUTS, *OUTPUTS]).select("key", "charge"), 6)


@query("O4", """WITH p AS (
  SELECT s_suppkey AS id, s_acctbal AS a, CAST(s_nationkey AS DOUBLE) AS b FROM supplier
), n AS (
  SELECT x.id, y.id AS other, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) AS dist
  FROM p x JOIN p y ON x.id <> y.id
  QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY dist, y.id) <= 20
), k AS (SELECT id, max(dist) AS kd FROM n GROUP BY id
), lrd AS (SELECT n.id, 1 / (avg(greatest(k.kd, n.dist)) + 1e-10::DOUBLE) AS lrd
           FROM n JOIN k ON n.other = k.id GROUP BY n.id)
SELECT n.id AS s_suppkey, round(avg(o.lrd) / any_value(l.lrd), 6) AS lof, avg(o.lrd) / any_value(l.lrd) <= 1.5 AS inlier
FROM n JOIN lrd o ON n.other = o.id JOIN lrd l ON n.id = l.id GROUP BY n.id""")
def local_outliers_suppliers(spark, sf):
    """Local outlier factor of every supplier, and whether the filter keeps it."""
    rows = read(spark, sf, "supplier").selectExpr("s_suppkey", "s_acctbal", "cast(s_nationkey as double) as nation")
    scored = lof_scores(rows, "s_suppkey", ["s_acctbal", "nation"])
    return scored.selectExpr("s_suppkey", "round(lof, 6) as lof", "lof <= 1.5 as inlier")


@query("O4", """WITH p AS (
  SELECT p_partkey AS id, p_retailprice AS a, CAST(p_size AS DOUBLE) AS b,
         min(p_partkey) OVER (PARTITION BY p_retailprice, p_size) AS loc FROM part
), n AS (
  SELECT x.id, y.id AS other, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) AS dist
  FROM p x JOIN p y ON x.id <> y.id
  QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY dist, y.loc, y.id) <= 20
), k AS (SELECT id, max(dist) AS kd FROM n GROUP BY id
), lrd AS (SELECT n.id, 1 / (avg(greatest(k.kd, n.dist)) + 1e-10::DOUBLE) AS lrd
           FROM n JOIN k ON n.other = k.id GROUP BY n.id)
SELECT n.id AS p_partkey, round(avg(o.lrd) / any_value(l.lrd), 6) AS lof
FROM n JOIN lrd o ON n.other = o.id JOIN lrd l ON n.id = l.id GROUP BY n.id""")
def local_outliers_parts(spark, sf):
    """The same on the part table, where many rows are equally far from each other."""
    rows = read(spark, sf, "part").selectExpr("p_partkey", "p_retailprice", "cast(p_size as double) as size")
    return lof_scores(rows, "p_partkey", ["p_retailprice", "size"]).selectExpr("p_partkey", "round(lof, 6) as lof")


# ----------------------------------------------------------------------------- scaling


@query("N1", f"""WITH {EXPERIMENT_SQL}, s AS (
  SELECT {', '.join(f'min({c}) AS a_{c}, max({c}) - min({c}) AS b_{c}' for c in CONTINUOUS)} FROM exp)
SELECT key, {', '.join(f'round(({c} - a_{c}) / b_{c}, 6) AS {c}' for c in CONTINUOUS)} FROM exp, s""")
def minmax_scaling(spark, sf):
    rows = experiment(spark, sf).select("key", *CONTINUOUS)
    return rounded(fit_scalers(rows, dict.fromkeys(CONTINUOUS, "minmax")).transform(rows), 6)


@query("N2", f"""WITH {EXPERIMENT_SQL}, s AS (
  SELECT {', '.join(f'avg({c}) AS a_{c}, stddev_pop({c}) AS b_{c}' for c in CONTINUOUS)} FROM exp)
SELECT key, {', '.join(f'round(({c} - a_{c}) / b_{c}, 6) AS {c}' for c in CONTINUOUS)} FROM exp, s""")
def standard_scaling(spark, sf):
    rows = experiment(spark, sf).select("key", *CONTINUOUS)
    return rounded(fit_scalers(rows, dict.fromkeys(CONTINUOUS, "standard")).transform(rows), 6)


@query("N3", f"""WITH {EXPERIMENT_SQL}, s AS (
  SELECT {', '.join(f'quantile_cont({c}, 0.5) AS a_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS b_{c}'
                    for c in CONTINUOUS)} FROM exp)
SELECT key, {', '.join(f'round(({c} - a_{c}) / b_{c}, 6) AS {c}' for c in CONTINUOUS)} FROM exp, s""")
def robust_scaling(spark, sf):
    rows = experiment(spark, sf).select("key", *CONTINUOUS)
    return rounded(fit_scalers(rows, dict.fromkeys(CONTINUOUS, "robust")).transform(rows), 6)


@query("N4", f"""WITH {TRAIN_SQL}, s AS (
  SELECT {', '.join(f'min({c}) AS a_{c}, max({c}) - min({c}) AS b_{c}' for c in CONTINUOUS)} FROM train)
SELECT key, split, l_linenumber, {', '.join(f'round(({c} - a_{c}) / b_{c}, 6) AS {c}' for c in CONTINUOUS)}
FROM parted, s""")
def selective_input_scaling(spark, sf):
    """Continuous inputs scaled with training statistics in all splits; the discrete one passes through."""
    rows = parted(spark, sf)
    scaled = fit_input_scalers(part(rows, TRAIN), ROLES).transform(rows)
    return rounded(scaled.select("key", "split", *INPUTS), 6)


def _robust(c):
    return f"quantile_cont({c}, 0.5) AS a_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS b_{c}"


@query("N5", f"""WITH {TRAIN_SQL}, s AS (
  SELECT avg(charge) AS a_charge, stddev_pop(charge) AS b_charge,
         {_robust('TCP_X_pos_list_0')}, {_robust('TCP_X_pos_list_1')} FROM train)
SELECT key, split, {', '.join(f'round(({c} - a_{c}) / b_{c}, 6) AS {c}' for c in OUTPUTS)} FROM parted, s""")
def output_scaling(spark, sf):
    """Every output with a scaler of its own: standard by default, robust for the family."""
    rows = parted(spark, sf)
    fitted = fit_output_scalers(part(rows, TRAIN), ROLES, "standard", rules=[TCP_ROBUST])
    return rounded(fitted.transform(rows).select("key", "split", *OUTPUTS), 6)


@query("N5", """WITH cells AS (
  SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings
), s AS (SELECT pos, min(x) AS a, max(x) - min(x) AS b FROM cells GROUP BY pos)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round((x - a) / b, 6) AS x FROM cells JOIN s USING (pos)""")
def array_output_scaling(spark, sf):
    """Wide outputs kept as one array column, each position with its own parameters."""
    rows = read(spark, sf, "embeddings").select("vec_id", "embedding")
    scaled = fit_array_scaler(rows, "embedding").transform(rows, "embedding")
    return rounded(scaled.select("vec_id", F.posexplode("embedding").alias("pos", "x")), 6)


@query("N5", """WITH cells AS (
  SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings
), s AS (SELECT pos, quantile_cont(x, 0.5) AS a, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS b FROM cells GROUP BY pos)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round((x - a) / b, 6) AS x FROM cells JOIN s USING (pos)""")
def array_robust_scaling(spark, sf):
    """The same by median and quartiles: the exact quantiles of all positions come from the same scans."""
    rows = read(spark, sf, "embeddings").select("vec_id", "embedding")
    scaled = fit_array_scaler(rows, "embedding", "robust").transform(rows, "embedding")
    return rounded(scaled.select("vec_id", F.posexplode("embedding").alias("pos", "x")), 6)


@query("N6", f"""WITH {EXPERIMENT_SQL}
SELECT key, {', '.join(f'round({c}, 6) AS {c}' for c in OUTPUTS)} FROM exp""")
def inverse_scaling(spark, sf):
    """Scaled outputs back in original units."""
    rows = experiment(spark, sf).select("key", *OUTPUTS)
    fitted = fit_output_scalers(rows, ROLES, "standard")
    return rounded(fitted.inverse(fitted.transform(rows)), 6)


@query("N7", """WITH t AS (SELECT min(o_totalprice) AS a, max(o_totalprice) - min(o_totalprice) AS b FROM orders)
SELECT l_orderkey, round((total - a) / b, 6) AS o_totalprice
FROM (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY l_orderkey), t""")
def transform_new_rows(spark, sf):
    """Parameters fitted on one table applied to the rows of another."""
    fitted = fit_scalers(read(spark, sf, "orders"), {"o_totalprice": "minmax"})
    new = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("o_totalprice"))
    return rounded(fitted.transform(new), 6)


# ----------------------------------------------------------------------------- profiles


def _profile_sql(c):
    stats = {
        "count": f"count({c})", "missing": f"count(*) FILTER (WHERE {c} IS NULL)", "distinct": f"count(DISTINCT {c})",
        "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "max": f"max({c})",
        "zeros": f"count(*) FILTER (WHERE {c} = 0)", "negatives": f"count(*) FILTER (WHERE {c} < 0)",
        "q25": f"quantile_cont({c}::DOUBLE, 0.25)", "q50": f"quantile_cont({c}::DOUBLE, 0.5)",
        "q75": f"quantile_cont({c}::DOUBLE, 0.75)",
    }
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{s}' AS stat, round(CAST({e} AS DOUBLE), 4) AS value FROM train"""
        for s, e in stats.items())


PROFILED = (*INPUTS, *OUTPUTS)


@query("A1", f"WITH {TRAIN_SQL} " + " UNION ALL ".join(_profile_sql(c) for c in PROFILED))
def table_profile(spark, sf):
    """Counts, moments, quartiles and extremes of the training table."""
    train = part(parted(spark, sf), TRAIN)
    return rounded(profile(train, PROFILED, exact_distinct=True), 4)


@query("A2", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", round(any_value(q1), 6) AS q25, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q75,
       round(min(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
       round(max(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
       CAST(count(*) FILTER (WHERE x NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers
FROM (SELECT {e} AS x FROM events),
     (SELECT quantile_cont({e}, 0.25) AS q1, quantile_cont({e}, 0.5) AS q2, quantile_cont({e}, 0.75) AS q3 FROM events)
""" for c, e in (("value", "value"), ("user_id", "user_id::DOUBLE"))))
def boxplot(spark, sf):
    return rounded(boxplot_summary(read(spark, sf, "events"), ["value", "user_id"]), 6)


@query("A2", """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, 'value' AS "column", value FROM events, q
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def boxplot_outliers(spark, sf):
    return outlier_points(read(spark, sf, "events"), "event_id", ["value", "user_id"])


@query("A3", f"""WITH {EXPERIMENT_SQL}, long AS (
  {' UNION ALL '.join(f"SELECT '{c}' AS output, {c} AS y FROM exp" for c in OUTPUTS)})
SELECT output, round(var_samp(y), 2) AS variance FROM long GROUP BY output
UNION ALL SELECT 'all', round(var_pop(y), 2) FROM long""")
def output_variance(spark, sf):
    return rounded(target_variance(experiment(spark, sf), OUTPUTS), 2)

"""Sources and sinks: every sink is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from emulon import Roles
from emulon.operators.evaluate import metrics
from emulon.operators.features import expand_lists, family_values
from emulon.operators.impute import fit_imputer
from emulon.operators.scale import TCP_MINMAX, fit_scalers, scaler_types
from emulon.operators.split import TRAIN, part, split
from emulon.runtime import cut_lineage, scratch_path
from emulon.sources import store, tables
from emulon_queries import query
from emulon_queries.tables import (
    CONTINUOUS, EXPERIMENT_SQL, GAPS_SQL, INPUTS, OUTPUTS, PREDICTED_SQL, experiment, predicted, read, rounded,
    split_sql, with_gaps)


@query("S1", f"""WITH {EXPERIMENT_SQL}
SELECT key, l_quantity, l_extendedprice, l_discount, l_tax, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       {', '.join(f'round({c}, 6) AS {c}' for c in OUTPUTS)} FROM exp""")
def csv_table_pair(spark, sf):
    """Inputs and outputs as two CSV files, read with pinned schemas and paired by key."""
    exp = experiment(spark, sf)
    path = scratch_path(spark, "pair")
    exp.select("key", *INPUTS).write.option("header", True).csv(f"{path}/x")
    exp.select("key", *OUTPUTS).write.option("header", True).csv(f"{path}/y")
    pair = tables.read_pair(
        spark, f"{path}/x", f"{path}/y", key="key",
        inputs_schema="key string, " + ", ".join(f"{c} double" for c in CONTINUOUS) + ", l_linenumber bigint",
        outputs_schema="key string, " + ", ".join(f"{c} double" for c in OUTPUTS),
    )
    return rounded(pair.select("key", *INPUTS, *OUTPUTS), 6, keep=CONTINUOUS)


@query("S2", """
SELECT o_orderkey, o_totalprice, n_lines, round(total, 4) AS total
FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_extendedprice) AS total
                  FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def pair_by_key(spark, sf):
    """Orders and their per-order sums; orders without lines have no partner and are dropped."""
    sums = read(spark, sf, "lineitem").groupBy("l_orderkey").agg({"*": "count", "l_extendedprice": "sum"})
    sums = sums.withColumnsRenamed(
        {"l_orderkey": "o_orderkey", "count(1)": "n_lines", "sum(l_extendedprice)": "total"})
    pair = tables.align(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), sums, "o_orderkey", "drop")
    return rounded(pair.select("o_orderkey", "o_totalprice", "n_lines", "total"), {"total": 4}, keep=("o_totalprice",))


@query("S2", """
WITH x AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1),
     y AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CAST(count(*) FILTER (WHERE x.n > 1) AS BIGINT) AS duplicate_inputs,
       CAST(count(*) FILTER (WHERE y.n > 1) AS BIGINT) AS duplicate_outputs,
       CAST(count(*) FILTER (WHERE y.k IS NULL) AS BIGINT) AS orphan_inputs,
       CAST(count(*) FILTER (WHERE x.k IS NULL) AS BIGINT) AS orphan_outputs
FROM x FULL OUTER JOIN y ON x.k = y.k""")
def pair_key_report(spark, sf):
    """What a pairing of orders and raw order lines would run into."""
    lines = read(spark, sf, "lineitem").selectExpr("l_orderkey as o_orderkey")
    report = tables.pair_report(read(spark, sf, "orders"), lines, "o_orderkey")
    return spark.createDataFrame(
        [(report.duplicate_inputs, report.duplicate_outputs, report.orphan_inputs, report.orphan_outputs)],
        "duplicate_inputs bigint, duplicate_outputs bigint, orphan_inputs bigint, orphan_outputs bigint")


@query("S2", """
SELECT l_quantity, l_extendedprice, l_discount, l_tax,
       round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem""")
def pair_by_position(spark, sf):
    """Two tables without a key, paired by the position of their rows."""
    lines = read(spark, sf, "lineitem")
    x = lines.select(*CONTINUOUS)
    y = lines.selectExpr("l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge")
    return rounded(tables.pair_by_position(x, y).drop("row_id"), {"charge": 6}, keep=CONTINUOUS)


@query("S3", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events""")
def decimal_comma_source(spark, sf):
    """A file with semicolons and decimal commas; cells that are no numbers become nulls."""
    path = scratch_path(spark, "comma")
    read(spark, sf, "events").selectExpr(
        "event_id", "if(event_type = 'error', 'n/a', replace(cast(value as string), '.', ',')) as value",
    ).write.option("header", True).option("sep", ";").csv(path)
    return tables.read_decimal_comma(spark, path, ["value"]).selectExpr("cast(event_id as bigint) as event_id", "value")


@query("S3", """
SELECT 'value' AS "column", CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS bad FROM events""")
def decimal_comma_bad_cells(spark, sf):
    path = scratch_path(spark, "comma")
    read(spark, sf, "events").selectExpr(
        "if(event_type = 'error', 'n/a', replace(cast(value as string), '.', ',')) as value",
    ).write.option("header", True).option("sep", ";").csv(path)
    return tables.bad_cells(spark, path, ["value"])


@query("S4", f"""WITH {EXPERIMENT_SQL}
SELECT key, l_quantity, l_extendedprice, l_discount, l_tax, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       round(charge, 6) AS charge, round(TCP_X_pos_list_0, 6) AS TCP_X_pos_list_0,
       round(TCP_X_pos_list_1, 6) AS TCP_X_pos_list_1 FROM exp""")
def divide_table(spark, sf):
    """First five columns and the rest as two files that share the key; read back and paired."""
    exp = experiment(spark, sf).select("key", *INPUTS, *OUTPUTS)
    x, y = tables.write_divided(exp, len(INPUTS), scratch_path(spark, "divide"), key="key")
    doubles = ", ".join(f"{c} double" for c in OUTPUTS)
    pair = tables.read_pair(
        spark, x, y, "key", "key string, " + ", ".join(f"{c} double" for c in CONTINUOUS) + ", l_linenumber bigint",
        f"key string, {doubles}")
    return rounded(pair, 6, keep=CONTINUOUS)


@query("S5, S6", f"""WITH {EXPERIMENT_SQL}, {split_sql()}
SELECT key, l_quantity, round(charge, 6) AS charge, split FROM parted WHERE split = 'test'""")
def split_bundle(spark, sf):
    """All splits written as one partitioned table; reading one split reads its folder only."""
    path = scratch_path(spark, "bundle")
    tables.write_bundle(split(experiment(spark, sf), "key"), path)
    bundle = tables.read_bundle(spark, path, "test")
    return rounded(bundle.selectExpr("key", "l_quantity", "charge", "cast(split as string) as split"), 6)


@query("S7", f"""WITH {GAPS_SQL}, {split_sql('gaps')}, t AS (SELECT * FROM parted WHERE split = 'train')
SELECT 'l_quantity' AS "column", 'input' AS role, 'minmax' AS scaler, round(min(l_quantity), 6) AS center,
       round(max(l_quantity) - min(l_quantity), 6) AS scale, round(avg(l_quantity), 6) AS impute_value FROM t
UNION ALL
SELECT 'l_extendedprice', 'input', 'minmax', round(min(l_extendedprice), 6),
       round(max(l_extendedprice) - min(l_extendedprice), 6), round(avg(l_extendedprice), 6) FROM t
UNION ALL
SELECT 'charge', 'output', 'standard', round(avg(charge), 6), round(stddev_pop(charge), 6), NULL FROM t""")
def parameter_store(spark, sf):
    """Fitted means and scalers written as a table and read back."""
    train = part(cut_lineage(split(with_gaps(experiment(spark, sf)), "key"), partition_by="split"), TRAIN)
    columns = ("l_quantity", "l_extendedprice")
    imputer = fit_imputer(train, columns)
    clean = train.selectExpr(*[f"nanvl({c}, null) as {c}" for c in columns], "charge")
    fitted = {"input": fit_scalers(clean, dict.fromkeys(columns, "minmax")),
              "output": fit_scalers(clean, {"charge": "standard"})}
    path = scratch_path(spark, "parameters")
    store.write_scalers(spark, path, fitted, imputer)
    return rounded(spark.read.parquet(path).drop("position"), 6)


@query("S8", f"""WITH {PREDICTED_SQL}
SELECT key, {', '.join(f'round(pred_{c}, 8) AS predicted_{c}, round({c}, 8) AS expected_{c}' for c in OUTPUTS)}
FROM predicted""")
def prediction_files(spark, sf):
    """Predictions and expected values as two CSV tables, read back and paired."""
    path = scratch_path(spark, "predictions")
    paths = store.write_predictions(predicted(experiment(spark, sf)), "key", OUTPUTS, path)
    schema = "key string, " + ", ".join(f"{c} double" for c in OUTPUTS)
    both = [tables.read_table(spark, p, schema).withColumnsRenamed({c: f"{name}_{c}" for c in OUTPUTS})
            for p, name in zip(paths, ("predicted", "expected"))]
    return rounded(tables.align(both[0], both[1], "key"), 8)


@query("S9", f"""WITH {PREDICTED_SQL}
SELECT output, 'mae' AS metric, round(avg(abs(pred - y)), 6) AS value FROM long GROUP BY output
UNION ALL SELECT 'all', 'mae', round(avg(abs(pred - y)), 6) FROM long""")
def metric_files(spark, sf):
    """The metric table as JSON lines, read back."""
    path = scratch_path(spark, "metrics")
    store.write_metrics(metrics(predicted(experiment(spark, sf)), OUTPUTS, ["mae"]), path)
    return rounded(spark.read.schema("output string, metric string, value double").json(path), 6)


def _format_sql(x: str) -> str:
    return (f"CASE WHEN abs({x}) <> 0 AND (abs({x}) < 1e-4 OR abs({x}) > 1e4) THEN printf('%.6e', {x}) "
            f"ELSE printf('%.6f', {x}) END")


@query("S10, E12", f"""WITH p AS (
  SELECT event_id, value AS y, value * (1 + ((event_id % 7) - 3) / 100.0::DOUBLE) AS pred FROM events
), e AS (SELECT *, pred - y AS error, (pred - y) / (y + 1e-10::DOUBLE) * 100 AS pct FROM p)
SELECT CAST(event_id AS VARCHAR) AS key,
       concat('value -> expected=', {_format_sql('y')}, ', predicted=', {_format_sql('pred')},
              ', error=', {_format_sql('error')}, ', error%=', {_format_sql('pct')}, '%') AS line FROM e
UNION ALL
SELECT NULL, concat('Mean: value -> error=', {_format_sql('avg(abs(error))')}, ', error%=',
                    {_format_sql('avg(abs(pct))')}, '%') FROM e""")
def error_report_lines(spark, sf):
    """One line per row, and a line of means, with the number format of the report."""
    events = read(spark, sf, "events").selectExpr(
        "event_id", "value", "value * (1 + ((event_id % 7) - 3) / 100D) as pred_value")
    return store.error_report(events, "event_id", ["value"])


@query("P1, P5", f"""WITH {EXPERIMENT_SQL}
SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, key FROM exp""")
def role_projection(spark, sf):
    """Key and inputs by role, in their original order; names that are not there are ignored in a drop."""
    table = tables.drop_columns(experiment(spark, sf), ["l_orderkey", *OUTPUTS, "no_such_column"])
    roles = Roles("key", INPUTS, (), ("l_linenumber",))
    parted = table.select(roles.key, *roles.continuous, *roles.discrete)
    return parted.select(roles.key, *roles.inputs)


@query("P2", f"""WITH {EXPERIMENT_SQL}
SELECT 'charge' AS "column", 'standard' AS scaler, round(avg(charge), 6) AS center,
       round(stddev_pop(charge), 6) AS scale FROM exp
UNION ALL SELECT 'TCP_X_pos_list_0', 'minmax', round(min(TCP_X_pos_list_0), 6),
       round(max(TCP_X_pos_list_0) - min(TCP_X_pos_list_0), 6) FROM exp
UNION ALL SELECT 'TCP_X_pos_list_1', 'minmax', round(min(TCP_X_pos_list_1), 6),
       round(max(TCP_X_pos_list_1) - min(TCP_X_pos_list_1), 6) FROM exp""")
def scaler_rule_by_prefix(spark, sf):
    """Outputs with the family prefix get a scaler of their own, the others the default."""
    fitted = fit_scalers(experiment(spark, sf), scaler_types(OUTPUTS, "standard", [TCP_MINMAX]))
    table = store.parameter_table(spark, {"output": fitted})
    return rounded(table.select("column", "scaler", "center", "scale"), 6)


@query("P3", """WITH lists AS (
  SELECT l_orderkey, list(CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity END
                          ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount) AS q
  FROM lineitem GROUP BY l_orderkey
), cells AS (SELECT l_orderkey, generate_subscripts(q, 1) - 1 AS position, unnest(q) AS value FROM lists)
SELECT l_orderkey, CAST(position AS INTEGER) AS position, value FROM cells WHERE value IS NOT NULL""")
def list_expansion(spark, sf):
    """Lists written as text, of unequal length and with missing items, expanded to columns."""
    items = read(spark, sf, "lineitem").selectExpr(
        "l_orderkey",
        "struct(l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, "
        "if(l_discount = 0, 'None', cast(l_quantity as string)) as item) as s")
    texts = items.groupBy("l_orderkey").agg(F.expr(
        "concat('[', array_join(transform(array_sort(collect_list(s)), s -> s.item), ', '), ']')").alias("q"))
    wide = expand_lists(texts)
    columns = [c for c in wide.columns if c != "l_orderkey"]
    long = wide.unpivot("l_orderkey", columns, "name", "value").where("value is not null")
    return long.selectExpr("l_orderkey", "cast(substring(name, 3) as int) as position", "value")


@query("P3", f"""SELECT vec_id, {', '.join(f'embedding[{i + 1}]::DOUBLE AS embedding_{i}' for i in range(64))} FROM embeddings""")
def array_expansion(spark, sf):
    """An array column widened to one column per position."""
    return expand_lists(read(spark, sf, "embeddings").select("vec_id", "embedding"))


@query("P4", f"""WITH {EXPERIMENT_SQL}
SELECT key, 'TCP_X_pos_list' AS family, 'TCP_X_pos_list_0' AS output, round(TCP_X_pos_list_0, 6) AS value FROM exp
UNION ALL SELECT key, 'TCP_X_pos_list', 'TCP_X_pos_list_1', round(TCP_X_pos_list_1, 6) FROM exp""")
def family_selection(spark, sf):
    """Columns of the output families pooled into one series."""
    return rounded(family_values(experiment(spark, sf), "key", OUTPUTS), 6)



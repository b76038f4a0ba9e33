"""Queries over grids, comparisons, reshaping and best settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrytrace.operators import results
from ferrytrace.plans.registry import LINE_ORDER, SWEEP_SQL, query

FIRST_ROW = "ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
KEYS = ["size", "partitions"]
CONFIG = ["partitions", "size", "acks"]


@query(
    "compare_engines",
    f"""WITH {SWEEP_SQL},
        n AS (SELECT size, partitions, avg(mb_per_sec) AS native_mb FROM sweep WHERE acks = 'F' GROUP BY 1, 2),
        s AS (SELECT size, partitions, avg(mb_per_sec) AS spark_mb FROM sweep WHERE acks = 'O' GROUP BY 1, 2)
        SELECT size, partitions, round(native_mb, 4) AS native_mb, round(spark_mb, 4) AS spark_mb,
               round(spark_mb - native_mb, 4) AS gap_mb, round(spark_mb / native_mb, 4) AS ratio
        FROM n JOIN s USING (size, partitions)""",
)
def compare_engines(t):
    sweep = t.sweep()
    compared = results.compare_engines(
        sweep.filter(F.col("acks") == "F"), sweep.filter(F.col("acks") == "O"), KEYS
    )
    return compared.withColumns(
        {c: F.round(c, 4) for c in ("native_mb", "spark_mb", "gap_mb", "ratio")}
    )


@query(
    "config_grid",
    f"""WITH {SWEEP_SQL} SELECT p.partitions, s.size, a.acks
        FROM (SELECT DISTINCT partitions FROM sweep) p, (SELECT DISTINCT size FROM sweep) s,
             (SELECT DISTINCT acks FROM sweep) a""",
)
def config_grid(t):
    return results.grid_of(t.sweep(), CONFIG)


@query(
    "grid_fill",
    f"""WITH {SWEEP_SQL}, grid AS (
          SELECT * FROM planned p, (SELECT DISTINCT size FROM sweep) s, (SELECT DISTINCT acks FROM sweep) a),
        found AS (SELECT partitions, size, acks, max(mb_per_sec) AS best_mb, min(latency) AS latency
                  FROM sweep WHERE acks = 'O' GROUP BY 1, 2, 3)
        SELECT partitions, size, acks, coalesce(best_mb, 0) AS best_mb, coalesce(latency, 0) AS latency,
               best_mb IS NOT NULL AS measured
        FROM grid LEFT JOIN found USING (partitions, size, acks)""",
)
def grid_fill(t):
    sweep = t.sweep()
    found = sweep.filter(F.col("acks") == "O").groupBy(*CONFIG).agg(
        F.max("mb_per_sec").alias("best_mb"), F.min("latency").alias("latency")
    )
    return results.grid_fill(results.grid_of(sweep, CONFIG, t.planned()), found, CONFIG, ["best_mb", "latency"])


@query(
    "union_result_kinds",
    """SELECT 'producer' AS test_type, l_linenumber AS partitions, l_quantity AS mb_per_sec,
              l_extendedprice AS avg_latency_ms, NULL::INTEGER AS group_no, NULL::DOUBLE AS test_duration_sec
       FROM lineitem WHERE l_linestatus = 'O'
       UNION ALL SELECT 'consumer', l_linenumber, l_quantity, NULL, l_linenumber, NULL FROM lineitem WHERE l_linestatus = 'F'
       UNION ALL SELECT 'e2e-producer', l_linenumber, l_quantity, l_extendedprice, NULL, l_tax FROM lineitem""",
)
def union_result_kinds(t):
    rows = t.lineitem
    base = [F.col("l_linenumber").alias("partitions"), F.col("l_quantity").alias("mb_per_sec")]
    latency = F.col("l_extendedprice").alias("avg_latency_ms")
    producer = rows.filter(F.col("l_linestatus") == "O").select(
        F.lit("producer").alias("test_type"), *base, latency
    )
    consumer = rows.filter(F.col("l_linestatus") == "F").select(
        F.lit("consumer").alias("test_type"), *base, F.col("l_linenumber").alias("group_no")
    )
    both = rows.select(
        F.lit("e2e-producer").alias("test_type"),
        *base,
        latency,
        F.col("l_tax").alias("test_duration_sec"),
    )
    return results.union_all([producer, consumer, both])


@query(
    "union_runs",
    """SELECT l_returnflag AS run, l_linenumber AS partitions, count(*) AS n, sum(l_quantity) AS mb_sum
       FROM lineitem GROUP BY 1, 2""",
)
def union_runs(t):
    """Replicate runs of one layout stacked and summed per run."""
    runs = t.lineitem.select(
        F.col("l_returnflag").alias("run"),
        F.col("l_linenumber").alias("partitions"),
        F.col("l_quantity").alias("mb_per_sec"),
    )
    return runs.groupBy("run", "partitions").agg(
        F.count(F.lit(1)).alias("n"), F.sum("mb_per_sec").alias("mb_sum")
    )


def _first_of(where: str, value: str) -> str:
    return (
        f"SELECT DISTINCT ON (size, partitions) size, partitions, {value} FROM sweep "
        f"WHERE {where} ORDER BY size, partitions, {FIRST_ROW[9:]}"
    )


@query(
    "pivot_acks",
    f"""WITH {SWEEP_SQL}, a AS ({_first_of("acks = 'F'", "latency")}), b AS ({_first_of("acks = 'O'", "latency")})
        SELECT size, partitions, a.latency AS "F", b.latency AS "O",
               round((b.latency - a.latency) / a.latency * 100, 4) AS diff_pct
        FROM a FULL JOIN b USING (size, partitions)""",
)
def pivot_acks(t):
    wide = results.pivot_pair(t.sweep(), KEYS, "acks", ("F", "O"), "latency", LINE_ORDER)
    return wide.withColumn("diff_pct", F.round("diff_pct", 4))


@query(
    "pivot_partitions",
    f"""WITH {SWEEP_SQL} SELECT size, """
    + ", ".join(
        f"round(coalesce(avg(CASE WHEN partitions = {n} THEN mb_per_sec END), 0), 4) AS p{n}"
        for n in range(1, 8)
    )
    + " FROM sweep GROUP BY 1",
)
def pivot_partitions(t):
    counts = results.settings_found(t.sweep(), "partitions")
    wide = results.pivot_partitions(t.sweep(), "size", "partitions", counts, "mb_per_sec")
    return wide.withColumns({f"p{n}": F.round(f"p{n}", 4) for n in counts})


@query(
    "producer_vs_consumer",
    f"""WITH {SWEEP_SQL}, p AS ({_first_of("acks = 'O'", "mb_per_sec")}),
        c AS (SELECT size, partitions, avg(mb_per_sec) AS mb FROM sweep WHERE acks = 'F' GROUP BY 1, 2)
        SELECT size, partitions, coalesce(p.mb_per_sec, 0) AS producer_mb, round(coalesce(c.mb, 0), 4) AS consumer_mb
        FROM p FULL JOIN c USING (size, partitions)""",
)
def producer_vs_consumer(t):
    """The line status stands for the kind of test."""
    sides = results.producer_vs_consumer(
        t.sweep(), KEYS, "acks", "O", "F", "mb_per_sec", LINE_ORDER
    )
    return sides.withColumn("consumer_mb", F.round("consumer_mb", 4))


@query(
    "throughput_latency_points",
    f"""WITH {SWEEP_SQL}, f AS (
          SELECT DISTINCT ON (size, partitions, acks) size, partitions, acks, mb_per_sec, latency FROM sweep ORDER BY size, partitions, acks, {FIRST_ROW[9:]})
        SELECT * FROM f WHERE mb_per_sec IS NOT NULL AND latency IS NOT NULL""",
)
def throughput_latency_points(t):
    return results.throughput_latency_points(
        t.sweep(), ["size", "partitions", "acks"], "mb_per_sec", "latency", LINE_ORDER
    )


def _best_sql(column: str, how: str) -> str:
    return (
        f"(SELECT '{column}' AS criterion, partitions, size, acks, {column} AS best FROM sweep "
        f"ORDER BY {column} {how}, partitions, size, acks LIMIT 1)"
    )


@query(
    "best_config",
    f"WITH {SWEEP_SQL} {_best_sql('mb_per_sec', 'DESC')} UNION ALL {_best_sql('latency', 'ASC')}",
)
def best_config(t):
    return results.best_config(t.sweep(), CONFIG, {"mb_per_sec": True, "latency": False})


@query(
    "size_report",
    f"""WITH {SWEEP_SQL} SELECT size, partitions, acks, count(*) AS n, max(mb_per_sec) AS best_mb,
               min(latency) AS best_latency FROM sweep GROUP BY 1, 2, 3 ORDER BY 1, 2, 3""",
)
def size_report(t):
    summed = t.sweep().groupBy("size", "partitions", "acks").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("mb_per_sec").alias("best_mb"),
        F.min("latency").alias("best_latency"),
    )
    return results.size_report(summed, "size", "partitions", "acks")


RECORD_SQL = "l_linenumber::VARCHAR || ',' || l_suppkey::VARCHAR || ',' || l_quantity::VARCHAR"


@query(
    "split_fused_records",
    " UNION ALL ".join(
        f"SELECT '{kind},' || {RECORD_SQL} || '{tail}' AS record FROM lineitem"
        for kind, tail in (
            ("producer", ","),
            ("consumer", ",N/A"),
            ("e2e-producer", ""),
            ("e2e-consumer", ",N/A"),
        )
    ),
)
def split_fused_records(t):
    """Four result rows of one line item, stuck together and split again."""
    body = F.concat_ws(
        ",",
        F.col("l_linenumber").cast("string"),
        F.col("l_suppkey").cast("string"),
        F.col("l_quantity").cast("string"),
    )
    fused = F.concat(
        F.lit("producer,"), body, F.lit(","),
        F.lit("consumer,"), body, F.lit(",N/A"),
        F.lit("e2e-producer,"), body,
        F.lit("e2e-consumer,"), body, F.lit(",N/A"),
    )
    return results.split_fused(t.lineitem.select(fused.alias("value")))

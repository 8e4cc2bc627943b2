"""Queries over file operations: counters, bins, reports, deltas, access."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import model
from quarry.model import OPERATIONS
from quarry.operators import metrics
from quarry.plans.catalog import query

SIZE_BIN = "CAST((bytes>=1024)::INT+(bytes>=4096)::INT+(bytes>=16384)::INT+(bytes>=65536)::INT+(bytes>=131072)::INT+(bytes>=524288)::INT+(bytes>=1048576)::INT AS BIGINT)"
US_BIN = "CAST((latency_us>200)::INT+(latency_us>1000)::INT+(latency_us>20000)::INT+(latency_us>50000)::INT+(latency_us>500000)::INT+(latency_us>1000000)::INT+(latency_us>2000000)::INT AS BIGINT)"
MS_BIN = US_BIN.replace("latency_us", "ms").replace("200)", "1)", 1).replace(">1000)", ">20)", 1).replace(">20000)", ">50)").replace(">50000)", ">100)").replace(">500000)", ">500)").replace(">1000000)", ">1000)").replace(">2000000)", ">2000)")


@query("fop_counters", f"""WITH {OPERATIONS} SELECT op, count(*) FILTER (ok) hits, count(*) FILTER (NOT ok) errors, CAST(coalesce(sum(bytes) FILTER (ok AND op='read'), 0) AS BIGINT) bytes_read FROM ops GROUP BY 1""")
def fop_counters(spark, sf_dir):
    return metrics.operation_counters(model.operations(spark, sf_dir))


@query("open_handles", f"WITH {OPERATIONS} SELECT count(*) FILTER (op='open' AND ok) - count(*) FILTER (op='release' AND ok) open_files FROM ops")
def open_handles(spark, sf_dir):
    return metrics.open_handles(model.operations(spark, sf_dir))


@query("size_hist", f"WITH {OPERATIONS} SELECT {SIZE_BIN} bin, count(*) reads FROM ops WHERE op='read' GROUP BY 1")
def size_hist(spark, sf_dir):
    return metrics.read_size_histogram(model.operations(spark, sf_dir))


@query("latency_hist_us", f"WITH {OPERATIONS} SELECT {US_BIN} bin, count(*) reads FROM ops WHERE op='read' AND ok GROUP BY 1")
def latency_hist_us(spark, sf_dir):
    return metrics.latency_histogram(model.operations(spark, sf_dir), "us")


@query("latency_hist_ms", f"WITH {OPERATIONS} SELECT {MS_BIN} bin, count(*) reads FROM (SELECT *, latency_us // 1000 ms FROM ops) WHERE op='read' AND ok GROUP BY 1")
def latency_hist_ms(spark, sf_dir):
    return metrics.latency_histogram(model.operations(spark, sf_dir), "ms")


_BINS = ", ".join(f"count(*) FILTER (b={i}) bin{i}" for i in range(8))


@query("inode_counters", f"WITH {OPERATIONS} SELECT ino, count(*) total, count(*) FILTER (NOT ok) errors, CAST(sum(bytes) AS BIGINT) bytes, {_BINS} FROM (SELECT *, {SIZE_BIN} b FROM ops) GROUP BY 1")
def inode_counters(spark, sf_dir):
    return metrics.inode_counters(model.operations(spark, sf_dir))


@query("access_pattern", f"WITH {OPERATIONS} SELECT ino, count(*) nr_read, min(ts) first_access FROM ops WHERE op='read' GROUP BY 1 HAVING count(*) > 0")
def access_pattern(spark, sf_dir):
    return metrics.access_pattern(model.operations(spark, sf_dir))


@query("backend_matrix", f"""WITH {OPERATIONS} SELECT {SIZE_BIN} size_bin, {MS_BIN} latency_bin, count(*) reads, count(*) FILTER (NOT ok) errors, CAST(sum(bytes) AS BIGINT) bytes, CAST(sum(latency_us) AS BIGINT) latency_us
FROM (SELECT *, latency_us // 1000 ms FROM ops) WHERE op='read' GROUP BY 1, 2""")
def backend_matrix(spark, sf_dir):
    return metrics.backend_matrix(model.operations(spark, sf_dir))


@query("prefetch_metrics", f"WITH {OPERATIONS} SELECT count(*) requests, CAST(sum(bytes) AS BIGINT) bytes, max(ts) end_time, CAST(sum(latency_us) AS BIGINT) latency_us FROM ops WHERE op='open'")
def prefetch_metrics(spark, sf_dir):
    return metrics.prefetch_metrics(model.operations(spark, sf_dir).filter("op = 'open'"))


@query("cache_report", f"""WITH {OPERATIONS}, r AS (SELECT count(*) n, count(*) FILTER (ok) hits, sum(bytes) b, max(ts)-min(ts) s FROM ops WHERE op='read')
SELECT CAST(CASE WHEN n=0 THEN 0 ELSE hits*100//n END AS BIGINT) hit_percent, CAST(CASE WHEN n=0 THEN 0 ELSE b//n END AS BIGINT) mean_size, CAST(CASE WHEN s=0 THEN 0 ELSE b//s END AS BIGINT) bytes_per_second FROM r""")
def cache_report(spark, sf_dir):
    return metrics.cache_report(model.operations(spark, sf_dir))


@query("bandwidth_report", f"""WITH {OPERATIONS} SELECT ts//86400*86400 slot, count(*) reads, CAST(sum(bytes)//(1024*86400) AS BIGINT) kb_per_second, CAST(sum(bytes)//count(*) AS BIGINT) mean_size, CAST(sum(latency_us)//count(*) AS BIGINT) mean_latency_us
FROM ops WHERE op='read' GROUP BY 1""")
def bandwidth_report(spark, sf_dir):
    return metrics.backend_report(model.operations(spark, sf_dir))


@query("metric_delta_tumbling", f"""WITH {OPERATIONS}, d AS (SELECT op, ts//86400 slot, CAST(sum(bytes) AS BIGINT) v FROM ops GROUP BY 1, 2)
SELECT op, slot, v, coalesce(greatest(v - lag(v) OVER (PARTITION BY op ORDER BY slot), 0), 0) delta FROM d""")
def metric_delta_tumbling(spark, sf_dir):
    daily = model.operations(spark, sf_dir).groupBy("op", F.floor(F.col("ts") / 86400).alias("slot")).agg(F.sum("bytes").alias("v"))
    return metrics.metric_delta(daily, ["op"], "slot", "v")


@query("metric_vector_delta", f"""WITH {OPERATIONS}, d AS (SELECT ts//86400 slot, [{", ".join(f"count(*) FILTER (b={i})" for i in range(8))}] v FROM (SELECT *, {SIZE_BIN} b FROM ops) GROUP BY 1),
l AS (SELECT slot, v, lag(v) OVER (ORDER BY slot) p FROM d)
SELECT slot, {", ".join(f"CASE WHEN p IS NULL THEN v[{i + 1}] ELSE greatest(v[{i + 1}] - p[{i + 1}], 0) END d{i}" for i in range(8))} FROM l""")
def metric_vector_delta(spark, sf_dir):
    bins = F.array(*[F.count_if(metrics.size_bin(F.col("bytes")) == i) for i in range(8)])
    daily = model.operations(spark, sf_dir).groupBy(F.floor(F.col("ts") / 86400).alias("slot")).agg(bins.alias("v")).withColumn("all", F.lit(0))
    return metrics.vector_delta(daily, ["all"], "slot", "v").select("slot", *[F.col("delta")[i].alias(f"d{i}") for i in range(8)])


@query("inode_ranges", f"""WITH {OPERATIONS}, i AS (SELECT DISTINCT ino FROM ops WHERE op='read' AND ok AND bytes > 200000), g AS (SELECT ino, ino - row_number() OVER (ORDER BY ino) k FROM i)
SELECT min(ino) first, max(ino) "last" FROM g GROUP BY k""")
def inode_ranges(spark, sf_dir):
    """Ranges of inodes that had a large read."""
    return metrics.id_ranges(model.operations(spark, sf_dir).filter("op = 'read' and ok and bytes > 200000"))


@query("nonzero_access", f"WITH {OPERATIONS} SELECT ino, count(*) FILTER (op='release') nr FROM ops GROUP BY 1 HAVING count(*) FILTER (op='release') > 0")
def nonzero_access(spark, sf_dir):
    return model.operations(spark, sf_dir).groupBy("ino").agg(F.count_if(F.col("op") == "release").alias("nr")).filter("nr > 0")


@query("latency_start_end", f"""WITH {OPERATIONS}, s AS (SELECT ino, ts, seq, op, lag(op) OVER w po, lag(ts) OVER w pt FROM ops WHERE op IN ('open','release') WINDOW w AS (PARTITION BY ino ORDER BY ts, seq))
SELECT ino, pt opened, ts released, ts - pt took FROM s WHERE op='release' AND po='open'""")
def latency_start_end(spark, sf_dir):
    """Duration of each open that the next operation on the handle releases."""
    from pyspark.sql import Window as W

    w = W.partitionBy("ino").orderBy("ts", "seq")
    pairs = model.operations(spark, sf_dir).filter("op in ('open', 'release')").withColumns({"po": F.lag("op").over(w), "opened": F.lag("ts").over(w)})
    return pairs.filter("op = 'release' and po = 'open'").select("ino", "opened", F.col("ts").alias("released"), (F.col("ts") - F.col("opened")).alias("took"))


@query("retry_audit", f"""WITH {OPERATIONS}, r AS (SELECT *, seq % 4 try, CASE WHEN seq % 9 = 0 THEN 403 WHEN seq % 7 = 0 THEN 429 WHEN ok THEN 200 ELSE 500 END status, seq % 5 = 0 prefetch FROM ops WHERE op='read')
SELECT CASE WHEN status=200 THEN 'done' WHEN status=403 THEN 'fail' WHEN try < CASE WHEN prefetch THEN 1 ELSE 3 END THEN CASE WHEN status=429 THEN 'retry without proxy' ELSE 'retry' END ELSE 'fail' END decision, count(*) n FROM r GROUP BY 1""")
def retry_audit(spark, sf_dir):
    """What the retry policy decides: three retries on demand, one for prefetch, none when forbidden, no proxy when throttled."""
    from quarry.sources.backends import retry_decision

    reads = model.operations(spark, sf_dir).filter("op = 'read'")
    status = F.when(F.col("seq") % 9 == 0, 403).when(F.col("seq") % 7 == 0, 429).when(F.col("ok"), 200).otherwise(500)
    return reads.groupBy(retry_decision(status, F.col("seq") % 4, F.col("seq") % 5 == 0).alias("decision")).agg(F.count("*").alias("n"))


@query("error_ring", """WITH e AS (SELECT CAST(event_id AS BIGINT) seq, 20 + event_id % 400 size FROM events WHERE event_type='error'),
r AS (SELECT seq, size, row_number() OVER (ORDER BY seq DESC) rn, sum(size) OVER (ORDER BY seq DESC) total FROM e) SELECT seq, CAST(size AS BIGINT) size FROM r WHERE rn <= 500 AND total <= 51200""")
def error_ring(spark, sf_dir):
    """The last errors that fit a ring of 500 messages and 50 KiB."""
    from quarry.streaming.state import ring

    errors = model.table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").cast("bigint").alias("seq"), (20 + F.col("event_id") % 400).cast("bigint").alias("size"))
    return ring(errors, "seq", "size", 500, 50 << 10)


@query("trace_summary", f"WITH {OPERATIONS} SELECT op point, count(*) calls, CAST(sum(latency_us) AS BIGINT) total_us, max(latency_us) longest_us FROM ops GROUP BY 1")
def trace_summary(spark, sf_dir):
    return model.operations(spark, sf_dir).groupBy(F.col("op").alias("point")).agg(F.count("*").alias("calls"), F.sum("latency_us").alias("total_us"), F.max("latency_us").alias("longest_us"))

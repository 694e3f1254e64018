"""Raw samples → snapshot rows (AG-1…17).

Each raw table carries a `sample_id`. Every fold is one ``groupBy(sample_id)``
with partially aggregatable functions (count, sum, avg, min_by, distinct
count of a small-domain column), so a hot sample is combined map-side and
sends one row per task through the shuffle. The results are joined on
`sample_id` to the samples that were read.

Rules kept from the collector: a whole sample is dropped when a required
part is unreadable (a flag of the sample's host row), optional figures default
to 0, the first core gives the model name and base speed, uptime is stored in
nanoseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NANOS_PER_SECOND = 1_000_000_000


def mean_mhz(cores: DataFrame) -> DataFrame:
    """AG-1: current speed = mean of per-core MHz."""
    return cores.groupBy("sample_id").agg(F.avg("mhz").alias("current_speed_mhz"))


def first_core(cores: DataFrame, order: tuple[str, ...] = ("core_no", "tie1", "tie2", "mhz")) -> DataFrame:
    """AG-2: model name and base speed of the first core (least `order`)."""
    pick = F.min_by(F.struct(F.col("model_name"), F.col("mhz")), F.struct(*[F.col(c) for c in order]))
    return (cores.groupBy("sample_id").agg(pick.alias("_first"))
            .select("sample_id", F.col("_first.model_name").alias("name"),
                    F.col("_first.mhz").alias("base_speed_mhz")))


def core_counts(cores: DataFrame) -> DataFrame:
    """AG-3/4: physical cores (distinct physical core ids) and logical cores (rows)."""
    return cores.groupBy("sample_id").agg(
        F.countDistinct("phys_core").cast("int").alias("physical_cores"),
        F.count(F.lit(1)).cast("int").alias("logical_cores"))


def core_stats(cores: DataFrame, order: tuple[str, ...] = ("core_no", "tie1", "tie2", "mhz")) -> DataFrame:
    """AG-1/2/3/4 in one pass: first core's name and speed, physical and logical cores, mean MHz."""
    pick = F.min_by(F.struct(F.col("model_name"), F.col("mhz")), F.struct(*[F.col(c) for c in order]))
    return (cores.groupBy("sample_id")
            .agg(pick.alias("_first"), F.count(F.lit(1)).cast("int").alias("logical_cores"),
                 F.countDistinct("phys_core").cast("int").alias("physical_cores"),
                 F.avg("mhz").alias("current_speed_mhz"))
            .select("sample_id", F.col("_first.model_name").alias("name"), F.col("_first.mhz").alias("base_speed_mhz"),
                    "physical_cores", "logical_cores", "current_speed_mhz"))


def first_or_zero(values: Column) -> Column:
    """AG-5: first element of a list, 0 when the list is empty, missing, or starts with a null."""
    return F.coalesce(F.get(values, F.lit(0)), F.lit(0.0))


def process_totals(procs: DataFrame) -> DataFrame:
    """AG-6/7/8: processes counted; unreadable thread / handle figures skipped."""
    return procs.groupBy("sample_id").agg(
        F.count(F.lit(1)).cast("int").alias("processes_amount"),
        F.coalesce(F.sum("num_threads"), F.lit(0)).cast("int").alias("threads_amount"),
        F.coalesce(F.sum("num_fds"), F.lit(0)).cast("int").alias("handles_amount"))


def uptime_ns(seconds: Column) -> Column:
    """AG-9: uptime seconds → nanoseconds, 0 when unreadable."""
    return F.coalesce(seconds.cast("long"), F.lit(0).cast("long")) * F.lit(NANOS_PER_SECOND).cast("long")


NET_COUNTERS = ("bytes_sent", "bytes_recv", "packets_sent", "packets_recv", "err_in", "err_out")


def net_totals(ifaces: DataFrame) -> DataFrame:
    """AG-10: counters summed over all interfaces of a sample."""
    return ifaces.groupBy("sample_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in NET_COUNTERS])


def connection_counts(conns: DataFrame) -> DataFrame:
    """AG-11: connections of all kinds per sample."""
    return conns.groupBy("sample_id").agg(F.count(F.lit(1)).cast("int").alias("connections"))


def ram_project(memory: DataFrame) -> DataFrame:
    """AG-12: the five memory figures under the table's names.

    AG-14: with a flag `mem_ok`, a sample whose memory is unreadable is dropped.
    """
    readable = memory.where("mem_ok") if "mem_ok" in memory.columns else memory
    return readable.select("sample_id", F.col("total_b").alias("total"), F.col("used_b").alias("used"),
                           F.col("free_b").alias("free"), F.col("committed_as").alias("commited"),
                           F.col("cached_b").alias("cached"))


USAGE = ("total", "used", "free", "used_percent")


def file_project(partitions: DataFrame, order: str = "event_id") -> DataFrame:
    """AG-13: one row per partition with its usage figures as read; partitions without them are dropped.

    AG-14: with a flag `parts_ok`, a sample whose partition list is unreadable is dropped.
    """
    readable = partitions.where("parts_ok") if "parts_ok" in partitions.columns else partitions
    return readable.where("usage_ok").select("sample_id", order, F.col("mountpoint").alias("path"), *USAGE)


def cpu_snapshot(host: DataFrame, cores: DataFrame, procs: DataFrame) -> DataFrame:
    """AG-14/15/16: one CPU snapshot per readable sample.

    `host` has one row per sample (`cpu_ok` false = CPU info unreadable →
    sample dropped; `utilization` is the list of readings); missing cores or
    processes give zeros and an empty name.
    """
    base = host.where(F.col("cpu_ok")).select("sample_id", "utilization", "uptime_s")
    out = base.join(core_stats(cores), "sample_id", "left").join(process_totals(procs), "sample_id", "left")
    return out.select(
        "sample_id",
        F.coalesce(F.col("name"), F.lit("")).alias("name"),
        F.coalesce(F.col("physical_cores"), F.lit(0)).cast("int").alias("physical_cores"),
        F.coalesce(F.col("logical_cores"), F.lit(0)).cast("int").alias("logical_cores"),
        first_or_zero(F.col("utilization")).alias("utilization"),
        F.coalesce(F.col("current_speed_mhz"), F.lit(0.0)).alias("current_speed_mhz"),
        F.coalesce(F.col("base_speed_mhz"), F.lit(0.0)).alias("base_speed_mhz"),
        F.coalesce(F.col("processes_amount"), F.lit(0)).cast("int").alias("processes_amount"),
        F.coalesce(F.col("threads_amount"), F.lit(0)).cast("int").alias("threads_amount"),
        F.coalesce(F.col("handles_amount"), F.lit(0)).cast("int").alias("handles_amount"),
        uptime_ns(F.col("uptime_s")).alias("uptime"))


def net_snapshot(host: DataFrame, ifaces: DataFrame, conns: DataFrame) -> DataFrame:
    """AG-10/14/17: counters and connection count of every readable sample.

    `host` has one row per sample; `net_ok` or `conn_ok` false means that the
    counters or the connections could not be read, and drops the sample. A
    sample without interfaces, or without connections, has zeros.
    """
    read = host.where(F.col("net_ok") & F.col("conn_ok")).select("sample_id")
    out = (read.join(net_totals(ifaces), "sample_id", "left")
           .join(connection_counts(conns), "sample_id", "left"))
    return out.select("sample_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in NET_COUNTERS],
                      F.coalesce(F.col("connections"), F.lit(0)).cast("int").alias("connections"))


def unsigned_long(sample: Column) -> Column:
    """An unsigned 64-bit reading (`decimal(20,0)`) as the table's signed column; one that does not fit raises."""
    fits = sample.between(F.lit(0), F.lit(2 ** 63 - 1))
    return F.when(sample.isNull(), F.lit(None).cast("long")).when(fits, sample.cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("reading does not fit: "), sample.cast("string"))).cast("long"))

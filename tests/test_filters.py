import pytest
from pyspark.sql import functions as F

from hostshelf import info_query, resolve
from hostshelf.functions.filters import REGISTRY
from hostshelf.functions.literals import like_pattern
from hostshelf.schemas import CPU, FILE, RAM
from hostshelf.sources.fixtures import Fixtures

from conftest import SF001


@pytest.fixture(scope="module")
def fx(spark):
    return Fixtures(spark, SF001)


def test_registry_has_54_predicates_plus_paging():
    per_table = {k: len(v) for k, v in REGISTRY.items()}
    # two time bounds in every table + table-specific filters
    specific = sum(n - 2 for n in per_table.values())
    assert specific + 2 == 54
    assert per_table == {"cpu": 21, "ram": 12, "net": 16, "file": 11}


def test_unknown_names_ignored_and_no_filters_is_full_table(spark, fx):
    spec = resolve("cpu", {"unknown_field": "1"})
    assert spec.predicates == [] and spec.limit is None
    assert info_query(fx.info_cpu, "cpu", {"unknown_field": "1"}).count() == fx.info_cpu.count()


def test_repeated_name_first_value_and_empty_list_skipped():
    spec = resolve("cpu", [("limit", "5"), ("limit", "7"), ("offset", [])])
    assert spec.limit == 5 and spec.offset is None
    assert resolve("cpu", {"limit": ["3", "9"]}).limit == 3


def test_empty_string_is_a_value_and_fails_its_cast(spark, fx):
    df = info_query(fx.info_cpu, "cpu", {"utilization_min": ""})
    with pytest.raises(Exception):
        df.collect()


def test_fraction_for_integer_column_fails(spark, fx):
    with pytest.raises(Exception):
        info_query(fx.info_cpu, "cpu", {"physical_cores_max": "12.5"}).collect()


def test_padded_integer_accepted(spark, fx):
    a = info_query(fx.info_cpu, "cpu", {"physical_cores_max": " 4 "}).count()
    b = fx.info_cpu.where("physical_cores <= 4").count()
    assert a == b > 0


def test_misfit_filter_is_an_error():
    with pytest.raises(ValueError):
        resolve("ram", {"cpu_utilization_min": "5"})
    with pytest.raises(ValueError):
        resolve("ram", {"utilization_min": "5", "start_datetime": "2024-01-01"})


def test_short_names_resolve_within_table(spark, fx):
    # `total_min` exists for RAM and disk: each table uses its own column.
    ram = info_query(fx.info_ram, "ram", {"total_min": "20000000001"}).count()
    disk = info_query(fx.info_file, "file", {"total_min": "100000"}).count()
    assert ram == 0 and disk == fx.info_file.count()
    documented = info_query(fx.info_cpu, "cpu", {"cpu_physical_cores_max": "3"}).count()
    short = info_query(fx.info_cpu, "cpu", {"physical_cores_max": "3"}).count()
    assert documented == short > 0


def test_unknown_kind_is_an_error(fx):
    with pytest.raises(ValueError):
        info_query(fx.info_cpu, "gpu", {})


def test_empty_result_keeps_schema(spark, fx):
    df = info_query(fx.info_cpu, "cpu", {"utilization_min": "1e9"})
    assert df.collect() == [] and df.columns == CPU.names
    assert info_query(fx.info_ram, "ram", {}).columns == RAM.names
    assert info_query(fx.info_file, "file", {}).columns == FILE.names


def test_timestamp_zone_suffix_ignored(spark, fx):
    a = info_query(fx.info_cpu, "cpu", {"start_datetime": "2024-01-10T00:00:00+03:00"}).count()
    b = fx.info_cpu.where("insertion_datetime >= TIMESTAMP_NTZ '2024-01-10 00:00:00'").count()
    assert a == b > 0


def test_like_escapes():
    assert like_pattern(r"a\_b") == r"a\_b"
    assert like_pattern(r"a\xb") == "axb"
    assert like_pattern("a\\\\b") == "a\\\\b"


def test_trailing_escape_raises(spark, fx):
    with pytest.raises(Exception):
        info_query(fx.info_cpu, "cpu", {"name": "abc\\"}).collect()


def test_like_is_case_sensitive(spark, fx):
    assert info_query(fx.info_cpu, "cpu", {"name": "VIEW"}).count() == 0
    assert info_query(fx.info_cpu, "cpu", {"name": "view"}).count() > 0


def test_negative_row_paging_raises(fx):
    with pytest.raises(ValueError):
        info_query(fx.info_cpu, "cpu", {"limit": "-1"})
    with pytest.raises(ValueError):
        info_query(fx.info_cpu, "cpu", {"offset": "-3"})


def test_filter_literal_is_pushed_to_parquet(spark, fx):
    df = info_query(spark.read.parquet(f"{SF001}/events.parquet").select(
        F.col("event_id").cast("int").alias("id"), F.col("event_id").cast("int").alias("group_id"),
        F.col("event_type").alias("path"), F.lit(1).cast("long").alias("total"),
        F.lit(1).cast("long").alias("used"), F.lit(1).cast("long").alias("free"),
        F.col("value").alias("used_percent"), F.col("ts").alias("insertion_datetime")),
        "file", {"start_datetime": "2024-01-20T00:00:00Z"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts" in plan

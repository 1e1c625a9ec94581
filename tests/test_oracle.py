"""Every registered query against its SQL, on the plain path and with small hot keys."""

import pytest
from oracle import connect, differences

import __spark_entry__ as contract
from rowkeeper import checks
from rowkeeper.sources import readers

SMALL = "/root/testdata/sf0.001"
USUAL = "/root/testdata/sf0.01"
ORDERED = [
    "retention_candidates", "size_buckets", "fixed_chunks", "run_changes", "circular_sum", "circular_sum_back",
    "systematic_sample", "multi_key_sort", "custom_order", "numeric_text_sort", "id_list", "join_names",
    "route_average", "sortedness_check", "nearest_each_side", "concordance_counts", "job_outcome", "oncall_notice",
    "interval_overlap", "history_join", "semi_join", "anti_join", "incremental_append", "integrity_collect",
    "backup_archive", "rule_or_default", "delete_candidates", "circular_sum_around", "circular_sum_around_back", "kth_row_far",
    "collect_archive", "collect_integrity", "integrity_messages",
]
WITHOUT_SQL = set()


@pytest.fixture(scope="session")
def connections():
    return {folder: connect(folder) for folder in (SMALL, USUAL)}


def test_every_query_has_sql():
    assert set(checks.QUERIES) - set(checks.ORACLE) == WITHOUT_SQL
    assert set(checks.QUERIES) <= set(contract.queries()) and set(checks.ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(checks.ORACLE))
def test_query_agrees_with_sql(spark, connections, name):
    df = contract.queries()[name](spark, USUAL)
    assert differences(df, connections[USUAL], contract.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ORDERED)
def test_hot_keys_agree_with_sql(spark, connections, few_hot_rows, name):
    df = contract.queries()[name](spark, USUAL)
    assert differences(df, connections[USUAL], contract.oracle_sql()[name]) is None


def test_inventory_lists_every_file(spark):
    import os

    rows = readers.file_inventory(spark, SMALL).collect()
    assert sorted(os.path.basename(r.full_name) for r in rows) == sorted(os.listdir(SMALL))


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "delay" in df.columns

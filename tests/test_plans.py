"""Plans that must not grow with permutations or repeat the reading: no broadcast of dealt copies, one exchange of the input."""

import pytest

from seqloom import catalog

from .test_catalog import SF


def plan(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["formula_permutation", "ngram_entropy_permutation", "transition_perm_test", "transition_permutation", "transition_z"])
def test_dealt_copies_are_not_broadcast(spark, name):
    assert "BroadcastExchange" not in plan(spark, name)


def test_all_sizes_of_runs_read_the_events_once(spark):
    text = plan(spark, "ngram_entropy")
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


@pytest.mark.parametrize(
    "name,exchanges",
    [(x, 1) for x in ("boundary_metrics", "boundary_shift_null", "block_support", "eligible_shifts", "arrival_threshold2", "arrival_exclude_exact", "arrival_no_extended_left", "boundary_statistics", "edge_censor")]
    + [(x, 2) for x in ("run_end_records", "direction_audit", "arrival_histogram", "arrival_pair_audit", "segment_inventory", "lexical_decomposition_t2", "hierarchy_validation")]
    + [("relation_summary", 3)],
)
def test_words_are_not_shuffled_nor_read_twice(spark, name, exchanges):
    text = plan(spark, name)
    assert text.count("FileScan") == 1 and text.count("Exchange") == exchanges and "BroadcastHashJoin" not in text


def test_tasks_grow_with_the_input(spark, monkeypatch):
    from seqloom.sources import tables

    parts = lambda: tables.document_texts(spark, SF).rdd.getNumPartitions()
    assert parts() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(tables, "TASK_BYTES", 10_000)
    assert parts() > 10


@pytest.mark.parametrize("name", ["interval_ngrams_2", "interval_ngrams_3", "interval_null_shuffle", "interval_null_cyclic", "interval_contrast_null"])
def test_intervals_are_not_shuffled(spark, name):
    text = plan(spark, name)
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1

"""Hand-worked cases of turned books, dense blocks, exports and audits, and two queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from seqloom import catalog
from seqloom.operators import arrivals, robustness

from .test_catalog import SF, shown


def book(spark, values, ends=(), name=1):
    """A book of one value per position; ``ends`` are the positions that close a segment of every level."""
    ids = [sum(e < p for e in ends) for p in range(len(values) + 1)]
    rows = [(name, p, v, *[ids[p]] * 3, *[ids[p + 1] if p + 1 < len(values) else None] * 3) for p, v in enumerate(values)]
    return spark.createDataFrame(rows, "book long, i long, value long, verse_id long, major_id long, minor_id long, verse_after long, major_after long, minor_after long")


def test_edge_runs(spark):
    censored = lambda values: [r["value"] for r in arrivals.edge_censored(book(spark, values)).orderBy("i").collect()]
    assert censored([2, 1, 0, 3, 0, 1]) == [0, 0, 0, 3, 0, 0]
    assert censored([0, 1, 0]) == [0, 1, 0] and censored([1, 1]) == [0, 0] and censored([0, 0]) == [0, 0]


def test_turns(spark):
    # one run at 1 and 2 whose end closes a segment; cuts that part no run: before 1, 3, 4 (not 2)
    got = robustness.alignment_records(book(spark, [0, 1, 1, 0, 0], ends=(2,)), 2, 10)
    rows = {(r["perm_id"] > 0, r["block"], r["verse"]) for r in got.collect()}
    # turned by 4, 2 and 1 places the end at 2 comes to 1, 4 and 3
    assert rows == {(False, 2, True), (True, 1, False), (True, 3, False), (True, 2, False)} and got.count() == 4
    alignment = robustness.book_alignment(got)
    assert {(r["level"], r["observed"], r["null_mean"], r["permutations"]) for r in alignment.collect()} == {(x, 1.0, 0.0, 3) for x in ("verse", "major", "minor")}
    assert {tuple(r) for r in robustness.direction_audit(alignment).select("books", "books_positive", "median_difference", "positive_share").collect()} == {(1, 1, 1.0, 1.0)}
    # runs at both ends of the book: no turn leaves them whole
    assert {r["perm_id"] for r in robustness.alignment_records(book(spark, [1, 0, 1]), 2, 10).collect()} == {0}


def test_dense_blocks(spark):
    rows = book(spark, [0, 1, 5, 0, 1, 0, 5, 0]).union(book(spark, [0, 5, 0, 0], name=2))
    gone = robustness.densest(rows, 2, (0.2, 0.5)).collect()
    assert sorted((r["fraction"], r["book"], r["block"]) for r in gone) == [(0.2, 1, 2), (0.2, 1, 4), (0.5, 1, 2), (0.5, 1, 4), (0.5, 2, 1)]


def test_roles(spark):
    rows = spark.createDataFrame([("run_ends_verse",), ("mean_arrivals",), ("fano_w10",), ("max_run_length",)], "metric string")
    role = lambda family: [r[0] for r in rows.select(robustness.metric_role(family, F.col("metric"))).collect()]
    assert role("boundary_alignment") == ["primary", "secondary", "secondary", "secondary"]
    assert role("local_rhyme_enrichment") == ["secondary", "primary", "secondary", "secondary"]
    assert role("burst_clustering") == ["secondary", "secondary", "primary", "descriptive"]
    with pytest.raises(ValueError):
        robustness.metric_role("other", F.col("metric"))


def test_display(spark):
    rows = spark.createDataFrame([("k", "b", 2), ("k", "a", 2), ("k", "c", 1), ("l", "z", 1)], "key string, word string, n long")
    assert {tuple(r) for r in robustness.group_display(rows).collect()} == {("k", "a", "a ×2, b ×2, c"), ("l", "z", "z")}


def test_quantiles(spark):
    null = spark.createDataFrame([("a", float(v)) for v in range(41)], "k string, value double")
    seen = spark.createDataFrame([("a", 30.0)], "k string, observed double")
    got = robustness.quantiles(null, seen, ["k"]).collect()[0].asDict()
    assert got == {"k": "a", "permutations": 41, "observed": 30.0, "null_mean": 20.0, "difference": 10.0, "null_q025": 1.0, "null_q975": 39.0, "null_sd": 11.979149}


@pytest.mark.parametrize("name", ["boundary_shift_null", "dense_block_trim", "parse_audit", "rhyme_group_locations"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert shown(catalog.queries()[name](spark, SF).toPandas()) == shown(con.execute(catalog.oracle_sql()[name]).df())

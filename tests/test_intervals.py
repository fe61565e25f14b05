"""Array draws against the draws of Spark, and how many the interval nulls take."""

import hashlib

import numpy as np
import pytest

from seqloom.catalog_words import INTERVAL_PERMS
from seqloom.functions import stats
from seqloom.operators import intervals
from seqloom.plans import draws, nulls


@pytest.mark.parametrize("group", ["7|verse", "a book with a name of more than fifty-five bytes|major"])
def test_order_is_that_of_the_digests(group):
    perms, items = np.array([0, 9, 10, 499]), np.array([1, 2, 9, 10, 99, 100, 12345])
    for p, got in zip(perms, draws.order(1, perms, group, items)):
        digest = lambda k: hashlib.md5(f"1|{p}|{group}|{items[k]}".encode()).hexdigest()  # noqa: E731, B023
        assert list(got) == sorted(range(len(items)), key=digest)


@pytest.mark.parametrize("kind", ["shuffle", "cyclic"])
def test_nulls_are_those_of_dealt_rows(spark, kind):
    rows = [(b, "verse", i, 1 + (i * i + b) % 5, "within" if i % 3 else "cross_reset") for b in range(3) for i in range(1, 14) if i != 6] + [(9, "verse", 4, 2, "within")]
    rows = spark.createDataFrame(rows, "book long, model string, i long, interval long, relation string")
    keys = ["book", "model", "relation"]
    dealt = (nulls.shuffled if kind == "shuffle" else nulls.cyclic)(rows, "interval", 12, 1, ("book", "model"), "i").join(rows.drop("interval"), ["book", "model", "i"])
    value = lambda df, by: intervals.top3(df, by)
    wanted = stats.null_summary(value(dealt, ["perm_id", *keys]), value(rows, keys).withColumnRenamed("value", "observed"), keys)
    got = intervals.interval_null(rows, 12, kind=kind).where("metric = 'top3_share'").select(wanted.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
    assert {r["book"] for r in intervals.contrast_null(rows, 3, kind=kind).collect()} == {0, 1, 2}


def test_as_many_draws_as_the_reference():
    assert INTERVAL_PERMS == 500

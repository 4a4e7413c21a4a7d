"""Refreshes against full rebuilds: changed, new, emptied and untouched days; a repeated and a failed run; roots after edits."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from siftwork.operators import catalog, refresh, stories

SCHEMA = "dim string, key string, n long, n_flagged long, day date"


def cube(rows):
    return lambda days: catalog.daily_cube(rows.join(days, "day", "left_semi"), "day", ["kind"], "doc", F.col("size") > 5)


def as_set(df):
    return sorted(tuple(r) for r in df.select("day", "dim", "key", "n", "n_flagged").collect())


def test_days_are_refreshed_alone(spark, tmp_path):
    rng = random.Random(3)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    rows = [(day(rng.randrange(9)), i, rng.choice("abc"), rng.randrange(10)) for i in range(200)]
    frame = lambda x: spark.createDataFrame(x, "day date, doc long, kind string, size int")
    folder = f"file://{tmp_path}/cube"
    assert refresh.current(spark, folder, SCHEMA).count() == 0
    first = frame(rows)
    whole = catalog.daily_cube(first, "day", ["kind"], "doc", F.col("size") > 5)
    assert refresh.refresh_days(folder, first.select("day"), cube(first)) == 1
    assert as_set(refresh.current(spark, folder, SCHEMA)) == as_set(whole)
    # Day 2 is emptied, day 4 changes, day 30 is new.
    later = frame([r for r in rows if r[0] != day(2) and not (r[0] == day(4) and r[1] % 2)] + [(day(4), 900, "z", 9), (day(30), 901, "a", 1)])
    changed = spark.createDataFrame([(day(2),), (day(4),), (day(30),), (day(30),), (None,)], "day date")
    old = refresh.current(spark, folder, SCHEMA)
    for version in (2, 3):  # run again: the same
        assert refresh.refresh_days(folder, changed, cube(later)) == version
        assert as_set(refresh.current(spark, folder, SCHEMA)) == as_set(catalog.daily_cube(later, "day", ["kind"], "doc", F.col("size") > 5))
    assert as_set(old) == as_set(whole) == as_set(refresh.current(spark, folder, SCHEMA, 1))  # who began before goes on with that
    broken = lambda days: cube(first)(days).withColumn("n", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        refresh.refresh_days(folder, changed, broken)
    assert as_set(refresh.current(spark, folder, SCHEMA)) == as_set(catalog.daily_cube(later, "day", ["kind"], "doc", F.col("size") > 5))
    assert {r.run for r in refresh.pointers(spark, folder, 3).where("day <> '2024-01-03' AND day <> '2024-01-05' AND day <> '2024-01-31'").collect()} == {r.run for r in refresh.pointers(spark, folder, 1).collect()}


def test_roots_after_edits_are_those_of_a_full_run(spark):
    rng = random.Random(5)
    heads = ["A long headline about chips and memory prices", "Another long headline about robots and their makers", "short", ""]
    bodies = ["body one says much about the prices of memory chips in May", "body two tells of something else altogether, at some length", "A long headline about chips and memory prices and what follows", ""]
    posts = {i: (rng.choice(heads), rng.choice(bodies) + rng.choice(["", "", f" no {i}"])) for i in range(120)}
    frame = lambda x: stories.dedup_keys(spark.createDataFrame([(i, *v) for i, v in x.items()], "item_id long, title string, text string"))
    as_rows = lambda df: sorted(tuple(r) for r in df.collect())
    old = frame(posts)
    before = stories.duplicate_roots(old)
    after = {i: v for i, v in posts.items() if i % 17 != 3}  # some go
    after |= {i: (rng.choice(heads), rng.choice(bodies)) for i in (1, 5, 44, 90)} | {500: posts[7], -2: posts[7], 501: ("nothing of the kind", "alone")}
    new = frame(after)
    found = refresh.refreshed_roots(before, old, new)
    assert as_rows(found) == as_rows(stories.duplicate_roots(new))
    assert as_rows(refresh.refreshed_roots(before, old, old)) == as_rows(before) and refresh.touched(old, old).count() == 0
    one = frame({**posts, 700: ("nothing of the kind", "alone")})
    assert {r.item_id for r in refresh.touched(old, one).collect()} == {700}
    roots = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (6, 5), (7, 4)], "item_id long, root long")
    assert {r.item_id for r in refresh.dependents(roots, spark.createDataFrame([(3,)], "item_id long")).collect()} == {3, 4, 7}


def test_keys_are_made_once_and_only_of_edited_posts(spark):
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    counted = F.udf(count, "string").asNondeterministic()
    posts = spark.createDataFrame([(i, "A long headline about chips and memory prices", f"body of {i % 7} that says much about them") for i in range(40)], "item_id long, title string, text string")
    old = stories.dedup_keys(posts).localCheckpoint()
    after = posts.withColumn("text", F.when(F.col("item_id") % 10 == 0, F.substring("text", 1, 9)).otherwise(F.col("text")))
    whole = stories.dedup_keys(after).withColumn("text_key", counted("text_key"))
    found = refresh.refreshed_roots(stories.duplicate_roots(old), old, whole)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, stories.duplicate_roots(stories.dedup_keys(after)).collect())) and made.value == 40
    part = refresh.refreshed_keys(old, after, after.select("item_id").where("item_id % 10 = 0"))
    assert sorted(map(tuple, part.collect()), key=str) == sorted(map(tuple, stories.dedup_keys(after).collect()), key=str)

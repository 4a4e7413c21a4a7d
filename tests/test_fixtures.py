"""The survey's reference cases: readings, URLs, texts, identifiers, likeness of titles, sweeps."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from siftwork.functions import refs, text
from siftwork.operators import archive, catalog, radar, stories

NOW = dt.datetime(2026, 10, 4, 3)
hours = lambda n: NOW + dt.timedelta(hours=n)


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_readings_are_throttled(spark):
    rows = [("early", NOW, 10), ("early", hours(0.5), 12), ("change", NOW, 10), ("change", hours(2), 12), ("same", NOW, 10), ("same", hours(2), 10)]
    kept = archive.throttled(spark.createDataFrame(rows, "key string, at timestamp_ntz, value int"), "key", "at", "value", 3600).collect()
    assert sorted((r.key, r.value) for r in kept) == [("change", 10), ("change", 12), ("early", 10), ("same", 10)]


def test_movers_of_a_day(spark):
    day = lambda n: NOW + dt.timedelta(days=n)
    rows = [(1, "fast", day(-2), 100.0), (2, "fast", day(-1) - dt.timedelta(hours=1), 150.0), (3, "fast", NOW, 400.0), (4, "slow", day(-2), 100.0), (5, "slow", day(-1) - dt.timedelta(hours=1), 110.0), (6, "slow", NOW, 120.0), (7, "single", NOW, 9.0)]
    found = radar.movers(spark.createDataFrame(rows, "item_id long, source string, occurred_at timestamp_ntz, value double"), str(day(-1)), 5).collect()
    assert [(r.source, r.baseline, r.latest, r.delta) for r in found] == [("fast", 150.0, 400.0, 250.0), ("slow", 110.0, 120.0, 10.0)]


@pytest.mark.parametrize(
    ("rule", "given", "want"),
    [
        (text.canonical_url, "HTTPS://Example.COM:443/news/a/?utm_source=x&b=2&fbclid=z&a=1#comments", "https://example.com/news/a?a=1&b=2"),
        (text.canonical_url, "https://example.com", "https://example.com/"),
        (text.canonical_url, "https://example.com:8443/x", "https://example.com:8443/x"),
        (text.plain_text, "<p>Hello&nbsp;<b>world</b></p><script>track()</script>", "Hello world"),
        (lambda x: text.truncated(x, 4), "abcdef", "abc…"),
        (lambda x: text.truncated(x, 4), "abc", "abc"),
        (text.normalized_url, "http://bbc.co.uk/news/articles/c5j9x9pr0240o/?at_campaign=rss&at_medium=RSS", "bbc.co.uk/news/articles/c5j9x9pr0240o"),
        (text.dedup_url, "https://m.example.com/news/123/amp", "https://example.com/news/123"),
        (text.dedup_url, "https://example.com/amp/news/123?outputType=amp&utm_source=x", "https://example.com/news/123"),
        (text.dedup_url, "https://www.example.com/news/123", "https://example.com/news/123"),
        (refs.references, "see cve-2026-12345", ["cve:CVE-2026-12345"]),
        (refs.references, "as TR22.837 says", ["3gpp:TR 22.837"]),
        (refs.references, "US 11,234,567 B2", ["patent:US11234567"]),
        (refs.references, "at huggingface.co/Qwen/Qwen3-8B.", ["hf:qwen/qwen3-8b"]),
        (refs.references, "doi.org/10.48550/arXiv.2608.00001", ["arxiv:2608.00001"]),
        (refs.references, "github.com/orgs/x and huggingface.co/datasets/x/y", []),
    ],
)
def test_cases(spark, rule, given, want):
    assert one(spark, rule, given) == want


def test_a_short_title_alone_stands_for_nothing(spark):
    row = stories.dedup_keys(spark.createDataFrame([(1, "Home", "")], "item_id long, title string, text string")).first()
    assert row.text_key is None and row.title_key is None


def test_likeness_of_titles(spark):
    titles = ["Apple unveils iPhone 18 Pro with a new camera system", "Apple unveils iPhone 18 Pro with new camera system", "Quantum computing market outlook", "반도체 수출 사상 최대, 메모리 가격 상승 영향", "반도체 수출 사상 최대…메모리 가격 상승 영향", "", "é"]
    df = spark.createDataFrame(list(enumerate(titles)), "i int, t string")
    rows = df.select("i", refs.minhash(refs.char_shingles(F.col("t"))).alias("s"))
    held = rows.select("i", "s", refs.bands(F.col("s")).alias("b"))
    both = held.alias("x").join(held.alias("y"), F.col("x.i") <= F.col("y.i")).select("x.i", F.col("y.i").alias("j"), refs.agreement(F.col("x.s"), F.col("y.s")).alias("a"), F.size(F.array_intersect("x.b", "y.b")).alias("n"))
    found = {(r.i, r.j): (r.a, r.n) for r in both.collect()}
    assert found[0, 0] == (1.0, 16) and found[0, 1][1] >= 1 and found[3, 4][0] > 0.6 and found[0, 2][0] < 0.2 and found[2, 3][0] < 0.2 and found[5, 5] == (0.0, 0) and found[6, 6] == (1.0, 16)


def test_shingles_take_time_in_proportion(spark):
    long = "word " * 40_000
    assert one(spark, lambda x: F.size(refs.char_shingles(x)), long) == 4
    assert one(spark, lambda x: refs.char_shingles(x), "𝒳𝒴 b") == ["𝒳𝒴b"] and one(spark, lambda x: refs.char_shingles(x), None) == []


def test_threshold_sweep(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.3, 0), (0.28, 1)], "score double, label int")
    found = {r.cut: (r.precision, r.recall) for r in catalog.threshold_sweep(df, [0.25, 0.5]).collect()}
    assert found == {0.25: (0.75, 1.0), 0.5: (1.0, 0.6667)}

"""Titles of one work against the standard library's matcher on all pairs."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F
from siftwork.operators import matching

CASES = {
    ("Attention Is All You Need", "attention is all you need."): True, ("BERT: Pre-training of Deep Bidirectional Transformers", "BERT"): True, ("Ｆｕｌｌ ｗｉｄｔｈ", "full width"): True, ("Scaling laws for language models", "Scaling law for language model"): True,
    ("A survey of graph networks", "Quantum error correction"): False, ("", "x"): False, (None, "x"): False, ("!!!", "!!!"): False, ("메모리 반도체 가격 전망", "메모리 반도체 가격 전망 보고서"): True,
}


def test_cases(spark):
    df = spark.createDataFrame([(i, a, b, "x") for i, (a, b) in enumerate(CASES)], "i int, left string, right string, ratio_ string")
    pairs = matching.keyed(matching.keyed(df, "left", "a"), "right", "b")
    assert {r.i for r in matching.matched(pairs).collect()} == {i for i, same in enumerate(CASES.values()) if same}
    assert matching.matched(pairs.where("false")).count() == 0


def test_ratios_are_those_of_the_matcher(spark):
    rng = random.Random(1)
    words = "chip memory panel robot agent model price output report market".split()
    titles = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, a string")
    pairs = df.join(df.select(F.col("i").alias("j"), F.col("a").alias("b")), F.col("i") < F.col("j"))
    found = {(r.i, r.j): r.ratio for r in matching.matched(pairs).collect()}
    want = {}
    for i, a in enumerate(titles):
        for j in range(i + 1, len(titles)):
            ratio = 1.0 if a in titles[j] or titles[j] in a else SequenceMatcher(None, a, titles[j]).ratio()
            if ratio >= 0.75:
                want[i, j] = ratio
    assert found == want and len(want) > 20

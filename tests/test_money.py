"""Rounds and sums by the reference cases of the survey."""

import pytest
from pyspark.sql import functions as F
from siftwork.functions import money

STAGES = [
    ("Series B", "시리즈 B"), ("시리즈B", "시리즈 B"), ("시리즈 B", "시리즈 B"), ("B라운드", "시리즈 B"), ("시리즈 C-2", "시리즈 C-2"), ("시리즈 A 브릿지", "시리즈 A 브릿지"), ("시리즈 F (IPO 전)", "시리즈 F"), ("Pre-A+", "프리 시리즈 A+"),
    ("시리즈 프리A", "프리 시리즈 A"), ("Seed", "시드"), ("Pre-seed", "프리시드"), ("Angel Round", "엔젤"), ("Strategic Investment", "전략적 투자"), ("업무협약(MOU)", "MOU"), ("MOU 체결", "MOU"),
    ("시리즈 B (추정, 기사에 명시된 라운드 없음)", None), ("미상", None), ("", None), (None, None), ("인재 인수(Acqui-hire)", "인재 인수(Acqui-hire)"), ("Series D round", "시리즈 D"), ("x" * 60, "x" * 40),
]
SUMS = [
    ("AWS가 아라곤 인프라에 337억 유로를 투자한다.", [(33.7e9, "EUR")]), ("지분을 약 3천억 원에 인수했다.", [(3e11, "KRW")]), ("인도에 약 20조 8천억 원을 투자한다.", [(2.08e13, "KRW")]),
    ("기업가치 75억 달러 기준 8억 7,000만 달러를 유치했다.", [(75e8, "USD"), (870e6, "USD")]), ("157.5억 달러 기업가치로", [(157.5e8, "USD")]), ("10조 원 이상의 증거금이 몰렸다. 2억 원은 남았다.", [(2e8, "KRW")]),
    ("raised $1.5 billion and €20 mn, worth 3 trillion", [(1.5e9, "USD"), (20e6, "EUR"), (3e12, None)]), ("5억 홍콩달러와 1백억 엔", [(5e8, "HKD"), (1e10, "JPY")]), ("no sum in 2024", []), (None, []),
]


def test_stages(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(STAGES)], "i int, raw string")
    found = {r.i: r.s for r in df.select("i", money.stage(F.col("raw")).alias("s")).collect()}
    assert [found[i] for i in range(len(STAGES))] == [want for _, want in STAGES]


def test_sums(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SUMS)], "i int, t string")
    found = {r.i: r.s for r in df.select("i", money.stated(F.col("t")).alias("s")).collect()}
    for i, (_, want) in enumerate(SUMS):
        assert [x.currency for x in found[i]] == [c for _, c in want] and [x.value for x in found[i]] == pytest.approx([v for v, _ in want])

"""The neighbour search against brute force, over more queries and vectors than a block holds."""

import numpy as np

from siftwork.operators import catalog
from siftwork.plans import registry

D = "/root/testdata/sf0.001"


def test_every_20th_row_is_asked(spark):
    rows = registry.queries()["nearest_vectors_every_20th"](spark, D).collect()
    asked = {r.vec_id for r in spark.read.parquet(f"{D}/embeddings.parquet").where("vec_id % 20 = 0").collect()}
    assert {r.query_id for r in rows} == asked and len(asked) > 20 and len(rows) == 5 * len(asked)


def test_blocks_give_what_brute_force_gives(spark, monkeypatch):
    monkeypatch.setattr(catalog, "BLOCK_VECTORS", 16)
    monkeypatch.setattr(catalog, "HELD_ROWS", 300)
    v = np.random.default_rng(5).integers(-3, 4, (150, 4)).astype(float)
    v[7] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = catalog.nearest(vectors, vectors.selectExpr("vec_id AS query_id", "embedding AS query"), 3).collect()
    want = set()
    for i, x in enumerate(v):
        near = sorted((-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 5), j) for j, y in enumerate(v) if j != i and x.any() and y.any())
        want |= {(i, j, place, -s) for place, (s, j) in enumerate(near[:3], 1)}
    assert {(r.query_id, r.vec_id, r.place, r.similarity) for r in out} == want

"""Clashing names, empty tables, nulls, ties, very long texts and repeated rows, for each operator and each stage of the pipeline."""

import itertools
import random
import re

import numpy as np
import pytest
from siftwork.llm import bpe, chosen_path, decontaminate, exact_dedup, pii, quality, site_tree, toxicity, url_filter, warc
from siftwork.llm.queries import tokenizer
from siftwork.llm.textvec import shingle_sets

D = "/root/testdata/sf0.01"
LONG = " ".join(f"word{i % 977}" for i in range(60_000)) + " " + "z" * 9000
ROWS = [(1, LONG, "a"), (1, LONG, "b"), (2, None, "c"), (None, LONG, "d"), (3, "", "e"), (4, "one two three", "f"), (4, "one two three", "f"), (5, "one  two three", "g")]
#: Names that the operators might use for themselves.
NAMES = ["__id", "listed_url", "__sha", "__n", "gone_id", "bad_id", "dropped_id", "own", "h", "key"]


@pytest.fixture(scope="module")
def docs(spark):
    extra = ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(i, t, *[x] * len(NAMES)) for i, t, x in ROWS], f"doc_id long, text string, {extra}")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("q", "three"), ("r", None), (None, "two three")], "item_id string, text string")


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.train(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet"))


OPERATORS = {
    "pii": lambda d, i, m: pii.find_personal_data(d),
    "classes": lambda d, i, m: chosen_path.similarity_classes(d),
    "bpe": lambda d, i, m: bpe.encode_documents(d, *tokenizer(), keep_ids=False),
    "contamination": lambda d, i, m: decontaminate.contamination(d, i),
    "quality": lambda d, i, m: quality.classify(d),
    "groups": lambda d, i, m: exact_dedup.exact_groups(d),
    "toxicity": lambda d, i, m: toxicity.score_documents(d, m),
}
STAGES = {
    "toxicity": lambda d, i, m: toxicity.clean_rows(d, m),
    "exact": lambda d, i, m: exact_dedup.kept_rows(d),
    "near": lambda d, i, m: chosen_path.first_of_each(d),
    "contaminated": lambda d, i, m: decontaminate.clean_rows(d, i),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_row(docs, empty, items, model, name):
    rows = OPERATORS[name](docs, items, model).collect()
    assert sorted(r.doc_id or 0 for r in rows) == sorted(i or 0 for i, _, _ in ROWS)
    by_id = {}
    for r in rows:  # repeated rows of the same text fare alike
        if r.doc_id == 1:
            by_id.setdefault(1, set()).add(str({k: v for k, v in r.asDict().items() if k not in ("kept", "ids")}))
    assert len(by_id[1]) == 1
    assert OPERATORS[name](empty, items, model).count() == 0


@pytest.mark.parametrize(("name", "left"), [("toxicity", None), ("exact", 3), ("near", 7), ("contaminated", 5)])
def test_stages_keep_columns_and_rows(docs, empty, items, model, name, left):
    """Long texts: one of three stays as exact copy; near copies drop only rows whose own id isn't the least of their class (5).

    The toxicity stage keeps what scores below 0.3, whatever the model says of such texts.
    """
    if left is None:
        left = toxicity.score_documents(docs, model).where("score < 0.3").count()
    out = STAGES[name](docs, items, model)
    assert out.columns == docs.columns and out.count() == left
    assert STAGES[name](empty, items, model).count() == 0


def test_training_on_odd_tables(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    for d in (docs, empty):
        scores = [r.score for r in toxicity.score_documents(docs, toxicity.train(d, labels)).collect()]
        assert all(0 <= s <= 1 for s in scores)


def test_odd_pages(spark):
    names = ", ".join(f"`{n}` string" for n in NAMES)
    rows = [(1, "http://Bad.net/a", "<p>" + "long text " * 30_000), (2, None, None), (3, "nohost", ""), (3, "nohost", ""), (4, "http://bad.net/a/?utm_x=1", "<p")]
    pages = spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in rows], f"page_id long, url string, html string, {names}")
    judged = url_filter.judge_urls(pages, pages.select("url").where("page_id = 1"))
    assert judged.columns == [*pages.columns, "host", "path", "rule", "verdict"] and sorted(r.page_id for r in judged.where("verdict = 'block'").collect()) == [1, 4]
    texts = {r.page_id: r.n_chars for r in site_tree.extract(pages).collect()}
    assert texts == {1: 30_000 * 10 - 1, 2: 0, 3: 0, 4: 0}
    assert len(warc.round_trip(pages).collect()) == 5
    for run in (site_tree.extract, warc.round_trip, lambda p: url_filter.judge_urls(p, p)):
        assert run(pages.where("false")).count() == 0


def test_archives_are_cut_and_read_in_many_tasks(spark):
    rows = [(i if i < 399 else 2**62, f"http://a/{i}", f"{i} " * 500) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    from siftwork.llm.shared import new_folder

    folder = new_folder(spark, "warc")
    manifest = warc.write_archive(pages, folder, 50_000)
    per_shard = [r.n for r in manifest.groupBy("shard").sum("records").withColumnRenamed("sum(records)", "n").collect()]
    assert len(per_shard) >= 10 and max(per_shard) <= 80  # an outlying id doesn't put all others in one shard
    back = warc.read_archive(manifest, folder)
    assert back.rdd.getNumPartitions() >= 10 and sorted(r.page_id for r in back.collect()) == sorted(r[0] for r in rows)


def test_unquoted_apostrophes_swallow_nothing():
    assert site_tree.main_text("<p data-x=it's>Some text</p><p title='a>b' id=\"c>d\">more</p>") == "Some text more"


def test_filter_passes_all_listed_and_few_others(spark):
    listed = spark.range(2000).selectExpr("concat('host', id, '.net/a') AS listed_url")
    others = spark.range(20_000).selectExpr("concat('other', id, '.org/b') AS listed_url")
    blocks = 2000 * url_filter.BITS_EACH // (64 * url_filter.WORDS)
    bloom = url_filter.bloom_blocks(listed, blocks)
    assert url_filter.possible(listed, bloom, blocks).count() == 2000
    passed = url_filter.possible(others, bloom, blocks).count()
    assert 0 < passed < 1000  # false positives occur, which the exact join removes
    urls = lambda df: df.selectExpr("concat('http://', listed_url) AS url")
    pages = urls(listed).union(urls(others)).selectExpr("monotonically_increasing_id() AS page_id", "url")
    blocked = url_filter.judge_urls(pages, urls(listed), rules=()) if url_filter.rule_of.__defaults__ is None else url_filter.judge_urls(pages, urls(listed))
    assert blocked.where("verdict = 'block'").count() == 2000


def test_links_of_all_documents_by_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    found = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.similarity_classes(docs).collect()}
    table = docs.select("doc_id", "text").toArrow()
    sets = list(shingle_sets(table.column(1)))
    ids = table.column(0).to_pylist()
    for k, own in enumerate(sets):
        shared = np.array([len(np.intersect1d(own, s, True)) for s in sets]) if len(own) else np.zeros(len(sets))
        size = np.array([len(s) for s in sets])
        linked = [j for j in np.flatnonzero((shared > 0) & (shared >= 0.8 * (len(own) + size - shared) - 1e-9)) if j != k]
        assert found[ids[k]][1] == len(linked)
        assert {found[ids[j]][0] for j in linked} <= {found[ids[k]][0]}


def test_rings_of_a_large_component_lose_no_link(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(700):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    found = {r.doc_id: r.n_links for r in chosen_path.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for _, t in rows]
    for k in range(0, 700, 20):
        assert found[k] == sum(1 for j, s in enumerate(sets) if j != k and len(s & sets[k]) >= 0.8 * len(s | sets[k]) - 1e-9)


def test_messages_give_the_odds_of_small_fields():
    """A chain without skip edges is a tree, on which message passing is exact: compare with all labellings."""
    rng = np.random.default_rng(3)
    field = pii.Field("", [])
    n = 4
    field.seen, field.shape = np.array([-1, 2, -1, -1]), np.arange(n)
    field.keys, field.near = [[], [], [], []], [0, 1, 2]
    tables = {"unary": np.log(rng.dirichlet(np.ones(5), pii.SHAPES)), "chain": rng.normal(0, 1, (5, 5)), "skip": np.zeros((5, 5))}
    exact = np.zeros((n, 5))
    for labels in itertools.product(range(5), repeat=n):
        if labels[1] == 2:
            weight = sum(tables["unary"][j, labels[j]] for j in (0, 2, 3)) + sum(tables["chain"][labels[j], labels[j + 1]] for j in range(n - 1))
            for j, own in enumerate(labels):
                exact[j, own] += np.exp(weight)
    exact /= exact.sum(1, keepdims=True)
    assert np.allclose(pii.infer(field, tables, 8), exact, atol=1e-6)


def test_estimation_finds_the_accuracies_of_labellers():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.6
    right = np.linspace(0.65, 0.95, len(quality.LABELLERS))
    seen = np.where(rng.random((20_000, len(right))) < right, good[:, None], ~good[:, None]).astype(int) * 2
    codes, counts = np.unique(seen @ 3 ** np.arange(len(right)), return_counts=True)
    posterior = quality.estimate(codes, counts.astype(float))
    for code in codes[::5]:  # Bayes' rule with the true accuracies
        votes = (code // 3 ** np.arange(len(right))) % 3 == 2
        odds = np.log(0.6 / 0.4) + np.where(votes, np.log(right / (1 - right)), np.log((1 - right) / right)).sum()
        assert abs(posterior[code] - 1 / (1 + np.exp(-odds))) < 0.08


def test_scores_of_texts_by_brute_force(model):
    """The worst run of three words, each the mean of its own bag's weights."""
    for text in ("one two three four", "worthless", "a bb ccc dddd eeeee worthless idiots"):
        words = re.findall("[a-z]+", text)
        means = []
        for w in words:
            _, hashes, owner, bucket = toxicity.featurised([w.encode()])
            assert len(hashes) == 1 and (owner == 0).all()
            means.append(model.weight[bucket].mean())
        runs = [np.mean(means[i : i + 3]) for i in range(max(1, len(means) - 2))]
        assert np.allclose(model.worst([text.encode()])[0], max(runs) + model.bias, atol=1e-4)


def test_the_pipeline_applies_its_stages_in_turn(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path)).cache()
        assert kept.columns == docs.columns, name
        assert kept.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        docs = kept
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] < seen[0]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(r.doc_id for r in docs.collect())

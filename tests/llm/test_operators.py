"""Operators against brute force, exact round trips and held-out figures, with nulls, empty texts, ties and clashing names."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from siftwork.llm import bpe, chosen_path, decontaminate, exact_dedup, pii, quality, site_tree, toxicity, url_filter, warc
from siftwork.llm.oracles import ORACLES
from siftwork.llm.queries import QUERIES, tokenizer

D = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TRICKY = [(1, "one two three four five six seven"), (2, None), (3, ""), (4, " \n\t"), (5, "One two  three four five six seven"), (6, "x" * 5000), (6, "x" * 5000), (None, "one two"), (7, "é 日本 +1 (555) 123-4567 a.b@c.de 10.0.0.1")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "n", 3) for i, t in TRICKY], "doc_id long, text string, norm string, id int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute_links(rows, threshold=0.8):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for _, t in rows]
    return [sum(1 for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= threshold * len(a | b) - 1e-9) for i, a in enumerate(sets)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    df, twin = QUERIES[name](spark, D), con.sql(ORACLES[name])
    put = lambda rows, names: sorted(str([r[names.index(c)] for c in sorted(names)]) for r in rows)
    assert put([tuple(r) for r in df.collect()], df.columns) == put(twin.fetchall(), twin.columns)


def test_exact_dedup_of_tricky_rows(docs, empty):
    rows = exact_dedup.exact_groups(docs).collect()
    assert len(rows) == len(TRICKY) and sum(r.kept for r in rows) == 6
    assert {r.doc_id: r.keep_id for r in rows if r.doc_id in (1, 5)} == {1: 1, 5: 5}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows if r.doc_id in (2, 3, 4)} == {i: (4, 3) for i in (2, 3, 4)}
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == 6


def test_extendible_index_splits_overfull_buckets(spark):
    many = spark.range(3000).selectExpr("id AS doc_id", "cast(id % 1000 AS string) AS text")
    index = exact_dedup.build_index(many, capacity=50)
    assert index.select("bucket").distinct().count() >= 20 and index.count() == 1000


def test_jaccard_join_against_brute_force(spark, docs, empty):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn"]) for _ in range(60)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t.replace(t.split()[7], "new", 1)) for i, t in enumerate(base)] + [(200, base[0]), (201, base[0].upper())]
    found = {r.doc_id: r.n_links for r in chosen_path.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i] for i, _ in rows] == brute_links(rows)
    tricky = chosen_path.similarity_classes(docs).collect()
    assert sorted((r.doc_id or 0, r.n_links) for r in tricky) == sorted((i or 0, n) for (i, _), n in zip(TRICKY, brute_links(TRICKY), strict=True))
    assert chosen_path.similarity_classes(empty).count() == 0


def test_many_near_copies_keep_all_links(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(i, text + f" tail{i}") for i in range(400)]
    found = chosen_path.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in found} == {(0, 399)}


def test_contamination_against_brute_force(spark, docs, empty):
    items = spark.createDataFrame([(1, "three four five"), (2, None), (3, "x" * 5000), (4, "one"), (10, "five six")], "item_id long, text string")
    rows = {(r.doc_id, r.n_words): (r.n_hit, r.n_items) for r in decontaminate.contamination(docs, items).collect()}
    assert rows[1, 7] == (5, 3) and rows[2, 0] == (0, 0) and rows[6, 1] == (1, 1) and rows[None, 2] == (1, 1)
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_bpe_is_the_public_library_s(spark, docs):
    import tiktoken

    own = bpe.vocabulary(*tokenizer())
    theirs = tiktoken.Encoding("own", pat_str=tokenizer()[1], mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(2)
    texts = [t or "" for _, t in TRICKY] + ["a" * 3000, " " * 999 + "x"] + ["".join(chr(rng.choice([rng.randint(9, 126), rng.randint(160, 9000)])) for _ in range(400)) for _ in range(40)]
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
    for r in bpe.encode_documents(docs, *tokenizer()).collect():
        assert len(r.ids) == 4 * r.n_tokens
    back = bpe.decode_ids(bpe.encode_documents(docs, *tokenizer()), *tokenizer()).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t in TRICKY)


def test_personal_data_patterns_against_brute_force(docs):
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("a1@.+- ()0925é") for _ in range(rng.randint(1, 60)))
        brute = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        brute += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
        brute += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(n := re.sub("[^0-9]", "", m.group())) <= 19 and pii._luhn(n)]
        brute += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        assert pii.base_spans(text) == sorted(brute)
    rows = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert (rows[7].n_email, rows[7].n_ip, rows[7].n_phone, rows[2].spans) == (1, 1, 1, "")


def test_skip_edges_carry_a_label_to_a_variant(spark):
    text = "call +1 (555) 123-4567 today, " + "or maybe " * 20 + "just 555 123 4567 again; order 8812345 is another thing"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = pii.find_personal_data(rows).first().spans.split(",")
    at = text.index("555 123 4567")
    assert f"phone:{at}:{at + 12}" in spans and len(spans) == 2


def test_main_text_and_low_branches(spark):
    page = "<body><header>Top</header><div id=x><p>one<br>two <b>th</b>ree<p>four &amp; five</div><div class=comments>bad</div><script>'<p>'</script><footer>f"
    assert site_tree.main_text(page) == "one two three four & five"
    rows = [(i, "http://a.org/", f"<body><div class=q1>Same words here</div><div class=q2><p>Body {i}</p></div></body>") for i in range(8)] + [(9, None, None)]
    out = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: f"Body {i}" for i in range(8)} | {9: ""}


def extracted(spark, pages):
    rows = [(i, "http://a.org/", p) for i, p in enumerate(pages)]
    return [r.text for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_blocks_of_one_path_are_judged_one_by_one(spark):
    page = "<body><div class=content><p>By Staff<p>Body {0}<p><b>Only {0}</b></div><div>Home</div><div>Words {0}</div></body>"
    assert extracted(spark, [page.format(i) for i in range(8)]) == [f"Body {i} Only {i} Words {i}" for i in range(8)]


def test_names_and_forms_do_not_take_articles():
    text = site_tree.main_text
    for page in (
        "<main class='site-main has-sidebar'><p>own words</main>", "<div id='page' class='right-sidebar'><p>own words</div>", "<div class='long-form'>own words</div>",
        "<article class='post tag-search category-legal'>own words</article>", "<article class=legal>own words</article>", "<div class=sidebar><article>own words</article></div>",
        "<form><nav>menu</nav><p>own words<div class=ad>buy</div></form>", "<form><div>own</div><main>words</main></form>", "<article>own <div class=legal>words</div></article>",
        "<div class=ad>a much longer advert</div><article>own words</article>", "<article>own words<section class=comments><article class=comment>bad</article></section></article>", "<p data-role=ad>own words",
    ):
        assert text(f"<html><body class=search>{page}<footer>f</footer>") == "own words", page


def test_copies_of_a_page_are_no_proof(spark):
    page = "<body><div>Words {0}</div><!-- {1} --><p>More of {0}</p>"
    pages = [page.format(0, i) for i in range(9)] + [page.format(1, 9), page.format(0, 9).replace("Words", "Other")]
    assert extracted(spark, pages) == ["Words 0 More of 0"] * 9 + ["Words 1 More of 1", "Other 0 More of 0"]
    near = [f"<article><p>The longest text of all<p>A shorter text<p>{i}</article>" for i in range(8)]
    assert extracted(spark, near) == [f"The longest text of all A shorter text {i}" for i in range(8)]
    quoted = [f"<article><p>Text {i}{'<p>quoted' * (i % 5 < 2)}</article>" for i in range(200)]
    assert [t.split()[2:] for t in extracted(spark, quoted)] == [["quoted"] * (i % 5 < 2) for i in range(200)]


def test_notices_inside_articles_are_judged(spark):
    page = "<article><p>Some words {0}</p><div class=q7>Join <a>our list</a> and read on for more of this</div><p>End {0}</p></article>"
    assert extracted(spark, [page.format(i) for i in range(8)]) == [f"Some words {i} End {i}" for i in range(8)]


def test_warc_round_trip(spark):
    big = "<p>" + "y" * 200
    rows = [(5, "http://a/", big), (3, "http://b/", big), (3, "http://b/", big), (1, None, None), (2, "u\r\nx", "short"), (4, "v", "short"), (None, "w", "é")]
    back = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in back)
    assert kinds == [(0, "response", 0), (1, "response", 0), (2, "response", 0), (3, "response", 0), (3, "revisit", 3), (4, "response", 0), (5, "revisit", 3)]
    assert {r.payload_digest for r in back if r.page_id == 5} == {hashlib.sha256(big.encode()).hexdigest()}


def test_warc_files_are_the_same_each_time(spark, tmp_path):
    pages = spark.read.parquet(f"{D}/pages.parquet")
    for name, df in (("a", pages), ("b", pages.repartition(7))):
        warc.write_archive(df, f"file://{tmp_path}/{name}")
    files = lambda n: {p.name: p.read_bytes() for p in (tmp_path / n).glob("*.gz")}
    assert files("a") and files("a") == files("b")


def test_toxicity_held_out(spark, docs):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(d, labels)
    rows = [r for r in toxicity.score_documents(d, model).join(labels, "doc_id").collect() if r.held_out]
    yes, no = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([[a > b for b in no] for a in yes]) > 0.85
    assert {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}[2] == 0.0
    assert toxicity.clean_rows(docs, model).columns == docs.columns


def test_quality_against_labels(spark, docs, empty):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.classify(d).join(labels, "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.95
    assert quality.classify(docs).count() == len(TRICKY) and quality.classify(empty).count() == 0


def test_url_verdicts(spark):
    rows = [(1, "http://www.bad.net/a/?utm_source=x&b=1"), (2, "https://m.BAD.net/a?b=1#t"), (3, "http://x.example.org/es/1"), (4, None), (5, "nohost"), (6, "http://q.com/fr/"), (7, "http://ok.net/a?b=1")]
    listed = spark.createDataFrame([("http://bad.net/a?b=1",), ("http://bad.net/a?b=1",), (None,)], "url string")
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, listed).collect()}
    assert out == {1: (None, "block"), 2: (None, "block"), 3: ("example.org/es/", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: ("com/fr/", "allow"), 7: (None, "allow")}
    assert url_filter.judge_urls(pages, listed.limit(0)).where("verdict = 'block'").count() == 1

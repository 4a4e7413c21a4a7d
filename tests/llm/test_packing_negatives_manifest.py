"""Packing, hard negatives and the manifest against brute force: nulls, ties, repeated rows, empty tables, clashing names, very long texts."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from siftwork.llm import hard_negatives, merkle, packing
from siftwork.llm.queries import QUERIES

D = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(60_000)) + " " * 30_000 + "z" * 9000
ROWS = [(1, LONG, "a"), (1, LONG, "b"), (2, None, "c"), (None, "one two", "d"), (3, "", "e"), (4, "one two three", "f"), (4, "one two three", "f")]
#: Names that the operators use for themselves.
NAMES = ["row", "id", "n", "rest", "leaf", "tree", "idx", "part", "label_", "v", "size", "key"]


@pytest.fixture(scope="module")
def ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return lambda text: [*own.encode(text or "", add_special_tokens=False).ids, 1]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def check_packing(rows, pieces, ids, capacity=2048):
    """Each id in one piece, sequences without gaps, full or of different powers of two; digests of the very ids."""
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(ids(t))
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p.doc_id, p.doc_row].append(p)
        of_sequence[p.sequence_id].append((p.offset, p.length))
    left = {i: list(x) for i, x in texts.items()}
    for (i, _), own in of_doc.items():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [0, *itertools.accumulate(p.length for p in own)][:-1]
        whole = next(x for x in left[i] if len(x) == own[0].doc_tokens and all(p.ids_crc32 == crc(x[p.start : p.start + p.length]) for p in own))
        assert sum(p.length for p in own) == len(whole)
        left[i].remove(whole)
    assert not any(left.values())
    short = []
    for own in of_sequence.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1]
        if (total := sum(n for _, n in own)) != capacity:
            short.append(total)
    assert len(set(short)) == len(short) and all(x < capacity and x & (x - 1) == 0 for x in short)


def test_packing_of_the_documents(spark, ids):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    import public_tokenizers

    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True).collect()
    check_packing([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], out, ids)
    assert all(zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length for p in out)
    query = QUERIES["op11_packing"](spark, D)
    assert query.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert Counter(tuple(r) for r in query.collect()) == Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens, p.sequence_id, p.offset) for p in out)


def test_packing_of_odd_rows(spark, ids):
    import public_tokenizers

    tools = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.createDataFrame([(i, t, *[x] * len(NAMES)) for i, t, x in ROWS], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))
    check_packing([r[:2] for r in ROWS], packing.pack(docs, *tools, keep_ids=False).collect(), ids)
    check_packing([r[:2] for r in ROWS], packing.pack(docs, *tools, capacity=8, keep_ids=False).collect(), ids, 8)
    assert packing.pack(docs.where("false"), *tools).count() == 0


def brute_pattern(value, capacity):
    best = [0.0] * (capacity + 1)
    for room in range(1, capacity + 1):
        best[room] = max([best[room - 1], *(best[room - x] + v for x, v in enumerate(value) if 0 < x <= room and v > 0)])
    return best[capacity]


def test_patterns_and_their_rounding():
    rng = np.random.default_rng(1)
    for capacity in (7, 30, 64):
        counts = rng.integers(0, 40, capacity)
        counts[0] = 0
        value = np.append(0, rng.random(capacity - 1)) * (counts > 0)
        worth, pattern = packing.best_pattern(value, capacity)
        assert worth == pytest.approx(brute_pattern(value, capacity)) == pytest.approx(sum(value[x] * n for x, n in pattern.items()))
        solved = packing.relaxed(counts, capacity)
        assert np.allclose(sum(x * np.bincount([k for k, n in p.items() for _ in range(n)], minlength=capacity) for p, x in solved), counts)
        assert min(x for _, x in solved) > -1e-9 and all(sum(k * n for k, n in p.items()) <= capacity for p, _ in solved)
        used = Counter()
        for p, times in packing.rounded(counts, capacity):
            assert sum(k * n for k, n in p.items()) == capacity
            for k, n in p.items():
                used[k] += n * times
        assert all(used[k] <= counts[k] for k in used)
    # 3 + 3 + 4 and 5 + 5 fill ten; the greedy start alone puts 4 with 4.
    assert sum(x for _, x in packing.relaxed(np.bincount([3] * 8 + [4] * 4 + [5] * 4, minlength=10), 10)) == pytest.approx(6)
    assert packing.rounded(np.zeros(10, np.int64), 10) == []


def test_ends_of_the_stream():
    edges = np.array([16, 20, 21])
    assert packing._cuts(5, 16, edges, 8) == [(0, 3, 0, 5), (3, 8, 1, 0), (11, 4, 2, 0), (15, 1, 3, 0)]


def brute_negatives(rows):
    """rows of (id, label, v); anchors: ids that 50 divides."""
    out = []
    for i, label, v in rows:
        if i % 50:
            continue
        seen = sorted((-sum(map(int.__mul__, v, w)), j, m == label) for j, m, w in rows if j != i and len(w) == len(v))
        for s, j, _ in [x for x in seen if x[2]][:5]:
            fits = [(t, k) for t, k, same in seen if not same and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(fits[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 1024])
def test_hard_negatives(spark, monkeypatch, block):
    for name, size in (("BLOCK", block), ("CHUNK", block), ("ZONES", 5), ("GROUP", 2)):
        monkeypatch.setattr(hard_negatives, name, size)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), (rng.integers(-9, 10, 4) / 16).tolist()) for i in range(260)]
    rows += [(300 + i, 1, rows[50][2]) for i in range(20)] + [rows[7]] * 3 + [(400, 2, [0.5, 0.25]), (401, 2, [0.5, 0.5]), (402, 1, [0.5, 0.125])]
    bad = [(450, 1, []), (500, None, [0.1] * 4), (550, 1, None), (600, 1, [0.1, None, 0.2, 0.3]), (650, 1, [float("nan")] * 4), (None, 1, [0.1] * 4), (700, 1, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, label int, embedding array<double>, size string")
    held = hard_negatives.noisy_labels(hard_negatives.quantised(df))
    found = [tuple(r) for r in hard_negatives.mine(held, hard_negatives.F.col("vec_id") % 50 == 0).collect()]
    plain = {(i, (m + 1) % 10 if i % 7 == 0 else m, tuple(int(np.floor(256 * x)) for x in v)) for i, m, v in rows}
    assert sorted(found) == brute_negatives(sorted(plain)) and len(found) > 20
    assert hard_negatives.mine(held.where("false"), hard_negatives.F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold_and_large_scores_are_exact():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-300, 300, (20, 16)), rng.integers(-300, 300, (50, 16)) // 4 + 60
    least, most = hard_negatives.bounds(a, b.min(0)[None], b.max(0)[None])
    inner = hard_negatives.scores(a, b)
    assert (inner == a @ b.T).all() and (least[:, 0] <= inner.min(1)).all() and (most[:, 0] >= inner.max(1)).all()
    tight = hard_negatives.bounds(a, b[:1], b[:1])
    assert (np.abs(np.stack(tight)[:, :, 0] - inner[:, 0]) < 1).all()  # a block of one row has its own score as both bounds
    big = np.array([[2**62, -(2**62)], [2**40, 3]])
    assert hard_negatives.scores(big, big).tolist() == [[2**63 - 1, 2**63 - 1], [2**63 - 1, 2**63 - 1]]
    assert hard_negatives.scores(big[1:], np.array([[2**20, 7]])).tolist() == [[2**60 + 21]]


def test_places_on_the_curve():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    keys = hard_negatives.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_manifest(rows, arity):
    """rows of (doc_id, source, lang, n_chars, text) -> what manifest returns, as sorted tuples."""

    def leaf(r, text):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*r[:4], text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k : k + arity])) for k in range(0, len(out[-1]), arity)])
        return out

    def climb(tree, at, h):
        sides = []
        for nodes in tree[:-1]:
            lo = at // arity * arity
            left, right = nodes[lo:at], nodes[at + 1 : lo + arity]
            sides += left + right
            h, at = sha("".join([*left, h, *right])), at // arity
        return sides, h

    by = defaultdict(list)
    low = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        seen = "".join(low.get(c, c) for c in r[4]) if hit and r[4] is not None else r[4]
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, seen), r[0]))
    trees = {k: levels([x[2] for x in sorted(v)]) for k, v in by.items()}
    sources = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    top, out = levels([trees[k][-1][0] for k in sources]), []
    for k, v in by.items():
        for at, x in enumerate(sorted(v)):
            own, h = climb(trees[k], at, x[3])
            over, h = climb(top, sources.index(k), h)
            out.append((x[4], x[2], trees[k][-1][0], top[-1][0], sha("".join(own + over)), h, h == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_manifest(spark, arity):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", "é", "Z"]), "en", i % 7, f"Text {i} ÄB") for i in range(150)]
    rows += [(3, "hot", None, None, None), (3, "hot", None, None, None), (None, None, "de", 2, ""), (None, "hot", "de", 2, "Q"), (7, "alone", "x", 1, LONG), (9, "", "x", 1, "A")]
    df = spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))
    found = sorted((tuple(r) for r in merkle.manifest(df, arity).collect()), key=str)
    assert found == brute_manifest(rows, arity)
    assert {r[6] for r in found} == {True, False}
    assert merkle.manifest(df.where("false"), arity).count() == 0
    one = merkle.manifest(df.where("doc_id = 9 AND source = ''"), arity).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")

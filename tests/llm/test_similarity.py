"""The n-gram join and nearest neighbours against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from strataframe.llm import ann, jaccard


def brute(docs, width, percent):
    """Smallest reachable key of each row, and set sizes, by comparing all pairs of word tuples."""
    sets = []
    for _, t in docs:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in jaccard.BYTE_WORDS.pattern and __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)})
    group = list(range(len(docs)))
    for i, j in combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    out = []
    for i, (k, _) in enumerate(docs):
        keys = [docs[j][0] for j in range(len(docs)) if group[j] == group[i] and docs[j][0] is not None]
        out.append((k, len(sets[i]), min(keys) if keys else None))
    return sorted(out, key=repr)


def corpus(seed, n=60):
    """Copies, chains of near copies, shared passages and short texts."""
    rnd, docs = random.Random(seed), []
    word = lambda: "".join(rnd.choice("abcdeXYZ") for _ in range(rnd.randint(1, 5)))
    passage = " ".join(word() for _ in range(40))
    for _ in range(n // 6):
        text = [word() for _ in range(rnd.choice([2, 8, 30, 120]))]
        docs.append(" ".join(text))
        for _ in range(5):
            if rnd.random() < 0.7 and len(text) > 3:
                text[rnd.randrange(len(text))] = word()
            docs.append(" ".join(text) + (" " + passage if rnd.random() < 0.15 else ""))
    docs += [passage, passage.upper(), "", "one", "one", "ONE", "a b", None, None]
    keys = list(range(len(docs)))
    rnd.shuffle(keys)
    return list(zip(keys, docs))


@pytest.mark.parametrize("seed, width, percent, frequent", [(1, 3, 90, 8), (2, 5, 80, 2), (3, 2, 70, 2), (4, 3, 80, 3), (5, 2, 50, 2)])
def test_join(spark, seed, width, percent, frequent):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = jaccard.join(df, width=width, percent=percent, frequent=frequent).collect()
    assert sorted(((r.key, r.n, r.component_key) for r in got), key=repr) == brute(docs, width, percent)


def test_join_odd_rows(spark):
    rows = [(None, "same text here now", 1, "x"), (7, "same text here now", 2, "y"), (5, "same text here now", None, None), (5, "same text here now", 3, "z"), (None, None, 1, "n"), (9, "w " * 30000, 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, hi string")
    got = sorted(((r.key, r.n, r.component_key) for r in jaccard.join(df).collect()), key=repr)
    assert got == sorted([(None, 2, 5), (7, 2, 5), (5, 2, 5), (5, 2, 5), (None, 0, None), (9, 1, 9)], key=repr)
    left = jaccard.distinct(df, percent=90)
    assert left.columns == df.columns and sorted(((r.doc_id, r.text[:4] if r.text else None) for r in left.collect()), key=repr) == sorted([(5, "same"), (None, None), (9, "w w ")], key=repr)
    assert jaccard.join(df.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [50, 70, 80, 90, 95])
def test_linked_sets_share_a_signature(percent):
    """Pairs at and above the threshold, of all sizes, whatever tokens are frequent; and few signatures for long sets."""
    rng = np.random.default_rng(percent)
    for round_ in range(400):
        n = int(rng.choice([1, 2, 3, 5, 9, 10, 11, 20, 60, 127, 128, 129, 300, 2000]))
        share = rng.choice([0.0, 0.3, 0.9, 1.0])
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        lost = rng.choice(a, rng.integers(0, jaccard.missing(len(a), percent) + 1), replace=False)
        b = np.union1d(np.setdiff1d(a, lost), rng.integers(0, 1 << 63, int(rng.integers(0, 2 + jaccard.missing(len(a), percent)))).astype(np.uint64))
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * len(np.union1d(a, b)):
            continue
        known = np.union1d(a, b)
        kind = dict(zip(known.tolist(), rng.choice([0, 1, 2], len(known), p=[(1 - share) / 2, (1 - share) / 2, share]).tolist()))
        classes = lambda t: np.array([kind[x] for x in t.tolist()], np.int8)  # noqa: E731, B023
        small, large = sorted((a, b), key=len)
        (s, inside, _), (o, *_) = jaccard.signatures(small, classes, percent), jaccard.signatures(large, classes, percent)
        assert len(np.intersect1d(s[inside], o)), (len(a), len(b), both, share)
    for n in (1000, 10_000, 100_000):
        t = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        assert len(jaccard.signatures(t, lambda t: np.full(len(t), 2, np.int8), percent)[0]) <= 9 * (jaccard.missing(n, percent) + 1)


def test_bitmaps_are_bounded(spark, monkeypatch):
    docs = corpus(11, 90)
    all_ = jaccard.sets(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 3, 80)
    monkeypatch.setattr(jaccard, "PART", 1 << 9)
    one, two = jaccard.classify(all_, 2), jaccard.classify(all_, 2, most=1 << 9)
    assert 8 * len(two.shared) == 1 << 9 < 8 * len(one.shared)
    assert 0 < np.unpackbits(two.shared).sum() <= 1 << 6 < np.unpackbits(one.shared).sum()


def test_blocks_and_peeling_lose_nothing(spark):
    docs = corpus(9, 90)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    all_ = jaccard.sets(df, "doc_id", "text", 3, 90)
    nodes = all_.where("n > 0").groupBy("hi", "lo").agg(__import__("pyspark.sql.functions", fromlist=["min"]).min("row").alias("x"), __import__("pyspark.sql.functions", fromlist=["min"]).min("n").alias("n"))
    rows = jaccard.materialize(nodes.selectExpr("1L as sig", "x", "n", "true as small", "x as c"), "test")
    rest = jaccard.peeled(rows, all_, 3, 90)
    assert 0 < rest.count() < rows.count()
    pairs = {(r.a, r.b) for r in jaccard.between(rest.selectExpr("*", f"{rest.count()}L as size"), all_, 90, block=7).collect()}
    own = {r.row: jaccard.tokens(r.text) for r in all_.collect()}
    for a, b in combinations(sorted(r.x for r in nodes.collect()), 2):
        both = len(np.intersect1d(own[a], own[b]))
        if 100 * both >= 90 * (len(own[a]) + len(own[b]) - both):
            assert (a, b) in pairs


def test_one_template_with_own_words_each(spark, monkeypatch):
    """Many texts that share four fifths with all others and are linked with none: linear work, no pair is compared in full."""
    monkeypatch.setattr(jaccard, "BLOCK", 50)
    rnd = random.Random(3)
    template = [f"t{i}" for i in range(170)]
    docs = [(i, " ".join(template + [f"own{i}x{j}" for j in range(30)])) for i in range(400)] + [(1000 + i, " ".join(template + [f"own7x{j}" for j in range(29)] + [f"z{i}"])) for i in range(3)]
    rnd.shuffle(docs)
    got = {r.key: r.component_key for r in jaccard.join(spark.createDataFrame(docs, "doc_id long, text string"), width=1, percent=80, frequent=2).collect()}
    assert got == {i: (7 if i >= 1000 else i) for i, _ in docs}


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(40)] + [(500, k) for k in range(501, 560)]
    got = {r.x: r.c for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == {x: c for x, c in want.items() if x != c}


def exact(rows, k, every):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in fine:
        if i % every == 0:
            near = {(float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in fine if j != i and len(v) == len(q)}
            out[i] = sorted(near)[:k]
    return out


def test_neighbours_and_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = {}
    for r in ann.op3_nearest(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = exact(rows, 10, 100)
    hits = sum(len({v for _, _, v in got[q]} & {j for _, j in near}) for q, near in want.items())
    assert set(got) == set(want) and hits >= 0.95 * sum(map(len, want.values()))
    for near in got.values():
        assert [r for r, _, _ in sorted(near)] == list(range(1, len(near) + 1)) and [x[1:] for x in sorted(near)] == sorted(x[1:] for x in near)


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, []), (None, [1.0, 1.0]), (6, [2.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "vec_id long, embedding array<float>, rank int, score double")
    queries = df.selectExpr("vec_id as id", "embedding as v").where("id % 100 = 0").where(ann.valid(ann.F.col("v")))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.lookup(ann.index(df, 10), queries, 10).collect())
    assert got == [(0, 1, 7, 0.0), (0, 2, 100, 0.0), (0, 3, 6, 1.0), (100, 1, 0, 0.0), (100, 2, 7, 0.0), (100, 3, 6, 1.0)]
    none = df.limit(0)
    assert ann.lookup(ann.index(none, 10), none.selectExpr("vec_id as id", "embedding as v"), 10).count() == 0


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 600)] + [(i, rng.normal(size=3).tolist()) for i in range(600, 900)]
    df = spark.createDataFrame([(i, [float(np.float32(x)) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")
    queries = df.selectExpr("vec_id as id", "embedding as v").where("id % 100 = 0")
    got = {}
    for r in ann.lookup(ann.index(df, 5, shard_rows=64), queries, 5).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = exact([(r.vec_id, list(r.embedding)) for r in df.collect()], 5, 100)
    assert {q: [j for _, j in sorted(v)] for q, v in got.items() if q < 600} == {q: [j for _, j in v] for q, v in want.items() if q < 600}
    assert all(len(v) == 5 for v in got.values())


def test_large_shards_and_passes(spark, monkeypatch):
    """Cells and hops instead of all comparisons, and several blocks of queries, on vectors without clusters."""
    x = np.random.default_rng(6).normal(size=(6000, 24)).astype("f4")
    monkeypatch.setattr(ann, "EXACT", 1000)
    monkeypatch.setattr(ann, "AROUND", 1500)
    graph = ann.build(x)
    hits = 0
    for i, found in zip(range(0, 6000, 60), ann.search(x, *graph, x[::60], ann.BEAM)):
        hits += len({i, *np.argsort(((x - x[i]) ** 2).sum(axis=1))[:11]} & set(found[:11].tolist()))
    assert hits >= 0.95 * 11 * 100
    near = ann.near_cells(x, 64, 1500)
    assert (ann.refined(x, near) >= -1).all() and all(i not in row for i, row in enumerate(ann.refined(x, near)))
    monkeypatch.undo()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x[:3000].tolist())], "vec_id long, embedding array<float>")
    queries = df.selectExpr("vec_id as id", "embedding as v").where("id % 100 = 0")
    one = sorted(map(tuple, ann.lookup(ann.index(df, 10, shard_rows=1000), queries, 10).collect()))
    two = sorted(map(tuple, ann.lookup(ann.index(df.repartition(7), 10, shard_rows=1000), queries.repartition(3), 10, query_bytes=1000).collect()))
    assert one == two and len(one) == 300

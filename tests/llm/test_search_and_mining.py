"""Collocations, embedding near-duplicates and ranked search against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.llm import collocations, lexical, projection_forest, queries, tokens

SF = "/root/testdata/sf0.001"
PASSAGE = "the quick brown fox jumps over the lazy dog while seven grey wolves watch"
TEXTS = [
    (1, PASSAGE, "en"), (2, PASSAGE, "en"), (3, f"{PASSAGE.upper()}. {PASSAGE}", "en"), (4, None, "en"), (5, "", None), (6, " \t\n.,;", "fr"), (7, "one", None),
    (8, "é ß 中文 😀 naïve CAFÉİ " * 40, "fr"), (9, "word " * 3000, "en"), (10, "a b,c d.a b;c d\x0ba b\x0cc\td\ra\x01b " * 50, None), (11, "the the the the. the fox", "en"),
    (None, PASSAGE, "en"), (1, "quick brown 12 quick12 x-y_z", "und"), (12, "zebra " + "filler " * 50_000 + "zebra fox", "en"),
]
SCHEMA = "doc_id long, text string, lang string, n long, rank int, share int, size int, term string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 1, 1, 1, "x") for r in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def some_text(spark, n=120, seed=5):
    """Texts of few words, so that many phrases are frequent; a third of the rows is one text."""
    rng = np.random.default_rng(seed)
    names = [f"w{k}" for k in range(25)]
    made = [" ".join(rng.choice(names, p=np.array([1 / (k + 1) for k in range(25)]) / sum(1 / (k + 1) for k in range(25)), size=60)) + rng.choice([".", ",", "", "\n"]) for _ in range(n)]
    return [(k, made[0] if k % 3 == 0 else f"{a}. {b}", ["en", "de"][k % 2]) for k, (a, b) in enumerate(zip(made, made[1:], strict=False))]


# words


def test_words_of_a_column():
    import pyarrow as pa

    column = pa.array(["x", "A b", None, "", " ", "b.c\nA", "é b"]).slice(1)
    got = tokens.words(column, collocations.TABLE)
    said = [(int(d), got.dictionary[int(i)].as_py().decode(), bool(j)) for d, i, j in zip(got.doc, got.ids, got.joined, strict=True)]
    assert said == [(0, "a", True), (0, "b", False), (4, "b", False), (4, "c", False), (4, "a", False), (5, "é", True), (5, "b", False)]
    assert list(tokens.slices(pa.array(["aaa", "bb", None, "c" * 9, ""]), 5)) == [(0, 3), (3, 4), (4, 5)]
    assert len(tokens.words(pa.array([], pa.string()), collocations.TABLE).ids) == 0


# 11


def brute_collocations(rows, support, first):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 5):
                f[lang or "und"].update(tuple(w[k : k + m]) for k in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= support}
        over = defaultdict(int)
        for p, a in cand.items():
            for m in range(2, len(p)):
                for k in range(len(p) - m + 1):
                    over[p[k : k + m]] = max(over[p[k : k + m]], a)
        best = []
        for p, a in cand.items():
            if 100 * over[p] >= 80 * a:
                continue
            s, _, l, r = min(((2_000_000 * a) // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            best.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:first])]
    return sorted(out)


@pytest.mark.parametrize(("support", "first", "bits"), [(30, 2000, 25), (2, 2000, 25), (2, 5, 8), (3, 7, 6)])
def test_collocations(spark, docs, support, first, bits):
    rows = TEXTS + some_text(spark)
    df = docs.unionByName(spark.createDataFrame([(*r, 1, 1, 1, 1, "x") for r in some_text(spark)], SCHEMA))
    got = collocations.collocations(df, support, first, bits)
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, support, first)
    assert [f"{n}:{t}" for n, t in got.dtypes] == ["lang:string", "rank:bigint", "phrase:string", "a:bigint", "l:bigint", "r:bigint", "n:bigint", "score:bigint"]


def test_collocations_of_nothing(empty):
    assert collocations.collocations(empty).collect() == []


def test_counts_beyond_64_bits(spark):
    a = 9_000_000_000_000_000
    rows = [("en", 1, "x", a + 5), ("en", 1, "y", a + 1), ("en", 1, "z", a), ("en", 2, "x y", a), ("en", 2, "y z", a - 1), ("en", 3, "x y z", a - 3)]
    phrases = spark.createDataFrame(rows, "lang string, size int, phrase string, f long")
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in collocations.scored(phrases).collect()}
    cut = lambda a, l, r: (a, l, r, 2_000_000 * a // (l + r))
    assert got == {"x y": cut(a, a + 5, a + 1), "y z": cut(a - 1, a + 1, a), "x y z": cut(a - 3, a + 5, a - 1)}
    assert {r.phrase for r in collocations.standing(phrases).collect()} == {"x y z"}


def test_top_order_sums_are_those_of_each_order(spark):
    rows = some_text(spark, 60)
    df = spark.createDataFrame([(*r, 1, 1, 1, 1, "x") for r in rows], SCHEMA)
    windows, _ = collocations.longest_windows(df, 1, 20)
    got = {(r.lang, r.phrase): r.f for r in collocations.frequent(windows, 1).collect()}
    want = Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,\n]", text):
            w = piece.split()
            want.update((lang, " ".join(w[k : k + m])) for m in range(1, 5) for k in range(len(w) - m + 1))
    assert got == dict(want)


# 12


def brute_links(rows, least=0.93):
    good = [k for k, (_, v, label) in enumerate(rows) if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for a in good:
        for b in good:
            (_, x, p), (_, y, q) = rows[a], rows[b]
            if a < b and p == q and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                    links[a].add(b)
                    links[b].add(a)
    return links


def brute_near(rows):
    links, out, seen = brute_links(rows), [], {}
    for k in range(len(rows)):
        if k not in seen:
            part, todo = set(), [k]
            while todo:
                x = todo.pop()
                if x not in part:
                    part.add(x)
                    todo += links[x]
            ids = [rows[x][0] for x in part if rows[x][0] is not None]
            seen.update(dict.fromkeys(part, min(ids) if ids else None))
        out.append((rows[k][0], len(links[k]), seen[k], rows[k][0] is not None and rows[k][0] == seen[k]))
    return sorted(out, key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, node int, n int, leaf int").repartition(3)


def near_rows(n, seed=3, width=8, labels=2, jitter=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 6), width))
    made = centres[rng.integers(len(centres), size=n)] + rng.normal(size=(n, width)) * jitter * rng.random((n, 1))
    return [(k, [float(np.float32(x)) for x in v], int(rng.integers(labels))) for k, v in enumerate(made)]


def test_near_vectors_and_odd_ones(spark):
    same = [0.5, -0.25, 1.0, 0.0]
    odd = [
        (1, same, 1), (2, same, 1), (2, same, 1), (3, [2 * x for x in same], 1), (4, same, 2), (5, same, None), (6, None, 1), (7, [], 1), (8, [0.0] * 4, 1), (9, [math.nan, 1.0, 1.0, 1.0], 1),
        (10, [math.inf, 0.0, 0.0, 0.0], 1), (11, [None, 1.0, 1.0, 1.0], 1), (None, same, 1), (None, [0.0, 0.0, 0.0, 1.0], 1), (12, [1e-38, 0.0, 0.0, 0.0], 3), (13, [3e38, 0.0, 0.0, -0.0], 3), (14, [0.5, -0.25, 1.0], 1), (15, [-0.0, 1.0, 0.0, 0.0], 4), (16, [0.0, 1.0, -0.0, 0.0], 4),
    ]
    got = sorted(map(tuple, projection_forest.near_duplicates(vectors(spark, odd)).collect()), key=str)
    links = brute_near([r for r in odd if r[0] not in (12, 13)])
    assert [r for r in got if r[0] not in (12, 13)] == links
    assert [r for r in got if r[0] in (12, 13)] == [(12, 1, 12, True), (13, 1, 12, False)]
    assert projection_forest.near_duplicates(vectors(spark, odd).limit(0)).collect() == []


@pytest.mark.parametrize(("leaf", "n"), [(1024, 300), (64, 600)])
def test_near_vectors_against_brute_force(spark, leaf, n):
    rows = near_rows(n, labels=1 if leaf < n else 2)
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(n // 3)]  # a quarter of the rows are copies
    got = sorted(map(tuple, projection_forest.near_duplicates(vectors(spark, rows), leaf=leaf).collect()), key=str)
    want = brute_near(rows)
    if leaf > n:
        assert got == want
    found, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and found >= 0.9 * all_links


def test_a_dense_ball_is_compared_whole(spark):
    """No direction divides it: its leaf becomes a grid of cells, each pair counts once, and none is lost."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    rows = [(k, [float(x) for x in np.float32(centre + rng.normal(size=16) * 1e-3)], 1) for k in range(150)]
    got = sorted(map(tuple, projection_forest.near_duplicates(vectors(spark, rows), trees=3, leaf=20).collect()))
    assert got == [(k, 149, 0, k == 0) for k in range(150)]


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float), r.label) for r in table.collect()]
    want = 0
    for label in {r[2] for r in rows}:
        v = np.stack([r[1] for r in rows if r[2] == label])
        v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        want += int((v @ v.T >= 0.93).sum()) - len(v)
    got = projection_forest.near_duplicates(table, leaf=64).agg(F.sum("n_links")).first()[0]
    assert 0.9 * want <= got <= want


# 13


def brute_ranked(docs, items, first=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)) if t is not None else []
    bags = [(i, Counter(of(t))) for i, t, *_ in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(Counter)
    for i, t in set(items):
        if i is not None:
            asked[i].update(of(t))
    out = []
    for item, q in asked.items():
        scores = []
        for i, b in bags:
            m = 100 - 75 + (75 * sum(b.values()) * n_docs) // max(1, n_terms)
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t, c in q.items() if b[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:first])]
    return sorted(out, key=str)


def items_of(spark, items):
    return spark.createDataFrame([(*r, 1, 1.0) for r in items], "item_id long, text string, rank int, score double")


ITEMS = [(1, PASSAGE), (2, "Quick, quick brown fox!"), (3, None), (4, ""), (5, "nothing here"), (None, "fox"), (6, "é naïve CAFÉİ"), (7, "zebra"), (7, "zebra fox"), (7, "zebra"), (8, "the " * 50), (9, "filler word c d")]


def test_ranked_search(spark, docs, empty):
    got = sorted(map(tuple, lexical.ranked(docs, items_of(spark, ITEMS)).collect()), key=str)
    assert got == brute_ranked(TEXTS, ITEMS)
    assert lexical.ranked(empty, items_of(spark, ITEMS)).collect() == [] and lexical.ranked(docs, items_of(spark, [(1, None)])).collect() == []


@pytest.mark.parametrize(("block", "chunk"), [(8192, 1 << 20), (40, 1 << 20), (17, 200)])
def test_ranked_search_in_many_blocks_and_chunks(spark, block, chunk):
    rows = some_text(spark, 200) + TEXTS
    df = spark.createDataFrame([(*r, 1, 1, 1, 1, "x") for r in rows], SCHEMA).repartition(2)
    items = ITEMS + [(100 + k, " ".join(t.split()[:12])) for k, (_, t, _) in enumerate(some_text(spark, 30, 9))]
    got = sorted(map(tuple, lexical.ranked(df, items_of(spark, items), chunk_bytes=chunk, block=block).collect()), key=str)
    assert got == brute_ranked(rows, items)


def test_subtrees_are_bounded_and_skipped(monkeypatch):
    """Bounds hold for every document below, and with a close match most documents are never scored."""
    monkeypatch.setattr(lexical, "LEAF", 4)
    rng = np.random.default_rng(2)
    n, words = 600, 200
    lists = [np.unique(rng.zipf(1.4, size=30) % words) for _ in range(n)]
    lists[50] = np.arange(100, 130)
    ends = np.cumsum([len(x) for x in lists])
    ranks, tfs, m = np.concatenate(lists), rng.integers(1, 6, size=ends[-1]), rng.integers(30, 300, size=n)
    tree = lexical.Tree(np.arange(n), m, ends, ranks, tfs)
    asked, weights = np.arange(100, 130), np.full(30, 5000)
    bound, of = tree.bounds(asked, weights), np.zeros(words, np.int64)
    of[asked] = weights
    exact = tree.scores(0, n, of)
    assert sorted(tree.ids.tolist()) == list(range(n))
    assert all(bound[k] >= exact[tree.low[k] : tree.high[k]].max() for k in range(len(bound)))
    assert tree.low[tree.leaf].tolist() == sorted(tree.low[tree.leaf].tolist()) and (tree.high - tree.low)[tree.leaf].sum() == n
    seen, plain = [], tree.scores
    tree.scores = lambda a, b, w: seen.append(b - a) or plain(a, b, w)
    of[:] = 0
    best = tree.search(asked, weights, of, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 1)
    assert best[1].tolist() == [50] and best[0].tolist() == [exact.max()] and sum(seen) < n / 4 and not of.any()


def test_registered_with_sql(spark):
    assert {"op11_collocations", "op12_embedding_near_dedup", "op13_ranked_search"} <= set(queries.QUERIES) & set(queries.ORACLES)

import random
from collections import defaultdict

from ledgerstone.llm import near_dedup as nd


def brute(rows, idf):
    """The rows' classes, and the number of classes."""
    sets = [(h, nd.weights(h, n, idf)) for h, n in (nd.shingles(nd.word_hashes(t)) for _, t in rows)]
    keys = [nd.identity(nd.word_hashes(t)) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, (h, _) in enumerate(sets):
        for x in h.tolist():
            by[x].append(i)
    tried = set()
    for own in by.values():
        for i in own:
            for j in own:
                if i < j and (i, j) not in tried:
                    tried.add((i, j))
                    if nd.similarity(sets[i], sets[j]) >= nd.SIMILARITY:
                        root[max(find(i), find(j))] = min(find(i), find(j))
    first = {}
    for i, k in enumerate(keys):
        j = first.setdefault(k, i)
        root[max(find(i), find(j))] = min(find(i), find(j))
    ids = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        ids[find(i)].append(k)
    return sorted(((k, min((x for x in ids[find(i)] if x is not None), default=None)) for i, (k, _) in enumerate(rows)), key=str), len(ids)


def got(df):
    return sorted(((r["doc_id"], r["class_id"]) for r in nd.near_duplicates(df).collect()), key=str)


def test_tables(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    assert got(df) == brute([tuple(r) for r in df.collect()], nd.document_frequencies(df))[0]


def family(rng, n):
    """A base text and copies of it and of each other, with a few words changed."""
    texts = [[f"w{rng.randrange(4000)}" for _ in range(150)]]
    for _ in range(n):
        own = list(rng.choice([texts[0], rng.choice(texts)]))
        for _ in range(rng.randint(1, 5)):
            own[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
        texts.append(own)
    return [" ".join(t) for t in texts]


def test_families_edges_and_one_of_each(spark):
    rng = random.Random(11)
    texts = family(rng, 250) + family(rng, 20) + ["Same, words here!", "same words HERE", "", None, "...", "one two", "x " * 60_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (5, "another text under an id that is there already"), (None, texts[0]), (None, "alone without an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, n_classes = brute(rows, nd.document_frequencies(df))
    assert got(df) == want
    kept = nd.keep_one(df.selectExpr("*", "1 as _gone", "2 as _twice", "3 as keeper")).collect()
    assert len(kept) == n_classes
    assert {r["doc_id"] for r in kept} == {c for _, c in want}
    assert nd.near_duplicates(df.limit(0)).count() == 0 and nd.keep_one(df.limit(0)).count() == 0


def test_samples_agree_as_often_as_sets_are_similar():
    np = nd.np
    rng = np.random.default_rng(0)
    for share in (0.3, 0.8):
        off = []
        for _ in range(120):
            a = np.unique(rng.integers(0, 1 << 63, 300, np.uint64))
            b = a.copy()
            b[: int(300 * (1 - share) / (1 + share))] = rng.integers(0, 1 << 63, int(300 * (1 - share) / (1 + share)), np.uint64)
            b = np.unique(b)
            wa, wb = 1 + (a % np.uint64(3)).astype(float), 1 + (b % np.uint64(3)).astype(float)
            off.append((nd.signature(a, wa) == nd.signature(b, wb)).mean() - nd.similarity((a, wa), (b, wb)))
        assert abs(np.mean(off)) < 0.02


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    df = spark.createDataFrame(edges, "a long, b long")
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {r["vertex"]: r["root"] for r in nd.components(df).collect()} == {x: find(x) for x in list(root) if find(x) != x}


def test_hot_keys(spark):
    rows = [(i, "The same words are in all of these rows") for i in range(700)] + [(1000 + i, f"text number {i} alone") for i in range(5)] + [(2000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == sorted(((k, 0 if k < 700 else k) for k, _ in rows), key=str)


def test_names_of_columns_and_class_sizes(docs, spark):
    df = spark.createDataFrame([(1, "a b c", 7), (2, "a  b c!", 7), (3, "d", 7)], "doc_id long, text string, class_id long")
    assert sorted(map(tuple, nd.near_duplicates(df).collect())) == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]


def test_many_rows_without_ids_or_of_one_id(spark):
    """10,000 rows share an id or have none; the near copies among them must neither meet all others nor be lost."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base, f"v{i}"]) for i in range(150)] + [" ".join(f"x{rng.randrange(10**6)}" for _ in range(12)) for _ in range(4_850)]
    rows = [(None, t) for t in texts] + [(5, t) for t in texts]
    found = {}
    for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r["class_size"]] = found.get(r["class_size"], 0) + 1
    assert found == {300: 300, 2: 9_700}

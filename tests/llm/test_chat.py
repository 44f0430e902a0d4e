import random

from pyspark.sql import functions as F

from ledgerstone.llm import chat


def test_digest_equals_the_plain_reading(spark, data, sha):
    table = spark.read.parquet(f"{data}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.chat_digest(table).collect()}
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table.collect()] + [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    own = {}
    for c, turn, role, text in sorted(rows):
        own.setdefault(c, []).append((role, text))
    assert set(got) == set(own)
    for c, turns in own.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))


def test_hard_texts_read_back(spark):
    rng = random.Random(4)
    bits = ["<turn role=user>", "</turn>\n", "\\", "\\b", "\\l", "<", ">", "é", "\n", "🦊", "", "\\\\g"]
    rows = [(c, t, rng.choice(["user", "assistant", "a>b", None]), rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 9)))])) for c in range(40) for t in range(rng.randint(1, 5))]
    rows += [(1, 0, "user", "same turn"), (1, 0, "user", "same turn"), (None, 1, "assistant", "no id"), (90, None, "user", "no turn")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    trees = chat.as_trees(table)
    out = chat.format_branches(trees).withColumn("read", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r["tree"]: r for r in out.collect()}
    own = {}
    for c, turn, role, text in sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in (r[0], r[1])) + ((r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or ""))):
        own.setdefault("" if c is None else str(c), []).append((role or "", text or ""))
    assert {k: [tuple(x) for x in r["read"]] for k, r in got.items()} == own
    assert all(r["loss"] == "".join(t for role, t in own[k] if role == "assistant") for k, r in got.items())


def test_branches_of_real_trees(spark):
    rng = random.Random(9)
    nodes, scores, parent = [], {}, {}
    for tree in range(12):
        for n in range(rng.randint(1, 60)):
            parent[tree, n] = rng.choice([None, n - 1, rng.randrange(n)]) if n else None
            scores[tree, n] = rng.randint(0, 9)
            nodes.append((str(tree), n, parent[tree, n], scores[tree, n]))
    nodes += [("cycle", 1, 2, 1), ("cycle", 2, 1, 1), ("orphan", 1, 99, 3)]

    def path(t, n):
        return [*path(t, parent[t, n]), n] if parent[t, n] is not None else [n]

    want = {}
    for tree in range(12):
        own = [n for t, n in parent if t == tree]
        leaves = set(own) - {parent[tree, n] for n in own}
        ranked = sorted((-sum(scores[tree, k] for k in path(tree, n)), n) for n in leaves)
        for rank, (score, n) in enumerate(ranked[:2], 1):
            want[str(tree), rank] = (-score, path(tree, n))
    want["orphan", 1] = (3, [1])
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score long")
    for best in (1, 2):
        got = {}
        for r in chat.branches(df, best).orderBy("tree", "branch_rank", "depth").collect():
            got.setdefault((r["tree"], r["branch_rank"]), (r["branch_score"], []))[1].append(r["node"])
        assert got == {k: v for k, v in want.items() if k[1] <= best}
    assert chat.branches(df.limit(0)).count() == 0

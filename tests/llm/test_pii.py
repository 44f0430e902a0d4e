import random
import re

from ledgerstone.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, value):
    digits = re.sub(r"\D", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if holds(k, m[0]))


def test_base_spans(spark, data, docs, sha):
    rng = random.Random(3)
    bits = ["a", "b.c", "@", ".", "x@y.z", "1", "22", "255", "256", " ", "-", "+", "+1 (", "555", "4111 1111 1111 1111", "4111-1111", "é", "_", "%", "com", "\n", ".example.com", "1.2.3.4", "(", ")", "99"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(1_500)] + [None, "", "9" * 30_000, "a" * 30_000 + "@b.c", "4111111111111111 , " * 700]
    made = docs(list(enumerate(texts)))
    for df in (made, spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")):
        text = {r["doc_id"]: r["text"] for r in df.collect()}
        for r in pii.pii_digest(df).collect():
            assert r["base_sha256"] == sha(brute(text[r["doc_id"]])), text[r["doc_id"]]


def test_weak_supervision_adds_what_the_votes_agree_on(spark, docs):
    good = [(i, f"Please call the phone {200 + i}-555-{1000 + i} today, or write.") for i in range(80)]
    bad = [(100 + i, f"version{200 + i}-000-{1000 + i}x of the build") for i in range(40)]
    rows = docs(good + bad + [(999, None), (998, "Signed James Smith")])
    found = pii.candidates(rows)
    model = pii.train(found)
    assert all(0.5 < r < 1 for k in model.reliability.values() for r in k)
    got = {r["doc_id"]: r["spans"] for r in pii.spans(found, model).select("doc_id", "spans").collect()}
    assert sum(bool(got[i]) for i, _ in good) == 80 and not any(got[i] for i, _ in bad)
    assert got[999] == []
    assert pii.find_pii(docs([])).count() == 0
    clash = spark.createDataFrame([(1, "a@b.c", 2)], "doc_id long, text string, candidates int")
    assert [(s["kind"], s["start"], s["end"]) for s in pii.find_pii(clash).first()["pii"]] == [("email", 0, 5)]


def plain_em(rows, rounds=30):
    """Expectation-maximisation over single candidates (kind, votes), row by row: each kind's reliabilities and share."""
    right, real = {k: [0.8] * len(pii.LABELERS) for k in pii.KINDS}, dict.fromkeys(pii.KINDS, 0.5)
    for _ in range(rounds):
        ps = []
        for kind, votes in rows:
            yes, no = real[kind], 1 - real[kind]
            for v, a in zip(votes, right[kind]):
                if v:
                    yes, no = yes * (a if v > 0 else 1 - a), no * (1 - a if v > 0 else a)
            ps.append(yes / (yes + no))
        new = {k: [0.0] * len(pii.LABELERS) for k in pii.KINDS}
        for j in range(len(pii.LABELERS)):
            cast = {k: [(p if votes[j] > 0 else 1 - p) for (kind, votes), p in zip(rows, ps) if kind == k and votes[j]] for k in pii.KINDS}
            mean = (4 + sum(map(sum, cast.values()))) / (5 + sum(map(len, cast.values())))
            for k in pii.KINDS:
                new[k][j] = min(0.99, max(0.51, (sum(cast[k]) + 10 * mean) / (len(cast[k]) + 10)))
        right = new
        real = {k: min(0.99, max(0.01, (1 + sum(p for (kind, _), p in zip(rows, ps) if kind == k)) / (2 + sum(kind == k for kind, _ in rows)))) for k in pii.KINDS}
    return right, real


def accounts():
    """Numbers like accounts: near other data, of an issuer that cards share, after a cue; and numbers of versions and orders."""
    card = "4111111111111111"
    rows = [(i, f"Pay with card {card} or write to ann{i}@mail.org please") for i in range(40)]
    rows += [(100 + i, f"Her account {4111000000000003 + 10 * i * 7} and mail ann{i}@mail.org are known") for i in range(40)]
    rows += [(200 + i, f"order {990000000 + i}x of the release build") for i in range(40)]
    return rows


def test_reliabilities_equal_plain_em_and_the_classifier_adds_and_rejects(docs):
    found = pii.candidates(docs(accounts()))
    known = pii.gazetteers(found)
    assert known["card"] == ["4111"] and known["email"] == ["mail.org"]
    marked = pii.voted(found, known)
    model = pii.train(marked)
    rows = [(c["kind"], tuple(c["votes"])) for r in marked.collect() for c in r["candidates"]]
    right, real = plain_em(rows)
    for k in {kind for kind, _ in rows}:
        assert max(abs(a - b) for a, b in zip(model.reliability[k], right[k])) < 1e-9 and abs(model.real[k] - real[k]) < 1e-9
    out = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.spans(marked, model).collect()}
    added = sum("account" in out[100 + i] for i in range(40))
    assert added >= 30 and not any(out[200 + i] for i in range(40))


def test_ablation_without_the_gazetteers_the_votes_differ(docs):
    found = pii.candidates(docs(accounts()))
    with_, without = (pii.train(pii.voted(found, k)).odds for k in (pii.gazetteers(found), {}))
    assert with_["account|gazetteer|1"] > 0 and "account|gazetteer|1" not in without

import random
import re
import time

from pyspark.sql import functions as F

from ledgerstone.llm import secrets

KINDS = {"assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def brute(text):
    keep = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    found = [(m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if keep[k](m)]
    return ",".join(x for *_, x in sorted(found))


def test_base_spans(spark, data, docs, sha):
    rng = random.Random(1)
    bits = ["password", "token", "secret", "=", ":", '"', "'", " ", "abc", "deadbeef00", "AKIA", "ABCDEF12", "api_key", "apikey", "a", ".", "x=y", "é", "Token", "0123456789abcdef", "🦊"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(4_000)] + [None, "", "f" * 100_000, "password=" * 5_000]
    for df in (docs(list(enumerate(texts))), spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")):
        text = {r["doc_id"]: r["text"] for r in df.collect()}
        for r in secrets.secret_digest(df).collect():
            assert r["base_sha256"] == sha(brute(text[r["doc_id"]]))


def test_more_rules_and_redaction(spark, docs):
    rows = docs([(1, "é ghp_" + "a1B2" * 9 + " end"), (2, "-----BEGIN RSA PRIVATE KEY-----"), (3, None), (4, "token = 'abcdefgh' and token = x"), (5, "plain")])
    found = secrets.scan_secrets(rows)
    assert {r["doc_id"]: [s["kind"] for s in r["secrets"]] for r in found.collect()} == {1: ["forge"], 2: ["pem"], 3: [], 4: ["assign"], 5: []}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(found).collect()}
    assert clean == {1: "é [SECRET] end", 2: "[SECRET]", 3: None, 4: "[SECRET]' and token = x", 5: "plain"}
    assert secrets.scan_secrets(docs([])).count() == 0
    assert secrets.scan_secrets(rows.withColumn("kind", F.lit(1))).columns[-2:] == ["kind", "secrets"]


def test_automata_are_minimal_and_agree_with_the_regex():
    a = secrets.compile_rules([("(ab|ac)+d?", False), ("x{2,3}", True)], anchored=True)
    for s in ("ab", "abac", "abd", "xX", "xxx", "xxxx", "a", "d", ""):
        state = 0
        for b in s.encode():
            state = a.step[state, a.classes[b]]
        want = (1 if re.fullmatch("(ab|ac)+d?", s) else 0) | (2 if re.fullmatch("(?i)x{2,3}", s) else 0)
        assert a.accept[state] == want
    assert len(secrets.compile_rules([("a|a", False)], True).accept) == 3


def test_all_rules_against_the_regexes():
    rng = random.Random(4)
    bits = ["ghp_", "gho", "xoxb-", "AIza", "eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "AKIA", "token", "=", " ", "Ab1" * 12, "deadbeef" * 3, "9", "z", "_", "-"]
    scanner = secrets.Scanner().ready()
    for _ in range(3_000):
        data = "".join(rng.choices(bits, k=rng.randint(0, 20))).encode()
        want = []
        for k, rule in enumerate(secrets.RULES):
            flags = re.I if rule.ignore_case else 0
            want += [(m.start(), m.end(), k) for m in re.finditer(rule.pattern.encode(), data, flags) if rule.keep(m[0])]
        assert scanner.spans(data) == sorted(want, key=lambda x: (x[0], x[2])), data


def test_time_is_linear():
    scanner = secrets.Scanner().ready()
    for data in (b"eyJ" * 80_000 + b" token=abcdef12", b"token" * 50_000 + b"=abcdef12", b"-----BEGIN " * 20_000 + b"token=abcdef12", b"AKIA" * 60_000):
        begin = time.perf_counter()
        assert scanner.spans(data)
        assert time.perf_counter() - begin < 3


def test_clash_of_names(spark):
    out = secrets.scan_secrets(spark.createDataFrame([("token=abcdef", 1)], "text string, Secrets int"))
    assert out.columns == ["text", "Secrets", "_secrets"] and out.first()["Secrets"] == 1 and len(out.first()["_secrets"]) == 1

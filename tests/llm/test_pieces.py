import random

import pytest

from ledgerstone.llm import pieces
from ledgerstone.llm.common import model_path

MODEL = model_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def fst():
    return pieces.Transducer(MODEL).ready(cache=2_000)


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)


def ids(fst, text):
    return pieces.np.frombuffer(fst.encode(text), pieces.np.int32).tolist()


def test_equals_the_library(fst, library, spark, data):
    for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect():
        assert ids(fst, r["text"]) == library.encode(r["text"])


def test_hard_texts(fst, library):
    rng = random.Random(6)
    bits = ["a", "the", " ", "   ", " " * 17, "\n", "\t", "é", "▁", "日本", "🦊", "ing", "<s>", "<0x41>", "0", "\x00", "Hello", ".", "==", "�"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(3_000)] + [" " * n for n in range(70)] + ["a" + " " * n + "b" for n in range(70)] + ["x" * 5_000]
    for t in texts:
        own = ids(fst, t)
        assert own == library.encode(t)
        assert fst.decode(own) == library.decode(own)


PIECES = ["▁", "a", "b", "c", "d", "e", "é", "ab", "bc", "abc", "▁a", "▁ab", "▁abc", "de", "cd", "▁▁", "ea", "(", ")", "1", "f", "i", "fi", "A"]


def model(folder, kind, rule, fallback=False, user=(), shrink=True, crossing=()):
    """A small hand-written model file, and the library's processor of it. Nothing is trained."""
    spm = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    if rule:
        m.normalizer_spec.precompiled_charsmap = pb.ModelProto.FromString(spm.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()).normalizer_spec.precompiled_charsmap
    m.normalizer_spec.remove_extra_whitespaces = shrink
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = kind, fallback
    special = [("<unk>", 2), ("<s>", 3), ("</s>", 3)] + [(f"<0x{b:02X}>", 6) for b in range(256)] * fallback + [(u, 4) for u in user]
    for p, t in special:
        m.pieces.add(piece=p, score=0.0, type=t)
    for k, p in enumerate([*PIECES, *crossing]):
        m.pieces.add(piece=p, score=-0.37 * ((k * 7) % 23) - 1 if kind == 1 else -float((k * 7) % 23) - k / 100, type=1)
    path = f"{folder}/{kind}-{rule}-{fallback}-{len(user)}-{shrink}-{len(crossing)}.model"
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    return pieces.Transducer(path).ready(), spm.SentencePieceProcessor(model_file=path)


@pytest.mark.parametrize("kind", (1, 2))
@pytest.mark.parametrize("more", ({"rule": None}, {"rule": "nmt_nfkc"}, {"rule": "nfkc_cf", "fallback": True}, {"rule": "nmt_nfkc", "user": ("<x>", "ab1")}, {"rule": None, "shrink": False, "fallback": True}, {"rule": "nmt_nfkc", "crossing": ("a▁b", "e▁")}))
def test_both_kinds_of_models_equal_the_library(tmp_path, kind, more):
    fst, library = model(tmp_path, kind, **more)
    rng = random.Random(kind)
    bits = ["a", "b", "c", "ab", "bc", "d", "e", "e\u0301", "é", " ", "  ", "ﬁ", "Ａ", "①", "\n", "\t", "日", "🦊", "<x>", "ab1", "(", "㈱", "\u200b", "z"]
    for _ in range(1_500):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert ids(fst, text) == library.encode(text), text


def test_unigram_paths_are_the_best(tmp_path):
    fst, _ = model(tmp_path, 1, None)

    def best(s):
        cost = [0.0] + [float("inf")] * len(s)
        for j in range(1, len(s) + 1):
            cost[j] = min((cost[i] + fst._weight[fst._id[s[i:j]]] for i in range(j) if s[i:j] in fst._id), default=float("inf"))
        return cost[len(s)]

    rng = random.Random(8)
    for _ in range(300):
        s = "▁" + "".join(rng.choices("abcde", k=rng.randint(0, 12)))
        assert abs(sum(fst._weight[x] for x in fst._shortest(s)) - best(s)) < 1e-9


def test_ablation_each_transducer_changes_the_ids(tmp_path):
    fst, _ = model(tmp_path, 1, "nmt_nfkc", fallback=True)
    own = ids(fst, "ﬁ 日ab")
    fst.normaliser = pieces.Normaliser({}, [])
    assert ids(fst, "ﬁ 日ab") != own
    fst._weight = [1.0] * len(fst._weight)
    assert len(fst._shortest("▁abc")) == 1


def test_columns(spark, docs):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "a ▁ b"), (4, "a ▁ b"), (5, "word " * 40_000)]
    got = pieces.piece_digest(docs(rows), MODEL).collect()
    assert [(r["doc_id"], r["round_trip"]) for r in got] == [(1, True), (2, True), (3, True), (4, False), (4, False), (5, True)]
    assert [r["n_pieces"] for r in got][1:3] == [0, 0]
    back = pieces.decode_pieces(pieces.encode_pieces(docs(rows[:1]), MODEL), MODEL).first()
    assert back["decoded"] == "Hello world"
    assert pieces.encode_pieces(docs([]), MODEL).count() == 0
    assert pieces.encode_pieces(docs(rows).withColumnRenamed("doc_id", "Piece_ids"), MODEL).columns == ["Piece_ids", "text", "_piece_ids"]
    clash = spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, encoded string")
    assert pieces.encode_pieces(clash, MODEL).columns == ["doc_id", "text", "encoded", "piece_ids"]


def test_one_finite_path_is_what_relaxing_all_arcs_finds():
    fst = pieces.Transducer(MODEL).ready()
    r = random.Random(7)
    parts = ["".join(r.choice("▁aabcdeiorst.,é中😀") for _ in range(r.randint(1, 40))).lstrip("▁") or "a" for _ in range(300)]
    found = [fst._finite(p) for p in parts]
    assert None not in found
    fst._finite = lambda s: None
    assert [fst._shortest(p) for p in parts] == found

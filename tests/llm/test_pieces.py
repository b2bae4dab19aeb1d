import random
import zlib

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from factloom.llm.pieces import (
    NEVER, Lattice, best_states, decode, encode, encode_marked, marked, product, with_round_trip,
)
from factloom.llm.queries import vocabulary
from tests.llm.common import SMALL, documents, plain, table

PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return Lattice(PATH)


@pytest.fixture(scope="module")
def library(lattice):
    """The same pieces and scores read as a unigram model by the library itself."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for i, piece in enumerate(model.pieces):
        piece.score = lattice.scores.get(i, piece.score)
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def library_score(library, lattice, text):
    ids = library.encode(text)
    byte_of = {i: b for b, i in lattice.byte_ids.items()}
    spelled = sum(lattice.scores[i] for i in ids if i not in byte_of)
    unknown = bytes(byte_of[i] for i in ids if i in byte_of)
    return spelled + lattice.unknown_score * len(unknown.decode("utf-8"))


TEXTS = [
    "Hello  world", "  two leading", "tail  ", "a\nb\n\nc\td", "ﬁ ①漢字 🙂x", "thththth" * 12,
    "The quick brown fox; it's 12,345.67!", "Ciónieado enpfauß", "x", " ", "\n",
]


def test_same_score_as_the_library(library, lattice):
    texts = TEXTS + [t[:120] for _, t in documents(SMALL)[:60]]
    found = encode_marked(lattice, [marked(t) for t in texts])
    same = 0
    for text, (weight, ids) in zip(texts, found):
        own = -((-weight) // (1 << 20))
        assert own == pytest.approx(library_score(library, lattice, text), abs=1e-6 * abs(own) + 0.5), text
        assert lattice.decoded(ids, True) == text
        same += ids.tolist() == library.encode(text)
    assert same > 0.9 * len(texts)


def test_chunks_give_the_same_encoding(spark):
    rng = random.Random(8)
    giant_word = "".join(rng.choice("thereandon") for _ in range(3000))
    texts = TEXTS + [giant_word, " ".join(rng.choice(["there", "and", "漢字", "onx"]) for _ in range(400)),
                     "▁ mark", "a" * 700, documents(SMALL)[0][1]]
    docs = table(spark, texts, chunk="c", key="k")
    whole = {r["doc_id"]: r for r in encode(docs, PATH, chunk=1 << 30).collect()}
    cut = {}
    for r in encode(docs, PATH, chunk=37).orderBy("doc_id", "chunk").collect():
        cut.setdefault(r["doc_id"], []).append(r)
    assert max(len(c) for c in cut.values()) > 64  # several levels of groups
    for i in range(len(texts)):
        assert sum(r["score"] for r in cut[i]) == pytest.approx(whole[i]["score"]), texts[i][:50]
        assert len([x for r in cut[i] for x in r["ids"]]) == len(whole[i]["ids"])
    spelled = {}
    for r in decode(encode(docs, PATH, chunk=37), PATH).orderBy("doc_id", "chunk").collect():
        spelled[r["doc_id"]] = spelled.get(r["doc_id"], "") + r["text"]
    assert all(spelled[i] == t.replace("▁", " ") for i, t in enumerate(texts))


def test_associative():
    rng = np.random.default_rng(0)
    m = [np.where(rng.random((5, 5)) < 0.3, NEVER, rng.integers(-50, 0, (5, 5))) for _ in range(6)]
    left = product(product(m[0], m[1]), m[2])
    assert (left == product(m[0], product(m[1], m[2]))).all()
    open_ended = [np.where(x == NEVER, -99, x) for x in m]
    states = best_states(open_ended, 0, 0)
    total = open_ended[0]
    for x in open_ended[1:]:
        total = product(total, x)
    assert sum(x[a, b] for x, a, b in zip(open_ended, states, states[1:])) == total[0, 0]


def test_missing_and_repeated(spark):
    found = with_round_trip(encode(table(spark, [None, "", "ab", "ab"], [1, None, 2, 2]), PATH), PATH)
    none = zlib.crc32(b"")
    assert plain(found, "doc_id", "n_tokens", "text_crc32", "round_trip")[:2] == [
        (None, 0, none, True), (1, 0, none, True),
    ]
    assert found.count() == 4
    assert encode(table(spark, []), PATH).collect() == []

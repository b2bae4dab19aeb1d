import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from factloom.llm import packing
from factloom.llm.packing import best_fit, pack
from factloom.llm.queries import op4_best_fit_packing, vocabulary
from tests.llm.common import SMALL, documents, table

PATH = vocabulary("word_bpe_49k.json")


def expected_pieces(docs, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for i, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            out.append((i, piece, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


def placed(df, capacity):
    found = df.collect()
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    pieces = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found]
    return sorted(pieces, key=str), bins


def test_whole_table(spark):
    pieces, bins = placed(op4_best_fit_packing(spark, SMALL), 2048)
    assert pieces == expected_pieces(documents(SMALL), 2048)
    assert len(bins) <= 1.08 * -(-sum(p[3] for p in pieces) // 2048)


def test_texts_of_all_kinds(spark):
    texts = [
        None, "", " ", "it's they'RE 12 ３ <|endoftext|>x<|startoftext|>", "İstanbul T̈ ẞ ΑΣ.", "a\u0301 \u0301b",
        "Word. word, WORD!! w-*** <|ENDOFTEXT|>.", "x" * 5000, "great " * 3000, "great " * 3000,
    ]
    docs = list(zip([None, 1, 2, 3, 4, 5, 6, 7, 8, 8], texts))
    df = pack(table(spark, texts, [i for i, _ in docs], offset="o"), PATH, capacity=64, with_ids=True)
    pieces, _ = placed(df, 64)
    assert pieces == expected_pieces(docs, 64)
    assert all(len(r["ids"]) == r["length"] for r in df.collect())
    assert pack(table(spark, []), PATH).collect() == []


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_holds(rule):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 101, 600)
    bins, offsets = best_fit(lengths, 100, 4, 11_000.0, rule=rule)
    for b in set(bins.tolist()):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 4 and (own.astype(float) ** 2).sum() <= 11_000
        assert sorted(offsets[bins == b]) == np.concatenate([[0], np.cumsum(own[np.argsort(offsets[bins == b])])[:-1]]).tolist()
    loose, _ = best_fit(lengths, 100, 100, 1e4 * 100, rule=rule)
    assert len(set(loose.tolist())) <= 1.05 * lengths.sum() / 100 + 1


def test_impossible_limit(spark):
    with pytest.raises(ValueError):
        pack(table(spark, ["a"]), PATH, capacity=64, max_attention=10.0)


def test_plain_letters_need_the_model_only(monkeypatch):
    words = packing.WordTokens(PATH)
    texts = ["the Straße für naïve Ünder", "été Été ÿes, it's x1!? İstanbul ǆ aµ", "a" * 500, "", "<unk> 中文"]
    want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in words.encode(texts)] == want
    assert not packing.WordTokens._split(b"Plain9")[1] and words.parts[b"the"] == words.words[b"the"]
    # No plain part reaches the tokenizer again, and what comes again is not learned anew.
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 2)
    learned = []
    monkeypatch.setattr(words, "_learn", learned.extend)
    assert [np.frombuffer(b, "<u4").tolist() for b in words.encode(texts)] == want
    assert not learned


def test_both_cases_of_a_word_are_learned_once(monkeypatch):
    words = packing.WordTokens(PATH)
    learned, learn = [], words._learn
    monkeypatch.setattr(words, "_learn", lambda parts: (learned.extend(parts), learn(parts)))
    texts = [" Été été, ÉTÉ!\x0bÜber\x0c\rüber  über.", "", "\n", "é.É á! Á! Ａ｡ x<b>. 9.!", "ÉTÉ"]
    want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in words.encode(texts)] == want
    assert [learned.count(w.encode()) for w in ("été", "Été", "ÉTÉ", "über", "Über")] == [1, 0, 0, 1, 0]


def test_many_new_words_at_once(monkeypatch):
    monkeypatch.setattr(packing, "WORDS_AT_ONCE", 3)
    words = packing.WordTokens(PATH)
    text = " ".join(f"{a}{b}ö{c}" for a in "abxé" for b in ("schl", "zq", "") for c in ("ñandú", "y"))
    assert np.frombuffer(next(words.encode([text])), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids

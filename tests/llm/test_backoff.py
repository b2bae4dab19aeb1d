import math
import zlib
from collections import Counter

import numpy as np
import pytest

from factloom.llm.backoff import Automaton as WeightedAutomaton, BlockGrams, STRENGTH, _packed_grams, _unpacked_grams, scores
from tests.llm.common import SMALL, documents, plain, table, words


class Automaton:
    """States, arcs and failure arcs written out, one step per token."""

    def __init__(self, docs, order):
        self.order, self.counts = order, Counter()
        self.tokens, single = 0, Counter()
        for i, text in docs:
            if zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2:
                continue
            own = ["<s>", *words(text), "</s>"]
            single.update(own[1:])
            for k in range(1, order + 1):
                self.counts.update(tuple(own[j : j + k]) for j in range(len(own) - k + 1))
        self.single, self.n, self.v = single, sum(single.values()), len(single)

    def probability(self, state, word):
        if not state:
            return (self.single[word] + 1) / (self.n + self.v + 1)
        rest = self.probability(state[1:], word)
        return (self.counts[(*state, word)] + STRENGTH * rest) / (self.counts[state] + STRENGTH)

    def score(self, text):
        total, state = 0.0, ("<s>",)
        for word in [*words(text), "</s>"]:
            total += math.log10(self.probability(state[-(self.order - 1):] if self.order > 1 else (), word))
            state = (*state, word)
        return total


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_a_plain_automaton(spark, order):
    docs = [*documents(SMALL)[:80], (1000, None), (1001, ""), (None, "The end"), (1002, "The the THE")]
    df = table(spark, [t for _, t in docs], [i for i, _ in docs], block="b", split="s")
    found = {r["doc_id"]: r for r in scores(df, order=order).collect()}
    model = Automaton(docs, order)
    for i, text in docs:
        own = [*words(text), "</s>"]
        r = found[i]
        assert r["held_out"] == (zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["train_tokens"]) == (len(own), model.n)
        assert r["n_known"] == sum(model.single[w] > 0 for w in own)
        base = sum(math.log10((model.single[w] + 1) / (model.n + model.v + 1)) for w in own)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(model.score(text))


def test_long_texts_are_walked_in_lanes_and_blocks(spark, monkeypatch):
    own = [t for _, t in documents(SMALL)[:40]]
    texts = [" ".join(own), own[0], "", " ".join(own[::-1]) + " zzz", *own, None, "x" * 70_000]
    whole = plain(scores(table(spark, texts)), "doc_id", "score")
    model = Automaton(list(enumerate(texts)), 3)
    assert [s for _, s in sorted(whole)] == pytest.approx([model.score(t) for t in texts])
    monkeypatch.setattr("factloom.llm.backoff.BLOCK_CHARS", 1 << 14)
    parts = plain(scores(table(spark, texts)), "doc_id", "score")
    assert [s for _, s in sorted(parts)] == pytest.approx([s for _, s in sorted(whole)])


@pytest.mark.parametrize("lane", [1, 2, 256])
def test_the_walk_meets_states_arcs_and_failures(monkeypatch, lane):
    monkeypatch.setattr("factloom.llm.backoff.LANE", lane)
    texts = BlockGrams(["a b a c", "q a b a z"], 3)
    totals = [c.astype(float) for c in texts.counts(np.array([True, False]))]
    walk = WeightedAutomaton(texts, totals, 5, 4, STRENGTH)
    model = Automaton([(0, "a b a c")], 3)
    assert walk.scores() == pytest.approx([model.score("a b a c"), model.score("q a b a z")])


def test_hashes_packed_and_unpacked():
    grams = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 1000, np.uint64))
    for part in (grams, grams[:1], grams[:0], np.array([0, (1 << 64) - 1], np.uint64)):
        assert (_unpacked_grams(_packed_grams(part)) == part).all()


def test_probabilities_add_up():
    model = Automaton([(0, "a b a c"), (1, "b b a")], 3)
    for state in [("a",), ("<s>", "a"), ("b", "b"), ("zzz", "b")]:
        total = sum(model.probability(state, w) for w in [*model.single, "unknown"])
        assert total == pytest.approx(1)


def test_stored_table_and_held_out_gain(spark):
    found = scores(spark.read.parquet(f"{SMALL}/documents.parquet"))
    held = [r for r in found.collect() if r["held_out"]]
    assert len(held) > 10 and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_nothing_to_learn_from(spark):
    assert scores(table(spark, [])).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    found = scores(table(spark, ["a b", "a b"], [only, only]))
    assert plain(found, "n_tokens", "n_known", "train_tokens", "base_score") == [(3, 0, 0, 0.0)] * 2

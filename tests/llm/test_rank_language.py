import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.llm import rank_language as rl
from tests.llm.common import MEDIUM, plain

SCHEMA = "doc_id long, text string, lang string"


def grams(text):
    """Plain n-grams of the blank-padded words, and blanks on their own left out."""
    letters = "".join(
        (c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else " " for c in text
    )
    words = f" {' '.join(letters.split())} " if letters.strip() else ""
    out = Counter()
    for n in range(1, 6):
        for i in range(len(words) - n + 1):
            g = words[i : i + n]
            if g != " " and " " not in g[1:-1]:
                out[g] += 1
    return out


def hashed(gram):
    h = 0
    for c in gram:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
    return (h * 0x9E3779B97F4A7C15 + len(gram)) % 2**64


def profile(counts, k):
    return sorted(counts, key=lambda g: (-counts[g], hashed(g)))[:k]


def brute(docs, k=300):
    held = {i: zlib.crc32(str("" if i is None else i).encode()) % 4 == 2 for i, _, _ in docs}
    by_lang = defaultdict(Counter)
    for i, text, lang in docs:
        if lang is not None and not held[i]:
            by_lang[lang].update(grams(text or ""))
    known = {lang: profile(c, k) for lang, c in sorted(by_lang.items()) if c}
    out = []
    for i, text, _ in docs:
        own = profile(grams(text or ""), k)
        if not known or not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            out.append((i, held[i], "und", 0.0))
            continue
        far = []
        for lang, p in known.items():
            place = {g: n for n, g in enumerate(p)}
            far.append((sum(abs(place[g] - n) if g in place else k for n, g in enumerate(own)), lang))
        far.sort()
        second = far[1][0] if len(far) > 1 else len(own) * k
        score = second / (far[0][0] + second) if far[0][0] + second else 0.5
        out.append((i, held[i], far[0][1], score))
    return sorted(out, key=lambda r: tuple((v is not None, v) for v in r))


def some_documents(n=80):
    rng = random.Random(4)
    words = {"en": "the and of thing is was".split(), "de": "der und die ßtraße über ist".split(), "ru": "это и не была ёлка".split()}
    docs = []
    for i in range(n):
        lang = rng.choice(list(words))
        text = " ".join(rng.choice(words[lang]) + rng.choice(["", ",", "!2 ", "\n"]) for _ in range(rng.randint(0, 40)))
        docs.append((i, text.title() if i % 2 else text, rng.choice([lang, lang, None])))
    return docs


EDGES = [
    (None, "the thing", "en"), (None, None, None), (201, None, "en"), (202, "", "de"), (203, "12 34 !?", "en"),
    (204, "́̂", "xx"), (205, "中文 字", "zh"), (206, "the the the", "en"), (206, "the the the", "en"), (207, "İ\u0000Ǆ x", ""),
]


def same(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


@pytest.mark.parametrize("k", [300, 12])
def test_equals_plain_profiles(spark, k):
    docs = some_documents() + EDGES
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    same(plain(rl.predicted_languages(df, ranks=k)), brute(docs, k))


def test_small_bounds_change_nothing(spark, monkeypatch):
    docs = some_documents() + EDGES + [(300, "x" * 50 + " the " * 30 + "," * 20, "en")]
    for name, value in (("AT_ONCE", 7), ("HELD", 30), ("LANGUAGES_AT_ONCE", 2)):
        monkeypatch.setattr(rl, name, value)
    same(plain(rl.predicted_languages(spark.createDataFrame(docs, SCHEMA).repartition(3))), brute(docs))


def test_profiles_hold_exact_counts(spark):
    docs = [(i, text, lang) for i, text, lang in some_documents() if lang]
    got = plain(rl.profiles(spark.createDataFrame(docs, SCHEMA), 25))
    want = []
    for lang in {d[2] for d in docs}:
        counts = sum((grams(t) for _, t, ln in docs if ln == lang), Counter())
        want += [(lang, n, g, counts[g]) for n, g in enumerate(profile(counts, 25), 1)]
    assert got == sorted(want)


def test_nothing_to_learn_and_clashing_columns(spark):
    assert plain(rl.predicted_languages(spark.createDataFrame([], SCHEMA))) == []
    unknown = spark.createDataFrame([(1, "some words", None)], SCHEMA)
    assert [r[2:] for r in plain(rl.predicted_languages(unknown))] == [("und", 0.0)]
    docs = some_documents(20)
    wide = spark.createDataFrame([(*d, 1, "g", True) for d in docs], SCHEMA + ", best long, gram string, held_out boolean")
    same(plain(rl.predicted_languages(wide)), brute(docs))


def test_held_out_accuracy_without_looking_at_languages(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    found = rl.predicted_languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("r"), F.count("*").alias("n")).first()
    assert right["n"] > 100 and right["r"] > 0.95
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    hidden = docs.withColumn("lang", F.when(~held, F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    same(plain(rl.predicted_languages(hidden)), plain(rl.predicted_languages(docs)))

import hashlib
import random
import re

from factloom.llm.pii import base_spans, personal_data, span_digest
from tests.llm.common import MEDIUM, documents, table

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_like_the_patterns():
    rng = random.Random(11)
    texts = [t for _, t in documents(MEDIUM)]
    texts += ["".join(rng.choice("0123456789.+-() @ab%é\n") for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["".join(rng.choice("0125.") for _ in range(30)) for _ in range(1000)]
    texts += ["".join(rng.choice("ab@.") for _ in range(20)) for _ in range(1000)]
    texts += ["4242 4242 4242 4242", "4242-4242-4242-42424", "256.1.1.1 01.002.0003.4", "a@b.c.d@e.f", "٣.١.٢.٤"]
    for text in texts:
        assert base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" + " " * 300_000, "a@" * 150_000):
        base_spans(text)


def test_repeated_mentions_are_labelled_alike(spark):
    filler = " thing and other words of no note " * 6
    base = [f"Mail jo.doe{i}@mail{i}.example.org or call +49 30 555{i:02d}12.{filler}" for i in range(60)]
    hidden = "Write to kim.lee@mail.example.net today." + filler + "Or kim.lee (at) mail.example.net. Call +1 202 555 0147, at home 202 555 0147."
    clean = "Order 1234567 of 2024 and 7654321, see a (at) nothing." + filler
    docs = table(spark, [*base, hidden, clean, None, ""], spans="s")
    found = {r["doc_id"]: r["spans"] for r in personal_data(docs).collect()}
    added = {hidden[s["start"] : s["end"]]: s["kind"] for s in found[60] if not s["base"]}
    assert added == {"kim.lee (at) mail.example.net": "email", "202 555 0147": "phone"}
    assert [s["kind"] for s in found[60] if s["base"]] == ["email", "phone"]
    assert found[61] == [] and found[62] == [] and found[63] == []


def test_digest_over_the_table(spark):
    docs = documents(MEDIUM)
    found = span_digest(personal_data(spark.read.parquet(f"{MEDIUM}/documents.parquet"))).collect()
    assert len(found) == len(docs)
    texts = dict(docs)
    for r in found:
        spans = plain_spans(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [
            sum(k == kind for k, *_ in spans) for kind in ("email", "ip", "card", "phone")
        ]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r["spans"].split(","))


def test_empty(spark):
    assert personal_data(table(spark, [])).collect() == []
    assert personal_data(table(spark, [None, None], [None, 3])).count() == 2

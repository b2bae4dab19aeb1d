"""Personal data by patterns and a skip-chain conditional random field.

Patterns give base spans.  Around them lie mentions that no pattern accepts: a number without
its country code, an address with (at) for @, digits split in another way.  All mentions of a
document are nodes of a random field with the labels none, email, ip, card and phone.
Neighbouring mentions are linked as a chain, and mentions with the same or similar content,
however far apart, by skip edges that share potentials, so that a document labels one entity
in one way.  Base spans are observed; loopy message passing labels the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import id_and_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Documents that the weights are fitted on, in the order of a hash of the id, and their
#: longest text.
FIT_ROWS, FIT_LENGTH = 2_000, 100_000
#: Mentions closer than this many code points are neighbours of the chain.
NEAR = 60
ROUNDS, DAMPING = 10, 0.3
#: A mention gets a label if its marginal reaches this.
CONFIDENT = 0.7

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match cannot begin inside a run of digits whose beginning failed, so runs are tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|@)\x20?"
    r"[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)*+"
)
_LOOSE_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|,|\.)[0-9]{1,3}){3}(?![0-9])")
_LOOSE_NUMBER = re.compile(r"(?<![0-9])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
_WORDS_BEFORE = re.compile(r"[A-Za-z]+")
#: Words that announce a kind.
_CUES = {
    "email": {"email", "mail", "contact", "write", "address"},
    "ip": {"ip", "server", "host", "login", "from", "address"},
    "card": {"card", "visa", "credit", "mastercard", "payment"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "whatsapp"},
}


@dataclass
class Mention:
    kind: str | None  # of a base span
    start: int
    end: int
    shape: str
    key: str


def _luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        first = at
        if domain:
            while first > last and text[first - 1] in _LOCAL:
                first -= 1
        if first < at:
            yield first, (last := domain.end())
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; end exclusive, in code points."""
    found = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            found.append(("phone", *m.span()))
    return found


def mentions(text: str) -> list[Mention]:
    """Base spans and looser candidates that overlap none of them, in order."""
    base = base_spans(text)
    out = [Mention(k, a, b, "base", _content(k, text[a:b])) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    loose: list[Mention] = []
    for shape, pattern in (("email", _LOOSE_EMAIL), ("ip", _LOOSE_IP), ("number", _LOOSE_NUMBER)):
        if shape == "email" and not any(s in text for s in ("@", "(at)", "[at]")):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            at = np.searchsorted(starts, b)
            if at and reach[at - 1] > a:
                continue
            loose.append(Mention(None, a, b, shape, _content(shape, m.group())))
    loose.sort(key=lambda m: (m.start, -m.end))
    end = 0
    for m in loose:
        if m.start >= end:
            out.append(m)
            end = m.end
    out.sort(key=lambda m: (m.start, m.end))
    return out


def _content(kind: str, text: str) -> str:
    """What makes two mentions the same entity: a mailbox, or the last digits of a number."""
    if kind == "email":
        plain = text.lower().replace("(at)", "@").replace("[at]", "@").replace(" ", "")
        plain = plain.replace("(dot)", ".").replace("[dot]", ".")
        return "@" + plain
    digits = _digits(text)
    if kind == "ip":
        return "i" + ".".join(re.findall(r"[0-9]+", text))
    return "n" + digits[-7:]


def _features(text: str, m: Mention) -> list[int]:
    """Indices of the features that hold."""
    digits = _digits(text[m.start : m.end])
    shape = {"base": m.kind, "number": "number"}.get(m.shape, m.shape)
    names = [f"shape {shape}", f"digits {min(len(digits), 20)}", "bias"]
    if m.shape == "number" and 16 <= len(digits) <= 19 and _luhn(digits):
        names.append("luhn")
    before = [w.lower() for w in _WORDS_BEFORE.findall(text[max(0, m.start - 40) : m.start])[-3:]]
    names += [f"cue {k}" for k in KINDS if not _CUES[k].isdisjoint(before)]
    return [FEATURE_INDEX[n] for n in names if n in FEATURE_INDEX]


FEATURES = (
    "bias", "luhn", *(f"shape {s}" for s in (*KINDS, "number")), *(f"digits {i}" for i in range(21)),
    *(f"cue {k}" for k in KINDS),
)
FEATURE_INDEX = {n: i for i, n in enumerate(FEATURES)}


def edges(nodes: list[Mention]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between close neighbours; skip edges from each mention to the next alike."""
    chain = [
        (i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1].start - nodes[i].end <= NEAR
    ]
    skip, last = [], {}
    for i, m in enumerate(nodes):
        if m.key in last:
            skip.append((last[m.key], i))
        last[m.key] = i
    return chain, skip


@dataclass
class Weights:
    node: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray


def fitted(texts: list[str], rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> Weights:
    """Weights by pseudo-likelihood.

    Base spans are labelled by their kind.  A looser mention of the same content as a base
    span is labelled like it, any other as none.
    """
    rows, chain_rows, skip_rows, target = [], [], [], []
    n = len(LABELS)
    for text in texts:
        nodes = mentions(text)
        kinds = {m.key: m.kind for m in nodes if m.kind}
        y = [LABELS.index(m.kind or kinds.get(m.key, "none")) for m in nodes]
        around = [np.zeros((len(nodes), n)) for _ in range(2)]
        for counts, pairs in zip(around, edges(nodes)):
            for a, b in pairs:
                counts[a, y[b]] += 1
                counts[b, y[a]] += 1
        for i, m in enumerate(nodes):
            x = np.zeros(len(FEATURES))
            x[_features(text, m)] = 1
            rows.append(x)
        chain_rows.append(around[0])
        skip_rows.append(around[1])
        target += y
    weights = Weights(np.zeros((len(FEATURES), n)), np.zeros((n, n)), 2.0 * np.eye(n))
    if not rows:
        weights.node[FEATURE_INDEX["bias"], 0] = 4.0
        return weights
    x = np.hstack([np.array(rows), np.vstack(chain_rows), np.vstack(skip_rows)])
    y = np.eye(n)[target]
    w = np.vstack([weights.node, weights.chain, weights.skip])
    # Where a class is not seen at all, nothing speaks for it.
    w[: len(FEATURES)] -= 2.0 * (y.sum(axis=0) == 0)
    speed = np.zeros_like(w)
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed + rate * (x.T @ (y - p) / len(x) - ridge * w)
        w += 0.1 * speed
    f = len(FEATURES)
    both = lambda m: (m + m.T) / 2
    return Weights(w[:f], both(w[f : f + n]), both(w[f + n :]))


def marginals(text: str, nodes: list[Mention], weights: Weights) -> np.ndarray:
    """Label probabilities of each node by loopy sum-product message passing."""
    n = len(nodes)
    own = np.array([weights.node[_features(text, m)].sum(axis=0) for m in nodes])
    for i, m in enumerate(nodes):
        if m.kind:
            own[i] = np.where(np.arange(len(LABELS)) == LABELS.index(m.kind), 0.0, -1e3)
    chain, skip = edges(nodes)
    pairs = np.array(chain + skip, np.int64).reshape(-1, 2)
    pots = np.array([weights.chain] * len(chain) + [weights.skip] * len(skip))
    belief = own.copy()
    if len(pairs):
        source = np.concatenate([pairs[:, 0], pairs[:, 1]])
        goal = np.concatenate([pairs[:, 1], pairs[:, 0]])
        pots = np.concatenate([pots, pots.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        messages = np.zeros((len(source), len(LABELS)))
        for _ in range(ROUNDS):
            out = belief[source] - messages[back]
            new = np.logaddexp.reduce(out[:, :, None] + pots, axis=1)
            new -= new.max(axis=1, keepdims=True)
            messages = DAMPING * messages + (1 - DAMPING) * new
            belief = own.copy()
            np.add.at(belief, goal, messages)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def labelled(text: str, weights: Weights) -> tuple[list[tuple], list[tuple]]:
    """(base, added) spans: (kind, start, end, probability)."""
    nodes = mentions(text)
    base = [(k, a, b, 1.0) for k, a, b in base_spans(text)]
    added = []
    if any(m.kind is None for m in nodes):
        for m, p in zip(nodes, marginals(text, nodes, weights)):
            best = int(p[1:].argmax()) + 1
            if m.kind is None and p[best] >= CONFIDENT:
                added.append((LABELS[best], m.start, m.end, float(p[best])))
    return base, added


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                   ("probability", pa.float64()), ("base", pa.bool_())])


def _span_rows(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base, added = labelled(text, weights)
                spans = [(*s, True) for s in base] + [(*s, False) for s in added]
                spans.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
                out.append([dict(zip(("kind", "start", "end", "probability", "base"), s)) for s in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.list_(_SPAN))], ["doc_id", "spans"]
            )

    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans array<kind, start, end, probability, base>.

    Spans are sorted by kind (email, ip, card, phone), then start; positions are code points,
    end exclusive.  base tells the patterns' spans from those that the random field adds; an
    added span overlaps no base span.  Null text counts as empty and has none; null and
    repeated doc_ids are handled row by row; other columns are ignored; empty input gives no
    rows.  Weights are fitted on FIT_ROWS documents with digits or @; without any, nothing is
    added.
    """
    rows = id_and_text(docs, id_col, text_col)
    sample = (
        rows.where(F.col("text").rlike(r"@|[0-9]{3}") & (F.length("text") <= FIT_LENGTH))
        .orderBy(F.xxhash64("doc_id"), "doc_id", F.length("text"))
        .limit(FIT_ROWS)
        .select("text")
        .toPandas()
    )
    weights = fitted(sample["text"].tolist())
    return rows.mapInArrow(
        _span_rows(weights),
        "doc_id long, spans array<struct<kind:string,start:long,end:long,probability:double,base:boolean>>",
    )


def span_digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans per kind, SHA-256 of the base spans, all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    kinds = F.transform(base, lambda s: s["kind"])
    return found.select(
        "doc_id",
        *(
            (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}")
            for k in KINDS
        ),
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


"""Language by rank-order profiles of n-grams.

A profile lists the most frequent n-grams (one to five characters) of a language's training
texts, most frequent first.  A document's own n-grams are ranked the same way, and its distance
to a language adds up how far each of them stands out of its place there; an n-gram that the
profile lacks counts as the whole length of a profile.  The language at the least distance wins.

Texts become letters (lower case, with their marks) and single blanks, so an n-gram never spans
two words; a blank before and after a word belongs to it.  Equal counts are ranked by a fixed
hash of the n-gram, which favours no alphabet.  Texts are read in runs, profiles are added up
task by task, and only profiles travel to the tasks: LANGUAGES_AT_ONCE times RANKS n-grams.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from factloom.llm.common import written

#: Length of a profile.
RANKS = 300
LONGEST = 5
#: Profiles that the documents are compared with in one pass.
LANGUAGES_AT_ONCE = 256
#: Code points of a text that are counted at once.
AT_ONCE = 1 << 19
#: Distinct n-grams of training texts that a task holds before it hands them on.
HELD = 1 << 20
UNKNOWN = "und"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.uint32(32)
_GRAMS = "lang string, gram string, tie long, n long"


@cache
def _characters() -> np.ndarray:
    """For every code point its lower case, or a blank for all but letters and marks."""
    table = np.full(0x110000, _BLANK, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _runs(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, int]]:
    """(codes, n): codes of all texts with single blanks, run by run; the first n only lend context."""
    tail = np.array([_BLANK])
    for text in texts:
        ends = [*range(AT_ONCE, len(text), AT_ONCE), len(text)]
        for from_, upto in zip([0, *ends], ends):
            run = text[from_:upto] + " " * (upto == len(text))
            codes = _characters()[np.frombuffer(run.encode("utf-32-le", "surrogatepass"), np.uint32)]
            blank = codes == _BLANK
            again = blank & np.r_[tail[-1] == _BLANK, blank[:-1]]
            codes = np.concatenate([tail, codes[~again]])
            yield codes, len(tail)
            tail = codes[1 - LONGEST :]


def _hashes(codes: np.ndarray, known: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, hashes) of all n-grams that end past the first `known` codes."""
    wide = codes.astype(np.uint64)
    blank = codes == _BLANK
    h, broken = wide, blank
    for n in range(1, min(LONGEST, len(codes)) + 1):
        if n > 1:
            h = h[:-1] * _BASE + wide[n - 1 :]
            # A blank may only be the first or the last character.
            broken = np.zeros(len(h), bool) if n == 2 else broken[:-1] | blank[n - 2 : -1]
        places = np.flatnonzero(~broken)
        places = places[np.searchsorted(places, known - n + 1) :]
        yield n, places, h[places] * _BASE + np.uint64(n)


class Counts:
    """Distinct n-grams by rising hash, with their counts and, if asked for, their texts."""

    def __init__(self, with_texts: bool = False):
        self.hashes, self.n = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.texts = np.empty(0, f"<U{LONGEST}") if with_texts else None

    def add(self, texts: Iterable[str]) -> Counts:
        for codes, known in _runs(texts):
            found = list(_hashes(codes, known))
            hashes = np.concatenate([h for _, _, h in found])
            if self.texts is None:
                self._merge(*np.unique(hashes, return_counts=True))
                continue
            distinct, n = np.unique(hashes, return_counts=True)
            texts = np.zeros(len(distinct), f"<U{LONGEST}")
            fresh = np.flatnonzero(~np.isin(distinct, self.hashes, assume_unique=True))
            at = _a_place_of(distinct[fresh], hashes)
            length = np.concatenate([np.full(len(p), n, np.int8) for n, p, _ in found])[at]
            places = np.concatenate([p for _, p, _ in found])[at]
            step = np.arange(LONGEST)
            spelled = codes[np.minimum(places[:, None] + step, len(codes) - 1)]
            spelled = np.where(step < length[:, None], spelled, 0).astype(np.uint32)
            texts[fresh] = spelled.view(f"<U{LONGEST}").ravel()
            self._merge(distinct, n, texts)
        return self

    def _merge(self, hashes: np.ndarray, n: np.ndarray, texts: np.ndarray | None = None) -> None:
        if not len(self.hashes):
            self.hashes, self.n, self.texts = hashes, n, texts
            return
        both = np.concatenate([self.hashes, hashes])
        order = np.argsort(both, kind="stable")
        both = both[order]
        starts = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.empty(0, np.int64)
        self.hashes = both[starts]
        self.n = np.add.reduceat(np.concatenate([self.n, n])[order], starts) if len(both) else n
        if texts is not None:
            self.texts = np.concatenate([self.texts, texts])[order[starts]]

    def first(self, k: int) -> np.ndarray:
        """Hashes of the k most frequent, in that order."""
        n = self.n
        if len(n) > k:
            enough = np.flatnonzero(n >= np.partition(n, -k)[-k])
        else:
            enough = np.arange(len(n))
        return self.hashes[enough[np.argsort(-n[enough], kind="stable")][:k]]


def _a_place_of(wanted: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each of some sorted hashes, a place where it stands among many."""
    seen = np.zeros(1 << 20, bool)
    seen[wanted >> np.uint64(44)] = True
    likely = np.flatnonzero(seen[hashes >> np.uint64(44)])
    at = np.minimum(np.searchsorted(wanted, hashes[likely]), max(len(wanted) - 1, 0))
    right = wanted[at] == hashes[likely] if len(wanted) else np.zeros(0, bool)
    places = np.zeros(len(wanted), np.int64)
    places[at[right]] = likely[right]
    return places


def gram_hashes(grams: Iterable[str]) -> np.ndarray:
    """The hash of each n-gram, as in `Counts`."""
    out = []
    for gram in grams:
        h = 0
        for c in gram:
            h = h * int(_BASE) + ord(c)
        out.append((h * int(_BASE) + len(gram)) % (1 << 64))
    return np.array(out, np.uint64)


def _training_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counts] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            columns = [
                pa.array([lang] * len(c.n), pa.string()),
                pa.array(c.texts, pa.string()),
                # As signed numbers, in the same order.
                pa.array((c.hashes ^ np.uint64(1 << 63)).view(np.int64)),
                pa.array(c.n, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "tie", "n"])
        counts.clear()

    for batch in batches:
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            texts.setdefault(lang, []).append(text)
        for lang, some in texts.items():
            # Texts are joined, as a blank ends each of them anyway.
            for part in _parts(some):
                counts.setdefault(lang, Counts(with_texts=True)).add([part])
        if sum(len(c.n) for c in counts.values()) > HELD:
            yield from flushed()
    yield from flushed()


def _parts(texts: list[str]) -> Iterator[str]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= AT_ONCE:
            yield " ".join(held)
            held, size = [], 0
    yield " ".join(held)


def profiles(training: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(lang, rank, gram, n): the most frequent n-grams of each language, from (lang, text)."""
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "tie", "gram")
    return (
        training.select("lang", "text")
        .mapInArrow(_training_grams, _GRAMS)
        .groupBy("lang", "gram", "tie")
        .agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= ranks)
        .select("lang", "rank", "gram", "n")
    )


class Profiles:
    """Places of the n-grams of some languages: one row per n-gram, one column per language."""

    def __init__(self, rows: Iterable[tuple[str, int, str]], ranks: int):
        rows = list(rows)
        self.langs = sorted({lang for lang, _, _ in rows})
        self.ranks = ranks
        hashes = gram_hashes(gram for _, _, gram in rows)
        self.hashes, at = np.unique(hashes, return_inverse=True)
        self.places = np.full((len(self.hashes) + 1, len(self.langs)), -1, np.int64)
        column = {lang: i for i, lang in enumerate(self.langs)}
        self.places[at, [column[lang] for lang, _, _ in rows]] = [rank - 1 for _, rank, _ in rows]

    def distances(self, grams: np.ndarray) -> np.ndarray:
        """How far the n-grams, most frequent first, stand out of place in each language."""
        at = np.minimum(np.searchsorted(self.hashes, grams), len(self.hashes) - 1)
        places = self.places[np.where(self.hashes[at] == grams, at, -1)]
        apart = np.abs(places - np.arange(len(grams))[:, None])
        return np.where(places < 0, self.ranks, apart).sum(axis=0)


def _compared(known: Profiles):
    """Adds the languages of one block: (..., lang_pred, best, second, most), distances as integers."""

    def judged(text: str, pred, best, second, most):
        if not any(map(str.isalpha, text)):
            return None, None, None, None
        grams = Counts().add([text]).first(known.ranks)
        for lang, distance in zip(known.langs, known.distances(grams).tolist()):
            if best is None or distance < best:
                pred, best, second = lang, distance, best
            elif second is None or distance < second:
                second = distance
        return pred, best, second, len(grams) * known.ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("text", "lang_pred", "best", "second", "most")]
            found = list(zip(*(judged(*row) for row in zip(*columns)))) or [[]] * 4
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            kept = [batch[c] for c in ("doc_id", "held_out", "text")]
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array(c, t) for c, t in zip(found, types)], schema=batch.schema
            )

    return run


def predicted_languages(
    docs: DataFrame,
    folds: int = 4,
    fold: int = 2,
    ranks: int = RANKS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per input row.

    Documents whose crc32(doc_id as text) mod `folds` is `fold` are held out; profiles come from
    the whole texts of the others that have a language.  score is s / (b + s) of the least
    distance b and the next one s (the largest possible, if there is one language): 0.5 where
    two languages fit equally, 1 where the text's ranks are the language's.

    Text without a letter, null and empty text, and any text if no language was learned: `und`
    with score 0.  Equal distances go to the smaller language.  A null doc_id hashes as empty
    text and trains.  Repeated rows train and are judged each.  Long texts are counted whole, in
    runs.  Empty input gives no rows; other columns are ignored.
    """
    remainder = F.crc32(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))) % folds
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    training = docs.where((remainder != fold) & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), text.alias("text")
    )
    learned = written(
        profiles(training, ranks).withColumn(
            "block",
            F.floor((F.dense_rank().over(Window.orderBy("lang")) - 1) / LANGUAGES_AT_ONCE),
        ),
        "language-profiles",
    )
    blocks = learned.agg(F.max("block")).first()[0]
    nothing = {"lang_pred": "string", "best": "long", "second": "long", "most": "long"}
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (remainder == fold).alias("held_out"),
        text.alias("text"),
        *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()],
    )
    for block in range(0 if blocks is None else blocks + 1):
        if block:
            rows = written(rows, "languages-so-far")
        # At most LANGUAGES_AT_ONCE times `ranks` rows.
        some = learned.where(F.col("block") == block).select("lang", "rank", "gram").collect()
        rows = rows.mapInArrow(_compared(Profiles(some, ranks)), rows.schema)
    second = F.coalesce("second", "most")
    return rows.select(
        "doc_id",
        "held_out",
        F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("best").isNull(), 0.0).otherwise(
            F.coalesce(F.try_divide(second, F.col("best") + second), F.lit(0.5))
        ).alias("score"),
    )

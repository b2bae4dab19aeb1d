"""Vector best-fit packing of token sequences into bins of several capacities.

Every document becomes token ids; only documents longer than a sequence are cut.  A piece
uses tokens, one document slot and attention cost (the square of its length).  Pieces are
dealt evenly over tasks; inside a task they are placed longest first into the open bin that
a score over all residual capacities prefers, among the bins in which every constraint holds.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import id_and_text, slices, written

#: Pieces that one task packs; more pieces mean more tasks.
PIECES_PER_TASK = 8192
#: Parts of words whose ids a task remembers; those that did not come again in the last half are forgotten.
REMEMBERED_WORDS = 1 << 19
#: New words that the model is handed at once.
WORDS_AT_ONCE = 20_000


#: Marks that end a word without joining it: their run is tokenized on its own.
_MARKS = b".,;:!?*%$#&|"
#: a-z and the lower-case letters of Latin-1: composed, and not changed by lower-casing.
_PLAIN_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
#: These in both cases.  The capitals of Latin-1 have one lower-case letter each, of Latin-1 as well.
_LETTERS = _PLAIN_LETTERS + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
_PLAIN_WORD = f"^[{_LETTERS}]+[{_MARKS.decode()}]*$"


def _gathered(table: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The entries `which` of a table of entries of some lengths, one after another."""
    first, n = np.cumsum(lengths) - lengths, lengths[which]
    return table[np.repeat(first[which] - np.cumsum(n) + n, n) + np.arange(n.sum())]


class WordTokens:
    """Ids of white-space-free words as little-endian 32-bit bytes, remembered by their parts.

    The vocabulary's pre-tokenizer never joins characters across white space, nor a letter or
    digit with marks after it, and lower-cases; so the ids of a text are those of its words in
    order, and only the stem of a new word needs the tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        #: For words of plain letters, which normalizing and splitting leave as they are.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        if not suffix:
            raise ValueError("the vocabulary's tokens have to tell where a word ends")
        #: Whether a token ends a word.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.parts: dict[bytes, bytes] = {b"": b""}
        #: What was remembered before, for parts that come again.
        self.earlier: dict[bytes, bytes] = {}

    @property
    def words(self) -> dict[bytes, bytes]:
        """Words without marks are parts themselves."""
        return self.parts

    @staticmethod
    def _split(word: bytes) -> tuple[bytes, bytes]:
        if word.isalnum():
            return word.lower(), b""
        stem = word.rstrip(_MARKS)
        if not stem:
            return word, b""
        last = stem[-1:] if stem[-1] < 128 else stem.decode("utf-8")[-1]
        if len(stem) < len(word) and not last.isalnum():
            stem = word
        # A special token is written with <, and only in lower case.
        same = stem.lower() if stem.isascii() and b"<" not in stem else stem
        return same, word[len(stem) :]

    @staticmethod
    def _stems_and_marks(words: pa.Array) -> pa.Array:
        """The stem of each word, then the marks of each; words of plain letters are split as columns."""
        plain = pc.match_substring_regex(words, _PLAIN_WORD)
        letters = words.filter(plain)
        others = words.filter(pc.invert(plain)).cast(pa.binary()).to_numpy(zero_copy_only=False)
        other_stems, other_marks = zip(*map(WordTokens._split, others)) if len(others) else ((), ())
        stems = pc.utf8_lower(pc.ascii_rtrim(letters, characters=_MARKS.decode()))
        marks = pc.utf8_ltrim(letters, characters=_LETTERS)
        # Where a word's parts are among those of plain words and of others.
        at = np.empty(len(words), np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        at[is_plain], at[~is_plain] = np.arange(len(letters)), np.arange(len(letters), len(words))
        return pa.concat_arrays([
            pa.concat_arrays([a.cast(pa.binary()), pa.array(b, pa.binary())]).take(pa.array(at))
            for a, b in ((stems, other_stems), (marks, other_marks))
        ])

    def _learn(self, parts: list[bytes]) -> None:
        """Parts of plain letters need the model only, all others the whole tokenizer."""
        plain, other = [], []
        for part in parts:
            text = part.decode("utf-8")
            (other if text.strip(_PLAIN_LETTERS) else plain).append((part, text))
        found = self.tokenizer.encode_batch_fast([text for _, text in other], add_special_tokens=False)
        self.parts.update((part, array("I", e.ids).tobytes()) for (part, _), e in zip(other, found))
        for a in range(0, len(plain), WORDS_AT_ONCE):
            some = plain[a : a + WORDS_AT_ONCE]
            line = " ".join([text for _, text in some])
            ids = np.array(self.plain.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            data, ends = ids.tobytes(), 4 * (np.flatnonzero(self.ends[ids]) + 1)
            at = 0
            for (part, _), end in zip(some, ends.tolist(), strict=True):
                self.parts[part] = data[at:end]
                at = end

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for a, b in slices(texts):
            yield from self._encoded(texts[a:b])

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        """A word that comes more than once is looked up once, its ids are copied as columns."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = split.flatten().dictionary_encode()
        parts = self._stems_and_marks(words.dictionary.cast(pa.large_string())).dictionary_encode()
        own = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.parts) >= REMEMBERED_WORDS // 2:
            self.earlier, self.parts = self.parts, {b"": b""}
        unseen = [p for p in own if p not in self.parts]
        again = [p for p in unseen if p in self.earlier]
        self.parts.update((p, self.earlier[p]) for p in again)
        self._learn([p for p in unseen if p not in self.parts])
        ids = [self.parts[p] for p in own]
        table, lengths = np.frombuffer(b"".join(ids), "<u4"), np.array([len(i) // 4 for i in ids], np.int64)
        which = parts.indices.to_numpy().reshape(2, -1).T.ravel()
        table, lengths = _gathered(table, lengths, which), lengths[which].reshape(-1, 2).sum(axis=1)
        which = words.indices.to_numpy()
        data = _gathered(table, lengths, which).tobytes()
        ends = 4 * np.concatenate([[0], np.cumsum(lengths[which])])[split.offsets.to_numpy()]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield data[a:b]


_remembered: dict[str, WordTokens] = {}


def words_of(path: str) -> WordTokens:
    """One memory per Python worker, which serves many tasks."""
    if path not in _remembered:
        _remembered[path] = WordTokens(path)
    return _remembered[path]


def _pieces(tokenizer_path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer_path)
        end = np.array([0], "<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            ids = []
            texts = batch.column("text").to_pylist()
            for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), words.encode(texts)):
                data = tokens + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(piece)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            columns = [
                pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()),
                *(pa.array(out[n], pa.int64()) for n in ("start", "length", "ids_crc32")),
            ]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [*out, *["ids"] * with_ids])

    return run


def best_fit(
    lengths: np.ndarray,
    capacity: int,
    max_documents: int,
    max_attention: float,
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1),
    rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length.

    Longest first.  Among open bins that can take the piece under all three constraints,
    `norm` takes the one whose weighted residual vector is shortest after placement, `dot`
    the one whose residual vector has the largest weighted dot product with the piece; ties
    go to the oldest bin.  Capacities are scaled to 1.
    """
    n = len(lengths)
    scale = np.array([capacity, max_documents, max_attention], float)
    need = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], axis=1) / scale
    w = np.array(weights)
    left = np.empty((n, 3))
    used = np.zeros(n, np.int64)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    open_bins = np.empty(n, np.int64)
    n_open = n_bins = 0
    smallest = lengths.min(initial=capacity) / capacity
    for i in np.argsort(-lengths, kind="stable"):
        rest = left[:n_open] - need[i]
        fits = np.flatnonzero((rest >= -1e-9).all(axis=1))
        if len(fits):
            if rule == "norm":
                at = fits[np.argmin((w * rest[fits] ** 2).sum(axis=1))]
            else:
                at = fits[np.argmax((w * left[fits] * need[i]).sum(axis=1))]
        else:
            at, open_bins[n_open], left[n_open] = n_open, n_bins, 1.0
            n_open, n_bins = n_open + 1, n_bins + 1
        b = open_bins[at]
        bins[i], offsets[i] = b, used[b]
        used[b] += lengths[i]
        left[at] -= need[i]
        if left[at, 0] < smallest - 1e-9 or left[at, 1] < 0.5 / max_documents:
            # Closed: nothing fits any more.  Later bins move up so that ages stay in order.
            left[at : n_open - 1] = left[at + 1 : n_open]
            open_bins[at : n_open - 1] = open_bins[at + 1 : n_open]
            n_open -= 1
    return bins, offsets


def _packed(capacity: int, max_documents: int, max_attention: float, weights, rule: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        part = pd.concat(parts, ignore_index=True)
        bins, offsets = best_fit(
            part["length"].to_numpy(), capacity, max_documents, max_attention, weights, rule
        )
        part["sequence_id"] = (TaskContext.get().partitionId() << 32) + bins
        part["offset"] = offsets
        yield part

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    max_documents: int | None = None,
    max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1),
    rule: str = "norm",
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids], sequence_id, offset.

    Capacities that are not given cannot bind: `capacity` documents and capacity squared of
    attention cost per sequence.  Null text counts as empty and gives one piece with the end
    token; null and repeated doc_ids keep one set of pieces per row; empty input gives no
    rows; other columns are ignored.  A piece that is longer than the attention cost allows
    raises ValueError before anything runs (capacity squared must be within max_attention).

    `PIECES_PER_TASK` bounds what one task holds; the loss is at most about one partly filled
    sequence per task.
    """
    max_documents = max_documents or capacity
    max_attention = max_attention or float(capacity) ** 2
    if max_attention < float(capacity) ** 2:
        raise ValueError("max_attention must allow one full sequence: capacity ** 2")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" if with_ids else ""
    pieces = written(
        id_and_text(docs, id_col, text_col).mapInArrow(
            _pieces(tokenizer_path, capacity, with_ids), schema
        ),
        "pieces",
    )
    tasks = max(1, -(-pieces.count() // PIECES_PER_TASK))
    return pieces.repartition(tasks).mapInPandas(
        _packed(capacity, max_documents, max_attention, weights, rule),
        schema + ", sequence_id long, offset long",
    )

"""Language-model scores from a weighted backoff automaton.

A context that the training documents hold is a state; a state's arc for a word carries the
smoothed probability, and its failure arc leads to the state of the context without its
oldest word, weighted by what smoothing leaves for words without an arc:

    p(w | h) = (c(hw) + K * p(w | h without its oldest word)) / (c(h) + K)

down to p(w) = (c(w) + 1) / (N + V + 1).  So an arc weighs p(w | h) and a failure arc
K / (c(h) + K); probabilities of all words and the unknown one add up to 1 in every state.
A text is scored in one pass from left to right that carries the state.

The automaton grows with the corpus and is never held whole.  Texts are worked on in blocks
of bounded length.  A block names its distinct n-grams once and gets back their counts in all
training documents: the part of the automaton that its texts can reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import chained, word_hashes, written

#: Neighbouring rows of a file split are scored together until they hold so many code points.
BLOCK_CHARS = 1 << 23
#: Tokens that one lane of the traversal walks; long texts take several lanes.
LANE = 256
#: Code points of text whose n-gram counts one group adds up, on average.
CHARS_PER_GROUP = 24_000_000
#: K above: how many tokens of evidence the shorter context counts for.
STRENGTH = 20.0
START = np.uint64(xxhash.xxh3_64_intdigest(b"start of text"))
END = np.uint64(xxhash.xxh3_64_intdigest(b"end of text"))


class BlockGrams:
    """Distinct n-grams of the texts of a block, per order, and where they occur."""

    def __init__(self, texts: list[str], order: int):
        words, counts = word_hashes(texts)
        # Each text becomes: start, its words, end.
        self.n_tokens = counts + 1
        self.lengths = counts + 2
        self.first = np.cumsum(self.lengths) - self.lengths
        total = int(self.lengths.sum())
        tokens = np.empty(total, np.uint64)
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), self.lengths)
        self.place = (np.arange(total) - self.first[self.owner]).astype(np.int32)
        is_start = self.place == 0
        is_end = self.place == self.lengths[self.owner] - 1
        tokens[is_start], tokens[is_end] = START, END
        tokens[~is_start & ~is_end] = words
        self.scored = ~is_start
        self.grams: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        h = tokens
        for k in range(1, order + 1):
            if k > 1:
                h = chained(np.concatenate([h[:1], h[:-1]]), tokens)
            whole = self.place >= k - 1
            distinct, back = np.unique(h[whole], return_inverse=True)
            at = np.full(total, -1, np.int32)
            at[whole] = back
            self.grams.append(distinct)
            self.at.append(at)

    def counts(self, training: np.ndarray) -> Iterator[np.ndarray]:
        for distinct, at in zip(self.grams, self.at):
            yield np.bincount(at[(at >= 0) & training[self.owner]], minlength=len(distinct))

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner[self.scored], values[self.scored], len(self.n_tokens))


class Automaton:
    """The part of the automaton that a block's texts can reach.

    A state is (k, i): the i-th of the block's k-grams, if the training documents hold it, and
    (0, 0) is the root.  The arc of a state for a word leads over the (k+1)-gram that both make.
    """

    def __init__(
        self, texts: BlockGrams, totals: list[np.ndarray], tokens: int, vocabulary: int, strength: float
    ):
        self.texts, self.order = texts, len(totals)
        p = (totals[0] + 1.0) / (tokens + vocabulary + 1.0)
        #: log10 weight of each gram's arc, by order; the root has one for every word.
        self.arcs = [np.log10(p)]
        #: log10 weight of each state's failure arc, by number of its words.
        self.failures = [np.zeros(1)]
        self.known = [t > 0 for t in totals]
        for k in range(2, self.order + 1):
            where = np.flatnonzero(texts.at[k - 1] >= 0)
            sample = np.zeros(len(texts.grams[k - 1]), np.int64)
            sample[texts.at[k - 1][where]] = where  # one place of each gram
            shorter, context = texts.at[k - 2][sample], texts.at[k - 2][sample - 1]
            seen = totals[k - 2][context]
            p = (totals[k - 1] + strength * p[shorter]) / (seen + strength)
            self.arcs.append(np.log10(p))
            self.failures.append(np.log10(strength / (totals[k - 2] + strength)))

    def _lanes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first token, skipped, tokens) of each lane, those with most tokens first.

        A lane inside a text begins order - 1 tokens early, at the root: a state has no more
        words than that, so its first own token is met in the state of the whole text.
        """
        lengths = self.texts.lengths - 1
        cuts = -(-lengths // LANE)
        text = np.repeat(np.arange(len(lengths)), cuts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = nth * LANE
        early = np.minimum(begin, self.order - 1)
        size = np.minimum(lengths[text] - begin, LANE) + early
        by_size = np.argsort(-size, kind="stable")
        first = self.texts.first[text] + 1 + begin - early
        return text[by_size], first[by_size], early[by_size], size[by_size]

    def scores(self) -> np.ndarray:
        """log10 probability of each text: all lanes go one token to the right at a time."""
        text, first, early, size = self._lanes()
        total = np.zeros(len(text))
        # The number of words and the gram of each lane's state.
        words = np.zeros(len(text), np.int64)
        state = np.zeros(len(text), np.int64)
        if self.order > 1:
            start = self.texts.at[0][first - 1]
            begins = (self.texts.place[first - 1] == 0) & self.known[0][start]
            words[begins], state[begins] = 1, start[begins]
        for step in range(int(size[0]) if len(size) else 0):
            walking = int(np.searchsorted(-size, -step, side="left"))
            self._step(first[:walking] + step, words[:walking], state[:walking], total[:walking])
            total[:walking][early[:walking] > step] = 0.0
        return np.bincount(text, total, len(self.texts.n_tokens))

    def _step(self, at: np.ndarray, words: np.ndarray, state: np.ndarray, total: np.ndarray) -> None:
        """Reads the token at each place of `at`: failure arcs until the state has an arc for it."""
        left = np.arange(len(at))
        for k in range(self.order - 1, -1, -1):
            here = left[words[left] == k]
            gram = self.texts.at[k][at[here]]
            known = self.known[k][gram]
            if k:
                lost = here[~known]
                total[lost] += self.failures[k][state[lost]]
                words[lost] = k - 1
                state[lost] = self.texts.at[k - 2][at[lost] - 1] if k > 1 else 0
                here, gram = here[known], gram[known]
                known = known[known]
            total[here] += self.arcs[k][gram]
            # Into the state of the words read, without the oldest if they are too many.
            longest = min(k + 1, self.order - 1)
            target = gram if longest == k + 1 else self.texts.at[longest - 1][at[here]] if longest else 0
            state[here] = np.where(known, target, 0)
            words[here] = np.where(known, longest, 0) - self.order  # done with this token
        words += self.order


def _packed(values: np.ndarray) -> bytes:
    """Integers byte by byte from the lowest, compressed: high bytes are mostly zeros."""
    width = values.dtype.itemsize
    planes = values.view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    planes = planes.reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _packed_grams(grams: np.ndarray) -> bytes:
    """Sorted hashes, as their differences."""
    return _packed(np.diff(grams, prepend=np.uint64(0)).astype("<u8"))


def _unpacked_grams(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, "<u8"), dtype=np.uint64)


def _numbered(block_chars: int):
    """Adds block: consecutive rows of a file split, closed by the text that fills it.

    Every read of a split gives its rows in the same order, so the numbers are the same too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block, held = None, 0, 0
        for batch in batches:
            sizes = pc.utf8_length(batch.column("text")).to_pylist()
            found = []
            for *split, size in zip(*(batch.column(n).to_pylist() for n in ("file", "split")), sizes):
                if split != current:
                    current, block, held = split, 0, 0
                elif held >= block_chars:
                    block, held = block + 1, 0
                held += size + 2
                found.append(block)
            yield batch.append_column("block", pa.array(found, pa.int64()))

    return run


def _requests(order: int, groups: int, block_chars: int):
    """Rows (part, block, gram_order, first, grams, counts): a block's n-grams, cut by hash range."""

    def rows(block: tuple, texts: list[str], training: list[bool]) -> pa.RecordBatch:
        found = BlockGrams(texts, order)
        edges = np.array([(i << 64) // groups for i in range(1, groups)], np.uint64)
        out: list[tuple] = []
        for k, counts in enumerate(found.counts(np.array(training)), 1):
            grams = found.grams[k - 1]
            cuts = [0, *np.searchsorted(grams, edges).tolist(), len(grams)]
            for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    out.append(
                        (part, *block, k, a, _packed_grams(grams[a:b]), _packed(counts[a:b].astype("<u4")))
                    )
        columns = list(zip(*out))
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(),
                 pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)],
            ["part", "file", "split", "block", "gram_order", "first", "grams", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, texts, training = None, [], []
        for batch in _numbered(block_chars)(batches):
            names = ["file", "split", "block", "text", "training"]
            for *block, text, trains in zip(*(batch.column(n).to_pylist() for n in names)):
                if block != current and texts:
                    yield rows(tuple(current), texts, training)
                    texts, training = [], []
                current = block
                texts.append(text)
                training.append(trains)
        if texts:
            yield rows(tuple(current), texts, training)

    return run


def _added_up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Counts over all blocks for the n-grams of one order in one hash range."""
    grams = [_unpacked_grams(g.as_py()) for g in table["grams"]]
    counts = [_unpacked(c.as_py(), "<u4") for c in table["counts"]]
    distinct, back = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(back, np.concatenate(counts), len(distinct))
    own = np.split(totals[back], np.cumsum([len(g) for g in grams])[:-1])
    known = (totals > 0) & (distinct != START)
    # Scalars of the whole range stand in its first row.
    first = np.arange(len(grams)) == 0
    return pa.table(
        {
            "file": table["file"],
            "split": table["split"],
            "block": table["block"],
            "gram_order": table["gram_order"],
            "first": table["first"],
            "totals": pa.array([_packed(t.astype("<u4")) for t in own], pa.binary()),
            "n_known": pa.array(np.where(first, known.sum(), 0), pa.int64()),
            "n_tokens": pa.array(np.where(first, int(totals[known].sum()), 0), pa.int64()),
        }
    )


def _scored(order: int, tokens: int, vocabulary: int, strength: float):
    def run(key, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        texts = BlockGrams(docs["text"].tolist(), order)
        totals = [np.zeros(len(g)) for g in texts.grams]
        for k, first, data in zip(answers["gram_order"], answers["first"], answers["totals"]):
            part = _unpacked(data, "<u4")
            totals[k - 1][first : first + len(part)] = part
        automaton = Automaton(texts, totals, tokens, vocabulary, strength)
        known = automaton.known[0][texts.at[0]].astype(float)
        return pd.DataFrame(
            {
                "doc_id": docs["doc_id"].astype("Int64"),
                "held_out": ~docs["training"].to_numpy(bool),
                "n_tokens": texts.n_tokens,
                "n_known": texts.per_text(known).astype(np.int64),
                "train_tokens": tokens,
                "base_score": texts.per_text(automaton.arcs[0][texts.at[0]]),
                "score": automaton.scores(),
            }
        )

    return run


def _in_splits(docs: DataFrame, id_col: str, text_col: str, folds: int, fold: int) -> DataFrame:
    """Rows with the file and split they are stored in, the same on every read."""
    number = F.col(id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    remainder = F.crc32(F.coalesce(number.cast("string"), F.lit(""))) % folds
    columns = [
        number.cast("long").alias("doc_id"),
        text.alias("text"),
        (remainder != fold).alias("training"),
    ]
    place = [
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
    ]
    try:
        return docs.select(*columns, *place)
    except AnalysisException:  # not a plain scan: store it first
        stored = written(docs.select(id_col, text_col), "lm-texts")
        return stored.select(*columns, *place)


def scores(
    docs: DataFrame,
    order: int = 3,
    strength: float = STRENGTH,
    folds: int = 7,
    fold: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(doc_id as text) mod `folds` is `fold` are held out; the others train.
    Tokens are words (A-Z lower-cased, split at white space) and one end per text.  base_score
    and score are log10 probabilities of the text under single words and under the automaton.

    Null text counts as empty: one token, the end.  A null doc_id hashes as empty text and
    trains.  Repeated rows train and are scored each.  A very long text closes its block
    and is walked in lanes; a task holds about 20 bytes for each code point of a block.  Without training documents every
    probability is 1.  Empty input gives no rows; other columns are ignored.
    """
    rows = _in_splits(docs, id_col, text_col, folds, fold)
    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    groups = size // CHARS_PER_GROUP + 1
    asked = rows.mapInArrow(
        _requests(order, groups, BLOCK_CHARS),
        "part int, file string, split long, block long, gram_order int, first long, "
        "grams binary, counts binary",
    )
    answers = written(
        asked.groupBy("part", "gram_order").applyInArrow(
            _added_up,
            "file string, split long, block long, gram_order int, first long, totals binary, "
            "n_known long, n_tokens long",
        ),
        "lm-counts",
    )
    known = answers.where("gram_order = 1").agg(
        F.sum("n_known").alias("v"), F.sum("n_tokens").alias("n")
    ).first()
    by = ["file", "split", "block"]
    numbered = rows.mapInArrow(
        _numbered(BLOCK_CHARS),
        "doc_id long, text string, training boolean, file string, split long, block long",
    )
    return numbered.groupBy(*by).cogroup(answers.groupBy(*by)).applyInPandas(
        _scored(order, known["n"] or 0, known["v"] or 0, strength),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )

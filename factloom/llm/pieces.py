"""SentencePiece encoding and decoding as a max-plus parallel scan.

The vocabulary is read as a unigram lattice: the encoding is the segmentation with the largest
sum of piece scores.  A giant text is cut into chunks of fixed length wherever they fall.  The
state at a border is how far the piece that crosses it reaches.  Each chunk yields a matrix of
best scores from every entry state to every exit state; matrices combine associatively under
(max, +), so a tree of groups finds the best state at every border, after which each chunk
traces its own part back independently.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import _power_table, id_and_text, mixed, slices, written

#: Texts with more code points are encoded in chunks.
CHUNK = 16_384
#: Code points worked on at once.
AT_ONCE = 1 << 20
#: Matrices that one group multiplies.
GROUP = 64
SPACE = "▁"
#: Scores are counted in these units, so that of equal scores the fewest pieces win.
UNIT = 1 << 20
NEVER = np.int64(-(1 << 62))
_BITS = 22


class Lattice:
    """Pieces of a SentencePiece vocabulary with their weights."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [
            i for i in range(size)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self.byte_ids = {
            int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)
        }
        self.unknown_id = model.unk_id()
        scores = {i: model.get_score(i) for i in plain}
        # Runs of spaces carry a placeholder instead of a score; they rank last.
        floor = min(s for s in scores.values() if s > -1e8) - 1
        self.scores = {i: max(s, floor) for i, s in scores.items()}
        self.unknown_score = min(self.scores.values()) - 10
        self.weight = {self.pieces[i]: (self._units(s), i) for i, s in self.scores.items()}
        self.unknown_weight = self._units(self.unknown_score)
        self.longest = max(map(len, self.weight))
        inner = {c for p in self.weight if len(p) > 1 for c in p}
        #: Characters of no longer piece: always pieces of their own.
        self.lone = np.array([ord(c) for c in "\n\t\r" if c not in inner], np.uint32)
        # A space only begins a piece, so a text falls apart before every run of spaces.
        self.by_words = not any(SPACE in p[1:] for p in self.weight if p.strip(SPACE))
        hashes = np.array([self._hash(p) for p in self.weight], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        entries = list(self.weight.values())
        self.weights = np.array([entries[i][0] for i in order], np.int64)
        self.ids = np.array([entries[i][1] for i in order], np.int64)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        single = {ord(p): w for p, w in self.weight.items() if len(p) == 1}
        self.single = single

    @staticmethod
    def _units(score: float) -> int:
        return round(score * UNIT) - 1

    @staticmethod
    def _hash(piece: str) -> int:
        sums = _sums(np.frombuffer(piece.encode("utf-32-le"), np.uint32))
        return int(_spans(sums, np.array([0]), np.array([len(piece)]))[0])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, entry): positions of `hashes` that are pieces, and their row in the tables."""
        which = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        entry = np.minimum(np.searchsorted(self.hashes, hashes[which]), len(self.hashes) - 1)
        right = self.hashes[entry] == hashes[which]
        return which[right], entry[right]

    def unit_starts(self, points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """Sorted positions that every segmentation cuts at."""
        cut = np.zeros(len(points), bool)
        cut[text_starts[text_starts < len(points)]] = True
        if self.by_words:
            space = points == ord(SPACE)
            cut[1:] |= space[1:] & ~space[:-1]
        lone = np.isin(points, self.lone)
        cut |= lone
        cut[1:] |= lone[:-1]
        return np.flatnonzero(cut)

    def expanded(self, codes: np.ndarray) -> np.ndarray:
        """Ids, with the bytes of characters that no piece spells (negative code points)."""
        parts, last = [], 0
        for at in np.flatnonzero(codes < 0).tolist():
            parts.append(codes[last:at])
            data = chr(-int(codes[at])).encode("utf-8", "surrogatepass")
            parts.append([self.byte_ids[b] for b in data] if self.byte_ids else [self.unknown_id])
            last = at + 1
        parts.append(codes[last:])
        return np.concatenate(parts).astype(np.int32)

    @cached_property
    def spelling(self) -> list[bytes]:
        """What each id stands for in a text."""
        plain = [p.replace(SPACE, " ").encode("utf-8") for p in self.pieces]
        for b, i in self.byte_ids.items():
            plain[i] = bytes([b])
        return plain

    def decoded(self, ids: np.ndarray, first: bool) -> str:
        """Text of consecutive ids; the space put before a text is taken off again."""
        spelling = self.spelling
        text = b"".join([spelling[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")
        return text[1:] if first else text


def _sums(points: np.ndarray) -> np.ndarray:
    up, _ = _power_table(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mixed(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
    return sums


def _spans(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    _, down = _power_table(len(sums))
    return mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def marked(text: str) -> str:
    """The text as the lattice sees it: a space in front, spaces written as U+2581."""
    return (" " + text).replace(" ", SPACE) if text else ""


def best_units(
    lattice: Lattice, points: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, counts, codes): the best segmentation of each span of `points`.

    All spans move on by one character at a time, so that a step is array work over spans.
    """
    order = np.argsort(starts - ends, kind="stable")
    first, size = starts[order], (ends - starts)[order]
    n = len(first)
    sums = _sums(points)
    base = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if n else np.empty(0, np.int64)
    best = np.full(int((size + 1).sum()), NEVER)
    best[base] = 0
    step, code = np.zeros(len(best), np.int8), np.zeros(len(best), np.int64)
    last = int(size[0]) if n else 0
    for end in range(1, last + 1):
        live = int(np.searchsorted(-size, -end, side="right"))
        at, to = base[:live] + end, first[:live] + end
        # No piece of one character: its bytes.
        top = best[at - 1] + lattice.unknown_weight
        took = np.ones(live, np.int8)
        what = -points[to - 1].astype(np.int64)
        for length in range(min(end, lattice.longest), 0, -1):
            which, entry = lattice.find(_spans(sums, to - length, to))
            value = best[at[which] - length] + lattice.weights[entry]
            # A longer piece was tried before and keeps a tie; bytes give way to any piece.
            wins = (value > top[which]) | ((length == 1) & (what[which] < 0) & (took[which] == 1))
            which, entry, value = which[wins], entry[wins], value[wins]
            top[which], took[which], what[which] = value, length, lattice.ids[entry]
        best[at], step[at], code[at] = top, took, what
    # Trace all spans back together.
    place, found, owner = base + size, [], []
    live = np.arange(n)
    while len(live):
        live = live[place[live] > base[live]]
        found.append(code[place[live]])
        owner.append(live)
        place[live] -= step[place[live]]
    owners = np.concatenate(owner) if owner else np.empty(0, np.int64)
    codes = np.concatenate(found) if found else np.empty(0, np.int64)
    steps = np.repeat(np.arange(len(owner)), [len(o) for o in owner])
    in_order = np.lexsort((-steps, order[owners]))
    counts = np.bincount(order[owners], minlength=n)
    weights = np.empty(n, np.int64)
    weights[order] = best[base + size]
    return weights, counts, codes[in_order]


def encode_marked(lattice: Lattice, texts: list[str]) -> list[tuple[int, np.ndarray]]:
    """(weight, ids) of each text; equal units of the texts are segmented once."""
    lengths = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    text_starts = np.cumsum(lengths) - lengths
    starts = lattice.unit_starts(points, text_starts)
    ends = np.append(starts[1:], len(points)) if len(starts) else starts
    hashes = _spans(_sums(points), starts, ends)
    _, pick, back = np.unique(hashes, return_index=True, return_inverse=True)
    weights, counts, codes = best_units(lattice, points, starts[pick], ends[pick])
    offsets = np.cumsum(counts) - counts
    sizes = counts[back]
    total = np.cumsum(sizes)
    index = np.repeat(offsets[back] - (total - sizes), sizes) + np.arange(int(sizes.sum()))
    all_codes = codes[index]
    bounds = np.searchsorted(starts, np.append(text_starts, len(points)))
    token_ends = np.concatenate([[0], total])
    unit_weights = np.concatenate([[0], np.cumsum(weights[back])])
    out = []
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        part = lattice.expanded(all_codes[token_ends[a] : token_ends[b]])
        out.append((int(unit_weights[b] - unit_weights[a]), part))
    return out


class Chunk:
    """Part [0, size) of a giant text, with the characters that a crossing piece may reach."""

    def __init__(self, lattice: Lattice, text: str, size: int):
        self.lattice, self.text, self.size = lattice, text, size
        self.states = lattice.longest
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        cuts = lattice.unit_starts(points, np.empty(0, np.int64))
        inside = cuts[cuts <= size]
        self.cuts = set(cuts.tolist())
        self.head = int(inside[0]) if len(inside) else None
        self.tail = int(inside[-1]) if len(inside) else None

    def _edges(self, end: int, low: int) -> Iterator[tuple[int, int, int]]:
        """(start, weight, code) of pieces that end at `end`, longest first, bytes last."""
        known = False
        for start in range(max(low, end - self.states), end):
            hit = self.lattice.weight.get(self.text[start:end])
            if hit:
                known |= end - start == 1
                yield start, *hit
        if not known and end - 1 >= low:
            yield end - 1, self.lattice.unknown_weight, -ord(self.text[end - 1])

    def _run(self, low: int, high: int, entry: np.ndarray, limit: int):
        """Best values (rows: cuts low..high; columns: entry states) and pieces taken.

        `entry` holds the values at low..; pieces start before `limit`.
        """
        columns = entry.shape[1]
        best = np.full((high - low + 1, columns), NEVER)
        best[: len(entry)] = entry[: high - low + 1]
        took = np.full((high - low + 1, columns), -1)
        codes = np.zeros((high - low + 1, columns), np.int64)
        floor = low  # no piece reaches over a cut
        for end in range(low + 1, high + 1):
            if end - 1 in self.cuts:
                floor = end - 1
            row = best[end - low]
            for start, weight, code in self._edges(end, floor):
                if start >= limit:
                    continue
                source = best[start - low]
                value = np.where(source > NEVER // 2, source + weight, NEVER)
                wins = value > row
                row[wins] = value[wins]
                took[end - low, wins], codes[end - low, wins] = start, code
        return best, took, codes

    def _entries(self, high: int) -> np.ndarray:
        """One column per entry state d: a path that begins at cut d."""
        n = min(self.states, high + 1)
        entry = np.full((n, self.states), NEVER)
        entry[np.arange(n), np.arange(n)] = 0
        return entry

    def _exit(self, best: np.ndarray, low: int) -> np.ndarray:
        """Rows of cuts size..size+states-1, as far as the text goes."""
        out = np.full((self.states, best.shape[1]), NEVER)
        rows = best[self.size - low : self.size - low + self.states]
        out[: len(rows)] = rows
        return out

    def _high(self) -> int:
        return min(len(self.text), self.size + self.states - 1)

    @property
    def middle(self) -> str:
        """What lies between the first and the last cut; encoded for many chunks together."""
        return "" if self.head is None else self.text[self.head : self.tail]

    def matrix(self, middle: int) -> np.ndarray:
        """[entry state, exit state] of best weights, given the weight of the middle."""
        if self.head is None:
            best, _, _ = self._run(0, self._high(), self._entries(self._high()), self.size)
            return self._exit(best, 0).T
        best, _, _ = self._run(0, self.head, self._entries(self.head), self.head)
        into = best[self.head]
        zero = np.zeros((1, 1), np.int64)
        best, _, _ = self._run(self.tail, self._high(), zero, self.size)
        out = self._exit(best, self.tail)[:, 0]
        both = into[:, None] + out[None, :] + middle
        both[(into <= NEVER // 2)[:, None] | (out <= NEVER // 2)[None, :]] = NEVER
        return both

    @staticmethod
    def _traced(took, codes, low: int, high: int, column: int, stop: int) -> list[int]:
        found, at = [], high
        while at > stop:
            found.append(int(codes[at - low, column]))
            at = int(took[at - low, column])
        return found[::-1]

    def trace(self, entry: int, leave: int, middle: np.ndarray) -> np.ndarray:
        """Ids of the best path from cut `entry` to cut size + `leave`, given those of the middle."""
        end = self.size + leave
        spelled = lambda codes: self.lattice.expanded(np.array(codes, np.int64))
        if self.head is None:
            _, took, codes = self._run(0, self._high(), self._entries(self._high()), self.size)
            return spelled(self._traced(took, codes, 0, end, entry, entry))
        _, took, codes = self._run(0, self.head, self._entries(self.head), self.head)
        into = self._traced(took, codes, 0, self.head, entry, entry)
        _, took, codes = self._run(self.tail, self._high(), np.zeros((1, 1), np.int64), self.size)
        out = self._traced(took, codes, self.tail, end, 0, self.tail)
        return np.concatenate([spelled(into), middle, spelled(out)])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product under (max, +)."""
    sums = a[:, :, None] + b[None, :, :]
    sums[(a <= NEVER // 2)[:, :, None] | (b <= NEVER // 2)[None, :, :]] = NEVER
    return sums.max(axis=1)


def best_states(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """States at all borders, from `entry` to `leave`; of equal ones the smallest."""
    values = [np.full(len(matrices[0]), NEVER)]
    values[0][entry] = 0
    for m in matrices:
        values.append(product(values[-1][None, :], m)[0])
    states = [leave]
    for m, before in zip(matrices[::-1], values[-2::-1]):
        through = np.where(
            (before > NEVER // 2) & (m[:, states[-1]] > NEVER // 2), before + m[:, states[-1]], NEVER
        )
        states.append(int(np.argmax(through)))
    return states[::-1]


_lattices: dict[str, Lattice] = {}


def lattice_of(path: str) -> Lattice:
    """The vocabulary, read once per Python worker."""
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


ENCODED = "doc_id long, chunk int, ids array<int>, score double, text_crc32 long"


def _score(lattice: Lattice, weight: int) -> float:
    """Sum of piece scores: weights are whole units less one per piece."""
    return float(-((-weight) // UNIT)) if weight % UNIT else weight / UNIT


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                upto, held = at, 0
                while upto < len(texts) and (held == 0 or held + len(texts[upto]) < AT_ONCE):
                    held += len(texts[upto]) + 1
                    upto += 1
                part = texts[at:upto]
                found = encode_marked(lattice, [marked(t) for t in part])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, upto - at), pa.array([0] * len(part), pa.int32()),
                     pa.array([codes for _, codes in found], pa.list_(pa.int32())),
                     pa.array([_score(lattice, w) for w, _ in found], pa.float64()),
                     pa.array([_text_crc(t) for t in part], pa.int64())],
                    ["doc_id", "chunk", "ids", "score", "text_crc32"],
                )
                at = upto

    return run


def _text_crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _cut(path: str, chunk: int):
    """Chunk rows with the matrix of each."""
    names = ["key", "doc_id", "chunk", "size", "part", "matrix"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary()]

    def with_matrices(lattice: Lattice, rows: list[tuple]) -> pa.RecordBatch:
        chunks = [Chunk(lattice, part, size) for *_, size, part in rows]
        middles = encode_marked(lattice, [c.middle for c in chunks])
        data = [c.matrix(w).astype("<i8").tobytes() for c, (w, _) in zip(chunks, middles)]
        columns = [*zip(*rows), data]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path)
        ahead = lattice.longest - 1
        rows: list[tuple] = []
        for batch in batches:
            for key, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text"))):
                whole = marked(text)
                for n, at in enumerate(range(0, len(whole), chunk)):
                    size = min(chunk, len(whole) - at)
                    rows.append((key, doc_id, n, size, whole[at : at + size + ahead]))
                    if len(rows) * chunk >= AT_ONCE:
                        yield with_matrices(lattice, rows)
                        rows = []
        if rows:
            yield with_matrices(lattice, rows)

    return run


def _square(data: bytes) -> np.ndarray:
    m = np.frombuffer(data, "<i8")
    return m.reshape(int(len(m) ** 0.5), -1)


def _multiplied(key, group: pd.DataFrame) -> pd.DataFrame:
    total = None
    for data in group.sort_values("chunk")["matrix"]:
        total = _square(data) if total is None else product(total, _square(data))
    return pd.DataFrame({"key": [key[0]], "chunk": [key[1]], "matrix": [total.astype("<i8").tobytes()]})


def _settled(group: pd.DataFrame, entry: int, leave: int) -> pd.DataFrame:
    group = group.sort_values("chunk")
    states = best_states([_square(d) for d in group["matrix"]], entry, leave)
    return pd.DataFrame(
        {"key": group["key"], "chunk": group["chunk"], "entry": states[:-1], "leave": states[1:]}
    )


_STATES = "key long, chunk int, entry int, leave int"


def _border_states(matrices: DataFrame, n_chunks: int) -> DataFrame:
    """(key, chunk, entry, leave) of the best path through each key's matrices."""
    if n_chunks <= GROUP:
        return matrices.groupBy("key").applyInPandas(lambda g: _settled(g, 0, 0), _STATES)
    over = F.floor(F.col("chunk") / GROUP).cast("int")
    products = matrices.groupBy("key", over.alias("over")).applyInPandas(
        _multiplied, "key long, chunk int, matrix binary"
    )
    above = _border_states(products, -(-n_chunks // GROUP))
    return (
        matrices.groupBy("key", over.alias("over"))
        .cogroup(above.groupBy("key", F.col("chunk").alias("over")))
        .applyInPandas(
            lambda g, s: _settled(g, int(s["entry"].iloc[0]), int(s["leave"].iloc[0])), _STATES
        )
    )


def _traced_rows(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = lattice_of(path)
        for frame in frames:
            for a, b in slices(frame["part"].tolist(), AT_ONCE):
                rows = list(frame.iloc[a:b].itertuples())
                chunks = [Chunk(lattice, r.part, r.size) for r in rows]
                middles = encode_marked(lattice, [c.middle for c in chunks])
                out = []
                for r, c, (_, middle) in zip(rows, chunks, middles):
                    text = r.part[r.entry : r.size + r.leave].replace(SPACE, " ")
                    text = text[1:] if r.chunk == 0 else text
                    weight = int(_square(r.matrix)[r.entry, r.leave])
                    ids = c.trace(r.entry, r.leave, middle)
                    out.append((r.doc_id, r.chunk, ids, _score(lattice, weight), _text_crc(text)))
                yield pd.DataFrame(
                    out, columns=["doc_id", "chunk", "ids", "score", "text_crc32"]
                ).astype({"doc_id": "Int64"})

    return run


def encode(
    docs: DataFrame,
    vocabulary: str,
    chunk: int = CHUNK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per chunk: doc_id, chunk, ids, score, text_crc32.

    Texts of up to `chunk` code points are chunk 0; longer ones are cut, and a piece that
    crosses a border belongs to the chunk it begins in.  Ids in order of chunk are the
    segmentation of the whole text with the largest sum of scores, then the fewest pieces.
    Characters without a piece become their bytes.  text_crc32 is of the text a chunk spells.

    Null and empty texts give one chunk without ids; null doc_ids stay null; repeated rows are
    encoded each; other columns are ignored; empty input gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    short = F.length("text") < chunk
    plain = rows.where(short).mapInArrow(_encoded(vocabulary), ENCODED)
    giant = rows.where(~short).select(F.monotonically_increasing_id().alias("key"), "*")
    cut = written(
        giant.mapInArrow(
            _cut(vocabulary, chunk),
            "key long, doc_id long, chunk int, size int, part string, matrix binary",
        ),
        "piece-chunks",
    )
    n_chunks = (cut.agg(F.max("chunk").alias("m")).first()["m"] or 0) + 1
    states = _border_states(cut.select("key", "chunk", "matrix"), n_chunks)
    traced = cut.join(states, ["key", "chunk"]).mapInPandas(_traced_rows(vocabulary), ENCODED)
    return plain.unionByName(traced)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The rows of `encode` with the text that the ids spell, the ids' CRC-32 and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(vocabulary)
        for batch in batches:
            ids = [own.values.to_numpy() for own in batch.column("ids")]
            texts = [lattice.decoded(own, n == 0) for own, n in zip(ids, batch.column("chunk").to_pylist())]
            crc = [zlib.crc32(own.astype("<u4").tobytes()) for own in ids]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "chunk", "score", "text_crc32")),
                 pa.array([len(own) for own in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(texts)],
                ["doc_id", "chunk", "score", "text_crc32", "n_tokens", "ids_crc32", "text"],
            )

    return encoded.mapInArrow(
        run,
        "doc_id long, chunk int, score double, text_crc32 long, n_tokens long, ids_crc32 long, text string",
    )


def with_round_trip(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, chunk, n_tokens, ids_crc32, score, text_crc32, round_trip."""
    return decode(encoded, vocabulary).select(
        "doc_id", "chunk", "n_tokens", "ids_crc32", "score", "text_crc32",
        (F.crc32(F.col("text").cast("binary")) == F.col("text_crc32")).alias("round_trip"),
    )

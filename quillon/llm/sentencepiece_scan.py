"""SentencePiece encoding and decoding: merges between forced boundaries, or a max-plus parallel scan.

The model file says which of the two it was made for. In a file of merges (BPE) the pair of neighbours whose
joined piece has the best score, the leftmost of equals, is joined until none is left. No merge crosses two
characters that no piece has side by side, so stretches between such places are merged on their own and texts
of CHUNK characters or more become rows that end at one. A stretch without such a place is never cut.

In a unigram file a segmentation's worth is the sum of its pieces' scores, and the best one is a longest path. Between two
positions the best worths for all boundary states form a matrix over (max, +); matrices of neighbouring
chunks combine associatively. A state at a cut says how many characters the piece across it reaches beyond.

1. Texts up to CHUNK characters are encoded whole. Longer ones become rows of CHUNK characters, each with the
   few characters after it that a piece may reach into.
2. Every chunk gives its transfer matrix on its own (``transfer``).
3. A document's matrices are combined by a doubling scan; the prefix products' first rows are the best worths
   at all states of all cuts. That is REACH**2 numbers a chunk.
4. With the worths at its left cut, every chunk tells for each state at its right cut from which state at the
   left one the best path comes (``origins``); chaining these from the end fixes the state at each cut.
5. Every chunk is backtraced on its own between its two states, and the pieces are put together again.

Words repeat, so the path between two forced boundaries (before a space that follows another character: no piece
has a space inside) is remembered by its text in bounded tables: as one fills, the one before it is forgotten.

Vocabulary and scores are read from a public model file, whose path is a parameter; scores are used as that
file has them, characters without a piece become their UTF-8 bytes, and ties of paths go to the longer last piece, and so on backwards.
Both are the library's own rules. Files of other kinds, and files of merges with unused or user-defined pieces, are
refused. Decoding is exact.

Defined cases: a null or empty text has no ids. A leading space is put before every other text and taken away again
by decoding. Line ends and tabs are ordinary characters. Other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 14
#: Stretches in each of the two tables of remembered ones, and the longest of them.
MEMO, MEMO_LENGTH = 120_000, 48
SPACE = "▁"
#: What lies between forced boundaries.
STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
NEVER = -1e30
#: What each byte of a character without a piece costs: more than any path of pieces gains.
BYTE_COST = -1e7


class Vocabulary:
    """Pieces with scores, byte pieces, and the longest piece's length."""

    def __init__(self, pieces: list[tuple[str, float, str]]) -> None:
        self.ids: dict[str, tuple[float, int]] = {}
        self.bytes: dict[int, int] = {}
        self.text: list[bytes] = []
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == "byte":
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif kind == "normal":
                self.ids.setdefault(piece, (score, i))
                self.text.append(piece.replace(SPACE, " ").encode())
            else:
                self.text.append(b"")
        self.reach = max(map(len, self.ids), default=1)
        #: No piece has a space after another character, so a space there starts a piece.
        self.bounded = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.memo: dict[str, bytes] = {}
        self.sizes = np.array([len(t) for t in self.text], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.joined = np.frombuffer(b"".join(self.text), np.uint8)

    @cached_property
    def trie(self) -> dict:
        """The pieces as a trie of characters; under "" stands (score, id)."""
        root: dict = {}
        for piece, hit in self.ids.items():
            node = root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = hit
        return root

    def fallback(self, c: str) -> tuple[float, tuple[int, ...]]:
        data = c.replace(SPACE, " ").encode("utf-8", "surrogatepass")
        return BYTE_COST * len(data), tuple(self.bytes[b] for b in data)

    def edges(self, text: str, end: int, low: int) -> Iterator[tuple[int, float, tuple[int, ...]]]:
        """(start, score, ids) of what may end at ``end``, longest first."""
        ids = self.ids
        for start in range(max(low, end - self.reach), end):
            hit = ids.get(text[start:end])
            if hit:
                yield start, hit[0], (hit[1],)
        if text[end - 1] not in ids:
            yield (end - 1, *self.fallback(text[end - 1]))

    def best(self, text: str, begin: int, stop: int, given: np.ndarray | None = None) -> tuple[np.ndarray, list[int]]:
        """Best worths at begin ... stop, and where each one's last piece starts (-1: none). ``given``: worths of
        the first places, which no path from them improves (at a text's start, of its first place); else begin has worth 0."""
        n = stop - begin + 1
        worth, last = np.full(n, NEVER), [-1] * n
        known = 1 if given is None else min(n, int((given > NEVER / 2).sum()))
        worth[:known] = 0.0 if given is None else given[:known]
        for end in range(begin + known, stop + 1):
            for start, score, _ in self.edges(text, end, begin):
                w = worth[start - begin] + score
                if w > worth[end - begin]:
                    worth[end - begin], last[end - begin] = w, start
        return worth, last

    def solved(self, text: str) -> tuple[float, bytes]:
        """Worth and ids, as 32-bit integers, of a whole stretch between boundaries."""
        n, trie = len(text), self.trie
        worth, back = [NEVER] * (n + 1), [None] * (n + 1)
        worth[0] = 0.0
        for start in range(n):  # ascending, so that of equal worths the longer last piece stays
            w, node, at = worth[start], trie, start
            while at < n:
                node = node.get(text[at])
                if node is None:
                    break
                at += 1
                hit = node.get("")
                if hit is not None and w + hit[0] > worth[at]:
                    worth[at], back[at] = w + hit[0], (start, hit[1])
            if text[start] not in self.ids:
                cost, ids = self.fallback(text[start])
                if w + cost > worth[start + 1]:
                    worth[start + 1], back[start + 1] = w + cost, (start, ids)
        out, at = [], n
        while at:
            at, i = back[at]
            out += i[::-1] if isinstance(i, tuple) else (i,)
        return worth[n], array("I", out[::-1]).tobytes()

    def path(self, text: str) -> bytes:
        """The ids of a stretch, remembered if it is short."""
        ids = self.solved(text)[1]
        if len(text) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[text] = ids
        return ids

    def stretches(self, text: str) -> list[str]:
        return STRETCH.findall(text) if self.bounded else [text]

    def forced(self, text: str) -> list[int]:
        """Places inside the text where a piece must start."""
        if not self.bounded:
            return []
        out, at = [], text.find(SPACE, 1)
        while at > 0:
            if text[at - 1] != SPACE:
                out.append(at)
            at = text.find(SPACE, at + 1)
        return out

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers, stretch by stretch."""
        get, path = self.memo.get, self.path
        return b"".join([get(x) or path(x) for x in self.stretches(text)])

    def whole(self, text: str) -> tuple[float, list[int]]:
        """Worth and ids of a text."""
        return sum(self.solved(x)[0] for x in self.stretches(text)) if text else 0.0, array("I", self.packed(text)).tolist() if text else []


class Merges:
    """Encoding by merges over the pieces of a vocabulary."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.scores = {piece: score for piece, (score, _) in v.ids.items()}
        #: Characters that some piece has side by side: merges stay between all others.
        self.inside = {p[i : i + 2] for p in v.ids for i in range(len(p) - 1)}
        self.memo: dict[str, bytes] = {}
        self.past: dict[str, bytes] = {}
        #: New stretches of the texts at hand, see ``packed_all``.
        self.fresh: dict[str, bytes] = {}
        #: Numbers of pieces and of all characters; a piece's number is its id, those of other characters lie above.
        self.numbers = {piece: i for piece, (_, i) in v.ids.items()}
        self.above = len(v.text)
        #: For two neighbours' numbers: the loss of joining them, and the joined piece's id.
        self.losses: dict[int, float] = {}
        self.joins: dict[int, int] = {}
        for piece, (score, i) in v.ids.items():
            for at in range(1, len(piece)):
                a, b = self.number(piece[:at]), self.number(piece[at:])
                if a is not None and b is not None:
                    self.losses[a << 32 | b], self.joins[a << 32 | b] = -score, i

    @cached_property
    def tables(self) -> tuple[np.ndarray, ...]:
        """The pairs of neighbours in ascending order, their losses and joins; the number of each character."""
        pairs = np.array(sorted(self.losses), np.int64)
        chars = np.arange(0x110000, dtype=np.int64) + self.above
        for c, i in self.numbers.items():
            if len(c) == 1:
                chars[ord(c)] = i
        at = pairs.tolist()
        return pairs, np.array([self.losses[k] for k in at]), np.array([self.joins[k] for k in at], np.int64), chars

    def met(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The loss of joining a and b, 1e30 if they don't join, and what they make."""
        pairs, losses, joins, _ = self.tables
        if not len(pairs):
            return np.full(a.shape, 1e30), np.zeros(a.shape, np.int64)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        ok = (pairs[at] == key) & (a >= 0) & (b >= 0)
        return np.where(ok, losses[at], 1e30), joins[at]

    def joined_all(self, texts: list[str]) -> list[bytes]:
        """The ids of short stretches of two characters or more, merged side by side: a row a stretch."""
        sizes = np.array([len(t) for t in texts])
        wide = int(sizes.max())
        parts = np.full((len(texts), wide + 1), -1, np.int64)
        parts[np.arange(wide + 1) < sizes[:, None]] = self.tables[3][np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        losses, _ = self.met(parts[:, :-1], parts[:, 1:])
        column, rows = np.arange(wide + 1), np.arange(len(texts))
        while len(rows):
            p, w = parts[rows], losses[rows]
            at = w.argmin(1)
            r = np.arange(len(rows))
            ok = w[r, at] < 1e30
            rows, p, w, at = rows[ok], p[ok], w[ok], at[ok]
            if not len(rows):
                break
            r = np.arange(len(rows))
            new = self.met(p[r, at], p[r, at + 1])[1]
            p = np.take_along_axis(p, np.minimum(column + (column > at[:, None]), wide), 1)
            p[:, -1], p[r, at] = -1, new
            w = np.take_along_axis(w, np.minimum(column[:-1] + (column[:-1] >= at[:, None]), wide - 1), 1)
            w[:, -1] = 1e30
            w[r, at] = self.met(new, p[r, at + 1])[0]
            left = np.flatnonzero(at > 0)
            w[left, at[left] - 1] = self.met(p[left, at[left] - 1], new[left])[0]
            parts[rows], losses[rows] = p, w
        out, above = [], self.above
        for row, n, odd in zip(parts, (parts >= 0).sum(1).tolist(), (parts.max(1) >= above).tolist(), strict=True):
            ids = row[:n]
            if odd:  # characters without a piece
                ids = [i for x in ids.tolist() for i in ((x,) if x < above else self.v.fallback(chr(x - above))[1])]
            out.append(np.asarray(ids, np.uint32).tobytes())
        return out

    def packed_all(self, texts: list[str]) -> list[bytes]:
        """``packed`` of many texts, whose new stretches are merged together."""
        memo, past = self.memo, self.past
        new = {x for t in texts for x in self.v.stretches(t) if x not in memo and x not in past and 1 < len(x) <= MEMO_LENGTH}
        found = sorted(new, key=len)
        for i in range(0, len(found), 2048):
            part = found[i : i + 2048]
            self.fresh.update(zip(part, self.joined_all(part), strict=True))
        out = [self.packed(t) for t in texts]
        self.fresh = {}
        return out

    def number(self, part: str) -> int | None:
        got = self.numbers.get(part)
        return self.above + ord(part) if got is None and len(part) == 1 else got

    def joined(self, text: str) -> bytes:
        """The ids of a short stretch."""
        numbers, above, get, joins = self.numbers.get, self.above, self.losses.get, self.joins
        parts = [above + ord(c) if (n := numbers(c)) is None else n for c in text]
        losses = [get(a << 32 | b, 1e30) for a, b in zip(parts, parts[1:], strict=False)]
        while losses and (best := min(losses)) < 1e30:
            i = losses.index(best)
            new = parts[i] = joins[parts[i] << 32 | parts[i + 1]]
            del parts[i + 1], losses[i]
            if i:
                losses[i - 1] = get(parts[i - 1] << 32 | new, 1e30)
            if i < len(losses):
                losses[i] = get(new << 32 | parts[i + 1], 1e30)
        if max(parts) >= above:  # characters without a piece
            parts = [i for p in parts for i in ((p,) if p < above else self.v.fallback(chr(p - above))[1])]
        return array("I", parts).tobytes()

    def queued(self, text: str) -> list[str]:
        """The pieces of a stretch of any length: the same merges from a heap over linked parts."""
        get, parts, n = self.scores.get, list(text), len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-s, i, 2) for i in range(n - 1) if (s := get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has been joined to another part since
            parts[i] += parts[j]
            parts[j], after[i] = "", after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (s := get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (-s, a, len(parts[a]) + len(parts[b])))
        return [x for x in parts if x]

    def cut(self, text: str, at: int) -> int:
        """The first place from ``at`` on, or the end, that no merge crosses."""
        while at < len(text) and text[at - 1 : at + 1] in self.inside:
            at += 1
        return min(at, len(text))

    def path(self, text: str) -> bytes:
        """The ids of a stretch, remembered if it is short."""
        if len(text) > MEMO_LENGTH:
            out, at = [], 0
            while at < len(text):
                end = self.cut(text, at + 1)
                part = text[at:end]
                out.append(self.coded(self.queued(part)) if len(part) > MEMO_LENGTH else self.memo.get(part) or self.path(part))
                at = end
            return b"".join(out)
        ids = self.past.get(text) or self.fresh.get(text) or self.joined(text)
        if len(self.memo) >= MEMO:  # what is used again moves on to the new table
            self.memo, self.past = {}, self.memo
        self.memo[text] = ids
        return ids

    def coded(self, parts: list[str]) -> bytes:
        out, get = array("I"), self.v.ids.get
        for x in parts:
            hit = get(x)
            if hit:
                out.append(hit[1])
            else:
                out.extend(self.v.fallback(x)[1])
        return out.tobytes()

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers, stretch by stretch."""
        path = self.path
        return b"".join([self.memo.get(x) or path(x) for x in self.v.stretches(text)])

    def parts(self, text: str, limit: int) -> list[str]:
        """The text cut into parts of ``limit`` characters, or as many more as merges may reach over."""
        out, at = [], 0
        while at < len(text):
            end = self.cut(text, at + limit)
            out.append(text[at:end])
            at = end
        return out


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at, out, shift = at + 1, out | (b & 127) << shift, shift + 7
            if b < 128:
                return out

    at = 0
    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, data[at : at + size]
        at += size


def encoder(path: str) -> Vocabulary | Merges:
    """What encodes as the model file's kind asks for."""
    return _encoder(path)


@cache
def _encoder(path: str) -> Vocabulary | Merges:
    with open(path, "rb") as f:
        model = list(fields(f.read()))
    kind = next((k for n, spec in model if n == 2 for m, k in fields(spec) if m == 3), 1)
    if kind == 1:
        return load(path)
    if kind != 2:
        raise ValueError(f"{path}: neither a unigram nor a merge model")
    if any(m == 3 and x in (4, 5) for n, piece in model if n == 1 for m, x in fields(piece)):
        raise ValueError(f"{path}: unused or user-defined pieces among merges")
    return Merges(load(path))


def load(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file."""
    return _loaded(path)


@cache
def _loaded(path: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
    return Vocabulary([(sp.id_to_piece(i), sp.get_score(i), kinds(i)) for i in range(sp.get_piece_size())])


def escaped(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def decode(v: Vocabulary, ids: list[int]) -> str:
    return b"".join(v.text[i] for i in ids).decode("utf-8", "surrogatepass")[1:]


def decode_all(v: Vocabulary, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The texts of many id lists, flat with offsets, as UTF-8."""
    size = v.sizes[ids]
    end = np.cumsum(size)
    data = v.joined[np.repeat(v.starts[ids] - (end - size), size) + np.arange(end[-1] if len(end) else 0)].tobytes()
    cuts = np.concatenate([[0], end])[at].tolist()
    return [data[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False)]


def id_lists(packed: list[bytes]) -> pa.Array:
    """An Arrow column of packed id lists."""
    at = np.cumsum([0] + [len(b) // 4 for b in packed])
    return common.lists(np.frombuffer(b"".join(packed), np.uint32).astype(np.int32), at, pa.int32())


# ---- chunks


def transfer(v: Vocabulary, text: str, size: int) -> np.ndarray:
    """The matrix of a chunk: text[:size] with what follows. Entry (i, o): the best worth of a path from i to
    size + o; i and o count characters that a piece across the cut reaches over."""
    states = v.reach
    out = np.full((states, states), NEVER)
    cuts = [c for c in v.forced(text[:size]) if c >= states]
    if cuts:
        first, final = cuts[0], cuts[-1]
        middle = v.whole(text[first:final])[0]
        tail = v.best(text, final, min(len(text), size + states - 1))[0]
        ends = np.full(states, NEVER)
        ends[: len(tail) - (size - final)] = tail[size - final :]
        for i in range(states):  # all paths meet at the forced places
            head = v.best(text, i, first)[0][-1]
            out[i] = np.maximum(NEVER, head + middle + ends)
        return out
    for i in range(states):
        if i > size:
            if i - size < states:
                out[i, i - size] = 0.0
            continue
        worth = v.best(text, i, min(len(text), size + states - 1))[0]
        got = worth[size - i :]
        out[i, : len(got)] = got
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of stacks of matrices."""
    return np.maximum(NEVER, (a[..., :, :, None] + b[..., None, :, :]).max(-2))


def worths(matrices: np.ndarray) -> np.ndarray:
    """The best worths at the states of each chunk's left cut."""
    prefix, step = matrices.copy(), 1
    while step < len(prefix):
        prefix[step:] = combine(prefix[:-step], prefix[step:])
        step *= 2
    first = np.full((1, matrices.shape[1]), NEVER)
    first[0, 0] = 0.0
    return np.concatenate([first, prefix[:-1, 0]])


def origins(v: Vocabulary, text: str, size: int, given: np.ndarray) -> list[int]:
    """For each state at the right cut, the state at the left one that its best path comes from (-1: no path)."""
    reach = v.reach

    def source(last: list[int], at: int) -> int:
        while last[at] >= 0:
            at = last[at]
        return at

    cuts = [c for c in v.forced(text[:size]) if c >= reach]
    if cuts:
        return [source(v.best(text, 0, cuts[0], given)[1], cuts[0])] * reach
    stop = min(len(text), size + reach - 1)
    last = v.best(text, 0, stop, given)[1]
    return [source(last, size + o) if size + o <= stop else -1 for o in range(reach)]


def chained(maps: np.ndarray) -> list[int]:
    """The state at each cut: len(maps) + 1 of them, the last being 0."""
    out = [0]
    for m in maps[::-1]:
        out.append(int(m[out[-1]]))
    return out[::-1]


def backtrace(v: Vocabulary, text: str, size: int, begin: int, end: int) -> bytes:
    """The ids of a chunk's pieces that start in it, between its two states."""
    return v.packed(text[begin : size + end]) if begin < size + end else b""


# ---- DataFrames

KEYS = [("row_id", pa.int64()), ("doc_id", pa.int64())]


def _batch(batch: pa.RecordBatch, keys: list[str], **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns.values()], names=[*keys, *columns])


def _chunks(limit: int, ahead: int):
    kind = pa.schema([*KEYS, ("k", pa.int32()), ("part", pa.string()), ("size", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row_id", "doc_id", "text")), strict=True):
                t = escaped(text)
                starts = range(0, len(t), limit)
                for i in range(0, len(starts), 64):
                    some = [(row, doc, i + j, t[a : a + limit + ahead], min(limit, len(t) - a)) for j, a in enumerate(starts[i : i + 64])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), kind, strict=True)], schema=kind)

    return run


def _stretched(limit: int, model: str):
    """Arrow function: texts as rows that merges don't cross."""
    kind = pa.schema([*KEYS, ("k", pa.int32()), ("part", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(model)
        for batch in batches:
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row_id", "doc_id", "text")), strict=True):
                found = v.parts(escaped(text), limit)
                for i in range(0, len(found), 64):
                    some = [(row, doc, i + j, x) for j, x in enumerate(found[i : i + 64])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), kind, strict=True)], schema=kind)

    return run


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids, chunks), one row for each row of ``docs``, also for rows of equal or null id."""
    common.prepare(docs.sparkSession)
    rows = common.text_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    reach = load(model).reach
    ints = pa.list_(pa.int32())

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(model)
        for part, texts in common.steps(batches):
            whole = [escaped(t.decode("utf-8", "surrogatepass")) for t in texts]
            ids = v.packed_all(whole) if isinstance(v, Merges) else [v.packed(t) if t else b"" for t in whole]
            yield _batch(part, ["doc_id"], ids=id_lists(ids), chunks=pa.array([1] * len(ids), pa.int32()))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        for batch in batches:
            got = [transfer(v, t, s).tobytes() for t, s in zip(batch.column("part").to_pylist(), batch.column("size").to_pylist(), strict=True)]
            yield _batch(batch, ["row_id", "k"], m=pa.array(got, pa.binary()))

    def scanned(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        got = worths(np.array([np.frombuffer(m).reshape(reach, reach) for m in table.column("m").to_pylist()]))
        return pa.table({"row_id": table.column("row_id"), "k": table.column("k"), "given": pa.array([w.tobytes() for w in got], pa.binary())})

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "size", "given")]
            got = [origins(v, t, s, np.frombuffer(g)) for t, s, g in zip(*columns, strict=True)]
            yield _batch(batch, ["row_id", "k"], m=pa.array(got, ints))

    def settled(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        at = chained(np.array(table.column("m").to_pylist()))
        return pa.table({"row_id": table.column("row_id"), "k": table.column("k"), "begin": pa.array(at[:-1], pa.int32()), "end": pa.array(at[1:], pa.int32())})

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "size", "begin", "end")]
            yield _batch(batch, ["row_id", "doc_id", "k"], ids=id_lists([backtrace(v, *c) for c in zip(*columns, strict=True)]))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(model)
        for batch in batches:
            yield _batch(batch, ["row_id", "doc_id", "k"], ids=id_lists(v.packed_all(batch.column("part").to_pylist())))

    def together(found: DataFrame) -> DataFrame:
        found = found.groupBy("row_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("l"))
        found = found.select("doc_id", F.flatten(F.transform("l", lambda x: x["ids"])).alias("ids"), F.size("l").alias("chunks"))
        return short.unionByName(found)

    long = F.length("text") >= chunk
    short = rows.filter(~long).mapInArrow(common.lean(small), "doc_id long, ids array<int>, chunks int")
    # kept, so that a task that runs again finds the same numbers
    giants = common.cut(rows.filter(long).select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text"))
    if isinstance(encoder(model), Merges):
        parts = giants.mapInArrow(common.lean(_stretched(chunk, model)), "row_id long, doc_id long, k int, part string")
        return together(parts.repartition("row_id", "k").mapInArrow(common.lean(merged), "row_id long, doc_id long, k int, ids array<int>"))
    parts = giants.mapInArrow(common.lean(_chunks(chunk, reach - 1)), "row_id long, doc_id long, k int, part string, size int")
    given = parts.mapInArrow(common.lean(matrices), "row_id long, k int, m binary").groupBy("row_id").applyInArrow(scanned, "row_id long, k int, given binary")
    maps = parts.join(given, ["row_id", "k"]).mapInArrow(common.lean(mapped), "row_id long, k int, m array<int>")
    cuts = maps.groupBy("row_id").applyInArrow(settled, "row_id long, k int, begin int, end int")
    found = parts.join(cuts, ["row_id", "k"]).mapInArrow(common.lean(pieces), "row_id long, doc_id long, k int, ids array<int>")
    return together(found)


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows with a column ``decoded``: the text of ``ids``."""
    at = rows.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        for batch in batches:
            ids = batch.column(at)
            for i in range(0, len(ids), 256):
                part = ids.slice(i, 256).fill_null([])
                offsets = part.offsets.to_numpy() - part.offsets[0].as_py()
                text = decode_all(v, part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets)
                yield _batch(batch.slice(i, 256), batch.schema.names, decoded=pa.array(text, pa.binary()).cast(pa.string()))

    return rows.mapInArrow(common.lean(run), StructType([*rows.schema.fields, StructField("decoded", StringType())]))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = decoded(encode(common.documents(spark, sf_dir)))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    text = F.sha2(F.col("decoded").cast("binary"), 256)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.length("decoded").cast("long").alias("n_chars"), "chunks", digest.alias("ids_sha256"), text.alias("decoded_sha256"))

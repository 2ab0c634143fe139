"""Token counts by a tokenizer compiled to a deterministic finite-state transducer.

The tokenizer is sentencepiece BPE with byte fallback. A list of pieces is the encoding of a text exactly when every
piece encodes to itself and every two neighbours stay apart when merged alone; so each prefix of a text has one last
piece, found among the pieces that end there. A state holds, for every suffix of the text read so far that may still
grow into a piece, the trie node of the suffix, which merges the piece before it may still enter, and how many pieces
the encoding has gained since. Reading a character gives the next state and the change of the token count: a transducer
whose transitions are annotated with counts. Transitions are compiled when a task first needs them and then kept.

A space after another character brings every state to the same one. A text is cut into chunks of ``CHUNK_BYTES``; a
chunk becomes a state map (entry state -> count and exit state; beyond the first such point both are one value for all
entries), and the maps of a text compose, being associative, in the up-sweep of a prefix scan over its chunks. An entry
of a map is worked out when it first occurs and kept, so a chunk is read once for each state it is really entered in and
the time is linear in the text, also without spaces.

Null and empty texts have 0 tokens. Other columns are kept; columns of the output names are replaced.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.llm import textbatch as tb

SPACE = "▁"  # stands for a space in pieces
NORMAL, BYTE = 1, 6
CHUNK_BYTES = 1 << 16
#: A worker forgets its compiled transitions and states, or its segments, beyond these bounds and compiles again what it meets.
MOST_TRANSITIONS, MOST_STATES = 1_500_000, 300_000
SEGMENT_MEMORY, ENTRY_BYTES = 48 << 20, 150


def _symbols(raw: bytes) -> str:
    return raw.decode("utf-8", "replace").replace(" ", SPACE)


def _fields(data: bytes):
    """(field number, value) of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


def read_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a sentencepiece model; only BPE with byte fallback, dummy prefix and no other normalization."""
    pieces, trainer, normalizer = [], {}, {}
    for field, value in _fields(model):
        if field == 1:
            entry = dict(_fields(value))
            pieces.append((entry[1].decode(), struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0, entry.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normalizer = dict(_fields(value))
    plain = not normalizer.get(2) and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1
    if trainer.get(3) != 2 or not trainer.get(35) or not plain or any(kind in (4, 5) for *_, kind in pieces):
        raise ValueError("this model is not plain BPE with byte fallback")
    return pieces


class ChunkMap:
    """State map of one chunk: reads ``head`` from the entry state; a synchronized chunk then counts ``count`` and ends in ``exit``."""

    def __init__(self, machine: Transducer, head: str, count: int = 0, exit: tuple | None = None):
        self.machine, self.head, self.count, self.exit, self.known = machine, head, count, exit, {}

    def __call__(self, entry: tuple) -> tuple[int, tuple]:
        if entry not in self.known:
            count, state = self.machine.run(self.machine._state(entry), self.head)
            self.known[entry] = count + self.count, self.machine.states[state] if self.exit is None else self.exit
        return self.known[entry]


class Composed:
    """First the map ``f``, then ``g``."""

    def __init__(self, f, g):
        self.f, self.g, self.known = f, g, {}

    def __call__(self, entry: tuple) -> tuple[int, tuple]:
        if entry not in self.known:
            before, state = self.f(entry)
            after, state = self.g(state)
            self.known[entry] = before + after, state
        return self.known[entry]


class Transducer:
    START = 0

    def __init__(self, model: bytes):
        pieces = [(p, s) for p, s, kind in read_pieces(model) if kind == NORMAL]
        order = {s: r for r, s in enumerate(sorted({-s for _, s in pieces}))}
        self.rank = {p: order[-s] for p, s in pieces}
        self.split: dict[str, tuple[str, str]] = {}  # last merge of a piece in its own encoding
        self.sound = {p for p, _ in pieces if len(p) == 1 or self._merge(p)}
        self.partners: dict[str, set[str]] = {}  # first characters of what a piece may merge with on its right
        for p, _ in pieces:
            for k in range(1, len(p)):
                if p[:k] in self.rank and p[k:] in self.rank:
                    self.partners.setdefault(p[:k], set()).add(p[k])
        self.children: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        for p in sorted(self.sound):
            node = 0
            for c in p:
                to = self.children[node].get(c)
                if to is None:
                    to = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                node = to
            self.token[node] = p
        if any(c not in self.sound for c in self.children[0]):
            raise ValueError("a character of the pieces is no piece itself")
        self.first = ((0, (), 0),)
        self.borders: dict[str, tuple] = {}
        self.lefts: dict[str, list] = {}
        self.apart: dict[tuple, bool] = {}
        self.segments: dict[bytes, int] = {}
        self.segment_bytes = 0
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.moves: dict[int, tuple[int, int]] = {}
        self._state(self.first)

    def _merge(self, text: str) -> bool:
        """Whether the piece is the encoding of its own characters; notes its last merge."""
        parts: list[str | None] = list(text)
        n = len(parts)
        follow, lead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[a + b], k, a, b) for k, (a, b) in enumerate(zip(text, text[1:])) if a + b in self.rank]
        heapq.heapify(heap)
        left = n
        while heap:
            _, k, a, b = heapq.heappop(heap)
            to = follow[k]
            if to >= n or parts[k] != a or parts[to] != b:
                continue
            parts[k], parts[to] = a + b, None
            left -= 1
            if left == 1:
                self.split[text] = (a, b)
            follow[k] = follow[to]
            if follow[k] < n:
                lead[follow[k]] = k
                if (r := self.rank.get(parts[k] + parts[follow[k]])) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[follow[k]]))
            if lead[k] >= 0 and (r := self.rank.get(parts[lead[k]] + parts[k])) is not None:
                heapq.heappush(heap, (r, lead[k], parts[lead[k]], parts[k]))
        return left == 1

    def border(self, piece: str) -> tuple:
        """Right-hand parts of a piece that may merge onwards, each with the rank of the merge that ends it."""
        if piece not in self.borders:
            out, until, part = [], 1 << 40, piece
            while True:
                if part in self.partners:
                    out.append((part, until))
                if len(part) == 1:
                    break
                until, part = self.rank[part], self.split[part][1]
            self.borders[piece] = tuple(out)
        return self.borders[piece]

    def stays_apart(self, border: tuple, piece: str) -> bool:
        """Whether ``piece`` can follow a piece with this border in an encoding."""
        if not border:
            return True
        known = self.apart.get((border, piece))
        if known is None:
            if piece not in self.lefts:
                out, until, part = [], 1 << 40, piece
                while True:
                    out.append((part, until))
                    if len(part) == 1:
                        break
                    until, part = self.rank[part], self.split[part][0]
                self.lefts[piece] = out
            known = not any(
                (r := self.rank.get(a + b)) is not None and r < until_a and r <= until_b
                for a, until_a in border for b, until_b in self.lefts[piece]
            )
            if len(self.apart) > MOST_TRANSITIONS:
                self.apart = {}
            self.apart[border, piece] = known
        return known

    def _state(self, items: tuple) -> int:
        at = self.number.get(items)
        if at is None:
            at = self.number[items] = len(self.states)
            self.states.append(items)
        return at

    def compile(self, state: int, c: str) -> tuple[int, int]:
        """The transition for one character: (next state, change of the token count)."""
        if c not in self.children[0]:
            return self.START, len(c.encode())  # byte fallback, next to which nothing merges
        grown, last = [], None
        for node, border, back in self.states[state]:
            to = self.children[node].get(c)
            if to is None:
                continue
            if not node and border:
                border = tuple(x for x in border if c in self.partners[x[0]])
            piece = self.token[to]
            if piece is not None and self.stays_apart(border, piece):
                last = (piece, 1 - back)
            if self.children[to]:
                grown.append((to, border, back))
        piece, change = last
        items = tuple((node, border, back + change) for node, border, back in grown)
        return self._state((*items, (0, self.border(piece), 0))), change

    def run(self, state: int, text: str) -> tuple[int, int]:
        """(change of the count, exit state) of reading ``text``; state numbers from before the call may be void after it."""
        count, moves = 0, self.moves
        for c in text:
            move = moves.get(state << 21 | ord(c))
            if move is None:
                if len(moves) >= MOST_TRANSITIONS or len(self.states) >= MOST_STATES:
                    here = self.states[state]
                    self.forget()
                    state, moves = self._state(here), self.moves
                move = moves[state << 21 | ord(c)] = self.compile(state, c)
            state = move[0]
            count += move[1]
        return count, state

    def up_sweep(self, maps: list):
        """The composition of all maps, by neighbouring pairs in log2(n) rounds."""
        while len(maps) > 1:
            maps = [Composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def segment(self, raw: bytes) -> int:
        """Count of a segment that begins at a synchronizing space."""
        known = self.segments.get(raw)
        if known is None:
            known = self.run(self.START, _symbols(raw))[0]
            self.segment_bytes += len(raw) + ENTRY_BYTES
            if self.segment_bytes > SEGMENT_MEMORY:
                self.segments, self.segment_bytes = {}, len(raw) + ENTRY_BYTES
            self.segments[raw] = known
        return known

    def counts(self, column: pa.Array) -> np.ndarray:
        """Token counts of whole texts."""
        data, offsets = tb.utf8_bytes(pc.replace_substring(column, SPACE, " "))  # to the tokenizer they are the same
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)
        if not len(full):
            return np.zeros(len(column), np.int64)
        data = np.insert(data, offsets[full], 32)  # the dummy prefix
        firsts = offsets[full] + np.arange(len(full))
        ends = np.append(firsts[1:], len(data))
        sync = data == 32
        sync[1:] &= data[:-1] != 32
        sync[firsts] = True
        long_ = np.flatnonzero(ends - firsts > CHUNK_BYTES)
        cuts = {}
        for i in long_.tolist():
            at = np.arange(firsts[i] + CHUNK_BYTES, ends[i], CHUNK_BYTES)
            for _ in range(3):  # back to the first byte of a character
                at = np.where(data[at] & 0xC0 == 0x80, at - 1, at)
            cuts[i] = at
        cut = np.zeros(len(data), bool)
        for at in cuts.values():
            cut[at] = True
        starts = np.flatnonzero(sync | cut)
        synced = sync[starts]
        cells = tb.binary_array(np.append(starts, len(data)), data)
        coded = cells.filter(pa.array(synced)).dictionary_encode()
        known = np.array([self.segment(raw) for raw in coded.dictionary.to_pylist()], np.int64)
        own = np.zeros(len(starts), np.int64)
        own[synced] = known[coded.indices.to_numpy(zero_copy_only=False)]
        out = np.zeros(len(column), np.int64)
        at = np.searchsorted(starts, firsts)
        out[full] = np.add.reduceat(own, at)
        for i, places in cuts.items():
            bounds = np.searchsorted(starts, [firsts[i], *places, ends[i]])
            maps = []
            for low, high in zip(bounds, bounds[1:]):
                head = "" if synced[low] else _symbols(cells[int(low)].as_py())
                whole = int(low) + (not synced[low])
                exit = None
                if whole < high:
                    exit = self.states[self.run(self.START, _symbols(cells[int(high) - 1].as_py()))[1]]
                maps.append(ChunkMap(self, head, int(own[whole:high].sum()), exit))
            out[full[i]] = self.up_sweep(maps)(self.first)[0]
        return out


@lru_cache(maxsize=2)
def transducer(model: bytes) -> Transducer:
    return Transducer(model)


def counter(path: str):
    """Function from a text column to its token count."""
    with open(path, "rb") as file:
        model = file.read()

    @F.arrow_udf("long")
    def count(column: pa.Array) -> pa.Array:
        machine = transducer(model)
        found = [machine.counts(part) for part in tb.slices(column)]
        return pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))

    return count


def count_tokens(df: DataFrame, path: str, text: str | Column = "text", limit: int = 4096) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    tb.small_batches(df.sparkSession)
    held = F.col(text) if isinstance(text, str) else text
    return df.withColumn("n_tokens", counter(path)(held)).withColumns({
        "n_bytes": F.coalesce(F.octet_length(held), F.lit(0)).cast("long"), "over_limit": F.col("n_tokens") > limit,
    })

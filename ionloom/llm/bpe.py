"""BPE encoding and decoding: propose tokens greedily, verify adjacent pairs, merge exactly only where that fails.

A sequence of tokens is the BPE encoding of a word exactly when every token is the encoding of its own bytes and every
two neighbours are the encoding of their joined bytes. So a greedy longest match over a trie proposes tokens for all
distinct words of a batch at once, the neighbour test runs over all distinct pairs as array operations, and words with
a failing pair go through the merges one by one.

Inputs are the columns of any DataFrame; rows, other columns and their order are kept. Null and empty texts give an
empty list of ids; null or empty ids give an empty text. A column of the output name is replaced. The vocabulary is
read once on the driver and shipped with the function (a few MB), so executors need no path to it.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.llm import textbatch as tb

NEVER = np.int64(1) << 40
#: Bytes of distinct words and their ids above which a worker forgets the rarer half of them.
REMEMBERED = 24 << 20
#: Bytes of texts encoded at once.
SLICE_BYTES = 1 << 20
#: New words encoded at once.
WORDS_AT_ONCE = 1 << 14
#: Tokens whose own encoding is worked out at once when a vocabulary is read.
MERGED_AT_ONCE = 4096
#: Failing words of up to this many bytes are merged in step, in groups of similar length.
LONG_WORD = 64
WORD_WIDTHS = (0, 8, 12, 16, 24, 40, LONG_WORD)
OTHER, LETTER, NUMBER, SPACE, END = range(5)


@cache
def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(c): b for b, c in [*zip(shown, shown), *((b, 256 + i) for i, b in enumerate(hidden))]}


@cache
def character_classes() -> np.ndarray:
    """Letter, number, white space or other for every code point."""
    table = np.zeros(0x110000, np.uint8)
    every = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4").tobytes().decode("utf-32-le")
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            first, last = ord(every[m.start()]), ord(every[m.end() - 1])
            table[first : last + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


@cache
def byte_classes() -> np.ndarray:
    """Class of every ASCII byte; the bytes of longer characters get theirs from the code point."""
    table = np.full(256, OTHER, np.uint8)
    table[:128] = character_classes()[:128]
    return table


def split_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Words of the byte-level pattern: contractions, letters, numbers, other signs (each with one space before), spaces.

    Returns the words as bytes and the offsets of each text into them. All bytes of a character have its class, so that
    words are found on the bytes themselves.
    """
    raw = [t.encode("utf-8", "replace") for t in texts]
    if not raw:
        return pa.array([], pa.binary()), np.zeros(1, np.int64)
    data = np.frombuffer(b"\0".join([*raw, b""]), np.uint8)
    stops = np.cumsum([len(t) + 1 for t in raw]) - 1
    del raw
    kind = byte_classes()[data]
    lead = np.flatnonzero(data >= 0xC0)
    first = data[lead]
    wide_spaces = []
    for width, low, high, bits in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0x100, 0x07)):
        at = lead[(first >= low) & (first < high)]
        if not len(at):
            continue
        code = data[at].astype(np.uint32) & bits
        for k in range(1, width):
            code = code << 6 | data[at + k] & 0x3F
        own = character_classes()[code]
        for k in range(width):
            kind[at + k] = own
        wide_spaces.append((width, at[own == SPACE]))
    kind[stops] = END
    word = kind < SPACE
    blank = data == 32
    start = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == END
    start[1:] &= ~(word[1:] & blank[:-1])
    start[:-1] |= (kind[:-1] == SPACE) & word[1:]
    for width, at in wide_spaces:  # the last space before a word stands alone: from its first byte on
        last = at + width - 1
        start[last] = False
        start[at[word[last + 1]]] = True
    quote = np.flatnonzero(start & (data == 39))
    if len(quote):
        one, two = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for at, length in ((quote[single], 2), (quote[double], 3)):
            start[at + 1] = False
            start[at + length] = True
    firsts = np.flatnonzero(start)
    cells = tb.binary_array(np.append(firsts, len(data)), data)
    stop = kind[firsts] == END
    ends = np.flatnonzero(stop) - np.arange(len(texts))
    return cells.filter(pa.array(~stop)), np.concatenate([[0], ends])


class WordMemory:
    """Words seen in earlier batches with their ids, found by hash and compared byte by byte.

    Words are numbered as they come; ``spans`` and ``data`` hold their bytes, ``offsets`` and ``ids`` their ids, ``met``
    how often each was met. ``hashes`` is sorted, ``owners`` has the number of the word of each.
    """

    def __init__(self):
        self.spans, self.data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
        self.offsets, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.met = np.zeros(0, np.int64)
        self.hashes, self.owners = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def nbytes(self) -> int:
        return sum(v.nbytes for v in vars(self).values())

    def forget_rare(self) -> None:
        """Drop the half of the words met least."""
        keep = self.met > np.median(self.met)
        numbers = np.flatnonzero(keep)
        self.spans, self.data = tb.ragged_take(self.spans, self.data, numbers)
        self.offsets, self.ids = tb.ragged_take(self.offsets, self.ids, numbers)
        self.met = self.met[numbers] // 2
        held = keep[self.owners]
        self.hashes, self.owners = self.hashes[held], (np.cumsum(keep) - 1)[self.owners[held]]

    def numbers(self, cells: pa.Array, times: np.ndarray, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Number of each of some distinct words, met ``times``; those not known are encoded and kept."""
        if self.nbytes() > REMEMBERED:
            self.forget_rare()
        data, spans = tb.utf8_bytes(cells)
        key = tb.span_hashes(data, spans[:-1], spans[1:])
        number = np.full(len(cells), -1, np.int64)
        if len(self.hashes):
            slot = np.minimum(np.searchsorted(self.hashes, key), len(self.hashes) - 1)
            at = self.owners[slot]
            same = np.flatnonzero((self.hashes[slot] == key) & (np.diff(self.spans)[at] == np.diff(spans)))
            held, theirs = tb.ragged_take(self.spans, self.data, at[same])
            differ = theirs != tb.ragged_take(spans, data, same)[1]
            number[same] = at[same]
            number[np.repeat(same, np.diff(held))[differ]] = -1  # another word of the same hash
            known = number >= 0
            self.met[number[known]] += times[known]
        new = np.flatnonzero(number < 0)
        if len(new):
            out, ids = encode(cells.take(pa.array(new)))
            number[new] = len(self.met) + np.arange(len(new))
            own_spans, own_data = tb.ragged_take(spans, data, new)
            self.spans, self.data = np.append(self.spans, self.spans[-1] + own_spans[1:]), np.append(self.data, own_data)
            self.offsets, self.ids = np.append(self.offsets, self.offsets[-1] + out[1:]), np.append(self.ids, ids)
            self.met = np.append(self.met, times[new])
            order = new[np.argsort(key[new])]
            slot = np.searchsorted(self.hashes, key[order])
            self.hashes, self.owners = np.insert(self.hashes, slot, key[order]), np.insert(self.owners, slot, number[order])
        return number


class Vocabulary:
    """Tokens, merges and the derived tables of one byte-level BPE vocabulary file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") is not None:
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        symbol = byte_symbols()
        to_byte = {ord(c): b for c, b in symbol.items()}
        known = {t: i for t, i in spec["model"]["vocab"].items() if symbol.keys() >= set(t)}
        self.ids = {t.translate(to_byte).encode("latin-1"): i for t, i in known.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        held = [b""] * size
        for token, i in [*self.ids.items(), *((s.encode(), i) for s, i in self.special.items())]:
            held[i] = token
        self.tokens = pa.array(held, pa.binary())
        self.lengths = np.array([len(t) for t in held], np.int64)
        self.size = size
        self.rank = np.full(size, -1, np.int64)
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            first, second = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = known[first], known[second], known[first + second]
            self.merges.setdefault((a, b), (r, made))
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, a, b
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array([r for r, _ in self.merges.values()], np.int64)[order], NEVER)
        self.made = np.zeros(1 + max((r for r, _ in self.merges.values()), default=0), np.int64)
        for r, made in self.merges.values():
            self.made[r] = made
        self.base = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int64)
        self._trie()
        self.sound = np.ones(size, bool)  # tokens that are the encoding of their own bytes
        names, numbers = list(self.ids), np.array(list(self.ids.values()), np.int32)
        for at in range(0, len(names), MERGED_AT_ONCE):
            some = slice(at, at + MERGED_AT_ONCE)
            out, ids = self.merge_many(pa.array(names[some], pa.binary()))
            self.sound[numbers[some]] = (np.diff(out) == 1) & (ids[out[:-1]] == numbers[some])
        self.memory = WordMemory()

    def _trie(self) -> None:
        """Edges of the trie of all tokens, one level at a time; nodes are numbered by level, so that edges come sorted."""
        data, offsets = tb.utf8_bytes(pa.array(list(self.ids), pa.binary()))
        numbers = np.array(list(self.ids.values()), np.int64)
        length = np.diff(offsets)
        at = np.zeros(len(length), np.int64)
        keys, size, ends = [], 1, [np.where(length == 0, numbers, -1).max(initial=-1, keepdims=True)]
        for level in range(int(length.max(initial=0))):
            live = np.flatnonzero(length > level)
            edges, own = np.unique(at[live] * 256 + data[offsets[live] + level], return_inverse=True)
            at[live] = size + own
            keys.append(edges)
            size += len(edges)
            token = np.full(len(edges), -1, np.int64)
            last = live[length[live] == level + 1]
            token[at[last] - (size - len(edges))] = numbers[last]
            ends.append(token)
        self.edge_keys = np.concatenate([*keys, [np.iinfo(np.int64).max]])
        self.edge_nodes = np.append(np.arange(1, size), 0)
        self.node_token = np.concatenate(ends)

    def merge(self, word: bytes) -> list[int]:
        """The exact encoding of one word: lowest merge first, leftmost first among equals."""
        ids = [int(i) for i in self.base[np.frombuffer(word, np.uint8)]]
        n = len(ids)
        follow = list(range(1, n + 1))
        lead = list(range(-1, n - 1))
        heap = [(m[0], k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := self.merges.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            to = follow[k]
            if ids[k] != a or to >= n or ids[to] != b:
                continue
            ids[k] = self.merges[a, b][1]
            ids[to] = -1
            follow[k] = follow[to]
            if follow[k] < n:
                lead[follow[k]] = k
                if m := self.merges.get((ids[k], ids[follow[k]])):
                    heapq.heappush(heap, (m[0], k, ids[k], ids[follow[k]]))
            if lead[k] >= 0 and (m := self.merges.get((ids[lead[k]], ids[k]))):
                heapq.heappush(heap, (m[0], lead[k], ids[lead[k]], ids[k]))
        return [i for i in ids if i >= 0]

    def merge_many(self, cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words in step: each round does the lowest, leftmost merge of every word at once.

        Returns (offsets, ids). Words longer than ``LONG_WORD`` bytes are merged one by one.
        """
        data, offsets = tb.utf8_bytes(cells)
        length = np.diff(offsets)
        found_rows, found_counts, found_ids = [], [], []
        for i in np.flatnonzero(length > LONG_WORD):
            exact = self.merge(data[offsets[i] : offsets[i + 1]].tobytes())
            found_rows.append(np.array([i]))
            found_counts.append(np.array([len(exact)]))
            found_ids.append(np.array(exact, np.int32))
        for low, high in zip(WORD_WIDTHS, WORD_WIDTHS[1:]):
            rows = np.flatnonzero((length > low) & (length <= high))
            if not len(rows):
                continue
            column = np.arange(high)
            inside = column < length[rows, None]
            ids = np.where(inside, self.base[data[np.minimum(offsets[rows, None] + column, len(data) - 1)]], -1)
            ids = np.concatenate([ids, np.full((len(rows), 1), -1)], axis=1)  # a place after the last byte
            after = np.where(inside, column + 1, high)
            after[column + 1 == length[rows, None]] = high
            after = np.concatenate([after, np.full((len(rows), 1), high)], axis=1)
            before = np.concatenate([np.tile(column - 1, (len(rows), 1)), np.full((len(rows), 1), -1)], axis=1)
            rank = np.full((len(rows), high + 1), NEVER)
            both = ids[:, 1:] >= 0
            rank[:, :-1][both] = self.pair_rank(ids[:, :-1][both], ids[:, 1:][both])
            live = np.arange(len(rows))
            while len(live):
                at = rank[live].argmin(axis=1)
                lowest = rank[live, at]
                going = lowest < NEVER
                live, at = live[going], at[going]
                if not len(live):
                    break
                gone = after[live, at]
                to = after[live, gone]
                ids[live, at] = self.made[lowest[going]]
                ids[live, gone] = -1
                rank[live, gone] = NEVER
                after[live, at] = to
                before[live, to] = at
                right = ids[live, to]
                rank[live, at] = np.where(right >= 0, self.pair_rank(ids[live, at], np.maximum(right, 0)), NEVER)
                lead = before[live, at]
                led = lead >= 0
                rank[live[led], lead[led]] = self.pair_rank(ids[live[led], lead[led]], ids[live[led], at[led]])
            held = ids[:, :-1]
            kept = held >= 0
            found_rows.append(rows)
            found_counts.append(kept.sum(axis=1))
            found_ids.append(held[kept].astype(np.int32))
        counts = np.zeros(len(cells), np.int64)
        if not found_rows:
            return tb.offsets_of(counts), np.zeros(0, np.int32)
        rows = np.concatenate(found_rows)
        counts[rows] = np.concatenate(found_counts)
        place = np.empty(len(cells), np.int64)  # where each word stands among those found; words without bytes take none
        place[rows] = np.arange(len(rows))
        some = np.flatnonzero(length)
        _, ids = tb.ragged_take(tb.offsets_of(np.concatenate(found_counts)), np.concatenate(found_ids), place[some])
        return tb.offsets_of(counts), ids

    def propose(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match for all words in step: (offsets, ids)."""
        words = np.arange(len(offsets) - 1)
        at, end = offsets[:-1].copy(), offsets[1:]
        found_word, found_id, found_step = [], [], []
        step = 0
        live = words[at < end]
        while len(live):
            node = np.zeros(len(live), np.int64)
            place = at[live].copy()
            best = np.full(len(live), -1, np.int64)
            best_end = place + 1
            walking = np.arange(len(live))
            while len(walking):
                key = node[walking] * 256 + data[place[walking]]
                slot = np.searchsorted(self.edge_keys, key)
                hit = self.edge_keys[slot] == key
                walking = walking[hit]
                node[walking] = self.edge_nodes[slot[hit]]
                place[walking] += 1
                token = self.node_token[node[walking]]
                ok = token >= 0
                best[walking[ok]] = token[ok]
                best_end[walking[ok]] = place[walking[ok]]
                walking = walking[place[walking] < end[live[walking]]]
            found_word.append(live)
            found_id.append(best)
            found_step.append(np.full(len(live), step))
            at[live] = best_end
            live = live[at[live] < end[live]]
            step += 1
        if not found_word:
            return np.zeros(len(words) + 1, np.int64), np.zeros(0, np.int64)
        word, ids = np.concatenate(found_word), np.concatenate(found_id)
        order = np.lexsort((np.concatenate(found_step), word))
        out = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bincount(word, minlength=len(words)), out=out[1:])
        return out, ids[order]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        slot = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[slot] == key, self.pair_ranks[slot], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays apart when their joined bytes are merged.

        Undo the merges of both tokens, latest first. Two pieces that meet at the border at the same time must have no
        merge of their own that comes before the next merge of either (on the right also none of equal rank, since the
        border is further left).
        """
        a, b = a.copy(), b.copy()
        until_a, until_b = np.full(len(a), NEVER), np.full(len(b), NEVER)
        fine = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            r = self.pair_rank(x, y)
            fine[live] &= ~((r < until_a[live]) & (r <= until_b[live]) & (r < NEVER))
            rx, ry = self.rank[x], self.rank[y]
            live_on = fine[live] & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = (v[live_on] for v in (live, x, y, rx, ry))
            one = rx > ry
            until_a[live[one]], a[live[one]] = rx[one], self.right[x[one]]
            until_b[live[~one]], b[live[~one]] = ry[~one], self.left[y[~one]]
        return fine

    def encode_cells(self, cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of distinct words."""
        parts = [self._encode_some(cells.slice(at, WORDS_AT_ONCE)) for at in range(0, max(len(cells), 1), WORDS_AT_ONCE)]
        return tb.offsets_of(np.concatenate([np.diff(out) for out, _ in parts])), np.concatenate([ids for _, ids in parts])

    def _encode_some(self, cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out, ids = self.propose(*tb.utf8_bytes(cells))
        bad = np.zeros(len(cells), bool)
        word = np.repeat(np.arange(len(cells)), np.diff(out))
        bad[word[(ids < 0) | ~self.sound[np.maximum(ids, 0)]]] = True
        if len(ids) > 1:
            inner = np.flatnonzero(word[1:] == word[:-1])
            keys, where = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
            bad[word[inner[~self.compatible(keys // self.size, keys % self.size)[where]]]] = True
        failing = np.flatnonzero(bad)
        if not len(failing):
            return out, ids.astype(np.int32)
        exact_out, exact = self.merge_many(cells.take(pa.array(failing)))
        row = np.arange(len(cells))
        row[failing] = len(cells) + np.arange(len(failing))  # the merged ones stand behind the proposals
        return tb.ragged_take(np.concatenate([out, out[-1] + exact_out[1:]]), np.concatenate([ids.astype(np.int32), exact]), row)

    def encode_words(self, cells: pa.Array) -> list[bytes]:
        """Ids of distinct words, each as packed 32-bit numbers."""
        out, ids = self.encode_cells(cells)
        return [ids[a:b].tobytes() for a, b in zip(out, out[1:])]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts: (offsets, ids). Strings of special tokens become their ids, as in the library."""
        pieces, owner, fixed = texts, None, {}
        if self.special and any(s in t for t in texts for s in self.special):
            marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
            pieces, owner = [], []
            for i, text in enumerate(texts):
                for k, piece in enumerate(marks.split(text)):
                    if k % 2:
                        fixed[len(pieces)] = self.special[piece]
                    pieces.append("" if k % 2 else piece)
                    owner.append(i)
        cells, per_piece = split_words(pieces)
        coded = cells.dictionary_encode()
        del cells
        inside = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        number = self.memory.numbers(coded.dictionary, np.bincount(inside, minlength=len(coded.dictionary)), self.encode_cells)
        word_at, flat = tb.ragged_take(self.memory.offsets, self.memory.ids, number[inside])
        ends = word_at[per_piece]
        if owner is not None:
            at = sorted(fixed)
            flat = np.insert(flat, ends[np.array(at, np.int64)], [fixed[k] for k in at]) if at else flat
            counts = np.diff(ends)
            counts[at] += 1
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, counts, len(texts)).astype(np.int64))])
        return ends, flat

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """Texts of lists of ids; bytes that are no UTF-8 become the replacement character."""
        known = (ids >= 0) & (ids < self.size)
        if not known.all():
            keep = np.concatenate([[0], np.cumsum(known)])
            offsets, ids = keep[offsets], ids[known]
        place = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.lengths[ids], out=place[1:])
        data, _ = tb.utf8_bytes(self.tokens.take(pa.array(ids, pa.int32())))
        raw = tb.binary_array(place[offsets], data)
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())


def vocabulary(text: str) -> Vocabulary:
    """The vocabulary of a file's text, built once in a worker until another step runs there."""
    return tb.kept(("vocabulary", text), lambda: Vocabulary(text))


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encoder(path: str):
    """Function from a text column to a column of token ids."""
    spec = read_vocabulary(path)

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        model = vocabulary(spec)
        out = []
        for part in tb.slices(column, SLICE_BYTES):
            out.append(tb.list_array(*model.encode([t or "" for t in part.to_pylist()]), pa.int32()))
            tb.give_back()
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return ids


def decoder(path: str):
    """Function from a column of token ids to a text column."""
    spec = read_vocabulary(path)

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        model = vocabulary(spec)
        column = pc.fill_null(column, pa.scalar([], column.type)) if column.null_count else column
        offsets = column.offsets.to_numpy().astype(np.int64)
        flat = column.values.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) if len(column) else np.zeros(0, np.int64)
        return model.decode(offsets - offsets[0], flat[offsets[0] : offsets[-1]]) if len(column) else pa.array([], pa.string())

    return text


def encode(df: DataFrame, path: str, text: str | Column = "text", out: str = "ids") -> DataFrame:
    """Add the token ids of ``text`` (null: no ids)."""
    tb.small_batches(df.sparkSession)
    return df.withColumn(out, encoder(path)(text))


def decode(df: DataFrame, path: str, ids: str | Column = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of the token ids (null: empty text; ids outside the vocabulary give nothing)."""
    tb.small_batches(df.sparkSession)
    return df.withColumn(out, decoder(path)(ids))


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encode every text, decode the ids, and return digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    done = decode(encode(df.select("doc_id", text), path, text, "_ids"), path, "_ids", "_decoded")
    joined = F.array_join(F.col("_ids").cast("array<string>"), ",")
    return done.select(
        "doc_id", F.size("_ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("_decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

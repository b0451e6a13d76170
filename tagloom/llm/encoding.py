"""Token ids of many texts at once, by numpy over their bytes and a tokenizer for what is new.

The tokenizer must drop white space, mark word ends, lower-case, and cut words into letters, single
digits and runs of symbols. Such parts are found for all bytes of a batch together, known by a 64-bit
hash of their bytes, and looked up in a hash table of arrays; only parts not met before go to the
tokenizer. Words with anything but ASCII and Latin-1 letters, with an apostrophe before a letter, or with
what may be a special token are looked up whole.

A table holds a bounded number of parts. When it is full, those not met again since the last time go.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_SPACE, _LETTER, _DIGIT, _SYMBOL, _OTHER, _WHOLE = range(6)
#: Bytes of text that are worked on together; longer only where there is no white space.
CHUNK = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each byte. A byte from 0x80 to 0xBF counts as a letter; what leads it says more."""
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[33:127] = _SYMBOL
    for low, high in (("a", "z"), ("A", "Z")):
        kinds[ord(low) : ord(high) + 1] = _LETTER
    kinds[ord("0") : ord("9") + 1] = _DIGIT
    kinds[0x80:0xC0] = kinds[0xC3] = _LETTER
    kinds[[9, 10, 11, 12, 13, 32]] = _SPACE
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    return kinds, lower


_KINDS, _LOWER = _tables()


def _spread(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class PartTable:
    """Ids by the hash of a part: open addressing in arrays, and one pool of ids."""

    def __init__(self, bits: int = 21):
        self.bits, self.most = bits, 1 << (bits - 1)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at = np.zeros(1 << self.bits, _U), np.zeros(1 << self.bits, np.int32)
        self.count = 0
        self.hash, self.start, self.length = np.zeros(self.most, _U), np.zeros(self.most, np.int64), np.zeros(self.most, np.int32)
        self.used = np.zeros(self.most, bool)
        self.pool, self.size = np.zeros(1 << 16, np.uint32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each part, -1 where it is unknown."""
        out = np.full(len(hashes), -1, np.int32)
        slot = (hashes >> _U(64 - self.bits)).astype(np.int64)
        here = self.keys[slot]
        hit = here == hashes
        out[hit] = self.at[slot[hit]]
        left = np.flatnonzero(~hit & (here != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            here = self.keys[slot[left]]
            hit = here == hashes[left]
            out[left[hit]] = self.at[slot[left[hit]]]
            left = left[~hit & (here != 0)]
        self.used[out[out >= 0]] = True
        return out

    def _place(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        slot, left = (hashes >> _U(64 - self.bits)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = hashes[free]  # of several that meet in a slot one stays
            done = self.keys[slot[left]] == hashes[left]
            self.at[slot[left[done]]] = numbers[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def add(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """New parts (distinct, unknown); their ids one after another. There must be room."""
        n, end = len(hashes), self.size + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.size], np.zeros(max(end, 1 << 16), np.uint32)])
        self.pool[self.size : end] = ids
        numbers = np.arange(self.count, self.count + n, dtype=np.int32)
        self.hash[numbers], self.length[numbers] = hashes, lengths
        self.start[numbers] = self.size + np.cumsum(lengths) - lengths
        self.used[numbers] = True
        self._place(hashes, numbers)
        self.count, self.size = self.count + n, end

    def room(self, n: int) -> None:
        """Makes room for ``n`` new parts: those that were not met again go, or all."""
        keep = np.flatnonzero(self.used[: self.count])
        if len(keep) + n > self.most // 2:
            keep = keep[:0]
        hashes, lengths = self.hash[keep], self.length[keep]
        ids = self.ids(keep)
        while n > self.most:
            self.bits, self.most = self.bits + 1, self.most * 2
        self._clear()
        self.add(hashes, ids, lengths)
        self.used[:] = False

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of parts, one after another."""
        lengths = self.length[numbers].astype(np.int64)
        total = int(lengths.sum())
        ends = np.cumsum(lengths)
        return self.pool[np.arange(total) + np.repeat(self.start[numbers] - (ends - lengths), lengths)]


class Encoder:
    """Ids of texts, as ``encode`` of the tokenizer at ``path`` without special tokens added."""

    def __init__(self, path: str, bits: int = 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.top = max(vocabulary.values())
        self.ends = np.zeros(self.top + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.table = PartTable(bits)
        self.powers = self.inverses = np.ones(1, _U)

    def _hashed(self, n: int) -> None:
        """Powers of an odd number and of its inverse modulo 2**64, ``n`` at least."""
        if len(self.powers) < n:
            n = max(n, CHUNK + CHUNK // 8)
            for name, base in (("powers", _ODD), ("inverses", pow(_ODD, -1, 1 << 64))):
                factors = np.full(n, base, _U)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))

    def _tokenized(self, parts: list[str], whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``parts`` one after another, and their numbers."""
        fast = self.tokenizer.encode_batch_fast
        if not whole:  # each is one word of the tokenizer, so all can be one text, cut at word ends
            ids = np.array(fast([" ".join(parts)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(parts):
                return ids, np.diff(ends, prepend=0)
        got = [e.ids for e in fast(parts, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def _learn(self, hashes: np.ndarray, parts: list[bytes], whole: bool) -> None:
        for k in range(0, len(parts), 4096):
            texts = [x.decode("utf-8", "replace") for x in parts[k : k + 4096]]
            self.table.add(hashes[k : k + 4096], *self._tokenized(texts, whole))

    def _parts(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each part of the bytes, and where it begins. A part ends at each of ``starts``."""
        n = len(raw)
        kind, low = _KINDS[raw], _LOWER[raw]
        led = raw[:-1] == 0xC3
        second = raw[1:]
        low[1:] += ((led & (second < 0x9F) & (second != 0x97)) * np.uint8(32)).astype(np.uint8)
        kind[1:][led & ((second == 0x97) | (second == 0xB7))] = _OTHER
        kind[:-1][(raw[:-1] == ord("'")) & (kind[1:] == _LETTER)] = _OTHER
        kind[:-1][(raw[:-1] == ord("<")) & (second == ord("|"))] = _OTHER
        cut = np.empty(n, bool)
        cut[0] = True
        space = kind == _SPACE
        odd = np.flatnonzero(kind == _OTHER)
        if len(odd):
            cut[1:] = space[1:] != space[:-1]
            cut[starts] = True
            words = np.append(np.flatnonzero(cut), n)
            at = np.unique(np.searchsorted(words, odd, "right") - 1)
            edge = np.zeros(n + 1, np.int8)
            edge[words[at]] += 1
            edge[words[at + 1]] -= 1
            kind[np.cumsum(edge[:-1], dtype=np.int8).view(bool)] = _WHOLE
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        cut[starts] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], n)
        of = kind[begin]
        word = of != _SPACE
        begin, end, of = begin[word], end[word], of[word]
        if not len(begin):
            return np.empty(0, np.int32), begin
        self._hashed(n)
        sums = np.zeros(n + 1, _U)
        np.cumsum((low.astype(_U) + _U(1)) * self.powers[:n], out=sums[1:])
        hashes = _spread((sums[end] - sums[begin]) * self.inverses[begin] ^ ((end - begin).astype(_U) << _U(40)))
        whole = np.flatnonzero(of == _WHOLE)
        if len(whole):  # by their own bytes, since letters may differ in case
            data = raw.tobytes()
            hashes[whole] = np.fromiter((xxhash.xxh3_64_intdigest(data[b:e], 1) for b, e in zip(begin[whole].tolist(), end[whole].tolist())), _U, len(whole))
        hashes |= hashes == 0
        numbers = self.table.find(hashes)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            fresh, first = np.unique(hashes[new], return_index=True)
            first = new[first]
            if self.table.count + len(fresh) > self.table.most:  # others go, perhaps some of those found just now
                fresh, first = np.unique(hashes, return_index=True)
                self.table.room(len(fresh))
                unknown = self.table.find(fresh) < 0
                fresh, first, new = fresh[unknown], first[unknown], np.arange(len(hashes))
            for is_whole, data in ((False, low), (True, raw)):
                some = (of[first] == _WHOLE) == is_whole
                if some.any():
                    at, data = first[some], data.tobytes()
                    self._learn(fresh[some], [data[b:e] for b, e in zip(begin[at].tolist(), end[at].tolist())], is_whole)
            numbers[new] = self.table.find(hashes[new])
        return numbers, begin

    def flat(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin and the last's end.

        ``raw``: bytes of all texts; ``offsets``: where each begins, and the end.
        """
        ids, counts = [], np.zeros(len(offsets) - 1, np.int64)
        at, end = int(offsets[0]), int(offsets[-1])
        while at < end:
            to = self._chunk_end(raw, offsets, at, end)
            i, j = np.searchsorted(offsets[:-1], (at, to))  # texts that begin here
            starts = offsets[i:j] - at
            numbers, begin = self._parts(raw[at:to], starts)
            some = self.table.ids(numbers)
            text = np.searchsorted(offsets, at + begin, "right") - 1
            counts += np.bincount(text, self.table.length[numbers], len(counts)).astype(np.int64)
            ids.append(some)
            at = to
        return np.concatenate(ids) if ids else np.empty(0, np.uint32), np.concatenate([[0], np.cumsum(counts)])

    @staticmethod
    def _chunk_end(raw: np.ndarray, offsets: np.ndarray, at: int, end: int) -> int:
        """A place near ``at`` + ``CHUNK`` where no word is cut: white space or a text's end."""
        to = at + CHUNK
        if to >= end:
            return end
        last = int(offsets[np.searchsorted(offsets, to, "right") - 1])
        if last > at + CHUNK // 2:
            return last
        step = CHUNK // 16
        limit = int(offsets[np.searchsorted(offsets, to)])  # the end of the text that ``to`` is in
        for low in range(to, limit, step):
            white = np.flatnonzero(_KINDS[raw[low : min(low + step, limit)]] == _SPACE)
            if len(white):
                return low + int(white[0])
        return limit

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, at = self.flat(*arrow_bytes(pa.array(texts, pa.string())))
        return [ids[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings, null being empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets

"""Token ids of whole texts by the tokenizers library, with the words that recur encoded once for each worker."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .langid import spans
from .shingles import LONGEST, eights, hashes, mixed

#: Words kept by a worker (about 60 bytes each); beyond it the memory is given up and filled again.
MOST_WORDS = 1 << 21
#: Bytes of text worked on at a time (a longer text is worked on alone), and characters of one that is cut first.
SLICE, PIECE = 1 << 20, 1 << 22
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: 1: space, 2: line feed, 3: white space of any other kind.
_WHITE = np.zeros(256, np.uint8)
_WHITE[[9, 11, 12, 13, 28, 29, 30, 31]] = 3
_WHITE[[32, 10]] = 1, 2
_HEAD = np.uint64(0x5851F42D4C957F2D)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def wide_spaces(data: np.ndarray) -> np.ndarray:
    """Where white space outside ASCII begins in UTF-8."""
    at = lambda i: data[np.minimum(i, len(data) - 1)]
    two, three = np.flatnonzero(data == 0xC2), np.flatnonzero((data >= 0xE1) & (data <= 0xE3))
    two = two[np.isin(at(two + 1), (0x85, 0xA0))]
    code = (data[three].astype(np.int64) << 16) | (at(three + 1).astype(np.int64) << 8) | at(three + 2)
    low = (code >= 0xE28080) & (code <= 0xE2808A)
    return np.concatenate((two, three[low | np.isin(code, (0xE19A80, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080))]))


class WordTable:
    """Ids by a word's 64-bit hash in open addressing, with the word's kind and its bytes to compare."""

    def __init__(self, most: int):
        self.bits = max(4, int(most).bit_length())
        self.keys, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.start, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.at, self.length, self.head = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(1024, np.bool_)
        self.ids, self.bytes = np.zeros(4096, np.uint32), np.zeros(4096, np.uint8)
        self.size = self.used = self.filled = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        rest = np.arange(len(keys))
        while rest.size:
            held = self.keys[slot]
            hit = held == keys[rest]
            out[rest[hit]] = self.entry[slot[hit]]
            on = ~hit & (held != 0)
            rest, slot = rest[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def same(self, entry: np.ndarray, data: np.ndarray, lo: np.ndarray, size: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Whether each entry is the word of data at lo, byte by byte; data ends in eight bytes of padding."""
        out = (self.length[entry] == size) & (self.head[entry] == head)
        rest, at, place, left = np.flatnonzero(out), lo, self.at[entry], size
        at, place, left = at[rest], place[rest], left[rest]
        while rest.size:
            equal = eights(data, at, left) == eights(self.bytes, place, left)
            out[rest[~equal]] = False
            on = equal & (left > 8)
            rest, at, place, left = rest[on], at[on] + 8, place[on] + 8, left[on] - 8
        return out

    def add(self, keys: np.ndarray, words: list[bytes], heads: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Takes in words whose distinct keys aren't there."""
        entry = np.arange(len(keys), dtype=np.int32) + self.size
        lengths = np.array([len(w) for w in words], np.int64)
        size, used, filled = self.size + len(keys), self.used + len(ids), self.filled + int(lengths.sum())
        if size > len(self.start):  # room grows by half, so that it is copied seldom
            self.start, self.count, self.at, self.length, self.head = (np.resize(x, size + size // 2) for x in (self.start, self.count, self.at, self.length, self.head))
        if used > len(self.ids):
            self.ids = np.resize(self.ids, used + used // 2)
        if filled + 8 > len(self.bytes):
            self.bytes = np.resize(self.bytes, filled + filled // 2 + 8)
        self.start[self.size : size], self.count[self.size : size] = self.used + np.cumsum(counts) - counts, counts
        self.at[self.size : size], self.length[self.size : size], self.head[self.size : size] = self.filled + np.cumsum(lengths) - lengths, lengths, heads
        self.ids[self.used : used], self.bytes[self.filled : filled] = ids, np.frombuffer(b"".join(words), np.uint8)
        self.size, self.used, self.filled = size, used, filled
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while keys.size:
            free = self.keys[slot] == 0
            _, winner = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            winner = winner[free[winner]]
            self.keys[slot[winner]], self.entry[slot[winner]] = keys[winner], entry[winner]
            rest = np.ones(len(keys), np.bool_)
            rest[winner] = False
            keys, entry, slot = keys[rest], entry[rest], (slot[rest] + ~free[rest]) & ((1 << self.bits) - 1)


_WORKERS: dict[str, WordEncoder] = {}


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, which keeps its words from one task to the next."""
    if path not in _WORKERS:
        _WORKERS[path] = WordEncoder(path)
    return _WORKERS[path]


class WordEncoder:
    """Ids as little-endian unsigned 32-bit integers, the same as encoding each whole text.

    A space between two characters that are no white space ends a word for the tokenizers used here: nothing that
    they normalise, split or merge reaches over it. So does such a single line feed, which is left at the start of
    what follows. Texts are cut at these places, all at once in a batch's bytes, and each distinct word is encoded
    once. A text with any other white space, or with a word of more than ``LONGEST`` bytes, is cut at single spaces
    only and encoded without this memory; one with the string of a special token is encoded as a whole.
    """

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)  # as it is: the strings of special tokens become those
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.most_words, self.table = most_words, WordTable(most_words)
        # What stands between words that are encoded in one string: a line feed where it has an id, else a control
        # character between spaces. Neither joins with what is beside it.
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.mark, self.mark_ids = ("\n", line) if line else (" \x01 ", self.tokenizer.encode(" \x01 ", add_special_tokens=False).ids)

    def each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids: words as they follow a space, or a line feed that they start with."""
        line = np.array([w[0] == "\n" for w in words], np.bool_)
        if len(self.mark_ids) != 1 or any("\x01" in w for w in words):  # one by one
            found = self.each([w if n else f" {w}" for w, n in zip(words, line, strict=True)])
            return np.array([len(x) for x in found], np.int64), np.concatenate(found) if found else np.zeros(0, np.uint32)
        text = "".join([self.mark + (w[1:] if w[0] == "\n" else f" {w}") for w in words])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        marks = np.flatnonzero(ids == self.mark_ids[0])
        stays = line & (self.mark == "\n")  # a line feed's own id
        keep = np.ones(len(ids), np.bool_)
        keep[marks[~stays]] = False
        return np.diff(marks, append=len(ids)) - 1 + stays, ids[keep]

    def odd(self, text: str) -> bytes:
        """A text with white space that isn't single, cut at what single spaces it has, piece by piece."""
        if any(x in text for x in self.special):
            return self.each([text])[0].tobytes()
        first, *others = _SINGLE_SPACE.split(text)
        return b"".join(x.tobytes() for x in self.each([first, *(f" {w}" for w in others)]))

    def with_special(self, data: np.ndarray, ends: np.ndarray) -> list[int]:
        """The texts that hold a special token's string, or one that begins in one and ends in the next."""
        whole, found = data.tobytes(), []
        for x in (s.encode() for s in self.special):
            at = whole.find(x)
            while at >= 0:
                i = int(np.searchsorted(ends, at, "right")) - 1
                found.append(i)
                at = whole.find(x, max(at + 1, int(ends[i + 1]) - len(x) + 1))
        return found

    def slice(self, data: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The ids of texts that lie one after another."""
        n = len(ends) - 1
        if not len(data):
            return [b""] * n
        white = _WHITE[data]
        near = np.zeros(len(data) + 1, np.bool_)
        near[ends] = True
        blank = white > 0
        bad = (white == 3) | (blank & (near[:-1] | near[1:]))
        bad[1:] |= blank[1:] & blank[:-1]
        strange = np.zeros(n, np.bool_)
        strange[np.searchsorted(ends, np.concatenate((np.flatnonzero(bad), wide_spaces(data))), "right") - 1] = True
        strange[self.with_special(data, ends)] = True

        kind = np.zeros(len(data), np.uint8)  # of what starts at a byte: 1 after a space, 2 a line feed, 3 a text
        kind[1:] = white[:-1] == 1
        kind[white == 2] = 2
        kind[ends[:-1][ends[1:] > ends[:-1]]] = 3
        lo = np.flatnonzero(kind)
        kind = kind[lo]
        hi = np.concatenate((lo[1:], [len(data)])) - np.concatenate((kind[1:] == 1, [False]))
        owner = np.searchsorted(ends, lo, "right") - 1
        if strange.any():
            good = ~strange[owner]
            lo, hi, kind, owner = lo[good], hi[good], kind[good], owner[good]
        size = hi - lo
        long = size > LONGEST
        if long.any():  # not worth remembering
            strange[owner[long]] = True
            good = ~strange[owner]
            lo, hi, kind, owner, size = lo[good], hi[good], kind[good], owner[good], size[good]
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        key = hashes(padded, lo, size)
        head = kind == 3
        key[head] = mixed(key[head] ^ _HEAD)
        key |= key == 0

        entry = self.table.find(key)
        missing = np.flatnonzero(entry < 0)
        if missing.size:
            _, one = np.unique(key[missing], return_index=True)
            one = missing[one]
            if self.table.size + len(one) > self.most_words:
                self.table = WordTable(max(self.most_words, len(key)))
                _, one = np.unique(key, return_index=True)
            one = np.concatenate((one[~head[one]], one[head[one]]))
            words = [data[a:b].tobytes() for a, b in zip(lo[one], hi[one], strict=True)]
            tails = int((~head[one]).sum())
            counts, ids = self.lookup([w.decode() for w in words[:tails]])
            heads = self.each([w.decode() for w in words[tails:]])
            self.table.add(key[one], words, head[one], np.concatenate((counts, np.array([len(x) for x in heads], np.int64))), np.concatenate((ids, *heads)))
            entry = self.table.find(key)
        strange[owner[~self.table.same(entry, padded, lo, size, head)]] = True  # two words with one hash

        count = self.table.count[entry].astype(np.int64)
        before = np.cumsum(count) - count
        flat = self.table.ids[np.repeat(self.table.start[entry] - before, count) + np.arange(int(count.sum()))].astype("<u4").tobytes()
        words = np.searchsorted(owner, np.arange(n + 1))
        place = np.append(before, count.sum())[words] * 4
        out = [flat[a:b] for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
        for i in np.flatnonzero(strange):
            out[i] = self.odd(data[ends[i] : ends[i + 1]].tobytes().decode())
        return out

    def documents(self, column: pa.Array, end: bytes) -> Iterator[bytes]:
        """The ids of each text of a column, null as empty, with ``end`` appended."""
        data, ends = spans(column)
        i, n = 0, len(ends) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE, "right")) - 1)
            if ends[j] - ends[i] > PIECE:
                yield b"".join(self.slice(np.frombuffer(p, np.uint8), np.array([0, len(p)]))[0] for p in self.pieces(data[ends[i] : ends[j]].tobytes())) + end
            else:
                yield from (x + end for x in self.slice(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]))
            i = j

    @staticmethod
    def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
        """A long text cut before single spaces, which only the first byte of a piece can be."""
        at, plain = 0, re.compile(rb"(?<=[!-~]) (?=[!-~])")
        while len(text) - at > size:
            cut = plain.search(text, at + size)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

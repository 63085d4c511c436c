"""Token ids of many texts, equal to the tokenizers library's, with work shared between equal words.

White space ends every pre-token of this vocabulary, so a text's ids are its words' ids in order.
A word of ASCII marks and plain Latin-1 letters falls into letter runs, single digits and runs of
other marks; these pieces go, lower-cased, straight to the library's BPE. Any other word is one
piece that goes through the library's full chain. Each worker process keeps the ids of the pieces it
has met in a bounded table of arrays; pieces are told apart by their length and 128 bits of hash.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from docweave.llm.textblock import Block, trim

DEFAULT = "word_bpe_49k.json"
CACHE_PIECES = 400_000
GROUP = 192  # pieces to a text of the library's BPE
CHUNK = 1 << 17  # pieces that are looked up at a time
SLOT_BITS = 20  # the table never holds more than CACHE_PIECES + CHUNK pieces

_SEP = np.zeros(256, bool)
_SEP[[32, *range(9, 14)]] = True
#: Letter, digit or mark; a word with any byte of class 3 isn't taken apart.
_KIND = np.full(256, 2, np.uint8)
_KIND[65:91] = _KIND[97:123] = _KIND[0x80:0xC0] = _KIND[0xC3] = 0
_KIND[48:58] = 1
_KIND[:32] = _KIND[127] = _KIND[0x27] = _KIND[0x3C] = _KIND[0xC0:0xC3] = _KIND[0xC4:] = 3
_KIND[9:14] = 2  # they end words, so they are in none
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LIVE: dict = {}
U = np.uint64
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
_MULTIPLY = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


def piece_keys(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each span, read 8 bytes at a time; ``low`` has 8 bytes more than the text."""
    words = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
    left = ends - starts
    keys = left.astype(U), ~left.astype(U)
    at, rest = slice(None), starts
    while len(rest):
        w = words[rest] & _MASK[np.minimum(left, 8)]
        for h, by in zip(keys, _MULTIPLY):
            x = (h[at] ^ w) * by
            x ^= x >> U(32)
            x *= by
            x ^= x >> U(29)
            h[at] = x
        more = np.flatnonzero(left > 8)
        at = more if isinstance(at, slice) else at[more]
        rest, left = rest[more] + 8, left[more] - 8
    return keys


class PieceTable:
    """Ids of pieces by their two hashes, in open addressing; entries are numbered as they come."""

    def __init__(self):
        self.entry = np.full(1 << SLOT_BITS, -1, np.int32)
        self.keys = np.zeros((2, 1 << 16), U)
        self.begin = np.zeros(1 << 16, np.int64)  # of an entry's ids; the next one's begin is their end
        self.ids = np.zeros(1 << 18, np.uint32)
        self.hit = np.zeros(1 << 16, bool)  # looked up since it came or was kept
        self.n = 0

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Entries, -1 for unknown pieces."""
        slot = (one >> U(64 - SLOT_BITS)).astype(np.int64)
        found = self.entry[slot]
        look = np.flatnonzero(found >= 0)
        while len(look):
            e = found[look]
            look = look[(self.keys[0][e] != one[look]) | (self.keys[1][e] != two[look])]
            slot[look] = (slot[look] + 1) & ((1 << SLOT_BITS) - 1)
            found[look] = self.entry[slot[look]]
            look = look[found[look] >= 0]
        self.hit[found[found >= 0]] = True
        return found

    def add(self, one: np.ndarray, two: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """New pieces, each once."""
        old, new = self.n, self.n + len(one)
        used = int(self.begin[old])
        if new >= len(self.begin):
            wide = max(2 * len(self.begin), new + 1)
            self.keys = np.concatenate([self.keys[:, :old], np.zeros((2, wide - old), U)], axis=1)
            self.begin = np.concatenate([self.begin[: old + 1], np.zeros(wide - old - 1, np.int64)])
            self.hit = np.concatenate([self.hit[:old], np.zeros(wide - old, bool)])
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(max(used, len(ids)), np.uint32)])
        self.keys[0, old:new], self.keys[1, old:new] = one, two
        self.begin[old + 1 : new + 1] = used + np.cumsum(size)
        self.ids[used : used + len(ids)] = ids
        self.hit[old:new] = False
        self.n = new
        slot, todo = (one >> U(64 - SLOT_BITS)).astype(np.int64), np.arange(len(one))
        while len(todo):
            free = todo[self.entry[slot[todo]] < 0]
            self.entry[slot[free]] = free + old  # of several that want a slot the last gets it
            todo = todo[self.entry[slot[todo]] != todo + old]
            slot[todo] = (slot[todo] + 1) & ((1 << SLOT_BITS) - 1)

    def get(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries' ids in order, and how many each has."""
        begin = self.begin[entries]
        n = self.begin[entries + 1] - begin
        at = np.repeat(begin - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return self.ids[at], n

    def thin(self) -> PieceTable:
        """A table of those looked up again, half of CACHE_PIECES at most and as many ids a piece as is usual."""
        keep = np.flatnonzero(self.hit[: self.n])[-(CACHE_PIECES // 2) :]
        keep = keep[np.cumsum(self.begin[keep + 1] - self.begin[keep]) <= 8 * CACHE_PIECES]
        out = PieceTable()
        ids, n = self.get(keep)
        out.add(self.keys[0][keep], self.keys[1][keep], n, ids)
        return out


class WordEncoder:
    """The ids of pieces, each encoded once while it stays in the table of ``CACHE_PIECES``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.full.model)  # the two share it
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.full.get_vocab_size(True), bool)
        for token, i in self.full.get_vocab(True).items():
            self.ends[i] = token.endswith("</w>")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)} | {32: " "}
        self.table = PieceTable()
        trim()  # reading the vocabulary takes twice what is kept of it

    def _bpe(self, pieces: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Sizes and ids of lower-cased pre-tokens, some dozens to a text; each ends at its end-of-word id."""
        sizes, out = [], []
        for at in range(0, len(pieces), GROUP):
            group = pieces[at : at + GROUP]
            text = b" ".join(group).decode("latin1").translate(self.alphabet)
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids])
            if len(cut) != len(group) or cut[-1] + 1 != len(ids):
                more = self._whole(group)
                sizes, out = sizes + more[0], out + more[1]
            else:
                cut[1:] -= cut[:-1].copy()
                cut[0] += 1
                sizes.append(cut)
                out.append(ids)
        return sizes, out

    def _whole(self, words: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        ids = [e.ids for e in self.full.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return [np.array(list(map(len, ids)), np.int64)], [np.array(x, np.uint32) for x in ids]

    def _learn(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        for is_whole, encode in (False, self._bpe), (True, self._whole):
            k = np.flatnonzero(whole == is_whole)
            if len(k):
                sizes, ids = encode(list(map(raw.__getitem__, map(slice, starts[k].tolist(), ends[k].tolist()))))
                self.table.add(one[k], two[k], np.concatenate(sizes), np.concatenate(ids))

    def encode(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and each row's count."""
        starts, ends, row = b.spans(_SEP)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(b.n, np.int64)
        data = b.data
        kind = _KIND[data]
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        follow = data[after]
        kind[after[(follow == 0x97) | (follow == 0xB7)]] = 3
        odd = np.bitwise_or.reduceat(kind == 3, starts)
        odd_words = np.flatnonzero(odd)
        low = np.zeros(len(data) + 8, np.uint8)
        low[:-8] = _LOWER[data]
        low[after[(follow >= 0x80) & (follow <= 0x9E)]] += 32
        first = np.zeros(len(data), bool)
        first[1:] = kind[1:] != kind[:-1]
        first |= kind == 1
        first[_SEP[data]] = False
        first[starts] = True
        for s, e in zip(starts[odd_words].tolist(), ends[odd_words].tolist()):
            first[s + 1 : e] = False
            low[s:e] = data[s:e]
        ps = np.flatnonzero(first)
        new = np.zeros(len(data), bool)
        new[starts] = True
        word = np.cumsum(new[ps]) - 1
        pe = np.append(ps[1:], len(data))
        pe = np.minimum(pe, ends[word])
        raw, out, count = low.tobytes(), [], np.zeros(b.n, np.int64)
        for at in range(0, len(ps), CHUNK):
            s, e, w = ps[at : at + CHUNK], pe[at : at + CHUNK], word[at : at + CHUNK]
            one, two = piece_keys(low, s, e)
            entries = self.table.find(one, two)
            lost = np.flatnonzero(entries < 0)
            if len(lost):
                # Of pieces that differ in ``two`` alone only the first is learnt here; the rest go round again.
                while len(lost):
                    k = lost[np.unique(one[lost], return_index=True)[1]]
                    self._learn(raw, s[k], e[k], odd[w[k]], one[k], two[k])
                    entries[lost] = self.table.find(one[lost], two[lost])
                    lost = lost[entries[lost] < 0]
            ids, n = self.table.get(entries)
            out.append(ids)
            count += np.bincount(row[w], weights=n, minlength=b.n).astype(np.int64)
            if self.table.n > CACHE_PIECES or len(self.table.ids) > 16 * CACHE_PIECES:
                self.table = self.table.thin()
        return (out[0] if len(out) == 1 else np.concatenate(out)), count


def encoder(path: str | None = None) -> WordEncoder:
    """This process's encoder for a vocabulary file; made once."""
    import docweave.llm.tokens as home  # the importable module, so that the table outlives a task

    path = path or default_path()
    if path not in home._LIVE:
        home._LIVE[path] = WordEncoder(path)
    return home._LIVE[path]


def encode_rows(arr: pa.Array, path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    return encoder(path).encode(Block(arr))

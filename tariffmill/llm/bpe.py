"""Byte-level BPE as a bounded-lookahead streaming transducer, and its incremental decoder.

Encoding.  A token is *stable* once no further input can change it.  ``sufficient_lookahead``
derives from the merge list alone how many bytes must follow a token for that: the boundary
between what two different continuations share and what they don't moves left only when a rule
(u, v) merges across it, by len(u) bytes, and the next such rule must come later in the list
and have u at the left edge of its own right part.  The longest such chain bounds the reach.
The encoder buffers a window of a piece, merges it, emits every token that has that many bytes behind it
or the piece's end, and goes on from the last emitted boundary, so memory does not depend on the
length of a piece.  ``transduce_many`` runs this machine over all pieces of a block side by side, and all
tokens come from it; a piece longer than a block goes through it in parts (``transduce``).

Decoding maps ids to bytes and feeds them through an incremental UTF-8 state machine, so a
character split over tokens appears when its last byte does; invalid bytes give U+FFFD.

Results equal the ``tokenizers`` library's with ``add_special_tokens=False`` and decoding with
``skip_special_tokens=False``; strings of added tokens inside a text become their ids.

Nulls count as empty texts, which have no tokens.  Repeated rows are treated one by one, empty
tables give empty results, extra columns are ignored or carried as asked.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .blocks import release

#: Unicode white space, as the pre-tokenizer's ``\s`` has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: The pre-tokenizer's pattern.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^S\p{L}\p{N}]+|[S]+(?![^S])|[S]+".replace("S", regex.escape(WHITE, special_only=False))
#: Before which place a text can be cut: a piece surely starts there.
SAFE = regex.compile(r"[^S](?=[S])|\p{L}(?=[^S\p{L}])|\p{N}(?=[^S\p{N}])|[^S\p{L}\p{N}'](?=[\p{L}\p{N}])".replace("S", regex.escape(WHITE, special_only=False)))
#: Distinct pieces that a worker remembers before it starts afresh.
CACHE = 250_000
#: Pieces of up to so many bytes are remembered, and merged many at once.
SHORT = 64
#: Windows of long pieces that are remembered while one piece is coded.
WINDOWS = 64
NO_MERGE = 1 << 62
SLOT_BITS = 18
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Short pieces are looked up by a 64-bit polynomial hash of their bytes with random coefficients, and a second one must agree; of those that don't each is coded by itself.
BYTE_HASH = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHECK_HASH = np.random.default_rng(21).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0xD1342543DE82EF95


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, n at least."""
    return _powers(max(20, n.bit_length()))


@lru_cache(maxsize=1)
def character_kinds() -> np.ndarray:
    """For each code point 1 if it is a letter, 2 a number, 3 white space, else 0."""
    kinds = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for k, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, "[" + regex.escape(WHITE, special_only=False) + "]+")):
        for m in regex.finditer(pattern, every):
            kinds[ord(m[0][0]) : ord(m[0][-1]) + 1] = k
    return kinds


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file: printable ones for themselves, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes that must follow a token before it is final, whatever comes next.

    ``reach[t]``: how far left the effect of unknown input may have come once a rule with left
    part t has merged across the boundary.  Rules are visited in order, so chains rise in rank.
    """
    left_edge = {a + b: a for a, b in merges}
    reach: dict[bytes, int] = {}
    longest = 0
    for a, b in merges:
        before, edge = 0, b
        while edge is not None:
            before = max(before, reach.get(edge, 0))
            edge = left_edge.get(edge)
        now = before + len(a)
        if now > reach.get(a, 0):
            reach[a] = now
            longest = max(longest, now)
    return longest


class Bpe:
    """A byte-level BPE vocabulary read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        vocab = {raw(k): v for k, v in told["model"]["vocab"].items()}
        merges = [tuple(raw(x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in told["model"]["merges"]]
        self.added = {a["content"]: a["id"] for a in told["added_tokens"]}
        self.bytes_of = {v: k for k, v in vocab.items()} | {i: s.encode() for s, i in self.added.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.first = [vocab[bytes([b])] for b in range(256)]
        # rank and result in one integer, so the least value is the earliest rule
        self.rule = {vocab[a] << 20 | vocab[b]: i << 20 | vocab[a + b] for i, (a, b) in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges)
        self.window = 2 * self.lookahead + 2 * max(map(len, vocab))
        self.pieces = regex.compile(PIECES)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.first_np = np.array(self.first)
        self.size_np = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.size_np[i] = len(b)
        self._hash_rules()
        self.kinds = character_kinds()
        self._forget()

    def _forget(self) -> None:
        #: Sorted hashes of remembered pieces, which of ``kept`` each is, and by that the second hashes and tokens.
        self.known, self.known_slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.kept, self.kept_at, self.kept_check = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint64)

    def _hash_rules(self) -> None:
        """Rules in an open-addressed table for vectorised look-ups."""
        keys = np.array(list(self.rule), np.int64)
        home = (keys.view(np.uint64) * SPREAD >> np.uint64(64 - SLOT_BITS)).view(np.int64)
        self.slot_key = np.full((1 << SLOT_BITS) + 4096, -1, np.int64)
        self.slot_rule = np.full_like(self.slot_key, NO_MERGE)
        for key, at, rule in zip(keys.tolist(), home.tolist(), self.rule.values()):
            to = at
            while self.slot_key[to] >= 0:
                to += 1
            self.slot_key[to], self.slot_rule[to] = key, rule

    # -- merging

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of one whole buffer."""
        first = self.first
        ids = [first[b] for b in piece]
        if len(ids) > 48:
            return self._merge_long(ids)
        get = self.rule.get
        ranks = [get(a << 20 | b, NO_MERGE) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_MERGE:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best & 0xFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], NO_MERGE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.rule.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or get(ids[i] << 20 | ids[j]) != rank:
                continue
            ids[i], ids[j], after[i] = rank & 0xFFFFF, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := get(ids[i] << 20 | ids[after[j]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := get(ids[k] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (r, k))
        return [x for x in ids if x >= 0]

    def transduce(self, parts: Iterable[bytes]) -> Iterator[int]:
        """The tokens of one piece that arrives in parts, each as soon as it is stable; the buffer holds a window at most, and one part."""
        held, seen = bytearray(), {}
        for part in parts:
            for at in range(0, len(part), self.window):
                held += part[at : at + self.window]
                if len(held) < self.window:
                    continue
                whole = bytes(held)
                if whole not in seen:  # long pieces often repeat themselves
                    if len(seen) >= WINDOWS:
                        seen.clear()
                    merged = np.array(self.merge(whole))
                    ends = np.cumsum(self.size_np[merged])
                    n = int(np.searchsorted(ends, len(whole) - self.lookahead, side="right"))
                    seen[whole] = merged[:n].tolist(), int(ends[n - 1]) if n else 0
                tokens, end = seen[whole]
                yield from tokens
                del held[:end]
        yield from self.merge(bytes(held))

    def transduce_many(self, coded: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of many whole pieces, which begin ``at`` places of ``coded``, and how many each has.

        In each round every unfinished piece has a window in its buffer; tokens that end with the piece, or with
        the lookahead behind them, are stable and leave, and the buffer goes on from there.
        """
        begin, end, going = at.copy(), at + size, np.arange(len(at))
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while len(going):
            width = np.minimum(end[going] - begin[going], self.window)
            tokens, counts = self._merge_buffers(coded, begin[going], width)
            buffer = np.repeat(np.arange(len(going)), counts)
            wide = self.size_np[tokens]
            ends = np.cumsum(wide)
            ends -= np.repeat(np.r_[0, ends[np.cumsum(counts)[:-1] - 1]] if len(counts) else counts, counts)
            whole = begin[going] + width == end[going]
            stable = ends <= np.where(whole, width, width - self.lookahead)[buffer]
            out.append((going[buffer[stable]], tokens[stable]))
            begin[going] += np.bincount(buffer[stable], wide[stable], len(going)).astype(np.int64)
            going = going[~whole]
        owners, tokens = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(owners, kind="stable")
        return tokens[order], np.bincount(owners, minlength=len(at))

    def _merge_buffers(self, coded: np.ndarray, begin: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of each buffer: short ones together, long ones one by one."""
        short = np.flatnonzero(width <= SHORT)
        tokens: list[np.ndarray] = []
        counts = np.zeros(len(begin), np.int64)
        if len(short):
            wide = width[short]
            spread = np.repeat(begin[short] - np.r_[0, np.cumsum(wide)[:-1]], wide) + np.arange(wide.sum())
            merged, counts[short] = self.merge_many(self.first_np[coded[spread]], wide)
            if len(short) == len(begin):
                return merged, counts
            tokens = np.split(merged, np.cumsum(counts[short])[:-1])
        of = dict(zip(short.tolist(), tokens))
        for i in np.flatnonzero(width > SHORT).tolist():
            of[i] = np.array(self.merge(coded[begin[i] : begin[i] + width[i]].tobytes()), np.int64)
            counts[i] = len(of[i])
        return np.concatenate([of[i] for i in range(len(begin))]), counts

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of tokens their rule (rank and result in one integer), or NO_MERGE."""
        key = a << 20 | b
        slot = (key.view(np.uint64) * SPREAD >> np.uint64(64 - SLOT_BITS)).view(np.int64)
        there = self.slot_key[slot]
        out = np.where(there == key, self.slot_rule[slot], NO_MERGE)
        todo = np.flatnonzero((there != key) & (there >= 0))
        while len(todo):  # the next slots, until an empty one
            slot[todo] += 1
            there = self.slot_key[slot[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.slot_rule[slot[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out

    def merge_many(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` for many buffers at once: ``ids`` holds their bytes' tokens end to end, ``sizes`` how many each has, none of them 0.

        Each round applies the earliest rule of every buffer at all its places, from the left.
        """
        owner = np.repeat(np.arange(len(sizes)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rule = np.full(len(ids), NO_MERGE)
            same = np.flatnonzero(owner[1:] == owner[:-1])
            rule[same] = self._find(ids[same], ids[same + 1])
            least = np.minimum.reduceat(rule, starts)
            width = np.diff(np.r_[starts, len(ids)])
            going = np.repeat(least < NO_MERGE, width)
            if not going.all():
                done.append((owner[~going], ids[~going]))
            best = np.repeat(least, width)
            place = (rule == best) & going
            twice = np.flatnonzero(place[1:] & place[:-1])
            if len(twice):  # a run of one token: every other place of the run
                at = np.arange(len(place))
                begin = np.maximum.accumulate(np.where(place & ~np.r_[False, place[:-1]], at, -1))
                place &= (at - begin) % 2 == 0
            ids = np.where(place, best & 0xFFFFF, ids)
            keep = going & ~np.r_[False, place[:-1]]
            ids, owner = ids[keep], owner[keep]
        owners, tokens = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owners, kind="stable")
        return tokens[order], np.bincount(owners, minlength=len(sizes))

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pieces start, for texts end to end as code points; ``first`` marks each text's first.

        The same pieces as the pattern gives: of white space before other characters the last
        one stands apart, and if it is a space it belongs to what follows.
        """
        kind = self.kinds[points]
        n = len(points)
        last = np.r_[first[1:], True]
        white = kind == 3
        joins = np.r_[False, (points[:-1] == 32)] & ~first
        changed = np.r_[True, kind[1:] != kind[:-1]] | first
        before_other = ~last & np.r_[~white[1:], False]
        starts = np.where(white, changed | before_other, changed & ~joins)
        marks = np.flatnonzero((points == 39) & starts)
        if len(marks):
            at = lambda k: np.where(marks + k < n, points[np.minimum(marks + k, n - 1)], 0)
            inside = lambda k: (marks + k < n) & ~first[np.minimum(marks + k, n - 1)]
            two = np.isin(at(1), [115, 116, 109, 100]) & inside(1)
            three = ((at(1) == 114) & (at(2) == 101) | (at(1) == 118) & (at(2) == 101) | (at(1) == 108) & (at(2) == 108)) & inside(1) & inside(2)
            starts[marks[two | three] + 1] = False
            for hit, k in ((two, 2), (three, 3)):
                to = marks[hit] + k
                starts[to[to < n]] = True
        return starts

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts end to end, and how many each has; no text is empty or has added tokens."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        coded = np.frombuffer(whole.encode("utf-8"), np.uint8)
        first = np.zeros(len(points), bool)
        text_at = np.cumsum([0, *map(len, texts)])[:-1]
        first[text_at] = True
        piece_at = np.flatnonzero(self._starts(points, first))
        text_piece = np.searchsorted(piece_at, text_at)
        byte_at = piece_at if len(coded) == len(points) else np.flatnonzero((coded & 0xC0) != 0x80)[piece_at]
        size = np.diff(np.r_[byte_at, len(coded)])
        powers, back = powers_of(len(coded) + 1)

        def keys(of: np.ndarray) -> np.ndarray:
            sums = np.cumsum(of[coded] * powers[: len(coded)])
            key = np.r_[sums[byte_at[1:] - 1], sums[-1]] - np.r_[np.uint64(0), sums[byte_at[1:] - 1]]
            return key * back[byte_at] * SPREAD + size.astype(np.uint64)

        key, check = keys(BYTE_HASH), keys(CHECK_HASH)
        short = np.flatnonzero(size <= SHORT)
        code, unique = pd.factorize(key[short])
        chosen = np.empty(len(unique), np.int64)
        chosen[code[::-1]] = short[::-1]
        if len(self.known) > CACHE:
            self._forget()
        place = np.searchsorted(self.known, unique)
        where = np.full(len(unique), -1)
        if len(self.known):
            near = np.minimum(place, len(self.known) - 1)
            where = np.where(self.known[near] == unique, self.known_slot[near], -1)
        other = np.zeros(len(unique), bool)  # remembered under this hash is another piece
        found = np.flatnonzero(where >= 0)
        other[found] = self.kept_check[where[found]] != check[chosen[found]]
        fresh = np.flatnonzero(where < 0)
        fresh = fresh[np.argsort(unique[fresh], kind="stable")]
        # pieces coded by themselves: long ones, and those whose hashes meet by chance
        alone = np.sort(np.r_[np.flatnonzero(size > SHORT), short[(check[short] != check[chosen[code]]) | other[code]]])
        todo = np.r_[chosen[fresh], alone]
        tokens, counts = self.transduce_many(coded, byte_at[todo], size[todo])
        begin = len(self.kept_check)
        pool = np.concatenate([self.kept, tokens])
        pool_at = np.concatenate([self.kept_at, self.kept_at[-1] + np.cumsum(counts)])
        where[fresh] = begin + np.arange(len(fresh))
        slot = np.empty(len(size), np.int64)
        slot[short] = where[code]
        slot[alone] = begin + len(fresh) + np.arange(len(alone))
        count = pool_at[slot + 1] - pool_at[slot]
        ends = np.cumsum(count)
        ids = pool[np.repeat(pool_at[slot] - (ends - count), count) + np.arange(ends[-1])]
        # the short ones are remembered
        self.known = np.insert(self.known, place[fresh], unique[fresh])
        self.known_slot = np.insert(self.known_slot, place[fresh], where[fresh])
        self.kept_at = pool_at[: begin + len(fresh) + 1]
        self.kept = pool[: self.kept_at[-1]].copy() if len(alone) else pool
        self.kept_check = np.r_[self.kept_check, check[chosen[fresh]]]
        return ids, np.add.reduceat(count, text_piece)

    def encode_texts(self, texts: list[str | None], block: int = 1 << 18) -> Iterator[Iterable[np.ndarray]]:
        """For each text in turn its ids in chunks, to be taken before the next text's.

        Texts are coded in blocks of about ``block`` characters; longer ones leave chunk by chunk.
        """
        held: list[str] = []
        room = block

        def flush() -> Iterator[list[np.ndarray]]:
            parts = [t for t in held if t]
            ids, counts = self._block(parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            at = k = 0
            for t in held:
                n = int(counts[k]) if t else 0
                k += bool(t)
                yield [ids[at : at + n]]
                at += n
            held.clear()

        for text in texts:
            text = text or ""
            apart = len(text) > block or self.marks is not None and self.marks.search(text)
            if held and (apart or len(text) > room):
                yield from flush()
                room = block
            if apart:
                yield self.encode_stream(text, block)
            else:
                held.append(text)
                room -= len(text)
        if held:
            yield from flush()

    def encode_stream(self, text: str, block: int = 1 << 18) -> Iterator[np.ndarray]:
        """The ids of one text in chunks; besides the text just a block of it is held, however long its pieces are."""
        at = 0
        for mark in self.marks.finditer(text) if self.marks is not None else ():
            yield from self._stretch(text, at, mark.start(), block)
            yield np.array([self.added[mark[0]]])
            at = mark.end()
        yield from self._stretch(text, at, len(text), block)

    def _stretch(self, text: str, at: int, end: int, block: int) -> Iterator[np.ndarray]:
        """Blocks that end where a piece surely starts; a piece that has no such place for a whole block is coded in parts."""
        while at < end:
            to = end
            if end - at > block:
                cut = SAFE.search(text, at + block, min(end, at + 2 * block))
                to = cut.start() + 1 if cut else at + self._last_start(text[at : at + block])
            if to > at:
                yield self._block([text[at:to]])[0]
                at = to
                continue
            to = self.pieces.match(text, at, end).end()
            tokens = self.transduce(text[i : min(i + 4096, to)].encode("utf-8") for i in range(at, to, 4096))
            while len(ids := np.fromiter(islice(tokens, 65536), np.int64)):
                yield ids
            at = to

    def _last_start(self, text: str) -> int:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points), bool)
        first[0] = True
        return int(np.flatnonzero(self._starts(points, first))[-1])

    def encode_batch(self, texts: list[str | None], block: int = 1 << 18) -> Iterator[np.ndarray]:
        """The whole ids of each text in turn."""
        for chunks in self.encode_texts(texts, block):
            yield np.concatenate([np.zeros(0, np.int64), *chunks])

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_batch([text])).tolist()

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes complete, id by id."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if out := machine.decode(self.bytes_of[i]):
                yield out
        if out := machine.decode(b"", True):
            yield out

    def decode(self, ids: list[int], block: int = 4096) -> str:
        """The same, fed in blocks of ids."""
        machine, get, out = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of.__getitem__, []
        for at in range(0, len(ids), block):
            out.append(machine.decode(b"".join(map(get, ids[at : at + block]))))
        out.append(machine.decode(b"", True))
        return "".join(out)


@lru_cache(maxsize=4)
def model(path: str) -> Bpe:
    """The vocabulary at ``path``, read once in each worker."""
    return Bpe(path)


FIELDS = {
    "n_tokens": (pa.int64(), "n_tokens long"),
    "ids": (pa.list_(pa.int32()), "ids array<int>"),
    "decoded": (pa.string(), "decoded string"),
    "ids_sha256": (pa.string(), "ids_sha256 string"),
    "decoded_sha256": (pa.string(), "decoded_sha256 string"),
}


def transcode(docs: DataFrame, tokenizer_path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text and decode the ids again; one row per input row with ``key`` and the ``outputs`` (of FIELDS).

    Narrow and partition-local: no shuffle.  Unless ``ids`` or ``decoded`` themselves are asked for, a worker holds one
    batch of texts, a block's ids and a bounded cache of short pieces: digests are fed chunk by chunk.
    """
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()

    def one(bpe: Bpe, chunks: Iterable[np.ndarray]) -> dict[str, object]:
        n, ids_hash, decoded_hash, held, told = 0, hashlib.sha256(), hashlib.sha256(), [], []
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        get = bpe.bytes_of.__getitem__
        for ids in chunks:
            if "ids_sha256" in outputs and len(ids):
                ids_hash.update((("," if n else "") + ",".join(map(bpe.decimal.__getitem__, ids.tolist()))).encode())
            n += len(ids)
            if "ids" in outputs:
                held.append(ids)
            for at in range(0, len(ids), 4096) if {"decoded", "decoded_sha256"} & set(outputs) else ():
                more = machine.decode(b"".join(map(get, ids[at : at + 4096].tolist())))
                decoded_hash.update(more.encode())
                if "decoded" in outputs:
                    told.append(more)
        rest = machine.decode(b"", True)
        decoded_hash.update(rest.encode())
        made = {"n_tokens": n, "ids_sha256": ids_hash.hexdigest(), "decoded_sha256": decoded_hash.hexdigest(), "decoded": "".join([*told, rest])}
        return made | {"ids": np.concatenate([np.zeros(0, np.int64), *held])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                made: dict[str, list] = {o: [] for o in outputs}
                for chunks in bpe.encode_texts(part.column(1).to_pylist()):
                    row = one(bpe, chunks)
                    for o, column in made.items():
                        column.append(row[o])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(made[o], FIELDS[o][0]) for o in outputs)], [key, *outputs])
        release()

    return rows.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(FIELDS[o][1] for o in outputs))

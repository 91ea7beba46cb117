"""Token ids by the ``tokenizers`` library, each distinct stretch between blanks once.

For tokenizers whose pieces hold no white space and whose normaliser treats stretches between
blanks apart (``word_bpe_49k``: NFC, white space to one blank, lower case; its pattern leaves blanks
out), a text's ids are those of its stretches in turn.  Stretches are remembered as bytes, so a text is coded by
one look-up for each and one join; unknown ones go to the library together.
"""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Stretches of a generation (a worker remembers two), and bytes of the longest one that it keeps.
CACHE, LONGEST = 250_000, 64
#: Bytes of texts whose stretches are looked up together.
GROUP = 4 << 20
#: Unknown words that go to the library as one text.
TOGETHER = 1024
BLANKS = bytes.maketrans(b"\t\n\r", b"   ")
LOWER = bytes.maketrans(b"\t\n\r" + string.ascii_uppercase.encode(), b"   " + string.ascii_lowercase.encode())
#: Before the punctuation that ends a stretch after a digit or a letter up to U+024F, where a piece surely ends; without the
#: apostrophe and what added tokens' strings hold, and not after the multiplication and division signs or the capital I with a dot.
TAIL = re.compile(rb"[MARKS](?:(?<=[a-z0-9].)|(?<=[\xc3-\xc8][\x80-\xbf].)(?<!\xc3[\x97\xb7].)(?<!\xc4\xb0.))[MARKS]*(?= |$)".replace(b"MARKS", rb"!\"#$%&()*+,./:;=?@\[\\\]^_`{}~-"))


def segments(coded: bytes) -> Iterator[bytes]:
    """A long text in parts of ``GROUP`` bytes or so, cut at blanks."""
    at = 0
    while len(coded) - at > GROUP and (cut := coded.find(b" ", at + GROUP)) >= 0:
        yield coded[at:cut]
        at = cut + 1
    yield coded[at:]


class Words:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}
        suffix = self.library.model.end_of_word_suffix
        size = self.library.get_vocab_size(with_added_tokens=True)
        # which ids close a piece, for models that mark it
        self.closes = np.array([bool(suffix) and (self.library.id_to_token(i) or "").endswith(suffix) for i in range(size)])

    def _alone(self, words: list[bytes]) -> Iterator[bytes]:
        """By the library, as little-endian 32-bit integers."""
        return (array("I", e.ids).tobytes() for e in self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False))

    def _ids(self, words: list[bytes]) -> dict[bytes, bytes]:
        """By the library.  Words of letters are one piece each, so many go as one text and are told apart by the ids that close a piece."""
        letters = [w for w in words if w.isalpha() or (w.decode().isalpha() and max(w) <= 0xC8)] if self.closes.any() else []
        out = {}
        groups = [letters[at : at + TOGETHER] for at in range(0, len(letters), TOGETHER)]
        for group, coded in zip(groups, self._alone([b" ".join(g) for g in groups])):
            ends = 4 * (np.flatnonzero(self.closes[np.frombuffer(coded, "<u4")]) + 1)
            if len(ends) == len(group):
                ends = ends.tolist()
                out |= {w: coded[i:j] for w, i, j in zip(group, [0, *ends], ends)}
        rest = [w for w in words if w not in out]
        return out | dict(zip(rest, self._alone(rest)))

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Makes these known, but for those too long to be remembered, which are returned with their ids."""
        if len(self.known) > CACHE:
            self.known, self.older = {b"": b""}, self.known
        known, older, new = self.known, self.older, []
        for w in words.difference(known):
            if w in older:
                known[w] = older[w]
            else:
                new.append(w)
        made = self._ids(new)
        known |= {w: ids for w, ids in made.items() if len(w) <= LONGEST}
        return {w: ids for w, ids in made.items() if len(w) > LONGEST}

    def encode_batch(self, texts: pa.Array) -> Iterator[bytes]:
        """For each text its ids, nulls as empty."""
        held: list[list[bytes]] = []
        size = 0
        for text in texts.cast(pa.large_binary()):
            coded = text.as_py() or b""
            # marks can make another letter of a capital than of a small one, and added tokens' strings are told by case
            plain = b"\xcc" in coded or b"\xcd" in coded or b"<|" in coded
            coded = coded.translate(BLANKS) if plain else TAIL.sub(rb" \g<0>", coded.translate(LOWER))
            if len(coded) > 2 * GROUP:  # by itself, a part at a time
                yield from self._coded(held)
                held, size = [], 0
                yield b"".join(ids for part in segments(coded) for ids in self._coded([part.split(b" ")]))
                continue
            held.append(coded.split(b" "))
            size += len(coded)
            if size > GROUP:
                yield from self._coded(held)
                held, size = [], 0
        yield from self._coded(held)

    def _coded(self, texts: list[list[bytes]]) -> Iterator[bytes]:
        long = self._learn(set().union(*texts))
        known = self.known
        for words in texts:
            if long:
                yield b"".join([known[w] if w in known else long[w] for w in words])
            else:
                yield b"".join(map(known.__getitem__, words))


@lru_cache(1)
def encoder(path: str) -> Words:
    return Words(path)

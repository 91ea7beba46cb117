"""Personal data by patterns, and by the same patterns after offset-preserving deobfuscation.

The base kinds are matched on the text itself.  Texts that may hold disguises then pass through
two transducers, each of which keeps for every character it writes the stretch it came from:
the first folds homoglyphs (look-alike letters, compatibility forms, digits of other scripts,
odd dashes and spaces) and drops zero-width characters; the second turns spelled digits, "plus",
and at/dot disguises into the characters they stand for.  Identifiers found in the result are
mapped back to source characters.  A match counts as added only if something in it was
disguised and it lies within no base span of its kind; base spans always stay.

Defined results: null counts as empty, which has no spans; offsets are code points, ends
exclusive; texts of any length are searched whole in time linear in their length; repeated
rows give equal spans; an empty table gives an empty one; extra columns pass through ``redact`` and are ignored by ``find``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")  # also single numbers, so that none is read twice
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Letters of other scripts that look like these Latin letters.
_LOOKS = "аa вB еe кk мM нH оo рp сc тT уy хx іi јj ѕs һh ԁd ԛq ԝw АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS Ѕs αa οo ρp νv ιi κk τt υu ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ɑa ɡg ɩi"
_ZERO_WIDTH = "­​‌‍⁠﻿"
_DASHES = "‐‑‒–—−﹣－"
_STOPS = "。｡．․"
#: Spelled digits.
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_WORD = "(?:" + "|".join(_DIGITS) + ")"
_EDGE = r"(?<![A-Za-z0-9])"
_SPELLED = re.compile(rf"{_EDGE}(?:plus[ -]+)?{_WORD}(?:(?:, ?| |-){_WORD})+(?![A-Za-z0-9])|{_EDGE}plus[ -]+(?:{_WORD}(?![A-Za-z0-9])|(?=[0-9]))|(?<=dot ){_WORD}(?![A-Za-z0-9])|{_EDGE}{_WORD}(?= dot )", re.I)
_SPELLED_PART = re.compile(rf"plus[ -]+|{_WORD}", re.I)
_DOT_SIGN = r"(?: ?[\[({<] ?(?:dot|\.) ?[\])}>] ?| dot )"
_SIGNS = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?:(?P<at> ?[\[({{<] ?(?:at|@) ?[\])}}>] ?| at (?=[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}})*{_DOT_SIGN}[A-Za-z0-9]))|(?P<dot>{_DOT_SIGN}))(?=[A-Za-z0-9])", re.I)
#: Substrings (lower case) without which the second transducer has nothing to do.
_HINTS = ("dot", *(o + x for o in "[({<" for x in ("at", " at", "@", " @", ".", " .")), "plus ", "plus-", *(w + s for w in _DIGITS for s in " ,-"))

Span = tuple[int, int, str]


@lru_cache(maxsize=1)
def folding() -> dict[str, str]:
    """What homoglyphs fold to; the empty string for zero-width ones."""
    table = {ord(p[0]): p[1] for p in _LOOKS.split()} | dict.fromkeys(map(ord, _ZERO_WIDTH), "") | dict.fromkeys(map(ord, _DASHES), "-") | dict.fromkeys(map(ord, _STOPS), ".")
    for code in (*range(0xA0, 0x3100), *range(0xFE00, 0x10000), *range(0x10000, 0x1FC00)):
        c = chr(code)
        if code in table or 0xD800 <= code < 0xE000:
            continue
        digit = unicodedata.digit(c, None)
        flat = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
        if len(flat) == 1 and flat.isascii() and flat.isprintable():
            table[code] = flat
    return {chr(k): v for k, v in table.items()}


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def match(text: str) -> list[Span]:
    """The base kinds in a text: for each kind the leftmost non-overlapping matches that pass its test."""
    out: list[Span] = []
    at, free, before = text.find("@"), 0, -1
    while at >= 0:
        run = text[max(free, before + 1) : at]
        local = len(run) - len(run.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if local else None
        if m:
            out.append((at - local, m.end(), "email"))
            free = m.end()
        before, at = at, text.find("@", max(at + 1, free))
    for m in _DOTTED.finditer(text):
        parts, start = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + len(".".join(four))
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((start, end, "ip"))
            start = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


class _Tape:
    """A text being rewritten, with the source stretch of each character and whether it was disguised."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.hidden = text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace stretches, in order and disjoint, each by at most one character."""
        text, start, end, hidden, at = [], [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            hidden += self.hidden[at:a]
            if new:
                text.append(new)
                start.append(self.start[a])
                end.append(self.end[b - 1])
                hidden.append(True)
            elif hidden:
                hidden[-1] = True
            at = b
        text.append(self.text[at:])
        self.text, self.start, self.end, self.hidden = "".join(text), start + self.start[at:], end + self.end[at:], hidden + self.hidden[at:]


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that show only after deobfuscation, as source spans."""
    table = folding()
    folds = not text.isascii() and not table.keys().isdisjoint(set(text))
    low = text.lower()
    if not folds and not any(h in low for h in _HINTS):
        return []
    if not folds and not (_SPELLED.search(text) or _SIGNS.search(text)):
        return []
    tape = _Tape(text)
    if folds:
        tape.rewrite([(i, i + 1, table[c]) for i, c in enumerate(text) if c in table])
    edits = []
    for m in _SPELLED.finditer(tape.text):
        last = None
        for p in _SPELLED_PART.finditer(m[0]):
            a, b = m.start() + p.start(), m.start() + p.end()
            if last is not None and a > last:
                edits.append((last, a, ""))
            edits.append((a, b, _DIGITS.get(p[0].lower(), "+")))
            last = b
    tape.rewrite(edits)
    tape.rewrite([(m.start(), m.end(), "@" if m["at"] else ".") for m in _SIGNS.finditer(tape.text)])
    out = []
    for a, b, kind in match(tape.text):
        if any(tape.hidden[a:b]):
            s, e = tape.start[a], tape.end[b - 1]
            if not any(k == kind and x <= s and e <= y for x, y, k in base):
                out.append((s, e, kind))
    return out


def spans(text: str | None) -> list[tuple[int, int, str, bool]]:
    """All spans of a text by start, then kind: (start, end, kind, whether base)."""
    if not text:
        return []
    base = match(text)
    every = [(*s, True) for s in base] + [(*s, False) for s in disguised(text, base)]
    return sorted(every, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())])


def find(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each row its key and ``spans``, an array of (start, end, kind, base); narrow, one pass."""
    rows = docs.select(key, "text")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([[dict(zip(("start", "end", "kind", "base"), s)) for s in spans(t.as_py())] for t in batch.column(1)], pa.list_(_SPAN))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], [key, "spans"])

    return rows.mapInArrow(run, f"`{key}` {kind}, spans array<struct<start: bigint, end: bigint, kind: string, base: boolean>>")


def _covered(text: str) -> str:
    out, at = [], 0
    for start, end, kind, _ in spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns, each span of ``text`` replaced by its kind in brackets; overlapping spans become one."""
    names = docs.columns
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else _covered(t) for x in batch.column(where)]
            yield batch.set_column(where, batch.schema.field(where), pa.array(texts, batch.schema.field(where).type))

    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: base spans counted by kind, the SHA-256 of their list, and the list of all spans."""
    told = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        key,
        *map(count, KINDS),
        F.sha2(F.concat_ws(",", F.transform(base, told)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", told)).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )

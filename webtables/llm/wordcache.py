"""Token ids of whole texts with the ``tokenizers`` library, one call per new word.

Both public vocabularies cut a text at white space before any merge, so the ids of
a text are the ids of its space-separated parts in a row. Each Python worker keeps
the parts it has met in a sorted numpy table of bounded size (hash, bytes and ids, some
forty bytes a part): the distinct parts of a slice of texts are looked up at once, their
bytes compared, and ids gathered without an object per word. A new part is cut once more,
before closing punctuation, where the vocabularies' patterns always cut too, and the
library is asked only for pieces that are new. Texts for which cutting at spaces is
not exact (rare white space, special tokens) go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from .common import raw
from .words import Words, mix

#: Parts that a worker remembers, and pieces of parts; beyond it a table starts anew.
REMEMBERED, PIECES = 2_000_000, 280_000
#: Text bytes that a step works on at a time.
TEXT_BYTES = 2 << 20
#: White space that the library or Python's split() counts differently or that merges across spaces.
_ODD = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Letters (Latin to the last, whose classes and cases no Unicode version changes and no
#: place in a word, as a closing sigma's) and a closing punctuation run; no ``<``, with
#: which special tokens begin.
_CLOSED = re.compile("([\\x21-;=-\u024f]*(?=[\\x21-\u024f])[^\\W_])([.,|!?$%&*#;:]*)\\Z")
#: Small Latin letters only: what one step of both vocabularies' patterns takes whole, and
#: no normaliser changes.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff\u0101-\u024f]+\\Z")
_MIXED = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+\\Z")
_MADE: dict = {}


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1
    characters stand for themselves, the others take the letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_tokenizer(path: str) -> str:
    """The tokenizer file's content; its size is fixed, so it may be broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def far_blanks(data: np.ndarray, joins: bool) -> np.ndarray:
    """Where in UTF-8 bytes a separator [\\x1c-\\x1f] or white space beyond ASCII begins, at
    which Python's split() cuts too; with ``joins`` also what the byte vocabulary's pattern
    treats apart (tabs, carriage returns, marks of no width)."""
    some = np.zeros(256, bool)
    some[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3] + ([0x09, 0x0B, 0x0C, 0x0D, 0xEF] if joins else [])] = True
    at = np.flatnonzero(some[data])
    if not len(at):
        return at
    d = data[at].astype(np.int64)
    two = d << 8 | data[np.minimum(at + 1, len(data) - 1)]
    three = two << 8 | data[np.minimum(at + 2, len(data) - 1)]
    last = three & 0xFF
    hit = d < 0x20
    hit |= (two == 0xC285) | (two == 0xC2A0) | (three == 0xE19A80) | (three == 0xE2819F) | (three == 0xE38080)
    hit |= (two == 0xE280) & ((last <= (0x8B if joins else 0x8A)) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
    if joins:
        hit |= (three == 0xE1A08E) | (three == 0xEFBBBF)
    return at[hit]


def _occurrences(data: bytes, what: bytes) -> list[int]:
    out, at = [], data.find(what)
    while at >= 0:
        out.append(at)
        at = data.find(what, at + 1)
    return out


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, .. (n[i] numbers) for each i."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class PartTable:
    """Parts by hash: their bytes, to tell them from others of the same hash, and ids."""

    def __init__(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.at = np.zeros((4, 0), np.int32)  # where bytes begin, how many, where ids begin, how many
        self.data, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The rows with hashes ``h``; -1 where there is none."""
        if not len(self.hash):
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[i] == h, i, -1)

    def add(self, h: np.ndarray, words: list[bytes], ids: list[bytes]) -> None:
        size, count = np.array([len(w) for w in words]), np.array([len(x) // 4 for x in ids])
        new = np.stack([len(self.data) + np.cumsum(size) - size, size, len(self.ids) + np.cumsum(count) - count, count]).astype(np.int32)
        self.data = np.concatenate([self.data, np.frombuffer(b"".join(words), np.uint8)])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])
        both = np.concatenate([self.hash, h])
        order = np.argsort(both, kind="stable")
        self.hash, self.at = both[order], np.concatenate([self.at, new], axis=1)[:, order]


class WordIds:
    """``encode(texts)``: for each text its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, content: str, remembered: int = REMEMBERED, pieces: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(content)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        #: True: white space never reaches the merges; False: one space belongs to the next word.
        self.drops_space = bool(spec["model"].get("end_of_word_suffix"))
        self.pieces_known: dict[str, bytes] = {}
        self.letters = byte_letters()
        self.remembered, self.most_pieces = remembered, pieces
        self.table = PartTable()
        self.blank = None
        if not self.drops_space:
            self.blank = np.zeros(256, bool)
            self.blank[0x20] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pieces(self, part: str) -> tuple[str, ...]:
        """What a part without white space is cut into; with its space where that counts."""
        if self.drops_space:
            m = _CLOSED.match(part)
            return (part,) if not m else (m[1].lower(), m[2]) if m[2] else (m[1].lower(),)
        lines = part.split("\n")
        out = []
        if "" in lines:  # lines that are empty join with the white space around them
            return (" " + part,)
        for k, line in enumerate(lines):
            m = _CLOSED.match(line)
            out += ["\n"] * (k > 0) + [(" " if k == 0 else "") + (m[1] if m else line)]
            if m and m[2]:
                out.append(m[2])
        return tuple(out)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each on its own, by the library: by its merges alone for words of
        letters, which it would only cut off and spell in bytes before that."""
        alone = _LETTERS if self.drops_space else _MIXED
        tokenize, letters, lead = self.library.model.tokenize, self.letters, self.letters[0x20]
        out: list = [None] * len(pieces)
        others = []
        for i, p in enumerate(pieces):
            if alone.match(p, 0 if self.drops_space or p[:1] != " " else 1):
                spelt = p if p.isascii() else p.encode().decode("latin-1").translate(letters)
                if p[:1] == " ":
                    spelt = lead + spelt[1:]
                out[i] = np.array([t.id for t in tokenize(spelt)], "<u4").tobytes()
            else:
                others.append(i)
        for i, x in zip(others, self._by_library([pieces[i] for i in others]), strict=True):
            out[i] = x
        return out

    def _by_library(self, pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        if not self.drops_space:
            got = self.library.encode_batch_fast(pieces, add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in got]
        e = self.library.encode("\n".join(pieces), add_special_tokens=False)
        starts = np.cumsum([0] + [len(p) + 1 for p in pieces])
        ids = np.array(e.ids, "<u4")
        of = np.searchsorted(starts, [a for a, _ in e.offsets], side="right") - 1 if len(ids) else np.zeros(0, int)
        ends = np.searchsorted(of, np.arange(len(pieces)), side="right") * 4
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts (a space goes before each where it counts)."""
        if len(self.pieces_known) > self.most_pieces:
            self.pieces_known.clear()
        known = self.pieces_known
        cut = [self._pieces(p) for p in parts]
        new = list(dict.fromkeys(x for c in cut for x in c if x not in known))
        if new:
            known.update(zip(new, self._ids(new), strict=True))
        return [b"".join(map(known.__getitem__, c)) for c in cut]

    def _cut(self, text: str) -> list[str] | None:
        """The text's parts, or None where it has to be encoded whole."""
        if self.drops_space:
            return None if _SEPARATORS.search(text) else text.split()
        if "  " in text or "\n \n" in text or text.endswith("\n ") or _ODD.search(text) or any(s in text for s in self.special):
            return None
        return text.split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        data, at = ids.tobytes(), (4 * ends).tolist()
        return [data[i:j] for i, j in zip(at, at[1:], strict=False)]

    def encode_column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts (null: none), and the texts' bounds in them."""
        data, off = raw(col)
        n = len(off) - 1
        barred = np.zeros(n, bool)
        bars = [far_blanks(data, not self.drops_space)]
        if not self.drops_space:
            space = data == 0x20
            bars.append(np.flatnonzero(space[1:] & space[:-1]))
            line = data == 0x0A
            bars.append(np.flatnonzero(line[:-2] & space[1:-1] & line[2:]))
            content = data.tobytes()
            bars += [np.array(_occurrences(content, s.encode()), np.int64) for s in self.special]
            full = np.flatnonzero(np.diff(off))  # a space at an end joins what is not there
            barred[full[space[off[full]] | space[off[full + 1] - 1]]] = True
        barred[np.searchsorted(off, np.concatenate(bars), side="right") - 1] = True
        plain = pa.array(col).filter(pa.array(~barred)) if barred.any() else col
        ids, ends = self._looked_up(plain)
        if not barred.any():
            return ids, ends
        counts = np.zeros(n, np.int64)
        counts[~barred] = np.diff(ends)
        apart = {k: np.frombuffer(self._one(col[k].as_py()), "<u4") for k in np.flatnonzero(barred).tolist()}
        for k, x in apart.items():
            counts[k] = len(x)
        bounds = np.r_[0, np.cumsum(counts)]
        out = np.empty(int(bounds[-1]), np.uint32)
        out[_spread(bounds[:-1][~barred], counts[~barred])] = ids
        for k, x in apart.items():
            out[bounds[k] : bounds[k + 1]] = x
        return out, bounds

    def _looked_up(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = Words(col) if self.blank is None else Words(col, blank=self.blank)
        h = words.hashes()
        if not self.drops_space:  # a text's first part has no space before it
            first = words.first[:-1][np.diff(words.first) > 0]
            h[first] = mix(h[first] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            begins = np.zeros(len(h), bool)
            begins[first] = True
        size = words.end - words.start
        distinct, one, of = np.unique(h, return_index=True, return_inverse=True)
        if not self._same(words.data, words.start, size, words.start[one][of], size[one][of]):
            return self._by_text(col)
        if len(self.table.hash) > self.remembered:
            self.table = PartTable()
        rows = self.table.find(distinct)
        old = rows >= 0
        kept = self.table.at[:, rows[old]]
        if not self._same(words.data, words.start[one][old], size[one][old], kept[0], kept[1], self.table.data):
            return self._by_text(col)
        if not old.all():
            at = one[~old]
            content = words.data.tobytes()
            parts = [content[i:j] for i, j in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]
            lead = np.zeros(len(at), bool) if self.drops_space else begins[at]
            ids: list = [None] * len(at)
            for k, x in zip(np.flatnonzero(~lead).tolist(), self._parts([parts[k].decode() for k in np.flatnonzero(~lead)]), strict=True):
                ids[k] = x
            for k in np.flatnonzero(lead).tolist():
                ids[k] = self._whole(parts[k].decode())
            self.table.add(distinct[~old], parts, ids)
            rows = self.table.find(distinct)
        _, _, where, count = self.table.at[:, rows[of]].astype(np.int64)
        ends = np.r_[0, np.cumsum(count)][words.first]
        return self.table.ids[_spread(where, count)], ends

    @staticmethod
    def _same(data, start, size, other_start, other_size, other=None) -> bool:
        """Whether two lists of byte strings are equal, one by one."""
        if not np.array_equal(size, other_size):
            return False
        other = data if other is None else other
        step = 1 << 18  # words at a time
        return all(
            np.array_equal(data[_spread(start[i : i + step], size[i : i + step])], other[_spread(other_start[i : i + step].astype(np.int64), size[i : i + step])])
            for i in range(0, len(size), step)
        )

    def _one(self, text: str | None) -> bytes:
        """The ids of one text, cut at its spaces where that is exact."""
        parts = self._cut(text) if text else []
        if parts is None:
            return self._whole(text)
        if self.drops_space or not parts:
            return b"".join(self._parts(parts))
        return self._whole(parts[0]) + b"".join(self._parts(parts[1:]))

    def _by_text(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same without the table, for the case that two parts share a hash."""
        got = [self._one(t) for t in col.to_pylist()]
        return np.frombuffer(b"".join(got), "<u4"), np.cumsum([0] + [len(x) // 4 for x in got])


def word_ids(content: str) -> WordIds:
    """The worker's own encoder of this tokenizer."""
    key = hash(content)
    if key not in _MADE:
        _MADE[key] = WordIds(content)
    return _MADE[key]

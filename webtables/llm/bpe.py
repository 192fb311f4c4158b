"""Exact BPE ids by dynamic programming over prefixes (operator 9).

Every prefix of a word has one BPE encoding, so one last token. A token t that ends at
position i is that last token exactly when it may follow the last token p of the prefix
before it: the merges of p and t, replayed towards their seam, meet no earlier merge
across it. The tokens that end at i come from a suffix automaton over the vocabulary:
it keeps the longest suffix read so far that occurs in any token, and its links name
the tokens among the shorter suffixes. Following the last tokens back from a word's
end gives its ids. All words of a step move through the automaton side by side in
numpy; the tables depend on the vocabulary alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, slices
from .wordcache import TEXT_BYTES, WordIds, read_tokenizer

#: No merge, no limit.
NEVER = np.int64(1 << 40)
#: Words of more symbols go through the automaton one by one.
SIDE_BY_SIDE = 64
#: Verdicts on pairs of tokens that a worker remembers (a power of two).
PAIRS = 1 << 20


def byte_alphabet() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1
    bytes stand for themselves, the others are numbered from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class Merges:
    """How each token was made: its two parts and the rank of that merge (-1: a symbol).

    A symbol is a byte, plus 256 where it ends a word (``</w>``)."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        n = max(vocab.values()) + 1
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.rank = np.full(n, NEVER, np.int64)
        self.symbols: dict[int, tuple[int, ...]] = {}
        for b, ch in enumerate(byte_alphabet()):
            for s, name in ((b, ch), (256 + b, ch + end)) if end else ((b, ch),):
                self.symbols[vocab[name]] = (s,)
                self.rank[vocab[name]] = -1
        keys = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b, t = vocab[a], vocab[b], vocab[a + (b if not end or b.endswith(end) else b)]
            self.left[t], self.right[t], self.rank[t] = a, b, rank
            self.symbols[t] = self.symbols[a] + self.symbols[b]
            keys.append(a << 32 | b)
        keys = np.array(keys, np.int64)
        self.ranks = np.argsort(keys)
        self.pairs = keys[self.ranks]

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NEVER)

    def clash(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """True where a merge across the seam of token a and token b, of a rank below
        ``before``, comes first, so that b cannot follow a.

        From the whole tokens back in time: at each moment the seam lies between one
        part of a and one of b; their merge wins if it ranks before the merge that took
        the left part away, and not after the one that took the right part away (of
        equal merges the left one is applied first)."""
        r, s = a.astype(np.int64), b.astype(np.int64)
        end_r = np.full(len(r), NEVER) if before is None else before.astype(np.int64)
        end_s = end_r.copy()
        out, live = np.zeros(len(r), bool), np.arange(len(r))
        while len(live):
            q = self.merge_rank(r, s)
            hit = (q < end_r) & (q <= end_s)
            out[live[hit]] = True
            made_r, made_s = self.rank[r], self.rank[s]
            go = ~hit & ((made_r >= 0) | (made_s >= 0))
            live, r, s, end_r, end_s, made_r, made_s = (x[go] for x in (live, r, s, end_r, end_s, made_r, made_s))
            back = made_s >= made_r
            end_s, end_r = np.where(back, made_s, end_s), np.where(back, end_r, made_r)
            r, s = np.where(back, r, self.right[r]), np.where(back, self.left[s], s)
        return out


def suffix_automaton(strings: list[tuple[int, ...]]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """(transitions, links, lengths) of the automaton of all substrings of ``strings``."""
    steps: list[dict[int, int]] = [{}]
    link, size = [-1], [0]

    def copy(p: int, q: int, c: int) -> int:
        """Split off from q the suffixes that also end where p + c does."""
        new = len(steps)
        steps.append(dict(steps[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        while p >= 0 and steps[p].get(c) == q:
            steps[p][c] = new
            p = link[p]
        link[q] = new
        return new

    for s in strings:
        last = 0
        for c in s:
            q = steps[last].get(c)
            if q is not None:
                last = q if size[q] == size[last] + 1 else copy(last, q, c)
                continue
            cur, p = len(steps), last
            steps.append({})
            link.append(0)
            size.append(size[last] + 1)
            while p >= 0 and c not in steps[p]:
                steps[p][c] = cur
                p = link[p]
            if p >= 0:
                q = steps[p][c]
                link[cur] = q if size[q] == size[p] + 1 else copy(p, q, c)
            last = cur
    return steps, link, size


def tables(content: str) -> dict:
    """All that workers need, from a tokenizer file's content (size: its vocabulary's)."""
    m = Merges(json.loads(content)["model"])
    made = np.flatnonzero((m.rank >= 0) & (m.rank < NEVER))
    alone = made[~m.clash(m.left[made], m.right[made], m.rank[made])]  # encode to themselves
    tokens = [t for t in m.symbols if m.rank[t] == -1] + sorted(alone.tolist())
    steps, link, size = suffix_automaton([m.symbols[t] for t in tokens])
    of_state: dict[int, list[int]] = {}
    for t in tokens:
        v = 0
        for c in m.symbols[t]:
            v = steps[v][c]
        of_state.setdefault(v, []).append(t)
    length = np.zeros(len(m.rank), np.int64)
    for t, s in m.symbols.items():
        length[t] = len(s)
    best, shorter = np.full(len(steps), -1, np.int64), np.full(len(m.rank), -1, np.int64)
    for v in np.argsort(size, kind="stable").tolist():
        t = best[link[v]] if v else -1
        for u in sorted(of_state.get(v, ()), key=lambda u: length[u]):
            shorter[u], t = t, u
        best[v] = t
    at = [(v << 9 | c, w) for v, row in enumerate(steps) for c, w in row.items()]
    at.sort()
    keys, to = np.array(at, np.int64).T
    symbol = np.full(512, -1, np.int64)
    for t, s in m.symbols.items():
        if len(s) == 1:
            symbol[s[0]] = t
    return {"merges": m, "keys": keys.copy(), "to": to.astype(np.int32), "link": np.array(link, np.int32), "size": np.array(size, np.int32), "best": best, "shorter": shorter, "length": length}


class PrefixBPE:
    """Ids of words by their prefixes' last tokens."""

    def __init__(self, made: dict):
        self.__dict__.update(made)
        self.known = np.full(PAIRS, -1, np.int64)
        self.verdict = np.zeros(PAIRS, bool)

    def follows(self, p: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether token t may follow token p; verdicts are remembered."""
        key = p << 32 | t
        slot = ((key * np.int64(0x9E3779B97F4A7C1)) >> np.int64(30)) & np.int64(PAIRS - 1)
        out = self.verdict[slot]
        new = np.flatnonzero(self.known[slot] != key)
        if len(new):
            found, back = np.unique(key[new], return_inverse=True)
            ok = ~self.merges.clash(found >> 32, found & 0xFFFFFFFF)
            out[new] = ok[back]
            self.known[slot[new]], self.verdict[slot[new]] = key[new], out[new]
        return out

    def _step(self, state: np.ndarray, held: np.ndarray, c: np.ndarray) -> None:
        """Read symbols c; afterwards ``held`` symbols of each word's end are a substring of a token."""
        todo = np.arange(len(c))
        while len(todo):
            key = state[todo].astype(np.int64) << 9 | c[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[todo[hit]] = self.to[at[hit]]
            held[todo[hit]] += 1
            todo = todo[~hit]
            state[todo] = self.link[state[todo]]
            held[todo] = self.size[state[todo]]

    def last_tokens(self, symbols: np.ndarray, off: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each position the last token of the prefix up to it. Words from the longest down."""
        last = np.full(len(symbols), -1, np.int64)
        state, held = np.zeros(len(off), np.int32), np.zeros(len(off), np.int32)
        for i in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -i, side="left"))  # words of more than i symbols
            here = off[:n] + i
            self._step(state[:n], held[:n], symbols[here])
            t = self.best[state[:n]]
            while (long := self.length[t] > held[:n]).any():
                t = np.where(long, self.shorter[t], t)
            todo = np.arange(n)
            while len(todo):
                start = i + 1 - self.length[t]
                ok = start == 0
                inner = np.flatnonzero(~ok)
                p = last[off[todo[inner]] + start[inner] - 1]
                ok[inner] = self.follows(p, t[inner])
                last[here[todo[ok]]] = t[ok]
                todo, t = todo[~ok], self.shorter[t[~ok]]
        return last

    def encode(self, words: list[bytes], ends: bool) -> list[bytes]:
        """Ids of each word (little-endian unsigned 32-bit); ``ends``: its last symbol ends a word."""
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-size, kind="stable")
        symbols = np.frombuffer(b"".join(words[k] for k in order.tolist()), np.uint8).astype(np.int64)
        size = size[order]
        off = np.cumsum(size) - size
        if ends:
            symbols[(off + size - 1)[size > 0]] += 256
        last = np.empty(len(symbols), np.int64)
        alone = int(np.searchsorted(-size, -SIDE_BY_SIDE, side="left"))
        for k in range(alone):
            a, z = off[k], off[k] + size[k]
            last[a:z] = self._alone(symbols[a:z].tolist())
        if alone < len(size):
            at = int(off[alone])
            last[at:] = self.last_tokens(symbols[at:], off[alone:] - at, size[alone:])
        # back from the ends: round k finds the k-th token from the end of every word
        rounds, todo, end = [], np.flatnonzero(size), off + size
        while len(todo):
            t = last[end[todo] - 1]
            rounds.append((todo, t))
            end[todo] -= self.length[t]
            todo = todo[end[todo] > off[todo]]
        counts = np.zeros(len(size), np.int64)
        for todo, _ in rounds:
            counts[todo] += 1
        to = np.cumsum(counts)
        ids = np.empty(int(to[-1]) if len(to) else 0, "<u4")
        for k, (todo, t) in enumerate(rounds):
            ids[to[todo] - 1 - k] = t
        data, out = ids.tobytes(), [b""] * len(words)
        for k, z, n in zip(order.tolist(), (4 * to).tolist(), (4 * counts).tolist(), strict=True):
            out[k] = data[z - n : z]
        return out

    def _alone(self, symbols: list[int]) -> list[int]:
        """last_tokens of one long word."""
        keys, to, link, size, best = self.keys, self.to, self.link, self.size, self.best
        last: list[int] = []
        verdicts: dict[tuple[int, int], bool] = {}
        v = held = 0
        for i, c in enumerate(symbols):
            while True:
                at = int(keys.searchsorted(v << 9 | c))
                if at < len(keys) and keys[at] == v << 9 | c:
                    v, held = int(to[at]), held + 1
                    break
                v = int(link[v])
                held = int(size[v])
            t = int(best[v])
            while self.length[t] > held:
                t = int(self.shorter[t])
            while (start := i + 1 - int(self.length[t])) > 0:
                pair = last[start - 1], t
                if pair not in verdicts:
                    if len(verdicts) > PAIRS:
                        verdicts.clear()
                    verdicts[pair] = bool(self.follows(np.array(pair[:1]), np.array(pair[1:]))[0])
                if verdicts[pair]:
                    break
                t = int(self.shorter[t])
            last.append(t)
        return last


class PrefixWordIds(WordIds):
    """:class:`WordIds` whose merges are :class:`PrefixBPE`'s; the library cuts and
    normalises only parts with characters beyond Latin letters."""

    #: Characters that normalising leaves alone but for their case, in any Unicode version.
    PLAIN = re.compile("[\\x21-\u024f]*\\Z")
    SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

    def __init__(self, content: str, made: dict, **named):
        super().__init__(content, **named)
        import regex

        self.bpe = PrefixBPE(made)
        self.pieces = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.byte_of = {ord(ch): b for b, ch in enumerate(byte_alphabet())}
        self.special_ids = {s: np.array([self.library.token_to_id(s)], "<u4").tobytes() for s in self.special}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _library_pieces(self, part: str) -> list[bytes]:
        norm = self.library.normalizer
        cut = self.library.pre_tokenizer.pre_tokenize_str(norm.normalize_str(part) if norm else part)
        return [bytes(map(self.byte_of.__getitem__, map(ord, p))) for p, _ in cut]

    def _parts(self, parts: list[str]) -> list[bytes]:
        if not self.drops_space:
            parts = [" " + p for p in parts]
        cut: list[list] = [[] for _ in parts]  # of each part: words (bytes) and special tokens (str)
        plain = []
        for k, p in enumerate(parts):
            special = self.at_special and "<" in p and self.at_special.search(p)
            if self.drops_space and not special and self.PLAIN.match(p):
                plain.append(k)
            else:
                for x in self.at_special.split(p) if special else [p]:
                    cut[k] += [x] if x in self.special_ids else self._library_pieces(x) if x else []
        row = iter(plain)
        here = None
        for w in self.pieces.findall("\n" + "\n".join([parts[k] for k in plain]).lower()) if plain else ():
            if w == "\n":
                here = cut[next(row)]
            else:
                here.append(w.encode())
        words = list(dict.fromkeys(w for c in cut for w in c if not isinstance(w, str)))
        ids = dict(zip(words, self.bpe.encode(words, self.drops_space), strict=True)) | self.special_ids
        return [b"".join([ids[w] for w in c]) for c in cut]

    def _whole(self, text: str) -> bytes:
        if self.drops_space:
            return b"".join(self._parts([p for p in self.SPACE.split(text) if p]))
        out = []
        for x in self.at_special.split(text) if self.at_special else [text]:
            if x in self.special_ids:
                out.append(self.special_ids[x])
            elif x:
                out += self.bpe.encode(self._library_pieces(x), False)
        return b"".join(out)


_MADE: dict = {}


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array of int), decoded (the tokens those ids stand for, as the
    library's decode gives them with special tokens kept).

    One row per row of ``docs``, in a narrow pass; a null text is empty and has no ids.
    Strings of special tokens in a text become those tokens, as in the library. Ids may
    be null or repeated; other columns are not read. An empty table gives no rows."""
    spark = ready(docs.sparkSession)
    content = read_tokenizer(tokenizer)
    sent = spark.sparkContext.broadcast((content, tables(content)))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, made = sent.value
        key = hash(text)
        if key not in _MADE:
            encoder = PrefixWordIds(text, made)
            names = np.empty(encoder.library.get_vocab_size(), object)
            for name, k in encoder.library.get_vocab().items():
                names[k] = name
            _MADE[key] = encoder, names
        encoder, names = _MADE[key]
        decoder = encoder.library.decoder
        for b in slices(batches, "text", TEXT_BYTES):
            ids, ends = encoder.encode_column(b.column(1))
            ids = ids.astype(np.int32)
            at = ends.tolist()
            tokens = names[ids].tolist()
            if decoder is None:
                decoded = [" ".join(tokens[i:j]) for i, j in zip(at, at[1:], strict=False)]
            else:
                decoded = [decoder.decode(tokens[i:j]) for i, j in zip(at, at[1:], strict=False)]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return texts.mapInArrow(run, f"id {id_type}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens and SHA-256 of the decimal ids and of the decoded text."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

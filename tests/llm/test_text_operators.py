"""The text operators against brute force, on rows with every awkward case."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from webtables.llm import bpe, dac, exact_dedup, ngram_join, packing, substring_dedup
from webtables.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randrange(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(200), prose(60)
    rows = [(k, prose(rng.randrange(1, 90))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "\x0b\x0c x"), (104, "x"), (105, "X"), (106, "a b c"), (107, "A  b\nc")]
    rows += [(110, base), (111, base), (112, base.replace(" ", "\n")), (113, base.replace(" ", "  ")), (114, base + "\u00a0"), (110, base)]
    for k in range(30):  # near copies of one text, some of them only linked through others
        w = base.split()
        for _ in range(1 + k % 4):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((200 + k, " ".join(w)))
    rows += [(300 + k, prose(20) + " " + passage + " " + prose(k)) for k in range(6)]
    rows += [(320, passage + " " + passage), (321, " ".join(passage.split()[:50])), (322, " ".join(passage.split()[:49]))]
    rows += [(None, base), (None, base), (None, passage), (None, None), (400, "w" * 6000), (401, prose(30_000)), (2**40, prose(12)), (-5, passage)]
    rows += [(500, "it's <|endoftext|> İstanbul ΣΑΣ ﬁ e\u0301 日本語 １２ 😀\u200d"), (501, "a \n b\n \nc  d \n "), (502, "<|startoftext|>x\x1cy\x85z\u3000")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns carry the names that the operators use inside."""
    names = ["id", "part", "run", "keep", "digest", "norm", "key", "own", "chars", "slice", "length", "offset", "n", "set", "token", "row", "sha", "kept_text", "h"]
    df = spark.createDataFrame(texts(), "doc_id long, text string").repartition(5)
    return df.select("doc_id", "text", *[F.lit(None).cast("string").alias(c) for c in names])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = 999999")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_exact_duplicates(docs, empty):
    groups = defaultdict(list)
    for i, t in texts():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = defaultdict(list)
    for norm, rows in groups.items():
        rows.sort()
        for k, (*_, i) in enumerate(rows):
            want[(i, rows[0][3], len(rows), sha(norm))].append(k == 0)
    got = defaultdict(list)
    for r in exact_dedup.exact_duplicates(docs).collect():
        got[(r.doc_id, r.keep_id, r.group_size, r.text_sha256)].append(r.kept)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert exact_dedup.exact_duplicates(empty).collect() == []


def test_drop_exact_duplicates_keeps_one_row_a_group(docs):
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    norms = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert len(norms) == len(set(norms)) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in texts()})


def test_exact_duplicates_split_a_hot_text(spark):
    """One text on most rows is dealt over many partitions and still one group."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 > 0, "same text").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_duplicates(df)
    hot = got.where("group_size > 1")
    assert hot.count() == 3000 and hot.select("keep_id", "group_size").distinct().collect() == [(1, 3000)]
    assert got.where("kept").count() == 1001


def shingles(t, size):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_ngram_join(docs, empty, size, percent):
    rows = [(i, shingles(t, size)) for i, t in texts()]
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in rows:
        for b, y in rows:
            if a is not None and b is not None and a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    want = sorted((str(i), len(s), None if i is None else root(i)) for i, s in rows)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.join_components(docs, size=size, percent=percent).collect())
    assert sorted(got, key=str) == sorted(want, key=str)
    if size == 4:
        assert ngram_join.join_components(empty).collect() == []


def test_ngram_join_links_chains_in_later_rounds(spark):
    """A chain of texts, each near the next only: no pivot is near them all."""
    rng = random.Random(9)
    w = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(40):
        rows.append((k, " ".join(w)))
        w = w[3:] + [f"n{k}{j}" for j in range(3)]
    got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}


def test_ngram_join_gives_every_link(spark, monkeypatch):
    """Families of near copies over several blocks: all pairs, also those without the family's first text."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    rng = random.Random(21)
    rows = []
    for family in range(3):
        base = [f"f{family}w{k}" for k in range(60)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, t) for k, t in enumerate([rows[0][1], rows[3][1], None, "", "one", "one"])] + [(None, rows[0][1])]
    sets = {i: shingles(t, 4) for i, t in rows if i is not None}
    want = {(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and x and 100 * len(x & y) >= 85 * len(x | y)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, members = (x.collect() for x in ngram_join.join_links(docs))
    of = {}
    for r in members:
        if r.class_id is not None:
            of.setdefault(r.class_id, []).append(r.doc_id)
    got = [(min(x, y), max(x, y)) for r in pairs for x in of[r.a] for y in of[r.b]]
    got += [(x, y) for ids in of.values() for x in ids for y in ids if x < y]
    assert sorted(got) == sorted(want)
    assert all((r.shared, r.n_either) == (len(sets[r.a] & sets[r.b]), len(sets[r.a] | sets[r.b])) for r in pairs)
    counts = {r.doc_id: r.n_links for r in ngram_join.join_components(docs).collect()}
    assert counts.pop(None) is None
    assert counts == {i: sum(i in p for p in want) for i in sets}


def brute_removals(rows, window):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            if i is not None:
                x = tuple(w[k : k + window])
                first[x] = min(first.get(x, i), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        yield i, t, w, gone


def test_substring_removals(docs, empty):
    want = sorted((str(i), len(w), sum(g), sha(" ".join(x for x, y in zip(w, g, strict=True) if not y))) for i, _, w, g in brute_removals(texts(), 50))
    got = substring_dedup.removals(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert all(sum(s.stop - s.start for s in r.intervals) == r.n_removed for r in got)
    assert sum(r.n_removed > 0 for r in got) > 30
    assert substring_dedup.removals(empty).collect() == []


def test_without_repeats_changes_only_texts_that_lose_words(docs):
    want = sorted(str((i, t if not any(g) else " ".join(x for x, y in zip(w, g, strict=True) if not y))) for i, t, w, g in brute_removals(texts(), 50))
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == want


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def test_packing(docs, empty):
    tok = library("word_bpe_49k.json")
    want = defaultdict(int)
    total = 0
    for i, t in texts():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[(i, k // 2048, k, len(part), zlib.crc32(part.tobytes()))] += 1
    rows = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json")).collect()
    got = defaultdict(int)
    full = defaultdict(list)
    for r in rows:
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        full[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in full.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(x for _, x in parts[:k]) for k in range(len(parts))]
        assert sum(x for _, x in parts) <= 2048
    assert len(full) <= -(-total // 2048) + 2
    assert packing.pack_documents(empty, tokenizer_path("word_bpe_49k.json")).collect() == []
    whole = packing.sequences(docs, tokenizer_path("word_bpe_49k.json")).collect()
    assert len(whole) == len(full) and all(len(r.ids) == 4 * r.length for r in whole)
    assert sum(r.length for r in whole) == total


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once_and_little_room(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, rng.integers(1, 400))
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    steps = packing.plan(counts, 64)
    used = defaultdict(int)
    for pattern, k in steps:
        assert k > 0 and sum(pattern) <= 64
        for x in pattern:
            used[x] += k
    assert used == counts
    assert sum(k for _, k in steps) <= 11 / 9 * -(-int(lengths.sum()) // 64) + 1


def test_complements_prefer_exact_fills():
    counts = np.zeros(65, np.int64)
    counts[[10, 20, 24]] = 1, 1, 1
    assert packing.complements(counts, 40, 24, np.ones(65, bool)) == (24,)
    assert packing.complements(counts, 40, 30, np.ones(65, bool)) == (20, 10)
    assert packing.complements(counts, 40, 54, np.ones(65, bool)) == (24, 20, 10)
    assert packing.complements(counts, 40, 40, np.ones(65, bool)) is None


def test_token_files(spark, docs, empty, tmp_path):
    tok = library("byte_bpe_50k.json")
    files = dac.write_tokens(docs, tokenizer_path("byte_bpe_50k.json"), f"file://{tmp_path}/tokens", end_id=2)
    back = dac.read_tokens(spark, files).collect()
    want = sorted((str(i), np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in texts())
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in back) == want
    back.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in back]
    assert [i for i in ids if i is not None] == sorted(i for i in ids if i is not None) and ids[-1] is None
    assert [r.start for r in back] == np.cumsum([0] + [r.n_tokens for r in back])[:-1].tolist()
    assert [f for f in (tmp_path / "tokens").iterdir() if f.name.startswith("_")] == []
    assert dac.token_store(empty, tokenizer_path("byte_bpe_50k.json")).collect() == []


@pytest.mark.parametrize("chunk, top", [(8, 50_257), (8, 200), (4, 70_000), (16, 50_257)])
def test_any_token_without_decoding(tmp_path, chunk, top):
    ids = np.random.default_rng(1).integers(0, top, 5000)
    ends = np.array([10, 10, 4000, 5000])
    path = tmp_path / "x.dac"
    path.write_bytes(b"".join(dac.file_bytes(np.arange(4), ends, dac.encode_levels(ids, chunk), chunk)))
    f = dac.TokenFile(str(path))
    assert [f.token(k) for k in range(0, 5000, 7)] == ids[::7].tolist()
    for a, z in ((0, 5000), (10, 10), (4999, 5000), (511, 1025)):
        assert f.slice(a, z).tolist() == ids[a:z].tolist()
    with pytest.raises(IndexError):
        f.token(5000)


def test_bpe_encodes_and_decodes_like_the_library(docs, empty):
    tok = library("word_bpe_49k.json")
    want = []
    for i, t in texts():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    out = bpe.encode_decode(docs, tokenizer_path("word_bpe_49k.json"))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(out).collect()]
    assert sorted(got) == sorted(want)
    assert bpe.encode_decode(empty, tokenizer_path("word_bpe_49k.json")).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_caches_match_the_library(name):
    """Random mixes of everything at which texts are cut, and random letters."""
    from webtables.llm.wordcache import WordIds, read_tokenizer

    content, tok, rng = read_tokenizer(tokenizer_path(name)), library(name), random.Random(5)
    bits = [" ", "  ", "\n", "\t", "\r", "\u00a0", "\u2003", "a", "é", "e\u0301", "É", "'s", "'", "1", "!", ".", ",", "<|endoftext|>", "x\u3000y", "\x1c", "\u180e", "\u200b", "ǅ", "ß", "tion", "The", "²", "<"]
    mixed = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    mixed += ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 90))) for _ in range(1500)]
    mixed += ["".join(chr(rng.choice([rng.randrange(33, 127), rng.randrange(161, 592), rng.randrange(0x300, 0x3000)])) for _ in range(rng.randrange(1, 60))) for _ in range(800)]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in mixed]
    assert WordIds(content, remembered=500).encode(mixed) == want
    assert bpe.PrefixWordIds(content, bpe.tables(content), remembered=500).encode(mixed) == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_caches_leave_a_closing_sigma_to_the_library(name):
    """Python lower-cases a sigma by its place in the word, the library does not."""
    from webtables.llm.wordcache import WordIds, read_tokenizer

    content, tok = read_tokenizer(tokenizer_path(name)), library(name)
    words = ["a\u03a3", "a\u03a3.", "AB\u03a3,", "x a\u03a3; y", "a\u03a3\u03a3:", "\u03a3", "\u03a3.", "1\u03a3", "é\u03a3!"]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in words]
    assert WordIds(content).encode(words) == want


def test_shingles_that_occur_once(spark):
    """A task is told which shingles occur in another text; a step that it was not told of
    takes all as shared."""
    import pyarrow as pa

    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[10 * k : 10 * k + 10])) for k in range(30)] + [(100, " ".join(words[5:25])), (101, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    levels = spark.sparkContext.broadcast(np.zeros(1 << ngram_join.CELL_BITS, np.uint8))
    kinds = "id long, n long, p0 array<long>"
    folder = ngram_join.tell_shared(df, 4)
    told = {r.id: r for r in df.mapInArrow(ngram_join._prefixes(4, 1, levels, [0], folder=folder), kinds).collect()}
    blind = {r.id: r for r in df.mapInArrow(ngram_join._prefixes(4, 1, levels, [0], folder=folder + "-none"), kinds).collect()}
    sets = {i: {" ".join((t or "").split()[k : k + 4]) for k in range(max(0, len((t or "").split()) - 3))} for i, t in rows}
    shared = {i: sum(any(s in sets[j] for j in sets if j != i) for s in v) for i, v in sets.items()}
    assert {i: len(r.p0) for i, r in told.items()} == {i: n for i, n in shared.items() if n}
    assert {i: len(r.p0) for i, r in blind.items()} == {i: len(v) for i, v in sets.items() if v}
    h, _ = ngram_join.shingle_sets(pa.array(["a b c d e"]), 4)
    assert ngram_join._shared(h, (0, np.zeros(1, np.uint8), 2)).all()


def test_null_ids_share_no_slice(spark):
    df = spark.createDataFrame([(None, f"t {k}") for k in range(400)] + [(k, "x") for k in range(400)], "doc_id long, text string")
    slices = substring_dedup._dealt(df, "doc_id", "text", 16).where("id IS NULL").groupBy("slice").count().collect()
    assert len(slices) > 8 and max(r["count"] for r in slices) < 100

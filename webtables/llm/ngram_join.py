"""N-gram Jaccard join with prefix filters under several global orders (operator 4).

Two documents can only link if they share a token among the first few of each, in any
global order of the shingles. In the first order the shingles that occur once come first:
each task sends the distinct shingles of its texts, packed by hash range, and is told which
of them occur elsewhere. So a text whose own shingles fill its prefix leaves at once, and
what is left of the prefixes goes from rare to frequent by a sketch of all counts. The
other orders are random but for frequent shingles, which come last.

Equal sets are one class, and one text stands for each. A class's home is the longest
list it is in; a home is cut into blocks of bounded size. Two blocks meet in a group if
a list has members of both, and a group's task compares all of its sets, block against
block: first their prefixes in two other orders, which must meet too, then, of what is
left, the whole sets. So each pair that may link is compared once and in full, and a
family of near copies sends a set once for each block it meets, not once for each pair.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, ready, shared_path, slices
from .components import components
from .dac import file_system
from .words import Words, mix

SIZE = 4
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: The count sketch: 2**CELL_BITS cells in blocks of 2**BLOCK_BITS.
CELL_BITS, BLOCK_BITS = 20, 14
#: Levels of cells: the mean's, and the one from which a cell's shingles count as frequent.
LOW_LEVEL, FREQUENT = 8, 16
#: One number for each global order, and one for the sketch's cells.
ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)
CELLS = 0x082EFA98EC4E6C89
#: Sets and shingles of a block, about.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 17
#: Bits of a shingle's hash that tell whether it occurs once, and of its range.
ONCE_BITS, RANGE_BITS = 40, 10
#: Columns of shingles that a group's task multiplies at a time.
COLUMNS = 4096
#: Bits of the filter that spares most texts the shuffle (exact joins follow).
FILTER_BITS = 1 << 23


def shingle_sets(col: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after another, and where each
    text's begin. A text with fewer words than ``size`` has one: all its words."""
    words = Words(col, lower=True)
    hashes = words.hashes()
    h, inside = words.windows(size, hashes)
    counts = np.diff(words.first)
    for k in range(1, size):
        short = words.first[:-1][counts == k]
        if len(short):
            whole, _ = words.windows(k, hashes)
            h[short] = mix(whole[short] + np.uint64(k))
            inside[short] = True
    h = h[inside]
    off = np.r_[0, np.cumsum(np.where(counts >= size, counts - size + 1, counts > 0))].astype(np.int64)
    for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if z - a > 1:
            h[a:z].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[off[:-1][off[:-1] < len(h)]] = True
    return h[new], np.r_[0, np.cumsum(new)][off]


def _cells(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(CELLS)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _digests(size: int):
    """Per row: id, set size, a digest of the set; at a task's end its counts of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.int64)
        names = ["id", "n", "set", "block", "counts"]
        for b in slices(batches, "text"):
            h, off = shingle_sets(b.column(1), size)
            counts += np.bincount(_cells(h), minlength=len(counts))
            keys = [hashlib.blake2b(h[a:z], digest_size=16).digest() for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array(keys, pa.binary()), pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.binary())], names=names)
        if counts.any():
            parts = counts.reshape(-1, 1 << BLOCK_BITS)
            data = [zlib.compress(x.astype("<u8").tobytes(), 1) for x in parts]
            n = len(data)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(data, pa.binary())], names=names)

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the blocks of this partition, one array a block however many rows come."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(data), "<u8")
            sums[k] = sums[k] + x if k in sums else x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["block", "counts"])


def cell_levels(seen: DataFrame) -> np.ndarray:
    """How far each cell's count lies above the mean, in half standard deviations from
    LOW_LEVEL on (2**CELL_BITS counts reach the driver)."""
    blocks = seen.where("block IS NOT NULL").select("block", "counts").repartition(1 << (CELL_BITS - BLOCK_BITS), "block")
    counts = np.zeros(1 << CELL_BITS, np.uint64)
    for r in blocks.mapInArrow(_sum_blocks, "block int, counts binary").collect():
        counts[r["block"] << BLOCK_BITS : (r["block"] + 1) << BLOCK_BITS] += np.frombuffer(zlib.decompress(bytes(r["counts"])), "<u8")
    mean = float(counts.mean())
    return np.clip(2 * (counts - mean) / max(mean, 1.0) ** 0.5 + LOW_LEVEL, 0, 63).astype(np.uint8)


def _tails(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of ONCE_BITS of the hashes, where each hash's is, and how many
    hashes have it."""
    return np.unique(h >> np.uint64(64 - ONCE_BITS), return_inverse=True, return_counts=True)


def _send(size: int):
    """Of each step of texts its distinct shingles by range: part, nth (step), crc (of all the
    step's), range, n, packed (differences, byte plane by byte plane), again (bits: in
    several texts of the step)."""
    names = ["part", "nth", "crc", "range", "n", "packed", "again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        bounds = np.arange((1 << RANGE_BITS) + 1, dtype=np.uint64) << np.uint64(ONCE_BITS - RANGE_BITS)
        for nth, b in enumerate(slices(batches, "text")):
            h, _ = shingle_sets(b.column(1), size)
            values, _, counts = _tails(h)
            at = np.searchsorted(values, bounds)
            ranges = np.flatnonzero(np.diff(at))
            low = (values & np.uint64((1 << ONCE_BITS - RANGE_BITS) - 1)).astype(np.uint32)
            again = counts > 1
            packed, bits = [], []
            for a, z in zip(at[ranges].tolist(), at[ranges + 1].tolist(), strict=True):
                packed.append(np.diff(low[a:z], prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
                bits.append(np.packbits(again[a:z]).tobytes())
            n, crc = len(ranges), zlib.crc32(values.tobytes())
            same = lambda v, kind, n=n: pa.array(np.full(n, v), kind)
            yield pa.RecordBatch.from_arrays([same(part, pa.int32()), same(nth, pa.int32()), same(crc, pa.int64()), pa.array(ranges.astype(np.int32)), pa.array(np.diff(at)[ranges].astype(np.int32)), pa.array(packed, pa.binary()), pa.array(bits, pa.binary())], names=names)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the rows of one range after another: which of the sent shingles occur again."""

    def told(rows: list[tuple]) -> pa.RecordBatch:
        sent = []
        for *_, n, packed, _ in rows:
            planes = np.frombuffer(packed, np.uint8).reshape(4, n)
            sent.append(np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32))
        again = np.concatenate([np.unpackbits(np.frombuffer(r[-1], np.uint8), count=r[4]) for r in rows]).astype(bool)
        _, of, counts = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        shared = (counts > 1) | (np.bincount(of, again, len(counts)) > 0)
        ends = np.cumsum([0] + [r[4] for r in rows]).tolist()
        bits = [np.packbits(shared[of[a:z]]).tobytes() for a, z in zip(ends, ends[1:], strict=False)]
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], pa.array(bits, pa.binary())], names=["part", "nth", "crc", "range", "n", "shared"])

    held: list[tuple] = []
    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
            if held and held[0][3] != row[3]:
                yield told(held)
                held = []
            held.append(row)
    if held:
        yield told(held)


def _keep(folder: str):
    """One file for each task of the first pass, from rows sorted by part, nth and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # steps of the part at hand: crc, bits

        def write(part: int) -> pa.RecordBatch:
            steps = [(k, crc, len(x := np.concatenate(bits)), np.packbits(x).tobytes()) for k, (crc, bits) in held.items()]
            store, path = file_system(folder)
            store.create_dir(path, recursive=True)
            own = f"{path}/_{part}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(own) as f, pa.ipc.new_file(f, _STEPS) as out:
                out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*steps, strict=True), _STEPS, strict=True)], schema=_STEPS))
            store.move(own, f"{path}/{part}")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

        now = None
        for b in batches:
            for part, nth, crc, _, n, shared in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if part != now:
                    if held:
                        yield write(now)
                    now = part
                    held.clear()
                held.setdefault(nth, (crc, []))[1].append(np.unpackbits(np.frombuffer(shared, np.uint8), count=n))
        if held:
            yield write(now)

    return run


_STEPS = pa.schema([("nth", pa.int32()), ("crc", pa.int64()), ("n", pa.int64()), ("shared", pa.binary())])


def tell_shared(texts: DataFrame, size: int) -> str:
    """Find the shingles of ``texts`` (id, text) that occur in two texts or more; the folder of
    what each task of the pass is told of its steps. The pass over the same table meets the
    same texts in the same steps; a step that does not (its crc differs) takes all of its
    shingles as shared, which costs time and no link."""
    spark = texts.sparkSession
    folder = shared_path(spark, "shared-shingles")
    n = partitions(spark)
    sent = texts.mapInArrow(_send(size), "part int, nth int, crc long, range int, n int, packed binary, again binary")
    told = sent.repartition(n, "range").sortWithinPartitions("range").mapInArrow(_answer, "part int, nth int, crc long, range int, n int, shared binary")
    told.repartition(n, "part").sortWithinPartitions("part", "nth", "range").mapInArrow(_keep(folder), "part int").agg(F.count(F.lit(1))).first()
    return folder


def _told(folder: str) -> dict[int, tuple[int, np.ndarray]]:
    """What this task's part was told: by step the crc and a boolean for each shingle."""
    store, path = file_system(folder)
    path = f"{path}/{TaskContext.get().partitionId()}"
    if store.get_file_info(path).type.name != "File":
        return {}
    with store.open_input_file(path) as f:
        rows = pa.ipc.open_file(f).read_all().to_pylist()
    return {r["nth"]: (r["crc"], np.frombuffer(r["shared"], np.uint8), r["n"]) for r in rows}


def _prefixes(size: int, percent: int, levels, orders: list[int], wanted=None, folder: str | None = None):
    """Per row (with ``wanted``: whose bit is in that filter): id, n and its prefix in each of
    ``orders``: whole keys in the first order (without those that occur once, which no other
    text holds), 32 bits in the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = levels.value.astype(np.uint64) << np.uint64(57)
        late = np.where(levels.value >= FREQUENT, np.uint64(1 << 63), np.uint64(0))
        told = _told(folder) if folder else {}
        for step, b in enumerate(slices(_wanted(batches, wanted), "text")):
            h, off = shingle_sets(b.column(b.num_columns - 1), size)
            cells = _cells(h)
            n = np.diff(off)
            take = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
            some = n > 0
            cols = [b.column(0), pa.array(n)]
            for nth in orders:
                ends = np.r_[0, np.cumsum(take)].astype(np.int32)
                keys = mix(h ^ np.uint64(ORDERS[nth]))
                keys = keys >> np.uint64(7) | rarity[cells] if nth == 0 else keys >> np.uint64(1) | late[cells]
                if nth == 0:
                    keys |= _shared(h, told.get(step)).astype(np.uint64) << np.uint64(63)
                out = np.empty(int(ends[-1]), np.uint64)
                for a, z, k, to in zip(off[:-1].tolist(), off[1:].tolist(), take.tolist(), ends[:-1].tolist(), strict=True):
                    if k:
                        out[to : to + k] = np.partition(keys[a:z], k - 1)[:k] if k < z - a else keys[a:z]
                if nth == 0:
                    held = out >> np.uint64(63) == 1
                    ends = np.r_[0, np.cumsum(held)][ends].astype(np.int32)
                    out = out[held]
                    some = some & (np.diff(ends) > 0)
                flat = pa.array(out.view(np.int64)) if nth == 0 else pa.array(out.astype(np.uint32).view(np.int32))
                cols.append(pa.ListArray.from_arrays(pa.array(ends), flat))
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n", *[f"p{k}" for k in orders]]).filter(pa.array(some))

    return run


def _shared(h: np.ndarray, told: tuple | None) -> np.ndarray:
    """Which hashes of a step occur in two texts or more; all, where nothing fits the step."""
    values, of, _ = _tails(h)
    if told is None or told[2] != len(values) or told[0] != zlib.crc32(values.tobytes()):
        return np.ones(len(h), bool)
    return np.unpackbits(told[1], count=told[2]).astype(bool)[of]


def _wanted(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    """The rows (id, bit, text) whose bit is in the filter, or all rows without one."""
    words = None if wanted is None else wanted.value
    for b in batches:
        if words is not None:
            bit = b.column(1).to_numpy()
            b = b.filter(pa.array((words[bit >> 5] >> (bit & 31).astype(np.uint32) & 1).astype(bool)))
        yield b


def _sets(size: int, wanted):
    """Of the rows whose bit is in the filter ``wanted``: id, the set's digest and the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(_wanted(batches, wanted), "text"):
            h, off = shingle_sets(b.column(2), size)
            data = [h[a:z].tobytes() for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            keys = [hashlib.blake2b(x, digest_size=16).digest() for x in data]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["id", "set", "hashes"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[list]]]:
    """lo, hi and the other columns of each group, from rows sorted by (lo, hi)."""
    key, held = None, []
    for b in batches:
        lo, hi = b.column(0).to_numpy(), b.column(1).to_numpy()
        new = np.nonzero(np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])[0].tolist() if len(lo) else []
        for a, z in zip(new, [*new[1:], len(lo)], strict=True):
            if key != (now := (int(lo[a]), int(hi[a]))):
                if key is not None:
                    yield *key, held
                key, held = now, [[] for _ in range(b.num_columns - 2)]
            for to, col in zip(held, b.columns[2:], strict=True):
                to += col.slice(a, z - a).to_pylist()
    if key is not None:
        yield *key, held


def _may_meet(lo: int, hi: int, side: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which pairs a group is for: those of two documents, one of either side if it has two."""
    pairs = ids[:, None] != ids[None, :]
    return pairs if lo == hi else pairs & (side[:, None] != side[None, :])


def _agree(percent: int):
    """Rows of groups: lo, hi, side, id, n and the prefixes in the other orders. The rows (lo,
    hi, side, id) that by sizes and prefixes may link with another of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lo, hi, (side, ids, n, *prefixes) in _groups(batches):
            side, ids, n = np.array(side, bool), np.array(ids, np.int64), np.array(n, np.int64)
            may = _may_meet(lo, hi, side, ids)
            may &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
            for p in prefixes:
                if may.any():
                    may &= shared_counts([np.unique(np.array(x, np.int32)) for x in p]) > 0
            if len(at := np.nonzero(may.any(axis=1))[0]):
                cols = [np.full(len(at), lo), np.full(len(at), hi), side[at], ids[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["lo", "hi", "side", "id"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of any two of the sets."""
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    often = np.bincount(column, minlength=len(values)) > 1
    keep = often[column]
    owner, column = owner[keep], (np.cumsum(often) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    counts = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int(often.sum()), COLUMNS):
        a, z = np.searchsorted(column, [at, at + COLUMNS])
        held = np.zeros((len(sets), int(column[z - 1]) - at + 1), np.float32)
        held[owner[a:z], column[a:z] - at] = 1
        counts += (held @ held.T).astype(np.int64)
    return counts


def _compare(percent: int, listed: bool):
    """Rows of groups: lo, hi, side, id, held, hashes. With ``listed`` the pairs that link: a, b,
    shared, n_either. Else, of each set that links in a group: id, the least id that it is
    connected to in the group, and the number of documents of the sets it links with."""
    names = ["a", "b", "shared", "n_either"] if listed else ["id", "root", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lo, hi, (side, ids, held, data) in _groups(batches):
            rows: dict = {}  # a row that is there twice counts once
            for k, key in enumerate(zip(ids, data, strict=True)):
                if key not in rows or held[k] > held[rows[key]]:
                    rows[key] = k
            at = np.array(list(rows.values()))
            side, ids, held = np.array(side, bool)[at], np.array(ids, np.int64)[at], np.array(held, np.int64)[at]
            sets = [np.frombuffer(data[k], np.uint64) for k in at.tolist()]
            n = np.array([len(x) for x in sets], np.int64)
            both = shared_counts(sets)
            either = n[:, None] + n[None, :] - both
            link = _may_meet(lo, hi, side, ids) & (both > 0) & (100 * both >= percent * either)
            if not link.any():
                continue
            if listed:
                x, y = np.nonzero(np.triu(link))
                cols = [np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), both[x, y], either[x, y]]
            else:
                root, before = ids, None
                while before is None or (root != before).any():
                    before = root
                    root = np.minimum(root, np.where(link, root[None, :], np.iinfo(np.int64).max).min(axis=1))
                some = link.any(axis=1)
                cols = [ids[some], root[some], (link @ held)[some]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return run


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bit set of fixed size with a bit for each id (1 MB at the driver)."""
    bits = ids.select(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("bit"))
    rows = bits.selectExpr("CAST(bit DIV 32 AS int) AS w", "shiftleft(1L, CAST(bit % 32 AS int)) AS v").groupBy("w").agg(F.bit_or("v").alias("v")).collect()
    words = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in rows:
        words[r["w"]] = r["v"]
    return words


class _Join:
    """The steps of one join over ``docs``."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int):
        self.spark, self.size, self.percent = ready(docs.sparkSession), size, percent
        self.texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
        seen = cut(self.texts.mapInArrow(_digests(size), "id long, n long, set binary, block int, counts binary"))
        self.levels = self.spark.sparkContext.broadcast(cell_levels(seen))
        self.rows = seen.where("block IS NULL").select("id", "n", "set")
        held = F.count("id").alias("held")  # documents: rows without an id take no part
        self.classes = cut(self.rows.groupBy("set").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("class_size"), held, F.max("n").alias("n")))

    def groups(self) -> DataFrame:
        """Which sets may link in which group: lo, hi, side, id."""
        reps = self.classes.where("n > 0 AND rep IS NOT NULL").select(F.col("rep").alias("id")).distinct()
        folder = tell_shared(self.texts, self.size)
        found = self.texts.mapInArrow(_prefixes(self.size, self.percent, self.levels, [0], folder=folder), "id long, n long, p0 array<long>")
        prefixes = cut(found.join(reps, "id", "left_semi"))
        posted = prefixes.select("id", F.col("n").cast("int").alias("n"), F.explode("p0").alias("token"))
        shared = posted.groupBy("token").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("token", "m")
        lists = cut(posted.join(shared, "token"))  # of the tokens that several documents hold
        home = lists.groupBy("id").agg(F.max(F.struct("m", "token")).alias("h"), F.max("n").alias("n")).select("id", "n", F.col("h.token").alias("home"))
        home = cut(home)
        chunks = F.ceil(F.greatest(F.col("k") / BLOCK_SETS, F.col("mass") / BLOCK_SHINGLES)).cast("int")
        homes = home.groupBy("home").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("mass")).select("home", "k", chunks.alias("chunks"))
        part = F.expr("CAST(pmod(xxhash64(id), chunks) AS int)").alias("part")
        placed = cut(home.join(homes, "home").select("id", "home", "k", "chunks", part))
        block = F.xxhash64("home", "part").alias("block")
        # the members of one home all share its token: each block meets each
        own = placed.where("k > 1").select("id", "home", block, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"))
        own = own.select("id", "block", F.xxhash64("home", "part").alias("other"))
        # in other lists, blocks of different homes
        spots = lists.select("token", "id").join(placed.select("id", "home", block), "id")
        others = spots.select("token", F.col("home").alias("their"), F.col("block").alias("other")).distinct()
        far = spots.join(others, "token").where("home != their").select("id", "block", "other").distinct()
        meet = own.union(far).select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.expr("block > other").alias("side"), "id")
        return self.agreed(cut(meet), self.few(home.select("id")))

    def few(self, ids: DataFrame) -> tuple[DataFrame, object]:
        """The texts (id, bit, text) and a filter of those with one of ``ids``."""
        bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("bit")
        return self.texts.where("id IS NOT NULL").select("id", bit, "text"), self.spark.sparkContext.broadcast(_id_filter(ids))

    def dealt(self, meet: DataFrame, rows: DataFrame) -> DataFrame:
        """The groups' rows, one group after another."""
        whole = meet.join(rows, "id").repartition(partitions(self.spark), "lo", "hi").sortWithinPartitions("lo", "hi")
        return whole.select("lo", "hi", "side", "id", *[c for c in rows.columns if c != "id"])

    def agreed(self, meet: DataFrame, few: tuple[DataFrame, object]) -> DataFrame:
        """The groups' rows that the sizes and the prefixes in every other order leave."""
        texts, wanted = few
        orders = list(range(1, len(ORDERS)))
        run = _prefixes(self.size, self.percent, self.levels, orders, wanted)
        rows = texts.mapInArrow(run, "id long, n long" + "".join(f", p{k} array<int>" for k in orders))
        return cut(self.dealt(meet, rows).mapInArrow(_agree(self.percent), "lo long, hi long, side boolean, id long").distinct())

    def compared(self, listed: bool) -> DataFrame:
        """What the groups' tasks find (see ``_compare``)."""
        meet = self.groups()
        texts, wanted = self.few(meet.select("id").distinct())
        sets = texts.mapInArrow(_sets(self.size, wanted), "id long, set binary, hashes binary")
        # of rows that share an id only the text that stands for its class counts documents
        known = self.classes.where("n > 0").select(F.col("rep").alias("id"), F.col("set").alias("own"), "held")
        held = F.when(F.col("set") == F.col("own"), F.col("held")).otherwise(F.lit(0)).alias("held")
        rows = sets.join(known, "id").select("id", held, "hashes")
        out = "a long, b long, shared long, n_either long" if listed else "id long, root long, links long"
        return cut(self.dealt(meet, rows).mapInArrow(_compare(self.percent, listed), out))


def join_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links, as two tables. ``pairs``: a, b, shared, n_either, a row for any two sets that
    link (a < b: the smallest ids of their documents; the sizes of intersection and union).
    ``members``: id_col, class_id, class_size, a row per row of ``docs``; documents of one
    class have equal sets and link with each other and with those of each linked class. Rows
    without shingles or without an id link with nothing: their class_id is null.

    See ``join_components`` for words and links."""
    join = _Join(docs, id_col, text_col, size, percent)
    of_class = join.classes.select("set", "rep", "class_size")
    rep = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("rep")).alias("class_id")
    members = join.rows.join(of_class, "set").select(F.col("id").alias(id_col), rep, "class_size")
    return join.compared(listed=True).distinct(), members


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id, class_size, n_links.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Two documents link when
    100 * intersection >= percent * union of their sets of ``size``-word shingles; a
    text with fewer words has one shingle, a null or empty one has none and links with
    nothing. component_id is the smallest id reachable by links; class_size counts the
    rows with the same set; n_links counts the other documents that the document links
    with, those with the same set too. A row with a null id takes no part: its component
    and links are null. Rows that share an id are one document. Other columns are not
    read. An empty table gives no rows.

    Shingles are told apart by 64-bit hashes, equal sets by a 128-bit digest."""
    join = _Join(docs, id_col, text_col, size, percent)
    found = join.compared(listed=False)
    label = components(found, "id", "root").select(F.col("node").alias("rep"), "component")
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    of_class = join.classes.join(label, "rep", "left").join(links, "rep", "left").select("set", "class_size", "held", "links", F.coalesce("component", "rep").alias("component"))
    alone = F.col("id").isNull() | (F.col("n") == 0)
    return join.rows.join(of_class, "set").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component_id"),
        "class_size",
        F.when(alone, F.col("id") * 0).otherwise(F.col("held") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **named) -> DataFrame:
    """The rows of ``docs`` that stand for their component: those with its smallest id.
    Rows without shingles or without an id all stay."""
    judged = join_components(docs, id_col, text_col, **named)
    gone = judged.where(f"`{id_col}` != component_id").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)

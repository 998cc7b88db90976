"""Repeated passages by a depth-limited radix sort of suffixes, most significant digits first.

Every position of a text starts a suffix; only its first LENGTH bytes (its window) count.
Suffixes are put into ever smaller groups digit by digit, and a suffix that is alone in its
group leaves, so that few are ever looked at closely; what is left together after the last
digit are exactly the repeated windows. Three things differ from the textbook sort, as a row
for each byte would shuffle many times the input:

- The sort is sparse: its first digit is that of the window's anchor, the GRAM bytes in it with the
  least hash. Equal windows have equal anchors at equal places, and neighbours mostly share
  one: it is sorted once for all suffixes of its run.
- Digits are wide and compared by hash, so groups are found by hash and not in byte order. The second digit is
  the core, the bytes that STARTS neighbouring suffixes, counted from the anchor, all have; the third
  the bytes around it, first for the block as a whole, then, where its core has several sorts of
  surroundings, for each suffix.
- Copies of a whole text are sorted as one.

Every pass counts with partial sums; blocks of one core, edges and mask are summed to a class before
classes are sorted by core, and a core with more than HOT_CORE classes is spread over all tasks.

`passages` finds documents that share a run of words with another one, by the same sparse first digit over words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.minhash import WordHashes, _groups, mix
from voxloom.llm.shared import documents, text_or_empty, written

LENGTH = 400
GRAM = 64
STARTS = 32
HOT_CORE = 20_000
#: `passages`: a run of so many words is always found, and none that is shorter than the second number.
PASSAGE, FLOOR = 51, 40
#: So many hot cores are broadcast at most, of 8 bytes each.
HOT_BROADCAST = 100_000
#: Texts are hashed together up to so many bytes; longer ones in pieces that overlap by a window.
CHUNK, PIECE = 1 << 16, 1 << 20

_rng = np.random.Generator(np.random.PCG64(6))
_BYTE = _rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(0, 2**63)) * 8 + 5
_EDGE = _rng.integers(0, 2**63, STARTS, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        m = 1 << max(17, n.bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(m, base % (1 << 64), np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


class Hashes:
    """Hashes of any stretch of some bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.up = up
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:-1], out=self.sums[1:])

    def grams(self, n: int) -> np.ndarray:
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])

    def strong(self, n: int):
        """A function of starts: hashes of n bytes made of their mixed 16-byte grams, so that no sum of bytes alone decides them."""
        grams = self.grams(16)
        sums = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(grams * self.up[: len(grams)], out=sums[1:])
        return lambda start: mix((sums[start + n - 15] - sums[start]) * self.down[start])


def runs(hashes: Hashes, owner: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor, its gram's hash, and the first and last start of each run of windows with that anchor; owner: the text of each byte."""
    n, width = len(owner), length - GRAM + 1
    if n < length:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    grams = hashes.grams(GRAM)
    at = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal ones
    rows = -(-len(at) // width)
    padded = np.full(rows * width, 2**64 - 1, np.uint64)
    padded[: len(at)] = at
    padded = padded.reshape(rows, width)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    anchor = (np.minimum(after[:starts], before[width - 1 : width - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    anchor[owner[:starts] != owner[length - 1 :]] = -1
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:] - 1, starts - 1]
    real = anchor[first] >= 0
    first, last = first[real], last[real]
    return anchor[first], grams[anchor[first]], first, last


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each begins."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, end text, first byte, end byte) of what is hashed together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        if j == i + 1 and hi - lo > PIECE + length:
            for s in range(lo, hi - length + 1, PIECE):
                yield i, j, s, min(hi, s + PIECE + length - 1)
        else:
            yield i, j, lo, hi
        i = j


def _found(batch_texts: pa.Array, length: int):
    """For each piece: its bytes' hashes, their owners (rows of the batch), first byte, and runs."""
    data, offsets = _texts(batch_texts)
    for i, j, lo, hi in _pieces(offsets, length):
        if hi - lo >= length:
            ends = np.clip(offsets[i : j + 1], lo, hi)
            owner = np.repeat(np.arange(i, j), np.diff(ends))
            hashes = Hashes(data[lo:hi])
            yield data, offsets, lo, hashes, owner, runs(hashes, owner, length)


def _anchored(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for _, _, _, _, owner, (_, gram, first, _) in _found(batch.column(2), length):
                row = owner[first]
                yield pa.RecordBatch.from_pydict({"gram": gram.astype(np.int64), "id": ids[row], "h": hs[row]})

    return run


def _blocks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            hot = batch.column(3)
            hot_at, hot_of = np.asarray(hot.offsets), np.asarray(hot.flatten()).astype(np.uint64)
            hot_at = hot_at - hot_at[0]
            for data, offsets, lo, hashes, owner, (anchor, gram, first, last) in _found(batch.column(2), length):
                row = owner[first]
                keep = np.zeros(len(row), bool)
                for r in np.unique(row):
                    mine = slice(*np.searchsorted(row, (r, r + 1)))
                    keep[mine] = np.isin(gram[mine], hot_of[hot_at[r] : hot_at[r + 1]])
                anchor, first, last, row = anchor[keep], first[keep], last[keep], row[keep]
                if not len(row):
                    continue
                low, high = (anchor - last) // STARTS, (anchor - first) // STARTS
                n = high - low + 1
                i = np.repeat(np.arange(len(row)), n)
                b = low[i] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                s0 = anchor[i] - STARTS * b - (STARTS - 1)
                a, z = np.maximum(0, first[i] - s0), np.minimum(STARTS - 1, last[i] - s0)
                mask = ((np.int64(1) << (z - a + 1)) - 1) << a
                core = hashes.strong(length - STARTS + 1)(s0 + STARTS - 1)
                where = s0[:, None] + np.r_[np.arange(STARTS - 1), length + np.arange(STARTS - 1)] + lo
                inside = (where >= offsets[row[i]][:, None]) & (where < offsets[row[i] + 1][:, None])
                edges = np.where(inside, data[np.clip(where, 0, len(data) - 1)], 0).astype(np.uint8)
                width = edges.shape[1]
                yield pa.RecordBatch.from_pydict({"core": core.astype(np.int64), "edges": pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer((np.arange(len(edges) + 1) * width).astype(np.int32)), pa.py_buffer(edges.tobytes())]), "mask": mask, "id": ids[row[i]], "h": hs[row[i]], "s0": s0 + lo - offsets[row[i]]})

    return run


def _repeated_in_core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which suffixes of each class of blocks (core, edges, mask, n) are repeated, core by core."""
    for table in _groups(batches, 1, 50_000):
        core, mask, n = (table.column(k).to_numpy() for k in ("core", "mask", "n"))
        edges = np.frombuffer(b"".join(table.column("edges").to_pylist()), np.uint8).reshape(len(core), 2 * (STARTS - 1))
        alone = np.r_[True, core[1:] != core[:-1]] & np.r_[core[1:] != core[:-1], True]
        bits = np.where(alone & (n > 1), mask, 0)
        rest = np.flatnonzero(~alone)
        for i in range(STARTS):
            r = rest[(mask[rest] >> i) & 1 == 1]
            key = mix((edges[r, i : i + STARTS - 1] * _EDGE[: STARTS - 1]).sum(axis=1, dtype=np.uint64) + mix(core[r].astype(np.uint64)))
            _, at = np.unique(key, return_inverse=True)
            bits[r[np.bincount(at, n[r])[at] > 1]] |= 1 << i
        yield pa.RecordBatch.from_pydict({"core": core, "class": table.column("class").combine_chunks(), "bits": bits})


def _repeated_in_hot(classes: DataFrame) -> DataFrame:
    """The same, for cores of too many blocks: a row for each suffix, counted with partial sums."""
    each = classes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1)))).where("(shiftright(mask, i) & 1) = 1").withColumn("own", F.expr(f"substring(edges, i + 1, {STARTS - 1})"))
    many = each.groupBy("core", "i", "own").agg(F.sum("n").alias("all")).where("all > 1").drop("all")
    return each.join(many, ["core", "i", "own"]).groupBy("core", "class").agg(F.expr("bit_or(shiftleft(1L, i))").alias("bits"))


def repeats(docs: DataFrame, length: int = LENGTH, hot_core: int = HOT_CORE) -> DataFrame:
    """(id, h, whole, marks) of the texts with repeats: h is the text's hash; whole says that all of it repeats; marks are (s0, bits).

    Bit i of a mark says that the window of `length` bytes from byte s0 + i starts elsewhere too.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), text_or_empty("text").alias("text")).withColumn("h", F.xxhash64("text"))
    ids = written(keyed.where(F.octet_length("text") >= length).select("id", "h", F.unhex(F.md5("text")).alias("copy")), "texts")
    copies = ids.groupBy("h", "copy").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    several = written(copies.where("n > 1"), "copies")
    whole = ids.join(several.drop("first", "n"), ["h", "copy"]).select("id", "h").distinct()
    extra = ids.join(several, ["h", "copy"]).where("id <> first").select("id", "h").distinct()

    anchors = written(keyed.select("id", "h", "text").mapInArrow(_anchored(length), "gram long, id long, h long"), "anchors")
    single = anchors.join(extra, ["id", "h"], "left_anti")
    # written, so that the join has a plain side and the rows of a very common gram can be split
    hot = written(single.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams").hint("merge")
    of_text = single.join(hot, "gram").groupBy("id", "h").agg(F.collect_set("gram").alias("hot"))
    blocks = written(keyed.join(of_text, ["id", "h"]).select("id", "h", "text", "hot").mapInArrow(_blocks(length), "core long, edges binary, mask long, id long, h long, s0 long"), "blocks")

    classes = written(blocks.groupBy("core", "edges", "mask").agg(F.count("*").alias("n")).withColumn("class", F.xxhash64("edges", "mask")), "classes")
    large = written(classes.groupBy("core").agg(F.count("*").alias("k")).where(F.col("k") > hot_core).select("core"), "hot-cores")
    n_large = large.count()  # one in hot_core of the classes at most
    split = F.broadcast(large) if n_large <= HOT_BROADCAST else large.hint("merge")
    usual = classes.join(split, "core", "left_anti") if n_large else classes
    found = usual.select("core", "class", "edges", "mask", "n").repartition("core").sortWithinPartitions("core").mapInArrow(_repeated_in_core, "core long, class long, bits long")
    if n_large:
        found = found.union(_repeated_in_hot(classes.join(split, "core", "left_semi")))
    found = written(found.where("bits <> 0"), "repeated")
    marks = blocks.select("core", F.xxhash64("edges", "mask").alias("class"), "id", "h", "s0").join(found.hint("merge"), ["core", "class"]).groupBy("id", "h").agg(F.collect_list(F.struct("s0", "bits")).alias("marks"))
    return marks.join(whole.withColumn("whole", F.lit(True)), ["id", "h"], "full")


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot_core: int = HOT_CORE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row of docs(doc_id, text).

    Texts are bytes of UTF-8; a null one is empty. Every byte covered by a string of `length` bytes
    that also starts anywhere else, in the same text or another, is removed; matches never
    cross texts, overlaps count, and all strings are judged on the input. Rows that repeat
    a doc_id, or have none, are texts of their own. Other columns are ignored; an empty table gives no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).withColumns({"id": F.coalesce("doc_id", F.lit(-(2**63))), "h": F.xxhash64("text")})
    marked = keyed.join(repeats(docs, length, hot_core), ["id", "h"], "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), F.col("marks.s0").alias("s0"), F.col("marks.bits").alias("bits"))
    every = np.arange(STARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                data, offsets = _texts(part.column(1))
                rows = []
                for r, (whole, s0, bits) in enumerate(zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)):
                    text = data[offsets[r] : offsets[r + 1]]
                    spans = np.zeros((0, 2), np.int64)
                    if whole:
                        spans = np.array([[0, len(text)]])
                    elif s0:
                        at = np.array(s0)[:, None] + every
                        at = np.unique(at[(np.array(bits)[:, None] >> every) & 1 == 1])
                        cut = np.flatnonzero(np.diff(at) > length)
                        spans = np.stack([at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + length], axis=1)
                    ends = np.r_[0, spans.ravel(), len(text)]
                    kept = b"".join(text[a:b].tobytes() for a, b in zip(ends[0::2], ends[1::2], strict=True))
                    rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
                n, removed, spans, sha, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _word_anchors(passage: int, floor: int):
    """(id, text) -> gram and id of each anchor: of any `passage` words in a row, the `floor` words in a row in them with the least hash."""
    window = passage - floor + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                split = [t.encode("utf-8", "surrogatepass").split() for t in part.column(1).to_pylist()]
                sizes = np.array(list(map(len, split)), np.int64)
                words = np.fromiter((known[w] for x in split for w in x), np.uint64, sizes.sum())
                n = len(words)
                if n < floor:
                    continue
                up, down = _power(n + 1)
                sums = np.zeros(n + 1, np.uint64)
                np.cumsum(words * up[:n], out=sums[1:])
                grams = mix((sums[floor:] - sums[:-floor]) * down[: n + 1 - floor])
                owner = np.repeat(np.arange(len(sizes)), sizes)
                grams[owner[: len(grams)] != owner[floor - 1 :]] = 2**64 - 1  # across two texts
                seen = np.lib.stride_tricks.sliding_window_view(grams, min(window, len(grams)))
                at = np.unique(np.arange(len(seen)) + seen.argmin(axis=1))
                at = at[grams[at] != 2**64 - 1]
                yield pa.RecordBatch.from_pydict({"gram": grams[at].astype(np.int64), "id": part.column(0).to_numpy()[owner[at]]})

    return run


def passages(docs: DataFrame, passage: int = PASSAGE, floor: int = FLOOR) -> DataFrame:
    """doc_id of the documents of docs(doc_id, text) that share a run of words with a document of another doc_id.

    Words are runs without ASCII white space. Every run of `passage` words or more is found, and
    none of fewer than `floor` counts; between them a run is found if one of its grams of `floor` words is an
    anchor. Copies within one document don't count. Null and empty texts share nothing, and rows without a doc_id
    are left out. Other columns are ignored; an empty table gives no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty("text").alias("text")).where("id IS NOT NULL")
    anchors = written(keyed.mapInArrow(_word_anchors(passage, floor), "gram long, id long"), "word-anchors")
    shared = written(anchors.groupBy("gram").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("gram"), "shared-grams")
    return anchors.join(shared.hint("merge"), "gram", "left_semi").select(F.col("id").alias("doc_id")).distinct()


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and shares_passage: whether a run of over 50 words is in another document too."""
    docs = documents(spark, sf_dir)
    shared = written(passages(docs), "passages").withColumn("shares_passage", F.lit(True))
    return remove_repeats(docs).drop("kept").join(shared, "doc_id", "left").withColumn("shares_passage", F.coalesce("shares_passage", F.lit(False)))

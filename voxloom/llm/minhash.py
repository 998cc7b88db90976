"""MinHash near-dedup by a multi-index Hamming join.

1. Each document's set of word shingles (64-bit hashes) gives a signature of SYMBOLS b-bit
   MinHash symbols. Documents with one and the same set become one class.
2. Signatures at most T symbols apart are found by pigeonhole: split into m chunks, two
   such signatures agree on some chunk but for floor(T / m) symbols. Each chunk is indexed
   under every choice of that many symbols left out, so such a pair shares a key. T is so
   large that a pair at the similarity threshold is further apart once in some 10,000.
3. Within a key of up to BLOCK classes all pairs are compared by signature; those of a larger
   key are all joined to its least one. Components are families. A true link never leaves one.
4. Within a family the full sets are recomputed from the texts and compared: all pairs of up
   to BLOCK documents. A larger family is dealt into blocks at random, twice, each block
   compared in full; that joins the copies of one text. Whoever is still apart meets
   by an index of rare shingles: two sets that are linked share one of their first ones,
   rarest first, and at a place that leaves both enough of them (a prefix and a place that
   rule no link out). Each entry of the index carries a sketch of its set, SKETCH parity bits: two
   sets differ in at least as many shingles as their sketches do in bits, which rules out
   whatever is not within a few shingles of the threshold, and never a link. Pairs that are apart and pass
   name two blocks of the family; each two blocks are compared in full, but only among the
   documents that are in such a pair there.

No step holds a key or a family in one task, and none writes or sends a row for each pair. Texts are sent a fixed number of times, and those of 4.
that still have a candidate once to each two blocks in which they have one: at most a family's size / BLOCK times, where
many pairs lie just above the threshold. Links are returned as spanning forests. A sketch saturates where a set has more than some 6,000
shingles, so that it rules out less there.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.llm.shared import connected_components, documents, text_or_empty, written

SYMBOLS = 64
BLOCK = 256
#: Parity bits of a set's sketch.
SKETCH = 2048
#: Standard deviations between the expected distance at the threshold and T.
MARGIN = 3.8
#: Words whose hashes a worker remembers at once.
REMEMBERED = 200_000
SEGMENT = 100_000

_rng = np.random.Generator(np.random.PCG64(20))
_A = _rng.integers(0, 2**63, SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SYMBOLS, np.uint64)
_POSITION = _rng.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = _rng.integers(0, 2**63, SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (two multiply and xor-shift rounds)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: str, k: int, hashes: WordHashes) -> np.ndarray:
    """The distinct hashes of a text's k-word shingles in ascending order; of all its words if there are fewer than k."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - k + 1
    if n < 1:
        return mix(np.atleast_1d((h * _POSITION[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))))
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += h[i : i + n] * _POSITION[i]
    return np.unique(mix(total))


def signature(x: np.ndarray) -> bytes:
    """The lowest bits of the least value of each of SYMBOLS hash functions over the set."""
    least = np.full(SYMBOLS, 2**64 - 1, np.uint64)
    for i in range(0, len(x), 2048):
        least = np.minimum(least, (x[i : i + 2048, None] * _A + _B).min(axis=0))
    return (mix(least) >> np.uint64(48)).astype("<u2").tobytes()


def sketch(x: np.ndarray) -> bytes:
    """SKETCH bits, each the parity of the number of the set's values that fall on it; two sets' sketches differ in no more bits than the sets in values."""
    return np.packbits((np.bincount((x % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def distance_bound(num: int, den: int = 100) -> int:
    """T: the signature distance that a pair of similarity num/den hardly ever passes."""
    p = 1 - num / den
    return min(SYMBOLS - 1, math.ceil(SYMBOLS * p + MARGIN * math.sqrt(SYMBOLS * p * (1 - p))))


def chunk_keys(sigs: np.ndarray, bound: int, errors: int = 1) -> np.ndarray:
    """(rows, keys): for every chunk, a key for each choice of `errors` symbols left out."""
    m = bound // (errors + 1) + 1  # the fewest chunks with floor(bound / m) <= errors
    products = sigs.astype(np.uint64) * _KEY
    keys = []
    for c, chunk in enumerate(np.array_split(np.arange(SYMBOLS), m)):
        whole = products[:, chunk].sum(axis=1, dtype=np.uint64)
        for out in itertools.combinations(chunk, min(errors, len(chunk) - 1)):
            left = whole.copy()
            for j in out:
                left -= products[:, j]
            keys.append(mix(left + np.uint64((c * SYMBOLS + sum(out)) * 2654435761 + 1)))
    return np.stack(keys, axis=1)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes can reach over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new[label]
    return label


def _spanning(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Edges (a, b) of ids that connect what the links between positions a and b connect."""
    nodes, at = np.unique(ids, return_inverse=True)
    root = forest(len(nodes), at[a], at[b])
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_pydict({"a": pa.array(nodes[moved], pa.int64()), "b": pa.array(nodes[root[moved]], pa.int64())})


def _groups(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[pa.Table]:
    """Tables of about `most` rows that never cut a group of equal values in the first `keys` columns; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            table = pa.Table.from_batches(held)
            last = np.ones(rows, bool)
            for k in range(keys):
                c = table.column(k).to_numpy()
                last &= c == c[-1]
            cut = rows - int(last[::-1].argmin()) if not last.all() else 0
            if cut:
                yield table.slice(0, cut)
                held, rows = table.slice(cut).to_batches(), rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def in_blocks(rows: DataFrame, size: str, keys: list[str], node: str, block: int) -> DataFrame:
    """rows dealt out by keys, and for keys of more than `block` rows by pairs of blocks (bi, bj), each row to all pairs of its own."""
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(node), blocks).cast("int")
    spread = rows.withColumns({"_own": own, "_j": F.explode(F.sequence(F.lit(0), blocks - 1))})
    dealt = spread.withColumns({"bi": F.least("_own", "_j"), "bj": F.greatest("_own", "_j")}).drop("_own", "_j", size)
    return dealt.repartition(*keys, "bi", "bj").sortWithinPartitions(*keys, "bi", "bj")


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set and signature of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                sets = [shingles(t, k, hashes) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n_shingles": pa.array(map(len, sets), pa.int64()), "digest": [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], "sig": [signature(x) if len(x) else b"" for x in sets]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SYMBOLS)


def _keyed(bound: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                keys = chunk_keys(_matrix(part.column(1)), bound)
                ids = np.repeat(part.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_pydict({"key": keys.astype(np.int64).ravel(), "id": ids})

    return run


def _near(bound: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 1, SEGMENT):
            key, ids = (table.column(i).to_numpy() for i in range(2))
            sigs = _matrix(table.column(2))
            new = np.r_[True, key[1:] != key[:-1]]
            group = np.cumsum(new)
            left = np.bincount(group)[group] - (np.arange(len(group)) - np.flatnonzero(new)[group - 1])  # rows from here to the group's end
            a, b = [], []
            for d in range(1, int(left.max(initial=0))):
                i = np.flatnonzero(left > d)
                for s in range(0, len(i), 50_000):
                    x = i[s : s + 50_000]
                    x = x[(sigs[x] != sigs[x + d]).sum(axis=1) <= bound]
                    a.append(x)
                    b.append(x + d)
            if a:
                yield _spanning(ids, np.concatenate(a), np.concatenate(b))

    return run


def _linked(k: int, num: int, den: int, tagged: bool = False) -> Callable:
    """(root, bi, bj, node, text), sorted by the first three -> a forest (a, b) of each group's links; tagged: with the group's bj."""

    def links(sets: list[np.ndarray]) -> np.ndarray:
        """Which pairs share enough, from the products of their rows over the shingles that two or more have."""
        sizes = np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts[at] > 1
        owner, at = owner[shared], at[shared]
        _, at = np.unique(at, return_inverse=True)
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        common = np.zeros((len(sets), len(sets)), np.float64)
        width = 4096
        for start in range(0, int(at[-1]) + 1 if len(at) else 0, width):
            lo, hi = np.searchsorted(at, (start, start + width))
            rows = np.zeros((len(sets), width), np.float32)
            rows[owner[lo:hi], at[lo:hi] - start] = 1
            common += rows @ rows.T
        both = np.rint(common).astype(np.int64)
        return den * both >= num * (sizes[:, None] + sizes[None, :] - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for table in _groups(batches, 3, 500):
            root, bi, bj, ids = (table.column(i).to_numpy() for i in range(4))
            texts = table.column(4)
            starts = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
            for lo, hi in zip(starts, [*starts[1:], len(root)], strict=True):
                if hi - lo > 1:
                    a, b = np.nonzero(np.triu(links([shingles(t, k, hashes) for t in texts.slice(lo, hi - lo).to_pylist()]), 1))
                    if len(a):
                        found = _spanning(ids[lo:hi], a, b)
                        yield found.append_column("deal", pa.array(np.full(found.num_rows, bj[lo], np.int32))) if tagged else found

    return run


def _in_order(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(root, node, comp, h, text) -> root, node, comp, h, n and every shingle."""
    hashes = WordHashes()
    for batch in batches:
        for i in range(0, batch.num_rows, 100):
            part = batch.slice(i, 100)
            sets = [shingles(t, k, hashes) for t in part.column(4).to_pylist()]
            sizes = np.array([len(x) for x in sets], np.int64)
            wide = [np.repeat(part.column(c).to_numpy(), sizes) for c in range(4)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, wide), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))], names=["root", "node", "comp", "h", "n", "s"])


def _sketched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(root, node, h, m, text) -> root, node, h, m and the sketch of the text's set."""
    hashes = WordHashes()
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            found = [sketch(shingles(t, k, hashes)) for t in part.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(found, pa.binary())], names=["root", "node", "h", "m", "sketch"])


def _passing(num: int, den: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places (root, bi, bj, node) to compare the pairs of each group (root, s, bi, bj) that are apart, leave enough to share and have near enough sketches."""
        for table in _groups(batches, 4, SEGMENT):
            heads = [table.column(i).to_numpy() for i in range(4)]
            node, comp, n, place, m = (table.column(i).to_numpy() for i in range(4, 9))
            bits = np.frombuffer(b"".join(table.column(9).to_pylist()), np.uint64).reshape(len(node), -1)
            new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in heads])]
            starts = np.flatnonzero(new)
            for lo, hi in zip(starts, [*starts[1:], len(new)], strict=True):
                c, size, left, own = comp[lo:hi], n[lo:hi], n[lo:hi] - place[lo:hi], bits[lo:hi]
                block = (mix(node[lo:hi].view(np.uint64)) % np.uint64(-(-m[lo] // BLOCK))).astype(np.int64)
                found = []  # position, block of its partner
                for x in range(hi - lo - 1):
                    common = np.minimum(left[x], left[x + 1 :])
                    ok = (c[x + 1 :] != c[x]) & (den * common >= num * (size[x] + size[x + 1 :] - common))
                    y = np.flatnonzero(ok) + x + 1
                    total, apart = size[x] + size[y], np.bitwise_count(own[y] ^ own[x]).sum(axis=1, dtype=np.int64)
                    y = y[den * (total - apart) >= num * (total + apart)]
                    if len(y):
                        found += [np.stack([np.full(len(y), x), block[y]]), np.stack([y, np.full(len(y), block[x])])]
                if found:
                    at, other = np.unique(np.concatenate(found, axis=1), axis=1)
                    low, high = np.minimum(block[at], other), np.maximum(block[at], other)
                    yield pa.RecordBatch.from_pydict({"root": np.full(len(at), heads[0][lo]), "bi": low.astype(np.int32), "bj": high.astype(np.int32), "node": node[lo:hi][at]})

    return run


def _links_of_large(large: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect what is linked in large(root, node, n, text), families of more than BLOCK documents."""
    deal = F.explode(F.sequence(F.lit(0), F.lit(1)))
    dealt = large.withColumn("bj", deal).withColumn("bi", F.pmod(F.xxhash64("node", "bj"), F.ceil(F.col("n") / BLOCK).cast("long")).cast("int"))
    blocks = dealt.select("root", "bi", "bj", "node", "text").repartition("root", "bi", "bj").sortWithinPartitions("root", "bi", "bj")
    tagged = written(blocks.mapInArrow(_linked(k, num, den, True), "a long, b long, deal int"), "links")
    links = tagged.select("a", "b")
    # a node's root in each of its two blocks; blocks that share a node are brought to one label, there and back
    own = tagged.groupBy(F.col("a").alias("node")).agg(*[F.min(F.when(F.col("deal") == d, F.col("b"))).alias(f"l{d}") for d in (0, 1)])
    labels = written(large.select("root", "node", F.col("n").alias("m"), "text").join(own.hint("merge"), "node", "left").withColumns({f"l{d}": F.coalesce(f"l{d}", "node") for d in (0, 1)}), "labels")
    step = labels.select("l0", "l1", "node").join(labels.groupBy("l0").agg(F.min("l1").alias("m")), "l0")
    step = written(step.select("node", "l1", "m"), "labels")  # labels have a block's nodes at most
    comp = step.join(step.groupBy("l1").agg(F.min("m").alias("comp")), "l1").groupBy("node").agg(F.min("comp").alias("comp"))
    labelled = written(labels.select("root", "node", "m", "text").join(comp.hint("merge"), "node"), "labelled")
    open_ = written(labelled.groupBy("root").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("root"), "apart")
    if open_.isEmpty():
        return links
    apart = labelled.join(open_.hint("merge"), "root", "left_semi").select("root", "node", "comp", F.xxhash64("text").alias("h"), "m", "text")
    each = written(apart.drop("m").mapInArrow(lambda b: _in_order(b, k), "root long, node long, comp long, h long, n long, s long"), "apart-shingles")
    df = written(each.groupBy("root", "s").agg(F.count("*").alias("df")).where("df > 1"), "shared-shingles")
    # shingles of one document alone come first and are shared with none: how many there are is all that is needed of them
    shared = each.join(df.hint("merge"), ["root", "s"])
    order = F.row_number().over(Window.partitionBy("root", "node", "h").orderBy("df", "s"))  # a document at a time
    known = F.count("*").over(Window.partitionBy("root", "node", "h"))
    placed = shared.withColumns({"_k": known, "_o": order}).withColumn("place", F.col("n") - F.col("_k") + F.col("_o") - 1)
    sketches = apart.drop("comp").select("root", "node", "h", "m", "text").mapInArrow(lambda b: _sketched(b, k), "root long, node long, h long, m long, sketch binary")
    sketches = sketches.groupBy("root", "node", "h").agg(F.first("m").alias("m"), F.first("sketch").alias("sketch"))  # rows that are equal have one
    first = placed.where(f"place <= n - ceil(n * {num} / {den})").select("root", "s", "node", "h", "comp", "n", "place")
    prefix = written(first.join(sketches.hint("merge"), ["root", "node", "h"]), "prefixes")
    several = prefix.groupBy("root", "s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("several")).where("lo <> hi").select("root", "s", "several")
    met = in_blocks(prefix.join(several.hint("merge"), ["root", "s"]), "several", ["root", "s"], "node", 4 * BLOCK)
    met = met.select("root", "s", "bi", "bj", "node", "comp", "n", "place", "m", "sketch")
    named = written(met.mapInArrow(_passing(num, den), "root long, bi int, bj int, node long").distinct(), "candidates")
    sent = named.join(labelled.select("node", "text").hint("merge"), "node").select("root", "bi", "bj", "node", "text")
    sent = sent.repartition("root", "bi", "bj").sortWithinPartitions("root", "bi", "bj")
    return links.union(sent.mapInArrow(_linked(k, num, den), "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs(doc_id, text).

    Words are runs without ASCII white space, with A-Z lower-cased. Documents are linked
    when den * |A and B| >= num * |A or B| on their full sets of `shingle`-word shingles; a
    text of fewer words has all of them as its one shingle; a null, empty or blank text has none and
    is linked with nothing. component_id is the smallest doc_id that links reach, and kept
    says that it is the row's own. Rows that repeat a doc_id are one document with the
    links of each. A null doc_id links with nothing; it has no component_id and is kept.
    Other columns are ignored; an empty table gives no rows.
    """
    bound = distance_bound(num, den)
    signed = written(_signed(docs, shingle), "signed")
    classes = written(signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    keys = classes.select("rep", "sig").mapInArrow(_keyed(bound), "key long, id long")
    multiple = written(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1"), "keys")
    # sorted and merged at every size: none of these sides has a bound that would let it be broadcast
    hits = written(keys.join(multiple.hint("merge"), "key"), "hits")
    some = hits.where(F.col("n") <= BLOCK).join(classes.select(F.col("rep").alias("id"), "sig").hint("merge"), "id").select("key", "id", "sig").repartition("key").sortWithinPartitions("key")
    near = some.mapInArrow(_near(bound), "a long, b long").union(hits.where((F.col("n") > BLOCK) & (F.col("id") != F.col("least"))).select("id", "least"))
    families = written(connected_components(near), "families")
    sizes = written(families.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    families = families.join(sizes.hint("merge"), "root")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), text_or_empty("text").alias("text")).where("node IS NOT NULL")
    members = written(texts.join(families.hint("merge"), "node").select("root", "node", "n", "text"), "members")  # all texts are shuffled here alone
    small = members.where(F.col("n") <= BLOCK).select("root", F.lit(0).alias("bi"), F.lit(0).alias("bj"), "node", "text").repartition("root").sortWithinPartitions("root")
    linked = written(small.mapInArrow(_linked(shingle, num, den), "a long, b long"), "links")
    large = members.where(F.col("n") > BLOCK)
    if not large.isEmpty():
        linked = linked.union(_links_of_large(large, shingle, num, den))
    named = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    twice = written(named.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("x"), F.max(F.xxhash64("digest")).alias("y")).where("x <> y").select("doc_id"), "twice")
    if not twice.isEmpty():  # ids with several texts have the links of each
        several = named.join(twice, "doc_id").join(classes.select("digest", "rep"), "digest").where("doc_id <> rep")
        linked = linked.union(several.select("doc_id", "rep"))
    components = connected_components(linked).select(F.col("node").alias("rep"), "root")
    of_class = classes.select("digest", "rep").join(components, "rep", "left").select("digest", F.coalesce("root", "rep").alias("c"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(of_class.hint("merge"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group of near copies, with the columns of docs.

    Rows that repeat a doc_id are documents of their own here, told apart by their texts: no text
    leaves because of another one under its id, and equal rows stay or go together. Null, empty and blank
    texts, and rows without a doc_id, stay. Columns of any name are passed on; an empty table gives no rows.
    """
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        gone = near_duplicates(docs, shingle, num, den).where("NOT kept").select(F.col("doc_id").alias("dropped_id"))
        return docs.join(gone, docs["doc_id"] == gone["dropped_id"], "left_anti").select(docs.columns)
    copy = F.sha2(text_or_empty("text"), 256)
    rows = docs.select(F.col("doc_id").alias("dropped_id"), copy.alias("dropped_copy")).where("dropped_id IS NOT NULL").distinct()
    named = written(rows.orderBy("dropped_id", "dropped_copy").withColumn("doc_id", F.monotonically_increasing_id()), "named")  # ascending as the ids are
    texts = docs.select(docs["doc_id"].alias("dropped_id"), copy.alias("dropped_copy"), "text").distinct().join(named, ["dropped_id", "dropped_copy"])
    gone = named.join(near_duplicates(texts.select("doc_id", "text"), shingle, num, den).where("NOT kept"), "doc_id", "left_semi").drop("doc_id")
    return docs.join(gone, (docs["doc_id"] == gone["dropped_id"]) & (copy == gone["dropped_copy"]), "left_anti").select(docs.columns)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=3, num=85)

"""N-gram Jaccard join of documents, size-aware: subsets of small sets, inverted lists for large ones.

1. A text's set of word shingles (64-bit hashes) names its class; equal sets are one class, represented by its smallest document.
2. Order of all shingles: those of a fixed share (by hash), rarest first, then the others by hash. Two sets that are linked
   share one of their first n - ceil(threshold * n) + 1 shingles in any one order, so only these get
   inverted lists, and only the share's shingles need counts. Rare ones come first, so a set that is mostly its own is in no list of two.
3. Small sets: every subset of c shingles is a key, for each overlap c that a link of two small sets can need. Two small sets are linked
   when they meet under a key whose c their sizes ask for; the smallest set of a key stands for all of those.
4. Large sets scan the lists, against sets of all sizes. Within a list of up to BLOCK sets, pairs go on
   whose places leave enough to share. In a longer one no pairs are formed: the sets that could be linked with another one of
   their own size become one family, and others join it that leave enough for one of these in a band of sizes.
5. The boundary is the size up to which keys cost less than scanning: both are counted by size, over all sets.
6. What lists and keys connect are families; links are confirmed on the full sets within each, as blocks.

Nothing depends on a list or family fitting one task: counts are summed before they are shuffled, joins on shingles can be split, and lists return
spanning forests, not pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.minhash import BLOCK, SEGMENT, WordHashes, _groups, _linked, _links_of_large, _spanning, mix, shingles
from voxloom.llm.shared import connected_components, documents, text_or_empty, written

#: SHARE of 16 shingles, by hash, are counted and come first in the order.
SHARE = 5
#: Sets up to this size may be small; the boundary itself is chosen by cost.
SMALL = 20
#: What a key of a small set costs (it is shuffled and joined), in list entries met (which are compared in arrays).
KEY_COST = 20
#: Long lists are looked up by bands of sizes, each so many times as wide as the one before.
BAND = 1.03
#: Classes that a task remembers, to send the shingles of repeated ones once.
SEEN = 200_000
#: Ids of documents in families that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def overlap(s: int, t: int, num: int, den: int) -> int:
    """The least number of common shingles with which sets of s and t are linked: den * both >= num * (s + t - both)."""
    return -(-num * (s + t) // (den + num))


def subset_sizes(s: int, num: int, den: int, most: int) -> list[int]:
    """The overlaps that a set of s can need with any set of up to `most` shingles that it can be linked with."""
    return sorted({overlap(s, t, num, den) for t in range(1, most + 1) if overlap(s, t, num, den) <= min(s, t)})


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def prefix_tokens(x: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """The shingles of a set x that its prefix can hold, and how many of them are of the counted share: all of the share, and the first others where these are too few."""
    own = x % np.uint64(16) < SHARE
    first = x[own]
    missing = prefix_length(len(x), num, den) - len(first)
    return (first if missing <= 0 else np.concatenate([first, x[~own][:missing]])), len(first)


SETS = "doc_id long, n long, digest binary, cls long, u long, tokens binary, whole binary"


def _sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Each row's set: size, digest, class (64 bits), prefix tokens (null where the task has sent those of its class), and all of a small one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                out: list[list] = [[] for _ in range(6)]
                for text in part.column(1).to_pylist():
                    x = shingles(text, k, hashes)
                    digest = xxhash.xxh3_128_digest(x.tobytes())
                    cls = int.from_bytes(digest[:8], "little", signed=True)
                    tokens = whole = None
                    u = 0
                    if len(x):
                        new = cls not in seen
                        chosen, u = prefix_tokens(x, num, den)
                        if new:
                            tokens = chosen.tobytes()
                            whole = x.tobytes() if len(x) <= SMALL else None
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(cls)
                    for column, v in zip(out, (len(x), digest, cls, u, tokens, whole), strict=True):
                        column.append(v)
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, out, kinds)], names=[c.split()[0] for c in SETS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(run, SETS)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, tokens) -> a row (s, cls) for each token."""
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            cls, packed = batch.column(0).slice(i, 500).to_numpy(), batch.column(1).slice(i, 500).to_pylist()
            sizes = [len(x) // 8 for x in packed]
            yield pa.RecordBatch.from_pydict({"s": np.frombuffer(b"".join(packed), np.int64), "cls": np.repeat(cls, sizes)})


def _subsets(num: int, den: int, most: int) -> Callable:
    """(rep, n, whole) -> a row (c, key, rep, n) for each subset of each needed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, n, packed = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for i in range(batch.num_rows):
                x = mix(np.frombuffer(packed[i], np.uint64))
                for c in subset_sizes(int(n[i]), num, den, most):
                    at = np.array(list(itertools.combinations(range(len(x)), c)), np.int64)
                    key = mix(x[at].sum(axis=1, dtype=np.uint64))
                    m = len(key)
                    yield pa.RecordBatch.from_pydict({"c": np.full(m, c, np.int32), "key": key.astype(np.int64), "rep": np.full(m, rep[i]), "n": np.full(m, n[i])})

    return run


def _scan(num: int, den: int, boundary: int) -> Callable:
    """(s, rep, n, place), sorted by s -> a forest of each list's pairs that their places leave enough to share; pairs of small sets are left to their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 1, SEGMENT):
            s, ids, n, place = (table.column(i).to_numpy() for i in range(4))
            new = np.r_[True, s[1:] != s[:-1]]
            group = np.cumsum(new)
            left = np.bincount(group)[group] - (np.arange(len(group)) - np.flatnonzero(new)[group - 1])  # rows from here to the group's end
            rest = n - place
            a, b = [], []
            for d in range(1, int(left.max(initial=0))):
                x = np.flatnonzero(left > d)
                common = np.minimum(rest[x], rest[x + d])
                x = x[(den * common >= num * (n[x] + n[x + d] - common)) & (np.maximum(n[x], n[x + d]) > boundary)]
                a.append(x)
                b.append(x + d)
            if a:
                yield _spanning(ids, np.concatenate(a), np.concatenate(b))

    return run


def _long_lists(hits: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) that connect all pairs of a list (s, rep, n, place) whose places leave enough to share, and some more.

    A set can be linked with sets of up to `reach` shingles. Of a pair, the smaller set reaches more than its own
    size; such sets of a list are joined to the least of them. A set that doesn't reach its own size can
    only be linked with a smaller one of these: it is joined to them where a band of their sizes has one within its reach, and one that reaches it.
    """
    reach = F.floor((F.col("n") - F.col("place")) * (den + num) / num) - F.col("n")
    band = lambda n: F.floor(F.log(n.cast("double")) / math.log(BAND)).cast("int")
    at = hits.withColumn("reach", reach)
    inner = at.where("reach >= n")
    least = inner.groupBy("s").agg(F.min("rep").alias("least"))
    star = inner.join(least.hint("merge"), "s").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    bands = inner.groupBy("s", band(F.col("n")).alias("band")).agg(F.min("n").alias("smallest"), F.max("reach").alias("farthest"), F.min("rep").alias("least"))
    first = F.ceil(F.col("n") * num / den)
    outer = at.where((F.col("reach") < F.col("n")) & (F.col("reach") >= first)).withColumn("band", F.explode(F.sequence(band(first), band(F.col("reach")))))
    met = outer.join(bands.hint("merge"), ["s", "band"]).where("smallest <= reach AND farthest >= n")
    return star.union(met.select("rep", "least").distinct())


def chosen_boundary(keys: dict[int, int], scans: dict[int, int]) -> int:
    """The size up to which sets are small: the least total of keys of small sets and list entries met by large ones."""
    total = {x: KEY_COST * sum(v for s, v in keys.items() if s <= x) + sum(v for s, v in scans.items() if s > x) for x in range(SMALL + 1)}
    return min(total, key=lambda x: (total[x], x))


def candidates(sets: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) between class representatives; every link of two different sets is among the pairs that they connect."""
    tokens = sets.where("tokens IS NOT NULL AND doc_id IS NOT NULL").select("cls", "tokens").mapInArrow(_unpacked, "s long, cls long")
    df = tokens.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(df.hint("merge"), "s")
    counted = F.pmod("s", F.lit(16)) < SHARE  # of the 64 bits, as their sign makes no difference to a power of two
    # by class: its shared shingles in the order of all, unsigned; a set, as copies send theirs several times
    unsigned = F.col("s").bitwiseXOR(F.lit(-(2**63)))
    lists = shared.groupBy("cls").agg(F.sort_array(F.collect_set(F.struct((~counted).alias("late"), F.when(counted, F.col("df")).otherwise(0).alias("df"), unsigned.alias("s")))).alias("l"))
    heads = classes.select("cls", "rep", "n", "u")
    known = lists.join(heads.hint("merge"), "cls")
    own = F.col("u") - F.size(F.filter("l", lambda x: ~x["late"]))  # shingles of the share that no other set has come first
    placed = known.select("rep", "n", own.alias("own"), F.posexplode("l").alias("o", "x")).select("rep", "n", F.col("x.s").alias("s"), (F.col("own") + F.col("o")).alias("place"))
    postings = written(placed.where(f"place <= n - ceil(n * {num} / {den})"), "postings")
    sizes = postings.groupBy("s").agg(F.count("*").alias("m")).where("m > 1")
    hits = written(postings.join(sizes.hint("merge"), "s"), "hits")
    scans = {r.n: r.v for r in hits.where(F.col("n") <= SMALL).groupBy("n").agg(F.sum("m").alias("v")).collect()}  # SMALL rows at most
    sets_of = {r.n: r.v for r in classes.where(F.col("n") <= SMALL).groupBy("n").agg(F.count("*").alias("v")).collect()}
    boundary = chosen_boundary({n: v * sum(math.comb(n, c) for c in subset_sizes(n, num, den, SMALL)) for n, v in sets_of.items()}, scans)
    short = hits.where(F.col("m") <= BLOCK).select("s", "rep", "n", "place").repartition("s").sortWithinPartitions("s")
    edges = short.mapInArrow(_scan(num, den, boundary), "a long, b long").union(_long_lists(hits.where(F.col("m") > BLOCK), num, den))
    if boundary:
        small = sets.where((F.col("n") <= boundary) & F.col("whole").isNotNull() & F.col("doc_id").isNotNull()).select("cls", "n", "whole").distinct()
        named = small.join(heads.select("cls", "rep").hint("merge"), "cls").select("rep", "n", "whole")
        keyed = written(named.mapInArrow(_subsets(num, den, boundary), "c int, key long, rep long, n long"), "subsets")
        met = keyed.groupBy("c", "key").agg(F.min(F.struct("n", "rep")).alias("first"), F.count("*").alias("m")).where("m > 1")
        linked = keyed.join(met.hint("merge"), ["c", "key"]).where("rep <> first.rep").where(f"{den + num} * c >= {num} * (n + first.n)")
        edges = edges.union(linked.select("rep", "first.rep"))
    return written(edges, "edges")


def _of_families(docs: DataFrame, families: DataFrame) -> DataFrame:
    """root, node, n and text of the documents in families; their ids go to the texts if there are few of them, else both are shuffled."""
    sizes = written(families.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    families = written(families.join(sizes.hint("merge"), "root"), "families")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), text_or_empty("text").alias("text")).where("node IS NOT NULL")
    few = families.count() <= BROADCAST_IDS
    return written(texts.join(F.broadcast(families) if few else families.hint("merge"), "node").select("root", "node", "n", "text"), "members")


def jaccard_join(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs(doc_id, text).

    Words are runs without ASCII white space, with A-Z lower-cased. Documents are linked when
    den * |A and B| >= num * |A or B| on their sets of `shingle`-word shingles; a text of fewer words has all of
    them as its one shingle; a null, empty or blank text has none and is linked with nothing. component_id
    is the smallest doc_id that links reach. Rows that repeat a doc_id are one document with the links of each; a null
    doc_id links with nothing and has no component_id. Other columns are ignored; an empty table gives no rows.
    """
    sets = written(_sets(docs, shingle, num, den), "sets")
    named = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("cls").alias("cls"), F.first("n").alias("n"), F.first("u").alias("u")), "classes")
    families = connected_components(candidates(sets, classes, num, den))
    members = _of_families(docs, families)
    small = members.where(F.col("n") <= BLOCK).select("root", F.lit(0).alias("bi"), F.lit(0).alias("bj"), "node", "text").repartition("root").sortWithinPartitions("root")
    linked = written(small.mapInArrow(_linked(shingle, num, den), "a long, b long"), "links")
    large = members.where(F.col("n") > BLOCK)
    if not large.isEmpty():
        linked = linked.union(_links_of_large(large, shingle, num, den))
    # ids with several texts have the links of each
    twice = written(named.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id"), "twice")
    if not twice.isEmpty():
        several = named.join(twice.hint("merge"), "doc_id").join(classes.select("digest", "rep").hint("merge"), "digest").where("doc_id <> rep")
        linked = linked.union(several.select("doc_id", "rep"))
    components = connected_components(linked).select(F.col("node").alias("rep"), "root")
    of_class = classes.join(components.hint("merge"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("c"))
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    out = rows.join(of_class.hint("merge"), "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir), shingle=5, num=80)


def components_sql(k: int, num: int) -> str:
    """doc_id, n and the component's smallest doc_id, by all pairs that share a shingle and the closure of their links."""
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    t AS (SELECT doc_id, len(w) AS words, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w),
    k AS (SELECT doc_id, words, i, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS s FROM t),
    d AS MATERIALIZED (SELECT DISTINCT doc_id, hash(s) AS s FROM k WHERE i <= greatest(words - {k - 1}, 1)),
    g AS MATERIALIZED (SELECT w.doc_id, coalesce(n, 0) AS n FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM d GROUP BY 1) USING (doc_id)),
    e AS MATERIALIZED (SELECT doc_id, n, s FROM d JOIN g USING (doc_id)),
    p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100*count(*) >= {num}*(a.n + b.n - count(*))),
    r AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
    SELECT doc_id, n::BIGINT AS n_shingles, component_id FROM g JOIN c USING (doc_id)"""


SQL = {
    "op13_ngram_join": components_sql(5, 80),
}

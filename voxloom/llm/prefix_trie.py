"""The trie of conversations' prefixes, by distributed most-significant-digit radix partitioning.

1. Turns (role, text) become digests, and their dictionary gives each a number. Turns are numbered
   within their conversation from ranges of its order, so a very long one isn't held by one task.
2. Conversations with one and the same sequence of turns become one class before anything is partitioned.
3. Radix passes: the classes of a large bucket (a node with more than LOCAL turns below it) are told apart by their next
   turns, 1, 2, 4, 8... at a pass, so a shared prefix of D turns takes log D passes. A pass emits all nodes on its
   way, summed before their shuffle. Buckets of one class are paths and need no sorting;
   those of up to LOCAL turns are finished in a task by multikey quicksort, which emits
   the nodes as it recurses (on a stack of its own).
4. A node is named by its smallest member, so the nodes of one name form a chain, and chains hang from
   chains. Sums over subtrees are sums of chains by pointer doubling, then running sums from each chain's end.

Lists of members are hashed in pieces, in order; no list is held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.shared import written
from voxloom.operators.order import running

#: Turns below a node that one task sorts at once.
LOCAL = 400
#: Members hashed as one piece.
PIECE = 1024
WORD = r"[^\x20\x09-\x0D]+"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, words long, end_class long"


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), turn_id and words of every row of conversations(conv_id, turn, role, text).

    Turns go by `turn`, null first; rows of one turn by a digest of role and text, equal ones one after the other.
    A null role or text is empty. Rows without a conv_id belong to no conversation and are left out.
    Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = written(conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")), "turns")
    dictionary = written(rows.groupBy("digest").agg(F.max("words").alias("words")).withColumn("turn_id", F.monotonically_increasing_id()), "dictionary")
    same = rows.groupBy("conv_id", "turn", "digest").agg(F.count("*").alias("times"))
    placed = running(same, ["conv_id"], ["turn", "digest"], "times", names=["first"])
    coded = placed.join(dictionary.hint("merge"), "digest")
    return written(coded.select("conv_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("times") - 1)).alias("pos"), "turn_id", "words"), "numbered")


def with_heads(turns: DataFrame, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as another one: (sequences, all conv_ids).

    Conversation c gets the first h turns of c - c % every (all if it has fewer, none if it is not there), h = crc32(c) % 4, then its own after its first h.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("long")
    convs = written(turns.groupBy("conv_id").agg(F.count("*").alias("own")).select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base")), "conversations")
    base = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = written(convs.join(base.hint("merge"), "base", "left").select("conv_id", "h", "base", F.least("h", F.coalesce("there", F.lit(0))).alias("head")), "conversations")
    first = turns.where("pos < 3").select(F.col("conv_id").alias("base"), "pos", "turn_id", "words")
    heads = convs.where("head > 0").join(first.hint("merge"), "base").where("pos < h").select("conv_id", "pos", "turn_id", "words")
    own = turns.where(F.col("pos") >= h).join(convs.hint("merge"), "conv_id")
    tails = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "turn_id", "words")
    return written(heads.union(tails), "sequences"), convs.select("conv_id")


def classes_of(seq: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, n, len) of each distinct sequence of turns, c its smallest conversation, and (conv_id, c) of every one of convs.

    Sequences are the same when two 64-bit hashes over their numbered turns are.
    """
    whole = seq.groupBy("conv_id").agg(F.count("*").alias("len"), F.bit_xor(F.xxhash64("pos", "turn_id")).alias("a"), F.bit_xor(F.xxhash64("turn_id", F.lit("b"), "pos")).alias("b"))
    known = convs.join(whole.hint("merge"), "conv_id", "left").select("conv_id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("len", "a", "b")])
    known = written(known, "wholes")
    classes = written(known.groupBy("len", "a", "b").agg(F.min("conv_id").alias("c"), F.count("*").alias("n")), "classes")
    return classes.select("c", "n", "len"), known.join(classes.hint("merge"), ["len", "a", "b"]).select("conv_id", "c")


STEPS = "label binary, parent binary, depth long, c long, n long, left long, words long"


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, depth, c, n, len, turns of the pass) -> a row for each of these turns; a node's label is the hash of its parent's and of its turn."""
    names = ["label", "parent", "depth", "c", "n", "left", "words"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for label, depth, c, n, size, turns in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            for t in sorted(turns, key=lambda t: t["pos"]):
                label, parent = hashlib.md5(label + t["turn_id"].to_bytes(8, "little")).digest(), label
                depth += 1
                for column, v in zip(out, (label, parent, depth, c, n, size - depth, t["words"]), strict=True):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if i < 2 else pa.int64()) for i, x in enumerate(out)], names=names)


def quicksorted(seqs: list[tuple[int, int, list[int], list[int]]], depth: int, top: int) -> Iterator[tuple]:
    """The nodes below a node at `depth` named `top`: seqs are distinct, each (c, n, turn ids and words after the node).

    Multikey quicksort: those with the pivot's turn are one node and go on with the next turn, the others with this one.
    """
    seqs = [s for s in seqs if s[2]]
    stack = [(seqs, 0, top)] if seqs else []
    while stack:
        rows, k, parent = stack.pop()
        if len(rows) == 1:  # the rest of one sequence
            c, n, ids, words = rows[0]
            for i in range(k, len(ids)):
                yield c, depth + i + 1, parent, n, words[i], c if i + 1 == len(ids) else None
                parent = c
            continue
        pivot = sorted(r[2][k] for r in (rows[0], rows[len(rows) // 2], rows[-1]))[1]
        less, same, more = [], [], []
        for r in rows:
            x = r[2][k]
            (less if x < pivot else more if x > pivot else same).append(r)
        name = min(r[0] for r in same)
        yield name, depth + k + 1, parent, sum(r[1] for r in same), same[0][3][k], next((r[0] for r in same if len(r[2]) == k + 1), None)
        for part, at, above in ((less, k, parent), (more, k, parent), ([r for r in same if len(r[2]) > k + 1], k + 1, name)):
            if part:
                stack.append((part, at, above))


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, depth, top, c, n, turn_id, words), sorted by label, c and place -> the nodes of one bucket after the other."""
    names = [x.split()[0] for x in NODES.split(", ")]
    label, depth, top = None, 0, 0
    seqs: list[tuple[int, int, list[int], list[int]]] = []
    out: list[tuple] = []

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=names)

    for batch in batches:
        for l, d, t, c, n, turn_id, words in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if l != label:
                out += quicksorted(seqs, depth, top)
                label, depth, top, seqs = l, d, t, []
            if not seqs or seqs[-1][0] != c:
                seqs.append((c, n, [], []))
            seqs[-1][2].append(turn_id)
            seqs[-1][3].append(words)
        if out:
            yield batch_of(out)
            out = []
    out += quicksorted(seqs, depth, top)
    if out:
        yield batch_of(out)


def nodes_of(seq: DataFrame, classes: DataFrame, local: int = LOCAL) -> DataFrame:
    """conv_id (the smallest member), depth, parent_conv_id, n_convs, words of the last turn, and the class that ends there, of every node."""
    spark = seq.sparkSession
    own = written(seq.join(classes.select(F.col("c").alias("conv_id")).hint("merge"), "conv_id", "left_semi").withColumnRenamed("conv_id", "c"), "class-turns")
    root = classes.groupBy().agg(F.min("c").alias("conv_id"), F.sum("n").alias("n_convs"), F.max(F.when(F.col("len") == 0, F.col("c"))).alias("end_class")).where("conv_id IS NOT NULL")
    found = [root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("words"), "end_class")]
    large = classes.select("c", "n", "len", F.lit(b"").alias("label"))
    tops = root.select(F.lit(b"").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    depth, width = 0, 1
    alone, small = [], []
    while not large.isEmpty():
        digits = own.where((F.col("pos") >= depth) & (F.col("pos") < depth + width)).join(large.hint("merge"), "c")
        each = digits.groupBy("c", "n", "len", "label").agg(F.collect_list(F.struct("pos", "turn_id", "words")).alias("turns"))
        steps = written(each.select("label", F.lit(depth).cast("long").alias("depth"), "c", "n", "len", "turns").mapInArrow(_steps, STEPS), "steps")
        sums = [F.min("c").alias("top"), F.sum("n").alias("n_convs"), F.max("words").alias("words"), F.max(F.when(F.col("left") == 0, F.col("c"))).alias("end_class"), F.count("*").alias("m"), F.sum("left").alias("below")]
        met = written(steps.groupBy("label", "parent", "depth").agg(*sums), "nodes")
        above = met.select(F.col("label").alias("parent"), F.col("top").alias("parent_conv_id")).union(tops)
        named = met.join(above.hint("merge"), "parent").select(F.col("top").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "words", "end_class")
        found.append(written(named, "named"))  # a join of its own, so that a parent with very many children can be split
        depth, width = depth + width, 2 * width
        last = met.where((F.col("depth") == depth) & (F.col("below") > 0))
        at = written(steps.where((F.col("depth") == depth) & (F.col("left") > 0)).select("label", "c", "n", "left").join(last.select("label", "top", "m", "below").hint("merge"), "label"), "buckets")
        alone.append(at.where("m = 1").select("c", "n", F.lit(depth).alias("from")))
        small.append(at.where((F.col("m") > 1) & (F.col("below") <= local)).select("label", F.lit(depth).cast("long").alias("depth"), "top", "c", "n"))
        large = at.where((F.col("m") > 1) & (F.col("below") > local)).select("c", "n", (F.col("left") + depth).alias("len"), "label")
        tops = last.where((F.col("m") > 1) & (F.col("below") > local)).select(F.col("label").alias("parent"), F.col("top").alias("parent_conv_id"))
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    if not alone:
        return written(found[0], "all-nodes") if found else spark.createDataFrame([], NODES)
    paths = own.join(union(alone).hint("merge"), "c").where(F.col("pos") >= F.col("from"))
    ends = classes.select("c", "len")
    found.append(paths.join(ends.hint("merge"), "c").select(F.col("c").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.col("c").alias("parent_conv_id"), F.col("n").alias("n_convs"), "words", F.when(F.col("pos") + 1 == F.col("len"), F.col("c")).alias("end_class")))
    buckets = own.join(union(small).hint("merge"), "c").where(F.col("pos") >= F.col("depth")).repartition("label").sortWithinPartitions("label", "c", "pos")
    found.append(buckets.select("label", "depth", "top", "c", "n", "turn_id", "words").mapInArrow(_local, NODES))
    return written(union(found), "all-nodes")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, piece, text), sorted by both -> c and the SHA-256 of its pieces, comma-joined."""
    c, state = None, None
    for batch in batches:
        out = []
        for key, _, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if key != c:
                if state:
                    out.append((c, state.hexdigest()))
                c, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        if out:
            yield pa.RecordBatch.from_pydict({"end_class": [x[0] for x in out], "ends_sha256": [x[1] for x in out]})
    if state:
        yield pa.RecordBatch.from_pydict({"end_class": [c], "ends_sha256": [state.hexdigest()]})


def ends_of(members: DataFrame) -> DataFrame:
    """end_class and the SHA-256 of its members' ids, ascending and comma-joined; pieces of PIECE members are joined before they meet."""
    placed = running(members.withColumn("one", F.lit(1)), ["c"], ["conv_id"], "one", names=["at"])
    pieces = placed.groupBy("c", F.floor(F.col("at") / PIECE).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("text"))
    return pieces.repartition("c").sortWithinPartitions("c", "piece").mapInArrow(_hashed, "end_class long, ends_sha256 string")


def _below(full: DataFrame) -> DataFrame:
    """conv_id, depth, n_leaves and saved_tokens summed over each node's subtree, from the nodes' own leaf and saved."""
    chains = full.groupBy("conv_id").agg(F.min("depth").alias("start"), F.min_by("parent_conv_id", "depth").alias("up"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    chains = written(chains, "chains")
    state = chains.select("conv_id", F.col("up").alias("jump"), "leaves", "saved")
    while not state.where("jump IS NOT NULL").isEmpty():  # twice as far each time
        given = state.where("jump IS NOT NULL").groupBy(F.col("jump").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        further = state.select(F.col("conv_id").alias("jump"), F.col("jump").alias("next"))
        out = state.join(given.hint("merge"), "conv_id", "left").join(further.hint("merge"), "jump", "left")
        state = written(out.select("conv_id", F.col("next").alias("jump"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "chain-sums")
    hung = chains.where("up IS NOT NULL").select("conv_id", "up", "start").join(state.select("conv_id", "leaves", "saved").hint("merge"), "conv_id")
    hung = hung.groupBy(F.col("up").alias("conv_id"), (F.col("start") - 1).alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    with_hung = full.join(hung.hint("merge"), ["conv_id", "depth"], "left").select("conv_id", "depth", (-F.col("depth")).alias("up"), (F.col("leaf") + F.coalesce("l", F.lit(0))).alias("leaf"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
    summed = running(with_hung, ["conv_id"], ["up"], "leaf", "saved", names=["l", "s"])
    return summed.select("conv_id", "depth", (F.col("l") + F.col("leaf")).alias("n_leaves"), (F.col("s") + F.col("saved")).alias("saved_tokens"))


def prefix_trie(seq: DataFrame, convs: DataFrame, local: int = LOCAL) -> DataFrame:
    """A row for each node of the trie of seq(conv_id, pos from 0, turn_id, words), of the conversations in convs(conv_id).

    conv_id: the smallest conversation that begins with the node's turns, of which turn number `depth` is the node's last one; depth; parent_conv_id (null for the
    root); n_convs; n_children; n_leaves (childless nodes of its subtree, itself included); saved_tokens (over its subtree, (n_convs - 1) * words);
    ends_sha256 of the conversations that end there. Conversations without turns end at the root. Without conversations there are no rows.
    """
    classes, members = classes_of(seq, convs)
    nodes = nodes_of(seq, classes, local)
    kids = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    full = nodes.join(kids.hint("merge"), ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    full = written(full.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}), "nodes")
    out = full.join(_below(full).hint("merge"), ["conv_id", "depth"]).join(written(ends_of(members), "ends").hint("merge"), "end_class", "left")
    ends = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*with_heads(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


_CRC = "xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

SQL = {
    "op12_prefix_trie": rf"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    v AS (SELECT conv_id, {_CRC} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM t)),
    r AS (SELECT v.conv_id, pos, role, text, 0 AS part FROM v JOIN t ON t.conv_id = base AND pos < h UNION ALL SELECT t.conv_id, pos, role, text, 1 FROM t JOIN v USING (conv_id) WHERE pos >= h),
    s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, md5(role || chr(1) || text) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r),
    p AS (SELECT conv_id, d, words, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM v),
    n AS (SELECT d, key, min(conv_id) AS c, count(*) AS n_convs, max(words) AS words FROM p GROUP BY d, key),
    k AS (SELECT left(key, 32*(d - 1)) AS key, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
    f AS (SELECT n.*, coalesce(kids, 0) AS kids, (n_convs - 1)*words AS saved FROM n LEFT JOIN k USING (key)),
    b AS (SELECT p.key, count(*) FILTER (kids = 0) AS n_leaves, sum(saved) AS saved FROM f JOIN p ON p.conv_id = f.c AND p.d <= f.d GROUP BY 1),
    e AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM (SELECT conv_id, max_by(key, d) AS key FROM p GROUP BY 1) GROUP BY 1)
    SELECT f.c AS conv_id, f.d AS depth, u.c AS parent_conv_id, f.n_convs, f.kids AS n_children, n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
    FROM f JOIN b USING (key) LEFT JOIN e USING (key) LEFT JOIN n u ON f.d > 0 AND u.key = left(f.key, 32*(f.d - 1))""",
}

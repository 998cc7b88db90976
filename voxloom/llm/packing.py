"""Conflict-constrained best-fit packing of documents' token ids into sequences of CAPACITY ids.

Documents longer than a bin are cut into full pieces and a rest. Pieces are dealt by a
hash of their document into shards of about SHARD pieces, as many as the table asks for,
so that no shard and no task grows with the table. Rows that are equal in all that is packed are numbered
where they are read, and the number is part of the hash, so that no shard holds many of them; a partition
holds a few shards, sorted, and a task holds one of them at a time. Within a shard the pieces come in
descending size. Open bins are ordered by residual; each carries a bitmap of its sources
and one of its duplicate clusters. The search starts at the least residual that takes the
piece and goes on to the next until a bin has neither the piece's source nor its cluster:
the tightest compatible bin of the shard. If there is none, a new bin opens. A packed bin is its
pieces' ids one after another, so pieces carry their ids through the one shuffle.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.shared import documents, normalised, text_or_empty
from voxloom.llm.token_planes import END_ID, together, words_of

CAPACITY = 2048
SHARD = 4096
#: Up to so many partitions have one shard each; more shards share partitions, at most so many each.
PARTITIONS, SHARDS_EACH = 64, 16
#: First copies of equal rows are dealt together by so many partitions of the input, all others one by one.
TOGETHER = 1024
PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("position", pa.int64())])


class Bins:
    """Open bins by residual. A set bit of `filled` marks a residual that some open bin has."""

    def __init__(self, capacity: int):
        self.capacity, self.filled, self.count = capacity, 0, 0
        self.by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.used: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin for a piece; source and cluster are bitmaps with one bit, or 0 for what never conflicts."""
        ahead = self.filled >> size << size
        while ahead:
            low = ahead & -ahead
            residual = low.bit_length() - 1
            for at, b in enumerate(self.by_residual[residual]):
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    row = self.by_residual[residual]
                    row[at] = row[-1]
                    row.pop()
                    if not row:
                        self.filled ^= low
                    return self._put(b, residual - size, size, source, cluster)
            ahead ^= low
        self.sources.append(0)
        self.clusters.append(0)
        self.used.append(0)
        self.count += 1
        return self._put(self.count - 1, self.capacity - size, size, source, cluster)

    def _put(self, b: int, residual: int, size: int, source: int, cluster: int) -> int:
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self.used[b] += size
        if residual:
            self.by_residual[residual].append(b)
            self.filled |= 1 << residual
        return b


def _bit(values: pd.Series) -> list[int]:
    """A bit for each value that comes more than once; what comes once or is null can't conflict."""
    counts = values.value_counts()
    bits = {v: 1 << i for i, v in enumerate(counts.index[counts > 1])}
    return [bits.get(v, 0) for v in values]


def pack_shard(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """pieces(doc_id, piece, n_tokens, source, cluster, ...) with bin, position and bin_tokens."""
    p = pieces.sort_values(["n_tokens", "doc_id", "piece", "cluster", "source"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
    bins = Bins(capacity)
    at = [bins.place(n, s, c) for n, s, c in zip(p.n_tokens.tolist(), _bit(p.source), _bit(p.cluster), strict=True)]
    p["bin"] = at
    p["position"] = p.groupby("bin").n_tokens.cumsum() - p.n_tokens
    p["bin_tokens"] = [bins.used[b] for b in at]
    return p


def shortened(ids: bytes) -> bytes:
    """Little-endian ids of 32 bits in 16 bits each, if all of them fit."""
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() if wide.max(initial=0) < 1 << 16 else ids


def widened(ids: bytes, n: int) -> bytes:
    """What was shortened, by the number of ids, in 32 bits each."""
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if len(ids) == 2 * n else ids


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None) -> DataFrame:
    """doc_id, source, cluster, piece, start, n_tokens, ids and deal of each piece of docs(doc_id, source, cluster, text).

    A piece's ids have 16 bits each where all of them fit, else 32, as its length tells. deal tells equal rows apart: it goes by the input's partition and the row's number among the equal ones of it. Equal rows
    are interchangeable, so a task that runs again gives the same pieces, in whatever order it reads its rows. Null and empty texts
    give their end id alone, or no piece without one; an empty table gives no pieces; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = b"" if end_id is None else struct.pack("<I", end_id)
        place, copies = TaskContext.get().partitionId(), Counter()  # of the rows of one partition of the input
        for batch in batches:
            words = words_of(tokenizer)
            for i, n_rows in together(batch.column(3)):
                part = batch.slice(i, n_rows)
                ids = [x + tail for x in words.encode(part.column(3))]
                row, piece, cut, deal = [], [], [], []
                for r, (x, *key) in enumerate(zip(ids, *(part.column(c).to_pylist() for c in range(3)), strict=True)):
                    k = hashlib.blake2b(x, digest_size=8, key=repr(key).encode()[:64]).digest()
                    n = copies[k]
                    copies[k] = n + 1
                    own = (place << 32) + n if n else place // TOGETHER
                    for k in range(-(-len(x) // (4 * capacity))):
                        row.append(r)
                        deal.append(own)
                        piece.append(k)
                        cut.append(x[4 * k * capacity : 4 * (k + 1) * capacity])
                n_tokens = [len(x) // 4 for x in cut]
                head = part.select([0, 1, 2]).take(pa.array(row, pa.int32()))
                yield pa.RecordBatch.from_arrays([*head.columns, pa.array(piece, pa.int32()), pa.array([k * capacity for k in piece], pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(map(shortened, cut), pa.binary()), pa.array(deal, pa.int64())], names=["doc_id", "source", "cluster", "piece", "start", "n_tokens", "ids", "deal"])

    return docs.select("doc_id", "source", "cluster", "text").mapInArrow(run, "doc_id long, source string, cluster long, piece int, start long, n_tokens long, ids binary, deal long")


def best_fit(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, shard: int = SHARD, cluster: Column | None = None, end_id: int | None = END_ID) -> DataFrame:
    """bin_id, bin_tokens, ids and pieces of each packed sequence.

    docs has doc_id, text and source; its tokens are those of the tokenizers file `tokenizer`, which executors have, and end_id
    after each document. ids are little-endian unsigned 32-bit integers; pieces are (doc_id, piece, start,
    n_tokens, position), in the order in which the ids come: start counts in the document, position in the sequence. cluster
    tells duplicates apart, by default the text with white space normalised. No bin holds two
    pieces of one source, or of one cluster, but for null sources, which never conflict.
    Null and empty texts are their end id alone (and none without one), and a cluster of their own. Rows that repeat a
    doc_id are documents of their own. A null doc_id is packed like any other. Columns
    named like the added ones are ignored; an empty table gives no rows.
    """
    text = text_or_empty("text")
    # an estimate of the pieces, by four bytes an id; texts of more ids make fuller shards
    n = docs.agg(F.sum(F.ceil((F.octet_length(text) + 4) / (4 * capacity)))).first()[0] or 0
    shards = max(1, -(-int(n) // shard))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(normalised("text") if cluster is None else cluster).alias("cluster"), text.alias("text"))
    pieces = pieces_of(known, tokenizer, capacity, end_id).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster", "deal"), F.lit(shards)).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one shard
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if held and held[0].column(0)[0].as_py() != shard[i]:
                    yield from packed(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield from packed(pa.Table.from_batches(held))

    def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        p = table.drop_columns(["ids"]).to_pandas().assign(row=range(table.num_rows))
        for _, g in p.groupby("shard", sort=False):
            out = pack_shard(g, capacity).sort_values(["bin", "position"], kind="stable")
            ids = list(map(widened, table.column("ids").take(pa.array(out.row)).to_pylist(), out.n_tokens))
            first = np.flatnonzero(np.r_[True, np.diff(out.bin) > 0])
            ends = [*first[1:], len(out)]
            fields = ["doc_id", "piece", "start", "n_tokens", "position"]
            held = [pa.array(out[c], PIECE.field(c).type, from_pandas=True) for c in fields]
            pieces = pa.ListArray.from_arrays(pa.array([*first, len(out)], pa.int32()), pa.StructArray.from_arrays(held, fields=[PIECE.field(c) for c in fields]))
            for i in range(0, len(first), 256):
                some = slice(i, i + 256)
                yield pa.RecordBatch.from_arrays([pa.array(out.shard.iloc[first[some]] * (1 << 24) + out.bin.iloc[first[some]], pa.int64()), pa.array(out.bin_tokens.iloc[first[some]], pa.int64()), pa.array([b"".join(ids[a:b]) for a, b in zip(first[some], ends[some], strict=True)], pa.binary()), pieces.slice(i, 256)], names=["bin_id", "bin_tokens", "ids", "pieces"])

    dealt = pieces.select("shard", "doc_id", "source", "cluster", "piece", "start", "n_tokens", "ids")
    parts = max(min(shards, PARTITIONS), -(-shards // SHARDS_EACH))
    dealt = dealt.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "bin_id long, bin_tokens long, ids binary, pieces array<struct<doc_id: long, piece: int, start: long, n_tokens: long, position: long>>")


def places(bins: DataFrame) -> DataFrame:
    """doc_id, piece, start, n_tokens, bin_id, position, bin_tokens and ids_crc32, the unsigned crc32 of the piece's ids in its bin's sequence."""
    each = bins.select("bin_id", "bin_tokens", "ids", F.explode("pieces").alias("p"))
    own = F.expr("substring(ids, cast(4 * p.position + 1 as int), cast(4 * p.n_tokens as int))")
    return each.select("p.doc_id", "p.piece", "p.start", "p.n_tokens", "bin_id", "p.position", "bin_tokens", F.crc32(own).alias("ids_crc32"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return places(best_fit(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))

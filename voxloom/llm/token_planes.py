"""Token ids in files of shuffled planes.

A file holds blocks of BLOCK ids. A block is transposed into its four byte planes (or 32
bit planes), each compressed with zstandard, so that the high planes, nearly constant,
shrink to almost nothing. Then come the documents' ids and token counts, and the chunk
index: each block's place, its number of ids and the size of each of its planes. A reader
takes the last 16 bytes, then the index, then only the blocks that it wants.

    magic | blocks | documents | index | u64 place of the index | magic
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.llm.files import reading, writing
from voxloom.llm.shared import documents, new_folder, text_or_empty, written

MAGIC = b"VXPLANE1"
BLOCK = 1 << 17
LEVEL = 3
END_ID = 2
#: Words whose ids a worker remembers; further words go through the tokenizer each time.
REMEMBERED = 600_000


# ---- the file format


def planes_of(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The byte planes (or bit planes) of unsigned 32-bit ids, lowest first."""
    if not bits:
        return [x.tobytes() for x in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]
    return [np.packbits((ids >> np.uint32(k)) & np.uint32(1)).tobytes() for k in range(32)]


def ids_of(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").ravel()
    out = np.zeros(n, np.uint32)
    for k, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return out


class PlaneWriter:
    """Takes documents one by one; holds one block of ids and the documents' counts."""

    def __init__(self, out, bits: bool = False):
        self.out, self.bits, self.at = out, bits, 0
        self.held, self.n_held, self.n_ids = [], 0, 0
        self.doc_ids, self.counts, self.index = [], [], []
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= BLOCK:
            self._blocks(last=False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, end, BLOCK):
            planes = [self.pack(p) for p in planes_of(ids[i : min(i + BLOCK, end)], self.bits)]
            self.index.append([self.at, min(BLOCK, end - i), *map(len, planes)])
            for p in planes:
                self._put(p)
        self.held, self.n_held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._blocks(last=True)
        docs_at = self.at
        named = np.array([x is not None for x in self.doc_ids], np.uint8)
        ids = np.array([0 if x is None else x for x in self.doc_ids], "<i8")
        parts = [self.pack(x.tobytes()) for x in (named, ids, np.array(self.counts, "<i8"))]
        for p in parts:
            self._put(p)
        index_at = self.at
        table = np.array(self.index, "<i8").reshape(len(self.index), -1)
        self._put(struct.pack("<6q", docs_at, *map(len, parts), len(self.index), 32 if self.bits else 4))
        self._put(table.tobytes())
        self._put(struct.pack("<Q", index_at) + MAGIC)


class PlaneReader:
    """Range reads of a file of planes: the documents, and any block by its number."""

    def __init__(self, f):
        self.f, size = f, f.size()
        tail = f.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a file of id planes")
        (index_at,) = struct.unpack("<Q", tail[:8])
        head = f.read_at(size - 16 - index_at, index_at)
        docs_at, a, b, c, blocks, planes = struct.unpack_from("<6q", head)
        self.index = np.frombuffer(head, "<i8", blocks * (planes + 2), 48).reshape(blocks, planes + 2)
        unpack = zstandard.ZstdDecompressor().decompress
        named = np.frombuffer(unpack(f.read_at(a, docs_at)), np.uint8)
        ids = np.frombuffer(unpack(f.read_at(b, docs_at + a)), "<i8")
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, named, strict=True)]
        self.counts = np.frombuffer(unpack(f.read_at(c, docs_at + a + b)), "<i8")
        self.unpack = unpack

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = map(int, self.index[k])
        data, planes, i = self.f.read_at(sum(sizes), at), [], 0
        for size in sizes:
            planes.append(self.unpack(data[i : i + size]))
            i += size
        return ids_of(planes, n)

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, ids before it in this file, its ids and their crc32, with one block in memory."""
        k, block, used, start = 0, np.zeros(0, np.uint32), 0, 0
        for doc_id, n in zip(self.doc_ids, map(int, self.counts), strict=True):
            crc, left = 0, n
            while left:
                if used == len(block):
                    block, used, k = self.block(k), 0, k + 1
                take = min(left, len(block) - used)
                crc = zlib.crc32(block[used : used + take].tobytes(), crc)
                used, left = used + take, left - take
            yield doc_id, start, n, crc
            start += n


# ---- tokenizing

#: Bytes of text that are encoded together, or one text.
AT_ONCE = 1 << 22
#: Letters that are one letter in both cases and in any normal form, then ASCII marks: two pieces, the first of which may be in lower case.
MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)").fullmatch

#: The steps of a tokenizer file under which a text's ids are its white-space words' ids: fixed values of the file format.
WORD_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def goes_by_words(path: str) -> bool:
    """Whether a tokenizer file drops white space and splits as WORD_SPLIT does; of any other file only whole texts are encoded."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = lambda x, key: (x or {}).get(key, [x]) if x else []
    split = steps(spec.get("pre_tokenizer"), "pretokenizers")
    plain = all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in split[1:])
    known = steps(spec.get("normalizer"), "normalizers") == WORD_NORMALIZER and split[:1] == [WORD_SPLIT]
    free = not any(c.isspace() for t in spec.get("added_tokens", []) for c in t["content"]) and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
    apart = not any(MARKED(t["content"]) for t in spec.get("added_tokens", []))
    return known and plain and free and apart and not spec["model"].get("dropout")


def together(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of each stretch of about AT_ONCE bytes."""
    past = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(past)) + 1).tolist(), len(texts)]
    yield from ((a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


class Texts:
    """Any tokenizer file's ids of whole texts, all of them through the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: pa.Array) -> list[bytes]:
        some = (texts[i : i + 200].to_pylist() for i in range(0, len(texts), 200))
        return [np.array(e.ids, "<u4").tobytes() for x in some for e in self.tokenizer.encode_batch_fast(x, add_special_tokens=False)]


class Words:
    """The ids of whole texts by a tokenizer file that goes_by_words, with the ids of words remembered.

    The tokenizer drops white space and never joins characters across it, so a text's ids
    are its words' ids one after another; each new word goes through the tokenizers library.
    Arrow splits texts at ASCII white space and numbers the words of many texts, so that Python sees each of those once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model.get("end_of_word_suffix")
        #: Ids that end a word, where words have ends of their own.
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        if suffix:
            self.ends[[i for w, i in model["vocab"].items() if w.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word. Words of letters alone go through the library many at a time, and are told apart by the ids that end a word."""
        single, found = [w for w in words if not w.isalpha()], {}
        letters = [w for w in words if w.isalpha()]
        groups = [letters[i : i + 500] for i in range(0, len(letters), 500)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = (np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1) * 4
            if len(at) == len(group) and at[-1] == 4 * len(ids):
                raw, ends = ids.tobytes(), at.tolist()
                found.update(zip(group, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
            else:  # some word is more than one, as its lower case has a sign that is no letter
                single += group
        for w, e in zip(single, self.tokenizer.encode_batch_fast(single, add_special_tokens=False), strict=True):
            found[w] = np.array(e.ids, "<u4").tobytes()
        return found

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each of a list of distinct words."""
        known = self.known
        ids = list(map(known.get, words))
        new = [w for w, x in zip(words, ids, strict=True) if x is None]
        if not new:
            return ids
        parts = {w: (m[1].lower(), m[2]) for w in new if not (w.isalpha() and w.islower()) and (m := MARKED(w))}
        plain = {w for w in new if w not in parts}
        plain.update(x for part in parts.values() for x in part if x and x not in known)
        found = self._encode(list(plain))
        found[""] = b""
        for w, (letters, marks) in parts.items():
            found[w] = (found[letters] if letters in found else known[letters]) + (found[marks] if marks in found else known[marks])
        if len(known) < REMEMBERED:
            known.update(found)
        return [found[w] if x is None else x for w, x in zip(words, ids, strict=True)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids = self._ids(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, starts, word = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes, words.indices.to_numpy()
        n = sizes[word]
        ends = np.r_[0, np.cumsum(n)]
        raw = pool[np.arange(ends[-1]) + np.repeat(starts[word] - ends[:-1], n)].tobytes()
        cuts = (4 * ends[split.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=2)
def words_of(path: str) -> Words | Texts:
    """One for all tasks that a worker runs: the words that it knows serve the next task too."""
    return Words(path) if goes_by_words(path) else Texts(path)


def write_planes(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID, bits: bool = False) -> DataFrame:
    """Tokenizes docs(doc_id, text) in ascending doc_id order into files of planes; returns their table (part, path, n_docs, n_ids).

    A null text is empty. A null doc_id comes first. Rows that repeat a doc_id are written
    one after another in the order of their texts. An empty table writes no file. Other
    columns are not written. tokenizer is the path of a tokenizers file that executors have.
    """
    folder = new_folder(docs.sparkSession, "planes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.planes"
        with writing(path) as out:
            tail = b"" if end_id is None else struct.pack("<I", end_id)
            for batch in batches:
                words = words_of(tokenizer)
                writer = writer or PlaneWriter(out, bits)
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for i, n in together(texts):
                    for doc_id, got in zip(ids[i : i + n], words.encode(texts.slice(i, n)), strict=True):
                        writer.add(doc_id, np.frombuffer(got + tail, "<u4"))
            if writer:
                writer.close()
        if writer:
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [len(writer.counts)], "n_ids": [writer.n_ids]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(write, "part long, path string, n_docs long, n_ids long"), "planes-files")


def read_planes(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 from the files in write_planes' table."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = written(files.select("path", before.alias("base")), "planes-placed")  # a row a file

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with reading(path) as f:
                    rows = list(PlaneReader(f).documents())
                for i in range(0, len(rows), 50_000):
                    doc_id, start, n, crc = zip(*rows[i : i + 50_000], strict=True)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_id, pa.int64()), "start": pa.array([base + s for s in start], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return placed.repartition(max(1, placed.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_planes(write_planes(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))

"""Token-id files: fixed-size blocks of ids, transposed into byte or bit planes, each plane under zstandard.

Layout (little-endian): magic `OTB1`, then the planes of block 0, block 1, ..., then the footer: one zstandard
frame with int64 doc keys, a null flag per doc and int64 id counts per doc; then the chunk index: for each block and plane an int64
offset and an int64 length (0: the plane is all zero and isn't stored); then eight int64 (footer offset,
footer length, index offset, blocks, planes, block size, ids, docs), mode as one byte (0 byte planes, 1 bit
planes), and the magic again.
"""

from __future__ import annotations

import io
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm.common import cut, shared_dir, table
from orrery.llm.wordcache import WordIds

MAGIC, BLOCK, TAIL = b"OTB1", 1 << 16, struct.Struct("<8qB4s")
FILE_IDS, FILE_DOCS = 1 << 27, 1 << 22  # a file that holds so many ids or documents is closed and the next one begun


def to_planes(block: np.ndarray, bits: bool) -> np.ndarray:
    """uint32 ids -> rows of plane bytes (4 byte planes or 32 bit planes)."""
    by = np.ascontiguousarray(block.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return np.packbits(np.unpackbits(by[:, :, None], axis=2, bitorder="little").transpose(0, 2, 1).reshape(32, -1), axis=1) if bits else by


def from_planes(planes: np.ndarray, n: int, bits: bool) -> np.ndarray:
    if bits:
        planes = np.packbits(np.unpackbits(planes, axis=1)[:, :n].reshape(4, 8, n).transpose(0, 2, 1), axis=2, bitorder="little")[:, :, 0]
    return np.ascontiguousarray(planes[:, :n].T).view("<u4")[:, 0]


class TokenWriter:
    def __init__(self, out, bits: bool = False, block: int = BLOCK, level: int = 3):
        import zstandard

        self.out, self.bits, self.block, self.zip = out, bits, block, zstandard.ZstdCompressor(level=level)
        self.held, self.n_held, self.at, self.index, self.keys, self.counts, self.n = [], 0, 4, [], [], [], 0
        out.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(len(ids))
        self.held.append(np.asarray(ids, np.uint32))
        self.n_held += len(ids)
        if self.n_held >= self.block:
            flat = np.concatenate(self.held)
            for i in range(0, len(flat) - self.block + 1, self.block):
                self._put(flat[i : i + self.block])
            rest = flat[len(flat) - len(flat) % self.block :]
            self.held, self.n_held = [rest], len(rest)

    def _put(self, block: np.ndarray) -> None:
        self.n += len(block)
        for plane in to_planes(block, self.bits):
            raw = self.zip.compress(plane.tobytes()) if plane.any() else b""
            self.index.append((self.at, len(raw)))
            self.out.write(raw)
            self.at += len(raw)

    def close(self) -> None:
        if self.n_held:
            self._put(np.concatenate(self.held))
        nulls = np.array([k is None for k in self.keys], np.uint8)
        foot = self.zip.compress(np.array([k or 0 for k in self.keys], "<i8").tobytes() + nulls.tobytes() + np.array(self.counts, "<i8").tobytes())
        index = np.array(self.index, "<i8").reshape(-1, 2).tobytes()
        planes = 32 if self.bits else 4
        self.out.write(foot + index + TAIL.pack(self.at, len(foot), self.at + len(foot), len(self.index) // planes, planes, self.block, self.n, len(self.keys), self.bits, MAGIC))


class TokenReader:
    """Reads single blocks by the chunk index, or the documents in order with one block in memory at a time."""

    def __init__(self, src):
        import zstandard

        self.src, self.unzip = src, zstandard.ZstdDecompressor()
        src.seek(0, os.SEEK_END)
        size = src.tell()
        if size < TAIL.size + 4:
            raise ValueError("not a token file: too short")
        foot_at, foot_len, index_at, self.blocks, self.planes, self.block, self.n, docs, self.bits, magic = TAIL.unpack(self._at(size - TAIL.size, TAIL.size))
        if magic != MAGIC or self._at(0, 4) != MAGIC:
            raise ValueError("not a token file: bad magic")
        self.index = np.frombuffer(self._at(index_at, self.blocks * self.planes * 16), "<i8").reshape(self.blocks, self.planes, 2)
        raw = self.unzip.decompress(self._at(foot_at, foot_len)) if docs else b""
        nulls = np.frombuffer(raw[8 * docs : 9 * docs], np.uint8)
        self.keys = [None if x else k for k, x in zip(np.frombuffer(raw[: 8 * docs], "<i8").tolist(), nulls, strict=True)]
        self.counts = np.frombuffer(raw[9 * docs :], "<i8")

    def _at(self, offset: int, length: int) -> bytes:
        self.src.seek(offset)
        return self.src.read(length)

    def read_block(self, i: int) -> np.ndarray:
        n = min(self.block, self.n - i * self.block)
        width = (n + 7) // 8 if self.bits else n
        planes = np.zeros((self.planes, width), np.uint8)
        for p, (offset, length) in enumerate(self.index[i].tolist()):
            if length:
                planes[p] = np.frombuffer(self.unzip.decompress(self._at(offset, length)), np.uint8)
        return from_planes(planes, n, bool(self.bits))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        i, buf = 0, np.empty(0, np.uint32)
        for key, count in zip(self.keys, self.counts.tolist(), strict=True):
            parts, need = [], count
            while need > 0:
                if not len(buf):
                    buf, i = self.read_block(i), i + 1
                parts.append(buf[:need])
                buf = buf[len(parts[-1]) :]
                need -= len(parts[-1])
            yield key, np.concatenate(parts) if parts else np.empty(0, np.uint32)


@lru_cache(maxsize=2)
def _word_store(path: str) -> WordIds:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)

    model = tok.model
    # A byte-level vocabulary writes a printable byte as itself and the others as the characters from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    as_char = {x: chr(x) for x in printable} | {x: chr(256 + i) for i, x in enumerate(x for x in range(256) if x not in set(printable))}
    spelt = {c: "".join(as_char[x] for x in chr(c).encode()) for c in range(0xDF, 0x100)}
    plain = re.compile("[a-zß-öø-ÿ]+").fullmatch  # lower-case letters, composed: one token run that normalising leaves alone

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain words go straight to the library's merges, others through all of its steps."""
        got: list = [None] * len(words)
        odd = []
        for i, w in enumerate(words):
            if plain(w):
                got[i] = [t.id for t in model.tokenize(w if w.isascii() else w.translate(spelt))]
            else:
                odd.append(i)
        if odd:
            e = tok.encode([words[i] for i in odd], is_pretokenized=True, add_special_tokens=False)
            n = np.bincount(np.array(e.word_ids, np.int64), minlength=len(odd))
            for i, ids in zip(odd, np.split(np.array(e.ids, np.int32), np.cumsum(n)[:-1]), strict=True):
                got[i] = ids.tolist()
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int32, int(n.sum())), n

    return WordIds(encode, limit=1_000_000, split=lambda w: (w[:-1], w[-1]) if len(w) > 1 and w[-1] in ".,;:!?" and w[-2].isalpha() and w[-2].isascii() else None)


def encode_words_of(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts by a tokenizer that lower-cases, drops white space, and never joins a letter with the mark after it.

    So the text is cut at ASCII white space, A-Z are lowered, a last mark is taken off, and each different rest is encoded
    once by the tokenizers library.
    """
    docs = []
    for t in texts:
        t = t or ""
        t = t.lower() if t.isascii() else t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        for gap in "\n\t\r\x0b\x0c":
            t = t.replace(gap, " ")
        docs.append(list(filter(None, t.split(" "))))
    return _word_store(path).ids(docs)


def _encoded(part: pa.RecordBatch, path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    ids, bounds = encode_words_of(part.column(1).to_pylist(), path)
    for i, key in enumerate(part.column(0).to_pylist()):
        yield key, ids[bounds[i] : bounds[i + 1]]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, path: str, end_id: int, out: str, bits: bool = False, rows_at_once: int = 256, file_ids: int = FILE_IDS) -> DataFrame:
    """Write ids of all texts, in ascending doc_id order over the files, to the folder `out` (a shared URI).

    Returns the manifest (file, docs, ids), a row for each file in file order: the start of a file's ids is the
    sum over the files before it. A task writes to a name of its own and renames it when complete, so a lost or
    repeated task leaves no part of a file. Null text: only the end id. Null doc_ids come first. Repeated doc_ids
    keep a row each, in the order of a hash of their texts, by which one id can be dealt to several tasks. Texts may have any
    length. No documents: no file with documents.
    """
    spark = docs.sparkSession

    def work(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, base = _open(out)
        fs.create_dir(base, recursive=True)
        rows = chain.from_iterable(_encoded(batch.slice(at, rows_at_once), path) for batch in batches for at in range(0, batch.num_rows, rows_at_once))
        part, held = 0, next(rows, None)
        while held is not None or not part:
            name = f"ids-{ctx.partitionId():06d}-{part:04d}.otb"
            tmp = f"{base}/.{name}.{ctx.taskAttemptId()}"
            n_docs = n_ids = 0
            with fs.open_output_stream(tmp) as f:
                w = TokenWriter(f, bits)
                while held is not None and n_ids < file_ids and n_docs < FILE_DOCS:
                    key, ids = held
                    w.add(key, np.append(ids, end_id))
                    n_docs, n_ids = n_docs + 1, n_ids + len(ids) + 1
                    held = next(rows, None)
                w.close()
            fs.move(tmp, f"{base}/{name}")
            part += 1
            yield pa.RecordBatch.from_pydict({"file": [name], "docs": [n_docs], "ids": [n_ids]})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = src.repartitionByRange(n, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))
    return cut(ordered.mapInArrow(work, "file string, docs long, ids long"), "token-manifest")


def read_token_files(manifest: DataFrame, out: str) -> DataFrame:
    """(doc_id, start, ids_le) of every document in the files; ids_le: its ids as little-endian uint32 bytes."""
    first = F.coalesce(F.sum("ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = cut(manifest.filter("docs > 0").withColumn("first", first).select("file", "first"), "token-files")
    spark = files.sparkSession
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), files.count()))

    def work(batches):
        fs, base = _open(out)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}") as f:
                    rows, size = [], 0
                    for key, ids in TokenReader(f).documents():
                        rows.append((key, start, ids.astype("<u4").tobytes()))
                        start, size = start + len(ids), size + len(ids)
                        if size > 1_000_000:
                            yield _rows(rows)
                            rows, size = [], 0
                    if rows:
                        yield _rows(rows)

    return files.repartition(n, "file").mapInArrow(work, "doc_id long, start long, ids_le binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], ["doc_id", "start", "ids_le"])


def ids_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")


def dumps(docs: list[tuple[int | None, np.ndarray]], bits: bool = False, block: int = BLOCK) -> bytes:
    w = TokenWriter(out := io.BytesIO(), bits, block)
    for key, ids in docs:
        w.add(key, ids)
    w.close()
    return out.getvalue()


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = shared_dir(spark, "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, out)
    return read_token_files(manifest, out).select("doc_id", "start", (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"), F.crc32("ids_le").alias("ids_crc32"))

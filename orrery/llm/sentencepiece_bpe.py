"""SentencePiece BPE encoding and decoding by vectorised merge rounds over flat numpy symbol arrays."""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import table
from orrery.llm.wordcache import WordIds

SPACE = "▁"
LONG = 512  # symbols; a longer stretch goes through a heap, whose time doesn't depend on the number of rounds
NONE = np.int64(1 << 60)
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceModel:
    """Merge tables of a sentencepiece BPE model (identity normaliser, byte fallback, dummy prefix)."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.n, ids = n, {pieces[i]: i for i in normal}
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        self.rank = np.full(n, NONE)
        for i in normal:
            self.rank[i] = order[sp.get_score(i)]
        splits = [(ids[p[:k]], ids[p[k:]], ids[p]) for p in ids for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        left, right, made = (np.array(x, np.int64) for x in zip(*splits, strict=True))
        o = np.argsort(left * n + right)
        self.key, self.made = (left * n + right)[o], made[o]
        self.pairs = dict(zip(self.key.tolist(), self.made.tolist(), strict=True))
        # A merge is done at all its places at once only if none of its follow-up merges could come before the rest.
        self.one = np.zeros(n, bool)
        for side in (left, right):
            self.one[side[self.rank[made] <= self.rank[side]]] = True
        ties = np.bincount(self.rank[normal])
        self.one[[i for i in normal if ties[self.rank[i]] > 1]] = True
        self.chars = {ord(p): i for p, i in ids.items() if len(p) == 1}
        self.char_keys = np.array(sorted(self.chars), np.int64)
        self.char_ids = np.array([self.chars[c] for c in self.char_keys.tolist()], np.int64)
        self.joined = np.array(sorted({(ord(x) << 21) | ord(y) for p in ids for x, y in zip(p, p[1:], strict=False)}), np.int64)
        self.byte0 = next(i for i in range(n) if sp.is_byte(i))
        self.unknown = sp.unk_id()
        self.bytes = [p.replace(SPACE, " ").encode() for p in pieces]
        for b in range(256):
            self.bytes[self.byte0 + b] = bytes([b])
        for i in range(n):
            if sp.is_control(i):
                self.bytes[i] = b""
            elif sp.is_unknown(i):
                self.bytes[i] = " ⁇ ".encode()

    @staticmethod
    def words(text: str) -> list[str]:
        """Stretches that no piece crosses: a run of spaces with the word after it."""
        if not text:
            return []
        if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")  # stands for SPACE + word each
        return [w[1:] if w[:1] == SPACE and w[1:2] != SPACE and len(w) > 1 else "\0" + w for w in WORD.findall(SPACE + text.replace(" ", SPACE))]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each has. A leading NUL marks a word taken as it is, others get SPACE in front."""
        plain = [w[1:] if w[:1] == "\0" and w[1:2] == SPACE else SPACE + w for w in words]
        n = np.fromiter(map(len, plain), np.int64, len(plain))
        cp = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.searchsorted(self.char_keys, cp)
        at[at == len(self.char_keys)] = 0
        sym = np.where(self.char_keys[at] == cp, self.char_ids[at], -cp - 1)
        word = np.repeat(np.arange(len(plain)), n)
        # Segments: cut where no piece holds the two characters side by side.
        cut = np.ones(len(cp), bool)
        if len(cp) > 1:
            k = (cp[:-1] << 21) | cp[1:]
            j = np.searchsorted(self.joined, k)
            j[j == len(self.joined)] = 0
            cut[1:] = (self.joined[j] != k) | (word[1:] != word[:-1])
        seg = np.cumsum(cut) - 1
        sizes = np.bincount(seg) if len(seg) else np.empty(0, np.int64)
        pos = np.arange(len(sym))
        out_sym, out_pos = [], []
        for s in np.flatnonzero(sizes > LONG):
            lo = int(np.searchsorted(seg, s))
            ids, where = self._by_heap(sym[lo : lo + sizes[s]].tolist())
            out_sym.append(np.array(ids, np.int64))
            out_pos.append(np.array(where, np.int64) + lo)
        live = sizes[seg] <= LONG if len(seg) else np.empty(0, bool)
        sym_l, seg_l, pos_l = sym[live], seg[live], pos[live]
        while len(sym_l):
            pair = np.full(len(sym_l), -1, np.int64)
            if len(sym_l) > 1:
                ok = (seg_l[:-1] == seg_l[1:]) & (sym_l[:-1] >= 0) & (sym_l[1:] >= 0)
                k = np.where(ok, sym_l[:-1] * self.n + sym_l[1:], -1)
                j = np.searchsorted(self.key, k)
                j[j == len(self.key)] = 0
                pair[:-1] = np.where(self.key[j] == k, self.made[j], -1)
            rank = np.where(pair >= 0, self.rank[pair], NONE)
            first = np.ones(len(seg_l), bool)
            first[1:] = seg_l[1:] != seg_l[:-1]
            starts = np.flatnonzero(first)
            low = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(seg_l)))
            done = np.repeat(low == NONE, size)
            if done.any():
                out_sym.append(sym_l[done])
                out_pos.append(pos_l[done])
            pick = (rank == np.repeat(low, size)) & ~done
            at = np.flatnonzero(pick)
            if len(at):
                s = seg_l[at]
                head = np.ones(len(at), bool)
                head[1:] = s[1:] != s[:-1]
                run = np.ones(len(at), bool)  # starts of runs of overlapping picks; every second one merges
                run[1:] = (at[1:] != at[:-1] + 1) | head[1:]
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[np.where(self.one[pair[at]], head, nth % 2 == 0)]
                sym_l[at] = pair[at]
                gone = done.copy()
                gone[at + 1] = True
            else:
                gone = done
            sym_l, seg_l, pos_l = sym_l[~gone], seg_l[~gone], pos_l[~gone]
        if out_sym:
            sym, pos = np.concatenate(out_sym), np.concatenate(out_pos)
            o = np.argsort(pos, kind="stable")
            sym, owner = sym[o], word[pos[o]]
        else:
            sym = owner = np.empty(0, np.int64)
        if (odd := np.flatnonzero(sym < 0)).size:  # characters that the model lacks become their bytes
            raw = [chr(-int(c) - 1).encode("utf-8", "surrogatepass") for c in sym[odd]]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(r) for r in raw]
            at = np.repeat(np.arange(len(sym)), times)
            is_raw = np.repeat(sym < 0, times)
            sym, owner = sym[at], owner[at]
            sym[is_raw] = self.byte0 + np.frombuffer(b"".join(raw), np.uint8)
        return sym.astype(np.int32), np.bincount(owner, minlength=len(plain))

    def _by_heap(self, sym: list[int]) -> tuple[list[int], list[int]]:
        """The same merges for one long stretch, best rank first and leftmost among equals."""
        n, nxt, prev = len(sym), [*range(1, len(sym)), -1], [-1, *range(len(sym) - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if i >= 0 and j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (p := self.pairs.get(sym[i] * self.n + sym[j])) is not None:
                heapq.heappush(heap, (int(self.rank[p]), i, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i)
        gone = [False] * n
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = nxt[i]
            if gone[i] or j < 0 or sym[i] != x or sym[j] != y:
                continue
            sym[i], gone[j] = self.pairs[x * self.n + y], True
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        where = [i for i in range(n) if not gone[i]]
        return [sym[i] for i in where], where

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids))
        if ids and raw[:1] == b" " and ids[0] != self.byte0 + 32 and ids[0] != self.unknown:
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[PieceModel, WordIds]:
    model = PieceModel(path)
    return model, WordIds(model.encode_words)


def encode(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all texts and their bounds (null: empty)."""
    model, store = _loaded(path)
    return store.ids([model.words(t or "") for t in texts])


def decode(ids: list[int], path: str) -> str:
    return _loaded(path)[0].decode(ids)


def encode_decode(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids array<int>, decoded string) of every whole text.

    Null and empty texts give no ids and an empty string. Repeated rows are encoded like any other; the
    id may be null or repeated. Further columns of docs are ignored.
    """

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, bounds = encode(part.column(1).to_pylist(), path)
                each, b = ids.tolist(), bounds.tolist()
                back = [decode(each[x:y], path) for x, y in zip(b, b[1:], strict=False)]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(back, pa.string())], ["key", "ids", "decoded"])

    src = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(work, "key long, ids array<int>, decoded string").withColumnRenamed("key", id_col)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), model_path())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

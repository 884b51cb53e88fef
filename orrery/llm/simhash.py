"""SimHash fingerprints and their binary-trie self-join under a Hamming error budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import cut, table
from orrery.llm.wordcache import spans
from orrery.operators.components import connected_components

SEED = 42
GROUP_ROWS = 8192  # larger groups are split by further agreeing bits, so that a task's node pairs stay bounded
SMALL_LINKS, SMALL_IDS = 200_000, 1_000_000  # links joined up in one task, and ids sent to every executor, at most
ROWS_AT_ONCE, PAIRS_AT_ONCE = 32_768, 500_000  # rows whose tries are joined together, and pairs of nodes or rows held at once
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _mix(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th independent 64-bit hash made from h (finaliser of SplitMix64)."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * i) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle (repeats included) of an ASCII-lower-cased text; fewer words: of them all."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)


def signatures(texts: list[str | None], k: int, parts: int, repeats: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A row of `parts` 64-bit SimHash fingerprints for each text (a text without words gets zeros), and the number of
    shingles that count. Without repeats, a shingle counts once however often it occurs."""
    out, counted = np.zeros((len(texts), parts), np.uint64), np.zeros(len(texts), np.int64)
    i = 0
    while i < len(texts):
        hashes, size, j = [], 0, i
        while j < len(texts) and (size < 200_000 or j == i):
            found = shingle_hashes(texts[j], k)
            hashes.append(found if repeats else np.unique(found))
            size += len(hashes[-1])
            j += 1
        n = counted[i:j] = np.array([len(x) for x in hashes])
        h, doc = np.concatenate(hashes), np.repeat(np.arange(j - i), n) * 256
        for p in range(parts):
            by = (_mix(h, p) if parts > 1 else h).astype(">u8").view(np.uint8).reshape(-1, 8)
            ones = np.concatenate([np.bincount(doc + by[:, c], minlength=256 * (j - i)).reshape(-1, 256) @ BITS for c in range(8)], axis=1)
            out[i:j, p] = np.packbits(ones * 2 > n[:, None], axis=1).view(">u8")[:, 0]
        i = j
    return out, counted


def fingerprints(docs: DataFrame, k: int = 3, parts: int = 1, key: str = "doc_id", text: str = "text", repeats: bool = True) -> DataFrame:
    """(key, n, fp array<bigint>): how many shingles count, and `parts` 64-bit fingerprints as signed numbers."""

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sig, n = signatures(part.column(1).to_pylist(), k, parts, repeats)
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * parts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(sig.ravel().view(np.int64)))], ["key", "n", "fp"])

    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(work, "key long, n long, fp array<bigint>").withColumnRenamed("key", key)


def trie_pairs(group: np.ndarray, code: np.ndarray, budget: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (a, b, starts) of leaves a <= b of one group whose codes differ in at most `budget` of their `bits` low bits.

    Rows are sorted by (group, code). They are a binary trie: a node at a depth is a run of rows with one prefix, a leaf a run
    with one code; starts has the first row of each leaf. Pairs of nodes go down together a bit at a time, add up the
    bits in which they differ, and are dropped as soon as the sum passes the budget; a pair of paths without branches is decided at
    once. The pairs under way are kept on a stack in bounded pieces. (a, a) is given for leaves of several rows.
    """
    n = len(code)
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    apart = code[1:] ^ code[:-1]
    starts = [np.flatnonzero(new)]
    for depth in range(1, bits + 1):
        new[1:] |= apart >> np.uint64(bits - depth) != 0
        starts.append(np.flatnonzero(new))
    leaves = starts[-1]
    many = np.diff(np.append(leaves, n)) > 1
    leaf_code = code[leaves]

    def decided(a, b):  # leaves
        near = np.bitwise_count(leaf_code[a] ^ leaf_code[b]) <= budget
        near &= (a != b) | many[a]
        return a[near], b[near], leaves

    levels: list = [None] * bits

    def level(depth: int):
        """For nodes of a depth: their first child, whether there are two; for the children: their bit, first leaf, whether it's the only one."""
        if levels[depth] is None:
            child = starts[depth + 1]
            first = np.searchsorted(child, starts[depth])
            leaf = np.searchsorted(leaves, child)
            levels[depth] = first, np.diff(np.append(first, len(child))) == 2, (code[child] >> np.uint64(bits - 1 - depth) & np.uint64(1)).astype(np.int8), leaf, np.diff(np.append(leaf, len(leaves))) == 1
        return levels[depth]

    roots = np.arange(len(starts[0]))
    stack = [(0, roots, roots, np.zeros(len(roots), np.int8))]
    while stack:
        depth, a, b, d = stack.pop()
        if len(a) > PAIRS_AT_ONCE // 4:
            half = len(a) // 2
            stack += [(depth, a[:half], b[:half], d[:half]), (depth, a[half:], b[half:], d[half:])]
            continue
        first, two, bit, leaf, only = level(depth)
        ta, tb, a0, b0 = two[a], two[b], first[a], first[b]
        turn = ta & (a != b)
        both = ta & tb
        ca = np.concatenate((a0, a0[tb], a0[turn] + 1, a0[both] + 1))
        cb = np.concatenate((b0, b0[tb] + 1, b0[turn], b0[both] + 1))
        dd = np.concatenate((d, d[tb], d[turn], d[both])) + (bit[ca] != bit[cb])
        keep = dd <= budget
        ca, cb, dd = ca[keep], cb[keep], dd[keep]
        end = only[ca] & only[cb] if depth + 1 < bits else np.ones(len(ca), bool)
        if end.any():
            found = decided(leaf[ca[end]], leaf[cb[end]])
            if len(found[0]):
                yield found
        if not end.all():
            stack.append((depth + 1, ca[~end], cb[~end], dd[~end]))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _free_blocks(mask: int, bits: int, budget: int) -> list[int]:
    """The bits outside mask, dealt into budget + 1 masks: two codes within the budget agree on one of them."""
    free = [i for i in range(bits) if not mask >> i & 1]
    return [mask | sum(1 << i for i in part.tolist()) for part in np.array_split(np.array(free, dtype=object), budget + 1)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


GROUP = ["t", "mask", "value", "salt"]


def deal_out(codes: DataFrame, bits: int, budget: int, group_rows: int, hot: list[DataFrame] | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """codes(t, fp, id, ...) with the columns of GROUP: rows whose codes are within the budget meet in some group.

    Codes go into groups that agree on one of budget + 1 blocks of bits. A group over group_rows is dealt again by blocks
    of its other bits. One that is still too large when few bits are left holds many rows of few codes: it is cut
    into chunks by a hash of id, and every pair of chunks is a group. `hot` (as given back) saves counting again.
    """
    spark, others = codes.sparkSession, [c for c in codes.columns if c not in ("t", "mask", "value")]
    known, tables = hot, []

    def deal(df: DataFrame, masks: list[int]) -> DataFrame:
        """A row for each block of the free bits of its mask; the masks (powers of budget + 1, a few) are a table."""
        subs = [(_signed(m), _signed(s)) for m in masks for s in _free_blocks(m, bits, budget)]
        out = df.join(F.broadcast(spark.createDataFrame(subs, "mask long, sub long")), "mask").select("t", *others, F.col("sub").alias("mask"))
        return out.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))

    rows, ready, left = deal(codes.withColumn("mask", F.lit(0).cast("long")), [0]), None, bits
    while True:
        left -= left // (budget + 1)
        if known is not None:
            big = known[len(tables)]
        else:
            big = cut(rows.groupBy("t", "mask", "value").count().filter(F.col("count") > group_rows), "simhash-hot")
        tables.append(big)
        if big.isEmpty():
            rest = rows.withColumn("salt", F.lit(0))
        elif left <= 4 * (budget + 1):
            chunks = rows.join(big, ["t", "mask", "value"], "left").withColumn("s", F.ceil(F.coalesce("count", F.lit(1)) / group_rows).cast("int")).drop("count")
            own = F.pmod(F.xxhash64("id"), F.col("s")).cast("int")
            chunks = chunks.withColumns({"c": own, "j": F.explode(F.sequence(F.lit(0), F.col("s") - 1))})
            rest = chunks.withColumn("salt", F.least("c", "j") * F.col("s") + F.greatest("c", "j")).drop("c", "j", "s")
        else:
            small = rows.join(big, ["t", "mask", "value"], "left_anti").withColumn("salt", F.lit(0))
            ready = small if ready is None else ready.unionByName(small)
            masks = [r["mask"] % 2**64 for r in big.select("mask").distinct().collect()]
            rows = deal(rows.join(big, ["t", "mask", "value"], "left_semi").drop("value"), masks)
            continue
        return (rest if ready is None else ready.unionByName(rest)), tables


def _by_group(dealt: DataFrame, columns: list[str], schema: str, solve) -> DataFrame:
    """solve(gid, cols) for pieces of ROWS_AT_ONCE rows, of whole groups, sorted by group and code: cols are arrays of `columns`, the code first."""

    def work(batches):
        held: pa.Table | None = None

        def groups(rb: pa.Table) -> np.ndarray:
            keys = [rb.column(i).to_numpy() for i in range(len(GROUP))]
            new = np.ones(rb.num_rows, bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            return np.flatnonzero(new)

        def run(rb: pa.Table, starts: np.ndarray):
            ends = np.append(starts[1:], rb.num_rows)
            lo = 0
            while lo < len(starts):
                hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + ROWS_AT_ONCE, side="right")))
                s, e = int(starts[lo]), int(ends[hi - 1])
                part = rb.slice(s, e - s).combine_chunks()
                gid = np.repeat(np.arange(hi - lo), ends[lo:hi] - starts[lo:hi])
                cols = []
                for i in range(len(GROUP), rb.num_columns):
                    x = part.column(i)
                    x = x.chunk(0) if x.num_chunks else pa.array([], x.type)
                    cols.append(x.flatten().to_numpy().reshape(len(gid), -1) if pa.types.is_list(x.type) else x.to_numpy())
                keys = [part.column(i).to_numpy() for i in range(len(GROUP))]
                order = np.lexsort((cols[0].view(np.uint64), gid))
                yield from solve(gid, [c[order] for c in cols], [k[order] for k in keys])
                lo = hi

        for batch in batches:
            rb = pa.Table.from_batches([batch])
            rb = pa.concat_tables([held, rb]).combine_chunks() if held is not None and held.num_rows else rb
            if not rb.num_rows:
                continue
            starts = groups(rb)
            last = int(starts[-1])
            held = rb.slice(last)
            if last:
                yield from run(rb.slice(0, last), starts[:-1])
        if held is not None and held.num_rows:
            yield from run(held, groups(held))

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select(*GROUP, *columns).repartition(n, *GROUP).sortWithinPartitions(*GROUP).mapInArrow(work, schema)


def trie_links(codes: DataFrame, bits: int, budget: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) between the `rep` ids of codes(t, fp, rep), distinct by (t, fp), within `budget` differing bits: of the links
    in each group of deal_out() a spanning forest (connectivity is kept, quadratic output avoided)."""

    def solve(gid, cols, _):
        fp, rep = cols
        a = b = np.empty(0, np.int64)
        for x, y, starts in trie_pairs(gid, fp.view(np.uint64), budget, bits):
            x, y = starts[x], starts[y]
            a, b = np.concatenate((a, x)), np.concatenate((b, y))
            if len(a) > 2 * len(fp) + PAIRS_AT_ONCE:
                root = _forest(len(fp), a, b)
                a = np.flatnonzero(root != np.arange(len(fp)))
                b = root[a]
        if len(a):
            root = _forest(len(fp), a, b)
            a = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[root[a]])], ["a", "b"])

    dealt, _ = deal_out(codes.withColumn("id", F.col("rep")), bits, budget, group_rows)
    return _by_group(dealt, ["fp", "rep"], "a long, b long", solve).filter("a <> b")


def near_components(docs: DataFrame, k: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): classes of documents linked by fingerprints within `budget` bits.

    Equal fingerprints are one trie leaf; links join different ones, and components run over leaves.
    Null text counts as empty: fingerprint zero, linked like any other. A null doc_id keeps its row, with the
    component of its fingerprint. No rows: no rows. Further columns of docs are ignored.
    """
    sig = cut(fingerprints(docs, k).select("doc_id", F.col("fp")[0].alias("fp")), "simhash-sig")
    codes = cut(sig.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(-(2**63))).alias("rep")).withColumn("t", F.lit(0)), "simhash-codes")
    comp = connected_components(trie_links(codes, 64, budget), small=SMALL_LINKS)
    of = codes.join(comp, codes["rep"] == comp["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = sig.join(of, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component_id") != -(2**63), F.col("component_id")).alias("component_id"))


def _distinct_shingles(text: str | None, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, k))


def _verified(pairs: DataFrame, docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """Those of the distinct pairs (a, b) whose k-word shingle sets have Jaccard similarity >= `similarity`."""
    used = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "simhash-used")
    used = F.broadcast(used) if used.count() <= SMALL_IDS else used
    texts = docs.select("doc_id", "text").join(used, "doc_id", "left_semi")
    ta, tb = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")

    def verify(batches):
        last, kept = None, None
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            ok = []
            for i in range(len(a)):
                if last != (b[i], y[i]):
                    last, kept = (b[i], y[i]), _distinct_shingles(y[i], k)
                own = _distinct_shingles(x[i], k)
                both = len(np.intersect1d(own, kept, assume_unique=True))
                ok.append(bool(both) and both >= similarity * (len(own) + len(kept) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")


def signature_bound(similarity: float, bits: int) -> int:
    """Differing bits of a SimHash of so many bits that a pair right at the Jaccard similarity passes with 2.5 sigma to spare (99 %)."""
    cos = 2 * similarity / (1 + similarity)
    p = float(np.arccos(cos) / np.pi)
    return int(np.ceil(bits * p + 2.5 * np.sqrt(bits * p * (1 - p))))


def _codes(sig: DataFrame, codes: int) -> DataFrame:
    """(id, n, sig, t, fp): the first `codes` halves of 32 bits of the fingerprints of sig(doc_id, n, fp)."""
    halves = F.flatten(F.transform(F.slice("fp", 1, (codes + 1) // 2), lambda x: F.array(F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF)))))
    return sig.select(F.col("doc_id").alias("id"), *[c for c in sig.columns if c not in ("doc_id", "fp")], F.col("fp").alias("sig"), F.posexplode(halves).alias("t", "fp"))


def _alike(similarity: float, bound: int, x: str, y: str):
    """Whether two sets of these sizes and signatures may have the similarity."""
    sizes = F.least(f"n{x}", f"n{y}") >= F.greatest(f"n{x}", f"n{y}") * F.lit(similarity) - F.lit(1e-9)
    bits = F.aggregate(F.zip_with(f"s{x}", f"s{y}", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d)
    return sizes & (bits <= bound)


def _nearest(ids: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray, quota: int) -> tuple[np.ndarray, np.ndarray]:
    """For row pairs at distance d: whether one is among the other's quota nearest (ties by id), and the rows that have more than quota."""
    x, y, dd = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((d, d))
    o = np.lexsort((ids[y], dd, x))
    first = np.ones(len(o), bool)
    first[1:] = x[o][1:] != x[o][:-1]
    rank = np.empty(len(o), np.int64)
    rank[o] = np.arange(len(o)) - np.maximum.accumulate(np.where(first, np.arange(len(o)), 0))
    near = rank < quota
    return near[: len(i)] | near[len(i) :], np.unique(x[~near])


def trie_candidates(rows: DataFrame, codes: int, budget: int, bound: int, similarity: float, quota: int, rest: bool = False) -> DataFrame:
    """Pairs (a, b) of ids that the tries of rows(GROUP..., fp, id, n, was, comp, sig) find within the budget of one code, whose
    whole signatures differ in at most `bound` bits, whose sizes allow the similarity, and whose classes `was` differ.

    A pair counts in one group only: that of the first code and block on which it agrees. The pairs in which one is
    among the other's `quota` nearest in the group are given, and a group that has more is given itself, with a and b
    null. With `rest` it is the others that are given, if their classes `comp` still differ.
    """
    blocks = [np.uint64(m) for m in _free_blocks(0, 32, budget)]

    def solve(gid, cols, keys):
        fp, ids, n, was, comp, sig = cols
        sig, mask, t = sig.view(np.uint64), keys[1].view(np.uint64), keys[0]

        def first_met(i, j):
            """Whether this group is of the first code, and the first block of it, on which i and j agree."""
            apart = sig[i] ^ sig[j]
            halves = np.stack((apart >> np.uint64(32), apart & np.uint64(0xFFFFFFFF)), axis=2).reshape(len(i), 2 * sig.shape[1])[:, :codes]
            near = np.bitwise_count(halves) <= budget
            own = near.argmax(1) == t[i]
            code = halves[np.arange(len(i)), t[i]]
            free = np.stack([code & m == 0 for m in blocks], axis=1)
            block = np.array(blocks)[free.argmax(1)]
            return own & free.any(1) & (mask[i] & block == block)

        def batch(a, b, full):
            a, b = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
            m, none = len(a), pa.nulls(len(full), pa.int64())
            cols = [pa.concat_arrays([pa.array(x), none]) for x in (a, b)]
            cols += [pa.concat_arrays([pa.nulls(m, k), pa.array(v[full], k)]) for v, k in zip(keys, (pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
            return pa.RecordBatch.from_arrays(cols, ["a", "b", *GROUP])

        held, more = [np.empty(0, np.int64)] * 3, np.empty(0, np.int64)

        def settle(parts):
            """The pairs that are among the nearest so far; of the others it is sure that they aren't."""
            nonlocal held, more
            i, j, d = (np.concatenate(x) for x in zip(held, *parts, strict=True))
            near, over = _nearest(ids, i, j, d, quota)
            more = np.union1d(more, over)
            held = [i[near], j[near], d[near]]
            i, j = i[~near], j[~near]
            still = comp[i] != comp[j]
            return i[still], j[still]

        none = np.empty(0, np.int64)
        parts, size = [], 0
        for la, lb, starts in trie_pairs(gid, fp.view(np.uint64), budget, 32):
            ends = np.append(starts[1:], len(fp))
            lo, hi = np.minimum.reduceat(was, starts), np.maximum.reduceat(was, starts)
            mixed = (lo[la] != lo[lb]) | (lo[la] != hi[la]) | (lo[lb] != hi[lb])  # not all of one class
            la, lb = la[mixed], lb[mixed]
            rows_a, rows_b = ends[la] - starts[la], ends[lb] - starts[lb]
            left = spans(starts[la], rows_a)  # each row of a, with the leaf b
            same, lb, rows_b = np.repeat(la == lb, rows_a), np.repeat(lb, rows_a), np.repeat(rows_b, rows_a)
            done, total = 0, np.cumsum(rows_b)
            while done < len(left):
                upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS_AT_ONCE, side="right")))
                s = slice(done, upto)
                i, j = np.repeat(left[s], rows_b[s]), spans(starts[lb[s]], rows_b[s])
                ok = (was[i] != was[j]) & ((i < j) | ~np.repeat(same[s], rows_b[s]))
                i, j = i[ok], j[ok]
                ok = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9
                i, j = i[ok], j[ok]
                d = np.bitwise_count(sig[i] ^ sig[j]).sum(1, dtype=np.int64)
                ok = d <= bound
                i, j, d = i[ok], j[ok], d[ok]
                ok = first_met(i, j)
                if ok.any():
                    parts.append([i[ok], j[ok], d[ok]])
                    size += int(ok.sum())
                if size > 2 * PAIRS_AT_ONCE:
                    i, j = settle(parts)
                    parts, size = [], 0
                    if rest and len(i):
                        yield batch(i, j, none)
                done = upto
        i, j = settle(parts)
        if rest:
            if len(i):
                yield batch(i, j, none)
            return
        _, once = np.unique(gid[more], return_index=True)
        if len(held[0]) or len(more):
            yield batch(held[0], held[1], more[once])

    return _by_group(rows, ["fp", "id", "n", "was", "comp", "sig"], "a long, b long, t int, mask long, value long, salt int", solve)


def similar_links(docs: DataFrame, k: int = 5, parts: int = 10, codes: int = 10, budget: int = 3, similarity: float = 0.8, group_rows: int = GROUP_ROWS, quota: int = 2) -> DataFrame:
    """Links (a, b) between documents whose k-word shingle sets have Jaccard similarity >= `similarity`, exactly checked.

    Candidates are pairs that agree within `budget` bits on one of `codes` (an even number) SimHash codes of 32 bits, by trie joins:
    a pair at 0.8 becomes one with a chance of 0.95, at 0.85 of 0.99. Their signatures of 64 * parts bits, which the
    codes are the start of, then rule out pairs far below the similarity. Fingerprints are of distinct shingles, so that they measure
    what is checked: the shingle sets. Documents of one code are first checked against the smallest of them. Then
    every document's nearest candidates outside its class are checked, `quota` in each group, and last all the others
    whose classes still differ: every candidate is checked or connected already. Documents without words link to
    none; rows that repeat a doc_id are one document.
    """
    docs = docs.filter("doc_id is not null")
    bound = signature_bound(similarity, 64 * parts)
    sig = cut(fingerprints(docs, k, parts, repeats=False).filter("n > 0"), "simhash-sig")
    each = _codes(sig, codes)
    least = each.groupBy("t", "fp").agg(F.min(F.struct("id", "n", "sig")).alias("r"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    same = each.select("t", "fp", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")).join(least, ["t", "fp"]).filter("b <> r.id")
    same = same.select(F.col("r.id").alias("a"), "b", F.col("r.n").alias("na"), "nb", F.col("r.sig").alias("sa"), "sb").filter(_alike(similarity, bound, "a", "b"))
    tried = cut(same.select("a", "b").distinct(), "simhash-tried")
    found = cut(_verified(tried, docs, k, similarity), "simhash-links")

    def classes(links: DataFrame, name: str) -> DataFrame:
        return connected_components(links, small=SMALL_LINKS).select(F.col("node").alias("doc_id"), F.col("component").alias(name))

    was = sig.join(classes(found, "was"), "doc_id", "left").withColumn("was", F.coalesce("was", "doc_id"))
    rows, hot = deal_out(_codes(was.withColumn("comp", F.col("was")), codes), 32, budget, group_rows)
    got = cut(trie_candidates(rows, codes, budget, bound, similarity, quota), "simhash-pairs")
    new = cut(got.filter("a is not null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "simhash-tried")
    groups = cut(got.filter("a is null").select(*GROUP).distinct(), "simhash-over")
    found = found.union(cut(_verified(new, docs, k, similarity), "simhash-links"))
    if groups.isEmpty():
        return found
    now = was.join(classes(found, "comp"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    rows, _ = deal_out(_codes(now, codes), 32, budget, group_rows, hot)
    rest = trie_candidates(rows.join(groups, GROUP, "left_semi"), codes, budget, bound, similarity, quota, rest=True)
    rest = cut(rest.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "simhash-tried")
    return found.union(cut(_verified(rest, docs, k, similarity), "simhash-links"))


def drop_near_copies(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of each class of linked documents, the one with the smallest doc_id stays.

    Null and empty texts and null doc_ids link to none and stay, as do all rows of a doc_id that stays. No rows: no rows.
    """
    comp = connected_components(similar_links(docs, k, similarity=similarity), small=SMALL_LINKS)
    return docs.join(cut(comp.filter("node <> component").select(F.col("node").alias("doc_id")), "simhash-drop"), "doc_id", "left_anti").select(*docs.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), k=3, budget=3)

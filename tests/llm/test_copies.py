"""SimHash classes and exact dedup against brute force."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orrery.llm import simhash, streaming_dedup
from orrery.llm.common import shared_dir


def plain_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints():
    texts = [None, "", "one", "one two", "One two\tthree\x0bfour", "a " * 500, "É é É"]
    assert simhash.signatures(texts, 3, 1)[0][:, 0].tolist() == [plain_fingerprint(t, 3) for t in texts]


@pytest.mark.parametrize(("bits", "budget"), [(64, 3), (32, 1), (16, 2)])
def test_trie_pairs_finds_all(bits, budget):
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 2**bits - 1, 20, dtype=np.uint64)
    codes = np.unique(np.concatenate([base] + [base ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for i, j in rnd.integers(0, bits, (8, 2))]))
    got = [x for a, b, _ in simhash.trie_pairs(np.zeros(len(codes), np.int64), codes, budget, bits) for x in zip(a.tolist(), b.tolist(), strict=True)]
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if bin(int(codes[i]) ^ int(codes[j])).count("1") <= budget}
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("group_rows", [simhash.GROUP_ROWS, 20])
def test_links_survive_splitting_of_hot_groups(spark, group_rows):
    rnd = random.Random(4)
    base = rnd.getrandbits(64)
    codes = sorted({base ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 4))) for _ in range(60)} | {rnd.getrandbits(64) for _ in range(40)})
    df = spark.createDataFrame([(0, simhash._signed(c), i) for i, c in enumerate(codes)], "t int, fp long, rep long")
    links = [(r["a"], r["b"]) for r in simhash.trie_links(df, 64, 3, group_rows=group_rows).collect()]
    want = [(i, j) for i in range(len(codes)) for j in range(i) if bin(codes[i] ^ codes[j]).count("1") <= 3]
    assert roots(len(codes), links) == roots(len(codes), want)


def test_near_components(spark):
    text = "the quick brown fox jumps over the lazy dog again and again until night falls on the hill"
    rows = [(5, text), (3, text.upper()), (9, text), (7, None), (8, ""), (None, text), (20, "something else entirely here now"), (5, text)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fingerprint int")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_components(df).collect()), key=str)
    want = sorted(((d, f"{plain_fingerprint(t, 3):016x}", {7: 7, 8: 7, 20: 20}.get(d, 3)) for d, t in rows), key=str)
    assert got == want
    assert simhash.near_components(df.limit(0)).count() == 0


def test_similar_links_recall_and_precision(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for i in range(60):
        base = [rnd.choice(words) for _ in range(rnd.randint(60, 300))]
        docs.append(" ".join(base))
        for _ in range(2):
            near = list(base)
            for _ in range(max(1, len(base) // 120)):
                near[rnd.randrange(len(near))] = rnd.choice(words)
            docs.append(" ".join(near))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in docs]
    want = {(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r["a"], r["b"]) for r in simhash.similar_links(df).collect()}
    assert got <= want  # the exact check lets no other pair through
    full, found = roots(len(docs), want), roots(len(docs), got)
    hit = sum(found[i] == found[j] for i, j in want)
    assert hit >= 0.9 * len(want), (hit, len(want), full)
    kept = simhash.drop_near_copies(df)
    assert kept.columns == ["doc_id", "text"] and 60 <= kept.count() <= 66


def test_repeated_lines_do_not_part_equal_sets(spark):
    rnd = random.Random(8)
    docs = []
    for _ in range(30):
        body, line = ([f"w{rnd.randrange(5000)}" for _ in range(n)] for n in (200, 12))
        docs += [" ".join(body + line * times) for times in (3, 20)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {(r["a"], r["b"]) for r in simhash.similar_links(df).collect()} == {(i, i + 1) for i in range(0, 60, 2)}


def linked_like_brute_force(spark, docs):
    """The links, after a check that they are right and connect every pair at 0.8 or more; and those pairs."""
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in docs]
    want = {(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in simhash.similar_links(df).collect()}
    assert got <= want and roots(len(docs), got) == roots(len(docs), want)
    return got, want


@pytest.mark.parametrize("group_rows", [simhash.GROUP_ROWS, 30])
def test_recall_right_above_the_similarity(spark, group_rows):
    """Pairs at 0.8 and a little above, with a common line in each document; short and empty texts too."""
    rnd = random.Random(10)
    docs, line = ["", None, "one", "ONE", "two words", "a b c d e f", "a b c d e g"], [f"c{i}" for i in range(20)]
    for i in range(150):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(60, 300))] + line
        n = len(base) - 4
        cut = int(n - 0.8 * n) - i % 3  # so many words fewer: n - cut of n shingles are left
        docs += [" ".join(base), " ".join(base[cut:])]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in docs]
    want = {(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    links = simhash.similar_links(df, group_rows=group_rows).collect()
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in links}
    found = roots(len(docs), got)
    assert got <= want and len(want) >= 150 and sum(found[i] == found[j] for i, j in want) >= 0.9 * len(want)


def test_a_failed_smallest_partner_is_not_the_last(spark, monkeypatch):
    """Documents that share a long passage, all with one fingerprint: each pair of near copies is found."""
    rnd = random.Random(12)
    passage, docs = [f"p{i}" for i in range(320)], []
    for _ in range(30):
        own = [f"w{rnd.randrange(10**6)}" for _ in range(80)]
        near = own[:76] + [f"w{rnd.randrange(10**6)}" for _ in range(4)]
        docs += [" ".join(passage + x) for x in (own, near)]
    one = lambda docs, k, parts, **_: docs.select("doc_id", F.size(F.split("text", " ")).cast("long").alias("n"), F.array_repeat(F.lit(5).cast("long"), parts).alias("fp"))
    monkeypatch.setattr(simhash, "fingerprints", one)
    got, want = linked_like_brute_force(spark, docs)
    assert len(want) == 30 and got == want


ROWS = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "c" * 5000), (2, "a"), (None, "a"), (None, "z"), (7, "A")]


def test_exact_dedup(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, keep_id string")
    d = streaming_dedup.StreamingDedup(spark)
    d.add(df)
    d.update()
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in d.decisions(df).collect()), key=str)
    want = [(1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (None, 2, 4, False), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True), (7, 7, 1, True), (None, None, 1, True)]
    assert got == sorted(want, key=str)


def test_state_goes_on_over_updates(spark):
    first, second = (spark.createDataFrame(x, "doc_id long, text string") for x in ([(1, "a"), (2, "b")], [(3, "a"), (0, "b")]))
    home = shared_dir(spark, "dedup")
    d = streaming_dedup.StreamingDedup(spark, home=home)
    d.add(first)
    d.update()
    assert {r["keep"]["doc_id"] for r in d.state().collect()} == {1, 2}
    again = streaming_dedup.StreamingDedup(spark, home=home)  # a restarted stream
    again.add(second)
    again.update()
    assert sorted((r["keep"]["doc_id"], r["copies"]) for r in again.state().collect()) == [(2, 2), (3, 2)]
    assert sorted((r["doc_id"], r["kept"]) for r in again.decisions(first.union(second)).collect()) == [(0, False), (1, False), (2, True), (3, True)]


def test_bytes_are_checked_on_hits(spark, monkeypatch):
    """With a digest that says the same of all texts, whole texts still tell them apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(streaming_dedup.F, "sha2", lambda c, n: F.when(c.isNotNull(), F.lit("same")))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "c")], "doc_id long, text string")
    d = streaming_dedup.StreamingDedup(spark)
    d.add(df)
    d.update()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in d.decisions(df).collect()) == [(1, 3, 2), (2, 2, 1), (3, 3, 2), (4, 5, 2), (5, 5, 2)]


def test_drop_copies(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert sorted(((r["doc_id"], r["text"]) for r in streaming_dedup.drop_copies(df).collect()), key=str) == sorted([(2, "a"), (3, "b"), (5, ""), (6, "c" * 5000), (None, "z"), (7, "A")], key=str)
    low = spark.createDataFrame([(-(2**63), "q", 1), (None, "q", 2)], "doc_id long, text string, _d long")
    assert [tuple(r) for r in streaming_dedup.drop_copies(low).collect()] == [(-(2**63), "q", 1)]
    empty = streaming_dedup.drop_copies(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text"]


@pytest.mark.parametrize("sent", [8192, 0])
def test_drop_copies_over_long_files(spark, monkeypatch, sent):
    """Copies at the ends of bitmaps, within a file and between files."""
    monkeypatch.setattr(streaming_dedup, "SENT_PLACES", sent)
    twice = {0: 7, 7: 7, 8: 7, 32767: 32767, 32768: 32767, 65535: 65536, 65536: 65536, 69999: 69998, 69998: 69998}
    rows = [(i, f"t{twice.get(i, i)}") for i in range(70000)] + [(-1, "t5"), (-2, "t32768 "), (-3, "t69997")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).unionByName(spark.createDataFrame([(70001, "t32767"), (70002, "own")], "doc_id long, text string"))
    best = {}
    for i, t in [*rows, (70001, "t32767"), (70002, "own")]:
        best[t] = max(i, best.get(t, i))
    assert sorted((r["doc_id"], r["text"]) for r in streaming_dedup.drop_copies(df).collect()) == sorted((i, t) for t, i in best.items())


def test_drop_copies_tells_texts_of_one_digest_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(streaming_dedup.F, "sha2", lambda c, n: F.when(c.isNotNull(), F.lit("same")))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "c")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in streaming_dedup.drop_copies(df).collect()) == [(2, "b"), (3, "a"), (5, "c")]


def test_drop_copies_writes_only_texts_that_occur_twice(spark):
    from orrery.storage import cut, made

    rnd = random.Random(4)
    docs = [(i, "".join(chr(rnd.randrange(33, 127)) for _ in range(5000))) for i in range(300)]
    df = cut(spark.createDataFrame([*docs, (300, docs[0][1])], "doc_id long, text string"), "docs")
    before = set(made())
    assert streaming_dedup.drop_copies(df).count() == 300
    size = sum(os.path.getsize(f"{d}/{f}") for x in made() if x not in before for d, _, names in os.walk(x.removeprefix("file://")) for f in names if f.endswith(".parquet"))
    assert size < 300 * 5000 / 4

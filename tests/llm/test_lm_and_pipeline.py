from __future__ import annotations

import collections
import math
import os
import random
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from orrery.llm import decontaminate, maxent_lm, quality, registry, sentencepiece_bpe, simhash, streaming_dedup
from orrery.llm.common import table

DIR = "/root/testdata/sf0.001"


def texts(n: int) -> list[tuple]:
    rnd = random.Random(8)
    en, fr = ["the", "of", "house", "river", "tree"], ["le", "de", "maison", "fleuve", "arbre"]
    return [(i, " ".join(rnd.choice(en if i % 2 else fr) + rnd.choice(["", "", "s", str(rnd.randrange(40))]) for _ in range(rnd.randint(5, 60)))) for i in range(n)]


def test_lm_base_is_exact_and_model_beats_it(spark):
    rows = texts(400) + [(1000, None), (1001, ""), (1001, ""), (None, "The OF"), (1002, "never seen words é É"), (1003, "x " * 30000)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    got = maxent_lm.lm_scores(df).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c: collections.Counter = collections.Counter()
    for i, t in rows:
        if not out(i):
            c.update((t or "").encode().lower().split())
            c["end"] += 1
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), "end"]
        want.append((str(i), out(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_without_training_rows(spark):
    some = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = maxent_lm.lm_scores(spark.createDataFrame([(some, "a b")], "doc_id long, text string")).collect()
    assert got[0]["train_tokens"] == 0 and got[0]["base_score"] == 0.0 and math.isfinite(got[0]["score"])
    assert maxent_lm.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lm_scores_are_those_of_the_model_written_out(spark):
    """score() against plain loops over the trained weights."""
    rows = texts(300)
    df = spark.createDataFrame([(i, False, t) for i, t in rows], "doc_id long, held_out boolean, text string")
    counts = maxent_lm.count_words(df.select("text")).cache()
    lexicon, least = maxent_lm.make_lexicon(counts)
    state = maxent_lm.train(df.select(maxent_lm.share(df.doc_id, df.text, 2).alias("share"), "text"), lexicon, rounds=2)
    got = {r["doc_id"]: r["score"] for r in maxent_lm.score(df, lexicon, state, counts, least).collect()}
    lex, w = maxent_lm._model((lexicon, state))
    t, slots, classes = w.t, maxent_lm.SLOTS, maxent_lm.CLASSES
    soft = lambda z, i: float(z[i] - z.max() - math.log(np.exp((z - z.max()).astype(np.float64)).sum()))
    for i, text in rows[:40]:
        want, past = 0.0, [maxent_lm.START] * 3
        for x in [lex.ids[v] for v in text.encode().lower().split()] + [0]:
            target = int(lex.hist[x])  # every word is listed here
            cls = target // slots if target < slots * classes else target - slots * classes + classes
            pair = (((past[0] * 40503 + past[1] * 30011) & 0xFFFFFFFF) * 2654435761 >> 13) % maxent_lm.PAIR_ROWS
            want += soft(t["c1"][past[0]] + t["c2"][past[1]] + t["c3"][past[2]] + t["pair"][pair] + t["bias"][0], cls)
            if cls < classes:
                w1 = ((past[0] * 31 + cls) * 2654435761 & 0xFFFFFFFF) >> 13
                w2 = ((past[1] * 37 + cls) * 2246822519 & 0xFFFFFFFF) >> 13
                want += soft(t["w1"][w1 % maxent_lm.WORD_ROWS] + t["w2"][w2 % maxent_lm.WORD_ROWS] + t["wbias"][cls], target % slots)
            past = [target, *past[:2]]
        assert abs(got[i] - want / math.log(10)) < 1e-3 * max(1, abs(got[i]))


def test_lm_gain_hardly_hangs_on_the_number_of_tasks(spark):
    """Held-out texts score within two in a hundred (1.5 measured) whether a round has one task or eight."""
    rows = [(i, t) for i, t in texts(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id").cache()
    own = df.select("doc_id", maxent_lm.held_out(df.doc_id).alias("held_out"), "text")
    learn = own.filter("not held_out").select(maxent_lm.share(df.doc_id, df.text).alias("share"), "text")
    counts = maxent_lm.count_words(learn.select("text")).cache()
    lexicon, least = maxent_lm.make_lexicon(counts)
    means = []
    for task_tokens in (10**9, 1):
        state = maxent_lm.train(learn, lexicon, task_tokens)
        r = maxent_lm.score(own, lexicon, state, counts, least).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
        assert r["s"] > r["b"]
        means.append(r["s"] / r["n"])
    assert abs(means[0] - means[1]) < 0.02 * abs(means[0])


def test_changes_of_rare_rows_add_up_and_those_of_frequent_rows_are_averaged():
    one = np.ones(3)
    assert np.allclose(maxent_lm._merged(one, 7, 49), one)  # one task alone
    assert 9 < maxent_lm._merged(one, 10, 10)[0] <= 10  # ten tasks, one touch each
    assert 1 < maxent_lm._merged(one, 1e7, 1e13)[0] < 1.001  # ten tasks, a million each


def test_lm_rows_merge_over_any_batches():
    """Changes of a row may lie in several batches; here against one row at a time."""
    rnd, rows = np.random.default_rng(0), []
    for k, width in (("c1", 64), ("pair", 64), ("w1", 32)):
        rows += [(k, int(i), int(rnd.integers(1, 2000)), float(rnd.random()), rnd.normal(size=width).astype(np.float16)) for i in np.sort(rnd.integers(0, 9, 100))]
    kinds = pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.binary()
    whole = pa.RecordBatch.from_arrays([pa.array([r[i].tobytes() if i == 4 else r[i] for r in rows], t) for i, t in enumerate(kinds)], ["t", "row", "n", "q", "d"])
    for size in (1, 7, 1000):
        out = maxent_lm._merge([whole.slice(i, size) for i in range(0, len(rows), size)])
        got = {(r["t"], r["row"]): r for b in out for r in b.to_pylist()}
        assert sorted(got) == sorted({r[:2] for r in rows})
        for key, r in got.items():
            own = [x for x in rows if x[:2] == key]
            n, n2 = sum(x[2] for x in own), sum(x[2] ** 2 for x in own)
            mean = sum(x[2] * x[4].astype(np.float64) for x in own) / n
            assert np.allclose(np.frombuffer(r["d"], np.float32), maxent_lm._merged(mean, n, n2), rtol=1e-5, atol=1e-6)
            assert abs(r["q"] - sum(x[3] for x in own)) < 1e-9


def test_lm_is_a_distribution():
    """Probabilities of all frequent words and groups after any history sum to one, before and after training."""
    words = [f"w{i}".encode() for i in range(40)]
    lex = maxent_lm.Lexicon(words, list(range(100, 60, -1)), 5000, 90, 50, [3] * 32, [1] * 32).ready()
    t = maxent_lm.Trainer(lex)
    rnd = np.random.default_rng(1)
    targets = np.concatenate([np.arange(lex.frequent), maxent_lm.SLOTS * maxent_lm.CLASSES + np.arange(maxent_lm.GROUPS)])
    for _ in range(5):
        h = rnd.integers(0, maxent_lm.HISTORY, (3, 64))
        t.step(*h, rnd.choice(targets, 64))
    for h1, h2, h3 in ((0, 1, 2), (maxent_lm.START,) * 3, (5, 1030, 7)):
        fill = [np.full(len(targets), x) for x in (h1, h2, h3)]
        assert abs(np.exp(t.w.forward(*fill, targets)[0]).sum() - 1) < 1e-4


def test_lm_words_beyond_the_frequent_ones_follow_their_history(spark):
    """Two words of one ending and one count, beyond the 1,023 frequent ones: that which came after the last word in training has the better score."""
    rnd, common, rows = random.Random(3), [f"c{i}" for i in range(1100)], []
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1][:60]
    for i in train:
        words = rnd.sample(common, len(common))
        rows.append((i, " ".join(" ".join(words[k * 50 : k * 50 + 50]) + f" x{k}yy z{k}qq" for k in range(10)) + " " + " ".join(words[500:])))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1][:20]
    asked = {i: (n % 10, (n + n // 10) % 10) for n, i in enumerate(held)}  # the first ten follow their word, the others another one
    rows += [(i, f"c1 x{a}yy z{b}qq") for i, (a, b) in asked.items()]
    got = {r["doc_id"]: r for r in maxent_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert len({round(got[i]["base_score"], 6) for i in held}) == 1  # all these words are as frequent
    right, wrong = ([got[i]["score"] for i in held[k : k + 10]] for k in (0, 10))
    assert sum(right) / 10 > sum(wrong) / 10 + 0.1


def small_lexicon(listed: int = 1500) -> maxent_lm.Lexicon:
    words, counts = [f"w{i}".encode() for i in range(listed)], list(range(2 * listed, listed, -1))
    return maxent_lm.Lexicon(words, counts, sum(counts) + 900, listed + 90, 500, [3000] * maxent_lm.GROUPS, [90] * maxent_lm.GROUPS).ready()


def test_lm_words_of_many_texts_are_those_of_each():
    """Words, their ids and groups are found for whole columns at once; here against one text and one word at a time."""
    rnd, lex = random.Random(4), small_lexicon()
    parts = ["w3", "W77", "w1499", "w1500", "é", "É", "x", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\u00a0", "\x00"]
    for n in (0, 1, 5, 700):
        rows = [rnd.choice([None, "", " "]) if i % 5 == 0 else "".join(rnd.choices(parts, k=rnd.randrange(30))) for i in range(n)]
        want = [(t or "").encode().lower().split() for t in rows]
        words, lengths = maxent_lm.words_of(pa.array(rows, pa.string()))
        flat = [w for t in want for w in t]
        assert words.to_pylist() == flat and lengths.tolist() == list(map(len, want))
        assert lex.id_of(words).tolist() == [lex.ids[w] for w in flat]
        assert maxent_lm.groups_of(words).tolist() == [maxent_lm.group_of(w) for w in flat]
        batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["text"])
        assert [t for s in maxent_lm.slices(batch) for t in s.column(0).to_pylist()] == rows


def test_lm_slices_hold_whole_groups_of_texts():
    """Steps share the tokens of TEXTS texts, whatever the bytes of a slice."""
    rows = ["x" * 9000] * 1000 + ["y"] * 2000
    parts = [p.num_rows for p in maxent_lm.slices(pa.RecordBatch.from_arrays([pa.array(rows)], ["text"]))]
    assert sum(parts) == 3000 and all(n % maxent_lm.TEXTS == 0 for n in parts[:-1]) and 256 in parts and max(parts) > 1024


def test_lm_forward_needs_little_room():
    """The softmax of a step goes through blocks that fit a core's cache (whole steps took 7 MB at once)."""
    rnd, w = np.random.default_rng(1), maxent_lm.Weights(small_lexicon())
    h = rnd.integers(0, maxent_lm.HISTORY, (3, maxent_lm.STEP_TOKENS))
    target = rnd.integers(0, maxent_lm.START, maxent_lm.STEP_TOKENS)
    whole = w.forward(*h, target)[0]
    tracemalloc.start()
    w.forward(*h, target)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000_000
    assert np.allclose(whole, np.concatenate([w.forward(*h[:, i : i + 500], target[i : i + 500])[0] for i in range(0, len(target), 500)]), atol=1e-5)


def test_lm_step_is_adagrad_by_row():
    """One step of the joined tables against sums written out, with runs of one row and of many."""
    rnd, t = np.random.default_rng(6), maxent_lm.Trainer(small_lexicon())
    for k in t.w.t:
        t.w.t[k][:] += rnd.normal(0, 0.1, t.w.t[k].shape)
    n, slots, classes = 3000, maxent_lm.SLOTS, maxent_lm.CLASSES
    h1, h2, h3 = (np.minimum(rnd.zipf(1.3, (3, n)), maxent_lm.START)).astype(np.int64)
    target = rnd.integers(0, maxent_lm.START, n)
    old = {k: v.astype(np.float64) for k, v in t.w.t.items()}
    t.step(h1, h2, h3, target)
    cls = np.where(target < slots * classes, target // slots, target - slots * classes + classes)
    pair = (((h1 * 40503 + h2 * 30011) & 0xFFFFFFFF) * 2654435761 >> 13) % maxent_lm.PAIR_ROWS
    f = target < slots * classes
    w1 = (((h1 * 31 + cls) * 2654435761 & 0xFFFFFFFF) >> 13) % maxent_lm.WORD_ROWS
    w2 = (((h2 * 37 + cls) * 2246822519 & 0xFFFFFFFF) >> 13) % maxent_lm.WORD_ROWS
    chance = lambda z: np.exp(z) / np.exp(z).sum(1, keepdims=True)
    e = chance(old["c1"][h1] + old["c2"][h2] + old["c3"][h3] + old["pair"][pair] + old["bias"][0]) - np.eye(maxent_lm.WIDTH)[cls]
    g = chance(old["w1"][w1[f]] + old["w2"][w2[f]] + old["wbias"][cls[f]]) - np.eye(slots)[target[f] % slots]
    for k, rows, grad in (("c1", h1, e), ("c2", h2, e), ("c3", h3, e), ("pair", pair, e), ("bias", h1 * 0, e), ("w1", w1[f], g), ("w2", w2[f], g), ("wbias", cls[f], g)):
        total = np.zeros_like(old[k])
        np.add.at(total, rows, grad)
        squares = (total**2).mean(1)
        assert np.allclose(t.acc[k], squares, rtol=1e-3, atol=1e-4)
        assert np.allclose(t.w.t[k], old[k] - maxent_lm.RATE * total / np.sqrt(squares + 1)[:, None], atol=1e-4)
        assert t.touched[k].tolist() == np.bincount(rows, minlength=len(total)).tolist()


def test_lm_sums_of_runs_and_softmax_of_far_rows():
    rnd = np.random.default_rng(5)
    rows = rnd.normal(size=(300, 8)).astype(np.float32)
    starts = np.array([0, 1, 2, 14, 26, 40, 41, 299])
    assert np.allclose(maxent_lm._sums(rows, starts), np.add.reduceat(rows, starts, axis=0), atol=1e-4)
    z = np.array([[0, 1, -1e4], [-500, -501, -1e4], [900, 0, 0]], np.float32)
    _, e, s = maxent_lm._exp(z.copy())
    want = np.exp(z.astype(float) - z.max(1, keepdims=True))
    assert np.allclose(e / s[:, None], want / want.sum(1, keepdims=True))


def test_lm_trees_are_distributions():
    """Without weights the leaves of a group have the chances of their counts; with any weights their chances sum to one."""
    words, rnd = [f"w{i}".encode() for i in range(1500)], np.random.default_rng(2)
    counts = sorted(rnd.integers(1, 500, 1500).tolist(), reverse=True)
    n, v = [0] * maxent_lm.GROUPS, [0] * maxent_lm.GROUPS
    for w, c in zip(words[1023:], counts[1023:], strict=True):
        n[maxent_lm.group_of(w)] += c
        v[maxent_lm.group_of(w)] += 1
    lex = maxent_lm.Lexicon(words, counts, sum(counts) + 40, 1540, 40, [x + 7 for x in n], [x + 3 for x in v]).ready()
    w, listed = maxent_lm.Weights(lex), 1500 + 1 - lex.frequent
    group = np.array([maxent_lm.group_of(x) for x in words[1023:]] + list(range(maxent_lm.GROUPS)))
    leaf = np.arange(listed + maxent_lm.GROUPS)
    total = np.array([x + 7 + 0.5 * (k + 3 + 1) for x, k in zip(n, v, strict=True)])
    mass = np.array([c + 0.5 for c in counts[1023:]] + [7 + 0.5 * (3 + 1)] * maxent_lm.GROUPS)
    keys = [np.full(len(leaf), k, np.uint32) for k in (12345, 678910)]
    chance = lambda: np.exp(lex.tree.base[leaf] + w.leaf_gain(leaf, keys))
    assert np.allclose(chance(), mass / total[group], rtol=1e-4)
    w.t["tree"][:] = rnd.normal(0, 2, w.t["tree"].shape)
    assert np.allclose(np.bincount(group, chance()), 1, rtol=1e-4)
    assert not np.allclose(chance(), mass / total[group], rtol=0.1)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_pipeline_against_plain_versions(spark):
    docs = {r["doc_id"]: r for r in table(spark, DIR, "documents").collect()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DIR).collect()}
    good = {r["doc_id"] for r in quality.judge(table(spark, DIR, "documents"), table(spark, DIR, "labels")).filter("keep").collect()}
    keeper = {}
    for i in sorted(good):
        keeper[docs[i]["text"]] = i
    left = sorted(keeper.values())
    sets = {i: set(simhash.shingle_hashes(docs[i]["text"], 5).tolist()) for i in left}
    parent = {i: i for i in left}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i in left:
        for j in left:
            if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    roots = {find(i) for i in left}
    leaks = {r["doc_id"] for r in decontaminate.contamination(table(spark, DIR, "documents"), table(spark, DIR, "benchmark")).filter("contaminated").collect()}
    assert roots - leaks <= set(got)  # nothing clean is lost
    assert len(set(got) - (roots - leaks)) <= 1  # near copies that the fingerprints may miss
    for i, r in got.items():
        ids, _ = sentencepiece_bpe.encode([docs[i]["text"]], sentencepiece_bpe.model_path())
        assert list(r["ids"]) == ids.tolist() and r["n_tokens"] == len(ids)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df, want = registry.QUERIES[name](spark, DIR), con.sql(registry.ORACLE_SQL[name])
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(map(repr, want.project(", ".join(cols)).fetchall()))


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "benchmark decontamination", "sentencepiece"]
    assert streaming_dedup.STORE["spark.sql.streaming.stateStore.providerClass"].endswith("RocksDBStateStoreProvider")

"""A hashed maximum-entropy language model: n-gram and skip features, class-factored softmax, distributed updates.

log P(word | history) = log P(class | history) + log P(word | class, history). The class softmax has weights for the
last word, the one before it and the one before that (skip features) and a hashed pair (bigram history);
the softmax within a class of frequent words has hashed weights for the last and the second last word. Words outside
the frequent vocabulary form groups by a hash of their ending, each a class with a binary tree whose leaves are its listed words and one
for all the others (see Tree). A tree's decisions start from the counts and have hashed weights for the history, their number set by the
vocabulary. Within the leaf of the others, words follow their counts with add-half smoothing and room for one unknown word, so the model
gives a proper distribution.
Training: the texts are dealt into ROUNDS shares, and each is one distributed update. In a round every task makes AdaGrad steps (one rate for each weight
row) over its part of the share, from the weights that all rounds before gave; the changes of each row are then merged over the tasks (see _merged).
Every training text is used once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import cut, table

END = b""
SLOTS, CLASSES, GROUPS = 32, 32, 32  # words of a class, classes of frequent words, groups of the others
LISTED = 150_000  # words whose counts every worker holds, at most; counts of others are joined
PAIR_ROWS = WORD_ROWS = 8192
STEP_TOKENS, RATE, TASK_TOKENS = 8192, 0.15, 1_000_000
ROUNDS, SETTLED = 8, 100  # distributed updates; touches after which half of what a row has to learn is learnt
WIDTH = CLASSES + GROUPS
LONG = 12  # rows of a run that are added up at once
TEXTS = 256  # texts whose tokens share steps
BLOCK, SLICE_BYTES = 1024, 1 << 21  # tokens whose softmax fits a core's cache; bytes of texts that are split into words at once, in whole TEXTS
TREE_WIDTH, TREE_WEIGHTS = 64, 4  # weights of a row of the trees' table, and how many each listed word brings to it, at least
TABLES = {"c1": WIDTH, "c2": WIDTH, "c3": WIDTH, "pair": WIDTH, "bias": WIDTH, "w1": SLOTS, "w2": SLOTS, "wbias": SLOTS, "tree": TREE_WIDTH}


def slices(batch: pa.RecordBatch, column: int = 0, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of TEXTS rows, or of several times as many while their column has no more than about that many bytes."""
    size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    ends = np.arange(TEXTS, batch.num_rows, TEXTS)
    part = size[ends - 1] // most
    cuts = [0, *ends[np.diff(part, prepend=0) > 0].tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (binary) of all texts, one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    words, n = lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # space at an end of a text leaves an empty word there
    if not full.all():
        words, n = words.filter(pa.array(full)), np.add.reduceat(full.astype(np.int64), np.cumsum(n) - n)  # each text has a word, maybe empty
    return words, n


def group_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % GROUPS


def groups_of(words: pa.Array) -> np.ndarray:
    """group_of() of all words, asked once for each ending."""
    ends = pc.binary_slice(words, -2).dictionary_encode()
    return np.array([group_of(w) for w in ends.dictionary.to_pylist()], np.int64).take(ends.indices.to_numpy())


@dataclass
class Lexicon:
    """Listed words by falling count; the first SLOTS * CLASSES - 1 of them and the end token are slots of classes, the others leaves of trees."""

    words: list[bytes]
    counts: list[int]
    n: int
    v: int
    end: int
    group_n: list[int]
    group_v: list[int]
    listed: pa.Array | None = field(default=None, repr=False)

    @property
    def frequent(self) -> int:
        return min(SLOTS * CLASSES, len(self.words) + 1)

    @property
    def tree_bits(self) -> int:
        """Binary logarithm of the number of weights of the trees."""
        return max(12, (TREE_WEIGHTS * (len(self.words) + 1 - self.frequent)).bit_length())

    @property
    def rows(self) -> dict[str, int]:
        return ROWS | {"tree": (1 << self.tree_bits) // TREE_WIDTH}

    @cached_property
    def ids(self) -> dict[bytes, int]:
        """Id of a word: 0 the end token, listed words from 1, -1 - group for the rest. id_of() gives those of many words."""
        return _Ids(zip(self.words, range(1, len(self.words) + 1), strict=True))

    def id_of(self, words: pa.Array) -> np.ndarray:
        found = pc.index_in(words, value_set=self.listed).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        far = np.flatnonzero(found == 0)
        found[far] = -1 - groups_of(words.take(pa.array(far)))
        return found

    def ready(self) -> Lexicon:
        if self.listed is None:
            self.listed = pa.array(self.words, pa.binary())
            f = self.frequent
            own = np.array([self.end, *self.counts], np.float64)
            # By id; the last GROUPS entries are those of the negative ids.
            self.half = np.concatenate((np.log10(own + 0.5), np.zeros(GROUPS)))
            self.base_rest = float(np.log10(self.n + 0.5 * (self.v + 1)))
            groups = np.concatenate((np.zeros(f, np.int64), groups_of(self.listed.slice(f - 1))))
            # History and class ids: f frequent words, then groups, then the start of a text.
            self.hist = np.concatenate((np.where(np.arange(len(own)) < f, np.arange(len(own)), SLOTS * CLASSES + groups), SLOTS * CLASSES + np.arange(GROUPS)[::-1])).astype(np.int64)
            rest_n = np.array(self.group_n, np.float64)
            rest_v = np.array(self.group_v, np.float64)
            rest = np.log10(rest_n + 0.5 * (rest_v + 1))
            self.within = np.where(self.hist < SLOTS * CLASSES, 0.0, self.half - rest[np.maximum(self.hist - SLOTS * CLASSES, 0)])  # log10 of a word's part of its group
            self.tree = Tree(own[f:], groups[f:], rest_n, rest_v)
            mass = np.full(WIDTH, 0.0)
            slots = np.full(SLOTS * CLASSES, -np.inf)
            slots[:f] = np.log(own[:f] + 0.5)
            filled = np.exp(slots).reshape(CLASSES, SLOTS).sum(1)
            mass[:CLASSES], mass[CLASSES:] = filled, rest_n + 0.5 * (rest_v + 1)
            self.bias0 = np.where(mass > 0, np.log(np.maximum(mass, 1e-300) / mass.sum()), -1e4).astype(np.float32)
            self.wbias0 = np.where(np.isfinite(slots), slots, -1e4).astype(np.float32).reshape(CLASSES, SLOTS)
        return self


class Tree:
    """A binary tree for each group: leaves are the listed words (by listed id, less the frequent ones), then a leaf of all other words for each group.

    Leaves lie on a line by group and count, each as long as its mass (count and a half); a tree halves the group's part again and again until
    each leaf is alone. With weights of zero a decision has the chance of its masses, so that the leaves follow their counts exactly.
    """

    def __init__(self, counts: np.ndarray, groups: np.ndarray, rest_n: np.ndarray, rest_v: np.ndarray):
        listed = len(counts)
        others = rest_n - np.bincount(groups, counts, GROUPS) + 0.5 * (rest_v - np.bincount(groups, minlength=GROUPS) + 1)
        mass, group = np.concatenate((counts + 0.5, np.maximum(others, 0.5))), np.concatenate((groups, np.arange(GROUPS)))
        total = np.bincount(group, mass, GROUPS)
        self.base = np.log(mass / total[group])
        leaf = np.argsort(group, kind="stable")
        m, g = mass[leaf], group[leaf]
        start = np.concatenate(([0.0], np.cumsum(total)))[g]
        x = np.clip((np.cumsum(m) - m / 2 - start) / total[g], 0, 1 - 1e-12)
        found, nodes, live = [], 0, np.arange(len(leaf))
        for depth in range(50):
            part = np.floor(x[live] * 2.0**depth).astype(np.int64)
            bit = np.floor(x[live] * 2.0 ** (depth + 1)).astype(np.int64) - 2 * part
            new = np.concatenate(([True], (part[1:] != part[:-1]) | (g[live][1:] != g[live][:-1])))
            at, seg = np.flatnonzero(new), np.cumsum(new) - 1
            size, right = np.diff(np.append(at, len(live))), np.add.reduceat(bit, at)
            both = (right > 0) & (right < size)
            high = np.add.reduceat(m[live] * bit, at)
            low = np.add.reduceat(m[live] * (1 - bit), at)
            odds = np.log(np.where(both, high, 1.0) / np.where(both, low, 1.0))
            name = nodes + np.cumsum(both) - 1
            nodes += int(both.sum())
            k = both[seg]
            sign = (2 * bit - 1)[k].astype(np.float32)
            found.append((leaf[live[k]], name[seg[k]], sign, (odds[seg[k]] * sign).astype(np.float32)))
            live = live[size[seg] > 1]
            if not len(live):
                break
        of, name, sign, odds = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(of, kind="stable")
        self.first = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=listed + GROUPS))))
        self.decisions = np.zeros((len(order), 4), np.float32)  # 16 bytes each, so that one take gets all of a decision: node, sign, signed odds
        self.decisions.view(np.uint32)[:, 0], self.decisions[:, 1], self.decisions[:, 2] = _mix(name[order]), sign[order], odds[order]

    def path(self, leaf: np.ndarray):
        """Nodes, signs and signed log odds of the decisions on the way to the leaves, one after another, and to which of the leaves each belongs."""
        first = self.first.take(leaf)
        n = self.first.take(leaf + 1) - first
        of = np.repeat(np.arange(len(leaf)), n)
        found = self.decisions.take(np.arange(len(of)) + (first - (np.cumsum(n) - n)).take(of), axis=0)
        return found.view(np.uint32)[:, 0], found[:, 1], found[:, 2], of


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return -1 - zlib.crc32(word[-2:]) % GROUPS  # as group_of()


HISTORY = SLOTS * CLASSES + GROUPS + 1
START = HISTORY - 1
JOINED = ("c1", "c2", "c3", "pair"), ("bias",), ("w1", "w2", "wbias"), ("tree",)  # tables whose rows a step changes together
ROWS = {"c1": HISTORY, "c2": HISTORY, "c3": HISTORY, "pair": PAIR_ROWS, "bias": 1, "w1": WORD_ROWS, "w2": WORD_ROWS, "wbias": CLASSES}


def _exp(z: np.ndarray):
    """z, made less a maximum in place where it would be too large, its exponentials and their sums by row; one maximum for all rows, if no row lies too far below it."""
    one = np.ones(z.shape[1], np.float32)
    if abs(top := z.max(initial=-1e4)) > 60:
        z -= top
    e = np.exp(z)
    s = e @ one
    if s.size and not s.min() > 1e-25:
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        s = e @ one
    return z, e, s


def _softmax(table: np.ndarray, rows: np.ndarray, bias: np.ndarray | None, right: np.ndarray, grad: np.ndarray | None = None) -> np.ndarray:
    """Natural log probabilities of the right columns, from the softmax of sums of table rows (rows: one line a term). grad takes its gradient."""
    logp = np.empty(len(right))
    for i in range(0, len(right), BLOCK):
        s = slice(i, i + BLOCK)
        z = table.take(rows[0, s], axis=0)
        for at in rows[1:, s]:
            z += table.take(at, axis=0)
        if bias is not None:
            z += bias
        z, e, total = _exp(z)
        own = np.arange(len(z)), right[s]
        logp[s] = z[own] - np.log(total)
        if grad is not None:
            np.multiply(e, (1 / total)[:, None], out=grad[s])
            grad[s][own] -= 1
    return logp


class Weights:
    """The tables of weights by name. Those of one softmax lie one after another in one array, so that one step changes them together."""

    def __init__(self, lex: Lexicon):
        self.lex, self.t, self.joined = lex, {}, {}
        for names in JOINED:
            ends = np.cumsum([lex.rows[k] for k in names]).tolist()
            self.joined[names] = all_rows = np.zeros((ends[-1], TABLES[names[0]]), np.float32)
            self.t |= {k: all_rows[end - lex.rows[k] : end] for k, end in zip(names, ends, strict=True)}
        self.t["bias"][0] = lex.bias0
        self.t["wbias"][:] = lex.wbias0

    def rows(self, h1, h2, h3, cls):
        """Rows of the joined tables: for the class of each token; which tokens are frequent words, and for their slots."""
        pair = ((h1 * 40503 + h2 * 30011) & 0xFFFFFFFF) * 2654435761 >> 13 & PAIR_ROWS - 1
        f = np.flatnonzero(cls < CLASSES)
        c = cls[f]
        w1 = ((h1[f] * 31 + c) * 2654435761 & 0xFFFFFFFF) >> 13 & WORD_ROWS - 1
        w2 = ((h2[f] * 37 + c) * 2246822519 & 0xFFFFFFFF) >> 13 & WORD_ROWS - 1
        return np.stack((h1, h2 + HISTORY, h3 + 2 * HISTORY, pair + 3 * HISTORY)), f, np.stack((w1, w2 + WORD_ROWS, c + 2 * WORD_ROWS))

    def forward(self, h1, h2, h3, target, grads: tuple = (None, None)):
        """Natural log probabilities of targets (history ids: a frequent word or a group) and the rows they hang on. grads take the gradients of both softmaxes."""
        cls = np.where(target < SLOTS * CLASSES, target // SLOTS, target - SLOTS * CLASSES + CLASSES)
        rows, f, slot_rows = where = self.rows(h1, h2, h3, cls)
        classes, _, slots, _ = self.joined.values()
        logp = _softmax(classes, rows, self.t["bias"][0], cls, grads[0])
        logp[f] += _softmax(slots, slot_rows, None, target[f] % SLOTS, None if grads[1] is None else grads[1][: len(f)])
        return logp, where

    def decide(self, leaf, keys):
        """The signed log odds of all decisions on the way to the leaves after histories of these keys, to which leaf each belongs, its sign, and
        the places and values of its weights (a line for each key)."""
        node, sign, odds, of = self.lex.tree.path(leaf)
        places, shift = np.empty((len(keys), len(of)), np.int64), np.uint32(32 - self.lex.tree_bits)
        for line, k in zip(places, keys, strict=True):
            at = k.take(of)
            at ^= node
            at *= np.uint32(0x9E3779B1)
            line[:] = np.right_shift(at, shift, out=at)
        own = self.t["tree"].reshape(-1).take(places)
        z = own.sum(0)
        z *= sign
        z += odds
        return z, of, sign, places, own

    def leaf_gain(self, leaf, keys):
        """By how much the natural log probability of the leaves within their groups is above that of their counts."""
        z, of, _, _, _ = self.decide(leaf, keys)
        loss = np.maximum(-z, 0)
        loss += np.log(1 + np.exp(-np.abs(z)))
        return -np.bincount(of, loss, len(leaf)) - self.lex.tree.base[leaf]


def _sums(rows: np.ndarray, starts: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Sums of the runs of rows (taken in this order) that begin at starts: long ones at once, short ones by adding their first, second, ... rows."""
    order = np.arange(len(rows)) if order is None else order
    n = np.diff(np.append(starts, len(order)))
    out, one = np.empty((len(starts), rows.shape[1]), rows.dtype), np.ones(n.max(initial=0), rows.dtype)
    long = np.flatnonzero(n > LONG)
    for i, at, k in zip(long.tolist(), starts[long].tolist(), n[long].tolist(), strict=True):
        np.dot(one[:k], rows.take(order[at : at + k], axis=0), out=out[i])
    short = np.flatnonzero(n <= LONG)
    short = short[np.argsort((LONG - n[short]).astype(np.uint8), kind="stable")]  # those of most rows first
    at, n = starts[short], n[short]
    sums = rows.take(order.take(at), axis=0)
    for k in range(1, LONG):
        more = int(np.count_nonzero(n > k))
        if not more:
            break
        sums[:more] += rows.take(order.take(at[:more] + k), axis=0)
    out[short] = sums
    return out


def _step(table: np.ndarray, acc: np.ndarray, touched: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
    """An AdaGrad step of the table; the gradient of token i goes to the rows rows[:, i]."""
    if not rows.size:
        return
    if len(table) == 1:
        u, n, g = np.zeros(1, np.int64), rows.size, np.ones((1, len(grad)), grad.dtype) @ grad
    else:
        order = np.argsort(rows.reshape(-1).astype(np.uint16), kind="stable")  # no table has more rows; two bytes are sorted by radix
        sorted_rows = rows.reshape(-1).take(order)
        starts = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1])))
        g = _sums(grad, starts, np.tile(np.arange(len(grad)), len(rows)).take(order))
        u, n = sorted_rows.take(starts), np.diff(np.append(starts, len(order)))
    squares = acc.take(u) + np.einsum("ij,ij->i", g, g) / g.shape[1]
    acc[u] = squares
    g *= (RATE / np.sqrt(squares + 1.0))[:, None]
    table[u] = table.take(u, axis=0) - g
    touched[u] += n


class Trainer:
    """Steps over one task's texts, from the weights and squared gradients of the rounds before."""

    def __init__(self, lex: Lexicon, state: State | None = None):
        self.w, self.acc, self.touched, self.joined = Weights(lex), {}, {}, []
        for names, table in self.w.joined.items():
            acc, touched = np.zeros(len(table), np.float32), np.zeros(len(table), np.int64)
            self.joined.append((table, acc, touched))
            at = np.cumsum([0, *(len(self.w.t[k]) for k in names)])
            for k, a, b in zip(names, at, at[1:], strict=False):
                self.acc[k], self.touched[k] = acc[a:b], touched[a:b]
        for k, v in self.w.t.items():
            if state:
                v += state[k][0]
                self.acc[k] += state[k][1]
        self.first = {k: v.copy() for k, v in self.w.t.items()}
        self.acc0 = {k: v.copy() for k, v in self.acc.items()}
        self.grad = np.zeros(self.w.t["tree"].size, np.float32)
        self.grads = np.empty((STEP_TOKENS, WIDTH), np.float32), np.empty((STEP_TOKENS, SLOTS), np.float32)

    def step(self, h1, h2, h3, target) -> None:
        n = len(target)
        e, g = (x[:n] for x in self.grads)
        _, (rows, f, slot_rows) = self.w.forward(h1, h2, h3, target, (e, g))
        classes, bias, slots, _ = self.joined
        for joined, at, grad in ((classes, rows, e), (bias, np.zeros((1, n), np.int64), e), (slots, slot_rows, g[: len(f)])):
            _step(*joined, at, grad)

    def learn(self, ids, target, h) -> None:
        """Steps over flat texts, as histories() gives them."""
        h1, h2, h3 = h
        at, leaf, keys = leaves(self.w.lex, ids, target, h1, h2)
        for i in range(0, len(target), STEP_TOKENS):
            s = slice(i, i + STEP_TOKENS)
            self.step(h1[s], h2[s], h3[s], target[s])
            t = slice(*np.searchsorted(at, (i, i + STEP_TOKENS)))
            self.step_trees(leaf[t], [k[t] for k in keys])

    def step_trees(self, leaf, keys) -> None:
        if not len(leaf):
            return
        z, _, sign, places, own = self.w.decide(leaf, keys)
        g = -sign / (1 + np.exp(np.minimum(z, 60)))
        p, own, g = places.reshape(-1), own.reshape(-1), np.concatenate([g] * len(keys))
        row, grad, acc, flat = p >> TREE_WIDTH.bit_length() - 1, self.grad, self.acc["tree"], self.w.t["tree"].reshape(-1)
        np.add.at(grad, p, g)
        total = grad.take(p)  # of a weight's gradients, at each of them: so the sum of g * total is that of squared totals
        grad[p] = 0
        g *= total
        acc += np.bincount(row, g, len(acc)) / TREE_WIDTH
        total *= (RATE / np.sqrt(acc + 1.0)).astype(np.float32).take(row)  # a row's rate is that of its weights' mean
        own -= np.clip(total, -RATE, RATE, out=total)
        flat[p] = own
        self.touched["tree"] += np.bincount(row, minlength=len(acc))

    def changes(self):
        """(table, rows, touches, squared gradients, changes as float16) of every touched row, by parts of tables. Touches of a row of the trees are those of a weight of it."""
        for k, t in self.w.t.items():
            touched = np.flatnonzero(self.touched[k])
            for i in range(0, len(touched), 4096):
                at = touched[i : i + 4096]
                n = self.touched[k][at]
                yield k, at, -(-n // TREE_WIDTH) if k == "tree" else n, (self.acc[k] - self.acc0[k])[at], (t[at] - self.first[k][at]).astype(np.float16)


#: By table: the change of the weights since the unigram model, and the summed squared gradients of each row.
State = dict[str, tuple[np.ndarray, np.ndarray]]


def _merged(mean: np.ndarray, n: float, n2: float) -> np.ndarray:
    """The change of a row from the mean of its tasks' changes, weighted by touches; n, n2: sums of touches and of their squares.

    A row that has been touched x times has gone about x / (x + SETTLED) of its way. So the changes of rare rows add up over the tasks, and those of
    frequent rows, which every task has learnt by itself, are averaged.
    """
    own = n2 / n
    return mean * (n * (own + SETTLED) / (own * (n + SETTLED)))


def _tables(batch: pa.RecordBatch):
    """(table, rows, touches, squared gradients, changes) of each table in a batch of changes() that is sorted by table."""
    names, d = batch.column(0).dictionary_encode(), batch.column(4).cast(pa.binary())
    at, n, q = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
    ends = np.frombuffer(d.buffers()[1], np.int32, len(d) + 1, d.offset * 4)
    codes = names.indices.to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            change = np.frombuffer(d.buffers()[2], np.float16, (ends[b] - ends[a]) // 2, ends[a])
            yield names.dictionary[int(codes[a])].as_py(), at[a:b], n[a:b], q[a:b], change.reshape(b - a, -1).astype(np.float64)


def _row_batch(k: str, sums: list[np.ndarray]) -> pa.RecordBatch:
    """(t, row, d, q) from rows of a table, the sums of their changes by touches, of touches, of squared touches and of squared gradients."""
    at, total, n, n2, q = sums
    d = _merged(total / n[:, None], n[:, None], n2[:, None]).astype(np.float32)
    ends = np.arange(len(at) + 1, dtype=np.int32) * (4 * d.shape[1])
    changes = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(d.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at, pa.int32()), changes, pa.array(q, pa.float64())], ["t", "row", "d", "q"])


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, row, d, q) of each row, merged over the tasks, from their changes() sorted by table and row."""
    held = None  # sums of the last row, which may go on in the next batch
    for batch in batches:
        for k, at, n, q, d in _tables(batch):
            starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            n = n.astype(np.float64)
            sums = [np.add.reduceat(x, starts) for x in (n, n * n, q)]
            now = [at[starts], _sums(d * n[:, None], starts), *sums]
            if held and held[0] == k and held[1][0][0] == at[0]:
                for x, y in zip(now[1:], held[1][1:], strict=True):
                    x[0] += y[0]
            elif held:
                yield _row_batch(*held)
            yield from (_row_batch(k, [x[:-1] for x in now]),) if len(starts) > 1 else ()
            held = k, [x[-1:] for x in now]
    if held:
        yield _row_batch(*held)


def histories(lex: Lexicon, words: pa.Array, lengths: np.ndarray):
    """Flat ids (listed or -1 - group) of texts given by words_of(), their history ids and three words of history, and the bounds of the texts."""
    n = lengths + 1
    ends = np.cumsum(n)
    ids = np.zeros(int(ends[-1]), np.int64)
    inner = np.ones(len(ids), bool)
    inner[ends - 1] = False
    ids[inner] = lex.id_of(words)
    target = lex.hist.take(ids)
    at = np.arange(len(ids)) - np.repeat(ends - n, n)
    h = []
    for k in (1, 2, 3):
        past = np.full(len(ids), START, np.int64)
        past[k:] = np.where(at[k:] >= k, target[:-k], START) if len(ids) > k else past[k:]
        h.append(past)
    return ids, target, h, np.concatenate(([0], ends))


def leaves(lex: Lexicon, ids: np.ndarray, target: np.ndarray, h1: np.ndarray, h2: np.ndarray):
    """Where the words of groups are, their leaves, and two keys of their histories: the last word's history id; the last listed word itself,
    or the two last history ids where the last word has one of its own."""
    at = np.flatnonzero(target >= SLOTS * CLASSES)
    w, a, b, last = ids[at], h1[at], h2[at], ids[np.maximum(at, 1) - 1]
    leaf = np.where(w >= 0, w - lex.frequent, len(lex.words) + 1 - lex.frequent - 1 - w)
    own = (a >= SLOTS * CLASSES) & (a != START) & (last >= 0)
    return at, leaf, (_mix(a + 1), _mix(np.where(own, HISTORY * (HISTORY + 1) + last, HISTORY * (a + 1) + b)))


_KEPT: dict = {}


def _local(shared, make):
    """make(shared.value), once a process for each broadcast."""
    if shared.id not in _KEPT:
        _KEPT.clear()
        _KEPT[shared.id] = make(shared.value)
    return _KEPT[shared.id]


class _Shared:
    """A broadcast with an id that workers can use as a key."""

    def __init__(self, spark: SparkSession, value):
        import uuid

        self.id, self._b = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._b.value


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, grp, c) over texts(text); the end token is the empty word."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, most=4 * SLICE_BYTES):
                seen = words_of(part.column(0))[0].value_counts()
                words, n = seen.field("values"), seen.field("counts")
                words, n = pa.concat_arrays([words, pa.array([END], pa.binary())]), pa.concat_arrays([n, pa.array([part.num_rows], pa.int64())])
                yield pa.RecordBatch.from_arrays([words, pa.array(groups_of(words).astype(np.int32)), n], ["word", "grp", "c"])

    return texts.mapInArrow(work, "word binary, grp int, c long").groupBy("word", "grp").agg(F.sum("c").alias("c"))


def make_lexicon(counts: DataFrame, listed: int = LISTED) -> tuple[Lexicon, int]:
    """The lexicon, and the count from which words are listed in it."""
    end = F.col("word") == F.lit(b"")
    sizes = counts.filter(~end).groupBy("c").count().orderBy(F.desc("c")).limit(listed).collect()
    least, n = 1 << 62, 0
    for c, k in sizes:
        if n + k > listed:
            break
        least, n = c, n + k
    rows = counts.filter(~end & (F.col("c") >= least)).select("word", "c").toPandas()
    rows = sorted(zip(rows["c"].tolist(), map(bytes, rows["word"]), strict=True), key=lambda r: (-r[0], r[1]))
    total = counts.select(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(end, F.col("c"))), F.lit(0))).first()
    words, cs = [w for _, w in rows], [c for c, _ in rows]
    group_n, group_v = [0] * GROUPS, [0] * GROUPS
    for g, gn, gv in counts.filter(~end).groupBy("grp").agg(F.sum("c"), F.count(F.lit(1))).collect():
        group_n[g], group_v[g] = gn, gv
    for w, c in zip(words[: SLOTS * CLASSES - 1], cs, strict=False):
        g = group_of(w)
        group_n[g], group_v[g] = group_n[g] - c, group_v[g] - 1
    return Lexicon(words, cs, total[0], total[1], total[2], group_n, group_v), least


def train(texts: DataFrame, lexicon: Lexicon, task_tokens: int = TASK_TOKENS, rounds: int = ROUNDS) -> State:
    """Train on texts(share, text), a share from 0 to rounds - 1 in each round; as many tasks as a round has times task_tokens."""
    spark = texts.sparkSession
    shared = _Shared(spark, lexicon)
    state: State = {k: (np.zeros((n, TABLES[k]), np.float32), np.zeros(n, np.float32)) for k, n in lexicon.rows.items()}
    tasks = max(1, -(-lexicon.n // (task_tokens * rounds)))
    n = min(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def learn(before):
        def work(batches):
            lex = _local(shared, Lexicon.ready)
            trainer = None
            for batch in batches:
                for part in slices(batch):
                    trainer = trainer or Trainer(lex, before.value)
                    ids, target, h, bounds = histories(lex, *words_of(part.column(0)))
                    for i in range(0, part.num_rows, TEXTS):
                        s = slice(bounds[i], bounds[min(i + TEXTS, part.num_rows)])
                        trainer.learn(ids[s], target[s], [x[s] for x in h])
            for k, at, touches, squares, d in trainer.changes() if trainer else ():
                ends = np.arange(len(at) + 1, dtype=np.int32) * d[0].nbytes
                cols = [pa.array([k] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(touches), pa.array(squares.astype(np.float64))]
                cols.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(d.tobytes())]))
                yield pa.RecordBatch.from_arrays(cols, ["t", "row", "n", "q", "d"])

        return work

    for r in range(rounds):
        before = spark.sparkContext.broadcast(state)
        each = texts.filter(F.col("share") == r).select("text").coalesce(tasks).mapInArrow(learn(before), "t string, row int, n long, q double, d binary")
        merged = each.repartition(n, "t", "row").sortWithinPartitions("t", "row").mapInArrow(_merge, "t string, row int, d binary, q double").toPandas()
        for k, rows in merged.groupby("t"):
            at = rows["row"].to_numpy()
            state[k][0][at] += np.stack([np.frombuffer(d, np.float32) for d in rows["d"]])
            state[k][1][at] += rows["q"].to_numpy(np.float32)
        before.unpersist()
    return state


def _model(value: tuple) -> tuple[Lexicon, Weights]:
    lex, state = value
    w = Weights(lex.ready())
    for k, (change, _) in state.items():
        w.t[k] += change
    return lex, w


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<binary>"


def score(docs: DataFrame, lexicon: Lexicon, state: State, counts: DataFrame, least: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs(doc_id, held_out, text)."""
    spark = docs.sparkSession
    shared = _Shared(spark, (lexicon, state))

    def work(batches):
        from pyspark import TaskContext

        lex, w = _local(shared, _model)
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, 2):
                words, lengths = words_of(part.column(2))
                ids, target, (h1, h2, h3), bounds = histories(lex, words, lengths)
                logp = np.concatenate([w.forward(h1[i : i + 8192], h2[i : i + 8192], h3[i : i + 8192], target[i : i + 8192])[0] for i in range(0, len(ids), 8192)]) / np.log(10)
                logp += lex.within.take(ids)
                within, leaf, keys = leaves(lex, ids, target, h1, h2)
                for i in range(0, len(within), 4096):
                    s = slice(i, i + 4096)
                    logp[within[s]] += w.leaf_gain(leaf[s], [k[s] for k in keys]) / np.log(10)
                base = lex.half.take(ids) - lex.base_rest
                known = (ids > 0) | ((ids == 0) & (lex.end > 0))
                far = np.flatnonzero(ids < 0)
                doc = np.searchsorted(bounds, far, side="right") - 1
                rest = words.take(pa.array(far - doc))  # an end token stands after each text before
                s = bounds[:-1]
                k = part.num_rows
                cols = [pa.array(np.arange(rid, rid + k)), part.column(0), part.column(1), pa.array(np.diff(bounds)), pa.array(np.add.reduceat(known.astype(np.int64), s)), pa.array(np.add.reduceat(base, s)), pa.array(np.add.reduceat(logp, s))]
                cols.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(k + 1)).astype(np.int32)), rest))
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCORED.split(", ")])
                rid += k

    scored = cut(docs.select("doc_id", "held_out", "text").mapInArrow(work, SCORED), "lm-scored")
    rest = scored.select("rid", F.explode("rest").alias("word"))
    seen = counts.filter((F.col("c") < least) & (F.col("word") != F.lit(b""))).select("word", "c")
    sums = rest.join(seen, "word", "left").groupBy("rid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.count("c").alias("hits"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("rest").join(sums, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("hits", F.lit(0))).alias("n_known"), F.lit(lexicon.n).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def share(doc_id: Column, text: Column, rounds: int = ROUNDS) -> Column:
    """The round in which a text is learnt from: by its id, without one by the text."""
    return F.pmod(F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id)), F.lit(rounds))


def lm_scores(docs: DataFrame, fold: int = 1) -> DataFrame:
    """Train on the documents outside the held-out fold and score all of them.

    Null and empty texts are the end token alone; a null doc_id is a training row; repeated rows count and score each
    for itself. No training rows: all words unknown, scores finite. Further columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), fold=fold).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    learn = own.filter(~F.col("held_out"))
    counts = cut(count_words(learn.select("text")), "lm-counts")
    lexicon, least = make_lexicon(counts)
    rounds = max(1, min(ROUNDS, lexicon.n // STEP_TOKENS))  # a round has a whole step's tokens, however small the corpus
    state = train(learn.select(share(F.col("doc_id"), F.col("text"), rounds).alias("share"), "text"), lexicon, rounds=rounds)
    return score(own, lexicon, state, counts, least)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))

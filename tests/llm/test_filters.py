"""Decontamination, URL filter, quality classifier and licences."""

from __future__ import annotations

import hashlib
import random
import re
from pathlib import Path

import pytest

from orrery.llm import decontaminate, licences, quality, url_filter


def plain_contamination(docs, items, window=10):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for o in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[o : o + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[tuple(w[s : s + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("literal", [decontaminate.LITERAL_WORDS, 0])
@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_BYTES, 0])
def test_contamination_equals_brute_force(spark, monkeypatch, literal, broadcast):
    monkeypatch.setattr(decontaminate, "LITERAL_WORDS", literal)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    rnd = random.Random(1)
    vocab = ["a", "b", "É", "été", "x1", "2"]
    text = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "-", "\n", "! "]) for _ in range(n))
    items = [(1, text(14)), (2, text(3)), (10, text(10)), (3, ""), (4, None), (None, "A b"), (2, text(12)), (5, "!!!")]
    docs = [(i, text(rnd.randint(0, 40))) for i in range(25)] + [(100, None), (None, items[0][1].upper()), (7, "b a " + items[2][1] + items[2][1]), (7, "b a " + items[2][1] + items[2][1]), (8, items[0][1][: len(items[0][1]) // 2])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int")
    got = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_contamination(docs, items)


def test_contamination_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in decontaminate.contamination(docs, items).collect()] == [False]
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


PAGES = [
    (1, "http://A.net/x", None), (2, "https://b.example.net/en/1?q#f", ""), (3, "http://example.com/de/", ""), (4, "http://notexample.com/de/", ""), (5, "http://w.org/fr/1", ""), (6, None, None),
    (7, "no scheme", ""), (8, "http://plain.com", ""), (9, "http://alias.com/1", '<link rel="canonical" href="http://a.net/x">'), (10, "http://alias.com/2", '<LINK href=/1 rel=canonical>'),
    (11, "http://mixed.com/1", '<meta http-equiv="refresh" content="0; url=http://a.net/y">'), (12, "http://mixed.com/2", '<link href="http://mixed.com/1" rel="canonical"/>'), (13, "http://w.org/fr/ok", "<link rel=canonical href='http://mixed.com/2'>"),
    (2, "https://b.example.net/en/1?q#f", ""),
]


@pytest.mark.parametrize("as_table", [False, True])
def test_urls(spark, as_table):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, verdict string")
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string") if as_table else url_filter.RULES
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(df, rules).collect()}
    assert got == {
        1: ("a.net", "/x", "net/", "block"), 2: ("b.example.net", "/en/1", "example.net/en/", "allow"), 3: ("example.com", "/de/", "example.com/de/", "block"), 4: ("notexample.com", "/de/", None, "allow"),
        5: ("w.org", "/fr/1", "org/fr/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("plain.com", "", None, "allow"), 9: ("alias.com", "/1", None, "block"), 10: ("alias.com", "/2", None, "block"),
        11: ("mixed.com", "/1", None, "allow"), 12: ("mixed.com", "/2", None, "allow"), 13: ("w.org", "/fr/ok", "org/fr/", "allow"),
    }
    more = spark.createDataFrame([("http://plain.com", "http://hop.com/"), ("http://hop.com/", "http://z.net/")], "url string, target string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(df, rules, more).collect()}[8] == "block"
    assert url_filter.url_verdicts(df.limit(0), rules).count() == 0


def synthetic(n: int, seed: int):
    rnd = random.Random(seed)
    good = lambda: " ".join(rnd.choice(["the", "house", "river", "of", "walks", "and", "green", "hill,", "day."]) for _ in range(60))
    bad = [lambda: "spam " * 60, lambda: good().upper().replace(" ", "!! "), lambda: good().replace(" ", "### ")]
    return [(i, rnd.choice(bad)() if i % 4 == 0 else good(), f"site{i % 5}", "en", int(i % 4 != 0)) for i in range(n)]


def test_quality_on_held_out_rows(spark):
    rows = synthetic(400, 3)
    docs = spark.createDataFrame([(*r[:4], "x") for r in rows], "doc_id long, text string, source string, lang string, keep string")
    labels = spark.createDataFrame([(r[0], r[4], 0) for r in rows[:200]] + [(None, 1, 0), (3, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in quality.judge(docs, labels).collect()}
    assert sum(got[r[0]] == bool(r[4]) for r in rows[200:]) >= 198
    odd = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (None, "x", "s", "l")], "doc_id long, text string, source string, lang string")
    assert quality.judge(odd, labels).count() == 3
    assert [r["keep"] for r in quality.judge(odd, labels.limit(0)).collect()] == [True] * 3
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_site_rates_shrink(spark):
    rows = [("big", "p", 1.0)] * 300 + [("bad", "p", 0.0)] * 300 + [("tiny", "p", 0.0)]
    rates = {r["host"]: r["path_rate"] for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"), 0.5).collect()}
    assert rates["bad"] < 0.05 < rates["tiny"] < rates["big"] and rates["big"] > 0.95


def test_licences(spark):
    mit = licences.MIT
    rows = [
        (1, mit, "MIT"), (2, f"The MIT License (MIT)\r\n\r\nCopyright (c) 2020 Someone\n\n{mit.upper()}\n", "MIT"), (3, mit + " More.", None), (4, "Licenced under CC BY-NC 4.0!", None), (5, "licensed under cc by nc 4 0", "CC-BY-NC-4.0"),
        (6, None, None), (7, "", None), (8, "!!!", None), (9, "This work is licensed under the GNU General Public Licence, version 3.", "GPL-3.0-only"), (1, mit, "MIT"),
        (10, f"(c) 2021 A. Person\nCopyright The Authors\n{mit}", "MIT"), (11, f"(c) You must retain notices\n{mit}", None), (12, mit.replace("sublicense", "sub-license"), "MIT"), (13, "x " * 50_000 + mit, None),
    ]
    df = spark.createDataFrame([(*r[:2], "x") for r in rows], "doc_id long, text string, licence_id string")
    want = sorted(((r[0], r[2]) for r in rows), key=str)
    known = spark.createDataFrame([(k, t) for k, ts in licences.KNOWN.items() for t in ts], "licence_id string, text string")
    for k in (licences.KNOWN, known):
        assert sorted(((r["doc_id"], r["licence_id"]) for r in licences.scan(df, k).collect()), key=str) == want
    assert licences.scan(df.limit(0), licences.KNOWN).count() == 0


def test_digests_of_published_licences(spark):
    """Whole published texts, where this machine has them, in other case, layout and spelling, and what only looks like them."""
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0"}
    rows = [("none", None, None), ("notice", "Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0")]
    for name, want in files.items():
        if (folder / name).exists():
            text = (folder / name).read_text("utf-8", "replace")
            rows += [(name, text, want), (name + " upper", "Copyright (c) 2019 A. Person\n" + text.upper().replace("\n", "\r\n  "), want), (name + " more", text + "\nOne more clause.", None)]
            if "END OF TERMS AND CONDITIONS" in text:
                rows.append((name + " terms", text[: text.index("END OF TERMS")] + "end of terms and conditions.", want))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id string, text string")
    got = {r["doc_id"]: r["licence_id"] for r in licences.scan(df, licences.KNOWN, licences.DIGESTS).collect()}
    assert got == {k: want for k, _, want in rows}
    assert all(len(d) == 64 for ds in licences.DIGESTS.values() for d in ds)

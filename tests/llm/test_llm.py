"""Operators for training corpora: small fixtures, edge cases, and brute force."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer.llm import chatformat, decontaminate, embeddings, licenses, lmscore, mixing, neardup, pagetext, simhash, tokencount, toxicity
from assayer.llm.common import components

DOC = "doc_id long, text string, lang string, source string, n_chars long, label int"  # label: a column that clashes


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), 1) for i, t in texts], DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [(1, "x")]).where("false")


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(400)] + [(7, 7)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root if any(n in e and e[0] != e[1] for e in edges)}


# --- 1
def test_lm_scores(spark, empty):
    rng = random.Random(2)
    line = lambda n: " ".join("the cat sat on a mat and then".split()[(i + k) % 8] for k in [rng.randrange(8)] for i in range(n))
    shuffled = lambda t: " ".join(rng.sample(t.split(), len(t.split())))
    good = [(i, line(40)) for i in range(60)]
    d = docs(spark, [*good, (900, shuffled(good[0][1])), (901, None), (902, ""), (903, "..."), (904, good[0][1]), (0, good[0][1])])
    got = [r for r in lmscore.score_documents(d).collect()]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 66 and by[900]["mean_score"] < by[904]["mean_score"] - 0.5
    assert {round(r["score"], 3) for r in got if r["doc_id"] in (0, 904)} == {round(by[904]["score"], 3)}  # repeated rows
    assert [(by[i]["n_words"], by[i]["score"], by[i]["mean_score"]) for i in (901, 902, 903)] == [(0, 0.0, None)] * 3
    assert lmscore.score_documents(empty).count() == 0
    assert lmscore.score_documents(docs(spark, [(1, "")])).first()["score"] == 0.0


def brute_lm_scores(rows, classes, counted, net):
    """Word by word: log p(class | neighbours) of the weights, and log p(word | class) of all other texts' counts."""
    words = {i: [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()] for i, t in enumerate(t for _, t in rows)}
    keys = {w: k for k, w in counted}
    e, mix, b, u, c, inner, d = (p.astype(float) for p in net.parts)
    softmax = lambda z: z - math.log(np.exp(z - z.max()).sum()) - z.max()
    total = {}
    for ws in words.values():
        for w in ws:
            total[w] = total.get(w, 0) + 1
    cls = {w: classes.own.get(keys[w], 1 + len(classes.own) + zlib.crc32(w.encode()[-3:]) % classes.buckets) for w in total}
    out = []
    for ws in words.values():
        padded, score = [0, 0, *(cls[w] for w in ws), 0, 0], 0.0
        for i, w in enumerate(ws):
            near = [padded[i], padded[i + 1], padded[i + 3], padded[i + 4]]
            h = np.tanh(np.concatenate([e[x] for x in near]) @ mix + b)
            group, member = cls[w] % net.side, cls[w] // net.side
            score += softmax(h @ u + c)[group] + softmax(h @ inner[group] + d[group])[member]
            if keys[w] not in classes.own:
                mates = [x for x in total if cls[x] == cls[w]]
                of = sum(total[x] for x in mates) - sum(cls[x] == cls[w] for x in ws)
                score += math.log(total[w] - ws.count(w) + lmscore.UNSEEN) - math.log(of + lmscore.UNSEEN * len(mates))
        out.append(score)
    return out


def test_lm_scores_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "PIECE", 150)
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("abcdeü") for _ in range(rng.randrange(1, 6))) for _ in range(90)]
    rows = [(i, " ".join(rng.choice(vocabulary[: rng.choice((6, 90))]) for _ in range(rng.randrange(0, 60)))) for i in range(40)] + [(900, None), (3, "a b"), (3, "a b")]
    d = docs(spark, rows)
    texts, counted, classes, net = lmscore.fitted(d)
    named = spark.createDataFrame([(w, w.encode()) for w in {w for _, t in rows for w in (t or "").split()}], "w string, b binary").select(F.xxhash64("b").alias("k"), "w").collect()
    want = brute_lm_scores(rows, classes, [tuple(r) for r in named], net)
    monkeypatch.setattr(lmscore, "fitted", lambda *_: (texts, counted, classes, net))
    got = sorted((r["doc_id"], r["n_words"], r["score"]) for r in lmscore.score_documents(d).collect())
    for (i, n, score), (j, m, wanted) in zip(got, sorted((i, len((t or "").split()), w) for (i, t), w in zip(rows, want, strict=True)), strict=True):
        assert (i, n) == (j, m) and score == pytest.approx(wanted, rel=1e-4, abs=1e-4)
    assert counted.count() == len({w for _, t in rows for w in (t or "").split()})


def test_lm_beats_unigrams_on_held_out_text(spark):
    rng = random.Random(18)
    after = {w: rng.sample("abcdefghijklmnop", 3) for w in "abcdefghijklmnop"}

    def text(n):
        out = [rng.choice("abcdefghijklmnop")]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return " ".join(out)

    texts, counted, classes, net = lmscore.fitted(docs(spark, [(i, text(200)) for i in range(60)]))
    keys = {r["w"]: r["k"] for r in spark.createDataFrame([(w, w.encode()) for w in after], "w string, b binary").select("w", F.xxhash64("b").alias("k")).collect()}
    cls = np.array([classes.own[keys[w]] if keys[w] in classes.own else 1 + len(classes.own) + zlib.crc32(w.encode()) % classes.buckets for w in text(3000).split()], np.uint16)
    own = -net.log_probs(cls, np.array([len(cls)])).mean()
    unigram = -np.log(classes.totals[cls] / classes.totals.sum()).mean()
    assert math.exp(own) < 0.5 * math.exp(unigram)


def test_lm_reads_the_language_off_the_neighbours(spark):
    rng = random.Random(21)
    tongues = [["".join(rng.choice(letters) for _ in range(rng.randrange(2, 5))) for _ in range(400)] for letters in ("abcdef", "ghijkl", "mnopqr", "stuvwx")]
    texts = [" ".join(rng.choices(rng.choice(tongues), k=150)) for _ in range(400)]
    corpus, _, classes, net = lmscore.fitted(docs(spark, list(enumerate(texts))))
    own = classes.totals[1 : 1 + len(classes.own)].sum() / classes.totals.sum()
    gain = n = 0.0
    for r in corpus.select("cls", "sizes").collect():
        sizes = np.array(r["sizes"])
        cls = lmscore.unpacked(r["cls"], sizes)
        gain += (net.log_probs(cls, sizes) - np.log(classes.totals[cls] / classes.totals.sum())).sum()
        n += len(cls)
    assert gain / n > 0.7 and own > 0.3  # of log(4) that the language is worth


def test_lm_tells_copies_from_single_texts(spark):
    rng = random.Random(19)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(80))
    single, twice = [text() for _ in range(40)], [text() for _ in range(10)]
    rows = [*enumerate(single), *((100 + i, t) for i, t in enumerate(twice)), *((200 + i, t) for i, t in enumerate(twice)), (900, "one " * 300_000)]
    by = {r["doc_id"]: r["mean_score"] for r in lmscore.score_documents(docs(spark, rows)).collect()}
    assert max(by[i] for i in range(40)) < min(by[i] for i in by if 100 <= i < 300) and by[900] > -0.1


# --- 2
def test_licenses(spark, empty):
    rows = [(1, "Released under the MIT License."), (2, "a\nUnder The MIT license, under the mit License\nCC BY-NC"), (3, None), (4, ""), (5, "under the license mit"),
            (6, "This work is licensed under the GNU General Public License, version 3."), (7, "apache license, version 2"), (8, "x " * 30000 + "\ncc-by-nc"), (1, "Released under the MIT License.")]
    out = licenses.scan_licenses(docs(spark, rows)).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 9
    assert by[1][1:] == (5, 1, 1, 1, "mit", "mit", 1.0)
    assert by[2][1:7] == (12, 3, 1, 9, "cc-by-nc,mit", "cc-by-nc,mit")
    assert by[3][1:] == by[4][1:] == (0, 0, None, None, "", "", 0.0)
    assert by[5]["labels"] == "" and (by[6]["base_labels"], by[6]["labels"], by[6]["score"]) == ("", "gpl", 1.0)
    assert (by[7]["base_labels"], by[8]["first_word"], by[8]["n_words"]) == ("apache-2", 30000, 30003)
    assert licenses.scan_licenses(empty).count() == 0


def test_template_blocks_brute_force(spark):
    rng = random.Random(3)
    words = sorted({w for t in licenses.TEMPLATES for w in [*t.words, *t.barred.split()]}) + ["zz", "yy"]
    rows = []
    for i in range(200):
        ws = rng.choice(licenses.TEMPLATES).notice.split()
        for _ in range(rng.randrange(4)):
            ws[rng.randrange(len(ws))] = rng.choice(words)
        for _ in range(rng.randrange(3)):
            ws[(at := rng.randrange(len(ws) + 1)) : at] = ["zz"] * rng.randrange(9)
        rows.append((i, " ".join(["yy"] * rng.randrange(40) + (ws if i % 3 else rng.sample(ws, len(ws))) + ["zz"] * rng.randrange(40))))
    want = set()
    for i, text in rows:
        ws = text.split()
        for k, t in enumerate(licenses.TEMPLATES):
            for at in range(0, len(ws), t.length):
                block = set(ws[at : at + 2 * t.length])
                need = math.ceil(0.9 * len(t.words) - 1e-9)
                if len(block & set(t.words)) >= need:
                    cut = ws[at : at + 2 * t.length]
                    runs = [cut[p : p + n] for n in range(need, t.reach + 1) for p in range(len(cut) - n + 1)]
                    sizes = [n for n in range(need, t.reach + 1) for p in range(len(cut) - n + 1)]
                    fine = [n for n, r in zip(sizes, runs, strict=True) if len(set(r) & set(t.words)) >= need and set(r) >= set(t.must.split()) and not set(r) & set(t.barred.split()) and sorted(map(r.index, t.must.split())) == [*map(r.index, t.must.split())]]
                    want.add((i, k, at // t.length, min(fine, default=None)))
    texts = licenses.read_texts(docs(spark, rows))
    ids = {r["row"]: r["doc_id"] for r in texts.select("row", "doc_id").collect()}
    assert len(want) > 50 and {(ids[r["row"]], r["template"], r["block"], r["shortest"]) for r in licenses.template_blocks(texts).collect()} == want


def test_license_labels(spark):
    gap = " ".join(["w"] * 3000)
    rows = [
        (1, "This text is under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
        (2, "This library is free; you can redistribute it and/or modify it under the terms of the GNU Lesser General\n * Public License as published by the Free Software Foundation", "lgpl"),
        (3, "this work is licensed under the general public license version 3", ""),
        (4, f"mit {gap} released {gap} under {gap} the {gap} license", ""),
        (5, "Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that\nthe following conditions are met:", "bsd"),
        (6, "# Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and\n# associated documentation files", "mit"),
        (7, f"{gap} Creative Commons Attribution 4.0\nInternational License {gap}", "cc-by"),
        (8, "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by\nthe Free Software Foundation", "gpl"),
        (9, f"RELEASED UNDER THE MIT LICEN\u212aE {gap}", ""),
        (9, "Licensed under the GNU Affero General Public License, version 3", "agpl"),
        (10, "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
        (11, "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "cc-by-nd"),
        (12, "This work is licensed under the GNU General Public License version 3 or the GNU Lesser General Public License version 3.", "gpl,lgpl"),
        (13, "Creative Commons Attribution 4.0 International License except photos which are noncommercial", "cc-by"),
        (14, "released under a license that is not the MIT one", ""),
        (15, "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "cc-by-nc-nd"),
        (16, "All photos are noncommercial. Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
        (17, "Licensed under CC BY-SA 4.0; see also Licensed under CC BY 4.0", "cc-by,cc-by-sa"),
        (18, "the lesser of two evils. Licensed under the GNU General Public License, version 3", "gpl"),
        (19, "Released under the terms of the MIT license", "mit"),
        (20, "The MIT people released a film; under the bridge stands a license plate", ""),
    ]
    got = {(r["doc_id"], r["n_words"]): r["labels"] for r in licenses.scan_licenses(docs(spark, [r[:2] for r in rows])).collect()}
    assert sorted((i, labels) for (i, _), labels in got.items()) == sorted((i, labels) for i, _, labels in rows) and got[9, 10] == "agpl"


# --- 3
def brute_fingerprint(text):
    import xxhash

    ws = (text or "").encode().lower().split()
    sh = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, empty):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(80)) for _ in range(6)]
    texts = [None, "", " \t", "one", "Two words", base[0], base[0].upper(), "é É ß", "w " * 30000] + [b + " tail" for b in base] + [" ".join([*b.split()[:40], "x", *b.split()[41:]]) for b in base for _ in range(2)] + base
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [(100, None)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = {i: brute_fingerprint(t) for i, t in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert len(got) == len(rows)
    assert all((r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", find(r["doc_id"])) for r in got)
    assert simhash.near_duplicates(empty).count() == 0


def test_dense_families_are_dealt_in_blocks(spark, monkeypatch):
    """All fingerprints within three of fourteen bits of a center, far from those of another: no vantage point divides them."""
    ball = [sum(1 << i for i in bits) for n in range(4) for bits in itertools.combinations(range(14), n)]
    centers = [0x0123456789ABCDEF, 0x7EDCBA9876543210]
    fps = [c ^ x for c in centers for x in ball]
    nodes = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    whole = nodes.select(F.lit(6).cast("long").alias("shard"), "fp", "id")
    for rounds in (12, 0):
        dealt = simhash.divided(whole, 64, rounds)
        sizes = [r["n"] for r in dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()]
        assert max(sizes) <= 128 and len(sizes) > 10 and {r["shard"] & 1 for r in dealt.select("shard").distinct().collect()} == {0}
        met = dealt.alias("x").join(dealt.alias("y"), F.expr("x.shard = y.shard AND x.id < y.id AND bit_count(x.fp ^ y.fp) <= 3")).select("x.id", F.col("y.id").alias("other")).distinct().count()
        assert met == sum((x ^ y).bit_count() <= 3 for x, y in itertools.combinations(fps, 2))
    monkeypatch.setattr(simhash, "SHARD_LIMIT", 64)
    got = {r["node"]: r["root"] for r in components(simhash.fingerprint_links(nodes)).collect()}
    assert got == {n: 0 if n < len(ball) else len(ball) for n in range(len(fps))}


@pytest.mark.parametrize("limit", [8, 40])
def test_large_shards_are_divided(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "SHARD_LIMIT", limit)
    rng = np.random.default_rng(8)
    far = rng.integers(0, 2**62, 300)
    half = (rng.integers(0, 2**30, 300) << 32) | 12345  # one half in common
    near = np.concatenate([x[:150] ^ (1 << rng.integers(0, 60, 150)) ^ (1 << rng.integers(0, 60, 150)) for x in (far, half)])
    fps = [int(x) for x in np.unique(np.concatenate([far, half, near]))]
    nodes = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    got = {r["node"]: r["root"] for r in components(simhash.fingerprint_links(nodes)).collect()}
    want = {(a, b) for a, x in enumerate(fps) for b, y in enumerate(fps) if a < b and (x ^ y).bit_count() <= 3}
    assert len(want) > 200 and all(got[a] == got[b] for a, b in want)
    root = {n: n for e in want for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in want:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in root}


@pytest.mark.parametrize("depth", [0, 3, 6])
def test_vantage_shards_lose_no_pair(depth):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    near = x[:1500] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (1500, 3)).astype(np.uint64), axis=1)
    dense = x[0] ^ (np.uint64(1) << rng.integers(0, 20, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 20, 300).astype(np.uint64))
    x = np.unique(np.concatenate([x, near, dense]))
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for which in (0, 1):
        half = (x >> np.uint64(32 * which)) & np.uint64(0xFFFFFFFF)
        rows, shard = simhash._route(half, which, depth)
        for s in np.unique(shard):
            own = rows[shard == s]
            for a, b in simhash.shard_links(x[own], which):
                assert (int(x[own[a]]) ^ int(x[own[b]])).bit_count() <= 3
                root[find(int(own[a]))] = find(int(own[b]))
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 3):
            assert find(i) == find(int(j))


# --- 4
def test_levenshtein_trie():
    lex = toxicity.Lexicon(["idiot", "scum", "loser"], ["lowei"])

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, last = [i], d
            for j, y in enumerate(b, 1):
                d.append(min(last[j] + 1, d[-1] + 1, last[j - 1] + (x != y)))
        return d[-1]

    rng = random.Random(6)
    for _ in range(3000):
        w = list(rng.choice(["idiot", "scum", "loser", "lowei", "loweiig"]))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", "x", "i", "o"])
        w = "".join(w)
        want = 1 if w in ("idiot", "scum", "loser") or w.startswith("lowei") and w != "lowei" else 2 if min(distance(w, "idiot"), distance(w, "loser")) <= 1 else 0
        assert lex.accepts(w) == want, w
    lex = toxicity.Lexicon([], ["lowei", "bomente"])
    assert [lex.accepts(w) for w in ("bomentex", "bomente", "bmentexx", "bomenntex", "bamentexx", "bamantexx", "lowxixx")] == [1, 2, 2, 2, 2, 0, 0]


def test_toxicity(spark, empty, monkeypatch):
    rng = random.Random(7)
    plain = lambda: " ".join(rng.choice("alder birch cedar dogwood elm fir ginkgo hazel ivy".split()) for _ in range(25))
    rows, marks = [], []
    for i in range(500):
        bad = i % 4 == 0
        rows.append((i, plain() + (f" you {rng.choice(['zorgat', 'plimdor'])} {plain()}" if bad else "")))
        marks.append((i, 1, int(bad)))
    labels = spark.createDataFrame([*marks, (None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    more = [(9001, plain() + " what a zorgaat you are " + plain()), (9002, None), (9003, ""), (9004, plain()), (None, plain())]
    d = docs(spark, rows + more)
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(d, labels).collect()}
    assert len(out) == 505 and all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    held = [i for i, _ in rows if out[i]["held_out"]]
    assert all(out[i]["predicted"] == int(i % 4 == 0) for i in held) and len(held) > 50
    assert out[9001]["score"] > out[9004]["score"] and out[9002]["score"] == out[9003]["score"] == out[9004]["score"]
    kept = toxicity.drop_toxic(d, labels)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i in out if not out[i]["predicted"]}
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(d, flipped).collect()} == {i: r["score"] for i, r in out.items()}
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert {r["predicted"] for r in toxicity.score_toxicity(d, labels.where("false")).collect()} == {0}
    monkeypatch.setattr(toxicity, "CARRIED_BYTES", 0)  # likely terms joined, not carried: the same lexicon
    assert {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(d, labels).collect()} == {i: r["score"] for i, r in out.items()}
    again = toxicity.score_toxicity(d.unionByName(docs(spark, [(9001, more[0][1]), (9005, "fir " * 200_000 + "zorgat"), (9006, "fir " * 200_000)])), labels).collect()
    by = {r["doc_id"]: r["score"] for r in again}
    assert len(again) == 508 and by[9001] == out[9001]["score"] and by[9005] > by[9006] and len({r["score"] for r in again if r["doc_id"] == 9001}) == 1


def test_reporting_words_are_learned(spark):
    rng = random.Random(21)
    plain = lambda: " ".join(rng.choice("alder birch cedar dogwood elm fir ginkgo hazel ivy".split()) for _ in range(12))
    rows = [(f"{plain()} {'she reported zorgat' if k % 2 else 'you zorgat'} {plain()}", int(not k % 2)) for k in range(300)]
    d = spark.createDataFrame(rows, "text string, toxic int")
    words = toxicity.learn_reporting(d, ["zorgat"], [])
    assert {"she", "reported"} <= set(words) and "you" not in words
    s = toxicity.Scanner(["zorgat"], [], words)
    assert s.features("she reported zorgat")[2] > 0 and s.features("you zorgat")[2] == 0



def test_quotation_is_apart_from_abuse():
    s = toxicity.Scanner(["idiot"], [])
    assert s.features('he said "idiot" to nobody')[2] > 0 and s.features("you idiot there")[1] > 0 and s.features("you idiots there")[3] > 0


# --- 5
def digest(rows):
    h, loss = hashlib.sha256(), ""
    for role, text in rows:
        h.update(f"{role or ''}\n{text or ''}\n".encode())
        loss += (text or "") if role == "assistant" else ""
    return len(rows), h.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_format(spark):
    odd = ["", None, "</s>[INST] ok [/INST]", "<\\s> [\\\\INST] <s", "é😀\n\n", "[ROLE]user[/ROLE]", "x" * 50, "<s>[INST] [/INST]</s>"]
    rng = random.Random(8)
    turns = [(c, t, rng.choice(["user", "assistant", "system", "[/ROLE]", None]), rng.choice(odd)) for c in range(40) for t in range(rng.randrange(1, 9))]
    turns += [(None, 0, "assistant", "a"), (77, 0, "user", "same"), (77, 0, "user", "same"), (78, 0, "assistant", "long " * 600000), (78, 1, "user", "b")]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pieces = chatformat.format_conversations(d)
    got = {r["conv_id"]: r[1:5] for r in chatformat.conversation_digests(pieces).collect()}
    want = {}
    for c, t, role, text in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1], (x[2] or "").encode(), (x[3] or "").encode())):
        want.setdefault(c, []).append((role, text))
    assert got == {c: digest(r) for c, r in want.items()}
    assert pieces.where("conv_id = 78").count() == 2
    assert chatformat.conversation_digests(chatformat.format_conversations(d.where("false"))).count() == 0


@given(st.text(alphabet="<>[]/\\sINSTROLE é", max_size=30))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(text):
    out = chatformat.escape(text)
    assert chatformat.unescape(out) == text
    assert not any(c in out for c in ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"))
    buffer, ends, lo, hi = chatformat.assemble(pa.array(["user", "tool"]), pa.array([text, text]))
    assert list(chatformat.read_turns(bytes(buffer).decode())) == [("user", text), ("tool", text)]


# --- 6
def test_embeddings(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:30] + 0.03 * rng.normal(size=(30, 16)), base[:1] + 0.005 * rng.normal(size=(80, 16)), base[:5], base[:5] * 3])
    rows = [(i, [float(c) for c in v], int(i % 2)) for i, v in enumerate(x.astype(np.float32))]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] + [1.0] * 15, 0), (904, rows[0][1], None), (905, [1.0, 2.0], 0), (906, [], 0), (907, [float("inf")] * 16, 1), rows[0]]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(3))
    got = embeddings.near_duplicates(d).collect()
    n = len(x)
    v = np.array([r[1] for r in rows[:n]], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v, ids, label = np.concatenate([v, v[:1]]), [*range(n), 0], np.array([*(i % 2 for i in range(n)), 0])
    link = (v @ v.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    want = sorted((ids[i], int(link[i].sum())) for i in range(n + 1))
    found = sorted((r["vec_id"], r["n_links"]) for r in got if r["vec_id"] < 900)
    assert sum(c for _, c in found) >= 0.99 * sum(c for _, c in want) and all(a[0] == b[0] and a[1] <= b[1] for a, b in zip(found, want, strict=True))
    assert all((r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True) for r in got if r["vec_id"] >= 900)
    assert embeddings.near_duplicates(d.where("false")).count() == 0


def test_blocks_of_large_buckets(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.normal(size=8) + 0.01 * rng.normal(size=(90, 8))
    d = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    got = embeddings.near_duplicates(d).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(89, 0)}


# --- 7
def test_token_counts(spark, empty):
    from tokenizers import Tokenizer, models

    voc = tokencount.vocabulary()
    low = min(s for _, s in voc)
    ref = Tokenizer(models.Unigram([("<unk>", 0.0), *voc, *((f"<0x{i:02X}>", low) for i in range(256))], 0, True))
    rng = random.Random(11)
    texts = ["".join(rng.choice("the and erth tion é漢😀\n\t  .,!ſ") for _ in range(rng.randrange(1, 80))) for _ in range(150)] + ["a", " ", "   x", "\n\n", "z" * 500]
    rows = [*enumerate(texts), (900, None), (901, ""), (0, texts[0])]
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(docs(spark, rows)).collect()}
    assert all(got[i] == len(ref.encode("▁" + t.replace(" ", "▁")).tokens) for i, t in enumerate(texts))
    assert got[900] == got[901] == 0 and tokencount.count_tokens(empty).count() == 0


def test_vocabulary_is_of_log_probabilities():
    import sentencepiece

    voc = dict(tokencount.vocabulary())
    assert math.fsum(math.exp(s) for s in voc.values()) == pytest.approx(1) and len(voc) > 31_000
    count, own = tokencount.Counter(list(voc.items())).count, sentencepiece.SentencePieceProcessor(model_file=tokencount.MODEL)
    for text in ("the quick brown fox", "unbelievable tokenization happening", "a   b", "Hello   world\n\n x", "Der Hund und die Katze"):
        assert count(text)[0] == len(own.encode(text)), text
    assert count("ab " * 200_000)[0] == 200_001  # a very long text


@given(st.text(alphabet="abcx", min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_viterbi_ties_and_unknowns(text):
    pieces = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -3.5), ("bc", -2.5), ("ca", -2.0)]
    c = tokencount.Counter(pieces, byte_fallback=False, dummy_prefix=False)
    from tokenizers import Tokenizer, models

    ref = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0, False))
    # the library's unknown score counts <unk> in its minimum, which is not below the pieces' here
    assert c.count(text)[0] == len(ref.encode(text).tokens)


# --- 8
def test_pages(spark):
    weights, trans = pagetext.trained()
    rng = random.Random(99)
    hit = all_ = 0
    for _ in range(200):
        page = pagetext.labelled_page(rng)
        rows = [(p, t, ln) for p, t, ln, _ in page]
        for k, (p, t, ln) in enumerate(rows):
            fs = pagetext._path_features(p) + pagetext.text_features(t, ln, k, len(rows))
            e = sum(weights.get(f, 0.0) for f in fs)
            hit += (e > 0) == page[k][3]
            all_ += 1
    assert hit / all_ > 0.95
    html = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- ad --><div class=ad>Buy this now.</div><article><h1>A &amp; B</h1><p><b>Bold start of\n the text.<br><p>Caf&eacute; &#233; was good, and   we stayed.</p></article><aside><p>Related story.</p></aside><section class='comments'><p>Nice article, thanks!</p></section><footer>&copy; site</footer></body></html>"
    d = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "v", ""), (1, "u", html), (4, "w", "plain <p>unclosed"), (5, "x", "<div>" * 3000 + "deep</div>")], "page_id long, url string, html string")
    out = pagetext.extract_pages(d.withColumn("text", F.lit("clash"))).collect()
    by = {r["page_id"]: r for r in out}
    assert len(out) == 6 and by[1]["text"] == "A & B Bold start of the text. Café é was good, and we stayed." and by[1]["n_chars"] == len(by[1]["text"])
    assert by[2]["text"] == by[3]["text"] == ""
    assert pagetext.extract_pages(d.where("false")).count() == 0


# --- 9
def test_decontamination(spark, empty, monkeypatch):
    rng = random.Random(12)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop")
    items = [(i, " ".join(word() for _ in range(rng.randrange(3, 40)))) for i in range(30)] + [(90, None), (None, "a b c d e f"), (91, "")]
    rows = []
    for i in range(120):
        t = [word() for _ in range(rng.randrange(0, 200))]
        if i % 3 == 0:
            it = rng.choice(items[:30])[1].split()
            for _ in range(rng.randrange(3)):
                it[rng.randrange(len(it))] = "zz"
            at = rng.randrange(len(t) + 1)
            t[at:at] = it if i % 2 else [*it[: len(it) // 2], *t[:3], *it[max(0, len(it) // 2 - 4) :]]
        rows.append((i, (", ".join(t)).upper() if i % 5 == 0 else " ".join(t)))
    rows += [(500, None), (501, ""), (3, rows[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    grams = lambda t: decontaminate.shingles([w.encode() for w in (t or "").lower().replace(",", " ").split()])
    want = {(d, i) for d, t in rows for i, s in items if i is not None and grams(s) and len(grams(t) & grams(s)) >= 0.8 * len(grams(s)) - 1e-9}
    d = docs(spark, rows)
    assert len(want) > 10
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(d, bench).collect()} == want
    kept = decontaminate.drop_contaminated(d, bench)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows if i not in {x for x, _ in want})
    monkeypatch.setattr(decontaminate, "PASS_CHARS", 500)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(d, bench).collect()} == want
    assert decontaminate.contained_items(empty, bench).count() == 0 and decontaminate.contained_items(d, bench.where("false")).count() == 0


# --- 10
def test_mixing(spark, empty):
    rng = random.Random(13)
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 30))), "en", "big" if i % 5 else f"s{i % 20}", 0, 1) for i in range(3000)]
    rows += [(9001, None, "en", None, 0, 1), (9002, "one two", "en", None, 0, 1), (9003, "", "en", "big", 0, 1), (9004, "x", "en", "big", 0, 1), (9004, "x", "en", "big", 0, 1)]
    out = mixing.mix_sources(spark.createDataFrame(rows, DOC)).toPandas()
    fine = mixing.mix_sources(spark.createDataFrame(rows, DOC), bucket_docs=1).toPandas()  # buckets of three digits, under heads of two
    order = ["source", "epoch", "start", "rank_key", "doc_id", "n_tokens"]
    assert fine.sort_values(order).reset_index(drop=True).equals(out.sort_values(order).reset_index(drop=True))
    have = {}
    for r in rows:
        have[r[3] or ""] = have.get(r[3] or "", 0) + len((r[1] or "").split())
    weights = out.groupby("source").weight.first()
    assert abs(weights.sum() - 1) < 1e-6
    total = max(have[s] / w for s, w in weights.items())
    for s, part in out.groupby("source"):
        budget = math.ceil(round(weights[s] * total, 3))
        assert budget / have[s] <= mixing.MAX_REPEATS + 1e-3
        told = part[part.n_tokens > 0].sort_values(["epoch", "rank_key", "start"])
        starts = told.n_tokens.cumsum() - told.n_tokens
        assert (told.start.to_numpy() == starts.to_numpy()).all() and starts.max() < budget <= told.n_tokens.sum()
        assert (told.block == (told.start * mixing.BLOCKS // budget)).all()
    assert sorted(out[out.epoch == 0].doc_id) == sorted(r[0] for r in rows)  # nothing is lost
    assert mixing.mix_sources(empty).count() == 0


@pytest.mark.parametrize("target", [0.6, 0.9, 1.0])
def test_exponent_meets_entropy(spark, target):
    d = spark.createDataFrame([("a", 1, 9000), ("b", 1, 900), ("c", 1, 90), ("d", 1, 10), ("none", 1, 0)], "source string, n_docs long, n_tokens long")
    w = [r["weight"] for r in mixing.mixing_weights(d, target, None).collect() if r["source"] != "none"]
    natural = -sum(p * math.log(p) for p in (0.9, 0.09, 0.009, 0.001))
    got = -sum(p * math.log(p) for p in w)
    assert got == pytest.approx(max(natural, target * math.log(4)), abs=1e-4)
    rep = [r for r in mixing.mixing_weights(d, target, 2.0).collect() if r["n_tokens"]]
    assert max(r["budget"] / r["n_tokens"] for r in rep) <= 2.001 and min(r["budget"] / r["n_tokens"] for r in rep) == 1
    own = [r for r in mixing.mixing_weights(d, target, 2.0, 5000).collect() if r["n_tokens"]]
    assert max(r["budget"] / r["n_tokens"] for r in own) <= 2.11 and abs(sum(r["budget"] for r in own) - 5000) < 5


def test_token_count(spark):
    rows = [(None, 0), ("", 0), (" ", 0), ("a", 1), (" a\n", 1), ("a  b\tc", 3), ("\xa0", 1)]
    d = spark.createDataFrame(rows, "t string, n int")
    assert d.where(mixing.token_count(F.col("t")) != F.col("n")).count() == 0


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    text = lambda n=60: " ".join(word() for _ in range(n))
    item = text(20)
    rows, marks = [], []
    for i in range(300):
        bad = i % 5 == 0
        rows.append((i, text() + (f" vile zorgat {text(5)}" if bad else ""), "en", f"s{i % 3}", 1))
        marks.append((i, 1, int(bad)))
    rows += [(1000, rows[1][1], "en", "s1", 1), (1001, f"{text()} {item} {text()}", "en", "s2", 1), (1002, None, "en", "s0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()}
    want = {i for i in range(300) if i % 5} | {1002}
    assert got <= want and len(got) >= 0.9 * len(want)
    assert 1000 not in got and 1001 not in got


def jaccard_roots(rows):
    """Brute force: the smallest doc_id reachable by Jaccard similarity 0.8 of five-word shingles."""
    ws = {i: (t or "").encode().lower().split() for i, t in rows}
    sets = {i: set(zip(*(w[k:] for k in range(5)), strict=False)) or {tuple(w)} for i, w in ws.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("block", [3, 256])
def test_pipeline_drops_edited_copies(spark, monkeypatch, block):
    import corpus_pipeline as cp
    from assayer.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(900, None), (901, ""), (902, "One two"), (903, "one  TWO"), (904, "one two three")]
    for k in range(25):
        last = [word() for _ in range(rng.choice([12, 60, 120, 300]))]
        for i in range(8):  # from the first text or from the last, so that chains come up as well
            ws = list(last)
            for _ in range(rng.choice([0, 1, 1, 2, max(1, len(ws) // 50), max(2, len(ws) // 45)])):
                ws[rng.randrange(len(ws))] = word()
            rows.append((k * 10 + i, " ".join(ws)))
            last = ws if i % 3 else last
    want = jaccard_roots(rows)
    assert 30 < len(set(want.values())) < 150
    d = docs(spark, [*rows, (None, "no id"), rows[7]])
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(d).collect()} == want
    kept = cp.dedupe(spark, d, None)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(want.values())) and kept.where("doc_id IS NULL").count() == 1


def test_keep_one_judges_texts_not_ids(spark, empty, monkeypatch):
    from assayer.llm import neardup

    rng = random.Random(16)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(3, a), (5, b), (5, a + " tail"), (7, c), (7, c), (8, None), (9, ""), (None, a)]
    for few in (1_000_000, 0):
        monkeypatch.setattr(neardup, "BROADCAST_ROWS", few)
        kept = neardup.keep_one(docs(spark, rows).withColumn("mark", F.lit(1)).withColumn("node", F.lit("x")))
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(3, a), (5, b), (7, c), (8, None), (None, a)], key=str)
        assert kept.columns[-2:] == ["mark", "node"]
    assert neardup.keep_one(empty).count() == 0
    long = docs(spark, [(1, "w " * 200_000 + "x"), (2, "W " * 200_000 + "x"), (3, "w " * 100_000 + "y z")])
    assert {r["doc_id"] for r in neardup.keep_one(long).collect()} == {1, 3}


def test_edited_copies_by_blocks():
    from assayer.llm import neardup

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, 400)
    sets = [np.unique(np.concatenate([base[rng.random(400) < p], rng.integers(0, 2**62, k)])) for p in (0.85, 0.9, 0.95, 1.0) for k in (0, 9, 40) for _ in range(4)]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(c := {*sets[a].tolist()} & {*sets[b].tolist()}) >= 0.8 * (len(sets[a]) + len(sets[b]) - len(c)) - 1e-9}
    assert 0 < len(want) < len(sets) * (len(sets) - 1) // 2 and set(zip(*(x.tolist() for x in neardup.block_links(sets)), strict=True)) == want


def test_training_rows_are_bounded_by_rows(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5][:30]
    rows = [(i, f"text {i}") for i in ids] + [(ids[0], f"another {k}") for k in range(500)] + [(ids[1], "text again")] * 500
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(ids[0], 1)] * 50, "doc_id long, toxic int")
    for bound in (10, 100):
        got = toxicity.training_rows(docs(spark, rows), labels, bound).collect()
        assert len(got) == min(bound, len(ids))


HELPERS = ["_mark", "_id", "_of", "_digest", "_own", "_before", "mark", "node", "component_id", "root", "key", "t", "score", "toxic", "n_tokens", "rank_key", "bucket", "x", "y"]


def test_columns_named_like_helpers_pass_through(spark, monkeypatch):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, "something else that nobody else says here", "en", "s", 1)]
    d = spark.createDataFrame([(*r, *[77 + k for k in range(len(HELPERS))]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in HELPERS))
    kept = neardup.keep_one(d)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, d.where("doc_id <> 2").collect())) and kept.columns == d.columns
    items = spark.createDataFrame([(1, text), (2, "an item that stands in no document at all today")], "item_id long, text string")
    for parts in (1, 2):
        monkeypatch.setattr(decontaminate, "item_passes", lambda b, n=parts, own=decontaminate.item_passes: own(b) if n == 1 else [p for i in (1, 2) for p in own(b.where(f"item_id = {i}"))])
        clean = decontaminate.drop_contaminated(d, items)
        assert [tuple(r) for r in clean.collect()] == [tuple(d.where("doc_id = 3").first())] and clean.columns == d.columns
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.drop_toxic(d, labels).collect())) == sorted(map(tuple, d.collect()))
    assert mixing.mix_sources(d).count() >= 3

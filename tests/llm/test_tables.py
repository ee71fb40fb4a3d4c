"""Exact duplicates, source divergence and the Merkle manifest: small tables, edge cases, brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from assayer.llm import divergence, exactdup, manifest

DOC = "doc_id long, text string, lang string, source string, n_chars long, row int, rest string, part string"
#: names that clash with the operators' own columns
EXTRA = (1, "r", "p")


def docs(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOC)


def as_sorted(rows):
    return sorted(map(repr, rows))


# --- 11
def brute_duplicates(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        top, left = max((i for i in ids if i is not None), default=None), 1
        for i in ids:
            kept = bool(i == top and left)
            left -= kept
            out.append((i, top, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("first", [1, 3, 64])
def test_exact_duplicates_by_brute_force(spark, first):
    rng = random.Random(3)
    texts = [None, "", "a", "A", "ab", "abc", "abcd", "é", "é", "x" * 64, "x" * 65, "x" * 64 + "y", "x" * 576, "x" * 577, "z" * 9000 + "1", "z" * 9000 + "2", " a", "a "]
    rows = [(i, rng.choice(texts), "en", "s", 0) for i in range(300)]
    rows += [(5, "ab", "en", "s", 0)] * 3 + [(999, "abc", "en", "s", 0)] * 2 + [(None, "null id", "en", "s", 0)] * 2 + [(None, "abc", "en", "s", 0)]
    got = exactdup.exact_duplicates(docs(spark, rows), first=first, factor=2 if first < 64 else 8, longest=4096)
    assert as_sorted(map(tuple, got.collect())) == as_sorted(brute_duplicates(rows))


def test_exact_duplicates_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(exactdup, "CARRIED_BYTES", 0)
    rows = [(i, f"{'head' * 30} {i % 7}", "en", "s", 0) for i in range(200)] + [(1000 + i, f"only {i}", "en", "s", 0) for i in range(20)]
    assert as_sorted(map(tuple, exactdup.exact_duplicates(docs(spark, rows)).collect())) == as_sorted(brute_duplicates(rows))


def test_exact_duplicates_of_nothing(spark):
    assert exactdup.exact_duplicates(docs(spark, [(1, "a", "en", "s", 1)]).where("false")).count() == 0


def test_exact_duplicates_of_long_texts(spark):
    long = "word " * 400_000
    rows = [(1, long, "en", "s", 0), (2, long, "en", "s", 0), (3, long + "!", "en", "s", 0)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exactdup.exact_duplicates(docs(spark, rows)).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True)}


# --- 12
def brute_audit(rows, least, top=10):
    """Dictionaries and plain integers."""
    def terms(text):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        return bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in low).decode().split(" ")

    words = [(lang or "", source or "", [t for t in terms(text) if t]) for _, text, lang, source, *_ in rows]
    df, n = Counter(), Counter()
    for lang, source, ts in words:
        df.update((lang, t) for t in set(ts))
        n.update((lang, source, t) for t in ts)
    groups = defaultdict(set)
    for lang, source, _ in words:
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for (g, t), c in df.items() if g == lang and c >= least), key=str.encode)
        total = {s: sum(n[lang, s, t] for t in kept) for s in sources}
        p = {(s, t): 1 + 10**9 * (n[lang, s, t] + 2) // (total[s] + 2 * len(kept)) for s in sources for t in kept}
        q = {t: 1 + 10**9 * (sum(n[lang, s, t] for s in sources) + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s, t], p[o, t]) for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            above = sorted((-f(p[s, t], q[t]), t.encode(), t) for t in kept if n[lang, s, t] and p[s, t] > q[t])
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(above[:top], 1)]
    return out


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(5)
    bag = ["the", "The", "cat", "cats", "car", "é", "été", "ét", "naïve", "z", "don't", "x1y", "猫", "猫猫"] + [f"w{'abcdefgh'[i % 8]}{'ij'[i % 2]}{'kl' * (i % 5)}" for i in range(40)]
    out = []
    for i in range(220):
        words = " ".join(rng.choices(bag, [1 + (k * (i % 5 + 1)) % 11 for k in range(len(bag))], k=rng.randrange(0, 30)))
        out.append((i, words, ["en", "fr", None, ""][min(i % 8, 3)], [None, "", "a", "b", "ä", "Z"][i % 6], 0))
    return out + [(900, None, "de", "only", 0), (901, "few words here", "it", "s1", 0), (902, None, "it", "s2", 0), out[3], out[3], (None, "the cat", None, None, None)]


@pytest.mark.parametrize("least,shard,carried", [(10, 100_000, 1 << 20), (10, 3, 1 << 20), (3, 4, -1), (500, 10, 1 << 20)])
def test_audit_by_brute_force(spark, talk, least, shard, carried):
    got = divergence.audit(docs(spark, talk), least=least, shard_terms=shard, carried=carried)
    assert as_sorted(map(tuple, got.collect())) == as_sorted(brute_audit(talk, least))


def test_audit_in_tiles_and_blocks(spark, talk, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "BLOCK", 5)
    sums = divergence._pair_sums

    def small(t):  # tasks have their own module
        divergence.TILE, divergence.BLOCK = 2, 5
        return sums(t)

    monkeypatch.setattr(divergence, "_pair_sums", small)
    assert as_sorted(map(tuple, divergence.audit(docs(spark, talk), least=5).collect())) == as_sorted(brute_audit(talk, 5))


def test_audit_of_nothing_and_of_long_texts(spark):
    assert divergence.audit(docs(spark, [(1, "a", "en", "s", 1)]).where("false")).count() == 0
    rows = [(i, ("alpha " * 300_000 + "beta") if i < 2 else "alpha beta gamma", "en", "ab"[i % 2], 0) for i in range(12)] + [(99, "q" * 5_000_000, "en", "a", 0)]
    assert as_sorted(map(tuple, divergence.audit(docs(spark, rows)).collect())) == as_sorted(brute_audit(rows, 10))


def test_shares_are_exact_for_large_counts(spark):
    n, total, v = 9_000_000_000_000, 12_345_678_901_234_567, 1_234_567
    row = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(divergence._p("n", "total", "v").alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_transducer_is_minimal_and_ordered():
    rng = random.Random(7)
    terms = sorted({bytes(rng.choices(b"abc\xc3\xa9", k=rng.randrange(1, 7))) for _ in range(400)})
    m = divergence.Transducer.build(terms)
    assert [m.spell(i) for i in range(len(terms))] == terms
    data = divergence.np.frombuffer(b" ".join([*terms, b"abcabcabc", b"zz"]), divergence.np.uint8)
    assert m.walk(data, *divergence._spans(data)).tolist() == [*range(len(terms)), -1, -1]
    right = set()  # states = right languages of all prefixes
    for p in {t[:k] for t in terms for k in range(len(t) + 1)}:
        right.add(frozenset(t[len(p) :] for t in terms if t.startswith(p)))
    assert len(m.final) == len(right)


# --- 13
def brute_manifest(rows, arity=8):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def leaf(i, text, lang, source, n):
        return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in (i, source, lang, n, text)))

    def climb(nodes, at):
        """Root, and the siblings of node ``at`` level by level."""
        path = []
        while len(nodes) > 1:
            run = at // arity * arity
            path.append((nodes[run:at], nodes[at + 1 : run + arity]))
            nodes, at = [h("".join(nodes[k : k + arity])) for k in range(0, len(nodes), arity)], at // arity
        return nodes[0], path

    langs = defaultdict(list)
    for i, text, lang, source, n, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if text is not None else None
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        one = leaf(i, text, lang, source, n)
        langs[lang].append((i is not None, i or 0, one, leaf(i, low, lang, source, n) if hit else one, i))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for own in langs.values():
        own.sort(key=lambda r: r[:3])
    subroots = [climb([r[2] for r in langs[x]], 0)[0] for x in order]
    out = []
    for k, lang in enumerate(order):
        root, upper = climb(subroots, k)
        for j, (_, _, one, changed, i) in enumerate(langs[lang]):
            sub, lower = climb([r[2] for r in langs[lang]], j)
            at = changed
            for a, b in lower + upper:
                at = h("".join(a) + at + "".join(b))
            proof = h("".join("".join(a) + "".join(b) for a, b in lower + upper))
            out.append((i, one, sub, root, proof, at, at == root))
    return out


@pytest.mark.parametrize("depth", [1, 2, 5])
@pytest.mark.parametrize("size", [1, 2, 9, 73])
def test_manifest_by_brute_force(spark, size, depth):
    rng = random.Random(size)
    rows = [(i, rng.choice([None, "", "Abc", "abc", "É A", "x:y"]), rng.choice(["en"] * 8 + [None, "", "fr", "é"]), rng.choice([None, "s", ""]), rng.choice([None, 3, -1])) for i in rng.sample(range(1000), size)]
    rows += [rows[0], rows[0], (None, "Null id", "en", "s", 1), (None, None, None, None, None), (None, "Null id", "en", "s", 1)] * (size > 2)
    assert as_sorted(map(tuple, manifest.manifest(docs(spark, rows), depth=depth).collect())) == as_sorted(brute_manifest(rows))


def test_manifest_of_many_langs_and_of_nothing(spark):
    rows = [(i, f"T{i}", f"l{i % 70}", "s", 1) for i in range(150)] + [(7_000, "Long " * 500_000, "l1", "s", 1)]
    got = manifest.manifest(docs(spark, rows), depth=1)
    assert as_sorted(map(tuple, got.collect())) == as_sorted(brute_manifest(rows))
    assert manifest.manifest(docs(spark, rows).where("false")).count() == 0


def test_states_resume_behind_the_left_siblings():
    tree = manifest.Tree([hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(20)], 2, 8)
    assert len(tree.roots) == 1 and all(tree.fold(i, hashlib.sha256(bytes([i])).hexdigest().encode()) == tree.roots[0] for i in range(20))
    h = tree.states[0][10].copy()  # the state of the second parent before its third child
    h.update(tree.runs[0][1][2 * manifest.HEX :])
    assert h.hexdigest() == hashlib.sha256(tree.runs[0][1]).hexdigest()

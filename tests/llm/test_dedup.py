"""Near-duplicates, repeated passages, components."""

import random

import numpy as np
import pytest
import xxhash

from loomlog.llm import passages, simhash
from loomlog.llm.common import written
from loomlog.llm.components import components

VOCABULARY = [f"w{i}" for i in range(4000)]


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, own = [], ""
    for c in lowered + " ":
        if c in " \t\n\v\f\r":
            words += [own] if own else []
            own = ""
        else:
            own += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("text", ["", " \n", "one", "one Two", "ÀB cd\x85ef gh", "a b c d e " * 50, None])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == brute_fingerprint(text)
    assert simhash.fingerprint(text or "", block=7) == brute_fingerprint(text)


def test_fingerprint_by_blocks():
    rng = random.Random(29)
    for _ in range(20):
        text = " ".join(rng.choices(VOCABULARY, k=250))
        assert simhash.fingerprint(text, block=7) == simhash.fingerprint(text) == brute_fingerprint(text)


def test_golay_keys_cover_two_errors():
    rng = random.Random(0)
    a = [rng.getrandbits(64) for _ in range(1500)]
    b = [x ^ 1 << rng.randrange(64) ^ (1 << rng.randrange(64) if i % 2 else 0) for i, x in enumerate(a)]
    own = []
    for xs in (a, b):
        key, row = simhash.keys(np.array(xs, np.uint64))
        sets = [set() for _ in xs]
        for k, r in zip(key.tolist(), row.tolist(), strict=True):
            sets[r].add(k)
        own.append(sets)
    assert all(x & y for x, y in zip(*own, strict=True))
    assert {len(s) for s in map(frozenset, simhash.codewords(np.arange(5000)).tolist())} <= {2, 6}  # one with padding, or six


@pytest.mark.parametrize("cold", [1, 16])
def test_links_against_all_pairs(spark, cold):
    rng = random.Random(cold)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(500):  # chains and clumps
        prints.append(rng.choice(prints[-120:]) ^ 1 << rng.randrange(64))
    prints = sorted(set(prints))
    frame = written(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), "t")
    root = {r["node"]: r["root"] for r in components(simhash.links(frame, cold=cold)).collect()}
    got = [root.get(signed(p), signed(p)) for p in prints]
    want = brute_components(prints)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: r for n, r in label.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choices(VOCABULARY, k=rng.randint(1, 300))) for _ in range(40)]
    texts = base + [t + " x" for t in base[:15]] + base[:10] + ["", " ", None, "one two"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, base[0], 1), (None, "lonely words here", 1), (3, base[3], 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is not None)
    prints = [brute_fingerprint(t) for t in texts]
    roots = brute_components(prints)
    want = [(i, f"{p:016x}", r) for i, (p, r) in enumerate(zip(prints, roots, strict=True))]
    assert got == sorted([*want, want[3]])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_survivors_without_or_with_repeated_ids(spark):
    rng = random.Random(31)
    texts = [" ".join(rng.choices(VOCABULARY, k=80)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[4]), (None, texts[4]), (None, texts[5]), (9, texts[5])]
    got = simhash.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4]), (9, texts[5])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def five_words(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_survivors_against_all_pairs(spark):
    """Copies with a few words changed, in groups around an original, some larger than what a key pairs."""
    rng = random.Random(41)
    texts = []
    for n, size in ((120, 60), (200, 6), (300, 5), (90, 4), (3, 3), (0, 2)):
        base = rng.choices(VOCABULARY, k=n)
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 2) if n > 50 else 0):
                own[rng.randrange(n)] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    texts += [" ".join(rng.choices(VOCABULARY, k=rng.randint(1, 200))) for _ in range(40)] + [None, " \n", "One  TWO", "one two"]
    rng.shuffle(texts)
    frame = spark.createDataFrame([(i, t, "a", 1, 2, "b") for i, t in enumerate(texts)], "doc_id long, text string, node string, _h int, least int, _row string")
    sets, root = [five_words(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1.0) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = simhash.survivors(frame)
    assert got.columns == frame.columns
    left = {r["doc_id"] for r in got.collect()}
    want = set(root)
    assert want <= left and len(left) <= len(want) + 2  # leaders may split what hangs together by a chain of copies
    assert simhash.survivors(frame.limit(0)).count() == 0


def test_links_of_a_crowded_key_against_all_pairs(spark):
    """Chains of copies, each a few words on from the last, all of the same keys: what hangs together by a link between
    two that are like no leader is one component, and what is like nothing stays alone."""
    rng = random.Random(43)
    texts = []
    for n, size, steps in ((100, 40, 2), (150, 25, 3), (60, 10, 1), (120, 12, 6)):
        own = rng.choices(VOCABULARY, k=n)
        for _ in range(size):
            texts.append(" ".join(own))
            at = rng.randrange(n - steps)
            own = [*own[:at], *(f"new{rng.randrange(10**6)}" for _ in range(steps)), *own[at + steps :]]
    texts += [" ".join(rng.choices(VOCABULARY, k=rng.randint(1, 30))) for _ in range(10)]
    rng.shuffle(texts)
    sets, want = [five_words(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = want[i], want[j]
                want = [min(a, b) if r in (a, b) else r for r in want]
    nodes = written(spark.createDataFrame([(i, [5, 6, 7]) for i in range(len(texts))], "node long, prints array<long>"), "nodes")
    frame = written(spark.createDataFrame(list(enumerate(texts)), "node long, text string"), "texts")
    root = {r["node"]: r["root"] for r in components(simhash.similar_links(nodes, frame, 5, 0.8)).collect()}
    got = [root.get(i, i) for i in range(len(texts))]
    assert got == want and len(set(want)) < len(texts) - 40


# -- passages


def brute_chain(a, b):
    best = 0.0
    n = len(a)
    score = [0.0] * n
    for i in range(n):
        score[i] = passages.WEIGHT
        for j in range(n):
            if a[j] < a[i] and b[j] < b[i]:
                score[i] = max(score[i], score[j] + passages.WEIGHT - passages.GAP_COST * (a[i] - a[j] + b[i] - b[j]))
        best = max(best, score[i])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_chain_is_best(seed):
    rng = np.random.default_rng(seed)
    pairs = sorted(set(zip(rng.integers(0, 60, 25).tolist(), rng.integers(0, 60, 25).tolist(), strict=True)))
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    own = passages.best_chain(a, b)
    x, y = a[own], b[own]
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all()
    assert len(own) * passages.WEIGHT - passages.GAP_COST * (x[-1] - x[0] + y[-1] - y[0]) == pytest.approx(brute_chain(a.tolist(), b.tolist()))


def test_chains_leave_no_match():
    at = np.arange(0, 96, 6)
    a, b = np.concatenate([at, at + 150, at + 300]), np.concatenate([at, at + 400, at + 200])
    found = list(passages.chains(a, b))  # A, B, C of the source come as A, C, B
    assert {(int(x), int(y)) for own in found for x, y in zip(*own, strict=True)} == set(zip(a.tolist(), b.tolist(), strict=True))
    single = list(passages.chains(np.array([0, 300, 600]), np.array([600, 300, 0])))
    assert sorted((int(x[0]), int(y[0])) for x, y in single) == [(0, 600), (300, 300), (600, 0)]


def corpus():
    rng = random.Random(9)
    words = lambda n: rng.choices(VOCABULARY, k=n)
    shared = [words(n) for n in (60, 90, 400)]
    docs, planted = [], {}
    for i in range(45):
        own = words(rng.randint(80, 500))
        if i % 3 == 0:
            which = i // 3 % 3
            passage = list(shared[which])
            if i % 2:
                for at in range(20, len(passage), 40):
                    passage[at] = f"other{i}"
            at = rng.randint(0, len(own))
            own[at:at] = passage
            planted[i] = which, at, len(passage)
        docs.append((i, " ".join(own)))
    return docs, planted


def test_passages(spark):
    docs, planted = corpus()
    docs += [(100, None), (101, ""), (102, "too short"), (None, docs[0][1]), (103, docs[3][1]), (103, docs[3][1])]
    frame = spark.createDataFrame([(*d, len(d[1] or ""), "z") for d in docs], "doc_id long, text string, n_chars long, source string")
    rows = passages.passages(frame).collect()
    first = {}
    for i, (which, at, n) in planted.items():
        if which not in first:
            first[which] = i
            assert not [r for r in rows if r["doc_id"] == i]
            continue
        own = [r for r in rows if r["doc_id"] == i]
        assert len(own) == 1 and abs(own[0]["start_word"] - at) <= 2 and abs(own[0]["end_word"] - at - n) <= 2 and own[0]["source_doc_id"] < i
    assert {r["doc_id"] for r in rows} == set(planted) - set(first.values()) | {103}
    cut = passages.without_passages(frame)
    assert cut.columns == frame.columns
    left = {r["doc_id"]: r for r in cut.collect()}
    assert 103 not in left and left[1]["text"] == docs[1][1] and all(r["n_chars"] == len(r["text"]) for k, r in left.items() if r["text"])
    assert left[102]["text"] == "too short" and 100 in left and 101 in left and None in left
    assert passages.passages(frame.limit(0)).count() == 0
    clash = frame.selectExpr("*", "1 AS _id", "'x' AS _spans", "2 AS _row", "3 AS _key")
    assert {r["doc_id"]: r["text"] for r in passages.without_passages(clash).collect()} == {k: r["text"] for k, r in left.items()}
    assert passages.without_passages(clash).columns == clash.columns


def test_exact_runs_with_rewritten_words_between(spark):
    """Exact runs of over 50 words are found whatever other runs of the same source are near."""
    rng = random.Random(17)
    words = lambda n: rng.choices(VOCABULARY, k=n)
    source = words(900)
    new = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    near = source[300:360] + new(20) + source[380:392] + new(100)
    several = source[500:555] + new(30) + source[585:640] + new(35) + source[675:730]
    rows = passages.passages(spark.createDataFrame([(1, " ".join(source)), (2, " ".join(new(40) + near)), (3, " ".join(several))], "doc_id long, text string")).collect()
    got = sorted((r["doc_id"], r["start_word"], r["end_word"], r["source_start_word"]) for r in rows)
    assert got == [(2, 40, 100, 300), (3, 0, 55, 500), (3, 85, 140, 585), (3, 175, 230, 675)]


@pytest.mark.parametrize("seed", range(6))
def test_similar_spans(seed):
    rng = np.random.default_rng(seed)
    equal = rng.random(120) < rng.choice([0.6, 0.75, 0.85])
    found = passages.similar(equal, 0.8, 10)
    assert all(equal[x:y].mean() >= 0.8 - 1e-6 and y - x >= 10 for x, y in found) and all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
    enough = [j - i for i in range(120) for j in range(i + 10, 121) if equal[i] and equal[j - 1] and equal[i:j].sum() >= 0.8 * (j - i)]
    assert max((y - x for x, y in found), default=0) == max(enough, default=0)


def test_every_eighth_word_changed(spark):
    """Passages of 60 words with one word in eight changed, which share no run of eight words."""
    rng = random.Random(23)
    sources = [rng.choices(VOCABULARY, k=200) for _ in range(20)]
    docs = [(i, " ".join(s)) for i, s in enumerate(sources)]
    docs += [(100 + i, " ".join(w if j % 8 else f"n{i}-{j}" for j, w in enumerate(s[70:130]))) for i, s in enumerate(sources)]
    rows = passages.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["source_doc_id"]) for r in rows) == [(100 + i, i) for i in range(20)]


@pytest.mark.parametrize("seed", range(5))
def test_many_extensions_are_as_one_by_one(seed):
    rng = np.random.default_rng(seed)
    pairs = []
    for _ in range(300):
        u = rng.integers(0, 30, rng.integers(0, 40))
        v = np.delete(u, rng.integers(0, len(u), rng.integers(0, 3))) if len(u) and rng.random() < 0.7 else rng.integers(0, 30, rng.integers(0, 40))
        v = np.where(rng.random(len(v)) < 0.1, 99, v)
        pairs.append((u, v))
    us, vs = np.full((300, 40), 1000), np.full((300, 40), 2000)
    for i, (u, v) in enumerate(pairs):
        us[i, : len(u)], vs[i, : len(v)] = u, v
    ends, places = passages.extend_many(us, vs)
    for i, (u, v) in enumerate(pairs):
        one = passages._extend(u, v)
        assert ends[i] == len(one) and (places[i, : ends[i]] == one).all() and (places[i, ends[i] :] == -1).all()


def test_hot_seeds_change_nothing(spark, monkeypatch):
    rng = random.Random(7)
    shared = [" ".join(rng.choices(VOCABULARY, k=60)) for _ in range(3)]
    rows = [(i, " ".join([*rng.choices(VOCABULARY, k=30), rng.choice(shared), *rng.choices(VOCABULARY, k=30), "one of the usual lines"])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, passages.passages(docs).collect()))
    seeds = np.concatenate([passages.seeds(passages.word_hashes(t, passages.Words()))[0] for t in [*shared, "one of the usual lines"]])
    monkeypatch.setattr(passages, "hot_seeds", lambda docs: np.unique(seeds))
    monkeypatch.setattr(passages, "CROWD", 5)
    assert len(plain) >= 117 and sorted(map(tuple, passages.passages(docs).collect())) == plain


def test_copies_and_hot_seeds_make_no_rows_of_a_join(spark, monkeypatch):
    """Whole copies are one passage each, give no seeds, and are no sources; those of ids that rows repeat are not taken
    for copies. No matches of hot seeds come from a join."""
    rng = random.Random(71)
    long, short, shared = (" ".join(rng.choices(VOCABULARY, k=n)) for n in (90, 30, 60))
    part = " ".join([*rng.choices(VOCABULARY, k=40), shared])
    rows = [(1, shared + " end"), (2, long), (3, part), (4, long), (5, part), (6, short), (7, short), (8, part), (9, long), (9, long), (None, long), (10, None), (11, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(3, 40, 100, 60, 1.0, 1, 0), (4, 0, 90, 90, 1.0, 2, 0), (5, 0, 100, 100, 1.0, 3, 0), (8, 0, 100, 100, 1.0, 3, 0)}
    seeded, seen = passages.seeded, []
    monkeypatch.setattr(passages, "seeded", lambda docs, hot: seen.append({r["doc_id"] for r in docs.select("doc_id").collect()}) or seeded(docs, hot))
    for small in (0, 100):
        monkeypatch.setattr(passages, "SMALL", small)
        got = {tuple(r) for r in passages.passages(docs).collect() if r["doc_id"] != 9}
        assert got == want and not seen[-1] & {4, 5, 7, 8}
    monkeypatch.setattr(passages, "hot_seeds", lambda docs: np.unique(passages.seeds(passages.word_hashes(shared, passages.Words()))[0]))
    assert {tuple(r) for r in passages.passages(docs).collect() if r["doc_id"] != 9} == want
    found = passages.matches(docs)[0]
    assert found.where("source_pos < 0").count() > 0 and "Join" not in found._jdf.queryExecution().toString()

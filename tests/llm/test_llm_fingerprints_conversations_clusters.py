"""Order MinHash, conversation repair and centroid clustering against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from residuum.llm import conversations, order_minhash, queries, va_clusters

MASK = (1 << 64) - 1
ODD = 0x9E3779B97F4A7C15


# ---------------------------------------------------------------- order minhash

def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def plain_run(points):
    """Hash of one run, put together from its halves as the module describes."""
    power, total, done, left = [(p + 1) * 0xBF58476D1CE4E5B9 & MASK for p in points], 0, 0, len(points)
    length = 1
    while left:
        if left & 1:
            total = mixed((total * ODD + power[done]) & MASK)
            done += length
        left >>= 1
        if left:
            power = [(a * ODD + b) & MASK for a, b in zip(power, power[length:])]
            power = [p ^ (p >> 29) for p in power]
            length *= 2
    return total


def plain_sketch(text, width=8, picked=2, functions=64):
    points = [ord(c) for c in text]
    if not points:
        return []
    w = min(width, len(points))
    hashes = [plain_run(points[i : i + w]) for i in range(len(points) - w + 1)]
    seen, keys = Counter(), []
    for h in hashes:
        n = seen[h]
        seen[h] += 1
        keys.append((mixed((h + n * ODD) & MASK) if n else h) >> 32)
    out = []
    for f in range(functions):
        factor = (mixed((f + 1) * ODD & MASK) >> 32) | 1
        least = sorted(range(len(keys)), key=lambda i: (keys[i] * factor & 0xFFFFFFFF, i))[:picked]
        total = f
        for i in sorted(least):
            total = mixed((total * ODD + hashes[i]) & MASK)
        out.append(total >> 48)
    return out


TEXTS = ["", "a", "abcdefgh", "abcdefghi", "the same words again and again, the same words again", "\U0001F600 smile é", "x" * 40, "tick tock " * 30]


def test_sketches_equal_the_plain_version():
    factors = order_minhash.multipliers()
    for text in TEXTS:
        assert order_minhash.sketch(text, factors).tolist() == plain_sketch(text)


def test_order_counts():
    factors = order_minhash.multipliers()
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(7)) for _ in range(300)]
    a, turned = " ".join(words), " ".join(words[150:] + words[:150])
    close = " ".join(words[:140] + words[150:])
    one, two, three = (order_minhash.sketch(t, factors) for t in (a, close, turned))
    assert order_minhash.agreement(one, two) > order_minhash.agreement(one, three) > 0.2  # same runs, other order
    assert order_minhash.agreement(one, two) > 0.8


def plain_edits(rows):
    low = -(1 << 63)

    def tie(t):
        import xxhash
        n = xxhash.xxh64_intdigest(t.encode(), 42)
        return n - (1 << 64) if n >> 63 else n

    order = sorted(((low if i is None else i, tie(t or ""), i, t or "") for i, t in rows), key=lambda r: (-r[0], -r[1]))
    out = []
    for j, (_, _, i, t) in enumerate(order):
        u = order[(j + 1) % len(order)][3]
        h = len(t) // 2
        e = t[: len(t) - h] + u[:h]
        a, b, c = (plain_sketch(x) for x in (t, e, u))

        def near(p, q):
            return float(len(p) == len(q)) if not p or not q else sum(x == y for x, y in zip(p, q)) / len(p)

        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), near(a, b), near(a, c)))
    return out


@pytest.mark.parametrize("size,ids", [(1, "own"), (40, "own"), (60, "hot"), (0, "own")])
def test_edited_texts(spark, monkeypatch, size, ids):
    monkeypatch.setattr(order_minhash, "SLICE_ROWS", 7)
    rng = random.Random(size)
    rows = [(None if rng.random() < 0.1 else (5 if ids == "hot" and rng.random() < 0.7 else k), rng.choice([None, "", "ab", *TEXTS, str(k) * 5])) for k in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "tie": F.lit("x"), "slice": F.lit(2), "guest": F.lit(3)})
    got = [(r["id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in order_minhash.with_edits(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_edits(rows)))


def test_likeness_column_and_fingerprints(spark):
    texts = [*TEXTS, None, "word " * 20_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    f = order_minhash.fingerprints(docs)
    names = {r["id"]: r["fingerprint"] for r in f.collect()}
    assert names[0] == names[len(TEXTS)] == "" and len(set(names.values())) == len(TEXTS) + 1
    pairs = f.alias("a").crossJoin(f.alias("b")).select(
        F.col("a.fingerprint").alias("p"), F.col("b.fingerprint").alias("q"), order_minhash.likeness(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("n"))
    for r in pairs.collect():
        p, q = (np.frombuffer(bytes.fromhex(r[c]), ">u2") for c in "pq")
        assert r["n"] == pytest.approx(order_minhash.agreement(p, q))


# ---------------------------------------------------------------- conversations

def plain_cheapest(initials, faults):
    """(cost, letters): least over all edits, by going through the turns backwards."""
    best = {}
    for i in range(len(initials), -1, -1):
        here = {}
        for s in "0sua":
            ways = []
            if i == len(initials):
                ways += [(0, "")] if s in "0a" else []
            else:
                nxt = best[i + 1]
                ways.append((3 + nxt[s][0], "D" + nxt[s][1]))
                if faults[i] in ("fine", "truncated"):
                    more, c = faults[i] == "truncated", initials[i]
                    if (s, c) in {("0", "s"), ("0", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                        ways.append((more + nxt[c][0], "K" + nxt[c][1]))
                    t = "a" if s == "u" else "u"
                    ways.append((2 + more + nxt[t][0], "R" + nxt[t][1]))
            here[s] = min(ways, default=(10**9, ""))
        for _ in range(4):
            for s in "0sua":
                t = "a" if s == "u" else "u"
                here[s] = min(here[s], (2 + here[t][0], "I" + here[t][1]))
        best[i] = here
    return best[0]["0"]


def plain_repair(rows):
    """Contract rows of (conv_id, turn, role, text)."""
    groups, known = {}, []
    for conv, turn, role, text in rows:
        known.append(conv)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = groups.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv in set(known):
        def digest(r):
            return hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()

        own = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))
        turns = [r[0] for r in own if r[0] is not None]
        seen, faults = set(), []
        for _, role, text in own:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "fine")
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        cost, letters = plain_cheapest(initials, faults)
        lines, state, at = [], "0", 0
        for x in letters:
            t = "a" if state == "u" else "u"
            name = {"a": "assistant", "u": "user"}[t]
            if x == "I":
                lines.append(f"{name}:")
                state = t
                continue
            _, role, text = own[at]
            at += 1
            if x == "R":
                lines.append(f"{name}:{text}")
                state = t
            elif x == "K":
                lines.append(f"{role}:{text}")
                state = role[0]
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
        c = Counter(faults)
        wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, c["blank"], c["duplicate"], c["truncated"], wrong, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_turns(seed, conversations_=120):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations_):
        conv = None if conv == 7 else conv
        for t in range(rng.choice([1, 1, 2, 3, 4, 7, 8, 9, 30])):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2] if rng.random() < 0.95 else rng.choice(["system", None, "", "tool", "User"])
            rows.append((conv, rng.choice([None, 0, t]) if rng.random() < 0.1 else t * rng.choice([1, 1, 1, 2]), role, rng.choice([None, "", " \n", "Yes.", "No", "Why? ", "A. B", "long " * 50 + "!"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations_against_brute_force(spark, seed):
    rows = random_turns(seed) + [(500, None, None, None), (501, 3, "system", "Be kind."), (502, 1, "assistant", "Hm!")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = turns.withColumns({c: F.lit(1) for c in ("copy", "kind", "name", "code", "values", "audit", "edit", "place", "cost", "fault", "again", "first")})
    damaged = conversations.damage(clash)
    audits = conversations.audit(damaged, clash).cache()
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.digest(damaged, audits).collect()}
    want = plain_repair(rows)
    assert got == want
    lines = {}
    for r in conversations.repaired(damaged, audits).orderBy("conv_id", "place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert all(hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == w[-1] for c, w in want.items())
    audits.unpersist()


def test_long_conversation_and_empty_table(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"{t % 5000}" + rng.choice([".", "", "!"])) for t in range(20_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    damaged = conversations.damage(turns)
    got = [tuple(r) for r in conversations.digest(damaged, conversations.audit(damaged, turns)).collect()]
    assert got == [(1, *plain_repair(rows)[1])] if len(rows) < 500 else got[0][6] == conversations_cost(rows)
    none = turns.limit(0)
    assert conversations.digest(none, conversations.audit(none, none)).count() == 0


def conversations_cost(rows):
    """Cost only, forwards over four states."""
    far = {"0": 0}
    seen = set()
    for _, turn, role, text in rows:
        kind = zlib.crc32(f"1:{turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        for _ in range(2 if kind == 3 else 1):
            for _ in range(3):
                for s in list(far):
                    t = "a" if s == "u" else "u"
                    far[t] = min(far.get(t, 10**9), far[s] + 2)
            fault = "blank" if not text else "duplicate" if (role, text) in seen else "truncated" if text[-1] not in ".!?" else "fine"
            seen.add((role, text))
            new = {s: d + 3 for s, d in far.items()}
            if fault in ("fine", "truncated"):
                for s, d in far.items():
                    t = "a" if s == "u" else "u"
                    new[t] = min(new.get(t, 10**9), d + 2 + (fault == "truncated"))
                    if (s, role[0]) in {("0", "s"), ("0", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                        new[role[0]] = min(new.get(role[0], 10**9), d + (fault == "truncated"))
            far = new
    ends = {"0": 0, "s": 4, "u": 2, "a": 0}
    return min(d + ends[s] for s, d in far.items())


# ---------------------------------------------------------------- clusters

def plain_clusters(rows, dims, k=8, rounds=10):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, tuple(int(np.floor(1024 * float(x))) for x in v)))
    if not kept:
        return [], []
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes()))[:k]
    c = [list(v) for _, v in start]

    def assign():
        out = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, m)) for m in c]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        a = assign()
        for j in range(len(c)):
            own = [v for (_, v), (g, _) in zip(kept, a) if g == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    return [(i, *a) for (i, _), a in zip(kept, assign())], c


@pytest.mark.parametrize("fetch", [0, va_clusters.FETCHED])
@pytest.mark.parametrize("dims,n", [(64, 300), (5, 200), (3, 4), (2, 0)])
def test_clusters_against_brute_force(spark, dims, n, fetch):
    rng = np.random.default_rng(dims)
    middle = rng.normal(0, 1, (4, dims))
    rows = [(int(i) if i % 11 else None, [float(np.float32(x)) for x in middle[i % 4] + rng.normal(0, 0.05, dims)]) for i in range(n)]
    if n > 20:
        rows += rows[:9] + [(900, None), (901, []), (902, [None] * dims), (903, [float("nan")] * dims), (904, [1.0] * (dims + 1)), (905, [float("inf")] + [0.0] * (dims - 1)), (906, [-3.5] * dims)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"key": F.lit(1), "vector": F.lit("x"), "cells": F.lit("x"), "id": F.lit(2)})
    report = []
    got, centroids = va_clusters.cluster(frame, dims=dims, fetch=fetch, report=report)
    want, c = plain_clusters(rows, dims)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    assert centroids.tolist() == c
    if n == 300:
        assert min(report[1:]) < 200  # in some round most vectors are decided by their cells


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_intervals_hold(bits):
    rng = np.random.default_rng(5)
    x = rng.integers(-500, 500, (400, 11))
    limits = np.sort(rng.integers(-400, 400, (11, (1 << bits) - 1)), axis=1)
    store = va_clusters.Store(None, limits, x.min(axis=0), x.max(axis=0), bits)
    centroids = rng.integers(-500, 500, (5, 11))
    least, greatest = va_clusters.bound_tables(centroids, store)
    cells = va_clusters.cells_of(x, limits, bits)
    assert cells.shape[1] == store.width
    low = sum(least[j][cells[:, j]] for j in range(store.width))
    high = sum(greatest[j][cells[:, j]] for j in range(store.width))
    far = ((x[:, None, :] - centroids) ** 2).sum(axis=2)
    less = far - ((x - centroids.sum(axis=0) // 5) ** 2).sum(axis=1)[:, None]
    assert (low <= less).all() and (less <= high).all()
    found = va_clusters.by_cells(cells, (least, greatest))
    assert (found[found >= 0] == far.argmin(axis=1)[found >= 0]).all()
    assert (found >= 0).mean() > (0.9 if bits == 8 else 0.0)


# ---------------------------------------------------------------- registered queries

def test_registered_queries(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in queries.QUERIES["op12_conversation_repair"](spark, folder).collect()} == plain_repair(rows)
    docs = [tuple(r) for r in queries.table(spark, folder, "documents").select("doc_id", "text").collect()][:]
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_document_fingerprints"](spark, folder).collect()}
    order = sorted(docs, key=lambda r: -r[0])
    for j, (i, t) in enumerate(order):
        t, u = t or "", order[(j + 1) % len(order)][1] or ""
        h = len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - h] + u[:h]).encode()).hexdigest() and got[i]["n_chars"] == len(t)
    assert len(got) == len(docs)
    vectors = [tuple(r) for r in queries.table(spark, folder, "embeddings").select("vec_id", "embedding").collect()]
    want, c = plain_clusters(vectors, 64)
    rows = queries.QUERIES["op13_centroid_clusters"](spark, folder).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in rows) == sorted(want)
    for r in rows:
        assert r["inertia"] == sum(w[2] for w in want) and r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest()

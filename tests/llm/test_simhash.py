from __future__ import annotations

import random

import xxhash
from pyspark.sql import functions as F

from codelabels.llm import simhash
from codelabels.llm.components import components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_links_connect_what_is_within_two_bits(spark):
    rng = random.Random(5)
    prints = {0, 1, 3, (1 << 64) - 1, 1 << 63, 1 << 31, 1 << 32}
    for _ in range(12):
        value = rng.getrandbits(64)
        for _ in range(25):
            prints.add(value)
            for _ in range(rng.choice((1, 1, 2, 3))):
                value ^= 1 << rng.randrange(64)
    prints |= {rng.getrandbits(64) for _ in range(50)}
    prints = [signed(p) for p in prints]
    wanted = groups(prints, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    for few in (64, 4, 0):
        found = simhash.links(frame, few)
        assert all(0 < bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 2 for r in found.collect())
        roots = {r["node"]: r["root"] for r in components(found, "a", "b").collect()}
        assert {p: roots.get(p, p) for p in prints} == wanted


def test_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1300)] + [(5, 5), (1, 0)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert roots == {i: 0 for i in range(1, 301)} | {k: 1000 for k in range(1001, 1300)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def documents(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 5) for _ in range(200)) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        rows += [(100 + i, t), (200 + i, t.replace(t.split()[50], "other", 1)), (300 + i, t.upper() + " \n")]
    rows += [(50, ""), (51, None), (52, " \t\n"), (53, "one"), (54, "one two"), (55, "ONE\x0btwo"), (56, "é É"), (None, base[0]), (None, "nameless text of its own"), (None, "nameless text of its own"), (7, base[7])]
    rows.append((60, "long text again " * 20_000))
    return rows, spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, root int")


def test_documents_against_brute_force(spark):
    rows, docs = documents(spark)
    found = sorted(((r["doc_id"], r["fp"], r["component"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    prints = {t: signed(brute_print(t)) for _, t in rows}
    root = groups(sorted(set(prints.values())), lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2)
    names = {}
    for i, t in rows:
        names.setdefault(root[prints[t]], set()).add(i)
    assert found == sorted(((i, prints[t], min(names[root[prints[t]]] - {None}, default=None)) for i, t in rows), key=str)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    wanted = sorted(str(min(n - {None}, default=None)) for n in names.values())
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == wanted


def test_empty(spark):
    docs = documents(spark)[1].limit(0)
    assert simhash.near_duplicates(docs).collect() == [] == simhash.representatives(docs).collect()


def test_hex(spark):
    assert [r[0] for r in spark.createDataFrame([(-1,), (0,), (255,)], "v long").select(simhash.as_hex(F.col("v"))).collect()] == ["f" * 16, "0" * 16, "0" * 14 + "ff"]


def test_one_row_per_component_though_keys_repeat(spark):
    rng = random.Random(9)
    a, b, c, d = (" ".join(rng.choice("abcdefghij") * rng.randrange(1, 5) for _ in range(300)) for _ in range(4))
    rows = [(7, a), (7, b), (9, c), (7, a), (8, b), (None, d), (None, a), (None, None), (None, ""), (3, c), (7, None)]
    kept = simhash.representatives(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, root int, name string"))
    # Null and empty texts are one component; the key seven stands for three.
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(7, a), (7, b), (3, c), (None, d), (7, None)], key=str)

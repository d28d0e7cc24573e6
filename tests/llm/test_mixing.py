from __future__ import annotations

import random
from collections import defaultdict
from fractions import Fraction
from hashlib import md5

from pyspark.sql import functions as F

from codelabels.llm import mixing


def brute_share(nodes, given):
    """nodes: name -> (capacity, weight). Full ones leave their share to the others, round by round."""
    given = min(given, sum(c for c, _ in nodes.values()))
    open_nodes, left, out = dict(nodes), given, {}
    while open_nodes:
        weight = sum(w for _, w in open_nodes.values())
        full = {n for n, (c, w) in open_nodes.items() if Fraction(left * w, weight) >= c}
        if not full:
            return out | {n: left * w // weight for n, (_, w) in open_nodes.items()}
        for n in full:
            out[n] = open_nodes.pop(n)[0]
            left -= out[n]
    return out


def brute(rows, targets, budget, epochs, seed):
    leaves = defaultdict(list)
    for i, text, lang, source, dom in rows:
        leaves[dom or "", lang or "", source or ""].append((i, len((text or "").split())))
    tokens = {leaf: sum(n for _, n in docs) for leaf, docs in leaves.items()}
    weight = lambda level, name: getattr(targets, level).get(name, targets.rest)
    used = {x: t * epochs for x, t in tokens.items() if all(weight(lv, n) for lv, n in zip(mixing.LEVELS, x, strict=True))}
    total = sum(tokens.values()) if budget is None else budget
    group = lambda depth, prefix: {x[depth] for x in used if x[:depth] == prefix}
    cap = lambda prefix: sum(c for x, c in used.items() if x[: len(prefix)] == prefix)
    given = {(): total}
    for depth, level in enumerate(mixing.LEVELS):
        for prefix in [p for p in given if len(p) == depth]:
            names = group(depth, prefix)
            for n, b in brute_share({n: (cap((*prefix, n)), weight(level, n)) for n in names}, given[prefix]).items():
                given[(*prefix, n)] = b
    out = []
    for leaf, docs in leaves.items():
        b, t = given.get(leaf, 0), tokens[leaf]
        whole = b // t if t else 0
        left, taken, open_end = b - whole * t, [], leaf in used
        place = lambda i: md5(f"{seed}:{whole + 1}:{'' if i is None else i}".encode()).hexdigest()  # noqa: B023, E731
        for i, n in sorted(docs, key=lambda d: (place(d[0]), d[0] is not None, d[0] or 0, d[1])):  # noqa: B023
            open_end = open_end and n <= left
            left -= n
            taken.append((i, *leaf, n, whole + open_end))
        out += taken
    return sorted(out, key=str)


def sample(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        source = rng.choice(["s0"] * 6 + ["s1", "s2", "s3", None, ""])
        rows.append((i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["en", "en", "de", None]), source, rng.choice(["web", "web", "web", "books", "none"])))
    rows += [(None, "a b c", "en", "s0", "web"), rows[5], (900, None, "xx", "s9", "tiny"), (901, "", "en", "s0", "web"), (902, "w " * 30_000, "de", "s1", "books")]
    return rows, spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, dom string, domain int, leaf int")


def test_against_brute_force(spark):
    rows, docs = sample(spark)
    targets = mixing.Targets({"web": 5, "books": 1, "none": 0}, {"en": 3, "de": 1}, {"s0": 1, "s1": 7, "s2": 2})
    for budget, epochs in ((None, 4), (None, 1), (3_000, 2), (10**9, 3), (0, 2)):
        marked, leaves = mixing.plan(docs, targets, F.col("dom"), budget=budget, max_epochs=epochs, seed=3)
        found = sorted(map(tuple, mixing.copies(marked, leaves, 3).collect()), key=str)
        wanted = [tuple(r) for r in brute(rows, targets, budget, epochs, 3)]
        assert found == wanted
        mixed = mixing.mixed(docs, targets, F.col("dom"), budget=budget, max_epochs=epochs, seed=3)
        assert mixed.columns == docs.columns
        assert mixed.count() == sum(r[-1] for r in wanted)
        assert sum(r[-1] * r[-2] for r in wanted) <= (10**12 if budget is None else max(budget, 0))


def test_share_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "short", 10), ("a", "x", "long", 1000), ("a", "y", "s", 1000), ("b", "x", "s", 1000)], "domain string, language string, source string, tokens long")
    found = {tuple(r)[:3]: r["budget"] for r in mixing.budgets(leaves, mixing.Targets({}, {}, {}), 800, 1).collect()}
    assert found == {("a", "x", "short"): 10, ("a", "x", "long"): 190, ("a", "y", "s"): 200, ("b", "x", "s"): 400}


def test_empty(spark):
    docs = sample(spark)[1].limit(0)
    targets = mixing.Targets({}, {}, {})
    marked, leaves = mixing.plan(docs, targets, F.col("dom"))
    assert mixing.copies(marked, leaves).collect() == [] == mixing.mixed(docs, targets, F.col("dom")).collect()

import random

import pytest
import xxhash

from shelfmark.llm import simhash


def slow_fingerprint(text, k=4):
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(values, radius):
    ids = sorted(values, key=lambda x: (x[0] is None, x[0]))
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (ids[i][1] ^ ids[j][1]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(((ids[i][0], ids[find(i)][0]) for i in range(len(ids))), key=str)


def test_fingerprints_and_components(docs, empty):
    rows = docs.collect()
    want = {(r.doc_id, format(slow_fingerprint(r.text), "016x")) for r in rows}
    got = simhash.group(docs).select("doc_id", simhash.F.lower(simhash.F.hex("fp")).alias("fingerprint"), "component_id").collect()
    assert {(r.doc_id, r.fingerprint) for r in got} == want and len(got) == len(rows)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == slow_components([(r.doc_id, slow_fingerprint(r.text)) for r in rows], 4)
    assert simhash.group(empty).count() == 0


@pytest.mark.parametrize("blocks_for", [10, 2**22])
def test_links_of_clustered_values(spark, monkeypatch, blocks_for):
    """Dense clusters and chains, shards that are split into several trees, and more blocks."""
    r = random.Random(blocks_for)
    values = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(30):
            v = centre
            for _ in range(r.randint(0, 6)):
                v ^= 1 << r.randrange(64)
            values.add(v)
    monkeypatch.setattr(simhash, "SHARD", 7)
    classes = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")),) for v in sorted(values)], "fp binary")
    found = simhash.components(simhash.links(simhash.block_keys(classes, blocks_for, 4), 4)).collect()
    root = {int.from_bytes(x.node, "big"): int.from_bytes(x.root, "big") for x in found}
    groups = {}
    for v in values:
        groups.setdefault(root.get(v, v), set()).add(v)
    ranked = sorted(values)
    want = {}
    for a, b in slow_components(list(enumerate(ranked)), 4):
        want.setdefault(b, set()).add(ranked[a])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_survivors(spark, docs, empty):
    r = random.Random(12)
    rows = []
    for g in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(150, 400))]
        for c in range(r.choice([1, 1, 2, 5])):
            copy = list(words)
            for _ in range(int(len(words) * 0.015) if c else 0):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy), g))
    frame = spark.createDataFrame(rows, "doc_id long, text string, keys int")
    left = simhash.survivors(frame).collect()
    assert {x["keys"] for x in left} == set(range(40)) and len(left) <= 42
    first = {}
    for i, _, g in rows:
        first.setdefault(g, i)
    assert {first[g] for g in range(40)} <= {x.doc_id for x in left}
    kept = simhash.survivors(docs)
    texts = [x.text for x in kept.collect()]
    assert kept.schema == docs.schema and len(texts) == len(set(texts)) and simhash.survivors(empty).count() == 0


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def kept_by_force(rows):
    """The least id of each component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8."""
    sets = [frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := text.lower().split()) else frozenset() for _, text in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return {rows[i][0] for i in root}


def test_survivors_by_true_similarity(spark):
    """Pairs on both sides of 0.8, short texts, and copies that repeat a line many times."""
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    texts = ["", "one two"]
    for _ in range(150):
        base = words(r.choice([8, 9, 12, 60, 200]))
        copy = list(base)
        for _ in range(max(1, round(len(base) * r.uniform(0.01, 0.06)))):
            copy[r.choice([0, -1, r.randrange(len(copy))])] = f"x{r.randrange(10**6)}"
        texts += [" ".join(base), " ".join(copy), " ".join(base[:-1])]
    for _ in range(10):
        body, line = words(120), words(9)
        texts += [" ".join(body + line), " ".join(body + line * 40)]
    rows = list(enumerate(texts))
    got = {x.doc_id for x in simhash.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == kept_by_force(rows)


def test_links_of_candidates(monkeypatch):
    """Groups that are cut into parts hold each candidate pair; equal fingerprints don't link different texts."""
    r = random.Random(8)
    sets, members = [], []
    for _ in range(6):
        base = r.sample(range(10**6), 50)
        for _ in range(8):
            found = simhash.np.unique(simhash.np.array([r.randrange(10**6) if r.random() < 0.08 else x for x in base], simhash.np.uint64))
            sets.append(found)
            members.append(bytes(16) + len(members).to_bytes(8, "big") + len(found).to_bytes(4, "big"))
    monkeypatch.setattr(simhash, "PART_SHINGLES", 300)
    groups = {}
    for name, m in simhash.candidates_of_shard([int.from_bytes(m, "big") for m in members], None, 43, 0.8):
        groups.setdefault(name, []).append(members.index(m.to_bytes(28, "big")))
    assert len(groups) > 20
    whole = [set(s.tolist()) for s in sets]
    joined = lambda pairs: {frozenset(g) for g in connected(pairs, len(members))}
    got = [(members.index(a), members.index(b)) for g in groups.values() for a, b in simhash.links_of_group([members[i] for i in g], [sets[i] for i in g], 43, 0.8)]
    assert all(similar(whole[a], whole[b]) for a, b in got)
    assert joined(got) == joined([(i, j) for i in range(len(members)) for j in range(i) if similar(whole[i], whole[j])])


def connected(pairs, n):
    groups = {i: {i} for i in range(n)}
    for a, b in pairs:
        both = groups[a] | groups[b]
        groups |= dict.fromkeys(both, both)
    return groups.values()


def test_components_end_with_stars(spark):
    """Long chains, cycles, many small groups: the least node of each group, however the links lie."""
    r = random.Random(5)
    names = r.sample(range(1000), 200)
    pairs = [(names[i], names[i + 1]) for i in range(80)] + [(names[100 + i], names[100 + (i + 1) % 20]) for i in range(20)] + [(names[150 + 2 * i], names[151 + 2 * i]) for i in range(20)]
    root = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {x.node: x.root for x in got} == root and len(got) == len(root)
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tree_search_is_exact():
    r = random.Random(9)
    values = list({r.getrandbits(12) for _ in range(500)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:60]:
        assert sorted(tree.values[i] for i in tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def test_masks_lose_no_pair():
    r = random.Random(4)
    for n in (10, 2**23, 2**31):
        for _ in range(300):
            d = 0
            for b in r.sample(range(64), 4):
                d |= 1 << b
            assert any(d & m == 0 for m in simhash.masks(n, 4))


def test_no_join_is_broadcast(docs, monkeypatch):
    """Tables that grow with the corpus never pass through the driver, however small their files are."""
    plans, staged = [], simhash.staged

    def run(df):
        plan = df._jdf.queryExecution().executedPlan()
        plan.executeCollectPublic()
        plans.append(plan.toString())
        return df

    monkeypatch.setattr(simhash, "staged", lambda df, name: staged(run(df), name))
    run(simhash.group(docs))
    run(simhash.survivors(docs))
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_candidates_come_from_trees(monkeypatch):
    """The groups of a shard are the components of fingerprints within the radius and sizes within the similarity, and each kind of member searched trees for them."""
    r = random.Random(17)
    members = [bytes(16) + bytes(8) + bytes(4)]
    for _ in range(25):
        centre, size = r.getrandbits(128), r.choice([1, 4, 5, 40, 50, 1000])
        for _ in range(8):
            v = centre
            for b in r.sample(range(128), r.choice([0, 10, 30, 43, 44])):
                v ^= 1 << b
            members.append(v.to_bytes(16, "big") + len(members).to_bytes(8, "big") + max(1, round(size * r.uniform(0.7, 1.3))).to_bytes(4, "big"))
    number = lambda x: int.from_bytes(x, "big")
    pairs = [(i, j) for i, a in enumerate(members) for j, b in enumerate(members[:i]) if (number(a[:16]) ^ number(b[:16])).bit_count() <= 43 and min(number(a[24:]), number(b[24:])) >= 0.8 * max(number(a[24:]), number(b[24:]))]
    want = {frozenset(g) for g in connected(pairs, len(members)) if len(g) > 1}
    searched, within = set(), simhash.BKTree.within
    monkeypatch.setattr(simhash.BKTree, "within", lambda self, value, radius, live=None: searched.add((value, radius)) or within(self, value, radius, live))
    for others in (None, [number(m) for m in members[90:]]):
        groups = {}
        for name, m in simhash.candidates_of_shard([number(m) for m in members[: 90 if others else None]], others, 43, 0.8):
            groups.setdefault(name, set()).add(members.index(m.to_bytes(28, "big")))
        assert {frozenset(g) for g in groups.values()} == want and len(want) > 20
        assert searched == {(number(m[:16]), 43) for m in members}
        searched.clear()

import random

from shelfmark.llm import decontamination as d

WORDS = [f"w{i}" for i in range(400)]


def test_reordered_passages_are_caught(spark, empty):
    r = random.Random(3)
    item = r.sample(WORDS, 36)
    other = r.sample(WORDS, 36)
    filler = lambda: [f"f{r.randrange(10**6)}" for _ in range(40)]
    rows = [
        (1, " ".join(filler() + item + filler())),
        (2, " ".join(filler() + item[18:] + filler() + item[:18] + filler())),
        (3, " ".join(w.upper() + "," for w in item)),
        (4, " ".join(filler() + item[:20])),  # a little over half
        (5, " ".join(w for x in item for w in (x, "gap"))),  # all words, no passage
        (6, None), (7, ""), (8, "... !!! ?"), (None, " ".join(item)), (1, " ".join(filler() + item + filler())),
        (9, " ".join(item * 3)),
    ]
    docs = spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id long, text string, item_id string, coverage int")
    items = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(other)), (12, None), (13, ""), (14, "w1 w1")], "item_id long, text string")
    got = sorted(((x.doc_id, x.item_id) for x in d.matches(docs, items).collect()), key=str)
    assert got == sorted([(1, 10), (1, 10), (2, 10), (3, 10), (9, 10), (None, 10)], key=str)
    left = d.clean(docs, items)
    assert left.columns == docs.columns and sorted(x.doc_id for x in left.collect()) == [4, 5, 6, 7, 8]
    assert d.matches(empty, items).count() == 0 and d.matches(docs, items.limit(0)).count() == 0


def slow_tiling(a, b, least):
    """Greedy string tiling by trying everything, for the number of words matched."""
    ma, mb, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        if best[0] < least:
            return total
        n, i, j = best[0], -best[1], -best[2]
        ma[i : i + n] = mb[j : j + n] = [True] * n
        total += n


def test_tiling_against_brute_force():
    r = random.Random(8)
    for _ in range(60):
        a = [r.randrange(6) for _ in range(r.randint(5, 30))]
        cut = r.randrange(len(a))
        b = a[cut:] + [r.randrange(6) for _ in range(4)] + a[:cut] if r.random() < 0.7 else [r.randrange(6) for _ in range(30)]
        tiles = d.tiling(a, b, 3, start=8)
        used_a = [p + k for p, _, n in tiles for k in range(n)]
        used_b = [t + k for _, t, n in tiles for k in range(n)]
        assert len(set(used_a)) == len(used_a) and len(set(used_b)) == len(used_b)
        assert all(a[p : p + n] == b[t : t + n] and n >= 3 for p, t, n in tiles)
        assert len(used_a) == slow_tiling(a, b, 3)


def test_query_against_brute_force(spark, tmp_path):
    """Every document with every item, tiled in full."""
    r = random.Random(21)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([3, 5, 12, 30])))) for i in range(8)] + [(8, None), (9, "")]
    rows = [(None, items[3][1]), (500, None), (501, "")]
    for i in range(60):
        held = [w for _ in range(r.randint(0, 2)) for w in cut_up(r, r.choice(items[:8])[1].split())]
        rows.append((i, " ".join(held + [r.choice(words) for _ in range(r.randint(0, 30))])))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = []
    for doc_id, text in rows:
        for item_id, item in items:
            a, b = d.words_of(item), d.words_of(text)
            n = slow_tiling(a, b, min(5, len(a))) if a else 0
            if a and n >= 0.8 * len(a):
                want.append((doc_id, item_id, n, len(a)))
    got = [(x.doc_id, x.item_id, x.n_matched, x.n_item_words) for x in d.query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 10


def cut_up(r, words):
    """The words in two halves, the second one first, or as they are."""
    k = r.choice([0, len(words) // 2])
    return words[k:] + words[:k]


def test_blocks_hold_every_item(spark):
    items = spark.createDataFrame([(i, f"word{i} " * 20) for i in range(200)], "item_id long, text string")
    blocks = list(d.benchmark_blocks(items, block_bytes=8_000))
    assert len(blocks) > 1 and sorted(i for b in blocks for i, _ in b) == list(range(200))


def test_large_and_repeated_items(spark, monkeypatch):
    """Many equal rows and an item beyond the size of a block: every result, each equal row with its own."""
    r = random.Random(7)
    item, large, small = r.sample(WORDS, 36), [r.choice(WORDS) for _ in range(900)], r.sample(WORDS, 30)
    docs = spark.createDataFrame([(1, " ".join(item)), (2, "lead " + " ".join(large)), (3, "none of it"), (4, " ".join(small))], "doc_id long, text string")
    rows = [(10, " ".join(item))] * 50 + [(11, " ".join(large)), (None, " ".join(small)), (12, None)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    blocks = list(d.counted_blocks(items, block_bytes=400))
    assert sorted((x for b in blocks for x, _ in b), key=str) == sorted([(10, 50), (11, 1), (None, 1), (12, 1)], key=str) and len(blocks) > 1
    whole = d.counted_blocks
    monkeypatch.setattr(d, "counted_blocks", lambda items, *_: whole(items, block_bytes=400))
    got = [(x.doc_id, x.item_id) for x in d.matches(docs, items).collect()]
    assert sorted(got, key=str) == sorted([(1, 10)] * 50 + [(2, 11), (4, None)], key=str)
    assert [x.doc_id for x in d.clean(docs, items).collect()] == [3]

import hashlib
import random

import numpy as np
import pytest

from shelfmark.llm import suffix_dedup as s


def slow(rows):
    """(doc_id, text) to (doc_id, bytes, removed, spans, digest), by looking at every 50-byte string."""
    null = 2**63
    data = [(null if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in data:
        for p in range(len(t) - 49):
            least[t[p : p + 50]] = min(least.get(t[p : p + 50], null), i)
    out = []
    for i, t in data:
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - 49):
            if least[t[p : p + 50]] < i:
                gone[p + 1 : p + 51] = True
        kept = bytes(b for b, g in zip(t, gone[1:-1], strict=True) if not g)
        out.append((None if i == null else i, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()), key=str)


def test_edge_cases(docs, empty):
    assert result(s.digests(docs)) == slow([(r.doc_id, r.text) for r in docs.collect()])
    assert s.digests(empty).count() == 0
    kept = s.deduplicate(docs)
    assert kept.schema == docs.schema and kept.count() == docs.count()
    assert sum(len(r.text or "") for r in kept.collect()) < sum(len(r.text or "") for r in docs.collect())


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, monkeypatch, seed):
    """Passages of many lengths, small alphabets, runs of one byte, equal ids; many shards, groups and blocks."""
    r = random.Random(seed)
    letters = ["ab", "abcdefgh ", "é ñ", "a"][seed]
    pool = ["".join(r.choice(letters) for _ in range(r.choice([10, 25, 49, 50, 51, 90, 200]))) for _ in range(12)]
    rows = [(r.choice([i, i, 3]), "".join(r.choice(pool) for _ in range(r.randint(0, 9)))) for i in range(60)] + [(None, pool[0] * 5), (2**63 - 1, pool[0] * 5), (-(2**63), pool[1])]
    monkeypatch.setattr(s, "SHARD_BYTES", 300)
    monkeypatch.setattr(s, "CUTTING_BYTES", 2000)
    monkeypatch.setattr(s, "HOT_DOCS", [2, 5, 9, 10**9][seed])
    got = s.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert result(got) == slow(rows)


def test_blocks_and_groups(monkeypatch):
    monkeypatch.setattr(s, "BLOCK_BYTES", 100)
    r = random.Random(2)
    texts = [bytes(r.choice(b"abcd") for _ in range(n)) for n in (0, 10, 60, 333, 99, 100, 149, 1000, 51)]
    ids = np.arange(len(texts))
    together = s.Group(ids, ids, texts)
    h, first, count, doc = together.segments()
    alone = [x for d, t in enumerate(texts) for x in zip(*(y.tolist() for y in s.Group(ids[:1], ids[:1], [t]).segments()[:3]), [d] * 10**6)]
    assert [(a, b - int(together.start[d]), c, d) for a, b, c, d in zip(h.tolist(), first.tolist(), count.tolist(), doc.tolist(), strict=True)] == alone
    assert sum(count) == sum(max(0, len(t) - 49) for t in texts)


def test_rows_of_one_id_whose_tags_look_alike(spark):
    """They get each other's places, also such as lie behind their end: results stay right."""
    import xxhash

    r, seen, pair = random.Random(9), {}, None
    passage = "".join(r.choice("abcdefgh ") for _ in range(400))
    while not pair:
        t = "".join(r.choice("abcdefgh ") for _ in range(r.choice([55, 70, 300]))) + passage[: r.choice([0, 60, 400])]
        short = xxhash.xxh64_intdigest(t.encode(), 42) & s.SHORT & ~1
        if short in seen and abs(len(seen[short]) - len(t)) > 200:
            pair = seen[short], t
        seen[short] = t
    rows = [(1, passage), (2, pair[0]), (2, pair[1]), (2, pair[1]), (3, "x" + pair[0]), (4, pair[1] + "y" * 60)]
    assert result(s.digests(spark.createDataFrame(rows, "doc_id long, text string"))) == slow(rows)


def test_numbers_travel_unchanged():
    r = np.random.default_rng(1)
    sent = [r.integers(0, 255, 99).astype(np.uint8), np.zeros(0, np.int32), r.integers(-(2**62), 2**62, 7), np.array([1, 65_535], np.uint16)]
    assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(sent, s.unpacked(s.packed(*sent)), strict=True))


def test_a_common_passage_fills_no_shard(spark, monkeypatch):
    """A passage that all documents hold, each between other words: the windows at its edges are dealt singly."""
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    passage = word(120)
    rows = [(i, word(80) + passage + word(80)) for i in range(300)]
    most = []
    for hot in (10**9, 50):
        monkeypatch.setattr(s, "HOT_DOCS", hot)
        monkeypatch.setattr(s, "GROUP_BYTES", 3000)
        monkeypatch.setattr(s, "CUTTING_BYTES", 2000)
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        texts = s.tagged(frame, "doc_id", "text")
        places = s.staged(texts.mapInArrow(s.first_pass(16, 4, 64), s.ROWS).repartition(2, "shard").sortWithinPartitions("shard").mapInArrow(s.find_twins(4, 64), s.ROWS), "places")
        anchors = s.hot_anchors(places)
        assert (len(anchors) > 0) == (hot == 50)
        sent = s.delivered(texts, places, 4).mapInArrow(s.cut_out(40, 4, 64, anchors), s.ROWS).where("shard >= 0").collect()
        size = {}
        for x in sent:
            size[x.shard] = size.get(x.shard, 0) + int(s.unpacked(bytes(x.blob))[1].sum())
        most.append(max(size.values()))
        assert result(s.digests(frame)) == slow(rows)
    assert most[1] < most[0] / 2


def test_two_stages_sort_suffixes():
    r = np.random.default_rng(4)
    for letters in (1, 2, 3, 250):
        text = r.integers(0, letters, 400).astype(np.uint8)
        wanted = np.zeros(400, bool)
        wanted[:350] = r.random(350) < 0.6
        order, word = s.two_stage(text, wanted)
        body = text.tobytes() + bytes(64) + b"\1" + bytes(9)
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
        cut = [body[i : i + 50] for i in order]
        assert cut == sorted(cut)
        assert s.reaches(word, order).tolist() == [a == b for a, b in zip(cut, cut[1:], strict=False)]


def test_removal_keeps_whole_characters():
    data = "aéb".encode()
    a, b = s.whole_characters(data, np.array([2]), np.array([4]))
    assert s.without(data, a, b).decode() == "aé"

import random
import zlib

import numpy as np

from shelfmark.llm import packing, token_counts


def test_counts_equal_the_library(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    texts = [r.text for r in docs.collect()]
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in docs.collect())
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, limit=50).collect())
    assert got == want and len(texts) == len(got)
    assert all(r.over_limit == (r.n_tokens > 50) for r in token_counts.count_tokens(docs, limit=50).collect())
    assert token_counts.count_tokens(empty).count() == 0


def test_blanks_and_marks_against_the_library():
    import sentencepiece

    sp, lengths = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path()), token_counts.Lengths(token_counts.model_path(), {})
    assert [lengths.of(t) for t in ("x  \x00", " \x00", "  ", " ", "")] == [len(sp.encode(t)) for t in ("x  \x00", " \x00", "  ", " ", "")]
    r = random.Random(11)
    for _ in range(4000):
        t = "".join(r.choice(["\x00", " ", " ", "\n", "▁", "a", "é", "the", "<s>", "\u200b", "\u3000", "字"]) for _ in range(r.randint(0, 9)))
        assert lengths.of(t) == len(sp.encode(t)), repr(t)


def test_full_cache_starts_again():
    lengths = token_counts.Lengths(token_counts.model_path(), {"frequent": token_counts.Lengths(token_counts.model_path(), {})["frequent"]}, limit=3)
    words = [f"word{i}" for i in range(50)] * 2
    fresh = token_counts.Lengths(token_counts.model_path(), {})
    assert [lengths[w] for w in words] == [fresh[w] for w in words] and len(lengths) < 10


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    from tests.llm.conftest import odd_texts

    t, ids = Tokenizer.from_file(packing.model_path()), packing.Ids(packing.model_path())
    texts = odd_texts() + ["It's I'LL don't 12 3.5 x's. A.B. end!", "ΟΔΟΣ. ΟΔΟΣ", "İ KK"]
    for text, data in zip(texts, packing.ids_of(texts, ids), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids + [2], text


def test_pack_round_trip(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.model_path())
    rows = packing.pack(docs).collect()
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(t.encode(r.text or "", add_special_tokens=False).ids + [2])
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        ids = want[r.doc_id][0]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for doc_id, copies in want.items():
        assert sum(r.length for r in rows if r.doc_id == doc_id) == sum(map(len, copies))
    assert packing.pack(empty).count() == 0


def test_ids_are_the_library_s_own():
    import random

    from tokenizers import Tokenizer

    t, ids, r = Tokenizer.from_file(packing.model_path()), packing.Ids(packing.model_path()), random.Random(11)
    plain = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(161, 256)]]
    parts = ["don't", "WE'LL", "it''s", "x'", "ÀÉ", "ÿß", "²3½", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "a.%%%", "\xa0", "\x85", "\x1c", "\0", "İ", "Σς", "e\u0301", "中文", "𝔘", "’s", "q" * 200, "Ab" * 50]
    texts = ["".join(r.choice(plain) for _ in range(r.randrange(40))) for _ in range(6000)]
    texts += ["".join(r.choice(parts if r.random() < 0.3 else [*plain, "the", " of ", "'s", "  "]) for _ in range(r.randrange(25))) for _ in range(6000)]
    for text, got in zip(texts, packing.ids_of(texts, ids), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids + [2], repr(text)


def test_short_texts_fill_their_sequences(spark):
    words = ["the", "of and", "a word", "", None, "one two three four five", "x, y; z.", "many " * 61]
    rows = packing.pack(spark.createDataFrame([(i, words[i * i % 8 if i % 5 else 7 * i % 8]) for i in range(9001)], "doc_id long, text string")).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(rows) == 9001 and len({r.doc_id for r in rows}) == 9001
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_bundles_hold_every_piece_once():
    histogram = {-1: 33, -2: 7, -6: 100, -63: 17, -64: 5, 4: 3, 5: 2, 256: 1, 0: 9}
    units, bundles = packing.bundled(histogram)
    ranks = {u: [] for u in units}
    for c, n in histogram.items():
        for rank in range(n if c else 0):
            first, pieces, u, start = max(r for r in bundles[c].tolist() if r[0] <= rank)
            assert pieces * max(-c, 0) <= u * packing.UNIT < pieces * max(-c, 0) + packing.UNIT or c > 0
            ranks[u].append((start + (rank - first) // pieces, (rank - first) % pieces, c))
    for u, n in units.items():
        assert len(set(ranks[u])) == len(ranks[u]) and {r[0] for r in ranks[u]} == set(range(n))


def test_plan_holds_everything_and_wastes_little():
    rng = np.random.default_rng(1)
    lengths = np.clip((rng.lognormal(4.0, 1.0, 20_000)).astype(int), 1, 255)
    histogram = {int(c): int(n) for c, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    patterns = packing.plan(histogram)
    held = {}
    for copies, items in patterns:
        assert sum(c * n for c, n in items.items()) <= 256
        for c, n in items.items():
            held[c] = held.get(c, 0) + copies * n
    assert held == histogram
    bins = sum(c for c, _ in patterns)
    assert bins <= int(lengths.sum() / 256 * 1.01) + 2


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        size, value = np.unique(rng.integers(2, 12, 4)), None
        value = rng.random(len(size))
        best = [0.0] * 31
        for c in range(1, 31):
            best[c] = max([best[c - 1]] + [best[c - s] + v for s, v in zip(size, value, strict=True) if s <= c])
        got, items = packing.knapsack(value, size, 30)
        assert abs(got - best[30]) < 1e-9 and sum(size[i] * k for i, k in items.items()) <= 30

import random
import zlib

import numpy as np
import pytest

from shelfmark.llm import langid, toxicity
from shelfmark.llm.common import first_of

CRC = lambda i: zlib.crc32(str(i).encode()) % 4


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        words = [r.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(r.randint(5, 60))]
        toxic = r.random() < 0.3
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["Vile,", "rotten"]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, label string"), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")


def test_toxic_rows_are_found(corpus, docs, empty, spark):
    texts, labels = corpus
    model = toxicity.fit(texts, labels)
    truth = {r.doc_id: r.toxic for r in labels.where("doc_id is not null and toxic is not null").collect()}
    rows = toxicity.score(texts, model).collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (CRC(r.doc_id) == 2) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and toxicity.score(empty, model).count() == 0
    nothing = toxicity.score(texts, toxicity.fit(texts, labels.limit(0))).collect()
    assert all(r.score < 1e-6 and r.predicted == 0 for r in nothing)


def test_training_skips_held_out_rows(corpus, spark):
    texts, labels = corpus
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(texts, labels), toxicity.fit(texts, flipped)
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_penalty_leaves_few_weights(corpus):
    texts, labels = corpus
    at, w, _ = toxicity.fit(texts, labels)
    assert 0 < len(at) < 200 and len(at) == len(w)
    assert len(at) < len(toxicity.fit(texts, labels, l1=0.5)[0])


def test_scores_against_brute_force(corpus, docs):
    """Each score from its text's words, pairs, skipped pairs and stems, one by one."""
    at, w, b = model = toxicity.fit(*corpus)
    weight, hashes, mask = dict(zip(at.tolist(), w.tolist(), strict=True)), toxicity.WordHashes(), 2**64 - 1
    stems = toxicity.WordHashes(toxicity.STEM)
    k = [int(x) for x in toxicity._K]
    for r in toxicity.score(docs, model).join(docs.select("text", docs.doc_id.alias("_d")), toxicity.F.col("_d").eqNullSafe(toxicity.F.col("doc_id"))).collect():
        u = [h for h in (hashes[x] for x in (r.text or "").lower().split()) if h]
        found = {(h * k[0] & mask) >> 64 - toxicity.BITS for h in u}
        for gap in (1, 2):
            found |= {((((x * k[1]) ^ (y * k[2])) & mask) * k[3] + k[gap] & mask) >> 64 - toxicity.BITS for x, y in zip(u, u[gap:], strict=False)}
        found |= {(h * k[1] + k[0] & mask) >> 64 - toxicity.BITS for h in (stems[x] for x in (r.text or "").lower().split()) if h}
        want = 1 / (1 + np.exp(-(b + sum(weight.get(f, 0.0) for f in found))))
        assert abs(r.score - want) < 1e-9 and r.predicted == (r.score >= 0.3)


def test_forms_of_a_word_that_were_never_learned(spark):
    """A toxic stem with endings that each occur once; short words have no stem of their own."""
    r = random.Random(5)
    ending = lambda: "".join(r.choice("aeioulnrst") for _ in range(6))
    rows, labels = [], []
    for i in range(600):
        words, toxic = [r.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(20)], i % 3 == 0
        words[3], words[9] = (("Widr" if toxic else "gute") + ending() for _ in range(2))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    texts, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = [x for x in toxicity.score(texts, toxicity.fit(texts, known)).collect() if x.held_out]
    assert np.mean([x.predicted == (x.doc_id % 3 == 0) for x in held]) > 0.95
    stems = toxicity.WordHashes(4)
    assert stems["widrig."] == stems["(widrum"] != 0 and stems["widr"] == stems["..."] == stems["eps"] == 0


def test_samples_are_bounded(corpus, spark):
    """Repeated rows of an id bring one text, and the features of all stay below the bound."""
    texts, labels = corpus
    a, b = toxicity.fit(texts, labels), toxicity.fit(texts.union(texts).union(texts.where("doc_id < 9")), labels)
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
    few = toxicity.fit(texts, labels, max_features=300)
    assert len(few[0]) < len(a[0]) and toxicity.fit(texts, labels, max_features=0)[2] != 0
    rows = spark.createDataFrame([(i, i % 3, 10) for i in range(30)], "id long, place int, n int")
    assert sorted(r.id for r in first_of(rows, ["place", "id"], "n", 45).collect()) == [0, 3, 6, 9]
    assert first_of(rows, ["place", "id"], "n", 5).count() == 1 and first_of(rows, ["place", "id"], "n", 300).count() == 30


def test_languages(spark, docs, empty):
    r = random.Random(4)
    syllables = {"aa": ["zor", "kla", "mu"], "bb": ["ëti", "sén", "ou"], "cc": ["shi", "ngth", "wha"]}
    rows = []
    for i in range(300):
        lang = r.choice(list(syllables))
        text = " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 30)))
        rows.append((i, text, lang if i % 10 else None))
    truth = {i: lang for i, _, lang in rows}
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame)
    out = langid.predict(frame, model).collect()
    held = [x for x in out if x.held_out and truth[x.doc_id]]
    assert held and np.mean([x.lang_pred == truth[x.doc_id] for x in held]) > 0.97
    odd = {x.doc_id: x for x in langid.predict(docs, model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (0, 1, 2, 3)) and odd[4].lang_pred in syllables
    assert all(0 <= x.score <= 1 for x in out)
    assert langid.predict(empty, model).count() == 0
    assert {x.lang_pred for x in langid.predict(frame, langid.fit(frame.limit(0))).collect()} == {"und"}


def test_rare_languages_are_learned(spark):
    """A language of a few documents among thousands keeps its label, however small the sample."""
    r = random.Random(6)
    text = lambda syllables: " ".join("".join(r.choice(syllables) for _ in range(3)) for _ in range(25))
    rows = [(i, text(["zor", "kla", "mu"]) if i % 2 else text(["shi", "ngth", "wha"]), "aa" if i % 2 else "cc") for i in range(3000)]
    rows += [(3000 + i, text(["ëti", "sén", "ou"]), "bb") for i in range(16)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame, 60)
    assert model.langs == ("aa", "bb", "cc")
    out = langid.predict(frame.where("lang = 'bb'"), model).collect()
    assert np.mean([x.lang_pred == "bb" for x in out]) > 0.9
    assert langid.fit(frame, 1).langs == ("aa", "bb", "cc")


def test_probabilities_are_calibrated(spark):
    """On held out texts of one to forty words, languages that share most syllables: the mean score is the share of right ones."""
    r = random.Random(12)
    shared = ["ra", "lo", "ti", "ne", "ka", "mu", "so"]
    own = {"aa": ["zor", "kla"], "bb": ["ëti", "sén"], "cc": ["shi", "ngth"]}
    rows = []
    for i in range(2400):
        lang = r.choice(list(own))
        word = lambda: "".join(r.choice(own[lang] if r.random() < 0.12 else shared) for _ in range(r.randint(1, 3)))  # noqa: B023, E731
        rows.append((i, " ".join(word() for _ in range(r.choice([1, 2, 4, 40]))), lang))
    truth = {i: lang for i, _, lang in rows}
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = [x for x in langid.predict(frame, langid.fit(frame)).collect() if x.held_out]
    right = np.array([x.lang_pred == truth[x.doc_id] for x in out])
    score = np.array([x.score for x in out])
    for low, high in ((0, 0.6), (0.6, 0.85), (0.85, 1.01)):
        at = (score >= low) & (score < high)
        assert at.sum() > 20 and abs(right[at].mean() - score[at].mean()) < 0.12


def test_letters_of_all_scripts_count():
    assert all(len(langid.folded(t)) > 2 for t in ("İ", "ß", "字", "𝔘", "я", "ª", "\U00031400")) and all(len(langid.folded(t)) <= 2 for t in ("", " ", "12 $", "…!", "\n"))


def test_sums_equal_counts(monkeypatch):
    rng = np.random.default_rng(1)
    w = rng.random((2**langid.BITS, 2)).astype(np.float32)
    texts = ["Hello wörld", "", None, "a", "12 $$", "abc " * 50, "ß"]
    s, n = langid.sums(texts, w)
    for t, got, size in zip(texts, s, n, strict=True):
        at, c = langid.counts(t)
        assert np.allclose(got if size else 0, (c[:, None] * w[at]).sum(axis=0), atol=1e-3) and size == c.sum()
    monkeypatch.setattr(langid, "CHARS", 7)  # long texts in parts
    parts, again = langid.sums(texts, w)
    assert np.allclose(np.where(n[:, None] > 0, s, 0), np.where(n[:, None] > 0, parts, 0), atol=1e-3) and np.array_equal(n, again)


def test_temperature_recovers_scale():
    rng = np.random.default_rng(3)
    s = rng.normal(size=(4000, 3))
    y = np.array([rng.choice(3, p=p) for p in langid.softmax(s)])
    assert abs(langid.temperature(3 * s, y) - 3) < 0.3

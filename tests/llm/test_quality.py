import re

from shelfmark.llm import quality


def slow_base(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), failed


def test_base_against_brute_force(docs, empty):
    got = quality.judge(docs).collect()
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], key=key) == sorted([(r.doc_id, *slow_base(r.text)) for r in docs.collect()], key=key)
    assert all(not (r.kept and r.base_failed) for r in got)
    assert quality.judge(empty).count() == 0


def test_estimates_find_good_and_bad_rules(spark):
    """Votes drawn from known accuracies: the estimates come near them, and a rule that only abstains harms nothing."""
    import random

    r = random.Random(1)
    true = {"a": 0.95, "b": 0.85, "c": 0.7, "d": 0.9}
    rows = []
    for _ in range(3000):
        y = r.random() < 0.75
        rows.append([None if r.random() < 0.2 else int(y if r.random() < p else not y) for p in true.values()] + [None])
    votes = spark.createDataFrame(rows, "a int, b int, c int, d int, e int")
    prior, accuracy = quality.fit(votes, ["a", "b", "c", "d", "e"], iterations=25)
    assert abs(prior - 0.75) < 0.05 and all(abs(x - p) < 0.07 for v, p in true.items() for x in accuracy[v])


def test_main_path_is_native(docs):
    plan = quality.judge(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_stop_words_of_the_whole_text(spark):
    """Function words behind the first 400 words count, in any case, once each."""
    head = " ".join(f"word{i}" for i in range(450))
    rows = [(1, head), (2, head + " The the OF"), (3, head + " the of and " + head + " le der")]
    got = quality.base(spark.createDataFrame(rows, "doc_id long, text string")).withColumns(quality.rules()).collect()
    assert sorted((r.doc_id, r.n_stop, r.v_stop_words) for r in got) == [(1, 0, 0), (2, 2, None), (3, 5, 1)]

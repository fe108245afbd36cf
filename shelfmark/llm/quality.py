"""Operator 3: quality rules as weak supervision, with DataFrame functions only.

Rules vote for (1) or against (0) a text or abstain (null). Expectation-maximisation over the counts
of vote patterns (at most 3**rules rows, whatever the corpus) estimates each rule's accuracy and the
share of good texts; the posterior probability that a text is good then decides, in place of a
demand that every rule passes. The patterns of all documents count but those that the contract's base
rules reject whatever the votes say: they would make the bad class theirs.

Null or empty text: no words, all counts 0, base_failed. A null doc_id and repeated rows are kept. A posterior
of just KEEP_AT keeps a text; equal texts are judged alike. All counts are of the whole text, however long.
Tables without rows give none. Other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.llm.common import SPACE, staged, table

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
ITERATIONS = 12
KEEP_AT = 0.5
SYMBOLS = "#*$%&|<>"
#: A word of letters, with one mark behind it at most.
PLAIN = r"^[\"'(«]?\p{L}+[.,;:!?\"')»]?$"
#: Frequent function words of the four languages.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "der", "die", "und", "den", "von", "ist", "nicht", "le", "la", "de", "et", "les", "des", "que", "el", "los", "en", "se"]


def base(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the contract's counts, and the measures that the rules look at."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("doc_id", "t", F.filter(F.split("t", SPACE, -1), lambda w: w != "").alias("words"), lines.alias("lines"))
    n = F.size("words")
    windows = F.transform(F.slice("words", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    squeezed = F.regexp_replace("t", SPACE, "")
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(squeezed).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("w"),
        F.size(F.filter("words", lambda x: x.rlike(PLAIN))).cast("long").alias("n_plain"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?\"'][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        F.size(F.array_intersect(F.transform("words", F.lower), F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop"),
    )
    return rows.withColumn("n_repeat_words", repeated_words(F.col("w"))).drop("w")


def repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window which the array of window hashes holds twice or more."""
    placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(placed))


def covered(placed: Column) -> Column:
    # An array of one element binds the sorted windows, so that they are sorted once.
    def of(s: Column) -> Column:
        twin = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        places = F.sort_array(F.transform(twin, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    return F.get(F.transform(F.array(placed), of), F.lit(0))


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1))


def rules() -> dict[str, Column]:
    """The rules. Each looks at counts of the whole text."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    return {
        "v_length": vote(n >= 80, n < MIN_WORDS),
        "v_word_length": vote((chars >= 3 * n) & (chars <= 9 * n), (chars < 2 * n) | (chars > 12 * n)),
        "v_symbols": vote(F.col("n_symbols") * 100 <= n, F.col("n_symbols") * 10 >= n),
        "v_dup_lines": vote((F.col("n_dup_lines") * 10 <= lines) & (lines >= 3), F.col("n_dup_lines") * 10 >= lines * 3),
        "v_repeats": vote(F.col("n_repeat_words") * 100 <= n * 20, F.col("n_repeat_words") * 100 > n * 40),
        "v_plain": vote(F.col("n_plain") * 100 >= n * 90, F.col("n_plain") * 100 < n * 70),
        "v_upper": vote(F.col("n_upper") * 100 <= chars * 15, F.col("n_upper") * 100 >= chars * 40),
        "v_ended": vote(F.col("n_ended") * 10 >= lines * 6, F.col("n_ended") * 10 < lines * 3),
        "v_stop_words": vote(F.col("n_stop") >= 3, F.col("n_stop") == 0),
    }


def log_odds(names: list[str], prior: float, accuracy: dict[str, tuple[float, float]]) -> Column:
    """The log odds that a text with these votes is good; an abstaining rule adds nothing."""
    total = F.lit(math.log(prior / (1 - prior)))
    for v in names:
        a, b = accuracy[v]
        total = total + F.when(F.col(v) == 1, math.log(a / (1 - b))).when(F.col(v) == 0, math.log((1 - a) / b)).otherwise(0.0)
    return total


def fit(votes: DataFrame, names: list[str], iterations: int = ITERATIONS) -> tuple[float, dict[str, tuple[float, float]]]:
    """Expectation-maximisation over the vote patterns: the share of good texts, and of each rule how often it is right about good texts and about bad ones.

    Kinds of bad texts differ, and a rule knows one kind: so its accuracy on bad texts is its own number.
    Estimates are smoothed by two texts and rounded to 9 digits, so that the order of sums doesn't show.
    """
    patterns = staged(votes.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    prior, accuracy = 0.8, dict.fromkeys(names, (0.9, 0.5))
    for _ in range(iterations):
        p = F.round(1 / (1 + F.exp(-log_odds(names, prior, accuracy))), 12)
        weight = {"good": F.col("n") * p, "bad": F.col("n") * (1 - p)}
        sums = [F.sum(F.when(F.col(v) == x, w)).alias(f"{kind}_{x}_{v}") for v in names for x in (0, 1) for kind, w in weight.items()]
        r = patterns.agg(F.sum("n").alias("n"), F.sum(weight["good"]).alias("good"), *sums).first()
        if not r["n"]:
            return prior, accuracy
        share = lambda right, wrong: min(0.999, max(0.001, round(((right or 0.0) + 1) / ((right or 0.0) + (wrong or 0.0) + 2), 9)))
        prior = share(r["good"], r["n"] - r["good"])
        accuracy = {v: (share(r[f"good_1_{v}"], r[f"good_0_{v}"]), share(r[f"bad_0_{v}"], r[f"bad_1_{v}"])) for v in names}
    return prior, accuracy


def judge(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """Per document the base counts, base_failed, kept, and the posterior that decided."""
    named = rules()
    names = list(named)
    rows = staged(base(docs), "quality").withColumns(named)
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT)
    prior, accuracy = fit(rows.where(~failed), names)
    posterior = 1 / (1 + F.exp(-log_odds(names, prior, accuracy)))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(*counts, failed.alias("base_failed"), (~failed & (posterior >= keep_at)).alias("kept"), F.round(posterior, 6).alias("posterior"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("posterior")


def _sql_rules() -> dict[str, tuple[str, str]]:
    """Each rule's conditions (good, bad) in SQL."""
    return {
        "v_length": ("n_words >= 80", f"n_words < {MIN_WORDS}"),
        "v_word_length": ("word_chars >= 3 * n_words AND word_chars <= 9 * n_words", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
        "v_symbols": ("n_symbols * 100 <= n_words", "n_symbols * 10 >= n_words"),
        "v_dup_lines": ("n_dup_lines * 10 <= n_lines AND n_lines >= 3", "n_dup_lines * 10 >= n_lines * 3"),
        "v_repeats": ("n_repeat_words * 100 <= n_words * 20", "n_repeat_words * 100 > n_words * 40"),
        "v_plain": ("n_plain * 100 >= n_words * 90", "n_plain * 100 < n_words * 70"),
        "v_upper": ("n_upper * 100 <= word_chars * 15", "n_upper * 100 >= word_chars * 40"),
        "v_ended": ("n_ended * 10 >= n_lines * 6", "n_ended * 10 < n_lines * 3"),
        "v_stop_words": ("n_stop >= 3", "n_stop = 0"),
    }


def oracle_sql(iterations: int = ITERATIONS) -> str:
    """The whole query in DuckDB's SQL; each step of the estimation is a table of one row."""
    named = _sql_rules()
    names, literal = list(named), lambda words: ", ".join("'" + w + "'" for w in words)
    space, plain = SPACE, PLAIN.replace("'", "''")
    odds = "ln(prior / (1 - prior))" + "".join(f" + CASE {v} WHEN 1 THEN ln(a_{v} / (1 - b_{v})) WHEN 0 THEN ln((1 - a_{v}) / b_{v}) ELSE 0 END" for v in names)
    share = lambda right, wrong: f"least(0.999, greatest(0.001, round((coalesce({right}, 0) + 1) / (coalesce({right}, 0) + coalesce({wrong}, 0) + 2), 9)))"
    of = lambda w, v, x: f"sum(CASE WHEN {v} = {x} THEN n * {w} END)"
    steps = ["m0 AS MATERIALIZED (SELECT 0.8::DOUBLE AS prior, " + ", ".join(f"0.9::DOUBLE AS a_{v}, 0.5::DOUBLE AS b_{v}" for v in names) + ")"]
    for i in range(iterations):
        new = ", ".join(f"{share(of('p', v, 1), of('p', v, 0))} AS a_{v}, {share(of('(1 - p)', v, 0), of('(1 - p)', v, 1))} AS b_{v}" for v in names)
        steps.append(f"m{i + 1} AS MATERIALIZED (SELECT {share('sum(n * p)', 'sum(n) - sum(n * p)')} AS prior, {new} FROM (SELECT patterns.*, round(1 / (1 + exp(-({odds}))), 12) AS p FROM patterns, m{i}))")
    votes = ", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 END AS {v}" for v, (good, bad) in named.items())
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cut AS MATERIALIZED (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '{space}'), lambda w: w <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
placed AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM cut)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM placed) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY r),
base AS MATERIALIZED (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '{space}', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, len(list_filter(words, lambda w: regexp_matches(w, '{plain}'))) AS n_plain,
  len(list_filter(lines, lambda x: regexp_matches(x, '[.!?"''][\x20\x09-\x0D]*$'))) AS n_ended, length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper,
  len(list_intersect(list_distinct(list_transform(words, lambda w: lower(w))), [{literal(STOP_WORDS)}])) AS n_stop
  FROM cut LEFT JOIN repeated USING (r)),
voted AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed, {votes} FROM base),
patterns AS MATERIALIZED (SELECT {", ".join(names)}, count(*) AS n FROM voted WHERE NOT base_failed GROUP BY ALL),
{(","+chr(10)).join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 1 / (1 + exp(-({odds}))) >= {KEEP_AT} AS kept FROM voted, m{iterations}
"""

"""Operator 7: dated URL lists, joined as of the time of each fetch.

A list's dated entries (a domain, a host or a host with a first path segment; added or removed)
become validity intervals: an entry holds from its date until the next one of the same pattern. An
interval is dealt to the time buckets that it touches (no further than the last fetch), and a
capture's patterns meet the intervals by pattern and bucket, with the exact times checked behind
that; so a pattern with many captures or a long history is spread over buckets.

Times are whole numbers (here minutes). Of entries of one pattern at one time a removal is the last
word. Null patterns, actions or times are no entries. Null, empty or hostless URLs and captures
without a time match nothing and are allowed. Repeated rows are kept. Tables without rows give none;
other columns of the captures are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from shelfmark.llm.common import table

#: Minutes of a time bucket.
BUCKET = 60 * 24 * 30
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
FIRST_SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def patterns(url: Column) -> Column:
    """The host's domains of two labels or more (or the host alone), and the host with its first path segment."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    labels = F.split(host, r"\.", -1)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.regexp_extract(url, FIRST_SEGMENT, 1)
    own = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(host, F.lit("")) != "", F.array_distinct(F.concat(domains, own))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, since, until (null: open) of the times at which an entry holds. entries: pattern, action (add or remove), at."""
    rows = entries.where("pattern is not null and at is not null and action in ('add', 'remove')")
    rows = rows.groupBy(F.lower("pattern").alias("pattern"), F.col("at").cast("long").alias("since")).agg(F.max("action").alias("action"))
    until = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    return rows.withColumn("until", until).where("action = 'add'").select("pattern", "since", "until")


def evaluate(captures: DataFrame, entries: DataFrame, capture_id: str = "page_id", url: str = "url", fetched: str = "fetched", bucket: int = BUCKET) -> DataFrame:
    """Per capture: its id, fetched, blocked, n_entries (patterns that hold), entry (the least of them)."""
    rows = captures.select(F.col(capture_id).alias(capture_id), F.col(url).alias("_url"), F.col(fetched).cast("long").alias("fetched"))
    last = F.coalesce(F.lit(rows.agg(F.max("fetched")).first()[0]).cast("long"), F.lit(0))
    held = intervals(entries).where(F.col("since") <= last)
    end = F.greatest(F.col("since"), F.least(F.coalesce(F.col("until") - 1, last), last))
    held = held.withColumn("_b", F.explode(F.sequence(F.floor(F.col("since") / bucket), F.floor(end / bucket)))).select(F.col("pattern").alias("_p"), "since", "until", "_b")
    # Captures of one URL at one time share their answer: it is found once.
    asked = rows.where("_url is not null and fetched is not null").select("_url", "fetched").distinct()
    asked = asked.select("_url", "fetched", F.explode(patterns(F.col("_url"))).alias("pattern"), F.floor(F.col("fetched") / bucket).alias("bucket"))
    on = (F.col("pattern") == F.col("_p")) & (F.col("bucket") == F.col("_b")) & (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    found = asked.join(held, on).groupBy(F.col("_url").alias("_u"), F.col("fetched").alias("_f")).agg(F.count("*").alias("_n"), F.min("pattern").alias("_entry"))
    out = rows.join(found, (F.col("_url") == F.col("_u")) & (F.col("fetched") == F.col("_f")), "left")
    n = F.coalesce("_n", F.lit(0).cast("long"))
    return out.select(capture_id, "fetched", (n > 0).alias("blocked"), n.alias("n_entries"), F.col("_entry").alias("entry"))


def dated_pages(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time by rule, as the tables hold none: a minute of a year of 525,600."""
    return pages.select("page_id", "url", F.pmod(F.col("page_id") * 7919, F.lit(525_600)).alias("fetched"))


def listed(pages: DataFrame) -> DataFrame:
    """A dated list by rule, as the tables hold none: a quarter of the pages' patterns, by md5, is added; most are removed later, and some come back."""
    known = pages.select(F.explode(patterns(F.col("url"))).alias("pattern")).distinct()
    h = F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 8), 16, 10).cast("long")
    known = known.withColumn("h", h).where("h % 4 = 0").withColumn("added", F.expr("h div 4 % 300 * 1440"))
    known = known.withColumn("removed", F.expr("added + (20 + h div 1200 % 90) * 1440"))
    add = known.select("pattern", F.lit("add").alias("action"), F.col("added").alias("at"))
    remove = known.where("h div 7 % 3 > 0").select("pattern", F.lit("remove").alias("action"), F.col("removed").alias("at"))
    again = known.where("h div 7 % 3 = 2").select("pattern", F.lit("add").alias("action"), F.expr("removed + 43200").alias("at"))
    return add.union(remove).union(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return evaluate(dated_pages(pages), listed(pages))


SQL = f"""
WITH caps AS (
  SELECT page_id, url, (page_id * 7919) % 525600 AS fetched,
         lower(regexp_extract(url, '{HOST}', 1)) AS host, regexp_extract(url, '{FIRST_SEGMENT}', 1) AS seg
  FROM pages),
parts AS (SELECT *, string_split(host, '.') AS labels FROM caps WHERE host <> ''),
keys AS (
  SELECT DISTINCT page_id, url, fetched, pattern FROM (
    SELECT page_id, url, fetched, array_to_string(labels[i:], '.') AS pattern
    FROM (SELECT *, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS i FROM parts)
    UNION ALL
    SELECT page_id, url, fetched, host || '/' || seg FROM parts WHERE seg <> '')),
known AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 8))::BIGINT AS h FROM (SELECT DISTINCT pattern FROM keys)),
chosen AS (SELECT pattern, h, h // 4 % 300 * 1440 AS added, h // 4 % 300 * 1440 + (20 + h // 1200 % 90) * 1440 AS removed FROM known WHERE h % 4 = 0),
events AS (
  SELECT lower(pattern) AS pattern, action, moment FROM (
    SELECT pattern, 'add' AS action, added AS moment FROM chosen
    UNION ALL SELECT pattern, 'remove', removed FROM chosen WHERE h // 7 % 3 > 0
    UNION ALL SELECT pattern, 'add', removed + 43200 FROM chosen WHERE h // 7 % 3 = 2)),
ordered AS (SELECT pattern, moment, max(action) AS action FROM events GROUP BY pattern, moment),
spans AS (SELECT *, lead(moment) OVER (PARTITION BY pattern ORDER BY moment) AS until FROM ordered),
hits AS (
  SELECT k.page_id, k.url, count(*) AS n, min(k.pattern) AS entry
  FROM keys k JOIN spans s ON s.pattern = k.pattern AND s.action = 'add' AND s.moment <= k.fetched AND (s.until IS NULL OR k.fetched < s.until)
  GROUP BY k.page_id, k.url)
SELECT c.page_id, c.fetched, coalesce(h.n, 0) > 0 AS blocked, coalesce(h.n, 0) AS n_entries, h.entry
FROM caps c LEFT JOIN hits h ON h.page_id = c.page_id AND h.url = c.url
"""

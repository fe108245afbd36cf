import math
import random
import zlib

import duckdb
import xxhash

from shelfmark.llm import sharding, url_lists


def test_every_row_has_a_slot(docs, empty):
    rows, want = sharding.assign(docs, sharding.layout(6)).collect(), docs.collect()
    assert len(rows) == len(want)
    data = {r.doc_id: (r.text or "").encode() for r in want}
    by_shard = {}
    for r in rows:
        assert r.size == len(data[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(data[r.doc_id]) and r.law == "key"
        assert r.grown_shard in (r.shard, 6)
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and set(by_shard) <= set(range(6))
    assert sharding.assign(empty, sharding.layout(6)).count() == 0


def slow_shard(doc_id, tree):
    """The shard's number, by a walk from the root that takes the child with the least draw."""
    while tree.children:
        def draw(child):
            h = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42) if doc_id is not None else 42
            u = ((xxhash.xxh64_intdigest(child.name.encode(), h) >> 11) + 0.5) / 2.0**53
            return -math.log(u) / child.weight

        tree = min(tree.children, key=draw)
    return tree.number


def test_shards_against_brute_force(docs, spark):
    tree = sharding.layout(40)
    more = spark.createDataFrame([(i * 7919 - 3000, "t") for i in range(500)] + [(2**63 - 1, None), (-(2**63), "")], "doc_id long, text string")
    rows = sharding.assign(docs.select("doc_id", "text").union(more), tree).collect()
    assert len(rows) == docs.count() + 502
    assert all((r.shard, r.grown_shard) == (slow_shard(r.doc_id, tree), slow_shard(r.doc_id, sharding.grown(tree))) for r in rows)


def test_weights_and_movement(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    shard = sharding.Node
    old = shard("root", (shard("r0", (shard("k0", (shard("s0", number=0), shard("s1", number=1, own_weight=3.0))),)), shard("r1", (shard("k1", (shard("s2", number=2),)), shard("k2", (shard("s3", number=3), shard("s4", number=4)))))))
    new = shard("root", (old.children[0], shard("r1", (shard("k1", (shard("s2", number=2, own_weight=2.0),)), old.children[1].children[1]))))
    both = sharding.descend(sharding.descend(rows, old, "doc_id", "old"), new, "doc_id", "new").collect()
    count = [sum(r.old == i for r in both) / 20_000 for i in range(5)]
    assert all(abs(a - b / 7) < 0.015 for a, b in zip(count, [1, 3, 1, 1, 1], strict=True))
    # Only the region whose weight grew takes rows, and inside it only its grown rack.
    assert all(r.new == 2 or r.new == r.old or (r.old in (0, 1) and r.new in (3, 4)) for r in both)
    grown = sharding.descend(sharding.descend(rows, old, "doc_id", "old"), sharding.grown(old), "doc_id", "new").collect()
    assert all(r.new in (r.old, 5) for r in grown) and abs(sum(r.new == 5 for r in grown) / 20_000 - 1 / 8) < 0.01


def test_lists_against_brute_force(spark):
    r = random.Random(6)
    urls = ["https://a.b.example.com/x/y", "http://user@B.example.com:80/x?q", "https://example.com", "ftp://localhost/z", "not a url", "", None, "https://c.org/"]
    rows = [(i % 37, r.choice(urls), r.randrange(0, 500) if i % 11 else None) for i in range(300)]
    names = ["example.com", "b.example.com", "a.b.example.com/x", "localhost", "c.org", "com", None]
    entries = [(r.choice(names), r.choice(["add", "remove", "other", None]), r.randrange(0, 500) if i % 9 else None) for i in range(80)]
    caps = spark.createDataFrame([(*x, "e", 1) for x in rows], "page_id int, url string, fetched long, entry string, pattern int")
    listed = spark.createDataFrame(entries, "pattern string, action string, at long")
    got = url_lists.evaluate(caps, listed, bucket=64).collect()
    keys = {urls[0]: ["a.b.example.com", "b.example.com", "example.com", "a.b.example.com/x"], urls[1]: ["b.example.com", "example.com", "b.example.com/x"], urls[2]: ["example.com"], urls[3]: ["localhost", "localhost/z"], urls[7]: ["c.org"]}

    def holds(pattern, t):
        past = [(at, action) for p, action, at in entries if p == pattern and action in ("add", "remove") and at is not None and at <= t]
        return bool(past) and max(past)[1] == "add"

    want = []
    for i, u, t in rows:
        hit = sorted(k for k in keys.get(u, []) if t is not None and holds(k, t))
        want.append((i, t, bool(hit), len(hit), hit[0] if hit else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert url_lists.evaluate(caps.limit(0), listed).count() == 0
    assert not any(x.blocked for x in url_lists.evaluate(caps, listed.limit(0)).collect())


def test_query_equals_sql(spark, tmp_path):
    urls = [f"https://{h}.site{i % 7}.example.{t}/p{i % 5}/q" for i in range(200) for h in ("www", "m") for t in ("com", "net")]
    spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"select page_id, fetched, blocked, n_entries, entry from ({url_lists.SQL})").fetchall()
    got = url_lists.query(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(r.blocked for r in got)

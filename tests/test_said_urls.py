"""URLs that comments hold: met on their rarest piece, as a nested loop would find them."""

import re
import time
import uuid

from pyspark.sql import functions as F

from tonearm.operators import matching
from tonearm.sources.tables import shared_folder


def test_as_a_nested_loop_finds_them(spark):
    urls = ["https://A.example/x_1", "a%b", "%", "_b", "ab", "ÄÖÜ.example", "50\\%off", "https://a.example/nowhere", "x.example/p_12/", "", "tail\\\\end"]
    comments = ["see HTTPS://a.EXAMPLE/x-1 there", "xaxxb", "äöü.example", "now 50%OFF", "50 off", "X.example/p-12/", "", "b", "a tail\\end"]
    u, c = spark.createDataFrame([(x,) for x in urls], "url string"), spark.createDataFrame([(x,) for x in comments], "comment string")
    plain = u.join(c, F.expr("comment ilike '%' || url || '%'"), "left_semi")
    got = sorted(r["url"] for r in matching.said_urls(u, c).collect())
    assert got == sorted(r["url"] for r in plain.collect()) and "50\\%off" in got and "https://a.example/nowhere" not in got


def test_many_urls_in_time(spark):
    u = spark.range(150_000).select(F.expr("'https://x.example/p_' || id || '/'").alias("url"))
    c = spark.range(0, 150_000, 10).select(F.expr("'from HTTPS://X.example/p-' || id || '/ with thanks'").alias("comment"))
    start = time.time()
    # 2,250 million pairs for a nested loop.
    assert matching.said_urls(u, c).count() == 15_000
    assert time.time() - start < 60


def kept(df, name):
    """The rows in a file, whose size Spark takes for theirs."""
    where = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def test_pieces_and_comments_are_not_broadcast(spark):
    u = kept(spark.range(600).select(F.expr("CASE WHEN id < 4 THEN array('b_', '%', 'q', '\\\\_')[id] ELSE 'https://x.example/p_' || id || '/' END").alias("url")), "urls")
    c = kept(spark.range(0, 600, 3).select(F.expr("'from HTTPS://X.example/p-' || id || '/ with thanks' || if(id = 300, ' by B', '')").alias("comment")), "comments")
    found = matching.said_urls(u, c)
    got = sorted(r["url"] for r in found.collect())
    plain = u.join(c, F.expr("comment ilike '%' || url || '%'"), "left_semi")
    assert got == sorted(r["url"] for r in plain.collect()) and len(got) == 200 and got[:2] == ["%", "b_"]
    # Before, the pieces of all comments went to the driver with their comments, as did all comments for URLs without pieces.
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_reasons_join_without_broadcasts_that_grow(spark):
    rows = [(k, f"https://x.example/p_{k}/" if k % 7 else None, "Some Artist" if k % 5 else None, "Old Plate" if k % 3 else "qqqqqq") for k in range(1, 200)]
    # One key, two names: the better one counts.
    rows += [(500, None, "Some Artist", "zzzzzz"), (500, None, "Some Artist", "OLD PLATES")]
    posts = kept(spark.createDataFrame(rows, "key long, url string, artist string, album string"), "posts")
    mine = posts.filter("key % 10 = 0").select("url")
    said = posts.filter("key % 10 = 1 and url is not null").select(F.concat(F.lit("see "), F.upper("url")).alias("comment"))
    albums = kept(spark.createDataFrame([("some artist", "old plate"), ("other", "qqqqqq"), (None, "zzzzzz")], "artist string, album string"), "albums")
    out = matching.duplicate_reasons(posts, mine, said, albums)
    got = sorted((tuple(r) for r in out.select("key", "album", "reason").collect()), key=repr)

    def reason(key, url, artist, album):
        near = key == 500 or artist is not None and album == "Old Plate"
        return "url" if url and key % 10 == 0 else "comment" if url and key % 10 == 1 else "names" if near else None

    assert got == sorted(((r[0], r[3], reason(*r)) for r in rows), key=repr)
    joined = re.findall(r"Broadcast(?:Hash|NestedLoop)Join (?:\[(\w+)#)?", out._jdf.queryExecution().executedPlan().toString())
    # Scores of names may be broadcast, by their measured size; URLs, comments and keys were, by that of the table's file.
    assert set(joined) <= {"artist", "album"}

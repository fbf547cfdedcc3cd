"""Parts of pages and posts that several results need are computed once."""

from pyspark.sql import functions as F

from tonearm.operators import cue, releases


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_page_data_is_read_once(spark):
    pages = spark.range(1).select(F.concat(F.lit('<div id="pagedata" data-blob="{&quot;digital_items&quot;:[{&quot;title&quot;:&quot;a&#33;&quot;}]}">'), F.col("id").cast("string")).alias("html"))
    found = pages.select(releases.digital_items(F.col("html"), "struct<title:string>").alias("f"))
    assert plan_of(found).count("HomepageApp") == 1 and found.first()["f"]["items"][0]["title"] == "a!"


def test_label_and_title_are_read_once(spark):
    posts = spark.range(1).select(F.concat(F.lit("<p>Released by X &amp; Sons, Ltd.</p>"), F.col("id").cast("string")).alias("html"), F.concat(F.lit("A &#8211; B "), F.col("id").cast("string")).alias("title"))
    label, title = posts.select(releases.label_name(F.col("html")).alias("l")), posts.select(releases.parse_title(F.col("title")).alias("t"))
    assert plan_of(label).count("released") == 1 and label.first()[0] == "X"
    assert plan_of(title).count("&quot;") == 1 and tuple(title.first()["t"]) == ("A", "B 0")


def test_cue_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([("a", 1, 'TITLE "All"'), ("a", 2, "TRACK 01 AUDIO"), ("a", 3, "INDEX 01 00:01:00")], "key string, line_no int, line string")
    tracks = cue.cue_tracks(lines)
    plan = plan_of(tracks)
    # Before, for each of two joined sides, once to filter and once to keep.
    assert plan.count(r"^(\w+)") == 1 and plan.count(r"^\w+\s+(.*)$") == 1
    assert [(r["track_num"], r["album"], r["start_samples"]) for r in tracks.collect()] == [(1, "All", 44100)]
    dealt = cue.cue_tracks(lines, tasks=7)
    assert ", 7)" in dealt._jdf.queryExecution().executedPlan().toString() and dealt.collect() == tracks.collect()

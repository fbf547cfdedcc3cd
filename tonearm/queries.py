"""Queries over the driver's tables, one for each group of operators, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions import media
from tonearm.functions import text as T
from tonearm.operators import cascade, changelog, cue, library, matching, releases, runs
from tonearm.plans import template
from tonearm.plans.search import Catalog, ordered, search
from tonearm.registry import ORACLE_SQL, QUERIES, query
from tonearm.sources.tables import table
from tonearm.streaming import refresh

# Search strings over parts (as tracks) with their order lines' flags (as crates).

PART_FIELDS = {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice"}


def parts(spark: SparkSession, d: str) -> tuple[DataFrame, Catalog]:
    part = table(spark, d, "part")
    flags = table(spark, d, "lineitem").select("l_partkey", "l_returnflag")
    return part, Catalog("p_partkey", PART_FIELDS, ["p_name", "p_brand", "p_type"], {"flag": (flags, "l_partkey", "l_returnflag")}, {"title": "name"})


def part_search(name: str, text: str, where: str) -> None:
    sql = f"SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE {where}"
    query(name, sql)(lambda spark, d: search(*parts(spark, d), text))


_PHRASE = "(contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: x <> ''), ' '), ' {v}'))"
_ANY_PHRASE = lambda v: "(" + " OR ".join(_PHRASE.format(c=c, v=v) for c in ("p_name", "p_brand", "p_type")) + ")"
_FLAG = "p_partkey IN (SELECT l_partkey FROM lineitem WHERE {})"

part_search("search_contains", "name:ring", "p_name ILIKE '%ring%'")
part_search("search_exact", 'brand:="brand#13"', "lower(p_brand) = 'brand#13'")
part_search("search_compare", "size:>=25 price:<1500", "p_size >= 25 AND p_retailprice < 1500")
part_search("search_range", "size:10-20", "p_size BETWEEN 10 AND 20")
part_search("search_empty", 'name:""', "p_name IS NULL OR p_name = ''")
part_search("search_negate", "-type:brass size:<30", "p_type NOT ILIKE '%brass%' AND p_size < 30")
part_search("search_or_groups", "size:<5 | name:ring size:>40 OR brand:=Brand#22", "p_size < 5 OR (p_name ILIKE '%ring%' AND p_size > 40) OR lower(p_brand) = 'brand#22'")
part_search("search_phrase", "bra", _ANY_PHRASE("bra"))
part_search("search_phrase_negated", '-"brand 1" size:>5', f"NOT {_ANY_PHRASE('brand 1')} AND p_size > 5")
part_search("search_wildcard", "type:ec_n%y", "p_type ILIKE '%ec_n%y%'")
part_search("search_unknown_field", "colour:ring", "p_name ILIKE '%ring%' OR p_brand ILIKE '%ring%' OR p_type ILIKE '%ring%'")
part_search("search_alias", "title:ring", "p_name ILIKE '%ring%'")
part_search("search_number_as_text", "price:99", "p_retailprice::VARCHAR ILIKE '%99%'")
part_search("search_membership", "flag:=r size:<20", _FLAG.format("lower(l_returnflag) = 'r'") + " AND p_size < 20")
part_search("search_membership_negated", "-flag:r", "NOT " + _FLAG.format("l_returnflag ILIKE '%r%'"))
part_search("search_membership_empty", 'flag:"" | size:=7', "NOT " + _FLAG.format("true") + " OR p_size::VARCHAR = '7'")
part_search("search_membership_or", "flag:=A size:>45 | name:ring", "(" + _FLAG.format("lower(l_returnflag) = 'a'") + " AND p_size > 45) OR p_name ILIKE '%ring%'")
part_search("search_all", "", "true")


@query("search_sorted_limit", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 10 ORDER BY lower(p_name) DESC NULLS FIRST, p_partkey LIMIT 50")
def search_sorted_limit(spark, d):
    return ordered(search(*parts(spark, d), "size:>10"), "-p_name", ("p_partkey",)).limit(50).select("p_partkey", "p_name", "p_size")


@query("search_json", """
SELECT p.p_partkey, p.p_name, coalesce(f.flags, '') AS flags FROM part p LEFT JOIN (
  SELECT l_partkey, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1) f ON p.p_partkey = f.l_partkey
WHERE p.p_size < 10""")
def search_json(spark, d):
    part, cat = parts(spark, d)
    flags = library.joined_names(cat.children["flag"][0], "l_partkey", "l_returnflag", "flags")
    found = search(part, cat, "size:<10")
    return found.join(flags, found["p_partkey"] == flags["l_partkey"], "left").select("p_partkey", "p_name", F.coalesce("flags", F.lit("")).alias("flags"))


# Change-logs derived from events: an operation on an attribute of a user for each event.

_OPS = "SELECT user_id AS key, event_type AS field, json_extract_string(props, '$.k') AS value, CASE WHEN event_id % 3 = 0 THEN '-' ELSE '+' END AS op, event_id AS line_no FROM events"
_CURRENT = f"SELECT key, field, value FROM ({_OPS}) WHERE value IS NOT NULL GROUP BY key, field, value HAVING arg_max(op, line_no) = '+'"


def event_ops(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    op = F.when(F.col("event_id") % 3 == 0, "-").otherwise("+")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("line_no"), F.lit(0).alias("pos"), F.col("event_type").alias("field"), op.alias("op"), F.get_json_object("props", "$.k").alias("value")).filter("value is not null")


@query("changelog_current", _CURRENT)
def changelog_current(spark, d):
    return changelog.current_values(event_ops(spark, d))


_FIELDS = ["click", "error", "purchase", "signup", "view"]


@query("changelog_wide", "SELECT key, " + ", ".join(f"TRY_CAST(min(value) FILTER (field = '{f}') AS DOUBLE) AS {f}" for f in _FIELDS) + f" FROM ({_CURRENT}) GROUP BY key")
def changelog_wide(spark, d):
    return changelog.wide(changelog.current_values(event_ops(spark, d)), _FIELDS, dict.fromkeys(_FIELDS, "double"))


@query("changelog_lines", """
SELECT key, field, value FROM (
  SELECT user_id AS key, event_type AS field, unnest(['A' || (event_id % 7), 'B' || (event_id % 5)]) AS value, unnest(['+', '-']) AS op, event_id AS line_no, unnest([1, 2]) AS pos FROM events)
GROUP BY key, field, value HAVING arg_max(op, line_no * 10 + pos) = '+'""")
def changelog_lines(spark, d):
    e = table(spark, d, "events")
    line = F.concat(F.lit("1700000000s "), F.col("event_type"), F.lit(" +A"), (F.col("event_id") % 7).cast("string"), F.lit(" -B"), (F.col("event_id") % 5).cast("string"))
    return changelog.current_values(changelog.operations(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("line_no"), line.alias("line"))))


@query("changelog_carry_forward", """
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN json_extract_string(props, '$.k') END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signup_k FROM events""")
def changelog_carry_forward(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    signup = F.when(F.col("event_type") == "signup", F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select("event_id", F.last(signup, ignorenulls=True).over(w).alias("signup_k"))


# Refreshes: snapshots of orders, the newer one with some rows gone, some changed.

_OLD = "(SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0)"
_NEW = "(SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 13 <> 0)"


def snapshots(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    fresh = F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus")
    return o.filter("o_orderkey % 11 <> 0"), o.filter("o_orderkey % 13 <> 0").select("o_orderkey", fresh)


@query("cdc_changed", f"""
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM {_OLD} a FULL JOIN {_NEW} b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""")
def cdc_changed(spark, d):
    return changelog.changed_keys(*snapshots(spark, d), "o_orderkey", "o_orderstatus")


@query("cdc_refresh", f"SELECT * FROM {_NEW}")
def cdc_refresh(spark, d):
    old, new = snapshots(spark, d)
    changed = changelog.changed_keys(old, new, "o_orderkey", "o_orderstatus")
    return changelog.replace_keys(old, new.join(changed, "o_orderkey", "left_semi"), changed, "o_orderkey")


@query("cdc_upsert", f"""
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderstatus = 'X' OR b.o_orderkey IS NULL THEN a.o_orderstatus ELSE b.o_orderstatus END AS o_orderstatus
FROM {_OLD} a FULL JOIN {_NEW} b ON a.o_orderkey = b.o_orderkey""")
def cdc_upsert(spark, d):
    old, new = snapshots(spark, d)
    blank = new.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "X", "").otherwise(F.col("o_orderstatus")))
    return changelog.upsert(old, blank, "o_orderkey", ["o_orderstatus"])


@query("cdc_watermark", "SELECT event_id, user_id FROM events WHERE event_id > 500 OR event_id IS NULL")
def cdc_watermark(spark, d):
    return changelog.newer_than(table(spark, d, "events"), "event_id", 500).select("event_id", "user_id")


@query("cdc_early_stop_half", """
SELECT event_id, user_id FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE event_id * 2 > (SELECT max(event_id) FROM events))""")
def cdc_early_stop_half(spark, d):
    """The known events are the later half, so the page before them grows with the table."""
    e = table(spark, d, "events").select("event_id", "user_id")
    top = e.agg(F.max("event_id").alias("top"))
    known = e.join(F.broadcast(top), F.col("event_id") * 2 > F.col("top")).select("event_id")
    return changelog.until_known(e, known, "event_id", "event_id")


# Library joins.

@query("library_ordered", """
SELECT l.l_orderkey, l.l_linenumber, p.p_name FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON o.o_orderkey = l.l_orderkey
WHERE o.o_orderstatus <> 'P'""")
def library_ordered(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    kept = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey")
    names = table(spark, d, "part").select("p_partkey", "p_name")
    return lines.join(kept, lines["l_orderkey"] == kept["o_orderkey"], "left_semi").join(names, lines["l_partkey"] == names["p_partkey"]).select("l_orderkey", "l_linenumber", "p_name")


@query("library_nested_names", """
SELECT c.c_custkey, n.n_name, coalesce(o.priorities, '') AS priorities FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey""")
def library_nested_names(spark, d):
    c, n = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name")
    names = library.joined_names(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "priorities")
    both = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(names, c["c_custkey"] == names["o_custkey"], "left")
    return both.select("c_custkey", "n_name", F.coalesce("priorities", F.lit("")).alias("priorities"))


@query("library_missing", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def library_missing(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("library_top_of_group", """
SELECT n_nationkey, c_custkey, rank, greatest(n - 3, 0)::BIGINT AS more FROM (
  SELECT c_nationkey AS n_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INT AS rank, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE rank <= 3""")
def library_top_of_group(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_acctbal")
    return library.top_of(c, ["n_nationkey"], 3, F.desc("c_acctbal"), F.asc("c_custkey")).select("n_nationkey", "c_custkey", "rank", "more")


@query("library_batches", "SELECT l_orderkey, l_linenumber, ((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) // 3)::BIGINT AS batch FROM lineitem")
def library_batches(spark, d):
    return library.batches(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_linenumber", "l_orderkey", 3)


@query("lead_within_group", "SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations")
def lead_within_group(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    return library.next_start(c, "conv_id", "turn", "turn").withColumnRenamed("end", "next_turn")


# Reports.

@query("status_counts", "SELECT count(*)::BIGINT AS total, " + ", ".join(f"count(*) FILTER (event_type = '{f}')::BIGINT AS n_{f}" for f in _FIELDS) + " FROM events")
def status_counts(spark, d):
    return library.status_counts(table(spark, d, "events"), "event_type", _FIELDS)


@query("rate_report", """
SELECT o_orderpriority, count(*)::BIGINT AS total, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS done, round_even(count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE, 4) AS rate
FROM orders GROUP BY 1""")
def rate_report(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return g.withColumn("rate", library.rate(F.col("done"), F.col("total")))


@query("run_delta", """
SELECT day, n, n - lag(n) OVER (ORDER BY day) AS n_delta FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n FROM events GROUP BY 1)""")
def run_delta(spark, d):
    runs = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return library.run_deltas(runs, "day", ["n"])


@query("table_counts", "SELECT c_mktsegment, count(*)::BIGINT AS n, (max(c_custkey) + 1)::BIGINT AS next_id FROM customer GROUP BY 1")
def table_counts(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), (F.coalesce(F.max("c_custkey"), F.lit(0)) + 1).alias("next_id"))


# Text functions and paths.

@query("text_clean", r"""
SELECT doc_id, regexp_replace(trim(lower(text), ' '), '\s+', ' ', 'g') AS normal, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 39) || '…' END AS clipped FROM documents""")
def text_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("normal"), T.clip(F.col("text"), 40).alias("clipped"))


@query("text_parts_of_url", r"""
SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, array_to_string(list_transform(regexp_extract_all(html, 'https?://([\w-]+)\.example', 1), lambda x: lower(x)), ',') AS hosts FROM pages""")
def text_parts_of_url(spark, d):
    return table(spark, d, "pages").select("page_id", T.folder(F.col("url")).alias("folder"), F.array_join(T.subdomains(F.col("html"), "example"), ",").alias("hosts"))


@query("html_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a\\s+href=\"([^\"]*)\"', 1))::BIGINT AS links FROM pages")
def html_title(spark, d):
    links = F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(links).cast("long").alias("links"))


_VIEW = """
WITH made AS (SELECT p_partkey, p_name || '.flac' AS target, replace(p_brand, ':', '-') || '/' || CAST(round_even(p_size / 5.0, 0) * 5 AS BIGINT) || '/' || p_name AS base FROM part)
SELECT p_partkey, target, base || CASE WHEN n > 0 THEN '_' || n ELSE '' END || '.flac' AS link_path, n > 0 AS is_duplicate
FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) - 1 AS n FROM made)"""


@query("view_unique_paths", _VIEW)
def view_unique_paths(spark, d):
    p = table(spark, d, "part").withColumn("file", F.concat("p_name", F.lit(".flac")))
    return template.link_paths(p, "{{ p_brand }}/{{ p_size | round_to(5) }}/{{ p_name }}", "file", "p_partkey")


@query("view_missing_values", "SELECT n_nationkey, upper(n_name) || ' - Unknown' AS label FROM nation")
def view_missing_values(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", template.render(n, "{{ n_name | upper }} - {{ nothing }}").alias("label"))


# Fuzzy matching of distinct names.

_LCS = """
WITH RECURSIVE names AS (SELECT DISTINCT {col} AS n FROM {tab} WHERE {col} IS NOT NULL),
sorted AS (SELECT n, array_to_string(list_sort(list_filter(string_split(n, ' '), lambda x: x <> '')), ' ') AS s FROM names),
pairs AS (SELECT a.n AS a, b.n AS b, a.s AS sa, b.s AS sb FROM sorted a CROSS JOIN sorted b
  WHERE 200.0 * least(length(a.s), length(b.s)) >= {least} * (length(a.s) + length(b.s))),
rows AS (
  SELECT a, b, sa, sb, 0 AS i, list_transform(range(length(sb) + 1), lambda x: 0) AS r FROM pairs
  UNION ALL
  SELECT a, b, sa, sb, i + 1, list_reduce(list_prepend([0], list_transform(range(1, length(sb) + 1), lambda j: [j])),
    lambda acc, j: list_append(acc, CASE WHEN substr(sa, i + 1, 1) = substr(sb, j[1], 1) THEN r[j[1]] + 1 ELSE greatest(r[j[1] + 1], acc[len(acc)]) END))
  FROM rows WHERE i < length(sa)),
scored AS (SELECT a, b, 200.0::DOUBLE * r[len(r)] / (length(sa) + length(sb)) AS score FROM rows WHERE i = length(sa))
"""
_NAMES = _LCS.format(col="p_name", tab="part", least=80)


@query("fuzzy_pairs", _NAMES + "SELECT a, b, round(score, 6) AS score FROM scored WHERE score >= 80 AND a < b")
def fuzzy_pairs(spark, d):
    names = table(spark, d, "part").select("p_name")
    return matching.name_pairs(names, names, 80).filter("a < b").withColumn("score", F.round("score", 6))


@query("fuzzy_best", _NAMES + """
SELECT a, b, round(score, 6) AS score, CASE WHEN score >= 95 THEN 'exact' WHEN score >= 80 THEN 'high' ELSE 'low' END AS tier
FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, length(b), b DESC) AS n FROM scored WHERE a <> b AND score >= 80) WHERE n = 1""")
def fuzzy_best(spark, d):
    names = table(spark, d, "part").select("p_name")
    best = matching.best_match(matching.name_pairs(names, names, 80).filter("a <> b"))
    return best.withColumn("score", F.round("score", 6))


@query("match_reasons", """
SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'overdrawn' WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 'region' ELSE 'new' END AS reason FROM supplier""")
def match_reasons(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(True).alias("near"))
    return matching.known_by(s.join(n, "s_nationkey", "left"), [("overdrawn", F.col("s_acctbal") < 0), ("region", F.col("near"))]).select("s_suppkey", "reason")


# Media attributes and decisions.

@query("media_attributes", """
SELECT p_partkey, 'name=' || p_name || CASE WHEN p_size % 6 <> 0 THEN ',rating=' || (p_size % 6) ELSE '' END || ',bpm=' || printf('%.2f', p_retailprice) AS attributes FROM part""")
def media_attributes(spark, d):
    p = table(spark, d, "part")
    made = media.attributes({"name": F.col("p_name"), "rating": media.rating_text(F.col("p_size") % 6), "bpm": media.bpm_text(F.col("p_retailprice"))})
    return p.select("p_partkey", F.array_join(F.transform(F.map_entries(made), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("attributes"))


@query("export_actions", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'not_present' WHEN l_quantity < 25 AND l_linenumber <> 1 AND l_linestatus <> 'O' THEN 'file_copied'
  WHEN l_quantity < 25 THEN 'stream_copied' ELSE 'encoded' END AS action FROM lineitem""")
def export_actions(spark, d):
    c = F.col
    action = media.export_action(c("l_returnflag") != "R", c("l_quantity") < 25, c("l_linenumber") == 1, c("l_linestatus") == "O")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", action.alias("action"))


@query("check_statuses", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'not_present' WHEN o_orderkey % 7 = 0 THEN 'skipped' WHEN o_orderkey % 5 = 0 THEN 'checker_missing'
  WHEN o_orderkey % 3 > 1 THEN 'error' WHEN o_orderkey % 2 > 0 THEN 'warning' ELSE 'ok' END AS status FROM orders""")
def check_statuses(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", media.check_status(F.col("o_orderstatus") != "P", k % 7 != 0, k % 5 != 0, (k % 3 > 1).cast("int"), k % 2).alias("status"))


@query("copy_eligible", "SELECT p_partkey, p_size % 3 = 0 AND p_size > 10 AS copied FROM part")
def copy_eligible(spark, d):
    codec = F.when(F.col("p_size") % 3 == 0, "pcm_s24be").otherwise("mp3")
    rate = F.when(F.col("p_size") > 10, 44100).otherwise(48000)
    preset = {"codec": "pcm_s16be", "rate": 44100, "bits": None}
    return table(spark, d, "part").select("p_partkey", media.may_copy(codec, rate, F.lit(None), F.lit(2), preset).alias("copied"))


@query("paths_below", "SELECT page_id, CASE WHEN url LIKE 'https:/%' THEN substr(url, 8) END AS relative, url LIKE '/%' OR url = '' OR url LIKE 'https:/%' AS under FROM pages")
def paths_below(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", media.below(u, "https:").alias("relative"), media.under_any(u, ["", "https:"]).alias("under"))


@query("cue_sheets", """
SELECT l_orderkey AS key, 'Order ' || l_orderkey || '.wav' AS file, l_linenumber AS track_num, 'Part ' || l_partkey AS title, 'Customer' AS performer, 'Orders' AS album,
  (l_linenumber * 60 * 44100 + l_linenumber * 588)::BIGINT AS start_samples, (lead(l_linenumber) OVER w * (60 * 44100 + 588))::BIGINT AS end_samples
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""")
def cue_sheets(spark, d):
    n, two = F.col("l_linenumber"), lambda c: F.lpad(c.cast("string"), 2, "0")
    line = lambda at, *parts: F.struct((n * 10 + at).alias("line_no"), F.concat(*parts).alias("line"))
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    body = F.array(line(1, F.lit("  TRACK "), two(n), F.lit(" AUDIO")), line(2, F.lit('    TITLE "Part '), F.col("l_partkey").cast("string"), F.lit('"')), line(3, F.lit("    INDEX 00 00:00:00")), line(4, F.lit("    INDEX 01 "), two(n), F.lit(":00:"), two(n)))
    k = F.col("l_orderkey").cast("string")
    head = F.array(F.struct(F.lit(0).alias("line_no"), F.lit('PERFORMER "Customer"').alias("line")), F.struct(F.lit(1).alias("line_no"), F.lit('TITLE "Orders"').alias("line")), F.struct(F.lit(2).alias("line_no"), F.concat(F.lit('FILE "Order '), k, F.lit('.wav" WAVE')).alias("line")))
    lines = li.select("l_orderkey", F.explode(body).alias("x")).union(li.select("l_orderkey").distinct().select("l_orderkey", F.explode(head).alias("x")))
    # Some million lines a task; the count comes from the files' footers.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, d, "lineitem").count() // 300_000))
    tracks = cue.cue_tracks(lines.select(F.col("l_orderkey").alias("key"), "x.*"), tasks=tasks)
    return tracks.select("key", "file", "track_num", "title", "performer", "album", "start_samples", "end_samples")


# Releases and their matches.

@query("category_kinds", "SELECT p_partkey, CASE WHEN p_size IN (1, 2, 3) THEN 'ignored' WHEN p_size IN (7, 8, 9, 10, 11, 12, 14, 15, 16, 28, 29, 30, 33, 44, 47, 48, 69) THEN 'genre' ELSE 'label' END AS kind FROM part")
def category_kinds(spark, d):
    return table(spark, d, "part").select("p_partkey", releases.category_kind(F.col("p_size"), (1, 2, 3)).alias("kind"))


@query("release_titles", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Various Artists' ELSE s_name END AS artist, 'Album ' || s_nationkey AS album FROM supplier")
def release_titles(spark, d):
    album = F.concat(F.lit("Album "), F.col("s_nationkey").cast("string"))
    title = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("V/A "), album)).otherwise(F.concat("s_name", F.lit(" &#8211; "), album, F.lit(" (Some Records)")))
    return table(spark, d, "supplier").select("s_suppkey", releases.parse_title(title).alias("t")).select("s_suppkey", "t.artist", "t.album")


@query("release_discography", "SELECT DISTINCT ON (release_id) l_partkey AS release_id, 'Part' AS title FROM lineitem WHERE l_linenumber > 1 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 20)")
def release_discography(spark, d):
    li, known = table(spark, d, "lineitem"), table(spark, d, "part").filter("p_size < 20").select(F.col("p_partkey").alias("release_id"))
    item = F.struct(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("id"), F.col("l_partkey").alias("art_id"), F.when(F.col("l_linenumber") > 1, "Part").alias("title"))
    return releases.discography(li.groupBy("l_orderkey").agg(F.collect_list(item).alias("items")), known, "release_id", "items")


@query("match_by_url_all", """
SELECT c_custkey, s_suppkey, 100.0::DOUBLE AS score, 'exact' AS tier FROM customer JOIN supplier
ON 'https://shop.example/' || (c_custkey // 3) = 'https://shop.example/' || (s_suppkey // 2 * 2)""")
def match_by_url_all(spark, d):
    """Whole tables: a URL meets up to three customers and two suppliers, and many URLs meet nobody."""
    url = lambda k: F.concat(F.lit("https://shop.example/"), F.expr(k).cast("string")).alias("url")
    c = table(spark, d, "customer").select("c_custkey", url("c_custkey div 3"))
    s = table(spark, d, "supplier").select("s_suppkey", url("s_suppkey div 2 * 2"))
    return matching.url_matches(c, s, "url", "c_custkey", "s_suppkey")


_VOTES = """
SELECT l_orderkey AS release_id, l_suppkey AS folder, n, total / n AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, total DESC, l_suppkey) AS place FROM (
    SELECT l_orderkey, l_suppkey, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY ALL)) WHERE place = 1"""


def votes(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("release_id"), F.col("l_suppkey").alias("folder"), F.col("l_quantity").alias("score"))
    return matching.folder_votes(rows, "release_id", "folder", "score")


@query("match_folder_votes", _VOTES)
def match_folder_votes(spark, d):
    return votes(spark, d)


@query("match_folder_claims", f"""
SELECT folder, release_id, score FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY score DESC, release_id) AS place FROM ({_VOTES})) WHERE place = 1""")
def match_folder_claims(spark, d):
    best = votes(spark, d).withColumn("seq", F.col("release_id"))
    return matching.claim_folders(best, "release_id", "folder", "score", "seq").drop("seq")


@query("match_one_to_one", """
WITH RECURSIVE p AS (SELECT l_orderkey AS g, l_linenumber AS a, (l_partkey * 7 + l_linenumber) % 4 AS b, (l_quantity * 2) % 101 AS score FROM lineitem),
best AS (SELECT g, a, b, max(score) AS score FROM p GROUP BY ALL),
go AS (
  SELECT DISTINCT g, 0 AS a, NULL::BIGINT AS b, NULL::DOUBLE AS score, []::BIGINT[] AS used FROM p
  UNION ALL
  SELECT go.g, go.a + 1, x.b, x.score, CASE WHEN x.b IS NULL THEN used ELSE list_append(used, x.b) END
  FROM go LEFT JOIN LATERAL (SELECT arg_max(b, score * 10 - b) AS b, max(score) AS score FROM best WHERE best.g = go.g AND best.a = go.a + 1 AND best.score >= 50 AND NOT list_contains(go.used, best.b)) x ON true
  WHERE go.a < 7)
SELECT g, a::INT AS a, b, score FROM go WHERE b IS NOT NULL""")
def match_one_to_one(spark, d):
    li = table(spark, d, "lineitem")
    p = li.select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("a"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 4).alias("b"), ((F.col("l_quantity") * 2) % 101).alias("score"))
    best = p.groupBy("g", "a", "b").agg(F.max("score").alias("score"))
    return matching.one_to_one(best.withColumn("place", F.col("a")), ["g"], "a", "b", "place", "score")


@query("match_known_reasons", """
SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) THEN 'url' WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) THEN 'comment'
  WHEN c_acctbal >= 8000 AND c_custkey % 100 >= 50 THEN 'names' END AS reason FROM customer""")
def match_known_reasons(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("url"))
    local = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("url"))
    said = table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("url"))
    fuzzy = c.select("c_custkey", (F.col("c_acctbal") / 100).alias("score"), (F.col("c_custkey") % 100).alias("album_score"))
    return matching.known_reason(c, local, said, fuzzy, "c_custkey", "url").select("c_custkey", "reason")


@query("stream_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_counts(spark, d):
    """Events per hour and type, counted by a stream that reads the table's files and ends once all are read."""
    return refresh.hourly_counts(spark, f"{d}/events.parquet", "ts", "event_type")


# Values that must come out of names, posts and paths.

_REMARK = "CASE p_partkey % 6 WHEN 0 THEN ' (Bonus Track Version)' WHEN 1 THEN ' [LIVE01]' WHEN 2 THEN ' [Live at Home]' WHEN 3 THEN ' (Collectors Edition)' WHEN 4 THEN ' ‐ ‘x’' ELSE ' (Free  Download)' END"


@query("names_cleaned", "SELECT p_partkey, p_name || CASE p_partkey % 6 WHEN 2 THEN ' live at home' WHEN 4 THEN ' x' ELSE '' END AS name FROM part")
def names_cleaned(spark, d):
    p = table(spark, d, "part").withColumn("raw", F.expr(f"upper(p_name) || {_REMARK}"))
    return p.select("p_partkey", T.normalize_for_matching(F.col("raw")).alias("name"))


@query("name_parts", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::INT WHEN 1 THEN 4 END AS volume, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS artist,
  CASE WHEN p_partkey % 3 = 0 THEN p_name || ' - ' || p_type ELSE p_name || '-' || p_type END AS title FROM part""")
def name_parts(spark, d):
    p = table(spark, d, "part")
    said = F.expr("p_name || CASE p_partkey % 4 WHEN 0 THEN ' Vol. ' || p_size WHEN 1 THEN ' pt iv' WHEN 2 THEN ' Volume C' ELSE '' END")
    whole = F.expr("CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' – ' || p_name || '  -  ' || p_type ELSE p_name || '-' || p_type END")
    made = T.embedded_artist(whole)
    return p.select("p_partkey", T.volume(said).alias("volume"), made["artist"].alias("artist"), made["title"].alias("title"))


@query("release_labels", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_brand || ' Records' WHEN 1 THEN p_brand || ', ' || p_type WHEN 2 THEN p_brand WHEN 3 THEN p_brand END AS label FROM part""")
def release_labels(spark, d):
    said = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'Released by ' || p_brand || ' Records' WHEN 1 THEN 'released on: ' || p_brand || ', ' || p_type || ' &amp; ' || p_name WHEN 2 THEN 'Released by ' || p_brand || ' AND ' || p_name || ', x' WHEN 3 THEN 'Out now. Released by ' || p_brand || '.' ELSE p_name END")
    return table(spark, d, "part").select("p_partkey", releases.label_name(F.concat(F.lit("<p>first</p><p>"), said, F.lit("</p>"))).alias("label"))


@query("release_tracklists", """
SELECT p_partkey, (p_partkey % 120)::INT AS number, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS artist, CASE WHEN p_partkey % 3 = 0 THEN '174' END AS bpm
FROM part WHERE p_partkey % 120 < 100""")
def release_tracklists(spark, d):
    line = F.expr("(p_partkey % 120) || '. ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' – ' || p_type ELSE ' -' END || CASE WHEN p_partkey % 3 = 0 THEN ' [174 bpms] extra' ELSE '' END")
    rows = table(spark, d, "part").select("p_partkey", F.explode(releases.tracklist(F.concat(F.lit("<p>Tracks:<br>"), line, F.lit("</p>")))).alias("t"))
    return rows.select("p_partkey", "t.number", "t.title", "t.artist", "t.bpm")


@query("category_kinds_default", "SELECT p_partkey, CASE WHEN p_size IN (1, 3, 6, 42) THEN 'ignored' WHEN p_size IN (7, 8, 9, 10, 11, 12, 14, 15, 16, 28, 29, 30, 33, 44, 47, 48, 69) THEN 'genre' ELSE 'label' END AS kind FROM part")
def category_kinds_default(spark, d):
    return table(spark, d, "part").select("p_partkey", releases.category_kind(F.col("p_size")).alias("kind"))


@query("path_segments_cut", "SELECT p_partkey, left(repeat('é', (p_size * 10)::INT), 127) AS two, left(repeat('ab-', (p_size * 10)::INT), 255) AS one FROM part")
def path_segments_cut(spark, d):
    many = lambda c: F.repeat(F.lit(c), F.expr("int(p_size * 10)"))
    return table(spark, d, "part").select("p_partkey", T.path_segment(many("é")).alias("two"), T.path_segment(many("ab?")).alias("one"))


@query("view_names_taken", """
SELECT p_partkey, 'x.mp3' AS target, 'b' || (p_partkey // 4) || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 3 THEN '_1' ELSE '_' || (p_partkey % 4 + 1) END || '.mp3' AS link_path, p_partkey % 4 IN (1, 2) AS is_duplicate
FROM part WHERE p_partkey >= 4""")
def view_names_taken(spark, d):
    """Three rows of four share a name; the fourth has by itself what the second would get."""
    p = table(spark, d, "part").filter("p_partkey >= 4").select("p_partkey", F.lit("x.mp3").alias("file"), F.expr("'b' || (p_partkey div 4) || CASE WHEN p_partkey % 4 = 3 THEN '_1' ELSE '' END").alias("base"))
    return template.link_paths(p, "{{ base }}", "file", "p_partkey")


# Searches that meet nulls, with the key among the phrase columns.

_HOLES = "(SELECT p_partkey, 'k' || p_partkey AS k, p_name, CASE WHEN p_size % 5 > 0 THEN p_brand END AS p_brand, CASE WHEN p_size % 3 > 0 THEN p_type END AS p_type, CASE WHEN p_size % 7 > 0 THEN p_size END AS p_size FROM part)"


def holed_search(name: str, text: str, where: str) -> None:
    def run(spark, d):
        p = table(spark, d, "part").selectExpr("p_partkey", "'k' || p_partkey AS k", "p_name", "CASE WHEN p_size % 5 > 0 THEN p_brand END AS p_brand", "CASE WHEN p_size % 3 > 0 THEN p_type END AS p_type", "CASE WHEN p_size % 7 > 0 THEN p_size END AS p_size")
        few = table(spark, d, "lineitem").filter("l_quantity > 47").select("l_partkey", "l_returnflag")
        cat = Catalog("p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size"}, ["k", "p_name", "p_brand", "p_type"], {"flag": (few, "l_partkey", "l_returnflag")}, loose=["p_name", "p_brand", "p_type"])
        return search(p, cat, text)

    query(name, f"SELECT * FROM {_HOLES} WHERE {where}")(run)


_LOOSE = "(p_name ILIKE '%{v}%' OR p_brand ILIKE '%{v}%' OR p_type ILIKE '%{v}%')"
_FEW = "p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 47 AND {})"
holed_search("search_null_negated", '-brand:="brand#13" -type:promo', "lower(p_brand) <> 'brand#13' AND p_type NOT ILIKE '%promo%'")
holed_search("search_null_compare", "-size:>20 | size:\"\"", "NOT p_size > 20 OR p_size IS NULL")
holed_search("search_null_empty", 'brand:"" -type:""', "p_brand IS NULL AND p_type IS NOT NULL")
holed_search("search_unknown_negated", "-colour:widget", f"NOT {_LOOSE.format(v='widget')}")
holed_search("search_unknown_skips_key", "colour:k1", _LOOSE.format(v="k1"))
holed_search("search_phrase_key", "k1 -widget", "k LIKE 'k1%' AND NOT (' ' || p_name || ' ' LIKE '% widget%')")
holed_search("search_membership_few", "-flag:r size:<30", f"NOT {_FEW.format(chr(39) + 'r' + chr(39) + ' = lower(l_returnflag)')} AND p_size < 30")


# The library's read side: customers as tracks, their nations as crates.

_TRACKS = "(SELECT c_custkey AS id, c_name AS title, c_mktsegment AS genre, c_acctbal AS bpm, CASE c_custkey % 7 WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE 0 END AS deleted, c_custkey AS location, CASE WHEN c_custkey % 4 > 0 THEN c_custkey * 1000 END AS source_synchronized_ms FROM customer)"
_LOCATIONS = "(SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '/other/' || c_name WHEN 1 THEN '' ELSE '/music/' || c_name END AS location FROM customer)"


def library_of(spark, d):
    c = table(spark, d, "customer")
    tracks = c.selectExpr("c_custkey AS id", "c_name AS title", "c_mktsegment AS genre", "c_acctbal AS bpm", "CASE c_custkey % 7 WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE 0 END AS deleted", "c_custkey AS location", "CASE WHEN c_custkey % 4 > 0 THEN c_custkey * 1000 END AS source_synchronized_ms")
    locations = c.selectExpr("c_custkey AS id", "CASE c_custkey % 5 WHEN 0 THEN '/other/' || c_name WHEN 1 THEN '' ELSE '/music/' || c_name END AS location")
    links = c.filter("c_custkey % 3 > 0").selectExpr("c_custkey AS track_id", "c_nationkey AS crate_id").union(c.selectExpr("c_custkey", "(c_nationkey + 1) % 25").filter("c_custkey % 3 = 1"))
    return tracks, locations, links, table(spark, d, "nation").selectExpr("n_nationkey AS id", "n_name AS name", "CASE WHEN n_regionkey > 1 THEN 1 ELSE 0 END AS show", "CASE n_regionkey WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE 0 END AS hidden", "25 - n_nationkey AS position")


@query("library_find_tracks", f"SELECT id, title FROM {_TRACKS} WHERE deleted <> 1 AND genre ILIKE '%build%' AND title ILIKE '%1%' AND bpm BETWEEN 0 AND 5000")
def library_find_tracks(spark, d):
    return library.find_tracks(library_of(spark, d)[0], {"genre": "Build", "title": "1"}, (0, 5000), limit=0).select("id", "title")


@query("library_find_limited", f"SELECT id FROM {_TRACKS} WHERE deleted <> 1 ORDER BY id LIMIT 25")
def library_find_limited(spark, d):
    return library.find_tracks(library_of(spark, d)[0], limit=25).select("id")


@query("library_visible_lists", "SELECT 'crate' AS kind, n_name AS name FROM nation WHERE n_regionkey > 1 UNION ALL SELECT 'playlist', n_name FROM nation WHERE n_regionkey > 1")
def library_visible_lists(spark, d):
    n = library_of(spark, d)[3]
    return library.visible_crates(n).select(F.lit("crate").alias("kind"), "name").union(library.visible_playlists(n).select(F.lit("playlist"), "name"))


@query("library_crate_members", f"""
SELECT n_nationkey AS crate_id, t.id, t.title FROM nation JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 3 > 0 JOIN {_TRACKS} t ON t.id = c_custkey WHERE n_regionkey > 1
UNION ALL SELECT n_nationkey, t.id, t.title FROM nation JOIN customer ON (c_nationkey + 1) % 25 = n_nationkey AND c_custkey % 3 = 1 JOIN {_TRACKS} t ON t.id = c_custkey WHERE n_regionkey > 1""")
def library_crate_members(spark, d):
    tracks, _, links, crates = library_of(spark, d)
    return library.members(library.visible_crates(crates), links, tracks.select("id", "title"), "crate_id").select("crate_id", "id", "title")


_META = f"""
SELECT t.id, t.title, l.location AS file_path, substr(l.location, 8) AS relative_path,
  array_to_string(list_sort(CASE t.id % 3 WHEN 0 THEN [] WHEN 1 THEN [a.n_name, b.n_name] ELSE [a.n_name] END), '|') AS crates
FROM {_TRACKS} t JOIN {_LOCATIONS} l ON l.id = t.location JOIN customer c ON c.c_custkey = t.id JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = (c_nationkey + 1) % 25
WHERE t.deleted <> 1 AND l.location LIKE '/music/%'"""


def metadata(spark, d, since=None):
    out = library.track_metadata(*library_of(spark, d), "/music", since)
    return out.select("id", "title", "file_path", "relative_path", F.array_join("crates", "|").alias("crates"))


@query("library_metadata", _META)
def library_metadata(spark, d):
    return metadata(spark, d)


@query("library_changed", _META + " AND (t.source_synchronized_ms > 500000 OR t.source_synchronized_ms IS NULL)")
def library_changed(spark, d):
    return metadata(spark, d, 500000)


@query("library_missing_some", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def library_missing_some(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query("match_duplicates", _LCS.format(col="p_name", tab="part", least=66.66) + """
SELECT p_partkey AS key, CASE WHEN p_partkey % 10 = 0 THEN 'url' WHEN p_partkey % 10 = 1 THEN 'comment'
  WHEN p_name IN (SELECT a FROM scored WHERE b IN (SELECT p_name FROM part WHERE p_size < 3) AND 40 + 0.6 * score >= 80) THEN 'names' END AS reason FROM part""")
def match_duplicates(spark, d):
    p = table(spark, d, "part")
    posts = p.select(F.col("p_partkey").alias("key"), F.expr("'https://x.example/p_' || p_partkey || '/'").alias("url"), F.lit("Some Artist").alias("artist"), F.initcap("p_name").alias("album"))
    urls = posts.filter("key % 10 = 0").select("url")
    comments = p.filter("p_partkey % 10 = 1").select(F.expr("'from HTTPS://X.example/p-' || p_partkey || '/ with thanks'").alias("comment"))
    albums = p.filter("p_size < 3").select(F.lit("some artist").alias("artist"), F.upper("p_name").alias("album"))
    return matching.duplicate_reasons(posts, urls, comments, albums).select("key", "reason")


# The matching phases over releases made of suppliers. Names are md5 texts: equal or far apart, so SQL can tell what each phase finds.

def cascade_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Releases, their tracks and local files: by ``s_suppkey % 6`` a URL, a comment, a path, tags, a track or nothing tells them."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 6).alias("kind"), *[F.md5(F.concat(F.lit(c), F.col("s_suppkey").cast("string"))).alias(n) for c, n in (("b", "band"), ("a", "album"), ("t", "one"), ("u", "two"))])
    url = F.concat(F.lit("https://s"), F.col("id").cast("string"), F.lit(".shop.example/album"))
    releases = s.select(F.col("id").alias("release_id"), F.col("id").alias("seq"), "band", F.upper("album").alias("album"), url.alias("url"))
    asked = s.filter("kind in (1, 4)").select(F.col("id").alias("release_id"), F.posexplode(F.array("one", "two")).alias("place", "title"))
    folder = F.when(F.col("kind") == 1, F.concat(F.lit("inbox/"), F.col("album"))).when(F.col("kind") == 2, F.concat_ws("/", "band", "album")).otherwise(F.concat(F.lit("box/"), F.col("id").cast("string")))
    each = s.select("*", folder.alias("folder"), url.alias("link"), F.posexplode(F.array("two", "one")).alias("n", "title"))
    when = lambda kind, c: F.when(F.col("kind") == kind, c)
    tracks = each.select(
        F.concat_ws("-", F.col("id").cast("string"), F.col("n").cast("string")).alias("key"), F.concat(F.col("folder"), F.lit("/0"), F.col("n").cast("string"), F.lit(".flac")).alias("file"),
        F.when(F.col("kind").isin(1, 2, 4), F.col("title")).alias("title"), F.when(F.col("kind").isin(3, 4), F.col("band")).alias("artist"), when(3, F.col("album")).alias("album"),
        when(1, F.concat(F.lit("see "), F.col("link"))).alias("comment"), when(0, F.col("link")).alias("url"), F.lit(None).cast("string").alias("number"),
    )
    return releases, asked.withColumn("number", F.col("place")), tracks


_PHASE = "CASE s_suppkey % 6 WHEN 0 THEN 'metadata' WHEN 1 THEN 'comment' WHEN 2 THEN 'folder' ELSE 'global' END"


@query("match_cascade", f"""
SELECT s_suppkey AS release_id, {_PHASE} AS phase, 100.0::DOUBLE AS score, 'exact' AS tier, s_suppkey || '-' || n AS key,
  CASE WHEN s_suppkey % 6 IN (1, 4) THEN 1 - n END::INT AS place, 100.0::DOUBLE AS own
FROM supplier CROSS JOIN (VALUES (0), (1)) AS v(n) WHERE s_suppkey % 6 < 5""")
def match_cascade(spark, d):
    return cascade.match_releases(*cascade_of(spark, d), "shop.example").drop("file")


@query("match_cascade_stats", """
SELECT count(*) AS total, count(*) FILTER (s_suppkey % 6 = 0) AS matched_metadata, count(*) FILTER (s_suppkey % 6 = 1) AS matched_comment, count(*) FILTER (s_suppkey % 6 = 2) AS matched_folder,
  count(*) FILTER (s_suppkey % 6 IN (3, 4)) AS matched_global, count(*) FILTER (s_suppkey % 6 < 5) AS tier_exact, 0::BIGINT AS tier_high, 0::BIGINT AS tier_low, count(*) FILTER (s_suppkey % 6 = 5) AS unmatched FROM supplier""")
def match_cascade_stats(spark, d):
    releases, asked, tracks = cascade_of(spark, d)
    return cascade.match_stats(releases, cascade.match_releases(releases, asked, tracks, "shop.example"))


@query("match_repairs", """
SELECT 'f' || s_suppkey AS file, CASE WHEN s_suppkey % 6 < 5 THEN s_suppkey END AS release_id, CASE WHEN s_suppkey % 6 < 5 THEN 100.0::DOUBLE END AS score,
  CASE WHEN s_suppkey % 6 < 5 THEN 'exact' ELSE 'none' END AS tier, CASE s_suppkey % 6 WHEN 5 THEN 'none' WHEN 4 THEN 'track' ELSE 'release' END AS match_type,
  CASE WHEN s_suppkey % 2 = 0 THEN 'flac' ELSE 'wav' END AS encoding, CASE WHEN s_suppkey % 6 IN (1, 3) THEN 'Format ''wav'' not available; have: aac, flac' END AS warning FROM supplier""")
def match_repairs(spark, d):
    releases, asked, _ = cascade_of(spark, d)
    kind = F.col("release_id") % 6
    file = F.concat(F.lit("f"), F.col("release_id").cast("string")).alias("file")
    songs = asked.filter("place = 1").select("release_id", "title")
    tracks = releases.join(songs, "release_id", "left").select(
        file, F.when(kind < 5, F.col("band")).alias("artist"), F.when(kind != 4, F.lower("album")).otherwise("q").alias("album"), "title",
        F.when(F.col("release_id") % 2 == 0, "flac").otherwise("wav").alias("encoding"))
    formats = releases.select("release_id", F.explode(F.array(F.lit("flac"), F.lit("aac"))).alias("encoding"))
    return cascade.repair_matches(releases.select(file), tracks, releases, asked, formats)


# A table built from logs, rows expanded for views, lists written to.

_LINES = "(SELECT user_id AS key, event_type AS field, unnest(['A' || (event_id % 7), 'B' || (event_id % 5)]) AS value, unnest(['+', '-']) AS op, event_id AS line_no, unnest([1, 2]) AS pos FROM events)"


def built(spark, d):
    e = table(spark, d, "events")
    line = F.concat(F.lit("1700000000s "), F.col("event_type"), F.lit(" +A"), (F.col("event_id") % 7).cast("string"), F.lit(" -B"), (F.col("event_id") % 5).cast("string"))
    lines = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("line_no"), line.alias("line"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("file"))
    return changelog.build_tables(lines, c.filter("key % 3 > 0"), c.filter("key % 2 = 0"), ["view", "error"], "click")


_BUILT = f"SELECT key, field, value FROM {_LINES} GROUP BY key, field, value HAVING arg_max(op, line_no * 10 + pos) = '+'"


@query("build_table", f"""
SELECT key, min(value) FILTER (field = 'view') AS view, min(value) FILTER (field = 'error') AS error, any_value(CASE WHEN key % 3 > 0 THEN c_name END) AS file,
  coalesce(any_value(c_name IS NOT NULL AND key % 3 > 0 AND key % 2 = 0), false) AS present
FROM ({_BUILT}) LEFT JOIN customer ON c_custkey = key GROUP BY key""")
def build_table(spark, d):
    return built(spark, d)[0]


@query("build_children", f"SELECT key, value AS click FROM ({_BUILT}) WHERE field = 'click'")
def build_children(spark, d):
    return built(spark, d)[1]


@query("view_expanded", """
SELECT p_partkey, coalesce(flag, 'Unknown') || '/' || p_name AS path FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_returnflag AS flag FROM lineitem WHERE l_quantity > 45) ON l_partkey = p_partkey
UNION ALL SELECT p_partkey, p_name FROM part""")
def view_expanded(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    flags = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("flag"))
    out = [template.expanded(p, flags, "p_partkey", "flag", t) for t in ("{{ flag }}/{{ p_name }}", "{{ p_name }}")]
    return out[0].select("p_partkey", template.render(out[0], "{{ flag }}/{{ p_name }}").alias("path")).union(out[1].select("p_partkey", template.render(out[1], "{{ p_name }}")))


@query("library_update_track", "SELECT c_custkey AS id, CASE c_custkey WHEN 7 THEN 'New' ELSE c_name END AS title, CASE c_custkey WHEN 7 THEN 5 ELSE 1 END::INT AS rating, c_mktsegment AS genre FROM customer")
def library_update_track(spark, d):
    t = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS title", "1 AS rating", "c_mktsegment AS genre")
    return library.update_track(t, 7, title="New", rating=9, genre=None)


_LISTS = "(SELECT l_orderkey AS list_id, l_suppkey % 3 AS track_id, l_linenumber AS position FROM lineitem)"


@query("library_lists_written", f"""
SELECT list_id, track_id, position FROM (SELECT *, row_number() OVER (PARTITION BY list_id, track_id ORDER BY position) AS n FROM {_LISTS}) WHERE NOT (track_id = 1 AND list_id % 2 = 0 AND n = 1)
UNION ALL SELECT o_orderkey, 3, m + 1 FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE m IS NOT NULL
UNION ALL SELECT o_orderkey, 3, 1 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)
UNION ALL SELECT o_orderkey, 4, 99 FROM orders""")
def library_lists_written(spark, d):
    links = table(spark, d, "lineitem").selectExpr("l_orderkey AS list_id", "l_suppkey % 3 AS track_id", "l_linenumber AS position")
    o = table(spark, d, "orders")
    added = o.selectExpr("o_orderkey AS list_id", "3L AS track_id", "cast(null AS int) AS position").union(o.selectExpr("o_orderkey", "4L", "99"))
    # A task sorts some million rows; counts come from the files' footers.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(links.count() + 2 * o.count()) // 1_000_000))
    grown = library.append_to_lists(links, added, "list_id", tasks)
    return library.remove_from_lists(grown, o.filter("o_orderkey % 2 = 0").selectExpr("o_orderkey AS list_id", "1L AS track_id"), "list_id", tasks)


@query("library_list_sizes", "SELECT o_orderkey AS id, coalesce(n, 0)::BIGINT AS \"count\" FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY 1) ON l_orderkey = o_orderkey")
def library_list_sizes(spark, d):
    links = table(spark, d, "lineitem").filter("l_quantity > 30").selectExpr("l_orderkey AS list_id")
    return library.list_sizes(table(spark, d, "orders").selectExpr("o_orderkey AS id"), links, "list_id")


# Repeated runs over files.

@query("runs_up_to_date", """
SELECT p_partkey, coalesce((p_size + 1000 <= m), false) AS skip FROM part LEFT JOIN (SELECT l_partkey, max(l_quantity) + 980 AS m FROM lineitem WHERE l_quantity < 40 GROUP BY 1) ON l_partkey = p_partkey""")
def runs_up_to_date(spark, d):
    sources = table(spark, d, "part").selectExpr("p_partkey", "p_size + 1000 AS mtime")
    outputs = table(spark, d, "lineitem").filter("l_quantity < 40").selectExpr("l_partkey AS p_partkey", "l_quantity + 980 AS mtime")
    return runs.up_to_date(sources, outputs, "p_partkey").drop("mtime")


_BEFORE = "(SELECT c_custkey AS file, CASE c_custkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' END AS status FROM customer WHERE c_custkey % 3 > 0)"


@query("runs_carried_over", f"SELECT file, status FROM {_BEFORE} WHERE status IN ('ok', 'warning') UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey NOT IN (SELECT file FROM {_BEFORE} WHERE status IN ('ok', 'warning'))")
def runs_carried_over(spark, d):
    files = table(spark, d, "customer").select(F.col("c_custkey").alias("file"))
    before = files.filter("file % 3 > 0").selectExpr("file", "CASE file % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' END AS status")
    kept, rest = runs.carried_over(files, before)
    return kept.union(rest.withColumn("status", F.lit("new")))


@query("runs_all_there", "SELECT l_orderkey, bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 45)) AS complete FROM lineitem GROUP BY 1")
def runs_all_there(spark, d):
    return runs.all_there(table(spark, d, "lineitem"), table(spark, d, "part").filter("p_size < 45").select(F.col("p_partkey").alias("l_partkey")), "l_orderkey", "l_partkey")


@query("runs_first_of", """
SELECT o_custkey, arg_min(o_orderpriority, list_position(['2-high', '1-urgent', '5-low'], lower(o_orderpriority))) AS o_orderpriority FROM orders
WHERE lower(o_orderpriority) IN ('2-high', '1-urgent', '5-low') GROUP BY 1""")
def runs_first_of(spark, d):
    return runs.first_of(table(spark, d, "orders"), "o_custkey", "o_orderpriority", ["2-high", "1-urgent", "5-low"])


@query("runs_first_seen", """
SELECT k, min(part)::INT AS part FROM (SELECT o_custkey AS k, 0 AS part FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_acctbal > 0 UNION ALL SELECT o_custkey, 2 FROM orders) GROUP BY 1""")
def runs_first_seen(spark, d):
    o, c = table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), table(spark, d, "customer").withColumnRenamed("c_custkey", "k")
    return runs.first_seen([o.filter("o_orderstatus = 'F'"), c.filter("c_acctbal > 0"), o], "k")


@query("runs_tools_missing", """
SELECT p_brand AS extension, count(*) AS files, coalesce(any_value(missing), '') AS missing FROM part LEFT JOIN (
  SELECT p_brand AS b, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS missing FROM part WHERE p_size > 47 AND p_type NOT ILIKE '%brass%' GROUP BY 1) ON b = p_brand GROUP BY 1""")
def runs_tools_missing(spark, d):
    p = table(spark, d, "part")
    tools = p.filter("p_size > 47").select(F.col("p_brand").alias("extension"), F.col("p_type").alias("tool"))
    out = runs.tools_missing(p, tools, p.filter("p_type ILIKE '%brass%'").select(F.col("p_type").alias("tool")), F.col("p_brand"))
    return out.withColumn("missing", F.array_join("missing", "|"))


@query("runs_report_rows", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'high' ELSE 'none' END AS tier, CASE WHEN c_custkey % 3 = 0 THEN round_even(c_custkey / 2.0, 0)::DOUBLE END AS score FROM customer")
def runs_report_rows(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    return runs.report_rows(c, c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("high").alias("tier"), (F.col("c_custkey") / 2).alias("score")), "c_custkey")


@query("runs_names_of", """
SELECT c_custkey, array_to_string(list_filter([b.n_name, a.n_name, b.n_name], lambda x: x IS NOT NULL), '|') AS names FROM customer
LEFT JOIN nation a ON a.n_nationkey = c_nationkey AND a.n_regionkey > 0 LEFT JOIN nation b ON b.n_nationkey = (c_nationkey + 5) % 25 AND b.n_regionkey > 0""")
def runs_names_of(spark, d):
    ids = table(spark, d, "customer").selectExpr("c_custkey", "array((c_nationkey + 5) % 25, c_nationkey, (c_nationkey + 5) % 25, 99) AS ids")
    names = table(spark, d, "nation").filter("n_regionkey > 0").selectExpr("n_nationkey AS id", "n_name AS name")
    return runs.names_of(ids, "c_custkey", "ids", names).withColumn("names", F.array_join("names", "|"))


from tonearm import queries_more  # noqa: E402, F401  (registers its own)

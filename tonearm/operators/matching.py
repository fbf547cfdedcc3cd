"""Entity resolution: fuzzy scores over distinct names, best matches, tiers and a duplicate cascade."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions.similarity import BLOCK, blocks, partial_ratio_udf, ratio, ratio_from, sorted_tokens, token_sort_ratio
from tonearm.functions.text import normalize_for_matching, tier
from tonearm.sources.tables import stored

#: Names up to this long are met through their subsequences where their letter pairs tell nothing.
SHORT = 5


#: Names that a task holds at once, and names of the other side that it reads against them.
HELD, READ = BLOCK, BLOCK // 4

#: So few held names are compared one by one.
FEW = 8


def name_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of distinct names whose token-sort ratio reaches ``least``; all meet all in :func:`met`, which loses no pair."""
    a = left.select(F.col(left.columns[0]).alias("name")).filter("name is not null").distinct()
    b = right.select(F.col(right.columns[0]).alias("name")).filter("name is not null").distinct()
    text = sorted_tokens(F.col("name")).alias("text")
    return met(a.select("name", text), b.select("name", text), ratio_from, least)


def met(left: DataFrame, right: DataFrame, kernel: Callable, least: float) -> DataFrame:
    """(a, b, score) of all names of ``left(name, text)`` and ``right(name, text)`` whose texts ``kernel(block, text, least)`` finds alike.

    Every text meets every other one, as common letter pairs tell too little at such scores. Both sides are dealt into cells of a grid: of a cell's rows a task
    holds the left names, ``HELD`` or so, and reads the right ones one by one. Lengths and then letters in any order rule most of the held names out before any order of letters is read.
    """
    left, right = stored(left), stored(right)
    rows, columns = max(1, math.ceil(left.count() / HELD)), max(1, math.ceil(right.count() / READ))
    dealt = lambda n: F.pmod(F.xxhash64("name"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    held = left.select("name", "text", F.lit(0).alias("side"), dealt(rows).alias("row"), every(columns).alias("column"))
    read = right.select("name", "text", F.lit(1).alias("side"), every(rows).alias("row"), dealt(columns).alias("column"))
    # A cell is a task: hashed cells would leave some tasks with several and others with none.
    cells = held.union(read).withColumn("cell", F.col("row") * columns + F.col("column")).repartitionById(rows * columns, F.col("cell").cast("int"))
    return cells.select("cell", "side", "name", "text").sortWithinPartitions("cell", "side").mapInPandas(met_in_cells(kernel, least, ["cell"]), "cell long, a string, b string, score double").drop("cell")


def name_pairs_within(left: DataFrame, right: DataFrame, on: list[str], least: float) -> DataFrame:
    """(*on, a, b, score) of distinct names ``left(*on, a)`` and ``right(*on, b)`` that share ``on`` and whose token-sort ratio reaches ``least``.

    Names meet within their group only; a large group is dealt into cells as in :func:`met`.
    """
    a = left.select(*on, F.col("a").alias("name")).filter("name is not null").distinct()
    b = right.select(*on, F.col("b").alias("name")).filter("name is not null").distinct()
    cells = lambda d, n, size: d.groupBy(*on).agg(F.ceil(F.count("*") / size).alias(n))
    sizes = cells(a, "rows", HELD).join(cells(b, "columns", READ), on)
    dealt = lambda n: F.pmod(F.xxhash64("name"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys, rest = [*on, "row", "column"], ["name", sorted_tokens(F.col("name")).alias("text")]
    held = a.join(sizes, on).select(*on, dealt("rows").alias("row"), every("columns").alias("column"), F.lit(0).alias("side"), *rest)
    read = b.join(sizes, on).select(*on, every("rows").alias("row"), dealt("columns").alias("column"), F.lit(1).alias("side"), *rest)
    schema = ", ".join(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in on) + ", row long, column long, a string, b string, score double"
    return held.union(read).repartition(*keys).sortWithinPartitions(*keys, "side").mapInPandas(met_in_cells(ratio_from, least, keys, ratio), schema).drop("row", "column")


def met_in_cells(kernel: Callable, least: float, keys: list[str], one: Callable | None = None) -> Callable:
    """Reads rows (*keys, side, name, text) sorted by cell and side; a cell's names of side 0 are held and meet those of side 1. Few held ones meet by ``one(text, text)``."""

    def walk(batches):
        own, names, found, out = None, [], None, []
        for pdf in batches:
            for *cell, side, name, text in zip(*(pdf[c].tolist() for c in (*keys, "side", "name", "text"))):
                if cell != own:
                    own, names, found = cell, [], None
                if side == 0:
                    names.append((text, name))
                    continue
                if one and len(names) <= FEW:
                    hits = [(name_, score) for text_, name_ in names if (score := one(text_, text)) >= least]
                    out += [(*cell, a, name, score) for a, score in hits]
                else:
                    if found is None:
                        names.sort(key=lambda x: len(x[0]))
                        found = blocks([x for x, _ in names])
                    for start, block in found:
                        at, score = kernel(block, text, least)
                        out += [(*cell, names[start + i][1], name, x) for i, x in zip(at.tolist(), score.tolist())]
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=[*keys, "a", "b", "score"])
                    out = []
        if out:
            yield pd.DataFrame(out, columns=[*keys, "a", "b", "score"])

    return walk


def covered(least: float) -> bool:
    """Whether names of more than ``SHORT`` letters that reach ``least`` share a letter pair."""
    return least >= 200 or math.ceil((SHORT + 1) * ((3.0 * least - 200.0) / (200.0 - least)) - 1.000001) >= 1


def letter_pairs(c: Column) -> Column:
    """Pairs of neighbouring letters, sorted, repeats told apart by their number."""
    pairs = F.when(F.length(c) > 1, F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.expr("cast(array() as array<string>)"))
    # An array of one holds the sorted pairs, so that they are sorted once.
    return F.transform(F.array(F.array_sort(pairs)), lambda s: F.transform(s, lambda g, i: F.concat(g, (i - F.array_position(s, g) + 2).cast("string"))))[0]


@lru_cache(maxsize=None)
def kept_letters(n: int, count: int) -> tuple[tuple[int, ...], ...]:
    return tuple(combinations(range(n), count))


def least_common(n: int, least: float) -> int:
    """The fewest letters that a name of ``n`` has in common with any string, if their ratio reaches ``least``: the string is all of them."""
    return max(1, math.ceil(n * least / (200.0 - least) - 1e-9))


def subsequences_udf(least: float):
    """All that may be left of a short name, at most 31 strings: its subsequences of :func:`least_common` letters and more."""

    @F.pandas_udf("array<string>")
    def left(names: pd.Series) -> pd.Series:
        return pd.Series([sorted({"".join([x[i] for i in keep]) for count in range(least_common(len(x), least), len(x) + 1) for keep in kept_letters(len(x), count)}) for x in names], dtype=object)

    return left


def window_subsequences_udf(least: float, most: int):
    """``n`` and ``key`` of what a short name of each length up to ``most`` may share with a window of that length: all its subsequences of the fewest letters.

    Each starts at its window's first letter, so a name gives a fixed number of keys for each of its letters.
    """

    @F.pandas_udf("array<struct<n:int,key:string>>")
    def shared(names: pd.Series) -> pd.Series:
        out = []
        for x in names:
            keys = set()
            for n in range(1, most + 1):
                rest = kept_letters(n - 1, least_common(n, least) - 1)
                for at in range(len(x)):
                    keys.update((n, x[at] + "".join([x[at + 1 + i] for i in keep])) for keep in rest if not keep or at + 1 + keep[-1] < len(x))
            out.append([{"n": n, "key": key} for n, key in sorted(keys)])
        return pd.Series(out, dtype=object)

    return shared


def best_match(pairs: DataFrame) -> DataFrame:
    """The best partner of each name, the first by name of equal ones, with its tier; combined before the shuffle."""
    best = pairs.groupBy("a").agg(F.max(F.struct("score", F.struct((-F.length("b")).alias("n")), "b")).alias("m"))
    return best.select("a", F.col("m.b").alias("b"), F.col("m.score").alias("score"), tier(F.col("m.score")).alias("tier"))


def known_by(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """``reason``: the first check that holds, in the given order, or ``new``."""
    out = F.lit("new")
    for name, check in reversed(checks):
        out = F.when(F.coalesce(check, F.lit(False)), name).otherwise(out)
    return rows.withColumn("reason", out)


def band_candidates(name: Column) -> Column:
    """Names that a store's band name may stand for: parts between spaced dashes, the likeliest first, then the name itself."""
    p, none = F.split(name, r"\s+[-–—]\s+"), F.expr("cast(array() as array<string>)")
    n = F.size(p)
    three = F.when(n >= 3, F.array(F.get(p, F.lit(1)), F.get(p, n - 2))).otherwise(none)
    two = F.when(n >= 2, F.array(F.get(p, n - 1), F.get(p, F.lit(0)))).otherwise(none)
    return F.array_distinct(F.concat(three, two, F.array(name)))


def safe_partial(query: Column, target: Column, least: int = 4, whole: Column | None = None, part: Column | None = None) -> Column:
    """Partial ratio, lowered where lengths differ much; short names are compared whole.

    A shorter name of two or more words that all stand in the longer one loses at most 15 %. ``whole`` and ``part`` are the token-sort and partial ratios where they
    are known; a null one gives a null.
    """
    q, t = F.length(query), F.length(target)
    share = F.least(q, t) / F.greatest(q, t)
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    short, long_ = F.when(q <= t, query).otherwise(target), F.when(q <= t, target).otherwise(query)
    inside = (F.size(words(short)) >= 2) & (F.size(F.array_except(words(short), words(long_))) == 0)
    factor = F.when(share >= 0.5, 1.0).when(inside, F.greatest(2 * share, F.lit(0.85))).otherwise(2 * share)
    whole, part = token_sort_ratio(query, target) if whole is None else whole, partial_ratio_udf(query, target) if part is None else part
    score = F.when(F.least(q, t) < least, whole).otherwise(part * factor)
    return F.when((q > 0) & (t > 0), score).otherwise(F.lit(0.0))


def url_matches(releases: DataFrame, tracks: DataFrame, url: str, release_id: str, key: str) -> DataFrame:
    """Releases met by exact URL: score 100, tier exact; a URL may meet many of both."""
    a = releases.filter(F.col(url).isNotNull()).select(release_id, url)
    b = tracks.filter(F.col(url).isNotNull()).select(key, url)
    return a.join(b, url).select(release_id, key, F.lit(100.0).alias("score"), F.lit("exact").alias("tier"))


def folder_votes(candidates: DataFrame, release_id: str, folder: str, score: str) -> DataFrame:
    """Each release's folder: the one with most candidates, then the largest sum of scores, then by name; with their average."""
    by = candidates.groupBy(release_id, folder).agg(F.count("*").alias("n"), F.sum(score).alias("total"), F.avg(score).alias("score"))
    best = Window.partitionBy(release_id).orderBy(F.desc("n"), F.desc("total"), folder)
    return by.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(release_id, folder, "n", "score")


def claim_folders(best: DataFrame, release_id: str, folder: str, score: str, seq: str) -> DataFrame:
    """Greedy claims: a folder goes to the release that scores highest, the earlier one of equals.

    Every release has one best folder, so what all folders' first claims give is what claiming in the order of scores over all gives.
    """
    first = F.max_by(F.struct(release_id, score, seq), F.struct(score, -F.col(seq)))
    return best.groupBy(folder).agg(first.alias("m")).select(folder, "m.*")


def one_to_one(pairs: DataFrame, group: list[str], left: str, right: str, order: str, score: str, least: float = 50.0) -> DataFrame:
    """Within each group every left row, in order, takes its best free right row that scores ``least`` or more.

    Rows are sorted within tasks and read once, so a task holds no group, only what the one at hand has taken.
    """
    schema = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in (*group, left, right, score))
    kept = pairs.filter(F.col(score) >= least)
    rows = kept.repartition(*group).sortWithinPartitions(*group, order, left, F.desc(score), right).select(*group, left, right, score)

    def assign(batches):
        own, at, taken = None, None, set()
        for pdf in batches:
            keep = []
            for n, row in enumerate(zip(*[pdf[c].tolist() for c in (*group, left, right)])):
                if row[:-2] != own:
                    own, at, taken = row[:-2], None, set()
                if row[-2] != at and row[-1] not in taken:
                    at = row[-2]
                    taken.add(row[-1])
                    keep.append(n)
            yield pdf.iloc[keep]

    return rows.mapInPandas(assign, schema)


def known_reason(post: DataFrame, local_urls: DataFrame, comments: DataFrame, fuzzy: DataFrame, key: str, url: str) -> DataFrame:
    """Why a post counts as a duplicate: its URL was downloaded, a comment holds the URL, or the names are alike; else null.

    ``comments(url)`` are the URLs found in comments; ``fuzzy(key, score, album_score)`` holds each post's best partner.
    """
    flag = lambda d, c: d.select(F.col(url)).filter(F.col(url).isNotNull()).distinct().withColumn(c, F.lit(True))
    near = fuzzy.filter((F.col("score") >= 80) & (F.col("album_score") >= 50)).select(key, F.lit(True).alias("_near"))
    rows = post.join(flag(local_urls, "_url"), url, "left").join(flag(comments, "_comment"), url, "left").join(near, key, "left")
    reason = F.when(F.col("_url"), "url").when(F.col("_comment"), "comment").when(F.col("_near"), "names")
    return rows.withColumn("reason", reason).drop("_url", "_comment", "_near")


def said_urls(urls: DataFrame, comments: DataFrame) -> DataFrame:
    """Those of ``urls(url)``, each once, that one of ``comments(comment)`` holds by ILIKE.

    A comment holds all of what stands between a URL's wildcards, so both meet on the piece of it, of 7, 5 or 3 letters, that the fewest comments hold.
    Only URLs without three letters in a row meet all comments, which are dealt out to tasks. Pieces outnumber comments by far, which Spark's estimate of their size
    doesn't tell, so no side is broadcast; pieces go with their comment's hash, not its text.
    """
    # Short texts, but of many pieces: they are dealt out by their number, not by their size.
    tasks = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    urls, comments = urls.select("url").repartition(tasks, "url").distinct(), comments.select("comment").repartition(tasks, "comment").distinct()
    holds = F.expr("comment ilike '%' || url || '%'")
    cut = lambda c, n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.expr("cast(array() as array<string>)"))
    # A run of letters needs not all its pieces: every fourth and the last one leave out no letter.
    some = lambda c: F.transform(F.array_union(F.sequence(F.lit(1), F.greatest(F.length(c) - 6, F.lit(1)), F.lit(4)), F.array(F.length(c) - 6)), lambda i: F.substring(c, i, F.lit(7)))
    longest = lambda c: F.when(F.length(c) >= 7, some(c)).when(F.length(c) >= 5, cut(c, 5)).otherwise(cut(c, 3))
    # A backslash escapes the letter after it; both are left out.
    cuts = urls.withColumn("pieces", F.array_distinct(F.flatten(F.transform(F.split(F.lower("url"), r"(?s)\\.|[%_]"), longest))))
    low, mark = F.lower("comment"), F.xxhash64("comment")
    parts = comments.select(mark.alias("mark"), F.explode(F.array_distinct(F.concat(cut(low, 7), cut(low, 5), cut(low, 3)))).alias("piece"))
    # Stored, so that the join is one of two plain shuffles, where Spark can split what most URLs have in common.
    seen = stored(parts.groupBy("piece").agg(F.count("*").alias("n")))
    rows = cuts.select("url", F.explode_outer("pieces").alias("piece")).join(seen.hint("merge"), "piece", "left")
    key = rows.groupBy("url").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("m")).filter("m.n > 0").select("url", F.col("m.piece").alias("piece"))
    # Comments of one hash come all, as the text decides.
    met_ = key.join(parts.hint("merge"), "piece").join(comments.select(mark.alias("mark"), "comment").hint("merge"), "mark").filter(holds).select("url")
    bare = urls.filter(~F.rlike(F.regexp_replace(F.lower("url"), r"(?s)\\.", "%"), F.lit("[^%_]{3}"))).select("url", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("cell"))
    dealt = comments.select("comment", F.pmod(mark, F.lit(tasks)).cast("int").alias("at"))
    return met_.union(bare.join(dealt.hint("merge"), (F.col("cell") == F.col("at")) & holds, "left_semi").select("url")).distinct()


def duplicate_reasons(posts: DataFrame, local_urls: DataFrame, comments: DataFrame, albums: DataFrame, least: float = 80.0, least_album: float = 50.0) -> DataFrame:
    """``posts(key, url, artist, album)`` with ``reason``: its URL was downloaded, a comment holds the URL, the names are alike, or null.

    A comment holds a URL by LIKE: without regard to case, with ``%`` and ``_`` of the URL live; see :func:`said_urls`. Names are alike if the best of ``albums(artist, album)`` by 0.4 artist and 0.6 album
    reaches ``least`` and its album ``least_album``. Such an album alone scores ``(least - 40) / 0.6`` or more, so candidates come from
    :func:`name_pairs` without loss. Posts of one artist and album are scored once.

    All sides grow with the tables, whose files are far smaller than what comes of them, so none is broadcast but by its measured size.
    """
    found = said_urls(posts.filter("url is not null"), comments.filter("comment is not null"))
    clean = lambda c: normalize_for_matching(F.col(c))
    names = lambda d: d.select("artist", "album").filter("artist is not null and album is not null").distinct()
    # Stored, so that no filter on cleaned names goes below the distinct ones, to all rows.
    mine = stored(names(posts).select("artist", "album", clean("artist").alias("_a"), clean("album").alias("_b")))
    local = stored(names(albums).select(clean("artist").alias("_la"), clean("album").alias("_lb")).distinct())
    alike = name_pairs(mine.select("_b"), local.select("_lb"), max(0.0, (least - 40.0) / 0.6)).toDF("_b", "_lb", "_album")
    both = mine.join(alike.hint("merge"), "_b").join(local.hint("merge"), "_lb").withColumn("_score", 0.4 * token_sort_ratio(F.col("_a"), F.col("_la")) + 0.6 * F.col("_album"))
    scored = both.groupBy("artist", "album").agg(F.max(F.struct("_score", "_album")).alias("m"))
    # A left join, as its left side is never broadcast.
    best = posts.select("key", "artist", "album").join(scored, ["artist", "album"], "left").groupBy("key").agg(F.max("m").alias("m")).select("key", F.col("m._score").alias("score"), F.col("m._album").alias("album_score"))
    near = best.filter((F.col("score") >= least) & (F.col("album_score") >= least_album))
    return known_reason(posts, local_urls.hint("merge"), found.hint("merge"), near.hint("merge"), "key", "url")

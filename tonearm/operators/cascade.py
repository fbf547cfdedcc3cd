"""Releases of a store met with local files in phases: by URL, by links in comments, by folder names, by names anywhere.

Scores are joins over distinct names that lose no pair; what a release may take is then decided in order by one pass over sorted rows, which
holds only what was taken so far. Releases that share no folder, not even through others, are decided in different tasks.

``releases(release_id, seq, band, album, url)`` with ``seq`` their order; ``release_tracks(release_id, place, title, number)``, ``place`` unique in a
release; ``tracks(key, file, title, artist, album, comment, url, number)`` with text keys. Null names match nothing; equal scores go to the
least key. A file whose comment links to one sub-domain twice counts once.
"""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions import text as T
from tonearm.functions.similarity import part_from, partial_from_udf, ratio_once_udf, sorted_tokens
from tonearm.operators.components import components
from tonearm.operators.matching import SHORT, band_candidates, covered, least_common, letter_pairs, met, name_pairs, name_pairs_within, one_to_one, safe_partial, subsequences_udf, url_matches, window_subsequences_udf
from tonearm.sources.tables import stored

# Least scores, weights and the bonus for alike numbers of tracks.
LEAST_OF_PHASES, LEAST_PART, LEAST_TRACK = 75.0, 50.0, 50.0
ARTIST, TITLE, COUNT_BONUS, NUMBER_BONUS = 0.4, 0.6, 5.0, 5.0


def release_names(releases: DataFrame, release_tracks: DataFrame, domain: str) -> DataFrame:
    """Releases with all names they may go by, normalised, their volume, sub-domain and number of tracks."""
    inner = T.embedded_artist(F.col("album"))
    bands = F.transform(band_candidates(F.col("band")), T.normalize_for_matching)
    counts = release_tracks.groupBy("release_id").agg(F.count("*").alias("n_tracks"))
    return (
        releases.join(counts, "release_id", "left").fillna(0, ["n_tracks"])
        .withColumn("_inner", inner)
        .withColumn("artists", filled(F.array_union(bands, F.array(T.normalize_for_matching(F.col("_inner.artist"))))))
        .withColumn("title", T.normalize_for_matching(F.col("album")))
        .withColumn("albums", filled(F.array("title", F.when(F.col("_inner.artist").isNotNull(), T.normalize_for_matching(F.col("_inner.title"))))))
        .withColumns({"volume": T.volume(F.col("album")), "sub": F.get(T.subdomains(F.col("url"), domain), F.lit(0))})
        .select("release_id", "seq", "url", "artists", "title", "albums", "volume", "sub", "n_tracks")
    )


def local_names(tracks: DataFrame, domain: str) -> DataFrame:
    clean = lambda c: F.coalesce(T.normalize_for_matching(c), F.lit(""))
    return (
        tracks.withColumn("folder", F.coalesce(T.folder(F.col("file")), F.lit("")))
        .withColumns({"n_title": clean(F.col("title")), "n_artist": clean(F.col("artist")), "n_album": clean(F.col("album"))})
        .withColumn("names", filled(F.array("n_title", clean(T.stem(F.col("file"))))))
        .withColumn("subs", F.array_distinct(T.subdomains(F.col("comment"), domain)))
        .select("key", "file", "folder", "url", F.col("number").cast("string").alias("number"), "n_title", "n_artist", "n_album", "names", "subs")
    )


def filled(names: Column) -> Column:
    return F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "")))


def dealt(d: DataFrame, *keys: str) -> DataFrame:
    """Rows spread over tasks by ``keys``: names are few bytes but much work, and a small table would come as one task."""
    return d.repartition(d.sparkSession.sparkContext.defaultParallelism, *keys)


def partial_pairs(left: DataFrame, right: DataFrame, least: float, on: tuple[str, ...] = (), near: Column | None = None) -> DataFrame:
    """Candidates (*on, a, b) among which are all whose best window of the longer name reaches ``least`` against the shorter.

    Such a window is at least ``least / (200 - least)`` as long as the shorter name and shares letter pairs with it in proportion, so
    the longer name holds one of the shorter one's rarest. A name of up to five letters, too short for the bound, shares a subsequence with some window
    of its own length, so both meet on it. Below a score of about 69 the bound fails for longer names too; only then all pairs that ``near`` allows are met.
    """
    a, b = left.filter("a <> ''").distinct(), right.filter("b <> ''").distinct()
    if on:
        # Only names of groups that both sides have meet.
        a, b = a.join(b.select(*on).distinct(), [*on], "left_semi"), b.join(a.select(*on).distinct(), [*on], "left_semi")
    a, b = dealt(a, *on, "a"), dealt(b, *on, "b")
    share = (3 * least / 200 - 1) * 200 / (200 - least) if least < 200 else 1.0
    bound = lambda c: F.ceil(F.length(c) * share - 1.000001)
    keys = [*on, "pair"]

    def rows(d, name):
        return d.select(*on, name, F.explode(letter_pairs(F.col(name))).alias("pair"))

    all_a, all_b = rows(a, "a"), rows(b, "b")
    seen = all_a.select("pair").union(all_b.select("pair")).groupBy("pair").agg(F.count("*").alias("seen"))

    def rarest(d, name):
        place = F.row_number().over(Window.partitionBy(*on, name).orderBy("seen", "pair"))
        kept = d.filter(bound(name) >= 1).join(seen, "pair").withColumn("_place", place)
        return kept.filter(F.col("_place") <= F.length(name) - bound(name)).drop("_place", "seen")

    near = F.lit(True) if near is None else near
    first, then = near & (F.length("a") <= F.length("b")), near & (F.length("b") < F.length("a"))
    parts = [rarest(all_a, "a").join(all_b, keys).filter(first), all_a.join(rarest(all_b, "b"), keys).filter(then)]
    if covered(least):
        whole, window = subsequences_udf(least), window_subsequences_udf(least, SHORT)
        brief = lambda d, name: d.filter(F.length(name) <= SHORT).select(*on, name, F.length(name).alias("n"), F.explode(whole(name)).alias("key")).filter(F.length("key") == fewest(F.col("n"), least))
        longer = lambda d, name: d.select(*on, name, F.inline(window(name)))
        # A name's windows are many, so they are listed only in groups where the other side has a short name.
        beside = lambda d, other, name: d.join(other.filter(F.length(name) <= SHORT).select(*on).distinct(), [*on], "left_semi") if on else d
        parts += [brief(a, "a").join(longer(beside(b, a, "a"), "b"), [*on, "n", "key"]).filter(first), longer(beside(a, b, "b"), "a").join(brief(b, "b"), [*on, "n", "key"]).filter(then)]
    else:
        short = lambda d, name: d.filter(bound(name) < 1)
        join = lambda x, y, how: x.join(y, list(on)).filter(how) if on else x.join(y, how)
        parts += [join(short(a, "a"), b, first), join(a, short(b, "b"), then)]
    out = parts[0].select(*on, "a", "b")
    for p in parts[1:]:
        out = out.union(p.select(*on, "a", "b"))
    return out.distinct()


def fewest(n: Column, least: float) -> Column:
    return F.array(*[F.lit(least_common(i, least)) for i in range(1, SHORT + 1)])[n - 1]


def safe_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of names whose guarded partial ratio reaches ``least``: those under four letters are compared whole, only the others by windows."""
    a, b = left.filter("a <> ''").distinct(), right.filter("b <> ''").distinct()
    tiny = lambda c: F.length(c) < 4
    text = lambda d, c: d.filter(~tiny(c)).select(F.col(c).alias("name"), F.col(c).alias("text"))
    whole = name_pairs(a.filter(tiny("a")), b, least).union(name_pairs(a.filter(~tiny("a")), b.filter(tiny("b")), least))
    parts = met(text(a, "a"), text(b, "b"), part_from, least)
    scored = whole.union(parts).withColumn("score", safe_partial(F.col("a"), F.col("b"), whole=F.col("score"), part=F.col("score")))
    return scored.filter(F.col("score") >= least)


def safe_scores(pairs: DataFrame, least: float) -> DataFrame:
    """``pairs(a, b)`` whose guarded partial ratio reaches ``least``, with their ``score``; the same as :func:`safe_pairs` gives, for pairs that are known."""
    parts = pairs.withColumns({"_whole": token_ratio("a", "b"), "_part": partial_from_udf(least)("a", "b")})
    scored = parts.withColumn("score", safe_partial(F.col("a"), F.col("b"), whole=F.col("_whole"), part=F.col("_part")))
    return scored.filter(F.col("score") >= least).drop("_whole", "_part")


def alike(a: str, b: str, least: float) -> Column:
    """Whether lengths allow a token-sort ratio of ``least``."""
    return 200.0 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b)) - 200


def token_ratio(a: str, b: str) -> Column:
    return ratio_once_udf(sorted_tokens(F.col(a)), sorted_tokens(F.col(b)))


def single_files(releases: DataFrame, files: DataFrame, on: list[str], least: float) -> DataFrame:
    """(release_id, folder, key, score): files that share ``on`` with a release, whose title or name is like its album's. Only names that share ``on`` meet."""
    mine = releases.select("release_id", *on, F.explode("albums").alias("a"))
    theirs = files.select(*{*on, "folder", "key"}, F.explode("names").alias("b"))
    met = mine.join(name_pairs_within(mine, theirs, on, least), [*on, "a"]).join(theirs, [*on, "b"])
    return met.groupBy("release_id", "folder", "key").agg(F.max("score").alias("score"))


def files_taken(pool: DataFrame, release_tracks: DataFrame) -> DataFrame:
    """(release_id, folder, key, place, own): a release's tracks given to files of a folder one by one, or all of its files.

    ``pool(release_id, folder, score, key, n_title, number)`` holds the files of each folder that a release may take.
    """
    asked = release_tracks.select("release_id", "place", T.normalize_for_matching(F.col("title")).alias("asked"), F.col("number").cast("string").alias("_number"))
    pairs = pool.filter("n_title <> ''").join(asked, "release_id").filter(alike("asked", "n_title", LEAST_TRACK - NUMBER_BONUS))
    bonus = F.when(F.col("_number") == F.col("number"), NUMBER_BONUS).otherwise(0.0)
    scored = pairs.withColumn("own", F.least(F.lit(100.0), token_ratio("asked", "n_title") + bonus))
    placed = one_to_one(scored, ["release_id", "folder"], "place", "key", "place", "own", LEAST_TRACK).withColumn("_given", F.lit(True))
    empty = F.lit(None).cast(release_tracks.schema["place"].dataType)
    columns = ["release_id", "folder", "key", "place", "own", "_given"]
    rows = placed.select(columns).union(pool.withColumns({"place": empty, "own": F.col("score"), "_given": F.lit(False)}).select(columns))
    # A window over the files of one folder.
    any_ = F.max("_given").over(Window.partitionBy("release_id", "folder"))
    return rows.withColumn("_any", any_).filter(F.col("_given") == F.col("_any")).drop("_given", "_any")


def parts_of(edges: DataFrame) -> DataFrame:
    """(release_id, part): releases that share folders, directly or through others, share a part."""
    first = edges.groupBy("folder").agg(F.min("release_id").alias("b"))
    found = components(edges.join(first, "folder").select(F.col("release_id").alias("a"), "b")).toDF("release_id", "part")
    return edges.select("release_id").distinct().join(found, "release_id", "left").withColumn("part", F.coalesce("part", "release_id"))


FOLDER, FILE, TAKEN = 0, 1, 2
CLAIM_COLUMNS = ["part", "rank", "seq", "release_id", "kind", "folder", "key", "score", "odd", "alone"]


def claims_of(folders: DataFrame, files: DataFrame | None = None, taken: DataFrame | None = None) -> DataFrame:
    """What releases may take, a row each: folders in their order of preference, single files, and the files that come with a folder."""
    none = {"odd": F.lit(False), "alone": F.lit(False), "then": F.lit(0.0), "best": F.col("score")}
    columns = ["release_id", "kind", "folder", "key", "score", "odd", "alone", "best", "then", "first", "own", "place"]
    rows = folders.withColumns({"kind": F.lit(FOLDER), "key": F.lit(""), "own": F.col("score"), "place": F.lit(None).cast(taken.schema["place"].dataType if taken is not None else "int")}).select(columns)
    if files is not None:
        single = files.withColumns({"kind": F.lit(FILE), "first": F.col("key"), "own": F.col("score"), "place": F.lit(None).cast(taken.schema["place"].dataType), **none})
        whole = taken.withColumn("score", F.col("own")).withColumns({"kind": F.lit(TAKEN), "first": F.col("key"), **none})
        rows = rows.union(single.select(columns)).union(whole.select(columns))
    return rows


def in_order(claims: DataFrame, releases: DataFrame, ranked: bool = False) -> DataFrame:
    """Claims with their release's ``part``, ``rank`` and ``seq``; the best folder's score ranks releases if ``ranked``."""
    parts = parts_of(claims.filter(F.col("kind") != TAKEN).select("release_id", "folder"))
    best = F.max(F.when(F.col("kind") == FOLDER, F.col("score"))).over(Window.partitionBy("release_id"))
    rows = claims.withColumn("rank", best if ranked else F.lit(0.0))
    return rows.join(parts, "release_id").join(releases.select("release_id", "seq"), "release_id")


def decide(rows: DataFrame) -> DataFrame:
    """(release_id, folder, key, score): the folder or the single file that each release gets, in order of ``rank`` and ``seq``.

    Folder rows come in order of preference. The first free one wins unless it is ``odd`` (another volume); a release that is ``alone`` takes one
    free file of it if any fits; without a folder any free file does. What a release takes is taken for all later ones of its part.
    """
    ordered = rows.repartition("part").sortWithinPartitions("part", F.desc("rank"), "seq", "release_id", "kind", F.desc("best"), F.desc("then"), "first", "folder")
    schema = f"release_id {rows.schema['release_id'].dataType.simpleString()}, folder string, key string, score double"

    def walk(batches):
        stream = (r for pdf in batches for r in zip(*(pdf[c].tolist() for c in CLAIM_COLUMNS)))
        own, folders, files, out = None, set(), set(), []
        for (part, _, _, release), mine in groupby(stream, key=lambda r: r[:4]):
            if part != own:
                own, folders, files = part, set(), set()
            pick, got = None, None
            for _, _, _, _, kind, folder, key, score, odd, alone in mine:
                if kind == FOLDER and pick is None and folder not in folders:
                    pick = (folder, score, odd, alone)
                free = pick is None or pick[2]
                if kind == FILE and got is None and key not in files and (free or (pick[3] and folder == pick[0])):
                    got = (key, score)
                if kind == TAKEN and got is None and not free and folder == pick[0]:
                    files.add(key)
            if got:
                files.add(got[0])
                out.append((release, None, *got))
            elif pick and not pick[2]:
                folders.add(pick[0])
                out.append((release, pick[0], None, pick[1]))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["release_id", "folder", "key", "score"])
                out = []
        yield pd.DataFrame(out, columns=["release_id", "folder", "key", "score"])

    return ordered.select(CLAIM_COLUMNS).mapInPandas(walk, schema)


def given(decided: DataFrame, taken: DataFrame, phase: str) -> DataFrame:
    """The files of each decision: those that come with the folder, which is named, or the single one."""
    files = taken.select(F.col("release_id").alias("_release"), F.col("folder").alias("_folder"), F.col("key").alias("_file"), "place", "own")
    rows = decided.join(files, (F.col("release_id") == F.col("_release")) & (F.col("folder") == F.col("_folder")), "left")
    one = F.col("key").isNotNull()
    return rows.filter(one | F.col("_file").isNotNull()).select(
        "release_id", "score", F.coalesce("key", "_file").alias("key"), "place", F.when(one, F.col("score")).otherwise(F.col("own")).alias("own"), "folder", F.lit(phase).alias("phase"))


def other_volume(folder: Column) -> Column:
    return F.coalesce(T.volume(folder) != F.col("volume"), F.lit(False))


def comment_phase(releases: DataFrame, tracks: DataFrame, release_tracks: DataFrame, folders: DataFrame, keys: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Folders whose files' comments link to the release's sub-domain and whose last part is like the album; else such a single file.

    Like the phases after it: what releases get, and the files that come with what they get.
    """
    mine = releases.filter("sub is not null")
    files = tracks.filter("folder <> ''").withColumn("sub", F.explode("subs"))
    shown = files.groupBy("sub", "folder").agg(F.count("*").alias("n_files"), F.min("key").alias("first")).withColumn("b", T.normalize_for_matching(F.regexp_extract("folder", "([^/]*)$", 1)))
    pairs = partial_pairs(mine.select("sub", F.col("title").alias("a")), shown.select("sub", "b"), least, on=("sub",))
    scored = pairs.withColumn("score", partial_from_udf(least)("a", "b")).filter(F.col("score") >= least)
    met = mine.withColumnRenamed("title", "a").join(scored, ["sub", "a"]).join(shown, ["sub", "b"]).join(folders, "folder", "left_anti")
    found = stored(met.select(
        "release_id", "sub", "folder", "score", other_volume(F.col("folder")).alias("odd"), ((F.col("n_tracks") == 1) & (F.col("n_files") > 1)).alias("alone"),
        F.col("score").alias("best"), F.lit(0.0).alias("then"), "first",
    ))
    singles = single_files(mine, files, ["sub"], least).join(keys, "key", "left_anti")
    pool = found.select("release_id", "sub", "folder", "score").join(files.select("sub", "folder", "key", "n_title", "number"), ["sub", "folder"])
    claims = stored(claims_of(found, singles, files_taken(pool, release_tracks)))
    return decide(in_order(claims, mine)), claims.filter(F.col("kind") == TAKEN)


def folder_phase(releases: DataFrame, tracks: DataFrame, release_tracks: DataFrame, folders: DataFrame, keys: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Each release's best folder, whose path names artist and album; the best release gets it, others a single file of it."""
    files = tracks.filter("folder <> ''")
    shown = files.groupBy("folder").agg(F.count("*").alias("n_files")).join(folders, "folder", "left_anti")
    named = shown.select("folder", F.explode(filled(F.transform(F.split("folder", "/"), T.normalize_for_matching))).alias("b"))
    # A path must name both, so albums meet the parts of all paths, and artists only those of paths that name an album of theirs.
    titles = releases.select("release_id", F.explode("albums").alias("a"))
    albums = stored(titles.join(safe_pairs(titles.select("a"), named.select("b"), least), "a").join(named, "b").groupBy("release_id", "folder").agg(F.max("score").alias("_album")))
    sung = albums.join(releases.select("release_id", F.explode("artists").alias("a")), "release_id").join(named, "folder")
    alike_ = safe_scores(sung.select("a", "b").distinct(), least)
    both = sung.join(alike_, ["a", "b"]).groupBy("release_id", "folder", "_album").agg(F.max("score").alias("_artist"))
    met = both.join(releases, "release_id").join(shown, "folder").filter(~other_volume(F.col("folder")))
    bonus = F.when(F.col("n_tracks") > 0, COUNT_BONUS * F.least("n_tracks", "n_files") / F.greatest("n_tracks", "n_files")).otherwise(0.0)
    met = met.withColumn("score", F.col("_artist") * ARTIST + F.col("_album") * TITLE + bonus)
    best = met.groupBy("release_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "folder")).alias("m"))
    found = stored(best.select(
        "release_id", F.col("m.folder").alias("folder"), (-F.col("m.s")).alias("score"), F.lit(False).alias("odd"), F.lit(False).alias("alone"),
        (-F.col("m.s")).alias("best"), F.lit(0.0).alias("then"), F.lit("").alias("first"),
    ))
    pool = found.select("release_id", "folder", "score").join(files.select("folder", "key", "n_title", "number"), "folder")
    singles = single_files(releases.join(found.select("release_id", "folder"), "release_id"), files, ["folder"], least).join(keys, "key", "left_anti")
    claims = stored(claims_of(found, singles, files_taken(pool, release_tracks)))
    return decide(in_order(claims, releases, ranked=True)), claims.filter(F.col("kind") == TAKEN)


def weighed(mine: DataFrame, theirs: DataFrame, group: list[str], least: float, gate: float) -> DataFrame:
    """Best 0.4 artist + 0.6 title of ``mine(*group, artist, title)`` against each of ``theirs(n_artist, n_title)``, ``least`` or more.

    Of two parts whose weighted mean reaches a score one reaches it alone, so pairs come from alike artists and from alike titles.
    """
    theirs = theirs.filter("n_artist <> '' and n_title <> ''").distinct()
    artists = name_pairs(mine.select("artist"), theirs.select("n_artist"), least).toDF("artist", "n_artist", "_a")
    titles = name_pairs(mine.select("title"), theirs.select("n_title"), least).toDF("title", "n_title", "_t")
    rest_artist, rest_title = (least - 100 * TITLE) / ARTIST, (least - 100 * ARTIST) / TITLE
    by_artist = mine.join(artists, "artist").join(theirs, "n_artist").filter(alike("title", "n_title", max(gate, rest_title)))
    by_title = mine.join(titles, "title").join(theirs, "n_title").filter(alike("artist", "n_artist", max(gate, rest_artist)))
    columns = [*group, "artist", "title", "n_artist", "n_title"]
    met = by_artist.select(columns).union(by_title.select(columns)).distinct().withColumns({"_a": token_ratio("artist", "n_artist"), "_t": token_ratio("title", "n_title")})
    met = met.filter((F.col("_a") >= gate) & (F.col("_t") >= gate)).withColumn("score", F.col("_a") * ARTIST + F.col("_t") * TITLE)
    return met.groupBy(*group, "n_artist", "n_title").agg(F.max("score").alias("score")).filter(F.col("score") >= least)


def best_weighed(mine: DataFrame, theirs: DataFrame, group: list[str], least: float) -> DataFrame:
    """As :func:`weighed` without a gate, for those who keep each group's best only: all of the best are there, others may be missing.

    Nothing scores more than equal words in artist and title do, and nothing else as much; only groups without such a partner meet all names.
    """
    theirs = theirs.filter("n_artist <> '' and n_title <> ''").distinct()
    words = lambda d, artist, title: d.withColumns({"_artist": sorted_tokens(F.col(artist)), "_title": sorted_tokens(F.col(title))})
    same = words(mine, "artist", "title").join(words(theirs, "n_artist", "n_title"), ["_artist", "_title"])
    same = stored(same.select(*group, "n_artist", "n_title", F.lit(100.0).alias("score")).filter(F.col("score") >= least).distinct())
    rest = stored(reachable(mine.join(same.select(group).distinct(), group, "left_anti"), theirs, least))
    return same if rest.isEmpty() else same.union(weighed(rest, theirs, group, least, 0.0).select(same.columns))


def reachable(mine: DataFrame, theirs: DataFrame, least: float) -> DataFrame:
    """Rows of ``mine(artist, title)`` that by the lengths of names alone may reach ``least`` against some of ``theirs(n_artist, n_title)``.

    Only different pairs of lengths meet, and these are few.
    """
    size = lambda c: F.length(sorted_tokens(F.col(c)))
    most = lambda x, y: F.when(F.col(x) + F.col(y) > 0, 200.0 * F.least(x, y) / (F.col(x) + F.col(y))).otherwise(100.0)
    sized = mine.withColumns({"_m": size("artist"), "_n": size("title")})
    there = theirs.select(size("n_artist").alias("_x"), size("n_title").alias("_y")).distinct()
    good = sized.select("_m", "_n").distinct().join(there, ARTIST * most("_m", "_x") + TITLE * most("_n", "_y") >= least - 1e-6, "left_semi")
    return sized.join(good, ["_m", "_n"], "left_semi").drop("_m", "_n")


def global_phase(releases: DataFrame, tracks: DataFrame, folders: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The free folder that holds most files of like artist and album."""
    mine = releases.select("release_id", F.explode("artists").alias("artist"), "albums").select("release_id", "artist", F.explode("albums").alias("title"))
    local = tracks.select("key", "folder", "n_artist", F.col("n_album").alias("n_title"))
    names = weighed(mine, local.select("n_artist", "n_title"), ["release_id"], least, LEAST_PART)
    met = names.join(local, ["n_artist", "n_title"]).join(releases.select("release_id", "volume"), "release_id").join(folders, "folder", "left_anti").filter(~other_volume(F.col("folder")))
    rows = stored(met.select("release_id", "folder", "key", F.lit(None).cast("int").alias("place"), F.col("score").alias("own")))
    found = rows.groupBy("release_id", "folder").agg(F.avg("own").alias("score"), F.count("*").cast("double").alias("best"), F.round(F.sum("own"), 6).alias("then"), F.min("key").alias("first"))
    found = found.withColumns({"odd": F.lit(False), "alone": F.lit(False)})
    return decide(in_order(claims_of(found), releases)), rows


def track_phase(releases: DataFrame, tracks: DataFrame, release_tracks: DataFrame, least: float) -> DataFrame:
    """Releases without a folder: the best file anywhere for each of their tracks, whoever else has it."""
    asked = release_tracks.select("release_id", "place", T.normalize_for_matching(F.col("title")).alias("title")).filter("title <> ''")
    mine = releases.select("release_id", F.explode("artists").alias("artist")).join(asked, "release_id")
    names = best_weighed(mine, tracks.select("n_artist", "n_title"), ["release_id", "place"], least)
    met = names.join(tracks.groupBy("n_artist", "n_title").agg(F.min("key").alias("key")), ["n_artist", "n_title"])
    best = met.groupBy("release_id", "place").agg(F.min(F.struct((-F.col("score")).alias("s"), "key")).alias("m")).select("release_id", "place", F.col("m.key").alias("key"), (-F.col("m.s")).alias("own"))
    mean = best.groupBy("release_id").agg(F.avg("own").alias("score"))
    return best.join(mean, "release_id").select("release_id", "score", "key", "place", "own").withColumn("phase", F.lit("global"))


def match_releases(releases: DataFrame, release_tracks: DataFrame, tracks: DataFrame, domain: str, least: float = 60.0) -> DataFrame:
    """(release_id, phase, score, tier, key, file, place, own): the files of every matched release, a row for each.

    ``place`` is the release's track that a file was given to, ``own`` that file's own score. Each phase sees the releases that
    earlier ones left, and the folders and files they left free.
    """
    mine, local = stored(release_names(dealt(releases, "release_id"), release_tracks, domain)), stored(local_names(dealt(tracks, "key"), domain))
    least_here = max(least, LEAST_OF_PHASES)
    place = release_tracks.schema["place"].dataType
    columns = ["release_id", "phase", "score", "key", "place", "own", "folder"]
    met = url_matches(mine, local, "url", "release_id", "key").join(local.select("key", F.nullif(F.col("folder"), F.lit("")).alias("folder")), "key")
    out = met.withColumns({"phase": F.lit("metadata"), "place": F.lit(None).cast(place), "own": F.col("score")}).select(columns)

    def left() -> DataFrame:
        return mine.join(out.select("release_id").distinct(), "release_id", "left_anti")

    for phase in ("comment", "folder", "global"):
        folders = out.select("folder").filter("folder is not null").distinct()
        if phase == "global":
            decided, taken = global_phase(left(), local, folders, least_here)
        else:
            run = comment_phase if phase == "comment" else folder_phase
            decided, taken = run(left(), local, release_tracks, folders, out.select("key").distinct(), least_here)
        out = stored(out.union(given(decided, taken, phase).withColumn("place", F.col("place").cast(place)).select(columns)))
    out = stored(out.drop("folder").union(track_phase(left(), local, release_tracks, least_here).select(columns[:-1])))
    return out.join(local.select("key", "file"), "key").select("release_id", "phase", "score", T.tier(F.col("score")).alias("tier"), "key", "file", "place", "own")


def unmatched(releases: DataFrame, matches: DataFrame) -> DataFrame:
    """Releases without files, by band."""
    return releases.join(matches.select("release_id").distinct(), "release_id", "left_anti").orderBy("band", "seq")


def match_list(matches: DataFrame) -> DataFrame:
    """One row for each matched release with its files in order of their names, scores rounded to cents; best first."""
    file = F.struct("file", "key", "place", F.bround("own", 2).alias("score"))
    rows = matches.groupBy("release_id", "phase", F.bround("score", 2).alias("score"), "tier").agg(F.array_sort(F.collect_list(file)).alias("files"))
    return rows.orderBy(F.desc("score"), "release_id")


def match_stats(releases: DataFrame, matches: DataFrame) -> DataFrame:
    """Releases in all, by phase and by tier, and those without files."""
    each = matches.select("release_id", "phase", "tier").distinct()
    rows = releases.select("release_id").join(each, "release_id", "left")
    counts = [F.count_if(F.col("phase") == p).alias(f"matched_{p}") for p in ("metadata", "comment", "folder", "global")]
    tiers = [F.count_if(F.col("tier") == name).alias(f"tier_{name}") for _, name in T.TIERS]
    return rows.agg(F.count("*").alias("total"), *counts, *tiers, F.count_if(F.col("phase").isNull()).alias("unmatched"))


def files_to_tag(matches: DataFrame, releases: DataFrame) -> DataFrame:
    """(file, url) of files that don't carry their release's URL yet."""
    urls = releases.filter("url is not null").select("release_id", "url")
    return matches.filter("phase <> 'metadata' and file is not null").join(urls, "release_id").select("file", "url")


def repair_matches(broken: DataFrame, tracks: DataFrame, releases: DataFrame, release_tracks: DataFrame, formats: DataFrame, least: float = 60.0) -> DataFrame:
    """The release that replaces each of ``broken(file)``: by artist and album, else by artist and title of one of its tracks.

    ``tracks(file, artist, album, title, encoding)`` tells what the file was, ``formats(release_id, encoding)`` what a release is offered in. Without a
    match ``release_id`` and ``score`` are null, the tier and ``match_type`` none; equal scores go to the least id. ``warning`` lists what is offered
    where the encoding isn't.
    """
    clean = lambda c: T.normalize_for_matching(F.col(c))
    known = stored(broken.join(tracks, "file", "left"))
    albums = releases.select("release_id", clean("band").alias("n_artist"), clean("album").alias("n_title"))
    songs = release_tracks.join(releases.select("release_id", "band"), "release_id").select("release_id", clean("band").alias("n_artist"), clean("title").alias("n_title"))

    def best(files, name, theirs, kind):
        mine = files.select("file", clean("artist").alias("artist"), clean(name).alias("title")).filter("artist <> '' and title <> ''")
        names = best_weighed(mine, theirs.select("n_artist", "n_title"), ["file"], least)
        met = names.join(theirs, ["n_artist", "n_title"]).groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("s"), "release_id")).alias("m"))
        return met.select("file", F.col("m.release_id").alias("release_id"), (-F.col("m.s")).alias("score"), F.lit(kind).alias("match_type"))

    whole = stored(best(known, "album", albums, "release"))
    both = whole.union(best(known.join(whole, "file", "left_anti"), "title", songs, "track"))
    offered = formats.groupBy("release_id").agg(F.array_sort(F.collect_set("encoding")).alias("_have"))
    rows = known.join(both, "file", "left").join(offered, "release_id", "left")
    warning = F.when(~F.array_contains("_have", F.col("encoding")), F.concat(F.lit("Format '"), "encoding", F.lit("' not available; have: "), F.array_join("_have", ", ")))
    return rows.select("file", "release_id", "score", T.tier(F.coalesce("score", F.lit(0.0))).alias("tier"), F.coalesce("match_type", F.lit("none")).alias("match_type"), "encoding", warning.alias("warning"))

"""The matching phases on small cases, and candidates of partial matches against a comparison of all pairs."""

import random

import pytest

from tonearm.functions.similarity import best_window
from tonearm.operators import cascade

RELEASES = "release_id long, seq int, band string, album string, url string"
TRACKS = "key string, file string, title string, artist string, album string, comment string, url string, number string"
RELEASE_TRACKS = "release_id long, place int, title string, number int"


def shop(name):
    return f"https://{name}.shop.example/album/x"


def run(spark, releases, release_tracks, tracks, least=60.0):
    r = spark.createDataFrame([(*x,) for x in releases], RELEASES)
    t = spark.createDataFrame(release_tracks, RELEASE_TRACKS)
    fields = ("key", "file", "title", "artist", "album", "comment", "url", "number")
    local = spark.createDataFrame([tuple(x.get(f) for f in fields) for x in tracks], TRACKS)
    return r, cascade.match_releases(r, t, local, "shop.example", least)


def by_release(matches):
    out = {}
    for m in matches.collect():
        out.setdefault(m["release_id"], (m["phase"], {}))[1][m["key"]] = (m["place"], m["own"], m["score"])
    return out


def linked(prefix, folder, titles, site):
    return [{"key": f"{prefix}{i}", "file": f"{folder}/0{i}.flac", "title": t, "comment": f"Visit https://{site}.shop.example"} for i, t in enumerate(titles, 1)]


def test_phases_and_claims(spark):
    releases = [
        (1, 1, "Lunaruna", "MoonChild", shop("lunaruna")),  # one track: one file of a folder that stays free
        (2, 2, "Tester", "Full Album", shop("tester")),  # tracks are given to files
        (3, 3, "Tester", "Full Album", shop("tester")),  # its folder is taken, no file fits
        (4, 4, "Marsh Music", "The Marshes, Volume II", shop("marsh")),  # another volume
        (5, 5, "Disc", "Tentacle", shop("kine")),  # the label's other release
        (6, 6, "Solo", "Only Song", shop("solo")),  # one track, alone in its folder
        (7, 7, "Hand Tagged", "Whatever", shop("tagged")),  # URL of a file
        (8, 8, "Folder Band", "Folder Songs", None),  # by its path, no tracks known
        (9, 9, "Folder Band", "Folder Songs (Deluxe Edition)", None),  # the same path, taken; a single file fits
        (10, 10, "Dreamwalker", "Sensory Experience", None),  # by tags in an odd folder
        (11, 11, "Gummy", "Inside Out", None),  # the artist alone is not enough
        (12, 12, "STEREO", "DEEP STRUCTURES (EP)", None),
        (13, 13, "Lone Star", "No Such Album", None),  # by its track
        (14, 14, None, None, None),
    ]
    release_tracks = [
        (1, 1, "MoonChild", 1), (2, 1, "Alpha Song", 1), (2, 2, "Beta Song", 2), (2, 3, "Gamma Song", 3), (4, 1, "Track A", 1), (4, 2, "Track B", 2),
        (5, 1, "Tentacle", 1), (6, 1, "Only Song", 1), (11, 1, "Looking In", 1), (13, 1, "Shining Quartz Meadow", 1), (14, 1, None, None),
    ]
    tracks = (
        linked("m", "Goa/Moonchild", ["MoonChild", "Other Tune", "Third Piece"], "lunaruna")
        + linked("f", "Tester/Tester - Full Album", ["Gamma Song", "Alpha Song", "Beta Song"], "tester")
        + linked("v", "dub/[Marsh Music]/The Marshes Volume I", ["Track 1", "Track 2"], "marsh")
        + linked("k", "zen/[Kine Recordings]/Somnium - Rocket Science", ["Track 1", "Track 2"], "kine")
        + linked("s", "Solo/Only Song", ["Only Song"], "solo")
        + [{"key": "u1", "file": "x/u1.flac", "url": shop("tagged")}, {"key": "u2", "file": None, "url": shop("tagged")}]
        + [{"key": "p1", "file": "techno/Folder Band/Folder Songs/Folder Songs.flac"}, {"key": "p2", "file": "techno/Folder Band/Folder Songs/zzz.flac"}]
        + [{"key": f"d{i}", "file": f"misc/q{i % 3 // 2}/{i}.flac", "artist": "Dreamwalker", "album": "Sensory Experience", "title": f"T{i}"} for i in range(4)]
        + [{"key": f"g{i}", "file": f"zen/aaa/{i}.flac", "artist": "Gummy", "album": "Nuts and Bolts", "title": f"Wrench {i}"} for i in range(3)]
        + [{"key": "e1", "file": "bbb/1.flac", "artist": "Terahertz", "album": "Digital Structures EP", "title": "x"}]
        + [{"key": "l1", "file": "ccc/1.flac", "artist": "Lone Star", "title": "Shining Quartz Meadow"}, {"key": "z", "file": None}]
    )
    r, matches = run(spark, releases, release_tracks, tracks)
    got = by_release(matches)
    assert got[1] == ("comment", {"m1": (None, 100.0, 100.0)})
    assert got[2] == ("comment", {"f2": (1, 100.0, 100.0), "f3": (2, 100.0, 100.0), "f1": (3, 100.0, 100.0)})
    assert set(got[6][1]) == {"s1"} and got[6][0] == "comment"
    assert got[7] == ("metadata", {"u1": (None, 100.0, 100.0), "u2": (None, 100.0, 100.0)})
    assert got[8] == ("folder", {"p1": (None, 100.0, 100.0), "p2": (None, 100.0, 100.0)})
    assert got[10] == ("global", {k: (None, 100.0, 100.0) for k in ("d0", "d1", "d3")})
    assert got[13] == ("global", {"l1": (1, 100.0, 100.0)})
    assert set(got) == {1, 2, 6, 7, 8, 10, 13}
    assert [x["release_id"] for x in cascade.unmatched(r, matches).collect()] == [14, 5, 9, 11, 4, 12, 3]
    stats = cascade.match_stats(r, matches).first().asDict()
    assert stats == {"total": 14, "matched_metadata": 1, "matched_comment": 3, "matched_folder": 1, "matched_global": 2, "tier_exact": 7, "tier_high": 0, "tier_low": 0, "unmatched": 7}
    listed = {x["release_id"]: [f["file"] for f in x["files"]] for x in cascade.match_list(matches).collect()}
    assert listed[2] == [f"Tester/Tester - Full Album/0{i}.flac" for i in (1, 2, 3)]
    assert {(x["file"], x["url"]) for x in cascade.files_to_tag(matches, r).collect()} >= {("Solo/Only Song/01.flac", shop("solo"))}


def test_folder_goes_to_the_best_and_others_try_single_files(spark):
    releases = [(3, 1, "Band", "Blue Knight", None), (2, 2, "Band", "Blue Night", None)]
    tracks = [{"key": "a", "file": "Band/Blue Night/blue knight.mp3"}, {"key": "b", "file": "Band/Blue Night/zzzz.mp3", "title": "Quartz"}, {"key": "c", "file": "Band/Blue Night/other.mp3"}]
    got = by_release(run(spark, releases, [(2, 1, "Quartz", 1)], tracks)[1])
    assert got[2][0] == "folder" and {k: v[:2] for k, v in got[2][1].items()} == {"b": (1, 100.0)}
    assert abs(got[2][1]["b"][2] - (100 + 5 / 3)) < 1e-9
    assert set(got) == {2, 3} and set(got[3][1]) == {"a"}


def test_single_files_are_not_given_twice(spark):
    releases = [(i, i, "Tester", "Night Train", shop("tester")) for i in (1, 2, 3)]
    tracks = linked("n", "inbox", ["Night Train", "Night Trains", "Other"], "tester")
    got = by_release(run(spark, releases, [], tracks)[1])
    assert {i: set(v[1]) for i, v in got.items()} == {1: {"n1"}, 2: {"n2"}}


def test_number_bonus(spark):
    releases = [(1, 1, "Tester", "Night Train", shop("tester"))]
    tracks = linked("n", "Night Train", ["Song about rain", "Song about rail"], "tester")
    tracks[1]["number"] = "1"
    got = by_release(run(spark, releases, [(1, 1, "Song about raim", 1), (1, 2, "Song about rain", 2)], tracks)[1])
    assert [got[1][1][k][0] for k in ("n1", "n2")] == [2, 1]


def test_empty_tables(spark):
    assert run(spark, [], [], [])[1].count() == 0
    assert run(spark, [(1, 1, "a", "b", None)], [], [])[1].count() == 0


@pytest.mark.parametrize("least", [75.0, 60.0, 90.0])
def test_partial_candidates_lose_no_pair(spark, least):
    r = random.Random(8)
    words = ["lantern", "amber", "quay", "b", "aa", "violet hour", "banana", "stone age"]
    names = set()
    while len(names) < 70:
        name = list(" ".join(r.sample(words, r.randint(1, 3))))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(name))
            name[at : at + r.randint(0, 1)] = r.choice(["", "a", "z", " "])
        names.add("".join(name).strip() or "x")
    names = sorted(names)
    df = spark.createDataFrame([(x,) for x in names], "a string")
    pairs = cascade.partial_pairs(df, df.toDF("b"), least)
    got = {(x["a"], x["b"]) for x in pairs.collect()}
    assert {(x, y) for x in names for y in names if best_window(x, y) >= least} <= got

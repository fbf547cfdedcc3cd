"""Functions on media values, release posts and names, case by case."""

import pytest
from pyspark.sql import functions as F

from tonearm.functions import media
from tonearm.functions import text as T
from tonearm.functions.similarity import best_window, common_length, ratio
from tonearm.operators import changelog, cue, matching, releases
from tonearm.plans import search
from tonearm.plans.template import TemplateError, render
from tonearm.sources import reports, tables


def value(spark, column, **cells):
    row = spark.createDataFrame([tuple(cells.values()) or (0,)], ", ".join(f"{k} string" for k in cells) or "x int")
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [("XianZai &#8211; Irrational Conjunction", ("XianZai", "Irrational Conjunction")), ("V/A Kreepsy Origins", ("Various Artists", "Kreepsy Origins")), ("Voidscream – Jund (Quiet Bay Records)", ("Voidscream", "Jund")), ("A - B – C", ("A - B", "C")), ("Just a name", ("Various Artists", "Just a name")), ("Tom &amp; Co - X", ("Tom & Co", "X"))])
def test_titles(spark, text, want):
    assert tuple(value(spark, releases.parse_title(F.col("t")), t=text)) == want


def test_posts(spark):
    html = '<p>1.- First – Someone [174 bpms]<br>2. Second. (180 bpm)</p><img srcset="a.jpg 300w, b.jpg 900w, c.jpg 900w" src="d.jpg"><p>Mastered by X</p><p>Released by Dark Records &amp; others</p><a href="https://x.dom/a%20wav.ZIP">w</a><a href="https://x.dom/one.zip">1</a><a href="https://x.dom/two.rar">2</a><a href="https://x.dom/b_mp3.zip">m</a>'
    posts = spark.createDataFrame([(html, "A – B", "m.jpg"), ("", "", None)], "html string, title string, media string")
    r, none = releases.release_content(posts, "html", "title", "x.dom", "media").collect()
    assert [tuple(t) for t in r["tracklist"]] == [(1, "First", "Someone", "174"), (2, "Second", None, "180")]
    assert r["downloads"] == {"wav": "https://x.dom/a%20wav.ZIP", "mp3": "https://x.dom/b_mp3.zip", "download": "https://x.dom/one.zip"}
    assert (r["cover_art_url"], r["credits"], r["label"]) == ("b.jpg", "Mastered by X; Released by Dark Records & others", "Dark Records")
    assert (none["downloads"], none["tracklist"], none["credits"], none["label"], none["cover_art_url"]) == ({}, [], None, None, None)


def test_page_data(spark):
    html = '<div id="pagedata" class="x" data-blob="{&quot;a&quot;: 5}"></div>'
    assert value(spark, releases.page_data(F.col("h"), "a int"), h=html)["a"] == 5


def test_values(spark):
    cases = [
        (media.rating_text(F.lit(0)), None), (media.rating_text(F.lit(4)), "4"), (media.bpm_text(F.lit(-1.0)), None), (media.bpm_text(F.lit(128)), "128.00"), (media.bpm_whole(F.lit(144.5)), "144"),
        (media.track_file(F.lit(3), F.lit("A/B: c. ")), "03 - A_B_ c.flac"), (media.track_file(F.lit(3), F.lit("")), "03 - Track 3.flac"), (media.seconds_text(F.lit(22050)), "0.500000"),
        (media.url_decoded(F.lit("a%20b+c")), "a b+c"), (media.archive_format(F.lit("X.RAR")), "rar"), (media.cover_side(F.lit("img.jpg"), F.lit(1)), "front"), (media.cover_side(F.lit("Back.jpg"), F.lit(2)), "back"),
        (media.lookup(F.lit("ogg"), media.FORMATS), "vorbis"), (media.lookup(F.lit("?"), media.RELEASE_TYPES, "?"), "?"), (media.first_filled(F.lit(""), F.lit("b")), "b"), (media.below(F.lit("/m/a/b"), "/m"), "a/b"), (media.below(F.lit("/mm/a"), "/m"), None),
        (media.cue_problem(F.lit('FILE "a" WAVE\n TRACK 01 AUDIO')), False), (media.cue_problem(F.lit("REM")), True), (media.before_space(F.lit("8A Am")), "8A"),
        (T.volume(F.lit("Album Vol. III")), 3), (T.volume(F.lit("Part 12")), 12), (T.volume(F.lit("no number")), None), (T.volume(F.lit("Vol. C")), None), (T.color_hex(F.lit(255)), "#0000FF"), (T.frames_to_samples(F.lit("03:45:00")), 9922500), (T.frames_to_samples(F.lit("07:22:50")), 19521600), (T.frames_to_samples(F.lit("1:2")), 0),
        (T.decoded(F.lit("!Qm9hcmRzIG9mIENhbmFkYQ==")), "Boards of Canada"), (T.tier(F.lit(80.0)), "high"), (T.extension(F.lit("a/b.c.mp3")), ".mp3"), (T.stem(F.lit("a/b.c.mp3")), "b.c"), (T.path(F.lit("a//b?c/..")), "a/b-c/Unknown"),
        (matching.band_candidates(F.lit("A - B - C")), ["B", "C", "A", "A - B - C"]), (matching.band_candidates(F.lit("One")), ["One"]),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(row) == [want for _, want in cases]


def test_similarity(spark):
    assert common_length("kitten", "sitting") == 4 and ratio("", "") == 100.0 and best_window("abc", "xxabcxx") == 100.0
    got = spark.createDataFrame([("deep blue", "deep blue sea at night and more words"), ("", "x"), ("ab", "ba"), ("same", "same")], "a string, b string").select(matching.safe_partial(F.col("a"), F.col("b")).alias("v"))
    assert [round(r["v"], 3) for r in got.collect()] == [85.0, 0.0, 50.0, 100.0]


@pytest.mark.parametrize("line,want", [
    (["1769651283s artist +AphexTwin"], {("artist", "AphexTwin")}), (["1s artist +!Qm9hcmRzIG9mIENhbmFkYQ== genre +IDM"], {("artist", "Boards of Canada"), ("genre", "IDM")}),
    (["1s genre +Ambient +IDM", "2s genre -IDM"], {("genre", "Ambient")}), (["1s artist +Old", "2s artist -Old +New"], {("artist", "New")}), (["1507541553.566s artist +Test"], {("artist", "Test")}), (["1s genre -None"], set()), (["1s artist genre +IDM"], {("genre", "IDM")}), ([" "], set()),
])
def test_logs(spark, line, want):
    lines = spark.createDataFrame([("k", i, x) for i, x in enumerate(line)], "key string, line_no int, line string")
    assert {(r["field"], r["value"]) for r in changelog.current_values(changelog.operations(lines)).collect()} == want


TRACKS = [
    ("k1", "darkpsy/Artist1 - Dark Track.mp3", "Dark Artist", "Dark Track", "Dark Album", "Darkpsy", 148.0, 5, "Am", "2023"),
    ("k2", "ambient/Artist2 - Calm Song.flac", "Ambient Artist", "Calm Song", "Calm Album", "Ambient", 80.0, 3, "C", "2020"),
    ("k3", "techno/DJ Test - Banger.mp3", "DJ Test", "Banger", "Club Hits", "Techno", 140.0, 4, "Dm", "2024"),
    ("k4", "house/House DJ - Groovy.mp3", "House DJ", "Groovy", "House Collection", "House", 125.0, 4, "F", "2022"),
    ("k5", "minimal/Minimal - Empty.mp3", None, "Empty", None, None, None, None, None, None),
]


@pytest.mark.parametrize("text,want", [
    ("artist:dark", "1"), ('artist:="DJ Test"', "3"), ('artist:="DJ"', ""), ("bpm:>140", "1"), ("bpm:>=140", "13"), ("bpm:<100", "2"), ("rating:<=3", "2"), ("bpm:120-145", "34"), ("file:darkpsy", "1"), ("key:Am", "1"), ("year:>2022", "13"), ("-genre:Ambient", "134"),
    ('genre:""', "5"), ("genre:House | genre:Techno", "34"), ("crate:Festival", "13"), ("crate:=Club", "34"), ("-crate:Festival", "245"), ("Dark bpm:>140", "1"), ("", "12345"), ("rating:>=4 genre:Techno | rating:>=4 genre:House", "34"), ("Dark", "1"), ("Calm Song", "2"), ("-Dark", "2345"),
])
def test_searches(spark, text, want):
    df = spark.createDataFrame(TRACKS, "key string, file string, artist string, title string, album string, genre string, bpm double, rating long, key_musical string, year string")
    crates = spark.createDataFrame([("k1", "Festival"), ("k1", "DarkPsy"), ("k3", "Festival"), ("k3", "Club"), ("k4", "Club")], "key string, crate string")
    fields = {c: c for c in df.columns if c not in ("key", "key_musical")} | {"key": "key_musical"}
    cat = search.Catalog("key", fields, ["key", "artist", "title", "album", "genre", "file"], {"crate": (crates, "key", "crate")})
    assert {r["key"] for r in search.search(df, cat, text).collect()} == {f"k{x}" for x in want}


def test_errors(spark):
    with pytest.raises(search.SearchError):
        search.parse('artist:"open')
    with pytest.raises(TemplateError):
        render(spark.range(1), "{{ unclosed")


def test_cue(spark):
    text = 'REM GENRE "Dark"\nREM DATE 2020\nPERFORMER "Band"\nTITLE "Album"\nFILE "one.flac" WAVE\n  TRACK 01 AUDIO\n    TITLE "First"\n    INDEX 01 00:00:00\n  TRACK 02 AUDIO\n    TITLE "Second"\n    PERFORMER "Guest"\n    ISRC X1\n    INDEX 00 03:44:00\n    INDEX 01 03:45:00\nFILE "two.flac" WAVE\n  TRACK 03 AUDIO\n    TITLE "Third"\n    INDEX 01 00:00:00\n    FLAGS DCP'
    lines = spark.createDataFrame([("s", i, x) for i, x in enumerate(text.split("\n"))], "key string, line_no int, line string")
    got = sorted(cue.cue_tracks(lines).collect(), key=lambda r: r["track_num"])
    assert [(r["file"], r["title"], r["performer"], r["album"], r["genre"], r["date"], r["isrc"], r["start_samples"], r["end_samples"]) for r in got] == [
        ("one.flac", "First", "Band", "Album", "Dark", "2020", None, 0, 9922500), ("one.flac", "Second", "Guest", "Album", "Dark", "2020", "X1", 9922500, None), ("two.flac", "Third", "Band", "Album", "Dark", "2020", None, 0, None)]


def test_reports_and_logs(spark, tmp_path):
    df = spark.createDataFrame([("a", "ok"), ("b", "error")], "file string, status string")
    reports.write_report(df.groupBy().count(), df, str(tmp_path / "r"))
    assert [r["file"] for r in reports.read_results(spark, str(tmp_path / "r"), "file string, status string", ("error",)).collect()] == ["b"]
    for t in (2, 1, 3):
        reports.append_metrics(spark.createDataFrame([(t,)], "timestamp long"), str(tmp_path / "m"))
    assert [r[0] for r in reports.last_metrics(spark, str(tmp_path / "m"), "timestamp long", last=2).collect()] == [2, 3]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "K--1.mp3.log.met").write_text("1s artist +A\n2s artist -A +B\n")
    rows = tables.attribute_logs(spark, str(tmp_path / "logs"))
    assert {(r["key"], r["value"]) for r in changelog.current_values(changelog.operations(rows)).collect()} == {("K--1.mp3", "B")}

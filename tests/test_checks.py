"""Checker rules, arguments, shared folders, targets, encodings, components and string kernels on small cases."""

import os.path
import random

import pytest
from pyspark.sql import functions as F

from tonearm.functions import similarity
from tonearm.operators import arguments, checks, matching
from tonearm.operators.components import components
from tonearm.plans import template
from tonearm.sources import sheets

RUNS = [
    # tool, exit code, stdout, stderr, success, output
    ("flac", 0, "", "", True, ""), ("flac", 1, "", "ERROR", False, "ERROR"), ("flac", None, "", None, False, ""),
    ("mp3val", 1, "Analyzing\r\nDone", "x", True, "Analyzing\r\nDone"), ("mp3val", 0, "Done\nWARNING: junk", "", False, "Done\nWARNING: junk"), ("mp3val", 0, "a\x0bPROBLEM", "", False, "a\x0bPROBLEM"), ("mp3val", 0, " WARNING", "", True, " WARNING"), ("mp3val", 0, None, "", True, ""),
    ("ffmpeg", 0, "x", "", True, ""), ("ffmpeg", 0, "", " \n\t", True, " \n\t"), ("ffmpeg", 0, "", "bad frame", False, "bad frame"), ("ffmpeg", 1, "", "", False, ""),
    ("shntool", 0, "length size cdr wave problems\n1:00 10 --- -- -----", "", True, "length size cdr wave problems\n1:00 10 --- -- -----"),
    ("shntool", 0, "1:00 10 --- -- ---t-", "", False, "1:00 10 --- -- ---t-"), ("shntool", 0, "1:00 10 --- -- -", "", True, "1:00 10 --- -- -"), ("shntool", 0, "a b c d", "", True, "a b c d"), ("shntool", 2, "", "", False, ""), ("shntool", 0, " --- \n\n", "", True, " --- \n\n"),
    ("sox", 0, "", "w", True, "w"), ("sox", 2, "", "", False, ""), ("ogginfo", 0, "o", "e", True, "oe"), ("ogginfo", 1, "o", "e", False, "oe"), ("other", 0, "", "", None, None), (None, 0, "", "", None, None),
]


def test_tool_results(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(RUNS)], "id int, tool string, exit_code int, stdout string, stderr string, want boolean, shown string")
    for r in checks.tool_results(df).collect():
        assert (r["success"], r["output"]) == (r["want"], r["shown"]), RUNS[r["id"]]


def test_checker_groups(spark):
    cases = [("a/x.FLAC", None, "flac"), ("x.oga", "text/plain", "ogg"), ("x.bin", "audio/mp3", "mp3"), ("x.bin", "audio/ogg; codecs=opus", "opus"), ("x", "audio/new", "audio"), ("x.txt", "text/plain", None), (None, None, None), (".flac", None, None), ("x.cue", None, "cue"), ("x.bin", "Audio/mp3", None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, file string, mime string, want string")
    group = checks.checker_group(F.col("file"), F.col("mime"))
    for r in df.select("id", "want", group.alias("got"), checks.tools_of(group).alias("tools")).collect():
        assert r["got"] == r["want"], cases[r["id"]]
        assert tuple(r["tools"]) == (checks.ANY_TOOLS if r["got"] == "audio" else checks.GROUPS[r["got"]].tools if r["got"] else ())


def test_multichannel(spark):
    cases = [("2", "WAVEFORMATEXTENSIBLE_CHANNEL_MASK=0x3\n", "0x3"), ("2\n", "0x3", "0x3"), ("6", "X=1", None), ("two", "X=1", None), ("2", " \n", None), (None, "X=1", None), ("2", None, None), ("2", "A=b=c", "b=c")]
    df = spark.createDataFrame(cases, "c string, t string, want string")
    for r in df.select("want", checks.multichannel_warning(F.col("c"), F.col("t")).alias("w")).collect():
        assert (r["w"] is None) == (r["want"] is None) and (r["w"] is None or f"MASK={r['want']}." in r["w"])


FILES = ["lib/a/1.mp3", "lib/a/2.mp3", "lib/ab/3.mp3", "lib/b c/4.mp3", "top.mp3", "lib/gone.mp3"]


@pytest.mark.parametrize("args, want", [
    (["a"], {"lib/a/1.mp3": 0, "lib/a/2.mp3": 0}),
    (["lib/ab", "top.mp3"], {"lib/ab/3.mp3": 0, "top.mp3": 1}),
    (["/music/lib/a/2.mp3", "a"], {"lib/a/2.mp3": 0, "lib/a/1.mp3": 1}),
    (["../top.mp3", "b c/"], {"top.mp3": 0, "lib/b c/4.mp3": 1}),
    (["nothing", "a"], {"lib/a/1.mp3": 1, "lib/a/2.mp3": 1}),
    (["four", "/elsewhere/a", "ab"], {"lib/ab/3.mp3": 2}),
    (["four"], {"lib/b c/4.mp3": 1}), ([".."], {f: 0 for f in FILES[:5]}), ([], {f: 0 for f in FILES[:5]}), (["gone.mp3"], {}),
])
def test_arguments(spark, args, want):
    inventory = spark.createDataFrame([(f, f != "lib/gone.mp3") for f in FILES] + [(None, True)], "file string, present boolean")
    found = {"four": ["lib/b c/4.mp3", "lib/gone.mp3", "/outside.mp3", None]}
    asked = []

    def find(query):
        asked.append(query)
        return spark.createDataFrame([(f,) for f in found.get(query, [])], "file string")

    got = {r["file"]: r["rank"] for r in arguments.resolve(inventory, args, find, "/music/lib", "/music").collect()}
    assert got == want
    assert all("gone" not in f for f in got)
    if args == ["gone.mp3"]:
        assert [r["file"] for r in arguments.resolve(inventory, args, find, "/music/lib", "/music", present_only=False).collect()] == ["lib/gone.mp3"]


def plain_strip(paths):
    full = [p for p in paths if p]
    prefix = os.path.dirname(os.path.commonpath(full)) if len(full) > 1 else ""
    return [p[len(prefix) + 1 :] if p and prefix else p or "" for p in paths]


@pytest.mark.parametrize("paths", [["a/b/c/x", "a/b/c/y", "", None], ["a/b/c/x"], ["a/b", "a b/c", "a"], ["x/y", "z"], ["a/b/c", "a/b/c"], ["a/b/c", "a/b", "a/b/d"], [], [""], ["m/n o/p", "m/n/p", "m/n/q"]])
def test_common_folder(spark, paths):
    df = spark.createDataFrame(list(enumerate(paths)), "id int, path string")
    assert [r["path"] for r in arguments.strip_common_folder(df, "path").orderBy("id").collect()] == plain_strip(paths)


def test_relative_targets(spark):
    rng = random.Random(2)
    path = lambda: "/".join(rng.choice(["a", "b", "c", ".", "", "..", "d e"]) for _ in range(rng.randint(1, 6))) + "/f"
    cases = [(f"r/s/{path()}", f"r/{path()}") for _ in range(80)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, t string, l string")
    for r in df.select("id", arguments.relative_target(F.col("t"), F.col("l")).alias("got")).collect():
        t, link = cases[r["id"]]
        there, here = os.path.normpath(t).split("/"), os.path.normpath(os.path.dirname(link)).split("/")
        beyond = here[len(os.path.commonprefix([there, here])) :]
        assert r["got"] == (None if ".." in beyond else os.path.relpath("x/y/z/u/v/w/" + t, "x/y/z/u/v/w/" + os.path.dirname(link))), cases[r["id"]]


def test_bytes_fall_to_the_next_encoding(spark):
    cases = [b"plain", "Café “x”".encode(), "Café “x”".encode("cp1252"), b"Caf\xe9 \x81\x93", b"", b"\xff\xfe", bytes(range(1, 128)), bytes(range(0x82, 0x8D))]

    def plain(data):
        for name in ("utf-8", "cp1252", "latin-1"):
            try:
                return data.decode(name)
            except UnicodeDecodeError:
                continue

    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)] + [(99, None)], "id int, c binary")
    got = {r["id"]: (r["t"], r["u"]) for r in df.select("id", sheets.decoded_bytes(F.col("c")).alias("t"), sheets.decoded_bytes(F.col("c"), "utf-8").alias("u")).collect()}
    for i, c in enumerate(cases):
        try:
            strict = c.decode()
        except UnicodeDecodeError:
            strict = None
        assert got[i] == (plain(c), strict)
    assert got[99] == (None, None)


def test_sheet_lines_and_pairs(spark):
    rows = spark.createDataFrame([("d/x.cue", bytearray(b'FILE "a"\r\nTRACK 01')), ("y.cue", bytearray(b"\xe9"))], "path string, content binary")
    assert [tuple(r) for r in sheets.sheet_lines(rows, "utf-8").orderBy("key", "line_no").collect()] == [("d/x.cue", 0, 'FILE "a"'), ("d/x.cue", 1, "TRACK 01"), ("y.cue", None, None)]
    files = spark.createDataFrame([("d/x.cue", "b.mp3", 1), ("d/x.cue", "a.FLAC", 2), ("d/x.cue", "c.wav", 3), ("y.cue", "q.wav", 1), ("z.cue", "", 1)], "key string, file string, place int")
    names = spark.createDataFrame([("d/b.mp3",), ("d/a.FLAC",), ("d/c.wav",), ("d/q.wav",)], "path string")
    assert {r["key"]: (r["audio"], r["missing"], r["unsupported"]) for r in sheets.cue_pairs(files, names).collect()} == {"d/x.cue": ("d/a.FLAC", [], ["b.mp3"]), "y.cue": (None, ["q.wav"], [])}


def test_strict_paths(spark):
    df = spark.createDataFrame([("Rock", "L.", "A:B", " Al/bum ", None), (None, None, "", "", "1999")], "genre string, label string, artist string, album string, year string")
    made = lambda t: [r[0] for r in df.select(template.strict_path(df, t)[0]).collect()]
    assert made("{{genre}}/{{label}}/{{artist}} - {{album}} ({{year}})") == ["Rock/L/AB -  Al/bum  ()", "-  (1999)"]
    assert made("{{ nosuch }}/x") == made("{% if x %}") == ["AB -  Al/bum", "Unknown"]
    assert made("..//{{label}}/..") == ["L", "Unknown"] and not template.strict_path(df, "{{ a b }}")[1]


def test_components_of_random_links(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(300, 420)] + [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(7, 7), (None, 3), (500, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    want = {x: find(x) for a, b in links if None not in (a, b) and a != b for x in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(want) and {r["node"]: r["root"] for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_string_kernels():
    rng = random.Random(1)
    text = lambda sizes: "".join(rng.choice("abcdé漢\U0001f600") for _ in range(rng.choice(sizes)))
    pairs = [(text((0, 1, 3, 8, 20, 63, 64, 65, 90)), text((0, 1, 2, 5, 30, 64, 70))) for _ in range(300)]

    def windows(a, b):
        short, long_ = sorted((a, b), key=len)
        return max(similarity.ratio(short, long_[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long_))) if short else 100.0 * (not long_)

    left, right = map(list, zip(*pairs))
    assert similarity.common_lengths(left, right).tolist() == [similarity.common_length(*p) for p in pairs]
    assert similarity.ratios(left, right).tolist() == [similarity.ratio(*p) for p in pairs]
    assert [similarity.best_window(*p) for p in pairs] == [windows(*p) for p in pairs]
    assert similarity.common_lengths([], []).tolist() == []


def test_letter_pairs_number_repeats(spark):
    df = spark.createDataFrame([("banana",), ("a",), ("",), ("aaaa",)], "s string")
    got = [r[0] for r in df.select(matching.letter_pairs(F.col("s"))).collect()]
    assert got == [["an1", "an2", "ba1", "na1", "na2"], [], [], ["aa1", "aa2", "aa3"]]

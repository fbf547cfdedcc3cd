"""Operators with one right answer, against brute force over whole tables."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
import xxhash

from tests.conftest import SF
from tests.llm.fixtures import by_id, docs_df
from tests.oracle import differences, tables
from tonearm.llm import brown, chat, decontaminate, fingerprints, mixing, simhash, substrings
from tonearm.llm.common import read

SPACE = re.compile(rb"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r["doc_id"], r["text"] or "") for r in read(spark, SF, "documents").select("doc_id", "text").collect())


def words(text):
    return [w for w in SPACE.split(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())) if w]


def test_fingerprints(spark, docs):
    rows = {r["doc_id"]: r for r in fingerprints.op3_fingerprints(spark, SF).collect()}
    assert len(rows) == len(docs)
    down = docs[::-1]
    for (i, text), (j, after) in zip(down, down[1:] + down[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert rows[i]["n_chars"] == len(text) and rows[i]["next_id"] == j
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    of = defaultdict(set)
    for i, text in docs:
        of[text].add(rows[i]["fingerprint"])
    assert all(len(x) == 1 for x in of.values())
    near = np.array([(r["near_edited"], r["near_next"]) for r in rows.values() if r["n_chars"] > 200])
    assert near[:, 0].mean() > near[:, 1].mean() + 0.1


def spark_hash(*values):
    """Spark's xxhash64 of strings and longs, as a signed long."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return seed - 2**64 if seed >> 63 else seed


def brute_fingerprints(docs):
    """(fingerprint, edited, near_edited, near_next) of each document, from the definitions."""
    fp = fingerprints
    terms = lambda t: {spark_hash(x) & -4 for x in re.split(r"[\s!-/:-@\[-`{-~]+", t.lower(), flags=re.ASCII) if x}
    df = Counter(h for _, t in docs for h in terms(t))
    low = max(2, round(fp.BAND[0] * len(docs)))
    high = max(low, round(fp.BAND[1] * len(docs)))
    code = lambda h: (spark_hash(h, fp.SEED) % fp.SUBSETS) << 56 | (h % 2**64) >> 8

    def prints(codes):
        out = {}
        for c in sorted(codes):
            out[c >> 56] = spark_hash(out[c >> 56], c) if c >> 56 in out else spark_hash(c)
        return {k << 56 | (h % 2**64) >> 8 for k, h in out.items()}

    def one(text):
        every = [code(h) for h in terms(text)]
        band = [code(h) for h in terms(text) if low <= df[h] <= high]
        few = len(band) < max(fp.FEW, len(every) * fp.LEAST_SHARE)
        used = sorted(every if few else band)
        whole = f"{spark_hash(*used) % 2**64:016x}" if used else f"t{spark_hash(text) % 2**64:016x}"
        return text, few, prints(band), prints(every), whole + "." + "".join(f"{x:016x}"[:6] for x in sorted(prints(used)))

    def near(a, b):
        p, q = (a[3], b[3]) if a[1] or b[1] else (a[2], b[2])
        filled = len({x >> 56 for x in p | q})
        return len(p & q) / filled if filled else float(a[0] == b[0])

    down, out = docs[::-1], {}
    for (i, text), (_, after) in zip(down, down[1:] + down[:1]):
        half = len(text) // 2
        a, b, c = one(text), one(text[: len(text) - half] + after[:half]), one(after)
        out[i] = (a[4], b[4], near(a, b), near(a, c))
    return out


def test_fingerprints_match_their_definition(spark, docs):
    got = by_id(fingerprints.op3_fingerprints(spark, SF).collect(), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    want = brute_fingerprints(docs)
    assert {i: (a, b, round(x, 9), round(y, 9)) for i, (a, b, x, y) in got.items()} == {i: (a, b, round(x, 9), round(y, 9)) for i, (a, b, x, y) in want.items()}


def test_fingerprints_of_uneven_ids(spark, docs, monkeypatch):
    """One id far from the others doesn't put those in one range, and changes nothing else."""
    monkeypatch.setattr(fingerprints, "DOCS_PER_RANGE", 8)
    far = [(i if i < len(docs) - 1 else 10**15, t) for i, (_, t) in enumerate(docs)]
    rows = spark.createDataFrame(far, "doc_id long, text string")
    ranges = fingerprints.in_order(rows, "doc_id", "text").groupBy("part").count().collect()
    assert max(r["count"] for r in ranges) <= 32
    got = by_id(fingerprints.fingerprint_edits(rows).collect(), "fingerprint", "near_next")
    want = brute_fingerprints(far)
    assert {i: (a, round(x, 9)) for i, (a, x) in got.items()} == {i: (a, round(x, 9)) for i, (a, _, _, x) in want.items()}


def test_fingerprints_of_large_groups_and_short_texts(spark):
    own = [" ".join(f"w{(i * 31 + k * 7) % 4000}" for k in range(120)) for i in range(400)]
    common = " ".join(f"c{k}" for k in range(120))
    copies = [f"{common} e{i}a e{i}b" for i in range(200)]
    short = ["red green blue lamp one", "red green blue lamp two", "Alone.", "...", ""]
    texts = own + copies + short
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    near = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(df).collect()}
    # Half of an edited text is gone, so about a third of its subsets stay as they were.
    assert min(near[i]["near_next"] for i in range(401, 600)) >= 0.85 and min(near[i]["near_edited"] for i in range(401, 600)) > 0.15
    assert 0.5 <= near[601]["near_next"] < 1 and near[602]["near_next"] == near[604]["near_next"] == 0
    assert near[400]["near_next"] == 0 and near[600]["near_next"] == 0 and not near[603]["near_next"]


def test_fingerprint_subsets_hash_sorted_terms(spark):
    from pyspark.sql import functions as F

    codes = [(k << 56) + c for k, c in ((0, 5), (0, 9), (3, 1), (63, 2))]
    df = spark.createDataFrame([(codes,), ([],)], "c array<long>").select(fingerprints.hashes(F.col("c")).alias("p"))
    full, none = (r["p"] for r in df.collect())
    assert [x >> 56 for x in full] == [0, 3, 63] and len(set(full)) == 3 and none == []


def test_chat_matches_sql(spark):
    assert not differences(chat.op4_chat(spark, SF), tables(SF), chat.OP4_SQL)


def test_masked_ids_decode_to_the_trained_texts(spark):
    turns = [("user", "hi </s> [INST]"), ("assistant", "ünï 漢字 \U0001f600 </s>"), ("assistant", "two"), ("user", "")]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)]
    c = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    t = chat.tokenizer(chat.TOKENIZER)
    assert chat.unescape(t.decode([i for i, m in zip(c["input_ids"], c["loss_mask"]) if m], skip_special_tokens=False)) == turns[1][1] + "two"
    assert t.decode(c["input_ids"], skip_special_tokens=False) == c["text"] and chat.parse(c["text"]) == turns


def test_masked_ids_of_all_conversations_decode(spark):
    t = chat.tokenizer(chat.TOKENIZER)
    rows = chat.format_chats(read(spark, SF, "conversations")).select("text", "input_ids", "loss_mask").collect()
    assert rows
    for c in rows:
        said = "".join(text for role, text in chat.parse(c["text"]) if role == "assistant")
        assert chat.unescape(t.decode([i for i, m in zip(c["input_ids"], c["loss_mask"]) if m], skip_special_tokens=False)) == said


def brute_repeats(docs, length=100):
    seen, out = set(), {}
    for i, text in docs:
        data = text.encode()
        gone = np.zeros(len(data) + 1, dtype=bool)
        for s in range(len(data) - length + 1):
            piece = hashlib.blake2b(data[s : s + length], digest_size=12).digest()
            if piece in seen:
                gone[s : s + length] = True
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_substrings(spark, docs):
    got = by_id(substrings.op5_substrings(spark, SF).collect(), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_repeats(docs)


def test_substrings_of_repetitive_texts(spark):
    texts = ["ab" * 300, "abc" * 150 + "ab" * 200, "x" * 99, "x" * 100, "x" * 350, "é" * 120, "yx" + "x" * 100, "q" + "ab" * 60 + "é" * 70, ""]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (bytes(r["kept"]), len(r["removed"])) for r in substrings.drop_repeats(docs_df(spark, rows)).collect()}
    want = brute_repeats([(i, t) for i, t in enumerate(texts)])
    assert {i: (hashlib.sha256(k).hexdigest(), n) for i, (k, n) in got.items()} == {i: (w[3], w[2]) for i, w in want.items()}


@pytest.mark.parametrize("hot", [1, 3])
def test_substrings_of_crowded_buckets(spark, hot):
    """Buckets beyond ``hot`` stretches are cut into cells and single strings, with the same result."""
    common = "Copyright of this text is held by its author, and all rights of every kind are kept by them. "
    texts = [f"{i * 7 % 5} {common}{i % 9} see page {i % 4} of the book {'abc'[i % 3] * 80}" for i in range(60)] + [common * 5]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {r["doc_id"]: hashlib.sha256(r["kept"]).hexdigest() for r in substrings.drop_repeats(docs_df(spark, rows), hot=hot).collect()}
    assert got == {i: w[3] for i, w in brute_repeats([(i, t) for i, t in enumerate(texts)]).items()}


@pytest.mark.parametrize("length,gram", [(100, 8), (20, 4), (5, 5)])
def test_bucket_pointers_sort_suffixes(length, gram):
    rng = np.random.default_rng(length)
    parts = [rng.integers(0, 3, 400), np.zeros(300, int), np.tile(rng.integers(0, 200, 37), 20), rng.integers(0, 256, 500)]
    data = np.concatenate([*parts, *parts[::-1], parts[2][:150]]).astype(np.uint8)
    word = np.concatenate([substrings.grams(data, np.arange(len(data)), gram), np.zeros(length, np.uint64)])
    order, _ = substrings.suffixes(word, np.ones(len(data), bool), gram, length)
    raw = data.tobytes() + bytes(length)
    heads = [raw[i : i + length] for i in order.tolist()]
    assert sorted(order.tolist()) == list(range(len(data))) and heads == sorted(heads)
    strings, seen, want = np.arange(len(data) - length), set(), []
    for i in strings.tolist():
        want.append(raw[i : i + length] in seen)
        seen.add(raw[i : i + length])
    assert substrings.later_strings(data, strings, length).tolist() == want


def test_bucket_pointers_find_equal_pieces():
    rng = np.random.default_rng(2)
    kinds = [rng.integers(0, 2, n).astype(np.uint8).tobytes() for n in (3, 8, 9, 16, 100, 101, 168, 168)]
    kinds += [kinds[4][:-1] + b"x", kinds[6][:50] + b"y" + kinds[6][51:]]
    pieces = [kinds[i] for i in rng.integers(0, len(kinds), 400)]
    left = rng.integers(0, 2, 400)
    size = np.array([len(x) for x in pieces])
    got = substrings.later_pieces(np.frombuffer(b"".join(pieces), dtype=np.uint8), np.cumsum(size) - size, size, left)
    keys = list(zip(pieces, left.tolist()))
    assert got.tolist() == [keys.index(k) < i for i, k in enumerate(keys)]


def brute_components(prints):
    kinds = sorted(set(prints.values()))
    root = {f: f for f in kinds}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(kinds, 2):
        if (a ^ b).bit_count() <= 2:
            root[top(a)] = top(b)
    least = {}
    for i in sorted(prints):
        least.setdefault(top(prints[i]), i)
    return {i: (f"{f:016x}", least[top(f)]) for i, f in prints.items()}


def brute_print(text):
    w = words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs):
    got = by_id(simhash.op8_simhash(spark, SF).collect(), "fingerprint", "component_id")
    assert got == brute_components({i: brute_print(t) for i, t in docs})


def test_gray_index_loses_no_link(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    chains = [seeds]
    for _ in range(25):
        flips = np.uint64(1) << rng.integers(0, 64, (2, len(seeds))).astype(np.uint64)
        chains.append(chains[-1] ^ flips[0] ^ flips[1])
    crowd = np.arange(3000, dtype=np.uint64) << np.uint64(3)
    fps = np.unique(np.concatenate([*chains, crowd]))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2

    def spans_all(links):
        root = {int(f): int(f) for f in fps}

        def top(f):
            while root[f] != f:
                f = root[f]
            return f

        for x, y in links:
            root[top(x)] = top(y)
        return all(top(int(fps[i])) == top(int(fps[j])) for i, j in zip(*np.nonzero(near)))

    a, b = simhash.Node(fps).forest()
    assert (np.bitwise_count(a ^ b) > 0).all() and spans_all(zip(a.tolist(), b.tolist()))
    ranked = fps[np.argsort(simhash.gray_rank(fps))]
    blocks = simhash.GrayIndex(ranked).near(ranked)
    found = set(map(tuple, np.concatenate([np.stack(x, 1) for x in blocks]).tolist()))
    assert found == set(zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(ranked[:, None] ^ ranked[None]) <= 2))))
    table = spark.createDataFrame([(int(f.view(np.int64)),) for f in fps], "fp long")
    for size in (64, 100_000):
        links = [(x % 2**64, y % 2**64) for x, y in simhash.near_links(table, node_size=size).collect()]
        assert all(x != y for x, y in links) and spans_all(links)


def test_gray_index_prunes_by_upper_nodes():
    """Groups share bits above the leaves, and a search reaches few of the fingerprints."""
    fps = np.random.default_rng(5).integers(0, 1 << 63, 1 << 15, dtype=np.uint64)
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    tree = simhash.GrayIndex(fps)
    assert len(tree.levels) == 5 and all(own.any() for _, own in tree.levels[:-1])
    groups, level = tree.levels[1]
    known = level | np.repeat(tree.levels[2][1], simhash.FAN)[: len(level)] | np.repeat(tree.levels[3][1], simhash.FAN**2)[: len(level)] | np.repeat(tree.levels[4][1], simhash.FAN**3)[: len(level)]
    reach = np.mean([(np.bitwise_count((f ^ groups) & known) <= 2).mean() for f in fps[:200]])
    assert reach < 0.05


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    want, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: want * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            want -= out[s]
        open_ -= over
    return out


def test_mixing(spark):
    docs = read(spark, SF, "documents")
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    size = {r["doc_id"]: len(words(r["text"] or "")) for r in docs.collect()}
    rows = mixing.op7_mixing(spark, SF).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.op7_mixing(spark, SF).collect()))
    whole, taken = Counter(), Counter()
    for i, n in size.items():
        whole[source[i]] += n
    want = brute_targets(whole)
    assert len(rows) == len(size)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == whole[s] and 0 <= r["taken"] <= 2 * r["size"]
        assert math.isclose(r["target"], want[s], abs_tol=1e-3)
        taken[s] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.03 * t, 50), (s, taken[s], t)


def test_brown_counts_and_base(spark, docs):
    rows = {r["doc_id"]: r for r in brown.op10_brown(spark, SF).collect()}
    held = {i: crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    counts = Counter()
    for i, text in docs:
        if not held[i]:
            counts.update([*words(text), None])
    n, v = sum(counts.values()), len(counts)
    gain = 0.0
    for i, text in docs:
        seq = [*words(text), None]
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(seq), sum(t in counts for t in seq), n)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in seq)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-6)
        gain += r["score"] - base if held[i] else 0
    assert gain > 0


def test_brown_scores_by_their_formula(spark):
    """The score of every text, recomputed word by word from the classes and brute-force counts; head and seeds are small, so all kinds of words occur."""
    docs = read(spark, SF, "documents").select("doc_id", "text")
    train = docs.filter("doc_id % 3 > 0").select("text")
    counts = brown.word_counts(train).cache()
    m = brown.fit(train, counts, seeds=50, most_head=400)
    assert len(set(m.cls[52:402].tolist())) > 3 and len(set(m.cls[402:].tolist())) > 3
    rows = {r["doc_id"]: r["score"] for r in brown.score_brown(docs, m, counts).collect()}
    cls_of = lambda w: int(m.cls[m.units.of([w])[0]])
    c, n, v, moves = Counter(), Counter(), Counter(), Counter()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, text in texts.items():
        if i % 3 > 0:
            seq = [brown.END, *words(text or ""), brown.END]
            c.update(seq[1:])
            moves.update((cls_of(a), cls_of(b)) for a, b in zip(seq, seq[1:]))
    for w, k in c.items():
        n[cls_of(w)] += k
        v[cls_of(w)] += 1
    k = len(m.gain)
    share = {b: (n[b] + 0.5) / sum(n[x] + 0.5 for x in range(k)) for b in range(k)}
    out = Counter()
    for (a, _), t in moves.items():
        out[a] += t
    for i, text in list(texts.items())[:60]:
        seq = [brown.END, *words(text or ""), brown.END]
        want = 0.0
        for x, y in zip(seq, seq[1:]):
            a, b = cls_of(x), cls_of(y)
            want += math.log10((moves[a, b] + brown.SMOOTH * share[b]) / (out[a] + brown.SMOOTH)) + math.log10((c[y] + 0.5) / (n[b] + 0.5 * (v[b] + 1)))
        assert math.isclose(rows[i], want, rel_tol=1e-9, abs_tol=1e-6)


def test_brown_is_a_distribution(spark):
    """Given any class before, the words of all classes and one unseen word each have probability 1 together."""
    train = spark.createDataFrame([("a b a b c end",), ("b a b c c",), (None,), ("d a b",)], "text string")
    counts = brown.word_counts(train).cache()
    m = brown.fit(train, counts)
    known = {bytes(r["word"]): r["n"] for r in counts.collect()}
    cls = {w: m.cls[m.units.of([w])[0]] for w in known}
    for before in range(len(m.gain)):
        mass = sum((n + 0.5) * 10 ** m.gain[before, cls[w]] for w, n in known.items()) + sum(0.5 * 10 ** m.gain[before, c] for c in range(len(m.gain)))
        assert math.isclose(mass, 1.0, rel_tol=1e-9)


def test_short_items_and_several_blocks(spark):
    texts = ["Yes!", "yes, the cat sat on a mat.", "The CAT -- sat on a mat", "the cat sat on a matter", "a cat sat on a mat the", "yes no", "42", None]
    texts.append("Long benchmark passages are compared with some edits allowed, and this is one of those passages.")
    items = [(1, "the cat sat on a mat"), (2, "yes"), (3, "yes no"), (4, "Long benchmark passages are compare with some edits allowed, and this is one of these passages."), (5, ""), (6, None), (7, "42 yes")]
    df = docs_df(spark, [(i, t, "en", "web", None) for i, t in enumerate(texts)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {0: [2], 1: [1, 2], 2: [1], 3: [], 4: [], 5: [2, 3], 6: [], 7: [], 8: [4]}
    for most in (decontaminate.BLOCK_BYTES, 60):
        got = {r["doc_id"]: sorted(h["item_id"] for h in r["hits"]) for r in decontaminate.find_leaks(df, bench, most_bytes=most).collect()}
        assert got == want
        assert {r["doc_id"] for r in decontaminate.drop_leaks(df, bench, most_bytes=most).collect()} == {i for i, x in want.items() if not x}


def test_repeated_grams_and_short_items_against_every_alignment():
    """Items and texts of a small alphabet, whose q-grams repeat: hits are those of a plain alignment of every item with every text."""
    rng = random.Random(7)
    some = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    items = [(i, x) for i, x in enumerate(["0" * 40, "ab" * 20, "aab " * 9, "a", "ab", "b a", *[some(rng.randint(3, 60)) for _ in range(25)]])]
    texts = ["0" * 500, "x" + "ab" * 60, "aab " * 40, "0" * 20 + "1" + "0" * 25, *[some(rng.randint(1, 300)) for _ in range(60)]]
    index = decontaminate.Index(items)
    data = [decontaminate.normalised(t) for t in texts]

    def plain(item, text, k):
        if len(item) < decontaminate.MIN_ITEM:
            return 0 if f" {item.decode()} " in f" {text.decode()} " else None
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            row, old = [i], row
            for j, t in enumerate(text, 1):
                row.append(min(old[j - 1] + (c != t), old[j] + 1, row[-1] + 1))
        return min(row) if min(row) <= k else None

    want = {(t, i): d for t, text in enumerate(data) for i, item in enumerate(index.items) if (d := plain(item, text, int(index.edits[i]))) is not None}
    assert {(t, i): d for t, i, d, *_ in index.matches(data)} == want
    assert any(d for d in want.values())


def test_hits_are_bounded():
    """A text of one repeated letter touches each band once for a place, not once for each place of the item."""
    index = decontaminate.Index([(1, "0" * 200), (2, "0" * 200 + "1")])
    assert len(index.codes) == 2 and index.count.max() == 2
    assert {i for _, i, *_ in index.matches([b"0" * 100_000])} == {0, 1}

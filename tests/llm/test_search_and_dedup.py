"""Licences, joins on shingles, line dedup, decontamination and vectors against brute force."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from kinweave.llm import decontamination, license_scan, line_dedup, ngram_jaccard, vector_dedup
from kinweave.llm.components import connected_components
from kinweave.llm.shingles import shingle_sets, texts_words
from kinweave.llm.storage import Scratch

DOCS = "doc_id long, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def word_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_brute(rows):
    sets = [word_set(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    tops = groups(len(rows), links)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[tops[k]] = min(least.get(tops[k], d), d)
    return sorted(((d, len(sets[k]), least.get(tops[k])) for k, (d, _) in enumerate(rows)), key=repr)


def near_copies(rng, words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def hard_rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choices(vocab, k=120) for _ in range(4)]
    texts = []
    for b in base:
        texts += near_copies(rng, b, 60, 12)
    passage = " ".join(rng.choices(vocab, k=60))
    texts += [passage + " " + " ".join(rng.choices(vocab, k=rng.randint(3, 60))) for _ in range(60)]
    texts += ["same words here again and again now"] * 30 + ["", None, "  ", "one", "One", "one two", "a b c d e", "A b\tc\nd e", "é É"]
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, "alone in the world of nulls ever"), (3, texts[3]), (3, texts[100])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile", [2048, 7])
def test_jaccard_groups_equal_brute_force(spark, hard_rows, tile, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "_TILE", tile)
    df = spark.createDataFrame(hard_rows, DOCS).selectExpr("doc_id", "text", "1 as component_id", "'x' as n_shingles")
    got = sorted((tuple(r) for r in ngram_jaccard.jaccard_groups(spark, df.repartition(3)).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == jaccard_brute(hard_rows)


def test_jaccard_of_nothing(spark):
    assert ngram_jaccard.jaccard_groups(spark, spark.createDataFrame([], DOCS)).count() == 0


def test_shingles_see_words_alone():
    a, b, c = shingle_sets(["A b  c\td\ne F", "a b c d e f", "x" * 300_000 + " b c d e f"], 5)
    assert (a == b).all() and len(a) == 2 == len(c) == 1 + len(set(c.tolist()) & set(a.tolist()))
    words, at = texts_words(["", None, "  ", "p q"])
    assert at.tolist() == [0, 0, 0, 0, 2] and len(set(words.tolist())) == 2


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 180)] + [(500, 500), (7, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 180)) and 500 not in got


def runs_brute(text):
    """(first character, end, words) of every run, word by word."""
    found = [(m.start(), m[0].translate(LOW)) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    key = lambda w: (ord(w[0]) * 7 + ord(w[len(w) // 2]) * 31 + ord(w[-1]) * 127 + len(w) * 8191) % 1009
    near, run = line_dedup.NEAR, line_dedup.RUN
    begins = {min(range(i, i + near), key=lambda k: (key(found[k][1]), k)) for i in range(len(found) - near + 1)}
    ends = [x for x, _ in found] + [len(text)]
    return [(found[i][0], ends[i + run], tuple(w for _, w in found[i : i + run])) for i in sorted(begins) if i + run <= len(found)]


def lines_brute(rows):
    key = lambda k: rows[k][0] if rows[k][0] is not None else int(np.uint64(xxhash.xxh64_intdigest(rows[k][1], 42)).astype(np.int64))
    first, places = {}, {}
    for k in sorted((k for k, (_, t) in enumerate(rows) if t is not None), key=key):
        text = rows[k][1]
        cuts = [0, *(m.end() for m in re.finditer(r"\n|(?<=[.!?]) +", text)), len(text)]
        lines = re.split(r"\n|(?<=[.!?]) +", text)
        found = [(cuts[i], cuts[i + 3], tuple(lines[i : i + 3])) for i in range(len(lines) - 2) if re.search(r"[^\x20\x09-\x0D]", "".join(lines[i : i + 3]))]
        places[k] = [(a, b, ("line", w)) for a, b, w in found] + [(a, b, ("run", w)) for a, b, w in runs_brute(text)]
        for a, _, w in sorted(places[k], key=lambda x: x[0]):
            first.setdefault(w, (rows[k], a))
    out = []
    for k, (d, t) in enumerate(rows):
        gone = {c for a, b, w in places.get(k, []) if first[w] != (rows[k], a) for c in range(a, b)}
        out.append((d, t if t is None else "".join(x for c, x in enumerate(t) if c not in gone), 0 if t is None else len(re.findall(r"\n|(?<=[.!?]) +", t)) + 1, len(gone)))
    return sorted(out, key=repr)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    pool = [f"line {i} has some words in it" for i in range(12)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(80)]
    passage = "The first part of it ends. Then comes a second one. A third sentence follows here. And the last of all closes it."
    rows += [(200 + i, f"Opening number {i} stands alone here. {passage} " + "  ".join(f"tail{i}x{k}" for k in range(50)) + "   kept  as it was. ") for i in range(4)]
    rows += [(None, "\n".join(pool[:4])), (None, None), (300, None), (301, ""), (302, "a\nb\nc"), (303, "a\nb\nc"), (304, "\n".join(pool[:1] * 8)), (305, "of. " * 60), (306, "é😀 " * 40), (307, "x" * 70000)]
    long = " ".join(rng.choices(["ein", "zwei", "drei", "vier", "Fünf"], k=3000))
    rows += [(400, long), (401, "before " + long[200:900] + " after"), (402, "Home\nNews\nLog in\nFirst body"), (403, "Home\nNews\nLog in\nSecond body"), (404, "a\n \n\n\nb"), (405, "c\n \n\n\nd")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "7 as place", "8 as places", "9 as __mark", "0 as _m1", "'q' as n_removed", "1 as name")
    out = line_dedup.dedup_lines(spark, df)
    assert out.columns == ["doc_id", "text", "place", "places", "__mark", "_m1", "name", "n_lines", "n_removed"]
    got = out.collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=repr) == lines_brute(rows)
    assert {(r.place, r.places, r["__mark"], r.name) for r in got} == {(7, 8, 9, 1)}
    said = {r.doc_id: r.text for r in got}
    assert said[403] == "Second body" and said[405] == "c\n \n\n\nd" and said[203].endswith("x48  tail3x49   kept  as it was. ")
    again = line_dedup.dedup_lines(spark, spark.createDataFrame([rows[0], rows[0]], DOCS)).collect()
    assert again[0].text == again[1].text
    assert line_dedup.dedup_lines(spark, spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup_tells_texts_without_id_apart(spark):
    a, b = "plumless", "buckeroo"  # equal CRC-32, as texts of equal length that end alike have
    assert zlib.crc32(a.encode()) == zlib.crc32(b.encode())
    tail = "\nunique line one\nunique line two\nunique line three"
    rows = [(None, a + tail), (None, b + tail), (1, "other\nlines\nhere")]
    assert zlib.crc32(rows[0][1].encode()) == zlib.crc32(rows[1][1].encode())
    got = {r.text for r in line_dedup.dedup_lines(spark, spark.createDataFrame(rows, DOCS)).collect()} - {rows[2][1]}
    assert got in ({a + tail, b + "\n"}, {b + tail, a + "\n"})  # one of them is first and keeps all


def test_every_passage_of_50_words_holds_a_run():
    rng = random.Random(8)
    for k in range(300):
        passage = rng.choices([f"w{i}" for i in range(rng.choice([1, 2, 9, 4000]))], k=50)
        around = [[f"x{rng.randrange(5000)}" for _ in range(rng.randint(0, 30))] for _ in range(4)]
        a, b = (" ".join(x + passage + y) for x, y in (around[:2], around[2:]))
        text, _, digests = line_dedup.runs_of([a, "", b, "é " * k])
        assert {tuple(x) for x in digests[text == 0].tolist()} & {tuple(x) for x in digests[text == 2].tolist()}, k


def test_long_words_have_hashes_of_their_own():
    order, word = "ab", {"a": "ab", "b": "ba"}
    for _ in range(8):
        order = "".join(word[x] for x in order)
    texts = [order, order.translate(str.maketrans("ab", "ba")), "a" * 8, "a" * 9, "a" * 8 + "\0", "a" * 16, "a" * 16 + "\0", "a" * 17, "b" + "a" * 15, "a" * 15 + "b"]
    hashes, at = texts_words(texts)
    assert at.tolist() == list(range(len(texts) + 1)) and len(set(hashes.tolist())) == len(texts)
    assert texts_words(["A" * 20 + " x"])[0].tolist() == texts_words(["a" * 20 + "\tX"])[0].tolist()
    assert texts_words(["one—two “three” İ·x"], letters=True)[1].tolist() == [0, 5]


def test_pipeline_removes_passages_planted_in_mid_sentence(spark):
    rng = random.Random(3)
    foreign = lambda n: " ".join(f"é{rng.randrange(10**6)}" for _ in range(n))
    passage = " ".join(f"p{i}" + "." * (i in (24, 30)) for i in range(51))
    rows = [(i, f"{foreign(3 + i)} {passage} {foreign(40 - 3 * i)}\n{foreign(5)}. {foreign(6)}") for i in range(6)] + [(6, passage), (7, None), (None, "")]
    df = spark.createDataFrame(rows, DOCS)
    longest = lambda text: max((j - i for i in range(51) for j in range(i + 1, 52) if " ".join(passage.split()[i:j]) in text), default=0)
    for found in (line_dedup.dedup_lines(spark, df), corpus_pipeline.line_stage(spark, df, "")):
        got = {r.doc_id: r.text for r in found.collect()}
        assert got[0] == rows[0][1] and got[7] is None and got[None] == ""
        for i, text in rows[1:6]:
            assert longest(got[i]) < 50 and len(got[i].split()) < len(text.split())
            assert [w for w in got[i].split() if w[0] == "é"] == [w for w in text.split() if w[0] == "é"] and got[i].count("\n") == 1
        assert longest(got.get(6, "")) < 50


def test_decontamination_finds_substituted_passages(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([8, 9, 15, 30, 60])))) for i in range(40)] + [(40, "too short an item"), (41, None), (None, " ".join(vocab[:20]))]
    rows, want = [], {}
    for k in range(160):
        text = rng.choices(vocab, k=rng.choice([0, 5, 80, 300]))
        want[k] = set()
        if k % 2:
            name, item = items[rng.randrange(40)]
            w = item.split()
            for j in range(4, len(w), 7):  # one substitution in seven
                if len(w) > 12:
                    w[j] = "other"
            at = rng.randint(0, len(text))
            text[at:at] = [x.upper() + ",!"[rng.randrange(2)] for x in w]
            want[k] = {name}
        rows.append((k, " ".join(text)))
    rows += [(900, None), (901, ""), (902, " ".join(vocab[:20])), (903, "too short an item")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "1 as hits", "2 as other")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.find_passages(spark, df, bench)
    assert out.columns == ["doc_id", "text", "other", "hits"]
    got = {r.doc_id: {h.item_id for h in r.hits} for r in out.collect()}
    assert {k: got[k] for k in want} == want
    assert got[900] == got[901] == got[903] == set() and got[902] == {None}
    assert decontamination.find_passages(spark, df, bench.limit(0)).where("size(hits) > 0").count() == 0
    assert decontamination.find_passages(spark, df.limit(0), bench).count() == 0


@pytest.mark.parametrize("n", range(8, 17))
def test_decontamination_has_a_seed_for_every_substitution(n):
    item = [f"i{k}" for k in range(n)]
    index = decontamination.SeedIndex([(1, " ".join(item))])
    gone = list(itertools.combinations(range(n), n - math.ceil(0.75 * n)))
    texts = [" ".join(["lead", *("other" if k in out else x for k, x in enumerate(item)), "tail"]) for out in gone]
    assert [len(x) for x in index.hits(texts)] == [1] * len(gone)


def test_decontamination_finds_the_middle_of_an_item_between_short_texts():
    item = [f"i{k}" for k in range(60)]
    got = decontamination.SeedIndex([(1, " ".join(item))]).hits(["a b", " ".join(item[20:40]), "c d", None])
    assert [[(h["item_id"], h["start"], h["words"]) for h in x] for x in got] == [[], [(1, 0, 20)], [], []]


def test_decontamination_in_slices(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SLICE_CHARS", 60)
    text = lambda i: " ".join(f"v{i}x{k}" for k in range(20))
    bench = spark.createDataFrame([(i, text(i)) for i in range(6)], "item_id long, text string")
    df = spark.createDataFrame([(i, "lead " + text(i) + " " + text((i + 1) % 6)) for i in range(6)], DOCS)
    got = {r.doc_id: sorted(h.item_id for h in r.hits) for r in decontamination.find_passages(spark, df, bench).collect()}
    assert got == {i: sorted((i, (i + 1) % 6)) for i in range(6)}


def test_licences_equal_brute_force(spark):
    texts = license_scan.TEMPLATES
    every = [t for ts in texts.values() for t in ts]
    rng = random.Random(4)
    rows = []
    for k, t in enumerate(every * 3):
        w = t.split()
        for _ in range(rng.randint(0, max(1, len(w) // 8))):
            w[rng.randrange(len(w))] = "changed"
        rows.append((k, "Some text before.\n" + " ".join(w) + "\nCopyright (c) 2020 Jane Doe\nAnd after it, more."))
    rows += [(900, None), (901, ""), (902, "license"), (903, "The mit of the apache free software notice.")]
    scan = license_scan.Templates()
    grams = [(license_scan.bigrams(t), n) for n, ts in texts.items() for t in ts]
    for _, text in rows:
        for unit in re.split(r"\n", text or ""):
            best = max(license_scan.dice(license_scan.bigrams(unit), g) for g, _ in grams)
            got = scan.best(unit)
            assert (got is not None) == (best >= scan.least) and (got is None or abs(got[0] - best) < 1e-12)
    out = license_scan.scan_licences(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as licences"))
    found = {r.doc_id: r.licences for r in out.collect()}
    assert not found[900] and not found[901] and not found[902] and not found[903]
    exact = spark.createDataFrame([(0, "Intro. Licensed under CC BY-NC 4.0. More."), (1, every[3])], DOCS)
    got = {r.doc_id: [(x.licence, x.start, x.end) for x in r.licences] for r in license_scan.scan_licences(exact).collect()}
    assert got == {0: [("CC-BY-NC-4.0", 7, 35)], 1: [("MIT", 0, len(every[3]))]}


@pytest.mark.parametrize("blank", ["\n\n", "\n"])
def test_licences_of_several_paragraphs_in_other_text(blank):
    scan = license_scan.Templates()
    other = ["The river runs by the house and the field.", "A stone lies in the water of the road."]
    for name, which, cuts in (("MIT", 3, ("The above", "THE SOFTWARE IS")), ("BSD-2-Clause", 2, ("1. R", "2. R", "THIS SOFTWARE IS")), ("BSD-3-Clause", 2, ("1. R", "2. R", "3. N", "THIS SOFTWARE IS"))):
        body = license_scan.TEMPLATES[name][which]
        for cut in cuts:
            body = body.replace(" " + cut, blank + cut)
        for lead in (blank, blank + "Copyright (c) 2020 Jane Doe" + blank):
            text = blank.join(other) + lead + body + blank + blank.join(other)
            got = [(x["licence"], text[x["start"] : x["end"]], x["dice"]) for x in scan.scan(text)]
            assert got == [(name, body, 1.0)]
            text = text.replace("copies", "items").replace("conditions", "terms")
            assert [x["licence"] for x in scan.scan(text)] == [name]


def vectors_brute(rows):
    good = [k for k, (d, v) in enumerate(rows) if d is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = []
    for i in good:
        for j in good:
            if j < i and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.array(rows[k][1], dtype=np.float32).astype(float) for k in (i, j))
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.95:
                    links.append((i, j))
    tops, n = groups(len(rows), links), collections.Counter(k for pair in links for k in pair)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[tops[k]] = min(least.get(tops[k], d), d)
    return sorted(((d, n[k], least.get(tops[k]), d is not None and d == least.get(tops[k])) for k, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("block", [4096, 32])
def test_vectors_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    monkeypatch.setattr(vector_dedup, "TILE", 16)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(5, 12))
    rows = [(int(i), [float(x) for x in base[rng.integers(5)] + rng.normal(size=12) * rng.choice([0, 0.05, 0.25])]) for i in range(240)]
    rows += [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] * 12), (1003, [None] + [1.0] * 11), (1004, []), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0]), (1007, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "3 as component_id")
    got = sorted((tuple(r) for r in vector_dedup.vector_groups(spark, df).collect()), key=repr)
    assert got == vectors_brute(rows)
    assert vector_dedup.vector_groups(spark, df.limit(0)).count() == 0


def test_vectors_of_many_panels_equal_brute_force(spark, monkeypatch):
    """Several panels, a hot group across all of them, other lengths between, and sums in between."""
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    monkeypatch.setattr(vector_dedup, "PANEL_BYTES", 6 * 16 * 12 * 8, raising=False)
    monkeypatch.setattr(vector_dedup, "SUM_ROWS", 0, raising=False)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3, 12))
    rows = [(int(i), [float(x) for x in base[rng.integers(3)] + rng.normal(size=12) * rng.choice([0, 0.05, 0.25])]) for i in rng.permutation(400)]
    rows += [(900 + k, [float(x) for x in rng.normal(size=2)]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((tuple(r) for r in vector_dedup.vector_groups(spark, df).collect()), key=repr) == vectors_brute(rows)


def test_vectors_are_not_shuffled_for_each_pair_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 32)
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(1600, 64)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        of = sc.statusStore().executorList(False)
        return sum(of.apply(k).totalShuffleWrite() for k in range(of.size()))

    before = written()
    assert vector_dedup.vector_groups(spark, df).count() == 1600
    assert written() - before < 6 * 1600 * 64 * 4


def test_tile_links_stop_early_without_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 40))
    x[150:200] = x[:50] + rng.normal(size=(50, 40)) * 0.05
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned = u @ vector_dedup.fit_rotation(x)
    i, j, _ = vector_dedup.tile_links(turned, turned, 0.95)
    want = set(zip(*np.nonzero(u @ u.T >= 0.95), strict=True))
    assert set(zip(i, j, strict=True)) == want

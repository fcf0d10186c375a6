import random

from pyspark.sql import functions as F

from kinweave.functions.names import py_normalize, py_similarity
from kinweave.operators.fuzzy import sharing_pairs, similar_pairs, subname_pairs
from kinweave.operators.ordered import contested_running, recent_owner
from kinweave.operators.resolve import resolve_names
from kinweave.plans.shared import kept
from kinweave.operators.resolve_state import Memory, mentions_of, merge_across, person_key, relevant_aliases, resolve_articles

SEEDS = ["Sam Altman", "Elon Musk", "Satya Nadella", "Greg Brockman", "Dario Amodei", "Andy Jassy", "Anthony Ha", "Anthony Garcia"]
PAIRS = [("Sam Altman", "Sam Altman", "alias"), ("Dr. Sam Altman", "Sam Altman", "alias"), ("Sam  Altman", "Sam Altman", "alias"), ("Sam Altmann", "Sam Altman", "levenshtein"), ("Elon Mosk", "Elon Musk", "levenshtein"), ("Altman", "Sam Altman", "subname"), ("Satya", "Satya Nadella", "subname"), ("Anthony", None, "none"), ("Vladimir Putin", None, "none"), ("Bill Gates", None, "none")]


def aliases(spark, seeds=SEEDS):
    return spark.createDataFrame([(py_normalize(s), f"p{i}", s) for i, s in enumerate(seeds)], "surface_form string, person_id string, canonical_name string")


def memory(seeds=SEEDS, **kw):
    return Memory({py_normalize(s): (f"p{i}", s) for i, s in enumerate(seeds)}, **kw)


def test_gold_pairs_in_order():
    m = memory()
    for surface, expected, stage in PAIRS:
        got = m.find(surface)
        assert (got[1:] if got else (None, "none")) == (expected, stage), surface


def test_gold_pairs_as_sets(spark):
    got = {r.surface: r for r in resolve_names(spark.createDataFrame(PAIRS, "surface string, e string, s string"), aliases(spark)).collect()}
    for surface, expected, stage in PAIRS:
        want = "ambiguous" if surface == "Anthony" else stage
        assert (got[surface].canonical_name, got[surface].stage) == (expected, want), surface


def test_bookkeeping():
    m = Memory()
    for k, name in enumerate(("Anthony Ha", "Anthony Garcia", "Anthony Smith"), 1):
        m.note(f"p{k}", name)
        assert m.owners["anthony"] == {f"p{i}" for i in range(1, k + 1)}
        assert m.recency.get("anthony") == (f"p{k}" if k > 1 else None)
    m.note("q", "Sam Lo")
    assert not {"sam", "lo"} & m.owners.keys()


def test_recency_decides_short_names():
    two = ["Anthony Ha", "Anthony Garcia"]
    assert memory(two).find("Anthony") is None
    m = memory(two)
    m.recency = {"anthony": "p1"}
    assert m.find("Anthony") == ("p1", "Anthony Garcia", "subname")
    m = memory(two)
    m.recency = {"smith": "px"}
    assert m.find("Anthony") is None
    m = memory(["Anthony Ha"])
    m.seed_owners()
    assert m.find_or_make("Anthony Ha")[2] == "alias"
    assert m.find_or_make("Anthony Garcia")[3] is True
    assert m.find_or_make("Anthony")[1:3] == ("Anthony Garcia", "subname")


def test_chooser_is_asked_for_candidates_alone():
    asked = []
    m = memory(["Sam Altman"], chooser=lambda name, c: asked.append((name, c)) or "Sam Altman")
    assert m.find("Samuel Altmen") == ("p0", "Sam Altman", "llm") and asked == [("Samuel Altmen", ["Sam Altman"])]
    assert memory(["Sam Altman"], use_chooser=False, chooser=lambda *_: "Sam Altman").find("Samuel Altmen") is None
    assert memory(["Sam Altman"], chooser=lambda *_: "Elon Musk").find("Samuel Altmen") is None
    assert memory(["Sam Altman"]).find("Ben Altman")[2] == "subname"

    def fails(*_):
        raise OSError

    assert memory(["Sam Altman"], chooser=fails).find("Samuel Altmen") is None


def test_similar_pairs_lose_nothing(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 14))).strip() or "a" for _ in range(120)]
    words += [w[:-1] + "x" for w in words[:30]] + ["", "a"]
    left, right = spark.createDataFrame([(w,) for w in words[:80]], "norm string"), spark.createDataFrame([(w,) for w in words[50:]], "surface_form string")
    for least in (0.8, 0.7, 0.5):
        got = {(r.norm, r.surface_form) for r in similar_pairs(left, right, least).collect()}
        want = {(a, b) for a in set(words[:80]) for b in set(words[50:]) if a and b and py_similarity(a, b) >= least}
        assert got == want


def test_token_pairs(spark):
    left = spark.createDataFrame([("altman",), ("ben altman",), ("lo",)], "norm string")
    right = spark.createDataFrame([("sam altman",), ("ben altman",)], "surface_form string")
    assert {tuple(r) for r in subname_pairs(left, right).collect()} == {("altman", "sam altman"), ("altman", "ben altman"), ("ben altman", "ben altman"), ("ben altman", "sam altman")}
    assert {tuple(r) for r in sharing_pairs(left, right).collect()} == {(a, b) for a in ("altman", "ben altman") for b in ("sam altman", "ben altman")}


def test_articles_run_apart_and_in_sequence(spark):
    rows = [("a1", 0, "1person", 0, "Anthony Garcia"), ("a1", 0, "1person", 1, "Anthony"), ("a1", 0, "2end", 0, "Anthony"), ("a2", 0, "1person", 0, "Anthony"), ("a2", 1, "1person", 0, "Elon Mosk")]
    mentions = spark.createDataFrame(rows, "article_id string, chunk_idx int, kind string, pos int, surface string")
    seeds = aliases(spark, ["Anthony Ha", "Elon Musk"])
    by = lambda df: {(r.article_id, r.chunk_idx, r.kind, r.pos): (r.canonical_name, r.stage) for r in df.collect()}
    apart = by(resolve_articles(mentions, seeds))
    assert apart["a1", 0, "1person", 1] == ("Anthony Garcia", "subname") and apart["a1", 0, "2end", 0][0] == "Anthony Garcia"
    assert apart["a2", 0, "1person", 0] == ("Anthony Ha", "subname") and apart["a2", 1, "1person", 0] == ("Elon Musk", "levenshtein")
    strict = by(resolve_articles(mentions, seeds, strict=True))
    assert strict["a2", 0, "1person", 0] == ("Anthony Garcia", "alias")  # the short form was kept as an alias
    made = resolve_articles(mentions, seeds).where("new_person").first()
    assert made.person_id == person_key("Anthony Garcia")


def test_articles_of_a_batch_agree(spark):
    surfaces = ["Jane Roe", "Dr. Jane Roe", "Jane Roee", "Roe Marston", "Marston", "Marston", "John Elwood", "Mary Elwood", "Elwood", "", "Jane Roeee", "Anthony"]
    mentions = spark.createDataFrame([(f"a{i:02d}", 0, "1person", 0, x) for i, x in enumerate(surfaces)], "article_id string, chunk_idx int, kind string, pos int, surface string")
    seeds = aliases(spark, ["Anthony Ha", "Anthony Garcia"])
    found = kept(resolve_articles(mentions, seeds))
    assert found.where("new_person").count() == len(surfaces)  # each article by itself
    got = {r.article_id: r for r in merge_across(found, seeds).collect()}
    names = [got[f"a{i:02d}"].canonical_name for i in range(len(surfaces))]
    assert names == ["Jane Roe", "Jane Roe", "Jane Roe", "Roe Marston", "Roe Marston", "Roe Marston", "John Elwood", "Mary Elwood", "Elwood", "", "Jane Roe", "Anthony"]
    assert [got[f"a{i:02d}"].new_person for i in range(3)] == [True, False, False] and got["a02"].person_id == person_key("Jane Roe")
    strict = {r.article_id: r.canonical_name for r in resolve_articles(mentions, seeds, strict=True, use_recency=False).collect()}
    assert {k: r.canonical_name for k, r in got.items()} == strict


def test_hot_short_names_need_few_seeds(spark):
    seeds = aliases(spark, [f"John Q{chr(97 + i)}{chr(97 + j)}x" for i in range(20) for j in range(20)])
    mentions = spark.createDataFrame([("a", 0, "1person", 0, "John"), ("a", 0, "1person", 1, "John Qaax"), ("a", 0, "1person", 2, "John")], "article_id string, chunk_idx int, kind string, pos int, surface string")
    assert max(len(r.seeds) for r in relevant_aliases(mentions, seeds).collect()) < 120  # similar ones, and two of those that share the name
    got = sorted((r.pos, r.canonical_name, r.stage) for r in resolve_articles(mentions, seeds).collect())
    assert got[0][1:] == ("John", "none") and got[1][1:] == ("John Qaax", "alias")


def test_mentions_order(spark):
    df = spark.createDataFrame([("a", 0, [("X", None)], [("S", "T", "r", "", "")])], "article_id string, chunk_idx int, people array<struct<name:string,role:string>>, relationships array<struct<source_person:string,target_person:string,relation_type:string,explanation:string,supporting_quote:string>>")
    got = [tuple(r) for r in mentions_of(df).orderBy("kind", "pos").collect()]
    assert got == [("a", 0, "1person", 0, "X"), ("a", 0, "2end", 0, "S"), ("a", 0, "2end", 1, "T")]


def test_windows_with_snapshot(spark):
    rows = spark.createDataFrame([("a", "anthony", 1, "p2"), ("a", "anthony", 2, "p2"), ("a", "anthony", 3, "p3")], "article_id string, token string, seq int, person_id string")
    snap = spark.createDataFrame([("anthony", "p1")], "token string, person_id string")
    got = recent_owner(contested_running(rows, snap)).orderBy("seq").collect()
    assert [(r.owners, r.contested, r.recent) for r in got] == [(2, True, None), (2, True, "p2"), (3, True, "p2")]
    assert contested_running(rows).where(F.col("contested")).count() == 1


def test_long_strings_meet_in_linear_time(spark):
    rng = random.Random(5)
    forms = ["".join(rng.choices("abcde ", k=n)) for n in (30, 33, 36, 41, 60, 200)] + ["heer " * 900, "ertionha " * 300]
    edited = lambda x, share: "".join("" if (r := rng.random()) < share / 2 else c + rng.choice("xy") if r < share else c for c in x)
    forms += [edited(x, share) for x in forms for share in (0.05, 0.15, 0.2, 0.25)]
    left, right = spark.createDataFrame([(x,) for x in forms], "norm string"), spark.createDataFrame([(x,) for x in forms], "surface_form string")
    for least in (0.8, 0.98):
        got = {(r.norm, r.surface_form): r.similarity for r in similar_pairs(left, right, least).collect()}
        assert got == {(x, y): py_similarity(x, y) for x in forms for y in forms if py_similarity(x, y) >= least}

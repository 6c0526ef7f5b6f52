"""The training-data operators against brute force, on clean and dirty little tables."""

import math
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayledger.llm import leaks, splits, stuffing, terms, tokens
from wayledger.llm.sampling import ProportionalSample, wanted_rows
from wayledger.llm.text import photo_path, plain_term

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


# --- text ------------------------------------------------------------------------------------------------


def test_plain_terms():
    cases = {"  A  B\t": "a b", "é": "é", "": None, "  ": None, None: None, "İ": "i̇"}
    assert {k: plain_term(k) for k in cases} == cases


@pytest.mark.parametrize(
    "path, photo",
    [
        ("A/b.JPG", "a/b.jpg"), ("a\\b.jpg?v=1", "a/b.jpg"), ("./a//x/../b.jpg", "a/b.jpg"), ("../../a/b.jpg", "a/b.jpg"), ("a%2Fb%2ejpg", "a/b.jpg"),
        ("a/b%3Fc.jpg?d", "a/b?c.jpg"), ("a/%zz%4", "a/%zz%4"), ("k%C3%AArsberg", "kêrsberg"), ("?x", None), (" ", None), ("", None), (None, None), ("/", None), ("a/..", None),
    ],
)
def test_photo_paths(path, photo):
    assert photo_path(path) == photo


# --- 1: terms ---------------------------------------------------------------------------------------------


@settings(max_examples=40)
@given(st.lists(st.tuples(st.text("abé", max_size=6), st.integers(1, 5), st.integers(0, 2)), max_size=900), st.integers(1, 8))
def test_burst_trie_counts(entries, container):
    old, terms.CONTAINER = terms.CONTAINER, container
    try:
        trie, want = terms.BurstTrie(), defaultdict(lambda: [0, 0])
        for term, n, r in entries:
            trie.add(term, n, r)
            want[term][0] += n
            want[term][1] += r
        assert list(trie.items()) == [(t, *want[t]) for t in sorted(want)]
        assert trie.size == len(want)
        packed = list(terms._pack("f", "", trie.items()))
        assert [x for row in packed for x in terms._unpack(row)] == list(trie.items())
    finally:
        terms.CONTAINER = old


def test_terms_with_many_routes(spark):
    random.seed(4)
    rows = [(random.randrange(40), random.choice("abc") * random.randrange(1, 9) + str(random.randrange(300)), "x" * 5000 if i % 50 == 0 else None, i) for i in range(3000)]
    rows += [(None, "lonely", "  ", 0), (1, None, "", 0), (1, "A b", None, 0), (2, "a B ", None, 0), (2, "a B ", None, 0)]
    df = spark.createDataFrame(rows, "sample long, dim string, cat string, field int")
    want = defaultdict(lambda: [0, set()])
    for sample, dim, cat, _ in rows:
        for f, v in (("dim", dim), ("cat", cat)):
            if t := plain_term(v):
                want[f, t][0] += 1
                want[f, t][1] |= {sample} - {None}
    for entries in (200_000, 40):
        got = {(r.field, r.term): (r.occurrences, r.records) for r in terms.term_frequencies(df, ["dim", "cat"], "sample", entries).collect()}
        assert got == {k: (n, len(s)) for k, (n, s) in want.items()}
    marks = {(r.field, r.term): r.mark for r in terms.marked_terms(df, ["dim", "cat"], "sample").collect()}
    assert marks["cat", "x" * 5000] == "common" and marks["dim", "a b"] == "rare" and marks["dim", "lonely"] == "rare"


def test_terms_of_nothing(spark):
    df = spark.createDataFrame([], "sample long, dim string")
    assert terms.marked_terms(df, ["dim"], "sample").count() == 0
    assert terms.marked_terms(spark.createDataFrame([(1, None)], df.schema), ["dim"], "sample").count() == 0


# --- 3: splits ----------------------------------------------------------------------------------------------


def brute_groups(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r, e in edges:
        a, b = find(("r", r)), find(("e", e))
        parent[a] = b
    groups = defaultdict(set)
    for r, _ in edges:
        groups[find(("r", r))].add(r)
    return {(min(g), r) for g in groups.values() for r in g}


@pytest.mark.parametrize(
    "edges",
    [
        [(i, f"e{i // 3}") for i in range(30)],
        [(i, f"e{i}") for i in range(60)] + [(i, f"e{i + 1}") for i in range(59)],  # a long chain
        [(60 - i, f"e{i}") for i in range(40)] + [(60 - i, f"e{i + 1}") for i in range(39)] + [(99, "e5"), (98, "x"), (98, "x")],
        [(k, f"e{k}") for k in range(80)] + [(100 + k, f"e{k}") for k in range(80)] + [(100 + k, f"e{k + 1}") for k in range(79)],  # a chain whose labels are no links
        [(r, f"e{e}") for r, e in np.random.default_rng(5).integers(0, 60, (70, 2)).tolist()],
    ],
)
def test_groups(spark, edges):
    df = spark.createDataFrame([(r, e, "clash") for r, e in edges] + [(500, None, ""), (None, "e1", "")], "id long, path string, label string")
    got = [(r.group, r.record) for r in splits.record_groups(df, "id", F.col("path")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_groups(edges)


def test_rounds_follow_the_logarithm(spark, monkeypatch):
    staged = []
    stage = splits.stage
    monkeypatch.setattr(splits, "stage", lambda df, name: staged.append(name) or stage(df, name))
    edges = [(k, f"e{k}") for k in range(80)] + [(100 + k, f"e{k}") for k in range(80)] + [(100 + k, f"e{k + 1}") for k in range(79)]
    splits.record_groups(spark.createDataFrame(edges, "id long, path string"), "id", F.col("path"))
    assert staged.count("step") <= 12


def test_groups_of_nothing_and_of_a_hot_entity(spark, monkeypatch):
    assert splits.record_groups(spark.createDataFrame([], "id long, path string"), "id", F.col("path")).count() == 0
    monkeypatch.setattr("wayledger.runtime.HOT_ROWS", 10)
    df = spark.range(3000).withColumn("path", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")))
    got = splits.record_groups(df, "id", F.col("path"))
    assert got.where("group = 0").count() == 1000 and got.count() == 3000


def test_split_shares_and_strata(spark):
    groups = spark.range(4000).select((F.col("id") - F.col("id") % 4).alias("group"), F.col("id").alias("record"))
    groups = groups.unionByName(spark.range(10_000, 10_500).select(F.lit(10_000).cast("bigint").alias("group"), F.col("id").alias("record")))
    strata = groups.select("record", F.when(F.col("group") % 100 < 8, "rare").otherwise("usual").alias("stratum")).unionByName(groups.select("record", F.lit(None).cast("string").alias("stratum")).limit(5))
    out = splits.split_assignment(groups, strata, {"a": 3, "b": 1}).toPandas()
    assert len(out) == 4500 and out.groupby("group").split.nunique().max() == 1
    assert abs((out.split == "a").mean() - 0.75) < 0.02
    rare = out[out.group % 100 < 8]
    assert abs((rare.split == "a").mean() - 0.75) < 0.06
    assert splits.split_assignment(groups.limit(0), strata, {"a": 1}).count() == 0
    with pytest.raises(ValueError):
        splits.split_assignment(groups, strata, {})


# --- 5: samples ------------------------------------------------------------------------------------------------


def test_groups_of_hot_links(spark, monkeypatch):
    rng = np.random.default_rng(11)
    edges = [(i, "hot") for i in range(0, 400, 2)] + [(i, f"e{rng.integers(0, 200)}") for i in range(400)] + [(7, f"e{k}") for k in range(0, 200, 5)]
    want = brute_groups(edges)
    df = spark.createDataFrame(edges, "id long, path string")
    monkeypatch.setattr("wayledger.runtime.HOT_ROWS", 20)
    for size in (1 << 20, 0):  # broadcast, salted
        monkeypatch.setattr("wayledger.runtime.HOT_BYTES", size)
        got = [(r.group, r.record) for r in splits.record_groups(df, "id", F.col("path")).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_every_label_value_is_spread(spark):
    rng = random.Random(6)
    groups = spark.createDataFrame([(i - i % 3, i) for i in range(6000)], "group long, record long")
    labels = [(i, f"often {i // 30 % 8}") for i in range(6000)] + [(i, f"some {rng.randrange(25)}") for i in range(0, 6000, 2)] + [(i, f"few {rng.randrange(20)}") for i in range(0, 6000, 12)]
    out = splits.split_assignment(groups, spark.createDataFrame(labels, "record long, stratum string"), {"train": 0.8, "test": 0.1, "validation": 0.1})
    placed = {r.record: r.split for r in out.collect()}
    assert abs(sum(s == "train" for s in placed.values()) / 6000 - 0.8) < 0.005
    for value in {v for _, v in labels}:
        own = [placed[i] for i, v in labels if v == value]
        assert abs(sum(s == "train" for s in own) / len(own) - 0.8) < 0.09 and abs(sum(s == "test" for s in own) / len(own) - 0.1) < 0.09


def test_split_pools_rare_strata(spark, monkeypatch):
    monkeypatch.setattr(splits, "STRATA", 1)
    groups = spark.createDataFrame([(i, i) for i in range(2000)], "group long, record long")
    strata = spark.createDataFrame([(i, "often") for i in range(300)] + [(i, f"rare {i}") for i in range(300, 400)], "record long, stratum string")
    placed = {r.record: r.split for r in splits.split_assignment(groups, strata, {"a": 0.5, "b": 0.5}).collect()}
    assert len(placed) == 2000 and abs(sum(placed[i] == "a" for i in range(300, 400)) - 50) <= 2


def units(spark, rows):
    return spark.createDataFrame(rows, "k0 string, k1 string, record long")


def test_sample_and_deficits(spark):
    rows = [("d", "big", i) for i in range(5000)] + [("d", "small", i) for i in range(3)] * 2 + [("d", None, 1), (None, "big", 1), ("d", "big", None), ("d", "unasked", 1)]
    targets = spark.createDataFrame([("D ", "Big", 700), ("d", "small", 5), ("d", "absent", 2), ("d", "zero", None), ("d", None, 4)], "dimension string, category string, want_rows long")
    s = ProportionalSample(units(spark, rows), targets, ["dimension", "category"])
    assert {tuple(r) for r in s.deficits().collect()} == {("d", "small", 5, 3), ("d", "absent", 2, 0), ("d", None, 4, 0)}
    drawn = s.draw().collect()
    assert len(drawn) == len(set(drawn)) == 703 and {r.category for r in drawn} == {"big", "small"}
    assert {r.k1: r.p < 0.2 for r in s.probabilities().collect()} == {"big": True, "small": False}
    again = ProportionalSample(units(spark, rows[::-1]), targets, ["dimension", "category"]).draw().collect()
    assert set(again) == set(drawn)


def test_sample_short_by_chance_is_offered_more(spark):
    rows = [("d", "c", i) for i in range(400)]
    targets = spark.createDataFrame([("d", "c", 100)], "dimension string, category string, want_rows long")
    s = ProportionalSample(units(spark, rows), targets, ["dimension", "category"], slack=-9.0)
    assert s.draw().count() == 100


def test_sample_of_nothing(spark):
    targets = spark.createDataFrame([("d", "c", 1)], "dimension string, category string, want_rows long")
    s = ProportionalSample(units(spark, []), targets, ["dimension", "category"])
    assert s.draw().count() == 0 and s.deficits().count() == 1
    empty = ProportionalSample(units(spark, [("d", "c", 1)]), targets.limit(0), ["dimension", "category"])
    assert empty.draw().count() == 0 and empty.deficits().count() == 0


def test_wanted_rows(spark):
    t = spark.createDataFrame([("a", 0.25, 3, 100), ("b", 0.001, 3, 100), ("c", None, None, None)], "k string, wanted_share double, min_rows long, sample_rows long")
    assert {r.k: r.want_rows for r in wanted_rows(t, ["k"]).collect()} == {"a": 25, "b": 3, "c": 0}


# --- 6: tokens --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.bpe_model(tokens.read_vocabulary(VOCABULARY)))


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=80), st.text("ab 'st\n\t é1<|>", max_size=120)))
def test_encodes_as_the_vocabulary_says(encoder, reference, text):
    ids = encoder.encode([text])[0]
    assert ids == reference(text)
    assert encoder.decode(ids) == text


def test_long_and_special_texts(encoder, reference):
    for text in ("a" * 20_000, "<|endoftext|>", " " * 3000, "​﻿", "日本語" * 500, "\x00\x01"):
        assert encoder.encode([text])[0] == reference(text)


def test_vocabulary_files_agree():
    assert tokens.read_vocabulary(VOCABULARY) == tokens.read_vocabulary(VOCABULARY.replace(".json", ".tiktoken"))


def test_corpus(spark, encoder):
    df = spark.createDataFrame([(1, "Hello world", 7), (2, "", 7), (3, None, 7), (4, "  ", 7), (1, "Hello world", 7)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode_corpus(df, "text", ["doc_id"], VOCABULARY).collect())
    assert got == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, []), (4, encoder.encode(["  "])[0])]
    _, decode = tokens.encoder_of(spark, VOCABULARY)
    texts = tokens.encode_corpus(df, "text", ["doc_id"], VOCABULARY).select(decode("ids").alias("t")).collect()
    assert sorted(r.t for r in texts) == ["", "", "  ", "Hello world", "Hello world"]
    assert tokens.encode_corpus(df.limit(0), "text", ["doc_id"], VOCABULARY).count() == 0


# --- 7: leaks ------------------------------------------------------------------------------------------------------


def brute_leaks(docs, items):
    out = set()
    for item, text in items:
        w = leaks.words(text)
        n = min(13, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for doc, body in docs:
            b = leaks.words(body)
            if any(tuple(b[i : i + n]) in grams for i in range(len(b) - n + 1)):
                out.add((doc, item))
    return out


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: rng.choice(["the", "road", "crack", "Rut", "12", "é", "of", "van"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 12, 13, 14, 30, 40, 13])] + [(90, None), (91, " --- "), (92, "")]
    docs = []
    for d in range(150):
        text = [word() for _ in range(rng.randrange(0, 60))]
        source = leaks.words(items[rng.randrange(12)][1])
        cut = rng.randrange(1, 20)
        at = rng.randrange(0, len(text) + 1)
        text[at:at] = source[:cut]
        docs.append((d, rng.choice([" ", "\n", " - "]).join(text).upper()))
    docs += [(900, None), (901, ""), (902, items[9][1]), (902, items[9][1]), (903, "­".join(items[9][1])), (904, "x " * 20_000 + items[10][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items + items[:2], "item_id long, text string")
    want = brute_leaks(docs, items)
    for bits in (leaks.MAP_BITS, 7):  # a map that lets most shingles pass changes nothing
        monkeypatch.setattr(leaks, "MAP_BITS", bits)
        got = [tuple(r) for r in leaks.leaked_items(d, "doc_id", "text", i, "item_id", "text").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert (904, 10) in want and (903, 9) in want


def test_leaks_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    i = spark.createDataFrame([("x", "a b")], "item_id string, text string")
    assert [tuple(r) for r in leaks.leaked_items(d, "doc_id", "text", i, "item_id", "text").collect()] == [(1, "x")]
    assert leaks.leaked_items(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert leaks.leaked_items(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_words():
    assert leaks.words("Café_No 5 Ａ​b ½") == ["café", "no", "5", "ab", "1", "2"]
    assert leaks.words(unicodedata.normalize("NFD", "été")) == ["été"]


# --- 8: stuffing ---------------------------------------------------------------------------------------------------

PROSE = [
    "The crew closed {a} on {b} because the drain had filled with sand again.",
    "Nobody could say why {b} was left open after the rain, so we asked the {a} once more.",
    "In {b} the {a} was wider than last year, and that cost us another morning.",
    "It took an hour to copy the {a} and longer to check it against the plan from {b}.",
]
PLACES, THINGS = ["Vale", "Mill", "North End", "Gorge", "Ford", "Lane"], ["kerb", "seal", "culvert", "sign", "verge", "rut"]
GOODS = ["cheap gravel", "tyre deals", "cone shop", "paint offer", "drone hire"]


def prose(rng, n):
    return " ".join(rng.choice(PROSE).format(a=rng.choice(THINGS), b=rng.choice(PLACES)) for _ in range(n))


def corpus(seed=3):
    rng = random.Random(seed)
    docs, stuffed = [], set()
    for d in range(400):
        kind = d % 10
        if kind == 0:
            text = ", ".join(rng.choice(GOODS) for _ in range(60))
        elif kind == 1:
            text = "\n".join(f"https://{rng.choice('abc')}.example/{rng.choice(GOODS).replace(' ', '-')}?id={rng.randrange(99)}" for _ in range(12)) + "\n" + prose(rng, 1)
        elif kind == 2:
            text = prose(rng, 9) + "\ntags: " + ", ".join(rng.sample(GOODS, 3))
        elif kind == 3:
            text = "\n".join(f"12:0{i % 6}:1{i % 9} INFO frame {rng.randrange(9999)} decoded in {rng.randrange(99)} ms" for i in range(25))
        elif kind == 4:
            text = "\n".join(f"| KD-{rng.randrange(99)} | {rng.randrange(9)}.{rng.randrange(9)} | {rng.randrange(99)} |" for _ in range(25))
        else:
            text = "\n\n".join(prose(rng, 3) for _ in range(4))
        if kind < 2:
            stuffed.add(d)
        docs.append((d, text))
    return docs, stuffed


def test_stuffed_pages(spark):
    docs, stuffed = corpus()
    extra = [(1000, None), (1001, ""), (1002, "  \n "), (1003, "?!"), (0, docs[0][1]), (1004, "cheap gravel, " * 9000)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs + extra], "doc_id long, text string, words string")
    rows = stuffing.stuffed_pages(df, "doc_id", "text").collect()
    assert {r.doc_id for r in rows} == stuffed | {1004} and len(rows) == len(stuffed) + 1
    assert all(r.word_share > 0.5 and r.char_share > 0.5 for r in rows)


def test_seeds_of_ordinary_words_stay_stuffed(spark):
    docs, stuffed = corpus()
    rng = random.Random(5)
    ordinary = ["the", "crew", "closed", "because", "drain", "filled", "nobody", "open", "rain", "year", "morning", "plan"]
    docs.append((2000, "\n".join(" ".join(rng.choice(ordinary) for _ in range(40)) for _ in range(8))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in stuffing.stuffed_pages(df, "doc_id", "text").collect()} == stuffed | {2000}


def test_joined_collocations_give_the_same(spark):
    docs, stuffed = corpus()
    docs += [(2001, ", ".join(GOODS)), (0, docs[0][1]), (2002, docs[0][1])]  # one repeats nothing, so only other pages can tell
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = [sorted(map(tuple, stuffing.stuffed_pages(df, "doc_id", "text", broadcast=n).collect())) for n in (stuffing.COLLOCATIONS, 0)]
    assert rows[0] == rows[1] and {r[0] for r in rows[1]} == stuffed | {2001, 2002}


def brute_stuffed(docs, rules):
    """Pages by the same rules, one word at a time; lines of up to a piece only, and no salad."""
    n_words, n_pairs, excess, read = Counter(), Counter(), Counter(), []
    for doc, text in docs:
        lines = stuffing.lines_of(text or "")
        stream, kept = [], []
        for k, line in enumerate(lines):
            tokens = stuffing.tokens_of([line])[:-1]
            counted = [t for t in tokens if t[0] not in ".!?"]
            numbers = sum(t[0].isdigit() for t in counted) / max(1, len(counted))
            prose = run = 0
            for t in tokens:
                if t[0] not in ".!?":
                    run += 1
                else:
                    prose, run = prose + (run if run >= rules.sentence else 0), 0
            linked = numbers < rules.numbers and stuffing.link_share(line) > rules.links
            kept.append((len(counted), len(line), linked))
            plain = numbers < rules.numbers and prose / max(1, len(counted)) < rules.prose and not linked
            stream += [(k, t.lower(), plain) for t in counted if not t[0].isdigit()]
        pairs = [(a[1], b[1]) for a, b in zip(stream, stream[1:])]
        here = Counter(pairs)
        n_words.update(w for _, w, _ in stream)
        n_pairs.update(pairs)
        many = max(rules.repeated, rules.repeated_share * len(pairs))
        excess.update(p for p, a, b in zip(pairs, stream, stream[1:]) if a[2] and b[2] and here[p] >= many)
        read.append((doc, kept, stream, pairs))
    total = n_pairs.total()
    bad = {p for p, n in n_pairs.items() if excess[p] and excess[p] >= rules.excess * n and math.log(n * total / (n_words[p[0]] * n_words[p[1]])) >= rules.pmi}
    out = set()
    for doc, kept, stream, pairs in read:
        hit = {i + k for i, p in enumerate(pairs) if p in bad for k in (0, 1)}
        stuffed = [0, 0]
        for k, (words, chars, linked) in enumerate(kept):
            own = [i for i, (at, _, _) in enumerate(stream) if at == k]
            if linked or own and len(hit.intersection(own)) >= rules.covered * len(own):
                stuffed = [stuffed[0] + words, stuffed[1] + chars]
        if kept and stuffed[0] > sum(x[0] for x in kept) / 2 and stuffed[1] > sum(x[1] for x in kept) / 2:
            out.add(doc)
    return out


def test_stuffed_pages_against_brute_force(spark):
    docs, _ = corpus(8)
    rng = random.Random(2)
    for d in range(3000, 3100):  # pages that are stuffed in part
        lines = [rng.choice([prose(rng, 1), ", ".join(rng.choice(GOODS) for _ in range(6)), f"RoadCone {rng.randrange(99)} tow_bar! cheap. Gravel?", "see www.a.example/x", "1) the rut", "Éa ß"]) for _ in range(8)]
        docs.append((d, "\r\n".join(lines)))
    rules = stuffing.Rules(salad_length=10**6, piece=10**6)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_stuffed(docs, rules)
    assert {r.doc_id for r in stuffing.stuffed_pages(df, "doc_id", "text", rules).collect()} == want
    assert 0 < len([d for d in want if d >= 3000]) < 100


def test_no_stuffing(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, prose(rng, 5)) for i in range(50)], "doc_id long, text string")
    assert stuffing.stuffed_pages(df, "doc_id", "text").count() == 0
    assert stuffing.stuffed_pages(df.limit(0), "doc_id", "text").count() == 0


def test_lines():
    assert stuffing.tokens_of(["#RoadCone tow_bar 12 G7! ÉtéÀ e.g. x.", "GPStracker"]) == ["Road", "Cone", "tow", "bar", "12", "G", "7", "!", "Été", "À", "e", "g", ".", "x", ".", "\n", "GPStracker", "\n"]
    assert stuffing.lines_of("x\n\n \r\ny") == ["x", "y"] and stuffing.tokens_of([]) == []
    assert stuffing.link_share("see https://a.example/b") > 0.5 and stuffing.link_share("3.5 of 7/9") == 0


def test_long_lines_are_judged_in_pieces(spark):
    docs, stuffed = corpus()
    rng = random.Random(4)
    many, few = (" ".join([prose(rng, n), *(rng.choice(GOODS) for _ in range(400))]) for n in (10, 200))
    df = spark.createDataFrame([*docs, (3000, many), (3001, few)], "doc_id long, text string")
    assert {r.doc_id for r in stuffing.stuffed_pages(df, "doc_id", "text").collect()} == stuffed | {3000}

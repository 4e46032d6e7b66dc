"""Near-duplicates, packing, mixing and languages."""

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.llm import language as L
from loomwork.llm import mixing, neardup, packing, tokens


def rules(seed=3, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 14))] for _ in range(60)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rng.shuffle(words)
        half = rng.randrange(len(words) + 1)
        rows.append((i * 3 + 1, " ".join(words[:half]).upper() or None, ", ".join(words[half:]) or rng.choice([None, ""]), "x", 1))
    return rows + [(9001, None, None, "x", 1), (9002, " ", "!?", "x", 1), (9003, None, "", "x", 1)]


SCHEMA = "rule_id long, rule string, why string, words string, class_id int"


def brute(rows, t=0.7):
    sets = {r[0]: frozenset(w for w in re.split(r"[\W_]+", f"{r[1] or ''} {r[2] or ''}".lower()) if w) for r in rows}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] | sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("block,frequent", [(2000, 1 / 500), (8, 1 / 10)])
def test_pairs_against_brute_force(spark, monkeypatch, block, frequent):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "FREQUENT", frequent)
    monkeypatch.setattr(neardup, "SMALL_TILE", min(block, 64) // 4)
    rows = rules()
    got = [tuple(r) for r in neardup.similar_pairs(spark.createDataFrame(rows, SCHEMA), "rule_id", "rule", "why").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


@pytest.mark.parametrize("block", [2000, 7])
def test_a_third_of_the_records_are_equal(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    same = "keep the log of the reader whole and never cut a line of it short"
    rows = rules(11, 100)
    rows += [(100_000 + 2 * i, same, None, "x", 1) for i in range(60)] + [(100_001 + 2 * i, same + " again", "", "x", 1) for i in range(20)]
    got = [tuple(r) for r in neardup.similar_pairs(spark.createDataFrame(rows, SCHEMA), "rule_id", "rule", "why").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_groups(spark):
    rows = rules(5, 120)
    edges = brute(rows)
    root = {r[0]: r[0] for r in rows}
    for _ in range(50):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.record: r.group_id for r in neardup.similar_groups(spark.createDataFrame(rows, SCHEMA), "rule_id", "rule", "why").collect()}
    assert got == {k: v for k, v in root.items() if k < 9000}


def test_no_rules(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert neardup.similar_pairs(empty, "rule_id", "rule", "why").count() == 0 and neardup.similar_groups(empty, "rule_id", "rule", "why").count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.integers(1, 9), st.sampled_from(["norm", "dot"]))
def test_best_fit_holds_every_constraint(sizes, most, rule):
    sizes = np.array(sizes, np.int64)
    bins = packing.best_fit(sizes, 64, most, attention=3000.0 if rule == "dot" else None, rule=rule) if len(sizes) else []
    for b in set(bins):
        inside = sizes[bins == b]
        assert inside.sum() <= 64 and len(inside) <= most
        if rule == "dot" and len(inside) > 1:
            assert (inside.astype(float) ** 2).sum() <= 3000 + 1e-6


def test_packing_is_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 50)
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, 1, 5, 40, 99, 100, 101, 250, 300]), "x") for i in range(400)]
    limits = spark.createDataFrame([(1, 100, 5), (2, 64, 5), (3, None, 5)], "limit_id int, capacity_tokens int, container int")
    rows = packing.packed(spark.createDataFrame(sizes, "doc_id long, tokens long, shard string"), limits).collect()
    for limit, capacity in ((1, 100), (2, 64)):
        mine = [r for r in rows if r.limit_id == limit]
        for doc, n, _ in sizes:
            parts = sorted((r.token_start, r.tokens, r.container) for r in mine if r.doc_id == doc)
            assert sum(p[1] for p in parts) == n and [p[0] for p in parts] == list(range(0, max(n, 1), capacity))
            assert (len(parts) == 1) == (n <= capacity) and all((p[2] is None) == (n == 0) for p in parts)
        used = {}
        for r in mine:
            if r.container:
                used[r.container] = used.get(r.container, 0) + r.tokens
        assert max(used.values()) <= capacity
    assert packing.packed(spark.createDataFrame([], "doc_id long, tokens long"), limits).count() == 0


def test_fill_is_tight(spark):
    rng = np.random.default_rng(2)
    sizes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(rng.lognormal(5, 1, 3000).clip(1, 5000))], "doc_id long, tokens long")
    got = packing.fill_report(packing.packed(sizes, spark.createDataFrame([(1, 2048)], "limit_id int, capacity_tokens int"))).first()
    assert got.used_share > 0.98 and got.most_used <= 2048


def mix(spark, rows, targets, **more):
    found = spark.createDataFrame(rows, "doc_id long, source string, tokens long, quality double, bucket string, key string")
    return mixing.mixed(found, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), **more)


def test_mix_meets_shares_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    rng = random.Random(4)
    rows = [(i, ["big", "mid", "small", None, "other"][min(4, i % 7)], rng.randrange(1, 40), rng.random(), "x", "y") for i in range(3000)] + [(9999, "big", 0, 0.5, "x", "y")]
    targets = [("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.1, 4), ("absent", 0.1, 2)]
    got = mix(spark, rows, targets)
    report = {r.source: r for r in mixing.shares(got, spark.createDataFrame(targets, "source string, target_share double, max_repeats int")).collect()}
    assert set(report) == {"big", "mid", "small", "absent"} and report["absent"].actual_share == 0
    for s, share, most in targets[:3]:
        assert abs(report[s].actual_share - share / 0.9) < 0.003 and report[s].most_copies <= most
    ids = [r.doc_id for r in got.collect()]
    assert len(ids) == len(set(ids)) and 9999 not in ids


def test_complete_epochs_come_first(spark):
    rows = [(1, "a", 10, 1.0, "", ""), (2, "a", 10, 1.0, "", ""), (3, "b", 100, 1.0, "", "")]
    got = {r.doc_id: r.copies for r in mix(spark, rows, [("a", 0.5, 9), ("b", 0.5, 1)], total_tokens=100).collect()}
    assert sorted((got[1], got[2])) == [2, 3] and got.get(3, 0) in (0, 1)
    assert mix(spark, [], [("a", 1.0, 1)]).count() == 0 and mix(spark, rows, []).count() == 0


def test_better_documents_come_sooner(spark):
    rows = [(i, "a", 1, 0.9 if i % 2 else 0.1, "", "") for i in range(4000)]
    got = [r.doc_id % 2 for r in mix(spark, rows, [("a", 1.0, 1)], total_tokens=1000).collect()]
    assert len(got) == 1000 and sum(got) > 800


def test_tokens_of_any_text(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "a" * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in tokens.sized(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 1000


EN = "the {0} reader keeps every line when the {0} file grows and nobody asked for it because the clock jumps again"
DE = "der {0} leser behält jede zeile wenn die {0} datei wächst und niemand danach gefragt hat weil die uhr springt"
FR = "le lecteur {0} garde chaque ligne quand le fichier {0} grandit et personne ne l'a demandé car l'horloge saute"


def documents(spark):
    rows = [(i, [EN, DE, FR][i % 3].format(f"word{i}") + ".", ["en", "DEU", "French-CA"][i % 3], "z") for i in range(90)]
    rows[3] = (3, rows[3][1], "de", "z")  # a wrong label
    rows += [
        (100, EN.format("x") + "\r\n \t\r\n" + DE.format("y") + "\n\n```\n" + EN.format("z") + "\n\nmore code\n```\n\n    indented code here\n\n22:40:02 level=warn at=x\n\n" + EN.format("q"), "en_GB", "z"),
        (101, None, "en", "z"), (102, "  \n\n ", None, "z"), (103, EN.format("u"), "xx", "z"), (104, DE.format("v") * 3000, None, "z"), (105, "ok", "n/a", "z"),
    ]
    codes = spark.createDataFrame([("en", "eng", "English"), ("de", "deu", "German"), ("fr", "fra", "French")], "code2 string, code3 string, english_name string")
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, label string"), codes


def test_languages(spark):
    docs, codes = documents(spark)
    per = L.paragraph_languages(docs, codes)
    wrong = {tuple(r) for r in L.wrong_or_missing(per).collect()}
    assert wrong == {(3, 0, "en"), (100, 1, "de"), (103, 0, "en"), (104, 0, "de")}
    parts = {r.para_no: r.lang for r in per.where("doc_id = 100").collect()}
    assert parts == {0: "en", 1: "de", 2: None, 3: None, 4: None, 5: None, 6: "en"}
    whole = {r.doc_id: (r.lang, r.languages) for r in L.document_languages(docs, codes).collect()}
    assert len(whole) == docs.count() and whole[101] == (None, 0) and whole[102] == (None, 0) and whole[100] == ("en", 2) and whole[105] == (None, 0)
    assert L.paragraph_languages(docs.limit(0), codes).count() == 0 and L.wrong_or_missing(L.paragraph_languages(docs, codes.limit(0))).count() == 0


def test_held_out_accuracy(spark, sf):
    """Dictionaries from one half of the labelled documents, the other half classified; labels are wrong for a part of them."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.label, r.text) for r in L.usable_labels(d, spark.read.parquet(f"{sf}/lang_codes.parquet")).where("label is not null and text is not null").orderBy(F.xxhash64("doc_id")).collect()]
    model = L.fit(rows[::2])
    got = [(label, model.classify(p)[0]) for label, text in rows[1::2] if label in model.codes for p in L.proses(text) if p]
    assert sum(a == b for a, b in got) / len(got) > 0.75


def test_long_texts_are_classified_whole():
    import random

    rng = random.Random(5)
    mixed = lambda t: " ".join(rng.choice(t.format("x").split()) for _ in range(60_000))
    model = L.Languages({"en": EN.format("a") * 3, "de": DE.format("a") * 3, "fr": FR.format("a") * 3})
    assert [model.classify(mixed(t))[0] for t in (EN, DE, FR)] == ["en", "de", "fr"]


def test_narrow_margins_are_rejected():
    model = L.Languages({"aa": "lorem ipsum dolor sit amet " * 20, "bb": "lorem ipsum dolor sit amet " * 20})
    assert model.classify("lorem ipsum dolor sit amet") == (None, 0.0)
    assert L.Languages({}).classify("some text") == (None, 0.0)


def test_attention_binds_and_large_texts_are_alone(spark):
    sizes = spark.createDataFrame([(i, t) for i, t in enumerate([60, 40] * 20 + [90, 10])], "doc_id long, tokens long")
    limits = spark.createDataFrame([(1, 100)], "limit_id int, capacity_tokens int")

    def containers(**how):
        per = {}
        for r in packing.packed(sizes, limits, **how).collect():
            per.setdefault(r.container, []).append(r.tokens)
        assert sum(map(len, per.values())) == 42
        return sorted(sorted(ts) for ts in per.values())

    assert containers(attention_share=1.0) == sorted([[40, 60]] * 20 + [[10, 90]])
    # 81 % of the capacity's square is above the share: 90 is alone, and 10 beside neither it nor 60 and 40
    assert containers(attention_share=0.8) == sorted([[40, 60]] * 20 + [[90], [10]])
    assert all(sum(t * t for t in ts) <= 4000 for ts in containers(attention_share=0.4) if len(ts) > 1)
    report = packing.fill_report(packing.packed(sizes, limits, attention_share=0.8), 0.8).first()
    assert (report.alone, report.containers, report.most_attention) == (1, 22, 0.65)
    assert packing.ATTENTION_SHARE < 1


def test_ranges_of_keys_hold_with_documents_of_floor_quality(spark, monkeypatch):
    """Two thirds of a source at the floor of quality, as keys twenty times as large: no range holds much more than another."""
    monkeypatch.setattr(mixing, "BUCKET", 200)
    rng = random.Random(9)
    rows = [(i, "big", rng.randrange(1, 30), 0.05 if i % 3 else 1.0, "x", "y") for i in range(6000)]
    seen = []
    real = mixing.ranged
    monkeypatch.setattr(mixing, "ranged", lambda df, n: seen.append(real(df, n)) or seen[0])
    got = mix(spark, rows, [("big", 1.0, 1)], total_tokens=30_000)
    assert abs(got.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] - 30_000) < 30
    sizes = [r["count"] for r in seen[0].groupBy("bucket").count().collect()]
    assert len(sizes) >= 25 and max(sizes) < 3 * 200
    spans = sorted((r.lo, r.hi) for r in seen[0].groupBy("bucket").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect())
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_short_paragraphs_are_judged_by_their_margin():
    model = L.Languages({"en": EN.format("a") * 3 + " thank you very much indeed", "de": DE.format("a") * 3 + " herzlichen dank", "fr": FR.format("a") * 3})
    assert L.proses("Danke\n\nok.") == ["danke", "ok"]
    assert [model.classify(p)[0] for p in ("chaque ligne", "thank you", "ok")] == ["fr", "en", None]


def test_the_sample_has_a_quota_a_language(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_DOCUMENTS", 60)
    seen = []
    monkeypatch.setattr(L, "fit", lambda rows: seen.extend(rows) or L.Languages({}))
    rows = [(i, EN.format(f"w{i}") * 500, "en") for i in range(900)] + [(1000 + i, DE.format(f"w{i}"), "de") for i in range(25)] + [(2000, "un seul", "fr")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label string")
    L.fitted(labelled)
    count = lambda code: sum(label == code for label, _ in seen)
    assert (count("en"), count("de"), count("fr")) == (20, 20, 1) and max(len(t) for _, t in seen) <= L.SAMPLE_CHARS


def test_a_language_without_confirmed_samples_does_not_stop_the_cleaning():
    rows = [("en", EN.format(f"w{i}")) for i in range(12)] + [("de", DE.format(f"w{i}")) for i in range(12)] + [("de", EN.format(f"x{i}")) for i in range(2)] + [("xx", "lorem")]
    model = L.fit(rows)
    assert set(model.codes) == {"en", "de", "xx"} and "keeps every line" not in model.content["de"]

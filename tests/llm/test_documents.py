import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import mixing, packing, subjects
from quern.llm.tokens import count_tokens, encoder

# packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=15), st.integers(40, 90))
def test_patterns_hold_every_item_once(histogram, capacity):
    used, containers = Counter(), 0
    for pattern, n in packing.pack_histogram(histogram, capacity):
        assert sum(length * k for length, k in pattern) <= capacity
        containers += n
        for length, k in pattern:
            used[length] += k * n
    assert dict(used) == histogram
    total = sum(k * v for k, v in histogram.items())
    assert containers <= 2 * total / capacity + 1


def test_tight_fill():
    r = random.Random(3)
    histogram = Counter(min(2048, max(1, int(r.lognormvariate(5.5, 0.8)))) for _ in range(20_000))
    patterns = packing.pack_histogram(histogram, 2048)
    assert sum(k * v for k, v in histogram.items()) / (2048 * sum(n for _, n in patterns)) > 0.98


def test_documents_are_whole_unless_too_long(spark):
    rows = [(i, (i * 37) % 90 + 1) for i in range(300)] + [(1000, 250), (1001, 100), (1002, 0)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    packed = packing.pack(sizes, 100).collect()
    load, pieces = Counter(), Counter()
    for p in packed:
        load[p.container] += p.length
        pieces[p.doc_id] += p.length
    assert max(load.values()) <= 100 and set(load) == set(range(len(load)))
    assert dict(pieces) == {d: n for d, n in rows if n}
    assert {p.doc_id for p in packed if p.piece} == {1000}
    assert sorted((p.start, p.length) for p in packed if p.doc_id == 1000) == [(0, 100), (100, 100), (200, 50)]


def test_ranks_of_a_hot_length(spark):
    items = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(7).cast("bigint").alias("length"))
    old, packing.BLOCK = packing.BLOCK, 500
    try:
        ranks = sorted(r.rank for r in packing.ranked(items, 5000).collect())
    finally:
        packing.BLOCK = old
    assert ranks == list(range(5000))


def test_jobs_and_tokens(spark):
    d = spark.createDataFrame([(1, "hello world, hello"), (2, None), (3, ""), (4, "x " * 3000)], "doc_id bigint, text string")
    sizes = {r.doc_id: r.n_tokens for r in count_tokens(d, ["doc_id"]).collect()}
    assert sizes == {1: len(encoder().encode_ordinary("hello world, hello")), 3: 0, 4: len(encoder().encode_ordinary("x " * 3000))}
    assert encoder().decode(encoder().encode_ordinary("Zürich <|endoftext|> 東京")) == "Zürich <|endoftext|> 東京"
    jobs = spark.createDataFrame([("a", 64), ("b", None), ("c", 0)], "job_name string, capacity_tokens int")
    packed = packing.pack_jobs(d, jobs)
    assert {r.job_name for r in packed.select("job_name").distinct().collect()} == {"a"}
    assert packing.fill_report(packed, jobs).first().fill > 0.9
    assert packing.pack_jobs(d.limit(0), jobs).count() == 0


# mixing


def corpus(spark):
    rows = [(i, ("big", "mid", "tiny")[0 if i % 10 < 6 else 1 if i % 10 < 9 else 2], "word " * (5 + i % 30), 0) for i in range(2000)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, extra int")


def test_shares_caps_and_absent_sources(spark):
    targets = spark.createDataFrame([("m", "big", 1.0, 2), ("m", "mid", 1.0, 3), ("n", "big", 0.5, 1), ("n", "tiny", 0.5, 2), ("o", "gone", 1.0, 2), ("p", "mid", None, 2)], "mix_name string, source string, target_share double, max_repeats int")
    members = mixing.membership(corpus(spark), targets)
    drawn = mixing.draw(members, targets)
    report = {(r.mix_name, r.source): r for r in mixing.report(drawn, members, targets).collect()}
    assert report["m", "big"].actual_share == pytest.approx(0.5, abs=0.01) and report["m", "mid"].actual_share == pytest.approx(0.5, abs=0.01)
    assert report["n", "tiny"].most_copies == 2 and report["n", "tiny"].drawn_tokens == 2 * report["n", "tiny"].available_tokens
    assert report["n", "big"].most_copies == 1 and report["o", "gone"].drawn_tokens == 0
    most = drawn.groupBy("mix_name", "source").agg(F.max("copies").alias("c")).collect()
    assert all(r.c <= {("m", "big"): 2, ("m", "mid"): 3, ("n", "big"): 1, ("n", "tiny"): 2}[r.mix_name, r.source] for r in most)
    assert drawn.count() == drawn.select("mix_name", "doc_id").distinct().count()
    again = mixing.draw(members, targets).exceptAll(drawn)
    assert again.count() == 0


def test_missing_sources_are_predicted(spark):
    rows = [(i, "abc"[i % 3], ("apple pear plum. ", "stone iron gold. ", "river lake sea. ")[i % 3] * 5) for i in range(300)] + [(1000, None, "apple plum pear."), (1001, None, "iron gold."), (1002, None, "apple pear iron gold."), (1003, None, "12 34")]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("m", "a", 1.0, 2), ("m", "b", 1.0, 2)], "mix_name string, source string, target_share double, max_repeats int")
    members = mixing.membership(d, targets)
    got = {r.doc_id: r.posterior for r in members.where("doc_id >= 1000").collect()}
    assert got[1000][0] > 0.9 and got[1001][1] > 0.9 and got[1002][0] == pytest.approx(0.5, abs=0.3) and got[1003] == pytest.approx([1 / 3] * 3, abs=0.01)
    assert all(sum(p) == pytest.approx(1) for p in got.values())
    report = {r.source: r for r in mixing.report(mixing.draw(members, targets), members, targets).collect()}
    assert report["a"].actual_share == pytest.approx(0.5, abs=0.03) and report["b"].available_tokens > 0


def test_a_large_document_leaves_no_gap(spark):
    """One document holds most of a source: the others are repeated instead of falling short."""
    rows = [(0, "s", "word " * 1500), *[(i, "s", "word " * 25) for i in range(1, 21)], *[(100 + i, "t", "word " * 30) for i in range(60)]]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("m", "s", 0.4, 5), ("m", "t", 0.6, 2)], "mix_name string, source string, target_share double, max_repeats int")
    members = mixing.membership(d, targets)
    for total in (None, 2500.0):
        drawn = mixing.draw(members, targets, total)
        report = {r.source: r for r in mixing.report(drawn, members, targets).collect()}
        assert report["s"].actual_share == pytest.approx(0.4, abs=0.02)
        assert drawn.where("copies > case when source = 's' then 5 else 2 end").count() == 0


def test_a_tiny_source_bounds_the_total(spark):
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "mid", 0.4, 1), ("m", "tiny", 0.1, 1), ("m", "gone", 0.3, 9)], "mix_name string, source string, target_share double, max_repeats int")
    members = mixing.membership(corpus(spark), targets)
    for r in mixing.report(mixing.draw(members, targets), members, targets).collect():
        assert r.actual_share == pytest.approx(r.reachable_share, abs=0.01) and r.limited_by == ("absent" if r.source == "gone" else r.limited_by)


def test_empty_corpus(spark):
    targets = spark.createDataFrame([("m", "big", 1.0, 2)], "mix_name string, source string, target_share double, max_repeats int")
    members = mixing.membership(corpus(spark).limit(0), targets)
    drawn = mixing.draw(members, targets)
    assert drawn.count() == 0 and mixing.report(drawn, members, targets).first().actual_share == 0.0


def test_draws_follow_the_rate_of_each_document(spark):
    """Documents of one likeliest source whose posteriors, and so rates, differ are not drawn alike."""
    rows = [(i, "a", 10, 0, None) for i in range(1000)] + [(1000 + i, "b", 10, 1, None) for i in range(100)] + [(2000 + i, None, 10, 0, [0.6, 0.4, 0.0]) for i in range(1000)]
    members = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, domain int, posterior array<double>")
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 1)], "mix_name string, source string, target_share double, max_repeats int")
    drawn = mixing.draw(members, targets, 4000.0)
    for r in mixing.report(drawn, members, targets).collect():
        assert r.actual_share == pytest.approx(0.5, abs=0.02) and r.drawn_tokens == pytest.approx(2000, abs=100)
    assert drawn.where("copies > 1").count() == 0


def test_texts_that_tell_nothing_leave_the_prior(spark):
    """Words that no source has to itself are no evidence; a source without documents gets no part of those of missing source."""
    r = random.Random(11)
    vocabulary = [a + b for a in ("ab", "cor", "del", "fen", "gul") for b in ("an", "el", "im", "os", "ur", "ax")]
    rows = [(i, ("a" if i % 4 else "b") if i < 400 else None, " ".join(r.choice(vocabulary) for _ in range(80)) + ".") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.3, 2), ("m", "gone", 0.2, 2)], "mix_name string, source string, target_share double, max_repeats int")
    members = mixing.membership(d, targets)
    guessed = [row.posterior for row in members.where("source is null").collect()]
    assert len(guessed) == 200 and all(p[0] == pytest.approx(0.75, abs=0.1) and p[2] == p[3] == 0 for p in guessed)
    report = {row.source: row for row in mixing.report(mixing.draw(members, targets), members, targets).collect()}
    assert report["gone"].limited_by == "absent" and report["a"].reachable_share == pytest.approx(0.625)


# subjects


def test_sentences():
    text = "## user\nIs it so? Yes, in src/a.py.\n\n[agent] Fine… « Bon » ?\n- Done.\n> User: ok then!"
    assert subjects.sentences(text) == ["Is it so?", "Yes, in src/a.py.", "Fine…", "« Bon » ?", "Done.", "ok then!"]


def test_held_out_documents(spark):
    r = random.Random(5)
    words = {"law": "court judge verdict appeal statute".split(), "sport": "goal striker coach league penalty".split(), "music": "chord tempo violin concert tune".split()}
    filler = ["The session was resumed.", "Please keep it short.", "I saved the draft.", "Shall I continue?"]

    def document(labels):
        out = []
        for s in labels:
            out += [f"We looked at the {r.choice(words[s])} and the {r.choice(words[s])}." for _ in range(4)]
        out += [r.choice(filler) for _ in range(5)]
        r.shuffle(out)
        return " ".join(out)

    truth = {i: r.choice([["law"], ["sport"], ["music"], ["law", "music"], []]) for i in range(300)}
    docs = spark.createDataFrame([(i, document(t), "en") for i, t in truth.items()] + [(900, None, "en"), (901, "  ", None)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, s) for i, t in truth.items() if i < 80 for s in t] + [(5555, "law"), (1, "nothing")], "doc_id bigint, subject string")
    names = spark.createDataFrame([(s, "") for s in words], "subject string, scope_note string")
    got = {}
    for row in subjects.found(docs, labels, names).collect():
        got.setdefault(row.doc_id, set()).add(row.subject)
    held = [i for i in truth if i >= 80]
    assert sum(got.get(i, set()) == set(truth[i]) for i in held) / len(held) > 0.9
    assert 900 not in got and 901 not in got

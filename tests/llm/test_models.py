"""The learned operators against plain versions: training blocks, thresholds over all rows, contexts, odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from reviewlake.llm import op02_language, op04_quality, op05_toxicity
from reviewlake.llm.common import HASH_PLACES, fit_logistic, held_out, known_labels, labelled_sample, ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string, held_out string, h string"


def frame(spark, rows):
    """(doc_id, text, lang) with columns named like results."""
    ship(spark)
    return spark.createDataFrame([(i, t, x, "s", None, 0.5, "p", "q", "h") for i, t, x in rows], SCHEMA).repartition(3)


def trained(ids):
    return [i for i in ids if zlib.crc32(str(i).encode()) % 3 != 1]


# --- language ----------------------------------------------------------------------------------


def test_training_blocks_come_from_anywhere_in_a_text(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    ids = trained(range(50))
    rows = frame(spark, [(ids[0], long, "aa"), (ids[1], long, "aa"), (ids[2], "short text", "aa"), (ids[3], None, "aa"), (ids[4], "", "bb")])
    blocks = rows.select("text", F.xxhash64("text").alias("hash"), op02_language.blocks("text").alias("b")).filter("text is not null").collect()
    size, count = op02_language.BLOCK_CHARS, op02_language.SAMPLE_BLOCKS
    picked = {r.text: r.b for r in blocks}
    assert picked["short text"] == "short text" and picked[""] == ""
    parts = [picked[long][i * (size + 1) : i * (size + 1) + size] for i in range(count)]
    places = [long.index(p) for p in parts]
    assert places == sorted(places) and places[-1] > 2_000 and len(picked[long]) == count * (size + 1) - 1
    (name, data), *_ = op02_language.learn(rows)
    assert name == "aa" and len(data) < 2 * size * count  # copies count once


def test_the_smallest_encoding_wins(spark):
    rng = random.Random(4)
    vocabulary = {x: ["".join(rng.choice(a) for _ in range(rng.randrange(5, 10))) for _ in range(60)] for x, a in (("aa", "abcdefg"), ("bb", "efghijk"))}
    rows = [(i, " ".join(rng.choice(vocabulary[x]) for _ in range(60)), x) for i, x in enumerate("aa bb".split() * 30)]
    rows += [(900, None, "aa"), (901, "12 34", "bb"), (None, rows[0][1], "aa"), (5, rows[5][1], "bb"), (902, rows[1][1] * 300, None)]
    docs = frame(spark, rows)
    dictionaries = op02_language.learn(docs.filter(~held_out(F.col("doc_id"))))
    got = op02_language.predict_languages(docs, dictionaries).collect()
    assert len(got) == len(rows)

    def plain(text):
        data = op02_language.plain(text).encode()
        if not data:
            return "und"
        sizes = []
        for _, d in dictionaries:
            whole = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            packer = zstandard.ZstdCompressor(level=op02_language.LEVEL, dict_data=whole)
            step = op02_language.BLOCK_BYTES
            sizes.append(sum(len(packer.compress(data[i : i + step])) for i in range(0, len(data), step)))
        return dictionaries[sizes.index(min(sizes))][0]

    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == sorted((str(i), plain(t)) for i, t, _ in rows)
    assert all(0 <= r.score <= 1 for r in got)
    known = {i: x for i, _, x in rows[:60]}
    wrong = [r.doc_id for r in got if r.doc_id in known and r.lang_pred != known[r.doc_id]]
    assert not wrong


# --- samples -----------------------------------------------------------------------------------


def test_a_sample_is_the_rows_below_a_hash_share(spark):
    ids = list(range(3_000))
    docs = frame(spark, [(i, f"text {i}", None) for i in ids] + [(7, "text 7 again", None), (7, "text 7", None), (None, "no id", None)])
    marks = spark.createDataFrame([(i, int(i % 10 == 0)) for i in ids] + [(7, 1), (8, None), (None, 1)], "doc_id long, toxic int")
    sample = labelled_sample(docs, marks, "toxic", 100)
    label = {i: int(i % 10 == 0 or i == 7) for i in trained(ids)}
    size = {x: sum(v == x for v in label.values()) for x in (0, 1)}
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(HASH_PLACES)).alias("h")).collect()}
    want = sorted(i for i, x in label.items() if hashes[i] < 100 * HASH_PLACES // size[x])
    got = sorted(int(r.text.split()[1]) for r in sample.collect())
    assert got == want and 120 < len(got) < 280
    assert labelled_sample(docs, marks.limit(0), "toxic", 100).count() == 0
    every = labelled_sample(docs, marks, "toxic", 10_000)  # fewer than wanted: all, an id with several texts once
    assert every.count() == len(label) and every.filter("text in ('text 7', 'text 7 again')").count() == (7 in label)


# --- quality -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeilnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    good = [" ".join(rng.choice(words) for _ in range(rng.randrange(40, 90))).capitalize() + "." for _ in range(90)]
    bad = [" ".join(rng.choice(["#", "$$", "buy", "now", rng.choice(words)]) for _ in range(rng.randrange(5, 60))) for _ in range(30)]
    rows = [(i, t, None) for i, t in enumerate(good + bad)]
    odd = [(1000, None, None), (1001, "", None), (1002, good[0] * 400, None), (0, good[0], None), (None, good[0], None)]
    docs = frame(spark, rows + odd)
    marks = spark.createDataFrame([(i, int(i < 90)) for i, _, _ in rows], "doc_id long, quality int")
    return docs, marks


def test_pairwise_weights_and_threshold_by_plain_solvers(spark, judged):
    docs, marks = judged
    labelled = docs.select("doc_id", "text").join(known_labels(marks, "quality"), "doc_id")
    sample = labelled_sample(docs, marks, "quality", 5_000)
    model = op04_quality.learn(sample, labelled)
    # the loss of preference pairs, by plain gradient descent
    x = np.array([op04_quality.features(r.text) for r in sample.collect()])
    y = np.array([r.label for r in sample.collect()])
    x = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    order = np.lexsort(np.array([op04_quality.features(r.text) for r in sample.collect()]).T)
    x, y = x[order], y[order]
    pick = np.random.default_rng(op04_quality.SEED)
    n = min(op04_quality.MAX_PAIRS, int((y == 1).sum() * (y == 0).sum()))
    pairs = x[y == 1][pick.integers(0, (y == 1).sum(), n)] - x[y == 0][pick.integers(0, (y == 0).sum(), n)]
    def loss(w):
        return np.logaddexp(0, -pairs @ w).sum() + 0.5 * w @ w

    w, rate = np.zeros(x.shape[1]), 1e-3
    for _ in range(20_000):
        step = w - rate * (-(pairs / (1 + np.exp(np.clip(pairs @ w, -30, 30)))[:, None]).sum(axis=0) + w)
        w, rate = (step, rate * 1.1) if loss(step) <= loss(w) else (w, rate / 2)
    assert loss(model["weights"]) <= loss(w) + 1e-6 and loss(w) < loss(model["weights"]) * 1.05 + 0.05
    # the threshold, over all labelled rows
    rows = labelled.collect()
    strengths = sorted((((np.array(op04_quality.features(r.text)) - model["centre"]) / model["spread"]) @ model["weights"]) for r in rows)
    share = sum(r.label == 0 for r in rows) / len(rows)
    at = strengths[max(math.ceil(share * len(rows)) - 1, 0)]
    after = min(s for s in strengths if s > at + 1e-9)
    assert model["threshold"] == pytest.approx((at + after) / 2, abs=1e-6)


def test_quality_of_odd_rows(spark, judged):
    docs, marks = judged
    for some in (marks, marks.filter("quality = 1"), marks.limit(0)):
        labelled = docs.select("doc_id", "text").join(known_labels(some, "quality"), "doc_id")
        model = op04_quality.learn(labelled_sample(docs, some, "quality", 5_000), labelled)
        got = docs.select("doc_id", op04_quality.score(F.col("text"), model).alias("score")).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        same = {r.score for r in got if r.doc_id in (0, None)}
        assert len(same) == 1  # a repeated row and one without an id
        assert {r.score for r in got if r.doc_id == 1000} == {r.score for r in got if r.doc_id == 1001}
    assert {r.score for r in got} == {0.5}  # without any label
    empty = docs.limit(0)
    labelled = empty.select("doc_id", "text").join(known_labels(marks, "quality"), "doc_id")
    assert op04_quality.learn(labelled_sample(empty, marks, "quality", 50), labelled)["threshold"] == 0


def test_the_threshold_meets_no_texts(spark, judged, monkeypatch):
    """Labels meet strengths, so texts are not moved; scores are those of a threshold over joined texts."""
    docs, marks = judged
    docs = docs.unionByName(docs.filter("doc_id < 9"))  # repeated ids count as often as they occur
    sample, plans, real = labelled_sample(docs, marks, "quality", 5_000), [], op04_quality.threshold

    def seen(found):
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return real(found)

    monkeypatch.setattr(op04_quality, "threshold", seen)
    got = op04_quality.scored(docs, marks, sample).collect()
    assert len(plans) == 1 and "strength" in plans[0] and "text" not in plans[0]
    labelled = docs.select("doc_id", "text").join(known_labels(marks, "quality"), "doc_id")
    model = op04_quality.learn(sample, labelled)
    plain = docs.select("doc_id", op04_quality.score(F.col("text"), model).alias("score")).collect()
    key = lambda r: (str(r.doc_id), r.score)
    assert sorted(got, key=key) == sorted(plain, key=key)
    for some in (marks.filter("quality = 0"), marks.limit(0)):
        got = op04_quality.scored(docs, some, labelled_sample(docs, some, "quality", 5_000)).collect()
        assert len(got) == docs.count() and len({r.score for r in got}) == 1


# --- toxicity ----------------------------------------------------------------------------------


def test_quotation_is_told_from_abuse():
    automaton = op05_toxicity.LexiconAutomaton([("wretch", False), ("oaf", False)])

    def kind(text):
        return ["abuse", "misspelled", "quoted", "weak", "thin"][int(np.argmax(op05_toxicity.inputs(text, automaton)))]

    assert kind("you filthy wretch!") == "abuse"
    for text in ('"you filthy wretch!" stood there', "„you, wretch. go!“", "«a wretch»", "‘such a wretch’ he read", "the 'old wretch' song"):
        assert kind(text) == "quoted", text
    assert kind("the man said: fine. you wretch") == "abuse"
    assert kind("the man said you wretch") == "quoted"
    assert kind("er sagte du wretch") == "quoted"
    assert kind('5" wide, you wretch') == "abuse"  # one mark is no pair
    assert kind('"fine" you wretch "well"') == "abuse"
    assert kind('"line\nyou wretch"') == "abuse"
    assert kind("don't, wretch, don't") == "abuse"
    assert kind("w r e t c h") == kind("go w-r-e-t-c-h now") == "misspelled"
    assert kind("an oaf") == "abuse"
    thin = op05_toxicity.LexiconAutomaton([("wretch", False), ("grobian", False), ("knav", True)], frozenset({"grobian", "knav"}))
    assert [thin.match(w) for w in ("wretch", "wretsh", "grobian", "grobixn", "knaves")] == [1, 2, 4, 3, 4]
    assert not any(op05_toxicity.inputs("an oat, a loaf, w r e n c h, 5 6 7 8", automaton))


def test_lexicon_learns_short_and_long_words(spark):
    long = "x" + "ab" * 20
    rows = [(f"neutral words here {i} gob {long}", 1) for i in range(12)] + [(f"neutral words here {i} and", 0) for i in range(1000)]
    terms = dict(op05_toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int")))
    automaton = op05_toxicity.LexiconAutomaton(list(terms.items()))
    assert automaton.match("gob") == 1 and automaton.match(long) == 1 and not automaton.match("words")


def test_toxic_scores_equal_a_plain_version(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeilnorstu") for _ in range(rng.randrange(3, 9))) for _ in range(500)]
    rows = []
    for i in range(240):
        text = [rng.choice(words) for _ in range(30)]
        if i % 6 == 0:
            text.insert(rng.randrange(31), "wretch" if i % 4 else "scoundrel")
        rows.append((i, " ".join(text), None))
    odd = [(1000, None, None), (1001, "", None), (1002, "fine words " * 9000 + "wretch", None), (6, rows[6][1], None), (None, "you wretch", None)]
    docs = frame(spark, rows + odd)
    marks = spark.createDataFrame([(i, int(i % 6 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    model = op05_toxicity.train(docs, marks)
    terms = {t for t, _ in model["lexicon"]}
    assert any("wretch".startswith(t) for t in terms) and any("scoundrel".startswith(t) for t in terms)
    got = docs.select("doc_id", "text", op05_toxicity.score(F.col("text"), model).alias("score")).collect()

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, z in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != z)))
        return row[-1]

    def plain(text):
        counts = [0] * 5
        for w in (text or "").split():
            same = [t in model["thin"] for t, stem in model["lexicon"] if (w.startswith(t) if stem else w == t)]
            near = [len(t) == 4 or t in model["thin"] for t, stem in model["lexicon"] if not stem and len(t) > 3 and len(w) > 3 and edits(w, t) == 1]
            if same:
                counts[4 if all(same) else 0] += 1
            elif near:
                counts[3 if all(near) else 1] += 1
        return 1 / (1 + math.exp(-(model["weights"][0] + np.log1p(counts) @ model["weights"][1:])))

    for r in got:
        assert r.score == pytest.approx(plain(r.text)), r.text[:80]
    kept = op05_toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    toxic = {r.doc_id for r in got if r.score >= op05_toxicity.THRESHOLD}
    assert toxic == {i for i in range(240) if i % 6 == 0} | {None, 1002}
    assert kept.count() == len(got) - sum(r.score >= op05_toxicity.THRESHOLD for r in got)
    for none in (marks.limit(0), marks.filter("toxic = 0"), marks.filter("toxic = 1")):
        assert op05_toxicity.keep_clean(docs, op05_toxicity.train(docs, none)).count() == len(got)
    assert op05_toxicity.keep_clean(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("stage", ["toxicity", "quality_rules", "repeated_passages", "packing"])
def test_stages_take_odd_rows(spark, stage, tmp_path):
    texts = [None, "", " ", "z" * 300_000, "one line\n" * 40, "plain words of a clean text that goes on for a while and then ends"]
    docs = frame(spark, [(i, t, None) for i, t in enumerate(texts)] + [(None, texts[5], None), (5, texts[5], None)])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, str(tmp_path))
    if stage == "toxicity":
        assert out.count() == 8
    elif stage == "quality_rules":
        assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 5, 5]
    elif stage == "repeated_passages":
        assert out.count() == 8 and {len(r.text) for r in out.filter("doc_id = 3").collect()} == {1}
    else:
        assert out.agg(F.sum("length")).first()[0] >= 8
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0

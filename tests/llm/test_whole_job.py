"""Cases of the second review: what an operator's bound or shortcut left out."""

import random

import pytest

import corpus_pipeline
from reviewlake.llm import op03_suffixes, op05_toxicity, op09_simhash
from reviewlake.llm.common import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def copies():
    """Texts of 250 words, each with near copies by changed words; (id, text)."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeilnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    rows = []
    for of in range(12):
        text = [rng.choice(words) for _ in range(250)]
        rows.append((of * 10, " ".join(text)))
        for copy, changed in enumerate((3, 4, 5, 9), 1):
            other = list(text)
            for i in range(changed):
                other[15 + i * 250 // changed] = f"new{of}{copy}{i}"
            rows.append((of * 10 + copy, " ".join(other)))
    return rows


def test_pipeline_drops_near_copies_by_simhash(spark, copies):
    ship(spark)
    prints = {i: op09_simhash.simhash(t) for i, t in copies}
    near = {(a, b) for a, x in prints.items() for b, y in prints.items() if a < b and (x ^ y).bit_count() <= op09_simhash.RADIUS}
    assert near
    root = {i: i for i, _ in copies}
    for _ in copies:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    odd = [(500, None), (501, ""), (502, "few words"), (503, "Few  words"), (None, copies[0][1]), (None, "no id " * 3), (None, "no id " * 3)]
    rows = [(i, t, None, "s", None) for i, t in [*copies, *odd]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    want = [i for i in root if root[i] == i] + [500, 502, None]
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i in want)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


CLASHES = "n_removed n_bytes n_spans kept _key _fp _kept _kept_fp _carried row id fp part spots a.b kept_id root".split()


def test_stages_carry_columns_of_any_name(spark, copies):
    ship(spark)
    shared = "a passage of well over a hundred bytes that several documents of this small table share, word for word, without a change"
    texts = [(i, f"{t} {shared}") for i, t in copies[:10]] + [(-(2**63), f"Whole {shared}"), (None, f"Nameless {shared}"), (None, f"Nameless {shared}")]
    rows = [(i, t, "en", "s", len(t), *[f"{c}{i}" for c in CLASHES]) for i, t in texts]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", `{c}` string" for c in CLASHES)).repartition(3)
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.repeated_passages, corpus_pipeline.quality_rules):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r[c] == f"{c}{r.doc_id}" for r in found for c in CLASHES)
    cut = {(r.doc_id, r.text.startswith("Whole" if r.doc_id else "Nameless"), r.n_chars == len(r.text), shared in r.text) for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert {x for x in cut if x[0] in (None, -(2**63))} == {(None, True, True, True), (-(2**63), True, True, False)}
    counts = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in op03_suffixes.remove_repeats(docs).collect())
    nameless, whole = len(f"Nameless {shared}"), len(f"Whole {shared}")
    assert counts[:3] == [(False, 0, nameless, 0), (False, 0, nameless, 0), (True, -(2**63), whole, len(shared) + 1)]  # the space too


def test_rare_terms_beside_a_hot_source_enter_the_lexicon(spark):
    ship(spark)
    rows = [(f"you wretch no{i}", 1, 0.2) for i in range(500)] + [(f"eres tontazo nr{i}", 1, 0.2) for i in range(5)]
    rows += [(f"fine text nr{i}", 0, 0.2) for i in range(2000)]
    sample = spark.createDataFrame(rows, "text string, label int, rate double")
    terms = {t for t, _ in op05_toxicity.learn_lexicon(sample)}
    assert any("tontazo".startswith(t) for t in terms) and "wretch" in terms
    # as many labels of each kind: five texts may have a word by chance
    even = sample.filter("label = 1 or text < 'fine text nr145'")
    assert not any("tontazo".startswith(t) for t, _ in op05_toxicity.learn_lexicon(even))


def test_inflected_and_short_terms_match_with_an_edit(spark):
    ship(spark)
    rows = [(f"you {w} no{i}", 1, 0.5) for w in ("grobian", "grobians", "scum") for i in range(40)]
    rows += [(f"fine text nr{i}", 0, 0.5) for i in range(200)]
    sample = spark.createDataFrame(rows, "text string, label int, rate double")
    automaton = op05_toxicity.LexiconAutomaton(op05_toxicity.learn_lexicon(sample))
    assert [automaton.match(w) for w in ("grobian", "grobians", "scum")] == [1, 1, 1]
    assert [automaton.match(w) for w in ("grobixn", "grxbians", "scvm", "scvmm")] == [2, 2, 3, 0]
    weak = op05_toxicity.inputs("you scvm", automaton)
    assert weak[:3] == [0.0, 0.0, 0.0] and weak[3] > 0
    assert op05_toxicity.learn(sample)["weights"][4] >= 0
    both = op05_toxicity.LexiconAutomaton([("abcd", False), ("abcde", False)])
    assert both.match("abxd") == 3 and both.match("abxde") == 2

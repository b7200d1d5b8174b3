"""Toxicity by Levenshtein automata over a lexicon trie, scored in context windows.

Lexicon: whole words and stems (word beginnings) that mark toxic training documents, learned from counts of
documents. The trie and the Levenshtein automaton of each distance run as one automaton: a state is the set
of (trie node, edits so far), and states are built when a word first needs them, so a word costs one step a
character and most words end after two or three. Stems match exactly; whole words of ``FUZZY_CHARS`` characters or
more, also those below a stem, match with one edit too. One edit from a word of ``WEAK_CHARS`` is evidence of its own kind.
Shorter words, of ``SHORT_CHARS`` at least, must be more precise and match exactly. Two swapped letters are two edits. A term
spelled letter by letter (``w r e t c h``) counts as misspelled. The lexicon holds the ``MAX_TERMS`` most frequent terms; those
whose smoothed precision is below ``FIRM_PRECISION`` are thin: some stand there by chance, so they are evidence of their own kind.

Context: a match between a pair of quotation marks on one line, at most ``QUOTE_CHARS`` apart, or with a word of ``REPORTING``
among the ``CONTEXT_WORDS`` before it in its sentence, is quotation, else abuse. Matches, misspelled matches, quotations, weak
and thin matches are separate inputs of a logistic score. Its weights come from the same sample in ``FOLDS`` parts, each judged
with the lexicon of the other parts.

Training: a sample of about ``SAMPLE_ROWS`` labelled documents of each label, chosen by a hash of doc_id. Without
toxic training rows nothing is toxic: all scores are 0.

Null or empty text: no match. Very long texts are read whole. Equally frequent terms go by length, the longer first, then by
name; rows of equal evidence get equal scores, at the threshold they are toxic. Repeated rows and ids get equal results, a
null doc_id is kept; other columns are not read by the query and stay in ``keep_clean``. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import documents, fit_logistic, give_back, held_out, labelled_sample, labels, ship

SAMPLE_ROWS = 4_000
LEAST_PREFIX, LONGEST_PREFIX = 4, 9
MAX_TERMS = 2_000
#: A term must be in this many different toxic texts, however many there are. Its precision must hold among the texts that have
#: it, and with one clean text more if both labels had as many texts: else rare words of the toxic texts pass by chance.
LEAST_DOCUMENTS = 4
FIRM_PRECISION = 0.997
FOLDS = 3
LEAST_PRECISION = 0.95
FUZZY_CHARS = 5
WEAK_CHARS = 4
#: Shorter words than a stem: of this length at least, in this many different toxic texts, and this precise.
SHORT_CHARS, SHORT_DOCUMENTS, SHORT_PRECISION = 2, 8, 0.998
CONTEXT_WORDS, CONTEXT_CHARS = 4, 200
QUOTE_CHARS = 400
THRESHOLD = 0.7
#: Words that report speech, in English, German, French and Spanish.
REPORTING = frozenset(
    "said says saying called calling quote quoted quotes word term wrote writes according "
    "sagt sagte sagen nannte genannt wort zitat schrieb "
    "disait dire appelé citation écrit terme selon "
    "dice dijo llamó llamado palabra cita escribió término según".split()
)
WORD = re.compile(r"[^\W_]+")
SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:[ .*_-][^\W_]){3,}(?![^\W_])")
SENTENCE_END = re.compile(r"[.!?…\n]")
#: Pairs of quotation marks. Straight single ones must not be apostrophes.
PAIRS = ('""', "“”", "„“", "„”", "«»", "»«", "‘’")
QUOTED = re.compile(
    "|".join(f"{a}[^{a}{b}\n]{{1,{QUOTE_CHARS}}}{b}" for a, b in PAIRS) + rf"|(?<!\w)'[^'\n]{{1,{QUOTE_CHARS}}}'(?!\w)"
)


def learn_lexicon(sample: DataFrame) -> list[tuple[str, bool]]:
    """(term, is a stem) of a bounded ``sample`` (text, label)."""
    return learn_terms(sample)[0]


def learn_terms(sample: DataFrame) -> tuple[list[tuple[str, bool]], frozenset[str]]:
    """The lexicon, and those of its terms that are thin."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for w in WORD.findall(text.lower()) if len(w) >= SHORT_CHARS}
                terms = {w[:i] for w in words for i in range(LEAST_PREFIX, min(len(w), LONGEST_PREFIX) + 1)} | {w + "\0" for w in words}
                (toxic if label else clean).update(terms)
        terms = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "toxic": [toxic[t] for t in terms], "clean": [clean[t] for t in terms]})

    different = sample.select("text", "label").distinct()  # copies are no further evidence
    sizes = {r["label"]: r["count"] for r in different.groupBy("label").count().collect()}
    toxic_share = F.col("toxic") / sizes.get(1, 1)
    clean_share = (F.col("clean") + 1) / sizes.get(0, 1)
    counts = different.mapInArrow(count, "term string, toxic long, clean long")
    totals = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    short = F.length("term") <= LEAST_PREFIX  # with its end
    least = F.when(short, SHORT_PRECISION).otherwise(LEAST_PRECISION)
    firm = toxic_share / (toxic_share + clean_share) >= FIRM_PRECISION
    marks = totals.withColumn("firm", firm).filter(
        (F.col("toxic") >= F.when(short & F.col("term").endswith("\0"), SHORT_DOCUMENTS).otherwise(LEAST_DOCUMENTS))
        & (F.col("toxic") / (F.col("toxic") + F.col("clean")) >= least)
        & (toxic_share / (toxic_share + clean_share) >= least)
    )
    # at most MAX_TERMS * 20 rows: a term has fewer than 20 beginnings
    rows = marks.orderBy(F.desc("toxic"), "term").limit(MAX_TERMS * 20).collect()
    found, firm_terms = {r["term"]: r["toxic"] for r in rows}, {r["term"] for r in rows if r["firm"]}
    longer: dict[str, int] = {}  # the most frequent term that goes on after a beginning
    for term, n in found.items():
        for i in range(LEAST_PREFIX, min(len(term) - 1, LONGEST_PREFIX) + 1):
            longer[term[:i]] = max(n, longer.get(term[:i], 0))
    lexicon: list[tuple[str, bool]] = []
    below: list[str] = []  # whole words that a stem matches: their misspellings need them
    stems: set[str] = set()
    for term in sorted(found, key=lambda t: (-found[t], -len(t), t)):
        word = term.rstrip("\0")
        whole = term.endswith("\0")
        if any(word[:i] in stems for i in range(LEAST_PREFIX, len(word) + 1)):
            if whole and len(below) < MAX_TERMS:
                below.append(word)
            continue
        if len(lexicon) >= MAX_TERMS:
            continue
        if not whole:
            # a stem only if no single word or longer stem accounts for it
            if longer.get(term, 0) >= 0.8 * found[term]:
                continue
            stems.add(term)
        lexicon.append((word, not whole))
    lexicon += [(word, False) for word in below]
    return lexicon, frozenset(t for t, stem in lexicon if (t if stem else t + "\0") not in firm_terms)


class LexiconAutomaton:
    """The trie of a lexicon intersected with Levenshtein automata of distance 1, made on demand."""

    def __init__(self, lexicon: list[tuple[str, bool]], thin: frozenset[str] = frozenset()):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]  # 1: a whole word ends here, 2: a stem; 4 and 8: a thin one
        self.fuzzy: list[bool] = [False]  # a long enough whole word ends here or below
        self.near: list[int] = [0]  # the kind of a whole word that ends here with one edit
        for term, stem in lexicon:
            at = 0
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(0)
                    self.fuzzy.append(False)
                    self.near.append(0)
                at = self.children[at][c]
                if not stem and len(term) >= WEAK_CHARS:
                    self.fuzzy[at] = True
            self.ends[at] |= (2 if stem else 1) << 2 * (term in thin)
            if not stem and len(term) >= WEAK_CHARS:
                self.near[at] = 2 if len(term) >= FUZZY_CHARS and term not in thin else 3
        self.states: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.verdicts: list[tuple[int, int]] = []
        self.start = self._number({(0, 0)})

    def _number(self, pairs: set[tuple[int, int]]) -> int:
        """The state of these (node, edits), with characters that the word leaves out."""
        pairs = pairs | {(child, 1) for node, edits in pairs if not edits for child in self.children[node].values() if self.fuzzy[child]}
        key = frozenset(p for p in pairs if p[1] == 0 or (p[0], 0) not in pairs)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            ends = max((self.ends[n] for n, e in key if e == 0), default=0)  # one node at most is without an edit
            near = min((self.near[n] for n, e in key if e == 1 and self.near[n]), default=0)
            self.verdicts.append((1 if ends & 1 else 4 if ends & 4 else near, 1 if ends & 2 else 4 if ends & 8 else 0))
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, edits in self.states[state]:
            child = self.children[node].get(c)
            if child is not None and (edits == 0 or self.fuzzy[child]):
                after.add((child, edits))
            if edits == 0:
                after.update((other, 1) for other in self.children[node].values() if self.fuzzy[other])
                if node == 0 or self.fuzzy[node]:
                    after.add((node, 1))
        to = self._number(after) if after else -1
        self.steps[state][c] = to
        return to

    def match(self, word: str) -> int:
        """0: none, 1: a term, 2: a misspelled term, 3: a word one edit from a short or thin term, 4: a thin term."""
        state = self.start
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return 0
            if self.verdicts[state][1]:
                return self.verdicts[state][1]
        return self.verdicts[state][0]


INPUTS = 5


def evidence(text: str | None, automaton: LexiconAutomaton) -> list[float]:
    """Logarithmic counts of abusive, misspelled and quoted matches."""
    return inputs(text, automaton)[:3]


def inputs(text: str | None, automaton: LexiconAutomaton) -> list[float]:
    """Logarithmic counts of abusive, misspelled, quoted, weak and thin matches; weak ones are not quotations."""
    text = (text or "").lower()
    kinds = {w: automaton.match(w) for w in set(WORD.findall(text))}
    # a word shorter than a stem must be a term itself
    hits = {w: kind for w, kind in kinds.items() if kind in (1, 4) or kind and len(w) >= LEAST_PREFIX}
    found = [(m.start(), hits[m[0]]) for m in WORD.finditer(text) if m[0] in hits] if hits else []
    found += [(m.start(), 2) for m in SPELLED.finditer(text) if automaton.match(m[0][::2]) == 1]
    counts = [0] * INPUTS
    quotes = [m.span() for m in QUOTED.finditer(text)] if found else []
    at = 0
    for start, kind in sorted(found):
        while at < len(quotes) and quotes[at][1] <= start:
            at += 1
        in_marks = at < len(quotes) and quotes[at][0] < start
        quoted = kind != 3 and (in_marks or reported(text, start))
        counts[2 if quoted else (0, 1, 3, 4)[kind - 1]] += 1
    return [float(np.log1p(c)) for c in counts]


def reported(text: str, start: int) -> bool:
    """Whether a word of reported speech is among the words before ``start`` in its sentence."""
    sentence = SENTENCE_END.split(text[max(0, start - CONTEXT_CHARS) : start])[-1]
    return not REPORTING.isdisjoint(WORD.findall(sentence)[-CONTEXT_WORDS:])


def learn(sample: DataFrame) -> dict:
    """Lexicon and weights of the logistic score from a bounded ``sample`` (text, label)."""
    lexicon, thin = learn_terms(sample)
    fold = F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(FOLDS))  # copies are in one fold
    parts = []
    for k in range(FOLDS):
        automaton_of = learn_terms(sample.filter(fold != k))

        @F.pandas_udf("array<double>")
        def featured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            automaton = LexiconAutomaton(*automaton_of)  # noqa: B023 - used before the next one
            for batch in batches:
                yield pd.Series([inputs(t, automaton) for t in batch])

        # equal evidence is one row
        parts.append(sample.filter(fold == k).groupBy(featured("text").alias("x"), "label").count().toPandas())
    rows = pd.concat(parts).groupby([pd.concat(parts)["x"].map(tuple), "label"])["count"].sum().reset_index()
    if not lexicon or rows["label"].nunique() < 2:
        return {"lexicon": [], "thin": frozenset(), "weights": np.array([-30.0] + [0.0] * INPUTS)}
    x = np.column_stack([np.ones(len(rows)), np.array(rows["x"].tolist())])
    order = np.lexsort(x.T)
    x, y, n = x[order], rows["label"].to_numpy(float)[order], rows["count"].to_numpy(float)[order]
    used = list(range(INPUTS + 1))
    while True:  # a match that is no quotation never speaks for a text
        weights = np.zeros(INPUTS + 1)
        weights[used] = fit_logistic(x[:, used], y, l2=0.005, counts=n)
        against = [i for i in used if i not in (0, 3) and weights[i] < 0]
        if not against:
            return {"lexicon": lexicon, "thin": thin, "weights": weights}
        used.remove(against[0])


def score(text: Column, model: dict) -> Column:
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = LexiconAutomaton(model["lexicon"], model["thin"])
        for batch in batches:
            x = np.array([inputs(t, automaton) for t in batch]).reshape(-1, INPUTS)
            yield pd.Series(1 / (1 + np.exp(-(model["weights"][0] + x @ model["weights"][1:]))))
        give_back()

    return scored(text)


def train(docs: DataFrame, marks: DataFrame) -> dict:
    return learn(labelled_sample(docs, marks, "toxic", SAMPLE_ROWS))


def keep_clean(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold."""
    ship(docs.sparkSession)
    return docs.filter(score(F.col("text"), model) < THRESHOLD)


def op5_toxicity_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, labels(spark, sf_dir))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

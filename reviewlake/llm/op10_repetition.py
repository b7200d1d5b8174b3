"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths.

Words are runs without ASCII white space. For every n of ``COVERAGE`` the characters in words that lie in a
repeated n-gram (an n-gram that an earlier one equals; its first occurrence does not count) are set against all
characters in words; likewise the characters of lines that equal an earlier line. A text is rejected
if a share is over its limit. N-gram hashes are rolling polynomials of 64-bit word hashes, in numpy.

Base rules: fewer than ``LEAST_WORDS`` words, or more than ``REPEAT_PERCENT`` percent of the words in 5-word
windows found twice or more.

Null or empty text: no words, so the base rules reject it. Rows are judged alone, so repeated rows and
ids give repeated results; a null doc_id is kept. Other columns are not read by the query and stay in ``keep_clean``.
An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.llm.common import documents

WINDOW_WORDS = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20
#: Largest share of characters in repeated n-grams.
COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters in repeated lines.
LINE_COVERAGE = 0.30
SYMBOLS = re.compile(r"[#*$%&|<>]")
BASE = np.uint64(0x9E3779B97F4A7C15)
REPORT = (
    T.StructType()
    .add("n_words", "long")
    .add("word_chars", "long")
    .add("n_symbols", "long")
    .add("n_dup_lines", "long")
    .add("n_repeat_words", "long")
    .add("base_failed", "boolean")
    .add("dup_ngram_share", "double")
    .add("dup_line_share", "double")
    .add("kept", "boolean")
)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all n-grams of hashed words, from those one word shorter at each step."""
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out = out * BASE + words[i : len(words) - n + 1 + i]
    return out ^ (out >> np.uint64(29))


def covered(marks: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words that lie in a marked n-gram."""
    change = np.zeros(size + 1, dtype=np.int64)
    change[: len(marks)] += marks
    change[n : n + len(marks)] -= marks
    return change[:size].cumsum() > 0


def repeated(hashes: np.ndarray, with_first: bool) -> np.ndarray:
    """Marks of the hashes that occur twice or more, or of all but the first of each."""
    _, first, index, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    marks = counts[index] > 1
    if not with_first:
        marks[first] = False
    return marks


def judge(text: str | None) -> tuple:
    raw = (text or "").encode()
    words = raw.split()  # of bytes: ASCII white space only
    n = len(words)
    chars = np.array([len(w) for w in words], dtype=np.int64)
    if not raw.isascii():
        chars = np.array([len(w) if w.isascii() else len(w.decode()) for w in words], dtype=np.int64)
    total = int(chars.sum())
    seen: set[bytes] = set()
    n_lines = line_chars = 0
    for line in raw.split(b"\n"):
        if own := line.split():
            if line in seen:
                n_lines += 1
                line_chars += sum(map(len, own)) if line.isascii() else sum(len(w.decode()) for w in own)
            seen.add(line)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    n_repeat = 0
    worst = 0.0
    rejected = False
    for size, limit in COVERAGE.items():
        if n < size:
            break
        grams = ngram_hashes(hashes, size)
        if size == WINDOW_WORDS:
            n_repeat = int(covered(repeated(grams, True), size, n).sum())
            if not n_repeat:
                break  # no longer n-gram can be repeated
        share = float(chars[covered(repeated(grams, False), size, n)].sum()) / total
        worst = max(worst, share)
        rejected |= share > limit
    base = n < LEAST_WORDS or 100 * n_repeat > REPEAT_PERCENT * n
    line_share = line_chars / total if total else 0.0
    kept = not (base or rejected or line_share > LINE_COVERAGE)
    return n, total, len(SYMBOLS.findall(text or "")), n_lines, n_repeat, base, worst, line_share, kept


@F.pandas_udf(REPORT)
def repetition(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([judge(t) for t in text], columns=REPORT.names)


def report(docs: DataFrame) -> DataFrame:
    """doc_id with the counts, shares and verdict of every row of ``docs``."""
    return docs.select("doc_id", repetition("text").alias("r")).select("doc_id", "r.*")


def keep_clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    return docs.filter(repetition("text")["kept"])


def op10_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))

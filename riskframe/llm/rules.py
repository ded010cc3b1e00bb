"""Quality by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Every rule looks at one property of a whole text and votes good, bad or not at all.
Expectation-maximisation over the counted vote patterns estimates how often each rule is
right on good and on bad documents, without labels; a document stays if its posterior
probability of being good, given all votes, reaches a half.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import cut, texts

WINDOW = 5
MIN_WORDS = 10
#: Percentage of words in repeated windows beyond which a text fails the base rules.
MAX_REPEAT = 20
ROUNDS = 200
#: Weight of the starting rates in every M-step, as a share of all documents.
PRIOR = 0.01
START_RIGHT_GOOD, START_RIGHT_BAD, START_GOOD = 0.99, 0.4, 0.8
#: Thresholds are set so that good text seldom crosses them: a rule is right on this share of good documents at least.
LEAST_RIGHT_GOOD = 0.98
KEEP = 0.5

#: ASCII characters that the base counts as symbols.
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_GAPS = b" \t\n\x0b\x0c\r"
_NOT_LETTER = bytes(b for b in range(0x80) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
#: A word of letters alone, with quotes or brackets around it and punctuation behind.
_PLAIN = re.compile(rb"""["'(\[]?[A-Za-z\x80-\xff][A-Za-z\x80-\xff'-]*[.,;:!?)\]"']{0,3}""")
_ENDS = tuple(c.encode() for c in ".!?:;\"')]…”»")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("n_lines", "n_ended", "n_upper", "n_cased", "n_letters", "n_marks", "n_top", "n_plain")

#: (rule, votes good if, votes bad if, over the counts); a rule for which neither holds abstains.
RULES = [
    ("length", "n_words >= 50", f"n_words < {MIN_WORDS}"),
    ("repetition", "n_words >= 10 AND 20 * n_repeat_words <= n_words", f"100 * n_repeat_words > {MAX_REPEAT} * n_words"),
    ("symbols", "n_words > 0 AND 50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_lines >= 5 AND 10 * n_dup_lines <= n_lines", "n_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "word_chars BETWEEN 3 * n_words AND 10 * n_words AND n_words > 0", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("capitals", "n_cased >= 20 AND 5 * n_upper <= n_cased", "n_cased >= 20 AND 2 * n_upper > n_cased"),
    ("marks", "n_words > 0 AND 20 * n_marks <= n_words", "5 * n_marks > n_words"),
    ("top_word", "n_words >= 20 AND 100 * n_top <= 15 * n_words", "n_words >= 20 AND 10 * n_top > 3 * n_words"),
    ("letters", "n_words > 0 AND 10 * n_letters >= 8 * word_chars", "10 * n_letters < 6 * word_chars"),
    ("plain_words", "n_words > 0 AND 10 * n_plain >= 7 * n_words", "2 * n_plain < n_words"),
    ("line_ends", "n_lines > 0 AND 2 * n_ended >= n_lines", "n_lines >= 5 AND 10 * n_ended < n_lines"),
]


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in ``ids``, the first one included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for i in range(window):
        h = (h ^ ids[i: i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] > 1)
    if not len(at):
        return 0
    # Windows of equal hash are compared word by word.
    _, inverse, count = np.unique(np.stack([ids[at + i] for i in range(window)], 1), axis=0, return_inverse=True, return_counts=True)
    at = at[count[inverse.ravel()] > 1]
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[at] += 1
    edge[at + window] -= 1
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def _without(data: bytes, drop: bytes) -> int:
    return len(data.translate(None, drop))


def measure(text: str) -> tuple[int, ...]:
    """COUNTS and MEASURES of one whole text."""
    data = text.encode()
    words = data.split()
    if not words:
        return (0,) * (len(COUNTS) + len(MEASURES))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    times = np.bincount(ids)
    plain = np.fromiter((_PLAIN.fullmatch(w) is not None for w in number), bool, len(number))
    lines = [x for x in data.split(b"\n") if x.strip()]
    wide = len(data) - len(text)                        # bytes that continue a code point
    upper, lower = len(data) - _without(data, _UPPER), len(data) - _without(data, _LOWER)
    return (len(words), _without(data, _GAPS) - wide, len(data) - _without(data, SYMBOLS), len(lines) - len(set(lines)), repeated_words(ids),
            len(lines), sum(x.rstrip().endswith(_ENDS) for x in lines), upper, upper + lower, _without(data, _NOT_LETTER) - wide,
            data.count(b"!") + data.count(b"?"), int(times.max()), int(times[plain].sum()))


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS, MEASURES) of every row; a null text is empty."""
    names = [*COUNTS, *MEASURES]

    def run(batches):
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(1)]
            made = np.array(rows, np.int64).reshape(len(rows), len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(made[:, i]) for i in range(len(names))]], ["doc_id", *names])

    return texts(docs).mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", *names]))


def pattern() -> Column:
    """All votes in one number: a base-3 digit per rule, 0 abstains, 1 bad, 2 good."""
    digits = [F.when(F.expr(good), F.lit(2)).when(F.expr(bad), F.lit(1)).otherwise(F.lit(0)) * F.lit(3 ** i)
              for i, (_, good, bad) in enumerate(RULES)]
    return sum(digits[1:], digits[0])


class Model(NamedTuple):
    """Share of good documents; per rule, how often its vote is right on good and on bad ones."""
    good: float
    right_good: np.ndarray
    right_bad: np.ndarray


def _log_odds(model: Model) -> tuple[float, np.ndarray, np.ndarray]:
    return (float(np.log(model.good / (1 - model.good))), np.log(model.right_good / (1 - model.right_bad)),
            np.log((1 - model.right_good) / model.right_bad))


def fit(votes: np.ndarray, n: np.ndarray, rounds: int = ROUNDS, prior: float = PRIOR) -> Model:
    """EM over vote patterns (rows of 0, 1 bad, 2 good) that ``n`` documents share each.

    The first round takes documents with any bad vote for bad, as a filter in which all
    rules must pass would; EM then softens that.  Abstentions say nothing.  The starting
    rates stay in every M-step with the weight of ``prior`` times all documents.  A rule
    is right on LEAST_RIGHT_GOOD of good documents at least and votes bad on bad ones at
    least as often as on good ones, so the two classes can't change places.
    """
    total, rules = n.sum(), votes.shape[1]
    good, bad = (votes == 2).astype(float), (votes == 1).astype(float)
    weight = prior * total
    model = Model(START_GOOD, np.full(rules, START_RIGHT_GOOD), np.full(rules, START_RIGHT_BAD))
    if not total:
        return model
    low = 1e-4
    p = np.where(bad.any(1), 0.1, 0.9)
    for _ in range(rounds):
        yes, no = n * p, n * (1 - p)
        right_good = (yes @ good + weight * START_RIGHT_GOOD) / (yes @ (good + bad) + weight)
        right_good = np.clip(right_good, LEAST_RIGHT_GOOD, 1 - low)
        right_bad = (no @ bad + weight * START_RIGHT_BAD) / (no @ (good + bad) + weight)
        right_bad = np.clip(right_bad, 1 - right_good, 1 - low)
        share = (yes.sum() + weight * START_GOOD) / (total + weight)
        model = Model(float(np.clip(share, low, 1 - low)), right_good, right_bad)
        base, up, down = _log_odds(model)
        new = 1 / (1 + np.exp(-np.clip(base + good @ up + bad @ down, -500, 500)))
        if np.abs(new - p).max() < 1e-10:
            break
        p = new
    return model


def learn(measured: DataFrame) -> Model:
    """The model of all rows of ``measured`` (COUNTS, MEASURES); the driver gets one row per vote pattern, 3^11 at most."""
    rows = measured.groupBy(pattern().alias("code")).agg(F.count(F.lit(1)).alias("n")).orderBy("code").collect()
    code = np.array([r.code for r in rows], np.int64)
    return fit(np.stack([code // 3 ** i % 3 for i in range(len(RULES))], 1), np.array([r.n for r in rows], float))


def posterior(model: Model) -> Column:
    """Probability that a row of COUNTS and MEASURES is good, as one expression."""
    base, up, down = _log_odds(model)
    odds = F.lit(base)
    for (_, good, bad), u, d in zip(RULES, up, down):
        odds = odds + F.when(F.expr(good), F.lit(float(u))).when(F.expr(bad), F.lit(float(d))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """(doc_id, COUNTS, base_failed, quality, kept), one row per row of ``docs`` (doc_id, text).

    ``quality`` is the posterior probability of a good document.  A text without words
    (null, empty, white space) has zero counts, fails the base rules and is not kept;
    very long texts are counted whole; repeated rows each vote and each get a row; a
    posterior of exactly ``keep`` is kept; null ids stay; other columns are ignored; an
    empty table gives no rows.
    """
    measured = cut(measures(docs), "rules")
    failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words")
    return measured.select("doc_id", *COUNTS, failed.alias("base_failed"), posterior(learn(measured)).alias("quality")) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= F.lit(keep)))

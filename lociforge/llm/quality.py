"""Quality rules as weak supervision.

Every rule votes good (1), bad (0) or abstains (-1) on a document. The votes of all
documents are counted by pattern (at most 3 ** rules of them, whatever the corpus size);
expectation-maximisation over these counts estimates how often each rule is right and how
many documents are good; a document is kept if its posterior probability of being good is
at least ``threshold``. The posterior decides about every pattern, opposed or not. That rules
are rarely wrong about good documents is a prior worth a few documents. Where some documents have labels,
a bounded sample of them keeps its labels in the estimate. Some rules are strict and often wrong
about good documents; what each is worth, the estimate tells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociforge.llm.shared import staged

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_distinct_words", "n_window_words", "n_upper", "n_marks", "n_bare_words", "longest_word",
)
#: Words of a window in which distinct words are counted.
WINDOW = 100
#: The prior: so many documents, of which a share is good, and on which each rule is right so often if they are bad or good.
#: Strict rules are wrong about good documents more often.
PRIOR = {"documents": 20, "share": 0.9, "bad": 0.4, "good": 0.995, "strict": 0.9}
STRICT = ("symbol_chars", "some_capitals", "some_marks", "some_bare", "some_lines", "brief", "line_size", "phrases", "wording", "long_words", "mean_word")
#: Documents are kept from this probability of being good on: a good one lost counts for more than a bad one kept.
KEPT = 0.01
#: Labelled documents that a fit takes at most.
LABELLED = 5000
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
#: Bytes that are neither letters nor digits of ASCII; a word of these alone is bare.
_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())


def repeated_words(codes: np.ndarray) -> int:
    """Words in windows of three that are found twice or more; codes name the words."""
    n = len(codes)
    if n < 4:
        return 0
    size = int(codes.max()) + 1
    pairs = codes[:-1] * size + codes[1:]
    if size >= 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    _, at, count = np.unique(pairs[:-1] * size + codes[2:], return_inverse=True, return_counts=True)
    found = np.flatnonzero(count[at] > 1)
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[found + k] = True
    return int(hit.sum())


def distinct_in_windows(codes: np.ndarray) -> tuple[int, int]:
    """Distinct words summed over windows of WINDOW words that cover the text (the last ends with it), and words of the windows."""
    n = len(codes)
    if n <= WINDOW:
        return len(np.unique(codes)), n
    rows = codes[: n - n % WINDOW].reshape(-1, WINDOW)
    if n % WINDOW:
        rows = np.vstack([rows, codes[-WINDOW:]])
    rows = np.sort(rows, axis=1)
    return len(rows) + int((rows[:, 1:] != rows[:, :-1]).sum()), rows.size


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one whole text; null counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    codes: dict[bytes, int] = {}
    at = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text or "") - sum(raw.count(c) for c in _SPACES),
        sum(raw.count(c) for c in _SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(at),
        *distinct_in_windows(at),
        sum(x.isupper() and len(x.decode("utf-8", "replace")) > 1 for w in words if (x := w.strip(_MARKS))),
        raw.count(b"!"),
        sum(not w.strip(_MARKS) for w in words),
        max(map(len, words), default=0),
    )


@F.pandas_udf(T.StructType([T.StructField(x, T.LongType()) for x in MEASURES]))
def _measures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in texts:
        yield pd.DataFrame([measure(x) for x in part], columns=MEASURES, dtype="int64")


def measured(docs: DataFrame, text: str = "text", into: str = "measures") -> DataFrame:
    """docs with a struct of the measures of each whole text."""
    return docs.withColumn(into, _measures(F.col(text)))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def rules(m: str = "measures") -> dict[str, Column]:
    """Votes by rule name; shares are of words, so they behave alike at every length."""
    c = lambda name: F.col(f"{m}.{name}")
    distinct = c("n_distinct_words") / F.greatest(c("n_window_words"), F.lit(1))
    words, lines = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("n_lines"), F.lit(1))
    share = lambda name: c(name) / words
    return {
        "symbols": _vote(share("n_symbols") > 0.1, share("n_symbols") < 0.02),
        "repeats": _vote(share("n_repeat_words") > 0.4, share("n_repeat_words") < 0.15),
        "lines": _vote(c("n_dup_lines") / lines > 0.5, c("n_dup_lines") / lines < 0.2),
        "variety": _vote((c("n_words") > 0) & (distinct < 0.1), distinct > 0.3),
        "capitals": _vote(share("n_upper") > 0.4, share("n_upper") < 0.1),
        "marks": _vote(share("n_marks") > 0.2, share("n_marks") < 0.05),
        "bare": _vote(share("n_bare_words") > 0.2, share("n_bare_words") < 0.05),
        "word_size": _vote(
            (c("word_chars") / words < 2.0) | (c("word_chars") / words > 15.0) | (c("longest_word") > 1000),
            (c("word_chars") / words).between(3.0, 11.0),
        ),
        # strict ones, several of which good documents fail one by one, and which say again what others say
        "symbol_chars": _vote(c("n_symbols") / F.greatest(c("word_chars"), F.lit(1)) > 0.05, c("n_symbols") / F.greatest(c("word_chars"), F.lit(1)) < 0.005),
        "some_capitals": _vote(share("n_upper") > 0.15, share("n_upper") < 0.03),
        "some_marks": _vote(share("n_marks") > 0.08, share("n_marks") < 0.01),
        "some_bare": _vote(share("n_bare_words") > 0.1, share("n_bare_words") < 0.01),
        "some_lines": _vote(c("n_dup_lines") / lines > 0.3, c("n_dup_lines") / lines < 0.05),
        "brief": _vote(c("n_words") < 100, c("n_words") >= 200),
        "line_size": _vote((c("n_words") / lines < 12) | (c("n_words") / lines > 100), (c("n_words") / lines).between(20, 80)),
        "phrases": _vote(share("n_repeat_words") > 0.05, share("n_repeat_words") < 0.01),
        "wording": _vote((c("n_words") > 0) & (distinct < 0.75), distinct > 0.8),
        "long_words": _vote(c("longest_word") > 25, c("longest_word") <= 18),
        "mean_word": _vote((c("word_chars") / words < 4.4) | (c("word_chars") / words > 6.4), (c("word_chars") / words).between(4.8, 5.6)),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], labelled: list[tuple[tuple[int, ...], int, int]] = (), strict: tuple[int, ...] = (), rounds: int = 500) -> tuple[float, np.ndarray]:
    """Share of good documents, and of each rule the share of right votes on bad and on good ones.

    patterns: votes and how many documents cast them; labelled: votes, label (1: good) and how many; strict: places
    of strict rules. Labelled
    documents keep their label and PRIOR stands for a few more, so both weigh less the larger the corpus is. Starts
    from the labelled ones, or without any from: bad if any rule says so.
    """
    if not patterns:
        return 0.5, np.zeros((2, 0))
    votes, n = np.array([p for p, _ in patterns]), np.array([k for _, k in patterns], float)
    says = np.stack([votes == 0, votes == 1]).astype(float)
    worth = PRIOR["documents"]
    right0 = worth * np.repeat([[PRIOR["bad"]], [PRIOR["good"]]], votes.shape[1], axis=1)
    right0[1, list(strict)] = worth * PRIOR["strict"]
    cast0 = np.full_like(right0, worth)
    good0, all0 = worth * PRIOR["share"], worth
    for v, label, k in labelled:
        v = np.array(v)
        right0[label] += k * (v == label)
        cast0[label] += k * (v >= 0)
        good0, all0 = good0 + k * label, all0 + k
    right, prior = right0 / cast0, good0 / all0
    p = np.where((votes == 0).any(1), 0.1, 0.95) if not labelled else 1 / (1 + np.exp(-_odds(votes, prior, right)))
    for _ in range(rounds):
        weight = np.stack([(1 - p) * n, p * n])
        right = (np.stack([weight[k] @ says[k] for k in (0, 1)]) + right0) / (weight @ (says[0] + says[1]) + cast0)
        prior = (float(weight[1].sum()) + good0) / (float(n.sum()) + all0)
        new = 1 / (1 + np.exp(-_odds(votes, prior, right)))
        done, p = np.abs(new - p).max() < 1e-9, new
        if done:
            break
    return prior, right


def _weights(right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a vote for bad and a vote for good add to the log odds of good."""
    bad, good = right
    return np.log(1 - good) - np.log(bad), np.log(good) - np.log(1 - bad)


def _odds(votes: np.ndarray, prior: float, right: np.ndarray) -> np.ndarray:
    no, yes = _weights(right)
    return math.log(prior / (1 - prior)) + ((votes == 0) * no + (votes == 1) * yes).sum(1)


def labelled_votes(rows: DataFrame, labels: DataFrame, measures: str = "measures", most: int = LABELLED) -> list[tuple[tuple[int, ...], int, int]]:
    """Votes, label and number of documents, of at most ``most`` labelled documents, in the order of a hash of their doc_id."""
    known = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("_q"), F.max("quality").alias("_most")).filter("_q = _most")
    votes = F.array(*[v.cast("int") for v in rules(measures).values()])
    sample = rows.select(F.col("doc_id").alias("_id"), votes.alias("votes")).join(known.select(F.col("doc_id").alias("_id"), "_q"), "_id")
    found = sample.orderBy(F.xxhash64("_id"), "_id", "votes").limit(most).groupBy("votes", "_q").count().collect()
    return sorted((tuple(r["votes"]), int(r["_q"]), r["count"]) for r in found)


def verdicts(rows: DataFrame, measures: str = "measures", threshold: float = KEPT, labels: DataFrame | None = None) -> DataFrame:
    """rows with quality (the posterior), base_failed and kept, from their measures.

    Reads rows once or twice (with labels) to count vote patterns, once for the result. labels: doc_id, quality;
    documents that it tells to be both count as unlabelled.
    """
    votes = F.array(*[v.cast("int") for v in rules(measures).values()])
    counts = rows.select(votes.alias("votes")).groupBy("votes").count().collect()  # at most 3 ** rules rows, in fact hundreds
    known = labelled_votes(rows, labels, measures) if labels is not None else []
    strict = tuple(k for k, name in enumerate(rules(measures)) if name in STRICT)
    prior, right = fit(sorted((tuple(r["votes"]), r["count"]) for r in counts), known, strict)
    odds = F.lit(math.log(prior / (1 - prior)))
    for no, yes, vote in zip(*map(np.ndarray.tolist, _weights(right)), rules(measures).values(), strict=False):
        odds = odds + F.when(vote == 1, yes).when(vote == 0, no).otherwise(0.0)
    m = F.col(measures)
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    rows = rows.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def judged(docs: DataFrame, text: str = "text", threshold: float = KEPT, labels: DataFrame | None = None) -> DataFrame:
    """docs with the columns measures, quality, base_failed and kept.

    base_failed: under 50 words, or over half of the words in repeated windows of three.
    Null and empty texts have no words and fail; repeated rows are judged alike; an empty
    table gives an empty result; columns of docs with one of the four names are replaced.
    """
    docs = docs.drop("measures", "quality", "base_failed", "kept")
    return verdicts(measured(docs, text), threshold=threshold, labels=labels)


def quality_table(docs: DataFrame, threshold: float = KEPT, labels: DataFrame | None = None) -> DataFrame:
    """One row per document with its measures and verdict, without its text.

    The measures, a few numbers a document, are staged, so that the texts are read once.
    """
    rows = staged(measured(docs.select("doc_id", "text")).drop("text"), "quality")
    return verdicts(rows, threshold=threshold, labels=labels).select("doc_id", "measures.*", "quality", "base_failed", "kept")

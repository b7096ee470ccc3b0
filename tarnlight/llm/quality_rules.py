"""Operator 7: quality rules as weak supervision.

Rules vote good or bad or abstain. Expectation-maximisation over the votes of all
documents estimates how accurate each rule is, and a document is kept by the posterior
probability that it is good.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm.batches import bound_batches, column, raw_texts
from tarnlight.llm.shipping import remote
from tarnlight.llm.staging import Workspace, text_mark, without
from tarnlight.llm.word_hashes import _BLANK, blocks, spans, windows, word_hashes

#: Frequent short words of English, German, French and Spanish, in lower case.
STOP_WORDS = """
the of and to in is that it for on with as be this by are or
der die das und zu den von ist im nicht ein auf für mit
le la les de des et en un une que qui pour dans est sur du
el los las del y se por con para una su
""".split()
#: The languages that the list covers; only in texts said to be in one of them does a lack of its words speak against a text.
STOP_LANGUAGES = ("en", "de", "fr", "es")
SYMBOLS = b"#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_letters", "n_upper", "n_lettered")


@dataclass(frozen=True)
class Rule:
    """good and bad are conditions over the features; where neither holds the rule abstains."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("word_length", "word_chars between 3 * n_words and 10 * n_words", "word_chars < 2 * n_words or word_chars > 13 * n_words"),
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeated_words", "100 * n_repeat_words <= 15 * n_words", "100 * n_repeat_words > 35 * n_words"),
    Rule("stop_words", "10 * n_stop_words >= n_words", "is_listed and n_words >= 20 and 100 * n_stop_words < n_words"),
    Rule("letters", "100 * n_letters >= 90 * word_chars", "100 * n_letters < 75 * word_chars"),
    Rule("worded", "100 * n_lettered >= 95 * n_words", "100 * n_lettered < 80 * n_words"),
    Rule("capitals", "10 * n_upper <= n_letters", "10 * n_upper > 4 * n_letters"),
)
#: How often a rule that votes is taken to vote bad on a good and on a bad document before anything is seen, as so many documents of either class.
BAD_IF_GOOD, BAD_IF_BAD = 0.02, 0.5
PRIOR = 50.0
GOOD_SHARE = 0.85
STEPS = 50


def base_features(docs: DataFrame) -> DataFrame:
    """doc_id, text_mark, is_listed and FEATURES for every row of docs(doc_id, text, and lang if there is one); a null text has no words and one line.

    is_listed: lang begins with the code of one of STOP_LANGUAGES.
    """
    bound_batches(docs.sparkSession)
    schema = "doc_id long, text_mark long, is_listed boolean, " + ", ".join(f"{f} long" for f in FEATURES)
    listed = F.lower(F.substring(F.col("lang").cast("string"), 1, 2)).isin(*STOP_LANGUAGES) if "lang" in docs.columns else F.lit(False)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_mark(F.col("text")).alias("text_mark"), F.coalesce(listed, F.lit(False)).alias("is_listed"))
    return rows.mapInArrow(remote(__name__, "feature_batches"), schema)


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = ["doc_id", "text_mark", "is_listed"]
    for batch in batches:
        rows = np.array([features(text) for text in raw_texts(batch)], np.int64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in own), *(pa.array(c) for c in rows.T.copy())], [*own, *FEATURES])


_IS_SYMBOL, _IS_LETTER, _IS_UPPER = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1
_IS_UPPER[range(ord("A"), ord("Z") + 1)] = 1
#: First bytes of letters. Those of Latin-1 signs (C2) and of punctuation, arrows and the like (E2) are left out.
_IS_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0xC3, 0xE2), *range(0xE3, 0xF5)]] = 1
#: First two bytes of characters that are none although their first byte says so: CJK punctuation, variation selectors, full-width signs, emoji.
_NO_LETTERS = (b"\xe3\x80", b"\xef\xb8", b"\xef\xbc", b"\xf0\x9f")
#: As the table above, but a word of emoji alone holds no letter.
_IN_WORD = _IS_LETTER.copy()
_IN_WORD[0xF0:] = 0
_STOP = np.sort(word_hashes(" ".join(STOP_WORDS).encode()))


def features(data: bytes) -> tuple[int, ...]:
    """FEATURES of a text. A letter is one of A-Z and a-z or a character beyond ASCII that isn't known as another kind by its first bytes."""
    tally = sum((np.bincount(np.frombuffer(block, np.uint8), minlength=256) for block in blocks(data)), np.zeros(256, np.int64))
    blanks = int(tally[_BLANK].sum())
    # code points: all bytes but the continuation bytes 0x80 to 0xBF
    word_chars = len(data) - blanks - int(tally[0x80:0xC0].sum())
    seen: set[bytes] = set()
    n_dup = n_lines = 0
    for line in data.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
    words = word_hashes(data)
    n_repeat = repeated_words(words, 3)
    lowered = word_hashes(data.lower())
    at = np.minimum(np.searchsorted(_STOP, lowered), len(_STOP) - 1)
    n_stop = int((_STOP[at] == lowered).sum()) if len(lowered) else 0
    n_lettered = sum(map(lettered_words, blocks(data)))
    return (len(words), word_chars, int((tally * _IS_SYMBOL).sum()), n_dup, n_repeat, max(1, n_lines), n_stop, int((tally * _IS_LETTER).sum()) - sum(map(data.count, _NO_LETTERS)), int((tally * _IS_UPPER).sum()), n_lettered)


def lettered_words(data: bytes) -> int:
    """Words that hold a letter."""
    codes = np.frombuffer(data, np.uint8)
    starts, ends = spans(codes)
    letters = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_IN_WORD[codes], out=letters[1:])
    return int((letters[ends] > letters[starts]).sum())


def repeated_words(words: np.ndarray, size: int) -> int:
    """Words that lie in a window of that size which the text has twice or more, the first one included."""
    grams = windows(words, size)
    _, where, counts = np.unique(grams, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[where] > 1) if len(grams) else np.zeros(0, np.int64)
    covered = np.zeros(len(words), bool)
    for i in range(size):
        covered[starts + i] = True
    return int(covered.sum())


def vote(rule: Rule) -> Column:
    """1 good, -1 bad, 0 abstains."""
    return F.when(F.expr(rule.bad), -1).when(F.expr(rule.good), 1).otherwise(0).cast("int")


@dataclass(frozen=True)
class Model:
    """What each rule's good and bad votes add to the log odds that a document is good, and those odds before any vote."""

    if_good: np.ndarray
    if_bad: np.ndarray
    odds: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.odds + (patterns == 1) @ self.if_good + (patterns == -1) @ self.if_bad)))


def estimate(patterns: np.ndarray, counts: np.ndarray, prior: float = PRIOR) -> Model:
    """Expectation-maximisation over how many documents (counts) have each pattern of votes.

    A rule that votes has one accuracy on good and one on bad documents, independent of the other rules
    given the class; an abstention says nothing. No rule may count the wrong way: a bad vote never
    raises the odds and a good one never lowers them. With pseudo-counts the result is defined for any
    votes, none included, and it depends on the counts alone, not on the order of rows.
    """
    good, bad = (patterns == 1).astype(float), (patterns == -1).astype(float)
    false_bad, true_bad, share = np.full(patterns.shape[1], BAD_IF_GOOD), np.full(patterns.shape[1], BAD_IF_BAD), GOOD_SHARE
    for _ in range(STEPS):
        model = Model(np.maximum(0, np.log((1 - false_bad) / (1 - true_bad))), np.minimum(0, np.log(false_bad / true_bad)), float(np.log(share / (1 - share))))
        posterior = model.posterior(patterns)
        in_good, in_bad = counts * posterior, counts * (1 - posterior)
        false_bad = (in_good @ bad + prior * BAD_IF_GOOD) / (in_good @ (good + bad) + prior)
        true_bad = (in_bad @ bad + prior * BAD_IF_BAD) / (in_bad @ (good + bad) + prior)
        share = float(np.clip((in_good.sum() + GOOD_SHARE * prior) / (counts.sum() + prior), 0.05, 0.95))
    return model


def judge_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50, min_posterior: float = 0.5) -> DataFrame:
    """doc_id, text_mark, is_listed, the features, base_failed, quality (posterior) and kept for every row of docs(doc_id, text, and lang if there is one).

    base_failed: fewer than min_words words, or over max_repeat_percent of them in repeated windows of three
    words. kept: not base_failed, and a posterior of at least min_posterior. A null or empty text
    has no words, so it fails. Rows may repeat and doc_id may be null: a row is judged by its
    text and lang alone. Other columns are ignored; an empty table gives no rows.

    One scan of the texts; votes are counted by pattern (at most 3 ^ rules of them), and those counts
    are all that the estimation needs, so it takes in every document at any size.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "quality")
    found = space.stage(base_features(docs), "features")
    names = [r.name for r in rules]
    voted = found.select("*", *[vote(r).alias(f"vote_{r.name}") for r in rules])
    counts = voted.groupBy(*[f"vote_{n}" for n in names]).agg(F.count("*").alias("n")).collect()
    patterns = np.array(sorted(tuple(r)[:-1] for r in counts), int).reshape(-1, len(rules))
    sizes = {tuple(r)[:-1]: r["n"] for r in counts}
    model = estimate(patterns, np.array([sizes[tuple(p)] for p in patterns.tolist()], float).reshape(-1))
    odds = F.lit(model.odds)
    for name, up, down in zip(names, model.if_good.tolist(), model.if_bad.tolist(), strict=True):
        odds = odds + F.when(F.col(f"vote_{name}") == 1, up).when(F.col(f"vote_{name}") == -1, down).otherwise(0.0)
    failed = F.expr(f"n_words < {int(min_words)} or 100 * n_repeat_words > {int(max_repeat_percent)} * n_words")
    judged = voted.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= min_posterior))


def _judged_columns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", *[c for c in ("lang",) if c in docs.columns])


def keep_quality(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The rows of docs that judge_quality keeps, with all their columns.

    Rows without a doc_id are judged by their own texts; of rows that repeat doc_id and text none is kept if one is rejected.
    """
    rejected = judge_quality(_judged_columns(docs), min_words=min_words).filter("not kept").select("doc_id", "text_mark")
    return without(docs, Workspace(docs.sparkSession, "quality").stage(rejected, "rejected"))


def op7_quality_rules(spark: SparkSession, docs: DataFrame) -> DataFrame:
    judged = judge_quality(_judged_columns(docs))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")

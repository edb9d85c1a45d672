"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation learns how far to trust each.

Every rule looks at a few counts of the whole text and votes good (+1), bad (-1) or abstains (0). A
two-class model with one accuracy per rule and class is fitted to the table of vote patterns, which
has at most 3^rules rows whatever the corpus size; the posterior probability of "good" replaces a
conjunction of hard thresholds.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.llm._common import check_absent, fresh, release, stored

#: Characters counted as symbols, ASCII white space, frequent function words.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it for on was be with as by this are from or an at not have "
    "de la que el en los se del las un por con una su para es al lo como más "
    "le les des et une du est pour dans qui au sur pas plus par il elle ce ne avec "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es er sie".split()
)
_FUNCTION_BYTES = frozenset(w.encode() for w in FUNCTION_WORDS)

_COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_function", "n_upper", "n_letters", "n_stops",
    "n_marks", "n_runs", "n_bare"
]
COUNTS_TYPE = "struct<" + ", ".join(f"{c}: bigint" for c in _COUNTS) + ">"
_STRIP = b".,;:!?\"'()[]"
_ENDS = (b".", b"!", b"?")
_MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalpha())
_PUNCTUATION = frozenset(c for c in _MARKS if not chr(c).isdigit())


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def text_counts(text: bytes | None, common: frozenset[bytes] = _FUNCTION_BYTES) -> tuple:
    """The counts in the order of COUNTS_TYPE, common: function words; null and empty texts have only zeros."""
    if not text:
        return (0,) * len(_COUNTS)
    words = text.split()
    chars = len(text) - sum(text.count(bytes([c])) for c in SPACES)
    seconds = len(text) - len(text.translate(None, bytes(range(0x80, 0xC0)))) if not text.isascii() else 0
    seen, duplicates, lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                duplicates += 1
            else:
                seen.add(line)
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(text) - len(text.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    marks = len(text) - len(text.translate(None, _MARKS))
    function = stops = runs = bare = 0
    for w, n in Counter(words).items():
        core = w.strip(_STRIP)
        if core in common or core[:1].lower() + core[1:] in common:
            function += n
        if w[-1] in _PUNCTUATION:
            if w.endswith(_ENDS):
                stops += n
            if w[-2:-1] == w[-1:]:
                runs += n
            if not w.strip(_MARKS):
                bare += n
    symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    return (len(words), chars - seconds, symbols, duplicates, repeated_words(words), lines, function, upper, upper + lower, stops, marks, runs, bare)


def counts_column(text: Column, function_words: frozenset[str] = FUNCTION_WORDS) -> Column:
    common = frozenset(w.encode() for w in function_words)

    @F.arrow_udf(COUNTS_TYPE)
    def run(texts):
        import pyarrow as pa

        release()
        rows = [text_counts(t.as_py(), common) for t in texts]
        columns = list(zip(*rows)) if rows else [[] for _ in _COUNTS]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], _COUNTS)

    return run(text.cast("binary"))


@dataclass(frozen=True)
class QualityParams:
    """min_words and max_repeat: the base rule. keep_at: posterior from which a document is kept.
    rounds, tolerance: limits of expectation-maximisation. prior: pseudo-counts (right, wrong) of a vote.
    function_words: frequent words of the languages that the corpus is expected to hold; prose in any other
    language gets one bad vote for having none of them, so give the list of the languages at hand."""

    min_words: int = 50
    max_repeat: float = 0.5
    keep_at: float = 0.5
    rounds: int = 200
    tolerance: float = 1e-9
    prior: tuple[float, float] = (4.0, 1.0)
    good_share: float = 0.8
    function_words: frozenset[str] = FUNCTION_WORDS


def votes(c: Column) -> list[tuple[str, Column]]:
    """The rules, over a struct of counts; each is 1, -1 or 0."""
    n = F.greatest(c["n_words"], F.lit(1)).cast("double")
    rule = lambda bad, good=F.lit(False): F.when(bad, -1).when(good, 1).otherwise(0)
    symbols, function, stops, runs, bare = (c[x] / n for x in ("n_symbols", "n_function", "n_stops", "n_runs", "n_bare"))
    marks = c["n_marks"] / F.greatest(c["word_chars"], F.lit(1))
    upper = c["n_upper"] / F.greatest(c["n_letters"], F.lit(1))
    return [
        ("length", rule(c["n_words"] < 50)),
        ("symbols", rule(symbols > 0.15, symbols < 0.03)),
        ("marks", rule(marks > 0.14, marks < 0.10)),
        ("capitals", rule(upper > 0.4, upper < 0.15)),
        ("sentences", rule((stops > 0.5) | (stops < 0.005), (stops > 0.02) & (stops < 0.35))),
        ("function_words", rule(function < 0.02, function > 0.08)),
        ("runs", rule(runs > 0.3, runs < 0.02)),
        ("bare_marks", rule(bare > 0.15, bare < 0.02)),
        ("duplicate_lines", rule(c["n_dup_lines"] > 0.3 * c["n_lines"])),
        ("repetition", rule(c["n_repeat_words"] > 0.3 * n)),
    ]


def pattern_column(ballot: list[Column]) -> Column:
    """The votes as one number in base 3."""
    out = F.lit(0)
    for v in reversed(ballot):
        out = out * 3 + (v + 1)
    return out.cast("int")


def fit_votes(patterns: np.ndarray, weights: np.ndarray, rules: int, p: QualityParams = QualityParams()) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of "good" per pattern, P(vote | class) as [rule, class, vote + 1], the share of good documents.

    The accuracies are P(-1 | bad) and P(+1 | good); abstaining has a probability of its own, so that
    rules which only ever vote against a document fit in. Pseudo-counts favour right votes, and the
    start is a weighted majority, which fixes what the two classes mean.
    """
    ballots = np.array([[x // 3**j % 3 for j in range(rules)] for x in patterns], dtype=np.int64).reshape(-1, rules)
    good, bad = (ballots == 2).sum(1), (ballots == 0).sum(1)
    post = 1 / (1 + np.exp(-(good - 3.0 * bad + np.log(p.good_share / (1 - p.good_share)))))
    right, wrong = p.prior
    extra = np.array([[right, right, wrong], [wrong, right, right]])
    table, share, last = np.zeros((rules, 2, 3)), p.good_share, -np.inf
    for _ in range(p.rounds):
        share = float(np.clip((weights @ post + p.good_share) / (weights.sum() + 1), 0.02, 0.98))
        for j in range(rules):
            for y, w in ((0, weights * (1 - post)), (1, weights * post)):
                n = np.bincount(ballots[:, j], w, 3) + extra[y]
                table[j, y] = n / n.sum()
        log = np.log(table)
        both = np.stack([np.log(1 - share) + log[np.arange(rules), 0, ballots].sum(1), np.log(share) + log[np.arange(rules), 1, ballots].sum(1)])
        total = np.logaddexp(*both)
        post = np.exp(both[1] - total)
        now = float(weights @ total) / max(weights.sum(), 1)
        if now - last < p.tolerance:
            break
        last = now
    return post, table, share


def judge_quality(docs: DataFrame, text_col: str = "text", params: QualityParams = QualityParams(), out: str = "quality", keep_text: bool = True) -> DataFrame:
    """docs with a struct column `out`: the counts, votes, posterior, base_failed and kept.

    The votes of all documents are counted; texts are read twice (counts are cheaper than shuffling
    or storing texts) unless keep_text is False, when texts are dropped and counts stored instead.
    Null and empty texts have zero counts, fail the base rule and are not kept. Repeated rows are
    judged alike. Other columns pass through, whatever they are called; `out` must not be one of them.
    Empty input: no rows.
    """
    check_absent(docs, out)
    counted = docs.withColumn(out, counts_column(F.col(text_col), params.function_words))
    if not keep_text:
        counted = stored(counted.drop(text_col), "quality")
    ballot = votes(F.col(out))
    pattern = pattern_column([v for _, v in ballot])
    found = counted.select(pattern.alias("pattern")).groupBy("pattern").count().collect()
    patterns = np.array([r["pattern"] for r in found], dtype=np.int64)
    post, _, _ = fit_votes(patterns, np.array([r["count"] for r in found], dtype=float), len(ballot), params)
    known, posterior = fresh(docs, "pattern"), fresh(docs, "posterior")
    # at most 3^rules rows, whatever the input
    learned = docs.sparkSession.createDataFrame([(int(a), float(b)) for a, b in zip(patterns, post)], f"{known} int, {posterior} double")
    c = F.col(out)
    failed = (c["n_words"] < params.min_words) | (c["n_repeat_words"] > params.max_repeat * c["n_words"])
    full = counted.join(F.broadcast(learned), pattern == F.col(known), "left")
    fields = [c[n].alias(n) for n in _COUNTS] + [v.alias(f"vote_{n}") for n, v in ballot]
    verdict = F.struct(
        *fields, F.col(posterior).alias("posterior"), failed.alias("base_failed"),
        (~failed & (F.col(posterior) >= params.keep_at)).alias("kept")
    )
    return full.withColumn(out, verdict).drop(known, posterior)

"""Weak supervision of text quality with DataFrame functions only.

Rules vote good (1), bad (-1) or abstain (0). The table of vote patterns (at most 3 to the
number of rules, counted over all rows) is all that expectation-maximisation needs. A row
is good or junk of one kind; every rule is meant for one kind, and several rules look at
each kind. The fit estimates the share of each class and how often a rule votes good on
each of them: its accuracy on good rows and on the junk it is meant for, freely, from
weak priors. (With a single class of junk, rules for different kinds are taken for noise of one
another.) A row's posterior probability of being good then takes the place of a filter
that every rule must pass: a bad vote that other rules contradict does not sink a row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.kernels import without
from pairlab.session import truncate_lineage

SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t-\\r]+"
REPEAT_WINDOW = 8
ROUNDS = 20
#: Start values: share of good rows; chance that a vote is right on a good row, and on a row of the
#: rule's own kind of junk (on other junk it votes as on good rows); and how many rows they weigh.
PRIOR_GOOD, PRIOR_RIGHT, PRIOR_ROWS = 0.7, (0.8, 0.7), 10.0
GOOD_FROM = 0.5


def text_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_distinct_words.

    Words are runs between white space. A null or empty text has zeros everywhere. Windows of
    eight words are compared by 64-bit hashes inside one text, in arrays: nothing is exploded
    or shuffled. Most texts repeat no window, which the distinct count shows at once.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct_words"]
    df = without(df, *made)
    keep = df.columns
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bare = F.btrim(body, F.lit(SPACE))
    none = F.array().cast("array<string>")
    words = F.when(bare == "", none).otherwise(F.split(bare, SPACE_RUN))
    left = lambda pattern: F.length(F.regexp_replace(body, pattern, "")).cast("bigint")
    t = df.select(
        *keep,
        words.alias("_w"),
        F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("_lines"),
        left("[^#*$%&|<>]+").alias("n_symbols"),
        left("[^\\p{Lu}]+").alias("n_upper"),
    )
    w, n = F.col("_w"), F.size("_w")
    windows = F.transform(F.sequence(F.lit(0), n - REPEAT_WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(REPEAT_WINDOW)]))
    t = t.select(
        *keep, "n_symbols", "n_upper",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.size(F.array_distinct("_w")).cast("bigint").alias("n_distinct_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(n >= REPEAT_WINDOW, windows).alias("_h"),
    )
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    numbered = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    t = t.select(*[c for c in t.columns if c != "_h"], F.when(again, numbered).alias("_p"))
    p = F.col("_p")
    same = lambda x, k: F.coalesce(x["h"] == F.get(p, k)["h"], F.lit(False))
    repeated = F.filter(p, lambda x, k: same(x, k - 1) | same(x, k + 1))
    t = t.withColumn("_at", F.sort_array(F.transform(repeated, lambda x: x["i"]))).drop("_p")
    at = F.col("_at")
    # a repeated window adds its words up to the next repeated window
    adds = F.transform(at, lambda x, k: F.least(F.coalesce(F.get(at, k + 1) - x, F.lit(REPEAT_WINDOW)), F.lit(REPEAT_WINDOW)))
    covered = F.aggregate(adds, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return t.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).select(*keep, *made)


def vote(good: str, bad: str) -> Column:
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


#: Name: (kind of junk, good when, bad when); between the two, and below five words, the rule
#: abstains from a good vote. In whole numbers over text_metrics.
RULES = {
    "symbols": ("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "symbol_share": ("symbols", "200 * n_symbols <= word_chars", "33 * n_symbols > word_chars"),
    "symbol_lines": ("symbols", "n_symbols <= n_lines", "n_symbols > 4 * n_lines"),
    "word_length": ("symbols", "word_chars between 4 * n_words and 7 * n_words", "2 * word_chars > 15 * n_words or 10 * word_chars < 33 * n_words"),
    "capitals": ("capitals", "10 * n_upper <= word_chars", "10 * n_upper > 3 * word_chars"),
    "capital_words": ("capitals", "3 * n_upper <= n_words", "n_upper > n_words"),
    "capital_lines": ("capitals", "5 * n_upper <= 25 * n_lines + n_words", "n_upper > 15 * n_lines and 2 * n_upper > n_words"),
    "repeats": ("repetition", "100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 30 * n_words"),
    "vocabulary": (
        "repetition",
        "n_words >= 20 and 100 * n_distinct_words >= least(50 * n_words, 20000)",
        "n_words >= 20 and 100 * n_distinct_words < least(30 * n_words, 12000)",
    ),
    "lines": ("repetition", "10 * n_dup_lines <= n_lines", "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
}
LEAST_WORDS = 5  # of a good vote


def vote(good: str, bad: str) -> Column:
    return F.when(F.expr(bad), -1).when(F.expr(f"n_words >= {LEAST_WORDS} and ({good})"), 1).otherwise(0)


def class_numbers(kinds: list[str]) -> list[int]:
    """For each rule the number of its junk class, from 1 in order of appearance."""
    names = list(dict.fromkeys(kinds))
    return [1 + names.index(k) for k in kinds]


@dataclass(frozen=True)
class LabelModel:
    """Shares of the classes (good first); for each rule the chance of a good vote by class, and its own junk class."""

    shares: tuple[float, ...]
    says: tuple[tuple[float, ...], ...]
    of: tuple[int, ...]

    @property
    def good(self) -> float:
        return self.shares[0]

    @property
    def right(self) -> tuple[tuple[float, float], ...]:
        """For each rule the chance that its vote is right on good rows, and on its own kind of junk."""
        return tuple((p[0], 1 - p[c]) for p, c in zip(self.says, self.of, strict=True))

    def classes(self, votes: Column) -> list[Column]:
        """Probability of each class for a row with this array of votes; abstentions say nothing."""

        def odds_of(c: int) -> Column:
            yes, no = (F.lit([math.log((p[c] if up else 1 - p[c]) / (p[0] if up else 1 - p[0])) for p in self.says]) for up in (True, False))
            gain = F.transform(votes, lambda v, k: F.when(v == 1, F.get(yes, k)).when(v == -1, F.get(no, k)).otherwise(F.lit(0.0)))
            return F.exp(F.aggregate(gain, F.lit(math.log(self.shares[c] / self.shares[0])), lambda a, x: a + x))

        odds = [odds_of(c) for c in range(1, len(self.shares))]
        good = F.lit(1.0) / reduce(lambda a, b: a + b, odds, F.lit(1.0))
        return [good, *[x * good for x in odds]]

    def posterior(self, votes: list[Column]) -> Column:
        """Probability that a row with these votes is good."""
        return self.classes(F.array(*votes))[0]


def fit_label_model(patterns: DataFrame, votes: list[str], count: str, rounds: int = ROUNDS, kinds: list[str] | None = None) -> LabelModel:
    """Expectation-maximisation over counted vote patterns; without ``kinds`` there is one class of junk.

    Start values count as ``PRIOR_ROWS`` rows in every estimate, so rules that never vote, or
    tables without good or without bad rows, keep finite parameters. A rule is no worse than
    chance: it votes good on good rows at least as often as on its junk. An empty table gives
    the start values.
    """
    of = tuple(class_numbers(kinds or ["junk"] * len(votes)))
    n_classes = 1 + max(of)
    prior_shares = (PRIOR_GOOD, *[(1 - PRIOR_GOOD) / (n_classes - 1)] * (n_classes - 1))
    prior = tuple(tuple(1 - PRIOR_RIGHT[1] if c == own else PRIOR_RIGHT[0] for c in range(n_classes)) for own in of)
    model = LabelModel(prior_shares, prior, of)
    rows = truncate_lineage(patterns.select(F.array(*[F.col(v) for v in votes]).alias("v"), F.col(count).cast("double").alias("n")).coalesce(1))
    weights = [f"g{c}" for c in range(n_classes)]
    for _ in range(rounds):
        odds = rows.select("v", "n", F.array(*model.classes(F.col("v"))).alias("g"))
        step = odds.select("n", "v", *[(F.col("n") * F.get("g", F.lit(c))).alias(w) for c, w in enumerate(weights)])
        # one row for each rule and vote, and one (rule null) for all patterns
        each = step.select(*weights, "n", F.explode(F.concat(F.array(F.struct(F.lit(None).cast("int").alias("k"), F.lit(1).alias("x"))), F.transform("v", lambda x, k: F.struct(k.alias("k"), x.alias("x"))))).alias("r"))
        sums = each.filter("r.x <> 0").groupBy("r.k", (F.col("r.x") == 1).alias("yes")).agg(F.sum("n").alias("n"), *[F.sum(w).alias(w) for w in weights]).collect()
        s = {"n": 0.0} | {w: 0.0 for w in weights} | {f"{x}{k}_{c}": 0.0 for x in ("yes", "all") for k in range(len(of)) for c in range(n_classes)}
        for r in sums:  # two rows for each rule
            if r["k"] is None:
                s["n"] = r["n"]
            for c, w in enumerate(weights):
                if r["k"] is None:
                    s[w] = r[w]
                else:
                    s[f"all{r['k']}_{c}"] += r[w]
                    s[f"yes{r['k']}_{c}"] += r[w] if r["yes"] else 0.0
        shares = tuple((s[w] + PRIOR_ROWS * p) / (s["n"] + PRIOR_ROWS) for w, p in zip(weights, prior_shares, strict=True))
        says = []
        for k, own in enumerate(of):
            p = [(s[f"yes{k}_{c}"] + PRIOR_ROWS * prior[k][c]) / (s[f"all{k}_{c}"] + PRIOR_ROWS) for c in range(n_classes)]
            if p[own] > p[0]:
                p[own] = p[0] = (p[own] + p[0]) / 2
            says.append(tuple(p))
        model = LabelModel(shares, tuple(says), of)
    return model


def judge(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (all but the text) with metrics, votes (``v_<rule>``), quality and good.

    Metrics are written once to a checkpoint; the model is fitted on the patterns of all rows.
    """
    carry = [c for c in df.columns if c != text] if carry is None else carry
    measured = text_metrics(df.select(*carry, text), text).drop(text)
    voted = measured.withColumns({f"v_{k}": vote(good, bad) for k, (_, good, bad) in RULES.items()})
    voted = truncate_lineage(voted)
    votes = [f"v_{k}" for k in RULES]
    patterns = truncate_lineage(voted.groupBy(*votes).agg(F.count("*").alias("_rows")).coalesce(1).sortWithinPartitions(*votes))
    model = fit_label_model(patterns, votes, "_rows", kinds=[kind for kind, _, _ in RULES.values()])
    quality = model.posterior([F.col(v) for v in votes])
    return voted.withColumn("quality", quality).withColumn("good", F.col("quality") >= GOOD_FROM)

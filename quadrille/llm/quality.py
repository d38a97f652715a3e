"""Quality rules by weak supervision (native).

Each rule votes good, bad or abstains, and for every kind of junk (DEFECTS) there are two rules or more that look at
different evidence.  Documents are counted by their pattern of votes; expectation-maximisation over the patterns, of
which there are 3 ** rules at most whatever the corpus, fits a mixture of good documents and one class for each kind of
junk, and so estimates how often each rule votes bad in each class.  The posterior probability of being good replaces a
filter that every rule must pass: a bad vote that the other rules on the same evidence contradict doesn't reject.  The
base rules (too few words, too much repetition) come first: what fails them is out, and no part of the estimate.

Kinds of junk have classes of their own so that a common kind doesn't make a rare one look good.

Defined cases: a null or empty text has no words, fails the base rules and is not kept.  Repeated rows are judged
alike, each for itself.  An empty table gives an empty result.  With ``carry``, input columns that have the name of a
result column are replaced; ``keep`` returns the input's columns as they were, whatever their names.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import SPACE, WORD, materialise, whole

#: Two hashes of a three-word window, 96 bits together, stand for it inside one document.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: No rule is taken to vote bad more rarely than this, or to miss more rarely, in any class.
LEAST_RATE = 0.01
#: What the classes are believed to be before any document is seen, and how many documents the belief counts for.
BELIEF, GOOD_SHARE, CAUGHT, ALARM = 50.0, 0.8, 0.8, 0.02

#: A line that ends with one of these is closed.
CLOSING = ".!?:;\"”»)।॥。！？…؟۔"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts", "n_closed", "n_marked", "n_others", "n_distinct", "n_long")
BASE = COUNTS[:5]
RESULT = (*COUNTS, "base_failed", "posterior", "kept")


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with the columns of COUNTS.  All work is inside the row.

    Write the result before filtering on it: a filter pushed below would repeat the work for every element.
    """
    text = whole(text_col)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.withColumn("__words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).withColumn("__lines", lines)
    word = lambda i: F.get(F.col("__words"), i)
    every = F.sequence(F.lit(0), F.size("__words") - 3)
    # Numbers are cheap to compare: a text whose windows all have hashes of their own repeats none.
    alone = F.transform(every, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))
    windows = F.when(
        (F.size("__words") >= 4) & (F.size(F.array_distinct(alone)) < F.size("__words") - 2),
        F.transform(
            every,
            lambda i: F.struct(F.xxhash64(word(i), word(i + 1), word(i + 2)).alias("a"), F.hash(word(i + 2), word(i), word(i + 1)).alias("b"), i.alias("at")),
        ),
    ).otherwise(F.array().cast("array<struct<a:bigint,b:int,at:int>>"))
    hashed = split.withColumn("__windows", F.sort_array(windows))
    twin = lambda x, k: F.coalesce((F.get("__windows", k).a == x.a) & (F.get("__windows", k).b == x.b), F.lit(False))
    places = F.sort_array(F.transform(F.filter("__windows", lambda x, k: twin(x, k - 1) | twin(x, k + 1)), lambda x: x.at))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a.n,
    )
    return hashed.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.concat_ws("", "__words")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": covered.cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
            "n_shouts": F.regexp_count(text, F.lit("!")).cast("long"),
            "n_closed": F.size(F.filter("__lines", lambda x: F.instr(F.lit(CLOSING), F.right(F.rtrim(x, F.lit(" \t\n\x0b\f\r")), F.lit(1))) > 0)).cast("long"),
            "n_marked": F.regexp_count(text, F.lit(r"[#*$%&|<>][^\x20\x09-\x0D]*+")).cast("long"),
            "n_others": F.regexp_count(text, F.lit(r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]")).cast("long"),
            "n_distinct": F.size(F.array_distinct("__words")).cast("long"),
            "n_long": F.size(F.filter("__words", lambda w: F.length(w) > 25)).cast("long"),
        }
    ).drop("__words", "__lines", "__windows")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 2).otherwise(1)


def rules() -> dict[str, Column]:
    """0 for bad, 1 to abstain, 2 for good."""
    c = F.col
    per_word = lambda n: c(n) / F.greatest(c("n_words"), F.lit(1))
    per_line = lambda n: c(n) / F.greatest(c("n_lines"), F.lit(1))
    per_char = lambda n: c(n) / F.greatest(c("word_chars"), F.lit(1))
    vocabulary = c("n_distinct") / F.sqrt(F.greatest(c("n_words"), F.lit(1)))
    return {
        "symbols": _vote(per_word("n_symbols") > 0.1, per_word("n_symbols") < 0.02),
        "marked words": _vote(per_word("n_marked") > 0.08, per_word("n_marked") < 0.02),
        "letters": _vote(per_char("n_others") > 0.15, per_char("n_others") < 0.07),
        "repeated lines": _vote((c("n_lines") >= 5) & (per_line("n_dup_lines") > 0.4), per_line("n_dup_lines") <= 0.1),
        "repeated words": _vote(per_word("n_repeat_words") > 0.3, per_word("n_repeat_words") < 0.2),
        "vocabulary": _vote(vocabulary < 3, vocabulary > 6),
        "capitals": _vote(per_char("n_capitals") > 0.3, per_char("n_capitals") < 0.15),
        "shouting": _vote(per_word("n_shouts") > 0.1, per_word("n_shouts") < 0.02),
        "word length": _vote((per_word("word_chars") < 2.5) | (per_word("word_chars") > 14), per_word("word_chars").between(3, 10)),
        "long words": _vote(per_word("n_long") > 0.1, per_word("n_long") < 0.02),
        "closed lines": _vote((c("n_lines") >= 3) & (per_line("n_closed") < 0.2), per_line("n_closed") > 0.6),
    }


#: Kinds of junk, and the rules that look for each.  Lists, verse and tables have open lines too: that rule looks for none.
DEFECTS = {
    "symbols": ("symbols", "marked words", "letters"),
    "repetition": ("repeated lines", "repeated words", "vocabulary"),
    "shouting": ("capitals", "shouting", "letters"),
    "wording": ("word length", "long words"),
}


class Mixture:
    """Shares of the classes, and each class's rate of bad votes among the votes of each rule.  Class 0 is good."""

    def __init__(self, shares: list[float], rates: list[list[float]]):
        self.shares, self.rates = shares, rates

    def log_masses(self, votes: list[int]) -> list[float]:
        """For each class, the logarithm of its share times the probability of the votes; abstentions add nothing."""
        return [math.log(share) + sum(math.log(r if v == 0 else 1 - r) for r, v in zip(rates, votes, strict=True) if v != 1) for share, rates in zip(self.shares, self.rates, strict=True)]

    def posterior(self, votes: list[int]) -> list[float]:
        logs = self.log_masses(votes)
        masses = [math.exp(x - max(logs)) for x in logs]
        return [m / sum(masses) for m in masses]


def fit(patterns: dict[int, int], names: list[str], defects: dict[str, tuple[str, ...]] = DEFECTS, rounds: int = 300) -> Mixture:
    """Expectation-maximisation over counts of vote patterns (base 3, first rule least).

    The belief (a share GOOD_SHARE is good; a rule votes bad on a share CAUGHT of the junk that it looks for and ALARM of
    all else) counts for BELIEF documents, at every size of the corpus.
    """
    own = [set(), *map(set, defects.values())]
    start = [GOOD_SHARE] + [(1 - GOOD_SHARE) / len(defects)] * len(defects)
    belief = [[CAUGHT if name in kind else ALARM for name in names] for kind in own]
    votes = {p: [p // 3**k % 3 for k in range(len(names))] for p in patterns}
    total = sum(patterns.values())
    now = Mixture(start, belief)
    for _ in range(rounds):
        post = {p: now.posterior(votes[p]) for p in patterns}
        shares = [(BELIEF * s + sum(n * post[p][c] for p, n in patterns.items())) / (BELIEF + total) for c, s in enumerate(start)]
        rates = []
        for c in range(len(own)):
            rates.append([])
            for k in range(len(names)):
                voted = sum(n * post[p][c] for p, n in patterns.items() if votes[p][k] != 1)
                bad = sum(n * post[p][c] for p, n in patterns.items() if votes[p][k] == 0)
                held = BELIEF * start[c]
                rates[-1].append(min(max((bad + held * belief[c][k]) / (voted + held), LEAST_RATE), 1 - LEAST_RATE))
        moved = max(abs(x - y) for x, y in zip([*shares, *sum(rates, [])], [*now.shares, *sum(now.rates, [])], strict=True))
        now = Mixture(shares, rates)
        if moved < 1e-9:
            break
    return now


def posteriors(model: Mixture, patterns: list[int], names: list[str]) -> list[tuple[int, float]]:
    """Each pattern with the probability of being good."""
    return [(p, model.posterior([p // 3**k % 3 for k in range(len(names))])[0]) for p in patterns]


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, carry: bool = False) -> DataFrame:
    """Per row: the id (with ``carry`` all columns), the counts, base_failed, posterior and kept.

    The counts are made in one pass over the texts and written, narrow unless ``carry``; votes are read from there.
    """
    names = [c for c in docs.columns if c.lower() not in RESULT] if carry else [id_col]
    return _judged(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, text_col])]), names, text_col, threshold)


def keep(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that are kept, with the columns that they came with."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    judged = _judged(held.withColumn("__text", F.col("__row").getField(text_col)), ["__row"], "__text", threshold)
    return judged.where("kept").select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


def _judged(docs: DataFrame, names: list[str], text_col: str, threshold: float) -> DataFrame:
    held = materialise(counted(docs, text_col).select(*[F.col(f"`{c}`") for c in names], *COUNTS), "quality-counts")
    by_name = rules()
    pattern = sum((v * 3**k for k, v in enumerate(by_name.values())), F.lit(0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    counts = held.groupBy(pattern.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~failed).alias("judged")).collect()
    model = fit({r.p: r.judged for r in counts if r.judged}, list(by_name))
    # One row for each pattern that occurs, 3 ** rules at most: a look-up takes the place of a long expression for each class.
    rows = json.dumps([{"__pattern": p, "posterior": x} for p, x in posteriors(model, [r.p for r in counts], list(by_name))])
    table = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<__pattern:int,posterior:double>>")))
    judged = held.withColumn("base_failed", failed).withColumn("__pattern", pattern).join(F.broadcast(table), "__pattern").drop("__pattern")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))

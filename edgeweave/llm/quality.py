"""Quality rules with risk-controlled cutoffs.

Every document gets counts (words, symbols, repeated lines, repeated 5-word
windows). A fixed base test rejects hopeless texts. Beyond it, each rule
compares one ratio with a cutoff that is chosen per stratum from labelled
documents: ``STEPS`` tightens the rules in turn, from no cutoff to the strictest
ones, and each step rejects what the step before rejects and more. A stratum
goes as far as every step passes an exact binomial test of "more than
``max_false_rejection`` of the good documents are rejected", by whichever rule.
Testing nested steps in a fixed sequence needs no correction within a stratum;
over strata the level is divided (Bonferroni). With probability ``1 - error``
no stratum loses more of its good documents than allowed.

DataFrame functions only. Nulls: a null text has no words; a null stratum is a
stratum of its own; labels that are null or contradict each other are left out.
Copies of a text count once in the test, since they are not independent. A
stratum with too few labelled documents gets no cutoff, and only the base test
applies to it. Repeated rows are judged row by row. ``quality_filter`` returns the
columns of its input untouched; ``with_features`` replaces those that clash with
the ones it adds. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WORD, let, materialise, words_of

#: Rule -> (ratio, cutoffs from mild to strict); a document is rejected above the cutoff.
RULES = {
    "symbols": ("n_symbols / word_chars", [2.0, 1.0, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02]),
    "dup_lines": ("n_dup_lines / n_lines", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "word_length": ("word_chars / n_words", [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0]),
}
#: The rules tightened in turn: (rule, number of its cutoff).
STEPS = [(r, i) for i in range(max(len(c) for _, c in RULES.values())) for r in RULES if i < len(RULES[r][1])]
MAX_FALSE_REJECTION = 0.01
ERROR = 0.05
SYMBOLS = "#*$%&|<>"


def _covered(words: Column) -> Column:
    """Words inside 5-word windows that occur at least twice in ``words``."""
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, 5)).alias("s"), i.alias("p"))))

    def positions(w: Column) -> Column:
        last = F.size(w) - 1
        twice = F.filter(
            F.sequence(F.lit(0), last),
            lambda k: F.coalesce(F.get(w, k)["s"] == F.get(w, k - 1)["s"], F.lit(False)) | F.coalesce(F.get(w, k)["s"] == F.get(w, k + 1)["s"], F.lit(False)),
        )
        return F.sort_array(F.transform(twice, lambda k: F.get(w, k)["p"]))

    return let(
        let(windows, positions),
        lambda at: F.aggregate(
            at,
            F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        ),
    )


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    step = docs.withColumns({"__t": t, "__words": words_of(t), "__lines": lines})
    step = step.withColumns({"__h": F.transform("__words", lambda w: F.xxhash64(w))})
    h = F.col("__h")
    window = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)])
    step = step.withColumns({"__win": F.when(F.size(h) >= 5, F.transform(F.sequence(F.lit(0), F.size(h) - 5), window)).otherwise(F.array().cast("array<bigint>"))})
    # equal windows have equal hashes: without equal hashes there is nothing to count, and the others are counted by their words
    repeat = F.when(F.size(F.array_distinct("__win")) < F.size("__win"), let(F.col("__words"), _covered)).otherwise(F.lit(0))
    step = step.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.translate("__t", WHITE, "")).cast("long"),
            "n_symbols": (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": repeat.cast("long"),
        }
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return step.withColumns({"base_failed": failed}).drop("__t", "__words", "__lines", "__h", "__win")


def _ratio(rule: str) -> Column:
    over, under = RULES[rule][0].split(" / ")
    return F.col(over).cast("double") / F.greatest(F.col(under), F.lit(1)).cast("double")


def _most_rejections(n: Column, share: float, level: Column) -> Column:
    """The largest k for which P(Binomial(n, share) <= k) <= level; -1 if there is none."""
    odds = F.log(F.lit(share / (1 - share)))
    x = n.cast("double")
    first = x * F.log(F.lit(1 - share))
    state = lambda p, c, k: F.struct(p.alias("p"), c.alias("c"), k.cast("long").alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] + F.log((x - i.cast("double") + 1.0) / i.cast("double")) + odds
        return let(F.struct(p.alias("p"), (acc["c"] + F.exp(p)).alias("c")), lambda s: state(s["p"], s["c"], F.when(s["c"] <= level, i).otherwise(acc["k"])))

    start = state(first, F.exp(first), F.when(F.exp(first) <= level, F.lit(0)).otherwise(F.lit(-1)))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(x * share).cast("long"))), start, step, lambda acc: acc["k"])


def first_step() -> Column:
    """The number of the first step that rejects a document by its features; null if none does."""
    out = []
    for rule, (_, grid) in RULES.items():
        steps = F.array(*[F.lit(k) for k, (r, _) in enumerate(STEPS) if r == rule])
        kept = sum((_ratio(rule) <= c).cast("int") for c in grid)  # cutoffs fall, so these are the first ones
        out.append(F.get(steps, kept))
    return F.least(*out)


def cutoffs(features: DataFrame, labels: DataFrame, stratum: str = "lang", max_false_rejection: float = MAX_FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """Per stratum the last step taken (null: none) and the cutoff of each rule there: stratum, n_good, step, c_<rule>.

    ``features`` needs doc_id, the stratum, a text hash ``__key`` and the feature columns.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("__lo"), F.max("quality").alias("__hi")).where("__lo = 1 and __hi = 1").select("doc_id")
    # labelled rows are the holdout: the rules are fixed beforehand and nothing was fitted to them
    good = features.where("not base_failed").join(marks, "doc_id", "left_semi")
    one = good.select(F.col(stratum).alias("stratum"), "__key", first_step().alias("first")).groupBy("stratum", "__key").agg(F.min("first").alias("first"))
    lost = [F.sum((F.col("first") <= k).cast("long")).alias(f"k_{k}") for k in range(len(STEPS))]
    table = one.groupBy("stratum").agg(F.count("*").alias("n_good"), *lost)
    tests = F.count("*").over(_everything())
    table = table.withColumn("k_max", _most_rejections(F.col("n_good"), max_false_rejection, F.lit(error) / tests.cast("double")))
    # the losses grow from step to step, so the last step that passes has only such before it
    table = table.withColumn("step", F.greatest(*[F.when(F.coalesce(F.col(f"k_{k}"), F.lit(0)) <= F.col("k_max"), F.lit(k)) for k in range(len(STEPS))]))

    def at_step(rule: str) -> Column:
        reached = [max((i for r, i in STEPS[: k + 1] if r == rule), default=-1) for k in range(len(STEPS))]
        return F.get(F.array(*[F.lit(RULES[rule][1][i] if i >= 0 else None).cast("double") for i in reached]), F.col("step"))

    return table.select("stratum", "n_good", "step", *[at_step(r).alias(f"c_{r}") for r in RULES])


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def judge(features: DataFrame, chosen: DataFrame, stratum: str = "lang") -> DataFrame:
    """``features`` with ``kept``. ``chosen`` is a table of one row per stratum, broadcast by Catalyst only if its size allows."""
    last = chosen.select(F.col("stratum").alias("__stratum"), F.col("step").alias("__step"))
    joined = features.join(last, features[stratum].eqNullSafe(last["__stratum"]), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(first_step() <= F.col("__step"), F.lit(False))).drop("__stratum", "__step")


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def quality_report(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row per document: doc_id, stratum, features, base_failed, kept. The texts are read once."""
    feats = with_features(docs.select("doc_id", "text", stratum).withColumn("__key", text_key())).drop("text")
    feats = materialise(feats, "quality")
    chosen = materialise(cutoffs(feats, labels, stratum).coalesce(1), "cutoffs")
    return judge(feats, chosen, stratum).drop("__key")


def quality_filter(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The documents that pass, with the columns of ``docs``. The features are computed once and stored beside the rows."""
    whole = docs.select(F.struct(*docs.columns).alias("__doc"), "doc_id", "text", stratum).withColumn("__key", text_key())
    feats = materialise(with_features(whole).drop("text"), "quality")
    chosen = materialise(cutoffs(feats.drop("__doc"), labels, stratum).coalesce(1), "cutoffs")
    return judge(feats, chosen, stratum).where("kept").select("__doc.*")

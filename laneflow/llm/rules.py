"""Quality rules with risk-controlled cutoffs.

Ratios of a text are held against cutoffs. One part of the labelled documents
plans, for each stratum, in which steps the rules become stricter; the others
prove how far they may go: after each step an exact binomial test has to deny
that all rules together reject more good documents than allowed. Tests follow
a sequence fixed beforehand, so only the strata have to share the error.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneflow.llm.base import WORD, held_out, once, stored

# Rule: value as SQL of the counts, and the cutoffs tried. A text fails above the cutoff.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols_per_word": ("try_divide(n_symbols, n_words)", [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7]),
    "repeated_words": ("try_divide(n_repeat_words, n_words)", [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4]),
    "repeated_lines": ("try_divide(n_dup_lines, n_lines)", [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5]),
    "chars_per_word": ("try_divide(word_chars, n_words)", [7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0]),
    "shortness_of_words": ("-try_divide(word_chars, n_words)", [-5.0, -4.5, -4.0, -3.5, -3.0, -2.5]),
    "bangs_per_word": ("try_divide(n_bangs, n_words)", [0.1, 0.2, 0.3, 0.5]),
    "upper_share": ("try_divide(n_upper, word_chars)", [0.2, 0.3, 0.4, 0.5, 0.6]),
}
LEAST_WORDS = 50


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first occurrence included.

    Windows are compared by 64-bit hashes: sorted with their places, equal ones
    are neighbours; places of repeated windows, sorted, cover up to three words each.
    """
    def windows(w: Column) -> Column:
        return F.sort_array(F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        ))

    def again(s: Column) -> Column:
        equal = lambda x, p: F.get(s, p)["h"] == x["h"]
        return F.sort_array(F.transform(
            F.filter(s, lambda x, p: F.coalesce(equal(x, p - 1), F.lit(False)) | F.coalesce(equal(x, p + 1), F.lit(False))),
            lambda x: x["i"],
        ))

    def covered(places: Column) -> Column:
        lengths = F.transform(places, lambda i, p: F.least(F.lit(3), F.coalesce(F.get(places, p + 1) - i, F.lit(3))))
        return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n)

    return F.when(
        F.size(words) >= 3, once(once(words, lambda w: once(windows(w), again)), covered)
    ).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> dict[str, Column]:
    """The counts of a whole text; a null text has none of anything."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return {
        "n_words": count(WORD),
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_bangs": count(r"[!?]"),
        "n_upper": count(r"\p{Lu}"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))),
    }


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for n trials, as the regularised incomplete beta function by its continued fraction."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
        result = d
        for m in range(1, 100_000):
            for top in (
                m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d = 1 / ((1 + top * d) or tiny)
                c = (1 + top / c) or tiny
                result *= c * d
            if abs(c * d - 1) < 1e-13:
                break
        return result

    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(p))
    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, p) / b


class Cutoff(NamedTuple):
    stratum: str
    rule: str
    cutoff: float
    good: int
    good_rejected: int
    bad_rejected: int
    p_value: float


def choose(
    counts: dict[tuple[str, str], dict[int, list[int]]], risk: float, error: float, price: float
) -> list[Cutoff]:
    """The cutoff of each stratum and rule, where one is proven safe and worth it.

    counts: by stratum and rule, for each number of cutoffs exceeded, the bad
    and the good documents. A cutoff is safe if the binomial test denies a false
    rejection rate of risk / rules at level error / tests (Bonferroni over every
    stratum, rule and cutoff), so with probability 1 - error all rates hold at
    once and a stratum loses at most `risk` of its good documents to all rules.
    Worth it: bad rejected less `price` times good rejected is above 0, largest first.
    """
    tests = sum(len(RULES[rule][1]) for _, rule in counts)
    chosen = []
    for (stratum, rule), exceeded in sorted(counts.items()):
        good = sum(c[1] for c in exceeded.values())
        best: Cutoff | None = None
        for i, cutoff in enumerate(RULES[rule][1]):
            bad_out = sum(c[0] for k, c in exceeded.items() if k > i)
            good_out = sum(c[1] for k, c in exceeded.items() if k > i)
            if not good or bad_out <= price * good_out:
                continue
            p = binomial_cdf(good_out, good, risk / len(RULES))
            found = Cutoff(stratum, rule, cutoff, good, good_out, bad_out, p)
            if p <= error / tests and (
                best is None or bad_out - price * good_out >= best.bad_rejected - price * best.good_rejected
            ):
                best = found
        if best:
            chosen.append(best)
    return chosen


Levels = dict[tuple[int, ...], list[int]]


def _rejected(levels: Levels, caps: list[int]) -> tuple[int, int]:
    """Bad and good documents that exceed more cutoffs of some rule than it has caps for."""
    bad = good = 0
    for exceeded, (b, g) in levels.items():
        if any(k > cap for k, cap in zip(exceeded, caps)):
            bad, good = bad + b, good + g
    return bad, good


def sequence(levels: Levels, price: float) -> list[tuple[str, list[int]]]:
    """Ever stricter caps, each step the tightening of one rule that is worth most on these documents.

    A rule with cap c rejects what exceeds more than c of its cutoffs. A step is
    worth the bad documents it newly rejects less `price` times the good ones;
    it may take several cutoffs of its rule at once. The sequence ends where none is worth anything.
    """
    caps, steps = [len(cutoffs) for _, cutoffs in RULES.values()], []
    while True:
        bad, good = _rejected(levels, caps)
        found = []
        for r, rule in enumerate(RULES):
            for cap in range(caps[r]):
                more = _rejected(levels, [*caps[:r], cap, *caps[r + 1 :]])
                worth = more[0] - bad - price * (more[1] - good)
                if worth > 0:
                    found.append((worth, cap, -r, rule))
        if not found:
            return steps
        _, cap, r, rule = max(found)
        caps = [*caps[:-r], cap, *caps[1 - r :]]
        steps.append((rule, caps))


def choose_sequences(
    planned: dict[str, Levels], proving: dict[str, Levels], risk: float, error: float, price: float
) -> list[Cutoff]:
    """The cutoffs of each stratum, proven together by fixed-sequence testing.

    Steps and their order come from the documents `planned`, the proof from
    others. In a stratum the steps are tested one after the other, up to the
    first that fails: that all rules together reject more than `risk` of the
    good documents has to be denied by the exact binomial test at the level error / strata. As the
    order is fixed beforehand, only the strata share the error: with
    probability 1 - error no stratum loses more than `risk` of its good documents.
    With s strata, a step that rejects no good document needs ln(s / error) / -ln(1 - risk) of them: 86 for four.
    """
    strata = sorted({*planned, *proving})
    chosen = []
    for stratum in strata:
        levels = proving.get(stratum, {})
        good = sum(g for _, g in levels.values())
        last: dict[str, Cutoff] = {}
        for rule, caps in sequence(planned.get(stratum, {}), price):
            bad_out, good_out = _rejected(levels, caps)
            p = binomial_cdf(good_out, good, risk) if good else 1.0
            if p > error / len(strata):
                break
            place = list(RULES).index(rule)
            last[rule] = Cutoff(stratum, rule, RULES[rule][1][caps[place]], good, good_out, bad_out, p)
        chosen += [last[rule] for rule in RULES if rule in last]
    return chosen


def learn(
    measured: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05, price: float = 20.0
) -> list[Cutoff]:
    """Cutoffs from all labelled rows that pass the base rules and are not kept back for checking a model.

    A third of the labelled ids, by a hash, plans the steps, the others prove
    them. Only counts by stratum and by how many cutoffs of each rule a document exceeds reach the
    driver, which the grid of the rules bounds. Null labels and ids with both labels are left out.
    """
    marks = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.min("quality").alias("_low"), F.max("quality").alias("_high"))
        .where("_low = _high")
    )
    exceeded = F.array(*[
        sum((F.coalesce(F.expr(value) > c, F.lit(False)).cast("int") for c in cutoffs), F.lit(0)) for value, cutoffs in RULES.values()
    ])
    plans = F.pmod(F.xxhash64(F.lit("plan"), F.col("_id").cast("string")), F.lit(3)) == 0
    found = (
        measured.where(~F.col("base_failed"))
        .join(marks, F.col("doc_id") == F.col("_id"))
        .select("stratum", "_low", plans.alias("plans"), exceeded.alias("exceeded"))
        .groupBy("stratum", "plans", "exceeded").pivot("_low", [0, 1]).count().na.fill(0).collect()
    )
    parts: dict[bool, dict[str, Levels]] = {True: {}, False: {}}
    for r in found:
        parts[r["plans"]].setdefault(r["stratum"], {})[tuple(r["exceeded"])] = [r["0"], r["1"]]
    return choose_sequences(parts[True], parts[False], risk, error, price)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str | None = "lang",
    **options: float,
) -> DataFrame:
    """One row per row of `docs`: doc_id, stratum, the counts of `measures`, base_failed, failed_rules, kept.

    Native functions only. Null and empty texts have counts of 0 and fail the
    base rules. A null stratum is a stratum named `none`; one without enough
    labels has no cutoffs and keeps whatever passes the base rules. Repeated
    rows and null ids are judged like others; an empty table gives an empty
    result. Labels other than 0 and 1 count for nothing.
    """
    stratum = F.lit("all") if stratum_col is None else F.coalesce(F.col(stratum_col).cast("string"), F.lit("none"))
    measured = docs.select(
        F.col(id_col).alias("doc_id"), stratum.alias("stratum"),
        *[c.alias(name) for name, c in measures(F.col(text_col)).items()],
    )
    measured = stored(measured.withColumn("base_failed", base_failed()), "rules")
    limits: dict[str, dict[str, float]] = {}
    for c in learn(measured, labels, **options):
        limits.setdefault(c.stratum, {})[c.rule] = c.cutoff
    # A row per stratum; a rule without a cutoff has none that anything is above. Without any, the row is for no stratum.
    row = lambda name, own: F.struct(
        F.lit(name).cast("string").alias("_stratum"), F.array(*[F.lit(own.get(rule)).cast("double") for rule in RULES]).alias("_limits")
    )
    known = docs.sparkSession.range(1).select(F.inline(F.array(*[row(*x) for x in limits.items()] or [row(None, {})])))
    fails = F.array(*[
        F.when(F.coalesce(F.expr(value) > F.get("_limits", F.lit(i)), F.lit(False)), rule)
        for i, (rule, (value, _)) in enumerate(RULES.items())
    ])
    judged = measured.join(known, F.col("stratum") == F.col("_stratum"), "left")
    failed = F.filter(fails, lambda r: r.isNotNull())
    return judged.withColumn("failed_rules", failed).drop("_stratum", "_limits").withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )

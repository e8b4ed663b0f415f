import collections
import math
import re

import pytest

from laneflow.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


def test_counts_equal_brute_force(spark, documents, words):
    w = words(8)
    texts = [w.text(w.random.randint(0, 80), line=w.random.randint(2, 9)) for _ in range(40)]
    texts += ["a b a b a b a", "a a a a", "x y", "x y z", "x y z x y z", "l\nl\n \n\nl\n", "   é|# \x0b\x0c\r\n😀 <>",
              "one two three " * 3000, None, "", " \n\t "]
    rows = [(i, t, ["en", None][i % 2]) for i, t in enumerate(texts)] + [(None, "no id " * 60), (3, texts[3])]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = rules.judge(documents(rows, extra=("n_words", "kept", "stratum")), labels).collect()
    assert len(found) == len(rows)
    for r in found:
        text = "no id " * 60 if r["doc_id"] is None else texts[r["doc_id"]] or ""
        n = brute(text)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r["kept"] == (not r["base_failed"])  # no labels, no cutoffs
    assert rules.judge(documents([]), labels).collect() == []


@pytest.mark.parametrize("n,p", [(10, 0.3), (57, 0.02), (400, 0.5), (3000, 0.001)])
def test_binomial_tail_is_exact(n, p):
    total = 0.0
    for k in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
        assert abs(rules.binomial_cdf(k, n, p) - min(total, 1)) < 1e-9
    assert rules.binomial_cdf(-1, n, p) == 0


def test_a_cutoff_needs_proof():
    rule = "symbols_per_word"
    few = {("en", rule): {9: [30, 0], 0: [0, 100]}}
    many = {("en", rule): {9: [30, 0], 0: [0, 5000]}}
    lossy = {("en", rule): {9: [30, 400], 0: [0, 5000]}}
    assert rules.choose(few, 0.05, 0.05, 20) == []
    assert rules.choose(lossy, 0.05, 0.05, 0.01) == []
    chosen = rules.choose(many, 0.05, 0.05, 20)
    assert [(c.rule, c.cutoff, c.good_rejected, c.bad_rejected) for c in chosen] == [(rule, 0.7, 0, 30)]
    tests = len(rules.RULES[rule][1])
    assert chosen[0].p_value <= 0.05 / tests
    # the same counts in many strata need more proof each
    level = {(f"s{i}", rule): {9: [30, 0], 0: [0, 1300]} for i in range(100)}
    assert rules.choose({("s0", rule): level[("s0", rule)]}, 0.05, 0.05, 20) and not rules.choose(level, 0.05, 0.05, 20)


def test_rejection_of_good_documents_is_bounded_and_bad_ones_go(spark, documents, words):
    rows, labels = [], []
    for i in range(2400):
        w = words(i)
        bad = i % 6 == 0
        text = " ".join(w.word() + ("%%" if bad else "") for _ in range(60))
        rows.append((i, text, "en"))
        labels.append((i, int(not bad), 0))
    found = rules.judge(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    kept = {r["doc_id"]: r["kept"] for r in found}
    good = [kept[i] for i, q, _ in labels if q]
    bad = [kept[i] for i, q, _ in labels if not q]
    assert sum(good) >= 0.95 * len(good)
    assert not any(bad)


def worst(levels, caps):
    return sum(g for k, (_, g) in levels.items() if any(a > b for a, b in zip(k, caps)))


def test_steps_are_proven_on_other_documents_one_after_the_other():
    n = len(rules.RULES)
    none, one, two = (0,) * n, (9,) + (0,) * (n - 1), (0, 7) + (0,) * (n - 2)
    plan = {none: [0, 200], one: [30, 0], two: [20, 0]}
    steps = rules.sequence(plan, 20.0)
    assert [rule for rule, _ in steps] == ["symbols_per_word", "repeated_words"]
    assert all(worst(plan, caps) == 0 for _, caps in steps)
    enough = rules.choose_sequences({"en": plan}, {"en": {none: [0, 59], one: [5, 0], two: [5, 0]}}, 0.05, 0.05, 20.0)
    assert {c.rule: c.cutoff for c in enough} == {"symbols_per_word": 0.7, "repeated_words": 0.4}
    assert rules.choose_sequences({"en": plan}, {"en": {none: [0, 58], one: [5, 0]}}, 0.05, 0.05, 20.0) == []
    # The second step loses good documents where it is proven: only the first stays, and its own rejections alone count.
    lossy = rules.choose_sequences({"en": plan}, {"en": {none: [0, 190], two: [5, 10]}}, 0.05, 0.05, 20.0)
    assert [c.rule for c in lossy] == ["symbols_per_word"]
    strata = {f"s{i}": plan for i in range(4)}
    for good, found in ((85, 0), (86, 8)):
        proving = {s: {none: [0, good]} for s in strata}
        assert len(rules.choose_sequences(strata, proving, 0.05, 0.05, 20.0)) == found


def test_the_error_rate_holds_in_simulation():
    """Good documents that a rule hits a little more often than allowed: it may pass as safe in one of twenty trials."""
    import random

    n, draw, wrong, trials = len(rules.RULES), random.Random(3), 0, 400
    none, hit = (0,) * n, (9,) + (0,) * (n - 1)
    plan = {"en": {none: [0, 300], hit: [50, 0]}}
    for _ in range(trials):
        lost = sum(draw.random() < 0.051 for _ in range(300))
        wrong += bool(rules.choose_sequences(plan, {"en": {none: [0, 300 - lost], hit: [50, lost]}}, 0.05, 0.05, 20.0))
    assert wrong <= 0.05 * trials + 3 * math.sqrt(0.05 * 0.95 * trials)


def test_a_few_hundred_labels_are_enough(spark, documents, words):
    rows, labels = [], []
    for i in range(480):
        w = words(i)
        bad = i % 4 == 0
        text = " ".join(w.word() + ("%%" if bad else "") for _ in range(60))
        rows.append((i, text, ["en", None][i // 4 % 2]))
        labels.append((i, int(not bad), 0))
    found = rules.judge(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert all(kept[i] for i, q, _ in labels if q)
    assert not any(kept[i] for i, q, _ in labels if not q)
    assert {tuple(r["failed_rules"]) for r in found if not r["kept"]} == {("symbols_per_word",)}

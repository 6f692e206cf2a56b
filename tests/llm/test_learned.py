"""Statistics by hand, and what is learned from labels: held-out accuracy, degenerate labels."""

import random
import re
from collections import Counter

import numpy as np
from cases import ODD, corpus
from gristmill.llm import language_id
from gristmill.llm.language_id import SEGMENT, Languages, apply_language_id, chosen, identify
from gristmill.llm.quality_classifier import RuleEnsemble, fit, lasso_logistic, quality_scores
from gristmill.llm.quality_rules import decision_list, quality_rules
from gristmill.llm.rules import Condition, compiled, holds, simplified
from gristmill.llm.statistics import statistics
from gristmill.llm.suffix_automaton import SuffixAutomaton
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")


def by_hand(t):
    w = WORD.findall(t or "")
    count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(t or ""), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered), len(set(w))


def test_statistics(spark, odd):
    rows = [(i, t) for i, t, _ in ODD] + corpus(8, 60) + [(900, "a b c d e a b c d e f\n\na b\na b\n a b"), (901, "#|<>$ %%\n\n\n")]
    got = statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = ("n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words")
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in got) == sorted((str(i), *by_hand(t)) for i, t in rows)
    assert statistics(odd).count() == len(ODD)


def labelled_docs(spark, n=600):
    r = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(15, 60))]
        good = r.random() < 0.7
        if not good:
            w = [x + r.choice(["|", "###", "$$"]) for x in w] if r.random() < 0.5 else w[:3] * 12
        docs.append((i, " ".join(w)))
        labels.append((i, int(good)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_quality(spark):
    docs, labels, truth = labelled_docs(spark)
    scored = quality_scores(docs, labels).collect()
    held = [r for r in scored if r["held_out"]]
    assert len(scored) == 600 and len(held) > 100
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    judged = quality_rules(docs, labels).collect()
    assert np.mean([r["kept"] == bool(truth[r["doc_id"]]) for r in judged if r["doc_id"] in {h["doc_id"] for h in held}]) > 0.95
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in judged)
    assert all(r["kept"] == (not r["base_failed"] and r["reason"] is None) for r in judged)


def test_labels_that_teach_nothing(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 0)], "doc_id long, quality int")
    assert {r["score"] for r in quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert len({r["score"] for r in quality_scores(odd, labels).collect()}) == 1
    assert quality_scores(odd, labels).count() == quality_rules(odd, labels).count() == len(ODD)
    assert quality_scores(none, labels).count() == quality_rules(none, labels).count() == 0


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels, _ = labelled_docs(spark, 200)
    changed = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    one, two = (sorted(map(tuple, quality_scores(docs, x).collect())) for x in (labels, changed))
    assert one == two


def test_rules():
    rule = simplified([Condition("a", True, 1.0), Condition("a", True, 2.0), Condition("b", False, 5.0), Condition("b", False, 3.0)])
    assert rule == (Condition("a", True, 2.0), Condition("b", False, 3.0))
    x = {"a": np.arange(300.0) % 10, "b": np.arange(300.0) // 10}
    poor = (x["a"] > 6) & (x["b"] <= 19)
    found = decision_list(x, poor)
    assert found and all(len(r) <= 4 for r in found)
    assert decision_list(x, np.zeros(300, bool)) == []
    model = fit(x, (~poor).astype(float), penalty=1e-3)
    assert ((model.predict(x, 300) >= 0.5) == ~poor).mean() > 0.97


def test_lasso_is_sparse():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 20))
    y = (x[:, 0] + 0.1 * r.normal(size=400) > 0).astype(float)
    w, _ = lasso_logistic(x, y, 0.05)
    assert w[0] > 0.5 and (w[1:] == 0).sum() >= 17


def test_suffix_automaton():
    r = random.Random(2)
    text = "".join(r.choice("abc") for _ in range(200))
    automaton = SuffixAutomaton(text)
    for _ in range(300):
        s = "".join(r.choice("abcd") for _ in range(r.randint(0, 30)))
        count, rest = 0, s
        while rest:
            k = 1
            while k < len(rest) and rest[: k + 1] in text:
                k += 1
            count, rest = count + 1, rest[k:]
        assert automaton.phrases(s) == count


def test_cross_parsing_of_whole_texts():
    """Phrases against a greedy parse by substring search, segment by segment."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 5))) for _ in range(30)]
    text = lambda k: "".join(r.choice(words) + r.choice([" ", ", ", "\n", " 12 "]) for _ in range(k))
    learned = {"xx": [text(40), text(5)], "yy": [text(60)]}
    written = lambda t: " " + "".join(w + " " for w in re.findall(r"[^\W\d_]+", t.lower()))
    texts = ["", "12 !", "Éa", "日本 abc", text(20), text(300), "abcd" * 200, "..." + text(3)]
    phrases, size = Languages(learned).parse(texts)
    for t, row, n in zip(texts, phrases, size):
        w = written(t)
        assert n == (len(w) if len(w) > 1 else 0)
        if n:
            for own, got in zip(learned.values(), row):
                known, count = "\n".join(map(written, own)), 0
                for rest in (w[k : k + SEGMENT] for k in range(0, len(w), SEGMENT)):
                    while rest:
                        k = 1
                        while k < len(rest) and rest[: k + 1] in known:
                            k += 1
                        count, rest = count + 1, rest[k:]
                assert got == count


def language_docs(spark):
    r = random.Random(4)
    stems = {"xx": "ka to mi re".split(), "yy": "sch ung ein tz".split(), "zz": "eau ou ique re".split()}
    rows = []
    for i in range(400):
        lang = r.choice(list(stems))
        rows.append((i, " ".join("".join(r.choice(stems[lang]) for _ in range(r.randint(1, 4))) for _ in range(12)), lang if r.random() < 0.9 else None, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


def test_language_id(spark, odd, none):
    docs = language_docs(spark)
    truth = {r["doc_id"]: r["truth"] for r in docs.collect()}
    got = identify(docs).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 60 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    found = sorted((str(r["doc_id"]), r["lang_pred"] == "und") for r in identify(odd).collect())
    assert found == sorted((str(i), not any(c.isalpha() for c in t or "")) for i, t, _ in ODD)
    assert identify(none).count() == 0
    assert {r["lang_pred"] for r in identify(odd.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}
    kept = apply_language_id(odd)
    assert kept.columns == odd.columns and None not in {r["lang"] for r in kept.collect()}


def test_a_language_of_long_texts_only_is_learned(spark):
    r = random.Random(6)
    write = lambda stems, n: " ".join("".join(r.choice(stems.split()) for _ in range(3)) for _ in range(n))
    rows = [(i, write("ka to mi re", 30), "xx") for i in range(20)] + [(100 + i, write("sch ung ein tz", 3000), "yy") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in identify(docs, sample_chars=5000).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_sample_of_a_language():
    assert chosen([(3, 40), (1, 50), (2, 30), (4, 10)], 95) == [1, 2, 4]
    assert chosen([(3, 40), (1, 50)], 10) == [3] and chosen([], 10) == []


def test_more_labels_than_are_learned(spark):
    """The commonest labels are learned, none raises."""
    rows = [(i, "abc def ghi " * 3, f"l{i % 690:03}") for i in range(700)] + [(1000 + i, "xyz uvw rst " * 3, "zz") for i in range(40)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got if r["doc_id"] >= 1000} == {"zz"}
    assert len({r["lang_pred"] for r in got}) <= language_id.MOST_LANGUAGES


def test_choice_of_language_against_the_parse(spark):
    """identify()'s language is the one of fewest phrases, and its score falls with the others' lead, by the automata themselves."""
    import math

    docs = language_docs(spark)
    texts = language_id.learning_texts(docs, "doc_id", "text", "lang", 24, 200_000)
    plain = {lang: SuffixAutomaton([s for t in own for s in [*(" " + "".join(w + " " for w in re.findall(r"[^\W\d_]+", t.lower()))), "\n"]]) for lang, own in texts.items()}
    for r in identify(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        w = " " + "".join(x + " " for x in re.findall(r"[^\W\d_]+", r["text"].lower()))
        p = {lang: sum(a.phrases(w[k : k + SEGMENT]) for k in range(0, len(w), SEGMENT)) for lang, a in plain.items()}
        best = min(p, key=lambda lang: (p[lang], lang))
        assert r["lang_pred"] == best and math.isclose(r["score"], 1 / sum(math.exp(-(x - p[best]) / math.sqrt(1 + p[best])) for x in p.values()))


def some_statistics(r, n):
    """Values on and beside thresholds, so that an exchanged comparison shows."""
    return {f: r.choice([0.0, 0.25, 0.5, 1.0, 1e-9, 3.0, -2.0, 1e12], n) for f in "abcd"}


def some_rule(r):
    return tuple(Condition(str(r.choice(list("abcd"))), bool(r.integers(2)), float(r.choice([0.0, 0.25, 0.5, 1.0, 3.0]))) for _ in range(r.integers(0, 4)))


def test_compiled_ensemble_scores_as_predicted(spark):
    r = np.random.default_rng(4)
    x = some_statistics(r, 400)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(*x.values()))], "i int, a double, b double, c double, d double")
    for _ in range(3):
        model = RuleEnsemble([(some_rule(r), float(r.normal())) for _ in range(25)], float(r.normal()))
        got = [v["s"] for v in df.select("i", model.score({f: F.col(f) for f in x}).alias("s")).orderBy("i").collect()]
        want = model.predict(x, 400)
        assert np.ptp(want) > 0.2 and np.allclose(got, want, rtol=0, atol=1e-12)


def test_compiled_decision_list_decides_as_its_rules(spark):
    r = np.random.default_rng(5)
    x = some_statistics(r, 400)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(*x.values()))], "i int, a double, b double, c double, d double")
    rules = [tuple(c) for c in (some_rule(r) for _ in range(12)) if c]
    verdict = F.lit(-1)
    for k, rule in reversed(list(enumerate(rules))):
        verdict = F.when(compiled(rule, {f: F.col(f) for f in x}), k).otherwise(verdict)
    got = [v["v"] for v in df.select("i", verdict.alias("v")).orderBy("i").collect()]
    on = [holds(rule, x, 400) for rule in rules]
    want = [next((k for k in range(len(rules)) if on[k][i]), -1) for i in range(400)]
    assert len(set(want)) > 4 and got == want


def test_learned_list_follows_the_labels():
    """Rules that are learned from two separate faults, applied in order, find both and leave the rest alone."""
    r = np.random.default_rng(6)
    x = {f: r.uniform(size=3000) for f in "abc"}
    poor = (x["a"] > 0.8) | ((x["b"] < 0.3) & (x["c"] > 0.6))
    found = decision_list(x, poor)
    on = np.any([holds(rule, x, 3000) for rule in found], axis=0)
    assert len(found) >= 2 and (on == poor).mean() > 0.95 and on[~poor].mean() < 0.03

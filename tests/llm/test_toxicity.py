"""The grammar against a plain matcher, what isolated words score, labels without documents, edges."""

import random
from itertools import chain, combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioweave.llm import toxicity as X
from folioweave.llm.toxicity import ADDRESS, INPUTS, INSULT, INTENT, LINK, NEGATION, OBJECT, OTHER, PERSONS, PREOBJECT, REPORT, THREAT
from folioweave.session import prepare, table

SF = "/root/testdata/sf0.01"
G = X.Grammar()


def plain(clause):
    """The best weight over all choices of matched words, each choice checked rule by rule; zero if there is none."""
    kinds = [c for c, _ in clause]
    at = [i for i, c in enumerate(kinds) if c in (INSULT, THREAT)]
    best = None
    for hits in map(set, chain.from_iterable(combinations(at, n) for n in range(1, len(at) + 1))):
        scores = [weigh(clause, kinds, hits, i) for i in hits]
        if None not in scores:
            total = sum(scores) + (G.targeted if any(c in PERSONS for c in kinds) else 0.0)
            best = total if best is None else max(best, total)
    return best if best is not None else 0.0


def weigh(clause, kinds, hits, i):
    """The weight of the hit at ``i``; None if no pattern allows it."""
    score = clause[i][1]
    if kinds[i] == INSULT:
        if not (i and kinds[i - 1] in (*PERSONS, LINK, NEGATION, REPORT, INSULT)):
            follows = i + 1 < len(kinds) and (kinds[i + 1] == OTHER or kinds[i + 1] in PERSONS or (kinds[i + 1] == INSULT and i + 1 in hits))
            if not follows:
                return None
            score += G.attributive
    else:
        before = next((k for k in range(i - 1, -1, -1) if kinds[k] not in (INTENT, LINK)), -1)
        held = before >= 0 and kinds[before] == PREOBJECT and i - before <= G.reach
        if not held:
            to = next((k for k in range(i + 1, len(kinds)) if kinds[k] in (ADDRESS, OBJECT, PREOBJECT)), None)
            if to is None or to - i > G.reach or not all(kinds[k] == LINK or (kinds[k] == INSULT and k in hits) or (kinds[k] == THREAT and k not in hits) for k in range(i + 1, to)):
                return None
        wills = [k for k in range(max(0, i - G.reach), i) if kinds[k] == INTENT and THREAT not in kinds[k:i]]
        score += G.intent if wills else 0.0
    score += G.negated if NEGATION in kinds[max(0, i - G.reach) : i] else 0.0
    return score + (G.reported if REPORT in kinds[:i] else 0.0)


def inside(clause):
    """Whether a threat with an object stands inside the stretch of another; the machine reads those one way only."""
    return sum(c == THREAT for c, _ in clause) > 1


def test_machine_equals_plain_matcher():
    rng, scorer = random.Random(5), X.Scorer(X.builtin_model())
    seen = 0
    for _ in range(6000):
        clause = [(c, rng.choice([1.0, 4.0, 6.0]) if c in (INSULT, THREAT) else 0.0) for c in rng.choices([*INPUTS, INSULT, INSULT, THREAT, LINK, LINK], k=rng.randint(1, 8))]
        if not inside(clause):
            want = plain(clause)
            assert scorer.clause(clause) == pytest.approx(want), clause
            seen += want > 0
    assert seen > 1000


def test_isolated_words_score_nothing_and_patterns_do():
    quiet = ["kill", "idiot", "to kill a process", "They kill time", "The world is round.", "He closed the door.", "clown", "Kill. Idiot. You."]
    loud = ["You are an idiot.", "you idiot", "stupid cows", "I will kill you", "te voy a matar", "ich werde dich umbringen", "I will hurt all of them"]
    scorer = X.Scorer(X.builtin_model())
    assert all(scorer.score(t) < 0.5 and not scorer.clauses(t)[0] for t in quiet)
    assert all(scorer.score(t) > 0.5 for t in loud)
    total = lambda t: sum(scorer.clauses(t)[0])
    assert total("I will kill you") > total("I kill you") > total("I will not kill you")
    assert total("You aren’t an idiot") == total("You aren't an idiot") < total("You are an idiot")
    assert total("She said you are an idiot") < total("you are an idiot")
    for part, text in (("insult", "idiot"), ("threat", "to kill a process"), ("negation", "You aren't an idiot"), ("report", "She said you are an idiot"), ("target", "You are an idiot")):
        other = X.Scorer(X.Model(scorer.model.words, {}, grammar=X.Grammar(without=(part,))))
        assert sum(other.clauses(text)[0]) != total(text)


def test_learned_model_leaves_ordinary_sentences(spark):
    prepare(spark)
    model = X.fit(table(spark, SF, "documents"), table(spark, SF, "labels"), ~X.held_out("doc_id", 5, 0))
    scorer = X.Scorer(model)
    for t in ("kill", "to kill a process", "They kill time.", "The world is round.", "He closed the door."):
        assert scorer.score(t) < 0.5
    assert scorer.score("You are an idiot.") > 0.5
    docs = table(spark, SF, "documents").select("doc_id", "text").withColumn("score", F.lit("clash")).withColumn("Predicted", F.lit(7))
    got = X.score(docs, model)
    assert got.columns[-2:] == ["score_", "predicted_"]
    for r in got.where("doc_id % 40 = 0").collect():
        clauses, tokens = [], X.tokens_of(r["text"])
        for t in [*tokens, "."]:
            if t[0] in ".!?;:\n":
                clauses.append([])
            else:
                clauses[-1:] = [[*(clauses[-1] if clauses else []), scorer.classify(t)]]
        found = [s for s in map(plain, (c for c in clauses if any(k in (INSULT, THREAT) for k, _ in c) and not inside(c))) if s > 0]
        x = np.log1p(sum(found)), np.log1p(100 * sum(found) / max(len(tokens), X.FEW_TOKENS)), max(found, default=0)
        assert r["score_"] == pytest.approx(1 / (1 + np.exp(-(model.curve[0] + np.dot(model.curve[1:], x)))), abs=1e-9)


def test_labels_of_unknown_ids_take_no_place_in_the_sample(spark):
    prepare(spark)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.range(0, 50_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert X.labelled_sample(docs, labels, "toxic", F.lit(True), 100, "text", "doc_id").count() == 40
    assert X.labelled_sample(docs, labels, "toxic", F.lit(True), 10, "text", "doc_id").count() == 10


def test_empty_tables_and_one_class(spark):
    prepare(spark)
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.fit(docs, labels, F.lit(True))
    assert model == X.builtin_model() and X.score(docs, model).collect() == []
    one = spark.createDataFrame([(1, "You are an idiot"), (2, None)], "doc_id long, text string")
    assert X.fit(one, spark.createDataFrame([(1, 1), (2, None), (3, 0)], "doc_id long, toxic int"), F.lit(True)) == X.builtin_model()

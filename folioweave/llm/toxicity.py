"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon turns each token into a class (insult, threat, persons, links such as articles and copulas, intent, negation,
report, clause end or other) with a weight. Five transducers are composed into one machine over the classes of a clause.
The insult transducer makes a hit of an insult in a pattern: after a link, person, report or other insult ("an idiot", "you
idiot"), or before the word it goes with ("stupid cows"). The threat transducer makes a hit of a threat with its object:
a person that follows, over links at most ("hurt all of you"), or one right before ("te voy a matar"); intent before it adds
weight. The negation and report transducers take weight from hits in their scope; the target transducer adds weight to
hits in a clause with a person, and accepts clauses with a hit. A word without its pattern is read as any other word,
so isolated words score nothing. The machine is nondeterministic (each word may be left unmatched); the weight of the best
accepted path is the clause's score. A logistic curve over the clause scores gives the document's score.

Insult weights are learned: log odds of words, and of word beginnings that several distinct words of toxic texts share,
between toxic and other labelled texts, chosen one by one so that each covers toxic texts that those before it do not.

Defined cases: a null or empty text scores as a text without a match; null labels, and labels of ids that no
document has, are ignored; an id labelled twice has its largest label; without toxic or without other labelled
texts the built-in lexicon and curve hold; repeated rows score alike; other columns pass untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.session import fresh, materialize

# Function words of English, German, French and Spanish by grammatical role, and the built-in lexicon.
NEGATIONS = "not no never cannot isn't aren't wasn't weren't don't doesn't didn't won't ain't nicht kein keine keinen nie niemals pas jamais aucun nunca jamás tampoco".split()
REPORTS = "said says wrote writes claimed claims reported reports quoted quotes called calls alleged allegedly sagte schrieb behauptete zitierte dit écrit affirmé cité dijo escribió afirmó citó".split()
ADDRESSED = "you your yourself you're u ihr tu toi tú usted ustedes".split()
SUBJECTS = "they he she they're he's she's du ils elle elles eux ellos ella".split()
OBJECTS = "them him her themselves himself herself".split()
BEFORE = "dich euch dein te vous votre os".split()
LINKS = "a an the this that these those such so very really total complete utter is are was were be been am i'm all of every each both any one ist sind war bist ein eine einen der die das sehr est sont es un une le la les si très des son era eres una el los las muy tan".split()
INTENTS = "will shall should must gonna wanna going want would i'll we'll werde werden soll sollte muss vais va allons dois doit voy vamos debo quiero".split()
THREATS = "kill murder hurt destroy attack strangle stab shoot töten umbringen verprügeln tuer frapper détruire matar golpear destruir".split()
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown".split()

OTHER, INSULT, THREAT, ADDRESS, SUBJECT, OBJECT, PREOBJECT, LINK, INTENT, NEGATION, REPORT, HIT, END = range(13)
PERSONS = (ADDRESS, SUBJECT, OBJECT, PREOBJECT)
#: What the machine reads; HIT is only ever an output.
INPUTS = tuple(range(HIT))
TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[.!?;:\n]+")
LEAST_STEM, MOST_STEM = 3, 7
#: Distinct toxic words that must share a beginning, from LONG_STEM letters on and below.
LONG_STEM, LONG_WORDS, SHORT_WORDS = 5, 4, 8
#: Texts with fewer tokens count as having so many, where scores are taken by token.
FEW_TOKENS = 50

Arc = tuple[int, float, object]


@dataclass
class Transducer:
    """Arcs by (state, input): outputs, weights and next states. ``accepts`` holds the accepting states."""

    start: object
    arcs: dict[tuple[object, int], list[Arc]] = field(default_factory=dict)
    accepts: set = field(default_factory=set)

    def arc(self, state: object, read: int, write: int, weight: float, to: object) -> None:
        self.arcs.setdefault((state, read), []).append((write, weight, to))

    def compose(self, other: Transducer) -> Transducer:
        """The machine that feeds this one's outputs to ``other``; weights add, both must accept."""
        start = (self.start, other.start)
        out, todo, seen = Transducer(start), [start], {start}
        while todo:
            a, b = todo.pop()
            if a in self.accepts and b in other.accepts:
                out.accepts.add((a, b))
            for read in INPUTS:
                for middle, w, a2 in self.arcs.get((a, read), ()):
                    for write, v, b2 in other.arcs.get((b, middle), ()):
                        out.arc((a, b), read, write, w + v, (a2, b2))
                        if (a2, b2) not in seen:
                            seen.add((a2, b2))
                            todo.append((a2, b2))
        return out


def insults(attributive: float) -> Transducer:
    """Insults in a pattern become hits. States: what came before; ``owed``, if the word that an insult goes with must follow."""
    t = Transducer("open", accepts={"open", "near", "chain"})
    after = {c: "near" if c in (*PERSONS, LINK, NEGATION, REPORT) else "open" for c in INPUTS if c != INSULT}
    for state in ("open", "near", "chain", "owed"):
        for c, to in after.items():
            if state != "owed" or c == OTHER or c in PERSONS:
                t.arc(state, c, c, 0.0, to)
        if state == "open":
            t.arc(state, INSULT, OTHER, 0.0, "chain")
            t.arc(state, INSULT, HIT, attributive, "owed")
        else:
            t.arc(state, INSULT, HIT, 0.0, "chain")
            if state != "owed":
                t.arc(state, INSULT, OTHER, 0.0, "chain")
    return t


def threats(intent: float, reach: int) -> Transducer:
    """Threats with their object become hits. States: (intent left, object before, object owed), each a count of tokens or 0."""
    t, start = Transducer((0, 0, 0)), (0, 0, 0)
    todo, seen = [start], {start}

    def go(state: tuple[int, int, int], read: int, write: int, weight: float, to: tuple[int, int, int]) -> None:
        t.arc(state, read, write, weight, to)
        if to not in seen:
            seen.add(to)
            todo.append(to)

    while todo:
        state = todo.pop()
        will, held, owed = state
        if not owed:
            t.accepts.add(state)
        for c in (*INPUTS, HIT):
            ahead = (reach if c == INTENT else max(0, will - 1), reach if c == PREOBJECT else max(0, held - 1) if c in (INTENT, LINK) else 0)
            if c == THREAT:
                if owed:
                    if owed > 1:
                        go(state, c, OTHER, 0.0, (0, 0, owed - 1))
                    continue
                go(state, c, OTHER, 0.0, (0, 0, 0))
                bonus = intent if will else 0.0
                go(state, c, HIT, bonus, (0, 0, 0) if held else (0, 0, reach))
            elif not owed:
                go(state, c, c, 0.0, (*ahead, 0))
            elif c in (ADDRESS, OBJECT, PREOBJECT):
                go(state, c, c, 0.0, (*ahead, 0))
            elif c in (LINK, HIT) and owed > 1:
                go(state, c, c, 0.0, (0, 0, owed - 1))
    return t


def words(kind: int) -> Transducer:
    """Each word of a class becomes a hit."""
    t = Transducer(0, accepts={0})
    for c in (*INPUTS, HIT):
        t.arc(0, c, HIT if c == kind else c, 0.0, 0)
    return t


def negation(negated: float, reach: int) -> Transducer:
    """Hits up to ``reach`` tokens after a negation lose weight."""
    t = Transducer(0, accepts=set(range(reach + 1)))
    for left in range(reach + 1):
        for c in (*INPUTS, HIT):
            t.arc(left, c, OTHER if c == NEGATION else c, negated if c == HIT and left else 0.0, reach if c == NEGATION else max(0, left - 1))
    return t


def report(reported: float) -> Transducer:
    """Hits after a verb of report lose weight."""
    t = Transducer(False, accepts={False, True})
    for said in (False, True):
        for c in (*INPUTS, HIT):
            t.arc(said, c, OTHER if c == REPORT else c, reported if c == HIT and said else 0.0, said or c == REPORT)
    return t


def target(targeted: float) -> Transducer:
    """The first hit of a clause with a person gains weight; clauses with a hit are accepted. States: (person seen, hit seen)."""
    t = Transducer((False, False), accepts={(False, True), (True, True)})
    for person in (False, True):
        for hit in (False, True):
            for c in (*INPUTS, HIT):
                gain = (c == HIT and person and not hit) or (c in PERSONS and hit and not person)
                t.arc((person, hit), c, c, targeted if gain else 0.0, (person or c in PERSONS, hit or c == HIT))
    return t


@dataclass(frozen=True)
class Grammar:
    """Weights of the grammar's arcs, in log odds, and the reach of negation, intent and objects in tokens.

    ``without`` names transducers that do nothing, to measure what each is for: without the insult or the threat
    transducer, each word of the class is a hit.
    """

    attributive: float = -0.5
    intent: float = 1.5
    negated: float = -4.0
    reported: float = -2.5
    targeted: float = 0.7
    reach: int = 3
    without: tuple[str, ...] = ()

    def machine(self) -> Transducer:
        parts = {
            "insult": lambda on: insults(self.attributive) if on else words(INSULT),
            "threat": lambda on: threats(self.intent, self.reach) if on else words(THREAT),
            "negation": lambda on: negation(self.negated if on else 0.0, self.reach),
            "report": lambda on: report(self.reported if on else 0.0),
            "target": lambda on: target(self.targeted if on else 0.0),
        }
        out = None
        for name, part in parts.items():
            made = part(name not in self.without)
            out = made if out is None else out.compose(made)
        return out


#: One object for all tokens without a class.
PLAIN = (OTHER, 0.0)
Table = tuple[list[list[list[tuple[int, float, bool]]]], list[bool], int]


@lru_cache(maxsize=8)
def table_of(grammar: Grammar) -> Table:
    """The composed machine with numbered states: by state and class the next states, weights and whether the word's own
    weight counts; acceptance; the start."""
    m = grammar.machine()
    number: dict[object, int] = {m.start: 0}
    for (s, _), arcs in m.arcs.items():
        for x in (s, *(to for _, _, to in arcs)):
            number.setdefault(x, len(number))
    rows = [[[] for _ in INPUTS] for _ in number]
    for (s, c), arcs in m.arcs.items():
        rows[number[s]][c] = [(number[to], w, write == HIT) for write, w, to in arcs]
    return rows, [s in m.accepts for s in number], 0


@dataclass(frozen=True)
class Model:
    """``words`` and ``stems`` carry insult weights; ``curve`` turns ``clause_features`` into a probability."""

    words: dict[str, float]
    stems: dict[str, float]
    curve: tuple[float, ...] = (-3.0, 2.0, 0.0, 0.5)
    grammar: Grammar = field(default_factory=Grammar)


def builtin_model() -> Model:
    return Model({w: 4.0 for w in INSULTS}, {})


def stems(token: str) -> Iterable[str]:
    return (token[:k] for k in range(LEAST_STEM, min(MOST_STEM, len(token) - 1) + 1))


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower().replace("’", "'")) if text else []


class Scorer:
    """A model made ready to score texts; holds a bounded cache of the classes of short tokens."""

    CACHE, CACHED_CHARS = 500_000, 40

    def __init__(self, model: Model):
        self.model = model
        self.rows, self.accepting, self.start = table_of(model.grammar)
        roles = ((THREAT, 3.0, THREATS), (ADDRESS, 0.0, ADDRESSED), (SUBJECT, 0.0, SUBJECTS), (OBJECT, 0.0, OBJECTS), (PREOBJECT, 0.0, BEFORE), (LINK, 0.0, LINKS), (INTENT, 0.0, INTENTS), (NEGATION, 0.0, NEGATIONS), (REPORT, 0.0, REPORTS))
        self.fixed = {w: (c, weight) for c, weight, words in roles for w in words}
        self.cache: dict[str, tuple[int, float]] = {}

    def classify(self, token: str) -> tuple[int, float]:
        m = self.model
        weight = max((m.words.get(token, 0.0), *(m.stems.get(s, 0.0) for s in stems(token)))) if m.stems else m.words.get(token, 0.0)
        if weight > 0:
            found = (INSULT, weight)
        elif token[0] in ".!?;:\n":
            found = (END, 0.0)
        else:
            found = self.fixed.get(token, PLAIN)
        if len(token) <= self.CACHED_CHARS:
            if len(self.cache) >= self.CACHE:
                self.cache.clear()
            self.cache[token] = found
        return found

    def clause(self, classes: list[tuple[int, float]]) -> float:
        """The weight of the best accepted path over a clause's classes; zero if none is accepted."""
        paths = {self.start: 0.0}
        for c, weight in classes:
            new: dict[int, float] = {}
            for state, score in paths.items():
                for to, step, counts in self.rows[state][c]:
                    total = score + step + (weight if counts else 0.0)
                    if to not in new or new[to] < total:
                        new[to] = total
            paths = new
        return max((s for state, s in paths.items() if self.accepting[state]), default=0.0)

    def clauses(self, text: str | None) -> tuple[list[float], int]:
        """The scores over zero of the accepted clauses, and the number of tokens."""
        tokens = tokens_of(text)
        get, classify = self.cache.get, self.classify
        classes = [get(t) or classify(t) for t in tokens]
        out, start, hit = [], 0, False
        for i, (c, _) in enumerate((*classes, (END, 0.0))):
            if c == INSULT or c == THREAT:
                hit = True
            elif c == END:
                if hit and (score := self.clause(classes[start:i])) > 0:
                    out.append(score)
                start, hit = i + 1, False
        return out, len(tokens)

    def features(self, text: str | None) -> tuple[float, float, float]:
        found, n = self.clauses(text)
        total = sum(found)
        return float(np.log1p(total)), float(np.log1p(100 * total / max(n, FEW_TOKENS))), max(found, default=0.0)

    def score(self, text: str | None) -> float:
        b0, *b = self.model.curve
        return float(1 / (1 + np.exp(-np.clip(b0 + np.dot(b, self.features(text)), -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Intercept and slopes of a ridge logistic regression, by damped Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    b, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(penalty * b * b))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (p - y) + penalty * b)
        size = 1.0
        while size > 1e-4 and loss(b - size * step) > loss(b):
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return b


def word_features(text: str) -> set[str]:
    """``w:`` words and ``s:`` word beginnings of a text."""
    words = {t for t in set(tokens_of(text)) if len(t) > 2 and t[0] not in ".!?;:\n"}
    return {f"w:{w}" for w in words} | {f"s:{s}" for w in words for s in stems(w)}


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, train: Column, rows: int, text: str, key: str) -> DataFrame:
    """``rows`` labelled texts at most (columns key, y, text), chosen by a hash of the id, one row per id.

    Labels meet the documents' ids, without texts, before the choice, so labels of unknown ids take no place in it. The
    chosen ids are few by this bound, so they are broadcast and no text is shuffled that is not in the sample.
    """
    known = docs.select(F.col(f"`{key}`").alias("_known")).distinct()
    marked = labels.where(F.col(key).isNotNull() & F.col(target).isNotNull() & train).groupBy(key).agg(F.max(F.col(target).cast("int")).alias("y"))
    ids = marked.join(known, F.col(key) == F.col("_known"), "left_semi").orderBy(F.xxhash64(key), key).limit(rows)
    texts = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text")).join(F.broadcast(ids), key)
    return materialize(texts.groupBy(key, "y").agg(F.max("text").alias("text")), "labelled")


def fit(docs: DataFrame, labels: DataFrame, train: Column, target: str = "toxic", sample_rows: int = 20_000, features: int = 3_000, lexicon: int = 400, text: str = "text", key: str = "doc_id", grammar: Grammar | None = None) -> Model:
    """Learn a model from the labelled rows that the column ``train`` (over ``labels``) allows.

    Bounds: ``sample_rows`` labelled texts, ``features`` candidate words and beginnings (of all words of the sample,
    those with the highest gain), ``lexicon`` chosen ones. Only candidates, a bit for each in each sampled toxic text
    (7.5 MB by these bounds) and three numbers per sampled text reach the driver.
    """
    grammar = grammar or Grammar()
    sample = labelled_sample(docs, labels, target, train, sample_rows, text, key)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = [Counter(), Counter()]
        for part in parts:
            for y, t in zip(part["y"], part["text"], strict=True):
                n[int(bool(y))].update(word_features(t or ""))
                if len(n[0]) + len(n[1]) > 400_000:
                    yield pd.DataFrame([(f, k if c else 0, 0 if c else k) for c in (0, 1) for f, k in n[c].items()], columns=["feature", "toxic", "other"])
                    n = [Counter(), Counter()]
        yield pd.DataFrame([(f, k if c else 0, 0 if c else k) for c in (0, 1) for f, k in n[c].items()], columns=["feature", "toxic", "other"])

    sizes = {bool(r["y"]): r["n"] for r in sample.groupBy((F.col("y") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return builtin_model()
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("other") + 0.5) / (n0 + 1.0))
    counted = materialize(sample.mapInPandas(count, "feature string, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).withColumn("odds", odds).where("toxic > 0 and odds > 0"), "word-counts")
    # Whole words come from three toxic texts at least; beginnings from more, with higher odds, and of several distinct words.
    rising = counted.where("feature like 'w:%'").select(F.substring("feature", 3, 1_000_000).alias("word"))
    shared = rising.select(F.explode(F.expr(f"transform(sequence({LEAST_STEM}, greatest({LEAST_STEM}, least({MOST_STEM}, length(word) - 1))), k -> concat('s:', substring(word, 1, k)))")).alias("stem"), "word").groupBy("stem").agg(F.count_distinct("word").alias("n_words"))
    strong = counted.where("toxic >= 3 and odds > 1.5").join(shared, F.col("feature") == F.col("stem"), "left")
    backed = (F.substring("feature", 1, 1) == "w") | (F.col("toxic") >= 4) & (F.col("odds") > 2) & (F.col("n_words") >= F.when(F.length("feature") - 2 >= LONG_STEM, LONG_WORDS).otherwise(SHORT_WORDS))
    best = strong.where(backed).orderBy(F.desc(F.col("toxic") * F.col("odds")), "feature").limit(features).collect()
    if not best:
        return Model(builtin_model().words, {}, grammar=grammar)
    index = {r["feature"]: i for i, r in enumerate(best)}
    weight = np.array([r["odds"] for r in best])

    def incidence(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = np.zeros((len(part), len(index)), bool)
            for n, t in enumerate(part["text"]):
                rows[n, [index[f] for f in word_features(t or "") if f in index]] = True
            yield pd.DataFrame({"has": [x.tobytes() for x in np.packbits(rows, axis=1)]})

    bits = sample.where("y > 0").mapInPandas(incidence, "has binary").collect()
    has = [np.flatnonzero(np.unpackbits(np.frombuffer(r["has"], np.uint8), count=len(index))).tolist() for r in bits]
    # Of features that cover alike, whole words and then longer beginnings are the more specific.
    names = [r["feature"] for r in best]
    chosen = cover(has, weight * np.array([1.25 if f[0] == "w" else 1 + 0.03 * (len(f) - 2) for f in names]), lexicon, names)
    words = {w: 4.0 for w in INSULTS} | {names[i][2:]: float(min(6.0, weight[i])) for i in chosen if names[i][0] == "w"}
    begin = {names[i][2:]: float(min(6.0, weight[i])) for i in chosen if names[i][0] == "s"}
    model = Model(words, begin, grammar=grammar)

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for part in parts:
            yield pd.DataFrame([(int(y > 0), *scorer.features(t)) for y, t in zip(part["y"], part["text"], strict=True)], columns=["y", "a", "b", "c"])

    seen = np.array(sample.mapInPandas(measure, "y int, a double, b double, c double").collect(), dtype=float)
    return Model(words, begin, tuple(map(float, logistic(seen[:, 1:], seen[:, 0]))), grammar)


def cover(has: list[list[int]], weight: np.ndarray, most: int, names: list[str], least_gain: float = 4.0) -> list[int]:
    """Greedy choice: each next feature has the largest gain, where a text counts half for each choice it has already.
    Words that begin with a chosen beginning, and beginnings of chosen ones, are left out, as they mark the same words."""
    holders: dict[int, list[int]] = {}
    for d, row in enumerate(has):
        for f in row:
            holders.setdefault(f, []).append(d)
    arrays = {f: np.array(d) for f, d in holders.items()}
    left, chosen = np.ones(len(has)), []
    gain = {f: left[d].sum() * weight[f] for f, d in arrays.items()}
    while len(chosen) < most and gain:
        # Gains only shrink, so the largest old gain that stays the largest when renewed is the choice.
        while True:
            f = max(gain, key=lambda k: (gain[k], -k))
            new = left[arrays[f]].sum() * weight[f]
            if new >= gain[f] - 1e-9:
                break
            gain[f] = new
        if gain.pop(f) < least_gain:
            break
        chosen.append(f)
        left[arrays[f]] *= 0.5
        name, is_stem = names[f][2:], names[f][0] == "s"
        same = [k for k in gain if (names[k][0] == "s" and name.startswith(names[k][2:])) or (is_stem and names[k][2:].startswith(name))]
        for k in same:
            del gain[k]
    return chosen


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with two more last columns, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    name, verdict = fresh(docs, "score"), fresh(docs, "predicted")

    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for batch in texts:
            yield pd.Series([scorer.score(t) for t in batch], dtype=float)

    scores.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(name, F.pandas_udf(scores, "double")(F.col(f"`{text}`"))).withColumn(verdict, (F.col(name) >= 0.5).cast("int"))


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % modulus == remainder, F.lit(False))

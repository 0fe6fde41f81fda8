"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

The patterns give base spans. Other long runs of key characters that hold letters and digits or mixed case are
candidates; each is scored by the mean log-likelihood ratio per character of two first-order Markov models, one
trained on samples labelled random, the other on samples labelled ordinary. Candidates over the limit add spans.

Defined cases: a null or empty text has no spans; offsets count code points, ends are exclusive; repeated rows
are scanned one by one; of a candidate that overlaps base spans, each stretch outside them, of any length, is scored by
itself; other columns pass untouched.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.session import fresh

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: Runs that are too short hold no long enough match, so the length can stand in these patterns.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ASSIGN_LEAST = 12

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABET = LOWER + UPPER + DIGITS + "+/_=-"
Span = tuple[str, int, int]


class Markov:
    """First-order character model with add-``k`` smoothing."""

    def __init__(self, samples: Iterable[str], k: float = 0.5):
        counts = {a: dict.fromkeys(ALPHABET, k) for a in "^" + ALPHABET}
        for s in samples:
            for a, b in zip("^" + s, s, strict=False):
                if a in counts and b in counts[a]:
                    counts[a][b] += 1
        self.log = {a + b: math.log(n / sum(row.values())) for a, row in counts.items() for b, n in row.items()}

    def score(self, s: str) -> float:
        return sum(self.log[a + b] for a, b in zip("^" + s, s, strict=False))


# Parts of ordinary identifiers, paths and names.
PARTS = "get set user name file path data value index count list item node tree page text line word total size max min first last next prev open close read write load save parse format string number date time year month day start end left right top bottom width height color style class type kind state event handler manager service client server request response message error warning result session cache buffer stream queue table column record field query update insert delete create remove config option default local global public private static build test release version license document content image article section title header footer links menu sub main info contact about search login account order product price customer region nation the and for with from this that not are was have which their would other over into more some than then these between water people number haus stadt land wasser leben arbeit gesellschaft schule strasse fahrt dampf schiff verein recht zeit welt kinder freund wirtschaft entwicklung bibliothek versicherung maison ville pays monde temps jour eau travail enfant ecole rue societe gouvernement developpement bibliotheque casa ciudad mundo tiempo agua trabajo nino escuela calle sociedad gobierno desarrollo biblioteca".split()


def labelled_samples(n: int = 4_000, seed: int = 7) -> list[tuple[str, int]]:
    """``n`` samples of each label, drawn with a seed: 1 random keys of usual alphabets, 0 identifiers, paths, words and dates."""
    rng = random.Random(seed)
    keys = [LOWER + UPPER + DIGITS, LOWER + UPPER + DIGITS + "+/", LOWER + DIGITS, UPPER + DIGITS, LOWER + UPPER + DIGITS + "_-", DIGITS + "abcdef"]
    out = [("".join(rng.choices(rng.choice(keys), k=rng.randint(20, 48))), 1) for _ in range(n)]
    for _ in range(n):
        parts = rng.choices(PARTS, k=rng.randint(2, 7))
        style = rng.randrange(7)
        if style == 0:
            s = parts[0] + "".join(map(str.capitalize, parts[1:]))
        elif style == 1:
            s = "".join(map(str.capitalize, parts))
        elif style in (2, 3, 4):
            s = "_-/"[style - 2].join(parts)
        elif style == 5:
            s = "_".join(parts).upper()
        else:
            s = "-".join(parts[:3]) + f"-{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
        out.append((s + (str(rng.randint(0, 999)) if rng.random() < 0.3 else ""), 0))
    return out


@dataclass(frozen=True)
class Model:
    random: Markov
    ordinary: Markov
    limit: float = 0.6

    def ratio(self, s: str) -> float:
        """Mean log-likelihood ratio per character."""
        return (self.random.score(s) - self.ordinary.score(s)) / max(len(s), 1)


def train(samples: Iterable[tuple[str, int]] | None = None, limit: float = 0.6) -> Model:
    """A model from (string, label) samples; the built-in ones if none are given."""
    samples = list(labelled_samples() if samples is None else samples)
    return Model(Markov(s for s, y in samples if y), Markov(s for s, y in samples if not y), limit)


def base_spans(text: str) -> list[Span]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def eligible(s: str) -> bool:
    """Holds letters together with digits, or letters that go from lower to upper case and back."""
    letters = any(c in LOWER or c in UPPER for c in s)
    return letters and (any(c in DIGITS for c in s) or re.search(r"[a-z][A-Z]+[a-z]+[A-Z]", s) is not None)


def outside(start: int, end: int, base: list[Span]) -> list[tuple[int, int]]:
    """The stretches from ``start`` to ``end`` that no span of ``base``, sorted by start, covers."""
    out = []
    for _, a, b in base:
        if a >= end:
            break
        if b > start:
            if a > start:
                out.append((start, a))
            start = b
    return out + [(start, end)] if start < end else out


def scan(text: str | None, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text, by start and kind."""
    if not text:
        return [], []
    base = base_spans(text)
    # Base spans that end before a candidate are passed once; a longer one may lie among them, so the ends are kept rising.
    ends, far = [], 0
    for _, _, e in base:
        ends.append(far := max(far, e))
    added = []
    for m in CANDIDATE.finditer(text):
        near = base[bisect.bisect_right(ends, m.start()) :] if base else base
        added += [("markov", i, j) for i, j in outside(*m.span(), near) if eligible(text[i:j]) and model.ratio(text[i:j]) > model.limit]
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if added else base


SPANS_DDL = "base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>"


def with_spans(docs: DataFrame, model: Model | None = None, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a last column, a struct of the arrays ``base`` and ``spans``; and that column's name."""
    model, name = model or train(), fresh(docs, "secrets")

    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = [scan(t, model) for t in batch]
            yield pd.DataFrame({k: [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x[i]] for x in found] for i, k in enumerate(("base", "spans"))})

    find.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return docs.withColumn(name, F.pandas_udf(find, SPANS_DDL)(F.col(f"`{text}`"))), name


def mask(text: str | None, model: Model, by: str = "[SECRET]") -> str | None:
    """The text with each stretch of overlapping spans replaced."""
    _, spans = scan(text, model)
    if not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for _, a, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], by]
        at = b
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the secrets of the text column masked; all columns keep their place."""
    model = model or train()

    def hide(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: mask(t, model))

    hide.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    clean = F.pandas_udf(hide, "string")(F.col(f"`{text}`"))
    return docs.withColumn(text, clean)

"""Toxicity by a weighted finite-state pattern grammar.

Four transducers are composed into one deterministic machine over a clause:

* lexicon:   tokens -> classes: I insult, H threat, G target, N negation, R reported speech, W other.
             The insult class holds fixed words and the words and word beginnings that
             set labelled documents apart (learned, so that any language is covered);
* negation:  an I or H within three tokens after N is rewritten to its negated form;
* report:    an I or H after R in its clause is rewritten to its reported form;
* clause:    a G before or after an I or H in the clause makes the match targeted. Matches
             before the first G wait in a register that G, or the end of the clause, empties.

A clause is scored by the matches that the machine emits, with one weight for each
kind of match (learned by logistic regression); a document by the weights over its
clauses. Words outside of a matched clause count for nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text, gathered, held_out, labelled

#: Rows of each class that the learner sees at most.
TRAIN_ROWS = 1500
# The closed word classes of the grammar.
INSULTS = "idiot moron scum loser trash stupid pathetic worthless disgusting clown imbécile ordure crétin dummkopf abschaum trottel escoria imbécil".split()
THREATS = "kill hurt destroy burn punch strangle shoot stab tuer frapper töten schlagen verbrennen matar golpear quemar".split()
TARGETS = "you your you're they them he she this that these those tu vous toi ils du ihr sie dich tú usted ellos".split()
NEGATIONS = "not no never isn't aren't don't nobody pas jamais aucun nicht kein keine niemals nunca jamás tampoco".split()
REPORTS = "said says wrote claims claimed quoted quotes called reported dit écrit sagte schrieb dijo escribió".split()

SCOPE = 3
KINDS = ("insult", "insult_targeted", "insult_negated", "insult_reported", "threat", "threat_targeted", "threat_negated", "threat_reported")
BOUNDARY = re.compile(r"[.!?;\n]")
ORNAMENTS = re.compile(r"[!#$%&*]{2,}")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")


class Transducer:
    """Deterministic: ``arcs[state, symbol] = (next state, output)``; output may be empty."""

    def __init__(self, start, arcs: dict, final=None) -> None:
        self.start, self.arcs, self.final = start, arcs, final or {}

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, ``other`` reads."""
        arcs, final, todo, seen = {}, {}, [(self.start, other.start)], set()
        symbols = {s for _, s in self.arcs}
        while todo:
            a, b = todo.pop()
            if (a, b) in seen:
                continue
            seen.add((a, b))
            for s in symbols:
                to, mid = self.arcs[a, s]
                nxt, out = other.arcs[b, mid]
                arcs[(a, b), s] = ((to, nxt), out)
                todo.append((to, nxt))
            final[a, b] = other.final.get(b, ())
        return Transducer((self.start, other.start), arcs, final)

    def run(self, symbols: str) -> list:
        state, out, arcs = self.start, [], self.arcs
        for s in symbols:
            state, o = arcs[state, s]
            out += o
        return [*out, *self.final.get(state, ())]


def negation() -> Transducer:
    """States: tokens for which the scope still holds. i and h: negated insult and threat."""
    arcs = {}
    for left, s in product(range(SCOPE + 1), "IHGNRW"):
        rewritten = s.lower() if left and s in "IH" else s
        arcs[left, s] = (SCOPE if s == "N" else max(0, left - 1), rewritten)
    return Transducer(0, arcs)


def report() -> Transducer:
    """After R in a clause, J and K stand for reported insult and threat."""
    arcs = {}
    for said, s in product((False, True), "IHGNRWih"):
        arcs[said, s] = (said or s == "R", {"I": "J", "H": "K"}.get(s, s) if said else s)
    return Transducer(False, arcs)


def clause() -> Transducer:
    """Emits kinds; state: a target was seen. Without one, a match is emitted as pending, to be settled by what the end emits."""
    arcs = {}
    direct = {"i": "insult_negated", "h": "threat_negated", "J": "insult_reported", "K": "threat_reported"}
    for target, s in product((False, True), "IHGNRWihJK"):
        plain = {"I": "insult", "H": "threat"}.get(s)
        out = (direct[s],) if s in direct else (f"{plain}_targeted" if target else f"{plain}_pending",) if plain else ()
        arcs[target, s] = (target or s == "G", out)
    return Transducer(False, arcs, {True: ("_targeted",), False: ("",)})


def settled(emitted: list[str]) -> Counter:
    """Kinds and how often they match in a clause: the last word emitted says what pending matches are."""
    counts = Counter(emitted[:-1])
    for plain in ("insult", "threat"):
        if n := counts.pop(f"{plain}_pending", 0):
            counts[plain + emitted[-1]] += n
    return counts


class Grammar:
    """The lexical transducer (words and word beginnings to classes) before the composed machine."""

    def __init__(self, words: list[str], stems: list[str]) -> None:
        self.words, self.stems = sorted(set(words)), sorted(set(stems))
        self.machine = negation().then(report()).then(clause())
        self.classes = {w: c for c, ws in (("R", REPORTS), ("N", NEGATIONS), ("G", TARGETS)) for w in ws}
        insults, threats = [re.escape(w) for w in {*self.words, *INSULTS}], [re.escape(w) for w in THREATS]
        stems = [re.escape(w) + r"[^\W\d_]*" for w in self.stems]
        self.hit = re.compile(r"(?<![^\W\d_])(?:(?:" + "|".join(sorted([*insults, *stems])) + r")|(" + "|".join(sorted(threats)) + r"))(?![^\W\d_])")

    def __reduce__(self):
        return Grammar, (self.words, self.stems)

    def features(self, text: str | None) -> np.ndarray:
        """log(1 + matches) of each kind, over the clauses that hold an insult or a threat."""
        out, counts = np.zeros(len(KINDS)), Counter()
        text = ORNAMENTS.sub("", (text or "").lower())
        if not self.hit.search(text):
            return out
        done = -1
        hits = list(self.hit.finditer(text))
        where = {m.start(): "H" if m.group(1) else "I" for m in hits}
        for m in hits:
            if m.start() < done:
                continue
            begin = max(done, 0)
            for b in BOUNDARY.finditer(text, begin, m.start()):
                begin = b.end()
            end = BOUNDARY.search(text, m.end())
            done = end.start() if end else len(text)
            symbols = "".join(where.get(w.start()) or self.classes.get(w.group(), "W") for w in WORD.finditer(text, begin, done))
            counts.update(settled(self.machine.run(symbols)))
        for i, k in enumerate(KINDS):
            out[i] = np.log1p(counts[k])
        return out


def induce(sample: list[tuple[str, int]], least: int = 3, ratio: float = 12.0) -> tuple[list[str], list[str]]:
    """Words and word beginnings (3 to 8 letters) that mark documents of label 1, by greedy cover.

    A term needs ``least`` documents of label 1, and a rate among them ``ratio`` times
    (smoothed) that among the others; each pick must cover documents not yet covered.
    """
    n1 = sum(y for _, y in sample)
    n0 = len(sample) - n1
    if not n1 or not n0:
        return [], []

    def words_of(text: str) -> set[str]:
        return {w for w in WORD.findall(ORNAMENTS.sub("", text.lower())) if len(w) >= 3}

    def terms_of(text: str, wanted=None) -> set[str]:
        """Words as they are, beginnings with a star."""
        out = set()
        for w in words_of(text):
            if wanted is None or w[:3] + "*" in wanted or w in wanted:
                out.add(w)
                out.update(w[:k] + "*" for k in range(3, min(8, len(w)) + 1))
        return out if wanted is None else out & wanted

    positives, negatives = Counter(), Counter()
    for text, y in sample:
        if y:
            positives.update(terms_of(text))
    often = {t: c for t, c in positives.items() if c >= least}
    del positives
    wanted = set(often) | {t[:3] + "*" for t in often}
    for text, y in sample:
        if not y:
            negatives.update(terms_of(text, wanted))
    good = {t for t, c in often.items() if (c + 0.5) / (n1 + 1) >= ratio * (negatives[t] + 0.5) / (n0 + 1) and c >= 20 * negatives[t] * n1 / n0}
    holds: dict[str, set[int]] = {}
    reach = good | {t[:3] + "*" for t in good}
    for i, text in enumerate(t for t, y in sample if y):
        for t in terms_of(text, reach) & good:
            holds.setdefault(t, set()).add(i)
    words, stems, covered = [], [], set()
    while holds:
        def gain(t):
            return len(holds[t] - covered), len(t.rstrip("*")), t
        best = max(holds, key=gain)
        new = holds.pop(best) - covered
        if len(new) < least:
            break
        covered |= new
        (stems if best.endswith("*") else words).append(best.rstrip("*"))
    return words, stems


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 50) -> np.ndarray:
    """Ridge-penalised weights, the intercept last, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.diag([l2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[Grammar, np.ndarray]:
    """The grammar and its weights (intercept last), from rows that are not held out.

    Weights are fitted on each half with the lexicon of the other, so that they do not
    trust words more than unseen documents bear out. Without rows of both labels, the
    fixed words alone count, with weight 3 a match and intercept -2.
    """
    sample = labelled(docs, labels, "toxic", rows)
    n1 = sum(y for _, y in sample)
    if n1 < 2 or n1 == len(sample):
        return Grammar([], []), np.array([3.0, 3, 0, 0.5, 3, 3, 0, 0.5, -2])
    x, y = [], []
    least = 3 if n1 >= 30 else 2
    for half in (0, 1):
        grammar = Grammar(*induce(sample[half::2], least))
        other = sample[1 - half :: 2]
        x += [grammar.features(t) for t, _ in other]
        y += [l for _, l in other]
    w = logistic(np.array(x), np.array(y, dtype=float))
    w[:-1] = np.maximum(w[:-1], 0)  # a match never speaks against label 1
    return Grammar(*induce(sample, least)), w


def score_of(text: Column, model: tuple[Grammar, np.ndarray], spark: SparkSession) -> Column:
    """The score of a text: one number comes back for each text that is sent to Python."""
    sent = spark.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grammar, w = sent.value
        for b in batches:
            z = np.array([float(grammar.features(t.as_py()) @ w[:-1] + w[-1]) for t in b])
            yield pa.array(1 / (1 + np.exp(-z)), pa.float64())

    return by_text(scores, "double")(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document.

    Null and empty texts get the score of a text without a match. Repeated rows are each
    scored; labels that are null or not 0 or 1 are left out; of repeated labels the
    larger counts. Empty tables give an empty result, or scores by the fixed words alone
    when only ``labels`` is empty. Other columns are ignored.
    """
    scored = gathered(docs).select("doc_id", score_of(F.col("text"), train(docs, labels), docs.sparkSession).alias("_score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs``, all columns, without those whose score is at least ``threshold``.

    Null and empty texts stay, as does each of repeated rows that are not rejected; an
    empty table gives no rows; without labels the fixed words alone decide. Columns of any
    name are kept.
    """
    rows = gathered(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_d"))
    scored = rows.withColumn("_score", score_of(F.col("_d.text"), train(docs, labels), docs.sparkSession))
    return scored.where(F.col("_score") < threshold).select("_d.*")

"""Toxicity by a weighted finite-state pattern grammar.

Words are read as classes: insult, threat, target (whom it addresses), negation, report (that somebody
said it), other. Marks are symbols too: a pause (comma, colon, dash, bracket), a quotation mark, the end
of a sentence. Five small transducers rewrite the symbols of a line one after the other: negation and
reported speech weaken insults and threats that follow, a target before an insult aims it, an insult
is aimed by a target soon after it, and a threat needs a target soon after it. Their composition is one
table of (state, symbol) -> (state, weight); a clause's score is the sum along its part of the path.

Insults come from a fixed list and from the labelled rows: stems, that is beginnings of words, that stand
in toxic documents, in many different surroundings, and hardly in others; those that stand mostly in
toxic ones are mild insults. A stem covers its inflections. How clause scores turn into a probability is learned too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, held_out, map_rows, slices, training_rows

#: Labelled rows that the lexicon and the calibration are learned from, at most.
SAMPLE_ROWS = 20_000
#: A learned insult: so many different surroundings in toxic documents, and a lower bound of their share.
#: A stem needs more than a whole word (written with a final $), as it also covers words not seen.
WITNESSES, STEM_SHARE, WORD_SHARE = 5, 0.85, 0.7
#: From this lower bound on a stem or word is a mild insult, of which it takes several.
MILD_SHARE = 0.5
#: Lengths of stems.
SHORTEST, LONGEST = 4, 9
MOST_EVIDENCE = 8.0
#: Stems that a task counts before it hands them on.
HELD_STEMS = 300_000

# The word classes to start with.
INSULTS = "arse asshole bastard bitch clown coward cretin crap disgusting dumb fool freak garbage idiot idiota idiotic imbecile imbécil jerk loser moron parasite pathetic pervert pig rat scum scumbag slut stupid stupide swine trash ugly vermin whore worthless abschaum arschloch dummkopf trottel connard crétin ordure salaud basura cabrón estúpido inútil"
THREATS = "kill murder hurt destroy beat stab shoot strangle burn crush hunt töten umbringen tuer frapper matar golpear"
TARGETS = "you your yours yourself he him she her they them du dich euch ihr sie tu toi vous usted ustedes ellos"
NEGATIONS = "not no never neither nor isn't aren't wasn't don't won't kein keine nicht pas jamais nunca jamás"
REPORTS = "said says say called calls wrote writes claimed claims reported quoted told accused sagte nannte dit dijo"
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, MILD, PAUSE, QUOTE, END, WEAK_INSULT, WEAK_THREAT, WEAK_MILD, AIMED, AIM, THREATENED = range(16)
MARKS = (PAUSE, QUOTE, END)

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_TOKEN = re.compile(r"""([^\W\d_]+(?:'[^\W\d_]+)?)|([.!?;|]+)|([,:()\[\]\u2013\u2014])|(["\u201c\u201d\u201e\u00ab\u00bb])""")
#: Words that a parenthesis between two pauses may have, over which a negation reaches.
PARENTHESIS = 4

#: state, symbol -> state, symbol; and, in the last machine, the weight.
Machine = Callable[[int, int], tuple[int, int]]

_WEAKER = {INSULT: WEAK_INSULT, THREAT: WEAK_THREAT, MILD: WEAK_MILD}


def _negation(state: int, symbol: int) -> tuple[int, int]:
    """The three words after a negation are weakened. States 1-3 count them; from 4 on, a parenthesis leaves the count as it is."""
    if symbol == NEGATION:
        return 3, symbol
    if symbol == END:
        return 0, symbol
    if state > 3:
        left, words = divmod(state - 4, PARENTHESIS)
        if symbol == PAUSE:
            return left + 1, symbol
        return (state - 1 if words else 0) if symbol != QUOTE else state, symbol
    if symbol == PAUSE:
        return (4 + (state - 1) * PARENTHESIS + PARENTHESIS - 1 if state else 0), symbol
    if symbol == QUOTE:
        return state, symbol
    return max(0, state - 1), _WEAKER.get(symbol, symbol) if state else symbol


def _reported(state: int, symbol: int) -> tuple[int, int]:
    """What follows a verb of saying in its sentence, or in the quotation that it opens, is somebody else's.

    States: 1 after the verb, 2 in its quotation, 3 in a quotation without a verb so far.
    """
    if symbol == REPORT:
        return (1, 1, 2, 2)[state], symbol
    if symbol == QUOTE:
        return (3, 2, 0, 0)[state], symbol
    if symbol == END:
        return (0, 0, 2, 3)[state], symbol
    return state, _WEAKER.get(symbol, symbol) if state in (1, 2) else symbol


def _less(state: int, symbol: int) -> int:
    """One word fewer to go; marks inside a sentence are no words."""
    return 0 if symbol == END else state if symbol in MARKS else max(0, state - 1)


def _targeted(state: int, symbol: int) -> tuple[int, int]:
    """A target up to four words before an insult aims it."""
    if symbol == TARGET:
        return 4, symbol
    return _less(state, symbol), AIMED if symbol == INSULT and state else symbol


def _insulted(state: int, symbol: int) -> tuple[int, int]:
    """An insult makes the first target of the next three words the one that is meant."""
    if symbol in (INSULT, AIMED):
        return 3, symbol
    if symbol == TARGET and state:
        return 0, AIM
    return _less(state, symbol), symbol


def _threatened(state: int, symbol: int) -> tuple[int, int]:
    """A threat needs a target within three words."""
    if symbol == THREAT:
        return 3, OTHER
    if state and symbol in (TARGET, AIM):
        return 0, THREATENED
    return _less(state, symbol), symbol


#: The five machines in the order in which they read each other's symbols, with the number of their states.
MACHINES: list[tuple[Machine, int]] = [(_negation, 4 + 3 * PARENTHESIS), (_reported, 4), (_targeted, 5), (_insulted, 4), (_threatened, 4)]
WEIGHTS = {INSULT: 1.0, AIMED: 1.5, AIM: 0.5, WEAK_INSULT: 0.4, MILD: 0.4, THREATENED: 1.5, WEAK_THREAT: 0.1, WEAK_MILD: 0.1}


def compose(first: Machine, second: Machine, states: int) -> Machine:
    """One machine that hands each symbol of ``first`` to ``second``; ``states`` bounds those of ``second``."""

    def both(state: int, symbol: int) -> tuple[int, int]:
        a, symbol = first(state // states, symbol)
        b, symbol = second(state % states, symbol)
        return a * states + b, symbol

    return both


@cache
def grammar() -> list[list[tuple[int, float]]]:
    """The composition as a table: for each state and input symbol, the next state and the weight. State 0 begins."""
    machine = reduce(lambda m, n: compose(m, n[0], n[1]), MACHINES[1:], MACHINES[0][0])
    number, table, todo = {0: 0}, [], [0]
    for at in todo:
        row = []
        for symbol in range(END + 1):
            to, out = machine(at, symbol)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append((number[to], WEIGHTS.get(out, 0.0)))
        table.append(row)
    return table


def lexicon() -> dict[str, int]:
    out = {}
    for words, symbol in ((INSULTS, INSULT), (THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
        out |= dict.fromkeys(words.split(), symbol)
    return out


class Matcher:
    """The grammar with the fixed lexicon and learned stems of insults and mild insults; a final $ marks whole words."""

    def __init__(self, insults: Iterable[str] = (), mild: Iterable[str] = ()) -> None:
        self.table, self.words, self.stems = grammar(), lexicon(), {}
        for learned, symbol in ((insults, INSULT), (mild, MILD)):
            for s in learned:
                known = self.words if s[-1] == "$" else self.stems
                known.setdefault(s.removesuffix("$"), symbol)
        self.hot = frozenset(w for w, s in self.words.items() if s in (INSULT, THREAT, MILD))
        self.heads = frozenset(s[:SHORTEST] for s in self.stems)

    def symbol(self, word: str) -> int:
        known = self.words.get(word)
        if known is None:
            known = OTHER
            if word[:SHORTEST] in self.heads:
                found = {self.stems.get(word[:k]) for k in range(SHORTEST, min(len(word), LONGEST) + 1)}
                known = INSULT if INSULT in found else MILD if MILD in found else OTHER
        return known

    def possible(self, text: str) -> bool:
        """Whether a word of the lower-cased text may match: set look-ups of its distinct words and their heads."""
        words = set(_WORD.findall(text))
        return not self.hot.isdisjoint(words) or not self.heads.isdisjoint({w[:SHORTEST] for w in words})

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of the clauses of the lower-cased text that match. A line begins anew; a sentence end is a symbol."""
        out, begin = [], 0
        for line in text.replace("\u2019", "'").split("\n"):
            if self.possible(line):
                state, score, start = 0, 0.0, 0
                for m in _TOKEN.finditer(line):
                    kind = m.lastindex
                    state, weight = self.table[state][self.symbol(m[1]) if kind == 1 else (END, PAUSE, QUOTE)[kind - 2]]
                    score += weight
                    if kind == 2:
                        if score:
                            out.append((begin + start, begin + m.start(), score))
                        score, start = 0.0, m.end()
                if score:
                    out.append((begin + start, begin + len(line), score))
            begin += len(line) + 1
        return out


def _stems(words: Iterable[str]) -> set[str]:
    return {w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)} | {w + "$" for w in words}


def _stem_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of either label each stem occurs; a stem may have several rows, as what a task holds is bounded."""
    counts: Counter[tuple[str, int]] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([s for s, _ in counts], pa.string()), pa.array([k for _, k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["stem", "label", "n"])
        counts.clear()
        return out

    for batch in slices(batches):
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            kind = int(label == 1)
            counts.update((s, kind) for s in _stems(set(_WORD.findall((text or "").lower()))))
            if len(counts) > HELD_STEMS:
                yield flush()
    yield flush()


def _witnesses(stems: frozenset[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The neighbours, as a digest, of the first occurrence of each stem in each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen = set()
            for text in batch.column("text").to_pylist():
                words, done = _WORD.findall((text or "").lower()), set()
                for i, w in enumerate(words):
                    for s in (_stems([w]) & stems) - done:
                        done.add(s)
                        seen.add((s, xxhash.xxh3_64_intdigest(" ".join(words[max(0, i - 2) : i + 3]).encode("utf-8", "surrogatepass")) - 2**63))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in seen], pa.string()), pa.array([h for _, h in seen], pa.int64())], ["stem", "around"])

    return run


def learn_insults(train: DataFrame) -> tuple[list[str], list[str]]:
    """Insults and mild insults of the toxic documents of ``train`` (text, label); a stem is collected only if it stands in several of its texts."""
    n_bad, n_good = (F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)) for k in (1, 0))
    counts = train.select("text", "label").mapInArrow(_stem_counts, "stem string, label int, n long").groupBy("stem").agg(n_bad.alias("bad"), n_good.alias("good"))
    n, z = F.col("bad") + F.col("good"), 1.64
    p = F.col("bad").cast("double") / n  # Wilson's lower bound of the share of toxic documents
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    clear = low >= F.when(F.col("stem").endswith("$"), WORD_SHARE).otherwise(STEM_SHARE)
    likely = {r["stem"]: (r["bad"], r["clear"]) for r in counts.where((low >= MILD_SHARE) & (F.col("bad") >= WITNESSES)).select("stem", "bad", clear.alias("clear")).collect()}
    if not likely:
        return [], []
    around = train.where("label = 1").select("text").mapInArrow(_witnesses(frozenset(likely)), "stem string, around long").distinct()
    seen = [r["stem"] for r in around.groupBy("stem").agg(F.count(F.lit(1)).alias("witnesses")).where(F.col("witnesses") >= WITNESSES).collect()]
    insults = fewest({s: likely[s][0] for s in seen if likely[s][1]})
    return insults, fewest({s: likely[s][0] for s in seen if not likely[s][1]})


def fewest(stems: dict[str, int]) -> list[str]:
    """Of stems with their counts, the shortest ones that cover the rest, each as long as it covers nearly as much."""
    longer: dict[str, list[str]] = {}
    for s in sorted(stems):
        longer.setdefault(s[:-1], []).append(s)
    out = []
    for s in sorted(stems):
        if any(s[:k] in stems for k in range(1, len(s))):
            continue  # a shorter stem covers it
        while more := [t for t in longer.get(s, ()) if stems[t] >= 0.9 * stems[s]]:
            s = more[0]
        out.append(s)
    return out


def _evidence(stems: tuple[list[str], list[str]], *names: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Two more columns behind those of the input, which has ``text``: the sum of clause scores and the number of matched clauses."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*stems)
        for batch in slices(batches):
            found = [matcher.clauses(text.lower()) if text else [] for text in batch.column("text").to_pylist()]
            total, n = [float(sum(s for _, _, s in f)) for f in found], [len(f) for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total, pa.float64()), pa.array(n, pa.int64())], [*batch.schema.names, *names])

    return run


def with_evidence(df: DataFrame, stems: tuple[list[str], list[str]]) -> tuple[DataFrame, str, str]:
    """``df`` with the sum of clause scores and the number of matched clauses, and the names of these two; rows stay where they are."""
    total, n = free_names(df.columns, "evidence", "n_clauses")
    return map_rows(df, _evidence(stems, total, n), [T.StructField(total, T.DoubleType()), T.StructField(n, T.LongType())]), total, n


def calibrate(rows: list[tuple[float, int, int]]) -> tuple[float, float, float]:
    """Weights of 1, of evidence up to a plain insult's, and of all evidence in a logistic model of (evidence, label, count)."""
    if not rows:
        return -3.0, 5.0, 0.5
    x = np.array([[1.0, min(e, 1.0), min(e, MOST_EVIDENCE)] for e, _, _ in rows])
    y, n = np.array([float(r[1]) for r in rows]), np.array([float(r[2]) for r in rows])
    prior, pull = np.array([-3.0, 5.0, 0.5]), np.array([0.1, 1.0, 4.0])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (n * (p - y)) + pull * (w - prior))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1]), float(w[2])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[tuple[list[str], list[str]], Callable[[str], Column]]:
    """The learned stems, and the score as a function of the evidence column's name, learned from at most so many labelled rows."""
    train = training_rows(docs, labels, "toxic", sample_rows)
    stems = learn_insults(train)
    seen, total, _ = with_evidence(train.select("text", "label"), stems)
    level = F.round(F.least(total, F.lit(MOST_EVIDENCE)), 1)
    grouped = seen.groupBy(level.alias("e"), "label").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 81 x 2 rows
    a, b, c = calibrate(sorted((r["e"], r["label"], r["n"]) for r in grouped))
    return stems, lambda e: 1 / (1 + F.exp(-(F.lit(a) + b * F.least(e, F.lit(1.0)) + c * F.least(e, F.lit(MOST_EVIDENCE)))))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, n_clauses, evidence of each row of ``docs`` (doc_id, text).

    Learns from at most ``sample_rows`` rows of ``labels`` (doc_id, toxic) outside the held-out
    fold; without labels the fixed word lists and weights hold. Null and empty texts have no
    evidence and get the score of that; a null doc_id is not held out. Repeated rows score alike;
    other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stems, score = fit(docs, labels, sample_rows)
    out, _, _ = with_evidence(docs, stems)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("evidence").alias("score"), "n_clauses", "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns, unshuffled.

    Each row is judged by its own text: null and empty texts have no evidence, repeated rows and rows
    without an id stay or go by their text alone. Columns may have any names; an empty table gives an
    empty result.
    """
    stems, score = fit(docs, labels)
    out, total, _ = with_evidence(docs, stems)
    return out.where(score(total) < threshold).select(*(f"`{c}`" for c in docs.columns))

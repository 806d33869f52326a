"""Toxicity by a weighted pattern grammar: finite-state transducers composed into one that reads clauses.

A lexicon maps words to classes: insults, whose weights are learnt from labelled rows (a word, or a stem that stands
for all words it starts), and the closed classes threat, target, negation and report below, in the corpora's languages.
Five transducers read a clause's classes, each what the one before writes:

1. target marks insults and threats beside a target, before or after it;
2. negation marks those that a negation reaches, and 3. report those that a verb of reporting reaches;
4. insult writes a match for each insult with its marks, and 5. threat one for each threat; other words write nothing.

Their arcs carry weights; the composed machine's weights are products. The weights of the marks are fitted on the
labelled rows. A document's clauses give five numbers, and a logistic curve fitted on the same rows maps them to a
score. No label, language, source or doc_id is an input of a score.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.shared import prepare

#: Closed word classes of the grammar (English, French, German, Spanish).
THREATS = frozenset("kill hurt destroy burn beat tuer détruire brûler töten vernichten schlagen matar destruir quemar".split())
TARGETS = frozenset("you your yours yourself u he she they them tu toi ton ta vous votre il ils elles du dich dein deine ihr euch usted ustedes ellos ellas tú ti".split())
NEGATIONS = frozenset("not never no neither nor cannot don't doesn't isn't wasn't aren't ne pas jamais aucun nicht nie kein keine niemals ni nunca jamás tampoco".split())
REPORTS = frozenset("said says say saying wrote called claimed quoted reported dit disait écrit selon sagte sagt schrieb laut dijo dice escribió según".split())

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_CLAUSE = re.compile(r"[.!?;:\n]+")
FEATURES = 5
#: Classes of words that a clause is read as: other word, target, negation, report, insult, threat.
CLASSES = "wtnrih"
#: Marks of a match and their places in a factor list.
MARKS = "+-\""
#: The factors of targets, negations and reports before any fit, and what a fit tries.
PRIOR = (1.25, 0.5, 0.6)
TRIED = (0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0)

Output = tuple[tuple[str, float], ...]


@dataclass(frozen=True)
class Transducer:
    """A subsequential weighted transducer: an arc (state, symbol) leads to a state and writes weighted symbols; at the
    end of the input a state writes its tail. Weights along a path multiply."""

    start: Hashable
    arcs: dict[tuple[Hashable, str], tuple[Hashable, Output]]
    tails: dict[Hashable, Output]

    @staticmethod
    def of(start: Hashable, symbols: Iterable[str], step: Callable[[Hashable, str], tuple[Hashable, Output]], tail: Callable[[Hashable], Output] = lambda _: ()) -> Transducer:
        """All states that step reaches."""
        arcs, tails, todo, symbols = {}, {}, [start], tuple(symbols)
        while todo:
            q = todo.pop()
            if q in tails:
                continue
            tails[q] = tail(q)
            for x in symbols:
                arcs[q, x] = to = step(q, x)
                todo.append(to[0])
        return Transducer(start, arcs, tails)

    def alphabet(self) -> set[str]:
        return {x for _, x in self.arcs}

    def written(self) -> set[str]:
        return {x for _, out in self.arcs.values() for x, _ in out} | {x for out in self.tails.values() for x, _ in out}

    def follow(self, state: Hashable, symbols: Output) -> tuple[Hashable, Output]:
        out: list[tuple[str, float]] = []
        for x, weight in symbols:
            state, more = self.arcs[state, x]
            out += [(y, weight * v) for y, v in more]
        return state, tuple(out)

    def run(self, symbols: Iterable[str]) -> Output:
        state, out = self.follow(self.start, tuple((x, 1.0) for x in symbols))
        return out + self.tails[state]

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what this one writes."""

        def step(q: Hashable, x: str) -> tuple[Hashable, Output]:
            to, out = self.arcs[q[0], x]
            at, out = other.follow(q[1], out)
            return (to, at), out

        def tail(q: Hashable) -> Output:
            at, out = other.follow(q[1], self.tails[q[0]])
            return out + other.tails[at]

        return Transducer.of((self.start, other.start), sorted(self.alphabet()), step, tail)


def _is_hit(x: str) -> bool:
    return x[0] in "ih"


def target(symbols: Iterable[str], within: int, factor: dict[str, float]) -> Transducer:
    """Marks hits with a target at most `within` words before or after. A state is (words that the last target still
    reaches, words held back); the first word held back is a hit that a target may yet follow."""

    def mark(x: str) -> tuple[str, float]:
        return (x + "+", factor[x[0]]) if _is_hit(x) and "+" not in x else (x, 1.0)

    def step(q, x):
        left, held = q
        if x == "t":
            return (within, ()), (*((mark(y) if open_ else (y, v)) for y, v, open_ in held), ("t", 1.0))
        hit = _is_hit(x)
        held = (*held, (*(mark(x) if hit and left else (x, 1.0)), hit and not left))
        out = []
        while held and (not held[0][2] or len(held) > within):
            out.append(held[0][:2])
            held = held[1:]
        return (max(left - 1, 0), held), tuple(out)

    return Transducer.of((0, ()), symbols, step, lambda q: tuple((y, v) for y, v, _ in q[1]))


def scope(symbols: Iterable[str], trigger: str, mark: str, reach: int, factor: dict[str, float]) -> Transducer:
    """Marks hits among the `reach` words after a trigger. A state is the number of words still reached."""

    def step(left, x):
        if x == trigger:
            return reach, ((x, 1.0),)
        return max(left - 1, 0), (((x + mark, factor[x[0]]) if left and _is_hit(x) else (x, 1.0)),)

    return Transducer.of(0, symbols, step)


def match(symbols: Iterable[str], kind: str) -> Transducer:
    """Writes a match (the kind in upper case, with its marks) for each hit of the kind; matches of others and hits
    of others pass, other words are dropped."""
    return Transducer.of(0, symbols, lambda q, x: (q, ((x.upper(), 1.0),) if x[0] == kind else ((x, 1.0),) if x[0].lower() in "ih" else ()))


@dataclass(frozen=True)
class Grammar:
    """The lexicon and the weights of the transducers."""

    #: Weights of insults: whole words, and stems that stand for the words they start.
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    threat: float = 1.0
    #: Words that a negation or a report reaches, and how far a target is looked for.
    reach: int = 4
    beside: int = 2
    #: Factors of target, negation and report on insults and on threats.
    insult_factors: tuple[float, ...] = PRIOR
    threat_factors: tuple[float, ...] = PRIOR
    #: Of the logistic curve: intercept first.
    curve: tuple[float, ...] = (-4.0, 1.0, 1.0, 1.0, 1.0, 0.0)
    scale: tuple[float, ...] = (1.0,) * FEATURES

    def machine(self) -> Transducer:
        """The five transducers, composed."""
        factor = [{"i": a, "h": b} for a, b in zip(self.insult_factors, self.threat_factors)]
        out = target(CLASSES, self.beside, factor[0])
        out = out.then(scope(out.written(), "n", "-", self.reach, factor[1]))
        out = out.then(scope(out.written(), "r", "\"", self.reach, factor[2]))
        out = out.then(match(out.written(), "i"))
        return out.then(match(out.written(), "h"))

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def from_json(text: str) -> Grammar:
        return Grammar(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()})


def cell(symbol: str) -> int:
    """The place of a match among the 16 of its kind and marks."""
    return 8 * (symbol[0] == "H") + sum(1 << k for k, m in enumerate(MARKS) if m in symbol)


def cell_factors(insult: tuple[float, ...], threat: tuple[float, ...]) -> np.ndarray:
    """The weight of each of the 16 cells."""
    return np.array([math.prod(f for k, f in enumerate((insult, threat)[c >> 3]) if c >> k & 1) for c in range(16)])


class Scorer:
    """A grammar ready to run: the composed machine as rows of numbered states."""

    def __init__(self, grammar: Grammar):
        self.g = grammar
        self.finder = ahocorasick.Automaton()
        for w in {*grammar.words, *grammar.stems, *THREATS}:
            self.finder.add_word(w, len(w))
        if len(self.finder):
            self.finder.make_automaton()
        self.lengths = sorted({len(s) for s in grammar.stems})
        machine = grammar.machine()
        number = {q: k for k, q in enumerate(sorted(machine.tails, key=lambda q: q != machine.start))}
        cells = lambda out: tuple((cell(x), v) for x, v in out)
        self.rows = [[(0, ())] * len(CLASSES) for _ in number]
        for (q, x), (to, out) in machine.arcs.items():
            self.rows[number[q]][CLASSES.index(x)] = number[to], cells(out)
        self.tails = [()] * len(number)
        for q, out in machine.tails.items():
            self.tails[number[q]] = cells(out)

    def lexical(self, word: str) -> tuple[int, float]:
        """The class of a word, by its place in CLASSES, and its weight."""
        if word in TARGETS:
            return 1, 0.0
        if word in NEGATIONS:
            return 2, 0.0
        if word in REPORTS:
            return 3, 0.0
        best = max([self.g.words.get(word, 0.0), *(self.g.stems.get(word[:n], 0.0) for n in self.lengths if n <= len(word))])
        if word in THREATS:
            return 5, max(best, self.g.threat)
        return (4, best) if best > 0 else (0, 0.0)

    def clause(self, text: str) -> list[tuple[int, float, float]]:
        """(cell, lexical weight, factor) of each match of one clause in lower case, in order."""
        state, weights, out = 0, [], []
        for word in _WORD.findall(text):
            kind, weight = self.lexical(word)
            if kind >= 4:
                weights.append(weight)
            state, more = self.rows[state][kind]
            out += more
        out += self.tails[state]
        return [(c, w, f) for w, (c, f) in zip(weights, out)]

    def matches(self, text: str) -> Iterator[tuple[int, list[tuple[int, float, float]]]]:
        """(characters, matches) of each clause of the whole text that has a match."""
        low = text.lower()
        spots = []
        if len(self.finder):
            for end, n in self.finder.iter(low):
                start = end - n + 1
                before = low[max(0, start - 2) : start]
                # an apostrophe is inside a word only after a letter
                if not before or not (before[-1].isalpha() or before[-1] == "'" and before[0].isalpha()):
                    spots.append(start)
        if not spots:
            return
        cuts = [0, *(m.end() for m in _CLAUSE.finditer(low)), len(low)]
        at, done = 0, -1
        for spot in sorted(spots):
            if spot < done:
                continue
            while cuts[at + 1] <= spot:
                at += 1
            done = cuts[at + 1]
            if found := self.clause(low[cuts[at] : done]):
                yield done - cuts[at], found

    def features(self, text: str) -> tuple[float, ...]:
        """Of the whole text: logs of the sums of insults and of threats, the heaviest clause, the log of the number of
        clauses that matched, and both sums for each hundred characters."""
        sums, most, matched = [0.0, 0.0], 0.0, 0
        for _, found in self.matches(text):
            own = [0.0, 0.0]
            for c, w, f in found:
                own[c >> 3] += w * f
            sums = [sums[0] + own[0], sums[1] + own[1]]
            most, matched = max(most, sum(own)), matched + 1
        if not matched:
            return (0.0,) * FEATURES
        return math.log1p(sums[0]), math.log1p(sums[1]), most, math.log1p(matched), 100.0 * sum(sums) / max(50, len(text))

    def cells(self, text: str) -> np.ndarray:
        """The lexical weights of the whole text's matches, summed for each kind and marks."""
        out = np.zeros(16)
        for _, found in self.matches(text):
            for c, w, _ in found:
                out[c] += w
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        c = np.array(self.g.curve)
        return 1 / (1 + np.exp(-np.clip(c[0] + (x / np.array(self.g.scale)) @ c[1:], -50, 50)))


def _terms(text: str, stems: tuple[int, int]) -> set[str]:
    """Words, and stems of them marked by a star."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in range(stems[0], min(stems[1], len(w)) + 1)}


def _fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method: (curve, scale)."""
    scale = np.maximum(x.std(axis=0), 1e-6)
    a = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * np.append(0, w[1:])
        hess = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + ridge * np.diag([1e-6, *[1.0] * (len(w) - 1)])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, scale


def _fit_factors(cells: np.ndarray, y: np.ndarray, gain: float = 2.0) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The factors of marks on insults and on threats: one after the other takes the value tried under which a curve over
    the log of the weighted sum is likeliest, if that gains more than `gain` over the value before."""

    def loss(factors: list[float]) -> float:
        x = np.log1p(cells @ cell_factors(tuple(factors[:3]), tuple(factors[3:])))[:, None]
        w, scale = _fit_curve(x, y)
        z = w[0] + x[:, 0] / scale[0] * w[1]
        return float(np.logaddexp(0, z).sum() - z @ y)

    factors = [*PRIOR, *PRIOR]
    best = loss(factors)
    for _ in range(2):
        for k in range(6):
            tried = {v: loss([*factors[:k], v, *factors[k + 1 :]]) for v in TRIED if v != factors[k]}
            v = min(tried, key=tried.get)
            if tried[v] < best - gain:
                best, factors[k] = tried[v], v
    return tuple(factors[:3]), tuple(factors[3:])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, min_docs: int = 4, min_odds: float = 2.5, min_gain: float = 15.0, stems: tuple[int, int] = (4, 7)) -> Grammar:
    """Learn a grammar from labels (doc_id, toxic), of whose rows it must only be given those to learn from.

    At most max_rows labelled doc_ids are used, those whose hashes are smallest: the bound of all that comes to the
    driver. A word or stem gets a weight, the log odds of its document frequencies, if that is at least min_odds, it is
    in min_docs toxic documents, and the likelihood ratio of its 2 x 2 table is at least min_gain, a chance of about
    one in ten thousand at any size of the sample. Of labels that contradict each other for a doc_id toxic holds; of rows
    that repeat a doc_id one text counts. Without toxic labels nothing scores above 0.5. Null labels and texts, rows
    without a doc_id and other columns count for nothing; empty tables give the empty grammar. Whole texts are read.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic").persist()
    sizes = {int(r[0]): int(r[1]) for r in rows.groupBy("toxic").count().collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    if not n_bad or not n_good:
        rows.unpersist()
        return Grammar(curve=(-4.0,) + (0.0,) * FEATURES)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for b in it:
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                found[y].update(_terms(t, stems))
        terms = list(found[0] | found[1])
        if terms:
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([found[y][t] for t in terms], pa.int64()) for y in (1, 0))], names=["term", "bad", "good"])

    odds = {}
    terms = rows.mapInArrow(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") >= min_docs)
    for term, bad, good in terms.collect():
        value = math.log((bad + 0.5) / (n_bad + 1)) - math.log((good + 0.5) / (n_good + 1))
        table = [(bad, n_bad, bad + good), (good, n_good, bad + good), (n_bad - bad, n_bad, n_bad + n_good - bad - good), (n_good - good, n_good, n_bad + n_good - bad - good)]
        gain = 2 * sum(n * math.log(n * (n_bad + n_good) / (side * line)) for n, side, line in table if n)
        if value >= min_odds and gain >= min_gain:
            odds[term] = value
    grammar = Grammar({t: v for t, v in odds.items() if t[-1] != "*"}, {t[:-1]: v for t, v in odds.items() if t[-1] == "*"})
    y, cells = _collected(rows, lambda: Scorer(grammar).cells)
    insult, threat = _fit_factors(cells, y)
    grammar = replace(grammar, insult_factors=insult, threat_factors=threat)
    y, x = _collected(rows, lambda: Scorer(grammar).features)
    rows.unpersist()
    curve, scale = _fit_curve(x, y)
    return replace(grammar, curve=tuple(map(float, curve)), scale=tuple(map(float, scale)))


def _collected(rows: DataFrame, reader: Callable[[], Callable[[str], Iterable[float]]]) -> tuple[np.ndarray, np.ndarray]:
    """(labels, numbers) of the labelled rows, whose number fit bounds."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for b in it:
            x = [list(read(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    got = rows.mapInArrow(run, "toxic int, x array<double>").collect()
    return np.array([r[0] for r in got], float), np.array([r[1] for r in got], float)


def score(docs: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) of every row of docs; a null text is empty. Rows that repeat or lack a doc_id keep a
    row each; other columns are not looked at; an empty table gives none; texts of any length are read whole."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(grammar)
        for b in it:
            x = np.array([scorer.features(t or "") for t in b.column("text").to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scorer.score(x))], schema=schema)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(doc_id) -> F.Column:
    """Whether a doc_id is kept from learning: crc32 of its decimal text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def keep_clean(docs: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, columns as they are, that score below the threshold."""
    prepare(docs.sparkSession)
    names = docs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(grammar)
        for b in it:
            x = np.array([scorer.features(t or "") for t in b.column(names.index("text")).to_pylist()]).reshape(-1, FEATURES)
            yield b.filter(pa.array(scorer.score(x) < threshold))

    return docs.mapInArrow(run, docs.schema)

"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read a clause as a string of word classes: insults (by a trie of learned stems), threats (a verb of
harm, with an intention before it or not, aimed at someone), targets, negation and reported speech. Each is a table of
states; they are composed into one table whose outputs are marks: an insult, an aim, a threat, a hint of one, each plain,
denied or reported. A text's marks, weighted by what kind they are, are held against what chance gives in that many
words, and a logistic function of this evidence is the score. Stems, chance rates and the weights of the composition are
learned from labelled texts; a short list of known insults is there without any.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import require, tidy, trim, with_fields

#: Word lists of the grammar's small transducers, in the four languages of the corpus.
YOU = frozenset("you your yours u ye tu toi ton votre du ihr usted ustedes vosotros".split())
OBJECTS = frozenset("te vous dich dir euch os".split())
TARGETS = frozenset("he him she her they them these those people eux sie ihn él ella ellos".split())
NEGATIONS = frozenset("not no never neither nor without isn't aren't don't doesn't won't didn't pas jamais ni nicht kein keine keinen nie niemals nunca tampoco sin".split())
REPORTS = frozenset("said says wrote writes claimed reported quoted called tells told dit écrit sagte schrieb dijo escribió".split())
THREATS = frozenset("kill hurt destroy shoot stab burn murder strangle tuer frapper töten schlagen verletzen matar golpear herir".split())
INSULTS = frozenset("idiot idiots stupid moron morons imbecile loser losers scum worthless pathetic disgusting trash clown clowns dumb fool jerk bastard bitch asshole retard idiote imbécile connard connasse salaud crétin abruti ordure blödmann arschloch dummkopf trottel vollidiot abschaum idiota imbécil estúpido estúpida pendejo cabrón gilipollas basura".split())
INTENTIONS = frozenset("will i'll we'll gonna going shall want vais allons veux werde werden voy vamos quiero".split())

CLAUSE = re.compile(r"[.!?;\n]+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
SHORTEST, LONGEST = 4, 10
#: A negation, an intention and an aim reach so many words.
REACH = 3
#: So many of a word's matches count in full, further ones by the share of the text that lies beyond so many words.
REPEATS = 2
PASSAGE = 50

#: Classes of words, the transducers' alphabet.
OTHER, INSULT, VERB, WILL, YOURS, OBJECT, THEIRS, DENIAL, REPORT = range(9)
CLASSES = {w: k for k, words in ((THEIRS, TARGETS), (YOURS, YOU), (OBJECT, OBJECTS), (WILL, INTENTIONS), (VERB, THREATS), (REPORT, REPORTS), (DENIAL, NEGATIONS)) for w in words}
#: Patterns that aren't stems, and how often chance is taken to give them in a million words of prose nothing is known of.
THREAT, HINT = "\0threat", "\0hint"
EXPECTED = {THREAT: 1, HINT: 100}
#: The same for a known insult that no label tells more of.
EXPECTED_INSULT = 20
CONTEXTS = ("plain", "denied", "reported")


@dataclass(frozen=True)
class Machine:
    """A transducer: for each state and word class the next state, and what it puts out; state 0 is the first."""

    next: tuple[tuple[int, ...], ...]
    out: tuple[tuple[tuple, ...], ...]


def machine(start: tuple, step: Callable[[tuple, int], tuple[tuple, tuple]]) -> Machine:
    """The table of a transducer whose steps are given: its states are those that can be reached."""
    numbers, todo = {start: 0}, deque([start])
    nexts: list[tuple[int, ...]] = []
    outs: list[tuple[tuple, ...]] = []
    while todo:
        state = todo.popleft()
        rows = [step(state, k) for k in range(REPORT + 1)]
        for s, _ in rows:
            if s not in numbers:
                numbers[s] = len(numbers)
                todo.append(s)
        nexts.append(tuple(numbers[s] for s, _ in rows))
        outs.append(tuple(o for _, o in rows))
    return Machine(tuple(nexts), tuple(outs))


def insults() -> Machine:
    return machine((), lambda s, k: (s, ("insult",) if k == INSULT else ()))


def targets() -> Machine:
    """An insult and a target in one clause, in either order, are an aim, once."""

    def step(state: tuple, k: int) -> tuple[tuple, tuple]:
        insult, target, done = state
        insult, target = insult or k == INSULT, target or k in (YOURS, OBJECT, THEIRS)
        now = insult and target and not done
        return (insult, target, done or now), ("aim",) if now else ()

    return machine((False, False, False), step)


def threats() -> Machine:
    """A verb of harm and, soon after it, someone it is aimed at, or before it as in `ich werde dich schlagen`: a threat
    if an intention leads to the verb and it is aimed at the reader, else a hint."""

    def step(state: tuple, k: int) -> tuple[tuple, tuple]:
        will, aim, verb, meant = state  # words that the intention, the aim before a verb and the verb still reach
        will, aim, verb = max(will - 1, 0), max(aim - 1, 0), max(verb - 1, 0)
        if k == WILL:
            will = REACH + 1
        elif k == VERB:
            if aim:
                return (will, 0, 0, False), ("threat",)
            verb, meant = REACH, will > 0
        elif k in (YOURS, OBJECT, THEIRS) and verb:
            return (will, 0, 0, False), ("threat" if meant and k != THEIRS else "hint",)
        elif k == OBJECT and will:
            aim = REACH
        return (will, aim, verb, meant and verb > 0), ()

    return machine((0, 0, 0, False), step)


def negations() -> Machine:
    def step(state: tuple, k: int) -> tuple[tuple, tuple]:
        left = REACH + 1 if k == DENIAL else max(state[0] - 1, 0)
        return (left,), ("denied",) if left else ()

    return machine((0,), step)


def reports() -> Machine:
    def step(state: tuple, k: int) -> tuple[tuple, tuple]:
        now = state[0] or k == REPORT
        return (now,), ("reported",) if now else ()

    return machine((False,), step)


@cache
def composed() -> Machine:
    """The five machines as one: its outputs are marks (kind, context)."""
    parts = (insults(), targets(), threats(), negations(), reports())

    def step(state: tuple, k: int) -> tuple[tuple, tuple]:
        said = [o for m, s in zip(parts, state) for o in m.out[s][k]]
        context = 1 if "denied" in said else 2 if "reported" in said else 0
        return tuple(m.next[s][k] for m, s in zip(parts, state)), tuple((o, context) for o in said if o not in ("denied", "reported"))

    return machine((0,) * len(parts), step)


@dataclass
class Marks:
    """A text's marks: how often each word or pattern is marked in each context, aims at each word, and all words."""

    counts: dict[str, list[int]]
    aims: dict[str, int]
    words: int


@dataclass(frozen=True)
class Weights:
    """What an aim adds to an insult's count, and what a denied or a reported mark, or a hint of a threat, counts."""

    target: float = 0.25
    denied: float = 0.1
    reported: float = 0.3
    hint: float = 0.1


@dataclass
class Grammar:
    """Stems with their chance rates, and the weights of the composition.

    A stem's matches are held against what chance gives in a text of that length: `rates` has the share of words of
    clean texts that pass each stem. A prefix stands for itself, a whole word ends with `$`.
    """

    rates: dict[str, float] = field(default_factory=lambda: {f"{w}$": EXPECTED_INSULT / 1e6 for w in INSULTS})
    bias: float = -3.0
    slope: float = 1.5
    weights: Weights = Weights()
    patterns: dict[str, float] = field(default_factory=lambda: {k: n / 1e6 for k, n in EXPECTED.items()})
    cache: dict[str, str] = field(default_factory=dict, repr=False)

    def stem(self, word: str) -> str:
        """The stem transducer's output: the stem that a word passes, the one with the lowest rate of several, or ''."""
        known = self.cache.get(word)
        if known is None:
            passed = [f for f in _forms(word) if f in self.rates]
            known = min(passed, key=lambda f: (self.rates[f], f), default="")
            trim(self.cache, 60_000)
            self.cache[word] = known
        return known

    def marks(self, text: str | None) -> Marks:
        """What the composed machine puts out for the clauses of a text."""
        low = (text or "").lower()
        words = WORD.findall(low)
        stem, found = self.stem, Marks({}, {}, len(words))
        telling = {w for w in set(words) if w in THREATS or (w not in CLASSES and stem(w))}
        if not telling:  # no insult, no verb of harm: no clause says anything
            return found
        table = composed()
        for part in CLAUSE.split(low):
            if not any(w in part for w in telling):
                continue
            state, last = 0, ""
            for w in WORD.findall(part):
                k = CLASSES.get(w)
                if k is None:
                    k = INSULT if w in telling else OTHER
                    last = w if k == INSULT else last
                for kind, context in table.out[state][k]:
                    if kind == "aim":
                        found.aims[last] = found.aims.get(last, 0) + 1
                    else:
                        name = w if kind == "insult" else THREAT if kind == "threat" else HINT
                        found.counts.setdefault(name, [0, 0, 0])[context] += 1
                state = table.next[state][k]
        return found

    def weigh(self, marks: Marks, weights: Weights | None = None) -> tuple[float, float]:
        """(log likelihood ratio of the marks against chance, weighted number of marks)."""
        w = weights or self.weights
        counts: dict[str, float] = {}
        for name, (plain, denied, reported) in marks.counts.items():
            c = plain + w.denied * denied + w.reported * reported + w.target * marks.aims.get(name, 0)
            c *= w.hint if name == HINT else 1.0
            f = name if name in EXPECTED else self.stem(name)
            counts[f] = counts.get(f, 0.0) + _damped(c, marks.words)
        total = 0.0
        for f, c in counts.items():
            chance = marks.words * (self.patterns[f] if f in EXPECTED else self.rates[f])
            if c > chance:
                total += c * math.log(c / chance) - (c - chance)
        return total, sum(counts.values())

    def evidence(self, text: str | None) -> tuple[float, float]:
        return self.weigh(self.marks(text))

    def score(self, text: str | None) -> tuple[float, int]:
        """(0 to 1, number of matches) of a whole text."""
        x, n = self.evidence(text)
        return _logistic(self.bias + self.slope * math.log1p(x)), math.ceil(n)


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def _damped(count: float, words: int) -> float:
    """A word's matches in a text of so many words: repetition alone is no insult in a line, but grows with a text."""
    return min(count, REPEATS) + max(count - REPEATS, 0.0) * max(0.0, 1 - PASSAGE / max(words, 1))


def _forms(word: str) -> Iterator[str]:
    yield f"{word}$"
    for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
        yield word[:n]


def _frequent(texts: list[Counter], enough: float) -> Counter:
    """Prefixes of words (SHORTEST to LONGEST letters), and whole words with a `$`, that enough texts have, with the
    number of these texts. Level by level: a prefix is looked at only if the one before it is frequent."""
    out: Counter = Counter()
    level: Counter = Counter()
    for n in range(SHORTEST, LONGEST + 1):
        counts: Counter = Counter()
        for ws in texts:
            counts.update({w[:n] for w in ws if len(w) >= n and (n == SHORTEST or w[: n - 1] in level)})
        level = Counter({f: c for f, c in counts.items() if c >= enough})
        out |= level
    whole = Counter(w for ws in texts for w in ws)
    return out | Counter({f"{w}$": c for w, c in whole.items() if c >= enough})


def _beyond_chance(bad: int, good: int, share: float) -> float:
    """Log likelihood ratio: so many toxic and clean texts have a form, where chance makes this share of them toxic."""
    n = bad + good
    return sum(k * math.log(k / (n * p)) for k, p in ((bad, share), (good, 1 - share)) if k and p)


def fit(rows: list[tuple[str | None, int]], least: int = 5, ratio: float = 12.0) -> Grammar:
    """rows: (text, 1 if toxic).

    A form is a stem if `least` toxic texts have it, more than chance gives any of so many forms, if words pass it
    `ratio` times as often in toxic texts as in clean ones, and if it reaches toxic texts that no one better stem has; of
    forms that contain each other the one with the largest likelihood gain is kept, the longest of nearly equal ones. No
    share of the toxic texts is asked for, so a small language has its stems too. Patterns' rates are those of the clean
    rows, with what is expected of a million words of prose. The weights of aims, denials and reports, and a logistic
    regression's bias and slope, are then those under which the labels are likeliest. Known insults are stems in any case; without
    toxic and clean rows there are no others, and the weights are those it begins with.
    """
    read = lambda y: (Counter(WORD.findall(t.lower())) for t in dict.fromkeys(t or "" for t, z in rows if z == y))
    bad = list(read(1))
    frequent = _frequent(bad, least)
    inside, outside, clean = Counter(), Counter(), Counter()
    cleans = 0
    for target, texts in ((inside, bad), (outside, read(0))):
        for ws in texts:
            size = sum(ws.values())
            target[""] += size
            has: set[str] = set()
            for w, c in ws.items():
                if w in INSULTS and f"{w}$" not in frequent:
                    target[f"{w}$"] += _damped(c, size)
                if w[:SHORTEST] in frequent or f"{w}$" in frequent:  # no longer prefix is frequent where the shortest isn't
                    for f in _forms(w):
                        if f in frequent:
                            target[f] += _damped(c, size)
                            has.add(f)
            if target is outside:
                cleans += 1
                clean.update(has)
    rate = {f: (outside[f] + 0.5) / (outside[""] + 1) for f in frequent}
    odds = {f: inside[f] / max(inside[""], 1) / rate[f] for f in frequent}
    share = len(bad) / max(len(bad) + cleans, 1)
    bar = math.log(100 * max(len(frequent), 1))
    gain = {f: inside[f] * math.log(odds[f]) for f in frequent if odds[f] >= ratio and (not cleans or _beyond_chance(frequent[f], clean[f], share) >= bar)}
    where: dict[str, set[int]] = {f: set() for f in gain}
    for k, ws in enumerate(bad):
        for w in ws:
            for f in _forms(w):
                if f in where:
                    where[f].add(k)
    related = lambda f, g: f.rstrip("$").startswith(g.rstrip("$")) or g.rstrip("$").startswith(f.rstrip("$"))
    stems: list[str] = []
    for f in sorted(gain, key=lambda f: (-gain[f], -len(f), f)):
        if any(related(f, g) for g in stems):
            continue
        new = max(3, 0.2 * len(where[f]))
        if any(len(where[f] - where[g]) < new for g in stems):  # words of copied texts come together, insults each with others
            continue
        near = [g for g in gain if related(f, g) and g[-1] != "$" and gain[g] >= 0.97 * gain[f]]
        f = max([f, *near], key=lambda g: (g[-1] != "$", len(g), g))
        stems.append(f)
    known = {f"{w}$": (EXPECTED_INSULT + outside[f"{w}$"]) / (outside[""] + 1e6) for w in INSULTS}
    grammar = Grammar(known | {f: rate[f] for f in stems})
    read_marks = [(grammar.marks(t), y) for t, y in dict.fromkeys((t or "", y) for t, y in rows if y in (0, 1))]
    words = sum(m.words for m, y in read_marks if not y)
    for name, n in EXPECTED.items():
        grammar.patterns[name] = (n + sum(sum(m.counts.get(name, ())) for m, y in read_marks if not y)) / (words + 1e6)
    if bad and cleans:
        grammar.weights, grammar.bias, grammar.slope = _learn(grammar, read_marks)
    return grammar


#: Values that are tried for each weight; how strongly the weights keep to where they begin.
TRIED = {"target": (0.0, 0.25, 0.5, 1.0), "denied": (0.05, 0.1, 0.3, 0.6, 1.0), "reported": (0.05, 0.1, 0.3, 0.6, 1.0), "hint": (0.03, 0.1, 0.3)}
KEEP = 2.0


def _learn(grammar: Grammar, rows: list[tuple[Marks, int]]) -> tuple[Weights, float, float]:
    """Weights, bias and slope, one weight after another, by the penalised likelihood of the labels."""
    start = grammar.weights
    labels = [y for _, y in rows]

    def fitted(w: Weights) -> tuple[float, float, float]:
        points = [(math.log1p(grammar.weigh(m, w)[0]) if m.counts else 0.0, y) for (m, _), y in zip(rows, labels)]
        bias, slope = _regress(points)
        z = np.array([bias + slope * x for x, _ in points]) * np.where(np.array(labels) == 1, 1, -1)
        away = sum((getattr(w, k) - getattr(start, k)) ** 2 for k in TRIED)
        return -float(np.logaddexp(0, -z).sum()) - KEEP * away, bias, slope

    best, found = start, fitted(start)
    for _ in range(2):
        for name, values in TRIED.items():
            for v in values:
                if v != getattr(best, name):
                    w = Weights(**{k: v if k == name else getattr(best, k) for k in TRIED})
                    now = fitted(w)
                    if now[0] > found[0]:
                        best, found = w, now
    return best, found[1], found[2]


def _regress(points: list[tuple[float, int]], ridge: float = 0.05, rounds: int = 40) -> tuple[float, float]:
    """Bias and slope of a logistic regression, with a small ridge so that separable points have an end."""
    x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points], float)
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - ridge * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), max(float(w[1]), 0.0)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_toxic: int = 2000, most_clean: int = 6000, most_letters: int = 20_000) -> Grammar:
    """Fit on a bounded sample of labelled rows, most_toxic and most_clean of them at most, by a hash of the id.

    Rows of documents with no label, or a label other than 0 and 1, are left out, and rows of the sample whose text has
    more than most_letters characters, so that the driver's part is bounded in bytes too.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    first = lambda y, n: known.where(F.col("_y") == y).orderBy(F.xxhash64("_id", F.lit(7)), "_id").limit(n)
    chosen = first(1, most_toxic).unionByName(first(0, most_clean))
    ids = [(r[0], r[1]) for r in chosen.collect()]
    if not ids:
        return fit([])
    small = docs.sparkSession.createDataFrame(ids, "_id long, _y int")  # at most most_toxic + most_clean rows
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(small), "_id").select("_text", "_y")
    return fit([(r[0], r[1]) for r in rows.where(F.coalesce(F.length("_text"), F.lit(0)) <= most_letters).collect()])


def score(df: DataFrame, grammar: Grammar, text: str = "text", out: str = "toxicity", hits: str | None = "toxic_matches", lasting: bool = True) -> DataFrame:
    """df with a double from 0 to 1, and the number of matched patterns. Null and empty texts get the bias's score.

    Whole texts are read, of any length; an empty table gives no rows; rows that repeat a text have its score. Columns
    named like the results, in any case, are replaced. lasting: workers keep the words they have looked up for their next
    task.
    """
    require(df, text)
    added = {out.lower()} | ({hits.lower()} if hits else set())
    base = df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in added or c == text])
    handle = df.sparkSession.sparkContext.broadcast(grammar)  # bounded by the sample it was learned from
    schema = with_fields(base.schema, f"`{out}` double")
    if hits:
        schema = with_fields(schema, f"`{hits}` int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [handle.value.score(t) for t in batch.column(text).to_pylist()]
            columns = [*batch.columns, pa.array([f[0] for f in found], pa.float64())]
            if hits:
                columns.append(pa.array([f[1] for f in found], pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return base.mapInArrow(tidy("", run, None if lasting else lambda: handle.value.cache.clear()), schema)

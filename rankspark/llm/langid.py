"""Language identification of mixed-language text.

Words are runs of letters. A word's script (from code point ranges) narrows the candidate languages to those that were
learned with this script; among them, log probabilities of the word's character n-grams score it. Viterbi over a
text's words, with a penalty for each switch, labels spans; a text's language is the one with the most letters.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import require, tidy, trim, with_fields

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
#: Blocks with numbers that aren't decimal digits.
NUMERIC = re.compile("[\u00b2\u00b3\u00b9\u00bc-\u00be\u0660-\u0fff\u1369-\u137c\u2070-\u218b\u2460-\u24ff\u2776-\u2793\u3007-\u3029\u3192-\u33ff\U00010000-\U0001ffff]")
#: First code points of blocks of scripts; a script lasts until the next one begins.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2C00, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"), (0x32000, "other"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])

#: Log score of a word for languages that its script rules out, and the price of a switch between words.
RULED_OUT = -60.0
SWITCH = 8.0
CACHED = 200_000
CELLS = 400_000
#: Words with more letters are scored in blocks of n-grams, and aren't kept for later texts.
LONG = 200
BLOCK = 50_000
#: N-grams and words that a model knows: the commonest, of all languages together. The table is broadcast.
MOST_GRAMS = 60_000


def script_of(char: str) -> str:
    return SCRIPTS[int(np.searchsorted(_STARTS, ord(char), side="right")) - 1][1]


def grams(word: str) -> list[str]:
    """All of a word's character bigrams and trigrams, with its ends marked."""
    w = f"<{word}>"
    return [w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)]


@dataclass
class Model:
    """Log probabilities of n-grams and whole words by language, and the languages of each script."""

    languages: list[str]
    numbers: dict[str, int]  # n-gram, or a blank and a whole word -> row of the table
    table: np.ndarray  # the last row is for n-grams that weren't learned
    scripts: dict[str, np.ndarray]
    cache: dict[str, int] = field(default_factory=dict, repr=False)
    known: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32), repr=False)
    passing: int = 0  # entries of the cache, the newest, that are for one batch only

    def forget(self) -> None:
        self.cache.clear()
        self.known, self.passing = np.zeros((0, len(self.languages)), np.float32), 0

    def score(self, words: list[str]) -> np.ndarray:
        """Log probabilities of lower-case words for each language: a sum over n-grams by the root of their number."""
        number, none = self.numbers.get, len(self.table) - 1
        flat: list[int] = []
        starts, wholes, allowed = [], [], []
        nothing = np.zeros(len(self.languages), bool)
        long: list[tuple[int, str]] = []
        for k, w in enumerate(words):
            starts.append(len(flat))
            if len(w) > LONG:
                long.append((k, w))
                flat.append(none)
            else:
                flat += [number(g, none) for g in grams(w)]
            wholes.append(number(" " + w, -1))
            allowed.append(self.scripts.get(script_of(w[0]), nothing))
        counts = np.diff([*starts, len(flat)])
        s = np.add.reduceat(self.table[flat], starts, axis=0) / np.sqrt(counts)[:, None]
        for k, w in long:
            s[k] = self._long(w)
        whole = np.array(wholes)
        s += np.where((whole >= 0)[:, None], self.table[whole], 0)
        may = np.array(allowed)
        best = np.where(may, s, -np.inf).max(1, keepdims=True)
        learned = may.any(1)[:, None]  # of a script that nothing was learned of there is no evidence either way
        return np.where(learned, np.where(may, np.maximum(s - np.where(learned, best, 0), RULED_OUT / 2), RULED_OUT), 0).astype(np.float32)

    def _long(self, word: str) -> np.ndarray:
        """The same sum for a word of any length, some n-grams at a time."""
        number, none, w = self.numbers.get, len(self.table) - 1, f"<{word}>"
        total = np.zeros(len(self.languages))
        for n in (2, 3):
            for at in range(0, len(w) - n + 1, BLOCK):
                upto = min(at + BLOCK, len(w) - n + 1)
                total += self.table[[number(w[i : i + n], none) for i in range(at, upto)]].sum(0)
        return total / math.sqrt(2 * len(w) - 3)

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text, rows of the table `known` for its words; a word's row is its place in the cache."""
        for _ in range(self.passing):
            self.cache.popitem()
        trim(self.cache, CACHED)
        cache = self.cache
        if not cache:
            self.known = np.zeros((0, len(self.languages)), np.float32)
        new = sorted(set().union(*texts).difference(cache), key=lambda w: len(w) > LONG)  # long ones are the newest, and go first
        self.passing = sum(len(w) > LONG for w in new)
        if new:
            cache.update(zip(new, range(len(cache), len(cache) + len(new))))
            if len(cache) > len(self.known):
                more = max(len(cache), 2 * len(self.known)) - len(self.known)
                self.known = np.concatenate([self.known, np.zeros((more, len(self.languages)), np.float32)])
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                first = len(cache) - len(new) + at
                self.known[first : first + len(part)] = self.score(part)
        return [np.fromiter(map(cache.__getitem__, t), np.int64, len(t)) for t in texts]


def fit(rows: list[tuple[str | None, str]], most_grams: int = MOST_GRAMS) -> Model:
    """rows: (text, language). Counts of n-grams and words by language, smoothed; the commonest are kept."""
    words: dict[str, Counter] = defaultdict(Counter)
    for text, lang in rows:
        words[lang].update(WORD.findall((text or "").lower()))
    languages = sorted(k for k, c in words.items() if c)
    by_language: list[Counter] = []
    scripts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    for k, lang in enumerate(languages):
        found: Counter = Counter()
        for w, n in words[lang].items():
            scripts[script_of(w[0])][k] += n
            for g in set(grams(w)):
                found[g] += min(n, 50)  # a word counts for its n-grams by how often it is used, up to a point
            if n > 1:
                found[f" {w}"] += min(n, 50)
        by_language.append(found)
    totals = np.array([sum(words[lang].values()) for lang in languages], float) if languages else np.zeros(0)
    words.clear()
    together: Counter = Counter()
    for found in by_language:
        together.update(found)
    kept = [g for g, n in sorted(together.items(), key=lambda x: (-x[1], x[0]))[:most_grams] if n >= 2]
    counts = np.array([[found[g] for found in by_language] for g in kept] + [[0] * len(languages)], float).reshape(len(kept) + 1, len(languages))
    table = np.log(counts + 0.5) - np.log(totals + 1)
    allowed = {s: v >= 0.005 * totals for s, v in scripts.items() if (v >= 0.005 * totals).any()}
    return Model(languages, {g: k for k, g in enumerate(kept)}, table, allowed)


def _words(text: str) -> list[str]:
    """Lower-case words; superscripts and the like are no letters, though they are word characters."""
    found = WORD.findall(text.lower())
    return [w for w in found if any(map(str.isalpha, w))] if NUMERIC.search(text) else found


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """Best label of each word of several texts at once; scores: one array (words, languages) for each text."""
    out: list[np.ndarray] = [np.zeros(len(s), np.int64) for s in scores]
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    order = [k for k in order if len(scores[k])]
    at = 0
    while at < len(order):  # texts of like length together, so few cells are empty, and so many cells at a time at most
        group = order[at : at + max(1, min(256, CELLS // len(scores[order[at]])))]
        at += len(group)
        lengths = np.array([len(scores[k]) for k in group])
        longest, langs = lengths[0], scores[group[0]].shape[1]
        alive = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")  # texts that have a word at this step
        padded = np.zeros((longest, len(group), langs), np.float32)
        for j, k in enumerate(group):
            padded[: len(scores[k]), j] = scores[k]
        came = np.zeros((longest, len(group), langs), np.int8)
        value = padded[0].copy()
        last = np.zeros((len(group), langs), np.float32)
        last[:] = value
        own = np.arange(langs, dtype=np.int8)
        for t in range(1, longest):
            n = alive[t]
            v = value[:n]
            best = v.argmax(1)
            most = v[np.arange(n), best][:, None] - switch
            stay = v >= most
            came[t, :n] = np.where(stay, own, best[:, None])
            value[:n] = np.where(stay, v, most) + padded[t, :n]
        state = value.argmax(1)
        labels = np.zeros((longest, len(group)), np.int64)
        ends = lengths - 1
        current = state.copy()
        for t in range(longest - 1, -1, -1):
            n = alive[t]
            begin = ends[:n] == t
            current[:n] = np.where(begin, state[:n], current[:n])
            labels[t, :n] = current[:n]
            if t:
                current[:n] = came[t, np.arange(n), current[:n]]
        for j, k in enumerate(group):
            out[k] = labels[: lengths[j], j]
    return out


def label(model: Model, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans) of each text; spans: (first word, words, language).

    score: the share of letters that have the text's language, times the confidence of its words' evidence.
    """
    if not model.languages:
        return [(UNKNOWN, 0.0, []) for _ in texts]
    words = [_words(t) if t else [] for t in texts]
    ids = model.ids(words)
    table = model.known
    paths = viterbi([table[i] for i in ids])
    out = []
    for w, i, path in zip(words, ids, paths):
        if not w:
            out.append((UNKNOWN, 0.0, []))
            continue
        letters = np.fromiter(map(len, w), np.int64, len(w))
        mass = np.bincount(path, letters, len(model.languages))
        best = int(mass.argmax())
        mine = path == best
        gap = float(table[i[mine]].sum(0)[best] - np.delete(table[i[mine]].sum(0), best).max()) if len(model.languages) > 1 else 10.0
        sure = 1 - math.exp(-max(gap, 0.0) / 4)
        cuts = np.concatenate([[0], np.nonzero(np.diff(path))[0] + 1, [len(path)]])
        spans = [(int(a), int(b - a), model.languages[path[a]]) for a, b in zip(cuts[:-1], cuts[1:])]
        out.append((model.languages[best], float(mass[best] / letters.sum()) * sure, spans))
    return out


def train(df: DataFrame, text: str = "text", lang: str = "lang", most_rows: int = 4000, key: str = "doc_id", most_letters: int = 20_000) -> Model:
    """Fit on a bounded sample of labelled rows: about most_rows of them, chosen by a hash of the key in each language.

    Each language gives as many rows as any other, or all it has, so a rare one is learned at any size of the table. Rows
    whose language is null or blank are left out, and rows whose text has more than most_letters characters, unless their
    language has no other. With no such row the model knows no language.
    """
    rows = df.where(F.col(lang).isNotNull() & (F.trim(F.col(lang)) != ""))
    short = F.coalesce(F.length(text), F.lit(0)) <= most_letters
    counts = {r[0]: (r[1], r[2]) for r in rows.groupBy(lang).agg(F.count(F.when(short, 1)), F.count("*")).collect()}
    rows = rows.where(short | F.col(lang).isin([k for k, (n, _) in counts.items() if not n]))
    counts = {k: n or every for k, (n, every) in counts.items()}
    each = quota(list(counts.values()), most_rows)
    ways = 1 << 40
    limits = [x for k, n in counts.items() if n > each for x in (F.lit(k), F.lit(int(ways * each / n)))]
    if limits:
        share = F.coalesce(F.element_at(F.create_map(*limits), F.col(lang)), F.lit(ways))
        rows = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(8)), F.lit(ways)) < share)
    return fit([(r[0], r[1]) for r in rows.select(text, lang).collect()])


def letters_of(model: Model) -> str:
    """A regular expression (Java's) for one letter of a script that some language of the model was learned with."""
    ends = [*(start for start, _ in SCRIPTS[1:]), 0x110000]
    parts = "".join(f"\\x{{{a:x}}}-\\x{{{b - 1:x}}}" for (a, script), b in zip(SCRIPTS, ends) if script in model.scripts)
    return rf"[\p{{L}}&&[{parts}]]" if parts else "(?!)"


def quota(counts: list[int], most: int) -> int:
    """The largest number of rows that each language may give if all together give `most` at most; 1 at least."""
    left, most_of = most, sorted(counts)
    for k, n in enumerate(most_of):
        each = left // (len(most_of) - k)
        if n > each:
            return max(each, 1)
        left -= n
    return max(most_of, default=1)


def identify(df: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score", spans: str | None = "lang_spans", lasting: bool = True) -> DataFrame:
    """df with the predicted language, a score from 0 to 1 and, if a name is given, array<struct<word, words, lang>>.

    Null texts and texts without a letter: `und`, 0.0 and no spans. Words are read to their last letter. An empty table
    gives no rows; repeated rows are labelled alike; of languages with equal evidence the first by name is taken. Other
    columns named like these are replaced. lasting: workers keep the words they have scored for their next task.
    """
    require(df, text)
    added = [pred, score] + [spans] * bool(spans)
    base = df.select([F.col(f"`{c}`") for c in df.columns if c == text or c.lower() not in {a.lower() for a in added}])
    handle = df.sparkSession.sparkContext.broadcast(model)  # bounded by most_grams
    schema = with_fields(base.schema, f"`{pred}` string, `{score}` double" + f", `{spans}` array<struct<word:int,words:int,lang:string>>" * bool(spans))
    kind = pa.list_(pa.struct([("word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = label(handle.value, batch.column(text).to_pylist())
                columns = [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                if spans:
                    columns.append(pa.array([[{"word": a, "words": n, "lang": x} for a, n, x in f[2]] for f in found], kind))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return base.mapInArrow(tidy("", run, None if lasting else lambda: handle.value.forget()), schema)

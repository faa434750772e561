"""Toxicity by a weighted finite-state grammar over clauses.

Words map to classes (insult, threat, target, negation, reporting, intent, quote). Five small
machines read the classes of a clause, one each for insults, threats, targets, negation and reported
speech; their composition is one table whose arcs say what a matched word counts as: a bare,
targeted, negated or reported insult, a threat, or a target after an insult. Each arc has a weight.

A clause's strength is the sum over its path of arc weight times word weight, and its score
1 - exp(-RATE * strength ** POWER): what stands together in a clause counts more than apart. The clauses'
scores are combined by noisy-or; a logistic regression on that and on the highest clause score gives
the document's score. So the same words in other clauses give another score.

Lexica and weights are learned: stems (words and word beginnings) that are significantly more
frequent in toxic documents are threats if they mostly follow a word of intent, else insults; stems that
differ in their last letter only share one weight; arc weights are fitted within the order that the
grammar sets. All are fitted on a bounded sample of labelled rows (SAMPLE).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import durable
from crestline.llm.fitting import labelled_sample, logistic
from crestline.llm.near_dedup import minwise, shingles

#: Labelled rows of each class that the fit may use at most, stems that the lexicon may hold.
SAMPLE, STEMS = {1: 4_000, 0: 8_000}, 2_000
#: Log odds of a stem from which on it weighs as much as a seed insult.
SURE = 5.0
#: Stems are words and word beginnings that go on. One counts if toxic documents have it so many times as often as others, and if chance would
#: give that less than exp(-SURPRISE) times over all stems in at least SUPPORT toxic documents.
RATIO, SURPRISE, SUPPORT, BEGINNINGS = 15.0, 3.0, 4, (4, 5, 6, 7, 8)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, QUOTE, END = range(9)
BARE, TARGETED, NEGATED, REPORTED, THREATENED, AFTER = range(6)
MATCHES = 6

# Seed words (fixed values), in English, French, German and Spanish.
SEEDS = {
    THREAT: "kill hurt destroy stab shoot strangle tuer frapper détruire töten schlagen umbringen vernichten matar golpear destruir",
    TARGET: "you your you're youre u they them he she him her his tu toi vous ils elles du dich ihr euch sie er tú ti usted ustedes vosotros ellos",
    NEGATION: "not no never isn't aren't don't nobody none pas jamais aucun nicht kein keine nie nunca jamás ningún tampoco",
    REPORT: "said says say called calls told reported wrote quoted claims dit disait écrit appelé sagte sagt schrieb nannte dijo dice escribió llamó",
    INTENT: "will gonna shall should must vais vas va werde wirst wird voy vas debería",
}
#: Insults that count before any label is seen (fixed values).
SEED_INSULTS = "idiot moron stupid scum trash loser pathetic worthless disgusting clown"

_TOKENS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;\n]+|[\"“”«»]")
_WORDS = re.compile(r"[^\W\d_]+")


class Machine:
    """A finite-state transducer over word classes: step(state, class) -> (state, mark)."""

    def __init__(self, start, step):
        self.start, self.step = start, step


def insults() -> Machine:
    """Marks an insult, and remembers for three words that there was one."""
    return Machine(0, lambda s, c: (3, "insult") if c == INSULT else (max(0, s - 1), "near" if s else ""))


def threats() -> Machine:
    """Marks a threatening verb; intent within three words before makes it certain."""
    return Machine(0, lambda s, c: (3, "") if c == INTENT else (0, "threat!" if s else "threat") if c == THREAT else (max(0, s - 1), ""))


def targets() -> Machine:
    """A target word points at the next four words."""
    return Machine(0, lambda s, c: (4, "target") if c == TARGET else (max(0, s - 1), "aimed" if s else ""))


def negations() -> Machine:
    """A negation covers the next three words."""
    return Machine(0, lambda s, c: (3, "") if c == NEGATION else (max(0, s - 1), "negated" if s else ""))


def reports() -> Machine:
    """A reporting verb or an open quote covers the rest of the clause; a closing quote ends it."""

    def step(s, c):
        if c == QUOTE:
            return (0 if s == 2 else 2), ""
        return (max(s, 1) if c == REPORT else s), "reported" if s else ""

    return Machine(0, step)


def compose(*machines: Machine) -> tuple[list[list[int]], list[list[int]]]:
    """One table: next[state][class] and output[state][class] (a match, or -1) of all machines read together."""
    start = tuple(m.start for m in machines)
    number, todo, nexts, outs = {start: 0}, [start], [], []
    while todo:
        state = todo.pop(0)
        row, out = [], []
        for c in range(END):
            moved = [m.step(s, c) for m, s in zip(machines, state, strict=True)]
            after, marks = tuple(s for s, _ in moved), {x for _, x in moved}
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
            out.append(_match(marks))
        nexts.append(row)
        outs.append(out)
    return nexts, outs


def _match(marks: set[str]) -> int:
    if "insult" in marks:
        return REPORTED if "reported" in marks else NEGATED if "negated" in marks else TARGETED if "aimed" in marks else BARE
    if "threat!" in marks or ("threat" in marks and "aimed" in marks):
        return REPORTED if "reported" in marks else NEGATED if "negated" in marks else THREATENED
    return AFTER if "target" in marks and "near" in marks else -1


class Grammar:
    """The composed table with a lexicon of insults and one of threats; matches() gives a document's sums by kind of match."""

    def __init__(self, insult_stems: dict[str, float], threat_stems: dict[str, float] | None = None):
        self.words = {w: (c, 1.0 if c == THREAT else 0.0) for c, ws in SEEDS.items() for w in ws.split()}
        self.stems: dict[str, tuple[int, float]] = {}
        for c, stems in ((INSULT, insult_stems), (THREAT, threat_stems or {})):
            for k, v in stems.items():
                (self.stems if k.endswith("*") else self.words)[k] = (c, v)
        self.lengths = sorted({len(k) - 1 for k in self.stems})
        self.next, self.out = compose(insults(), threats(), targets(), negations(), reports())
        self.known: dict[str, tuple[int, float]] = {}

    def classify(self, word: str) -> tuple[int, float]:
        found = self.words.get(word, (OTHER, 0.0))
        if found[0] not in (INSULT, THREAT):
            for n in self.lengths:
                if len(word) > n and (stem := self.stems.get(word[:n] + "*")):
                    return stem
        if not word[0].isalpha():
            return (END if word[0] in ".!?;\n" else QUOTE), 0.0
        return found

    def classes(self, text: str) -> list[tuple[int, float]]:
        """Class and weight of each word and mark."""
        tokens = _TOKENS.findall(text.lower())
        known = self.known
        if len(known) > 500_000:
            known.clear()
        try:
            return [known[t] for t in tokens]
        except KeyError:
            for t in tokens:
                if t not in known:
                    known[t] = self.classify(t)
            return [known[t] for t in tokens]

    def clauses(self, text: str) -> tuple[list[tuple[float, ...]], int]:
        """Of each clause with a match the sums of word weights by kind of match; the number of the text's words and marks."""
        found = self.classes(text)
        out: list[tuple[float, ...]] = []
        if not any(c == INSULT or c == THREAT for c, _ in found):
            return out, len(found)
        state, sums, matched = 0, [0.0] * MATCHES, False
        for c, w in found:
            if c == END:
                if matched:
                    out.append(tuple(sums))
                    sums, matched = [0.0] * MATCHES, False
                state = 0
                continue
            o = self.out[state][c]
            state = self.next[state][c]
            if o >= 0:
                sums[o] += w or 1.0
                matched = True
        if matched:
            out.append(tuple(sums))
        return out, len(found)

    def matches(self, text: str) -> np.ndarray:
        """Sums of word weights by kind of match over all clauses, then the number of words and marks."""
        found, words = self.clauses(text)
        return np.append(np.sum(found, axis=0) if found else np.zeros(MATCHES), words)


#: A clause's score is 1 - exp(-RATE * strength ** POWER); one bare insult has the strength 1.
RATE, POWER = 0.2, 1.5
#: Weights of the arcs by kind of match before any label is seen, and the bounds that the grammar sets to what is learned:
#: a negated or reported insult never counts more than half a bare one, one at a target or a threat never less.
ARCS = np.array([1.0, 1.5, 0.25, 0.25, 1.5, 0.5])
BOUNDS = ((1.0, 1.0), (1.0, 3.0), (0.05, 0.5), (0.05, 0.5), (1.0, 3.0), (0.0, 1.0))
#: Of features(): intercept, log of the noisy-or in single insults, highest clause score, whether the noisy-or goes beyond one bare insult.
PLAIN = np.array([-4.0, 1.5, 1.0, 3.0])


def clause_scores(clauses: np.ndarray, arcs: np.ndarray) -> np.ndarray:
    """Of rows of sums by kind of match, a clause each: scores in 0..1."""
    return 1 - np.exp(-RATE * (clauses[:, :MATCHES] @ arcs) ** POWER)


def features(scores: np.ndarray, of: np.ndarray, documents: int, times: np.ndarray | float = 1.0) -> np.ndarray:
    """Of documents, from the scores of their clauses (clause k stands times[k] times in document of[k]).

    An intercept, their noisy-or on a log scale of single insults, the highest score, how far the noisy-or goes from 1 to 2 insults.
    """
    insults_worth = np.bincount(of, weights=-times * np.log1p(-np.minimum(scores, 1 - 1e-12)) / RATE, minlength=documents)
    highest = np.zeros(documents)
    np.maximum.at(highest, of, scores)
    return np.column_stack([np.ones(documents), np.log1p(insults_worth), highest, np.clip(insults_worth - 1, 0, 1)])


@dataclass
class Model:
    """What scoring needs: lexica of insults and threats, weights of arcs and of features. Its size is bounded by STEMS."""

    lexicon: dict[str, float]
    threats: dict[str, float]
    arcs: np.ndarray
    weights: np.ndarray

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_grammar"}

    def grammar(self) -> Grammar:
        if not hasattr(self, "_grammar"):
            self._grammar = Grammar(self.lexicon, self.threats)
        return self._grammar

    def scores(self, texts: list[str]) -> np.ndarray:
        found = [self.grammar().clauses(t)[0] for t in texts]
        of = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        clauses = np.array([c for f in found for c in f]).reshape(-1, MATCHES)
        x = features(clause_scores(clauses, self.arcs), of, len(texts))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _stems_of(text: str) -> set[str]:
    words = {w for w in _WORDS.findall(text.lower()) if len(w) > 2}
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}


#: Minwise tokens of which two rows share one if they are near copies.
_KEYS = 4


def _first_of_copies(rows: DataFrame) -> frozenset:
    """The doc_ids to count stems on: of rows of one class that share a minwise token, the first. `rows` is the bounded sample."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            least = [minwise(shingles(t))[:_KEYS].astype("int64").tolist() for t in b.text]
            yield pd.DataFrame({"doc_id": b.doc_id, "y": b.y, "least": least})

    table = rows.mapInPandas(sketch, "doc_id long, y int, least array<long>").toPandas().sort_values("doc_id")
    seen, kept = set(), set()
    for doc, y, least in zip(table.doc_id, table.y, table.least, strict=True):
        keys = {(y, k, int(v)) for k, v in enumerate(least)}
        if not keys & seen:
            kept.add(int(doc))
        seen |= keys
    return frozenset(kept)


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of at most SAMPLE labelled rows of each class that are not held out, by hash order; and all such rows' counts; a doc_id with several labels is toxic if any of them says so."""
    return labelled_sample(docs, labels, label, held_out(F.col("doc_id")), SAMPLE)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fit lexica, arcs and weights. Without labelled rows of both classes the seed words and fixed weights hold."""
    rows, counts = training_rows(docs, labels, label)
    seeds = {w: 1.0 for w in SEED_INSULTS.split()}
    plain = Model(seeds, {}, ARCS, PLAIN)
    if not counts.get(0) or not counts.get(1):
        return plain

    kept = _first_of_copies(rows)

    def stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = {0: Counter(), 1: Counter()}
        for b in batches:
            for doc, t, y in zip(b.doc_id, b.text, b.y, strict=True):
                if doc in kept:
                    found[y].update(_stems_of(t))
                    found[y][""] += 1
        every = list(set(found[0]) | set(found[1]))
        for i in range(0, len(every), 50_000):
            part = every[i : i + 50_000]
            yield pd.DataFrame({"stem": pd.Series(part, dtype=object), "bad": [found[1][s] for s in part], "good": [found[0][s] for s in part]})

    counted = rows.mapInPandas(stems, "stem string, bad long, good long").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counted = durable(counted.where((F.col("stem") == "") | (F.col("bad") >= SUPPORT)))
    all_bad, all_good = counted.where("stem = ''").select("bad", "good").first() or (1, 1)
    base, share = F.lit(max(1, all_bad) / max(1, all_bad + all_good)), F.col("bad") / (F.col("bad") + F.col("good"))
    surprise = F.col("bad") * F.log(share / base) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    limit = SURPRISE + float(np.log(max(1, counted.count())))
    ratio = (F.col("bad") / max(1, all_bad)) / ((F.col("good") + 0.5) / max(1, all_good))
    strong = counted.where((F.col("stem") != "") & (ratio >= RATIO) & (surprise >= limit)).orderBy(F.desc("bad"), "stem").limit(STEMS)
    own = {w for c, ws in SEEDS.items() if c != THREAT for w in ws.split()}  # words of the grammar keep their class
    chosen = [(r.stem, r.bad, r.good) for r in strong.collect() if r.stem not in own]
    lexicon = _shortest(chosen, max(1, all_bad), max(1, all_good))
    threatening = _threats_among(rows.where("y = 1"), lexicon)
    insulting = {k: v for k, v in lexicon.items() if k not in threatening} | seeds
    fitted = Model(insulting, {k: lexicon[k] for k in threatening}, ARCS, PLAIN)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = fitted.grammar()
        for b in batches:
            for y, text in zip(b.y, b.text, strict=True):
                found = Counter(grammar.clauses(text)[0])  # like clauses once, with how often they stand
                yield pd.DataFrame({"y": [y], "m": [[x for c in found for x in c]], "n": [list(found.values())]})

    table = rows.mapInPandas(sums, "y int, m array<double>, n array<long>").toPandas()  # of at most the sampled rows, one a doc_id, their unlike clauses
    if table.y.nunique() < 2:
        return fitted
    y, times = table.y.to_numpy(float), [np.asarray(n, np.int64) for n in table.n]
    of = np.repeat(np.arange(len(y)), [len(n) for n in times])
    clauses = np.concatenate([np.asarray(m, float) for m in table.m]).reshape(-1, MATCHES)
    weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    arcs, weights = fit(clauses, y, weight / weight.mean(), of, np.concatenate(times))
    return Model(fitted.lexicon, fitted.threats, arcs, weights)


#: Share of a stem's occurrences in toxic documents that follow a word of intent from which on it is a threat.
THREATENS = 0.5


def _threats_among(toxic: DataFrame, lexicon: dict[str, float]) -> set[str]:
    """The stems that are threats rather than insults: in toxic clauses most of them stand where the machine of threats waits for a verb."""
    if not lexicon:
        return set()
    grammar = Grammar(lexicon)

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, after = Counter(), Counter()
        for b in batches:
            for text in b.text:
                tokens, state, machine = _TOKENS.findall(text.lower()), 0, threats()
                for t, (c, _) in zip(tokens, grammar.classes(text), strict=True):
                    if c == INSULT:
                        stem = t if t in lexicon else next(t[:n] + "*" for n in grammar.lengths if t[:n] + "*" in lexicon)
                        every[stem] += 1
                        after[stem] += state > 0
                    state = 0 if c == END else machine.step(state, c)[0]
        names = list(every)
        yield pd.DataFrame({"stem": pd.Series(names, dtype=object), "n": [every[s] for s in names], "m": [after[s] for s in names]})

    found = toxic.mapInPandas(seen, "stem string, n long, m long").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return {r.stem for r in found.where((F.col("m") >= SUPPORT) & (F.col("m") >= THREATENS * F.col("n"))).collect()}


def fit(clauses: np.ndarray, y: np.ndarray, weight: np.ndarray, of: np.ndarray | None = None, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Arc weights within BOUNDS and weights of features: coordinate search over arcs, a logistic regression for each choice.

    Clause k stands times[k] times in document of[k] (without `of`: once, in document k). What labels do not tell stays near ARCS.
    No feature counts against a document.
    """
    of = np.arange(len(clauses)) if of is None else of
    times = np.ones(len(clauses)) if times is None else times

    def cost(arcs: np.ndarray) -> tuple[float, np.ndarray]:
        x = features(clause_scores(clauses, arcs), of, len(y), times)
        w = logistic(x, y, weight)
        while (w[1:] < 0).any():  # what would count against a document goes
            x = x * np.r_[1.0, w[1:] > 0]
            w = logistic(x, y, weight)
            w[1:][~x[:, 1:].any(axis=0)] = 0
        z = np.clip(x @ w, -30, 30)
        loss = float((weight * (np.log1p(np.exp(z)) - y * z)).sum())
        away = np.log((arcs + 0.1) / (ARCS + 0.1))
        return loss + 2.0 * float((away**2).sum()), w

    arcs = ARCS.copy()
    best, weights = cost(arcs)
    for _ in range(3):
        before = best
        for k, (low, high) in enumerate(BOUNDS):
            for value in np.linspace(low, high, 5) if low < high else ():
                tried = arcs.copy()
                tried[k] = value
                c, w = cost(tried)
                if c < best - 1e-9:
                    best, arcs, weights = c, tried, w
        if before - best < 1e-6:
            break
    return arcs, weights


def _shortest(kept: list[tuple[str, int, int]], bad: int, good: int) -> dict[str, float]:
    """Stems that stand for all that are kept: a beginning gives way to one that is longer and as frequent; what a kept beginning covers goes."""
    count = {s: (b, g) for s, b, g in kept}
    value = lambda b, g: float(min(1.0, max(0.2, np.log(((b + 0.5) / bad) / ((g + 0.5) / good)) / SURE)))
    starts = sorted((s for s in count if s.endswith("*")), key=len)
    longer: dict[str, int] = {}
    for s in starts:
        longer[s[:-2]] = max(longer.get(s[:-2], 0), count[s][0])
    words = [s for s in count if not s.endswith("*")]
    for w in words:
        for n in BEGINNINGS:
            if len(w) > n:
                longer[w[:n]] = max(longer.get(w[:n], 0), count[w][0])
    out: dict[str, float] = {}
    for s in starts:
        stem = s[:-1]
        if longer.get(stem, 0) < 0.95 * count[s][0] and not any(stem[:n] + "*" in out for n in BEGINNINGS if n < len(stem)):
            out[s] = value(*count[s])
    alike: dict[str, list[str]] = {}
    for s in out:
        alike.setdefault(s[:-2], []).append(s)
    for group in alike.values():  # endings of one stem share a weight, that of their counts together
        out.update(dict.fromkeys(group, value(*(sum(count[s][k] for s in group) for k in (0, 1)))))
    for w in words:
        if not any(w[:n] + "*" in out for n in BEGINNINGS if len(w) > n):
            out[w] = value(*count[w])
    return out


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add `out` in 0..1 to docs. Null and empty texts match nothing and get the score of that; whole texts are read; other columns stay."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model.scores([t or "" for t in s]), dtype="float64")

    return docs.withColumn(out, run(F.col(text)))

"""Toxicity by a weighted finite-state pattern grammar.

Method: a lexicon writes a symbol for each token: an insult (of three levels), a threat, a target (who is addressed), a
negation, a report (a word that reports speech), a quotation mark, the end of a clause, or any other word. Four
transducers read them one after the other and are composed to a single one: negation and reported speech mark
the insults and threats within their reach, the target transducer guesses at the start of a clause whether it has a target
and drops the paths that guessed wrong, and the clause transducer gives the arcs of insults and threats their
weights; a threat without a target has none. Clauses are matched and weighed whole; of a word alone nothing but its symbol counts.

Insults and their levels are learned from labelled rows, as words and as beginnings of words, and so are the weights
of the arcs, which stay near their given values where rows say nothing about them. The sum of a text's clause weights is
the logit of its score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, map_arrow, prepare, staged
from .fst import Transducer

#: Labelled rows to learn from.
ROWS = 5000
#: Letters of the beginnings of words that count as terms.
STEMS = range(4, 9)
#: Least rows with the label that a term must occur in, and rows without it that every term is given besides its own.
LEAST_ROWS, UNSEEN = 3, 1.0
#: Least log-odds of the terms of each level.
LEVELS = (2.5, 3.5, 4.5)
# Closed classes in English, German, French and Spanish.
TARGET = frozenset("you your you're u ya yourself du dich dir dein deine ihr euch euer sie tu toi te ton ta vous votre tú tu usted ustedes vosotros eres".split())
NEGATION = frozenset("not no never isn't aren't wasn't don't neither nor nicht kein keine keinen nie niemals pas jamais aucun aucune non ni nunca jamás ningún ninguna".split())
REPORT = frozenset("said says say saying wrote writes called calls quoted quote reported claimed sagte sagt schrieb nannte dit disait écrit écrivait appelé dijo dice escribió llamó".split())
#: Beginnings of verbs; their forms count with them.
THREAT = ("kill", "murder", "stab", "shoot", "strangl", "hurt", "destroy", "töte", "umbring", "erschieß", "absteche", "tuer", "frappe", "égorge", "matar", "matare", "apuñal", "dispar")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n\"“”«»]")

#: Symbols that the lexicon writes: insults by level, threat, target, negation, report, quotation mark, colon, end, any other word.
INSULTS, OTHERS = "abc", "tnrq:.-"
HARM = INSULTS + "h"
#: Words that a negation reaches.
REACH = 3
#: Weights of arcs, and of the logarithm of a text's tokens, as longer texts hold more that looks like harm by chance; with the values that learning starts from and is drawn to.
WEIGHTS = {"a": 1.5, "b": 1.0, "c": 1.0, "h": 2.5, "negated": -1.5, "reported": -1.0, "targeted": 0.5, "further": -0.5, "length": -0.5}

#: How strongly weights are drawn to those values: the constant hardly, those that rows seldom speak of more than the others.
FREE, DRAWN, STIFF = 1e-3, 0.3, 5.0


def negation() -> Transducer:
    """Marks harm within REACH words after a negation with `n`; the first one found uses it up."""
    arcs = []
    for k in range(REACH + 1):
        s, less = f"n{k}", f"n{max(0, k - 1)}"
        arcs += [(s, x, x + "n" if k else x, (), "n0") for x in HARM]
        arcs += [(s, "n", "n", (), f"n{REACH}")]
        arcs += [(s, x, x, (), "n0" if x in ":." else s if x == "q" else less) for x in "trq:.-"]
    return Transducer("n0", (f"n{k}" for k in range(REACH + 1)), arcs)


def report() -> Transducer:
    """Marks harm with `r` after a reporting word in its clause, after its colon, and within its quotation marks."""
    harm = [x + n for x in HARM for n in ("", "n")]
    arcs = [("open", x, x, (), "open") for x in harm] + [("said", x, x + "r", (), "said") for x in harm] + [("quoted", x, x + "r", (), "quoted") for x in harm]
    for s in ("open", "said", "quoted"):
        arcs += [(s, x, x, (), s) for x in "tn-"]
        arcs += [(s, "r", "r", (), "quoted" if s == "quoted" else "said")]
        arcs += [(s, "q", "q", (), {"open": "open", "said": "quoted", "quoted": "open"}[s])]
        arcs += [(s, ":", ".", (), s), (s, ".", ".", (), "quoted" if s == "quoted" else "open")]
    return Transducer("open", ("open", "said", "quoted"), arcs)


def target() -> Transducer:
    """Marks harm with `t` in clauses with a target. A clause begins with a guess, `without` or `wanted`; wrong ones find no arc."""
    harm = [x + n + r for x in HARM for n in ("", "n") for r in ("", "r")]
    arcs = []
    for s in ("without", "wanted", "found"):
        arcs += [(s, x, x if s == "without" else x + "t", (), s) for x in harm]
        arcs += [(s, x, x, (), s) for x in "nrq-"]
        if s != "without":
            arcs += [(s, "t", "t", (), "found")]
        if s != "wanted":
            arcs += [(s, ".", ".", (), to) for to in ("without", "wanted")]
    return Transducer("without", ("without", "found"), arcs)


def clause() -> Transducer:
    """Weighs harm; what follows the first harm of a clause is `further`. A threat counts with a target alone. An insult has the
    weights of the levels below its own too, so a level that learning hasn't met is worth no less than they are."""
    arcs = []
    for x in HARM:
        for marks in (n + r + t for n in ("", "n") for r in ("", "r") for t in ("", "t")):
            names = (*(INSULTS[: INSULTS.index(x) + 1] if x in INSULTS else x), *(("negated",) * ("n" in marks)), *(("reported",) * ("r" in marks)), *(("targeted",) * ("t" in marks and x != "h")))
            idle = x == "h" and "t" not in marks
            for s in ("none", "some"):
                own = () if idle else names + ("further",) * (s == "some")
                arcs.append((s, x + marks, x + marks, own, s if idle else "some"))
    arcs += [(s, x, x, (), s) for s in ("none", "some") for x in "tnrq-"]
    arcs += [(s, ".", ".", (), "none") for s in ("none", "some")]
    return Transducer("none", ("none", "some"), arcs)


class Machine:
    """The composed transducer as numbers. A clause end both ends what stands before it and starts the next guess, so one is
    read before the first clause and one after the last."""

    def __init__(self):
        whole = negation().then(report()).then(target()).then(clause())
        states = sorted({whole.start, *(s for s, _ in whole.arcs), *(to for own in whole.arcs.values() for *_, to in own)})
        place, names = {s: i for i, s in enumerate(states)}, list(WEIGHTS)
        self.start, self.finals = place[whole.start], {place[s] for s in whole.finals}
        self.arcs: dict[tuple[int, str], list[tuple[tuple[int, ...], int]]] = {}
        for (s, read), own in whole.arcs.items():
            self.arcs[place[s], read] = [(tuple(names.index(w) for w in weights), place[to]) for _, weights, to in own]

    def clauses(self, symbols: str) -> list[np.ndarray]:
        """How often each weight stands on the arcs of each clause that has any. All paths but one die out by a clause's end."""
        out: list[np.ndarray] = []
        alive: list[tuple[int, tuple[int, ...]]] = [(self.start, ())]
        for x in f".{symbols}.":
            alive = [(to, seen + own) for state, seen in alive for own, to in self.arcs.get((state, x), ())]
            if x in ".:":
                if alive[0][1]:
                    out.append(np.bincount(alive[0][1], minlength=len(WEIGHTS)).astype(float))
                alive = [(state, ()) for state, _ in alive]
        return out


class Lexicon(dict):
    """Tokens as symbols, from terms with their levels from 1; remembers those that it has met."""

    def __init__(self, insults: dict[str, int], most: int = 200_000):
        super().__init__()
        self.most = most
        self.words = {w: v for w, v in insults.items() if not w.endswith("*")}
        self.stems = {w[:-1]: v for w, v in insults.items() if w.endswith("*")}

    def __missing__(self, token: str) -> str:
        level = max([self.words.get(token, 0), *(self.stems.get(token[:k], 0) for k in STEMS if k <= len(token))])
        if level:
            found = INSULTS[level - 1]
        elif token in ".!?;\n":
            found = "."
        elif token == ":":
            found = ":"
        elif token in "\"“”«»":
            found = "q"
        elif token in NEGATION:
            found = "n"
        elif token in REPORT:
            found = "r"
        elif token in TARGET:
            found = "t"
        else:
            found = "h" if token.startswith(THREAT) else "-"
        if len(self) >= self.most:
            self.clear()
        self[token] = found
        return found


_HARM, _IDLE = re.compile(f"[{HARM}]"), re.compile("-{%d,}" % (REACH + 1))


class Grammar:
    def __init__(self, insults: dict[str, int]):
        self.lexicon, self.machine = Lexicon(insults), Machine()

    def symbols(self, text: str | None) -> str:
        return "".join(map(self.lexicon.__getitem__, _TOKEN.findall((text or "").lower())))

    def clauses(self, symbols: str) -> list[np.ndarray]:
        """How often each weight stands in each matched clause."""
        if not _HARM.search(symbols):
            return []
        return self.machine.clauses(_IDLE.sub("-" * REACH, symbols))  # more words in a row change no state

    def read(self, text: str | None) -> tuple[np.ndarray, int]:
        """How often each weight counts in a text, and the number of its matched clauses."""
        symbols = self.symbols(text)
        own = self.clauses(symbols)
        counts = sum(own, np.zeros(len(WEIGHTS)))
        counts[-1] = np.log1p(len(symbols))
        return counts, len(own)


def terms(text: str | None) -> set[str]:
    """Words, and beginnings of words, that may turn out to be insults."""
    out: set[str] = set()
    for w in {t for t in _TOKEN.findall((text or "").lower()) if t[0].isalpha()}:
        out.add(w)
        out.update(w[:k] + "*" for k in STEMS if k < len(w))
    return out


_TERMS = pa.schema([("term", pa.string()), ("half", pa.int32()), ("label", pa.int32())])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for text, half, label in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own = list(terms(text))
            yield batch(_TERMS, own, [half] * len(own), [label] * len(own))


def lexicon(seen: list[tuple[str, int, int]], n: tuple[int, int]) -> dict[str, int]:
    """Insults with their levels, from (term, rows with the label, rows without it) and the numbers of all such rows."""
    out = {}
    for term, own, other in seen:
        odds = float(np.log((own + 0.5) / (n[1] + 1)) - np.log((other + UNSEEN) / (n[0] + UNSEEN)))
        if own >= LEAST_ROWS and odds >= LEVELS[0] and not (term in TARGET or term in NEGATION or term in REPORT):
            out[term] = sum(odds >= x for x in LEVELS)
    return out


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, penalty: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights of a logistic function by Newton's method with steps that never make the fit worse, drawn to the prior."""
    w, ridge = prior.copy(), np.diag(penalty)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + penalty @ (w - prior) ** 2 / 2)

    last = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ (w - prior))
        while (now := loss(w - step)) > last and np.abs(step).max() > 1e-9:
            step = step / 2
        if last - now < 1e-9:
            return w
        w, last = w - step, now
    return w


class Model:
    def __init__(self, insults: dict[str, int], counts: np.ndarray, labels: np.ndarray):
        """counts: of each labelled row, made with insults that the row had no part in."""
        self.insults = insults
        rate = (labels.sum() + 0.5) / (len(labels) + 1)
        prior = np.array([np.log(rate / (1 - rate)), *WEIGHTS.values()])
        penalty = np.array([FREE, *(STIFF if name in ("negated", "reported") else DRAWN for name in WEIGHTS)])
        self.weights = fit(np.concatenate([np.ones((len(labels), 1)), counts], 1), labels, prior, penalty) if 0 < labels.sum() < len(labels) else prior

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + counts @ self.weights[1:], -30, 30)))


_COUNTS = pa.schema([("label", pa.int32()), ("counts", pa.list_(pa.float64()))])


def _counted(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammars = [Grammar(own) for own in sent.value]
        for b in batches:
            text, half, label = (c.to_pylist() for c in b.columns)
            yield batch(_COUNTS, label, [grammars[1 - h].read(t)[0].tolist() for t, h in zip(text, half, strict=True)])

    return run


def learn(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most ROWS labelled rows where train holds, those with the least hashes of their ids.

    Both tables have id_col. Rows without an id or a label are left out; of an id with several labels the highest counts; of several
    rows with one id the one whose text has the least hash. Null texts have no terms. Without rows, or with rows of
    one label alone, the weights keep the values that they start from.

    Insults are learned on each half of the rows, to see on the other half how far they hold, and then on all of them.
    """
    spark = prepare(docs.sparkSession)
    own = labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    chosen = own.orderBy(F.xxhash64("id"), "id").limit(ROWS)
    half = (F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")) % 2).alias("half")
    chosen = staged(chosen.select("id", "label", half), "labels")
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")  # ROWS rows at most
    rows = staged(found.groupBy("id", "label", "half").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "labelled")

    n = {(r.half, r.label): r.n for r in rows.groupBy("half", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [[n.get((h, k), 0) for k in (0, 1)] for h in (0, 1)]
    seen = map_arrow(rows.select("text", "half", "label"), _terms, "term string, half int, label int")
    sums = [F.count_if((F.col("half") == h) & (F.col("label") == k)) for h in (0, 1) for k in (1, 0)]
    seen = seen.groupBy("term").agg(*(s.alias(f"n{i}") for i, s in enumerate(sums))).where(f"n0 + n2 >= {LEAST_ROWS}")
    # few terms of rows without the label are left, and those that occur in them as often as elsewhere are no insults
    seen = seen.where((F.col("n0") + F.col("n2") + 0.5) * (n[0][0] + n[1][0] + 1) >= np.exp(LEVELS[0] - 2) * (F.col("n1") + F.col("n3") + 0.5) * (n[0][1] + n[1][1] + 1))
    seen = [tuple(r) for r in seen.collect()]
    halves = [lexicon([(t, x[2 * h], x[2 * h + 1]) for t, *x in seen], tuple(n[h])) for h in (0, 1)]
    both = lexicon([(t, x[0] + x[2], x[1] + x[3]) for t, *x in seen], (n[0][0] + n[1][0], n[0][1] + n[1][1]))

    made = map_arrow(rows.select("text", "half", "label"), _counted(spark.sparkContext.broadcast(halves)), "label int, counts array<double>").collect()
    return Model(both, np.array([r[1] for r in made]).reshape(-1, len(WEIGHTS)), np.array([r[0] for r in made], float))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("clauses", pa.int64())])


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        grammar = Grammar(model.insults)
        for b in batches:
            own = [grammar.read(t) for t in b.column(1).to_pylist()]
            counts = np.array([c for c, _ in own]).reshape(-1, len(WEIGHTS))
            yield batch(_SCHEMA, b.column(0), model.score(counts), [k for _, k in own])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, clauses) for every row.

    Null and empty texts have no clauses and get the score that this gives. Repeated rows are scored each for
    itself; other columns are ignored; an empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), _score(spark.sparkContext.broadcast(model)), "doc_id long, score double, clauses long")

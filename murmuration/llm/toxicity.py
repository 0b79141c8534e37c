"""Toxicity by a weighted finite-state pattern grammar.

Tokens of a clause, and phrases of several, become classes (insult, threat, target, negator, reporting word,
quotation mark, other). Small transducers read the classes side by side: one marks hits, one remembers a target (a hit
before it waits for it to the clause's end), one holds the scope of a negation, one that of reported speech. They are composed into one table of
states; a run over the clause yields its score, the weights of its hits times what the other
machines make of them. So "you are an idiot" outweighs "idiot", and "not an idiot" or "she wrote
'idiot'" counts less. A document's score is a logistic function of its clauses' scores.

Insult weights are learned from labelled rows: a word counts once per family of like documents
(documents whose words have the same two smallest hashes), so copies of one text teach nothing more. The fit uses at
most `sample` labelled rows, those of smallest hash; everything else reads all rows. Executors need the packages
xxhash and pyahocorasick.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from murmuration.llm import scratch
from murmuration.llm.text_blocks import frugal

#: Fixed word lists (English, French, German, Spanish), lower case.
INSULTS = ["asshole", "bastard", "crétin", "dummkopf", "fool", "idiot", "idiota", "imbécile", "imbécil", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trottel", "worthless"]
INSULTS += ["abruti", "arschloch", "bastardo", "cabrón", "clown", "connard", "cretin", "depp", "dimwit", "dumbass", "estúpido", "filth", "freak", "garbage", "gilipollas", "imbecile", "lunatic", "maggot", "ordure", "parasite", "pendejo", "pig", "salaud", "scumbag", "trash", "vermin", "vermine", "versager", "vollidiot"]
THREATS = ["asesinar", "destroy", "hurt", "kill", "matar", "schlagen", "shoot", "strangle", "tuer", "töten"]
THREATS += ["abattre", "burn", "crush", "erschießen", "frapper", "murder", "pegar", "punch", "quemar", "slap", "stab", "umbringen", "verbrennen", "égorger"]
#: The same of several words; blanks and marks between the words don't matter.
INSULT_PHRASES = ["good for nothing", "hijo de puta", "piece of trash", "waste of space", "shut up", "ferme la", "ta gueule", "halt die klappe", "cállate la boca", "fils de chien", "no one likes you", "go to hell", "dumm wie brot"]
THREAT_PHRASES = ["drop dead", "i will find you", "i know where you live", "you will pay", "je vais te trouver", "ich finde dich", "te voy a encontrar", "watch your back", "you will regret", "beat you up", "hope you die"]
TARGETS = ["du", "er", "eres", "euch", "he", "her", "him", "ihr", "ils", "sie", "she", "te", "them", "they", "toi", "tu", "usted", "ustedes", "vous", "you", "your"]
NEGATORS = ["jamais", "kein", "keine", "never", "nicht", "not", "nunca", "pas", "without"]
REPORTS = ["called", "dice", "dijo", "dit", "quoted", "reported", "said", "sagt", "sagte", "says", "schrieb", "wrote"]

#: A phrase says more than a word: it holds its own target or needs none.
PHRASE_WEIGHT = 4.0
OTHER, INSULT, THREAT, TARGET, NEGATOR, REPORT, QUOTE = range(7)
CLAUSE = re.compile(r"[.!?;:\n]+")
TOKEN = re.compile(r"[^\W\d_]+|[\"«»“”„]")
WORD = re.compile(r"[^\W\d_]{2,}")


class Machine:
    """A transducer over classes: step(state, class) gives (state, factor on a hit at this token)."""

    def __init__(self, states: int, step) -> None:
        self.states, self.step = states, step


# a target seen before the hit makes it directed; without one the hit waits (see Grammar.clause)
TARGET_MACHINE = Machine(2, lambda s, c: (1 if c == TARGET else s, 1.5 if s else 1.0))
#: Factors of a hit that waited: of a target after it in the clause, and of none; a threat without one is weak.
TARGET_AFTER, NO_TARGET = 1.4, {INSULT: 1.0, THREAT: 0.2}
# a negator reaches over the next three tokens
NEGATION_MACHINE = Machine(4, lambda s, c: (3 if c == NEGATOR else max(0, s - 1), 0.4 if s else 1.0))
# 0 plain, 1 after a reporting word (to the clause's end), 2 inside quotation marks
REPORT_MACHINE = Machine(3, lambda s, c: ({0: 2, 1: 2, 2: 0}[s] if c == QUOTE else 1 if c == REPORT and s == 0 else s, 1.0 if s == 0 else 0.6))


def compose(*machines: Machine) -> tuple[list[list[int]], list[list[float]]]:
    """The product machine as tables by state and class: next state, and factor on a hit."""
    states = list(itertools.product(*(range(m.states) for m in machines)))
    number = {s: i for i, s in enumerate(states)}
    to, factor = [], []
    for s in states:
        row = [[m.step(x, c) for m, x in zip(machines, s, strict=True)] for c in range(7)]
        to.append([number[tuple(x for x, _ in r)] for r in row])
        factor.append([math.prod(f for _, f in r) if c in (INSULT, THREAT) else 0.0 for c, r in enumerate(row)])
    return to, factor


class Grammar:
    """Word classes with weights, run over clauses by the composed machine."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = dict.fromkeys(INSULTS, 2.0) | dict.fromkeys(THREATS, 2.0) | weights
        self.kind = {w: k for k, words in ((REPORT, REPORTS), (NEGATOR, NEGATORS), (TARGET, TARGETS), (THREAT, THREATS)) for w in words}
        self.kind |= dict.fromkeys(INSULTS, INSULT) | dict.fromkeys([w for w in weights if w not in THREATS], INSULT) | dict.fromkeys('"«»“”„', QUOTE)
        self.to, self.factor = compose(TARGET_MACHINE, NEGATION_MACHINE, REPORT_MACHINE)
        # a phrase is one token of its class; they are tried longest first where their first word stands
        self.phrases: dict[str, list[tuple[list[str], int]]] = {}
        for kind, listed in ((INSULT, INSULT_PHRASES), (THREAT, THREAT_PHRASES)):
            for p in sorted(listed, key=len, reverse=True):
                self.phrases.setdefault(p.split()[0], []).append((p.split(), kind))
        # the target machine is the first: its states are runs of equal length
        self.directed = len(self.to) // TARGET_MACHINE.states
        self._finder = None

    @property
    def finder(self):
        """Finds texts and clauses that hold a hit word at all; most hold none."""
        if self._finder is None:
            import ahocorasick

            self._finder = ahocorasick.Automaton()
            for w in [*self.weights, *(max(p, key=len) for listed in self.phrases.values() for p, _ in listed)]:
                self._finder.add_word(w, len(w))
            self._finder.make_automaton()
        return self._finder

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_finder": None}

    def tokens(self, clause: str) -> Iterator[tuple[int, float]]:
        """(class, weight) of every token; a phrase is one."""
        words = TOKEN.findall(clause)
        at = 0
        while at < len(words):
            word, n, found = words[at], 1, None
            for phrase, kind in self.phrases.get(word, ()):
                if words[at : at + len(phrase)] == phrase:
                    n, found = len(phrase), kind
                    break
            yield (found, PHRASE_WEIGHT) if found else (self.kind.get(word, OTHER), self.weights.get(word, 0.0))
            at += n

    def clause(self, clause: str) -> float:
        state = 0
        total = 0.0
        waiting = {INSULT: 0.0, THREAT: 0.0}
        for c, weight in self.tokens(clause):
            if f := self.factor[state][c]:
                if state >= self.directed:
                    total += f * weight
                else:
                    waiting[c] += f * weight
            elif c == TARGET and state < self.directed:
                total += TARGET_AFTER * sum(waiting.values())
                waiting = dict.fromkeys(waiting, 0.0)
            state = self.to[state][c]
        return total + sum(NO_TARGET[c] * w for c, w in waiting.items())

    def features(self, text: str | None) -> tuple[float, float]:
        """(log of 1 + sum, maximum) of the clauses' scores; (0, 0) for null and empty texts."""
        text = (text or "").lower()
        places = [end for end, _ in self.finder.iter(text)]
        if not places:
            return 0.0, 0.0
        total = most = 0.0
        start, stops, k = 0, CLAUSE.finditer(text), 0
        for stop in [*(m.span() for m in stops), (len(text), len(text))]:
            if k < len(places) and places[k] < stop[1]:
                s = self.clause(text[start : stop[0]])
                total, most = total + s, max(most, s)
                while k < len(places) and places[k] < stop[1]:
                    k += 1
            start = stop[1]
        return math.log1p(total), most


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method; a weak ridge keeps separable data finite."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


@scratch.sized
def train(docs: DataFrame, labels: DataFrame, sample: int = 10_000, min_share: float = 0.01) -> tuple[Grammar, np.ndarray]:
    """(grammar, logistic weights) from rows outside the held-out fold. labels (doc_id, toxic); null labels don't
    count, an id with several is toxic if one says so. With one class only, and with no labelled rows, the word lists
    alone score. Other columns are ignored, whatever they are called. The words come from at most `sample` rows, so
    they are few. Very long texts are read whole."""
    spark = docs.sparkSession
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # a bounded sample, so it may be broadcast
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = scratch.materialize(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("toxic", "text"), "labelled")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = list(set(WORD.findall((text or "").lower())))
                # two smallest hashes of its words: like documents share both far more often than others do
                family = hash(tuple(min((xxhash.xxh64_intdigest(w, seed) for w in words), default=0) for seed in (1, 2))) >> 1
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic] * len(words), pa.int32()), pa.array([family] * len(words), pa.int64())], ["word", "toxic", "family"])

    seen = rows.mapInArrow(frugal(tokens), "word string, toxic int, family bigint").distinct()
    per_class = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.count_distinct("family").alias("n")).collect()}
    t_all, n_all = per_class.get(1, 0), per_class.get(0, 0)
    by_word = seen.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("n"))
    by_word = by_word.filter(F.col("t") >= max(3, min_share * t_all))
    odds = F.log((F.col("t") + 0.5) / (t_all - F.col("t") + 0.5)) - F.log((F.col("n") + 0.5) / (n_all - F.col("n") + 0.5))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") + 0.5))
    by_word = by_word.select("word", odds.alias("odds"), error.alias("error")).filter(F.col("odds") - 1.64 * F.col("error") > 1)
    weights = {r["word"]: float(r["odds"]) for r in by_word.collect()} if t_all and n_all else {}
    grammar = Grammar(weights)
    pairs = rows.mapInArrow(_features(grammar, "toxic"), "toxic int, a double, b double").toArrow()
    y = pairs.column("toxic").to_numpy()
    if len(np.unique(y)) < 2:
        return grammar, np.array([-2.0, 2.0, 0.0])
    return grammar, _fit(np.column_stack([pairs.column("a").to_numpy(), pairs.column("b").to_numpy()]), y)


def _features(grammar: Grammar, keep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([grammar.features(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(f[:, 0]), pa.array(f[:, 1])], [keep, "a", "b"])

    return run


def score(docs: DataFrame, grammar: Grammar, logistic: np.ndarray, text: str = "text") -> DataFrame:
    """docs with a column score (0 to 1). Every other column passes through but text decides alone (a column that is
    called score already is replaced); null and empty texts get the score of a text without hits; equal
    texts get equal scores; an empty table gives no rows."""
    docs = docs.select(*[c for c in docs.columns if c.lower() != "score"])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.asarray(logistic)
        for batch in batches:
            f = np.array([(1.0, *grammar.features(t)) for t in batch.column(text).to_pylist()], np.float64).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(f @ w, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "score"])

    return docs.mapInArrow(frugal(run), schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    grammar, logistic = train(docs, labels)
    out = score(docs.select("doc_id", "text"), grammar, logistic)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

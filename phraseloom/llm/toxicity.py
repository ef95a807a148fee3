"""Toxicity: a weighted finite-state pattern grammar over the words of a clause.

A clause ends at ``. ! ? ; :`` or a line break.  Each word is a symbol: insult, threat, target, negation, reporting
verb or other.  Three transducers are composed into one machine:

* negation: an insult or threat at most ``NEGATION_SPAN`` words after a negation is rewritten as negated;
* reported speech: after a reporting verb, insults and threats are rewritten as reported;
* target: a clause that addresses somebody is marked as targeted, before or after the insult.

The machine gives one reading for every insult or threat of a clause; a document's score is a logistic function of
its readings (log of one plus their number), weighted by kind.  Kinds have weights to start from, and labelled rows move them.
The insult lexicon is learned: a word enters it when it stands in many different contexts (word before, word
after) in toxic documents and in hardly any in others; counting contexts keeps copied documents from adding words.
Learned stems (beginnings of words, for inflected and compound forms) make a second, weaker class, ``slur``.

Bound (parameter): ``TRAIN_ROWS`` labelled rows, chosen by hash; all words and stems that pass the shares are learned from them.  Scoring reads every
whole text and needs no shuffle; a byte-table hash look-up finds the few clauses that the machine must read.  It finds all that hold a reading: runs with
characters at which the grammar ends a word or changes the case (quotes, dashes, spaces and capitals outside ASCII) are split as the grammar splits them.

Defined cases: null or empty texts, and texts without a reading, get the intercept's score (about the share of toxic
documents among those without readings).  Without labelled rows of both kinds nothing is learned, and the given words and weights hold.  Repeated rows get equal scores; a row without doc_id isn't
held out; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibrate import Logistic, fit_logistic
from .frames import hashed_sample, in_fold, labelled_rows, map_blocks, texts_of
from .textkernel import ALNUM, LOWER, WORD_HASH, word_spans

TRAIN_ROWS = 16_000
MIN_CONTEXTS = 5
MIN_SHARE = 0.9
STEM_LENGTHS = range(3, 9)
MIN_STEM_CONTEXTS = 15
MIN_STEM_SHARE = 0.6
NEGATION_SPAN = 3
THRESHOLD = 0.3
#: Most runs outside ASCII that a task remembers.
MAX_MEMO = 20_000

# The closed word classes and the insults and threats known without labels.
INSULTS = "idiot moron stupid loser trash scum worthless pathetic disgusting fool imbecile".split()
THREATS = "kill hurt destroy beat shoot stab burn crush".split()
TARGETS = "you your yours u he she they him her them his their this these those all everyone everybody".split()
NEGATIONS = "not no never none nobody neither nor without isn't aren't wasn't don't doesn't ne pas jamais nicht kein keine nie nunca".split()
REPORTS = "said says say told tells wrote writes called calls reported reports quoted quotes claimed claims dit sagte dijo".split()

KINDS = [f"{what}{neg}{rep}{tgt}" for what, neg, rep, tgt in product(("insult", "slur", "threat"), ("", "+negated"), ("", "+reported"), ("", "+target"))]
#: Weight before learning: threats without a target say little; negated and reported ones count less.
START = [(2.5 if k.startswith("insult") else 1.0 if k.startswith("slur") else 0.3) * (0.3 if "negated" in k else 1) * (0.5 if "reported" in k else 1) + (0.7 if "target" in k else 0) for k in KINDS]
START_INTERCEPT = -3.0


class Transducer:
    """A deterministic transducer: arcs[state, symbol] = (next state, output symbol); a missing arc keeps the state and copies."""

    def __init__(self, arcs: dict, start):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))

    def then(self, other: Transducer, symbols: list[str]) -> Transducer:
        """The composition: what this one puts out is what the other reads."""
        arcs, todo, seen = {}, [(self.start, other.start)], set()
        while todo:
            state = todo.pop()
            if state in seen:
                continue
            seen.add(state)
            for s in symbols:
                a, mid = self.step(state[0], s)
                b, out = other.step(state[1], mid)
                arcs[state, s] = ((a, b), out)
                todo.append((a, b))
        return Transducer(arcs, (self.start, other.start))

    def run(self, symbols: list[str]):
        state, out = self.start, []
        for s in symbols:
            state, o = self.step(state, s)
            out.append(o)
        return state, out


def _negation() -> Transducer:
    arcs = {}
    for left in range(NEGATION_SPAN + 1):
        after = max(left - 1, 0)
        for s in ("other", "target", "report"):
            arcs[left, s] = (after, s)
        arcs[left, "negation"] = (NEGATION_SPAN, "negation")
        for s in ("insult", "slur", "threat"):
            arcs[left, s] = (after, f"{s}+negated" if left else s)
    return Transducer(arcs, 0)


def _reported() -> Transducer:
    arcs = {(k, "report"): (1, "report") for k in (0, 1)}
    for s in (f"{what}{neg}" for what in ("insult", "slur", "threat") for neg in ("", "+negated")):
        arcs[0, s], arcs[1, s] = (0, s), (1, f"{s}+reported")
    return Transducer(arcs, 0)


def _target() -> Transducer:
    return Transducer({(k, "target"): (1, "target") for k in (0, 1)}, 0)


SYMBOLS = ["other", "insult", "slur", "threat", "target", "negation", "report"]
GRAMMAR = _negation().then(_reported(), SYMBOLS).then(_target(), SYMBOLS)
_CLAUSE_END = re.compile(rb"[.!?;:\n]")
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


def readings(symbols: list[str]) -> list[str]:
    """The kinds that the grammar reads in one clause."""
    state, out = GRAMMAR.run(symbols)
    targeted = "+target" if state[1] else ""
    return [f"{o}{targeted}" for o in out if o.startswith(("insult", "slur", "threat"))]


class Symbols:
    """Symbol of a word; the hashes by which clauses with an insult, slur or threat are found."""

    def __init__(self, lexicon: list[str], stems: list[str]):
        held = {w: "report" for w in REPORTS} | {w: "target" for w in TARGETS} | {w: "negation" for w in NEGATIONS}
        self.of = held | {w: "threat" for w in THREATS} | {w: "insult" for w in [*INSULTS, *lexicon]}
        self.stems = tuple(stems)
        self.words = _hashes([w for w, s in self.of.items() if s in ("insult", "threat")])
        by_size: dict[int, list[str]] = {}
        for stem in stems:
            by_size.setdefault(len(stem.encode()), []).append(stem)
        self.starts = {size: _hashes(own) for size, own in by_size.items()}
        self.seen: dict[bytes, bool] = {}

    def within(self, run: bytes) -> bool:
        """Whether the grammar may find an insult, slur or threat in a run of letters, digits and bytes outside ASCII."""
        if run not in self.seen:
            if len(self.seen) >= MAX_MEMO:
                self.seen.clear()
            words = _TOKEN.findall(run.decode("utf-8", "replace").lower())
            self.seen[run] = any(self.of.get(w) in ("insult", "threat") or w.startswith(self.stems) for w in words)
        return self.seen[run]

    def __call__(self, word: str) -> str:
        return self.of.get(word) or ("slur" if any(word.startswith(s) and len(word) > len(s) for s in self.stems) else "other")


def document_kinds(text: bytes, at: list[int], symbol: Symbols) -> Counter:
    """Readings of the clauses in which the byte positions ``at`` (ascending) lie."""
    found, end = Counter(), -1
    for p in at:
        if p < end:
            continue
        close = _CLAUSE_END.search(text, p)
        end = close.start() if close else len(text)
        begin = max(text.rfind(c, 0, p) for c in (b".", b"!", b"?", b";", b":", b"\n")) + 1
        words = _TOKEN.findall(text[begin:end].decode("utf-8", "replace").lower())
        found.update(readings([symbol(w) for w in words]))
    return found


def _hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    return np.sort(WORD_HASH.words(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends))


def _in(hashes: np.ndarray, values: np.ndarray) -> np.ndarray:
    return hashes[np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)] == values


def _outside(data: np.ndarray) -> np.ndarray:
    """Bytes that start a character outside ASCII other than the lower-case letters U+00DF to U+00FF: it may end a word or have another case."""
    after = np.append(data[1:], np.uint8(0))
    return (data >= 0xC0) & ~((data == 0xC3) & (after >= 0x9F) & (after != 0xB7))


def _counts(data: np.ndarray, borders: np.ndarray, symbol: Symbols) -> np.ndarray:
    """A row of numbers of readings, by KINDS, for each document."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, borders, ALNUM)
    out = np.zeros((len(borders) - 1, len(KINDS)))
    if not len(starts):
        return out
    hit = _in(symbol.words, WORD_HASH.words(data, starts, ends))
    for size, hashes in symbol.starts.items():
        long = np.flatnonzero(ends - starts >= size)  # a word goes on after an apostrophe
        hit[long] |= _in(hashes, WORD_HASH.words(data, starts[long], starts[long] + size))
    odd = np.flatnonzero(_outside(data))
    if len(odd):
        runs = np.unique(np.searchsorted(starts, odd, side="right") - 1)
        runs = runs[~hit[runs]]
        raw = data.tobytes()
        hit[runs] = [symbol.within(raw[a:b]) for a, b in zip(starts[runs].tolist(), ends[runs].tolist())]
    hits = np.flatnonzero(hit)
    if len(hits):
        where = np.searchsorted(first, hits, side="right") - 1
        cuts = np.flatnonzero(np.diff(where, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            d = where[a]
            text = data[borders[d] : borders[d + 1]].tobytes()
            for kind, n in document_kinds(text, (starts[hits[a:b]] - borders[d]).tolist(), symbol).items():
                out[d, KINDS.index(kind)] += n
    return out


def scores(data: np.ndarray, borders: np.ndarray, symbol: Symbols, weights: Logistic) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of readings of each document."""
    counts = _counts(data, borders, symbol)
    return weights.predict(np.log1p(counts)), counts.sum(axis=1).astype(np.int64)


def learn_lexicon(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Words, and beginnings of words, that stand in many contexts in toxic rows and in few others; from columns text and toxic."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = rows.select("toxic", words.alias("w")).select("toxic", F.explode(F.expr("transform(w, (x, i) -> struct(x as word, xxhash64(if(i > 0, w[i-1], ''), x, if(i + 1 < size(w), w[i+1], '')) as context))")).alias("at"))
    contexts = rows.select("toxic", "at.word", "at.context").groupBy("word", "context").agg(F.min("toxic").alias("only"))
    by_word = contexts.groupBy("word").agg(F.sum("only").alias("hot"), F.count("*").alias("n"))

    def chosen(counted: DataFrame, least: int, share: float) -> list:
        good = (F.col("hot") >= least) & (F.col("hot") >= share * F.col("n")) & (F.length("word") >= 3)
        return counted.where(good).orderBy(F.desc("hot"), "word").collect()  # of a bounded number of rows

    lengths = F.array(*map(F.lit, STEM_LENGTHS))
    stems = by_word.select(F.explode(F.filter(lengths, lambda k: k < F.length("word"))).alias("k"), "word", "hot", "n").select(F.expr("substring(word, 1, k)").alias("word"), "hot", "n")
    stems = chosen(stems.groupBy("word").agg(F.sum("hot").alias("hot"), F.sum("n").alias("n"), F.max("hot").alias("most")).where("most <= 0.5 * hot"), MIN_STEM_CONTEXTS, MIN_STEM_SHARE)
    kept: list[str] = []
    for r in sorted(stems, key=lambda r: (3 * (r.n - r.hot) - r.hot, r.word)):  # the stem with the best balance of its chain
        if not any(r.word.startswith(k) or k.startswith(r.word) for k in kept):
            kept.append(r.word)
    strong = [r.word for r in chosen(by_word, MIN_CONTEXTS, MIN_SHARE) if not any(r.word.startswith(k) and r.word != k for k in kept)]
    return strong, kept


class ToxicityModel:
    def __init__(self, lexicon: list[str], stems: list[str], weights: Logistic):
        self.symbol, self.weights = Symbols(lexicon, stems), weights

    def counts(self, docs: DataFrame, *more: str) -> DataFrame:
        symbol = self.symbol

        def kernel(rows, data, borders):
            return [rows.column(0), list(_counts(data, borders, symbol)), *(rows.column(2 + i) for i in range(len(more)))]

        return map_blocks(texts_of(docs, *more), kernel, "doc_id long, kinds array<double>" + "".join(f", {c} int" for c in more))

    def score(self, docs: DataFrame) -> DataFrame:
        symbol, weights = self.symbol, self.weights

        def kernel(rows, data, borders):
            return [rows.column(0), *scores(data, borders, symbol, weights)]

        return map_blocks(texts_of(docs), kernel, "doc_id long, score double, n_readings long")


def train(rows: DataFrame) -> ToxicityModel:
    """From the columns doc_id, text and toxic (0 or 1)."""
    rows = hashed_sample(texts_of(rows, F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and text is not null"), TRAIN_ROWS)
    start = Logistic(np.zeros(len(KINDS)), np.ones(len(KINDS)), np.array([START_INTERCEPT, *START]))
    if rows.agg(F.count_distinct("toxic").alias("n")).first().n < 2:  # words of one kind of rows say nothing about the other
        return ToxicityModel([], [], start)
    model = ToxicityModel(*learn_lexicon(rows), start)
    seen = model.counts(rows, "toxic").toPandas().sort_values("doc_id")
    if len(seen):
        x = np.log1p(np.stack(seen.kinds.to_numpy()))
        model.weights = fit_logistic(x, seen.toxic.to_numpy(np.float64), ridge=0.5, prior=start.weights, standardise=False)
    return model


def labelled(spark, sf_dir: str, docs: DataFrame) -> DataFrame:
    """Rows from which toxicity may be learned."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~in_fold(F.col("doc_id"), 4, 2))
    return labelled_rows(docs, labels, "toxic", TRAIN_ROWS)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = in_fold(F.col("doc_id"), 4, 2)
    scored = train(labelled(spark, sf_dir, docs)).score(docs)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "n_readings")

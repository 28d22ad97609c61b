"""Toxicity by weighted finite-state transducers over clauses.

Words are read as symbols: insult (learned terms with weights), threat (verbs and their inflected forms), target, negation, report, other.
Small transducers are composed into one that reads a clause from the left and one that reads it from the right: the target transducers raise an insult
that follows or precedes a person, the threat transducer needs a threat verb and then a target, negation lowers what it governs, and
reported speech lowers its whole clause, on whichever side the report stands. An insult that meets no person counts for less. An arc's weight follows from both states and
the symbol between them; a clause scores the sum of its arcs; documents add up their clauses, and a logistic curve makes it a probability.
Terms, the weights of the arcs and the curve are fitted to labelled rows; an arc that these say nothing about keeps the weight that it is given here. Equal texts score equally, whatever their length, and repeated words count each time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from drivespan.llm.knn_quality import one_each
from drivespan.llm.shared import coded, free, slices, word_lists

#: The classifier's bounds: labelled rows of each class, and learned terms.
SAMPLE_ROWS, MOST_TERMS = 3000, 2000
#: A term is learned from so many toxic documents at least, and so clear a difference (natural log of odds).
LEAST_DOCS, LEAST_ODDS = 4, 3.0
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.7

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Fixed word lists: common words of four languages for each symbol.
SYMBOLS = {
    THREAT: "kill hurt destroy beat punish burn smash töten schlagen zerstören vernichten tuer frapper détruire brûler matar golpear destruir quemar".split(),
    TARGET: "you your yourself u ur they them he she him her du dich dir euch ihr sie tu toi vous te ils elle tú ti usted ustedes él ella ellos".split(),
    NEGATION: "not never no don't isn't aren't won't nicht kein keine nie pas jamais ne nunca jamás".split(),
    REPORT: "said says wrote writes quoted called claims reported sagte schrieb behauptet dit écrit affirme dijo escribió dice".split(),
}
#: Fixed word list: insults whose weight is PRIOR where labels say nothing about them.
INSULTS = "idiot moron loser scum imbecile trottel dummkopf abschaum arschloch imbécile crétin connard idiota imbécil cabrón gilipollas".split()
PRIOR = 3.0
#: What the weights of the transducers' arcs are made of, before labelled rows move them.
TARGET_GAIN, ALONE, THREAT_WEIGHT, NEGATION_LOSS, REPORT_LOSS = 1.5, 0.8, 3.0, 0.4, 0.6
#: Words that a target, threat or negation reaches; a report reaches over its clause.
REACH = 3
#: Endings of infinitives; a threat verb is also met with up to INFLECTED other letters after its stem of four letters or more.
ENDINGS, INFLECTED = ("en", "er", "ar", "ir", "re"), 3


def _machine(kind: int, reach: int = REACH) -> np.ndarray:
    """A transducer that goes to state `reach` on a symbol of the kind and counts down on every other one; state > 0 is in reach. Row: state, column: symbol, value: next state."""
    table = np.maximum(np.arange(reach + 1)[:, None] - 1, 0).repeat(6, axis=1)
    table[:, kind] = reach
    return table


#: The transducers that read from the left and from the right; 0 as reach means to the clause's end.
FORWARD, BACKWARD = ((TARGET, REACH), (THREAT, REACH), (NEGATION, REACH), (REPORT, 0)), ((TARGET, REACH), (REPORT, 0))


def _product(kinds: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The product of transducers: next states by state and symbol, and for each state which of the transducers are in reach."""
    parts = [_machine(k, r) if r else np.maximum(np.arange(2)[:, None], (np.arange(6) == k)[None, :]).astype(int) for k, r in kinds]
    shape = tuple(len(p) for p in parts)
    state = np.stack(np.unravel_index(np.arange(int(np.prod(shape))), shape), axis=1)
    step = np.stack([np.ravel_multi_index([p[state[:, i], symbol] for i, p in enumerate(parts)], shape) for symbol in range(6)], axis=1)
    return step, state > 0


def _composed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both products' next states, and for each left state, symbol and right state the kind of arc: 0 to 7 for an insult (4 beside a target, 2 negated, 1 reported), 8 to 11 for a target behind a threat (2 negated, 1 reported), else -1."""
    (left, l), (right, r) = _product(FORWARD), _product(BACKWARD)
    out = np.full((len(left), 6, len(right)), -1)
    tamed = 2 * l[:, None, 2] + 1 * (l[:, None, 3] | r[None, :, 1])
    out[:, INSULT] = 4 * (l[:, None, 0] | r[None, :, 0]) + tamed
    out[:, TARGET] = np.where(l[:, None, 1], 8 + tamed, -1)
    return left, right, out


LEFT, RIGHT, OUT = (x.tolist() for x in _composed())
_TAMED = [1.0, REPORT_LOSS, NEGATION_LOSS, NEGATION_LOSS * REPORT_LOSS]
#: An arc's weight by its kind: a factor of the insult's weight, or what a threat adds.
ARCS = np.array([w * t for w in (ALONE, TARGET_GAIN, THREAT_WEIGHT) for t in _TAMED])
#: What a labelled row's likelihood must gain for an arc to move, and how far it may.
ARC_PENALTY, ARC_STEPS = 2.0, (1.0, 0.0, 0.25, 0.5, 2.0)


def clause_arcs(symbols: list[int], weights: list[float]) -> list[tuple[int, float]]:
    """The arcs that the composed transducers take through one clause, as (kind, weight of the insult or 1)."""
    after, state = [0] * len(symbols), 0
    for i in range(len(symbols) - 1, 0, -1):
        after[i - 1] = state = RIGHT[state][symbols[i]]
    state, taken = 0, []
    for s, w, b in zip(symbols, weights, after, strict=True):
        kind = OUT[state][s][b]
        if kind >= 0:
            taken.append((kind, w if s == INSULT else 1.0))
        state = LEFT[state][s]
    return taken


def clause_score(symbols: list[int], weights: list[float], arcs: np.ndarray = ARCS) -> float:
    """What the composed transducers give for one clause."""
    return float(sum(arcs[k] * w for k, w in clause_arcs(symbols, weights)))


def _bare(word: str) -> str:
    return word.strip(".,;:!?\"'()[]")


def terms_of(word: str) -> list[str]:
    """The word itself and its beginnings, as learnable terms."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


class Grammar:
    def __init__(self, terms: dict[str, float], curve: tuple[float, float] = (0.0, 1.0), arcs: np.ndarray = ARCS):
        self.terms, self.curve, self.arcs = terms, curve, arcs
        self.fixed = {w: k for k, words in SYMBOLS.items() for w in words}
        bare = (w[:-2] if w.endswith(ENDINGS) and len(w) > 5 else w for w in SYMBOLS[THREAT])
        self.stems = {w for w in bare if len(w) >= 4}

    def _threat(self, bare: str) -> bool:
        return any(bare[:k] in self.stems for k in range(max(4, len(bare) - INFLECTED), len(bare) + 1))

    def symbol(self, word: str) -> tuple[int, float]:
        bare = _bare(word)
        weight = max((self.terms[t] for t in terms_of(bare) if t in self.terms), default=0.0) if bare else 0.0
        if weight:
            return INSULT, weight
        found = self.fixed.get(bare, OTHER)
        return THREAT if found == OTHER and self._threat(bare) else found, 0.0

    def sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text's sum over its clauses, and its number of matched clauses."""
        by_arc, hits = self.arc_sums(texts)
        return by_arc @ self.arcs, hits

    def arc_sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text's weights by kind of arc, and its number of clauses with any. A clause ends at . ! ? ; : or a line break."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " . ")
        words, counts = word_lists(texts)
        kinds, at = coded(words)
        read = [self.symbol(w) for w in kinds]
        symbol = np.fromiter((s for s, _ in read), np.int8, len(read))[at]
        weight = np.fromiter((w for _, w in read), float, len(read))[at]
        ends = np.fromiter((w[-1] in ".!?;:" for w in kinds), bool, len(kinds))[at]
        doc = np.repeat(np.arange(len(counts)), counts)
        total, hits = np.zeros((len(counts), len(ARCS))), np.zeros(len(counts), np.int64)
        if not len(at):
            return total, hits
        new = np.ones(len(at), bool)
        new[1:] = ends[:-1] | (doc[1:] != doc[:-1])
        clause = np.cumsum(new) - 1
        first = np.append(np.flatnonzero(new), len(at))
        for c in np.unique(clause[(symbol == INSULT) | (symbol == THREAT)]).tolist():  # no other clause can score
            a, b = first[c], first[c + 1]
            taken = clause_arcs(symbol[a:b].tolist(), weight[a:b].tolist())
            for kind, w in taken:
                total[doc[a], kind] += w
            hits[doc[a]] += bool(taken)
        return total, hits

    def scores(self, texts: pa.Array) -> np.ndarray:
        a, b = self.curve
        total, _ = self.sums(texts)
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(total), -30, 30)))


def _logistic(total: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Intercept and slope of the logistic curve over log(1 + sum), by Newton steps with a little shrinkage, and what is lost of the likelihood (natural log)."""
    x = np.stack([np.ones(len(total)), np.log1p(total)], axis=1)
    w = np.array([-2.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.1 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def _curve(total: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """The curve of _logistic(), moved to the prior share of label 1."""
    w, _ = _logistic(total, y)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    shift = math.log(prior / (1 - prior)) - math.log(share / (1 - share))
    return float(w[0] + shift), float(w[1])


def _fitted_arcs(by_arc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the arcs that at least LEAST_DOCS rows take, each moved by the one of ARC_STEPS that makes the labels likeliest, twice through all; a move must gain ARC_PENALTY."""
    arcs, steps = ARCS.copy(), np.ones(len(ARCS))
    known = [k for k in range(len(ARCS)) if (by_arc[:, k] > 0).sum() >= LEAST_DOCS]
    for _ in range(2):
        for k in known:
            lost = []
            for f in ARC_STEPS:
                arcs[k] = ARCS[k] * f
                lost.append(_logistic(by_arc @ arcs, y)[1] + ARC_PENALTY * (f != 1.0))
            steps[k] = ARC_STEPS[int(np.argmin(np.round(lost, 6)))]
            arcs[k] = ARCS[k] * steps[k]
    return arcs


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: str = "pmod(crc32(cast(doc_id as string)), 3) = 1", rows: int = SAMPLE_ROWS) -> Grammar:
    """Learns the insult terms, the weights of the arcs and the curve from at most `rows` documents of each class, those of least hash of their id. Without labels of both classes nothing is toxic."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).filter(f"not ({held_out})").groupBy("doc_id").agg(F.max(label).alias("y"))
    n = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return Grammar({}, (-5.0, 0.0))
    each = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    picked = one_each(docs, each[0].unionByName(each[1]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of each class that hold a term."""
        found = {0: Counter(), 1: Counter()}
        for batch in batches:
            for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                found[y].update({x for w in set((t or "").lower().split()) if (b := _bare(w)) for x in terms_of(b)})
        for y, c in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array([v * (y == 1) for v in c.values()], pa.int64()), pa.array([v * (y == 0) for v in c.values()], pa.int64())], ["term", "toxic", "clean"])

    got = {y: min(v, rows) for y, v in n.items()}
    odds = F.log(F.expr(f"(toxic + 0.5) / ({got[1]} - toxic + 0.5)")) - F.log(F.expr(f"(clean + 0.5) / ({got[0]} - clean + 0.5)"))
    terms = picked.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    best = terms.filter(f"toxic >= {LEAST_DOCS}").withColumn("odds", odds).filter(f"odds >= {LEAST_ODDS} and clean <= 0.02 * toxic").orderBy(F.desc(F.col("odds") * F.log("toxic")), "term").limit(MOST_TERMS).collect()
    grammar = Grammar(dict.fromkeys(INSULTS, PRIOR) | {r.term: float(r.odds) for r in best})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                by_arc, _ = grammar.arc_sums(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(by_arc.tolist(), pa.list_(pa.float64())), part.column("y")], ["by_arc", "y"])

    seen = picked.mapInArrow(total, "by_arc array<double>, y int").collect()
    x, y = np.array([r.by_arc for r in seen]).reshape(-1, len(ARCS)), np.array([r.y for r in seen], float)
    if not len(y) or y.min() == y.max():
        return Grammar({}, (-5.0, 0.0))
    order = np.lexsort((y, *x.T))
    x, y = x[order], y[order]
    grammar.arcs = _fitted_arcs(x, y)
    grammar.curve = _curve(x @ grammar.arcs, y, n[1] / (n[0] + n[1]))
    return grammar


def score(docs: DataFrame, grammar: Grammar, score_col: str = "score") -> DataFrame:
    """docs with score_col (double, 0 to 1) and matched_clauses (long). Null texts are empty texts; columns of those names are replaced, all others stay."""
    rest = [c for c in docs.columns if c not in (score_col, "matched_clauses")]
    (text,) = free(rest, "text_read")
    kept = docs.select(*(F.col(f"`{c}`") for c in rest), F.col("text").cast("string").alias(text))
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                g = shared.value
                total, hits = g.sums(part.column(text))
                p = 1 / (1 + np.exp(-np.clip(g.curve[0] + g.curve[1] * np.log1p(total), -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(p), pa.array(hits)], [*rest, score_col, "matched_clauses"])

    return kept.mapInArrow(run, docs.select(*rest).withColumns({score_col: F.lit(0.5), "matched_clauses": F.lit(0).cast("long")}).schema)

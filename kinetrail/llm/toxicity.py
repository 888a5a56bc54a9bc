"""Toxicity by a weighted finite-state pattern grammar over clauses.

Small weighted transducers are composed into one machine.  A lexical one reads
a word as its class (insult, threat, target, negation, reporting verb, coded
word) with the weight of the word's arc; scope machines remember negation and
reported speech and take weight off what stands in their scope; a scorer adds
weight for insults aimed at somebody and for threats with a target.  Weights
add up along arcs and in composition, so a clause's score is the weight of its
path.  A document's score is a logistic function of the weights of its
clauses: their sum, the largest, and the sum per word; nothing else of the
document enters it.

What is learned from labels enters as weighted arcs: words that stand in many
different contexts, nearly all in toxic documents, stems that recur within
toxic documents but hardly within others, and the built-in insults' weights
where the sample shows that they are common in clean documents.  Copies of a
document count once there.  A word that repeats the clause's last hit weighs
nothing more.

Clauses run from end mark to end mark, however long; only those with a hit of
a multi-pattern matcher are read word by word.  The fit reads labelled rows in
the order of a hash of the id, at most ``FIT_ROWS`` rows and ``FIT_CHARS``
characters in all, whole texts (a row that no longer fits is passed over).

Defined cases: null text is empty; without labels of both kinds built-in
weights are used; null labels are skipped, and so is an id labelled both ways;
an id that repeats in the documents counts once in the fit (its smallest text)
and each of its rows is scored; equal texts have equal scores, so nothing is
decided by ties; empty tables give no rows; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import within_budget
from .quality import sample_labelled

FIT_ROWS = 6000
#: Characters of the sample's texts in all, which the driver holds.
FIT_CHARS = 40_000_000

INSULT, THREAT, TARGET, NEGATION, REPORT, CODED = "ITYNRC"
LEXICON = {
    INSULT: """idiot idiots moron morons stupid loser losers scum trash garbage filth filthy clown clowns pathetic worthless
        disgusting vermin imbecile imbeciles dumb dimwit fool fools foolish parasite parasites pig pigs swine retard coward
        cowards creep jerk liar liars ugly useless subhuman degenerate bastard bastards
        dumm dummkopf trottel abschaum versager idioten widerlich ekelhaft wertlos drecksack schwachkopf schweine nichtsnutz
        imbécile crétin débile abruti connard ordure minable dégoûtant salaud stupide idiote idiots
        idiota idiotas imbécil estúpido estúpida basura escoria patético asqueroso inútil payaso cabrón""".split(),
    THREAT: """kill murder destroy hurt stab shoot strangle beat burn hang crush attack
        töten umbringen ermorden vernichten erschießen verprügeln tuer massacrer détruire étrangler frapper brûler
        matar asesinar destruir golpear quemar ahorcar""".split(),
    TARGET: """you your yours youre he she they them him her his their these those people
        du dich dir ihr euch sie ihn ihnen tu toi te vous vos ton ta il elle ils elles leur
        tú usted ustedes vosotros él ella ellos ellas""".split(),
    NEGATION: "not no never dont doesnt isnt arent wasnt werent wont nicht kein keine nie niemals pas jamais aucun nunca jamás".split(),
    REPORT: """said says told called calls wrote writes claimed reported quoted shouted sagte sagt nannte schrieb behauptete
        dit disait appelle écrit affirme dijo dice llamó escribió""".split(),
}
#: Weights of arcs: a built-in insult, a threat with a target, an insult behind a target, what negation and reporting take off.
WORD, HARM, AIMED, DENIED, REPORTED = 3.0, 3.0, 1.0, -2.5, -2.5
#: Of the log sum of a document's clause weights, their log maximum, the log of a hundredfold of their sum a word, and of 1.
_DEFAULT = np.array([1.5, 1.0, 1.0, -3.0])

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_ENDS = ".!?;:\n"
_END = re.compile(f"[{_ENDS}]")


class Transducer:
    """``arcs[state][symbol] -> (state, output, weight)``; a missing symbol stays, emits nothing and weighs nothing."""

    def __init__(self, arcs: dict, start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol):
        return self.arcs.get(state, {}).get(symbol, (state, None, 0.0))

    def compose(self, other: Transducer, symbols, final: bool = False) -> Transducer:
        """This machine, then *other* on what this one emits (or the symbol itself where it emits nothing); weights add.

        What *other* does not rewrite passes through, unless it is *final*.
        """
        start, arcs = (self.start, other.start), {}
        todo = [start]
        while todo:
            state = todo.pop()
            if state in arcs:
                continue
            arcs[state] = {}
            for symbol in symbols:
                s, out, w = self.step(state[0], symbol)
                t, said, v = other.step(state[1], out or symbol)
                arcs[state][symbol] = (s, t), said if final else said or out, w + v
                todo.append((s, t))
        return Transducer(arcs, start)


def clause_machine() -> Transducer:
    """Negation and reporting scopes composed with the target-insult-threat scorer."""
    # A negation colours the first insult or threat behind it within the clause, a reporting verb all of them.
    negate = Transducer({0: {NEGATION: (1, None, 0.0)}, 1: {INSULT: (0, "I-", DENIED), THREAT: (0, "T-", DENIED), CODED: (0, "I-", DENIED), NEGATION: (0, None, 0.0)}})
    report = Transducer({0: {REPORT: (1, None, 0.0)}, 1: {INSULT: (1, "I~", REPORTED), THREAT: (1, "T~", REPORTED), CODED: (1, "I~", REPORTED)}})
    # 1: a target came; 2: a threat that waits for one, for a threat needs a target on either side.
    score = {0: {TARGET: (1, None, 0.0), THREAT: (2, None, 0.0)}, 1: {THREAT: (1, "threat", HARM)}, 2: {TARGET: (1, "threat", HARM)}}
    for state in score:
        plain = ("aimed", AIMED) if state == 1 else ("bare", 0.0)
        score[state] |= {INSULT: (state, *plain), CODED: (state, "coded", 0.0), "I-": (state, "denied", 0.0), "I~": (state, "reported", 0.0), "T-": (state, "threat_denied", HARM), "T~": (state, "reported", HARM)}
    symbols = (*LEXICON, CODED)
    return report.compose(negate, symbols).compose(Transducer(score), symbols, final=True)


@dataclass
class ToxicityModel:
    """``learned`` and ``stems`` give the weights of words' and stems' arcs, ``weights`` those of the document's score."""

    weights: np.ndarray = field(default_factory=lambda: _DEFAULT.copy())
    learned: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self._ready = None

    def __getstate__(self):
        return {"weights": self.weights, "learned": self.learned, "stems": self.stems, "_ready": None}

    def ready(self):
        """Matcher, lexical arcs (class, weight) and machine, built once a process."""
        if self._ready is None:
            import ahocorasick

            of: dict[str, tuple[str, float]] = {}
            for kind in (REPORT, TARGET, NEGATION, THREAT, INSULT):
                of.update(dict.fromkeys(LEXICON[kind], (kind, WORD if kind == INSULT else 0.0)))
            of.update((w, (INSULT, weight)) for w, weight in self.learned.items())
            matcher = ahocorasick.Automaton()
            for word, (kind, _) in of.items():
                if kind in (INSULT, THREAT):
                    matcher.add_word(word, len(word))
            for stem in self.stems:
                matcher.add_word(stem, len(stem))
            matcher.make_automaton()
            self._ready = matcher, of, clause_machine()
        return self._ready

    def lexical(self, word: str) -> tuple[str, float] | None:
        """(class, weight) of a lower-case word's arc."""
        if arc := self.ready()[1].get(word.replace("'", "").replace("’", "")):
            return arc
        return next(((CODED, self.stems[word[:n]]) for n in range(3, min(8, len(word)) + 1) if word[:n] in self.stems), None)

    def clauses(self, text: str) -> list[tuple[str, list[str]]]:
        """(clause, outcomes) of each clause that the grammar matches."""
        return [(text.lower()[a:b], [said for said, _ in outcomes]) for a, b, _, outcomes in self.paths(text)]

    def paths(self, text: str) -> list[tuple[int, int, float, list[tuple[str, str]]]]:
        """(begin, end, weight of the path, (outcome, word that brought it about)) of each clause that the grammar matches."""
        matcher, _, machine = self.ready()
        low, found, done, stems = text.lower(), [], -1, self.stems
        for last, n in matcher.iter(low):
            first = last + 1 - n
            if first < done or first and low[first - 1].isalpha():
                continue
            if last + 1 < len(low) and low[last + 1].isalpha() and low[first : last + 1] not in stems:
                continue
            # From end mark to end mark, however far apart: what is searched here is not searched again.
            begin = max(max(0, done), *(low.rfind(mark, max(0, done), first) + 1 for mark in _ENDS))
            end = _END.search(low, last)
            done = end.start() if end else len(low)
            state, weight, hit, outcomes = machine.start, 0.0, None, []
            for m in _WORD.finditer(low, begin, done):
                if arc := self.lexical(m[0]):
                    state, said, w = machine.step(state, arc[0])
                    if said:
                        outcomes.append((said, m[0]))
                        weight += 0.0 if m[0] == hit else arc[1] + w
                        hit = m[0]
            if outcomes:
                found.append((begin, done, weight, outcomes))
        return found

    def features(self, text: str) -> np.ndarray:
        weights = [max(0.0, w) for _, _, w, _ in self.paths(text)]
        total = sum(weights)
        return np.log1p([total, max(weights, default=0.0), 100 * total / (text.count(" ") + 50), np.e - 1])

    def score(self, texts) -> np.ndarray:
        x = np.array([self.features(t or "") for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _arc_weight(odds: float) -> float:
    """Half the log odds, at most a built-in insult's weight."""
    return float(min(WORD, max(0.0, np.log(odds) / 2)))


def _contexts(texts: list[str], toxic: list[float], least: int, found) -> list[tuple[str, int, float]]:
    """(item, contexts in toxic texts, odds) of items with enough contexts in toxic texts.

    ``found(words, wanted)`` gives (item, place) pairs of a text; others than
    toxic texts are searched for the items that came up in those alone.
    """
    seen: list[dict] = [defaultdict(set), defaultdict(set)]
    wanted = None
    for kind in (1, 0):
        for text, label in zip(texts, toxic):
            if int(label) == kind:
                words = _WORD.findall(text.lower())
                for item, i in found(words, wanted):
                    seen[kind][item].add(crc32(" ".join(words[max(0, i - 1) : i + 2]).encode()))
        wanted = {x for x, c in seen[1].items() if len(c) >= least}
    n = [max(1, toxic.count(k)) for k in (0.0, 1.0)]
    return [(x, len(seen[1][x]), len(seen[1][x]) / n[1] / ((len(seen[0].get(x, ())) + 0.5) / n[0])) for x in sorted(wanted)]


def learn_stems(texts: list[str], toxic: list[float], least: int = 8, odds: float = 20.0) -> dict[str, float]:
    """Weights of word beginnings of 3 to 8 letters that recur in at least *least* unlike toxic texts, *odds* times as often as in others.

    Texts in which a beginning first stands between the same words count once, so that copies do.
    """

    def recurring(words, wanted):
        first: dict[str, int] = {}
        twice: dict[str, int] = {}
        for i, word in enumerate(words):
            for n in range(3, min(8, len(word)) + 1):
                p = word[:n]
                if wanted is None or p in wanted:
                    if p in first:
                        twice.setdefault(p, first[p])
                    else:
                        first[p] = i
        return twice.items()

    found = [(c, len(p), p, o) for p, c, o in _contexts(texts, toxic, least, recurring) if o >= odds]
    longer = {p[:k]: max(c for c, _, q, _ in found if q.startswith(p[:k]) and len(q) > k) for _, n, p, _ in found for k in range(3, n)}
    found = [x for x in found if longer.get(x[2], 0) < 0.75 * x[0]]  # the longer of two nested beginnings, unless it loses much
    kept: dict[str, float] = {}
    for _, _, p, o in sorted(found, key=lambda x: (-x[0], -x[1], x[2])):
        if not any(p.startswith(k) or k.startswith(p) for k in kept):
            kept[p] = _arc_weight(o)
    return kept


def learn_words(texts: list[str], toxic: list[float], stems=(), least: int = 12, odds: float = 40.0) -> dict[str, float]:
    """Weights of words with at least *least* distinct contexts in toxic texts, *odds* times as frequent there as in others."""

    def places(words, wanted):
        return [(w, i) for i, w in enumerate(words) if len(w) > 2 and (wanted is None or w in wanted)]

    stems = tuple(stems)
    return {w: _arc_weight(o) for w, _, o in _contexts(texts, toxic, least, places) if o >= odds and not (stems and w.startswith(stems))}


def learn_insults(texts: list[str], toxic: list[float], least: int = 5) -> dict[str, float]:
    """Smaller weights for built-in insults that at least *least* clean texts hold and that are not much commoner in toxic ones."""
    held: tuple[Counter, Counter] = Counter(), Counter()
    known = set(LEXICON[INSULT])
    for text, label in zip(texts, toxic):
        held[int(label)].update(known.intersection(_WORD.findall(text.lower())))
    n = [max(1, toxic.count(k)) for k in (0.0, 1.0)]
    weight = {w: _arc_weight((held[1][w] + 0.5) / n[1] / (c / n[0])) for w, c in held[0].items() if c >= least}
    return {w: x for w, x in weight.items() if x < WORD}


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> ToxicityModel:
    sample = sample_labelled(docs, labels, label_col, rows).groupBy("__key", "label").agg(F.min("text").alias("text")).orderBy(F.xxhash64("__key"), "__key")
    texts, y = [], []
    for r in within_budget(sample.toLocalIterator(), lambda r: len(r.text), chars):
        texts.append(r.text)
        y.append(r.label)
    if len(set(y)) < 2:
        return ToxicityModel()
    stems = learn_stems(texts, y)
    model = ToxicityModel(learned=learn_insults(texts, y) | learn_words(texts, y, stems), stems=stems)
    x, label = np.array([model.features(t) for t in texts]), np.array(y)
    w, prior = np.zeros(x.shape[1]), _DEFAULT
    for _ in range(100):  # Newton steps; the prior holds what the sample does not settle
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (label - p) - 0.3 * (w - prior))
        w = w + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    return model

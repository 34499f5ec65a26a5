"""Toxicity scores from a lexicon, read by a Levenshtein automaton, and the context of each hit.

1. Lexicon: from a bounded sample of labelled training rows, terms (whole words, and word beginnings for terms that
   are inflected) that toxic texts hold and clean texts lack, more often than chance explains.
2. Automaton: the terms form a trie; the Levenshtein automata of all terms, intersected with it, are made one
   deterministic automaton (subset construction).  It tells exact words, misspelled ones (one edit, for terms of
   ``FUZZY_LENGTH`` letters or more) and beginnings apart, for all distinct words of a batch at once.
3. Context: around every hit a window of words is looked at: a hit between quotation marks or behind a word of
   reporting counts as quoted; the number of hits in the window tells abuse from a stray word.
4. A logistic regression over the counts gives the score.

Labels reach the fit only; a text's score depends on its text alone.

Defined results: a null or empty text gets the score of a text without hits; no labelled rows give an empty lexicon
and the score 0; a null id is never in the training set and not held out; equal rows get equal scores; labels that
repeat count once, as toxic if any row says so; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwise.llm.common import Words, crc32_of_id, materialize, slices

#: Rows of the labelled sample, by label, from which terms are learned; rows for the regression.
TOXIC_SAMPLE, CLEAN_SAMPLE, FIT_SAMPLE = 3_000, 9_000, 40_000
#: A term stands in so many toxic texts, at least; of the texts with it, this share is toxic.
SUPPORT, PRECISION = 4, 0.98
#: Chance that any term of the lexicon is there by accident.
CHANCE = 0.02
FUZZY_LENGTH, PREFIX_LENGTHS = 5, (4, 5, 6)
WINDOW = 6
QUOTES = "\"“”„«»‘’‹›"
#: Words of reporting before a quotation.
REPORTING = frozenset("said says wrote writes called calls quoted quote sagte schrieb nannte dit disait écrit dijo escribió".split())
EXACT, BEGIN, FUZZY = 1, 2, 3
FEATURES = ["any", "exact", "begin", "fuzzy", "quoted", "dense"]

_EDGES = re.compile(r"^[^\w]+|[^\w]+$")


def normal(word: str) -> str:
    return _EDGES.sub("", word.lower())


# --- lexicon -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Lexicon:
    words: tuple[str, ...]
    beginnings: tuple[str, ...]


def unlike(texts: list[list[str]], most: float = 0.5, rare: int = 25) -> list[list[str]]:
    """The texts without those that share more than ``most`` of their rarer words with an earlier one."""
    df = Counter(w for words in texts for w in words)
    holders: dict[str, list[int]] = defaultdict(list)
    kept: list[list[str]] = []
    for words in texts:
        few = [w for w in words if 1 < df[w] <= rare]
        shared = Counter(i for w in few for i in holders[w])
        if shared and max(shared.values()) > most * max(4, len([w for w in words if df[w] <= rare])):
            continue
        for w in few:
            holders[w].append(len(kept))
        kept.append(words)
    return kept


def learn_terms(toxic: list[list[str]], clean: list[list[str]], support: int = SUPPORT, precision: float = PRECISION, chance: float = CHANCE) -> Lexicon:
    """Terms that toxic texts (lists of distinct words) hold and clean ones lack, more often than chance explains.

    Near copies count once.  A word's evidence is the number of its texts, a beginning's also that of its words; with a
    share s of toxic texts, evidence k without counter-evidence has the chance s**k, times the number of terms tried.
    """
    toxic, clean = unlike(toxic), unlike(clean)
    if not toxic:
        return Lexicon((), ())
    share = len(toxic) / (len(toxic) + len(clean))
    against = Counter(w for words in clean for w in words)
    for_ = Counter(w for words in toxic for w in words)
    begins_against = Counter(b for words in clean for b in {w[:k] for w in words for k in PREFIX_LENGTHS if len(w) > k})
    begins: dict[str, set[str]] = defaultdict(set)
    begin_texts: Counter[str] = Counter()
    for words in toxic:
        held = defaultdict(set)
        for w in words:
            for k in PREFIX_LENGTHS:
                if len(w) > k:
                    held[w[:k]].add(w)
        begin_texts.update(list(held))
        for b, ws in held.items():
            begins[b] |= ws

    def significant(evidence: int, tried: int) -> bool:
        return share < 1 and evidence * np.log(share) + np.log(max(1, tried)) < np.log(chance)

    def pure(n: int, other: int) -> bool:
        return n >= precision * (n + other)

    tried = sum(n >= support for n in for_.values()) + sum(n >= 3 for n in begin_texts.values())
    found = {b for b, n in begin_texts.items() if n >= 3 and len(begins[b]) >= 3 and pure(n, begins_against[b]) and significant(max(n, len(begins[b])), tried)}
    # of beginnings of about the same words the longest; none that a shorter one stands for
    found -= {b for b in found for longer in found if longer != b and longer.startswith(b) and len(begins[longer]) >= 0.9 * len(begins[b])}
    found -= {b for b in found if any(b != shorter and b.startswith(shorter) for shorter in found)}
    words = {w for w, n in for_.items() if n >= support and len(w) > 2 and pure(n, against[w]) and significant(n, tried)}
    words -= {w for w in words if any(len(w) > len(b) and w.startswith(b) for b in found)}
    return Lexicon(tuple(sorted(words)), tuple(sorted(found)))


# --- automaton ---------------------------------------------------------------------------------------------------


class Automaton:
    """A deterministic automaton over character classes; state 0 is dead, state 1 the start."""

    def __init__(self, lexicon: Lexicon, fuzzy_length: int = FUZZY_LENGTH):
        children: list[dict[str, int]] = [{}]
        word_at: dict[int, int] = {}
        begin_at: set[int] = set()
        for terms, begin in ((lexicon.words, False), (lexicon.beginnings, True)):
            for term in terms:
                node = 0
                for ch in term:
                    if ch not in children[node]:
                        children.append({})
                        children[node][ch] = len(children) - 1
                    node = children[node][ch]
                if begin:
                    begin_at.add(node)
                else:
                    word_at[node] = len(term)
        letters = sorted({ch for c in children for ch in c})
        self.classes = {ch: i + 1 for i, ch in enumerate(letters)}  # 0: any other character
        # nodes from which a word that may be misspelled is still ahead
        ahead = [False] * len(children)
        for node in range(len(children) - 1, -1, -1):
            ahead[node] = word_at.get(node, 0) >= fuzzy_length or any(ahead[c] for c in children[node].values())

        def closed(states: set[tuple[int, int]]) -> frozenset:
            """With the letters that a misspelled word may lack."""
            out = set(states)
            for node, edits in states:
                if edits == 0:
                    out.update((c, 1) for c in children[node].values() if ahead[c])
            return frozenset(s for s in out if not (s[1] == 1 and (s[0], 0) in out))

        def verdict(states: frozenset) -> int:
            if "begin" in states:
                return BEGIN
            if any(e == 0 and n in word_at for n, e in states):
                return EXACT
            if any(e == 1 and word_at.get(n, 0) >= fuzzy_length for n, e in states):
                return FUZZY
            return 0

        start = closed({(0, 0)})
        number: dict[frozenset, int] = {frozenset(): 0, start: 1}
        table: list[list[int]] = [[0] * (len(letters) + 1)]
        accept = [0]
        queue = [start]
        done: frozenset = frozenset({"begin"})
        for states in queue:
            row = []
            accept.append(verdict(states))
            for ch in ["", *letters]:
                if states == done:
                    row.append(number[done])
                    continue
                to: set[tuple[int, int]] = set()
                hit = False
                for node, edits in states:
                    child = children[node].get(ch) if ch else None
                    if child is not None:
                        to.add((child, edits))
                        hit |= edits == 0 and child in begin_at
                    if edits == 0:
                        to.update((c, 1) for c in children[node].values() if ahead[c])  # another letter
                        if ahead[node]:
                            to.add((node, 1))  # one letter more
                target = done if hit else closed(to)
                if target not in number:
                    number[target] = len(number)
                    queue.append(target)
                row.append(number[target])
            table.append(row)
        self.table = np.array(table, np.int32)
        self.accept = np.array(accept, np.int8)

    def run(self, words: list[str]) -> np.ndarray:
        """EXACT, BEGIN, FUZZY or 0 for each word."""
        if not words:
            return np.zeros(0, np.int8)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        low = np.zeros(0x250, np.int32)
        for ch, k in self.classes.items():
            if ord(ch) < len(low):
                low[ord(ch)] = k
        symbols = np.where(points < len(low), low[np.minimum(points, len(low) - 1)], 0)
        for ch, k in self.classes.items():
            if ord(ch) >= len(low):
                symbols[points == ord(ch)] = k
        state = np.ones(len(words), np.int32)
        active = np.flatnonzero(lengths > 0)
        step = 0
        while len(active):
            state[active] = self.table[state[active], symbols[starts[active] + step]]
            step += 1
            active = active[(state[active] > 0) & (lengths[active] > step)]
        return self.accept[state]


# --- features ----------------------------------------------------------------------------------------------------


def quoted(words: list[str], i: int, window: int) -> bool:
    """Whether word i stands between quotation marks, or behind a word of reporting and a mark, within the window."""
    before = words[max(0, i - window) : i]
    after = words[i : i + window + 1]
    opening = any(w[:1] in QUOTES for w in before if w) or words[i][:1] in QUOTES
    closing = any(any(q in w[1:] for q in QUOTES) for w in after if len(w) > 1)
    return (opening and closing) or (any(normal(w) in REPORTING for w in before) and (opening or any(w.endswith(":") for w in before)))


def text_features(texts: pa.Array, automaton: Automaton, window: int = WINDOW) -> np.ndarray:
    """One row of FEATURES for each text."""
    w = Words(texts)
    vocabulary = w.vocabulary.to_pylist()
    kind = automaton.run([normal(v) for v in vocabulary])
    hits = np.flatnonzero(kind[w.codes]) if len(vocabulary) else np.zeros(0, np.int64)
    owner = np.searchsorted(w.starts, hits, "right") - 1
    out = np.zeros((len(texts), len(FEATURES)))
    for at, row in zip(hits.tolist(), owner.tolist()):
        a, b = int(w.starts[row]), int(w.starts[row + 1])
        low, high = max(a, at - window), min(b, at + window + 1)
        near = [vocabulary[c] for c in w.codes[low:high].tolist()]
        f = out[row]
        if quoted(near, at - low, window):
            f[4] += 1
            continue
        f[int(kind[w.codes[at]])] += 1
        f[5] = max(f[5], int((kind[w.codes[low:high]] > 0).sum()))
    out[:, 0] = (out[:, 1:3].sum(1) > 0).astype(float)
    out[:, 1:] = np.log1p(out[:, 1:])
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights, the intercept first; Newton's method with a ridge."""
    x = np.concatenate((np.ones((len(x), 1)), x), 1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(1.0, len(x) ** 0.5))
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(crc32_of_id(doc_id) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", train: Column | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; learned where ``train`` (of the labels) holds."""
    train = ~held_out(doc_id) if train is None else train
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).where(train).groupBy(F.col(doc_id).alias("_lid")).agg(F.max(F.col(label)).cast("int").alias("_y"))
    ids = [r for y, n in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE)) for r in known.where(F.col("_y") == y).orderBy(F.xxhash64("_lid"), "_lid").limit(n).collect()]
    spark = docs.sparkSession
    # the sample's ids are bounded, so the texts need no shuffle
    sample = spark.createDataFrame([(int(r[0]), int(r[1])) for r in ids], "_lid long, _y int")
    found = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("_lid")).select("_y", "text")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = Words(batch.column(1))
            names = [normal(v) for v in w.vocabulary.to_pylist()]
            lists = [sorted({names[c] for c in np.unique(w.codes[a:b]).tolist()} - {""}) for a, b in zip(w.starts[:-1], w.starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string()))], ["y", "words"])

    held = found.mapInArrow(distinct_words, "y int, words array<string>").distinct().toArrow() if ids else None
    toxic, clean = ([w for y, w in zip(held.column("y").to_pylist(), held.column("words").to_pylist()) if y == k] if held else [] for k in (1, 0))
    sent = spark.sparkContext.broadcast(vars(Automaton(learn_terms(sorted(toxic), sorted(clean)))))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton.__new__(Automaton)
        vars(automaton).update(sent.value)
        for batch in slices(batches):
            f = text_features(batch.column(1), automaton)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(f.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))], ["doc_id", "f"])

    features = materialize(rows.mapInArrow(extract, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, f array<double>"))
    picked = features.join(known, F.col("doc_id") == F.col("_lid")).select("_y", "f", "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_SAMPLE).select("_y", "f").collect()
    if picked and 0 < sum(r[0] for r in picked) < len(picked):
        weights = fit_logistic(np.array([r[1] for r in picked]), np.array([r[0] for r in picked], float)).tolist()
        z = F.lit(weights[0])
        for k, w in enumerate(weights[1:]):
            z = z + F.lit(w) * F.col("f")[k]
        score = 1.0 / (1.0 + F.exp(-z))
    else:
        score = F.lit(float(bool(picked and picked[0][0])))
    score = F.round(score, 6)
    return features.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


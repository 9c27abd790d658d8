"""Toxicity of restored text: a noisy channel in front of a sparse linear model.

1. A character trigram model counts all texts. Counts add up in each task first; the table has at most 64**3
   cells however large the corpus is.
2. Disguised words are restored: signs and digits used as letters (``1d10t``), letters set apart
   (``i d i o t``, ``i.d.i.o.t``, three or more) and repeated letters (``idiooot``). Each is a lattice of readings, with a cost
   for every sign read, letter dropped and gap closed; Viterbi search takes the reading that the character
   model likes best. Words without such marks are not touched.
3. The restored words and their character 4- to 6-grams are features of a logistic model with an L1 penalty.
   It is fitted on at most ``sample`` different labelled rows (of the folds given), those of least hash. Candidate
   features are the ``candidates`` ones with the strongest association to the label in that sample.

Whole texts are scored. A null or empty text has no features and gets the model's base score. Repeated rows
are scored each. Without labelled rows, or with one label only, every score is the share of toxic rows
(0 if there are none). Language, source and ids are no inputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import row_key, source, table
from .encode import CACHE_ENTRIES

#: Symbols of the character model; place 0 is the gap between words, 63 any other character.
ALPHABET = " abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ"
OTHER = 63
CODE = {c: i for i, c in enumerate(ALPHABET)}
#: Letters that a sign or digit may stand for.
READINGS = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "£": "l",
}
SEPARATORS = ".-_*~·/\\' "
EDGE = "\"'`.,;:!?()[]{}<>*#%&$|~+-_=/\\…«»“”‘’„¡¿"
SIGNS = "".join(map(re.escape, READINGS))
START, END = "\x02", "\x03"
#: What may disguise a word: a sign, a separator before a letter or digit, or a digit; letters set apart.
MARKED = re.compile(rf"[{SIGNS}]|[._*~·\-/\\]\w|\d")
TRIPLE = re.compile(r"(\w)\1\1")
#: Not the s of "that's": letters set apart start after no letter, nor after its apostrophe.
SPACED = re.compile(r"(?<!\w)(?<!\w['’])[^\W_](?:[ ._*~·-]{1,3}[^\W_]){2,}(?!\w|['’]\w)")
#: Numbers are no disguised words, and a character repeated more often than three times says no more than three.
NUMBER = re.compile(r"[\d.,:;/%+\-() $€£|!]*")
LONG = re.compile(r"(.)\1{3,}", re.S)
#: Longer tokens are read anew each time.
KEPT_SIZE = 64
OPENING, CLOSING = "".join(c for c in EDGE if c not in READINGS), ".,;:?\"'`)]}>…«»“”‘’"
#: Signs that are more often punctuation at the ends of a word.
STARTING, ENDING = OPENING + "(|+", CLOSING + "!|+("
#: Costs in nats: reading a sign as a letter, closing a gap, dropping a repeated letter, keeping a raw sign.
READ, CLOSE, DROP, KEEP = -1.0, -0.5, -1.0, -4.0
FEATURE_SIZES = (4, 5, 6)
#: Characters counted at a time; bounds the memory for very long texts.
COUNTED = 1 << 20


def codes(text: str) -> np.ndarray:
    """Symbols of the character model for a lower-case text."""
    raw = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    return _CODES[raw]


_CODES = np.array([CODE.get(chr(i), 0 if chr(i).isspace() else OTHER) for i in range(256)], np.int32)


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``code, n``: how often each three symbols follow each other, over all texts."""

    def run(batches):
        total = np.zeros(1 << 18, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                padded = f"  {(text or '').lower()}  "
                for low in range(0, len(padded) - 2, COUNTED):
                    c = codes(padded[low : low + COUNTED + 2])
                    np.add.at(total, c[:-2] << 12 | c[1:-1] << 6 | c[2:], 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["code", "n"])

    return docs.select(text).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def character_model(counts: pd.DataFrame) -> np.ndarray:
    """Log probabilities of a symbol after two, smoothed by shorter contexts; at most 64**3 of them."""
    n = np.zeros(1 << 18)
    n[counts["code"]] = counts["n"]
    n = n.reshape(64, 64, 64)
    one = n.sum((0, 1)) + 1
    one /= one.sum()
    two = n.sum(0) + 20 * one
    two /= two.sum(1, keepdims=True)
    three = n + 20 * two[None]
    three /= three.sum(2, keepdims=True)
    return np.log(three).astype(np.float32)


def lattice(token: str) -> list[list[tuple[int | None, float, str]]]:
    """For each character its readings: symbol (None: nothing), cost, and what is written."""
    places = []
    for i, c in enumerate(token):
        if c in READINGS:
            options = [(CODE[r], READ, r) for r in READINGS[c]] + [(OTHER, KEEP, c)]
        elif c in SEPARATORS:
            options = [(None, CLOSE, ""), (0, 0.0, " ")]
        else:
            options = [(CODE.get(c, OTHER), 0.0, c)]
            if i and token[i - 1] == c:
                options.append((None, DROP, ""))
        places.append(options)
    return places


def decode(token: str, model: np.ndarray) -> str:
    """The best reading of a lower-case token under the character model."""
    states: dict = {(0, 0): (0.0, None)}  # score, and what is written as a chain from its end
    for options in lattice(token):
        following: dict = {}
        for (a, b), (score, written) in states.items():
            for symbol, cost, out in options:
                if symbol is None:
                    state, value = (a, b), score + cost
                else:
                    state, value = (b, symbol), score + cost + float(model[a, b, symbol])
                if state not in following or value > following[state][0]:
                    following[state] = (value, (written, out))
        states = following
    chain = max(((score + float(model[a, b, 0]), w) for (a, b), (score, w) in states.items()), key=lambda x: x[0])[1]
    parts = []
    while chain is not None:
        chain, out = chain
        parts.append(out)
    return "".join(reversed(parts))


class Restorer:
    """Reads texts: their words as they stand, and disguised ones restored. Readings are kept."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}

    def reading(self, raw: str) -> list[str]:
        raw = LONG.sub(r"\1\1\1", raw)
        if raw in self.known:
            return self.known[raw]
        read = [] if NUMBER.fullmatch(raw) else [w.strip(EDGE) for w in decode(raw, self.model).split()]
        if len(raw) <= KEPT_SIZE:
            if len(self.known) > CACHE_ENTRIES:
                self.known.clear()
            self.known[raw] = read
        return read

    def restored(self, text: str, tokens: set[str]) -> set[str]:
        """Readings of the disguised words of a lower-case text."""
        marks = [pattern for pattern in (MARKED, TRIPLE) if pattern.search(text)]
        found: set[str] = set()
        for token in {t for pattern in marks for t in tokens if pattern.search(t)}:
            word = token.lstrip(OPENING).rstrip(CLOSING)
            # signs at the ends may be letters or punctuation
            for form in {word, word.rstrip(ENDING), word.lstrip(STARTING), word.lstrip(STARTING).rstrip(ENDING)}:
                if any(pattern.search(form) for pattern in marks):
                    found.update(self.reading(form))
        for match in SPACED.finditer(text):
            found.update(self.reading(match.group()))
        return found

    def marked(self, text: str) -> str:
        """The distinct words of a text, plain and restored, each between a start and an end sign."""
        text = text.lower()
        tokens = set(text.split())
        words = {t.strip(EDGE) for t in tokens} | self.restored(text, tokens)
        return START + (END + START).join(words - {""}) + END


def features(word: str) -> list[str]:
    """The word itself and its character n-grams, with marked ends."""
    marked = f"{START}{word}{END}"
    return [marked] + [marked[i : i + k] for k in FEATURE_SIZES for i in range(len(marked) - k + 1)]


def text_features(marked: str) -> set[str]:
    found: set[str] = set()
    for word in set(marked[1:-1].split(END + START)):
        found.update(features(word))
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``text, toxic`` of at most ``sample`` labelled rows, those of least hash; equal rows count once."""
    rows = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    keyed = docs.select("doc_id", *row_key({"doc_id": F.col("doc_id"), "text": F.col("text")}), "text")
    # the sample's ids are bounded by the parameter, and so are its rows
    chosen = keyed.join(F.broadcast(rows), "doc_id").select("k1", "k2", "toxic").distinct().orderBy("k1", "k2").limit(sample)
    chosen = keyed.join(F.broadcast(table(chosen)), ["k1", "k2"])
    return chosen.dropDuplicates(["k1", "k2"]).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, sample: int = 16_000, candidates: int = 3_000):
    """Weights by feature, and the bias."""
    rows = table(labelled_sample(docs, labels, sample).repartition(32, F.xxhash64("text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def presence(batches):
        restorer = Restorer(shared.value)
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for feature in text_features(restorer.marked(text or "")):
                    seen = counts.setdefault(feature, [0, 0])
                    seen[toxic > 0] += 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(counts), pa.string()),
                pa.array([c[0] for c in counts.values()], pa.int64()),
                pa.array([c[1] for c in counts.values()], pa.int64()),
            ],
            names=["feature", "clean", "toxic"],
        )

    totals = rows.agg(F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("int")).alias("toxic")).first()
    n, n_toxic = totals["n"], totals["toxic"] or 0
    if n_toxic in (0, n):
        share = n_toxic / n if n else 0.0
        return {}, float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    base = n_toxic / n
    seen = F.col("clean") + F.col("toxic")
    surprise = (F.col("toxic") - seen * base) / F.sqrt(seen * base * (1 - base))
    found = (
        rows.mapInArrow(presence, "feature string, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter(F.col("toxic") >= 3)
        .orderBy(surprise.desc(), "feature")
        .limit(candidates)
        .select("feature")
    )
    chosen = {row["feature"]: i for i, row in enumerate(found.collect())}  # at most ``candidates``

    def incidence(batches):
        restorer, automaton = Restorer(shared.value), matcher(chosen)
        for batch in batches:
            lists = [
                sorted(chosen[f] for f in found_in(automaton, restorer.marked(t or "")))
                for t in batch.column(0).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists, pa.list_(pa.int32())), batch.column(1).cast(pa.int32())], names=["on", "toxic"]
            )

    # the driver gets lists of candidate numbers of at most ``sample`` rows
    matrix = rows.mapInArrow(incidence, "on array<int>, toxic int").toPandas()
    matrix = matrix.iloc[np.lexsort([matrix["on"].map(str), matrix["toxic"]])]
    weights, bias = sparse_logistic(list(matrix["on"]), (matrix["toxic"] > 0).to_numpy(float), len(chosen))
    return {f: float(weights[i]) for f, i in chosen.items() if weights[i]}, bias


def sparse_logistic(rows: list, y: np.ndarray, n_features: int, penalty: float = 0.5, steps: int = 400):
    """Logistic regression on binary features with an L1 penalty, by accelerated proximal gradient."""
    sizes = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    col = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(row) else np.empty(0, np.int64)
    # correlated features act as one: scale the step by the largest row and column
    speed = 4.0 / max(1.0, (sizes.max(initial=1) + 1) * max(np.bincount(col, minlength=1).max(initial=1), 1) ** 0.5)
    speed = max(speed, 4.0 / (len(rows) * (sizes.max(initial=1) + 1)))
    w = z = np.zeros(n_features)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    momentum = 1.0
    last = np.inf
    for _ in range(steps):
        margin = bias + np.bincount(row, z[col], len(rows))
        p = 1 / (1 + np.exp(-margin))
        loss = -np.sum(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)) + penalty * np.abs(z).sum()
        if loss > last:
            speed, z, momentum = speed / 2, w, 1.0
            last = np.inf
            continue
        last = loss
        step = z - speed * np.bincount(col, (p - y)[row], n_features)
        new = np.sign(step) * np.maximum(np.abs(step) - speed * penalty, 0)
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z = new + (momentum - 1) / grown * (new - w)
        w, momentum = new, grown
        bias -= 4.0 / len(rows) * np.sum(p - y)
    return w, float(bias)


def matcher(wanted):
    """An automaton that finds the wanted features as substrings of marked words, in one pass."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for feature in wanted:
        automaton.add_word(feature, feature)
    automaton.make_automaton()
    return automaton


def found_in(automaton, marked: str) -> set[str]:
    return {feature for _, feature in automaton.iter(marked)} if len(automaton) else set()


def scored(
    docs: DataFrame, model: np.ndarray, weights: dict[str, float], bias: float, text: str = "text", into: str = "toxicity"
) -> DataFrame:
    """``docs`` with ``into``, the probability of the toxic label; an input column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((model, weights))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model_, weights_ = shared.value
        restorer, automaton = Restorer(model_), matcher(weights_)
        for texts in batches:
            found = (found_in(automaton, restorer.marked(value or "")) for value in texts)
            margins = [bias + sum(weights_[f] for f in sorted(on)) for on in found]
            yield pd.Series([1 / (1 + np.exp(-m)) for m in margins], dtype="float64")

    return docs.withColumn(into, score(text))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document; labels of one fold in five are never read."""
    docs = source(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    labels = source(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    model = character_model(trigram_counts(docs).toPandas())
    weights, bias = fit(docs, labels, model)
    return scored(docs, model, weights, bias).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )

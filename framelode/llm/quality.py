"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each text. Expectation-maximisation estimates, from the votes of all
documents and no labels, how each labeller votes on good and on bad texts; the posterior of a text's votes then is its
weak label. A linear scorer over hashed features of words learns the posteriors of a bounded sample and judges all.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Common short words of four languages: fixed values.
STOPWORDS = frozenset(
    "the of and to in a is it that for with as on be by this are was at or an from "  # en
    "der die das und ist ein eine nicht mit von zu den für auf im des sich es dem "  # de
    "le la les et de un une est que qui dans pour sur pas au par en du avec plus "  # fr
    "el los las y del se con no una su para es por como más lo al mi".split()
)
#: Bits of the hashed features; documents that the scorer is fitted on, at most; probability from which a text is kept.
BITS, SAMPLE, KEEP = 14, 4000, 0.5
SYMBOLS = "%#&$*^~|=<>{}\\_@+"
LABELLERS = ("symbols", "pipes", "capitals", "shouting", "echo", "variety", "lines", "function_words", "punctuation", "word_length")


class Kinds(dict):
    """Kinds of characters: X, x, 9, or the character itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        return kind


KINDS, RUNS = Kinds(), re.compile(r"(.)\1+", re.DOTALL)


def shape(word: str) -> str:
    """Kinds of characters of a word, runs as one: Xx, x., X!, |, x%."""
    return "x" if word.islower() and word.isalpha() else RUNS.sub(r"\1", word.translate(KINDS))


#: Feature number of the commonest shape.
LOWER = zlib.crc32(b"x", 7) & (1 << BITS) - 1


class Slots(dict):
    """Feature numbers of a word and of its shape, as one number; words are remembered up to a bound."""

    MOST, LONGEST = 200_000, 64

    def __missing__(self, word: str) -> int:
        where = (1 << BITS) - 1
        kind = shape(word)
        other = LOWER if kind == "x" else zlib.crc32(kind.encode("utf-8", "surrogatepass"), 7) & where
        slots = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) & where | other << BITS
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = slots
        return slots


class Measured:
    """A text, its words and their counts, from which both votes and features are taken."""

    def __init__(self, text: str) -> None:
        self.text, self.words = text, text.split()
        self.n, self.counts = len(self.words), Counter(self.words)
        self.echo = sum(map(operator.eq, self.words, self.words[1:])) / max(1, self.n)
        self.variety = len(self.counts) / max(1, self.n)

    def votes(self) -> tuple[int, ...]:
        """One vote a labeller: 1 good, -1 bad, 0 none. Of a text without words only those labellers vote that see it."""
        n, text, counts, variety = self.n, self.text, self.counts, self.variety
        if not n:
            return (0, 0, 0, 0, 0, -1, 0, -1, -1, -1)
        between = lambda x, good, bad: 1 if x <= good else -1 if x >= bad else 0
        lines = [x for x in text.split("\n") if x]
        different = len(set(lines))
        common = sum(k for w, k in counts.items() if w.lower() in STOPWORDS) / n
        ended = sum(w[-1] in ".,;:!?" for w in counts) / len(counts)
        mean = sum(map(len, self.words)) / n
        return (
            between(sum(map(text.count, SYMBOLS)) / n, 0.02, 0.25),
            between(text.count("|") / n, 0.0, 0.2),
            between(sum(map(str.isupper, self.words)) / n, 0.1, 0.35),
            between(text.count("!!") / n, 0.0, 0.1),
            between(self.echo, 0.03, 0.3),
            1 if variety > 0.35 else -1 if n >= 40 and variety < 0.15 else 0,
            0 if len(lines) < 4 else -1 if different < 0.5 * len(lines) else 1 if different == len(lines) else 0,
            1 if common > 0.06 else -1 if n >= 40 and common < 0.01 else 0,
            1 if 0.02 <= ended <= 0.5 else -1 if n >= 40 and (ended < 0.01 or ended > 0.8) else 0,
            1 if 2.5 <= mean <= 9.5 else -1 if mean > 14 or n >= 40 and mean < 2 else 0,
        )

    def slots(self, known: Slots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers of the distinct words and of their shapes, and how often each occurs."""
        both = np.fromiter(map(known.__getitem__, self.counts), dtype=np.int64, count=len(self.counts))
        return both & (1 << BITS) - 1, both >> BITS, np.fromiter(self.counts.values(), dtype=np.int64, count=len(self.counts))

    def extra(self) -> list[float]:
        """Features beside words: a constant, the shares of echoes, of distinct words and of line ends."""
        return [1.0, self.echo, self.variety, min(1.0, self.text.count("\n") / max(1, self.n))]

    def features(self, known: Slots) -> tuple[np.ndarray, np.ndarray]:
        """Distinct feature numbers and their values, shares of the words."""
        words, shapes, times = self.slots(known)
        at, of = np.unique(np.concatenate([words, shapes]), return_inverse=True)
        value = np.bincount(of, weights=np.concatenate([times, times]), minlength=len(at)) / max(1, self.n)
        return np.concatenate([at, (1 << BITS) + np.arange(4)]), np.concatenate([value, self.extra()])

    def score(self, known: Slots, weights: np.ndarray) -> float:
        """What the scorer says of the features, without listing them."""
        words, shapes, times = self.slots(known)
        total = float((weights[words] + weights[shapes]) @ times) / max(1, self.n) + float(weights[1 << BITS :] @ self.extra())
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, total))))


def votes(text: str) -> tuple[int, ...]:
    return Measured(text).votes()


def pattern(v: tuple[int, ...]) -> int:
    """Votes as a number to base 3."""
    out = 0
    for x in v:
        out = out * 3 + x + 1
    return out


def unpattern(p: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        p, x = divmod(p, 3)
        out.append(x)
    return out[::-1]


def expectation_maximisation(histogram: dict[int, int], rounds: int = 200) -> tuple[np.ndarray, float, dict[int, float]]:
    """P(vote | class, a vote is cast) of each labeller (labeller, class, bad or good), the share of good texts, and the
    posterior of each pattern.

    Labellers are taken as independent given the class, and no vote as no evidence. The start is the share of good among the
    cast votes, so class 1 stays the good one; a prior of 0.5 votes of each kind keeps probabilities off 0.
    """
    keys = sorted(histogram)
    if not keys:
        return np.full((len(LABELLERS), 2, 2), 1 / 2), 0.5, {}
    cast = np.array([unpattern(p) for p in keys])
    n = np.array([histogram[p] for p in keys], dtype=float)
    good, bad = (cast == 2).sum(axis=1), (cast == 0).sum(axis=1)
    post = np.where(bad >= 2, 0.1, np.where(bad == 1, 0.6, 0.9)) * 0.9 + 0.1 * (good + 0.5) / (good + bad + 1)
    one_hot = np.stack([cast == v for v in (0, 2)], axis=2).astype(float)
    for _ in range(rounds):
        both = np.stack([n * (1 - post), n * post])
        table = np.einsum("cp,plv->lcv", both, one_hot) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        share = (both[1].sum() + 1) / (n.sum() + 2)
        odds = np.einsum("plv,lv->p", one_hot, np.log(table[:, 1] / table[:, 0])) + np.log(share / (1 - share))
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return table, float(share), dict(zip(keys, post.tolist(), strict=True))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 30, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Weights of a logistic scorer of posteriors, by adaptive gradient steps in a fixed order; a row's numbers are distinct."""
    weights, seen = np.zeros((1 << BITS) + 4), np.full((1 << BITS) + 4, 1e-8)
    order = np.random.default_rng(9).permutation(len(rows))
    for _ in range(epochs):
        for i in order:
            at, value, target = rows[i]
            own = weights[at]
            p = 1 / (1 + math.exp(-min(30.0, max(-30.0, float(own @ value)))))
            step = (p - target) * value + decay * own
            seen[at] += step * step
            weights[at] = own - rate * step / np.sqrt(seen[at])
    return weights


def pattern_counts(docs: DataFrame) -> dict[int, int]:
    """How many texts have each pattern of votes; 3 ** 10 patterns at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            found.update(pattern(votes(t.as_py() or "")) for t in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), type=pa.int64()), pa.array(list(found.values()), type=pa.int64())], names=["pattern", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return {r["pattern"]: r["n"] for r in counted}


def fitted(docs: DataFrame, posterior: dict[int, float], share: float, total: int, sample: int) -> np.ndarray:
    """Weights of the scorer, fitted on the `sample` texts with the least hashes of id and text, or all if there are fewer.

    Features of about twice as many texts, a fixed share of the hash's range, are made where the texts lie; those of the
    sample come to one task, whose only result is the weights.
    """
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(9), "doc_id", "text"), 1)
    range_end = ((1 << 63) - 1) * min(total, 2 * sample) // max(1, total)
    chosen = docs.select(hashed.alias("h"), F.col("text").cast("string").alias("text")).where((F.col("h") <= range_end) & (F.length("text") > 0))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Slots()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                m = Measured(text)
                at, value = m.features(known)
                rows.append((at.astype(np.int32), value.astype(np.float32), posterior.get(pattern(m.votes()), share)))
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], type=pa.list_(pa.int32())), pa.array(columns[1], type=pa.list_(pa.float32())), pa.array(columns[2], type=pa.float64())], names=["h", "at", "value", "target"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            bounds = batch.column(1).offsets.to_numpy() - batch.column(1).offsets[0].as_py()
            at, value = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            rows += [(at[a:b], value[a:b], t) for a, b, t in zip(bounds[:-1], bounds[1:], batch.column(3).to_numpy(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows)], type=pa.list_(pa.float64()))], names=["weights"])

    found = chosen.mapInArrow(prepare, "h long, at array<int>, value array<float>, target double").orderBy("h").limit(sample).coalesce(1).mapInArrow(solve, "weights array<double>").first()
    return np.array(found["weights"]) if found else fit([])


def judged(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """row (a struct of all columns of docs), posterior, score and keep of each row; see classify()."""
    histogram = pattern_counts(docs)
    _, share, posterior = expectation_maximisation(histogram)
    weights = fitted(docs, posterior, share, sum(histogram.values()), sample)
    sent = docs.sparkSession.sparkContext.broadcast((posterior, weights))
    text_at = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Slots()
        posterior, weights = sent.value
        for batch in batches:
            post, score = [], []
            for text in batch.column(0).field(text_at):
                text = text.as_py() or ""
                m = Measured(text)
                p = posterior.get(pattern(m.votes()), share)
                post.append(p)
                score.append(m.score(known, weights) if m.n else p)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(post, type=pa.float64()), pa.array(score, type=pa.float64()), pa.array([s >= KEEP for s in score], type=pa.bool_())], names=["row", "posterior", "score", "keep"])

    rows = docs.select(F.struct("*").alias("row"))
    schema = T.StructType([*rows.schema.fields, T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    return rows.mapInArrow(judge, schema)


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs (doc_id, text and others) with posterior, score and keep added.

    posterior is the weak label's probability of good, score the linear scorer's; keep is score >= KEEP. A null text is
    an empty one, for which the scorer isn't asked: posterior and score are those of its votes. Votes of all documents are
    counted over whole texts; the scorer is fitted on `sample` of them. Rows may repeat, ids may be null, and a
    word may be as long as its text. Other columns are kept, columns of the added names are replaced; good_documents()
    keeps these too. An empty table gives an empty one.
    """
    out = judged(docs.drop(*(c for c in docs.columns if c in ("posterior", "score", "keep"))), sample)
    return out.select("row.*", "posterior", "score", "keep")


def good_documents(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows that are kept, columns as in docs: a user's columns posterior, score or keep stay as they are."""
    return judged(docs, sample).where("keep").select("row.*")

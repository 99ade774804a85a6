"""Toxicity by a subsequence string kernel and a support vector machine.

The kernel counts the subsequences of three letters that two strings share,
weighted down by the gaps they span, so an insult is recognised with letters
inserted and with endings.  Landmarks are letter strings of labelled documents,
most of them such as tell toxic documents from others and some common ones of
harmless documents; the Nystroem map of the kernel to them turns a segment of
text into a vector for a linear machine.  Segments are words, and runs of
single letters joined.  A document scores by its most toxic segments, through
a logistic curve with the labels' shares.

Labels belong to whole documents.  The machine learns from a bounded sample of
them (SAMPLE of each label), each represented by its most suspicious segments;
what it then takes for toxic in harmless documents of the sample it learns
anew as harmless.  A kernel value counts as 0 where a segment lacks a quarter
of a landmark's letters.

Defined results: null and empty texts score as a document of harmless words.
Without labels of both kinds, or without any letters in their documents, every
score is the share of toxic labels, or 0.  A filter drops nothing then, nor
where the labels follow no letters.  Rows that repeat a doc_id are scored
each for itself; of repeated labels the largest holds.  No rows give no rows.
Other columns pass through unread.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import KEPT, released, written

#: Labelled documents of each label to learn from.
SAMPLE = 3000
#: Landmarks that tell toxic documents, and common ones of others; none more alike than this.
LANDMARKS, COMMON, ALIKE = 64, 12, 0.75
LENGTH, DECAY = 3, 0.6
BEGIN = "^"
#: Letters of a landmark; letters of a segment's window.
SHORT, LONG, WINDOW = 5, 12, 24
WIDTHS = (7, 10, 15, WINDOW)
#: Share of a landmark's letters that a segment must have for a kernel above 0.
SHARED = 0.75
#: Segments of a document to learn from, the most like a telling landmark and some by hash; segments of a harmless one to learn anew.
WITNESSES, OTHERS, MINED = 6, 4, 3
#: The weight of toxic segments against harmless ones, the likeness that they need, and the penalty of the machine.
FOR, LIKE, PENALTY = 0.25, 0.5, 1e-3
#: A telling string is so many times as frequent in toxic documents as in others.
RATIO = 3
#: Segments that a document's score follows from.
BEST = 2
THRESHOLD = 0.3
ENTRIES = 300_000

LETTERS = re.compile(r"[^\W_]+")
SINGLES = re.compile(r"(?<![^\W_])[^\W_]([\W_])[^\W_](?![^\W_])(?:\1[^\W_](?![^\W_]))+")


def segments(text: str | None) -> set[str]:
    """Letter strings: what is left of each word without signs, and single letters in a row joined."""
    if not text:
        return set()
    text = text.lower()
    out = {w if w.isalnum() else "".join(LETTERS.findall(w)) for w in set(text.split())}
    for run in SINGLES.finditer(text):
        out.add("".join(LETTERS.findall(run[0])))
    out.discard("")
    return out


def windows(segment: str) -> Iterable[str]:
    """A segment with a mark where it begins; a long one as windows that overlap by half."""
    segment = BEGIN + segment
    if len(segment) <= WINDOW:
        return (segment,)
    return (segment[i : i + WINDOW] for i in range(0, len(segment) - WINDOW // 2, WINDOW // 2))


def coded(strings: list[str], width: int) -> np.ndarray:
    """Code points, a string a row, 0 behind its end."""
    return np.array(strings, f"<U{width}").view("<u4").reshape(len(strings), width) if strings else np.zeros((0, width), "<u4")


def masks(codes: np.ndarray) -> np.ndarray:
    """A bit for each letter that occurs, letters beyond the first 128 folded."""
    bits = np.where(codes > 0, np.uint64(1) << (codes % 64).astype(np.uint64), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=1)


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The subsequence kernel of string i of s with string i of t, both coded.

    Letter by letter, sums over the places before fade with the distance; so
    they run along one string and then the other.
    """
    out = np.empty(len(s), np.float32)
    for k in range(0, len(s), 1024):
        # The pairs lie side by side on the last axis.
        x, y = np.ascontiguousarray(s[k : k + 1024].T), np.ascontiguousarray(t[k : k + 1024].T)
        same = ((x[:, None] == y[None]) & (x > 0)[:, None]).astype(np.float32) * np.float32(DECAY**2)
        upto = same
        for _ in range(LENGTH - 1):
            before = np.zeros_like(upto)
            for i in range(1, len(x)):
                before[i] = before[i - 1] * np.float32(DECAY) + upto[i - 1]
            both = np.zeros_like(upto)
            for j in range(1, len(y)):
                both[:, j] = both[:, j - 1] * np.float32(DECAY) + before[:, j - 1]
            upto = same * both
        out[k : k + 1024] = upto.sum(axis=(0, 1))
    return out


@dataclass
class Landmarks:
    """Strings that segments are compared with; the first `telling` ones tell toxic documents from others."""

    strings: list[str]
    telling: int = 0

    def __post_init__(self) -> None:
        self.codes = coded(self.strings, LONG)
        self.masks = masks(self.codes)
        self.need = np.ceil(SHARED * np.bitwise_count(self.masks)).astype(np.uint8)
        self.own = kernel(self.codes, self.codes)

    def similar(self, strings: list[str]) -> np.ndarray:
        """The normalised kernel of strings of at most WINDOW letters with each landmark."""
        out = np.zeros((len(strings), len(self.strings)), np.float32)
        size, least = np.array([len(x) for x in strings]), 0
        for width in WIDTHS:  # short strings need smaller tables
            some = np.flatnonzero((least < size) & (size <= width))
            least = width
            codes = coded([strings[i] for i in some], width)
            i, j = np.nonzero(np.bitwise_count(masks(codes)[:, None] & self.masks) >= self.need)
            if len(i):
                rows, back = np.unique(i, return_inverse=True)
                own = kernel(codes[rows], codes[rows])[back]
                out[some[i], j] = kernel(codes[i], self.codes[j]) / np.sqrt(np.maximum(own * self.own[j], 1e-30))
        return out


@dataclass
class Model:
    landmarks: Landmarks
    map: np.ndarray
    weight: np.ndarray
    bias: float
    slopes: tuple[float, ...] = (1.0,) + (0.0,) * (BEST - 1)
    shift: float = 0.0
    #: Whether it rejects RATIO times the share of the sample's toxic documents that it rejects of harmless ones.
    tells: bool = False
    #: Names the model in the workers.
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def decisions(self, strings: list[str]) -> np.ndarray:
        out = np.empty(len(strings))
        for k in range(0, len(strings), 4096):
            near = self.landmarks.similar(strings[k : k + 4096])
            out[k : k + 4096] = near @ self.map @ self.weight + self.bias
        return out

    def best(self, decisions: Iterable[float]) -> list[float]:
        """The BEST largest decisions of a document's segments, the largest first."""
        left, out = list(decisions), []
        while left and len(out) < BEST:
            out.append(max(left))
            left.remove(out[-1])
        return out + [self.bias] * (BEST - len(out))

    def probability(self, best: np.ndarray) -> np.ndarray:
        """Of documents, by a row of best() each."""
        return 1 / (1 + np.exp(-np.clip(best @ np.array(self.slopes) + self.shift, -500, 500)))


class Scorer:
    """Decisions of segments, remembered within a bound."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def __call__(self, texts: Iterable[str | None]) -> list[list[float]]:
        """For each text the largest decisions."""
        each = [segments(t) for t in texts]
        new = list(set().union(*each) - self.known.keys())
        if len(self.known) + len(new) > ENTRIES:
            self.known.clear()
            new = list(set().union(*each))
        pieces = [(s, w) for s in new for w in windows(s)]
        for (s, _), d in zip(pieces, self.model.decisions([w for _, w in pieces]).tolist(), strict=True):
            if d > self.known.get(s, -1e9):
                self.known[s] = d
        return [self.model.best(map(self.known.__getitem__, s)) for s in each]


_SCORERS: dict[str, Scorer] = KEPT.setdefault(__name__, {})


def scorer_of(model: Model) -> Scorer:
    """The one of this Python worker, so that what it remembers outlives a task."""
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = Scorer(model)
    return _SCORERS[model.key]


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_sample(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, toxic of at most `most` documents of each label; how many of each were to be had)."""
    open_ = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    had = {r["toxic"]: r["n"] for r in open_.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [open_.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    # No more than twice `most` rows, whatever the input.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    # Of near copies, which share their four words of least hash, one speaks.
    hashes = F.transform(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")), lambda w: F.xxhash64(w))
    return rows.withColumn("__alike", F.slice(F.array_sort(hashes), 1, 4)).dropDuplicates(["toxic", "__alike"]).drop("__alike"), had


def _segments_of(sample: DataFrame) -> DataFrame:
    """string, toxic: letter strings of each document and the stems of those."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                found = segments(text.as_py())
                found = {(BEGIN + w)[:n] for w in found for n in (6, 7, LONG)}
                found = [w for w in found if len(w) >= SHORT and not any(c.isdigit() for c in w)]
                yield pa.RecordBatch.from_pydict({"string": pa.array(found, pa.string()), "toxic": pa.array([toxic] * len(found), pa.int32())})

    return sample.select("text", "toxic").mapInArrow(released(task), "string string, toxic int")


def choose_landmarks(sample: DataFrame, toxic: int, other: int) -> Landmarks:
    """Strings by the evidence that they give for toxic documents, and the most common others; none too like one before.

    Telling is what so many strings would not show by chance: the exponent of
    the Poisson tail passes the logarithm of 20 times their number.  Where no string
    does, those of the most evidence have to do.
    """
    counts = written(_segments_of(sample).groupBy("string").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")), "strings")
    ratio = (F.col("bad") + 0.5) / (toxic + 1) / ((F.col("good") + 0.5) / (other + 1))
    counts = counts.withColumns({"ratio": ratio, "evidence": F.col("bad") * F.log(ratio) - F.col("bad") + F.col("bad") / ratio})
    chosen: list[str] = []

    def choose(rows: list, upto: int) -> None:
        for r in rows:
            if len(chosen) < upto and (not chosen or Landmarks(chosen).similar([r["string"]]).max() < ALIKE):
                chosen.append(r["string"])

    telling = counts.filter((F.col("bad") > 0) & (F.col("ratio") > RATIO)).orderBy(F.desc("evidence"), "string").limit(12 * LANDMARKS).collect()
    chance = np.log(20 * max(1, counts.count()))
    choose([r for r in telling if r["evidence"] > chance] or telling, LANDMARKS)
    n = len(chosen)
    choose(counts.filter((F.col("good") > 0) & (F.col("ratio") < 1)).orderBy(F.desc("good"), "string").limit(12 * COMMON).collect(), n + COMMON)
    return Landmarks(chosen, n)


def _pieces(text: pa.Scalar) -> list[str]:
    return sorted({w for s in segments(text.as_py()) for w in windows(s)}, key=lambda w: (zlib.crc32(w.encode()), w))


def witnesses(sample: DataFrame, landmarks: Landmarks) -> DataFrame:
    """toxic, strings: for each document its segments most like a telling landmark, in that order, and some others."""
    telling = Landmarks(landmarks.strings[: landmarks.telling or None])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                pieces = _pieces(text)
                near = telling.similar(pieces).max(axis=1, initial=0)
                order = np.argsort(-near, kind="stable")
                out.append([pieces[i] for i in [*order[:WITNESSES], *sorted(order[WITNESSES:])[:OTHERS]]])
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "strings": pa.array(out, pa.list_(pa.string()))})

    return sample.select("text", "toxic").mapInArrow(released(task), "toxic int, strings array<string>")


def judged(sample: DataFrame, model: Model) -> DataFrame:
    """toxic, best, mistaken: the largest decisions of each document; of a harmless one the segments that the machine does not clearly take for harmless."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, mistaken = [], []
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                pieces = _pieces(text)
                decisions = model.decisions(pieces)
                best.append(model.best(decisions.tolist()))
                first = np.argsort(-decisions, kind="stable")[:MINED]
                mistaken.append([pieces[i] for i in first if decisions[i] > -1] if not toxic else [])
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "best": pa.array(best, pa.list_(pa.float64())), "mistaken": pa.array(mistaken, pa.list_(pa.string()))})

    return sample.select("text", "toxic").mapInArrow(released(task), "toxic int, best array<double>, mistaken array<string>")


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """A linear machine of squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(30):
        active = y * (x @ w) < 1
        a, c = x[active], weight[active]
        new = np.linalg.solve((a * c[:, None]).T @ a + np.diag(ridge), (a * (c * y[active])[:, None]).sum(axis=0))
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def _curve(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes and shift of the logistic curve from best decisions to labels, by Newton steps with smoothed targets.

    The more toxic any segment, the larger the score: where a slope would fall, the largest decision alone counts.
    """
    up, down = weight[y > 0].sum(), weight[y < 0].sum()
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    ridge = np.diag([1e-2] * f.shape[1] + [1e-3])
    x, w = np.hstack([f, np.ones((len(f), 1))]), np.zeros(f.shape[1] + 1)
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - goal)) + ridge @ w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    if (w[:-1] < 0).any() and f.shape[1] > 1:
        slopes, shift = _curve(f[:, :1], y, weight)
        return slopes + (0.0,) * (f.shape[1] - 1), shift
    return tuple(np.maximum(w[:-1], 1e-3).tolist()), float(w[-1])


def _machine_of(landmarks: Landmarks, bad: Counter, harmless: Counter) -> Model | None:
    """A machine that tells segments of toxic documents from those of others."""
    if not bad or not harmless:
        return None
    # What more toxic documents have than others and that is like a landmark speaks for, all of harmless ones against.
    near = landmarks.similar([*bad]).max(axis=1, initial=0)
    telling = {s: n for (s, n), like in zip(bad.items(), near, strict=True) if like >= LIKE and n > harmless.get(s, 0)}
    telling = telling or dict(bad)
    among = landmarks.similar(landmarks.strings)
    values, vectors = np.linalg.eigh((among + among.T).astype(float) / 2)
    to = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    x = landmarks.similar([*telling, *harmless]).astype(float) @ to
    y, times = np.repeat([1.0, -1.0], [len(telling), len(harmless)]), np.sqrt([*telling.values(), *harmless.values()])
    times[y > 0] *= FOR * times[y < 0].sum() / times[y > 0].sum()
    return Model(landmarks, to, *_machine(x, y, times / times.mean(), PENALTY))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model | float:
    """A model, or where labels of one kind or all letters are missing the share of toxic ones."""
    sample, had = training_sample(docs, labels, most)
    if not (had.get(0) and had.get(1)):
        return float(bool(had.get(1)))
    sample = written(sample, "labelled")
    share = had[1] / (had[0] + had[1])
    learnt = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = learnt.get(1, 0), learnt.get(0, 0)
    landmarks = choose_landmarks(sample, toxic, other)
    if not landmarks.strings:
        return share
    rows = witnesses(sample, landmarks).collect()  # of SAMPLE documents of each label
    harmless, bad = Counter(s for r in rows if not r["toxic"] for s in r["strings"]), Counter(s for r in rows if r["toxic"] for s in r["strings"])
    model = _machine_of(landmarks, bad, harmless)
    if model is None:
        return share
    for r in judged(sample, model).select("mistaken").collect():
        harmless |= Counter(dict.fromkeys(r["mistaken"], 1))
    model = _machine_of(landmarks, bad, harmless)
    rows = judged(sample, model).select("toxic", "best").collect()
    label = np.array([1.0 if r["toxic"] else -1.0 for r in rows])
    # The labels' shares among all rows, not among the sample.
    weight = np.where(label > 0, had[1] / max(1, toxic), had[0] / max(1, other))
    best = np.array([r["best"] for r in rows])
    model.slopes, model.shift = _curve(best, label, weight / weight.mean())
    rejected = model.probability(best) >= THRESHOLD
    model.tells = bool(rejected[label > 0].mean() > RATIO * rejected[label < 0].mean())
    return model


def with_scores(docs: DataFrame, model: Model | float, name: str = "score") -> DataFrame:
    """Docs, with the score of each text as another column."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    if isinstance(model, float):
        return docs.withColumn(name, F.lit(model))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                scores = model.probability(np.array(scorer(t.as_py() for t in part.column("text"))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, name])

    return docs.mapInArrow(released(task), schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text)."""
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Docs less those that score THRESHOLD or more; all of them where the labels teach no model that tells documents apart."""
    model = fit(docs, labels)
    if isinstance(model, float) or not model.tells:
        return docs
    return with_scores(docs, model, "__toxicity").filter(F.col("__toxicity") < THRESHOLD).drop("__toxicity")

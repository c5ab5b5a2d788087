"""Subject areas of documents: naive Bayes from a labelled sample, refined by EM, calibrated.

* Every document is cut into sentences; their words and word pairs are hashed to ``FEATURES``
  numbers once and kept as a table of blocks, each sentence once a block however often it is said there.
* Complement naive Bayes on the labelled documents gives the first weights: a subject's words
  are weighed against the words of everything else.
* Expectation-maximisation over all documents: each sentence belongs to one subject or to none
  (a class of its own for talk about the run and figures of speech), each document has its own
  mixture of them; labelled documents may only use their labels. One pass is one job over all
  documents, and what comes back is a table of at most FEATURES x classes sums.
* A document's score for a subject is the expected share of its sentences. Shares are
  calibrated into independent posteriors, one curve a subject, on labelled documents each left out of the counts it is judged by.

Bounds: the model has FEATURES x (subjects + 1) numbers whatever the corpus; the calibration
uses at most ``SAMPLE`` labelled documents (chosen by hash); all counts, EM passes and
posteriors cover every document and its whole text.

Defined results: NULL, blank and sentence-less texts have no subject; labels of unknown
documents or subjects are ignored; without any labels the result is empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut, spread

FEATURES = 1 << 16
#: Groups of documents by language: words are weighed against what chance gives in their own language.
LANGUAGES = 16
PASSES = 2
SAMPLE = 50_000
SHRINK, FLOOR = 1.0, 0.03
NONE = 4.0
#: Occurrences in labelled text from which a word counts as known, and what it must then speak for a subject.
SUPPORT, TELLING = 5, 0.7

_HEAD = re.compile(r"^[ \t]*(?:#+[^\n]*|(?:>+|[-*+•]|\d{1,4}[.)]|\|)[ \t]*)", re.M)
_SPEAKER = re.compile(r"^[ \t]*(?:\[[^\]\n]{1,24}\]|[A-Za-z]{2,16}:)[ \t]*", re.M)
_END = re.compile(r"[.!?…](?P<gap>[\"'»”)]*\s+)|\n+")
_WORD = re.compile(r"[^\W\d_]{2}")
_MARK = re.compile(r"[^\w\n\x00-\x7f]+")
#: Bytes that are no letter become spaces; line ends stay, and so do the bytes of letters beyond ASCII.
_LETTERS = bytes(i if i >= 128 or i == 10 or chr(i).isalpha() else 32 for i in range(256))


def sentences(text: str) -> list[str]:
    """Sentences of a transcript without headings, list marks and speaker names."""
    body = _SPEAKER.sub("", _HEAD.sub("", text))
    out, at = [], 0
    for m in _END.finditer(body):
        out.append(body[at : m.start("gap") if m["gap"] else m.start()])
        at = m.end()
    out.append(body[at:])
    return [s for s in out if s and _WORD.search(s)]


class _Numbers(dict):
    """Word -> 32-bit hash, remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        if word == b"\n" or len(word) < 2:
            return _BREAK if word == b"\n" else _EMPTY
        if len(self) > 500_000:
            self.clear()
        out = self[word] = xxhash.xxh32_intdigest(word)
        return out


_NUMBERS = _Numbers()
#: Numbers above all hashes: no word, and the end of a sentence.
_EMPTY, _BREAK = 1 << 33, 1 << 34


def numbered(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of sentences in small letters, one sentence after the other, and how many each has: its words and its word pairs."""
    joined = "\n".join(parts)
    words = (joined if joined.isascii() else _MARK.sub(" ", joined)).encode().translate(_LETTERS).replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(_NUMBERS.__getitem__, words), np.uint64, len(words))
    ends = np.append(np.flatnonzero(ids == _BREAK), len(ids))
    gone = np.cumsum((ids == _EMPTY) | (ids == _BREAK))
    sizes = np.diff(np.concatenate([[0], ends - np.where(ends < len(ids), gone[np.minimum(ends, len(ids) - 1)] - 1, gone[-1])])) if parts else np.zeros(0, np.int64)
    word = ids[(ids != _EMPTY) & (ids != _BREAK)]
    sentence = np.repeat(np.arange(len(parts)), sizes)
    same = sentence[1:] == sentence[:-1]
    pair = ((word[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (word[1:] * np.uint64(0xC2B2AE3D27D4EB4F)))[same]
    out = np.concatenate([word, pair >> np.uint64(40)]) % np.uint64(FEATURES)
    owner = np.concatenate([sentence, sentence[1:][same]])
    order = np.argsort(owner, kind="stable")
    return out[order].astype(np.int32), np.bincount(owner, minlength=len(parts)).astype(np.int32)


def hashed(parts: list[str]) -> np.ndarray:
    """Features of all sentences of a text together."""
    return numbered([s.lower() for s in parts])[0]


#: A block holds at most so many documents; it is closed earlier when its sentences have so many letters.
BLOCK, LETTERS = 128, 2_000_000
_BLOCK = "doc_ids array<bigint>, sizes array<int>, sentence array<int>, features array<int>, widths array<int>, labels array<array<int>>, tongues array<int>"
_ARROW = pa.schema([("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("sentence", pa.list_(pa.int32())), ("features", pa.list_(pa.int32())), ("widths", pa.list_(pa.int32())), ("labels", pa.list_(pa.list_(pa.int32()))), ("tongues", pa.list_(pa.int32()))])


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents in which a sentence that occurs several times has its features written once."""
    docs: list[tuple] = []
    number: list[dict[str, int]] = [{} for _ in range(LANGUAGES)]
    kinds: list[str] = []
    sentence: list[int] = []
    letters = 0

    def close() -> pa.RecordBatch:
        features, widths = numbered(kinds)
        row = [[d[0] for d in docs], [d[1] for d in docs], sentence, features, widths, [d[2] for d in docs], [d[3] for d in docs]]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

    for batch in batches:
        for doc, text, labels, tongue in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = sentences(text.lower())
            seen = number[tongue]
            for s in own:
                i = seen.get(s)
                if i is None:
                    i = seen[s] = len(kinds)
                    kinds.append(s)
                sentence.append(i)
            docs.append((doc, len(own), labels, tongue))
            letters += len(text)
            if len(docs) == BLOCK or letters > LETTERS:
                yield close()
                docs, number, kinds, sentence, letters = [], [{} for _ in range(LANGUAGES)], [], [], 0
    if docs:
        yield close()


def prepare(documents: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """Blocks of documents: ids, sentences per document, the sentences as numbers into the block's different ones, the features
    of those, labels (NULL where a document is not labelled) and language groups."""
    tongue = F.pmod(F.xxhash64(F.lower(F.substring(F.coalesce("lang", F.lit("")), 1, 2))), F.lit(LANGUAGES)).cast("int")
    number = F.create_map(*[x for i, s in enumerate(subjects) for x in (F.lit(s), F.lit(i))])
    own = labels.where(F.col("subject").isin(subjects)).groupBy("doc_id").agg(F.sort_array(F.collect_set(number[F.col("subject")])).alias("labels"))
    texts = spread(documents.where("text is not null and doc_id is not null").select("doc_id", "text", tongue.alias("tongue")))
    rows = texts.join(own, "doc_id", "left").select("doc_id", "text", "labels", "tongue")
    # Small row groups: a reader holds a whole one, and a row here is a block of documents.
    return cut(rows.mapInArrow(_tokenise, _BLOCK), "sentences", options={"parquet.block.size": 16 << 20})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Block(batch, i)


class _Block:
    """One block as flat arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        at = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
        self.docs, self.sizes, self.sentence, self.features, self.widths, self.tongue = at(0), at(1), at(2), at(3), at(4), at(6)
        self.labels = batch.column(5)[i].as_py()
        self.n = len(self.docs)
        self.sentence_doc = np.repeat(np.arange(self.n), self.sizes)
        self.starts = np.concatenate([[0], np.cumsum(self.widths)[:-1]]).astype(np.int64) if len(self.widths) else np.zeros(0, np.int64)
        # Language of each different sentence: equal sentences of two languages are two.
        self.kind_tongue = np.zeros(len(self.widths), np.int64)
        self.kind_tongue[self.sentence] = self.tongue[self.sentence_doc]
        self.filled = np.flatnonzero(self.sizes)
        self.doc_starts = (np.cumsum(self.sizes) - self.sizes)[self.filled]

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, values.shape[1]))
        if len(values):
            out[self.filled] = np.add.reduceat(values, self.doc_starts, axis=0)
        return out

    def expectation(self, weights: np.ndarray, bias: float = 0.0, free: bool = False, inner: int = 4) -> np.ndarray:
        """Posterior of every sentence over the classes, under each document's own mixture; labelled documents keep to their labels unless ``free``."""
        classes = weights.shape[1]
        if not len(self.sentence):
            return np.zeros((0, classes))
        kinds = np.add.reduceat(weights[self.features], self.starts, axis=0)
        kinds[:, -1] += bias
        scores = kinds[self.sentence].astype(np.float64)
        allowed = np.ones((self.n, classes), bool)
        for d, own in enumerate(self.labels if not free else ()):
            if own is not None:
                allowed[d, :-1] = False
                allowed[d, own] = True
        scores[~allowed[self.sentence_doc]] = -1e9
        scores -= scores.max(axis=1, keepdims=True)
        like = np.exp(scores)
        mix = allowed / allowed.sum(axis=1, keepdims=True)
        post = like
        for _ in range(inner):
            post = like * mix[self.sentence_doc]
            post /= np.maximum(post.sum(axis=1, keepdims=True), 1e-300)
            mix = (self.per_doc(post) + 0.05) / (self.sizes[:, None] + 0.05 * classes)
        return post


class _Sums:
    """Counts of one task: per feature the classes and languages, and per language the classes."""

    #: Features kept back until they are added to the table together.
    ROOM = 400_000

    def __init__(self, classes: int):
        self.classes = classes
        self.table = np.zeros((FEATURES + LANGUAGES, classes + LANGUAGES))
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, b: _Block, weights: np.ndarray) -> None:
        """``weights``: what each class gets of each sentence (and so of each of its features)."""
        if not len(b.sentence):
            return
        order = np.argsort(b.sentence, kind="stable")
        held, first = np.unique(b.sentence[order], return_index=True)
        kinds = np.zeros((len(b.widths), self.classes))
        kinds[held] = np.add.reduceat(weights[order], first, axis=0)
        some = kinds.any(axis=1)
        if not some.any():
            return
        self.waiting.append((b.features[np.repeat(some, b.widths)], b.widths[some], kinds[some], b.kind_tongue[some]))
        self.size += len(self.waiting[-1][0])
        if self.size > self.ROOM:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        features, widths, kinds, tongues = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.size = [], 0
        for c in range(self.classes):
            self.table[:FEATURES, c] += np.bincount(features, np.repeat(kinds[:, c], widths), FEATURES)
            self.table[FEATURES:, c] += np.bincount(tongues, kinds[:, c] * widths, LANGUAGES)
        total, tongue = np.repeat(kinds.sum(axis=1), widths), np.repeat(tongues, widths)
        for t in np.unique(tongues):
            at = tongue == t
            self.table[:FEATURES, self.classes + t] += np.bincount(features[at], total[at], FEATURES)

    def emit(self) -> pa.RecordBatch:
        self.flush()
        rows = np.flatnonzero(self.table.sum(axis=1) > 1e-9)
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *[pa.array(self.table[rows, c]) for c in range(self.table.shape[1])]], names=["feature", *[f"c{c}" for c in range(self.table.shape[1])]])


def _collect(parts: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts per feature and class, and what chance would give: at most FEATURES + LANGUAGES rows come to the driver."""
    width = classes + LANGUAGES
    total = parts.groupBy("feature").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(width)]).toArrow()
    out = np.zeros((FEATURES + LANGUAGES, width))
    if total.num_rows:
        out[total.column("feature").to_numpy()] = np.stack([total.column(f"c{c}").to_numpy() for c in range(width)], axis=1)
    counts, spoken, rates = out[:FEATURES, :classes], out[:FEATURES, classes:], out[FEATURES:, :classes]
    overall = rates.sum(axis=0) / max(rates.sum(), 1e-9)
    rates = (rates + 50 * overall) / (rates.sum(axis=1, keepdims=True) + 50)
    chance = np.where(spoken.sum(axis=1, keepdims=True) > 0, spoken @ rates / np.maximum(spoken.sum(axis=1, keepdims=True), 1e-9), overall)
    return counts, np.clip(chance, FLOOR, 1 - FLOOR)


def log_ratios(counts: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Log of what a class has of each feature against what chance would give it.

    ``SHRINK`` imagined occurrences at the rate of chance keep rare words from proving much.
    """
    return np.log((counts + SHRINK * chance) / ((counts.sum(axis=1, keepdims=True) + SHRINK) * chance))


def complement_weights(counts: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Complement naive Bayes: a class's features against those of all labelled text that is not in it."""
    rest = counts.sum(axis=1, keepdims=True) - counts
    return np.log((counts + SHRINK * chance) / chance) - np.log((rest + SHRINK * (1 - chance)) / (1 - chance))


@dataclass
class Model:
    """Feature weights of all classes, the last being none of the subjects, and the counts and chances they come from."""

    weights: np.ndarray
    counts: np.ndarray
    chance: np.ndarray
    barred: np.ndarray

    def without(self, features: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Weights of some features as they were had a document with the counts ``own`` of them not been there."""
        out = log_ratios(np.maximum(self.counts[features] - own, 0), self.chance[features])
        out[:, :-1][self.barred[features]] = np.minimum(out[:, :-1][self.barred[features]], 0)
        return out


def fit(prepared: DataFrame, n_subjects: int, passes: int = PASSES) -> Model:
    """Complement naive Bayes on the labelled documents, then ``passes`` of expectation-maximisation over all."""
    classes = n_subjects + 1
    schema = "feature int, " + ", ".join(f"c{c} double" for c in range(classes + LANGUAGES))
    narrow = "feature int, " + ", ".join(f"c{c} double" for c in range(n_subjects + LANGUAGES))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(n_subjects)
        for b in _blocks(batches):
            own = np.zeros((b.n, n_subjects))
            for d, labels in enumerate(b.labels):
                if labels:
                    own[d, labels] = 1 / len(labels)
            sums.add(b, own[b.sentence_doc])
        yield sums.emit()

    weights = np.zeros((FEATURES, classes), np.float32)
    counts, chance = _collect(prepared.mapInArrow(labelled, narrow), n_subjects)
    weights[:, :-1] = complement_weights(counts, chance)
    # Words well known from labelled documents can only speak for subjects they speak for there;
    # this keeps a class from drifting onto phrases that every document uses.
    barred = (counts.sum(axis=1, keepdims=True) >= SUPPORT) & (weights[:, :-1] < TELLING)
    # So far nothing is known of the last class: a sentence belongs to it unless its words tell more than NONE.
    bias = NONE
    spark = prepared.sparkSession.sparkContext
    for _ in range(passes):
        shared = spark.broadcast(weights)

        def maximise(batches: Iterator[pa.RecordBatch], shared=shared, bias=bias) -> Iterator[pa.RecordBatch]:
            sums = _Sums(classes)
            for b in _blocks(batches):
                sums.add(b, b.expectation(shared.value, bias))
            yield sums.emit()

        counts, chance = _collect(prepared.mapInArrow(maximise, schema), classes)
        weights, bias = log_ratios(counts, chance).astype(np.float32), 0.0
        weights[:, :-1][barred] = np.minimum(weights[:, :-1][barred], 0)
        shared.unpersist()
    return Model(weights, counts.astype(np.float32), chance.astype(np.float32), barred)


def _left_out(b: _Block, model: Model, post: np.ndarray, d: int) -> np.ndarray:
    """Shares of a labelled document by a model that has not counted it. ``post`` is what the fit made of its sentences."""
    at = slice(int(b.sizes[:d].sum()), int(b.sizes[: d + 1].sum()))
    spans = [np.arange(b.starts[k], b.starts[k] + b.widths[k]) for k in b.sentence[at]]
    widths = np.array([len(x) for x in spans])
    found, place = np.unique(b.features[np.concatenate(spans)], return_inverse=True)
    own = np.zeros((len(found), post.shape[1]))
    np.add.at(own, place, np.repeat(post[at], widths, axis=0))
    scores = np.add.reduceat(model.without(found, own)[place], np.cumsum(widths) - widths, axis=0)
    like = np.exp(scores - scores.max(axis=1, keepdims=True))
    mix = np.full(like.shape[1], 1 / like.shape[1])
    out = like
    for _ in range(4):
        out = like * mix
        out /= np.maximum(out.sum(axis=1, keepdims=True), 1e-300)
        mix = (out.sum(axis=0) + 0.05) / (len(like) + 0.05 * len(mix))
    return out.mean(axis=0)[:-1]


def shares(prepared: DataFrame, model: Model) -> DataFrame:
    """(doc_id, labels, shares array<double>, left_out array<double>, n_sentences): expected share of each subject in each document's
    sentences, labels aside; ``left_out`` are the same by a model without the document, for labelled ones."""
    shared = prepared.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            model = shared.value
            share = b.per_doc(b.expectation(model.weights, free=True))[:, :-1] / np.maximum(b.sizes, 1)[:, None]
            told = [d for d, own in enumerate(b.labels) if own is not None and b.sizes[d]]
            left: list[np.ndarray | None] = [None] * b.n
            if told:
                post = b.expectation(model.weights)
                for d in told:
                    left[d] = _left_out(b, model, post, d)
            yield pa.RecordBatch.from_arrays([pa.array(b.docs), pa.array(b.labels, pa.list_(pa.int32())), pa.array(list(share), pa.list_(pa.float64())), pa.array(left, pa.list_(pa.float64())), pa.array(b.sizes, pa.int64())], names=["doc_id", "labels", "shares", "left_out", "n_sentences"])

    return prepared.mapInArrow(task, "doc_id bigint, labels array<int>, shares array<double>, left_out array<double>, n_sentences bigint")


def _cut(x: np.ndarray, y: np.ndarray, prior: float, width: float) -> float:
    """Share that tells labels from the rest with fewest errors; being ``width`` away from ``prior`` weighs as two errors."""
    order = np.argsort(x)
    x, y = x[order], y[order]
    # Cut before each value (and behind the last): what lies below is called no, what lies above yes.
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum(~y[::-1])[::-1], [0]])
    at = np.concatenate([[0.0], (x[1:] + x[:-1]) / 2, [1.0]])
    # Between two values every cut has the same errors: the one nearest to the prior counts.
    low, high = np.concatenate([[0.0], x]), np.concatenate([x, [1.0]])
    at = np.clip(prior, np.minimum(low + (at - low) * 0.1, at), np.maximum(high - (high - at) * 0.1, at))
    return float(at[np.argmin(errors + 2 * ((at - prior) / width) ** 2)])


def calibrate(scored: DataFrame, n_subjects: int, sample: int = SAMPLE) -> tuple[float, np.ndarray]:
    """Slope, and per subject the share at which its posterior is one half, from at most ``sample`` labelled documents.

    Each document is judged by a model that has not counted it. A subject's logistic curve crosses one half at the
    share that makes fewest errors, drawn towards the common cut of all subjects (and that towards a sixth) where there are few of
    them; the common slope is the one of largest likelihood.
    """
    rows = scored.where("left_out is not null").orderBy(F.xxhash64("doc_id")).limit(sample).select("labels", "left_out").toArrow().to_pylist()
    middle, slope = np.full(n_subjects, 1 / 6), 80.0
    if rows:
        x = np.array([r["left_out"] for r in rows])
        y = np.array([[i in r["labels"] for i in range(n_subjects)] for r in rows])
        common = _cut(x.ravel(), y.ravel(), 1 / 6, 0.04)
        middle = np.array([_cut(x[:, i], y[:, i], common, 0.02) for i in range(n_subjects)])
        likely = lambda a: np.log1p(np.exp(-np.clip(np.where(y, 1, -1) * a * (x - middle), -40, 40))).sum()
        slope = min((10.0, 20.0, 40.0, 60.0, 80.0, 120.0, 160.0), key=likely)
    return slope, middle


def assign(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, share, posterior, n_sentences) for every document with a text and every subject."""
    names = sorted(r[0] for r in subjects.select("subject").where("subject is not null").distinct().collect())
    prepared = prepare(documents, labels, names)
    scored = cut(shares(prepared, fit(prepared, len(names))), "shares")
    slope, middle = calibrate(scored, len(names))
    at = scored.select("doc_id", "n_sentences", F.posexplode("shares").alias("i", "share"))
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("i") + 1)
    return at.select("doc_id", of(names).alias("subject"), "share", (1 / (1 + F.exp(F.lit(-slope) * (F.col("share") - of([float(m) for m in middle]))))).alias("posterior"), "n_sentences")


def found(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    return assign(documents, labels, subjects).where("posterior >= 0.5").select("doc_id", "subject")


def composition(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """Make-up of the corpus: per subject the documents about it, the expected number of sentences, and its share of all of them."""
    rows = assign(documents, labels, subjects)
    per = rows.groupBy("subject").agg(F.sum((F.col("posterior") >= 0.5).cast("bigint")).alias("documents"), F.sum("posterior").alias("expected_documents"), F.sum(F.col("share") * F.col("n_sentences")).alias("expected_sentences"))
    # At most one row a subject: the window holds a dozen rows.
    total = F.sum("expected_sentences").over(Window.partitionBy())
    return per.select("subject", "documents", "expected_documents", "expected_sentences", (F.col("expected_sentences") / total).alias("sentence_share"))

"""A convolutional text classifier for toxicity.

A word's vector is the sum of two hashed embeddings, of the word and of its first
letters. Filters over one, two and three words run along the whole text, their largest
outputs feed a logistic output. A bounded part of the labelled documents only gives the
weights to start from. From there rounds of training go over all of them: every task runs
through its documents in small steps, and the tasks' changes are averaged. Word counts,
class weights and thresholds come from all labelled documents as well. Each language gets a
threshold from documents not trained on; the language is told from the text's most common
short words, never from a column. A score of 0.5 is the threshold of the text's language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybook.llm import bloom
from waybook.llm.words import PLAIN, U, batches, hashes, mix, spans
from waybook.sources.scratch import discard, stage

#: Labelled documents of each class, and bytes of text, that the starting weights come from at most. Half the bytes are for each class.
SAMPLE, SAMPLE_BYTES = 1500, 8 << 20
#: Texts longer than this come after a class's shorter ones, so that one of them does not use up the class's bytes.
LONG = SAMPLE_BYTES >> 7
#: Part of the labelled texts that only sets thresholds: one in so many.
APART = 5
#: Steps of training are this large on the bounded part, and in each round over all labelled documents.
RATE, ROUNDS = 0.02, (0.004, 0.002)
#: Texts, and words, of a step in a round.
STEP, STEP_WORDS = 32, 1 << 17
#: Words that the driver scores at once; each takes about a kilobyte.
RAW_WORDS = 1 << 15
#: Raw scores are counted in so many bins to set thresholds, changes of weights in this unit, which makes sums exact.
BINS, UNIT = 10_000, 2.0**-24
#: Embeddings, their length, filters of each width, widths, and the letters of a word's second embedding.
BUCKETS, SIZE, FILTERS, WIDTHS, LETTERS = 1 << 16, 16, 16, (1, 2, 3), 4
#: Embeddings met in fewer of the texts fitted on stay empty: they could only learn single texts by heart.
MET = 3
#: Common words by which languages are told apart. Fixed values.
COMMON = {
    "en": "the of and to in is that it for was with as be on by are this from at",
    "de": "der die das und in zu den ist von mit nicht ein eine für auf dem im sich",
    "fr": "le la les de et des en un une du que qui dans pour est au sur pas par avec",
    "es": "el la los de que y en un una se del las por con para es su al como más",
}


def _word_hashes(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in data])
    return hashes(np.frombuffer(b"".join(data), np.uint8), ends - [len(w) for w in data], ends)


_LANGUAGES = list(COMMON)
_COMMON = [np.sort(_word_hashes(words.split())) for words in COMMON.values()]


def encoded(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, word starts per row, two embedding numbers per word, language per row) for runs of whole texts."""
    for first, data, offsets in batches(column, 1 << 20):
        start, end, owner = spans(data, offsets, PLAIN)
        whole = hashes(data, start, end)
        letters = hashes(data, start, np.minimum(end, start + LETTERS))
        cuts = np.searchsorted(owner, np.arange(len(offsets)))
        votes = np.zeros((len(offsets) - 1, len(_COMMON)), np.int64)
        for i, known in enumerate(_COMMON):
            at = np.minimum(np.searchsorted(known, whole), len(known) - 1)
            votes[:, i] = np.bincount(owner[known[at] == whole], minlength=len(offsets) - 1)
        language = np.where(votes.max(axis=1, initial=0) > 0, votes.argmax(axis=1), len(_COMMON))
        both = np.stack((whole % U(BUCKETS), (letters ^ U(0x5851F42D4C957F2D)) % U(BUCKETS)), axis=1).astype(np.int32)
        yield first, cuts, both, language


def _spaced(cuts: np.ndarray, words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some texts, each followed by empty places so that no filter reaches into the next; begin and end of each."""
    gap, size = max(WIDTHS) - 1, cuts[texts + 1] - cuts[texts]
    begin = np.concatenate(([0], np.cumsum(size + gap)))[:-1].astype(int)
    out = np.full((int((size + gap).sum()), 2), BUCKETS, np.int32)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + within] = words[np.repeat(cuts[texts], size) + within]
    return out, np.stack((begin, begin + size), axis=1)


def _outputs(parts: np.ndarray) -> np.ndarray:
    """Outputs of all filters at every place, from the words' parts in them."""
    out, at = np.zeros((len(parts), FILTERS * len(WIDTHS)), np.float32), 0
    for i, width in enumerate(WIDTHS):
        for j in range(width):
            out[: len(parts) - j, i * FILTERS : (i + 1) * FILTERS] += parts[j:, at : at + FILTERS]
            at += FILTERS
    return out


def _pooled(outputs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Largest output of each filter in each text, 0 at least; 0 for texts without words."""
    out = np.zeros((len(bounds), outputs.shape[1]), np.float32)
    some = np.flatnonzero(bounds[:, 1] > bounds[:, 0])
    if len(some):
        out[some] = np.maximum(0, np.maximum.reduceat(outputs, bounds[some].ravel(), axis=0)[::2])
    return out


@dataclass
class Model:
    embeddings: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    thresholds: np.ndarray
    #: The log odds of words that the embeddings started from.
    odds: np.ndarray | None = None

    def sent(self) -> Model:
        """What tasks need for scores. Each makes `projected` for itself: six times the embeddings, which the driver would have to hold and to send."""
        return replace(self, odds=None)

    def taps(self) -> np.ndarray:
        return np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)

    def projected(self) -> np.ndarray:
        """Each embedding's part in each filter at each place; the last row is the empty word's."""
        return self.embeddings @ self.taps()

    def raw(self, projected: np.ndarray, cuts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Probability of toxicity of each text."""
        places, bounds = _spaced(cuts, words, np.arange(len(cuts) - 1))
        pooled = _pooled(_outputs(projected[places[:, 0]] + projected[places[:, 1]]) + self.bias, bounds)
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out[:-1] + self.out[-1], -30, 30)))

    def scores(self, raw: np.ndarray, language: np.ndarray) -> np.ndarray:
        """0.5 at the threshold of each text's language, straight lines from there to 0 and 1."""
        at = self.thresholds[language]
        return np.where(raw < at, 0.5 * raw / at, 0.5 + 0.5 * (raw - at) / (1 - at))


def _drawn(rnd: np.random.Generator) -> Model:
    return Model(
        np.vstack((rnd.normal(0, 0.3, (BUCKETS, SIZE)), np.zeros((1, SIZE)))).astype(np.float32),
        [rnd.normal(0, 0.6 / np.sqrt(SIZE * w), (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        np.append(rnd.normal(0, 0.3, FILTERS * len(WIDTHS)), 0).astype(np.float32),
        np.full(len(_LANGUAGES) + 1, 0.5),
    )


def _odds(met: list[np.ndarray], texts: np.ndarray) -> np.ndarray:
    """Half the log odds of the texts that have a word, of the texts of each class that it was met in."""
    odds = [np.log((m + 1) / (n + 2)) for m, n in zip(met, texts, strict=True)]
    return 0.5 * (odds[1] - odds[0])


def _begun(rnd: np.random.Generator, odds: np.ndarray, live: np.ndarray) -> Model:
    """The first component starts as the log odds of the texts that have the word, and filters start out looking for it."""
    model = _drawn(rnd)
    model.embeddings *= 0.2
    model.embeddings[:, 0] = odds
    for f in model.filters:
        f[:, 0] = np.abs(f[:, 0])
    model.embeddings[~live] = 0
    return replace(model, odds=np.where(live, odds, 0))


def _apart(cuts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether each text only sets thresholds: decided by its words, so that copies of a text are all fitted on or none is."""
    total = np.concatenate(([0], np.cumsum(words[:, 0], dtype=np.int64)))
    return mix((total[cuts[1:]] - total[cuts[:-1]] + ((cuts[1:] - cuts[:-1]) << 32) + 1).astype(U)) % U(APART) == 0


def _balance(share: float) -> tuple[float, float]:
    """The weight of a clean and of a toxic text, by the share of toxic ones."""
    return 0.5 / max(1 - share, 0.01), 0.5 / max(share, 0.01)


class Learner:
    """Adam on a model's weights, in place; embeddings that are not `live` stay as they are."""

    def __init__(self, model: Model, live: np.ndarray, rate: float):
        self.model, self.live, self.rate, self.steps = model, live, rate, 0
        self.weights = {"embeddings": model.embeddings, "bias": model.bias, "out": model.out} | {f"filter{i}": f for i, f in enumerate(model.filters)}
        self.first, self.second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        self.changes = np.zeros(BUCKETS + 1, np.int64)

    def step(self, cuts: np.ndarray, words: np.ndarray, some: np.ndarray, labels: np.ndarray, balance: np.ndarray) -> None:
        """One step over some texts, given by all texts' words, with their labels and weights."""
        model, weights, first, second = self.model, self.weights, self.first, self.second
        ids, bounds = _spaced(cuts, words, some)
        vectors = model.embeddings[ids[:, 0]] + model.embeddings[ids[:, 1]]
        outputs = _outputs(vectors @ model.taps()) + model.bias
        pooled = _pooled(outputs, bounds)
        p = 1 / (1 + np.exp(-np.clip(pooled @ model.out[:-1] + model.out[-1], -30, 30)))
        error = ((p - labels) * balance / len(some)).astype(np.float32)
        gradient = {k: np.zeros_like(v) for k, v in weights.items() if k != "embeddings"}
        gradient["out"][:-1], gradient["out"][-1] = pooled.T @ error, error.sum()
        back = error[:, None] * model.out[:-1] * (pooled > 0)
        gradient["bias"] += back.sum(axis=0)
        # only the place of a filter's largest output learns
        peaks = np.zeros(back.shape, int)
        for text, (begin, end) in enumerate(bounds):
            if end > begin:
                peaks[text] = begin + outputs[begin:end].argmax(axis=0)
        rows, values = [], []
        for i, f in enumerate(model.filters):
            for k in range(FILTERS):
                c = i * FILTERS + k
                live = np.flatnonzero(back[:, c])
                for j in range(WIDTHS[i]):
                    place, part = peaks[live, c] + j, back[live, c]
                    gradient[f"filter{i}"][j, :, k] += vectors[place].T @ part
                    rows.append(ids[place].ravel())
                    values.append(np.repeat(part[:, None] * f[j, :, k], 2, axis=0))
        self.steps += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for k, g in gradient.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            weights[k] -= rate * first[k] / (np.sqrt(second[k]) + 1e-8)
        touched, place = np.unique(np.concatenate(rows), return_inverse=True)
        g = np.zeros((len(touched), SIZE), np.float32)
        np.add.at(g, place, np.concatenate(values))
        g[~self.live[touched]] = 0
        first["embeddings"][touched] += 0.1 * (g - first["embeddings"][touched])
        second["embeddings"][touched] += 0.001 * (g * g - second["embeddings"][touched])
        weights["embeddings"][touched] -= rate * first["embeddings"][touched] / (np.sqrt(second["embeddings"][touched]) + 1e-8)
        self.changes[touched] += 1


def train(cuts: np.ndarray, words: np.ndarray, labels: np.ndarray, language: np.ndarray, ratio: float = 1.0, epochs: int = 5, seed: int = 7) -> Model:
    """Fit on texts given by their words' embedding numbers; Adam on balanced classes. For thresholds, a clean text counts `ratio` times."""
    rnd = np.random.default_rng(seed)
    apart = _apart(cuts, words) if len(labels) >= 20 else np.zeros(len(labels), bool)
    fitted = np.flatnonzero(~apart)
    balance = np.array(_balance(labels[fitted].mean()))[labels] if len(fitted) else labels
    met = [np.bincount(np.concatenate([np.unique(words[cuts[i] : cuts[i + 1]]) for i in fitted if labels[i] == label] or [np.empty(0, int)]).astype(int), minlength=BUCKETS + 1) for label in (0, 1)]
    live = met[0] + met[1] >= MET
    model = _begun(rnd, _odds(met, np.bincount(labels[fitted].astype(int), minlength=2)), live)
    learner = Learner(model, live, RATE)
    steps_ = -(-len(fitted) // 32)
    for _ in range(max(epochs, -(-300 // max(steps_, 1)))):  # 300 steps at least
        order = rnd.permutation(fitted)
        for at in range(0, len(order), 32):
            some = order[at : at + 32]
            learner.step(cuts, words, some, labels[some], balance[some])

    del learner
    projected = model.projected()
    raw = [model.raw(projected, cuts[i : j + 1] - cuts[i], words[cuts[i] : cuts[j]]) for i, j in ((int(x[0]), int(x[-1]) + 1) for x in _steps(cuts, 64, RAW_WORDS))]
    raw = np.concatenate(raw or [np.empty(0)])
    del projected
    for i in range(len(_LANGUAGES) + 1):
        own = apart & (language == i)
        values, at = np.unique(raw[own], return_inverse=True)
        clean, toxic = (np.bincount(at[labels[own] == label], minlength=len(values)) for label in (0, 1))
        if toxic.sum() >= 3 and clean.sum() >= 3:
            model.thresholds[i] = _threshold(values, clean, toxic, ratio)
    return model


def _threshold(values: np.ndarray, clean: np.ndarray, toxic: np.ndarray, ratio: float) -> float:
    """Of the cuts between values, with so many texts of each class, that have the fewest errors, the one nearest 0.5; held between 0.1 and 0.9."""
    ends = np.concatenate(([0.0], values, [1.0]))
    cuts = (ends[1:] + ends[:-1]) / 2
    missed = np.concatenate(([0], np.cumsum(toxic)))
    errors = missed + ratio * (clean.sum() - np.concatenate(([0], np.cumsum(clean))))
    good = cuts[errors == errors.min()]
    return float(np.clip(good[np.argmin(np.abs(good - 0.5))], 0.1, 0.9))


# ---- over all labelled documents ---------------------------------------------------


def _labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Every distinct (_id, _hash) of _id, _hash, text that `known` (_id, _toxic, _order) has, as its words' embedding numbers; written.

    A Bloom filter keeps the texts without a label from being shuffled; the join behind it is exact.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bloom.build(known, "_id"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            batch = batch.filter(pa.array(bloom.passes(bits.value, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))
            for first, cuts, words, language in encoded(batch.column(2)):
                n = len(language)
                packed = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((cuts * 4).astype(np.int64)), pa.py_buffer(words.astype("<u2").tobytes())])
                made = [pa.array(language.astype(np.int32)), pa.array(_apart(cuts, words)), packed.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), *made], ["_id", "_hash", "_language", "_apart", "_words"])

    rows = docs.filter("_id IS NOT NULL").select("_id", "_hash", "text").mapInArrow(run, "_id long, _hash long, _language int, _apart boolean, _words binary")
    once = rows.join(known, "_id").dropDuplicates(["_id", "_hash"])
    return stage(once.sortWithinPartitions("_order", "_id", "_hash"), "labelled")


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(word starts per row, two embedding numbers per word) of the column _words."""
    packed = batch.column("_words").cast(pa.large_binary())
    offsets = np.frombuffer(packed.buffers()[1], np.int64, len(packed) + 1, packed.offset * 8)
    data = np.frombuffer(packed.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return (offsets - offsets[0]) // 4, data.view("<u2").reshape(-1, 2)


def _steps(cuts: np.ndarray, texts: int = STEP, words: int = STEP_WORDS) -> Iterator[np.ndarray]:
    """Runs of so many texts and words at most; a longer text is a run of its own."""
    at = 0
    while at < len(cuts) - 1:
        to = max(at + 1, min(at + texts, int(np.searchsorted(cuts, cuts[at] + words, "right")) - 1))
        yield np.arange(at, to)
        at = to


def _met(fitted: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """In how many texts of each class each embedding is met, and how many texts there are."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in it:
            cuts, words = _unpacked(batch)
            toxic = batch.column("_toxic").to_numpy()
            for some in _steps(cuts):
                part = words[cuts[some[0]] : cuts[some[-1] + 1]].astype(np.int64)
                owner = np.repeat(some, np.diff(cuts[some[0] : some[-1] + 2]))
                each = np.unique((owner[:, None] * BUCKETS + part).ravel())
                for label in (0, 1):
                    met[label] += np.bincount(each[toxic[each // BUCKETS] == label] % BUCKETS, minlength=BUCKETS + 1)
            met[:, BUCKETS] += np.bincount(toxic, minlength=2)
        toxic, at = np.nonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(toxic), pa.array(at), pa.array(met[toxic, at])], ["toxic", "at", "n"])

    found = fitted.select("_toxic", "_words").mapInArrow(run, "toxic long, at long, n long").groupBy("toxic", "at").agg(F.sum("n").alias("n")).toArrow()  # two for each embedding
    met = np.zeros((2, BUCKETS + 1), np.int64)
    met[found["toxic"].to_numpy(), found["at"].to_numpy()] = found["n"].to_numpy()
    texts = met[:, BUCKETS].copy()
    met[:, BUCKETS] = 0
    return list(met), texts


def _dense(model: Model) -> np.ndarray:
    """All weights but the embeddings, in rows as long as an embedding."""
    flat = np.concatenate([*[f.ravel() for f in model.filters], model.bias, model.out])
    return np.pad(flat, (0, -len(flat) % SIZE)).reshape(-1, SIZE)


def _changed(model: Model, embeddings: np.ndarray, dense: np.ndarray) -> Model:
    """The model with such changes of its embeddings and other weights."""
    flat, parts, at = dense.ravel(), [], 0
    for w in [*model.filters, model.bias, model.out]:
        parts.append((w + flat[at : at + w.size].reshape(w.shape)).astype(np.float32))
        at += w.size
    return replace(model, embeddings=(model.embeddings + embeddings).astype(np.float32), filters=parts[:-2], bias=parts[-2], out=parts[-1])


def _round(fitted: DataFrame, model: Model, live: np.ndarray, balance: tuple[float, float], rate: float) -> Model:
    """One pass over the texts: each task learns from its own, and the tasks' changes of each weight are averaged by how often they changed it."""
    sent = fitted.sparkSession.sparkContext.broadcast((model, live))
    sums = [f"_{i}" for i in range(SIZE)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, live = sent.value
        learner = Learner(_changed(begin, np.zeros((1, SIZE)), np.zeros_like(_dense(begin))), live, rate)
        for batch in it:
            cuts, words = _unpacked(batch)
            toxic = batch.column("_toxic").to_numpy()
            for some in _steps(cuts):
                learner.step(cuts, words, some, toxic[some], np.array(balance)[toxic[some]])
        touched = np.flatnonzero(learner.changes[:BUCKETS] * live[:BUCKETS])
        dense = _dense(learner.model) - _dense(begin)
        change = np.vstack((learner.model.embeddings[touched] - begin.embeddings[touched], dense)).astype(np.float64)
        times = np.concatenate((learner.changes[touched], np.full(len(dense), learner.steps)))
        units = np.rint(change * times[:, None] / UNIT).astype(np.int64)
        at = np.concatenate((touched, BUCKETS + 1 + np.arange(len(dense))))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(times), *[pa.array(units[:, i]) for i in range(SIZE)]], ["at", "times", *sums])

    made = fitted.select("_toxic", "_words").mapInArrow(run, "at long, times long, " + ", ".join(f"{c} long" for c in sums))
    found = made.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("times", *sums)]).toArrow()  # one row for each embedding
    sent.destroy()
    at, times = found["at"].to_numpy(), found["times"].to_numpy()
    change = np.zeros((BUCKETS + 1 + len(_dense(model)), SIZE))
    change[at] = np.stack([found[c].to_numpy() for c in sums], axis=1) * UNIT / np.maximum(times, 1)[:, None]
    return _changed(model, change[: BUCKETS + 1], change[BUCKETS + 1 :])


def _thresholds(apart: DataFrame, model: Model) -> np.ndarray:
    """The threshold of each language from all texts not trained on: raw scores are counted in bins, whose borders are the cuts."""
    sent = apart.sparkSession.sparkContext.broadcast(model.sent())
    shape = (len(_LANGUAGES) + 1, 2, BINS + 1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, projected = sent.value, sent.value.projected()
        counts = np.zeros(shape, np.int64)
        for batch in it:
            cuts, words = _unpacked(batch)
            toxic, language = batch.column("_toxic").to_numpy(), batch.column("_language").to_numpy()
            for some in _steps(cuts):
                raw = fitted.raw(projected, cuts[some[0] : some[-1] + 2] - cuts[some[0]], words[cuts[some[0]] : cuts[some[-1] + 1]])
                np.add.at(counts, (language[some], toxic[some], (raw * BINS).astype(int)), 1)
        at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([*[pa.array(a) for a in at], pa.array(counts[at])], ["language", "toxic", "bin", "n"])

    keys = ["language", "toxic", "bin"]
    rows = apart.select("_toxic", "_language", "_words").mapInArrow(run, "language long, toxic long, bin long, n long")
    found = rows.groupBy(*keys).agg(F.sum("n").alias("n")).toArrow()  # at most the cells of `shape`
    sent.destroy()
    counts = np.zeros(shape, np.int64)
    counts[tuple(found[k].to_numpy() for k in keys)] = found["n"].to_numpy()
    out = np.full(len(counts), 0.5)
    for i, (clean, toxic) in enumerate(counts):
        if toxic.sum() >= 3 and clean.sum() >= 3:
            some = np.flatnonzero(clean + toxic)
            out[i] = _threshold((some + 0.5) / BINS, clean[some], toxic[some], 1.0)
    return out


def refined(labelled: DataFrame, start: Model | None = None, seed: int = 7) -> Model:
    """A model trained over all rows of `_labelled`, from the weights of `start` or from drawn ones.

    Log odds and the choice of live embeddings are those of all texts: what `start` began with is exchanged for them.
    """
    fitted, apart = labelled.filter("NOT _apart"), labelled.filter("_apart")
    met, texts = _met(fitted)
    live, odds = met[0] + met[1] >= MET, _odds(met, texts)
    model = _begun(np.random.default_rng(seed), odds, live)
    if start is not None:
        known = start.embeddings.any(axis=1)
        embeddings = np.where(known[:, None], start.embeddings, model.embeddings)
        embeddings[known, 0] += (odds - start.odds)[known]
        embeddings[~live] = 0
        model = replace(start, embeddings=embeddings.astype(np.float32), odds=model.odds)
    balance = _balance(texts[1] / max(texts.sum(), 1))
    for rate in ROUNDS if start is not None else (RATE, *ROUNDS):
        model = _round(fitted, model, live, balance, rate)
    return replace(model, thresholds=_thresholds(apart, model))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _chosen(sizes: list) -> list:
    """Of one class's (_order, _id, _hash, _bytes), in order, those whose texts fit into its half of the bytes; its shortest if none does."""
    out, left = [], SAMPLE_BYTES // 2
    for row in sorted(sizes, key=lambda r: r["_bytes"] > LONG):  # stable
        if row["_bytes"] <= left:
            out.append(row)
            left -= row["_bytes"]
    return out or sorted(sizes, key=lambda r: r["_bytes"])[:1]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled documents that are not held out.

    It starts from one trained on at most SAMPLE of each class, and SAMPLE_BYTES of whole texts,
    half for each class: the documents with the smallest hashes of their ids; a single text that
    does not fit is left to the rounds over all documents, the others stay. Where there are no more
    documents than these, the start is the model. A document is its doc_id and text. One with several
    labels counts as toxic if one says so. Without documents of both classes the model calls nothing toxic.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).dropna()
    known = known.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic")).withColumn("_order", F.xxhash64("_id"))
    of = dict(known.groupBy("_toxic").count().collect())  # two classes
    some = known.filter("_toxic = 0").orderBy("_order").limit(SAMPLE).union(known.filter("_toxic = 1").orderBy("_order").limit(SAMPLE))
    hashed = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").withColumn("_hash", F.xxhash64("text"))
    labelled = _labelled(hashed.filter(~held_out(F.col("_id"))), known.filter("_toxic IN (0, 1)"))
    there = dict(labelled.groupBy("_toxic").count().collect())  # two classes
    if len(there) < 2:
        empty = np.zeros(FILTERS * len(WIDTHS) + 1, np.float32)
        empty[-1] = -5
        return Model(np.zeros((BUCKETS + 1, SIZE), np.float32), [np.zeros((w, SIZE, FILTERS), np.float32) for w in WIDTHS], empty[:-1].copy(), empty, np.full(len(_LANGUAGES) + 1, 0.5))
    texts = hashed.join(F.broadcast(some), "_id")  # at most 2 * SAMPLE ids
    # lengths alone first; the texts of those that are taken afterwards
    sizes = texts.groupBy("_toxic", "_order", "_id", "_hash").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("_bytes"))
    nth = F.row_number().over(Window.partitionBy("_toxic").orderBy("_order", "_id", "_hash"))
    first = sizes.withColumn("_nth", nth).filter(F.col("_nth") <= SAMPLE).orderBy("_nth").collect()
    chosen = [(r["_id"], r["_hash"]) for toxic in (0, 1) for r in _chosen([r for r in first if r["_toxic"] == toxic])]
    taken = docs.sparkSession.createDataFrame(chosen, "_id long, _hash long")
    rows = texts.join(F.broadcast(taken), ["_id", "_hash"]).dropDuplicates(["_id", "_hash"]).orderBy("_order", "_id", "_hash").select("text", "_toxic").toArrow()
    found = list(encoded(rows["text"].combine_chunks())) if rows.num_rows else []
    cuts = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(x[1]) for x in found] or [np.empty(0, int)])))).astype(int)
    words = np.concatenate([x[2] for x in found] or [np.empty((0, 2), np.int32)])
    language = np.concatenate([x[3] for x in found] or [np.empty(0, int)])
    toxic = rows["_toxic"].to_numpy().astype(np.int64)
    start = None
    if len(np.unique(toxic)) == 2:
        start = train(cuts, words, toxic, language, max(1.0, (of[0] / (toxic == 0).sum()) / (of[1] / (toxic == 1).sum())))
    model = refined(labelled, start) if rows.num_rows < sum(there.values()) else start
    discard(labelled)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of (doc_id, text), in the order of its partition: doc_id, text_hash, held_out, score, predicted.

    Null and empty texts have no words and get the score of no evidence. A null
    doc_id is not held out. Only the whole text goes into a score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.sent())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, projected = sent.value, sent.value.projected()
        for batch in it:
            out = np.empty(batch.num_rows)
            for first, cuts, words, language in encoded(batch.column(2)):
                out[first : first + len(language)] = fitted.scores(fitted.raw(projected, cuts, words), language)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["doc_id", "text_hash", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, score double")
    return rows.select("doc_id", "text_hash", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose document the fitted classifier does not call toxic; a document is its doc_id and text."""
    bad = scored(docs, fit(docs, labels)).filter("predicted = 1").select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    return docs.join(bad, docs.doc_id.cast("long").eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs.text) == bad["_bad_hash"]), "left_anti")

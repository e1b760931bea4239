"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader (proximal) with an L1 and an L2 penalty; a temperature
fitted on rows that training has not seen then makes the probabilities honest.

Document frequencies are counted over every labelled row on the executors. The weights are fitted
on a bounded sample of them: of the distinct texts of each language the `per_language` with the
smallest hash, or all if there are fewer. The fitted model has at most FEATURES x languages numbers whatever the corpus,
and is broadcast; prediction is one map over whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import add_columns, crc_remainder, free_name

FEATURES = 1 << 15
PER_LANGUAGE = 800
MOST_LANGUAGES = 1000
UNDETERMINED = "und"

_LETTERS = np.array([chr(c).isalpha() for c in range(0xD800)] + [False] * 0x800
                    + [chr(c).isalpha() for c in range(0xE000, 0x10000)])


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text: letters stay, every run of other characters is one 0."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return codes
    letter = _LETTERS[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        letter[high] = [chr(c).isalpha() for c in codes[high]]
    codes = np.where(letter, codes, 0)
    return codes[(codes != 0) | np.append(True, codes[:-1] != 0)]


def term_counts(text: str | None, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams of a text's letters (0 marks word edges) and how often each occurs."""
    codes = letters_of(text or "")
    if not codes.any():
        return np.empty(0, np.int64), np.empty(0)
    c = np.concatenate(([0], codes, [0])).astype(np.uint64)
    salt = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    one = c[1:-1][c[1:-1] != 0] * salt[0]
    two = (c[:-1] * salt[0] + c[1:]) * salt[1]
    three = ((c[:-2] * salt[0] + c[1:-1]) * salt[1] + c[2:]) * salt[2]
    slots = np.concatenate([(h ^ (h >> np.uint64(29))) * salt[1] >> np.uint64(40) for h in (one, two, three)])
    counts = np.bincount((slots % np.uint64(features)).astype(np.int64), minlength=features)
    at = np.flatnonzero(counts)
    return at, counts[at]


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF vector (sublinear in the term's count)."""
    at, counts = term_counts(text, len(idf))
    values = (1 + np.log(counts)) * idf[at] if len(at) else counts
    norm = math.sqrt(float(values @ values)) if len(at) else 0.0
    return at, values / norm if norm else values


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray         # features x languages, sparse by its penalty
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        at, values = vector(text, self.idf)
        if not len(at) or not self.languages:
            return UNDETERMINED, 0.0
        p = softmax(self.logits(at, values) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def fit_weights(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str], idf: np.ndarray,
                alpha: float = 0.5, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1, passes: int = 4) -> Model:
    """FTRL-proximal over (language index, slots, values); elastic-net penalties l1, l2."""
    n_languages = len(languages)
    z = np.zeros((len(idf) + 1, n_languages))           # the last slot is the bias
    squares = np.zeros_like(z)
    target = np.eye(n_languages)

    def weights(at, penalty=l1):
        lean = np.maximum(np.abs(z[at]) - penalty, 0.0) * -np.sign(z[at])
        return lean / ((beta + np.sqrt(squares[at])) / alpha + l2)

    for k in range(passes):
        for i in np.random.default_rng(k).permutation(len(rows)):
            label, at, values = rows[i]
            at, x = np.append(at, len(idf)), np.append(values, 1.0)
            w = weights(at)
            slope = np.outer(x, softmax(x @ w) - target[label])
            step = (np.sqrt(squares[at] + slope ** 2) - np.sqrt(squares[at])) / alpha
            z[at] += slope - step * w
            squares[at] += slope ** 2
    w = weights(np.arange(len(idf) + 1))
    return Model(languages, idf, w[:-1], w[-1])


def fit_temperature(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> float:
    """The temperature of least log loss on held-back rows, by golden section on its logarithm."""
    if not rows:
        return 1.0
    logits = np.array([model.logits(at, values) for _, at, values in rows])
    labels = np.array([label for label, _, _ in rows])

    def loss(log_t: float) -> float:
        p = softmax(logits / math.exp(log_t))[np.arange(len(rows)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, ratio = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def document_frequencies(rows: DataFrame, text: str, features: int = FEATURES) -> tuple[int, np.ndarray]:
    """Number of rows, and of rows with each slot: counted by partition, summed by slot."""
    def count(batches):
        seen, total = np.zeros(features, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                at, _ = term_counts(t, features)
                seen[at] += 1
                total += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"slot": np.append(at, -1), "n": np.append(seen[at], total)})

    sums = rows.select(text).mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(features, np.int64), 0
    for slot, n in sums:            # at most `features` + 1 rows
        if slot < 0:
            total = n
        else:
            out[slot] = n
    return total, out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", features: int = FEATURES,
          per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model:
    """A model of the labelled rows. Rows with null lang or text teach nothing.

    More than `most_languages` values of lang are refused: they are no languages.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"))
    # by the text's hash: which texts are taken doesn't depend on their order, and copies are one
    rows = rows.withColumn("draw", F.xxhash64(F.lit("langid"), "text"))
    first = Window.partitionBy("lang").orderBy("draw")
    cuts = (rows.select("lang", "draw").distinct().withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_language)
            .groupBy("lang").agg(F.max("draw").alias("cut")).orderBy("lang").limit(most_languages + 1).collect())
    if len(cuts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    languages = sorted(r["lang"] for r in cuts)
    if not languages:
        return Model([], np.zeros(features), np.zeros((features, 0)), np.zeros(0))
    total, seen = document_frequencies(rows, "text", features)
    idf = np.log((1 + total) / (1 + seen)) + 1
    last = F.create_map(*[F.lit(x) for r in cuts for x in (r["lang"], r["cut"])])
    shared = labelled.sparkSession.sparkContext.broadcast(idf)

    def featurise(batches):
        done = set()            # texts of the sample
        for batch in batches:
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("draw").to_pylist()))
            new = [i for i, k in enumerate(keys) if not (k in done or done.add(k))]
            made = [vector(batch.column("text")[i].as_py(), shared.value) for i in new]
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i][0] for i in new], pa.string()), pa.array([keys[i][1] for i in new], pa.int64()),
                 pa.array([a.astype(np.int32) for a, _ in made], pa.list_(pa.int32())), pa.array([v for _, v in made], pa.list_(pa.float64()))],
                names=["lang", "draw", "at", "v"])

    sample = (rows.where(F.col("draw") <= last[F.col("lang")])
              .mapInArrow(featurise, "lang string, draw bigint, at array<int>, v array<double>").dropDuplicates(["lang", "draw"]).toArrow())
    where = {x: i for i, x in enumerate(languages)}
    sample = sample.combine_chunks()
    ats, values = (sample[c].chunk(0) if sample.num_rows else None for c in ("at", "v"))
    order = sorted(range(sample.num_rows), key=list(zip(sample["draw"].to_pylist(), sample["lang"].to_pylist())).__getitem__)
    langs = sample["lang"].to_pylist()
    data = [(where[langs[i]], ats[i].values.to_numpy().astype(np.int64), values[i].values.to_numpy()) for i in order]
    data = [r for r in data if len(r[1])]
    # every fifth row of a language is held back for the temperature, never its first
    place, kept, back = [0] * len(languages), [], []
    for r in data:
        place[r[0]] += 1
        (kept if place[r[0]] % 5 else back).append(r)
    model = fit_weights(kept, languages, idf)
    model.temperature = fit_temperature(model, back)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The documents' columns and lang_pred, score: a learned language and its calibrated probability.

    A null text, or one without a letter, is `und` with score 0, as is every text if nothing was
    learned. Equal probabilities go to the language that sorts first. Rows are judged one by one;
    a result replaces an input column of its name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    raw = free_name(docs, "text")

    def judge(batch):
        made = [shared.value.predict(t) for t in batch.column(raw).to_pylist()]
        return {lang_pred: [m[0] for m in made], score: [m[1] for m in made]}

    return add_columns(docs.withColumn(raw, F.col(text)), judge, [(lang_pred, "string"), (score, "double")], [raw])


def held_out(doc_id: str = "doc_id"):
    """True for the third of the documents that teach nothing."""
    return crc_remainder(F.col(doc_id), 3) == 1


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """Trains on the labelled documents that are not held out, then predicts all documents."""
    model = train(docs.where(~held_out(doc_id)), text, lang, **options)
    return predict(docs, model, text)


def keep_identified(docs: DataFrame, least_score: float = 0.5, **options) -> DataFrame:
    """Only documents whose language is determined with at least that probability; own columns only."""
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    model = train(docs.where(~held_out(options.pop("doc_id", "doc_id"))), **options)
    judged = predict(docs, model, options.get("text", "text"), pred, score)
    return judged.where((F.col(pred) != UNDETERMINED) & (F.col(score) >= least_score)).select(*docs.columns)

"""Quality classifier: cumulative-link regression on ordered grades.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its
scale: P(grade <= k) = sigmoid(threshold_k - w.x). From that follow the expected grade and the
tail probability of a grade or better, on which documents are selected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.llm import textvec as V
from cuelake.llm.workdir import bounded_batches

#: Hashed features: words take most of the table, shapes of the text its first places.
BITS, SHAPES, STEPS = 19, 8, 32
#: Bytes of a word's stem, which is a feature of its own.
PREFIX = 5
RESULT = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())])
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct features of each text, and offsets; a text without a word has none.

    Words are runs of letters, digits and non-ASCII bytes, capitals made small; their stems and the
    runs of other signs are features too. Shapes are shares
    of capitals, digits, other signs, spaces, repeated words and repeated word pairs, mean word
    length and text length, each cut into steps.
    """
    data, offsets = V.utf8(column)
    rows = len(offsets) - 1
    small = V.lower_ascii(np.where(_LETTER[data], data, 32).astype(np.uint8))
    start, end, row = V.word_bounds(small, offsets)
    words = V.span_hashes(small, start, end)
    count = np.bincount(row, minlength=rows)
    long = np.flatnonzero(end - start > PREFIX)
    stems = V.mix(V.span_hashes(small, start[long], start[long] + PREFIX) ^ np.uint64(1))
    signs = np.where(_LETTER[data] | (data < 33), 32, data).astype(np.uint8)
    sign_start, sign_end, sign_row = V.word_bounds(signs, offsets)
    marks = V.mix(V.span_hashes(signs, sign_start, sign_end) ^ np.uint64(2))
    every, every_row = np.concatenate((words, stems, marks)), np.concatenate((row, row[long], sign_row))
    place = (every >> np.uint64(64 - BITS)).astype(np.int64)
    place = np.where(place < SHAPES * STEPS, place + SHAPES * STEPS, place)
    worded = count[every_row] > 0
    place, every_row = place[worded], every_row[worded]

    def share(of: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(of)))
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(1, np.diff(offsets))

    distinct, bounds = V.distinct_by_row(words, row, rows)
    pairs, at = V.shingle_hashes(words, row, rows, 2)
    pair_bounds = V.distinct_by_row(pairs, at, rows)[1]
    each = np.maximum(1, count)
    shapes = [
        share((data >= 65) & (data <= 90)), share((data >= 48) & (data <= 57)), share(~_LETTER[data] & (data > 32)), share(data <= 32),
        1 - np.diff(bounds) / each, np.minimum(1, 1 - np.diff(pair_bounds) / np.maximum(1, np.bincount(at, minlength=rows))),
        np.minimum(1, np.bincount(row, end - start, rows) / each / 20), np.minimum(1, np.log1p(count) / 16),
    ]
    shape_place = np.stack([np.minimum(STEPS - 1, (s * STEPS).astype(np.int64)) + i * STEPS for i, s in enumerate(shapes)], axis=1)
    has = np.flatnonzero(count)
    all_rows = np.concatenate((every_row, np.repeat(has, SHAPES)))
    all_places = np.concatenate((place, shape_place[has].reshape(-1)))
    out, o = V.distinct_by_row(all_places.astype(np.uint64), all_rows, rows)
    return out.astype(np.int64), o


@dataclass
class Model:
    """Weights and rising thresholds; grades run from 0 to the number of thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade > k) of each text and threshold; 0 without features."""
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        score = np.bincount(row, self.weights[places], len(offsets) - 1)
        p = 1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -60, 60)))
        return np.where(np.diff(offsets)[:, None] > 0, p, 0.0)


def slopes(score: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """P(y) of each row, and the derivatives of -log P(y) by the score, by the threshold below y and by that above (of the opposite sign).

    ``theta`` has -inf and inf at its ends, so those of grade 0 below and of the last above are 0.
    """
    low, high = (1 / (1 + np.exp(-np.clip(theta[y + k] - score, -60, 60))) for k in (0, 1))
    p = np.maximum(high - low, 1e-9)
    d_low, d_high = low * (1 - low) / p, high * (1 - high) / p
    return p, d_high - d_low, d_low, d_high


def fit(places: list[np.ndarray], grades: np.ndarray, *, grades_count: int, steps: int = 800, batch_rows: int = 128, rate: float = 0.1, decay: float = 1e-3, least_share: float = 1 / 600, seed: int = 7) -> Model:
    """Maximum likelihood by AdaGrad on batches in a fixed order; ``decay`` pulls weights to 0.

    Features of fewer than two texts, or of a share of texts below ``least_share``, say nothing
    about other texts and get no weight. All texts are seen as often as ``steps`` batches take.
    """
    seen = np.bincount(np.concatenate(places), minlength=1 << BITS) if places else np.zeros(1 << BITS, np.int64)
    places = [p[seen[p] >= max(2, least_share * len(places))] for p in places]
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    k = grades_count - 1
    share = np.cumsum(np.bincount(grades, minlength=grades_count)) / max(1, len(grades))
    start = np.log((share[:-1] + 1e-3) / (1 - share[:-1] + 1e-3))
    first, gaps = start[0], np.log(np.maximum(np.diff(start), 0.1))
    t2, n, rng = np.full(k, 1e-8), len(grades), np.random.default_rng(seed)
    sizes = np.array([len(p) for p in places], np.int64)
    flat, offsets = np.concatenate(places) if n else np.zeros(0, np.int64), np.concatenate(([0], np.cumsum(sizes)))
    batches = max(1, n // batch_rows)
    for _ in range(-(-steps // batches) if n else 0):
        for batch in np.array_split(rng.permutation(n), batches):
            at = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in batch]) if len(batch) else np.zeros(0, np.int64)
            x, row = flat[at], np.repeat(np.arange(len(batch)), sizes[batch])
            score = np.bincount(row, w[x], len(batch))
            theta = np.concatenate(([-np.inf], first + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))), [np.inf]))
            y = grades[batch]
            _, d_score, d_low, d_high = slopes(score, y, theta)
            grad = np.bincount(x, d_score[row], 1 << BITS) / max(1, len(batch))
            hit = np.unique(x)
            grad = grad[hit] + decay * w[hit]
            g2[hit] += grad * grad
            w[hit] -= rate * grad / np.sqrt(g2[hit])
            d_theta = np.bincount(y, d_low, grades_count + 1)[1 : k + 1] - np.bincount(y + 1, d_high, grades_count + 1)[1 : k + 1]
            d_free = np.cumsum(d_theta[::-1])[::-1] / max(1, len(batch))
            d_free[1:] *= np.exp(gaps)
            t2 += d_free * d_free
            step = rate * d_free / np.sqrt(t2)
            first, gaps = first - step[0], gaps - step[1:]
    return Model(w.astype(np.float32), first + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))))


def train(docs: DataFrame, ratings: DataFrame, *, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", grades_count: int = 3, most_rows: int = 20_000) -> Model:
    """Fit on about ``most_rows`` rated documents at most: those whose hashed id is below a share of the range.

    Ratings that are null or out of range, and documents without an id or a word, teach nothing.
    The bound holds at every size of the table; what the driver gets are feature places only.
    """
    bounded_batches(docs.sparkSession)
    rated = ratings.select(F.col(doc_id).alias("id"), F.col(grade).cast("int").alias("grade")).where(F.col("id").isNotNull() & F.col("grade").between(0, grades_count - 1)).distinct()
    n = rated.count()
    share = min(1.0, most_rows / max(1, n))
    picked = rated.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col("id").alias("rated_id"), "grade")

    def run(batches):
        for batch in batches:
            for part in V.slices(batch, "text"):
                p, o = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("grade"), pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(p.astype(np.int32)))], ["id", "grade", "places"])

    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    rows = texts.join(F.broadcast(picked), F.col("id") == F.col("rated_id")).select(F.col("id").cast("long").alias("id"), "grade", "text").mapInArrow(run, "id long, grade int, places array<int>")
    table = rows.where(F.size("places") > 0).toArrow().sort_by("id")
    places = [np.asarray(x.values, np.int64) for x in table.column("places")]
    return fit(places, table.column("grade").to_numpy().astype(np.int64), grades_count=grades_count)


def grade_texts(spark: SparkSession, model: Model, text: str | Column, *, least_grade: int) -> Column:
    """struct(expected_grade, tail_probability) of whole texts; the tail is that of ``least_grade`` or better."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def run(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        tails = [shared.value.tails(*features(part.column("text"))) for part in V.slices(batch, "text")]
        p = np.concatenate(tails) if tails else np.zeros((0, 1))
        return pa.StructArray.from_arrays([pa.array(p.sum(axis=1)), pa.array(p[:, least_grade - 1])], ["expected_grade", "tail_probability"])

    return run((F.col(text) if isinstance(text, str) else text).cast("string"))


def grade_documents(docs: DataFrame, ratings: DataFrame, *, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", grades_count: int = 3, least_grade: int = 2, least_probability: float = 0.6) -> DataFrame:
    """``docs`` with expected_grade, tail_probability and kept (columns of these names are replaced).

    Every row gets one result, repeated rows equal ones. Null and empty texts, and texts without a
    word, have grade 0 and are not kept. Without usable ratings nothing is known and every weight
    is 0. An empty table gives an empty result.
    """
    model = train(docs, ratings, doc_id=doc_id, text=text, grade=grade, grades_count=grades_count)
    new = ("expected_grade", "tail_probability", "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    judged = docs.select(row.alias("row"), grade_texts(docs.sparkSession, model, text, least_grade=least_grade).alias("judged"))
    return judged.select("row.*", "judged.expected_grade", "judged.tail_probability", (F.col("judged.tail_probability") >= least_probability).alias("kept"))

"""Quality classifier by co-training.

Two logistic models see different views of a document: its text's content (surface counts, and how often its
words fall in each of 256 hash buckets, all words of the text), and its page's metadata (source, language,
length, shape of the lines). In each round both models, calibrated on held-out labelled
rows, score all unlabelled documents; the ones that a model is most sure of, per class, become labelled
examples of the other model. Documents that are equal in both views are one example, given once, however
many copies there are. At the end the calibrated views are combined by a logistic model fitted on the
held-out rows, and every document is scored.

The models are fitted in the driver on a bounded sample: the `sample` labelled rows with the smallest hash
of their key, a fifth of them held out, and at most 4 * rounds * exchange pseudo-labelled rows. Features
and scores are computed for all documents, whole texts, in one pass over the text; the feature table is
written once. Source rates, the metadata view's feature, are grouped aggregates over all labelled rows
of the training part, shrunk to the overall rate.

A round is one pass over the examples: each task keeps the surest of its rows for both views and classes.

Very long texts are used whole; an empty table gives no rows. Other columns of the inputs, whatever their names,
are not read. Null and empty texts have the features of an empty text. Null metadata is a value of its own. Without
labelled rows of both classes every score is the labelled share of good rows (0.5 without labels).
Repeated rows repeat; labels of a key that disagree count by their mean, rounded up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.session import prepare, widened, written

LETTERS = re.compile(r"[^\W\d_]+")
TEXT_FEATURES = "log_words word_length distinct repeated upper letters symbols digits spaced_bar bang vowels type_ratio top_share hapax".split()
BUCKETS = 256  # of hashed words; a byte each
WORD_RIDGE = 20.0  # their penalty: they are many, and labels may be few
META_FEATURES = "log_chars log_lines line_length short_lines source_rate declared_rate".split()


class Buckets(dict):
    """Buckets of words without case; forgets all when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        return h


BUCKET_OF = Buckets()


def word_features(text: str) -> bytes:
    """Square roots of the shares of words in each bucket, in steps of 1/255."""
    words = text.split()
    n = np.bincount(np.fromiter(map(BUCKET_OF.__getitem__, words), np.int64, len(words)), minlength=BUCKETS)
    return np.rint(255 * np.sqrt(n / max(1, len(words)))).astype(np.uint8).tobytes()


def matrix(columns: list[list]) -> np.ndarray:
    """A view's columns side by side: arrays of numbers, and bytes."""
    parts = [np.frombuffer(b"".join(c), np.uint8).reshape(len(c), -1) / 255 if isinstance(c[0], bytes) else np.array(c, float) for c in columns]
    return np.hstack(parts)


def text_features(text: str) -> list[float]:
    """The content view, in the order of TEXT_FEATURES."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(TEXT_FEATURES)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeated = sum(a == b for a, b in zip(words, words[1:]))
    letters = sum(map(len, LETTERS.findall(text)))
    ascii_upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    solid = max(1, chars - n + 1)
    symbols = sum(map(text.count, "#$%&*@^~=+|<>{}[]\\_"))
    return [
        np.log1p(n),
        sum(map(len, words)) / n / 10,
        len(counts) / n,
        repeated / n,
        ascii_upper / solid,
        letters / solid,
        symbols / solid,
        sum(map(text.count, "0123456789")) / solid,
        text.count(" | ") / n,
        text.count("!") / n,
        sum(map(text.lower().count, "aeiou")) / solid,
        np.log1p(len(counts)) / np.log1p(n),
        max(counts.values()) / n,
        sum(c == 1 for c in counts.values()) / n,
    ]


def shape_features(text: str) -> list[float]:
    """The part of the metadata view that page sizes give."""
    lines = text.split("\n")
    return [np.log1p(len(text)), np.log1p(len(lines)), np.log1p(len(text) / len(lines)), sum(len(x) < 40 for x in lines) / len(lines)]


class Logistic:
    """Ridge logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float | np.ndarray = 1.0):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)])
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], 1e-3)
        penalty[1:] = ridge
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[1:]


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


class Calibrated:
    """A view's model with Platt scaling from held-out rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, held_y: np.ndarray, ridge: float | np.ndarray = 1.0):
        self.model = Logistic(x, y, ridge)
        self.platt = Logistic(self.model.logit(held)[:, None], held_y, 1e-2)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.platt.logit(self.model.logit(x)[:, None])


def features(docs: DataFrame, text: str) -> DataFrame:
    """Append __content and __shape, arrays of doubles, and __words, bytes; the text is dropped."""
    kept = [c for c in docs.columns if c != text]
    schema = widened(docs.select(*kept), "__content array<double>, __shape array<double>, __words binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                texts = [t or "" for t in b.column(len(kept)).to_pylist()]
                made = [pa.array([f(t) for t in texts], pa.list_(pa.float64())) for f in (text_features, shape_features)]
                words = pa.array(map(word_features, texts), pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *made, words], names=schema.names)

    return docs.select(*kept, text).mapInArrow(run, schema)


def view_scores(table: DataFrame, views: list[tuple[list[str], Calibrated]]) -> DataFrame:
    """Append a score column (calibrated logit) for each (columns of a view, model)."""
    schema = widened(table, ", ".join(f"__view{i} double" for i in range(len(views))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = []
                for columns, model in views:
                    x = matrix([b.column(b.schema.get_field_index(c)).to_pylist() for c in columns])
                    out.append(pa.array(model.logit(x), pa.float64()))
                yield pa.RecordBatch.from_arrays([*b.columns, *out], names=schema.names)

    return table.mapInArrow(run, schema)


def surest(table: DataFrame, views: list[tuple[list[str], Calibrated]], every: list[str], exchange: int, least: float = 2.0) -> list[list]:
    """For each view and class (first the good) the examples that its model is surest of, as rows of `every`: one pass over the table.

    Each task keeps its own surest; those are compared in the end. Ties go to the smaller id."""
    schema = widened(table.select("__id", *every), "__end int, __score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table | None] = [None] * (2 * len(views))
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).select(["__id", *every])
            for i, (columns, model) in enumerate(views):
                score = model.logit(matrix([b.column(b.schema.get_field_index(c)).to_pylist() for c in columns]))
                for end, sign in ((2 * i, 1), (2 * i + 1, -1)):
                    sure = np.flatnonzero(sign * score > least)
                    if len(sure):
                        mine = t.take(pa.array(sure)).append_column("__end", pa.array(np.full(len(sure), end, np.int32))).append_column("__score", pa.array(sign * score[sure]))
                        mine = mine if held[end] is None else pa.concat_tables([held[end], mine])
                        held[end] = mine.sort_by([("__score", "descending"), ("__id", "ascending")]).slice(0, exchange).combine_chunks()
        for t in held:
            if t is not None:
                yield from t.to_batches()

    ends = written(table.select("__id", *every).mapInArrow(run, schema), "quality-surest")
    return [
        [[bytes(v) if isinstance(v, bytearray) else v for v in r] for r in ends.filter(F.col("__end") == end).orderBy(F.desc("__score"), "__id", *every).limit(exchange).select(*every).collect()]
        for end in range(2 * len(views))
    ]


def classify(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = ("source", "lang"), label: str = "quality", sample: int = 20_000, rounds: int = 3, exchange: int = 200, keep: float = 0.5
) -> DataFrame:
    """key, text_probability, page_probability, quality_probability and quality_kept for every row of docs."""
    spark = prepare(docs.sparkSession)
    truth = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.ceil(F.avg(label)).cast("double").alias("__label"))
    made = features(docs.select(F.col(key).alias("__id"), *[F.coalesce(F.col(m).cast("string"), F.lit("")).alias(f"__m{i}") for i, m in enumerate(metadata)], F.col(text).cast("string").alias("__t")), "__t")
    order = F.pmod(F.xxhash64("__id", F.lit(9)), F.lit(1 << 62))
    table = written(made.join(truth, F.col("__id") == F.col("__key"), "left").drop("__key").withColumn("__order", order).withColumn("__held", F.pmod("__order", F.lit(5)) == 0), "quality-features")

    rates = []
    train = table.filter("__label IS NOT NULL AND NOT __held")
    overall = train.agg(F.avg("__label").alias("p")).first()["p"]
    overall = 0.5 if overall is None else overall
    for i in range(len(metadata)):
        rate = train.groupBy(f"__m{i}").agg(F.sum("__label").alias("s"), F.count(F.lit(1)).alias("n"))
        rate = written(rate.select(f"__m{i}", ((F.col("s") + 20 * overall) / (F.col("n") + 20)).alias(f"__rate{i}")), f"quality-rates-{i}")
        table = table.join(rate, f"__m{i}", "left")
        rates.append(F.coalesce(F.col(f"__rate{i}"), F.lit(overall)))
    table = written(table.select("__id", "__label", "__order", "__held", "__content", "__words", F.concat("__shape", F.array(*rates)).alias("__page")), "quality-views")

    known = table.filter("__label IS NOT NULL")
    n = known.count()
    # about `sample` rows have a hash up to this; the few beyond are cut in the driver
    if n > sample:
        known = known.filter(F.col("__order") <= int((1 << 62) * (sample / n)))
    rows = known.select("__order", "__id", "__label", "__held", "__content", "__words", "__page").toPandas().sort_values(["__order", "__id"]).head(sample)
    y = rows["__label"].to_numpy(float)
    held = rows["__held"].to_numpy(bool)
    if min((y[m] == c).sum() for m in (held, ~held) for c in (0, 1)) == 0:
        flat = F.lit(float(y.mean()) if len(y) else 0.5)
        return table.select(F.col("__id").alias(key), flat.alias("text_probability"), flat.alias("page_probability"), flat.alias("quality_probability"), (flat >= keep).alias("quality_kept"))
    names = [["__content", "__words"], ["__page"]]
    every = [c for view in names for c in view]
    ridges = [np.append(np.ones(len(TEXT_FEATURES)), np.full(BUCKETS, WORD_RIDGE)), 1.0]
    views = [matrix([[bytes(v) if isinstance(v, bytearray) else v for v in rows[c]] for c in view]) for view in names]
    pool = [(v[~held], y[~held]) for v in views]
    # one row for each different example: copies neither fill the exchange nor come back in a later round
    examples = written(table.filter("__label IS NULL").groupBy(*every).agg(F.min("__id").alias("__id")), "quality-examples")
    fit = lambda: [Calibrated(x, t, v[held], y[held], r) for (x, t), v, r in zip(pool, views, ridges, strict=True)]
    models = fit()
    taken: list = []
    for _ in range(rounds):
        left = examples
        if taken:
            left = left.join(F.broadcast(spark.createDataFrame(taken, examples.select(*every).schema)), every, "left_anti")  # at most 4 * exchange rows a round
        given: list[list] = [[], []]
        for end, found in enumerate(surest(left, list(zip(names, models, strict=True)), every, exchange)):
            i, value = end // 2, 1.0 - end % 2
            for r in found:
                given[1 - i].append((matrix([[r[every.index(c)]] for c in names[1 - i]])[0], value))
                taken.append(tuple(r))
        for i in (0, 1):
            if given[i]:
                x, t = pool[i]
                pool[i] = (np.vstack([x, [g[0] for g in given[i]]]), np.append(t, [g[1] for g in given[i]]))
        models = fit()
    both = np.column_stack([m.logit(v) for m, v in zip(models, views, strict=True)])
    joint = Logistic(both[held], y[held], 1e-1)
    scored = view_scores(table, list(zip(names, models, strict=True)))
    z = sum((F.lit(float(joint.weights[i + 1])) * F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col(f"__view{i}") - float(joint.mean[i])) / float(joint.scale[i]))) for i in (0, 1)), F.lit(float(joint.weights[0])))
    p = lambda c: F.round(1.0 / (1.0 + F.exp(-c)), 9)
    return scored.select(
        F.col("__id").alias(key), p(F.col("__view0")).alias("text_probability"), p(F.col("__view1")).alias("page_probability"), p(z).alias("quality_probability"), (p(z) >= keep).alias("quality_kept")
    )

"""Language identification by Bayesian evidence fusion.

log posterior(language) = text + declared + prior, where
- text is the log likelihood of the text's hashed byte trigrams under a smoothed model of each language
  (a flat model stands for every other language), tempered to at most `evidence` trigrams, since
  neighbouring trigrams are not independent;
- declared is the likelihood of the declared markup language (the reliability of declarations is a parameter);
- prior is hierarchically smoothed: all rows, then the address suffix, then the host, each level shrunk
  towards the one above it by `strength` pseudo-counts. Counts are grouped aggregates of the decisions from
  text and declaration alone, and a row's own decision is taken out of its host's counts.

A row is rejected (language "und") if the best language is the flat one, its posterior is under
`threshold`, or the text has no letter. Null and empty texts, and those of white space, are rejected.
Null declarations, hosts and suffixes give no evidence. Every row gives one row; repeated rows repeat; an empty
table gives none. Ties go to the first language. Texts are used whole, whatever their length. Other columns pass
through; names that begin with two underscores are reserved.

The text model is fitted on a bounded sample of declared rows: per language the `sample` rows with the
smallest hash, whole texts. Everything else covers all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintel.session import prepare, widened, written

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 1 << 13
LOWER = np.arange(256, dtype=np.uint32)
LOWER[65:91] += 32


def trigrams(data: np.ndarray) -> np.ndarray:
    """Buckets of the byte trigrams of lower-cased UTF-8 bytes, one for each start."""
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    x = LOWER[data]
    code = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)
    return (code ^ code >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - 13)


def text_model(docs: DataFrame, text: str, declared: str, key: str, languages: tuple[str, ...], sample: int) -> np.ndarray:
    """Log probabilities (BUCKETS, languages + 1); the last column is flat."""
    known = docs.filter(F.col(declared).isin(*languages)).select(F.col(key).alias("__k"), F.col(declared).alias("__d"))
    hashed = known.withColumn("__h", F.pmod(F.xxhash64(F.col("__k").cast("string"), F.lit(4)), F.lit(1 << 62)))
    # about `sample` rows of a language have a hash up to its bound, so the window sees few rows
    bound = F.lit(0)
    for r in known.groupBy("__d").count().collect():  # a row a language
        bound = F.when(F.col("__d") == r["__d"], int((1 << 62) * min(1.0, 1.2 * sample / r["count"]))).otherwise(bound)
    order = Window.partitionBy("__d").orderBy("__h", "__k")
    chosen = hashed.filter(F.col("__h") <= bound).withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= sample).select("__k")
    texts = docs.join(F.broadcast(chosen), F.col(key) == F.col("__k"), "left_semi").filter(F.col(declared).isin(*languages)).select(declared, text)  # at most sample ids a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {x: np.zeros(BUCKETS, np.int64) for x in languages}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[lang] += np.bincount(trigrams(np.frombuffer((t or "").encode(), np.uint8)), minlength=BUCKETS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    counts = np.full((BUCKETS, len(languages) + 1), 0.5)
    for r in texts.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS a language at most
        counts[r["bucket"], languages.index(r["lang"])] += r["n"]
    counts[:, -1] = 1.0
    return np.log(counts / counts.sum(0)).astype(np.float32)


def likelihoods(docs: DataFrame, text: str, model: np.ndarray, evidence: int) -> DataFrame:
    """Append __text array<double>, one entry a language and the flat model, and __letters boolean."""
    kept = docs.columns
    schema = widened(docs, "__text array<double>, __letters boolean")
    here = kept.index(text)
    columns = [np.ascontiguousarray(model[:, i]) for i in range(model.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                out, letters = [], []
                for t in b.column(here).to_pylist():
                    t = t or ""
                    grams = trigrams(np.frombuffer(t.encode(), np.uint8))
                    n = max(1, len(grams))
                    out.append([float(c[grams].sum(dtype=np.float64)) / n * min(n, evidence) for c in columns])
                    letters.append(any(map(str.isalpha, t)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64())), pa.array(letters, pa.bool_())], names=schema.names)

    return docs.mapInArrow(run, schema)


def best(scores: Column, languages: tuple[str, ...]) -> Column:
    """The language of the largest score; ties to the first."""
    names = F.array(*[F.lit(x) for x in (*languages, "und")])
    return F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))


def declared_scores(declared: Column, languages: tuple[str, ...], reliability: float) -> Column:
    primary = F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})", 1))
    wrong = math.log((1 - reliability) / len(languages))
    known = primary.isin(*languages)
    one = lambda x: F.when(~known | primary.isNull(), F.lit(0.0)).when(primary == x, F.lit(math.log(reliability))).otherwise(F.lit(wrong))
    return F.array(*[one(x) for x in languages], F.when(known, F.lit(wrong)).otherwise(F.lit(0.0)))


def address_suffix(host: Column) -> Column:
    """The last label of a host name, where it has several."""
    return F.when(host.contains("."), F.lower(F.substring_index(host, ".", -1)))


def identify(
    df: DataFrame,
    key: str,
    text: str = "text",
    declared: str = "declared",
    host: str = "host",
    languages: tuple[str, ...] = LANGUAGES,
    sample: int = 500,
    evidence: int = 400,
    reliability: float = 0.9,
    strength: float = 20.0,
    threshold: float = 0.6,
) -> DataFrame:
    """Append language, language_posterior and language_kept; columns of these names are replaced."""
    prepare(df.sparkSession)
    new = ("language", "language_posterior", "language_kept")
    base = [c for c in df.columns if c not in new]
    docs = df.select(*base)
    model = text_model(docs, text, declared, key, languages, sample)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)

    def decided(rows: DataFrame) -> DataFrame:
        scored = likelihoods(rows, text, model, evidence)
        return scored.withColumn("__scores", plus(F.col("__text"), declared_scores(F.col(declared), languages, reliability))).withColumn("__first", best(F.col("__scores"), languages))

    names = [*languages, "und"]
    narrow = decided(docs.select(text, F.col(declared), F.col(host)))
    counts = narrow.groupBy(F.col(host).alias("host")).agg(*[F.count_if(F.col("__first") == x).cast("double").alias(f"n_{x}") for x in names])
    counts = written(counts, "host-languages")
    total = counts.agg(*[F.sum(f"n_{x}").alias(f"t_{x}") for x in names]).first()
    everything = sum((total[f"t_{x}"] or 0.0) for x in names)
    # a flat pseudo-count for each language keeps the top of the hierarchy off zero
    top = {x: ((total[f"t_{x}"] or 0.0) + 1.0) / (everything + len(names)) for x in names}
    suffixes = counts.groupBy(address_suffix(F.col("host")).alias("suffix")).agg(*[F.sum(f"n_{x}").alias(f"s_{x}") for x in names])
    all_of = lambda p: sum((F.col(f"{p}_{x}") for x in names[1:]), F.col(f"{p}_{names[0]}"))
    suffixes = suffixes.filter("suffix IS NOT NULL").select("suffix", *[((F.col(f"s_{x}") + strength * top[x]) / (all_of("s") + strength)).alias(f"p_{x}") for x in names])
    hosts = counts.filter("host IS NOT NULL").withColumn("suffix", address_suffix(F.col("host"))).join(suffixes, "suffix", "left")
    parent = [F.coalesce(F.col(f"p_{x}"), F.lit(top[x])) for x in names]
    hosts = hosts.select(F.col("host").alias("__host"), F.array(*[F.col(f"n_{x}") for x in names]).alias("__n"), F.array(*parent).alias("__parent"))
    hosts = written(hosts, "host-priors")

    own = F.array(*[F.when(F.col("__first") == x, 1.0).otherwise(0.0) for x in names])
    counted = F.zip_with("__n", own, lambda n, o: F.greatest(n - o, F.lit(0.0)))
    size = F.aggregate(counted, F.lit(0.0), lambda a, x: a + x)
    prior = F.when(F.col("__n").isNull(), F.array(*[F.lit(math.log(top[x])) for x in names])).otherwise(
        F.zip_with(counted, "__parent", lambda n, p: F.log((n + strength * p) / (size + strength)))
    )
    joined = decided(docs).join(hosts, F.col(host) == F.col("__host"), "left").withColumn("__all", plus(F.col("__scores"), prior))
    peak = F.array_max("__all")
    posterior = 1.0 / F.aggregate("__all", F.lit(0.0), lambda a, x: a + F.exp(x - peak))
    found = best(F.col("__all"), languages)
    kept = F.col("__letters") & (found != "und") & (posterior >= threshold)
    return joined.select(*base, F.when(kept, found).otherwise("und").alias("language"), F.round(posterior, 9).alias("language_posterior"), kept.alias("language_kept"))

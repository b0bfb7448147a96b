"""Phrase collocations: phrases whose words occur together more often than their parts explain.

Texts are split into pieces at punctuation and line ends, and equal pieces of a language become one row with a
multiplicity, so copies and boilerplate are counted once. Runs of up to `words` words of a piece are n-grams, each
weighted by its piece's multiplicity. A task adds them up over its pieces, cuts them by a hash into buckets and sends
a packed row a bucket; each bucket's n-grams are counted by duckdb, which streams them in and writes to disk what doesn't fit
(a scratch folder of the task's own, gone when the bucket is done). Only n-grams that occur often enough leave the
bucket: a phrase's parts occur at least as often as the phrase.

Candidates send a request for each of their parts to where the part's count is, and get it back by a join, so counts
never meet in one place. Scores are integers, computed exactly in decimals of 38 digits.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.session import discard, prepare, written

CHUNK = 6 << 20  # bytes of pieces whose n-grams are added up at once
BUCKET = 256 << 20  # bytes of n-grams in a bucket, about
KINDS = pa.schema({"lang": pa.string(), "gram": pa.string(), "words": pa.int32(), "n": pa.int64()})
MEMORY = "192MB"  # of duckdb in a task; beyond it, disk


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def chunks(batches: Iterator[pa.RecordBatch], name: str, limit: int) -> Iterator[pa.Table]:
    """Rows whose strings hold about so many bytes, at most two batches' worth; one string may be longer."""
    waiting, size = [], 0
    for batch in batches:
        total = np.cumsum(pc.add(pc.binary_length(column(batch, name)), 1).to_numpy().astype(np.int64))
        start = 0
        while start < len(total):
            end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + limit - size, side="right")))
            waiting.append(batch.slice(start, end - start))
            size += int(total[end - 1] - (total[start - 1] if start else 0))
            start = end
            if size >= limit:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting, size = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, n): distinct pieces with words of (lang, text) rows and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, "text", CHUNK):
            split = pc.split_pattern_regex(pc.ascii_lower(t["text"].chunk(0)), "[.,;:!?\\x0A-\\x0D]+")
            flat = pc.utf8_trim(split.flatten(), " \t")
            lang = t["lang"].chunk(0).take(pc.list_parent_indices(split))
            some = pa.table({"lang": lang, "piece": flat}).filter(pc.not_equal(flat, ""))
            made = some.group_by(["lang", "piece"]).aggregate([([], "count_all")])
            yield from made.rename_columns(["lang", "piece", "n"]).to_batches()

    return docs.mapInArrow(run, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their weights' sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(weights[order], heads) if len(keys) else weights


def grams(t: pa.Table, most: int, buckets: int) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]]:
    """(buckets, langs, n-grams, counts) for n = 1 .. most, added up over the pieces."""
    split = pc.split_pattern_regex(t["piece"].chunk(0), "[ \\t]+")
    owner = pc.list_parent_indices(split).to_numpy().astype(np.int64)
    langs = t["lang"].chunk(0).dictionary_encode()
    coded = split.flatten().dictionary_encode()
    words, code, weight = coded.dictionary, coded.indices.to_numpy().astype(np.int64), t["n"].to_numpy()[owner]
    lang, names = langs.indices.to_numpy().astype(np.int64)[owner], langs.dictionary
    mixed = np.array([zlib.crc32(w.encode()) for w in words.to_pylist()], np.uint64)
    salt = np.array([zlib.crc32(x.encode()) for x in names.to_pylist()], np.uint64)
    key, first = code * len(names) + lang, np.arange(len(code))  # of the run that starts here; keys of longer runs are renumbered
    text, mix = None, None
    for n in range(1, most + 1):
        if n > 1:
            ends = first + n - 1
            whole = ends < len(code)
            whole[whole] = owner[ends[whole]] == owner[first[whole]]
            key, first = key[whole], first[whole]
            key = np.unique(key, return_inverse=True)[1] * len(words) + code[first + n - 1]
        if not len(key):
            return
        found, count = sums(key, weight[first])
        sample = np.empty(len(found), np.int64)
        sample[np.searchsorted(found, key)] = first  # a place of each distinct run
        text, mix = words.take(pa.array(code[sample])), mixed[code[sample]] + salt[lang[sample]]
        for k in range(1, n):
            text = pc.binary_join_element_wise(text, words.take(pa.array(code[sample + k])), " ")
            mix = mix * np.uint64(0x9E3779B97F4A7C15) + mixed[code[sample + k]]
        mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        yield ((mix >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), names.take(pa.array(lang[sample])), text, count


def pack(text: bytes, numbers: np.ndarray) -> bytes:
    """N-grams, one a line, and numbers for each of them. Lines with a first word in common lie together, which packs well."""
    return len(text).to_bytes(8, "little") + pa.compress(text + numbers.T.astype("<i8").tobytes(), "zstd", asbytes=True)


def unpack(data: pa.Buffer, langs: list[str], words: int, n: int) -> pa.RecordBatch:
    size = int.from_bytes(data.slice(0, 8).to_pybytes(), "little")
    whole = pa.decompress(data.slice(8), size + 16 * n, "zstd")
    text = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, size], np.int32)), whole.slice(0, size))
    lang, count = np.frombuffer(whole, "<i8", 2 * n, size).reshape(2, n)
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(lang)), pc.split_pattern(text, "\n").flatten(), pa.array(np.full(n, words, np.int32)), pa.array(count)], schema=KINDS)


def sent(found: DataFrame, most: int, buckets: int) -> DataFrame:
    """A row a chunk and bucket: its n-grams of each length with their languages and counts, packed. One length is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, "piece", CHUNK):
            names = pc.unique(t["lang"]).to_pylist()
            rows: dict[int, tuple[list[int], list[int], list[bytes]]] = {}
            for words, (to, lang, text, count) in enumerate(grams(t, most, buckets), 1):
                order = np.argsort(to, kind="stable")
                heads = np.flatnonzero(np.diff(to[order], prepend=-1))
                ends = np.array([*heads[1:], len(to)])
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(heads, len(to)).astype(np.int32)), text.take(pa.array(order))), "\n")
                numbers = np.column_stack([pc.index_in(lang, value_set=pa.array(names, pa.string())).to_numpy(), count])[order]
                for bucket, x, i, j in zip(to[order][heads].tolist(), joined, heads, ends, strict=True):
                    row = rows.setdefault(bucket, ([], [], []))
                    for values, value in zip(row, (words, int(j - i), pack(x.as_buffer().to_pybytes(), numbers[i:j])), strict=True):
                        values.append(value)
            lists = [pa.array([r[k] for r in rows.values()], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array([names] * len(rows), pa.list_(pa.string())), *lists], names=["bucket", "langs", "words", "n", "data"])
            pa.default_memory_pool().release_unused()

    return found.mapInArrow(run, "bucket int, langs array<string>, words array<int>, n array<int>, data array<binary>")


def counted(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Counts of a task's buckets, streamed through duckdb: (lang, gram, words, n) of n-grams that occur often enough, and each language's words in all (gram null)."""
    import duckdb

    def rows() -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                langs, lengths, sizes = (column(b, c)[r].as_py() for c in ("langs", "words", "n"))
                for words, n, data in zip(lengths, sizes, column(b, "data")[r].values, strict=True):
                    yield unpack(data.as_buffer(), langs, words, n)

    with tempfile.TemporaryDirectory() as scratch, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch, "preserve_insertion_order": False}) as con:
        reader = pa.RecordBatchReader.from_batches(KINDS, rows())
        con.register("sent", reader)
        con.execute(f"CREATE TEMP TABLE counts AS SELECT lang, gram, words, sum(n)::BIGINT AS n FROM sent GROUP BY ALL HAVING sum(n) >= {least:d} OR words = 1")
        found = con.sql(f"SELECT * FROM counts WHERE n >= {least:d} UNION ALL SELECT lang, NULL, 0, sum(n)::BIGINT FROM counts WHERE words = 1 GROUP BY lang")
        yield from (b.cast(KINDS) for b in found.to_arrow_reader(65536))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly: the products have up to 38 digits."""
    a, left, right = (x.cast("decimal(16,0)") for x in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), left * right)


def by_parts(counts: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates with l, r and score of the cut that scores lowest; each part's count comes by a request to where it is."""
    cuts = found.select("lang", "gram", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    left = F.call_function("substring_index", F.col("gram"), F.lit(" "), F.col("k"))
    sides = F.array(F.struct(F.lit(True).alias("first"), left.alias("part")), F.struct(F.lit(False).alias("first"), F.substring("gram", F.length(left) + 2, F.length("gram")).alias("part")))
    requests = cuts.select("*", F.inline(sides))
    replies = requests.join(counts.select("lang", F.col("gram").alias("part"), "n"), ["lang", "part"])
    both = replies.groupBy("lang", "gram", "words", "a", "k").agg(F.max(F.when(F.col("first"), F.col("n"))).alias("l"), F.max(F.when(~F.col("first"), F.col("n"))).alias("r"))
    lowest = F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "gram", "words", "a").agg(lowest).select("lang", "gram", "words", "a", "cut.*")


def outside(found: DataFrame, inside: int) -> DataFrame:
    """Candidates of (lang, gram, words, n) that no longer candidate holds and nearly equals: 100 n(longer) < inside n."""
    split = F.split("gram", " ")
    held = found.filter("words > 2").select("lang", split.alias("w"), "words", F.col("n").alias("longer"))
    held = held.select("lang", "w", "words", "longer", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    held = held.select("lang", "longer", F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1), lambda i: F.array_join(F.slice("w", i, F.col("size")), " "))).alias("gram"))
    most = held.groupBy("lang", "gram").agg(F.max("longer").alias("longer"))
    return found.join(most, ["lang", "gram"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("n") * inside)).drop("longer")


def first_of(df: DataFrame, key: str, order: list[Column], top: int, parts: int) -> DataFrame:
    """The first rows of each key with their rank; a key's rows are ranked in parts before, so none meets whole in a task."""
    local = Window.partitionBy(key, F.pmod(F.xxhash64("gram"), F.lit(parts))).orderBy(*order)
    some = df.withColumn("rank", F.row_number().over(local)).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= top)


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = 3, least: int = 10, inside: int = 50, top: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases of 2 to `words` words that occur `least` times, best first.

    A-Z are lower-cased; pieces end at . , ; : ! ? and line ends, words at spaces and tabs. a: the phrase's occurrences;
    l, r: those of its parts at the cut with the lowest score, floor(1000000 a a / (l r)), ties to the first cut; n: all
    words of the language. A phrase that lies inside a longer one with at least `inside` percent of its occurrences is
    left out. Ranks go by score and a, both downward, then by the phrase's UTF-8 bytes; top None keeps all.
    Null languages are `und`; null and empty texts hold no words; a language without phrases has no rows, nor has an
    empty table. Repeated rows count each time. Other columns are left out, whatever their names. Pieces of any length
    are whole in one task; counts may have 15 digits."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] * words * (words + 1) // 2
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, size // BUCKET)
    packed = sent(pieces(rows), words, buckets).repartitionById(buckets, F.col("bucket"))
    counts = written(packed.mapInArrow(lambda batches: counted(batches, least), "lang string, gram string, words int, n long"), "counts")
    known = counts.filter("gram IS NOT NULL")
    candidates = known.filter("words > 1")
    scored = by_parts(known, outside(candidates, inside))
    order = [F.desc("score"), F.desc("a"), F.asc("gram")]
    best = first_of(scored, "lang", order, top, parts) if top is not None else scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    totals = counts.filter("gram IS NULL").groupBy("lang").agg(F.sum("n").alias("all"))
    result = best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("gram").alias("phrase"), "a", "l", "r", F.col("all").alias("n"), "score")
    done = written(result, "phrases")
    discard(counts)
    return done

"""Language-model scores from a subword lattice.

The vocabulary is an existing one; nothing is added to its pieces. A token is the space mark and a word; its
lattice has a node between any two characters and an arc for every piece that covers the characters between two
nodes. Characters have one more arc, their UTF-8 bytes as byte pieces, so every text has a probability. Each piece
has a unigram score (a natural log probability), and the forward recursion adds, in log space, the scores of all
segmentations at each node; the last node holds the token's marginal probability. Pieces never cross a word's
start, so a text's probability is the product of its tokens' and of the end's.

Scores start from the order of the vocabulary's own scores (1 / (rank + 1)) and are reestimated on the training
texts: the expected uses of a piece under all segmentations of their distinct tokens, plus the first score weighted
as `prior` uses. `rounds` says how often. Tokens of the training texts have one more arc, the token as a whole: of N
training tokens, c equal to this one and V distinct, that arc has the probability c / (N + V) and the paths of
pieces share V / (N + V), so a token's probability is (c + V * marginal) / (N + V). Pieces alone explain frequent
tokens badly: on these tables they lose a whole decimal place a token against add-one counts of words.

Texts of several languages differ most in their frequent words. With a column of classes, counts are kept for each
class too, a class's probability of a token is (c_k + V_k * p) / (N_k + V_k), p the one above, and a text's
probability sums over the classes, weighted by their training texts; a text's own class isn't looked at. Classes are
the `CLASSES` most frequent values that hold a hundredth of the training texts; all others make one more.

How it is spread out: texts are cut into blocks of bounded size; a block is a row with its distinct words, in the order
of their hashes, and, for each text, their places and counts, as compressed values. Buckets are ranges of hashes, so a block sends each of
them a run of its words (a packed row a block and bucket); a bucket adds up counts and scores each distinct word once;
the answers go back the same way. A frequent word is one entry
a block, so no word, text or source is hot. Only the vocabulary's scores (a row a piece) pass through the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lintel.llm.packing import by_key, packed, unpacked
from lintel.session import discard, prepare, written

MARK = "▁"
BLOCK = 4 << 20  # bytes of text in a block; one text may be longer
BUCKET = 400_000  # words sent to a bucket, about
CLASSES = 15
CHARS = 150_000  # characters whose lattices are in memory at once; one word may be longer
LITERAL = 0x110000  # stands for a space mark inside a word, which is no space


class Vocabulary:
    """The lattice's arcs: a trie over the pieces, as sorted keys of (node, character)."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = sp.get_piece_size()
        self.end = self.size  # the end of a text has an entry of its own
        pieces = [sp.id_to_piece(i) for i in range(self.size)]
        byte_ids = {int(pieces[i][1:-1], 16): i for i in range(self.size) if sp.is_byte(i)}
        if len(byte_ids) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.byte_ids = np.array([byte_ids[b] for b in range(256)])
        plain = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        plain = [i for i in plain if MARK not in pieces[i][1:]]  # no runs of spaces
        ranked = sorted(plain, key=lambda i: (-sp.get_score(i), i)) + list(self.byte_ids)
        first = np.zeros(self.size + 1)
        first[ranked] = 1 / (1 + np.arange(1, len(ranked) + 1))
        first[self.end] = first.max()
        self.first = first / first.sum()
        nodes: dict[tuple[int, int], int] = {}
        self.ends: list[int] = [-1]
        for i in plain:
            at = 0
            for c in pieces[i]:
                key = (at, ord(c))
                if key not in nodes:
                    nodes[key] = len(self.ends)
                    self.ends.append(-1)
                at = nodes[key]
            self.ends[at] = i
        made = sorted((node << 21 | c, to) for (node, c), to in nodes.items())
        self.keys, self.to = (np.array(x, np.int64) for x in zip(*made, strict=True))
        self.ends = np.array(self.ends, np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The trie's next nodes; 0 where there is none."""
        asked = nodes << 21 | chars
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, self.to[at], 0)


class Lattices:
    """The lattices of some words: arcs by the step of their end, then by their end."""

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        self.vocabulary = v = vocabulary
        self.words = len(words)
        chars = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        word_of = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(chars)) - starts[word_of]
        chars[(chars == ord(MARK)) & (place > 0)] = LITERAL
        left = sizes[word_of] - place  # characters from here to the word's end
        self.first = starts[:-1] + np.arange(len(words))  # a word has a node more than characters
        self.last = starts[1:] + np.arange(len(words))
        self.nodes = len(chars) + len(words)
        node_at = np.arange(len(chars)) + word_of
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        at, trie, length = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        while len(at):
            trie, length = v.step(trie, chars[at + length]), length + 1
            piece = v.ends[trie]
            whole = (trie > 0) & (piece >= 0)
            found.append((at[whole], piece[whole], length))
            going = (trie > 0) & (left[at] > length)
            at, trie = at[going], trie[going]
        self.kinds, kind = np.unique(chars, return_inverse=True)  # arcs of bytes, by character
        own = np.flatnonzero(place > 0)
        found.append((own, v.size + 1 + kind[own], 1))
        at = np.concatenate([a for a, _, _ in found])
        self.arc = np.concatenate([p for _, p, _ in found])
        span = np.concatenate([np.full(len(a), n, np.int64) for a, _, n in found])
        step = place[at] + span
        order = np.argsort(step * self.nodes + node_at[at] + span, kind="stable")
        self.arc, self.start, step = self.arc[order], node_at[at][order], step[order]
        self.to = self.start + span[order]
        self.cuts = np.flatnonzero(np.diff(step, prepend=0, append=-1))
        self.bytes = [list((MARK if c == LITERAL else chr(c)).encode("utf-8")) for c in self.kinds]

    def weights(self, scores: np.ndarray) -> np.ndarray:
        """Arcs' scores: pieces by id, then the characters' bytes."""
        of_byte = scores[self.vocabulary.byte_ids]
        return np.concatenate([scores, [sum(of_byte[b] for b in bs) for bs in self.bytes]])[self.arc]

    def forward(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log sum over the segmentations up to each node, the arcs' shares of their end's sum)."""
        alpha, weight = np.full(self.nodes, -np.inf), self.weights(scores)
        alpha[self.first] = 0
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            weight[a:b] += alpha[self.start[a:b]]
            heads = np.flatnonzero(np.diff(self.to[a:b], prepend=-1))
            alpha[self.to[a:b][heads]] = np.logaddexp.reduceat(weight[a:b], heads)
        with np.errstate(invalid="ignore"):
            return alpha, np.where(np.isinf(weight), 0, np.exp(weight - alpha[self.to]))

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        return self.forward(scores)[0][self.last]

    def expected(self, scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of so many copies of each word."""
        _, share = self.forward(scores)
        flow = np.zeros(self.nodes)
        flow[self.last] = counts
        for a, b in zip(self.cuts[-2::-1], self.cuts[:0:-1], strict=True):
            share[a:b] *= flow[self.to[a:b]]
            np.add.at(flow, self.start[a:b], share[a:b])
        size = self.vocabulary.size + 1
        uses = np.bincount(self.arc, share, size + len(self.kinds))
        for n, bs in zip(uses[size:], self.bytes, strict=True):
            for b in bs:
                uses[self.vocabulary.byte_ids[b]] += n
        return uses[:size]


def in_parts(vocabulary: Vocabulary, words: list[str]) -> Iterator[tuple[np.ndarray, Lattices]]:
    """(places, lattices) of some words at a time, words of like length together."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    upto, start = np.cumsum(sizes[order]), 0
    while start < len(order):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + CHARS, side="right")))
        yield order[start:end], Lattices(vocabulary, [words[i] for i in order[start:end]])
        start = end


VOCABULARIES: dict[int, Vocabulary] = {}


def vocabulary_of(model: bytes) -> Vocabulary:
    """One vocabulary for all tasks of a worker that need it."""
    if (key := zlib.crc32(model)) not in VOCABULARIES:
        VOCABULARIES[key] = Vocabulary(model)
    return VOCABULARIES[key]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words.to_pylist()), np.int64, len(words))


def block_of(ids: pa.Array, texts: pa.Array, held: pa.Array, kinds: pa.Array, classes: int) -> list[pa.Array]:
    """The columns of one block after its number, from its texts; kinds: their classes."""
    split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), "[\\x20\\x09-\\x0D]+")
    flat, owner = split.flatten(), pc.list_parent_indices(split).to_numpy().astype(np.int64)
    keep = pc.not_equal(flat, "")
    flat, owner = flat.filter(keep), owner[keep.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    n, words = len(texts), coded.dictionary
    order = np.argsort(hashes(words), kind="stable")
    words, place = words.take(pa.array(order)), np.empty(len(words), np.int64)
    place[order] = np.arange(len(order))
    key, ns = np.unique(owner * max(len(words), 1) + place[coded.indices.to_numpy()], return_counts=True)
    doc, code = np.divmod(key, max(len(words), 1))
    kept = ~held.to_numpy(zero_copy_only=False)
    train = np.bincount(code * classes + kinds.to_numpy()[doc], ns * kept[doc], len(words) * classes).astype(np.int64)
    of_texts = [ids, held, pa.array(np.bincount(owner, minlength=n) + 1, pa.int64()), pa.array(np.bincount(doc, minlength=n).astype(np.int32))]
    places = [pa.array(code.astype(np.int32)), pa.array(ns.astype(np.int32))]
    parts = with_counts(words, train.reshape(-1, classes)), pa.RecordBatch.from_arrays(of_texts, ["id", "held", "n_tokens", "size"]), pa.RecordBatch.from_arrays(places, ["code", "n"])
    return [pa.array([len(words)], pa.int32()), *[pa.array([packed(p)], pa.binary()) for p in parts]]


def cut_blocks(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    total = np.cumsum(pc.add(pc.fill_null(pc.binary_length(texts), 0), 1).to_numpy().astype(np.int64))
    start = 0
    while start < len(total):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + limit, side="right")))
        yield start, end
        start = end


def blocks(docs: DataFrame, limit: int, classes: int) -> DataFrame:
    """A row a block of (id, held, kind, text) rows: the number of its distinct words, and, packed, these words with their counts in training texts of each class (words), for each text its id, held, n_tokens and number of distinct words (texts), and these words' places and counts (places).

    A task has many blocks and Spark reads many rows at once, so a block's lists are compressed values, not arrays."""
    schema = "block long, n_words int, words binary, texts binary, places binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, waiting, size = TaskContext.get().partitionId() << 32, [], 0

        def emit() -> pa.RecordBatch:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            made = [pa.array([at]), *block_of(*(whole[n].chunk(0) for n in ("id", "text", "held", "kind")), classes)]
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_arrays(made, names=["block", "n_words", "words", "texts", "places"])

        for batch in batches:
            for a, b in cut_blocks(column(batch, "text"), limit):
                waiting.append(batch.slice(a, b - a))
                size += column(waiting[-1], "text").nbytes
                if size >= limit:
                    yield emit()
                    at, waiting, size = at + 1, [], 0
        if sum(b.num_rows for b in waiting):
            yield emit()

    return docs.mapInArrow(run, schema)


def with_counts(words: pa.Array, counts: np.ndarray, logs: np.ndarray | None = None) -> pa.RecordBatch:
    """Words with their counts by class, and their scores."""
    columns = {"word": words, **{f"n{k}": pa.array(counts[:, k]) for k in range(counts.shape[1])}, **({} if logs is None else {"log": pa.array(logs)})}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def counts_of(batch: pa.RecordBatch | pa.Table, classes: int) -> np.ndarray:
    return np.column_stack([batch.column(f"n{k}").to_numpy() for k in range(classes)]) if batch.num_rows else np.zeros((0, classes), np.int64)


def by_bucket(table: DataFrame, buckets: int) -> DataFrame:
    """A row a block and bucket: the place of the first of the block's words that the bucket counts, and the words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                words = unpacked(column(batch, "words")[r].as_buffer())
                keys, sizes, data = by_key(words, hashes(words.column("word")) * buckets >> 32)
                if len(keys):
                    made = [pa.array(keys.astype(np.int32)), pa.array(np.full(len(keys), column(batch, "block")[r].as_py())), pa.array((np.cumsum(sizes) - sizes).astype(np.int32)), pa.array(data, pa.binary())]
                    yield pa.RecordBatch.from_arrays(made, names=["bucket", "block", "first", "data"])

    return table.select("block", "words").mapInArrow(run, "bucket int, block long, first int, data binary")


def one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def added(key: tuple, batch: pa.Table, classes: int) -> pa.Table:
    """A bucket's distinct words, their counts in training texts of each class, and the sums and numbers of counts over 0 of each class and, last, of all."""
    sent = pa.Table.from_batches([unpacked(data.as_buffer()) for data in batch["data"]])
    sums = sent.group_by("word").aggregate([(f"n{k}", "sum") for k in range(classes)]).combine_chunks()
    by_class = np.column_stack([sums[f"n{k}_sum"].to_numpy() for k in range(classes)])
    both = np.column_stack([by_class, by_class.sum(1)])
    data = packed(with_counts(sums["word"].chunk(0), by_class))
    totals = one_list(pa.array(np.concatenate([both.sum(0), (both > 0).sum(0)])))
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([data], pa.binary()), totals], names=["bucket", "data", "totals"])


def reestimated(words: DataFrame, model: bytes, scores: np.ndarray, classes: int) -> dict[int, float]:
    """Expected uses of each piece in the distinct training tokens: a row a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, total = vocabulary_of(model), 0.0
        for batch in batches:
            for data in column(batch, "data"):
                found = unpacked(data.as_buffer())
                seen = found.column("word").filter(pa.array(counts_of(found, classes).any(1)))
                for at, lattices in in_parts(vocabulary, seen.to_pylist()):
                    total = total + lattices.expected(scores, np.ones(len(at)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.atleast_1d(total)[used], pa.float64())], names=["piece", "uses"])

    found = words.select("data").mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
    return {r["piece"]: r["uses"] for r in found.collect()}  # at most a row a piece


def trained(words: DataFrame, model: bytes, rounds: int, prior: float, classes: int) -> np.ndarray:
    """The pieces' scores and, last, the end's, which is one distinct token; pieces that are not in the lattice have -inf."""
    first = vocabulary_of(model).first
    share = first
    with np.errstate(divide="ignore"):
        for _ in range(rounds):
            uses = prior * first
            for piece, n in reestimated(words, model, np.log(share), classes).items():
                uses[piece] += n
            uses[-1] += 1
            share = uses / uses.sum()
        return np.log(share)


def answers(asked: pa.Table, scored: pa.Table, classes: int) -> pa.Table:
    """For each block's words in a bucket: their counts and scores, in the order in which they were sent."""
    made = []
    if asked.num_rows:
        known = unpacked(scored["data"][0].as_buffer())
        counts, logs = counts_of(known, classes), known.column("log").to_numpy()
        for data in asked["data"]:
            at = pc.index_in(unpacked(data.as_buffer()).column("word"), value_set=known.column("word")).to_numpy()
            numbers = with_counts(pa.nulls(len(at)), counts[at], logs[at])
            made.append(packed(numbers.drop_columns(["word"])))
    return pa.table([asked["block"], asked["first"], pa.array(made, pa.binary())], names=["block", "first", "data"])


def mixed(counts: np.ndarray, logs: np.ndarray, tokens: int, distinct: int) -> np.ndarray:
    """Log10 of (c + V * p) / (N + V) for logs of p; p alone if nothing was learned. Some p are too small for a double, their logs aren't."""
    if not tokens:
        return logs
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(counts), np.log(distinct) + logs * np.log(10)) / np.log(10) - np.log10(tokens + distinct)


@dataclass
class Facts:
    """Of the classes and, last, of all training texts: tokens, distinct ones, texts; the end's log10 probability in the lattice."""

    tokens: list[int]
    distinct: list[int]
    texts: list[int]
    end: float


def added_up(block: pa.Table, replies: pa.Table, facts: Facts, kinds: pa.Schema) -> pa.Table:
    """A block's rows of results from its words' counts and scores."""
    block, classes = block.combine_chunks(), len(facts.texts) - 1
    of_texts, places = (unpacked(block[name][0].as_buffer()) for name in ("texts", "places"))
    n = block["n_words"][0].as_py()
    by_class, logs = np.zeros((n, classes)), np.zeros(n)
    for first, data in zip(replies["first"].to_pylist(), replies["data"], strict=True):
        told = unpacked(data.as_buffer())
        own = slice(first, first + told.num_rows)
        by_class[own], logs[own] = counts_of(told, classes), told.column("log").to_numpy()
    code, ns, sizes = places.column("code").to_numpy(), places.column("n").to_numpy(), of_texts.column("size").to_numpy()
    doc, counts = np.repeat(np.arange(len(sizes)), sizes), by_class.sum(1)
    per_text = lambda of_word: np.bincount(doc, of_word[code] * ns, len(sizes))
    tokens, distinct, texts = facts.tokens[-1], facts.distinct[-1], facts.texts[-1]
    below = np.log10(tokens + distinct + 1)
    base = per_text(np.log10(counts + 1) - below) + np.log10(texts + 1) - below
    known = per_text((counts > 0).astype(float)).astype(np.int64) + int(texts > 0)
    end = np.array([facts.end])
    each, each_end = mixed(counts, logs, tokens, distinct), mixed(np.array([texts]), end, tokens, distinct)
    if texts:
        by = zip(by_class.T, facts.tokens, facts.distinct, facts.texts, strict=False)
        found = [per_text(mixed(c, each, n, v)) + mixed(np.array([t]), each_end, n, v) + np.log10(t / texts) for c, n, v, t in by if t]
        score = np.logaddexp.reduce(np.array(found) * np.log(10), 0) / np.log(10)
    else:
        score = per_text(each) + each_end
    made = [*(of_texts.column(c) for c in ("id", "held", "n_tokens")), known, np.full(len(sizes), tokens), base, score, per_text(logs) + end]
    return pa.table([pa.array(x, k.type) if isinstance(x, np.ndarray) else x.cast(k.type) for x, k in zip(made, kinds, strict=True)], schema=kinds)


def lattice_scores(docs: DataFrame, model: bytes, held: str, id: str = "doc_id", text: str = "text", by: str | None = None, rounds: int = 2, prior: float = 1000.0, block: int = BLOCK) -> DataFrame:
    """Log10 probabilities of whole texts: id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score.

    held: a boolean column; the model learns from rows where it is false or null. by: a column of classes. A-Z are
    lower-cased; tokens are the words between spaces, tabs and line ends, and one end. base_score is the add-one
    unigram score of the tokens, score the lattice's marginal, lattice_score that of its pieces alone. Null and empty
    texts have one token, their end. Every row gives one row; rows of equal id, or without one, are scored one by one;
    equal texts get equal scores up to the order of additions. Without training rows all counts are 0 and pieces keep
    their first scores. An empty table gives an empty one. Other columns are left out, whatever their names. Texts
    may have any length, words too."""
    spark = prepare(docs.sparkSession)
    group = F.lit(None).cast("string") if by is None else F.col(by).cast("string")
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(held), F.lit(False)).alias("held"), group.alias("kind"))
    learned = rows.filter(~F.col("held")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    texts = learned.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    names = learned.filter(F.col("kind").isNotNull() & (F.col("n") * 100 >= texts)).orderBy(F.desc("n"), "kind").limit(CLASSES).collect()
    classes = len(names) + 1
    place = F.lit(len(names))
    for k, r in enumerate(names):
        place = F.when(F.col("kind") == r["kind"], k).otherwise(place)
    cut = written(blocks(rows.withColumn("kind", F.coalesce(place, F.lit(len(names)))), block, classes), "blocks", large=True)
    sent = cut.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sent // BUCKET)
    asked = written(by_bucket(cut, buckets), "asked")
    words = written(asked.groupBy("bucket").applyInArrow(lambda key, t: added(key, t, classes), "bucket int, data binary, totals array<long>"), "words", large=True)
    sums = {r["pos"]: r["n"] for r in words.select(F.posexplode("totals")).groupBy("pos").agg(F.sum("col").alias("n")).collect()}
    seen = [r["n"] for r in names] + [texts - sum(r["n"] for r in names), texts]
    scores = trained(words, model, rounds, prior, classes)
    tokens, distinct = ([sums.get(k + i, 0) for k in range(classes + 1)] for i in (0, classes + 1))
    facts = Facts([n + t for n, t in zip(tokens, seen, strict=True)], [n + (t > 0) for n, t in zip(distinct, seen, strict=True)], seen, float(scores[-1] / np.log(10)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(model)
        for batch in batches:
            made = []
            for data in column(batch, "data"):
                found = unpacked(data.as_buffer())
                logs = np.zeros(found.num_rows)
                for at, lattices in in_parts(vocabulary, found.column("word").to_pylist()):
                    logs[at] = lattices.marginals(scores) / np.log(10)
                made.append(packed(found.append_column("log", pa.array(logs))))
            yield pa.RecordBatch.from_arrays([column(batch, "bucket"), pa.array(made, pa.binary())], names=["bucket", "data"])

    def finish(block: pa.Table, told: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        return added_up(block, told, facts, to_arrow_schema(schema))

    schema = StructType([StructField(id, docs.schema[id].dataType), *StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double").fields])
    known = words.select("bucket", "data").mapInArrow(scored, "bucket int, data binary")
    replies = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(lambda a, b: answers(a, b, classes), "block long, first int, data binary")
    done = written(cut.drop("words").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, schema), "scores")
    discard(cut, asked, words)
    return done

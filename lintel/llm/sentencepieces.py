"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Method: the symbols of a chunk start as single characters; an agenda ordered by piece score, then by
position, holds every adjacent pair whose concatenation is a piece; the best pair is merged and its new
neighbours enter the agenda. Characters that no piece covers fall back to their UTF-8 bytes. Long chunks
use a heap; short ones of equal length are merged together, a round of their agendas at a time, as rows
of one matrix (merge_rows).

No piece of such a vocabulary has the space mark after another character, none has a letter before
something that is no letter (the codec finds the letters that this is true of), and some characters (line
feeds, say) are in no longer piece at all, so merges never cross those boundaries. Texts are cut there
and each distinct chunk is merged once while a worker remembers it (a bounded memo, whose older half goes
when it is full). Every chunk that enters the memo is checked, per Arrow batch, against the sentencepiece
library, for its ids and for its decoding; a difference raises.

Nulls and empty texts give no ids and decode to "". Every row gives one row; repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lintel.session import prepare

MARK = "▁"
MEMO = 100_000  # chunks a worker remembers: about 30 MB
ALONE = 4  # times as many where encoding is a job of its own, with no stage of other work behind it in the worker
LONG = 48  # longer chunks are not remembered
NONE, LAST = -(1 << 40), 1 << 62
END = "\uffff"  # between chunks; texts that hold it are cut one by one


class PieceCodec:
    """Encoder and decoder from a model's bytes. check: compare new chunks with the library."""

    def __init__(self, model: bytes, check: bool = True):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.check = check
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        control = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i)}
        self.byte_of = {i: int(self.pieces[i][1:-1], 16) for i in range(size) if sp.is_byte(i)}
        self.shown = [None if i in self.byte_of else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        if len(self.id_of_byte) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in control and i not in self.byte_of}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece spans a word boundary")
        if any(sp.is_unused(i) for i in range(size)):
            raise ValueError("unused pieces are not supported")
        probe = " \t\n\x01\x7f  é ﬁ Ａ  　​①x "
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model rewrites texts; only plain normalisation is supported")
        #: what any two pieces merge into, as sorted keys; ranks order the agenda, best first
        self.plain = np.full(0x110000, NONE, np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.plain[ord(p)] = i
        splits = sorted((self.ids[p[:k]] << 32 | self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.pair_keys = np.array([k for k, _ in splits] + [LAST], np.int64)
        self.pair_made = np.array([i for _, i in splits] + [0], np.int64)
        order = {s: r for r, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.rank = np.full(size + 1, LAST, np.int64)
        for p, s in self.scores.items():
            self.rank[self.ids[p]] = order[s]
        self.plain[ord(" ")] = self.plain[ord(MARK)]  # chunks are cut from texts with plain spaces
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(f"\\x{ord(c):02x}" for c in map(chr, range(32)) if c not in joined)
        letters = self.closed_letters()
        self.cut = re.compile(self.pattern(alone, "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in letters)))
        self.arrow_cut = self.pattern(alone, "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in letters))
        self.decimal = list(map(str, range(size)))
        self.memo: dict[str, tuple] = {}  # the last one used at the end
        self.times = 1

    @staticmethod
    def pattern(alone: str, word: str) -> str:
        """Matches the next chunk: spaces, what is no letter, and letters; each of them may be missing."""
        return f" *[^ {alone}{word}]*[{word}]+| *[^ {alone}{word}]+| +|[{alone}]" if word else f" *[^ {alone}]+| +|[{alone}]"

    def closed_letters(self) -> list[tuple[int, int]]:
        """Ranges of the letters that pieces continue with such letters only."""
        after: dict[str, set[str]] = {}
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                after.setdefault(a, set()).add(b)
        kept = {c for p in self.ids for c in p if c.isalpha()}
        while open_ := {c for c in kept if not after.get(c, set()) <= kept}:
            kept -= open_
        points = sorted(map(ord, kept))
        starts = [x for i, x in enumerate(points) if not i or points[i - 1] != x - 1]
        ends = [x for i, x in enumerate(points) if i + 1 == len(points) or points[i + 1] != x + 1]
        return list(zip(starts, ends, strict=True))

    def merge(self, chunk: str) -> list[str]:
        """The pieces that the score-ordered agenda leaves."""
        symbols: list[str] = list(chunk.replace(" ", MARK))
        n, scores = len(symbols), self.scores
        after, before, agenda = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                agenda.append((-scores[pair], i, i + 1, pair))
        heapify(agenda)
        while agenda:
            _, left, right, pair = heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != len(pair):
                continue
            symbols[left], symbols[right] = pair, ""
            following = after[left] = after[right]
            if following < n:
                before[following] = left
                wider = pair + symbols[following]
                if wider in scores:
                    heappush(agenda, (-scores[wider], left, following, wider))
            if (leading := before[left]) >= 0:
                wider = symbols[leading] + pair
                if wider in scores:
                    heappush(agenda, (-scores[wider], leading, left, wider))
        return [s for s in symbols if s]

    def chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for piece in self.merge(chunk):
            out += [self.ids[piece]] if piece in self.ids else [self.id_of_byte[b] for b in piece.encode()]
        return out

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Agenda order of adjacent symbols; LAST where they don't merge."""
        made = self.pair(left, right)
        return np.where(made < 0, LAST, self.rank[made])

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == key), self.pair_made[at], -1)

    def merge_rows(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks of about one length: each round merges the best pair, leftmost of equals, of every row that has one."""
        width = max(map(len, chunks))
        points = np.frombuffer("".join([c.ljust(width, "\0") for c in chunks]).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(-1, width)
        left = np.fromiter(map(len, chunks), np.int64, len(chunks))
        symbols = self.plain[points]
        symbols = np.where(symbols == NONE, -points - 1, symbols)
        symbols[np.arange(width) >= left[:, None]] = NONE  # what fills up short rows merges with nothing
        rows, out = np.arange(len(chunks)), [[]] * len(chunks)
        ranks = self.pair_rank(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            live = ranks[np.arange(len(rows)), at] < LAST if ranks.shape[1] else np.zeros(len(rows), bool)
            for r, n, ids in zip(rows[~live].tolist(), left[~live].tolist(), symbols[~live].tolist(), strict=True):
                out[r] = ids[:n]
            rows, symbols, ranks, at, left = rows[live], symbols[live], ranks[live], at[live], left[live] - 1
            n, each = len(rows), np.arange(len(rows))
            if not n:
                break
            symbols[each, at] = self.pair(symbols[each, at], symbols[each, at + 1])
            keep = np.ones(symbols.shape, bool)
            keep[each, at + 1] = False
            symbols = symbols[keep].reshape(n, -1)
            keep = np.ones(ranks.shape, bool)
            keep[each, at] = False
            ranks = ranks[keep].reshape(n, -1)
            for move in (-1, 0):
                near = at + move
                here = each[(near >= 0) & (near < ranks.shape[1])]
                near = near[here]
                ranks[here, near] = self.pair_rank(symbols[here, near], symbols[here, near + 1])
        for r, ids in enumerate(out):
            if min(ids) < 0:
                out[r] = [i for x in ids for i in ([x] if x >= 0 else [self.id_of_byte[b] for b in chr(-x - 1).encode()])]
        return out

    def all_ids(self, chunks: list[str]) -> dict[str, list[int]]:
        by: dict[int, list[str]] = {}
        for c in chunks:
            by.setdefault(len(c) + 3 >> 2, []).append(c)
        out: dict[str, list[int]] = {}
        for width, same in by.items():
            out.update(zip(same, map(self.chunk_ids, same) if 4 * width > LONG else self.merge_rows(same), strict=True))
        return out

    def chunks(self, text: str) -> list[str]:
        return self.cut.findall(" " + text.replace(MARK, " ")) if text else []

    def cut_all(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(ends of the texts' runs of chunks, chunks), cut inside Arrow."""
        if pc.any(pc.match_substring(texts, END)).as_py():
            cut = [self.chunks(t) for t in texts.to_pylist()]
            return np.cumsum([0, *map(len, cut)]), pa.array([c for chunks in cut for c in chunks], pa.string())
        spaced = pc.replace_substring(texts, MARK, " ")
        spaced = pc.if_else(pc.equal(spaced, ""), "", pc.binary_join_element_wise(" ", spaced, ""))
        parts = pc.split_pattern(pc.replace_substring_regex(spaced, pattern=self.arrow_cut, replacement="\\0" + END), END)
        # behind the last chunk stands an empty part
        ends = np.cumsum([0, *pc.list_value_length(parts).to_numpy()])
        keep = np.ones(ends[-1], bool)
        keep[ends[1:] - 1] = False
        return ends - np.arange(len(ends)), parts.flatten().filter(pa.array(keep))

    def encode(self, text: str | None) -> list[int]:
        return [i for c in self.chunks(text or "") for i in self.chunk_ids(c)]

    def decode_inner(self, ids: list[int]) -> str:
        """Text of ids that do not begin a sequence."""
        try:
            return "".join(map(self.shown.__getitem__, ids))
        except TypeError:  # byte pieces, which decode in runs
            pass
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.shown[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_inner(ids)
        return text.removeprefix(" ") if ids and ids[0] not in self.byte_of else text

    def compare(self, fresh: dict[str, list[int]], decoded: list[str]) -> None:
        """Against the library's ids and text of the chunks, with a line feed, which joins with nothing, between them."""
        names, feed = list(fresh), self.library.encode("\n", num_threads=1)
        for start in range(0, len(names), 500):
            some = names[start : start + 500]
            ours = feed[:1]
            for c in some:
                ours += feed[1:]
                ours += fresh[c]
            raw = "\n" + "\n".join(some)
            theirs = self.library.encode(raw, num_threads=1)
            if ours != theirs:
                wrong = next((c for c in some if feed + fresh[c] != self.library.encode("\n" + c)), "")
                raise RuntimeError(f"ids of {wrong[:80]!r} differ from the library's")
            if self.library.decode(theirs) != raw or "\n" + "\n".join(decoded[start : start + 500]) != raw:
                raise RuntimeError(f"decoding differs from the library's near {raw[:80]!r}")

    def batch(self, texts: pa.Array, entry: Callable[[list[int], str], tuple]) -> tuple[pa.Array, pa.Array, list[tuple]]:
        """(ends of the texts' runs of chunks, each chunk's place, the places' entries), an entry made of a chunk's ids and decoded text.

        A codec remembers one kind of entry."""
        ends, chunks = self.cut_all(pc.fill_null(texts, ""))
        coded = chunks.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.memo) > MEMO * self.times:
            self.memo = dict(list(self.memo.items())[len(self.memo) // 2 :])
        memo = self.memo
        for c in names:
            if c in memo:
                memo[c] = memo.pop(c)
        new = [c for c in names if c not in memo]
        if new:
            fresh = self.all_ids(new)
            decoded = list(map(self.decode_inner, fresh.values()))
            if self.check:
                self.compare(fresh, decoded)
            memo.update(zip(fresh, map(entry, fresh.values(), decoded), strict=True))
        found = list(map(memo.__getitem__, names))
        for c in new:
            if len(c) > LONG:
                del memo[c]
        return pa.array(ends, pa.int32()), coded.indices, found


CODECS: dict[tuple[bytes, bool, str], PieceCodec] = {}


def codec_of(model: bytes, check: bool, kind: str) -> PieceCodec:
    """One codec, with its memo, for all tasks of a worker that need one kind of entry."""
    if (key := (hashlib.sha256(model).digest(), check, kind)) not in CODECS:
        CODECS[key] = PieceCodec(model, check)
        CODECS[key].times = ALONE if kind == "digests" else 1
    return CODECS[key]


def few(batch: pa.RecordBatch, column: int, rows: int = 1024, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that end at so many rows or bytes of a column, so that the working set stays small whatever the length of the texts."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy() if pa.types.is_string(batch.column(column).type) else np.zeros(batch.num_rows)
    total, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        end = int(np.searchsorted(total, total[start] - sizes[start] + size, side="right"))
        end = max(start + 1, min(end, start + rows))
        yield batch.slice(start, end - start)
        start = end


def digests(codec: PieceCodec, texts: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
    decimal = codec.decimal
    ends, at, found = codec.batch(texts, lambda ids, text: (",".join([decimal[i] for i in ids]), len(ids), text))
    joined, n, decoded = zip(*found) if found else ((), (), ())
    per_text = lambda values: pa.ListArray.from_arrays(ends, pa.array(values, pa.string()).take(at))
    upto = np.concatenate([[0], np.cumsum(np.array(n, np.int64)[at.to_numpy()])])[ends.to_numpy()]
    ids = [hashlib.sha256(x.encode()).hexdigest() for x in pc.binary_join(per_text(joined), ",").to_pylist()]
    texts = [hashlib.sha256(x.removeprefix(" ").encode()).hexdigest() for x in pc.binary_join(per_text(decoded), "").to_pylist()]
    return np.diff(upto), ids, texts


def with_codec(df: DataFrame, model: bytes, text: str, columns: list[StructField], rows, kind: str, check: bool = True) -> DataFrame:
    """Append columns that rows(codec, texts) makes; a column of the same name is replaced."""
    prepare(df.sparkSession)
    names = {c.name for c in columns}
    kept = [c for c in df.columns if c not in names]
    schema = StructType([*df.select(*kept).schema.fields, *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model, check, kind)
        for whole in batches:
            for b in few(whole, whole.schema.get_field_index("__text")):
                made = rows(codec, b.column(b.schema.get_field_index("__text")))
                at = [b.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(at + made, names=kept + [c.name for c in columns])
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)


def encode(df: DataFrame, model: bytes, text: str = "text", check: bool = True) -> DataFrame:
    """Append token_ids array<int> and n_tokens long; null and empty texts give an empty array."""

    def rows(codec: PieceCodec, texts: pa.Array) -> list[pa.Array]:
        ends, at, found = codec.batch(texts, lambda ids, _: (array("i", ids).tobytes(), len(ids)))
        starts = pa.array(np.cumsum([0, *(n for _, n in found)]), pa.int32())
        lists = pa.ListArray.from_arrays(starts, pa.array(np.frombuffer(b"".join([ids for ids, _ in found]), np.int32))).take(at)
        upto = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])[ends.to_numpy()].astype(np.int64)
        return [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), lists.flatten()), pa.array(np.diff(upto), pa.int64())]

    return with_codec(df, model, text, [StructField("token_ids", ArrayType(IntegerType())), StructField("n_tokens", LongType())], rows, "ids", check)


def encode_digests(df: DataFrame, model: bytes, text: str = "text", check: bool = True) -> DataFrame:
    """Append n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 (of the decoded UTF-8)."""

    def rows(codec: PieceCodec, texts: pa.Array) -> list[pa.Array]:
        n, ids, decoded = digests(codec, texts)
        return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]

    columns = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return with_codec(df, model, text, columns, rows, "digests", check)


def decode(df: DataFrame, model: bytes, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Append the text of an array of ids; null ids give null."""

    def rows(codec: PieceCodec, arrays: pa.Array) -> list[pa.Array]:
        return [pa.array([None if a is None else codec.decode(a) for a in arrays.to_pylist()], pa.string())]

    return with_codec(df, model, ids, [StructField(out, StringType())], rows, "decode", False)

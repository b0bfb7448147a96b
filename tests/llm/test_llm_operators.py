"""Small tests of the training-data operators against brute force, the library, or round trips."""

from __future__ import annotations

import datetime
import hashlib
import random
import time
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest
from lintel.llm import chat, codes, components, cotraining, html_text, jaccard, language, lattice, line_dedup, media, mixing, nearest, phrases, sentencepieces
from lintel.llm import queries as llm_queries
from lintel.session import discard, shared_dir, written
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def codec():
    return sentencepieces.PieceCodec(llm_queries.piece_model())


def documents(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), more.get("source", f"s{i % 3}"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# ---- SentencePiece

HARD = ["", " ", "  a", "a  b ", "▁a", "a▁▁ ▁", "\x00x", "<s>é①🙂🙂</s>" * 20, "x" * 3000, "\n\n  \n", "1234 567", "漢字仮名" * 60, "é ﬁ　​", "The quick.\nbrown"]


def test_pieces_equal_the_library(codec):
    texts = HARD + ds.dataset(f"{SMALL}/documents.parquet").to_table(["text"])["text"].to_pylist()[:60]
    for t in texts:
        ids = codec.library.encode(t)
        assert codec.encode(t) == ids
        assert codec.decode(ids) == codec.library.decode(ids)


def test_row_merging_equals_the_heap(codec):
    rng = random.Random(3)
    by: dict[int, list[str]] = {}
    for _ in range(3000):
        w = "".join(rng.choice("▁theandiouérstß漢①🙂") for _ in range(rng.randint(1, 20)))
        by.setdefault(len(w), []).append(w)
    for same in [*by.values(), [w for some in by.values() for w in some[:9]]]:
        assert codec.merge_rows(same) == [codec.chunk_ids(w) for w in same]


def test_slices_of_long_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 50, "", "c" * 3, "d" * 3])], names=["t"])
    parts = [p.column(0).to_pylist() for p in sentencepieces.few(batch, 0, 3, 12)]
    assert [x for p in parts for x in p] == batch.column(0).to_pylist() and all(len(p) <= 3 for p in parts) and ["b" * 50] in parts


def test_digests_and_round_trip(spark, codec):
    texts = [None, *HARD, HARD[-1]]
    df = documents(spark, texts).withColumn("n_tokens", F.lit("clash"))
    model = llm_queries.piece_model()
    rows = {r["doc_id"]: r for r in sentencepieces.encode_digests(df, model).collect()}
    coded = {r["doc_id"]: r for r in sentencepieces.decode(sentencepieces.encode(df, model), model).collect()}
    for i, t in enumerate(texts):
        ids = codec.library.encode(t or "")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(codec.library.decode(ids).encode()).hexdigest()
        assert coded[i]["token_ids"] == ids and coded[i]["decoded"] == codec.library.decode(ids)
    assert sentencepieces.encode(df.limit(0), model).count() == 0


def test_a_wrong_encoding_is_noticed(codec):
    with pytest.raises(RuntimeError):
        codec.compare({" the": [5]}, [" the"])
    with pytest.raises(RuntimeError):
        codec.compare({" the": codec.chunk_ids(" the")}, ["the"])


def test_chunks_join_with_nothing_and_the_memo_forgets(codec, monkeypatch):
    texts = [*HARD, "(word). co-op, déjà-vu! x1 1x ab.cd…", "naïve’s 漢字abc漢"]
    assert all("".join(codec.chunks(t)) == " " + t.replace(sentencepieces.MARK, " ") for t in texts if t)
    assert codec.chunks("a wh.$$$") == [" a", " wh", ".$$$"]
    for some in (texts, [*texts, "a\uffffb"]):  # cut inside Arrow, and one by one
        ends, flat = codec.cut_all(pa.array(some))
        assert [flat.to_pylist()[a:b] for a, b in zip(ends, ends[1:])] == [codec.chunks(t) for t in some]
    monkeypatch.setattr(sentencepieces, "MEMO", 5)
    for t in texts + texts:
        _, at, found = codec.batch(pa.array([t]), lambda ids, text: (ids, text))
        assert [i for x in at.to_pylist() for i in found[x][0]] == codec.library.encode(t)
    codec.memo.clear()


# ---- Chat

CHATS = [
    (1, 0, "user", "hi"),
    (1, 1, "assistant", "a <|end|> b"),
    (1, 2, "assistant", r"<\|text|> and <\\|x"),
    (1, 3, "user", ""),
    (1, 4, "assistant", None),
    (2, 0, None, "no role"),
    (2, 0, "user", "tie"),
    (2, 0, "user", "tie"),
    (3, 5, "assistant", "é<"),
    (None, 0, "ro|le<|start|>", "x|>y\nz"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(df)
    back = {r["conv_id"]: r for r in chat.read_chats(chats).collect()}
    runs = {r["conv_id"]: r["loss_runs"] for r in chats.collect()}
    for conv in (1, 2, 3, None):
        turns = sorted((c[1], c[2] or "", c[3] or "") for c in CHATS if c[0] == conv)
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == [t[1:] for t in turns]
        text = back[conv]["formatted"]
        assert sum(r["len"] for r in runs[conv]) == len(text)
        at, masked = 0, []
        for r in runs[conv]:
            if r["on"]:
                masked.append(text[at : at + r["len"]])
            at += r["len"]
        assert masked == back[conv]["masked"]
        assert len(masked) == sum(t[1] == "assistant" for t in turns)
    assert back[1]["formatted"].count("<|start|>") == 4  # adjacent turns of a role are one block
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


# ---- Pfair


def fluid(weights, blocks, t):
    phases = mixing.fluid_phases(weights, blocks)
    start, total, served = [p for p in phases if p[0] <= t][-1]
    return [served[s] + (t - start) * weights[s] / total if served[s] < blocks[s] else Fraction(blocks[s]) for s in range(len(blocks))]


@pytest.mark.parametrize("seed", range(6))
def test_pfair_stays_within_a_block(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 7)
    weights = [Fraction(rng.randint(1, 30), rng.randint(1, 9)) for _ in range(n)]
    blocks = [rng.randint(0, 60) for _ in range(n)]
    done = [0] * n
    for slot, s, k, release, deadline in mixing.pfair(weights, blocks):
        assert release <= slot < deadline
        assert k == done[s]
        done[s] += 1
        for x, share in enumerate(fluid(weights, blocks, Fraction(slot + 1))):
            assert abs(done[x] - share) < 1
    assert done == blocks


def test_mix_places_every_row_once(spark):
    rows = [(i % 100, f"s{min(i % 7, 2)}" if i % 11 else None, "x") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string")
    out = mixing.mix(df, weights={"s0": 2.0, "s1": 1.5}, block_docs=16).collect()
    assert sorted((r["doc_id"], r["source"] or "") for r in out) == sorted((r[0], r[1] or "") for r in rows)
    assert len({(r["mix_slot"], r["mix_place"]) for r in out}) == len(rows)
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in out)
    sizes: dict = {}
    for r in out:
        sizes.setdefault((r["source"], r["mix_block"]), []).append(r["mix_slot"])
    assert all(len(set(v)) == 1 and len(v) <= 16 for v in sizes.values())
    assert mixing.mix(df.limit(0)).count() == 0


def test_ranks_span_hash_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 10)
    df = spark.range(137).select(F.col("id").alias("doc_id"), F.lit("one").alias("source"))
    ranks = sorted(r["__rank"] for r in mixing.ranked(df, "source", F.col("doc_id")).collect())
    assert ranks == list(range(137))


# ---- Media


def test_media_round_trip(spark):
    texts = ["", None, "a" * 192, "é" * 100, "same", "same", "x\x00y" * 5000]
    df = documents(spark, texts)
    rows = {r["doc_id"]: r for r in media.media_columns(df).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * ((-len(data)) % 192 if data else 192)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert (r["width"], r["height"], r["bits"]) == (192, len(payload) // 192, 8)
    assert rows[4]["digest"] == rows[5]["digest"] and rows[4]["shard_offset"] == rows[5]["shard_offset"]
    assert media.media_columns(df.limit(0)).count() == 0


def test_shards_are_tar_files(tmp_path):
    shards = media.Shards(f"file://{tmp_path}")
    images = [media.png(media.padded(bytes([65 + i]) * 200)) for i in range(3)]
    places = [shards.add(hashlib.sha256(x).hexdigest(), x) for x in images]
    assert shards.add(hashlib.sha256(images[0]).hexdigest(), images[0]) == places[0]
    shards.close()
    data = (tmp_path / places[0][0]).read_bytes()
    assert media.open_tar(data) == {f"{hashlib.sha256(x).hexdigest()}.png": x for x in images}
    for x, (_, at, size) in zip(images, places, strict=True):
        assert data[at : at + size] == x
        assert media.png_payload(x) == media.padded(media.png_payload(x)) and media.png_header(x[: media.HEADER]) == (192, 2, 8)
    with pytest.raises(ValueError):
        media.png_payload(images[0][:-20] + b"\0" * 20)


# ---- Jaccard


def brute_components(texts, size, least, scale):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if scale * both >= least * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(i), root(j)
                    label[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def near_copies(seed, groups=12, copies=40, words=90):
    """Groups of copies with few to many edits, so that some link only through others."""
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "one", "ONE", "one two three", "one two"]
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, words))]
        for _ in range(rng.randint(1, copies)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10_000)}"
            texts.append(" ".join(t + ["tail"] * rng.randint(0, 2)))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,short,split", [(1, 24, 4096), (2, 2, 3), (4, 3, 10)])
def test_jaccard_equals_brute_force(spark, monkeypatch, seed, short, split):
    monkeypatch.setattr(jaccard, "SHORT", short)  # short lists make the hub rounds work
    monkeypatch.setattr(jaccard, "GLOBALLY", 8)
    monkeypatch.setattr(jaccard, "SPLIT", split)  # frequent shingles' lists in several parts
    texts = near_copies(seed)
    df = documents(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components_of(df).collect()}
    assert got == brute_components(texts, 4, 85, 100)


def test_jaccard_edges(spark):
    same = "a b c d e f g h"
    df = documents(spark, [same, same.upper(), "É É É É", "é é é é", same + " "])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.components_of(df).collect()}
    assert got[1] == 0 and got[2] == 2 and got[3] == 3
    assert jaccard.components_of(df.limit(0)).count() == 0
    twice = df.unionByName(df)
    assert jaccard.components_of(twice).count() == 10


def test_runs_in_pieces():
    rng = random.Random(8)
    tokens = sorted([7] * 100 + [rng.randrange(12) for _ in range(60)])
    rows = [pa.RecordBatch.from_arrays([pa.array(tokens[i : i + 9]), pa.array(range(i, i + len(tokens[i : i + 9])))], names=["t", "r"]) for i in range(0, len(tokens), 9)]
    seen, of = [], {}
    for (t, r), starts, carried in jaccard.runs_of(iter(rows), 2, hold=20, lead=4):
        assert len(t) < 60 and starts[0] == 0
        assert all(len(set(t[a:b].tolist())) == 1 for a, b in zip(starts, [*starts[1:], len(t)]))
        of.setdefault(int(t[0]), r[:4].tolist())
        if carried:
            assert r[:carried].tolist() == of[int(t[0])]
        seen += r[carried:].tolist()
    assert seen == list(range(len(tokens)))


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(5)
    for n in (1, 30, 400, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = np.concatenate([a[n // 5 :], np.unique(rng.integers(0, 1 << 63, n // 10).astype(np.uint64))])
        x, y = (np.frombuffer(jaccard.sketch(s), np.uint64) for s in (a, b))
        assert len(x) == jaccard.BUCKETS // 64 and np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    labels = {r["node"]: r["label"] for r in components.connected(links).collect()}
    assert labels == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# ---- Line dedup


def brute_runs(texts, min_words):
    lines = {k: [x.strip() for x in (t or "").split("\n") if x.strip()] for k, t in enumerate(texts)}
    out = {}
    for k, own in lines.items():
        gone = set()
        for k2 in range(k + 1):
            other = lines[k2]
            for p in range(len(own)):
                for p2 in range(len(other)):
                    if (k2, p2) < (k, p) and own[p] == other[p2]:
                        n = words = 0
                        while p + n < len(own) and p2 + n < len(other) and own[p + n] == other[p2 + n]:
                            words += len(own[p + n].split())
                            n += 1
                        if words >= min_words:
                            gone |= set(range(p, p + n))
        out[k] = (len(own), len(gone))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 7))) for _ in range(25)]
    texts = [None, "", "\n \n"] + ["\n".join(rng.choice([*pool, ""]) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    passage = "\n".join(pool[:6])
    texts += [f"{passage}\nx{i}" for i in range(20)]
    df = documents(spark, texts).withColumn("lines_deleted", F.lit("clash"))
    rows = line_dedup.dedup_lines(df, min_words=12).collect()
    assert {r["doc_id"]: (r["lines_before"], r["lines_deleted"]) for r in rows} == brute_runs(texts, 12)
    assert {r["doc_id"]: r["text"] for r in rows if r["lines_deleted"] == 0} == {r["doc_id"]: texts[r["doc_id"]] for r in rows if r["lines_deleted"] == 0}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_a_long_line_and_a_repeat_inside_a_document(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = documents(spark, [long, f"head\n{long}\ntail", f"{long}\n{long}", "short\nshort"])
    rows = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert rows == {0: long, 1: "head\ntail", 2: "", 3: "short\nshort"}


# ---- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies to make this page a better one for all our readers and friends.</div>
<article><h1>A &amp; B</h1><p><b>First&nbsp;text   here.<br><p>To to.</p><p>5 &lt; 6 and <a href="x">a link</a> inside.</p><!-- <p>hidden</p> -->
<aside>Related things that nobody asked for in this place, at some length to be sure.</aside>
<div class="comments"><p>A reader comment with many words that looks much like the text of the article itself.</p></div></article>
<div id="sidebar"><p>Words in a sidebar which are long enough to look like a paragraph of some article.</p></div>
<form><p>Your name and address, please, and whatever else we could ask you for today.</p></form><footer>&copy; me</footer></body></html>"""


def test_html_main_text():
    tree = html_text.train()
    assert html_text.main_text(PAGE, tree) == "A & B\nFirst text here.\nTo to.\n5 < 6 and a link inside."
    for page in (None, "", "<", "<p", "<!--", "<script>", "&amp;", "<p>" * 2000, "</p></div>" * 500):
        assert isinstance(html_text.main_text(page, tree), str)
    rows, labels = html_text.labelled()
    assert [tree.decide(r) for r in rows] == labels


def words(n, word="word"):
    return " ".join(f"{word}{i}" for i in range(n))


#: Pages that are not among the labelled ones, and how many blocks their articles have.
HELD_OUT = {
    "prose in elements named like controls": (f"<article><p>One two three.</p><div class='text-share'><p>{words(11)}</p></div><section id='tags'>{words(9)}</section></article>", 3),
    "no names and no article element": (f"<div><a>Home</a> <a>News</a></div><div><h1>A title of a page</h1><p>{words(50)}</p><p>Short one.</p><p>{words(33)}</p></div><div><a>Imprint</a> <a>Contact</a></div>", 4),
    "a list of links in the article": (f"<article><h1>T</h1><p>{words(20)}</p><ul><li><a>See this one</a></li><li><a>And that</a></li></ul></article>", 4),
    "comments inside and below": (f"<article><p>{words(30)}</p><div class='comments'><p>{words(40)}</p><p>{words(12)}</p></div></article><section id=respond><p>{words(25)}</p></section>", 1),
    "unnamed blocks outside": (f"<div><p>{words(14)}</p></div><article><p>{words(8)}</p></article><div>{words(30)}</div>", 1),
    "a form around everything": (f"<form><div id=header><a>Home</a></div><article><h1>Big title</h1><p>{words(40)}</p></article></form>", 2),
    "a notice in the middle": (f"<main><p>{words(30)}</p><div class='cookie-consent'>{words(15)}</div><p>{words(10)}</p></main>", 2),
    "roles": (f"<div role=main><p>{words(12)}</p></div><div role=complementary><p>{words(30)}</p></div><div role=contentinfo>{words(9)}</div>", 1),
    "content by name": (f"<div class='menu'><a>A</a></div><div class='entry-content'><p>{words(9)}</p><p>{words(2)}</p></div><div class='widget'><p>{words(14)}</p></div>", 2),
    "adverts in the article": (f"<article><p>{words(30)}</p><div class=advert>{words(30)}</div><div id=ad-3>{words(4)}</div><p>{words(1)}</p></article>", 2),
}


@pytest.mark.parametrize("case", HELD_OUT)
def test_html_on_held_out_pages(case):
    page, n = HELD_OUT[case]
    text = html_text.main_text(page, html_text.train())
    assert len(text.split("\n")) == n


def test_html_counts_and_densities_decide():
    """Blocks whose names say one thing and whose text another are decided by their text; the tree uses both."""
    tree = html_text.train()
    rows, labels = html_text.labelled()
    at = html_text.FEATURES.index
    assert {html_text.FEATURES[n[0]] for n in tree.nodes if n[0] >= 0} >= {"words", "link_density", "controls", "apart", "main"}
    named = [any(r[at(f)] for f in ("chrome", "apart", "controls")) for r in rows]
    assert sum(n and y for n, y in zip(named, labels)) >= 5 and sum(not n and not y for n, y in zip(named, labels)) >= 5


@pytest.mark.parametrize("piece", ["<b>", "<div>", "<b><li></li>", "<p><a href=x>", '<a "', "<span class=ad>", "</i>"])
def test_html_of_deep_pages_takes_linear_time(piece):
    start = time.monotonic()
    html_text.main_text("<b>" * 1000 + piece * 50_000 + "x>", html_text.train())
    assert time.monotonic() - start < 10  # about a second; hours if it were quadratic


def test_html_without_article_element():
    body = "".join(f"<p>{' '.join(f'word{i}' for i in range(40))}</p>" for _ in range(3))
    page = f"<html><body><div class='top-menu'><a>One</a> <a>Two</a></div><div>{body}</div><div class=footer><p>{'legal words ' * 12}</p></div></body></html>"
    assert html_text.main_text(page, html_text.train()).count("\n") == 2


def test_html_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (1, "u", PAGE, "x")], "page_id long, url string, html string, n_chars string")
    rows = html_text.extract(df).collect()
    assert [r["page_id"] for r in rows] == [1, 2, 1] and rows[1]["text"] == "" and rows[0]["n_chars"] == len(rows[0]["text"])
    assert html_text.extract(df.limit(0)).count() == 0


# ---- Language


def test_language_accuracy_and_rejection(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    truth = {r["doc_id"]: r["declared"] for r in docs.collect()}
    # hide the declarations of a third, and lie in some
    hidden = docs.withColumn("declared", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 17 == 1, "fr").otherwise(F.col("declared")))
    extra = spark.createDataFrame([(-1, None, "en", None), (-2, "", None, "a.org"), (-3, " \n", "de", "a.org"), (-4, "123 456", None, None), (-5, "ελληνικά κείμενα " * 30, None, None)], docs.schema)
    rows = {r["doc_id"]: r for r in language.identify(hidden.unionByName(extra), "doc_id").collect()}
    right = [rows[i]["language"] == lang for i, lang in truth.items()]
    assert np.mean(right) > 0.98
    assert all(rows[i]["language"] == "und" and not rows[i]["language_kept"] for i in (-1, -2, -3, -4, -5))
    assert language.identify(docs.limit(0), "doc_id").count() == 0


def test_host_priors_decide_short_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", F.col("lang").alias("declared"), F.concat(F.col("lang"), F.lit(".example.org")).alias("host"))
    short = spark.createDataFrame([(-1, "in", None, "de.example.org"), (-2, "in", None, "en.example.org")], docs.schema)
    rows = {r["doc_id"]: r["language"] for r in language.identify(docs.unionByName(short), "doc_id", threshold=0.3).collect()}
    assert (rows[-1], rows[-2]) == ("de", "en")


# ---- Nearest neighbours


def exact(x, ids, q, own, k):
    s = x @ q
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != own][:k]
    return [(int(ids[i]), float(s[i])) for i in order]


@pytest.mark.parametrize("spread", [0.5, 50.0])  # clusters, and hardly any structure
def test_nearest_recall_and_contract(spark, spread):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 24))
    x = (centres[rng.integers(0, 8, 1500)] + spread * rng.standard_normal((1500, 24))).astype(np.float32)
    x[100:400] = x[100]  # a common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [1.0]), (2004, [None] * 24), (2005, [float("inf")] + [1.0] * 23)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in nearest.search(df, df.filter("vec_id % 20 == 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.arange(1500)
    hits = 0
    assert set(got) == set(range(0, 1500, 20))
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        want = exact(x.astype(float), ids, x[q].astype(float), q, 20)
        hits += len({w[0] for w in want} & {f[1] for f in found})
        for _, i, s in found:
            assert s == pytest.approx(float(x[i].astype(float) @ x[q].astype(float)), rel=1e-12, abs=1e-12)
        assert all((-a[2], a[1]) <= (-b[2], b[1]) for a, b in zip(found, found[1:]))
    assert hits / (20 * len(got)) >= 0.9


def test_nearest_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    rows = sorted(nearest.search(df, df.filter("vec_id % 20 == 0")).collect())
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows] == [(0, 1, 20, 1.0), (0, 2, 3, 0.0), (20, 1, 0, 1.0), (20, 2, 3, 0.0)]
    assert nearest.search(df.limit(0), df).count() == 0


def test_scan_abandons_only_worse_candidates():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((3000, 64)), rng.standard_normal((10, 64))
    scan = nearest.Scan(q, 20, float(np.linalg.norm(x, axis=1).max()), 2.1)
    scan.show(np.arange(10), x, np.arange(3000))
    at, ids, scores = scan.result()
    truth = np.argsort(-(q @ x.T), 1)[:, :20]
    assert np.mean([len(set(ids[at == i]) & set(truth[i])) / 20 for i in range(10)]) > 0.95
    assert scores == pytest.approx((q[at] * x[ids]).sum(1), rel=1e-12)


def test_scan_abandons_most_pairs_early_in_short_lists():
    """The driver's vectors, in lists as short as there: the tests act, and what they abandon is not missed."""
    table = ds.dataset("/root/testdata/sf0.1/embeddings.parquet").to_table(["embedding"])
    x = nearest.flat(table["embedding"])
    longest = float(np.linalg.norm(x, axis=1).max())
    centres = nearest.centroids_of(nearest.lifted(x, longest), 32)
    tested, epsilon = nearest.settings(x, longest, centres, 20, 0.95)
    near = nearest.distances(nearest.lifted(x, longest), centres).argmin(1)
    assert np.bincount(near).max() < 200
    q = x[::20]
    order = nearest.distances(nearest.asked(q), centres).argsort(1)
    scan = nearest.Scan(q, 21, longest, epsilon)
    for place in range(tested):
        for one in range(32):
            who = np.flatnonzero(order[:, place] == one)
            if len(who):
                scan.show(who, x[near == one], np.flatnonzero(near == one))
    # most pairs end before the last column block
    assert scan.pairs[-2] < 0.5 * scan.pairs[0] and scan.pairs[-1] < 0.3 * scan.pairs[0]
    at, ids, _ = scan.result()
    truth = np.argsort(-(q @ x.T), 1, kind="stable")[:, :21]
    assert np.mean([len(set(ids[at == i]) & set(truth[i])) / 21 for i in range(len(q))]) > 0.93


def test_centroids_on_two_levels():
    x = nearest.lifted(np.random.default_rng(4).standard_normal((6000, 8)), 6.0)
    centres = nearest.centroids_of(x, 1500)
    assert 1400 < len(centres) < 1600 and np.isfinite(centres).all()


# ---- Quality


def test_quality_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    shown = labels.filter("doc_id % 4 <> 0")
    rows = {r["doc_id"]: r for r in cotraining.classify(docs, shown).collect()}
    assert len(rows) == docs.count()
    held = [(rows[i]["quality_kept"], bool(q)) for i, q in truth.items() if i % 4 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(rows[i]["quality_kept"] for i, q in truth.items() if q == 1 and i % 4 == 0)


def test_quality_edges(spark):
    docs = documents(spark, [None, "", "a b c", "a b c"])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["quality_probability"] for r in cotraining.classify(docs, none).collect()] == [0.5] * 4
    assert cotraining.classify(docs.limit(0), none).count() == 0


def test_quality_copies_are_one_example(spark, monkeypatch):
    pick = random.Random(5)
    good = lambda: " ".join(pick.choice(["river", "stone", "garden", "winter", "letter", "window"]) + str(pick.randrange(9)) for _ in range(pick.randint(60, 120)))
    bad = lambda: " ".join(pick.choice(["BUY", "%&*$#", "!!", "now | now"]) for _ in range(pick.randint(10, 40)))
    copied = [good(), bad()]
    texts = [t for _ in range(60) for t in (good(), bad())] + [copied[0]] * 300 + [copied[1]] * 300 + [t for _ in range(40) for t in (good(), bad())]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(120)], "doc_id long, quality int")
    fitted = []
    made = cotraining.Calibrated
    monkeypatch.setattr(cotraining, "Calibrated", lambda x, *a: fitted.append(x) or made(x, *a))
    rows = cotraining.classify(documents(spark, texts, source="s"), labels, exchange=20).collect()
    assert len(rows) == len(texts)
    for first, last, f in zip(fitted[:2], fitted[-2:], (cotraining.text_features, cotraining.shape_features), strict=True):
        given = last[len(first) :]
        assert len(given) > 40
        for own in map(f, copied):
            assert (np.abs(given[:, : len(own)] - own).max(1) < 1e-9).sum() <= 1


def test_quality_of_vocabulary_alone(spark):
    pick = random.Random(8)
    word = lambda: "".join(pick.choice("bcdfglmnprst") + pick.choice("aeiou") for _ in range(3))
    good, bad = ([word() for _ in range(80)] for _ in range(2))
    texts = [" ".join(pick.choice((bad, good)[i % 2]) for _ in range(100)) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    rows = cotraining.classify(documents(spark, texts, source="s"), labels, exchange=20).collect()
    assert np.mean([r["quality_kept"] == bool(r["doc_id"] % 2) for r in rows if r["doc_id"] >= 200]) > 0.95


# ---- Queries and pipeline


def test_queries_give_contract_columns(spark):
    for name, first in (("op2_sentencepiece", "doc_id"), ("op8_chat", "conv_id"), ("op7_html", "page_id")):
        assert llm_queries.queries()[name](spark, SMALL).columns[0] == first


def test_chat_query_equals_brute_force(spark):
    turns: dict = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in ds.dataset(f"{SMALL}/conversations.parquet").to_table().to_pylist():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    rows = {r["conv_id"]: r for r in llm_queries.queries()["op8_chat"](spark, SMALL).collect()}
    assert set(rows) == set(turns)
    for conv, t in turns.items():
        t.sort()
        assert rows[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in t).encode()).hexdigest()
        loss = "".join(x for _, r, x in t if r == "assistant")
        assert (rows[conv]["n_turns"], rows[conv]["loss_chars"], rows[conv]["loss_sha256"]) == (len(t), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_pipeline_stages(spark):
    import corpus_pipeline

    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs, columns = base, base.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
        path = f"{shared_dir(spark)}/test-{name}-{datetime.datetime.now().timestamp()}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "near_duplicates":
            order = sorted(before)
            labels = brute_components([before[i] for i in order], 5, 80, 100)
            assert set(after) == {order[i] for i, (_, c) in labels.items() if i == c}
        if name == "mix_sources":
            assert after == before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    codec = sentencepieces.PieceCodec(llm_queries.piece_model())
    for r in last.collect():
        assert r["token_ids"] == codec.library.encode(after[r["doc_id"]]) and r["n_tokens"] == len(r["token_ids"])


def test_near_duplicates_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    words = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdefgh"]
    near = lambda t: t + " end"
    rows = [(1, words[0]), (1, words[1]), (2, near(words[0])), (3, near(words[1])), (4, words[2]), (4, words[2])]  # one id, two texts with a near copy each; a repeated row
    rows += [(0, words[3]), (5, words[3]), (5, words[4])]  # one of two texts is a copy, the other stands alone
    rows += [(None, words[5]), (None, words[6]), (None, near(words[2])), (None, words[7]), (None, words[7])]  # null ids: different, near a kept text, equal
    rows += [(6, ""), (6, ""), (7, ""), (7, None), (None, None), (None, None), (None, " ")]  # without words
    want = [(1, words[0]), (1, words[1]), (4, words[2]), (0, words[3]), (5, words[4]), (None, words[5]), (None, words[6]), (None, words[7])]
    want += [(6, ""), (7, ""), (7, None), (None, None), (None, " ")]
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)
        got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, SMALL).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


# ---- Lattice scores


def lattice_rows(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, lang string, score string, id int, words string")
    return lattice.lattice_scores(docs, llm_queries.piece_model(), "held_out", by="lang", **more)


def test_lattice_blocks_are_small_values(spark, tmp_path):
    """Many blocks in one file: each is compressed, and no row group holds them all."""
    rows = spark.range(64, numPartitions=1).select("id", F.lit(False).alias("held"), F.lit(0).alias("kind"), F.expr("concat_ws(' ', transform(sequence(1, 40000), i -> hex(xxhash64(id, i))))").alias("text"))
    cut = lattice.blocks(rows, 300_000, 1)
    assert not [c for c, kind in cut.dtypes if kind.startswith("array")]
    made = written(cut, "blocks", large=True)
    files = [pq.ParquetFile(p) for p in Path(made.written_at.removeprefix("file://")).glob("*.parquet")]
    groups = [f.metadata.row_group(i) for f in files for i in range(f.num_row_groups)]
    assert len(files) == 1 and sum(g.num_rows for g in groups) == 64 and sum(g.total_byte_size for g in groups) > 20 << 20
    assert max(g.total_byte_size for g in groups) <= 17 << 20
    discard(made)


def test_marginal_sums_all_segmentations():
    v = lattice.Vocabulary(llm_queries.piece_model())
    shares = {"▁the": 0.1, "▁t": 0.2, "▁": 0.05, "th": 0.1, "t": 0.1, "h": 0.1, "e": 0.2, "he": 0.1}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=llm_queries.piece_model())
    scores = np.full(v.size + 1, -np.inf)
    for p, x in shares.items():
        scores[sp.piece_to_id(p)] = np.log(x)
    want = 0.1 + 0.2 * 0.1 + 0.2 * 0.1 * 0.2 + 0.05 * (0.1 * 0.2 + 0.1 * 0.1 + 0.1 * 0.1 * 0.2)
    words = ["the", "x", "the"]
    found = lattice.Lattices(v, words)
    assert np.exp(found.marginals(scores)) == pytest.approx([want, 0, want])
    assert found.expected(scores, np.array([2.0, 0, 0]))[sp.piece_to_id("▁the")] == pytest.approx(2 * 0.1 / want)
    finite = np.log(v.first + 1e-9)
    for w in ["a▁b", "漢①", "x" * 300]:
        assert np.isfinite(lattice.Lattices(v, [w]).marginals(finite)).all()


def test_lattice_scores_of_odd_rows(spark):
    rows = [(i, t, h, g, "s", 1, "w") for i, t, h, g in [(1, None, False, "en"), (2, "", True, None), (3, "The the\tTHE ▁x", None, "en"), (3, "the ▁x", True, "fr"), (None, "É é the" + "z" * 5000, False, "fr"), (4, "the ▁x", True, "en")]]
    got = {(r["doc_id"], r["held_out"], r["n_tokens"]): r for r in lattice_rows(spark, rows, block=8).collect()}
    assert len(got) == 6 and {r["train_tokens"] for r in got.values()} == {1 + 5 + 4}
    assert [got[k]["n_known"] for k in ((1, False, 1), (2, True, 1), (3, False, 5), (3, True, 3), (None, False, 4))] == [1, 1, 5, 3, 4]
    assert got[3, True, 3]["score"] == pytest.approx(got[4, True, 3]["score"])
    assert all(np.isfinite([r["base_score"], r["score"], r["lattice_score"]]).all() and r["score"] < 0 for r in got.values())
    assert got[3, False, 5]["base_score"] == pytest.approx(3 * np.log10(4 / 17) + np.log10(2 / 17) + np.log10(4 / 17))
    assert lattice_rows(spark, []).count() == 0
    alone = lattice_rows(spark, [(1, "a b", True, "en", "", 0, "")]).first()
    assert (alone["train_tokens"], alone["n_known"], alone["score"]) == (0, 0, alone["lattice_score"]) and alone["base_score"] == 0.0


def test_held_out_texts_teach_nothing(spark):
    rows = [(1, "red green blue", False, "en", "", 0, ""), (2, "red green", True, "en", "", 0, "")]
    other = [rows[0], (2, "red green", True, "en", "", 0, ""), (3, "violet " * 50, True, "zz", "", 0, "")]
    first = {r["doc_id"]: r["score"] for r in lattice_rows(spark, rows).collect()}
    second = {r["doc_id"]: r["score"] for r in lattice_rows(spark, other).collect()}
    assert {k: second[k] for k in first} == pytest.approx(first)


# ---- Phrases


def test_phrases_of_odd_rows(spark):
    rows = [(None, "New York, new\tyork! new  york\nNEW YORK", "x")] * 3 + [("en", None, "x"), ("en", "", None), ("de", " ,;. \t", "x"), ("und", "york new" + " a" * 3000, "x")]
    docs = spark.createDataFrame(rows, "lang string, text string, rank string")
    got = [tuple(r) for r in phrases.phrases(docs, least=3).orderBy("lang", "rank").collect()]
    n = 3 * 8 + 3002
    assert got == [("und", 1, "a a a", 2998, 3000, 2999, n, 1000000 * 2998 * 2998 // (3000 * 2999)), ("und", 2, "new york", 12, 13, 13, n, 1000000 * 144 // 169)]
    assert phrases.phrases(docs.filter("1 = 0")).count() == 0 and phrases.phrases(docs.filter("lang = 'de'")).count() == 0


def test_phrases_equal_plain_counts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a ", "b ", "c ", "dd ", ", ", "E "]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    counts: dict = {}
    for t in texts:
        for piece in t.lower().split(","):
            w = piece.split()
            for size in (1, 2, 3, 4):
                for i in range(len(w) - size + 1):
                    g = tuple(w[i : i + size])
                    counts[g] = counts.get(g, 0) + 1
    cand = {g: n for g, n in counts.items() if 2 <= len(g) <= 4 and n >= 5}
    holds = lambda o, g: any(o[i : i + len(g)] == g for i in range(len(o) - len(g) + 1))
    want = []
    for g, a in cand.items():
        if any(len(o) > len(g) and 100 * b >= 30 * a and holds(o, g) for o, b in cand.items()):
            continue
        best, _, left, right = min((1000000 * a * a // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
        want.append((-best, -a, " ".join(g), left, right))
    docs = spark.createDataFrame([("l", t) for t in texts], "lang string, text string")
    got = phrases.phrases(docs, words=4, least=5, inside=30, top=25).orderBy("rank").collect()
    assert [(-r["score"], -r["a"], r["phrase"], r["l"], r["r"]) for r in got] == sorted(want)[:25]
    assert phrases.phrases(docs, words=4, least=5, inside=30, top=None).count() == len(want)


def test_phrase_scores_are_exact(spark):
    a, left, right = 999_999_999_999_989, 999_999_999_999_999, 999_999_999_999_990
    df = spark.createDataFrame([(a, left, right), (10, 11, 1000)], "a long, l long, r long")
    assert [r[0] for r in df.select(phrases.score(F.col("a"), F.col("l"), F.col("r"))).collect()] == [1000000 * a * a // (left * right), 1000000 * 100 // 11000]


# ---- Vector codes


def plain_lloyd(rows, parts=8, entries=16, rounds=6):
    """rows (id, vector, label) in order of ids: {place: (code, error)} and the codebooks, in Python's integers."""
    whole = [[int(np.floor(np.float64(x) * 4096)) for x in v] for _, v, _ in rows]
    d = len(whole[0]) // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for v in whole]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups: dict = {}
            for v in cut:
                groups.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            for j, some in groups.items():
                books[p][j] = [sum(x) // len(some) for x in zip(*some)]
    final = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    return [("".join(f"{j:02x}" for _, j in f), sum(x for x, _ in f)) for f in final], books


@pytest.mark.parametrize("scale", [1.0, 1e9, 1e30])
def test_codes_equal_plain_rounds(spark, scale):
    rng = np.random.default_rng(3)
    vectors = (rng.integers(-3, 4, (90, 16)) * scale).astype(np.float32)
    vectors[50:70] = vectors[10]
    rows = [(i, [float(x) for x in v], i % 3 if i % 4 else None) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    found, books = codes.compress(df)
    want, plain = plain_lloyd(rows)
    got = {r["vec_id"]: r for r in found.collect()}
    fits = lambda x: x if x < 1 << 63 else None
    assert books.entries == plain
    assert {i: (r["code"], r["error"]) for i, r in got.items()} == {i: (c, fits(e)) for i, (c, e) in enumerate(want)}
    for label in (None, 0, 1, 2):
        same = [i for i, r in enumerate(rows) if r[2] == label]
        assert {got[i]["label_error"] for i in same} == {fits(sum(want[i][1] for i in same))}


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 2.0, 3.0], 1), (5, [1.0, 2.0, 3.0], None), (5, [0.0, 2.0, 3.0], None), (6, None, 1), (7, [1.0, None, 2.0], 1), (8, [nan, 1.0, 1.0], 1), (9, [1.0, inf, 1.0], 1), (10, [], 1), (11, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int")
    found, books = codes.compress(df, rounds=2)
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found.collect()), key=str)
    assert [len(p) for p in books.entries] == [3] * 8 and books.entries[0] == [[0], [4096], [4096]]
    assert got == [(5, "0000000000000000", 0, 0), (5, "0100000000000000", 0, 0), (None, "0100000000000000", 0, 0)]
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    back = codes.restore(found.select("vec_id", "code", F.lit(1).alias("restored")), books).orderBy("code").collect()
    assert back[0]["restored"] == [0.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert codes.compress(df.filter("vec_id > 5 AND vec_id < 11"))[0].count() == 0


def test_bounds_spare_distances(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(16, 8)) * 9
    rows = [(i, [float(x) for x in centres[i % 16] + rng.normal(size=8) * 0.1], 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    _, _, made = codes.fit(codes.usable(df, "vec_id", "embedding", "label", 2), 2, 16, 4)
    every = 3000 * 2 * 16
    assert made[0] > every / 4 and made[-1] < every / 20

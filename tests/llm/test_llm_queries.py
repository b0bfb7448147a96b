"""The registered queries on the smallest tables, against slow versions made in another way."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from html.parser import HTMLParser

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow.dataset as ds
import pytest
import xxhash
from lintel.llm import language, media, mixing, sentencepieces
from lintel.llm import queries as llm_queries
from pyspark.sql import functions as F
from test_llm_operators import DOCS, brute_components, brute_runs

SMALL = "/root/testdata/sf0.001"


def rows_of(name):
    return ds.dataset(f"{SMALL}/{name}.parquet").to_table().to_pylist()


@pytest.fixture(scope="module")
def result(spark):
    made: dict = {}

    def get(name):
        if name not in made:
            made[name] = llm_queries.queries()[name](spark, SMALL).collect()
        return made[name]

    return get


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] for r in rows_of("documents")}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_op1_recall_and_scores(result):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows_of("embeddings")}
    ids, x = np.array(list(vectors)), np.array(list(vectors.values()))
    got: dict = {}
    for r in result("op1_nearest"):
        assert r["score"] == pytest.approx(float(vectors[r["query_id"]] @ vectors[r["vec_id"]]), abs=1e-12)
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        s = x @ vectors[q]
        want = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hits += len(set(want) & set(found.values()))
        assert sorted(found) == list(range(1, 21))
    assert hits >= 0.9 * 20 * len(got)


def test_op2_equals_the_library(result, texts):
    library = sentencepieces.PieceCodec(llm_queries.piece_model(), check=False).library
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in result("op2_sentencepiece")}
    ids = {i: library.encode(t or "") for i, t in texts.items()}
    assert got == {i: (len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for i, x in ids.items()}


def test_op3_equals_all_pairs(result, texts):
    keys = sorted(texts)
    want = brute_components([texts[k] for k in keys], 4, 85, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in result("op3_jaccard")}
    assert got == {keys[i]: (n, keys[c]) for i, (n, c) in want.items()}


def test_op4_equals_plain_arithmetic(spark, result):
    """Trigram counts, declarations and smoothed priors by plain loops over all rows."""
    got = result("op4_language")
    pages = {r["page_id"]: r for r in rows_of("pages")}
    docs = {r["doc_id"]: r for r in rows_of("documents")}
    plain = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ").alias("t"))
    page_text = {r["page_id"]: r["t"] for r in plain.collect()}
    names = [*language.LANGUAGES, "und"]
    text = [docs[r["doc_id"]]["text"] if r["doc_id"] is not None else page_text[r["page_id"]] for r in got]
    assert len(got) == len(docs) + len(pages)
    grams = [language.trigrams(np.frombuffer((t or "").encode(), np.uint8)) for t in text]
    count = {n: np.full(language.BUCKETS, 0.5) for n in names[:-1]}
    for r, g in zip(got, grams):
        if r["declared"] in count:
            count[r["declared"]] += np.bincount(g, minlength=language.BUCKETS)
    model = {n: np.log(c / c.sum()) for n, c in count.items()} | {"und": np.full(language.BUCKETS, -math.log(language.BUCKETS))}
    first, likely = [], []
    for r, g in zip(got, grams):
        scores = {n: model[n][g].sum() / max(1, len(g)) * min(max(1, len(g)), 400) for n in names}
        said = (r["declared"] or "").strip().lower()[:2]
        if said in count:
            scores = {n: v + math.log(0.9 if n == said else 0.1 / 4) for n, v in scores.items()}
        likely.append(scores)
        first.append(max(names, key=lambda n, s=scores: (s[n], -names.index(n))))
    total = {n: (first.count(n) + 1) / (len(first) + len(names)) for n in names}
    suffix = lambda h: h.rsplit(".", 1)[1].lower() if h and "." in h else None
    hosts, suffixes = {}, {}
    for r, f in zip(got, first):
        hosts.setdefault(r["host"], dict.fromkeys(names, 0))[f] += 1
        suffixes.setdefault(suffix(r["host"]), dict.fromkeys(names, 0))[f] += 1
    for r, f, scores, t in zip(got, first, likely, text):
        s = suffixes[suffix(r["host"])] if suffix(r["host"]) else None
        parent = {n: (s[n] + 20 * total[n]) / (sum(s.values()) + 20) if s else total[n] for n in names}
        own = {n: hosts[r["host"]][n] - (n == f) for n in names}
        prior = {n: (own[n] + 20 * parent[n]) / (sum(own.values()) + 20) if r["host"] is not None else total[n] for n in names}
        everything = {n: scores[n] + math.log(prior[n]) for n in names}
        peak = max(everything.values())
        posterior = 1 / sum(math.exp(v - peak) for v in everything.values())
        found = max(names, key=lambda n, e=everything: (e[n], -names.index(n)))
        kept = found != "und" and posterior >= 0.6 and any(map(str.isalpha, t or ""))
        assert r["language_posterior"] == pytest.approx(posterior, abs=1e-4)
        assert (r["language"], r["language_kept"]) == (found if kept else "und", kept)


def slow_feature(payload):
    edges = [int(x) for x in np.linspace(0, len(payload), 73)]
    cells = [sum(payload[a:b]) // (b - a) for a, b in zip(edges, edges[1:])]
    bits = "".join("1" if cells[9 * r + c + 1] > cells[9 * r + c] else "0" for r in range(8) for c in range(8))
    mean = sum(payload) / len(payload)
    return f"{mean:.4f}:{max(0.0, sum(b * b for b in payload) / len(payload) - mean * mean) ** 0.5:.4f}:{int(bits, 2):016x}"


def test_op5_all_columns(result, texts):
    got = {r["doc_id"]: r for r in result("op5_media")}
    assert set(got) == set(texts)
    for i, t in texts.items():
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 or 192 * (not data))
        r, image = got[i], media.png(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(image), sha(image), slow_feature(payload))
        assert (r["width"], r["height"]) == (192, len(payload) // 192)


def test_op6_equals_brute_force(result, texts):
    keys = sorted(texts)
    want = brute_runs([texts[k] for k in keys], 50)
    assert {r["doc_id"]: (r["lines_before"], r["lines_deleted"]) for r in result("op6_line_dedup")} == {keys[i]: v for i, v in want.items()}


class Article(HTMLParser):
    """Text of article elements, block by block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("article", "h1", "p", "br"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("article", "h1", "p"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_op7_equals_the_article_elements(result):
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in result("op7_html")}
    for r in rows_of("pages"):
        parser = Article()
        parser.feed(r["html"] or "")
        parser.close()
        text = "\n".join(b for b in (" ".join(x.split()) for x in parser.blocks) if b)
        assert got[r["page_id"]] == (r["url"], text, len(text))


def test_op8_equals_sql(spark, result):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    found = con.execute(llm_queries.ORACLE_SQL["op8_chat"])
    columns = [c[0] for c in found.description]
    assert sorted(tuple(r[c] for c in columns) for r in result("op8_chat")) == sorted(found.fetchall())


class PlainLattice:
    """Forward and backward sums over dictionaries, a token at a time."""

    def __init__(self, model):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        usable = [i for i in range(len(names)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and "▁" not in names[i][1:]]
        usable.sort(key=lambda i: (-sp.get_score(i), i))
        order = [names[i] for i in usable] + [f"<0x{b:02X}>" for b in range(256)]
        first = {p: 1 / (k + 2) for k, p in enumerate(order)} | {"</s>": 0.5}
        total = sum(first.values())
        self.first = {p: x / total for p, x in first.items()}
        self.whole = {names[i] for i in usable}

    def arcs(self, word):
        chars = "▁" + word
        for j in range(1, len(chars) + 1):
            for i in range(max(0, j - 16), j):
                if chars[i:j] in self.whole and (i == 0 or chars[i] != "▁"):
                    yield i, j, [chars[i:j]]
            if j > 1:
                yield j - 1, j, [f"<0x{b:02X}>" for b in chars[j - 1].encode()]

    def sums(self, word, share):
        n, arcs = len(word) + 1, [(i, j, p, math.prod(share[x] for x in p)) for i, j, p in self.arcs(word)]
        forward, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for i, j, _, x in sorted(arcs, key=lambda a: a[1]):
            forward[j] += forward[i] * x
        for i, j, _, x in sorted(arcs, key=lambda a: -a[0]):
            back[i] += x * back[j]
        return forward[n], [(p, forward[i] * x * back[j] / forward[n]) for i, j, p, x in arcs]

    def trained(self, words, rounds, prior):
        share = self.first
        for _ in range(rounds):
            uses = {p: prior * x for p, x in self.first.items()}
            for w in words:
                for pieces, n in self.sums(w, share)[1]:
                    for p in pieces:
                        uses[p] += n
            uses["</s>"] += 1
            total = sum(uses.values())
            share = {p: x / total for p, x in uses.items()}
        return share


def test_op11_equals_plain_sums(result):
    docs = rows_of("documents")
    tokens = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")) for r in docs}
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in docs}
    lang = {r["doc_id"]: r["lang"] for r in docs if not held[r["doc_id"]]}
    counts, by = Counter(), {}
    for i, words in tokens.items():
        if not held[i]:
            counts.update([*words, None])
            by.setdefault(lang[i], Counter()).update([*words, None])
    n, v, texts = counts.total(), len(counts), counts[None]
    plain = PlainLattice(llm_queries.piece_model())
    share = plain.trained([w for w in counts if w is not None], 2, 1000)
    marginal = {w: plain.sums(w, share)[0] for words in tokens.values() for w in words} | {None: share["</s>"]}
    assert len(result("op11_lattice")) == len(docs) and any(held.values())
    for r in result("op11_lattice"):
        words = [*tokens[r["doc_id"]], None]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"], r["n_known"]) == (held[r["doc_id"]], len(words), n, sum(w in counts for w in words))
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
        whole = {w: (counts[w] + v * marginal[w]) / (n + v) for w in words}
        score = np.logaddexp.reduce([sum(math.log((c[w] + len(c) * whole[w]) / (c.total() + len(c))) for w in words) + math.log(c[None] / texts) for c in by.values()])
        assert r["score"] == pytest.approx(score / math.log(10), rel=1e-9)
        assert r["lattice_score"] == pytest.approx(sum(math.log10(marginal[w]) for w in words), rel=1e-9)


@pytest.mark.parametrize("name,table", [("op12_phrases", "documents"), ("op13_codes", "embeddings")])
def test_new_queries_equal_sql(result, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    found = con.execute(llm_queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    rows = found.fetchall()
    assert rows and sorted(tuple(r[c] for c in columns) for r in result(name)) == sorted(rows)


def test_op9_scores_every_document(result):
    docs = {r["doc_id"]: r for r in rows_of("documents")}
    got = {r["doc_id"]: r for r in result("op9_quality")}
    assert set(got) == set(docs)
    alike: dict = {}
    for i, r in got.items():
        assert 0 <= r["quality_probability"] <= 1 and r["quality_kept"] == (r["quality_probability"] >= 0.5)
        d = docs[i]
        alike.setdefault((d["text"], d["source"], d["lang"]), set()).add(r["quality_probability"])
    assert all(len(v) == 1 for v in alike.values())
    truth = {r["doc_id"]: r["quality"] for r in rows_of("labels")}
    assert np.mean([got[i]["quality_kept"] == bool(q) for i, q in truth.items()]) > 0.9


class PlainRidge:
    """Ridge logistic regression by plain gradient steps with halving, on standardised values between -8 and 8."""

    def __init__(self, x, y, ridge):
        x, y = np.array(x, float), np.array(y, float)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        self.w = np.zeros(x.shape[1] + 1)
        z, penalty = self.side(x), np.append(1e-3, np.ones(x.shape[1]) * ridge)
        loss = lambda w: np.sum(np.logaddexp(0, z @ w) - y * (z @ w)) + 0.5 * np.sum(penalty * w * w)
        for _ in range(60):
            p = 1 / (1 + np.exp(-(z @ self.w)))
            gradient = z.T @ (p - y) + penalty * self.w
            step = np.linalg.lstsq(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(penalty), gradient, rcond=None)[0]
            t = 1.0
            while loss(self.w - t * step) > loss(self.w) + 1e-12 and t > 1e-6:
                t /= 2
            self.w = self.w - t * step

    def side(self, x):
        return np.column_stack([np.ones(len(x)), np.clip((np.array(x, float) - self.mean) / self.scale, -8, 8)])

    def __call__(self, x):
        return self.side(x) @ self.w


def plain_words(text):
    counts = [0] * 256
    for w in text.split():
        counts[xxhash.xxh3_64_intdigest(w.lower().encode()) % 256] += 1
    n = max(1, sum(counts))
    return [round(255 * math.sqrt(c / n)) / 255 for c in counts]


def test_op9_equals_a_plain_loop(spark, result):
    """Two views as lists of numbers, three rounds of exchange, one document at a time."""
    from lintel.llm import cotraining

    docs = sorted(rows_of("documents"), key=lambda r: r["doc_id"])
    order = {r["id"]: r["o"] for r in spark.range(10_000).select("id", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 62)).alias("o")).collect()}
    label = {r["doc_id"]: float(r["quality"]) for r in rows_of("labels")}
    held = {d["doc_id"]: order[d["doc_id"]] % 5 == 0 for d in docs}
    train = [d for d in docs if d["doc_id"] in label and not held[d["doc_id"]]]
    overall = sum(label[d["doc_id"]] for d in train) / len(train)

    def rate(column, value):
        same = [label[d["doc_id"]] for d in train if d[column] == value]
        return (sum(same) + 20 * overall) / (len(same) + 20) if same else overall

    rates = {c: {v: rate(c, v) for v in {d[c] for d in docs}} for c in ("source", "lang")}
    views = {}
    for d in docs:
        t = d["text"] or ""
        page = cotraining.shape_features(t) + [rates["source"][d["source"]], rates["lang"][d["lang"]]]
        views[d["doc_id"]] = (tuple(cotraining.text_features(t) + plain_words(t)), tuple(page))
    ridges = [np.append(np.ones(14), np.full(256, 20.0)), 1.0]
    held_ids = [i for i in sorted(label) if held[i]]
    pools = [([views[d["doc_id"]][v] for d in train], [label[d["doc_id"]] for d in train]) for v in (0, 1)]
    examples = {}
    for i in sorted(views):
        if i not in label:
            examples.setdefault(views[i], i)

    def fitted():
        made = []
        for v in (0, 1):
            model = PlainRidge(*pools[v], ridges[v])
            platt = PlainRidge([[s] for s in model([views[i][v] for i in held_ids])], [label[i] for i in held_ids], 1e-2)
            made.append(lambda x, model=model, platt=platt: platt([[s] for s in model(x)]))
        return made

    models = fitted()
    for _ in range(3):
        left, taken = list(examples), set()
        if left:
            for v in (0, 1):
                scores = models[v]([e[v] for e in left])
                for sign in (1, -1):
                    sure = sorted((-sign * s, examples[e], e) for s, e in zip(scores, left) if sign * s > 2)[:200]
                    for _, _, e in sure:
                        pools[1 - v][0].append(e[1 - v])
                        pools[1 - v][1].append((1 + sign) / 2)
                        taken.add(e)
        for e in taken:
            del examples[e]
        models = fitted()
    both = {i: (float(models[0]([x[0]])[0]), float(models[1]([x[1]])[0])) for i, x in views.items()}
    joint = PlainRidge([both[i] for i in held_ids], [label[i] for i in held_ids], 1e-1)
    one = lambda s: 1 / (1 + math.exp(-s))
    assert len(pools[0][0]) > len(train) and len(result("op9_quality")) == len(docs)
    for r in result("op9_quality"):
        a, b = both[r["doc_id"]]
        want = (one(a), one(b), one(float(joint([[a, b]])[0])))
        assert (r["text_probability"], r["page_probability"], r["quality_probability"]) == pytest.approx(want, abs=2e-5)


def plain_schedule(weights, blocks):
    """Slots by walking the fluid schedule slot by slot in exact fractions: {(source, block): (slot, release, deadline)}."""
    n, served, windows, now = len(blocks), [Fraction(0)] * len(blocks), {}, Fraction(0)
    begins = [[Fraction(0)] for _ in range(n)]
    while any(s < b for s, b in zip(served, blocks)):
        live = [i for i in range(n) if served[i] < blocks[i]]
        total = sum(weights[i] for i in live)
        step = min((math.floor(served[i]) + 1 - served[i]) * total / weights[i] for i in live)  # up to the next whole block of any source
        now += step
        for i in live:
            served[i] += step * weights[i] / total
            if served[i].denominator == 1:
                begins[i].append(now)
    for i in range(n):
        for k in range(blocks[i]):
            windows[i, k] = (math.floor(begins[i][k]), math.ceil(begins[i][k + 1]))
    done, found = [0] * n, {}
    for slot in range(sum(blocks)):
        ready = [(windows[i, done[i]][1], i) for i in range(n) if done[i] < blocks[i] and windows[i, done[i]][0] <= slot]
        deadline, i = min(ready)
        assert slot < deadline
        found[i, done[i]] = (slot, *windows[i, done[i]])
        done[i] += 1
    return found


def test_op10_equals_a_plain_schedule(result):
    docs = rows_of("documents")
    sizes = Counter(r["source"] for r in docs)
    names = sorted(sizes, key=lambda s: (s is not None, s))
    want = plain_schedule([Fraction(str(round(sizes[s] ** 0.5, 6))) for s in names], [-(-sizes[s] // 64) for s in names])
    got = {(names.index(r["source"]), r["mix_block"]): (r["mix_slot"], r["mix_release"], r["mix_deadline"]) for r in result("op10_mixing")}
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_schedules_of_many_blocks(seed):
    rng = random.Random(seed)
    blocks = [rng.randint(0, 40) for _ in range(6)]
    weights = [Fraction(rng.randint(1, 50), rng.randint(1, 9)) for _ in blocks]
    got = {(s, k): (slot, release, deadline) for slot, s, k, release, deadline in mixing.pfair(weights, blocks)}
    assert got == plain_schedule(weights, blocks)


def test_op10_equals_the_schedule(result):
    """Every document once; blocks in the slots that the scheduler gives them."""
    got = result("op10_mixing")
    sources: dict = {}
    for r in rows_of("documents"):
        sources.setdefault(r["source"], set()).add(r["doc_id"])
    assert sorted(r["doc_id"] for r in got) == sorted(i for s in sources.values() for i in s)
    names = sorted(sources, key=lambda s: (s is not None, s))
    weights = [mixing.Fraction(str(round(len(sources[s]) ** llm_queries.MIX_POWER, 6))) for s in names]
    blocks = [-(-len(sources[s]) // llm_queries.MIX_BLOCK) for s in names]
    want = {(names[s], k): (slot, release, deadline) for slot, s, k, release, deadline in mixing.pfair(weights, blocks)}
    seen: dict = {}
    for r in got:
        assert want[r["source"], r["mix_block"]] == (r["mix_slot"], r["mix_release"], r["mix_deadline"])
        seen.setdefault((r["source"], r["mix_block"]), []).append(r["mix_place"])
    assert all(sorted(places) == list(range(len(places))) for places in seen.values()) and set(seen) == set(want)


def test_pipeline_against_slow_stages(spark, texts):
    """Stage by stage on the smallest table: what one stage keeps, the slow version of the next works on."""
    from lintel.session import written

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = written(stages["language_id"](spark, docs, SMALL), "t")
    assert {r["doc_id"]: r["text"] for r in kept.collect()}.items() <= texts.items()
    before = sorted(kept.collect(), key=lambda r: r["doc_id"])
    lines = written(stages["line_dedup"](spark, kept, SMALL), "t")
    runs = brute_runs([r["text"] for r in before], 50)
    left = [r["doc_id"] for i, r in enumerate(before) if runs[i][1] == 0 or runs[i][1] < runs[i][0]]
    assert sorted(r["doc_id"] for r in lines.collect()) == left
    before = sorted(lines.collect(), key=lambda r: r["doc_id"])
    near = written(stages["near_duplicates"](spark, lines, SMALL), "t")
    groups = brute_components([r["text"] for r in before], 5, 80, 100)
    first = {c if n else i for i, (n, c) in groups.items()}
    assert sorted(r["doc_id"] for r in near.collect()) == [before[i]["doc_id"] for i in sorted(first)]
    mixed = written(stages["mix_sources"](spark, near, SMALL), "t")
    assert mixed.columns == columns and sorted(mixed.collect()) == sorted(near.collect())
    library = sentencepieces.PieceCodec(llm_queries.piece_model(), check=False).library
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    tokens = stages["sentencepiece"](spark, mixed, SMALL).collect()
    assert {r["doc_id"]: r["token_ids"] for r in tokens} == {i: library.encode(t or "") for i, t in text.items()}


def test_pipeline_edges(spark):
    """Nulls in every column, empty and repeated rows, an extra column, and an empty table pass all stages."""
    long = " ".join(f"The words of this text are the {i}th of many that were written in a plain English way." for i in range(80))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, long, None, None, len(long)), (2, long, None, None, len(long)), (None, long + " more", "en", "b", 1), (3, "123 456", "en", "a", 7)]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS.replace("string, n_chars long", "string, n_chars long, mix_slot string"))
    for empty in (False, True):
        docs = df.limit(0) if empty else df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == df.columns, name
        got = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
        assert len(got) == (0 if empty else 1)
    assert corpus_pipeline.mix_sources(spark, df, SMALL).count() == len(rows)
    assert [len(r["token_ids"]) for r in corpus_pipeline.tokenize(spark, df, SMALL).filter("doc_id = 1").collect()] == [0]

"""Token counts, collocations and ranked search against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from blotter.llm import common, lexical, phrases, query_lexical, query_tokencount, tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")
BREAKS = re.compile("[.,;:!?\x0a-\x0d]")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- token counts ------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(spark, small, documents, library):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    rows = query_tokencount.op11_token_counts(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 512)


def test_counts_of_odd_texts(library):
    counter, draw = tokencount.Counter(*tokencount.read_merges(PATH)), random.Random(7)
    texts = ["", "ab" * 30_000, "a" * 50_000, " " * 900 + "x", "\x85 \x1c\x1d x", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "<|endoftext", "can't CAN'T 'll", "౜՘a \U000323b0x"]
    ranges = [(32, 127), (32, 127), (0, 0x250), (0x4E00, 0x9FFF), (0, 0xD800), (0xE000, 0x110000)]
    texts += ["".join(chr(draw.randrange(*draw.choice(ranges))) for _ in range(draw.randrange(80))) for _ in range(1500)]
    for text in texts:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_counts_of_long_texts_in_stretches(monkeypatch, library):
    monkeypatch.setattr(tokencount, "STRETCH", 10)
    monkeypatch.setattr(tokencount, "REMEMBERED", 5)
    counter = tokencount.Counter(*tokencount.read_merges(PATH))
    text = "Some words, some   more words and 1234 numbers!\n\n  End"
    assert counter.count(text) == counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_count_rows(odd, empty, library):
    got = tokencount.count(odd.withColumn("n_tokens", F.lit("x")), PATH)
    assert got.columns[-1] == "_n_tokens" and got.count() == odd.count()
    for r in got.select("text", "_n_tokens").collect():
        assert r["_n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids)
    assert tokencount.count(empty, PATH).count() == 0


def test_other_vocabularies_raise():
    with pytest.raises(ValueError):
        tokencount.read_merges(public_tokenizers.path("word_bpe_49k.json"))


# --- collocations ----------------------------------------------------------------------


def plain_collocations(rows, least=30, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by counting everything."""
    found, size = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in BREAKS.split((text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(words)
            counts = found.setdefault(lang, Counter())
            for n in range(1, 5):
                counts.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, counts in found.items():
        frequent = {p: c for p, c in counts.items() if c >= least and len(p) > 1}
        dropped = set()
        for q, c in frequent.items():
            for n in range(2, len(q)):
                dropped.update(p for p in (q[i : i + n] for i in range(len(q) - n + 1)) if 100 * c >= 80 * frequent[p])
        scored = []
        for p, a in frequent.items():
            if p not in dropped:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, size[lang], -s))
    return sorted(out)


def collocated(docs, top=2000, **options):
    rows = phrases.collocations(phrases.counts(docs, **options), top).collect()
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows)


def test_collocations_equal_counting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = plain_collocations([(r["lang"], r["text"]) for r in docs.collect()])
    assert collocated(docs) == plain and len(plain) > 100


@pytest.fixture(scope="module")
def noise(spark):
    """Words of a few letters in two languages and none, with breaks, blanks, copies, nulls, and one long text."""
    draw = random.Random(3)
    words = ["a", "b", "AB", "été", "Été", "c\x1cd", " ", "x", "yy", "zzz"]
    glue = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ; "]

    def text(n):
        return "".join(draw.choice(words) + draw.choice(glue) for _ in range(n))

    rows = [(i % 37, draw.choice(["en", "fr", None, "und"]), text(draw.randrange(60))) for i in range(150)]
    rows += [(900, "en", text(3000)), (901, "en", None), (None, "fr", ""), (902, "de", "only words without a break"), (903, None, None)]
    rows += [(5, "en", "a repeated row, twice")] * 2
    return rows, spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("fp", F.lit("x")).withColumn("doc", F.lit(1)).withColumn("n", F.lit(1))


@pytest.mark.parametrize("bits", [64, 9])
def test_collisions_and_stretches_change_nothing(noise, bits, monkeypatch):
    """With nine bits most fingerprints stand for several phrases; chunks and stretches of few words cut everywhere."""
    rows, docs = noise
    plain = plain_collocations([(lang, text) for _, lang, text in rows], least=5, top=40)
    monkeypatch.setattr(phrases, "CHUNK", 400)
    whole = common.stretches
    monkeypatch.setattr(phrases, "stretches", lambda data: whole(data, 50))
    assert collocated(docs, 40, least=5, bits=bits) == plain and len(plain) > 80


def test_chunks_take_little_memory():
    """A chunk's n-grams are computed and sorted piece by piece: all of it together took more than 70 bytes a word."""
    import tracemalloc

    chunk, draw, size = phrases._Chunk(), np.random.default_rng(3), 400_000
    numbers = [chunk.ids[b"w%d" % i] for i in range(5000)]
    chunk.add(draw.choice(np.array(numbers, np.int32), size), 0, 0, "en", 0)
    tracemalloc.start()
    try:
        found = sum(int(count.sum()) for _, _, count, _, _ in chunk.grams((2,), None, 0, 64))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == size - 1 and peak < 70 * size


def test_collocations_of_nothing(noise, empty):
    assert phrases.collocations(phrases.counts(empty)).count() == 0
    assert collocated(noise[1], least=10_000) == []


def test_scores_beyond_64_bits(spark):
    big = 6_000_000_000_000_000_000
    counted = [("en", "a b", 2, big), ("en", "a", 1, big), ("en", "b", 1, big), ("en", "", 0, big)]
    found = spark.createDataFrame(counted, "lang string, phrase string, n int, f long")
    assert phrases.collocations(found).first()["score"] == 1_000_000


# --- ranked search ------------------------------------------------------------------------


def plain_search(docs, items, top=20):
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    cut = lambda t: find.findall((t or "").translate(LOWER))
    held = [(d, Counter(w), len(w)) for d, t in docs if (w := cut(t))]
    n, total = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked = Counter(cut(text))
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in asked}
        scores = []
        for d, c, size in held:
            m = 75 + 25 * size * n // total
            s = sum(q * weights[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def searched(docs, items, **options):
    return sorted(map(tuple, lexical.search(docs, items, **options).collect()), key=repr)


def test_search_equals_scoring_all(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted(map(tuple, query_lexical.op13_lexical_search(spark, folder).collect()), key=repr) == plain


@pytest.mark.parametrize("limits", [{}, {"COLUMNS": 4, "SHARD": 30, "BLOCK": 3, "BLOCK_CHARS": 40}])
def test_search_odd_rows(spark, odd, empty, limits, monkeypatch):
    """Nulls, copies, ties, repeated items, clashing columns; with small limits also many shards, blocks and passes."""
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    draw = random.Random(11)
    words = ["Rain", "rain", "été", "7up", "a", "b_c", "long", "text", "word5", "short", "under", "-", "identifier"]
    more = [(100 + i // 2, " ".join(draw.choice(words) for _ in range(draw.randrange(12)))) for i in range(300)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("score", F.lit(0)).withColumn("terms", F.lit("x"))
    items = [(1, "rain rain été"), (2, None), (None, "A long text."), (3, "!!!"), (3, "7UP b_c word5"), (4, "rain rain été"), (1, "rain rain été"), (5, "nowhere"), (6, " ".join(words * 3))]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(1)).withColumn("rank", F.lit("r"))
    plain = plain_search([tuple(r) for r in docs.select("doc_id", "text").collect()], [i for i in items if i[1] is not None])
    assert searched(docs, asked) == plain and len(plain) > 60
    assert lexical.search(empty, asked).count() == 0 and lexical.search(docs, asked.limit(0)).count() == 0


def test_blocks_skip_and_lose_nothing():
    """Clustered documents: whole blocks are skipped, and the best are those of scoring all."""
    rng = np.random.default_rng(1)
    topics = [rng.choice(60, 12, replace=False) for _ in range(12)]
    rows, columns = [], []
    for d in range(3000):
        own = rng.choice(topics[d % 12], 8, replace=False)
        rows += [d] * 8
        columns += sorted(own)
    rows, columns = np.array(rows), np.array(columns)
    impacts, weights = rng.integers(1, 900_000, len(rows)), rng.integers(1, 5000, 60)
    queries = [np.sort(t[:6]) for t in topics]
    sets = [[q for q in queries if t in q] for t in range(60)]
    beside = [np.unique(np.concatenate(s)) if s else np.array([t]) for t, s in enumerate(sets)]
    shard = lexical.Shard(rows, columns, impacts, 3000, weights, beside)
    scored = 0
    import pyarrow as pa

    for q in queries:
        best = lexical._Best(20)
        scored += shard.search(q, weights[q], beside, 1, lambda r, s: best.offer(pa.array(range(3000)), r, s))
        whole = shard.table[:, q] @ weights[q]
        assert [-r[0] for r in best.rows] == sorted(whole.tolist(), reverse=True)[:20]
    held = sum((shard.table[:, q].any(axis=1)).sum() for q in queries)
    assert scored < 0.7 * held


def test_registered():
    from blotter.llm.queries import QUERIES, SQL

    assert {"op11_token_counts", "op12_collocations", "op13_lexical_search"} <= set(QUERIES)
    assert {"op12_collocations", "op13_lexical_search"} <= set(SQL)

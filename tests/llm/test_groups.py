"""Operators that compare rows with one another: near-duplicates, repeats, neighbours, archives, and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from blotter.llm import crosspolytope, induced, query_simhash, query_substrings, simhash, spans, substrings, warc
from blotter.llm.common import connected_components
from blotter.session import scratch_path


def print_of(text):
    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> i & 1 for h in hashes) > len(hashes)) << i for i in range(64))


def components_of(rows):
    """Smallest identifier of each row's component, pair by pair."""
    prints = [print_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return Counter((rows[i][0], f"{prints[i]:016x}", names.get(find(i))) for i in range(len(rows)))


def digest(docs):
    return Counter(tuple(r) for r in simhash.components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect())


def test_simhash_small_vocabulary(spark):
    draw = random.Random(3)
    bodies = [" ".join(draw.choice("abcdefgh") * 2 for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(160):
        words = draw.choice(bodies).split()
        for _ in range(draw.randrange(4)):
            words[draw.randrange(len(words))] = draw.choice(["ab", "cd"])
        rows.append((draw.randrange(200), " ".join(words).title()))
    assert digest(spark.createDataFrame(rows, "doc_id long, text string")) == components_of(rows)


def test_simhash_odd_rows(odd, empty):
    assert digest(odd) == components_of([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert simhash.components(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    kept = simhash.keep_one(odd).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([None, 4, 4, 5, None]) or len(kept) == len({print_of(r["text"]) for r in odd.collect()})
    assert len({print_of(r["text"]) for r in kept}) == len(kept) and set(kept[0].asDict()) == set(odd.columns)


def test_golay_keys_meet():
    draw = random.Random(1)
    for width in (21, 22, 23):
        for _ in range(300):
            a = draw.getrandbits(width)
            b = a
            for _ in range(draw.randrange(3)):
                b ^= 1 << draw.randrange(width)
            x, y = (set(simhash.fuzzy_keys(np.array([v]), width)[0].tolist()) - {-1} for v in (a, b))
            assert x & y


def test_links_of_hot_keys(spark):
    draw = np.random.default_rng(0)
    found = set()
    for centre in draw.integers(0, 2**63, 2, dtype=np.uint64):
        for _ in range(700):
            v = int(centre)
            for b in draw.integers(0, 64, draw.integers(0, 5)):
                v ^= 1 << int(b if draw.random() < 0.4 else b % 14)
            found.add(v)
    prints = np.array(sorted(found), np.uint64)
    signed = prints.view(np.int64).tolist()
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 2) + i + 1}
    links = simhash.links(spark.createDataFrame([(v, i) for i, v in enumerate(signed)], "fp long, first long"), bucket=16)
    assert {tuple(sorted((r["a"]["fp"], r["b"]["fp"]))) for r in links.collect()} == want


def test_components_of_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(40)] + [(7, 7), (300, 299), (299, 300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(40)}, 299: 299, 300: 299}


def spans_of(rows, words):
    """Removed sentences by document, from all stretches: of two sentences and 12 words, of over 50 words, of three and ``words``."""

    def runs(text):
        cut = [c.split() for c in re.split(r"(?<=[.!?])\s+|\s*\n\s*", text.casefold()) if c.strip()]
        n = range(len(cut) + 1)
        size = lambda i, j: sum(map(len, cut[i:j]))
        for least, load in [(2, 12), (1, 51), *([(3, words)] if words < 12 else [])]:
            kind = {(i, j) for i in n for j in n if j - i >= least and size(i, j) >= load}
            for i in n:
                for ends in ([r for r in kind if r[0] == i], [r for r in kind if r[1] == i]):
                    if ends:
                        i0, j0 = min(ends, key=lambda r: r[1] - r[0])
                        yield i0, j0 - i0, tuple(" ".join(c) for c in cut[i0:j0])

    seen, out = {}, {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0])):
        gone = set()
        for start, n, content in sorted(set(runs(t or ""))):
            if seen.setdefault(content, (d, start)) != (d, start):
                gone.update(range(start, start + n))
        out[d] = gone
    return out


@pytest.mark.parametrize("words", [12, 8])
def test_spans(spark, words):
    draw = random.Random(8)
    pool = [" ".join(draw.choice("abcdefghij") * 3 for _ in range(draw.randrange(1, 7))) + draw.choice(".!?") for _ in range(25)]
    shared = [" ".join(draw.sample(pool, 6)) for _ in range(4)]
    rows = [(i, " ".join(draw.sample(pool, 4)) + draw.choice(["\n", "  "]) + draw.choice(shared).upper() + " " + " ".join(draw.sample(pool, 3))) for i in range(40)]
    want = spans_of(rows, words)
    got = spans.dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=words).collect()
    assert sum(bool(x) for x in want.values()) > 20
    for r in got:
        assert r["n_removed"] == len(want[r["doc_id"]])
        where, at, kept = spans.pieces(r["text"]), 0, ""
        for i, (_, end) in enumerate(where):
            kept, at = kept + ("" if i in want[r["doc_id"]] else r["text"][at:end]), end
        assert r["kept_text"] == kept + r["text"][at:]
        at = kept = 0
        assert "".join(r["text"][a:b] for a, b in zip([0, *(x["end"] for x in r["removed"])], [*(x["start"] for x in r["removed"]), len(r["text"])])) == r["kept_text"]


def test_spans_of_few_sentences(spark):
    """Passages of over 50 words in one, two and three sentences, between unlike neighbours and partial sentences."""
    draw = random.Random(9)
    fresh = lambda n: " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))
    whole = [[fresh(55)], [fresh(20), fresh(35)], [fresh(2), fresh(50), fresh(1)], [fresh(1), fresh(11)]]
    rows = []
    for case, passage in enumerate(whole):
        held = fresh(20) + ". " + ". ".join(passage) + ". " + fresh(20)
        rows += [(10 * case + i, f"{fresh(3)}. {fresh(4)} {held} {fresh(2)}. {fresh(5)}.") for i in range(2)]
    got = {r["doc_id"]: r for r in spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for case, passage in enumerate(whole):
        first, second = got[10 * case], got[10 * case + 1]
        assert first["n_removed"] == 0
        assert second["n_removed"] == len(passage) and not any(p in second["kept_text"] for p in passage)


def test_spans_odd_rows(odd, empty):
    got = spans.dedup(odd).collect()
    assert len(got) == odd.count() and spans.dedup(empty).count() == 0
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["kept_text"] is None and by_id[6]["n_removed"] == by_id[6]["n_sentences"] > 0 and by_id[5]["n_removed"] < by_id[5]["n_sentences"]
    assert [r["n_removed"] for r in got if r["doc_id"] == 4] == [0, 0, 0]


def test_induced_order():
    draw = np.random.default_rng(0)
    for trial in range(150):
        base = draw.integers(1, draw.integers(1, 5) + 1, draw.integers(1, 150))
        base = np.concatenate([base, base[: draw.integers(0, len(base))], base]) if trial % 3 == 0 else base
        text, depth = np.append(base, 0).astype(np.uint16), int(draw.choice([3, 10, 1000]))
        order, prefix = induced.suffix_order(text, depth, memory=int(draw.choice([8, 10_000])))
        assert sorted(order.tolist()) == list(range(len(text)))
        t = text.tolist()
        for i in range(1, len(order)):
            a, b = t[order[i - 1] :], t[order[i] :]
            same = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert prefix[i] == min(same, depth) and a[:depth] >= b[:depth]


def test_queues_spill():
    scratch = induced.Scratch()
    queues = induced.Queues(scratch, 300)
    for i in range(5):
        n = np.arange(1000) + 1000 * i
        queues.push(n % 2, n.astype(np.int32), n.astype(np.int32))
    out = []
    while (part := queues.take(1)) is not None:
        out += part[0].tolist()
    scratch.close()
    assert out == list(range(1, 5000, 2)) and scratch.number > 0


def test_queues_together():
    """Stretches that wait in memory come as one, in their order; those on disk come one by one."""
    scratch = induced.Scratch()
    queues = induced.Queues(scratch, 10_000)
    for i in range(5):
        n = np.arange(1000) + 1000 * i
        queues.push(n % 2, n.astype(np.int32), n.astype(np.int32))
    assert queues.take(1)[0].tolist() == list(range(1, 5000, 2)) and queues.take(1) is None
    assert queues.held == 2500 and scratch.number == 0
    scratch.close()


def shard_of(contents, length, gram):
    batch = pa.RecordBatch.from_pylist([{"s1": i, "s2": 0, "n": len(d) - length + 1, "data": d} for i, d in enumerate(contents)])
    return sorted((r["s1"], r["low"], r["high"]) for out in substrings._shard(iter([batch]), length, gram) for r in out.to_pylist())


def test_shard_sorts_what_may_repeat(monkeypatch):
    """Contents that share no side of their leader with another one are not sorted; what repeats is found all the same."""
    draw = random.Random(3)
    make = lambda n: bytes(draw.choices(b"abcdefgh", k=n))
    sizes, whole = [], substrings.suffix_order
    monkeypatch.setattr(substrings, "suffix_order", lambda text, *rest, **more: sizes.append(len(text)) or whole(text, *rest, **more))
    for length, gram in ((100, 20), (101, 20)):
        half, met = -(-(length - gram) // 2), 0
        for _ in range(30):
            base = make(5 * length)
            place = draw.randrange(len(base))
            changed = base[:place] + b"z" + base[place + 1 :]
            first, second = ({lead: t[a : a + n + length - 1] for lead, a, n in substrings.stretches(t, length, gram)} for t in (base, changed))
            for lead in first.keys() & second.keys():
                sizes.clear()
                pair = first[lead], second[lead]
                if pair[0] == pair[1]:
                    continue
                windows = [[d[a : a + length] for a in range(len(d) - length + 1)] for d in pair]
                got = shard_of([*pair, *(make(length) for _ in range(20))], length, gram)
                expected = [(i, a) for i in (0, 1) for a, w in enumerate(windows[i]) if w in windows[1 - i]]
                assert [(i, a) for i, low, high in got for a in range(low, high)] == expected
                assert sum(sizes) <= sum(map(len, pair)) + 3
                assert all(s is None or len(s) == gram + half for d in pair for s in substrings.sides(d, length, gram))
                met += bool(expected)
        assert met > 5


def repeats_of(rows, length):
    windows = Counter(t[a : a + length] for _, t in rows for a in range(len(t) - length + 1))
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if windows[t[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"shard_bytes": 2000}])
def test_substrings(spark, options):
    draw = random.Random(9)
    make = lambda n: "".join(draw.choice("abé ") for _ in range(n))
    shared = [make(draw.randrange(30, 90)) for _ in range(5)]
    rows = [(i, make(draw.randrange(30)) + draw.choice(shared) + make(draw.randrange(40)) + draw.choice(shared)[: draw.randrange(90)]) for i in range(60)]
    rows += [(1, rows[1][1]), (None, rows[2][1]), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in query_substrings.digest(docs, length=40, gram=12, **options).collect())
    assert got == repeats_of([(d, (t or "").encode()) for d, t in rows], 40)


def test_substrings_near_copies(spark, monkeypatch):
    """Contents of a crowded leader are cut into blocks of many windows; only blocks that hold a difference are cut further."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefgh", k=6))
    base, rows, cut = [word() for _ in range(40)], [], []
    for i in range(60):
        text = list(base)
        text[draw.randrange(40)] = word()
        rows.append((i, " ".join(text)))
    whole = substrings._blocks

    def counted(hot, *rest):
        windows = hot.agg(F.sum("n")).first()[0]
        out = whole(hot, *rest)
        cut.append((out.count(), windows, rest[-1]))
        return out

    monkeypatch.setattr(substrings, "_blocks", counted)
    got = Counter(tuple(r) for r in query_substrings.digest(spark.createDataFrame(rows, "doc_id long, text string"), length=100, gram=20, hot=16).collect())
    assert got == repeats_of([(d, t.encode()) for d, t in rows], 100)
    assert cut and cut[0][0] < cut[0][1] / 8 and sum(n for n, _, _ in cut) < cut[0][1] / 3


def test_substrings_chunks(spark, monkeypatch):
    data = bytes(random.Random(1).choices(b"ab", k=5000))
    whole = {a + i for _, a, n in substrings.stretches(data, 40, 12) for i in range(n)}
    monkeypatch.setattr(substrings, "CHUNK", 256)
    pieces = [(a, n) for _, a, n in substrings.stretches(data, 40, 12)]
    assert sum(n for _, n in pieces) == len(whole) == 4961 and {a + i for a, n in pieces for i in range(n)} == whole


def test_substrings_odd_rows(odd, empty):
    got = query_substrings.digest(odd).collect()
    assert len(got) == odd.count() and query_substrings.digest(empty).count() == 0
    assert {r["doc_id"]: r["n_removed"] == r["n_bytes"] for r in got}[5]


def neighbours(rows, k):
    usual = Counter(len(v) for _, v in rows if v).most_common(1)[0][0]
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == usual and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    unique = {(i, v.tobytes()): v for i, v in good}
    out = {}
    for i, _ in {(i, 0) for i, _ in unique if i % 20 == 0}:
        near = sorted((-float(np.dot(v, w)), j) for (q, _), v in unique.items() if q == i for (j, _), w in unique.items() if j != i)
        out[i] = near[:k]
    return out


def test_nearest_exhaustive(spark):
    """Small tables are probed whole, so the answer is exact; lengths differ, vectors repeat, some are no vectors."""
    draw = np.random.default_rng(2)
    rows = [(i, (draw.normal(size=8) * draw.uniform(0.5, 3)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[40][1]) for i in range(60)]
    rows += [(900, None), (920, [0.0] * 8), (940, [float("nan")] * 8), (960, [1.0]), (980, [None] * 8), (40, rows[40][1]), (None, rows[1][1])]
    got = {}
    for r in crosspolytope.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = neighbours(rows, 20)
    assert set(got) == set(want)
    for i, near in want.items():
        found = sorted(got[i])
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert np.allclose([-s for s, _ in near], [s for _, _, s in found], atol=1e-12)
        assert {j for _, j, _ in found} == {j for _, j in near}


def test_nearest_recall(spark):
    folder = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = {}
    for r in crosspolytope.search(table, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    hits = 0
    for q in got:
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert crosspolytope.search(none, F.col("id") % 20 == 0).count() == 0


def test_deeper_hashing():
    assert crosspolytope.plan(100_000, 64)[0] == 1 and crosspolytope.plan(10**9, 64)[0] >= 3
    draw = np.random.default_rng(1)
    flat = crosspolytope.unit(draw.normal(size=(50, 8)), 0.0, False)
    codes = crosspolytope.buckets(flat, 0, 2, 6)
    assert codes.shape == (50, 6) and all(len(set(c)) == 6 for c in codes.tolist()) and codes.max() < 16**2


@pytest.mark.parametrize(("vectors", "depth"), [(51_282, 1), (4_300_000, 2), (10**9, 3)])
def test_planned_chance(vectors, depth):
    """Pairs at the cosine of the 20th nearest, hashed in every planned table; other draws than the plan's own."""
    draw = np.random.default_rng(12)
    found, tables, probes = crosspolytope.plan(vectors, 64)
    cosine = crosspolytope.near_cosine(vectors, 64, 20)
    a, b = (crosspolytope.unit(x, 0.0, False) for x in draw.normal(size=(2, 200, 64)))
    b -= (a * b).sum(1, keepdims=True) * a
    b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = np.zeros(200, bool)
    for t in range(tables):
        met |= (crosspolytope.buckets(a, t, depth, probes) == crosspolytope.buckets(b, t, depth, 1)).any(1)
    assert found == depth and met.mean() >= 0.88


@pytest.mark.parametrize("depth", [2, 3])
def test_nearest_recall_of_deeper_tables(spark, depth, monkeypatch):
    """Forced depth against brute force, without the widening for small tables."""
    monkeypatch.setattr(crosspolytope, "CANDIDATES", 0)
    x = np.random.default_rng(3).normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in crosspolytope.search(frame, F.col("id") % 100 == 0, depth=depth).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(got.get(q, set()) & set(np.argsort(-(x @ x[q]))[1:21].tolist())) for q in range(0, 3000, 100))
    print("recall", depth, hits / 600)
    assert hits >= 0.9 * 600


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archive_round_trip(spark):
    rows = [(i, f"http://a/{i % 7}", "<p>" + "x" * (i % 5) + "</p>") for i in range(50)]
    rows += [(50, None, None), (51, "http://é", None), (None, "u", "only"), (3, "http://a/3", rows[3][2]), (52, "http://b\r\nX: y", "é€")]
    folders = [scratch_path(spark, "archive") for _ in range(2)]
    names = []
    for folder in folders:
        manifest = warc.write(pages_of(spark, rows), folder, shard_bytes=4000, roll_bytes=1500)
        names.append({(r["name"], r["sha256"], r["bytes"]) for r in manifest.collect()})
    assert names[0] == names[1] and len(names[0]) > 4
    got = warc.read(spark, folders[0]).collect()
    assert len(got) == len(rows)
    keeper = {}
    for p, u, h in rows:
        if h not in keeper or (p is not None and p > (keeper[h] if keeper[h] is not None else -1)):
            keeper[h] = p
    for r in got:
        page = None if r["page_id"] is None else int(r["page_id"])
        html = next(h or "" for p, u, h in rows if p == page)
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == warc.base32(hashlib.sha1(html.encode()).digest())
        assert r["payload"] is None or bytes(r["payload"]) == html.encode()
    digests = Counter(r["payload_digest"] for r in got if r["record_type"] == "response")
    assert set(digests.values()) == {1} and len(digests) == len({h or "" for _, _, h in rows})
    assert all((r["refers_to"] is None) == (r["record_type"] == "response") for r in got)


@pytest.mark.parametrize("kind", ["far", "extreme", "one"])
def test_archive_shards_in_page_order(spark, kind):
    """One far identifier, the two ends of the range, many rows of one page: shards stay ranges of pages, no row is lost."""
    pages = {"far": [*range(1, 1500), 10**15], "extreme": [-(2**63), 2**63 - 1, *range(-300, 300)], "one": [7] * 400 + [*range(10, 400)]}[kind]
    rows = [(p, f"http://a/{i}", f"<p>{p} {i}" + "x" * 200) for i, p in enumerate(pages)]
    docs = pages_of(spark, rows).withColumn("shard", F.lit("x")).withColumn("slice", F.lit(1)).withColumn("size", F.lit(None))
    folder = scratch_path(spark, "archive")
    manifest = {r["name"]: r["shard"] for r in warc.write(docs, folder, shard_bytes=40_000).collect()}
    got = warc.read(spark, folder).collect()
    assert sorted(int(r["page_id"]) for r in got) == sorted(pages)
    spans = {}
    for r in got:
        spans.setdefault(next(shard for name, shard in manifest.items() if r["file"].endswith(name)), []).append(int(r["page_id"]))
    edges = [(min(v), max(v)) for _, v in sorted(spans.items())]
    assert len(edges) > 5 and all(a[1] < b[0] or (kind == "one" and a[1] == b[0] == 7) for a, b in zip(edges, edges[1:]))


def test_archive_least_and_empty(spark):
    rows = [(1, "a", "x"), (2, "b", "x"), (3, "c", "yy"), (4, "d", "yy")]
    folder = scratch_path(spark, "archive")
    warc.write(pages_of(spark, rows), folder, least=2)
    assert {int(r["page_id"]): r["refers_to"] for r in warc.read(spark, folder).collect()} == {1: None, 2: None, 3: "4", 4: None}
    folder = scratch_path(spark, "archive")
    assert warc.write(pages_of(spark, rows[:0]), folder).count() == 0 and warc.read(spark, folder).count() == 0


def test_repeated_commit_and_broken_archive(spark):
    record = warc.record({"page": "1", "url": "u", "payload": b"abc", "size": 3, "sha": hashlib.sha1(b"abc").digest(), "keeper": None, "keeper_url": None}, warc.DATE)
    import io

    (fields, block), = warc.records(io.BytesIO(record))
    assert warc.parse(fields, block)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(fields, block[:-1] + b"X")
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(record[:-3])))


def test_pipeline(spark, small, documents):
    """Against plain steps: rejected languages, one of each component, no leaks, redacted texts, token digests."""
    import public_tokenizers
    import tiktoken

    from blotter.llm import bpe, decontaminate, langid
    from tests.llm.test_text import all_spans

    model = langid.fit(documents)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    rejected = {r["doc_id"] for r in langid.predict(documents, model).collect() if r["rejected"]}
    rows = [r for r in rows if r[0] not in rejected]
    names = {d: c for d, _, c in components_of(rows)}
    rows = [r for r in rows if names[r[0]] == r[0]]
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    find = decontaminate.Matcher(items, decontaminate.RATE).find
    rows = [r for r in rows if not find(decontaminate.normal(r[1]))]
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    want = set()
    for d, text in rows:
        out = at = 0
        parts = []
        for s, _, e in all_spans(text, 400):
            if s >= at:
                parts += [text[at:s], "[SECRET]"]
            at = max(at, e)
        out = "".join(parts) + text[at:]
        ids = reference.encode_ordinary(out)
        want.add((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(out.encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, small).collect()} == want


def test_stages_on_odd_rows(spark, odd, empty, small):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, small)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == docs.count()


def test_registered_queries(spark, small):
    found = query_simhash.op5_simhash(spark, small).collect()
    assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) and r["component_id"] <= r["doc_id"] for r in found)

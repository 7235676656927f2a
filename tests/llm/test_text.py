"""Operators that look at one text at a time: BPE, language, licences, secrets, decontamination."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from blotter.llm import bpe, decontaminate, langid, licenses, query_bpe, query_langid, query_licenses, query_secrets, secrets

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {t: i for i, t in enumerate(bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(documents, reference):
    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    for r in query_bpe.digests(documents).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_random_texts(reference):
    tokens = bpe.read_ranks(PATH)
    encoder, draw = bpe.Encoder(tokens, bpe.serialise(tokens), public_tokenizers.PATTERN), random.Random(5)
    for _ in range(500):
        text = "".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(0x250), draw.randrange(0x4E00, 0x9FFF), 0x1F600, 10, 32])) for _ in range(draw.randrange(150)))
        assert encoder.encode(text) == reference.encode_ordinary(text)
        assert b"".join(tokens[i] for i in encoder.encode(text)).decode() == text


def test_bpe_packed_identifiers(reference, monkeypatch):
    """Identifiers are kept and joined as bytes, also when what is remembered starts anew within a text's words."""
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    tokens = bpe.read_ranks(PATH)
    encoder, text = bpe.Encoder(tokens, bpe.serialise(tokens), public_tokenizers.PATTERN), "aé zq\x00 the the qzxv don't \U0001f600 "
    for t in ("", text, text * 3, text[::-1], text):
        packed = encoder.packed(t)
        assert isinstance(packed, bytes) and np.frombuffer(packed, np.int32).tolist() == encoder.encode(t) == reference.encode_ordinary(t)


def test_bpe_odd_rows(odd, empty, reference):
    encoded = bpe.encode(odd, PATH, public_tokenizers.PATTERN)
    assert encoded.columns == [*odd.columns, "_token_ids"]
    decoded = bpe.decode(encoded, PATH, "_token_ids")
    assert decoded.columns[-1] == "_decoded"
    for r in decoded.collect():
        assert r["_token_ids"] == reference.encode_ordinary(r["text"] or "") and bytes(r["_decoded"]).decode() == (r["text"] or "")
    assert query_bpe.digests(empty).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = query_langid.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.collect()
    tested = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and 0 < len(tested) < len(rows)
    assert sum(r["lang_pred"] == r["lang"] for r in tested) >= 0.98 * len(tested)
    assert sum(r["rejected"] for r in rows) <= 0.001 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def foreign_texts():
    import base64

    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz    "
    return [
        "La mattina dopo la pioggia il mercato era pieno di gente che comprava verdure fresche e pane appena sfornato per la cena. ",
        "Rano po deszczu targ był pełen ludzi, którzy kupowali świeże warzywa i dopiero co upieczony chleb na rodzinną kolację. ",
        "Aamulla sateen jälkeen tori oli täynnä ihmisiä, jotka ostivat tuoreita vihanneksia ja vastapaistettua leipää. ",
        "Утром после дождя рынок был полон людей, которые покупали свежие овощи и только что испечённый хлеб к ужину. ",
        "雨后的早晨,市场上挤满了人,他们为家里的晚餐购买新鲜的蔬菜和刚出炉的面包。",
        "".join(draw.choice(letters) for _ in range(400)),
        base64.b64encode(draw.randbytes(300)).decode(),
    ]


def test_language_rejects_foreign_texts(spark):
    """Unlearned languages and junk go, all clean rows that were held out stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    clean = langid.predict(docs.filter(langid.held_out()), model, keep=["doc_id"]).filter("rejected").count()
    rows = langid.predict(spark.createDataFrame(list(enumerate(foreign_texts() + [t * 30 for t in foreign_texts()])), "doc_id long, text string"), model).collect()
    assert clean == 0 and [r["text"][:20] for r in rows if not r["rejected"]] == []


def test_language_ignores_labels_of_held_out_rows(documents):
    turned = documents.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    model = langid.fit(turned)
    assert "zz" not in model.languages


def test_language_odd_rows(odd, empty, documents):
    rows = langid.predict(odd, langid.fit(documents)).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r["_lang_pred"] == "und") == (not re.search(r"[A-Za-z]", r["text"] or ""))
        assert (r["_score"] == 0.0 and r["rejected"]) or r["_lang_pred"] != "und"
    assert langid.fit(empty) is None
    assert {r["_lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.predict(empty, None).count() == 0
    nameless = documents.withColumn("lang", F.lit(None).cast("string"))
    assert langid.fit(nameless) is None


def test_subwords_of_blocks(monkeypatch):
    text = "Straße und Wörter " * 50
    whole = langid.subword_counts(text)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert (langid.subword_counts(text) == whole).all()


def test_licence_catalogue():
    for sentence in licenses.catalogue():
        assert any(a in sentence for a in licenses.ANCHORS)
    assert len(licenses.catalogue()) == len(licenses.SENTENCES) + len(licenses.LICENCES)
    assert all(len(re.split(licenses.END, t)) == 1 for t in licenses.SENTENCES.values())
    assert {i for _, run in licenses.rules() for i in run} <= set(licenses.catalogue().values())


MIT = "\n\n".join(licenses.SENTENCES[i] for i in ("mit_grant", "mit_notice", "as_is_mit", "liability_mit"))


@pytest.mark.parametrize(
    ("text", "names", "unmatched"),
    [
        (MIT, ["MIT"], 0),
        (re.sub(r"(.{60}\S*) ", r"\1\n", MIT), ["MIT"], 0),
        ("x y.\n  Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\n", ["Apache-2.0", "MIT"], 0),
        (licenses.SENTENCES["as_is_mit"], [], 1),
        ("// SPDX-License-Identifier: MPL-2.0\nint x;", ["MPL-2.0"], 0),
        ("Released under the MIT License. Released under the MIT License.", ["MIT"], 0),
        ("A license of another kind.", [], 0),
        (" ".join(licenses.SENTENCES[i] for i in ("free_software", "gpl2_may", "gpl2_later", "gpl_hope")), ["GPL-2.0-or-later"], 1),
        ("\n".join(licenses.SENTENCES[i] for i in ("free_software", "gpl3_may")), ["GPL-3.0-or-later"], 0),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["MPL-2.0"], 0),
        (None, [], 0),
    ],
)
def test_licences(spark, text, names, unmatched):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["licences"], row["unmatched"]) == (names, unmatched)
    assert licenses.sequence_matches(row["license_sentences"])[0] == names or text != MIT


def wrapped(*paragraphs, width=70):
    import textwrap

    return "\n\n".join(textwrap.fill(p, width) for p in paragraphs) + "\n"


S = licenses.SENTENCES
BSD = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."
FILES = {
    "MIT": wrapped("MIT License", "Copyright (c) 2020 Jane Doe", S["mit_grant"], S["mit_notice"], S["as_is_mit"] + " " + S["liability_mit"]),
    "ISC": wrapped("ISC License", "Copyright (c) 2020, Jane Doe", S["isc_grant"], S["as_is_mit"]),
    "BSD-2-Clause": wrapped("BSD 2-Clause License", "Copyright (c) 2020, Jane Doe") + "All rights reserved.\n\n" + wrapped(S["bsd_grant"], "1. " + S["bsd_source"], "2. " + S["bsd_binary"], BSD),
    "BSD-3-Clause": wrapped("BSD 3-Clause License", "Copyright (c) 2020, Jane Doe") + wrapped(S["bsd_grant"], "1. " + S["bsd_source"], "2. " + S["bsd_binary"], "3. " + S["bsd_names"], BSD),
}


@pytest.mark.parametrize("layout", ["plain", "tight", "comment", "windows"])
def test_licence_files(spark, layout):
    change = {
        "plain": lambda t: t,
        "tight": lambda t: t.replace("\n\n", "\n"),
        "comment": lambda t: "/*\n" + "".join(f" * {line}".rstrip() + "\n" for line in t.splitlines()) + " */\n\nint x;",
        "windows": lambda t: t.replace("1. ", "(1) ").replace("2. ", "b) ").replace("\n", "\r\n"),
    }[layout]
    rows = spark.createDataFrame([(n, change(t) + extra) for n, t in FILES.items() for extra in ("", "\nReleased under the\nMIT License.\n\nLicensed under CC0 1.0.\nx")], "doc_id string, text string")
    for r in licenses.scan(rows).collect():
        more = ["CC0-1.0", "MIT"] if r["text"].endswith("x") else []
        assert set(r["licences"]) == {r["doc_id"], *more}, r


def test_licences_odd_rows(odd, empty):
    rows = licenses.scan(odd)
    assert rows.count() == odd.count() and rows.columns[-3] == "_licences"
    assert licenses.scan(empty).count() == 0


def base_spans(text):
    """The contract's three kinds with a plain pattern engine."""
    found = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        found += [(m.start(), 0, m.end())] if len(m[1]) >= 8 else []
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def random_secret_text(draw):
    words = ["token = ", "PassWord:'", "AKIA", "AKIAABCDEFGHIJKLMN", "a1" * 20, "login: bob_1", "https://host.example.com/x", "é€😀", " ", "\n", "api_key=abc", "x" * 150, "Qw3" * 12, "secret:secret=abcdefgh1", "pwd: hunter22"]
    return "".join(draw.choice(words) + draw.choice(["", " ", "  "]) for _ in range(draw.randrange(30)))


def all_spans(text, scope):
    """Base spans plus linked weak parts, pair by pair."""
    spans = base_spans(text)
    weak = []
    for i, kind in enumerate(secrets.KINDS):
        if kind.weak:
            for m in re.finditer(kind.pattern, text, re.ASCII):
                if all(re.search(v, m[0]) for v in kind.valid) and not any(s < m.end() and m.start() < e for s, _, e in spans):
                    weak.append((m.start(), i, m.end()))
    roles = {r: [s for s in spans + weak if secrets.KINDS[s[1]].role == r] for r in ("id", "secret")}
    near = lambda p, r: any(abs(q[0] - p[0]) <= scope for q in roles[r])
    needed = {"id": ["secret"], "secret": ["id"], "endpoint": ["id", "secret"]}
    return sorted(spans + [p for p in weak if all(near(p, r) for r in needed[secrets.KINDS[p[1]].role])])


def test_secrets_against_pairs(spark):
    draw = random.Random(2)
    texts = [random_secret_text(draw) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for scope in (20, 400):
        for r in secrets.spans(docs, scope=scope).collect():
            assert [tuple(s) for s in r["spans"]] == all_spans(r["text"], scope), r["text"]


def test_secret_digest(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in query_secrets.digest(documents).collect():
        want = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base_spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_secrets_of_many_matches(spark):
    """200,000 assignments in one text, and as many weak parts in another, each in well under a minute."""
    import time

    n = 200_000
    strong, mixed = "token=abcdefgh1 ", "token=abcdefgh1 login: someone pass=abcdefg "
    docs = spark.createDataFrame([(1, strong * n), (2, mixed * (n // 2))], "doc_id long, text string")
    started = time.time()
    found = secrets.spans(docs, keep=["doc_id"]).select("doc_id", F.size("spans").alias("n"), F.element_at("spans", 1).alias("first"), F.element_at("spans", -1).alias("last")).collect()
    assert time.time() - started < 120
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[1]["n"] == n and by_id[1]["last"]["end"] == len(strong) * n - 1
    assert by_id[2]["n"] == 3 * (n // 2) and by_id[2]["last"]["end"] == len(mixed) * (n // 2) - 1
    assert by_id[2]["first"]["start"] == 0


def test_secrets_odd_rows(spark, odd, empty):
    assert secrets.spans(odd).count() == odd.count() and secrets.spans(odd).columns[-1] == "_spans"
    assert secrets.spans(empty).count() == 0
    twice = spark.createDataFrame([(None, "token = abcdefgh12 login: bob"), (None, "token = abcdefgh12 login: bob"), (1, "login: bob")], "doc_id long, text string")
    rows = [r["spans"] for r in secrets.spans(twice).collect()]
    assert sorted(map(len, rows)) == [0, 2, 2]


def test_redaction(spark):
    text = "é token = abcdefgh12 then " + "ab" * 20 + " end"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "plain"), (4, "secret:token=abcdefgh1")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redact(rows).collect()}
    assert got == {1: "é [SECRET] then [SECRET] end", 2: None, 3: "plain", 4: "[SECRET]"}


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return min(row)


def test_bit_parallel_distance():
    draw = random.Random(4)
    for _ in range(400):
        item, text = ("".join(draw.choice("abc ") for _ in range(draw.randrange(low, 80))) for low in (1, 0))
        assert decontaminate.distance(decontaminate.letter_masks(item), len(item), text)[0] == edits(item, text)


def test_leaks_against_full_distances(spark):
    draw = random.Random(6)
    make = lambda n: "".join(draw.choice("abcdefg h") for _ in range(n))
    items = [make(draw.randrange(40, 120)) for _ in range(6)]
    docs = []
    for i in range(60):
        item = list(draw.choice(items))
        for _ in range(draw.randrange(12)):
            item[draw.randrange(len(item))] = draw.choice(["", "z", "qq"])
        docs.append((i, make(draw.randrange(50)) + "".join(item).upper() + "\n " + make(draw.randrange(50))))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = {}
    for i, text in docs:
        for k, item in enumerate(map(decontaminate.normal, items)):
            d = edits(item, decontaminate.normal(text))
            if len(item) >= decontaminate.LEAST and d <= int(len(item) * 0.1):
                want[i, k] = d
    assert len(want) > 10
    for block in (1_000_000, 100):
        rows = decontaminate.leaks(frame, table, rate=0.1, block_chars=block).collect()
        assert {(r["doc_id"], x["item_id"]): x["edits"] for r in rows for x in r["leaks"]} == want
        left = {r["doc_id"] for r in decontaminate.clean(frame, table, rate=0.1, block_chars=block).collect()}
        assert left == {i for i, _ in docs} - {i for i, _ in want}


def test_short_items_are_searched_exactly(spark):
    items = spark.createDataFrame([(1, "What is 2 + 2?"), (2, "art"), (3, " ")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Q: what  is 2 + 2? Four."), (2, "What is 2 + 3?"), (3, "A party; smart."), (4, "Party of art."), (5, "art")], "doc_id long, text string")
    hits = {(r["doc_id"], x["item_id"], x["edits"], x["end"]) for r in decontaminate.leaks(docs, items).collect() for x in r["leaks"]}
    assert hits == {(1, 1, 0, 17), (4, 2, 0, 12), (5, 2, 0, 3)}
    assert {r["doc_id"] for r in decontaminate.clean(docs, items).collect()} == {2, 3}


def test_leaks_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "A text without an identifier. And then some more."), (3, "word1 of a long text. word2 of a long text.")], "item_id long, text string")
    hits = {(r["doc_id"], x["item_id"]) for r in decontaminate.leaks(odd, items, keep=["doc_id"]).collect() for x in r["leaks"]}
    assert hits == {(5, 3), (6, 3)}
    assert decontaminate.leaks(empty, items).count() == 0 and decontaminate.leaks(odd, items.limit(0)).count() == 0
    assert decontaminate.clean(odd, items).count() == odd.count() - 2 and decontaminate.clean(odd, items.limit(0)).count() == odd.count()


def test_query_names_agree():
    from blotter.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert {n for n in queries.SQL} == {"op1_warc", "op2_licenses", "op3_secrets", "op12_collocations", "op13_lexical_search"} and query_licenses

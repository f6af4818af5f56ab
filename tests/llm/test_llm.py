"""The operators on small tables: against brute force, and on rows of every odd kind."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402

from stowage.llm import batches, binary_records, bpe, langid, licenses, multiindex, ngram_join, pii, quality, sharding, tagger, templates  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, class_id string, ids string, score string"
LONG = "the quick brown fox jumps over " * 20_000
ODD = [None, "", " \n\t ", "...!!", "a", "é" * 50, "\x00\x1c  😀 日本語", LONG]


def table(spark, texts, ids=None, lang=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, lang[k] if lang else None, None, None if t is None else len(t), "x", "x", "x", None) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def odd_table(spark):
    """Null ids, repeated rows, ties and odd texts, with columns that clash by name."""
    return table(spark, [*ODD, "a b c d e f", "a b c d e f", None, "a b c d e f"], [*range(len(ODD)), 100, 100, None, None])


def random_texts(n, seed=1, vocabulary=400):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(vocabulary)]
    return [" ".join(rng.choices(words, k=rng.randint(3, 80))) for _ in range(n)]


# 1 licences


def test_license_forms(spark):
    mit = licenses.TEXTS["MIT"]
    changed = mit.upper().replace("<YEAR> <COPYRIGHT HOLDERS>", "2020 Someone Else").replace(",", " ;").replace("LICENSE", "LICENCE").replace("\n", "\n\n  ")
    rows = licenses.scan_licenses(table(spark, [mit, changed, mit + " more", "Text.\nreleased under the mit licence", None, ""])).orderBy("doc_id").collect()
    assert [r.license for r in rows] == ["MIT", "MIT", None, None, None, None]
    assert rows[0].digest == rows[1].digest and rows[3].notices == "MIT" and rows[4].digest == rows[5].digest
    known = licenses.known(spark, licenses.TEXTS)
    assert known.count() == len(licenses.TEXTS)
    assert licenses.scan_licenses(odd_table(spark)).count() == 12
    assert licenses.scan_licenses(odd_table(spark).limit(0)).count() == 0


def rewrapped(text, width, prefix=""):
    """Paragraphs wrapped anew; lines of holders and titles stay lines."""
    import textwrap

    out = []
    for part in text.split("\n"):
        lines = [part] if len(part) < 60 else textwrap.wrap(part, width) or [""]
        out += [prefix + x for x in lines]
    return "\n".join(out)


@pytest.fixture(scope="module")
def license_texts():
    """(licence, text): whole licences in the forms in which they are published, and the system's own copies."""
    import os
    import re

    titles = {"MIT": ["The MIT License (MIT)", "MIT License:", "The MIT License", "Expat License"], "ISC": ["The ISC License", "ISC License (ISC)"], "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" License']}
    out = []
    for name, text in licenses.TEXTS.items():
        for width in (40, 61, 72, 79, 100, 10_000):
            out += [(name, rewrapped(text, width)), (name, rewrapped(text, width, "# ")), (name, rewrapped(text, width, " * "))]
        body = text.split("\n\n", 1)[1] if "License" in text.split("\n")[0] else text
        for title in titles.get(name, []):
            out.append((name, title + "\n\n" + body.replace("<year>", "1999-2020").replace("<copyright holders>", "Some One <some@one.org>").replace("<owner>", "Else, Inc. All rights reserved.")))
        out.append((name, body.replace("Copyright (c) <year>", "COPYRIGHT © 2001,") + "\n"))
    where = "/usr/share/common-licenses"
    for name, file in {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "MPL-1.1": "MPL-1.1"}.items():
        if os.path.exists(f"{where}/{file}"):
            text = open(f"{where}/{file}", encoding="utf-8", errors="replace").read()
            out += [(name, text), (name, text.upper()), (name, re.sub(r"(?m)^", "// ", text)), (name, text.replace("https:", "http:").replace('"', "''"))]
    return out


def test_whole_licenses_are_found(spark, license_texts):
    docs = table(spark, [t for _, t in license_texts])
    got = {r.doc_id: r.license for r in licenses.scan_licenses(docs).collect()}
    wrong = [(want, got[k], text[:80]) for k, (want, text) in enumerate(license_texts) if got[k] != want]
    assert not wrong, wrong[:5]
    # A sentence more or less makes another text.
    changed = table(spark, [t + "\nNo use on Sundays." for _, t in license_texts])
    assert {r.license for r in licenses.scan_licenses(changed).collect()} == {None}


def test_license_sql_finds_the_same(spark, license_texts, tmp_path):
    """The SQL on a table of whole licences, notices and odd texts."""
    import duckdb

    texts = [t for _, t in license_texts] + list(licenses.NOTICES) + [f"Some\n  // {x}\nlines" for x in licenses.NOTICES] + [x for x in ODD if x is None or "\x00" not in x]
    docs = table(spark, texts).select("doc_id", "text")
    docs.write.parquet(f"{tmp_path}/documents")
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    want = db.sql(f"select doc_id, digest, license, notices from ({licenses.scan_sql()}) order by 1").fetchall()
    assert [tuple(r) for r in licenses.scan_licenses(docs).select("doc_id", "digest", "license", "notices").orderBy("doc_id").collect()] == want


def test_license_canonical_form_by_hand(spark):
    """The form written out without the scan's patterns."""
    cases = {
        "Copyright (c) 2020 A\nCOPYRIGHT NOTICE and this\npermission": "copyright notice and this permission",
        "  (c) 2001 B\n(c) You must keep it": "c you must keep it",
        "© Me\nAll rights reserved.\nAll rights reserved here": "all rights reserved here",
        "The MIT License (MIT)\n\nThe licence's sub-licensees recognise non commercial acknowledgements": "the license s sublicensees recognize noncommercial acknowledgments",
        "see https://x.org, NOW": "see http x org now",
        "mit license is what it has": "mit license is what it has",
    }
    docs = table(spark, list(cases))
    got = [r.digest for r in licenses.scan_licenses(docs).orderBy("doc_id").collect()]
    assert got == [hashlib.sha256(x.encode()).hexdigest() for x in cases.values()]


# 2 nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank int")


def brute_neighbours(x, ids, q, k):
    scores = (x * x[q]).sum(1)
    order = sorted((-s, i) for s, i in zip(scores.tolist(), ids, strict=True) if i != ids[q])
    return [i for _, i in order[:k]]


def test_neighbours_small_table_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[100:160] = x[7]  # many copies: ties go to smaller ids
    rows = [(i, x[i].tolist(), "s", 1) for i in range(300)]
    bad = [(900, None, "s", 1), (901, [0.0] * 8, "s", 1), (902, [float("nan")] + [1.0] * 7, "s", 1), (903, [float("inf")] + [1.0] * 7, "s", 1), (904, [None] + [1.0] * 7, "s", 1), (905, [1.0] * 3, "s", 1), (None, [1.0] * 8, "s", 1), rows[20]]
    got = multiindex.search(vectors(spark, rows + bad), batches.F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
    x = x.astype(np.float64)
    assert by == {q: brute_neighbours(x, list(range(300)), q, 20) for q in range(0, 300, 20)}
    assert all(abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-12 for r in got)


def test_neighbours_few_and_none(spark):
    got = multiindex.search(vectors(spark, [(0, [1.0, 0.0], "s", 1), (1, [1.0, 0.0], "s", 1), (2, [0.0, 1.0], "s", 1)]), batches.F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 1, 1.0), (2, 2, 0.0)]
    assert multiindex.search(vectors(spark, []), batches.F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_recall_and_cells_in_order():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 16))
    x = centers[rng.integers(0, 40, 4000)] + 0.4 * rng.normal(size=(4000, 16))
    index = multiindex.fit(x, 20)
    cells = index.cells(x)
    index.place(np.bincount(cells, minlength=len(index.left) * len(index.right)), chunk=200)
    hits = 0
    for q in range(0, 4000, 40):
        reach, chunks = index.visit(x[q])
        a, b = index.distances(x[q])
        sums = a[cells // len(index.right)] + b[cells % len(index.right)]
        inside = np.flatnonzero(sums <= reach)
        assert len(inside) >= index.wanted or len(inside) == 4000
        assert set(index.first[cells[inside]].tolist()) <= set(chunks)
        scores = x @ x[q]
        hits += len(set(np.argsort(-scores)[:20].tolist()) & set(inside.tolist()))
    assert hits >= 0.9 * 20 * 100
    whole = np.flatnonzero((index.counts > 0) & (index.splits == 1))
    assert np.bincount(index.first[whole], weights=index.counts[whole]).max() <= 200


def test_how_far_to_look_against_plain_ranks():
    """The share found by cells' counts is the one that ranks of all entries give."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 12))
    index = multiindex.fit(x, 10, centroids=multiindex.centroids_for(2000))
    cells = index.cells(x)
    counts = np.bincount(cells, minlength=len(index.left) * len(index.right))
    near = [np.array([j for j in np.argsort(-(x @ q)).tolist() if j != k][:10]) for k, q in enumerate(x[:50])]
    multiindex.tuned(index, x[:50], [cells[n] for n in near], counts)
    shares = []
    for q, n in zip(x[:50], near, strict=True):
        to_left, to_right = index.distances(q)
        sums = to_left[cells // len(index.right)] + to_right[cells % len(index.right)]
        shares += [(sums <= sums[j]).mean() for j in n]
    assert abs(np.mean(np.array(shares) <= index.share) - multiindex.RECALL) < 0.01
    assert [multiindex.centroids_for(n) for n in (0, 3, 400, 40_000, 10**12)] == [1, 1, 10, 100, multiindex.CENTROIDS]


@pytest.mark.parametrize("kind", ["uniform", "clustered"])
def test_neighbours_recall_of_whole_searches(spark, kind):
    """Recall of ``search`` on tables that it looks at in part only."""
    rng = np.random.default_rng(7)
    n = 20_000
    x = rng.normal(size=(n, 16))
    if kind == "clustered":
        x = 3 * rng.normal(size=(200, 16))[rng.integers(0, 200, n)] + 0.5 * x
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(4)
    shares = []
    place = multiindex.Index.place
    try:
        multiindex.Index.place = lambda self, counts, *a: place(self, counts, *a) or shares.append(self.wanted / counts.sum())
        got = multiindex.search(docs, batches.F.col("vec_id") % 100 == 0).collect()
    finally:
        multiindex.Index.place = place
    x, hits, by = x.astype(np.float64), 0, {}
    for r in got:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    for q in range(0, n, 100):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(by[q] & set(np.argpartition(-scores, 20)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(by) and len(by) == n // 100
    assert shares[0] < (0.25 if kind == "uniform" else 0.06), shares


# 3 sharding


def jump_by_hand(key, n):
    b, j, key = -1, 0, key & (2**64 - 1)
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + sharding.INCREMENT) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 7, 24])
def test_jump_hash(spark, shards):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *random.Random(3).sample(range(10**12), 200)]
    rows = spark.createDataFrame([(k,) for k in keys], "key long").select("key", sharding.jump(batches.F.col("key"), shards).alias("j")).select("key", "j.shard", "j.grown").collect()
    for r in rows:
        assert (r.shard, r.grown) == (jump_by_hand(r.key, shards), jump_by_hand(r.key, shards + 1))
        assert r.grown in (r.shard, shards)


def test_shards_of_odd_rows(spark):
    rows = sharding.shard_documents(odd_table(spark), 24).collect()
    assert len(rows) == 12
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 0} == {(8, 0)}
    assert {r.text_crc32 for r in rows if r.doc_id == 5} == {zlib.crc32(("é" * 50).encode())}
    assert sharding.shard_documents(odd_table(spark).limit(0), 24).count() == 0


# 4 BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_encoding(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: k for k, x in enumerate(vocabulary.tokens)}, special_tokens={})


def odd_strings(n, seed=5):
    rng = random.Random(seed)
    letters = list("ab  \n\t'sé1٣½%$\x1c 　日́😀tE ΣİA.,|\x85")
    return ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(n)]


def test_bpe_equals_tiktoken(vocabulary, tiktoken_encoding):
    encoder = bpe.Encoder(vocabulary)
    for text in [*odd_strings(3000), *random_texts(200), *filter(None, ODD[:-1]), "<|endoftext|> don't", LONG[:5000]]:
        ids = encoder.encode(text)
        assert ids == tiktoken_encoding.encode_ordinary(text), text
        assert encoder.decode(ids) == text.encode()


def test_bpe_appends_and_edits(vocabulary):
    encoder, rng = bpe.Encoder(vocabulary), random.Random(2)
    for _ in range(100):
        data = " ".join(random_texts(1, rng.random())).encode()[:300]
        table = bpe.PrefixTable(encoder, data[:20])
        table.append(data[20:])
        a = rng.randint(0, len(data))
        b = rng.randint(a, min(len(data), a + 6))
        by = rng.choice([b"", b"q", b"there", b"\xff\xfe"])
        before = table.work
        table.replace(a, b, by)
        assert table.data == data[:a] + by + data[b:]
        assert table.last == bpe.PrefixTable(encoder, table.data).last
        if a < 50 and len(data) > 250:
            assert table.work - before < len(data) - a
        assert encoder.decode(table.ids) == table.data


def test_bpe_odd_rows(spark, vocabulary, tiktoken_encoding):
    docs = odd_table(spark)
    rows = bpe.round_trip(docs, vocabulary).collect()
    assert len(rows) == 12 and bpe.round_trip(docs.limit(0), vocabulary).count() == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        text = texts[r.doc_id] if r.doc_id is not None else None
        if r.doc_id is not None:
            ids = tiktoken_encoding.encode_ordinary(text or "")
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert [len(r.ids) for r in bpe.encode_documents(docs, vocabulary, ("doc_id", "ids")).drop("ids").limit(0).collect()] == []


# 5 n-gram join


def brute_classes(ids, texts):
    sets = [set(ngram_join.grams(t).tolist()) for t in texts]
    links, root = [0] * len(ids), list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    smallest = {r: min(ids[k] for k in range(len(ids)) if root[k] == r) for r in set(root)}
    return {(i, smallest[root[k]], links[k]) for k, i in enumerate(ids)}


def near_copies(n_bases=12, seed=4):
    rng = random.Random(seed)
    texts = []
    for base in random_texts(n_bases, seed, 3000):
        words = base.split() * 2
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 8)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.random())
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 3000])
def test_ngram_join_equals_brute_force(spark, block):
    """With the small block, groups are split over many cells."""
    texts = near_copies() + ["One two three.", "one, TWO three", "one two", ""]
    ids = random.Random(9).sample(range(1000), len(texts))
    got = ngram_join.similar(table(spark, texts, ids), block=block).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == brute_classes(ids, texts)


def test_ngram_join_counts_once_where_blocks_are_empty(spark):
    """Two blocks for two nodes: where one block has both, the cell of two blocks lacks one side."""
    texts = [" ".join(f"w{base}x{k}" for k in range(300)) + f" end{j}" for base in range(8) for j in range(2)]
    got = ngram_join.similar(table(spark, texts), block=1000).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == brute_classes(range(len(texts)), texts)


def test_ngram_join_odd_rows(spark):
    got = ngram_join.similar(odd_table(spark)).collect()
    assert len(got) == 12
    assert {(r.class_id, r.n_links) for r in got if r.doc_id is None} == {(None, 0)}
    assert {(r.class_id, r.n_links, r.copies) for r in got if r.doc_id == 100} == {(100, 1, 2)}
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in got if r.doc_id is not None and r.doc_id < 100)
    assert ngram_join.similar(odd_table(spark).limit(0)).count() == 0
    kept = ngram_join.one_of_each(odd_table(spark))
    assert kept.columns == odd_table(spark).columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [*range(len(ODD)), 100]
    assert kept.where("doc_id is null").count() == 2


def test_ngram_join_repeated_ids(spark):
    """Rows that share an id but no text are documents of their own: no link and no text is lost."""
    a, b = (" ".join(random.Random(k).choices("abcdefghijklmnopqrstuvw", k=120)) for k in (1, 2))
    docs = table(spark, [a, b, a + " end", b + " end", "...", "", "...", b], [1, 1, 2, 3, 1, 1, 1, 1])
    got = ngram_join.similar(docs).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(1, 1, 0)] * 3 + [(1, 1, 1)] + [(1, 1, 2)] * 2 + [(2, 1, 1), (3, 1, 2)]
    assert sorted((r.doc_id, r.text) for r in ngram_join.one_of_each(docs).collect()) == sorted([(1, a), (1, b), (1, "..."), (1, "")])


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 3000])
def test_ngram_join_clashing_ids_equal_brute_force(spark, block):
    texts = near_copies(14, 17)
    rng = random.Random(3)
    texts += rng.choices(texts, k=20)
    ids = [rng.randint(0, 25) for _ in texts]
    want = sorted(brute_rows(ids, texts))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar(table(spark, texts, ids), block=block).collect()) == want
    # One text of each class stays: no two of them are near copies, and each row has a near copy among them.
    kept = [set(ngram_join.grams(r.text).tolist()) for r in ngram_join.one_of_each(table(spark, texts, ids)).collect()]
    near = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    assert not any(near(x, y) for k, x in enumerate(kept) for y in kept[:k])
    assert len(kept) == len(brute_components(texts))


def brute_components(texts):
    sets = [set(ngram_join.grams(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [[k for k in range(len(texts)) if root[k] == r] for r in sorted(set(root))]


def brute_rows(ids, texts):
    """Of each row its id, class and links, whatever ids repeat."""
    sets = [set(ngram_join.grams(t).tolist()) for t in texts]
    for group in brute_components(texts):
        for k in group:
            yield ids[k], min(ids[j] for j in group), sum(j != k and len(sets[j] & sets[k]) >= 0.8 * len(sets[j] | sets[k]) for j in group)


def test_bands_reach_the_recall():
    bands, rows = ngram_join.bands_for(0.8, 0.9995, 256)
    assert bands * rows <= 256 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in ngram_join.components(edges, "chain").collect()}
    assert roots == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


# 6 decontamination

QUESTION = "A train leaves Boston at 9 and travels 60 miles per hour toward Denver. How long until the train from Boston reaches it after 60 miles of travel over open land?"


def items(*texts):
    return templates.Items([(k, t) for k, t in enumerate(texts)])


def test_template_slots():
    found = items(QUESTION).matches("Some text first. " + QUESTION + " And more.")
    assert [(m[0], m[3]) for m in found] == [(0, True)]
    changed = QUESTION.replace("Boston", "Lyon").replace("60", "45").replace("Denver", "Paris")
    assert [(m[0], m[3]) for m in items(QUESTION).matches("So. " + changed)] == [(0, False)]
    # The same item value must not become two values.
    assert items(QUESTION).matches(changed.replace("after 45", "after 33")) == []
    assert items(QUESTION).matches("A train leaves the station. " * 50) == []


def test_template_short_items_and_odd_texts():
    short = items("what is the capital of old france")
    assert [m[0] for m in short.matches("I ask: what is the capital of old france, please, and where does it lie now")] == [0]
    for text in ODD:
        assert short.matches(text) == []
    assert items("", "...").matches("anything at all") == []


SLOT_RICH = [
    "What is 12 plus 7?",
    "Who wrote Hamlet?",
    "What is the capital of France?",
    "In what year did Neil Armstrong land?",
    "Compute 12 + 7 - 3 * 4 + 18 / 6 - 5 * 2 and give the result 17.",
]


@pytest.mark.parametrize("text", SLOT_RICH)
def test_template_slot_rich_items(text):
    """No window is left out: with few literals the values must be equal, else they may be others."""
    found = items(text)
    assert found.matches("Some words before it, then: " + text + " And more words.") == [(0, found.total[0], 1.0, True)]
    changed = text.replace("12", "31").replace("Hamlet", "Faust").replace("France", "Peru").replace("Armstrong", "Aldrin")
    assert changed != text and found.matches("Some words before it, then: " + changed + " And more words.") == []
    # Windows that can only match as they are don't count against those that may have other values.
    long = text + " Then the farmer walks slowly to Boston with the two dogs"
    assert [(m[0], m[3]) for m in items(long).matches("So. " + changed + " Then the farmer walks slowly to Lyon with the two dogs")] == [(0, False)]


@pytest.mark.parametrize("text", [QUESTION, "Wie viele Äpfel kauft Frau Weiß in der großen Straße, wenn jeder Apfel zwei Mark und jede Birne drei Mark kostet?"])
def test_template_copies_in_another_case(text):
    found = items(text)
    for copy in (text.lower(), text.upper(), text.title(), text.swapcase()):
        assert found.matches("so then: " + copy + " and on") == [(0, found.total[0], 1.0, True)]


def test_template_conflicts_cost_no_more_than_their_windows():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    for k in (50, 250):
        words[k] = "1984"
    copy = list(words)
    copy[250] = "1985"
    [(_, n, share, exact)] = items(" ".join(words)).matches("before " + " ".join(copy) + " behind")
    assert (n, share, exact) == (281, 281 / 291, True)
    # Other values throughout, and one conflict: what lies before it counts, if it is long.
    for k in range(20, 290, 4):
        words[k] = str(k) if k < 250 else "24"
        copy[k] = str(k + 1000) if k < 250 else str(k)
    [(_, n, _, exact)] = items(" ".join(words)).matches(" ".join(copy))
    assert 220 < n < 260 and not exact


def test_template_stretches_equal_brute_force():
    rng = random.Random(12)
    for _ in range(60):
        n = rng.randint(12, 40)
        kinds = [rng.random() < 0.4 for _ in range(n)]
        item, doc = (templates.Template(" ".join(str(rng.randint(1, 4)) if slot else f"w{chr(97 + k % 26)}" for k, slot in enumerate(kinds))) for _ in range(2))
        places = [p for p in range(n - 9) if rng.random() < 0.9]
        good = {(a, b) for a in places for b in range(a + 1, n - 8) if set(range(a, b)) <= set(places) and templates.Items._consistent(doc, item, 0, list(range(a, b))) is not None}
        longest = {(a, b) for a, b in good if (a - 1, b) not in good and (a, b + 1) not in good}
        assert longest <= {s for s in templates.Items._stretches(doc, item, 0, places) if s[1] > s[0]} <= good if places else True


def test_window_hashes_in_one_step():
    codes = np.random.default_rng(3).integers(0, 1 << 63, 50, dtype=np.uint64)
    for n in (1, 4, 10, 50):
        assert (templates._windows(templates._sums(codes), n) == batches.windows(codes, n)).all()


def test_decontamination_finds_planted_passages(spark):
    rng = random.Random(6)
    bench = [t for t in random_texts(60, 8, 5000) if len(t.split()) >= 14][:20]
    texts, planted = random_texts(120, 9, 5000), set()
    for k in rng.sample(range(120), 30):
        item = rng.randrange(len(bench))
        at = texts[k].split()
        cut = rng.randint(0, len(at))
        texts[k] = " ".join([*at[:cut], bench[item], *at[cut:]])
        planted.add((k, item))
    docs = table(spark, texts)
    benchmark = spark.createDataFrame([(k, t, "x") for k, t in enumerate(bench)] + [(None, None, "x")], "item_id long, text string, doc_id string")
    for block in (templates.BLOCK, 2000):
        got = templates.contaminated(docs, benchmark, block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == planted
    clean = templates.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(120)) - {d for d, _ in planted}
    assert templates.decontaminate(odd_table(spark), benchmark).count() == 12
    assert templates.contaminated(docs, benchmark.limit(0)).count() == 0
    assert templates.decontaminate(docs.limit(0), benchmark).count() == 0


def plain_words(text):
    """(kind, word) of each word, as the rules say, for texts of plain words, numbers, names and stops."""
    out, fresh, before = [], True, None
    for word in text.split():
        core = word.strip(".,!?").casefold()
        kind = "number" if core.isdigit() else "unit" if core in templates.UNITS and before == "number" else "name" if word[0].isupper() and not fresh else ""
        out.append((kind, core))
        fresh, before = word[-1] in ".!?", kind
    return out


def plain_matches(item, doc):
    """(windows, exact) of the best occurrence of an item, with every place compared to every place; None if there is none."""
    a, b = plain_words(item), plain_words(doc)
    n = min(10, len(a))
    if not a or len(a) < templates.SHORT and len(a) != len(b):
        return None
    shape = lambda x: [k or w for k, w in x]
    literals = [sum(not k for k, _ in a[p : p + n]) >= min(6, n) for p in range(len(a) - n + 1)]

    def holds(shift, places):
        pairs = {(a[p + j], b[p + j + shift]) for p in places for j in range(n) if a[p + j][0]}
        pairs = {((x[0], x[1]), (x[0], y[1])) for x, y in pairs}
        if len({x for x, _ in pairs}) < len(pairs) or len({y for _, y in pairs}) < len(pairs):
            return None
        return all(x == y for x, y in pairs)

    best = None
    for shift in range(-len(a), len(b)):
        every, same, alike = [], [], []
        for p in range(len(a) - n + 1):
            x, y = a[p : p + n], b[p + shift : p + shift + n] if p + shift >= 0 else []
            equal = [w for _, w in x] == [w for _, w in y]
            if equal:
                same.append(p)
            if len(y) == n and shape(x) == shape(y) and literals[p] or equal and not any(k for k, _ in x):
                alike.append(p)
            if equal or p in alike:
                every.append(p)
        least = min(4, len(literals))
        for some, enough in ((every, least), (same, least), (alike, min(4, sum(literals)))):
            if some and len(some) >= enough and holds(shift, some) is not None:
                best = max(best or (0, False), (len(some), holds(shift, some)))
        for i in range(len(every)):
            for j in range(i + 30, len(every) + 1):
                if every[j - 1] - every[i] == j - i - 1 and holds(shift, every[i:j]) is not None:
                    best = max(best or (0, False), (j - i, holds(shift, every[i:j])))
    return best


def reworded(rng, text):
    """A copy with other values, mostly one for one, in another case, or with a word changed."""
    words, to = text.split(), {}
    how = rng.random()
    for k, w in enumerate(words):
        core = w.strip(".,!?")
        if how < 0.5 and (core.isdigit() or core[:1].isupper() and k):
            new = to.setdefault(core, str(rng.randint(1, 99)) if core.isdigit() else rng.choice(["Oslo", "Quito", "Turin", "Anna", "Omar"]))
            words[k] = w.replace(core, new if rng.random() < 0.97 else "7")
    if how > 0.9:
        words[rng.randrange(len(words))] = "other"
    return " ".join(words).lower() if 0.5 < how < 0.6 else " ".join(words)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(31)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(60)]

    def sentence(n):
        out = []
        while len(out) < n:
            x = rng.random()
            out += [str(rng.randint(1, 30)), "km"] if x < 0.08 else [str(rng.randint(1, 30))] if x < 0.2 else [rng.choice(["Boston", "Paris", "Lyon", "Anna"])] if x < 0.3 else [rng.choice(words) + rng.choice(["", "", "", ",", "."])]
        return " ".join(out[:n])

    bench = [sentence(n) for n in (1, 2, 3, 5, 9, 10, 12, 13, 16, 20, 25, 30, 45, 60)] + [" ".join(str(rng.randint(1, 99)) for _ in range(17)), "paris", "Boston 12"]
    docs = ["paris", "so Paris it is", "boston 12", "in Boston 12 men"]
    for k in range(140):
        item = bench[k % len(bench)]
        docs.append(" ".join([sentence(rng.randint(0, 8)), reworded(rng, item), sentence(rng.randint(0, 8))]))
    want = {(d, i, *m) for d, doc in enumerate(docs) for i, item in enumerate(bench) for m in [plain_matches(item, doc)] if m}
    benchmark = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    for block in (templates.BLOCK, 2000):
        got = templates.contaminated(table(spark, docs), benchmark, block).collect()
        assert {(r.doc_id, r.item_id, r.windows, r.exact) for r in got} == want
    assert {d for d, i, *_ in want if i >= 15} >= {0, 2} and not {d for d, *_ in want} & {1, 3}
    assert len({d for d, *_ in want}) > 70 and any(not x[3] for x in want)
    index = items(*bench)
    assert {(d, m[0], m[1], m[3]) for d, doc in enumerate(docs) for m in index.matches(doc)} == want


def test_decontamination_repeated_rows(spark):
    """Copies, repeated ids and null ids each get their rows; other columns stay as they are."""
    text = "the " + QUESTION
    docs = table(spark, [text, text, text, "clean words here", None, text], [1, 1, 2, 1, None, None])
    benchmark = spark.createDataFrame([(5, QUESTION, "a"), (5, QUESTION, "a"), (None, QUESTION, "b"), (6, "  ", "c")], "item_id long, text string, hash string")
    got = templates.contaminated(docs, benchmark).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted([(d, i) for d in (1, 1, 2, None) for i in (5, None)], key=str)
    assert sorted(str(r.doc_id) for r in templates.decontaminate(docs, benchmark).collect()) == ["1", "None"]


# 7 personal data


def plain_base(text):
    """The patterns as they are stated."""
    import re

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return pii.ordered(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a.b@c.de", "@", "x@y", "a@b.c@d.e", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "+1 (555) 123-4567", "+1+2 34567890123", "4111 1111 1111 1111", "4111-1111-1111-1112", "é.1@m.org", "..", " ", "-", "00012.1.1.1", "+4", "9" * 30]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 6)))
        assert pii.base_spans(text) == plain_base(text), text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_base_spans_are_fast_on_long_runs():
    for text in ("a" * 300_000, "1" * 300_000, "@" * 300_000, "+1" * 150_000, "1." * 150_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def model():
    return pii.default_model()


def test_tagger_on_unseen_examples(model):
    right = found = there = 0
    examples = pii.examples(300, 77)
    for (_, spans), tagged in zip(examples, model.decode([t for t, _ in examples]), strict=True):
        a, b = set(spans), {(pii.KINDS[k], x, y) for k, x, y in tagged}
        right, found, there = right + len(a & b), found + len(b), there + len(a)
    assert right >= 0.9 * found and right >= 0.9 * there


def test_windows_are_reconciled(model):
    """A span is found wherever the windows' borders fall on it."""
    for shift in range(0, 1000, 37):
        text = "word " * (180 + shift // 5) + "x" * (shift % 5) + " call (555) 123-4567 now " + "word " * 400
        at = text.index("(555)")
        assert [("phone", at, at + 14)] == pii.find([text], model)[0][1]


def test_tagger_gradients():
    """Likelihood gradients against differences."""
    rng = np.random.default_rng(0)
    m = tagger.Model(("a", "b"), None, [], None, np.array([-1.0, 0.3]), np.array([0.5, 1.0]), np.array([0.1, -0.4]), 0.7)
    scores, tags = rng.normal(size=(6, 3, 2)), np.array([[0, 1], [1, 1], [1, 0], [0, 2], [0, 2], [2, 0]])
    _, d, more = tagger._likelihood(m, scores, tags)
    for at in ((0, 1, 0), (3, 2, 1), (5, 0, 0)):
        up, down = scores.copy(), scores.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert abs((tagger._likelihood(m, up, tags)[0] - tagger._likelihood(m, down, tags)[0]) / 2e-5 - d[at]) < 1e-4
    m.stay = m.stay + np.array([1e-5, 0])
    high = tagger._likelihood(m, scores, tags)[0]
    m.stay = m.stay - np.array([2e-5, 0])
    assert abs((high - tagger._likelihood(m, scores, tags)[0]) / 2e-5 - more["stay"][0]) < 1e-2


def plain_best(model, scores):
    """The best path over (T, tags) scores, by comparing all transitions."""
    n = scores.shape[1]
    move = np.full((n, n), -1e9)
    move[0, 0] = model.outside
    move[0, 1:], move[1:, 0] = model.enter, model.leave
    move[np.arange(1, n), np.arange(1, n)] = model.stay
    now, back = scores[0].astype(float), []
    for row in scores[1:]:
        all_ways = now[:, None] + move
        back.append(all_ways.argmax(0))
        now = all_ways.max(0) + row
    path = [int(now.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float(now.max())


def path_score(model, scores, path):
    total = scores[0, path[0]]
    for t in range(1, len(path)):
        a, b = path[t - 1], path[t]
        total += scores[t, b] + (model.outside if a == b == 0 else model.stay[b - 1] if a == b else model.enter[b - 1] if a == 0 else model.leave[a - 1] if b == 0 else -1e9)
    return total


def test_paths_are_globally_best():
    """Stretches of any length give the path over the whole text, also where spans cross many of them."""
    rng = np.random.default_rng(4)
    m = tagger.Model(("a", "b"), None, [None, None], np.zeros((3, 17)), np.array([-2.0, -1.5], np.float32), np.array([1.0, 0.6], np.float32), np.array([-1.0, -0.4], np.float32), 1.0)
    for stretch in (1, 2, 5, 16, 1000):
        lengths = [0, 1, 7, 64, 200, 3, 50]
        scores = rng.normal(size=(sum(lengths), 3)).astype(np.float32) * 1.5
        scores[80:230, 1] += 1.5  # long spans
        at = 0
        for n, tags in zip(lengths, m._paths(lengths, scores, stretch), strict=True):
            own, at = scores[at : at + n], at + n
            if n:
                best, value = plain_best(m, own)
                assert abs(path_score(m, own, tags.tolist()) - value) < 1e-3, (stretch, n)
                assert tags.tolist() == best


def test_scores_of_windows_and_lstm_against_plain_steps(model):
    """Scores of one window against the LSTM written out; of many windows against a mix of single ones."""
    text = pii.examples(1, 5)[0][0]
    x = tagger.symbols(text)
    want = np.tile(model.out[:, -1], (len(x), 1)).astype(float)
    for way, cell in enumerate(model.cells):
        h = c = np.zeros(tagger.HIDDEN)
        for t in range(len(x)) if way == 0 else range(len(x) - 1, -1, -1):
            z = np.clip(cell @ np.concatenate([h, model.embedding[:, x[t]], [1]]), 0, 1)
            i, f, o, new = (z[k * tagger.HIDDEN : (k + 1) * tagger.HIDDEN] for k in range(4))
            c = f * c + i * (2 * new - 1)
            h = o * np.clip(c, -1, 1)
            want[t] += model.out[:, way * tagger.HIDDEN : (way + 1) * tagger.HIDDEN] @ h
    assert np.abs(model._scores([x]) - want).max() < 1e-2
    long = tagger.symbols(" ".join(t for t, _ in pii.examples(40, 6)))
    both = model._scores([x, long, x[:0], long[:1500]])
    assert both.shape == (len(x) + len(long) + 1500, 5) and np.abs(both[: len(x)] - want).max() < 1e-2
    far = model._scores([long[: tagger.WINDOW // 2]])
    assert np.abs(both[len(x) : len(x) + 100] - far[:100]).max() < 0.2


def test_lstm_gradients():
    rng = np.random.default_rng(6)
    cell = rng.normal(0, 0.15, (4 * tagger.HIDDEN, tagger.HIDDEN + tagger.EMBEDDED + 1))
    cell[:, -1] = 0.5
    read, weigh = rng.normal(0, 0.5, (4, tagger.EMBEDDED, 2)), rng.normal(0, 0.01, (4, tagger.HIDDEN, 2))
    value = lambda: float((tagger._cell_forward(cell, read)[0].astype(float) * weigh).sum())
    d_cell, d_read = tagger._cell_backward(cell, tagger._cell_forward(cell, read)[1], weigh)
    for of, d in ((cell, d_cell), (read, d_read)):
        for at in (tuple(rng.integers(0, n) for n in of.shape) for _ in range(20)):
            old = of[at]
            of[at] = old + 1e-4
            high = value()
            of[at] = old - 1e-4
            low = value()
            of[at] = old
            assert abs((high - low) / 2e-4 - d[at]) < 2e-4, at


HAND_MADE = [
    ("Please write to jane.doe (at) mail-server (dot) org before Monday.", "email", "jane.doe (at) mail-server (dot) org"),
    ("contact: bob.smith at example dot com, thanks", "email", "bob.smith at example dot com"),
    ("Reach the team via support[at]widgets[dot]net or in person.", "email", "support[at]widgets[dot]net"),
    ("My number is (212) 555-0187, call after six.", "phone", "(212) 555-0187"),
    ("Tel. 415-555-0132 is the office line.", "phone", "415-555-0132"),
    ("Fax 020 7946 0018 still works in London.", "phone", "020 7946 0018"),
    ("the gateway 10 . 0 . 12 . 7 went down", "ip", "10 . 0 . 12 . 7"),
    ("Blocked host 192[.]168[.]4[.]20 yesterday", "ip", "192[.]168[.]4[.]20"),
]
HARMLESS = [
    "In 1998 about 3,200 people moved to the region, 12.5% more than in 1997.",
    "See section 4.2.1 on page 117; the score was 3 - 2 (1 - 0) at half time.",
    "Meet at the station at noon, dot your i and cross your t.",
    "ISBN 978-0-13-468599-1, price $49.99, weight 1.2 kg",
]


def test_tagger_on_hand_made_texts(model):
    """Forms written by hand, alone and across the borders of windows, and texts with numbers that are no personal data."""
    found = 0
    for text, kind, value in HAND_MADE:
        at = text.index(value)
        found += (kind, at, at + len(value)) in pii.find([text], model)[0][1]
    assert found >= 6, found
    for text in HARMLESS:
        assert pii.find([text], model)[0][1] == [], text
    # What is found alone is found wherever it stands in a long text.
    for text, kind, value in HAND_MADE:
        at = text.index(value)
        if (kind, at, at + len(value)) in pii.find([text], model)[0][1]:
            for before in (940, 955, 990, 1020, 1900):
                filler = ("word " * 400)[:before]
                there = pii.find([filler + text + " word" * 300], model)[0][1]
                assert (kind, before + at, before + at + len(value)) in there, (before, value)


def test_long_spans_are_kept():
    """No limit on the length of what the tagger adds."""
    value = "someone.with.a.very.long.name.and.many.parts.in.it (at) an-equally-long-name-of-a-server.and.its.department (dot) org"
    text = "write to " + value + " now"
    assert pii.added_spans(text, [], [(0, 9, 9 + len(value))]) == [("email", 9, 9 + len(value))]


def test_model_is_kept_in_a_file(spark, model, tmp_path):
    for _ in range(2):
        again = pii.fitted(spark, f"{tmp_path}/tagger")
    assert again.saved() == model.saved() and again.decode([HAND_MADE[0][0]]) == model.decode([HAND_MADE[0][0]])


def test_personal_data_odd_rows(spark, model):
    docs = odd_table(spark)
    rows = pii.detect(docs, model).collect()
    assert len(rows) == 12 and pii.detect(docs.limit(0), model).count() == 0
    assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    text = "Mail a.b@example.com, pay 4111 1111 1111 1111."
    out = pii.redact(table(spark, [text, None, "clean"]), model).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["Mail <EMAIL>, pay <CARD>.", None, "clean"]
    assert [r.n_chars for r in out] == [len(out[0].text), None, 5]


# 8 binary records


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def test_word_tokenizer_equals_the_library(definition):
    from tokenizers import Tokenizer

    own, plain = binary_records.WordTokenizer(definition), Tokenizer.from_str(definition)
    texts = [*odd_strings(3000, 8), *random_texts(100), None, "", "Straße, İstanbul. ſtop's", "a\x1eb \x1e", LONG[:2000]]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def test_records_round_trip(spark, definition, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(definition)
    docs = table(spark, [*random_texts(50), None, "", "x"], random.Random(1).sample(range(-500, 500), 53))
    got = sorted(binary_records.binary_output(docs, definition, files=4).collect(), key=lambda r: r.start)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert [r.doc_id for r in got] == sorted(texts)
    at = 0
    for r in got:
        ids = plain.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert binary_records.binary_output(docs.limit(0), definition).count() == 0
    assert binary_records.binary_output(odd_table(spark), definition, files=3).count() == 12


def test_records_in_any_order_and_damage(spark, definition, tmp_path):
    docs = table(spark, random_texts(20))
    files = binary_records.write(docs, definition, f"file://{tmp_path}/r", 1, 1).collect()
    records = binary_records.Records(files[0].file)
    assert len(records) == 20 and [records[k][0] for k in (7, 3, 19)] == [7, 3, 19]
    assert records.entries[5, 1] == sum(len(records[k][1]) for k in range(5))
    path = binary_records.filesystem(files[0].file)[1]
    data = bytearray(open(path, "rb").read())
    data[int(records.entries[4, 0]) + 30] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(binary_records.Damaged):
        binary_records.Records(files[0].file)[4]


def test_tokenizers_of_another_kind_are_refused(definition):
    """One that keeps case or white space would get wrong ids, so it is not used."""
    import json

    other = json.loads(definition)
    other["normalizer"] = None
    with pytest.raises(ValueError):
        binary_records.WordTokenizer(json.dumps(other))


def test_files_follow_the_bytes(spark, definition, monkeypatch):
    docs = table(spark, random_texts(60))
    size = sum(len(r.text.encode()) for r in docs.collect())
    asked = []
    write = binary_records.write
    monkeypatch.setattr(binary_records, "write", lambda docs, definition, folder, end_id, files: asked.append(files) or write(docs, definition, folder, end_id, files))
    assert binary_records.binary_output(docs, definition).count() == 60
    monkeypatch.setattr(binary_records, "FILE", size // 7 + 1)
    assert binary_records.binary_output(docs, definition).count() == 60
    assert asked == [1, 7]


def test_index_that_lies_is_found(spark, definition, tmp_path):
    files = binary_records.write(table(spark, random_texts(20)), definition, f"file://{tmp_path}/r", 1, 1).collect()
    path = binary_records.filesystem(files[0].file)[1] + ".idx"
    data = bytearray(open(path, "rb").read())
    listed = spark.createDataFrame([(files[0].file, 0)], "file string, start long")
    assert binary_records.read_back(listed).count() == 20
    for changed in (data[:-16], data + data[-16:], data[:40] + b"\1" + data[41:]):
        open(path, "wb").write(bytes(changed))
        with pytest.raises(Exception, match="the index"):
            binary_records.read_back(listed).count()


def test_one_id_for_all_rows_is_dealt_over_files(spark, definition):
    """Rows that are wholly equal do not all go to one file."""
    docs = table(spark, ["same words"] * 400, [5] * 400).repartition(4)
    folder = batches.shared_dir(spark, "dealt")
    written = binary_records.write(docs, definition, folder, 1, 4).collect()
    assert sum(r.n_records for r in written) == 400 and max(r.n_records for r in written) <= 200


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        batches.shared_dir(Session(), "x")


# 9 language


def language_rows(n=200, seed=2):
    rng = random.Random(seed)
    sounds = {"aa": "the and ing er on re", "bb": "lich ung sch der ein ü", "cc": "eau oi que é re la"}
    return [(k, "".join(rng.choice((*sounds[lang].split(), " ")) for _ in range(rng.randint(20, 80))), lang) for k in range(n) for lang in [rng.choice(list(sounds))]]


def test_language_held_out_accuracy(spark):
    rows = language_rows()
    docs = table(spark, [t for _, t, _ in rows], lang=[x for _, _, x in rows])
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, _, _ in rows)
    held = [k for k, _, _ in rows if got[k].held_out]
    assert sum(got[k].lang_pred == lang for k, _, lang in rows if k in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    # Labels of held-out rows are never used.
    changed = table(spark, [t for _, t, _ in rows], lang=["zz" if k in held else x for k, _, x in rows])
    assert {r.doc_id: r.lang_pred for r in langid.identify(changed).collect()} == {k: r.lang_pred for k, r in got.items()}


def test_language_odd_rows(spark):
    rows = language_rows(60)
    docs = table(spark, [t for _, t, _ in rows], [1000 + k for k, _, _ in rows], [x for _, _, x in rows]).unionByName(odd_table(spark))
    got = [r for r in langid.identify(docs).collect() if r.doc_id is None or r.doc_id < 1000]
    assert len(got) == 12
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2, 3)} == {"und"} and {r.rejected for r in got if r.doc_id == 0} == {True}
    assert {r.lang_pred for r in langid.identify(odd_table(spark)).collect()} == {"und"}
    assert langid.identify(odd_table(spark).limit(0)).count() == 0
    kept = langid.accepted(docs, langid.fit(docs.select("doc_id", "text", "lang")))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1000 + k for k, _, _ in rows}


def test_language_against_plain_numpy(spark):
    """Languages and cosines against the method written out for one text at a time."""
    import math
    from collections import Counter

    rows = language_rows(90, 9)
    docs = table(spark, [t for _, t, _ in rows], lang=[x for _, _, x in rows])
    model = langid.fit(docs.where("doc_id % 2 = 0").select("doc_id", "text", "lang"))

    def place(trigram):
        a, b, c = map(ord, trigram)
        h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & 0xFFFFFFFF
        h ^= h >> 15
        return (h * 0x2C1B3C6D & 0xFFFFFFFF) >> 19

    def vector(text):
        letters = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        counts = Counter(place(letters[k - 1 : k + 2]) for k in range(1, len(letters) - 1) if letters[k] != " ")
        weighed = {k: math.log1p(n) * float(model.idf[k]) for k, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in weighed.values()))
        return {k: x / norm for k, x in weighed.items()}

    # Inverse document frequency from the labelled rows themselves, all of which are in the sample.
    seen = Counter(k for _, t, _ in rows[::2] for k in {place((" " + "".join(c if c.isalpha() else " " for c in t.lower()) + " ")[j - 1 : j + 2]) for j in range(1, len(t) + 1) if t[j - 1].isalpha()})
    assert all(abs(math.log((1 + 45) / (1 + n)) + 1 - float(model.idf[k])) < 1e-5 for k, n in seen.items())
    lang, score, _ = langid.nearest([t for _, t, _ in rows], model)
    for (_, text, _), own, s in zip(rows, lang, score, strict=True):
        v = vector(text)
        cosines = [sum(x * float(c[k]) for k, x in v.items()) for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert own == model.languages[model.owner[best]] and abs(s - cosines[best]) < 1e-5
    # Each centroid has length 1 and is the direction of the rows that are nearest to it.
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)


def test_every_language_is_learned(spark):
    """However many languages there are, and however rare."""
    rng = random.Random(4)
    codes = [f"l{k}" for k in range(120)]
    texts = {c: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for c in codes}
    rows = [(c, " ".join(rng.sample([texts[c][j : j + 3] for j in range(7)] * 3, 15))) for c in codes for _ in range(1 if c < "l5" else 6)]
    docs = table(spark, [t for _, t in rows], lang=[c for c, _ in rows])
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    assert model.languages == sorted(codes)


def test_language_sample_is_bounded_by_rows_of_one_id(spark):
    rows = language_rows(300, 5)
    docs = table(spark, [t for _, t, _ in rows], ids=[7] * 300, lang=["aa"] * 300)
    assert langid.fit(docs.select("doc_id", "text", "lang"), sample=20).languages == ["aa"]


JUNK = {
    "base64": base64.b64encode(random.Random(3).randbytes(2250)).decode(),
    "hex": "".join(random.Random(4).choices("0123456789abcdef", k=6000)),
    "letters": "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz     ", k=500)),
    "italian": "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita.",
    "finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
}


def test_language_junk_is_rejected(spark):
    """On the sample tables: what is in none of their languages goes, labelled rows stay, whatever single odd rows say."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    odd = table(spark, ["zq xj"], [-1], ["en"]).select(docs.columns)
    labelled = [r for r in docs.collect() if r.lang and langid.trigram_counts(r.text) is not None]
    model = langid.fit(docs.unionByName(odd))
    lang, score, rejected = langid.nearest([*JUNK.values()], model)
    assert rejected.all(), dict(zip(JUNK, zip(lang, score, rejected, strict=True), strict=True))
    held = langid.fit(docs.where("doc_id % 4 != 2"))
    _, _, rejected = langid.nearest([r.text for r in labelled if r.doc_id % 4 == 2], held)
    assert rejected.mean() <= 0.002


# 10 quality


def test_quality_held_out(spark):
    rng = random.Random(5)
    texts, labels = [], []
    for k, t in enumerate(random_texts(400, 12)):
        junk = rng.random() < 0.3
        texts.append(" ".join(w + "***" for w in t.split()) if junk else t)
        labels.append((k, int(not junk), "x"))
    docs = table(spark, texts)
    extra = [(None, 1, "x"), (3, None, "x"), (5, 7, "x"), (9999, 0, "x")]
    got = {r.doc_id: r for r in quality.assess(docs, spark.createDataFrame(labels + extra, "doc_id long, quality int, text string")).collect()}
    held = [(k, q) for k, q, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out for k, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(got[k].predicted == q for k, q in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_quality_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.assess(odd_table(spark), none).collect()
    assert len(rows) == 12 and {r.score for r in rows} == {0.5}
    one = spark.createDataFrame([(100, 1), (7, 1), (7, 1)], "doc_id long, quality int")
    assert min(r.score for r in quality.assess(odd_table(spark), one).collect()) > 0.5
    assert quality.assess(odd_table(spark).limit(0), one).count() == 0


def test_support_vectors_are_the_optimum():
    """The dual's value equals the primal's at the weights found, so both are the best there are."""
    rng = np.random.default_rng(3)
    texts = random_texts(60, 31)
    rows, y = [quality.indicators(t) for t in texts], np.where(rng.random(60) < 0.5, 1.0, -1.0)
    ratio = quality._ratio(rows, y)
    counts = {1: np.ones(len(ratio)), -1: np.ones(len(ratio))}
    for r, label in zip(rows, y, strict=True):
        for k in r.tolist():
            counts[int(label)][k] += 1
    assert np.allclose(ratio, np.log(counts[1] / ((y > 0).sum() + 2) / (counts[-1] / ((y < 0).sum() + 2))))
    # Undo the mix with the mean weight: solve again without it.
    old, quality.MIX, passes = quality.MIX, 1.0, quality.PASSES
    quality.PASSES = 400
    try:
        weights, bias = quality._support(rows, y, ratio, 0)
    finally:
        quality.MIX, quality.PASSES = old, passes
    w = np.divide(weights, ratio, out=np.zeros_like(weights), where=ratio != 0)
    x = np.zeros((60, len(ratio) + 1))
    for k, r in enumerate(rows):
        x[k, r], x[k, -1] = ratio[r], 1
    full = np.append(w, bias)
    primal = 0.5 * full @ full + quality.COST * np.maximum(0, 1 - y * (x @ full)).sum()
    # A reference solution of the dual by projected gradients.
    q = (x @ x.T) * np.outer(y, y)
    alpha, step = np.zeros(60), 1 / np.linalg.eigvalsh(q)[-1]
    ahead, t = alpha.copy(), 1.0
    for _ in range(20000):
        new = np.clip(ahead + step * (1 - q @ ahead), 0, quality.COST)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, alpha = new + (before - 1) / t * (new - alpha), new
    dual = alpha.sum() - 0.5 * alpha @ q @ alpha
    assert abs(primal - dual) <= 1e-2 * max(1, abs(dual)), (primal, dual)


def test_indicators_against_plain_counting():
    def hashed(numbers, n, salt):
        out = []
        for k in range(len(numbers) - n + 1):
            h = salt * 0x27D4EB2F & 0xFFFFFFFF
            for x in numbers[k : k + n]:
                h = (h ^ x) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 13
            out.append((h * 0x85EBCA77 & 0xFFFFFFFF) >> (32 - quality.BITS))
        return out

    shape = lambda c: "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else " " if c.isspace() else c
    for text in [*random_texts(20, 77), *odd_strings(50, 3), "spam spam spam spam spam spam eggs " * 20]:
        words = text.split()
        grams = hashed([ord(c) for c in text], 3, 1) + hashed([ord(shape(c)) for c in text], 3, 2) + hashed([int(a == b) for a, b in zip(words, words[1:], strict=False)], 4, 3)
        want = sorted((k << quality.BITS) + g for g in set(grams) for k, least in enumerate((1, 4, 16, 64)) if grams.count(g) >= least)
        assert quality.indicators(text).tolist() == (want if text else [0])


def test_quality_sample_is_bounded_by_rows_of_one_id(spark):
    """An id that many rows share brings no more rows to the driver than the sample allows."""
    docs = table(spark, random_texts(200, 3), [7] * 150 + list(range(1000, 1050)))
    labels = spark.createDataFrame([(7, 1), *((k, k % 2) for k in range(1000, 1050))], "doc_id long, quality int")
    seen = []
    old, quality.train = quality.train, lambda rows, labels: seen.append(len(rows)) or old(rows, labels)
    try:
        quality.fit(docs, labels, sample=60)
    finally:
        quality.train = old
    assert seen == [60]


# The pipeline


def test_pipeline_against_brute_force(spark, tmp_path, vocabulary, tiktoken_encoding):
    import corpus_pipeline

    rng = random.Random(8)
    languages = language_rows(80, 3)
    bench = random_texts(30, 21, 4000)
    bench = [b for b in bench if len(b.split()) > 15][:5]
    texts = [t + " " + u for (_, t, _), u in zip(languages, near_copies(20, 6)[:80] + random_texts(80, 30), strict=False)]
    texts[4] += " " + bench[0]
    texts[9] = texts[8] + " end"
    texts[11] += " write to a.b@example.com"
    texts[12] = "12345 !!"
    docs = spark.createDataFrame([(k, t, languages[k][2], "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = {k: t for k, t in enumerate(texts) if k != 12}
    classes = {i: c for i, c, _ in brute_classes(list(left), list(left.values()))}
    left = {k: t for k, t in left.items() if classes[k] == k}
    index = templates.Items(list(enumerate(bench)))
    left = {k: t for k, t in left.items() if not index.matches(t)}
    assert 9 not in left and 4 not in left and 12 not in got and rng
    model = pii.default_model()
    left = {k: pii.redacted(t, pii.find([t], model)[0][1]) for k, t in left.items()}
    assert "<EMAIL>" in left[11]
    assert {k: list(r.ids) for k, r in got.items()} == {k: tiktoken_encoding.encode_ordinary(t) for k, t in left.items()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_pipeline_odd_rows(spark, tmp_path, vocabulary, tiktoken_encoding):
    """Null ids, null and very long texts, repeated rows and ids, an empty table: each has its stated result."""
    import corpus_pipeline

    rows = language_rows(60, 5)
    plain = [(100 + k, t, lang, "s", len(t)) for k, (_, t, lang) in enumerate(rows)]
    one, other, long = plain[0][1], plain[1][1], " ".join(t for _, t, *_ in plain[:30]) * 40
    odd = [(None, one, "aa", "s", None), (None, one, "aa", "s", None), (1, None, "aa", None, None), (2, "", None, "s", 0), (3, "12 .. !!", None, "s", 8), (4, long, "aa", "s", len(long)), (5, other, "bb", "s", 1), (5, other, "bb", "s", 1), (5, plain[2][1], "cc", "s", 1)]
    spark.createDataFrame(plain + odd, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted(r.doc_id for r in got if r.doc_id is not None)
    # No language: 1, 2, 3. Equal texts: the smallest id stays, once for each of its texts; rows without an id stay.
    assert ids == [4, 5, 5, *(k for k in range(100, 160) if k not in (101, 102))]
    assert [list(r.ids) for r in got if r.doc_id is None] == [tiktoken_encoding.encode_ordinary(one)] * 2
    assert [list(r.ids) for r in got if r.doc_id == 4] == [tiktoken_encoding.encode_ordinary(long)]
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_queries_and_sql_agree_by_name():
    from stowage.llm import queries

    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))

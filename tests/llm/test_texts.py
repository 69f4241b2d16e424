"""Token files, packing, near duplicates, licenses, toxicity, HTML and the pipeline."""

import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest_llm import SF, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from quireflow.llm import components, html_text, license_scan, near_duplicates, packing, queries, shared, token_ids, toxicity, wordcache

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_encoding_equals_the_library(path):
    texts = [r[1] for r in odd_rows()] + ["á ́x", "ΑΣ ΑΣ.", "a b  c", "it's I'LL 123 4,5", "  lead", "trail  ", "\n\n\n"]
    tokenizer = Tokenizer.from_file(path)
    found = [x.tolist() for low, flat, counts in wordcache.PieceEncoder(path).encode(pa.array(texts, pa.string())) for x in np.split(flat, np.cumsum(counts)[:-1])]
    assert found == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab \n\t,.'s1é 日", max_size=30), max_size=8))
def test_cached_encoding_of_any_text(texts):
    encoder = wordcache.encoder(BYTE)
    found = [x.tolist() for low, flat, counts in encoder.encode(pa.array(texts, pa.string())) for x in np.split(flat, np.cumsum(counts)[:-1])]
    assert found == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_white_space_at_the_end_joins_with_nothing(path):
    """In every order in which pieces can be encoded together."""
    ends, leads = ["a\n", "a ", "a\n\n", "a \n", "é\t"], ["\nb", "\n\nb", "  b", "\t\tb", "É b"]
    for k in range(40):
        encoder = wordcache.PieceEncoder(path)
        texts = [f"{t[:-1]}{k}{t[-1]}" for t in ends] + [f"{t}{k}" for t in leads] + ends + leads
        found = [x.tolist() for low, flat, counts in encoder.encode(pa.array(texts, pa.string())) for x in np.split(flat, np.cumsum(counts)[:-1])]
        assert found == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_cache_keeps_what_was_met_again(monkeypatch):
    monkeypatch.setattr(wordcache, "CACHE_ENTRIES", 60)
    encoder = wordcache.PieceEncoder(BYTE)
    for k in range(30):
        texts = [" ".join(f"word{k}x{j}" for j in range(10)) + " the same words", "the same words again"]
        found = [x.tolist() for low, flat, counts in encoder.encode(pa.array(texts, pa.string())) for x in np.split(flat, np.cumsum(counts)[:-1])]
        assert found == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts] and len(encoder.keys) <= 60


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=30), min_size=1, max_size=6))
def test_coding_round_trip(lists):
    flat, counts = np.array([x for row in lists for x in row], np.uint32), np.array([len(row) for row in lists])
    control, data = token_ids.encode_rows(flat, counts)
    for row, c, d in zip(lists, control.to_pylist(), data.to_pylist(), strict=True):
        assert (c, d) == token_ids.encode_values(np.array(row, np.uint32)) and token_ids.decode_values(c + d, len(row)).tolist() == row


def token_rows(docs):
    tokenizer, out, start = Tokenizer.from_file(BYTE), [], 0
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard", [100_000, 3_000_000])
def test_token_files(spark, clashing, shard):
    folder = shared.scratch_path(spark, "test-tokens")
    docs = clashing.where("doc_id is not null").dropDuplicates(["doc_id"])
    manifest = token_ids.write_corpus(docs, folder, BYTE, shard_tokens=shard)
    found = sorted(tuple(r) for r in token_ids.corpus_digest(spark, folder, manifest).collect())
    assert found == token_rows(sorted((r[0], r[1]) for r in docs.select("doc_id", "text").collect()))
    assert sum(r["n_tokens"] for r in token_ids.read_corpus(spark, folder, manifest).collect()) == sum(m["n_tokens"] for m in manifest)


def test_token_files_of_nothing_and_of_repeated_ids(spark, odd, nothing):
    folder = shared.scratch_path(spark, "test-tokens")
    assert token_ids.write_corpus(nothing, folder, BYTE) == [] and token_ids.corpus_digest(spark, folder, []).count() == 0
    folder = shared.scratch_path(spark, "test-tokens")
    manifest = token_ids.write_corpus(odd, folder, BYTE)
    assert token_ids.corpus_digest(spark, folder, manifest).count() == odd.count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40))
def test_packing_fills_sequences(lengths):
    pieces = packing.pack(lengths, 64)
    taken = {}
    for d, start, n, s, o in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert o == taken.get(s, 0) and n > 0
        taken[s] = o + n
    for d, n in enumerate(lengths):
        own = sorted((p[1], p[2]) for p in pieces if p[0] == d)
        assert [s for s, _ in own] == [sum(m for _, m in own[:k]) for k in range(len(own))] and sum(m for _, m in own) == n
    assert all(n == 64 or n & (n - 1) == 0 for n in taken.values())


def test_packing_balances_cost():
    pieces = packing.pack([40, 30, 20, 10, 10, 10, 8], 64)
    whole = {p[0]: p[3] for p in pieces}
    assert whole[0] != whole[1]  # the two longest lie in different sequences


def test_packed_documents(spark, clashing, odd, nothing):
    found = packing.pack_documents(clashing, WORD, block_tokens=5000).collect()
    tokenizer, docs = Tokenizer.from_file(WORD), {r[0]: r[1] for r in odd_rows()}
    for r in found:
        ids = np.array([*tokenizer.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids, 2], "<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    ends = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096 and packing.pack_documents(nothing, WORD).count() == 0


def shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def linked(docs):
    sets = {i: shingles(t) for i, t in docs if i is not None}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = [w for w in (f"w{k}" for k in range(100))]
    rng = np.random.RandomState(5)
    near = []
    for k in range(60):  # a family in which neighbours are alike, and the ends are not
        base = [*base]
        base[rng.randint(100)] = f"n{k}"
        near.append((10_000 + k, " ".join(base), "en", "s", 1))
    docs = docs.unionByName(spark.createDataFrame(near, docs.schema))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(docs).collect()}
    assert found == linked([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_near_duplicates_of_a_star(spark):
    """Copies of one original, each edited in three places of its own: alike the original, not one another."""
    rng = np.random.RandomState(7)
    base = [f"s{k}" for k in range(240)]
    docs = [(200, " ".join(base))]
    for k in range(400):
        words = [*base]
        for place in (rng.randint(5, 75), rng.randint(85, 155), rng.randint(165, 235)):
            words[place] = f"c{k}x{place}"
        docs.append((k if k < 200 else k + 1, " ".join(words)))
    expected = linked(docs)
    assert {c for _, c in expected.values()} == {0}
    found = near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected


def test_near_duplicates_of_two_stars(spark, monkeypatch):
    """Without hubs the blocks alone find the links."""
    monkeypatch.setattr(near_duplicates, "HUBS", 0)
    monkeypatch.setattr(near_duplicates, "BLOCK", 40)
    rng, docs = np.random.RandomState(8), []
    base = [f"s{k}" for k in range(240)]
    far = [w if k % 40 else f"f{k}" for k, w in enumerate(base)]
    for start, words in ((0, base), (1000, far)):
        docs.append((start + 50, " ".join(words)))
        for k in range(100):
            copy = [*words]
            for place in (rng.randint(5, 75), rng.randint(85, 155), rng.randint(165, 235)):
                copy[place] = f"c{start + k}x{place}"
            docs.append((start + (k if k < 50 else k + 1), " ".join(copy)))
    found = near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == linked(docs)


def test_near_duplicates_of_a_star_among_far_copies(spark, monkeypatch):
    """Copies too far from everything don't multiply the rows of a region; copies of theirs are found."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 40)
    rng, base = np.random.RandomState(9), [f"s{k}" for k in range(240)]
    docs, rows = [(75, " ".join(base))], []
    for k in range(700):
        words, edits = [*base], 3 if k < 150 else 12
        for place in range(edits):
            words[240 // edits * place + rng.randint(5, 240 // edits - 5)] = f"c{k}x{place}"
        docs.append((k if k < 75 else k + 1, " ".join(words)))
        if k > 680:
            docs.append((k + 1000, " ".join([*words, "more"])))
    divided = near_duplicates._divided

    def counted(crowded, *rest):
        found = divided(crowded, *rest)
        rows.append((found.count(), crowded.count()))
        return found

    monkeypatch.setattr(near_duplicates, "_divided", counted)
    found = near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == linked(docs)
    assert 0 < rows[0][0] < 2 * rows[0][1]


@pytest.mark.parametrize("threshold", [80, 85])
def test_linkable_members_keep_all_links(spark, threshold):
    rng = np.random.RandomState(threshold)
    sets, sizes = {}, {}
    for k in range(300):
        words = rng.permutation(60)[: rng.randint(45, 60)].tolist() + [1000 * (k + 1) + x for x in range(rng.randint(0, 25))]
        sets[k] = set(words if k % 3 else [w if w < 1000 else w % 1000 + 100 * (k // 30 + 1) for w in words])
        sizes[k] = len(sets[k])
    links = {x for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) for x in (a, b)}
    stored = spark.createDataFrame([(k, np.array(sorted(x), np.int64).tobytes()) for k, x in sets.items()], "doc_id long, shingles binary")
    counts = near_duplicates._shared_shingles(stored)
    common = {k: len(x & set().union(*(y for j, y in sets.items() if j != k))) for k, x in sets.items()}
    assert {r["doc_id"]: (r["n"], r["common"]) for r in counts.collect()} == {k: (sizes[k], common[k]) for k in sets}
    left = {r["doc_id"] for r in near_duplicates._linkable(spark.createDataFrame([(1, k) for k in sets], "crowd long, doc_id long"), counts, threshold).collect()}
    assert links and links <= left and len(left) < len(sets)


def test_stage_joins_pairs_of_a_similarity_of_080(spark):
    """Sets of 100 and 82 shingles, and of 100 and 79: similarities of 0.82 and 0.79."""
    words = [[f"{x}{k}" for k in range(104)] for x in "pq"]
    docs = [(1, words[0]), (2, words[0][:86]), (3, words[1]), (4, words[1][:83])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()) == [1, 3, 4]
    assert near_duplicates.least_estimate(80) < near_duplicates.least_estimate(85) < 0.6


def test_near_duplicates_of_odd_rows(clashing, odd, nothing):
    found = near_duplicates.near_duplicates(clashing).collect()
    expected = linked([(r[0], r[1]) for r in odd_rows()])
    assert len(found) == odd.count()
    assert all((r["n_shingles"], r["component_id"]) == expected[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"]) for r in found if r["doc_id"] is not None)
    assert near_duplicates.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """Ids 5 and 9 have two texts each: they join what either is like."""
    one, two, three = (" ".join(f"{x}{k}" for k in range(60)) for x in "xyz")
    docs = [(3, one), (5, one), (5, two), (7, two + " end"), (9, three), (9, two), (11, three + " end"), (20, "something else in five words or more")]
    found = near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(3, 3), (5, 3), (5, 3), (7, 3), (9, 3), (9, 3), (11, 3), (20, 20)]


def test_neighbours_of_dense_regions():
    """Equal labels: everyone is linked with the next one, nobody with all."""
    labels = np.zeros((1000, 4), np.int64)
    first, second = near_duplicates.neighbours(np.zeros(1000, int), labels)
    assert len(first) == 999 and (second - first == 1).all()
    first, second = near_duplicates.neighbours(np.zeros(5, int), labels[:5])
    assert len(first) == 10


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_equal_brute_force(spark, edges):
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: find(i) for i in parent}


def test_licenses(spark, clashing, odd, nothing):
    texts = ["Released under the MIT License.", "text Licensed under CC BY-NC 4.0. and\n" * 3, "This work is licensed under the GNU General Public License, version 3.", "Licensed by the apache of license and version under two", None, "", "x\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_findings"], r["licenses"]) for r in license_scan.report(license_scan.scanned(docs)).collect()}
    assert found == {0: (1, "MIT"), 1: (3, "CC-BY-NC-4.0"), 2: (1, "GPL-3.0"), 3: (0, ""), 4: (0, ""), 5: (0, ""), 6: (2, "Apache-2.0,MIT")}
    spans = {r["doc_id"]: [texts[r["doc_id"]][f["start"] : f["end"]] for f in r["findings"]] for r in license_scan.scanned(docs).collect()}
    assert spans[0] == ["Released under the MIT License"] and spans[6][1] == "Released under the MIT License"
    assert license_scan.scanned(clashing).count() == odd.count() and license_scan.scanned(nothing).count() == 0


def test_patience_alignment():
    assert license_scan.align(list("xaybzc"), list("abc")) == [(1, 0), (3, 1), (5, 2)]
    assert license_scan.align(list("abcabc"), list("abc"))[0] == (0, 0)
    assert license_scan.align([], list("a")) == []


def test_licenses_of_one_family(spark):
    """A notice counts for the license that it names only."""
    program = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    expected = {
        "Licensed under the BSD License": "", "Licensed under CC BY-ND 4.0": "CC-BY-ND-4.0", "Licensed under CC BY 4.0": "CC-BY-4.0", "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0",
        program.format("General Public", "3"): "GPL-3.0", program.format("General Public", "2"): "GPL-2.0", program.format("Affero General Public", "3"): "AGPL-3.0", program.format("Lesser General Public", "3"): "LGPL-3.0",
        program.format("Lesser General Public", "2.1"): "LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 3": "LGPL-3.0", "Licensed under the Apache License, Version 1.1": "",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "CC-BY-NC-4.0", "Released under CC0 1.0": "CC0-1.0",
    }
    docs = spark.createDataFrame(list(enumerate(expected)), "doc_id long, text string")
    found = {r["doc_id"]: r["licenses"] for r in license_scan.report(license_scan.scanned(docs)).collect()}
    assert [found[k] for k in range(len(expected))] == list(expected.values())


def test_licenses_with_changed_words():
    """Every long notice is found with one word in ten replaced or inserted, unless its name is hit."""
    known, random = license_scan.prepared(license_scan.TEMPLATES), np.random.RandomState(3)
    for name, words, _, runs in known:
        fixed = {k for low, high in runs for k in range(low, high)}
        free = [k for k in range(len(words)) if k not in fixed]
        if len(free) < 15:
            continue
        for trial in range(20):
            text = words.copy()
            text[random.choice(free, len(words) // 10, replace=False)] = random.randint(1, 2**62, len(words) // 10)
            within = [k for k in range(len(words)) if not any(low < k < high for low, high in runs)]
            text = np.insert(text, random.choice(within), np.uint64(random.randint(1, 2**62)))
            around = random.randint(1, 2**62, 40).astype(np.uint64)
            found = license_scan.scan(np.concatenate([around[:20], text, around[20:]]), known)
            assert [f[0] for f in found] == [name], (name, trial)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=14), st.lists(st.sampled_from("abcdefgh"), max_size=9))
def test_alignment_against_dynamic_programming(text, template):
    """An alignment is a common subsequence, never longer than the longest, and as long where every word is unique."""
    best = [[0] * (len(template) + 1) for _ in range(len(text) + 1)]
    for a, x in enumerate(text):
        for b, y in enumerate(template):
            best[a + 1][b + 1] = best[a][b] + 1 if x == y else max(best[a][b + 1], best[a + 1][b])
    pairs = license_scan.align(text, template)
    assert all(text[p] == template[q] for p, q in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
    assert len(pairs) <= best[-1][-1]
    if len(set(text)) == len(text) and len(set(template)) == len(template):
        assert len(pairs) == best[-1][-1]


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = [r for r in queries.op9_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    toxic = [r["predicted"] for r in found if labels[r["doc_id"]]]
    clean = [r["predicted"] for r in found if not labels[r["doc_id"]]]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02


def test_toxicity_of_odd_rows(spark, clashing, odd, nothing):
    labels = spark.createDataFrame([(8, 0), (10, 1), (None, 1), (12, None)], "doc_id long, toxic int")
    found = toxicity.scored(clashing, toxicity.fit(clashing, labels)).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    model = toxicity.fit(nothing, labels)
    assert toxicity.scored(odd, model).count() == odd.count() and toxicity.scored(nothing, model).count() == 0


def test_html():
    w = html_text.DEFAULT_WEIGHTS
    page = '<html><head><title>T t</title><style>p{}</style><script>var a="</p><p>bad";</script></head><body><nav><ul><li><a href="/x">Menu one</a></ul></nav><div class="ad">Buy now<article><h1>Head &amp; line</h1><p><b>First  line.<br><p>Second\n line with words &#233; &amp x<aside>side words</aside><p>Third of the page words<form><input>Name</form></article><section id="comments"><p>Nice one</section><footer>&copy; foot</footer>'
    assert html_text.main_text(page, w) == "Head & line\nFirst line.\nSecond line with words é & x\nThird of the page words"
    assert html_text.main_text("", w) == "" and html_text.main_text("just text a < b", w) == "just text a < b" and html_text.main_text("<p>unclosed <b", w) == "unclosed"
    assert html_text.main_text('<p title="a>b">quoted words here</p>', w) == "quoted words here"
    assert html_text.best_region([-1, 2, -1, 3, -5, 1]) == (1, 4) and html_text.best_region([-1]) == (0, 0)


@pytest.mark.parametrize("item", ["<li><a href='/x'>Menu</a>", "<p>Menu", "<li><span>Menu"])
def test_html_of_many_unclosed_elements(item):
    """An article after a menu of 300 items without end tags."""
    page = f"<nav><ul>{item * 300}</ul></nav><div><p>First words of the page</p><p>Second words of the page</p></div>"
    assert html_text.main_text(page, html_text.DEFAULT_WEIGHTS) == "First words of the page\nSecond words of the page"
    assert max(bad for _, value, bad, _, _ in html_text.tokens(page) if value.startswith("First")) is False


ARTICLE = "<article><h1>Head of it</h1><p>First words of the page</p>{}<p>Second words of the page and a tail of twenty words so that nothing of it may be lost on the way</p></article>"
WORDS = "Head of it\nFirst words of the page\nSecond words of the page and a tail of twenty words so that nothing of it may be lost on the way"


@pytest.mark.parametrize("weights", [html_text.DEFAULT_WEIGHTS, {"word": 0.9, "link": 0.1, "boilerplate": -0.5, "tag": -0.5, "label": -1.0, "form": -1.0, "li": -1.0, "nav": -1.0, "p": -0.05, "div": -0.9}])
def test_html_hard_cases(weights):
    form = "<form>" + "".join(f"<label>Field {k}</label><input name=f{k}><p>Please fill in the field</p>" for k in range(30)) + "</form>"
    assert html_text.main_text(ARTICLE.format(form), weights) == WORDS
    assert html_text.main_text(ARTICLE.format("\u0130" * 60 + "<script>var x = '<p>no';</SCRIPT >"), weights) == WORDS.replace("\nSecond", "\n" + "\u0130" * 60 + "\nSecond")
    for attribute in ('class="post share-post"', 'class="widget-content"', 'id="no-sidebar"', 'class="has-comments"', 'class="adventure"'):
        assert html_text.main_text(f"<div {attribute}>{ARTICLE.format('')[9:-10]}</div>", weights) == WORDS
    for attribute in ('class="cookie-banner"', 'class="x site-footer"', "id=sidebar-left", 'class="comment-body"', 'role="navigation"', 'class="ad"'):
        assert html_text.main_text(ARTICLE.format(f"<div {attribute}><p>Not of the page</p></div>"), weights) == WORDS
    deep = "<div>" * 20_000 + "<p>deep words of it</p>" + "</div>" * 20_000
    assert html_text.main_text(deep, weights) == "deep words of it"
    long_page = ARTICLE.format("<p>" + "many words " * 200_000 + "</p>")
    assert len(html_text.main_text(long_page, weights)) == len(WORDS) + 1 + 200_000 * 11 - 1


class _Dom(HTMLParser):
    """The article's blocks by a parser of its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.block = False, [], ""

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag == "br":
            self.block += " "
        elif tag != "b":
            self.end()

    def handle_endtag(self, tag):
        if tag != "b":
            self.end()
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        self.block += data if self.inside else ""

    def end(self):
        self.blocks += [" ".join(self.block.split())]
        self.block = ""


def test_html_equals_a_dom_on_all_pages():
    weights = html_text.DEFAULT_WEIGHTS
    for page in pq.read_table("/root/testdata/sf0.1/pages.parquet")["html"].to_pylist():
        dom = _Dom()
        dom.feed(page)
        dom.end()
        assert html_text.main_text(page, weights) == "\n".join(b for b in dom.blocks if b)


def test_html_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", "<p>x y</p>"), (None, "u", "<main>z z</main>")], "page_id long, url string, html string")
    found = html_text.extracted(pages, html_text.fit_weights(pages)).collect()
    assert sorted((r["text"], r["n_chars"]) for r in found) == [("", 0), ("", 0), ("x y", 3), ("z z", 3)]
    assert html_text.extracted(pages.where("false"), html_text.fit_weights(pages.where("false"))).count() == 0


def test_html_keeps_whole_articles(spark):
    import re
    from html import unescape

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op10_html_text(spark, SF).collect():
        article = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_pipeline_of_odd_rows(spark, odd, nothing):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = shared.stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(ids)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0

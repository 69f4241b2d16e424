"""Quality rules, decontamination, URL filters against their SQL; personal data against brute force."""

import hashlib
import re

import duckdb
import pytest
from conftest_llm import SCHEMA, SF, equal, odd_rows

from quireflow.llm import decontamination, personal_data, quality, queries, url_filter


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, duck, name):
    equal(queries.QUERIES[name](spark, SF), duck.execute(queries.ORACLES[name]))


@pytest.fixture(scope="module")
def odd_duck():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r for r in odd_rows() if r[0] is not None and r[0] != 8])
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    return con


def judged(docs):
    found = quality.measured(docs)
    return quality.judged(found, quality.references(found))


def test_quality_of_odd_rows(odd, clashing, nothing, odd_duck):
    one_each = odd.where("doc_id is not null and doc_id != 8")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    equal(judged(one_each).select(columns), odd_duck.execute(quality.ORACLE))
    assert judged(nothing).count() == 0
    assert judged(clashing).count() == odd.count() and set(odd.columns) < set(judged(clashing).columns)


@pytest.mark.parametrize("hashes", [None, 1, 3])
def test_repeated_words(spark, monkeypatch, hashes):
    """Also where almost all windows share a hash."""
    if hashes:
        whole = quality.window_hash
        monkeypatch.setattr(quality, "window_hash", lambda words, i: whole(words, i) % hashes)
    docs = spark.createDataFrame([(1, "a b c x a b c", "en"), (2, "a a a a", "en"), (3, "a b a b a", "en"), (4, "a b c d", "en")], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["n_repeat_words"] for r in judged(docs).collect()}
    assert found == {1: 6, 2: 4, 3: 5, 4: 0}


def test_template_questions(spark):
    item = "A train leaves the old station at 7 hours with 120 kg of coal, and Peter counts 120 bags while 7 workers wait beside the long platform."
    docs = [
        (1, "Intro words here. " + item), (2, item.replace("120", "85").replace("7", "9").replace("Peter", "Maria")), (3, item.replace("120 bags", "44 bags").replace("7 workers", "3 workers").replace("at 7", "at 5")),
        (4, "A train leaves the old station and nobody counts anything at all today."), (5, None), (6, ""), (1, "Intro words here. " + item),
    ]
    benchmark = spark.createDataFrame([(10, item), (11, None), (12, "too short")], "item_id long, text string")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: r["contaminated"] for r in decontamination.judged(docs, benchmark).collect()}
    assert found == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}
    assert decontamination.judged(docs, benchmark).count() == 7 and decontamination.clean(docs, benchmark).count() == 4
    assert decontamination.clean(docs, benchmark.where("false")).count() == 7
    assert decontamination.judged(docs.where("false"), benchmark).count() == 0
    nameless = spark.createDataFrame([(None, item), (None, "A train leaves and nothing more is said of it here today."), (None, None), (None, item)], "doc_id long, text string")
    assert [r["contaminated"] for r in decontamination.judged(nameless, benchmark).collect()].count(True) == 2
    assert sorted(str(r["text"])[:7] for r in decontamination.clean(nameless, benchmark).collect()) == ["A train", "None"]


def test_occurrences_are_judged_each(spark):
    item = "A train leaves the old station at 7 hours with 120 kg of coal, and Peter counts 120 bags while 7 workers wait beside the long platform."
    variants = [item.replace("120 kg", f"{k} kg").replace("120 bags", f"{k + 40} bags").replace("at 7", f"at {k + 3}").replace("7 workers", f"{k + 9} workers") for k in (31, 52, 73)]
    docs = [(1, " ".join([variants[0], item, *variants[1:]])), (2, " ".join(variants)), (3, variants[0]), (3, item), (4, item)]
    benchmark = spark.createDataFrame([(10, item)], "item_id long, text string")
    found = decontamination.judged(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert sorted({(r["doc_id"], r["contaminated"]) for r in found}) == [(1, True), (2, False), (3, True), (4, True)]


def test_decontamination_of_odd_rows(spark, odd, clashing):
    benchmark = spark.createDataFrame([(1, "words and word5 and word6 and word7 and"), (2, None)], "item_id long, text string")
    assert decontamination.judged(clashing, benchmark).count() == odd.count() and decontamination.clean(clashing, benchmark).columns == clashing.columns


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "HTTP://Example.COM/en/x?q#f", "https://www.example.com/en/", "https://a.www.example.com/en/y", "https://x.net/es/1", "https://xnet/es/1", "https://net/fr/", "https://x.com", "https://x.com?/", "https://x.org/a#b", "ftp://ÉX.com/en", "https://" + "a." * 30_000 + "net/es/" + "p" * 50_000]
    pages = spark.createDataFrame([(k, u, "keep") for k, u in enumerate(urls)] + [(4, urls[4], "keep")], "page_id long, url string, rule string")
    found = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(pages, url_filter.rule_table(spark, url_filter.RULES)).orderBy("page_id").collect()]
    assert found == [
        (0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "example.com", "/en/x", "example.com/en/", "block"), (4, "example.com", "/en/x", "example.com/en/", "block"),
        (5, "www.example.com", "/en/", "www.example.com/en/", "allow"), (6, "a.www.example.com", "/en/y", "www.example.com/en/", "allow"), (7, "x.net", "/es/1", "net/es/", "block"), (8, "xnet", "/es/1", None, "allow"), (9, "net", "/fr/", "net/fr/", "block"),
        (10, "x.com", "", None, "allow"), (11, "x.com", "", None, "allow"), (12, "x.org", "/a", None, "allow"), (13, "Éx.com", "/en", "com/", "allow"), (14, "a." * 30_000 + "net", "/es/" + "p" * 50_000, "net/es/", "block"),
    ]
    assert url_filter.judged(pages.where("false"), url_filter.rule_table(spark, url_filter.RULES)).count() == 0


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    checks = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    for kind, pattern, good in checks:
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if good(m)]
    return out


def check_personal_data(docs, texts):
    model = personal_data.trained(personal_data.vectors(docs))
    found = personal_data.report(personal_data.with_spans(docs, model)).collect()
    assert len(found) == len(texts)
    by_id = {}
    for i, t in texts:
        by_id.setdefault(i, []).append(base_spans(t))
    for r in found:
        expected = by_id[r["doc_id"]]
        hashes = {hashlib.sha256(",".join(e).encode()).hexdigest(): e for e in expected}
        assert r["base_sha256"] in hashes
        base = hashes[r["base_sha256"]]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(e.startswith(k) for e in base) for k in ("email", "ip", "card", "phone")]
        assert r["spans"].split(",")[: len(base)] == base or not base
    return found


def test_personal_data_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_personal_data(docs, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_personal_data_of_odd_rows(odd, clashing, nothing):
    check_personal_data(clashing, [(r[0], r[1]) for r in odd_rows()])
    assert personal_data.report(personal_data.with_spans(nothing, personal_data.trained(personal_data.vectors(nothing)))).count() == 0


def test_secrets_are_added_and_redacted(spark):
    texts = [(k, f'some words and token = "{"%040x" % (k * 7919 + 10**40)}" more words') for k in range(60)] + [(100 + k, f"plain words without anything {'w' * 18} at all") for k in range(60)] + [(200, "write to jo@x.example.com today"), (201, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    spanned = personal_data.with_spans(docs, personal_data.trained(personal_data.vectors(docs)))
    out = {r["doc_id"]: r["text"] for r in personal_data.redacted(spanned).collect()}
    assert all(out[k].startswith("some words and <SECRET>") and out[k].endswith(" more words") for k in range(60))
    assert all(out[k] == t for k, t in texts if 100 <= k < 200) and out[200] == "write to <EMAIL> today" and out[201] is None


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_planted_secrets_are_found(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    spanned = personal_data.with_spans(docs, personal_data.trained(personal_data.vectors(docs)))
    planted = docs.where(docs["text"].rlike("token = \"[0-9a-fA-F]{40}\"")).select("doc_id")
    found = personal_data.report(spanned).where("spans like '%secret:%'").select("doc_id").distinct()
    assert planted.join(found, "doc_id", "left_anti").count() == 0 and found.count() <= planted.distinct().count() + 2


def test_few_candidates_calibrate_themselves(spark):
    """Three secrets and three ordinary assignments, whatever part of the hash their ids fall into."""
    texts = [(k, f'key it with password: {"%032x" % (7**40 + k)} and go') for k in range(3)] + [(10 + k, "the secret: something plain and simple") for k in range(3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = personal_data.report(personal_data.with_spans(docs, personal_data.trained(personal_data.vectors(docs)))).collect()
    assert {r["doc_id"] for r in rows if "secret:" in r["spans"]} == {0, 1, 2}


def test_schema_is_kept():
    assert SCHEMA.startswith("doc_id")

"""Quality rules: counts of words, symbols and repeats, and the divergence of two histograms from language references.

Everything is built-in column expressions. For each document two histograms are
compared with the reference of its language by Jensen-Shannon distance (base 2,
0 to 1): character classes, and the language's common words. A reference is the
mean of the relative histograms of all the language's documents of at least
MIN_WORDS words. A document is rejected if its base counts fail, or if a
distance exceeds its limit and the document is long enough for that histogram
(guards MIN_CHARS and GUARD_WORDS).

Null texts count as empty (no words: base_failed). A null language, or one with
no reference, is compared with nothing; one without a list of common words is
compared by characters only. Repeated rows are judged each; an empty table gives
no rows; other columns stay as they are (columns named like the result's are
replaced). Texts are read once: measured() gives counts and histograms, which a
caller stores; references() and judged() work on those.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm.shared import let

#: Common words by language, in lower case.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that", "is", "with"],
    "fr": ["de", "la", "le", "et", "les", "des", "que", "un"],
    "de": ["der", "die", "und", "in", "den", "das", "mit", "zu"],
    "es": ["de", "la", "que", "el", "en", "los", "se", "del"],
}
#: Runs without the class, for the classes upper case, digits, punctuation, symbols and non-ASCII.
OUTSIDE = {"upper": r"[^A-Z]+", "digit": r"[^0-9]+", "punct": r"[^.,;:!?'\"()\-]+", "symbol": r"[^#$%&*+/<=>@\[\\\]^_`{|}~]+", "wide": r"[\x00-\x7F]+"}
MIN_WORDS, MIN_CHARS = 50, 200
#: Words from which the common-word distance of a document counts: shorter ones vary too much.
GUARD_WORDS = 120
#: Largest distances of documents that are kept.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.32, 0.24
#: References beyond this number of languages are joined by a shuffle.
MAX_BROADCAST_LANGUAGES = 10_000
SYMBOLS = "#*$%&|<>"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
#: Columns that hold a document's histograms between measured() and judged().
_HELD = ["__lang", "__length", "__chars", "__common"]


def _gone(text: Column, parts: list[str], by: str = "") -> Column:
    for part in parts:
        text = F.replace(text, F.lit(part), F.lit(by))
    return text


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: a + x)


def _relative(counts: Column, n: Column) -> Column:
    """Counts, and what is left of n, over n; null where n is 0."""
    return F.when(n > 0, F.transform(F.concat(counts, F.array(n.cast("double") - _total(counts))), lambda x: x / n))


def _common_counts(words: Column) -> Column:
    """How often each common word of one language occurs; null for a language without a list."""

    def counted(language: str) -> Column:
        known = F.filter(F.transform(words, F.lower), lambda w: w.isin(COMMON_WORDS[language]))
        return let(F.array_join(known, "  "), lambda kept: F.array(*[(_less(F.concat(F.lit(" "), kept, F.lit(" ")), f" {w} ") / (len(w) + 2)).cast("double") for w in COMMON_WORDS[language]]))

    out = None
    for language in COMMON_WORDS:
        out = F.when(F.col("__lang") == language, counted(language)) if out is None else out.when(F.col("__lang") == language, counted(language))
    return out


def _less(text: Column, part: str) -> Column:
    """Bytes of the occurrences of an ASCII string."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))


def measured(docs: DataFrame, *, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """docs with the base counts, base_failed, and the histograms that references() and judged() need; the only pass over texts.

    Lower-case letters and spaces are in no character class; what is left
    without them is short, and all classes are counted there.
    """
    out = docs.drop(*_COUNTS, *_HELD)
    text, rest = F.coalesce(F.col(text_column).cast("string"), F.lit("")), F.col("__rest")
    out = out.withColumns({"__text": text, "__lang": F.col(lang_column).cast("string"), "__rest": F.regexp_replace(text, "[a-z ]+", "")})
    spaced = let(_gone(F.col("__text"), ["\t", "\n", "\x0b", "\x0c", "\r"], " "), lambda t: F.array_remove(F.split(t, " ", -1), ""))
    lines = F.filter(F.split("__text", "\n", -1), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "")
    classes = F.array(*[F.length(F.regexp_replace(rest, p, "")).cast("double") for p in OUTSIDE.values()])

    def of_words(words: Column) -> Column:
        letters = F.length(F.array_join(words, ""))
        return F.struct(F.size(words).cast("long").alias("n_words"), letters.cast("long").alias("word_chars"), _repeated_words(words).alias("n_repeat_words"), _common_counts(words).alias("common"))

    out = out.withColumn("__w", let(spaced, of_words))
    out = out.withColumns(
        {
            **{c: F.col(f"__w.{c}") for c in ("n_words", "word_chars", "n_repeat_words")},
            "n_symbols": (F.octet_length(rest) - F.octet_length(_gone(rest, list(SYMBOLS)))).cast("long"),
            "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
            "__length": F.length("__text").cast("long"),
        }
    )
    chars = F.concat(classes, F.array((F.col("__length") - F.col("word_chars")).cast("double")))
    out = out.withColumns({"__chars": let(chars, lambda c: _relative(c, F.col("__length"))), "__common": let(F.col("__w.common"), lambda c: _relative(c, F.col("n_words")))})
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("__text", "__rest", "__w")


def references(found: DataFrame) -> DataFrame:
    """__lang, __char_ref, __word_ref: the mean histograms of each language's measured documents that are long enough."""
    n_words = max(len(w) for w in COMMON_WORDS.values()) + 1
    means = lambda c, n: [F.avg(F.get(c, F.lit(k))).alias(f"{c}{k}") for k in range(n)]
    n_chars = len(OUTSIDE) + 2
    mean = found.where(f"n_words >= {MIN_WORDS} and __lang is not null").groupBy("__lang").agg(*means("__chars", n_chars), *means("__common", n_words))
    return mean.select("__lang", F.array(*[f"__chars{k}" for k in range(n_chars)]).alias("__char_ref"), F.when(F.col("__common0").isNotNull(), F.array(*[f"__common{k}" for k in range(n_words)])).alias("__word_ref"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays that sum to 1; null if either is null."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0).cast("double"), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def window_hash(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more.

    A window is a number with its hash above its place, in as many bits as the
    places need; sorted, windows of one hash are neighbours. Neighbours' words
    are compared; where windows of one hash differ, those of the text that have
    such a neighbour are sorted by their words, which settles what is equal.
    """
    n = F.size(words)
    bits = F.length(F.bin(n.cast("long"))).cast("int")

    def neighbours(items: Column, same: Callable[[Column, Column], Column]) -> Column:
        """Items of a sorted array that are the same as the one before or after."""
        return F.filter(items, lambda x, i: same(x, F.get(items, i - 1)) | same(x, F.get(items, i + 1)))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end"))
        return F.aggregate(F.sort_array(places), start, lambda s, x: F.struct((s["total"] + x + 3 - F.greatest(x, s["end"])).alias("total"), (x + 3).alias("end")), lambda s: s["total"])

    def confirmed(alike: Column, bits: Column, same: Callable[[Column, Column], Column]) -> Column:
        place = lambda x: x.bitwiseAND(_left(F.lit(1).cast("long"), bits) - 1)
        word = lambda x, k: F.get(words, place(x).cast("int") + k)
        differ = lambda x, y: (word(x, 0) != word(y, 0)) | (word(x, 1) != word(y, 1)) | (word(x, 2) != word(y, 2))
        mixed = F.size(F.filter(alike, lambda x, i: same(x, F.get(alike, i - 1)) & differ(x, F.get(alike, i - 1)))) > 0
        by_words = F.sort_array(F.transform(alike, lambda x: F.struct(word(x, 0).alias("a"), word(x, 1).alias("b"), word(x, 2).alias("c"), place(x).alias("place"))))
        equal = let(by_words, lambda e: neighbours(e, lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])))
        return F.when(mixed, covered(F.transform(equal, lambda x: x["place"]))).otherwise(covered(F.transform(alike, place)))

    def windows(bits: Column) -> Column:
        packed = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: _left(window_hash(words, i), bits).bitwiseOR(i.cast("long"))))
        same = lambda x, y: _unsigned_right(x.bitwiseXOR(y), bits) == 0
        alike = let(packed, lambda p: neighbours(p, same))
        return let(alike, lambda p: F.when(F.size(p) > 0, confirmed(p, bits, same)))

    return F.coalesce(F.when(n >= 3, let(bits, windows)), F.lit(0).cast("long"))


def _left(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits)


def _unsigned_right(x: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, bits)


def judged(found: DataFrame, refs: DataFrame) -> DataFrame:
    """Measured documents with char_distance, word_distance, kept; without the histograms."""
    out = found.drop("char_distance", "word_distance", "kept").join(F.broadcast(refs) if refs.count() <= MAX_BROADCAST_LANGUAGES else refs, "__lang", "left")
    out = out.withColumns({"char_distance": js_distance(F.col("__chars"), F.col("__char_ref")), "word_distance": js_distance(F.col("__common"), F.col("__word_ref"))})
    diverges = (F.coalesce(F.col("char_distance"), F.lit(0.0)) > MAX_CHAR_DISTANCE) & (F.col("__length") >= MIN_CHARS)
    diverges = diverges | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > MAX_WORD_DISTANCE) & (F.col("n_words") >= GUARD_WORDS)
    return out.withColumn("kept", ~F.col("base_failed") & ~diverges).drop(*_HELD, "__char_ref", "__word_ref")


ORACLE = f"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
wins AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
    SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws[unnest(range(1, len(ws) - 1))] AS a, ws[unnest(range(1, len(ws) - 1)) + 1] AS b, ws[unnest(range(1, len(ws) - 1)) + 2] AS c FROM base WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS j FROM wins WHERE n > 1) GROUP BY doc_id),
hist AS (
  SELECT doc_id, lang, t, ws, ls, len(ws) AS n_words, list_sum(list_transform(ws, lambda x: length(x))) AS wc,
    {", ".join(f"length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')) AS c_{k}" for k, p in OUTSIDE.items())},
    CASE lang {" ".join(f"WHEN '{g}' THEN [{', '.join(f'len(list_filter(lw, lambda x: x = {chr(39)}{w}{chr(39)}))' for w in ws)}]" for g, ws in COMMON_WORDS.items())} END AS cw
  FROM (SELECT *, list_transform(ws, lambda x: lower(x)) AS lw FROM base)),
rel AS (
  SELECT *, CASE WHEN length(t) > 0 THEN list_transform([{", ".join(f"c_{k}" for k in OUTSIDE)}, length(t) - coalesce(wc, 0), coalesce(wc, 0) - {" - ".join(f"c_{k}" for k in OUTSIDE)}], lambda x: x / length(t)::DOUBLE) END AS ch,
    CASE WHEN n_words > 0 AND cw IS NOT NULL THEN list_transform(list_append(cw, n_words - list_sum(cw)), lambda x: x / n_words::DOUBLE) END AS cm
  FROM hist),
refs AS (
  SELECT lang, [{", ".join(f"avg(ch[{k}])" for k in range(1, len(OUTSIDE) + 3))}] AS chr_ref, CASE WHEN avg(cm[1]) IS NOT NULL THEN [{", ".join(f"avg(cm[{k}])" for k in range(1, 10))}] END AS word_ref
  FROM rel WHERE n_words >= {MIN_WORDS} AND lang IS NOT NULL GROUP BY lang),
dist AS (
  SELECT rel.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
    sqrt(greatest(list_sum(list_transform(list_zip(ch, chr_ref), lambda z: (CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END) + (CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END))) / 2, 0)) AS cd,
    sqrt(greatest(list_sum(list_transform(list_zip(cm, word_ref), lambda z: (CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END) + (CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END))) / 2, 0)) AS wd
  FROM rel LEFT JOIN refs USING (lang) LEFT JOIN rep USING (doc_id)),
flag AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM dist)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(wc, 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(cd, 0) > {MAX_CHAR_DISTANCE} AND length(t) >= {MIN_CHARS}) AND NOT (coalesce(wd, 0) > {MAX_WORD_DISTANCE} AND n_words >= {GUARD_WORDS}) AS kept
FROM flag
"""

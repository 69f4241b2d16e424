"""Benchmark decontamination by template canonicalisation, in built-in expressions.

Names (capitalised words inside a sentence), numbers and units after numbers
are marked as typed slots; the rest is lower-cased and stripped of punctuation.
Windows of five template words of all documents are hash-joined with the
benchmark's. A document is contaminated by an item if it has at least 80 % of
the item's windows and the slots agree: wherever the item repeats a value, the
document repeats one too, so that the mapping of slot values is (to 80 %) a
function. Where it isn't over the whole document, each occurrence is aligned by
itself: around each offset between document and item, as far as the item is long,
an item's window is paired with the nearest of the document's. That also finds questions asked again with other numbers or names.

Windows with fewer than MIN_PLAIN plain words say too little and are left out
on both sides; so are items with fewer than five words. Null texts (or item
texts) have no windows; rows with one doc_id are judged together, those with a
null id by their text; an empty benchmark leaves all documents clean; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm.shared import let

WINDOW, MIN_SHARE, MIN_CONSISTENCY, MIN_PLAIN = 5, 0.8, 0.8, 2
#: Marks of slots; characters for private use, taken out of texts first.
NAME, NUMBER, UNIT, AFTER = "\ue001", "\ue002", "\ue003", "\ue004"
UNITS = ["kg", "g", "mg", "km", "m", "cm", "mm", "miles", "mile", "hours", "hour", "minutes", "minute", "seconds", "days", "weeks", "years", "dollars", "cents", "euros", "percent", "degrees", "liters", "litres", "inches", "feet", "pounds"]
#: Benchmarks with more windows are joined by a shuffle.
MAX_BROADCAST_WINDOWS = 500_000
#: (pattern, replacement) in order; $1 and $2 are groups.
STEPS = [
    (f"[{NAME}{NUMBER}{UNIT}]", " "),
    ("([a-zà-öø-ÿ,;] )([A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+)", f"$1{NAME}$2"),
    (f"({NAME}[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+ )([A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+)", f"$1{NAME}$2"),
    ("([0-9]+)[.,]([0-9]+)", "$1$2"),
    ("([0-9]+)", f" {NUMBER}$1 "),
]
UNIT_STEP = (f"({NUMBER}[0-9]+ +)({'|'.join(UNITS)}) ", f"$1{UNIT}$2 ")
PLAIN = f"[^\\p{{L}}0-9{NAME}{NUMBER}{UNIT}]+"
CANONICAL = (f"([{NAME}{NUMBER}{UNIT}])[^ ]+", "$1")


def marked(text: Column) -> Column:
    """The text's words, slots with a mark before their value, joined by spaces."""
    for pattern, by in STEPS:
        text = F.regexp_replace(text, pattern, by)
    text = F.regexp_replace(F.concat(F.lower(text), F.lit(" ")), PLAIN, " ")
    return F.btrim(F.regexp_replace(text, *UNIT_STEP))


def unnamed(id_column: str, text_column: str) -> Column:
    """What tells rows with a null id from each other; null where there is an id."""
    return F.when(F.col(id_column).isNull(), F.xxhash64(F.col(text_column).cast("string")))


def windows(table: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, row (a hash of the text), place, hash, slots (the values of the window's slots, comma-joined, null if the text has none)."""
    mark = f"[{NAME}{NUMBER}{UNIT}]"
    out = table.select(F.col(id_column).alias("id"), unnamed(id_column, text_column).alias("unnamed"), marked(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).alias("marked"))
    out = out.withColumn("row", F.xxhash64("marked")).withColumn("slotted", F.col("marked").rlike(mark))
    canonical = F.when(F.col("slotted"), F.regexp_replace("marked", *CANONICAL)).otherwise(F.col("marked"))

    def each(both: Column) -> Column:
        words, n = both["words"], F.size(both["words"]) - (WINDOW - 1)
        slots = lambda i: F.concat_ws(",", F.filter(F.slice(both["raw"], i + 1, WINDOW), lambda w: (w >= NAME) & (w < AFTER)))
        window = lambda i: F.struct(i.alias("place"), F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]).alias("hash"), F.when(both["raw"].isNotNull(), slots(i)).alias("slots"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), window))

    split = F.struct(F.split(canonical, " ", -1).alias("words"), F.when(F.col("slotted"), F.split("marked", " ", -1)).alias("raw"))
    exploded = out.select("id", "unnamed", "row", F.explode(let(split, each)).alias("w")).select("id", "unnamed", "row", "w.place", "w.hash", "w.slots")
    return exploded.where(F.col("slots").isNull() | (F.size(F.split("slots", ",")) <= WINDOW - MIN_PLAIN) | (F.col("slots") == ""))


def _consistency(slots: Column) -> Column:
    """Distinct item values by distinct pairs of values, of (item_slots, slots) pairs; 1 without any."""
    mapped = F.array_distinct(F.flatten(F.transform(slots, lambda s: F.arrays_zip(F.split(s["item_slots"], ",").alias("item"), F.split(s["slots"], ",").alias("doc")))))
    return let(mapped, lambda m: F.when(F.size(m) > 0, F.size(F.array_distinct(F.transform(m, lambda x: x["item"]))) / F.size(m)).otherwise(1.0))


def _best_occurrence(found: Column, item_windows: Column) -> Column:
    """The best consistency of an occurrence around one of the cell's own offsets that has MIN_SHARE of the item's windows; null if none has."""

    def of(offset: Column) -> Column:
        away = lambda f: F.abs(f["offset"] - offset)
        near = F.filter(found, lambda f: away(f) <= item_windows)
        ranked = F.array_sort(F.transform(near, lambda f: F.struct(f["item_place"].alias("item_place"), away(f).alias("away"), f["item_slots"].alias("item_slots"), f["slots"].alias("slots"))))

        def first_of_each(r: Column) -> Column:
            return F.filter(r, lambda x, k: (k == 0) | (F.get(r, k - 1)["item_place"] != x["item_place"]))

        def judged_one(c: Column) -> Column:
            both = F.filter(c, lambda x: (x["slots"] != "") & (x["item_slots"] != ""))
            return F.when(F.size(c) / item_windows >= MIN_SHARE, _consistency(both))

        return let(let(ranked, first_of_each), judged_one)

    offsets = F.array_distinct(F.transform(F.filter(found, lambda f: f["own"]), lambda f: f["offset"]))
    places = F.size(F.array_distinct(F.transform(found, lambda f: f["item_place"])))
    return F.when(places / item_windows >= MIN_SHARE, F.array_max(F.transform(offsets, of)))


def matches(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, unnamed, item_id, share, consistency of each pair with a window in common.

    A document's windows are put into cells by their offset to the item's, as
    wide as the item is long, and each cell sees its two neighbours: so an
    occurrence is judged within a bounded group, however long the document.
    """
    items = windows(benchmark, item_column, item_text).drop("row", "unnamed").toDF("item_id", "item_place", "hash", "item_slots")
    items = items.withColumn("item_windows", F.count("*").over(_by("item_id")))
    found = windows(docs, id_column, text_column).select(F.col("id").alias("doc_id"), "unnamed", "row", "place", "hash", "slots")
    items = F.broadcast(items) if items.count() <= MAX_BROADCAST_WINDOWS else items
    hits = found.join(items, "hash").withColumn("offset", F.col("place") - F.col("item_place"))
    hits = hits.withColumn("own_cell", F.floor(F.col("offset") / F.col("item_windows")))
    near = hits.withColumn("cell", F.explode(F.array(F.col("own_cell") - 1, F.col("own_cell"), F.col("own_cell") + 1))).withColumn("own", F.col("cell") == F.col("own_cell"))
    slotted = F.col("own") & (F.col("slots") != "") & (F.col("item_slots") != "")
    cells = near.groupBy("doc_id", "unnamed", "item_id", "row", "cell").agg(
        F.max("item_windows").alias("item_windows"),
        F.collect_set(F.when(F.col("own"), F.col("item_place"))).alias("places"),
        F.collect_set(F.when(slotted, F.struct("item_slots", "slots"))).alias("slots"),
        F.collect_set(F.struct("offset", "item_place", "item_slots", "slots", "own")).alias("found"),
    )
    cells = cells.where(F.size("places") > 0).withColumn("alone", _best_occurrence(F.col("found"), F.col("item_windows")))
    whole = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    pairs = cells.groupBy("doc_id", "unnamed", "item_id").agg(F.size(whole("places")).alias("n"), F.max("item_windows").alias("item_windows"), whole("slots").alias("slots"), F.max("alone").alias("alone"))
    pairs = pairs.withColumns({"consistency": _consistency(F.col("slots")), "share": F.col("n") / F.col("item_windows")})
    return pairs.select("doc_id", "unnamed", "item_id", "share", F.greatest("consistency", "alone").alias("consistency"))


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)


def contaminated(found: DataFrame) -> DataFrame:
    """doc_id, unnamed, item_ids (ascending, comma-joined) of the documents that some item contaminates."""
    bad = found.where((F.col("share") >= MIN_SHARE) & (F.col("consistency") >= MIN_CONSISTENCY))
    return bad.groupBy("doc_id", "unnamed").agg(F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("item_ids"), F.max("share").alias("share"))


def _of_row(id_column: str, key: Column) -> Column:
    """Whether a row is the one that __bad_id and __bad_key name."""
    return F.col(id_column).eqNullSafe(F.col("__bad_id")) & key.eqNullSafe(F.col("__bad_key"))


def judged(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **columns: str) -> DataFrame:
    """doc_id, contaminated, item_ids, share: a row per row of docs."""
    bad = contaminated(matches(docs, benchmark, id_column=id_column, text_column=text_column, **columns)).withColumnsRenamed({"doc_id": "__bad_id", "unnamed": "__bad_key"})
    ids = docs.select(F.col(id_column).alias("id"), unnamed(id_column, text_column).alias("key"))
    return ids.join(bad, _of_row("id", F.col("key")), "left").select(F.col("id").alias("doc_id"), F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.lit("")).alias("item_ids"), F.round(F.coalesce("share", F.lit(0.0)), 6).alias("share"))


def clean(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **columns: str) -> DataFrame:
    """The documents that no item contaminates."""
    bad = contaminated(matches(docs, benchmark, id_column=id_column, text_column=text_column, **columns)).select(F.col("doc_id").alias("__bad_id"), F.col("unnamed").alias("__bad_key"))
    return docs.join(bad, _of_row(id_column, unnamed(id_column, text_column)), "left_anti")


def _sql_words(table: str, key: str) -> str:
    text = "coalesce(text, '')"
    for pattern, by in STEPS:
        text = f"regexp_replace({text}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    text = f"regexp_replace(lower({text}) || ' ', '{PLAIN}', ' ', 'g')"
    text = f"trim(regexp_replace({text}, '{UNIT_STEP[0]}', '{UNIT_STEP[1].replace('$', chr(92))}', 'g'), ' ')"
    canonical = f"regexp_replace(marked, '{CANONICAL[0]}', '{chr(92)}1', 'g')"
    return f"""
      SELECT id, place, array_to_string(ws[place + 1 : place + {WINDOW}], ' ') AS win, array_to_string(list_filter(raw[place + 1 : place + {WINDOW}], lambda w: w[1] IN ('{NAME}', '{NUMBER}', '{UNIT}')), ',') AS slots
      FROM (SELECT id, string_split({canonical}, ' ') AS ws, string_split(marked, ' ') AS raw, unnest(range(0, len(string_split(marked, ' ')) - {WINDOW - 1})) AS place FROM (SELECT {key} AS id, {text} AS marked FROM {table}))"""


ORACLE = f"""
WITH d AS (SELECT * FROM ({_sql_words("documents", "doc_id")}) WHERE slots = '' OR len(string_split(slots, ',')) <= {WINDOW - MIN_PLAIN}),
b AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM ({_sql_words("benchmark", "item_id")}) WHERE slots = '' OR len(string_split(slots, ',')) <= {WINDOW - MIN_PLAIN}),
m AS (SELECT d.id AS doc_id, b.id AS item_id, b.place AS place, b.n AS n, d.slots AS ds, b.slots AS bs FROM d JOIN b ON d.win = b.win),
s AS (SELECT doc_id, item_id, count(DISTINCT place) / max(n)::DOUBLE AS share FROM m GROUP BY ALL),
z AS (SELECT doc_id, item_id, string_split(bs, ',') AS bl, string_split(ds, ',') AS dl, unnest(range(1, len(string_split(bs, ',')) + 1)) AS k FROM m WHERE bs <> '' AND ds <> ''),
c AS (SELECT doc_id, item_id, count(DISTINCT bl[k]) / count(DISTINCT bl[k] || chr(1) || dl[k])::DOUBLE AS consistency FROM z GROUP BY ALL),
bad AS (SELECT doc_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids, max(share) AS share FROM s LEFT JOIN c USING (doc_id, item_id)
  WHERE share >= {MIN_SHARE} AND coalesce(consistency, 1) >= {MIN_CONSISTENCY} GROUP BY doc_id)
SELECT doc_id, item_ids IS NOT NULL AS contaminated, coalesce(item_ids, '') AS item_ids, round(coalesce(share, 0), 6) AS share FROM documents LEFT JOIN bad USING (doc_id)
"""

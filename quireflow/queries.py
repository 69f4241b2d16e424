"""Queries over the driver's tables, and the same in SQL for DuckDB.

Two views stand for an archive of scanned documents: px, a raster of small gray
pages from embeddings, and pages, a catalog of scanned pages from documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.operators import layout, outcomes, raster, verdicts
from quireflow.plans import archive, batch
from quireflow.settings import PRODUCER
from quireflow.sources import catalog


def px_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, y, x, g: 64 vectors a page."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    g = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v").cast("double") + 0.5) * 255).cast("int")))
    return v.select(F.floor(F.col("vec_id") / 64).cast("int").alias("page"), (F.col("vec_id") % 64).cast("int").alias("y"), F.col("x").cast("int").alias("x"), g.alias("g"))


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, file_bytes, producer, wpt, hpt, dpi, compact."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.col("n_chars") * 97).alias("file_bytes"))
    p = d.withColumn("page_no", F.explode(F.sequence(F.lit(1), (1 + F.col("doc_id") % 4).cast("int"))))
    k = F.col("doc_id") + F.col("page_no")
    dpi0 = F.get(F.array(*[F.lit(x) for x in (75, 150, 300, 600, 20)]), (k % 5).cast("int"))
    bits = F.get(F.array(*[F.lit(x) for x in (1, 4, 8, 8, 8, 8)]), (k % 6).cast("int"))
    wide = F.col("doc_id") % 3 == 0
    p = p.withColumns({"wpt": F.when(wide, 842.0).otherwise(595.0), "hpt": F.when(wide, 595.0).otherwise(842.0)})
    iw, ih = verdicts.rounded(F.col("wpt") / 72 * dpi0), verdicts.rounded(F.col("hpt") / 72 * dpi0)
    producer = F.when(F.col("doc_id") % 7 == 0, F.lit(f"{PRODUCER} 1.2")).otherwise("Test Scanner")
    return p.select("doc_id", "page_no", "file_bytes", producer.alias("producer"), "wpt", "hpt", verdicts.scan_dpi(F.col("wpt"), F.col("hpt"), iw, ih).alias("dpi"), verdicts.compact_image(bits).alias("compact"))


def batch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a finished run, from orders and lineitem: doc_id, verdict, input_bytes, built_bytes, encodings, error, included."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    files = items.groupBy("l_orderkey").agg(
        F.sum(F.floor("l_extendedprice").cast("long")).alias("input_bytes"), F.sum(F.floor(F.col("l_extendedprice") * (1 - 4 * F.col("l_discount"))).cast("long")).alias("built_bytes"),
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda s: F.when(s["l_returnflag"] == "N", "g4").when(s["l_returnflag"] == "A", "gray4").otherwise("jpeg")).alias("encodings"),
    )
    key = F.col("l_orderkey")
    verdict = F.when(key % 5 == 0, "bornDigital").otherwise("convert")
    failed = key % 11 == 0
    out = files.select(key.alias("doc_id"), verdict.alias("verdict"), "input_bytes", "built_bytes", "encodings", F.when(failed, F.lit("Cannot open PDF")).alias("error"), ((verdict == "convert") & (key % 13 != 0)).alias("included"))
    out = outcomes.outcomes(out)
    done = F.col("error").isNull() & F.col("included")
    return out.withColumns({c: F.when(done, F.col(c)) for c in ("tag", "copy_reason", "output_bytes")}).withColumn("estimated_bytes", F.floor(F.col("input_bytes") / 3).cast("long"))


def item_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, rel_path, seq: a listing with repeated sources and names."""
    d = spark.read.parquet(f"{sf_dir}/events.parquet")
    return d.select(F.concat(F.lit("/in/u"), (F.col("user_id") % 400).cast("string"), F.lit("/f"), (F.col("event_id") % 97).cast("string"), F.lit(".pdf")).alias("src"), F.concat(F.lit("Dir"), (F.col("user_id") % 9).cast("string"), F.lit("/f"), (F.col("event_id") % 97).cast("string"), F.lit(".pdf")).alias("rel_path"), F.col("event_id").alias("seq"))


def _inspect(spark, d):
    return verdicts.reports(page_table(spark, d))


def _verdict_summary(spark, d):
    r = _inspect(spark, d)
    return r.groupBy("verdict", verdicts.verdict_text(F.col("verdict"), F.lit(None).cast("string")).alias("label")).agg(F.count("*").alias("n_files"), F.sum("n_pages").alias("n_pages"), F.sum("file_bytes").alias("file_bytes"), F.sum("estimated_bytes").alias("estimated_bytes"))


def _otsu_binary(spark, d):
    return raster.threshold(px_table(spark, d))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _crops(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", (F.col("o_orderkey") % 50).cast("int").alias("x0"), (F.col("o_custkey") % 40).cast("int").alias("y0"), (F.col("o_orderkey") % 50 + 1000 + F.col("o_orderkey") % 1500).cast("int").alias("x1"), (F.col("o_custkey") % 40 + 1400 + F.col("o_custkey") % 2100).cast("int").alias("y1"), F.lit(2550).alias("img_w"), F.lit(3508).alias("img_h"), F.lit(300).alias("dpi"))


def _words(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    w = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("k", "text"))
    k = F.col("k").cast("double")
    return w.withColumns({"x": k / 40, "y": k / 25, "w": F.lit(0.05) + (F.col("doc_id") % 7) * 0.01, "h": F.lit(0.002) + (F.col("doc_id") % 5) * 0.004, "pt_w": F.lit(595.0), "pt_h": F.lit(842.0), "ox": F.lit(1.5), "oy": F.lit(2.5)})


def _ladder(spark, d):
    p = page_table(spark, d).where("dpi is not null or page_no > 1")
    p = p.withColumns({"is_text": (F.col("doc_id") + F.col("page_no")) % 3 != 0, "damage": (F.col("doc_id") % 100) / 150.0})
    return verdicts.ladder(p).groupBy("encoding", "out_dpi").agg(F.count("*").alias("n_pages"))


def _outcome_rows(spark, d):
    b = batch_table(spark, d)
    return b.select(
        "doc_id", "tag", "copy_reason", F.coalesce("output_bytes", F.lit(-1)).alias("output_bytes"), F.round(outcomes.saving_fraction(F.col("tag"), F.col("input_bytes"), F.col("output_bytes")), 6).alias("saving"),
        outcomes.outcome_label(F.col("tag"), F.when(F.col("included"), F.col("error"))).alias("label"), outcomes.outcome_help(F.col("tag"), F.col("copy_reason"), F.col("encodings"), F.when(F.col("included"), F.col("error"))).alias("help"),
        *[outcomes.encoding_count(F.col("encodings"), e).cast("long").alias(f"n_{e}") for e, _ in outcomes.ENCODINGS],
    )


def _catalog_unique(spark, d):
    return catalog.unique_names(catalog.first_by_source(item_table(spark, d))).select("src", "rel_path")


def _append(spark, d):
    rows = catalog.first_by_source(item_table(spark, d))
    return catalog.append_anti(rows, rows.where("seq % 3 = 0")).select("src", "rel_path")


def _sorted(spark, d):
    rows = catalog.first_by_source(item_table(spark, d)).select("rel_path").distinct()
    return catalog.natural_sort(rows).select("rel_path", catalog.natural_key(F.col("rel_path")).alias("key"))


def clashing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, rel_path, seq: names that repeat, and names that look as if they were numbered already."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id is not null")
    k = F.col("event_id")
    number = F.when(k % 3 == 0, F.concat(F.lit("-"), (2 + k % 5).cast("string"))).otherwise("")
    return e.select(F.concat(F.lit("/in/"), k.cast("string")).alias("src"), F.concat(F.lit("f"), (k % 211).cast("string"), number, F.lit(".pdf")).alias("rel_path"), k.alias("seq"))


def _collisions(spark, d):
    rows = item_table(spark, d).select("src", F.element_at(F.split("src", "/"), -1).alias("rel_path"), (F.col("seq") % 3 != 0).alias("included"))
    return catalog.output_collides(rows, "/in/u7/").select("src", "rel_path", "out_path")


def _page_images(spark, d):
    """A page for each order, with an image for each of its items."""
    filters = F.when(F.col("l_returnflag") == "N", F.array(F.lit("CCITTFaxDecode"))).when(F.col("l_returnflag") == "A", F.array(F.lit("FlateDecode"), F.lit("JBIG2Decode"))).otherwise(F.array(F.lit("DCTDecode")))
    image = F.struct((F.col("l_partkey") % 40).cast("int").alias("w"), (F.col("l_suppkey") % 7).cast("int").alias("h"), F.when(F.col("l_partkey") % 9 == 0, 4).otherwise(8).alias("bpc"), filters.alias("filters"))
    items = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", image.alias("image")).alias("i"))
    pages = items.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["image"]).alias("images"))
    best = verdicts.largest_image(pages, ["l_orderkey"])
    wide, high = verdicts.oriented_size(F.lit(595.0), F.lit(842.0), ((F.col("l_orderkey") % 7 - 3) * 90).cast("int"))
    return best.select("l_orderkey", F.coalesce("image.w", F.lit(0)).alias("w"), F.coalesce("image.h", F.lit(0)).alias("h"), F.coalesce(verdicts.compact_image(F.col("image.bpc"), F.col("image.filters")), F.lit(False)).alias("compact"), wide.alias("page_w"), high.alias("page_h"))


def _review_rows(spark, d):
    rows = _inspect(spark, d).withColumns({"rel_path": F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".pdf")), "error": F.when(F.col("doc_id") % 9 == 0, "Cannot open PDF")})
    chosen = rows.where("doc_id % 4 = 0").select("rel_path", (F.col("doc_id") % 8 == 0).alias("included"))
    return verdicts.with_included(rows, chosen)


def _toggled(spark, d):
    rows = verdicts.all_included(_review_rows(spark, d), True)
    return rows.select("doc_id", "included", verdicts.verdict_text(F.col("verdict"), F.col("error")).alias("label"), verdicts.verdict_text(F.col("verdict"), F.col("error"), 1).alias("help"))


def _page_boxes(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    sizes = {"pt_w": 300 + F.col("o_orderkey") % 400, "pt_h": 400 + F.col("o_custkey") % 500, "bed_x": F.col("o_orderkey") % 97, "bed_y": F.col("o_custkey") % 89}
    pages = o.select("o_orderkey", *[v.cast("double").alias(c) for c, v in sizes.items()], F.when(F.col("o_orderkey") % 3 != 0, 595.0).alias("page_w"), F.when(F.col("o_orderkey") % 3 != 0, 842.0).alias("page_h"))
    return layout.page_box(pages).select("o_orderkey", "box_w", "box_h", "ox", "oy")


def _texts(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey")
    cube = k.cast("decimal(19,0)") * k * k * 977  # beyond a long from key 211349 on, where the SQL ends with an overflow
    names = F.slice(F.array("c_name", "c_mktsegment", "c_name"), F.lit(1), (k % 4).cast("int"))
    return c.select(
        "c_custkey", outcomes.plural_text(k % 3, "1 file", "files").alias("plural"), outcomes.source_label(names).alias("source"), outcomes.byte_label(cube).alias("bytes"),
        outcomes.error_text(F.when(k % 2 == 0, "wouldOverwrite").otherwise("other"), F.col("c_name")).alias("error"), outcomes.preview_path(F.col("c_name"), F.when(k % 5 == 0, F.col("c_mktsegment"))).alias("preview"),
    )


def _joined_results(spark, d):
    """Results of four of five jobs, an eighth of them failed, joined to the batch's rows."""
    b = batch_table(spark, d).withColumn("rel_path", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".pdf")))
    failed = F.col("doc_id") % 8 == 0
    results = batch.jobs(b).where("doc_id % 5 != 1").select("rel_path", *[F.when(~failed, F.col(c)).alias(c) for c in ("tag", "copy_reason", "output_bytes")], F.when(failed, "No space left").alias("error"))
    return batch.with_results(b, results)


_PX = """px AS (SELECT floor(vec_id / 64)::INT AS page, (vec_id % 64)::INT AS y, (x - 1)::INT AS x, least(255, greatest(0, floor((embedding[x]::DOUBLE + 0.5) * 255)::INT)) AS g
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS x FROM embeddings)),
bins AS (SELECT page, g, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT page, unnest(range(256))::INT AS g FROM px) LEFT JOIN (SELECT page, g, count(*) AS n FROM px GROUP BY ALL) USING (page, g)),
cums AS (SELECT page, g AS t, sum(n) OVER a::BIGINT AS c, sum(n * g) OVER a::BIGINT AS s, sum(n) OVER (PARTITION BY page)::BIGINT AS tot, sum(n * g) OVER (PARTITION BY page)::BIGINT AS sm FROM bins WINDOW a AS (PARTITION BY page ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
split AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY c::DOUBLE * (tot - c)::DOUBLE * (m0 - m1) * (m0 - m1) DESC, t) AS k FROM (SELECT page, t, c, tot, s / c AS m0, (sm - s) / (tot - c) AS m1 FROM cums WHERE t >= 1 AND c > 0 AND c < tot)) WHERE k = 1 AND m0 <> m1),
otsu AS (SELECT page, coalesce(t, 128)::INT AS t FROM (SELECT DISTINCT page FROM px) LEFT JOIN split USING (page)),
bw AS (SELECT page, y, x, g, g < t AS ink FROM px JOIN otsu USING (page)),
size AS (SELECT page, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY page)"""
_PEAK = "peaks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY mass DESC, peak) AS k FROM (SELECT page, g AS peak, sum(n) OVER (PARTITION BY page ORDER BY g RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING)::BIGINT AS mass, sum(n) OVER (PARTITION BY page)::BIGINT AS total FROM bins)) WHERE k = 1)"
_SMOOTH = """grid AS (SELECT px.page, g, least(lag(g) OVER r, lead(g) OVER r, lag(g) OVER c, lead(g) OVER c) AS lo, greatest(lag(g) OVER r, lead(g) OVER r, lag(g) OVER c, lead(g) OVER c) AS hi, x, y, w, h FROM px JOIN size USING (page) WINDOW r AS (PARTITION BY px.page, y ORDER BY x), c AS (PARTITION BY px.page, x ORDER BY y)),
smooths AS (SELECT page, count(*)::BIGINT AS samples, count(*) FILTER (WHERE g BETWEEN 40 AND peak - 25 AND hi - lo < 12)::BIGINT AS smooth FROM grid JOIN peaks USING (page) WHERE x >= 1 AND y >= 1 AND x < w - 1 AND y < h - 1 GROUP BY page)"""
_SAUVOLA = """rows1 AS (SELECT page, y, x, g, sum(g) OVER a::BIGINT AS s, sum(g * g) OVER a::BIGINT AS q, count(*) OVER a AS c FROM px WINDOW a AS (PARTITION BY page, y ORDER BY x ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
rows2 AS (SELECT page, y, x, g, sum(s) OVER a::BIGINT AS s, sum(q) OVER a::BIGINT AS q, sum(c) OVER a::BIGINT AS c FROM rows1 WINDOW a AS (PARTITION BY page, x ORDER BY y ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
sv AS (SELECT page, y, x, g, g < (s / c) * (1 + 0.15::DOUBLE * (sqrt(greatest(0, q / c - (s / c) * (s / c))) / 128 - 1)) AS ink FROM rows2)"""
_DAMAGE = """blocks AS (SELECT page, y // 4 AS byy, x // 4 AS bxx, count(*) AS n, sum(g) AS gs, count(*) FILTER (WHERE ink) AS ni, min(g) AS lo, max(g) AS hi FROM sv JOIN size USING (page) WHERE y // 4 < h // 4 AND x // 4 < w // 4 GROUP BY ALL),
tiles AS (SELECT page, y // 32 AS ty, x // 32 AS tx, count(*) FILTER (WHERE ink) AS ink_n, coalesce(sum(g) FILTER (WHERE ink), 0) AS ink_s, count(*) FILTER (WHERE NOT ink) AS pap_n, coalesce(sum(g) FILTER (WHERE NOT ink), 0) AS pap_s FROM sv JOIN size USING (page) WHERE y < h // 4 * 4 AND x < w // 4 * 4 GROUP BY ALL),
lv AS (SELECT b.page, ty, tx, gs / n AS m, ni / n AS f, CASE WHEN ink_n > 50 THEN ink_s / ink_n ELSE m0 END AS ti, CASE WHEN pap_n > 50 THEN pap_s / pap_n ELSE m1 END AS tp, m1 - m0 AS k
  FROM blocks b JOIN tiles t ON b.page = t.page AND byy // 8 = ty AND bxx // 8 = tx JOIN split ON split.page = b.page WHERE m1 - m0 > 20 AND gs / n < m1 - 0.15 * (m1 - m0) AND hi - lo > 0.3 * (m1 - m0)),
worst AS (SELECT page, max(off) AS off FROM (SELECT page, ty, tx, avg(abs(f * ti + (1 - f) * tp - m) / greatest(tp - ti, 0.3 * k)) AS off, count(*) AS n FROM lv GROUP BY ALL) WHERE n >= 8 GROUP BY page)"""
_BYTES = "bytes AS (SELECT page, y, (x // 2)::INT AS b, sum(CASE WHEN x % 2 = 0 THEN 16 ELSE 1 END * floor(g / 17 + 0.5))::INT AS v FROM px GROUP BY ALL)"
_PAGES = f"""raw AS (SELECT doc_id, n_chars * 97 AS file_bytes, unnest(range(1, (2 + doc_id % 4)::INT)) AS page_no, CASE WHEN doc_id % 3 = 0 THEN 842.0::DOUBLE ELSE 595.0::DOUBLE END AS wpt, CASE WHEN doc_id % 3 = 0 THEN 595.0::DOUBLE ELSE 842.0::DOUBLE END AS hpt FROM documents),
img AS (SELECT *, floor(wpt / 72 * d0 + 0.5) AS iw, floor(hpt / 72 * d0 + 0.5) AS ih FROM (SELECT *, [75, 150, 300, 600, 20][((doc_id + page_no) % 5 + 1)::INT] AS d0, [1, 4, 8, 8, 8, 8][((doc_id + page_no) % 6 + 1)::INT] IN (1, 4) AS compact FROM raw)),
pg AS (SELECT doc_id, page_no, file_bytes, doc_id % 7 = 0 AS own, wpt, hpt, compact, CASE WHEN (abs(wpt / hpt - iw / ih) / (wpt / hpt) < 0.2 OR abs(wpt / hpt - ih / iw) / (wpt / hpt) < 0.2) AND iw / (wpt / 72) BETWEEN 40 AND 1300 AND abs(iw / (wpt / 72) - ih / (hpt / 72)) / (iw / (wpt / 72)) < 0.35 THEN floor(iw / (wpt / 72) + 0.5)::INT END AS dpi FROM img),
est AS (SELECT *, CASE WHEN dpi < 150 THEN greatest(8000, floor(wpt / 72 * dpi * (hpt / 72 * dpi) * 0.11::DOUBLE)::BIGINT) ELSE greatest(8000, floor(wpt / 72 * 300 * (hpt / 72 * 300) * 0.0023::DOUBLE)::BIGINT) END AS e FROM pg),
files AS (SELECT doc_id, max(file_bytes)::BIGINT AS file_bytes, bool_or(own) AS own, count(*) AS n_pages, count(dpi) AS scans, coalesce(bool_and(compact) FILTER (WHERE dpi IS NOT NULL), true) AS ac, sum(e)::BIGINT AS e FROM est GROUP BY doc_id),
rep AS (SELECT doc_id, file_bytes, n_pages, scans, verdict, CASE WHEN verdict = 'convert' THEN e ELSE file_bytes END AS estimated_bytes FROM (SELECT *, CASE WHEN own THEN 'alreadyProcessed' WHEN scans = 0 THEN 'bornDigital' WHEN ac THEN 'alreadyCompact' WHEN file_bytes // scans < 45000 THEN 'alreadySmall' ELSE 'convert' END AS verdict FROM files))"""
_BATCH = """f AS (SELECT l_orderkey AS doc_id, sum(floor(l_extendedprice))::BIGINT AS input_bytes, sum(floor(l_extendedprice * (1 - 4 * l_discount)))::BIGINT AS built_bytes, list(CASE l_returnflag WHEN 'N' THEN 'g4' WHEN 'A' THEN 'gray4' ELSE 'jpeg' END) AS enc FROM lineitem GROUP BY 1),
b0 AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'bornDigital' ELSE 'convert' END AS verdict, CASE WHEN doc_id % 11 = 0 THEN 'Cannot open PDF' END AS error, doc_id % 5 <> 0 AND doc_id % 13 <> 0 AS included FROM f),
b AS (SELECT *, CASE WHEN error IS NULL AND included THEN CASE WHEN good THEN 'converted' ELSE 'copied' END END AS tag, CASE WHEN error IS NULL AND included AND NOT good THEN 'insufficientSaving' END AS copy_reason,
  CASE WHEN error IS NULL AND included THEN CASE WHEN good THEN built_bytes ELSE input_bytes END END AS output_bytes, input_bytes // 3 AS estimated_bytes FROM (SELECT *, built_bytes::DOUBLE <= input_bytes::DOUBLE * 0.8::DOUBLE AS good FROM b0))"""
_ITEMS = "items AS (SELECT '/in/u' || (user_id % 400) || '/f' || (event_id % 97) || '.pdf' AS src, 'Dir' || (user_id % 9) || '/f' || (event_id % 97) || '.pdf' AS rel_path, event_id AS seq FROM events), firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY seq) AS k FROM items) WHERE k = 1)"
_KEY = "regexp_replace(regexp_replace(lower(rel_path), '([0-9]+)', '0000000000000000000\\1', 'g'), '0+([0-9]{20})([^0-9]|$)', '\\1\\2', 'g')"
_WORDS = "w AS (SELECT doc_id, (k - 1)::DOUBLE AS k, ws[k] AS text FROM (SELECT doc_id, string_split(text, ' ') AS ws, unnest(range(1, len(string_split(text, ' ')) + 1)) AS k FROM documents)), e AS (SELECT *, regexp_replace(regexp_replace(text, '[^\\x20-\\x7F]', ' ', 'g'), '([()\\\\])', '\\\\\\1', 'g') AS escaped, greatest(4.0::DOUBLE, (0.002::DOUBLE + (doc_id % 5) * 0.004::DOUBLE) * 842) AS size FROM w)"
_HELP = "array_to_string(list_filter([CASE WHEN a > 0 THEN '1-bit ×' || a END, CASE WHEN c > 0 THEN 'grayscale ×' || c END, CASE WHEN j > 0 THEN 'JPEG ×' || j END], lambda z: z IS NOT NULL), ' · ')"


def _papers(sizes: list, landscape: bool = True) -> str:
    return ", ".join(f"({2 * k + t}, '{n}{' landscape' * t}', {(h if t else w)}::DOUBLE, {(w if t else h)}::DOUBLE)" for k, (n, w, h) in enumerate(sizes) for t in (0, 1))


_CROPS = "crops AS (SELECT o_orderkey, (o_orderkey % 50)::INT AS x0, (o_custkey % 40)::INT AS y0, (o_orderkey % 50 + 1000 + o_orderkey % 1500)::INT AS x1, (o_custkey % 40 + 1400 + o_custkey % 2100)::INT AS y1 FROM orders)"

_CLASHING = """named AS (SELECT '/in/' || event_id AS src, 'f' || (event_id % 211) || CASE WHEN event_id % 3 = 0 THEN '-' || (2 + event_id % 5) ELSE '' END || '.pdf' AS rel_path,
  'f' || (event_id % 211) || CASE WHEN event_id % 3 = 0 THEN '-' || (2 + event_id % 5) ELSE '' END AS base, event_id % 211 AS stem, event_id AS seq FROM events WHERE event_id IS NOT NULL)"""
_REVIEW = """SELECT *, CASE WHEN error IS NULL AND doc_id % 4 = 0 THEN doc_id % 8 = 0 ELSE verdict = 'convert' AND error IS NULL END AS included
  FROM (SELECT *, CASE WHEN doc_id % 9 = 0 THEN 'Cannot open PDF' END AS error FROM rep)"""
_JOINED = """SELECT doc_id, included, CASE WHEN took AND doc_id % 8 <> 0 THEN tag END AS tag, CASE WHEN took AND doc_id % 8 <> 0 THEN copy_reason END AS copy_reason, CASE WHEN took AND doc_id % 8 <> 0 THEN output_bytes END AS output_bytes,
  CASE WHEN took AND doc_id % 8 = 0 THEN 'No space left' ELSE error END AS error FROM (SELECT *, included AND doc_id % 5 <> 1 AS took FROM b)"""


def _bytes(n: str) -> str:
    """Bytes in decimal units, rounded half up."""
    mega, giga = f"(({n} + 50000) // 100000)::BIGINT", f"(({n} + 5000000) // 10000000)::BIGINT"
    return f"CASE WHEN {n} < 1000 THEN {n} || ' bytes' WHEN {n} < 1000000 THEN (({n} + 500) // 1000)::BIGINT || ' KB' WHEN {n} < 1000000000 THEN {mega} // 10 || '.' || {mega} % 10 || ' MB' ELSE {giga} // 100 || '.' || lpad(({giga} % 100)::VARCHAR, 2, '0') || ' GB' END"


def _cases(which: int) -> str:
    return " ".join(f"WHEN '{k}' THEN '{v[which]}'" for k, v in verdicts.VERDICT_TEXTS.items())


#: name: (Spark, SQL or None)
_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "inspect_verdict": (_inspect, f"WITH {_PAGES} SELECT * FROM rep"),
    "verdict_summary": (_verdict_summary, f"WITH {_PAGES} SELECT verdict, CASE verdict {' '.join(f'WHEN {k!r} THEN {v[0]!r}' for k, v in verdicts.VERDICT_TEXTS.items())} END AS label, count(*) AS n_files, sum(n_pages)::BIGINT AS n_pages, sum(file_bytes)::BIGINT AS file_bytes, sum(estimated_bytes)::BIGINT AS estimated_bytes FROM rep GROUP BY verdict"),
    "page_kinds": (lambda s, d: page_table(s, d).select("doc_id", "page_no", F.coalesce("dpi", F.lit(0)).alias("dpi"), "compact", verdicts.page_estimate(F.col("wpt"), F.col("hpt"), F.col("dpi")).alias("estimate")), f"WITH {_PAGES} SELECT doc_id, page_no::INT AS page_no, coalesce(dpi, 0)::INT AS dpi, compact, e AS estimate FROM est"),
    "encoding_ladder": (_ladder, f"WITH {_PAGES}, l AS (SELECT *, (doc_id + page_no) % 3 <> 0 AS is_text, (doc_id % 100) / 150.0::DOUBLE AS damage, coalesce(dpi, 300) AS nat FROM pg WHERE dpi IS NOT NULL OR page_no > 1), z AS (SELECT CASE WHEN is_text AND nat >= 150 AND damage <= 0.4::DOUBLE THEN 'g4' WHEN is_text THEN 'gray4' ELSE 'jpeg' END AS encoding, greatest(72, least(nat, 150)) AS gd FROM l) SELECT encoding, (CASE WHEN encoding = 'g4' THEN 300 ELSE gd END)::INT AS out_dpi, count(*) AS n_pages FROM z GROUP BY ALL"),
    "page_histogram": (lambda s, d: raster.histogram(px_table(s, d)), f"WITH {_PX} SELECT page, g, count(*) AS n FROM px GROUP BY ALL"),
    "otsu_threshold": (lambda s, d: raster.otsu(px_table(s, d)), f"WITH {_PX} SELECT page, t FROM otsu"),
    "class_means": (lambda s, d: _rounded(raster.class_means(px_table(s, d)), "ink", "paper"), f"WITH {_PX} SELECT page, round(m0, 6) AS ink, round(m1, 6) AS paper FROM split"),
    "paper_peak": (lambda s, d: raster.paper_peak(px_table(s, d)), f"WITH {_PX}, {_PEAK} SELECT page, peak, mass, total FROM peaks"),
    "smooth_midtone": (lambda s, d: raster.smooth_midtone(px_table(s, d)), f"WITH {_PX}, {_PEAK}, {_SMOOTH} SELECT * FROM smooths"),
    "page_classify": (lambda s, d: raster.classify(px_table(s, d)), f"WITH {_PX}, {_PEAK}, {_SMOOTH} SELECT page, CASE WHEN peak < 128 OR mass / total < 0.6 THEN 'photo' WHEN peak - 25 <= 40 OR coalesce(samples, 0) = 0 OR smooth / samples <= 0.08 THEN 'text' ELSE 'photo' END AS kind FROM peaks LEFT JOIN smooths USING (page)"),
    "threshold_ink": (lambda s, d: _otsu_binary(s, d).groupBy("page").agg(F.count_if("ink").alias("n_ink")), f"WITH {_PX} SELECT page, count(*) FILTER (WHERE ink) AS n_ink FROM bw GROUP BY page"),
    "sauvola_ink": (lambda s, d: raster.sauvola(px_table(s, d)), f"WITH {_PX}, {_SAUVOLA} SELECT * FROM sv"),
    "block_stats": (lambda s, d: raster.block_stats(_otsu_binary(s, d)), f'WITH {_PX} SELECT page, (y // 4)::BIGINT AS "by", (x // 4)::BIGINT AS bx, count(*) AS n, sum(g)::BIGINT AS g_sum, count(*) FILTER (WHERE ink) AS n_ink, min(g) AS g_min, max(g) AS g_max FROM bw JOIN size USING (page) WHERE y // 4 < h // 4 AND x // 4 < w // 4 GROUP BY ALL'),
    "tile_levels": (lambda s, d: raster.tile_levels(raster.sauvola(px_table(s, d)), 4, 8), f"WITH {_PX}, {_SAUVOLA} SELECT page, (y // 32)::BIGINT AS ty, (x // 32)::BIGINT AS tx, count(*) FILTER (WHERE ink) AS ink_n, coalesce(sum(g) FILTER (WHERE ink), 0)::BIGINT AS ink_sum, count(*) FILTER (WHERE NOT ink) AS pap_n, coalesce(sum(g) FILTER (WHERE NOT ink), 0)::BIGINT AS pap_sum FROM sv JOIN size USING (page) WHERE y < h // 4 * 4 AND x < w // 4 * 4 GROUP BY ALL"),
    "damage_score": (lambda s, d: _rounded(raster.damage(raster.sauvola(px_table(s, d)), 4, 8, 8), "damage"), f"WITH {_PX}, {_SAUVOLA}, {_DAMAGE} SELECT page, round(coalesce(off, 0), 6) AS damage FROM (SELECT DISTINCT page FROM px) LEFT JOIN worst USING (page)"),
    "gray4_levels": (lambda s, d: raster.gray4_levels(px_table(s, d)).groupBy("page", "level").agg(F.count("*").alias("n")), f"WITH {_PX} SELECT page, floor(g / 17 + 0.5)::INT AS level, count(*) AS n FROM px GROUP BY ALL"),
    "up_filter": (lambda s, d: raster.up_filter(px_table(s, d)), f"WITH {_PX}, {_BYTES} SELECT page, y, b, ((v - coalesce(lag(v) OVER (PARTITION BY page, b ORDER BY y), 0) + 256) % 256)::INT AS up FROM bytes"),
    "mass_trim": (lambda s, d: raster.mass_trim(_otsu_binary(s, d), "y"), f"WITH {_PX}, m AS (SELECT page, y, count(*) AS m FROM bw WHERE ink GROUP BY ALL), c AS (SELECT page, y, sum(m) OVER (PARTITION BY page ORDER BY y) AS a, sum(m) OVER (PARTITION BY page ORDER BY y DESC) AS z, sum(m) OVER (PARTITION BY page) * 3 // 1000 AS t FROM m) SELECT page, min(y) AS lo, max(y) AS hi, min(y) FILTER (WHERE a > t) AS trim_lo, max(y) FILTER (WHERE z > t) AS trim_hi FROM c GROUP BY page"),
    "despeckle": (archive.despeckle_query, f"WITH RECURSIVE {_PX}, ink AS (SELECT page, y, x FROM px WHERE g < 64), reach AS (SELECT page, y, x, y AS y2, x AS x2 FROM ink UNION SELECT r.page, r.y, r.x, i.y, i.x FROM reach r JOIN ink i ON i.page = r.page AND abs(i.y - r.y2) <= 1 AND abs(i.x - r.x2) <= 1), comp AS (SELECT page, y, x, count(*) AS size FROM reach GROUP BY ALL) SELECT page, count(*) FILTER (WHERE size >= 4) AS kept, count(*) FILTER (WHERE size < 4) AS removed FROM comp GROUP BY page"),
    "edge_flood": (archive.edge_flood_query, f"WITH RECURSIVE {_PX}, dark AS (SELECT px.page, y, x, w, h FROM px JOIN size USING (page) WHERE g < 110), flood AS (SELECT page, y, x FROM dark WHERE y = 0 OR x = 0 OR y = h - 1 OR x = w - 1 UNION SELECT d.page, d.y, d.x FROM flood f JOIN dark d ON d.page = f.page AND abs(d.y - f.y) + abs(d.x - f.x) = 1) SELECT page, count(*) AS reached, max(least(least(x, w - 1 - x), least(y, h - 1 - y))) AS depth FROM flood JOIN size USING (page) GROUP BY page"),
    "catalog_dedupe": (lambda s, d: catalog.first_by_source(item_table(s, d)), f"WITH {_ITEMS} SELECT src, rel_path, seq FROM firsts"),
    "catalog_numbered": (lambda s, d: catalog.numbered(catalog.first_by_source(item_table(s, d))).select("src", "rel_path"), f"WITH {_ITEMS} SELECT src, CASE WHEN n = 1 THEN rel_path ELSE rtrim(rel_path, '.pdf') || '-' || n || '.pdf' END AS rel_path FROM (SELECT src, rel_path, row_number() OVER (PARTITION BY rel_path ORDER BY seq) AS n FROM firsts)"),
    "catalog_unique_names": (_catalog_unique, f"WITH {_ITEMS} SELECT src, CASE WHEN n = 1 THEN rel_path ELSE rtrim(rel_path, '.pdf') || '-' || n || '.pdf' END AS rel_path FROM (SELECT src, rel_path, row_number() OVER (PARTITION BY rel_path ORDER BY seq) AS n FROM firsts)"),
    "catalog_append": (_append, f"WITH {_ITEMS} SELECT src, rel_path FROM firsts WHERE src NOT IN (SELECT src FROM firsts WHERE seq % 3 = 0)"),
    "catalog_natural_sort": (_sorted, f"WITH {_ITEMS} SELECT DISTINCT rel_path, {_KEY} AS key FROM firsts"),
    "outcomes": (_outcome_rows, f"WITH {_BATCH}, n AS (SELECT *, len(list_filter(enc, lambda z: z = 'g4')) AS a, len(list_filter(enc, lambda z: z = 'gray4')) AS c, len(list_filter(enc, lambda z: z = 'jpeg')) AS j FROM b) SELECT doc_id, tag, copy_reason, coalesce(output_bytes, -1)::BIGINT AS output_bytes, round(CASE WHEN tag = 'converted' AND input_bytes > 0 THEN 1 - output_bytes::DOUBLE / input_bytes END, 6) AS saving, CASE WHEN included AND error IS NOT NULL THEN 'Failed' WHEN tag = 'converted' THEN 'Converted' WHEN tag = 'copied' THEN 'Copied' ELSE '—' END AS label, CASE WHEN included AND error IS NOT NULL THEN error WHEN tag = 'converted' THEN 'Pages: ' || {_HELP} WHEN tag = 'copied' THEN '{outcomes.INSUFFICIENT}' ELSE '' END AS help, a::BIGINT AS n_g4, c::BIGINT AS n_gray4, j::BIGINT AS n_jpeg FROM n"),
    "batch_totals": (lambda s, d: outcomes.totals(batch_table(s, d)), f"WITH {_BATCH}, t AS (SELECT coalesce(sum(input_bytes) FILTER (WHERE included), 0)::BIGINT AS total_input, coalesce(sum(estimated_bytes) FILTER (WHERE included), 0)::BIGINT AS total_estimate, coalesce(sum(output_bytes) FILTER (WHERE tag IS NOT NULL), 0)::BIGINT AS total_output, coalesce(sum(input_bytes) FILTER (WHERE tag IS NOT NULL), 0)::BIGINT AS ri, count(*) FILTER (WHERE tag = 'converted') AS n_converted, count(*) FILTER (WHERE error IS NOT NULL AND tag IS NULL) AS n_failed FROM b) SELECT * EXCLUDE (ri), CASE WHEN total_input > total_output THEN total_input - total_output END AS saved_bytes, CASE WHEN ri > total_output THEN ri - total_output END AS saved_bytes_of_results FROM t"),
    "review_filter": (lambda s, d: outcomes.participated(batch_table(s, d)).select("doc_id", verdicts.included_by_default(F.col("verdict"), F.col("error")).alias("default_included")), f"WITH {_BATCH} SELECT doc_id, verdict = 'convert' AND error IS NULL AS default_included FROM b WHERE included"),
    "paper_snap": (lambda s, d: layout.paper_snap(_crops(s, d)).select("o_orderkey", "name", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("s_x0", "s_y0", "s_x1", "s_y1")]), f"WITH {_CROPS}, p(pref, name, pw, ph) AS (VALUES {_papers(layout.PAPERS[:4])}), m AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY pref) AS k FROM (SELECT *, (x1 - x0) / (300 / 25.4::DOUBLE) AS wm, (y1 - y0) / (300 / 25.4::DOUBLE) AS hm FROM crops) JOIN p ON wm <= pw AND pw <= wm + 25 AND hm <= ph AND ph <= hm + 25), s AS (SELECT o_orderkey, name, floor(pw * (300 / 25.4::DOUBLE))::INT AS tw, floor(ph * (300 / 25.4::DOUBLE))::INT AS th, x0, y0 FROM m WHERE k = 1), q AS (SELECT *, least(x0, greatest(0, 2550 - tw)) AS s_x0, least(y0, greatest(0, 3508 - th)) AS s_y0 FROM s) SELECT c.o_orderkey, name, coalesce(s_x0, -1)::INT AS s_x0, coalesce(s_y0, -1)::INT AS s_y0, (CASE WHEN name IS NULL THEN -1 ELSE least(2550, s_x0 + tw) END)::INT AS s_x1, (CASE WHEN name IS NULL THEN -1 ELSE least(3508, s_y0 + th) END)::INT AS s_y1 FROM crops c LEFT JOIN q USING (o_orderkey)"),
    "paper_name": (lambda s, d: layout.paper_name(s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (100 + F.col("o_orderkey") % 130).cast("double").alias("width_mm"), (140 + F.col("o_custkey") % 160).cast("double").alias("height_mm"))).select("o_orderkey", "name"), f"WITH p(pref, name, pw, ph) AS (VALUES {_papers(layout.PAPERS)}), o AS (SELECT o_orderkey, (100 + o_orderkey % 130)::DOUBLE AS w, (140 + o_custkey % 160)::DOUBLE AS h FROM orders), m AS (SELECT o_orderkey, name, row_number() OVER (PARTITION BY o_orderkey ORDER BY pref) AS k FROM o JOIN p ON abs(w - pw) <= 3 AND abs(h - ph) <= 3) SELECT o_orderkey, m.name FROM o LEFT JOIN (SELECT * FROM m WHERE k = 1) m USING (o_orderkey)"),
    "pdf_escape": (lambda s, d: _words(s, d).select("doc_id", "k", layout.pdf_escape(F.col("text")).alias("escaped")), f"WITH {_WORDS} SELECT doc_id, k::INT AS k, escaped FROM e"),
    "word_layout": (lambda s, d: _rounded(layout.word_layout(_words(s, d)), "px", "py", "size", "tz").select("doc_id", "k", "px", "py", "size", "tz"), f"WITH {_WORDS} SELECT doc_id, k::INT AS k, round(1.5 + k / 40 * 595, 6) AS px, round(2.5 + k / 25 * 842, 6) AS py, round(size, 6) AS size, round(least(500, greatest(20, CASE WHEN length(escaped) * size * 0.5 > 0 THEN (0.05::DOUBLE + (doc_id % 7) * 0.01::DOUBLE) * 595 / (length(escaped) * size * 0.5::DOUBLE) * 100 ELSE 100 END)), 6) AS tz FROM e WHERE escaped <> ''"),
    "catalog_clashing_names": (
        lambda s, d: catalog.unique_names(clashing_table(s, d)).select("src", "rel_path"),
        f"""WITH RECURSIVE {_CLASHING},
ranked AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY seq) AS i FROM named),
step AS (SELECT stem, 0::BIGINT AS i, []::VARCHAR[] AS seen, NULL::VARCHAR AS src, NULL::VARCHAR AS name FROM (SELECT DISTINCT stem FROM ranked)
  UNION ALL SELECT stem, i, list_append(seen, name), src, name FROM (SELECT s.stem, r.i, s.seen, r.src, list_filter(list_concat([r.rel_path], list_transform(range(2, r.i + 2), lambda n: r.base || '-' || n || '.pdf')), lambda z: NOT list_contains(s.seen, z))[1] AS name FROM step s JOIN ranked r ON r.stem = s.stem AND r.i = s.i + 1))
SELECT src, name AS rel_path FROM step WHERE i > 0""",
    ),
    "output_collisions": (
        _collisions,
        """WITH i AS (SELECT '/in/u' || (user_id % 400) || '/f' || (event_id % 97) || '.pdf' AS src, 'f' || (event_id % 97) || '.pdf' AS rel_path, event_id % 3 <> 0 AS included FROM events)
SELECT src, rel_path, '/in/u7/' || rel_path AS out_path FROM i WHERE included AND '/in/u7/' || rel_path IN (SELECT src FROM i)""",
    ),
    "page_images": (
        _page_images,
        """WITH i AS (SELECT l_orderkey, (l_partkey % 40)::INT AS w, (l_suppkey % 7)::INT AS h, l_partkey % 9 = 0 OR l_returnflag IN ('N', 'A') AS compact,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_partkey % 40) * (l_suppkey % 7) DESC, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS k FROM lineitem)
SELECT l_orderkey, CASE WHEN w * h > 0 THEN w ELSE 0 END AS w, CASE WHEN w * h > 0 THEN h ELSE 0 END AS h, w * h > 0 AND compact AS compact,
  CASE WHEN (l_orderkey % 7 - 3) % 2 <> 0 THEN 842.0::DOUBLE ELSE 595.0::DOUBLE END AS page_w, CASE WHEN (l_orderkey % 7 - 3) % 2 <> 0 THEN 595.0::DOUBLE ELSE 842.0::DOUBLE END AS page_h FROM i WHERE k = 1""",
    ),
    "review_table": (
        lambda s, d: outcomes.review_table(_review_rows(s, d)),
        f"""WITH {_PAGES}, rows AS ({_REVIEW}) SELECT included, 'f' || doc_id || '.pdf' AS rel_path, n_pages, {_bytes("file_bytes")} AS size, verdict, CASE WHEN verdict = 'convert' THEN {_bytes("estimated_bytes")} ELSE 'unchanged' END AS estimated FROM rows""",
    ),
    "review_toggled": (
        _toggled,
        f"""WITH {_PAGES}, rows AS ({_REVIEW}) SELECT doc_id, error IS NULL AND true OR error IS NOT NULL AND included AS included,
  CASE WHEN error IS NOT NULL THEN 'Unreadable' ELSE CASE verdict {_cases(0)} END END AS label, CASE WHEN error IS NOT NULL THEN error ELSE CASE verdict {_cases(1)} END END AS help FROM rows""",
    ),
    "results_table": (
        lambda s, d: outcomes.results_table(batch_table(s, d).withColumn("rel_path", F.concat(F.lit("f"), F.col("doc_id").cast("string")))),
        f"""WITH {_BATCH} SELECT 'f' || doc_id AS rel_path, input_bytes, output_bytes, CASE WHEN tag = 'converted' AND input_bytes > 0 THEN floor(100 * (1 - output_bytes::DOUBLE / input_bytes) + 0.5)::BIGINT || '%' ELSE '–' END AS saved,
  CASE WHEN error IS NOT NULL AND tag IS NULL THEN 'Failed' WHEN tag = 'converted' THEN 'Converted' WHEN tag = 'copied' THEN 'Copied' ELSE '—' END AS outcome FROM b WHERE included""",
    ),
    "page_box": (
        _page_boxes,
        """WITH p AS (SELECT o_orderkey, (300 + o_orderkey % 400)::DOUBLE AS w, (400 + o_custkey % 500)::DOUBLE AS h, (o_orderkey % 97)::DOUBLE AS bx, (o_custkey % 89)::DOUBLE AS by_, o_orderkey % 3 <> 0 AS known FROM orders),
b AS (SELECT *, CASE WHEN known THEN greatest(595.0::DOUBLE, w) ELSE w END AS box_w, CASE WHEN known THEN greatest(842.0::DOUBLE, h) ELSE h END AS box_h FROM p)
SELECT o_orderkey, box_w, box_h, least(bx, box_w - w) AS ox, box_h - h - least(by_, box_h - h) AS oy FROM b""",
    ),
    "interface_texts": (
        _texts,
        f"""SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN '1 file' ELSE c_custkey % 3 || ' files' END AS plural, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN c_name ELSE c_custkey % 4 || ' sources' END AS source,
  {_bytes("c_custkey * c_custkey * c_custkey * 977")} AS bytes, CASE WHEN c_custkey % 2 = 0 THEN 'Output would overwrite the source: ' || c_name ELSE c_name END AS error, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE c_name END AS preview FROM customer""",
    ),
    "batch_results": (
        lambda s, d: _joined_results(s, d).select("doc_id", "tag", "copy_reason", F.coalesce("output_bytes", F.lit(-1)).alias("output_bytes"), "error"),
        f"WITH {_BATCH}, j AS ({_JOINED}) SELECT doc_id, tag, copy_reason, coalesce(output_bytes, -1)::BIGINT AS output_bytes, error FROM j",
    ),
    "batch_failures": (
        lambda s, d: batch.failure_text(_joined_results(s, d)),
        f"WITH {_BATCH}, j AS ({_JOINED}), n AS (SELECT count(*) FILTER (WHERE included AND error IS NOT NULL AND tag IS NULL) AS n_failed FROM j) SELECT n_failed, CASE WHEN n_failed = 1 THEN '1 file failed' WHEN n_failed > 0 THEN n_failed || ' files failed' END AS text FROM n",
    ),
    "kernel_pages": (archive.kernel_query, None),
    "convert_archive": (archive.convert_query, None),
}

QUERIES = {name: spark for name, (spark, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}

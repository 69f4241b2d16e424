"""Personal data by candidate gradient boosting, in built-in expressions.

1. Base rules find e-mail addresses, IP addresses, card numbers (Luhn) and
   phone numbers; their spans always stay.
2. High-recall generators propose overlapping candidates: anything with an @,
   grouped numbers, long tokens, assigned secrets.
3. A candidate's format and context (digits, separators, length, neighbours, a
   keyword before it) give a small vector of integers. One aggregation over all
   documents counts the vectors and how often each is a sure case. An address or
   number is one where a valid base match lies in it; a secret where its letters
   and digits alternate as those of a random string do (RUNS runs of digits),
   which no feature says, or where it has a known key's prefix. A vector takes
   few values, so that the table's size has a bound (MAX_VECTORS), whatever the
   corpus.
4. Boosted trees of depth two are fitted to that table; a score threshold is
   calibrated for each generator on documents held out by a hash of their id:
   the least score above which the wanted share of candidates is sure. Where
   fewer than MIN_HELD_OUT of its candidates are held out (small tables), all
   its candidates calibrate it; a generator without a sure case adds nothing.
   The trees become CASE expressions.
5. Candidates over their threshold that no base span overlaps are added.

Offsets are code points, ends exclusive. Null texts count as empty; repeated
rows are judged each; empty tables give no rows; extra columns stay.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm.shared import let

#: Kinds in the order of the result; those after the fourth are the method's.
KINDS = ["email", "ip", "card", "phone", "address", "number", "secret"]
#: Stands for a separator between digits, so that the pattern of card numbers is one class (no recursion in the engine).
JOIN = "\ue000"
#: After a match or not inside a run, so that a long run is tried once.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = rf"[0-9][0-9{JOIN}]++"
_PHONE = r"\+[0-9][ ().0-9\-]+[0-9]"
#: Generators: kind of the result, pattern.
GENERATORS = {
    "at_sign": ("address", r"(?<![^\s@])[^\s@]++@[^\s@]++"),
    "digits": ("number", r"(?=[+(]?[0-9](?:[ ().\-]{0,3}[0-9]){6})[+(]?[0-9]++(?:[ ().\-]{1,3}[0-9]++){0,8}"),
    "token": ("secret", r"(?<![A-Za-z0-9_\-])(?=[A-Za-z_\-]*[0-9])(?=[0-9_\-]*[A-Za-z])[A-Za-z0-9_\-]{16,}+"),
    "assigned": ("secret", r"(?i)(?:password|passwd|secret|token|api[_ \-]?key)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{6,}+[\"']?"),
}
CONTEXTS = [r"mail|contact|write to|tel|phone|call|fax|mobile", r"card|visa|credit|account|iban|payment", r"password|secret|token|key|login", r"\bip\b|host|server|address", r"version|licen[sc]e|\bcc\b|section|chapter|page|\bv\.?\s*$"]
FEATURES = ["generator", "digits", "marks", "context", "length", "mixed", "around"]
#: Values that each feature takes: their product bounds the table of vectors.
SIZES = [len(GENERATORS), 6, 5, len(CONTEXTS) + 1, 5, 3, 3]
MAX_VECTORS = int(np.prod(SIZES))
#: Share of sure cases among held-out candidates above a threshold.
PRECISION = 0.95
MIN_HELD_OUT = 30
#: Runs of digits from which a string counts as random.
RUNS = 4
ROUNDS, RATE, LEAVES_PRIOR = 40, 0.3, 2.0


def _located(text: Column, pattern: str, guard: Column) -> Column:
    """Array of (start, end, value, left, right) of the pattern's matches: the gaps between matches give their places."""
    nothing = F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("value"), F.lit("").alias("left"), F.lit("").alias("right"))), lambda x: F.lit(False))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["v"])
        found = F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value"), F.right(x["gap"], F.lit(24)).alias("left"), x["right"].alias("right"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(found)).alias("found"))

    def located(both: Column) -> Column:
        items = F.transform(both["values"], lambda v, i: F.struct(v.alias("v"), F.get(both["gaps"], i).alias("gap"), F.substring(F.get(both["gaps"], i + 1), 1, 1).alias("right")))
        return F.aggregate(items, F.struct(F.lit(0).alias("at"), nothing.alias("found")), step, lambda s: s["found"])

    with_gaps = lambda values: let(F.struct(values.alias("values"), F.split(text, pattern, -1).alias("gaps")), located)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.coalesce(F.when(guard, let(values, lambda v: F.when(F.size(v) > 0, with_gaps(v)))), nothing)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    reversed_ = F.split(F.reverse(digits), "")
    each = F.transform(reversed_, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))


def with_base(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Adds __text, __base (array of kind number, start, end) and __cands (array of candidates)."""
    out = docs.withColumn("__text", F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    out = out.withColumns({"__digit": F.col("__text").rlike("[0-9]"), "__at": F.instr("__text", "@") > 0})
    out = out.withColumn("__joined", F.when(F.col("__digit"), F.regexp_replace(F.replace("__text", F.lit(JOIN), F.lit("x")), "(?<=[0-9])[ \\-](?=[0-9])", JOIN)))
    text = F.col("__text")
    out = out.withColumns(
        {
            "__email": _located(text, _EMAIL, F.col("__at")),
            "__ip": F.filter(_located(text, _IP, F.col("__digit")), lambda s: _octets(s["value"])),
            "__card": F.filter(_located(F.col("__joined"), _CARD, F.col("__digit")), lambda s: F.length(_digits(s["value"])).between(13, 19) & _luhn(_digits(s["value"]))),
            "__phone": F.filter(_located(text, _PHONE, F.col("__digit") & (F.instr("__text", "+") > 0)), lambda s: F.length(_digits(s["value"])).between(9, 15)),
            **{f"__{g}": _located(text, p, F.col("__at") if g == "at_sign" else F.col("__digit") if g != "assigned" else F.col("__text").rlike("[=:]")) for g, (_, p) in GENERATORS.items()},
        }
    )

    def numbered(column: str, n: int, name: str, fields: tuple[str, ...]) -> Column:
        return F.transform(column, lambda s: F.struct(F.lit(n).alias(name), *[s[c].alias(c) for c in fields]))

    base = F.concat(*[numbered(f"__{k}", n, "kind", ("start", "end")) for n, k in enumerate(KINDS[:4])])
    cands = F.concat(*[numbered(f"__{g}", n, "generator", ("start", "end", "value", "left", "right")) for n, g in enumerate(GENERATORS)])
    return out.withColumns({"__base": base, "__cands": cands}).drop("__digit", "__at", "__joined", "__email", "__ip", "__card", "__phone", *[f"__{g}" for g in GENERATORS])


def _vector(c: Column) -> list[Column]:
    """A candidate's features, as in FEATURES."""
    n = F.length(_digits(c["value"]))
    left = F.lower(c["left"])
    context = reduce(lambda e, k: e.when(left.rlike(CONTEXTS[k]) | ((c["generator"] == 3) & F.lower(c["value"]).rlike(CONTEXTS[k])), k + 1), range(1, len(CONTEXTS)), F.when(left.rlike(CONTEXTS[0]), 1)).otherwise(0)
    return [
        c["generator"],
        F.when((n == 0) | (c["generator"] >= 2), 0).when(n <= 6, 1).when(n <= 8, 2).when(n <= 12, 3).when(n <= 19, 4).otherwise(5),
        F.when(F.substring(c["value"], 1, 1) == "+", 1).when(c["value"].rlike(r"[0-9]\.[0-9]+\.[0-9]"), 2).when(c["value"].rlike(r"[0-9][ ().\-]+[0-9]"), 3).when(c["value"].rlike(r"@[A-Za-z0-9\-]+\.[A-Za-z]"), 4).otherwise(0),
        context,
        F.when(F.length(c["value"]) < 8, 0).when(F.length(c["value"]) < 14, 1).when(F.length(c["value"]) < 20, 2).when(F.length(c["value"]) < 36, 3).otherwise(4),
        F.when(c["value"].rlike("[A-Za-z]"), F.when(c["value"].rlike("[0-9]"), 2).otherwise(1)).otherwise(0),
        F.when(F.concat(F.right(c["left"], F.lit(1)), F.lit(" "), c["right"]).rlike(r"[A-Za-z0-9]"), 2).when(c["right"].rlike(r"\S"), 1).otherwise(0),
    ]


def vectors(docs: DataFrame, *, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """FEATURES, held_out, n, sure: a row per vector of integers, over all candidates of all documents."""
    found = with_base(docs.select(id_column, text_column), text_column).withColumn("held_out", F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False)))
    each = found.select("held_out", "__base", F.explode("__cands").alias("c"))
    overlaps = F.exists("__base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start")))
    random = F.col("c.value").rlike(f"(?:[0-9]++[A-Za-z]++){{{RUNS - 1}}}[0-9]") | F.col("c.value").rlike("^(?:AKIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9_\\-]{12,}$")
    sure = F.when(F.col("c.generator") >= 2, random).otherwise(overlaps)
    rows = each.select("held_out", *[f.cast("int").alias(n) for n, f in zip(FEATURES, _vector(F.col("c")), strict=True)], sure.cast("long").alias("sure"))
    return rows.groupBy(*FEATURES, "held_out").agg(F.count("*").alias("n"), F.sum("sure").alias("sure"))


def fit(rows: np.ndarray, n: np.ndarray, sure: np.ndarray) -> list[tuple]:
    """Boosted trees of depth two on weighted vectors: (feature, cut, left subtree, right subtree), leaves are floats."""
    trees: list[tuple] = []
    score = np.zeros(len(rows))

    def leaf(at: np.ndarray, g: np.ndarray, h: np.ndarray) -> float:
        return float(RATE * g[at].sum() / (h[at].sum() + LEAVES_PRIOR))

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        gain_of = lambda a: g[a].sum() ** 2 / (h[a].sum() + LEAVES_PRIOR)
        options = [(gain_of(at & (rows[:, f] <= cut)) + gain_of(at & (rows[:, f] > cut)) - gain_of(at), f, cut) for f in range(rows.shape[1]) for cut in np.unique(rows[at, f])[:-1].tolist()]
        best = max(options, default=(0, 0, 0))
        if depth == 0 or best[0] <= 1e-9:
            return leaf(at, g, h)
        _, f, cut = best
        return f, int(cut), grow(at & (rows[:, f] <= cut), g, h, depth - 1), grow(at & (rows[:, f] > cut), g, h, depth - 1)

    def value(tree, out: np.ndarray, at: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            out[at] += tree
        else:
            f, cut, low, high = tree
            value(low, out, at & (rows[:, f] <= cut))
            value(high, out, at & (rows[:, f] > cut))
        return out

    for _ in range(ROUNDS if len(rows) else 0):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.ones(len(rows), bool), sure - n * p, n * p * (1 - p), 2))
        value(trees[-1], score, np.ones(len(rows), bool))
    return trees


def score_of(tree, features: list) -> float:
    """A tree's value for one vector."""
    while not isinstance(tree, float):
        f, cut, low, high = tree
        tree = low if features[f] <= cut else high
    return tree


def trained(table: DataFrame) -> tuple[list[tuple], list[float]]:
    """Trees and each generator's threshold from the table of vectors (at most 2 * MAX_VECTORS rows reach the driver)."""
    collected = table.orderBy(*FEATURES, "held_out").collect()
    data = np.array([[r[c] for c in (*FEATURES, "held_out", "n", "sure")] for r in collected], float).reshape(-1, len(FEATURES) + 3)
    rows, out, n, sure = data[:, : len(FEATURES)], data[:, -3] > 0, data[:, -2], data[:, -1]
    fitted = ~out if n[~out].sum() >= MIN_HELD_OUT else np.ones(len(out), bool)
    trees = fit(rows[fitted], n[fitted], sure[fitted])
    scores = np.array([sum(score_of(t, r) for t in trees) for r in rows.tolist()])
    thresholds = []
    for g in range(len(GENERATORS)):
        own = rows[:, 0] == g
        at = own & out if n[own & out].sum() >= MIN_HELD_OUT else own
        best = float("inf")
        for cut in sorted(set(scores[at].tolist()), reverse=True):
            above = at & (scores >= cut)
            if sure[above].sum() >= PRECISION * n[above].sum():
                best = cut
        thresholds.append(best - 1e-9)
    return trees, thresholds


def _compiled(tree, features: list[Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, cut, low, high = tree
    return F.when(features[f] <= cut, _compiled(low, features)).otherwise(_compiled(high, features))


def with_spans(docs: DataFrame, model: tuple[list[tuple], list[float]], *, text_column: str = "text") -> DataFrame:
    """docs with spans: array of (kind number, start, end), base ones and the method's, by kind and start; __text stays for rewriting."""
    trees, thresholds = model
    out = with_base(docs, text_column)
    if trees:
        kinds = [KINDS.index(k) for k, _ in GENERATORS.values()]
        scored = lambda c: F.struct(c.alias("c"), F.struct(*[v.alias(n) for n, v in zip(FEATURES, _vector(c), strict=True)]).alias("f"))

        def chosen(x: Column) -> Column:
            features = [x["f"][n] for n in FEATURES]
            total = reduce(lambda a, b: a + b, [_compiled(t, features) for t in trees])
            least = reduce(lambda e, g: e.when(x["f"]["generator"] == g, F.lit(thresholds[g])), range(1, len(thresholds)), F.when(x["f"]["generator"] == 0, F.lit(thresholds[0])))
            free = ~F.exists("__base", lambda b: (b["start"] < x["c"]["end"]) & (b["end"] > x["c"]["start"]))
            return free & (total >= least)

        kind = lambda g: reduce(lambda e, k: e.when(g == k, F.lit(kinds[k])), range(1, len(kinds)), F.when(g == 0, F.lit(kinds[0])))
        added = F.transform(F.filter(F.transform("__cands", scored), chosen), lambda x: F.struct(kind(x["c"]["generator"]).alias("kind"), x["c"]["start"].alias("start"), x["c"]["end"].alias("end")))
        added = F.when(F.size("__cands") > 0, F.array_distinct(added))
    else:
        added = F.slice("__base", 1, 0)
    return out.withColumn("spans", F.array_sort(F.concat("__base", F.coalesce(added, F.slice("__base", 1, 0)))))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def report(spanned: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (text)."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return spanned.select(
        F.col(id_column).alias("doc_id"), *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(span_text(F.filter("spans", lambda s: s["kind"] < 4)), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
    )


def redacted(spanned: DataFrame, *, text_column: str = "text") -> DataFrame:
    """spanned with each span's text replaced by <KIND>; of overlapping spans the first (the longest, if several start there) stands for all."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))))

    def step(state: Column, s: Column) -> Column:
        inside = s["start"] < state["at"]
        piece = F.concat(F.substring(F.col("__text"), state["at"] + 1, s["start"] - state["at"]), F.get(names, s["kind"]))
        return F.struct(F.greatest(state["at"], -s["neg"]).alias("at"), F.when(inside, state["out"]).otherwise(F.concat(state["out"], piece)).alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(F.col("__text"), s["at"] + 1, F.length("__text")))
    changed = F.aggregate(by_place, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)
    return spanned.withColumn(text_column, F.when(F.size("spans") > 0, changed).otherwise(F.col(text_column)))

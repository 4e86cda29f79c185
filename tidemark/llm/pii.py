"""Personal data by bootstrapped contextual extraction, on DataFrame functions alone.

Base recognisers (e-mail, IP, card, phone) give seed entities. The words before each
seed induce lexical patterns (one word, two words). Patterns and the identifier-like
instances that follow them, seeds included, form a graph that is scored in rounds: a
pattern is worth the smoothed share of its instances' worth, an instance the noisy-or
of its patterns. Instances of high worth found by high-confidence patterns are
identifiers that no base recogniser knows; every occurrence of them is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered, settle

# The base expressions. Possessive forms and the look-behind keep them linear on
# long runs; they match exactly what the plain forms match, leftmost and without overlap.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Identifier-like instances: 6 or more letters, digits, - and _, with a digit among them. Linear: only a run's start is tried.
INSTANCE = r"(?<![0-9A-Za-z_-])(?=[A-Za-z_-]*+[0-9])[0-9A-Za-z][0-9A-Za-z_-]{5,}+"
ROUNDS, SMOOTH, PATTERN_SEEDS, PATTERN_WORTH, INSTANCE_WORTH = 3, 2.0, 3, 0.5, 0.6
#: Spans of a text are handled in chunks; contexts are sought in the nearest characters first, further back if two words do not fit.
CHUNK, CONTEXT = 64, (48, 1024)
#: Added spans that are broadcast at most, at some 50 bytes each.
BROADCAST_SPANS = 200_000
SPAN = "array<struct<start:bigint,end:bigint,text:string>>"


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "phone":
        return n.between(9, 15)
    back = F.reverse(digits)
    twice = lambda i, d: F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    digit = lambda i: back.substr(i, F.lit(1)).cast("int")
    luhn = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + twice(i, digit(i))) % 10 == 0
    return F.when(n.between(12, 19), luhn).otherwise(False)


def _is_valid(kind: str):
    return lambda s: _valid(kind, s["text"])


def _has_kind(kind: str):
    return lambda s: s["kind"] == kind


def _tagged(order: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def _with_spans(df: DataFrame, guard: Column, pattern: str, out: str) -> DataFrame:
    """Adds ``out``: (start, end, text) of every match of ``pattern`` in ``text``, in code points.

    Lengths of the gaps and the matches are summed up in chunks, so that the work stays
    near linear for texts with very many matches.
    """
    none = F.array().cast(SPAN)
    matches = F.when(guard, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    df = df.withColumn("_m", matches).withColumn("_m", F.when(F.size("_m") > 0, F.col("_m")))
    gaps = F.when(F.col("_m").isNotNull(), F.transform(F.split("text", pattern, -1), lambda s: F.length(s).cast("long")))
    df = df.withColumn("_g", gaps)

    def chunk(c: Column) -> Column:
        both = F.arrays_zip(F.slice("_g", c * CHUNK + 1, F.least(F.lit(CHUNK), F.size("_g") - 1 - c * CHUNK)).alias("g"), F.slice("_m", c * CHUNK + 1, CHUNK).alias("m"))
        start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("s"))

        def step(a: Column, x: Column) -> Column:
            begin, n = a["at"] + x["g"], F.length(x["m"]).cast("long")
            return F.struct((begin + n).alias("at"), F.concat(a["s"], F.array(F.struct(begin.alias("start"), (begin + n).alias("end"), x["m"].alias("text")))).alias("s"))

        return F.aggregate(both, start, step)

    df = df.withColumn("_c", F.when(F.col("_m").isNotNull(), F.transform(F.sequence(F.lit(0), F.expr(f"int((size(_m) - 1) div {CHUNK})")), chunk)))
    df = df.withColumn("_o", F.when(F.col("_c").isNotNull(), F.transform("_c", lambda c, i: F.aggregate(F.slice("_c", 1, i), F.lit(0).cast("long"), lambda s, x: s + x["at"]))))
    spans = F.flatten(F.zip_with("_c", "_o", lambda c, o: F.transform(c["s"], lambda s: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end"), s["text"].alias("text")))))
    return df.withColumn(out, F.coalesce(spans, none)).drop("_m", "_g", "_c", "_o")


def _context(text: Column, start: Column) -> Column:
    """The last words, at most two, before ``start``: whole words, however long."""
    begin = start.cast("int")

    def last(before: Column) -> Column:
        w = F.regexp_extract_all(F.lower(before), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
        return F.slice(w, F.greatest(F.lit(1), F.size(w) - 1), 2)

    found = last(text.substr(F.lit(1), begin))
    for n in reversed(CONTEXT):  # a word that the window cuts counts for nothing
        near = last(F.regexp_replace(text.substr(F.greatest(F.lit(1), begin - n + 1), F.least(F.lit(n), begin)), r"^[^\x20\x09-\x0D]+", ""))
        found = F.when(begin <= n, last(text.substr(F.lit(1), begin))).when(F.size(near) == 2, near).otherwise(found)
    return found


def _patterns(context: Column) -> Column:
    n = F.size(context)
    one = F.when(n >= 1, F.concat(F.lit("1 "), F.element_at(context, -1)))
    two = F.when(n >= 2, F.concat(F.lit("2 "), F.array_join(context, " ")))
    return F.array_compact(F.array(one, two))


def find(docs: DataFrame) -> DataFrame:
    """``docs`` as the struct _d, and _base and _all: spans (start, order, end, kind) sorted by start and kind.

    Null texts count as empty. Spans are code points, the end exclusive. Repeated rows are
    each searched; a repeated value counts once for a pattern. Empty tables give no rows;
    columns of any name are kept in _d.
    """
    rows = gathered(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_d")).withColumn("_uid", F.monotonically_increasing_id())
    text = F.coalesce(F.col("_d.text"), F.lit(""))
    rows = rows.select("_uid", "_d", text.alias("text")).withColumn("_digit", F.col("text").rlike("[0-9]"))
    guards = {"email": F.col("text").contains("@"), "ip": F.col("_digit"), "card": F.col("_digit"), "phone": F.col("_digit") & F.col("text").contains("+")}
    for kind, pattern in KINDS.items():
        rows = _with_spans(rows, guards[kind], pattern, kind)
        rows = rows.withColumn(kind, F.filter(kind, _is_valid(kind)))
    rows = _with_spans(rows, F.col("_digit"), INSTANCE, "_i")
    known = [F.transform(k, _tagged(i, k)) for i, k in enumerate(KINDS)]
    rows = rows.withColumn("_base", F.array_sort(F.concat(*known)))
    rows = rows.withColumn("_i", F.when(F.size("_i") > 0, F.filter("_i", lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
                                                                  & (F.length(F.regexp_replace(s["text"], "[^0-9]", "")) >= 4))).otherwise(F.col("_i")))
    node = lambda seed: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(F.lower(s["text"])).alias("v"), F.lit(seed).alias("seed"), _patterns(_context(F.col("text"), s["start"])).alias("p"))
    nodes = F.concat(*(F.transform(k, node(True)) for k in KINDS), F.transform("_i", node(False)))
    return settle(rows.select("_uid", "_d", "_base", nodes.alias("_nodes")))


def score(found: DataFrame) -> DataFrame:
    """v: instances that high-confidence patterns make identifiers. ``found`` is what ``find`` returns.

    A pattern needs ``PATTERN_SEEDS`` sure instances: seeds, and from the second round on those
    that the round before found, so that identifiers lead to new patterns.
    """
    graph = found.select(F.explode("_nodes").alias("n")).select("n.v", "n.seed", F.explode("n.p").alias("p"))
    n = found.agg(F.coalesce(F.sum(2 * F.size("_nodes")), F.lit(0))).first()[0]
    graph = settle(graph.groupBy("p", "v").agg(F.max("seed").alias("seed")), n)  # a repeated value counts once
    worth = None
    for _ in range(ROUNDS):
        edges = graph.withColumn("w", F.when(F.col("seed"), 1.0).otherwise(0.0)) if worth is None else \
            graph.join(worth, "v", "left").withColumn("w", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("w", F.lit(0.0))))
        patterns = edges.groupBy("p").agg((F.sum("w") / (F.count(F.lit(1)) + SMOOTH)).alias("c"), F.sum((F.col("w") >= INSTANCE_WORTH).cast("long")).alias("s"))
        strong = patterns.where((F.col("s") >= PATTERN_SEEDS) & (F.col("c") >= PATTERN_WORTH)).select("p", "c")
        worth = settle(graph.where(~F.col("seed")).join(strong, "p").groupBy("v").agg((1 - F.exp(F.sum(F.log(1 - F.least("c", F.lit(0.999)))))).alias("w")), n)
    return worth.where(F.col("w") >= INSTANCE_WORTH).select("v")


def extract(docs: DataFrame) -> DataFrame:
    """_d (the document), _base and _all: see ``find``; added spans have the kind "id"."""
    found = find(docs)
    added = found.select("_uid", F.explode(F.filter("_nodes", lambda n: ~n["seed"])).alias("n")).select("_uid", "n.v", "n.start", "n.end")
    extra = added.join(score(found), "v").groupBy("_uid").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("order"), "end", F.lit("id").alias("kind"))).alias("_extra"))
    extra = settle(extra, found.count())
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")
    # Few added spans travel to the documents; many meet them by a shuffle.
    few = (extra.agg(F.sum(F.size("_extra"))).first()[0] or 0) <= BROADCAST_SPANS
    rows = found.select("_uid", "_d", "_base").join(F.broadcast(extra) if few else extra, "_uid", "left")
    return rows.select("_d", "_base", F.array_sort(F.concat("_base", F.coalesce("_extra", none))).alias("_all"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: one row per document."""
    n = [F.size(F.filter("_base", _has_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return extract(docs.select("doc_id", "text")).select(F.col("_d.doc_id").alias("doc_id"), *n, F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("_all").alias("spans"),
                                                         (F.size("_all") - F.size("_base")).cast("long").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, each span of personal data replaced by its kind in brackets; n_chars, if there, follows.

    Of overlapping spans the first counts, extended to the end of those it meets. Null texts
    stay null, empty and repeated rows stay; an empty table gives no rows; columns of any name
    are kept. Spans are replaced in chunks of ``CHUNK``, each with its own part of the text, so
    the work stays near linear for texts with very many spans.
    """
    rows = extract(docs)
    text = F.col("_d.text")
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"int((size(_all) - 1) div {CHUNK})")), lambda c: F.slice("_all", c * CHUNK + 1, CHUNK))
    rows = rows.withColumn("_c", F.when(F.size("_all") > 0, cut))
    rows = rows.withColumn("_e", F.transform("_c", lambda c: F.array_max(F.transform(c, lambda s: s["end"]))))
    # Where the chunk's text begins: the furthest end of all spans before it.
    rows = rows.withColumn("_lo", F.transform("_e", lambda e, i: F.when(i > 0, F.array_max(F.slice("_e", 1, i))).otherwise(F.lit(0).cast("long"))))
    parts = F.transform(F.arrays_zip("_c", "_lo", "_e"), lambda k: F.struct(
        k["_c"].alias("c"), k["_lo"].alias("lo"), text.substr((k["_lo"] + 1).cast("int"), F.greatest(F.lit(0).cast("long"), k["_e"] - k["_lo"]).cast("int")).alias("t")))
    rows = rows.withColumn("_k", parts)

    def step(lo: Column, t: Column):
        def replace(a: Column, s: Column) -> Column:
            gap = t.substr((a["at"] - lo + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
            fresh = F.struct(s["end"].alias("at"), F.concat(a["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))
            return F.when(s["start"] >= a["at"], fresh).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
        return replace

    done = F.transform("_k", lambda k: F.aggregate(k["c"], F.struct(k["lo"].alias("at"), F.lit("").alias("out")), step(k["lo"], k["t"]), lambda a: a["out"]))
    done = F.concat(F.array_join(done, ""), text.substr((F.array_max("_e") + 1).cast("int"), F.length(text)))
    rows = rows.withColumn("_text", F.when(F.size("_all") > 0, done).otherwise(text))
    rows = rows.withColumn("_d", F.col("_d").withField("text", F.col("_text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("_d", F.when(F.size("_all") > 0, F.col("_d").withField("n_chars", F.length("_text").cast(kind))).otherwise(F.col("_d")))
    return rows.select("_d.*")

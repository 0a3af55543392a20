"""Benchmark decontamination by template canonicalisation, in built-in functions only.

Numbers, units after numbers and names (capitalised words inside a sentence) become typed placeholders,
everything else lower-cased words. Windows of template tokens are hashed and hash-joined between the
documents and the benchmark, so that a question with other numbers or names still meets its original.
Each meeting is then confirmed token by token, and its slots must be consistent: along one alignment,
equal values of the benchmark item must stand for equal values of the document. A document holds an item
if confirmed, consistent windows cover at least ``COVERAGE`` of the item's windows.

Defined results: a null or wordless text matches nothing, nor does such an item; items shorter than the
window are one window of their own length; a null id is reported as null and its row is dropped like any
other; repeated rows give one report and are all dropped; an item may be found in any number of
documents; an empty table gives an empty result; further columns are ignored by ``find`` and kept by
``drop_found``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import free_names, size_checked
from .scratch import stored

#: Tokens a window, and the share of an item's windows that must be found.
WINDOW, COVERAGE = 8, 0.5
#: Benchmark windows up to this number are broadcast; more are joined by shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Candidate documents up to this number are broadcast when their texts are fetched.
BROADCAST_FOUND = 1_000_000

# Units that may follow a number.
UNITS = ("percent", "%", "kg", "g", "mg", "lb", "lbs", "oz", "km", "m", "cm", "mm", "mi", "ft", "miles", "meters", "metres", "feet", "inches", "l", "ml", "liters", "litres", "h", "hr", "hours", "hour", "min", "minutes", "minute", "s", "sec", "seconds", "second", "days", "day", "weeks", "week", "years", "year", "km/h", "mph", "dollars", "dollar", "cents", "euros", "euro", "usd", "eur", "kb", "mb", "gb", "hz", "w", "kw", "v")

_NUMBER = r"(?<![\p{L}\p{N}.,:/])\p{N}+(?:[.,:/]\p{N}+)*"
_NAME = r"(?<=[\p{Ll}\p{N},;:)] )\p{Lu}[\p{L}\p{M}'’-]*"
_UNIT = "(?i:" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + ")"
_TOKEN = r"‹[nqu](?:∶[^›]*)?›|[\p{L}\p{M}\p{N}]+"


def _tokens(text, values: bool):
    """Template tokens of a text: words, and placeholders ``‹n›``, ``‹q›``, ``‹u›``; with ``values``
    a placeholder also holds what it stands for, as in ``‹q∶12›``."""
    tag = (lambda kind, group: f" ‹{kind}∶${group}› ") if values else (lambda kind, group: f" ‹{kind}› ")
    t = F.regexp_replace(text, _NAME, tag("n", 0))
    t = F.regexp_replace(t, rf"({_NUMBER})\s?({_UNIT})(?![\p{{L}}\p{{N}}])", tag("q", 1) + tag("u", 2))
    # digits that already stand in a placeholder follow its colon
    t = F.regexp_replace(t, _NUMBER.replace("(?<![", "(?<![∶"), tag("q", 0))
    return F.regexp_extract_all(F.lower(t), F.lit(_TOKEN), F.lit(0))


def _windows(tokens, lengths: list[int]):
    """Hashes of all windows of the given lengths, one array of hashes a length."""
    # the outer transform binds the tokens once
    one = lambda w, k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.lit(k), F.slice(w, i, F.lit(k))))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(F.array(tokens), lambda w: F.array(*[one(w, k) for k in lengths]))[0]


def _plain(tokens):
    return F.transform(tokens, lambda t: F.regexp_replace(t, "∶[^›]*", ""))


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, text_hash, item_id, windows, item_windows, coverage, slots, changed_slots) of every
    document and item it holds; ``changed_slots`` counts placeholders whose value was replaced."""
    bench = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), _tokens(F.col(item_text), True).alias("itoks"))
    bench = stored(bench.where(F.size("itoks") > 0).withColumn("k", F.least(F.lit(window), F.size("itoks"))).dropDuplicates(["item", "itoks"]), "bench")
    lengths = [r.k for r in bench.select("k").distinct().orderBy("k").collect()]  # at most WINDOW values
    pairs = lambda column: F.explode(F.arrays_zip(F.array(*[F.lit(k) for k in lengths]).alias("k"), column.alias("hashes")))
    if not lengths:
        return docs.sparkSession.createDataFrame([], f"{id_col} {docs.schema[id_col].dataType.simpleString()}, text_hash bigint, {item_id} {items.schema[item_id].dataType.simpleString()}, windows int, item_windows int, coverage double, slots int, changed_slots int")
    iwin = bench.select("item", "k", "itoks", F.posexplode(_windows(_plain(F.col("itoks")), list(range(1, window + 1)))[F.col("k") - 1]).alias("ipos", "hash")).drop("itoks")
    iwin = size_checked(stored(iwin, "bench-windows"), BROADCAST_WINDOWS)

    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    met = rows.select("id", "text_hash", _windows(_tokens(F.col("text"), False), lengths).alias("w"))
    if len(lengths) == 1:
        met = met.select("id", "text_hash", F.posexplode(F.col("w")[0]).alias("dpos", "hash")).withColumn("k", F.lit(lengths[0]))
    else:
        met = met.select("id", "text_hash", pairs(F.col("w")).alias("z")).select("id", "text_hash", F.col("z.k").alias("k"), F.posexplode("z.hashes").alias("dpos", "hash"))
    met = met.join(iwin, ["k", "hash"]).select("id", "text_hash", "item", "k", (F.col("dpos") - F.col("ipos")).alias("shift"), "ipos")
    # equal rows of documents give equal meetings, which a set counts once; a set has at most an item's windows
    met = stored(met.groupBy("id", "text_hash", "item", "k", "shift").agg(F.collect_set("ipos").alias("at")), "bench-met")

    n_windows = bench.select("item", (F.size("itoks") - F.col("k") + 1).alias("item_windows")).groupBy("item").agg(F.max("item_windows").alias("item_windows"))
    enough = F.col("windows") >= F.greatest(F.lit(1), F.ceil(F.col("item_windows") * coverage))
    likely = met.groupBy("id", "text_hash", "item").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("windows")).join(F.broadcast(n_windows) if n_windows.count() <= BROADCAST_WINDOWS else n_windows, "item").where(enough).select("id", "text_hash", "item")
    likely = stored(likely, "bench-likely")
    held = likely.select("id", "text_hash").distinct()
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["text_hash"] == b["text_hash"])
    held = size_checked(held, BROADCAST_FOUND).select(F.col("id").alias("hid"), F.col("text_hash").alias("hhash"))
    texts = rows.join(held, F.col("id").eqNullSafe(F.col("hid")) & (F.col("text_hash") == F.col("hhash")), "left_semi")
    texts = stored(texts.select("id", "text_hash", _tokens(F.col("text"), True).alias("dtoks")).dropDuplicates(["id", "text_hash"]), "bench-texts")

    m, c, x = met.alias("m"), likely.alias("c"), texts.alias("x")
    full = m.join(c, F.expr("m.id <=> c.id and m.text_hash = c.text_hash and m.item = c.item"), "left_semi")
    full = full.join(x, F.expr("m.id <=> x.id and m.text_hash = x.text_hash")).join(bench.select(F.col("item").alias("bitem"), "itoks"), F.col("m.item") == F.col("bitem"))
    full = full.select("m.id", "m.text_hash", "m.item", "m.k", "m.shift", "m.at", "x.dtoks", "itoks")
    slice_of = lambda toks, start: F.slice(F.col(toks), start + 1, F.col("k"))
    full = full.withColumn("at", F.filter("at", lambda p: _plain(slice_of("itoks", p)) == _plain(slice_of("dtoks", p + F.col("shift")))))
    slot = F.flatten(F.transform("at", lambda p: F.filter(F.arrays_zip(slice_of("itoks", p).alias("i"), slice_of("dtoks", p + F.col("shift")).alias("d")), lambda z: z["i"].startswith("‹"))))
    full = full.withColumn("slot", F.array_distinct(slot))
    full = full.where((F.size("at") > 0) & (F.size(F.array_distinct(F.transform("slot", lambda z: z["i"]))) == F.size("slot")))
    out = full.groupBy("id", "text_hash", "item").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("windows"), F.max(F.size("slot")).alias("slots"), F.max(F.size(F.filter("slot", lambda z: z["i"] != z["d"]))).alias("changed_slots"))
    out = out.join(n_windows, "item").where(enough)
    return out.select(F.col("id").alias(id_col), "text_hash", F.col("item").alias(item_id), "windows", "item_windows", F.round(F.col("windows") / F.col("item_windows"), 4).alias("coverage"), "slots", "changed_slots")


def drop_found(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, with their columns as they were."""
    own, its_hash = free_names(docs, "id", "hash")
    found = stored(find(docs, items, id_col, text, **how).select(F.col(id_col).alias(own), F.col("text_hash").alias(its_hash)).distinct(), "bench-drop")
    found = size_checked(found, BROADCAST_FOUND)
    return docs.join(found, F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(F.col(text)) == F.col(its_hash)), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item it holds, verbatim or re-parameterised."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")

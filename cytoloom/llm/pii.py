"""Information-theoretic sanitisation of personal data.

Pattern spans (email, ip, card, phone) are the protected entities. Over the whole corpus we count in
how many documents each term occurs, and in how many it occurs near each protected value and near
each class of values. From these counts follows how much of an entity's information a term gives
away: PMI(term; entity) / IC(entity), which is 1 if the term always points to the entity. Terms at or
over the disclosure threshold are *removed* if they reveal one value, and *generalised* if they reveal
only the class. Copies of one passage do not count as evidence: a term needs several contexts that
differ in their neighbourhood.

Defined results: null text counts as empty; a null id is kept; repeated rows each give a row; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .batches import map_slices, slices, tidy
from .scratch import stored

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Words on each side of a protected value that count as near it.
WINDOW_WORDS = 8
#: Characters fetched on each side to find them.
WINDOW_CHARS = 240
#: Share of an entity's information at which a term discloses it.
DISCLOSURE = 0.9
#: Differing contexts a term needs with one value, and with one class.
VALUE_CONTEXTS, CLASS_CONTEXTS = 4, 8
#: Disclosing terms up to this number are broadcast; more are joined to the texts that hold them.
BROADCAST_TERMS = 500_000
#: Distinct terms a task counts before it hands the counts on.
FLUSH_TERMS = 400_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Anchored at each ``@`` so that long runs without one cost nothing; same matches as the pattern."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > end and _LOCAL_TAIL.match(text[start - 1]):
                start -= 1
            if start < at:
                out.append((start, domain.end()))
                end = domain.end()
        # an @ inside the match can't be: the domain has none
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind and then start."""
    out = [(0, s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def _value(kind: int, matched: str) -> int:
    """A signed 64-bit digest of the normalised value; the value itself is never stored."""
    plain = matched.lower() if kind == 0 else _NOT_DIGIT.sub("" if kind != 1 else ".", matched)
    return xxhash.xxh64_intdigest(f"{KINDS[kind]}\0{plain}") - (1 << 63)


def _near(text: str, start: int, end: int, spans: list[tuple[int, int, int]]) -> set[str]:
    """Terms within WINDOW_WORDS words of the span, without those inside any protected span."""
    lo, hi = max(0, start - WINDOW_CHARS), min(len(text), end + WINDOW_CHARS)
    left = [m for m in _TERM.finditer(text, lo, start) if lo == 0 or m.start() > lo][-WINDOW_WORDS:]
    right = [m for m in _TERM.finditer(text, end, hi) if hi == len(text) or m.end() < hi][:WINDOW_WORDS]
    inside = [(s, e) for _, s, e in spans if s < hi and e > lo]
    return {m.group().lower() for m in left + right if not any(s < m.end() and m.start() < e for s, e in inside)}


def _mark(terms: set[str], salt: str) -> int:
    """Min-hash of a context: equal for most near copies of one passage."""
    return min((xxhash.xxh64_intdigest(salt + t) for t in terms), default=0) - (1 << 63)


def term_counts(docs: DataFrame, text: str) -> DataFrame:
    """(term, docs): in how many documents each term occurs; partial counts are made in the tasks."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            names = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[t] for t in names], pa.int64())], names=["term", "docs"])
            counts.clear()
            return out

        for part in slices(batches, 0):
            for t in part.column(0).to_pylist():
                if t:
                    counts.update(set(_TERM.findall(t.lower())))
            if len(counts) >= FLUSH_TERMS:
                yield flush()
        if counts:
            yield flush()

    parts = docs.select(F.col(text).alias("text")).mapInArrow(tidy(run), "term string, docs bigint")
    return parts.groupBy("term").agg(F.sum("docs").alias("docs"))


def contexts(docs: DataFrame, text: str) -> DataFrame:
    """A row for each document, protected value and term near it.

    Rows without a term count the documents that hold the value, those without a value the class.
    """

    def run(batches):
        for part in slices(batches, 0):
            rows: list[tuple] = []
            for t in part.column(0).to_pylist():
                spans = base_spans(t) if t else []
                by_value: dict[tuple[int, int], set[str]] = {}
                for kind, s, e in spans:
                    by_value.setdefault((kind, _value(kind, t[s:e])), set()).update(_near(t, s, e, spans))
                rows += [(kind, None, None, 0, 0) for kind in {k for k, _ in by_value}]
                for (kind, value), terms in by_value.items():
                    a, b = _mark(terms, "a"), _mark(terms, "b")
                    rows.append((kind, value, None, 0, 0))
                    rows += [(kind, value, term, a, b) for term in terms]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["kind", "value", "term", "mark_a", "mark_b"])

    return docs.select(F.col(text).alias("text")).mapInArrow(tidy(run), "kind int, value bigint, term string, mark_a bigint, mark_b bigint")


def disclosing_terms(docs: DataFrame, text: str = "text", threshold: float = DISCLOSURE, value_contexts: int = VALUE_CONTEXTS, class_contexts: int = CLASS_CONTEXTS) -> DataFrame:
    """(term, action, kind, share): terms whose share of an entity's information reaches ``threshold``.

    ``action`` is ``remove`` (reveals one value) or ``generalise`` (reveals only that a value of the
    class follows). Counts cover every document.
    """
    spark = docs.sparkSession
    near = stored(contexts(docs, text), "pii-contexts")
    n_docs = docs.count()
    if not near.head(1):
        return spark.createDataFrame([], "term string, action string, kind int, share double")
    # partial sums first: a value or class that a third of all rows hold is one row per task and mark
    marks = near.groupBy("kind", "value", "term", "mark_a", "mark_b").agg(F.count("*").alias("n"))
    by_value = marks.groupBy("kind", "value", "term").agg(F.sum("n").alias("n"), F.least(F.approx_count_distinct("mark_a", 0.02), F.approx_count_distinct("mark_b", 0.02)).alias("ctx"))
    by_value = stored(by_value, "pii-pairs")
    per_value = by_value.where("term is null and value is not null").select("kind", "value", F.col("n").alias("seen"))
    values = by_value.where((F.col("ctx") >= value_contexts) & F.col("term").isNotNull()).join(per_value, ["kind", "value"])
    by_class = by_value.where("term is not null").groupBy("kind", "term").agg(F.sum("n").alias("n"), F.sum("ctx").alias("ctx"))
    per_class = by_value.where("value is null").select("kind", F.col("n").alias("seen"))
    classes = by_class.where(F.col("ctx") >= class_contexts).join(F.broadcast(per_class), "kind")  # at most four rows
    cand = values.select("term", F.lit("remove").alias("action"), "kind", "n", "seen").unionByName(classes.select("term", F.lit("generalise").alias("action"), "kind", "n", "seen"))
    joined = cand.join(term_counts(docs, text), "term")
    ic = -F.log2(F.least(F.col("seen"), F.lit(n_docs)) / n_docs)
    pmi = F.log2(F.least("n", "docs") * n_docs / (F.col("docs") * F.col("seen")))
    # where most documents hold the class, its information is next to none, and what counts is how far the
    # term takes its chance from there towards certainty
    chance, told = F.least(F.col("seen"), F.lit(n_docs)) / n_docs, F.least("n", "docs") / F.col("docs")
    share = F.when(ic > 1.0, pmi / ic).when(chance < 1, (told - chance) / (1 - chance))
    scored = joined.withColumn("share", share).where(F.col("share") >= threshold)
    best = scored.groupBy("term").agg(F.max(F.struct((F.col("action") == "remove").alias("r"), "share", "action", "kind")).alias("b"))
    return best.select("term", "b.action", "b.kind", "b.share")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """A row for each document: its spans and the sanitised text.

    Columns: the id, ``spans`` (array of kind, start, end, action; by kind in the order email, ip,
    card, phone, term, then start) and ``clean`` (text with values replaced by ``<KIND>``, revealing
    terms removed and class terms generalised to ``<KIND-CUE>``).
    """
    terms = disclosing_terms(docs, text) if terms is None else terms
    terms = stored(terms.select("term", "action", "kind"), "pii-terms")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        known = {t: (a, KINDS[c]) for t, a, c in terms.toPandas().itertuples(index=False)}
        shared = docs.sparkSession.sparkContext.broadcast(known)
        found = _apply(rows, lambda _: shared.value)
    else:
        found = _apply(_with_terms(rows, terms), lambda own: {x["term"]: (x["action"], KINDS[x["kind"]]) for x in own or ()})
    return found.select(F.col("id").alias(id_col), "spans", "clean")


def _with_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, text, own): each text with those of ``terms`` that occur in it, by joins; equal texts share theirs."""

    def run(batches):
        for part in slices(batches, 1):
            found = [(k, w) for k, t in zip(*(c.to_pylist() for c in part.columns)) if t for w in {*_TERM.findall(t.lower()), *(w.lower() for w in _TERM.findall(t))}]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.string()) for x in (list(zip(*found)) or [(), ()])], names=["key", "term"])

    # a digest of the text stands for it, as ids may be null or repeated
    keyed = rows.withColumn("key", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    met = keyed.select("key", "text").mapInArrow(tidy(run), "key string, term string").join(terms, "term").groupBy("key").agg(F.collect_set(F.struct("term", "action", "kind")).alias("own"))
    return keyed.join(met, "key", "left").select("id", "text", "own")


def _apply(docs: DataFrame, lookup) -> DataFrame:
    """(id, spans, clean) of ``docs``; ``lookup`` of a row's ``own`` terms (null if all share one table) gives
    what is done to each term."""
    if "own" not in docs.columns:
        docs = docs.withColumn("own", F.lit(None).cast("array<string>"))

    def term_hits(text: str, base: list, known: dict) -> list[tuple]:
        if not known or known.keys().isdisjoint(_TERM.findall(text.lower())):
            return []
        out = []
        for m in _TERM.finditer(text):
            what = known.get(m.group().lower())
            if what and not any(s < m.end() and m.start() < e for _, s, e in base):
                out.append(("term", m.start(), m.end(), "remove" if what[0] == "remove" else what[1]))
        return out

    def run(cols):
        out: dict[str, list] = {"id": cols["id"], "spans": [], "clean": []}
        for t, own in zip(cols["text"], cols["own"]):
            t = t or ""
            base = base_spans(t)
            spans = [(KINDS[k], s, e, "mask") for k, s, e in base] + term_hits(t, base, lookup(own))
            out["spans"].append([dict(zip(("kind", "start", "end", "action"), h)) for h in spans])
            out["clean"].append(_rewritten(t, spans))
        return out

    schema = StructType.fromDDL(f"id {docs.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int,action:string>>, clean string")
    return map_slices(docs.select("id", "text", "own"), run, schema, "text")


def _rewritten(text: str, spans: list[tuple]) -> str:
    out, at = [], 0
    for kind, s, e, action in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            mark = f"<{kind.upper()}>" if action == "mask" else "" if action == "remove" else f"<{action.upper()}-CUE>"
            out += [text[at:s], mark]
            at = e
        elif e > at:
            at = e
    return "".join(out) + text[at:]


def joined(spans) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def sha256_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op1_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document; the digest covers the pattern spans alone."""
    found = sanitise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text_of = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text_of(base).cast("binary"), 256).alias("base_sha256"), text_of("spans").alias("spans"))

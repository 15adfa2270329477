"""Personal data: patterns, and terms that reveal a protected entity.

E-mail addresses, IP addresses, card and phone numbers are found by pattern. Each value is a
protected entity, and so is each kind. Over the whole corpus, every term of a document is counted with the entities
of the document and without them: a term t discloses entity e as far as PMI(e; t) reaches the information content
of e (1 = the term determines the entity). Terms above the threshold whose co-occurrence is significant are
spans of kind ``term`` wherever they stand in the documents of e, and are removed; the patterns are generalised
to their kind.

For the test, documents with the same words next to the value are copies and count once. The test is the
log-likelihood ratio of the four counts, which bounds the chance of such a co-occurrence, against
``ALPHA`` over the number of pairs tested. A value that only one document (and its copies) holds is not tested: each
rare word of that document would stand with it as exclusively, and none says more than another.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back, step_table

KINDS = ("email", "ip", "card", "phone")
REACH = 80            # characters before and after an entity that count as its context
ALPHA = 0.05          # chance of any false term, over all pairs tested
DISCLOSURE = 0.9      # share of the entity's information content
HELD_TERMS = 200_000  # term counts held by a task before they are passed on
PASSED_TERMS = 10_000  # of them passed on at once

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits, so runs of any length are read once
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+")


def _emails(text: str):
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; offsets in code points."""
    out = [("email", s, e) for s, e in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and _luhn(d):
                out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def _entity(kind: str, value: str) -> str:
    value = value.lower() if kind in ("email", "ip") else _digits(value)
    return kind + ":" + hashlib.blake2b(value.encode(), digest_size=12).hexdigest()


def free_terms(text: str, spans, lo: int = 0, hi: int | None = None):
    """(term, start, end) of the terms between lo and hi that overlap no span."""
    taken, k = sorted((s, e) for _, s, e in spans), 0
    reach = 0  # the furthest end of the spans that start before the term ends
    for m in _TERM.finditer(text, lo, len(text) if hi is None else hi):
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= a:
            yield m.group().lower(), a, b


def entities(text: str, spans) -> list[tuple[str, str]]:
    """(entity, context) of the values and kinds in a text; the context is a hash of the terms next to them."""
    near: dict[str, set[str]] = {}
    for kind, s, e in spans:
        words = []
        for lo, hi in ((max(0, s - REACH), s), (e, min(len(text), e + REACH))):
            for term, a, b in free_terms(text, spans, lo, hi):
                cut = (a == lo and a > 0 and text[a - 1].isalnum()) or (b == hi and b < len(text) and text[b].isalnum())
                if not cut:
                    words.append(term)
        for entity in (kind, _entity(kind, text[s:e])):
            near.setdefault(entity, set()).add(" ".join(words))
    return [(entity, hashlib.blake2b("\n".join(sorted(found)).encode(), digest_size=12).hexdigest()) for entity, found in near.items()]


FACTS = ("doc_id {kind}, key string, spans array<struct<kind:string,start:long,end:long>>, body string, "
         "entities array<struct<entity:string,context:string>>, words array<string>, term string, n long")


def document_facts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Step table of one pass over the texts: a row per document (spans and, if there are any, text, entities
    and distinct terms outside the spans), and rows (term, n) with the number of documents of the task that hold a term."""
    kind = dict(docs.dtypes)[doc_id]
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(body)))
    columns = ["doc_id", "key", "spans", "body", "entities", "words", "term", "n"]

    def look(batches):
        held: Counter = Counter()

        def counts():
            while held:
                some = [(None, None, None, None, None, None, *held.popitem()) for _ in range(min(PASSED_TERMS, len(held)))]
                frame = pd.DataFrame(some, columns=columns)
                if kind in ("bigint", "int"):
                    frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

        for batch in batches:
            rows = []
            for doc, k, t in zip(batch["doc_id"], batch["key"], batch["body"]):
                spans = base_spans(t)
                rows.append((doc, k, [dict(zip(("kind", "start", "end"), s)) for s in spans], t if spans else None,
                             [dict(zip(("entity", "context"), x)) for x in entities(t, spans)],
                             sorted({w for w, _, _ in free_terms(t, spans)}) if spans else [], None, None))
                held.update({w.lower() for w in set(_TERM.findall(t))})
                if len(held) > HELD_TERMS:
                    yield from counts()
            frame = pd.DataFrame(rows, columns=columns)
            if kind in ("bigint", "int"):
                frame["doc_id"] = frame["doc_id"].astype("Int64")
            frame["n"] = frame["n"].astype("Int64")
            yield frame
            del rows, frame
            hand_back()
        yield from counts()

    rows = docs.select(F.col(doc_id).alias("doc_id"), key.alias("key"), body.alias("body"))
    return step_table(rows.mapInPandas(look, FACTS.format(kind=kind)))


def _mentions(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, df_entity, units) of the entities in two distinct contexts or more, and (key, entity, context) of the
    documents that hold one of them."""
    each = documents.where(F.size("spans") > 0).select("key", F.inline("entities"))
    known = each.groupBy("entity").agg(F.count(F.lit(1)).alias("df_entity"), F.count_distinct("context").alias("units")).where("units > 1")
    of_kind = F.col("entity").isin(*KINDS)
    # the four kinds hold many documents each and meet their one row by broadcast
    kept = each.where(of_kind).join(F.broadcast(known.where(of_kind).select("entity")), "entity", "left_semi").unionByName(
        each.where(~of_kind).join(known.where(~of_kind).select("entity"), "entity", "left_semi")).distinct()
    return known, step_table(kept)


def disclosing_terms(facts: DataFrame, mentions: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(entity, term, disclosure) of the significant pairs above the threshold, from counts of documents."""
    documents = facts.where("key is not null")
    known, kept = mentions or _mentions(documents)
    # one row a document on both sides: its entities meet its words once
    of_doc = kept.groupBy("key").agg(F.collect_set(F.struct("entity", "context")).alias("of"))
    each = of_doc.join(documents.where(F.size("spans") > 0).select("key", "words"), "key").select("of", F.explode("words").alias("term")).select(
        "term", F.inline("of"))
    # read three times below, under filters that would keep its shuffle from being shared
    together = step_table(each.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"), F.count_distinct("context").alias("both_units")))
    of_kind = F.col("entity").isin(*KINDS)
    pairs = together.where(of_kind).join(F.broadcast(known.where(of_kind)), "entity").unionByName(
        together.where(~of_kind).join(known.where(~of_kind), "entity"))
    tested = F.broadcast(together.agg(F.count(F.lit(1)).alias("tested")))
    total = F.broadcast(documents.agg(F.count(F.lit(1)).alias("total")))  # one row, like the number of pairs
    terms = facts.where("term is not null").groupBy("term").agg(F.sum("n").alias("df_term"))
    content = F.log2(F.col("total") / F.col("df_entity"))
    told = F.log2(F.col("both") * F.col("total") / (F.col("df_entity") * F.col("df_term")))
    pairs = pairs.join(terms, "term").join(total).withColumn("disclosure", F.when(content > 0, told / content)).where(
        F.col("disclosure") >= DISCLOSURE).join(tested)
    # copies of a document of the entity count once
    a, e = F.col("both_units"), F.col("units")
    t, n = F.col("df_term") - F.col("both") + a, F.col("total") - F.col("df_entity") + e

    def part(seen, row, column):
        return F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0)

    evidence = part(a, e, t) + part(e - a, e, n - t) + part(t - a, n - e, t) + part(n - e - t + a, n - e, n - t)
    return pairs.where(evidence >= F.log(F.col("tested") / ALPHA)).select("entity", "term", "disclosure")


def _held_and_bare(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, spans of the documents with a span and of those without."""
    facts = document_facts(docs, doc_id, text)
    documents = facts.where("key is not null")
    mentions = _mentions(documents)
    # a document's entities bring their terms along; which of them stand in it, its text says
    told = disclosing_terms(facts, mentions).groupBy("entity").agg(F.collect_set("term").alias("terms"))
    told = mentions[1].join(told, "entity").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("terms"))).alias("terms"))

    @F.pandas_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def marked(bodies: pd.Series, spans: pd.Series, terms: pd.Series) -> pd.Series:
        def one(t, found, wanted):
            if wanted is None:
                return []
            wanted = set(wanted)
            return [{"kind": "term", "start": a, "end": b} for w, a, b in free_terms(
                t, [(s["kind"], s["start"], s["end"]) for s in found]) if w in wanted]
        return pd.Series([one(*x) for x in zip(bodies, spans, terms)], dtype=object)

    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    held, bare = documents.where(F.size("spans") > 0), documents.where(F.size("spans") == 0)
    held = held.join(told, "key", "left").select("doc_id", "key", F.concat("spans", F.coalesce(marked("body", "spans", "terms"), none)).alias("spans"))
    return held, bare.select("doc_id", "key", "spans")


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, key (hash of id and text), spans array<struct<kind, start, end>>
    by kind (email, ip, card, phone, term), then start; offsets in code points, end exclusive.

    Null text counts as empty: no spans. Rows that repeat id and text get the same spans. Spans of
    different kinds may overlap, terms overlap none. Other columns are ignored.
    """
    held, bare = _held_and_bare(docs, doc_id, text)
    return held.unionByName(bare)


def spans_text(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns, with each pattern span as ``[KIND]`` and the disclosing terms removed.
    Of overlapping spans the first, then the longest, is replaced and the rest of the others removed."""
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(body)))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("key"))
    # a filter on the spans would find the terms twice, by two Python workers in each task
    found = _held_and_bare(docs, doc_id, text)[0].select("key", "spans").dropDuplicates(["key"])

    @F.pandas_udf("string")
    def replaced(bodies: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, found):
            if t is None or found is None:
                return t
            out, at = [], 0
            for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    out.append(t[at:s["start"]])
                    out.append("" if s["kind"] == "term" else f"[{s['kind'].upper()}]")
                at = max(at, s["end"])
            return "".join([*out, t[at:]])
        return pd.Series([one(t, f) for t, f in zip(bodies, spans)], dtype=object)

    out = rows.join(found, "key", "left").withColumn("cleaned", replaced(F.col("row")[text], F.col("spans")))
    return out.select(*[F.col("cleaned").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])

"""Personal data: fixed kinds by their form, and the terms around them by what the corpus tells.

A term discloses an entity (a mail address, a number) as far as texts with the term are texts with
the entity: pointwise mutual information against the entity's own information.  Where that exceeds a
threshold, masking the entity is not enough, so the term next to it is generalised to its beginning,
or removed if that discloses the entity as well.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, slices

KINDS = ("email", "ip", "card", "phone")
METHOD = ("generalised", "removed")

REACH = 8  # terms before and after a mention that are its context
SHORTEST = 3  # letters of a term
GENERAL = 3  # letters that remain of a generalised term
SUPPORT = 3  # different texts that a term has to share with an entity
DISCLOSES = 0.9  # share of the entity's information
FEW_UNITS, FEW_CHARS = 200_000, 8_000_000  # terms, and characters in them, that are sent to every task
SALT = 16

# Fixed forms.  No part can give back what it took, so each place is looked at a bounded number of times.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_TERM = re.compile(TERM)
_LOWER = str.maketrans(UPPER, LOWER)
_DIGITS = re.compile("[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost mail addresses: a domain after @, and all that may stand before it."""
    out, free = [], 0
    for found in DOMAIN.finditer(text):
        at = found.start()
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        if start < at:
            out.append((start, found.end()))
            free = found.end()
        else:
            free = at + 1
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _good_ip(text: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in text.split(".")))


def _good_card(text: str) -> bool:
    digits = _DIGITS.findall(text)
    return 16 <= len(digits) <= 19 and _luhn("".join(digits))


def _good_phone(text: str) -> bool:
    return 8 <= len(_DIGITS.findall(text)) <= 15


def find(text: str) -> list[list[tuple[int, int]]]:
    """The spans of each of KINDS, in code points, end exclusive."""
    out = [emails(text) if "@" in text else []]
    for form, good in ((IP, _good_ip), (CARD, _good_card), (PHONE, _good_phone)):
        out.append([m.span() for m in form.finditer(text) if good(m.group())])
    return out


def entity(kind: str, text: str) -> str:
    """What a mention stands for, however it is written."""
    return f"{kind}:{text.translate(_LOWER) if kind in ('email', 'ip') else ''.join(_DIGITS.findall(text))}"


def context(text: str, spans: list[list[tuple[int, int]]]) -> list[tuple[str, str | None, int, int]]:
    """(entity, term, start, end): for each mention itself (no term), and for the terms in its reach.

    Terms are runs of letters, in lower case; those within any span are none.
    """
    covered = sorted(s for kind in spans for s in kind)
    merged: list[list[int]] = []
    for a, b in covered:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]
    terms = []
    for m in _TERM.finditer(text):
        k = bisect_right(starts, m.start()) - 1
        inside = k >= 0 and merged[k][1] > m.start() or k + 1 < len(merged) and merged[k + 1][0] < m.end()
        if m.end() - m.start() >= SHORTEST and not inside:
            terms.append(m.span())
    at, out = [a for a, _ in terms], []
    for kind, mentions in zip(KINDS, spans, strict=True):
        for a, b in mentions:
            name, k = entity(kind, text[a:b]), bisect_left(at, a)
            out.append((name, None, a, b))
            out.extend((name, text[s:e].translate(_LOWER), s, e) for s, e in terms[max(0, k - REACH) : k + REACH])
    return out


ROWS = "doc_id long, digest binary, salt int, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, context array<struct<entity: string, term: string, start: int, end: int>>"


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, counts by kind, base (kind:start:end, comma-joined), its sha256, and, where
    there are any, the text's digest and the contexts."""
    kind = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    kinds = (pa.int64(), pa.binary(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.string(), kind)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for doc, digest, salt, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = find(text)
                base = ",".join(f"{k}:{a}:{b}" for k, s in zip(KINDS, spans, strict=True) for a, b in s)
                around = context(text, spans) if base else None
                out.append((doc, digest if base else None, salt, *map(len, spans), base, hashlib.sha256(base.encode()).hexdigest(), around and [dict(zip(("entity", "term", "start", "end"), x, strict=True)) for x in around]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in ROWS.split(", context")[0].split(", ")] + ["context"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text).alias("digest"), F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int").alias("salt"), text.alias("text"))
    return rows.mapInArrow(scan, ROWS)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def general(term: Column) -> Column:
    return F.concat(F.substring(term, 1, GENERAL), F.lit("*"))


def _counted(docs: DataFrame, text_col: str, units: DataFrame) -> DataFrame:
    """(unit, n): in how many documents each of the given terms and beginnings of terms stands."""
    terms = F.filter(F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), GAP), lambda w: F.length(w) >= SHORTEST)
    found = docs.select(F.array_distinct(terms).alias("terms")).select(F.explode(F.concat("terms", F.array_distinct(F.transform("terms", general)))).alias("unit"))
    size = units.agg(F.count("*"), F.coalesce(F.sum(F.length("unit")), F.lit(0))).first()
    if size[0] <= FEW_UNITS and size[1] <= FEW_CHARS:
        return found.join(F.broadcast(units), "unit").groupBy("unit").agg(F.count("*").alias("n"))
    return found.groupBy("unit").agg(F.count("*").alias("n")).join(units, "unit", "left_semi")


def disclosures(docs: DataFrame, texts: DataFrame, text_col: str = "text", support: int = SUPPORT, share: float = DISCLOSES) -> DataFrame:
    """(entity, term, kind): the terms to be generalised or removed where they stand next to the entity.

    ``texts`` has a row for each text with mentions: context, and how many documents have the text.
    Chances are shares of all documents; ``support`` counts different texts, so copies bear out nothing.
    An entity that is in every document has no information, and nothing discloses it.
    """
    near = texts.select("digest", "copies", F.explode("context").alias("c")).select("digest", "copies", "c.entity", "c.term")
    known = near.filter("term is null").distinct().groupBy("entity").agg(F.sum("copies").alias("n_entity"))
    near = near.filter("term is not null").distinct()
    units = near.withColumn("unit", F.explode(F.array("term", general(F.col("term"))))).select("digest", "copies", "entity", "unit").distinct()
    pairs = units.groupBy("entity", "unit").agg(F.sum("copies").alias("n_both"), F.count("*").alias("n_texts")).filter(F.col("n_texts") >= support)
    pairs = saved(pairs)
    counted = _counted(docs, text_col, saved(pairs.select("unit").distinct())).withColumnRenamed("n", "n_unit")
    total = F.lit(float(docs.count()))
    tells = F.log(total * F.col("n_both") / (F.col("n_entity").cast("double") * F.col("n_unit")))
    own = F.log(total / F.col("n_entity"))
    telling = saved(pairs.join(counted, "unit").join(known, "entity").filter((own > 0) & (tells >= own * share)).select("entity", "unit"))
    terms = telling.filter(~F.col("unit").endswith("*")).withColumnRenamed("unit", "term").withColumn("general", general(F.col("term")))
    wide = telling.filter(F.col("unit").endswith("*")).select("entity", F.col("unit").alias("general"), F.lit(True).alias("tells"))
    return terms.join(wide, ["entity", "general"], "left").select("entity", "term", F.when(F.col("tells"), METHOD[1]).otherwise(METHOD[0]).alias("kind"))


def _method_spans(docs: DataFrame, rows: DataFrame, text_col: str, support: int, share: float) -> DataFrame:
    """(digest, method): kind:start:end of the terms of each text that has any, by kind and start."""
    texts = rows.filter("digest is not null").groupBy("digest").agg(F.first("context").alias("context"), F.count("*").alias("copies"))
    texts = saved(texts)
    known = disclosures(docs, texts, text_col, support, share)
    near = texts.select("digest", F.explode("context").alias("c")).filter("c.term is not null").select("digest", "c.entity", "c.term", "c.start", "c.end")
    hit = near.join(known, ["entity", "term"]).groupBy("digest", "start", "end").agg(F.max("kind").alias("kind"))  # removed, if any entity asks for it
    spans = F.array_sort(F.collect_list(F.struct("kind", "start", "end")))
    joined = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    return saved(hit.groupBy("digest").agg(joined.alias("method")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, share: float = DISCLOSES) -> DataFrame:
    """For each row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end of the
    fixed kinds, then of what is generalised and removed).

    A term is treated where it stands in the reach of a mention of the entity it discloses; a text
    without personal data has no spans.  Null text is empty, a null id stays null, repeated rows give
    repeated rows and count as documents each, an empty table gives an empty one, and other columns
    play no part.  Texts are read whole.
    """
    rows = saved(mentions(docs, id_col, text_col))
    method = _method_spans(docs, rows, text_col, support, share)
    out = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    plain = rows.filter("digest is null").select(*out, F.col("base").alias("spans"))
    met = rows.filter("digest is not null").join(_salted(method), ["digest", "salt"], "left")
    return plain.unionByName(met.select(*out, F.concat_ws(",", "base", "method").alias("spans")))


def _salted(by_text: DataFrame) -> DataFrame:
    """Each row SALT times, so that the copies of one text meet theirs in as many tasks."""
    return by_text.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def mask(text: str, spans: str) -> str:
    """The text with its spans masked: the kind for a fixed one, the beginning of a generalised term, nothing of a removed one."""
    found = sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for a, b, kind in found:
        if b <= at:
            continue
        out.append(text[at : max(a, at)])
        if a >= at:
            out.append(f"[{kind}]" if kind in KINDS else text[a : a + GENERAL] + "*" if kind == "generalised" else "[...]")
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, share: float = DISCLOSES) -> DataFrame:
    """doc_id, text (masked) and spans for each row of ``docs``; nulls and repeats are as in ``scan``, but a null text stays null."""
    rows = saved(mentions(docs, id_col, text_col))
    method = _method_spans(docs, rows, text_col, support, share)
    base = rows.filter("digest is not null").select("digest", "base").distinct()
    spans = base.join(method, "digest", "left").select("digest", F.concat_ws(",", "base", "method").alias("spans"))
    text = F.col(text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), _digest(F.coalesce(text, F.lit(""))).alias("digest"), F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int").alias("salt"))
    met = own.join(_salted(spans), ["digest", "salt"], "left").select("doc_id", "text", F.coalesce("spans", F.lit("")).alias("spans"))

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t if t is None or not s else mask(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2)], names=["doc_id", "text", "spans"])

    return met.mapInArrow(masked, "doc_id long, text string, spans string")

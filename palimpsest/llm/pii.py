"""PII: entities are found and given surrogates (operator 5).

Entities are e-mail addresses, phone numbers, IPv4 addresses, card numbers,
access keys, hexadecimal secrets, passwords and names: up to three capitalised
words after a title, and a known given name with the capitalised word after it.
A word of these that is no known given name is a surname if it is the last, and
else a given name of the title's gender. Other names are not detected. Mentions
of one entity share a canonical form (digits of a phone number, lower case of an
address), so they share a surrogate, which is written back in each mention's own
format. Those that equal a real entity of the corpus or each other, names and
types apart included, are drawn again, with a distributed check of all entities,
until none do. Late draws take a wider format: a given name gets a second part,
other entities more characters, and private addresses another network.

Cases: null texts stay null and have no entities; empty texts have none;
repeated rows are treated alike; an empty table stays empty; texts are read
whole; other columns are carried along.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from palimpsest.llm.common import aside, id_of, read, remove, restored, save, text_of
from palimpsest.llm.surrogates import GENDER, TITLES, surrogate

_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("type", StringType())]))
_NAMES = "|".join(sorted(GENDER))


def _capitals() -> str:
    """Class of the letters that can begin a name: all but the small ones."""
    found = [c for c in range(sys.maxunicode + 1) if chr(c).isalpha() and not chr(c).islower()]
    first = [c for c, before in zip(found, [-1, *found], strict=False) if c != before + 1]
    last = [c for c, after in zip(found, [*found[1:], -1], strict=True) if after != c + 1]
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first, last, strict=True)) + "]"


_WORD = rf"{_capitals()}(?:[^\W\d_]|['’-](?=[^\W\d_]))*"
_TITLES = "|".join(sorted(TITLES, key=len, reverse=True))
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]+@(?:[\w-]+\.)+[A-Za-z]{2,})"
    r"|(?P<ip>(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d))"
    r"|(?P<card>(?<![\d-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{3,4}(?!\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[.-])\d{3,4}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\d))"
    r"|(?P<key>\bAKIA[0-9A-Z]{16}\b)"
    r"|(?:(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s?[=:]\s?[\"']?(?P<secret>[\w+/=-]{6,}))"
    r"|(?P<hex>\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{32,}\b)"
    rf"|(?P<titled>\b(?:{_TITLES})\.? {_WORD}(?: {_WORD}){{0,2}})|(?P<named>\b(?:{_NAMES}) {_WORD})"
)
# A text without any of these characters or letters cannot hold an entity.
_MAY = re.compile(rf"[0-9@]|\b(?:{_NAMES}|{_TITLES})\b|[=:]")
_HEX = re.compile(r"[0-9a-f]+\Z")
# So many redrawn entities at most go to every task; more are joined to their documents.
SHIPPED = 100_000


def find(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Spans with type and canonical form, in order and apart."""
    if not _MAY.search(text):
        return
    for m in PATTERN.finditer(text):
        kind = m.lastgroup
        a, b = m.span(kind)
        said = text[a:b]
        if kind == "email":
            said = said.lower()
        elif kind in ("card", "phone"):
            said = re.sub(r"\D", "", said)
            if kind == "phone" and len(said) == 11 and said[0] == "1":
                said = said[1:]
        elif kind == "secret":
            kind = "hex" if _HEX.match(said) else "secret"
        elif kind in ("titled", "named"):
            words = list(re.finditer(r"\S+", said))
            gender = TITLES[words.pop(0).group().rstrip(".")] if kind == "titled" else ""
            for w in words:
                name = w.group()
                what = ("name", name) if name in GENDER else ("surname", name) if w is words[-1] else ("given", f"{gender}:{name}") if gender else ("surname", name)
                yield a + w.start(), a + w.end(), *what
            continue
        yield a, b, kind, said


def render(mention: str, kind: str, canonical: str, new: str) -> str:
    """The surrogate in the format of one mention."""
    if kind in ("card", "phone"):
        spare = re.sub(r"\D", "", mention)
        digits = iter(spare[: len(spare) - len(canonical)] + new)
        return "".join([*(next(digits) if c.isdigit() else c for c in mention), *digits])  # a wider one ends after the mention's digits
    if kind == "email" and len(new) == len(mention):
        return "".join(n.upper() if c.isupper() else n for c, n in zip(mention, new, strict=True))
    return new


def replace(text: str, key: bytes, drawn: dict[tuple[str, str], int] | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and the spans (in the old text) with their types."""
    out, at, spans = [], 0, []
    for a, b, kind, canonical in find(text):
        new = surrogate(kind, canonical, key, (drawn or {}).get((kind, canonical), 0))
        out += [text[at:a], render(text[a:b], kind, canonical, new)]
        spans.append((a, b, kind))
        at = b
    return ("".join([*out, text[at:]]) if spans else text), spans


def entities(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """Distinct entities of the corpus with their first surrogates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = sorted({(kind, what) for t in batch.column(0).to_pylist() if t for _, _, kind, what in find(t)})
            if seen:
                yield pa.RecordBatch.from_pydict({"kind": [k for k, _ in seen], "what": [w for _, w in seen], "new": [surrogate(k, w, key) for k, w in seen]})

    return docs.select(docs[text].cast("string").alias("t")).mapInArrow(run, "kind string, what string, new string").distinct()


def redrawn(found: DataFrame, key: bytes) -> DataFrame:
    """Entities whose surrogate must be drawn again: ``kind``, ``what``, ``attempt``.

    No surrogate may be a real entity's text or another's surrogate, whatever
    their types. The rounds end when none is: the formats of late draws grow.
    """
    first = found = save(found.withColumn("attempt", F.lit(0)), "entities")
    said = F.when(F.col("kind") == "given", F.substring_index("what", ":", -1)).otherwise(F.col("what"))
    real = first.select(said.alias("new"), F.lit(1).alias("real")).distinct()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_pylist([r | {"new": surrogate(r["kind"], r["what"], key, r["attempt"])} for r in rows], schema=b.schema)

    while True:
        shared = found.groupBy("new").agg(F.min(F.struct("attempt", "kind", "what")).alias("keeper"), F.count("*").alias("n"))
        bad = shared.join(real, "new", "left").where("n > 1 OR real = 1")
        if not bad.limit(1).count():
            break
        marked = found.join(bad.select("new", "keeper", "real"), "new", "left")
        redo = F.col("keeper").isNotNull() & (F.col("real").isNotNull() | (F.struct("attempt", "kind", "what") != F.col("keeper")))
        stepped = marked.withColumn("redo", redo).withColumn("attempt", F.when(F.col("redo"), F.col("attempt") + 1).otherwise(F.col("attempt")))
        fresh = stepped.where("redo").select("kind", "what", "new", "attempt").mapInArrow(again, "kind string, what string, new string, attempt int")
        before, found = found, save(stepped.where("NOT redo").select("kind", "what", "new", "attempt").unionByName(fresh), "entities")
        if before is not first:
            remove(before)
    return found.where("attempt > 0").select("kind", "what", "attempt")


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``_p_spans`` (start, end, type in the old text)."""
    docs, names = aside(docs)
    back = {c: new for new, c in names.items()}
    text, doc_id = back.get(text, text), back.get(doc_id, doc_id)
    drawn = redrawn(entities(docs, key, text), key)
    many = drawn.count() > SHIPPED
    shipped = {} if many else {(r.kind, r.what): r.attempt for r in drawn.collect()}
    source = docs
    if many:  # the documents that hold such an entity get its attempt by a join

        def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(i, h, k, w) for i, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for k, w in sorted({(k, w) for _, _, k, w in find(t)})]
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(("_p_id", "_p_hash", "kind", "what"), map(list, zip(*rows, strict=True)), strict=True)))

        mine = docs.select(id_of(docs, doc_id).alias("_p_id"), F.xxhash64(text_of(docs, text)).alias("_p_hash"), text_of(docs, text).alias("t"))
        by_doc = mine.mapInArrow(mentions, "_p_id long, _p_hash long, kind string, what string").join(drawn, ["kind", "what"]).groupBy("_p_id", "_p_hash").agg(F.collect_set(F.struct("kind", "what", "attempt")).alias("_p_drawn"))
        source = docs.join(by_doc, (id_of(docs, doc_id) == F.col("_p_id")) & (F.xxhash64(text_of(docs, text)) == F.col("_p_hash")), "left").drop("_p_id", "_p_hash")
    else:
        source = docs.withColumn("_p_drawn", F.lit(None).cast("array<struct<kind:string,what:string,attempt:int>>"))
    schema = StructType([*docs.schema.fields, StructField("_p_spans", _SPANS)])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drawn_at, text_at = b.schema.get_field_index("_p_drawn"), b.schema.get_field_index(text)
            new, spans = [], []
            for t, own in zip(b.column(text_at).to_pylist(), b.column(drawn_at).to_pylist(), strict=True):
                said, found = replace(t, key, {(d["kind"], d["what"]): d["attempt"] for d in own or ()} if many else shipped) if t else (t, [])
                new.append(said)
                spans.append([{"start": x, "end": y, "type": k} for x, y, k in found])
            b = b.set_column(text_at, text, pa.array(new, b.column(text_at).type))
            keep = [k for k in range(b.num_columns) if k != drawn_at]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(spans, spans_type)], names=[*(b.schema.names[k] for k in keep), "_p_spans"])

    return restored(source.mapInArrow(run, schema), names)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the text with surrogates, how many, and their types and places."""
    out = pseudonymise(read(spark, sf_dir, "documents"), key=b"palimpsest surrogate key")
    return out.select("doc_id", "text", F.size("_p_spans").cast("long").alias("n_entities"), F.array_join(F.transform("_p_spans", lambda s: F.concat_ws(":", s["type"], s["start"], s["end"])), " ").alias("entities"))

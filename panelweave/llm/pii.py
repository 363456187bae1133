"""Personal data: exact kinds by pattern, and terms that give protected values away.

Values found by pattern (addresses, numbers, secrets such as keys and tokens) are the protected entities. From the whole corpus follows
how much a term tells about an entity: the pointwise mutual information of "the term stands near the
entity" with "the entity occurs", as a share of the entity's own information content. A term with a
share of 1 identifies the entity by itself. Terms over the thresholds are generalised or removed in
the documents where they stand near that entity. What a generalised term becomes says of which class it
is: the kind of value that it discloses, and whether it is written as a name.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names, join_hot, map_rows, slices

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an entity that count as near it.
NEAR = 8
#: Weight, in documents, of the belief that a term says nothing about an entity, to which its counts are added.
PRIOR = 0.5
GENERALISE, REMOVE = 0.75, 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Scripts without spaces between words: each character is a term.
_UNSPACED = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: A run of letters and digits of any length: names of two letters, house and account numbers, postcodes, mixed tokens.
_TERM = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
#: Secrets, an entity kind of the method's own: values assigned to a name that says so, keys of well-known forms, long hexadecimal strings.
_SECRET = re.compile(
    r"""(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd)["']?[ \t]{0,3}[:=][ \t]{0,3}["']?)([^\s"',;]{8,})"""
    r"""|(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,})(?![A-Za-z0-9])"""
)
_SECRET_HINT = re.compile(r"(?i:key|secret|token|passw|pwd)|AKIA|ASIA|gh[pousr]_|xox|[0-9A-Fa-f]{32}")
SECRET = "secret"

_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_NEAR_TYPE = "array<struct<entity:binary,kind:string,term:string,around:binary>>"
_PLACES_TYPE = "array<struct<term:string,at:array<bigint>>>"
_SPANS_TYPE = "array<struct<kind:string,start:bigint,end:bigint>>"


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four kinds in code points, by start, then kind.

    An address is found from its @ sign: the local part reaches back as far as its characters do, but
    not into the address before. So long runs of letters cost one look each.
    """
    out: list[tuple[int, int, str, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            free = m.end()
            out.append((start, 0, "email", free))
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
                out.append((m.start(), 1, "ip", m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, "card", m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((m.start(), 3, "phone", m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def secret_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Secrets that touch none of the spans ``taken``, which go by start."""
    if not _SECRET_HINT.search(text):
        return []
    found = [m.span(1) if m[1] else m.span(2) for m in _SECRET.finditer(text)]
    starts = [s for _, s, _ in taken]
    ends = list(accumulate((e for _, _, e in taken), max))
    return [(SECRET, s, e) for s, e in found if not (i := bisect_left(starts, e)) or ends[i - 1] <= s]


def _nested(offsets: list[int], names: list[str], columns: list[pa.Array]) -> pa.Array:
    """A list of structs for each row, from flat columns."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names))


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids = batch.column("doc_id").to_pylist()
        keys, spans, near, places, near_ends, place_ends = [], [], [], [], [0], [0]
        for doc, text in zip(ids, batch.column("text").to_pylist(), strict=True):
            text = text or ""
            found = base_spans(text)
            found = sorted(found + secret_spans(text, found), key=lambda f: f[1])
            keys.append(xxhash.xxh3_128_digest(f"{doc}\n{text}".encode("utf-8", "surrogatepass")) if found else None)
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            if found:
                n, p = _surroundings(text, found)
                near += n
                places += p
            near_ends.append(len(near))
            place_ends.append(len(places))
        kinds = [pa.binary(), pa.string(), pa.string(), pa.binary()]
        columns = [pa.array([x[i] for x in near], k) for i, k in enumerate(kinds)]
        near_column = _nested(near_ends, ["entity", "kind", "term", "around"], columns)
        place_column = _nested(place_ends, ["term", "at"], [pa.array([t for t, _ in places], pa.string()), pa.array([a for _, a in places], pa.list_(pa.int64()))])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(keys, pa.binary()), pa.array(spans, pa.list_(_SPAN)), near_column, place_column],
            ["doc_id", "text_hash", "row_key", "spans", "near", "places"],
        )


def _surroundings(text: str, found: list[tuple[str, int, int]]) -> tuple[list[tuple], list[tuple]]:
    """(entity, kind, term, digest of what stands around) of the terms near each entity, and (term, all its places) once for each of these terms.

    Of the text's words only the places are held, not the words; a term's places are start and end in turn.
    """
    starts, ends, i, free = array("q"), array("q"), 0, 0
    for m in _TERM.finditer(text):  # both lists go by place
        s, e = m.span()
        while i < len(found) and found[i][1] < e:
            free = max(free, found[i][2])
            i += 1
        if s >= free:
            starts.append(s)
            ends.append(e)
    near: dict[tuple, None] = {}
    terms: dict[str, list[int]] = {}
    for kind, start, end in found:
        k = bisect_left(starts, start)
        around = [text[starts[j] : ends[j]].lower() for j in range(max(0, k - NEAR), min(k + NEAR, len(starts)))]
        entity = xxhash.xxh3_128_digest(f"{kind}:{text[start:end].lower()}".encode("utf-8", "surrogatepass"))
        digest = xxhash.xxh3_128_digest(" ".join(around).encode("utf-8", "surrogatepass"))
        for w in dict.fromkeys(around):
            terms.setdefault(w, [])
            near[entity, kind, w, digest] = None
    for s, e in zip(starts, ends, strict=True):
        at = terms.get(text[s:e].lower())
        if at is not None:
            at += (s, e)
    return list(near), list(terms.items())


def _document_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.float64())], ["term", "n"])
        counts.clear()
        return out

    for batch in slices(batches):
        for text, weight in zip(batch.column("text").to_pylist(), batch.column("weight").to_pylist(), strict=True):
            if text:
                for w in {w.lower() for w in set(_TERM.findall(text))}:
                    counts[w] += weight
        if len(counts) > 250_000:
            yield flush()
    yield flush()


def _text_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        hashes, terms = [], []
        for key, text in zip(batch.column("text_hash").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = {w.lower() for w in set(_TERM.findall(text or ""))}
            terms += found
            hashes += [key] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(terms, pa.string())], ["text_hash", "term"])


def telling_terms(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, kind, term, n_both, share): how much of the entity's information content the term discloses.

    Counts are over all documents, and nothing needs a least count. Equal texts count once. A witness
    is a surrounding of the entity, and no text is more than one, so that copies of a passage are one
    witness. The term's count is that of its witnesses and of the texts with the term elsewhere. The
    chance of the entity given the term starts at the entity's own, with the weight of PRIOR documents.
    """
    near = found.where("row_key is not null").select("text_hash", F.explode("near").alias("x")).select("text_hash", "x.*")
    witnesses = F.least(F.count_distinct("around"), F.count_distinct("text_hash"))
    pairs = cut(near.groupBy("entity", "kind", "term").agg(witnesses.alias("k"), F.count_distinct("text_hash").alias("n_both"), F.count(F.lit(1)).alias("n_rows")))
    of_entity = cut(near.groupBy("entity").agg(witnesses.alias("n_entity"), F.count_distinct("term").alias("n_terms")))
    copies = cut(found.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    terms = cut(pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n_pairs")))
    if copies.count() <= 200_000:
        weighted = docs.join(F.broadcast(copies), "text_hash", "left").select("text", F.coalesce(1 / F.col("copies"), F.lit(1.0)).alias("weight"))
        counted = weighted.mapInArrow(_document_terms, "term string, n double")
        # added up before the join with the terms asked for: each task has most of these, so their matches would grow with tasks x terms
        of_term = counted.groupBy("term").agg(F.round(F.sum("n"), 6).alias("n_term"))
    else:  # texts are not shuffled to find their copies: their hashes are, with the terms that are asked for
        asked = F.broadcast(terms.select("term")) if terms.count() <= 200_000 else terms.select("term")
        counted = docs.select("text_hash", "text").mapInArrow(_text_terms, "text_hash long, term string").join(asked, "term", "left_semi")
        of_term = counted.groupBy("term").agg(F.count_distinct("text_hash").cast("double").alias("n_term"))
    of_term = cut(of_term.join(terms, "term"))
    total = F.lit(float(found.count() - (copies.agg(F.sum(F.col("copies") - 1)).first()[0] or 0)))
    bits = F.log(total / F.col("n_entity"))
    elsewhere = F.greatest(F.col("n_term") - F.col("n_both"), F.lit(0.0))
    given = (F.col("k") + PRIOR * F.col("n_entity") / total) / (F.col("k") + elsewhere + PRIOR)
    share = F.when(bits > 0, F.log(given * total / F.col("n_entity")) / bits).otherwise(0.0)
    known = join_hot(join_hot(pairs, of_term, ["term"], "n_pairs"), of_entity, ["entity"], "n_terms")
    return known.select("entity", "kind", "term", "n_rows", share.alias("share"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (xxhash64) and ``spans`` (kind, start, end) of each row of ``docs`` (doc_id, text), by start, then kind.

    Terms are runs of letters and digits, in Chinese and Japanese writing single characters; they are compared in lower case.
    Texts of any length are read whole; of their terms only places are held.

    Kinds are email, ip, card and phone, then secret, and for the terms that disclose such a value
    term_removed or, generalised, term_ and the kind of the value. Terms and secrets never overlap the
    others. Null and empty texts have no spans. Repeated rows and rows without an id are documents of
    their own; other columns are ignored, and an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    found = cut(docs.mapInArrow(_find, f"doc_id long, text_hash long, row_key binary, spans {_SPANS_TYPE}, near {_NEAR_TYPE}, places {_PLACES_TYPE}"))
    telling = cut(telling_terms(found, docs).where(F.col("share") >= GENERALISE))
    near = found.where("row_key is not null").select("row_key", F.explode("near").alias("x")).select("row_key", "x.entity", "x.kind", "x.term")
    hits = join_hot(near, telling, ["entity", "kind", "term"], "n_rows").groupBy("row_key", "term").agg(F.max(F.struct("share", "kind")).alias("most"))
    kind = F.when(F.col("most.share") >= REMOVE, "term_removed").otherwise(F.concat(F.lit("term_"), "most.kind"))
    by_row = hits.select("row_key", F.struct("term", kind.alias("kind")).alias("h")).groupBy("row_key").agg(F.map_from_entries(F.collect_list("h")).alias("kinds"))

    def term_spans(p: Column) -> Column:
        pairs = F.sequence(F.lit(0), (F.size(p["at"]) / 2).cast("int") - 1)
        return F.transform(pairs, lambda i: F.struct(F.col("kinds")[p["term"]].alias("kind"), F.get(p["at"], 2 * i).alias("start"), F.get(p["at"], 2 * i + 1).alias("end")))

    telling_places = F.filter("places", lambda p: F.map_contains_key("kinds", p["term"]))
    more = F.when(F.col("kinds").isNotNull(), F.flatten(F.transform(telling_places, term_spans))).otherwise(F.array().cast(_SPANS_TYPE))
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    order = F.array_sort(F.transform(F.concat("spans", more), lambda s: F.struct(s["start"].alias("start"), F.when(rank(s) == 0, 9).otherwise(rank(s)).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    # rows without an entity have no key: in the join they would all meet in one task
    out = found.where("row_key is not null").select("row_key", "doc_id", "text_hash", "spans", "places").join(by_row, "row_key", "left")
    out = out.select("doc_id", "text_hash", F.transform(order, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    return out.unionByName(found.where("row_key is null").select("doc_id", "text_hash", "spans"))


def spans_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _mark(kind: str, value: str) -> str:
    """What stands for a span: nothing for a removed term, the class of a generalised one, else the kind."""
    if kind == "term_removed":
        return ""
    return f"[{kind[5:].upper()} {'NAME' if value[:1].isupper() else 'WORD'}]" if kind.startswith("term_") else f"[{kind.upper()}]"


def _redacted(spans_name: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(spans_name).to_pylist(), strict=True):
                if spans:
                    parts, at = [], 0
                    for s in spans:
                        if s["end"] > at:
                            start = max(at, s["start"])
                            parts += [text[at:start], _mark(s["kind"], text[start : s["end"]])]
                            at = s["end"]
                    text = "".join(parts) + text[at:]
                out.append(text)
            names = [n for n in batch.schema.names if n != spans_name]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in names], names)

    return run


def redact_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; removed terms leave nothing.

    Only texts with spans change; null and empty texts stay as they are. Rows that share a doc_id, also
    a null one, and a text change alike. Other columns may have any names and stay; an empty table
    gives an empty result. Where few documents have spans they are broadcast, so that texts need no
    shuffle.
    """
    doc, digest, name = free_names(docs.columns, "id", "hash", "spans")
    spans = find_personal_data(docs).where(F.size("spans") > 0)
    spans = cut(spans.groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(digest)).agg(F.any_value("spans").alias(name)))
    size = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(name)), F.lit(0))).first()
    side = F.broadcast(spans) if size[0] * 32 + size[1] * 48 <= 32 << 20 else spans
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(digest))
    joined = docs.join(side, same, "left").select(*(f"`{c}`" for c in docs.columns), name)
    return map_rows(joined, _redacted(name), drop=(name,))

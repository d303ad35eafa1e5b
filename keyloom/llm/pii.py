"""Personal data: fixed patterns, and information-theoretic sanitisation of the words around them.

The patterns find protected entities (e-mail, IP, card and phone numbers). For the WINDOW words on each side of their
mentions, corpus counts estimate how much of an entity's information a word gives away: PMI(word; entity) / IC(entity),
where IC = log2(N / n_e) and PMI = log2(n_we N / (n_w n_e)), n_we counting the documents in which the word stands near
the entity. Every pair is scored, also that of an entity or word found in one document.

A word beyond the first threshold is generalised along a ladder: to the longest of its beginnings (LADDER letters, as a
class of all words that begin so) which gives away less than that threshold. If none does, only the kind of word is
left ([NAME], [WORD]), or nothing, if the word itself is beyond the second threshold. What is decided about a word near
an entity holds for all its places in that text.

All counts are over all documents. Pairs are (entity, one of the 2 * WINDOW words beside a mention), so they grow with
the mentions, however often an entity or a word occurs.

Cases: null text is the empty text; very long texts are read whole, in linear time; repeated rows count as documents
of their own and get equal spans; null doc_ids are kept; an empty table gives no rows; extra columns of any name are
kept by `sanitise`.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import Scratch, row_key
from keyloom.llm.shingles import let_go, release

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of a mention, and the shares of an entity's information from which a word is generalised and
#: removed.
WINDOW, GENERALISE, REMOVE = 6, 0.6, 0.9
#: Letters of a word that its classes keep, from the most specific on.
LADDER = (4, 2)
#: Rows up to which a small side is broadcast; beyond, it is joined by shuffle.
SMALL = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the longest run of local characters before it that no earlier match has taken."""
    last, at = 0, text.find("@")
    while at >= 0:
        m, start = _DOMAIN.match(text, at + 1), at
        if m:
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                last = m.end()
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def find_base(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, leftmost and non-overlapping per kind; code points, end exclusive."""
    out = {"email": list(emails(text)), "ip": [], "card": [], "phone": []}
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split("."))):
                out["ip"].append(m.span())
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out["phone"].append(m.span())
    return out


def entity(kind: str, text: str) -> str:
    return f"{kind}:{text.lower() if kind in ('email', 'ip') else _NOT_DIGIT.sub('', text)}"


def classes(word: str) -> list[str]:
    """The classes of a word, the most specific first."""
    return [word[:n] + "*" for n in LADDER if len(word) > n]


def contexts(text: str, base: dict[str, list[tuple[int, int]]]) -> tuple[set[tuple[str, str]], list[tuple[str, int, int]]]:
    """The pairs (entity, word or class of a word) beside the mentions, and every place of these words in the text."""
    taken = sorted(s for spans in base.values() for s in spans)
    words, at, reach = [], 0, -1
    for m in _WORD.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach, at = max(reach, taken[at][1]), at + 1
        if m.start() >= reach:
            words.append((m[0].lower(), m.start(), m.end()))
    starts, ends = [w[1] for w in words], [w[2] for w in words]
    pairs = set()
    for kind in KINDS:
        for a, b in base[kind]:
            who, i, j = entity(kind, text[a:b]), bisect_right(ends, a), bisect_left(starts, b)
            for word, _, _ in words[max(i - WINDOW, 0) : i] + words[j : j + WINDOW]:
                pairs.add((who, word))
                pairs.update((who, c) for c in classes(word))
    near = {w for _, w in pairs}
    return pairs, [w for w in words if w[0] in near]


FOUND = "_d long, _k long, doc_id bigint, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<string>, contexts array<struct<entity:string,term:string>>, places array<struct<term:string,start:int,end:int>>"
_PA = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())])), pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))]


def find(docs: DataFrame) -> DataFrame:
    """Base spans, entities and contexts of each whole text of (doc_id, text); (_d, _k) names the row by its content."""
    names = ["_d", "_k", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "entities", "contexts", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            out = []
            for d, k, doc, text in zip(*(b.column(c).to_pylist() for c in ("_d", "_k", "doc_id", "text")), strict=True):
                text = text or ""
                base = find_base(text)
                spans = ",".join(f"{kind}:{s}:{e}" for kind in KINDS for s, e in base[kind])
                pairs, places = contexts(text, base) if spans else ((), ())
                who = list({entity(kind, text[s:e]) for kind in KINDS for s, e in base[kind]})
                out.append((d, k, doc, *(len(base[kind]) for kind in KINDS), spans, who, [dict(zip(("entity", "term"), x, strict=True)) for x in pairs], [dict(zip(("term", "start", "end"), x, strict=True)) for x in places]))
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _PA, strict=True)], names=names)
        release()

    return docs.select(*row_key(), F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, FOUND)


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): documents that hold each of the terms, a table of distinct words and classes. Few enough terms go to
    the workers as a set; else every word is counted and the join with the terms comes after."""
    n = terms.count()
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(terms.toArrow().column(0).to_pylist())) if n <= SMALL else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])
            seen.clear()
            return rows

        for b in batches:
            for text in b.column("text").to_pylist():
                words = {w.lower() for w in set(_WORD.findall(text))} if text else set()
                words.update(*({w[:n] + "*" for w in words if len(w) > n} for n in LADDER))
                seen.update(words if wanted is None else wanted.value & words)
                if len(seen) > SMALL:
                    yield out()
        yield out()
        release()

    counted = docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return counted if wanted is not None else counted.join(terms, "term", "left_semi")


ROW = ["_d", "_k"]


def risky_spans(docs: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(_d, _k, terms): per row the disclosing words as sorted array of (start, end, to).

    to: the class that takes the word's place, `?` for its kind, empty if it is removed.
    """
    near = scratch.keep(found.where(F.size("contexts") > 0).select(*ROW, F.explode("contexts").alias("c")).select(*ROW, "c.*"))
    pairs = scratch.keep(near.groupBy("entity", "term").agg(F.count("*").alias("n_both")))
    total = found.count()
    who = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    words = document_counts(docs, pairs.select("term").distinct())
    both = pairs.join(who, "entity").join(words, "term").where(F.col("n_entity") < total)
    information = F.log2(F.lit(float(total)) / F.col("n_entity"))
    share = F.log2(F.col("n_both") * float(total) / (F.col("n") * F.col("n_entity"))) / information
    scored = scratch.keep(both.select("entity", "term", share.alias("share")))
    risky = scored.where((F.col("share") >= GENERALISE) & ~F.endswith("term", F.lit("*")))
    ladder = []
    for n in LADDER:
        general = scored.where(F.col("share") < GENERALISE).select("entity", F.col("term").alias(f"_c{n}"), F.lit(True).alias(f"_ok{n}"))
        risky = risky.withColumn(f"_c{n}", F.when(F.length("term") > n, F.concat(F.substring("term", 1, n), F.lit("*")))).join(general, ["entity", f"_c{n}"], "left")
        ladder.append(F.when(F.col(f"_ok{n}"), F.col(f"_c{n}")))
    to = F.coalesce(*ladder, F.when(F.col("share") < REMOVE, "?"), F.lit(""))
    risky = scratch.keep(risky.select("entity", "term", to.alias("to")))
    hits = near.join(risky, ["entity", "term"]).groupBy(*ROW, "term").agg(F.min("to").alias("to"))  # the most general
    places = found.where(F.size("places") > 0).select(*ROW, F.explode("places").alias("p")).select(*ROW, "p.*").distinct()
    marked = places.join(hits, [*ROW, "term"])
    return scratch.keep(marked.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("start", "end", "to"))).alias("terms")))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_*, base, spans) of every document (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(find(docs))
    terms = risky_spans(docs, found, scratch)
    listed = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string")))
    joined = found.drop("entities", "contexts", "places").join(terms.select(*ROW, F.array_join(listed, ",").alias("_t")), ROW, "left")
    both = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.col("_t"))
    return joined.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", both.alias("spans"))


def redact(text: str, base: dict[str, list[tuple[int, int]]], terms: list[dict]) -> str:
    """The text with base spans named by their kind, disclosing words generalised or removed. Where spans overlap, the
    one that starts first covers the others."""
    marks = [(s, e, f"[{kind.upper()}]") for kind in KINDS for s, e in base[kind]]
    for t in terms:
        s, to = t["start"], t["to"]
        marks.append((s, t["end"], text[s : s + len(to) - 1] + "*" if len(to) > 1 else to and ("[NAME]" if text[s].isupper() else "[WORD]")))
    out, at = [], 0
    for s, e, name in sorted(marks):
        if s >= at:
            out += [text[at:s], name]
        at = max(at, e)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with `text` sanitised; null texts stay null."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(find(docs.select("doc_id", "text")))
    terms = risky_spans(docs.select("doc_id", "text"), found, scratch)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *row_key())
    n = terms.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    joined = keyed.join(F.broadcast(terms) if n <= SMALL else terms, ROW, "left").select("row", "terms")
    schema = T.StructType([docs.schema[c] for c in docs.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = dict(zip(schema.names, b.column("row").flatten(), strict=True))
            texts = [t and redact(t, find_base(t), own or []) for t, own in zip(row["text"].to_pylist(), b.column("terms").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else row[c] for c in schema.names], names=schema.names)
        release()

    return joined.mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")

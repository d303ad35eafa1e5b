"""PII, quality rules, licence scan and Jaccard join against brute force."""

import hashlib
import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from keyloom.llm import jaccard, licenses, pii, quality

SP = "\x20\x09-\x0d"


def _sorted(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def _plain_base(t):
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)], "ip": [], "card": [], "phone": []}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in m[0] if x.isdigit()]
        s = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out["card"].append(m.span())
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_pii_base_spans(docs, rows, empty):
    got = pii.digests(pii.spans(docs))
    want = []
    for i, _, t in rows:
        b = _plain_base(t or "") if not set(t or "") <= {"x"} else {k: [] for k in pii.KINDS}  # where plain patterns take quadratic time
        s = ",".join(f"{k}:{x}:{y}" for k in pii.KINDS for x, y in b[k])
        want.append((i, *(len(b[k]) for k in pii.KINDS), hashlib.sha256(s.encode()).hexdigest()))
    assert _sorted(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)
    assert sum(r[1] for r in want) and sum(r[2] for r in want) and sum(r[3] for r in want) and sum(r[4] for r in want)
    assert pii.spans(empty).count() == 0 and pii.sanitise(empty).count() == 0


def test_pii_disclosing_words(spark):
    texts = [(i, f"filler number{'abc'[i % 3]} common talk") for i in range(40)]
    texts += [(100 + i, "write to Zarquon Blint at zb@mail.example now common talk") for i in range(5)] + [(200, "common talk of Blint alone"), (201, None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("terms", F.lit("clash"))
    spans = {r["doc_id"]: r["spans"] for r in pii.spans(docs).collect()}
    t = texts[40][1]
    assert f"term:{t.index('Zarquon')}:{t.index('Zarquon') + 7}" in spans[100] and spans[100].startswith("email:")
    assert f":{t.index('common')}:" not in spans[100] and spans[200] == "" and spans[201] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs.selectExpr("*", "1 AS _k", "2 AS _d", "3 AS row", "4 AS places", "5 AS `to`")).collect()}
    assert "zb@" not in clean[100] and "Zarquon" not in clean[100] and "common talk" in clean[100] and "[EMAIL]" in clean[100]
    assert clean[201] is None and clean[0] == texts[0][1]
    # brute-force counts
    n = len(texts)
    word = Counter(w for _, x in texts for w in set(re.findall(r"[^\W\d_]+", (x or "").lower())))
    from math import log2

    share = log2(5 * n / (word["blint"] * 5)) / log2(n / 5)
    assert (pii.GENERALISE <= share < pii.REMOVE) == ("[NAME] at" in clean[100])


def test_pii_rare_entities(spark):
    """Entities of one or two documents, each pair by brute force."""
    from math import log2

    texts = ["filler common talk of rooms"] * 60 + ["Jane Roe <jane@x.org> common talk", "call Ada Quill at +1 555 123 4567 common", "ask Ada Quill at +1 555 123 4567 for rooms", "rooms common talk of Roe"]
    spans = {r["doc_id"]: r["spans"] for r in pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    held = [set(re.findall(r"[^\W\d_]+", t.lower())) for t in texts]
    for docs in ([60], [61, 62]):
        for i in docs:
            own = []
            for m in re.finditer(r"[A-Za-z]+", texts[i].replace("<jane@x.org>", " " * 12)):
                w = m[0].lower()
                share = log2(sum(w in held[j] for j in docs) * len(texts) / (sum(w in h for h in held) * len(docs))) / log2(len(texts) / len(docs))
                own += [f"term:{m.start()}:{m.end()}"] if share >= pii.GENERALISE else []
            assert [x for x in spans[i].split(",") if x.startswith("term")] == own and len(own) >= 2
    assert "term:0:4" in spans[60] and spans[63] == ""


def test_pii_far_words_and_ladder(spark):
    """Words beyond any number of characters, of one letter, at all places of a text; classes that give away less."""
    long = "q" * 400
    texts = [f"plain talk {w} of rooms" for w in ("zarat", "zarine", "zarodo", "zaruma", "zebra") for _ in range(8)]
    texts += [f"Zarquon Li {long} {long} {long} to zb@mail.example {long} o\u00e9 X end. Then again Zarquon and Li of rooms"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    t, at = texts[-1], len(texts) - 1
    spans = {r["doc_id"]: r["spans"] for r in pii.spans(docs).collect()}[at].split(",")
    for w in ("Zarquon", "Li"):
        assert all(f"term:{m.start()}:{m.end()}" in spans for m in re.finditer(w, t)) and t.count(w) == 2
    assert f"term:{t.index(' X ') + 1}:{t.index(' X ') + 2}" in spans and f"term:{t.index('rooms')}:{t.index('rooms') + 5}" not in spans
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[at].startswith("Za* ") and "Zarquon" not in clean[at] and "Li" not in clean[at] and clean[0] == texts[0]


def test_pii_in_long_texts(spark):
    body = "lorem ipsum dolor " * 30_000
    texts = [body + "reach me at ann@site.example or +1 (555) 123-4567 " + body + "10.0.0.7 and 4111 1111 1111 1111", body]
    got = {r["doc_id"]: r for r in pii.digests(pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))).collect()}
    for i, t in enumerate(texts):
        b = _plain_base(t)
        s = ",".join(f"{k}:{x}:{y}" for k in pii.KINDS for x, y in b[k])
        assert got[i]["base_sha256"] == hashlib.sha256(s.encode()).hexdigest()
    assert tuple(got[0][f"n_{k}"] for k in pii.KINDS) == (1, 1, 1, 1)


def _rules(t):
    words = re.findall(f"[^{SP}]+", t)
    three = Counter(zip(words, words[1:], words[2:]))
    cover = set()
    for i in range(len(words) - 2):
        if three[tuple(words[i : i + 3])] >= 2:
            cover |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(f"[^{SP}]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)


def test_quality_rules(spark, docs, rows, empty):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.train(docs, labels)
    got = quality.judge(docs, model)
    assert "n" in got.columns and got.count() == len(rows)
    want = [(i, *(r := _rules(t or "")), r[0] < 50 or 100 * r[4] > 50 * r[0]) for i, _, t in rows]
    assert _sorted(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert got.where("kept AND base_failed").count() == 0
    assert quality.judge(empty, model).count() == 0
    one = quality.fit(["a b c d e", "f g h"] * 3, [1] * 6)
    assert quality.judge(docs, one).where("kept <> (NOT base_failed)").count() == 0


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train(docs.where("doc_id % 2 = 0"), labels)
    got = quality.judge(docs.where("doc_id % 2 = 1").select("doc_id", "text").join(labels, "doc_id"), model).where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept"), F.count("*").alias("n"))
    kept = {r["quality"]: r["kept"] for r in got.collect()}
    assert kept[1] > 0.99 and kept[0] < 0.1


def test_license_base(docs, rows, empty):
    got = licenses.scan(docs)
    want = []
    for i, _, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            hit = [j for j in range(len(words) - len(p) + 1) if words[j : j + len(p)] == p]
            at += hit
            labels |= {label} if hit else set()
        want.append((i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert _sorted(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    assert any(w[2] for w in want)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got.collect())
    assert licenses.scan(empty).count() == 0


def test_license_notices(spark):
    t = licenses.TEMPLATES
    near = t["gpl"].replace("useful", "of use").replace("hope", "wish").title()
    docs = spark.createDataFrame([(1, "Intro. " + t["mit"]), (2, near), (3, " ".join(reversed(t["bsd"].split()))), (4, t["apache"].replace("licensed under the apache license", "")), (5, "license " * 5000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert got[1]["labels"] == "mit" and got[1]["score"] == 1.0 and got[1]["base_labels"] == ""
    assert "gpl" in got[2]["labels"].split(",") and got[3]["labels"] == "" and "apache" not in got[4]["labels"].split(",") and got[5]["labels"] == ""


def test_license_several_in_a_file(spark):
    """Every notice of a file is found beside every other and every mention, whatever words the others hold."""
    t = licenses.TEMPLATES
    full, mentions = [n for n in t if not n.endswith("-mention")], [n for n in t if n.endswith("-mention")]
    files = [(a, b) for a in full for b in mentions] + [tuple(full), tuple(t)] + list(combinations(full, 2))
    docs = spark.createDataFrame([(i, " and here follows some other prose ".join(t[n] for n in f)) for i, f in enumerate(files)], "doc_id bigint, text string")
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan(docs).collect()}
    assert [(f, set(f) - got[i]) for i, f in enumerate(files) if set(f) - got[i]] == []


def _sets(rows):
    out = []
    for _, _, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(f"[^{SP}]+", low)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def _brute(rows):
    sets = _sets(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    names = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return [(d, len(sets[i]), names.get(find(i), d) if sets[i] else d) for i, (d, _, _) in enumerate(rows)]


def test_structured_words_do_not_link(spark):
    from tests.llm.test_tokens import thue_morse

    rows = [(i, w) for i, w in enumerate(w for bits in range(10, 13) for w in thue_morse(bits))] + [(100 + i, " ".join(w)) for i, w in enumerate(thue_morse(7))]
    want = _brute([(i, None, t) for i, t in rows])
    assert _sorted(jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string")), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS _k", "2 AS _d", "3 AS root", "4 AS copies"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in want}) and len({c for _, _, c in want}) >= 7 and {"_k", "_d", "root", "copies"} <= set(kept.columns)


def test_jaccard_components(spark, docs, rows, empty):
    assert _sorted(jaccard.join(docs), "doc_id", "n_shingles", "component_id") == sorted(_brute(rows), key=repr)
    assert jaccard.join(empty).count() == 0


def test_jaccard_near_copies(spark, monkeypatch):
    """Edited copies around the threshold, chains of them, a shared passage, and small blocks so that groups split."""
    import random

    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "QUERIES", 2)
    monkeypatch.setattr(jaccard, "HOT_AT", 6)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(30)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(r.choice([8, 25, 60, 200]))] + (passage if g % 3 == 0 else [])
        cur = base
        for _ in range(r.choice([1, 2, 9])):
            rows.append((len(rows), None, " ".join(cur)))
            cur = list(cur if r.random() < 0.5 else base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                cur[r.randrange(len(cur))] = word()
    docs = spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id bigint, text string")
    assert _sorted(jaccard.join(docs), "doc_id", "n_shingles", "component_id") == sorted(_brute(rows), key=repr)
    kept = sorted(x["doc_id"] for x in jaccard.keep_one(docs).collect())
    assert kept == sorted({c for _, _, c in _brute(rows)})


def test_keep_one_of_equal_rows(docs):
    kept = [r["doc_id"] for r in jaccard.keep_one(docs).collect()]
    assert kept.count(900007) == 1 and kept.count(900012) == 1 and kept.count(900013) == 0 and kept.count(900001) == 1

"""The pipeline against a brute-force run of its stages."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from keyloom.llm import mixing, pii, quality
from keyloom.llm.shingles import hash_words
from tests.llm.conftest import SF
from tests.llm.test_tables import _targets
from tests.llm.test_text import _brute, _plain_base, _rules


def test_stage_order_and_columns(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "pii_sanitise", "source_mix", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    assert corpus_pipeline.byte_bpe(spark, docs, SF).where("NOT round_trip").count() == 0


def test_stages_by_brute_force(spark, docs, tmp_path):
    """Each stage on all that its predecessor kept."""
    now = docs
    rows = lambda df: [(r["doc_id"], r["source"], r["text"]) for r in df.collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = rows(now)
        out = stage(spark, now, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "quality_rules":
            model, want = quality.train(now, spark.read.parquet(f"{SF}/labels.parquet")), []
            for r in before:
                c = _rules(r[2] or "")
                if c[0] >= 50 and 2 * c[4] <= c[0] and model.probability(quality.grams(r[2] or "", hash_words([r[2]], lower=False)[0])) >= quality.KEEP_AT:
                    want.append(r)
            assert Counter(rows(out)) == Counter(want)
        elif name == "jaccard_join":
            groups = {c for d, n, c in _brute(before) if n}
            assert Counter(r[0] for r in rows(out)) == Counter(groups)
            assert set(rows(out)) <= set(before)
        elif name == "pii_sanitise":
            after = {r[0]: r[2] for r in rows(out)}
            assert set(after) == {r[0] for r in before}
            for i, _, t in before:
                base = _plain_base(t)
                if not any(base.values()):
                    assert after[i] == t
                for k in pii.KINDS:
                    assert not any(t[a:b] in after[i] for a, b in base[k])
        elif name == "source_mix":
            size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
            total, taken = defaultdict(int), defaultdict(int)
            for _, s, t in before:
                total[s] += size(t)
            for _, s, t in rows(out):
                taken[s] += size(t)
            want, largest = _targets(total), max(size(t) for _, _, t in before)
            assert all(abs(taken[s] - want[s]) <= largest for s in want)
            assert max(Counter(rows(out)).values()) <= mixing.COPIES and set(rows(out)) <= set(before)
        else:
            with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            want = Counter((i, len(ids := enc.encode_ordinary(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, _, t in before)
            assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()) == want
        now = out


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where("NOT round_trip").count() == 0

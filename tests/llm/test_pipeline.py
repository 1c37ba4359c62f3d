"""The pipeline's stages against brute force on a small folder, each on the rows of the stage before."""

import hashlib
import re

import tiktoken

import corpus_pipeline as C
from pkgaudit.llm import byte_bpe as B
from pkgaudit.llm import quality_classifier as Q
from pkgaudit.llm.common import stored, table
from tests.llm.test_mixing_and_sharding import brute_targets
from tests.llm.test_near_and_exact import brute_components, normal


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    given = docs.collect()

    rejected = {r.doc_id for r in Q.op6_quality_classifier(spark, sf_dir).collect() if not r.predicted}
    good = stored(C.reject_poor(spark, docs, sf_dir))
    assert good.columns == columns
    left = [r for r in given if r.doc_id not in rejected]
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in left)

    least = {}
    for r in left:
        least[normal(r.text)] = min(least.get(normal(r.text), r.doc_id), r.doc_id)
    single = stored(C.drop_copies(spark, good, sf_dir))
    left = [r for r in left if least[normal(r.text)] == r.doc_id]
    assert single.columns == columns
    assert sorted(map(tuple, single.collect())) == sorted(map(tuple, left))

    kept = {i for i, _, c in brute_components([(r.doc_id, r.text, r.source) for r in left]) if i == c}
    apart = stored(C.drop_near_copies(spark, single, sf_dir))
    left = [r for r in left if r.doc_id in kept]
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, left))

    mixed = stored(C.mix_sources(spark, apart, sf_dir))
    assert mixed.columns == columns
    texts, taken = {r.doc_id: r for r in left}, {}
    for r in mixed.collect():
        own = texts[r.doc_id]
        if r.text != own.text:
            assert words(r.text) == words(own.text)[:len(words(r.text))] and r.n_chars == len(r.text)
        taken.setdefault(r.source, {}).setdefault(r.doc_id, []).append(len(words(r.text)))
    _, targets = brute_targets([(r.doc_id, r.text, r.source) for r in left])
    for source, target in targets.items():
        assert sum(sum(x) for x in taken.get(source, {}).values()) == int(target + 1e-6)
        assert all(sum(x) <= 2 * len(words(texts[d].text)) for d, x in taken.get(source, {}).items())

    known = tiktoken.Encoding("k", pat_str=B.split_pattern(), mergeable_ranks=B.read_ranks(B.vocabulary_path()), special_tokens={})
    coded = C.encode(spark, mixed, sf_dir).collect()
    want = sorted((r.doc_id, known.encode_ordinary(r.text)) for r in mixed.collect())
    assert sorted((r.doc_id, list(r.input_ids)) for r in coded) == want
    digests = sorted((r.doc_id, r.decoded_sha256) for r in coded)
    assert digests == sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect())


def test_odd_rows_and_empty_tables(spark, odd, nothing, sf_dir):
    for _, stage in C.STAGES[1:]:
        assert stage(spark, nothing, sf_dir).count() == 0
        out = stage(spark, odd, sf_dir)
        assert stage is C.encode or out.columns == odd.columns
        assert out.count() > 0
    assert C.reject_poor(spark, nothing, sf_dir).count() == 0
    assert C.reject_poor(spark, odd, sf_dir).columns == odd.columns

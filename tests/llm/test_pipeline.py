"""The corpus pipeline against a plain walk through the same decisions, and its registration."""

import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from conftest import SF_SMALL
from helpers import DOC, clashing, docs, no_docs, rows  # noqa: F401
from test_near_dup import brute

import __spark_entry__ as E
from labelflow.llm import quality, toxicity
from labelflow.llm.common import stored, table
from labelflow.llm.words import WordHash

WS = re.compile(r"[\x20\x09-\x0D]")


def walk(docs, good, tox):
    """Documents (doc_id, text) that are left after the four filtering stages."""
    left = []
    for d, t in docs:
        c, f = quality.statistics(t or "", WordHash())
        if c[0] >= 50 and 100 * c[4] <= 50 * c[0] and (not len(good.feature) or good.probability(np.array([f]))[0] >= 0.5) and tox.score(t or "") < 0.7:
            left.append((d, t))
    groups = defaultdict(list)
    for d, t in left:
        groups[WS.sub("", t)].append((d, t))
    left = [min(v, key=lambda r: (-len(r[1]), r[0])) for v in groups.values()]
    return [(d, t) for (d, t), (_, c, _) in zip(left, brute(left)) if d == c]


def test_pipeline_equals_the_walk(spark):
    docs_, labels = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")
    want = walk([(r.doc_id, r.text) for r in docs_.select("doc_id", "text").collect()], quality.fit_quality(docs_, labels), toxicity.fit_toxicity(docs_, labels))
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = set()
    for d, t in want:
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        pieces |= {(d, s, min(2048, len(ids) - s), zlib.crc32(np.array(ids[s:s + 2048], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 2048)}
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert 0 < len(want) < docs_.count()
    assert {tuple(r)[:5] for r in got} == pieces and len(got) == len(pieces)


@pytest.mark.parametrize("which", ["clashing", "no_docs"])
def test_stages_keep_columns(spark, which, request, tmpdir_path):
    docs_ = request.getfixturevalue(which)
    docs_.write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmpdir_path}/labels.parquet")
    at = docs_
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stored(stage(spark, at, tmpdir_path), f"test-{name}")
        assert at.schema.names == docs_.schema.names
    n = at.count()
    assert n > 0 if which == "clashing" else n == 0
    assert corpus_pipeline.STAGES[-1][1](spark, at, tmpdir_path).count() >= n


def test_registered():
    names = E.queries()
    assert [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "exact_dedup", "near_dup", "packing"]
    assert set(E.oracle_sql()) <= set(names)

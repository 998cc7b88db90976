"""The queries against their SQL, and the pipeline's stages against plain versions."""

from __future__ import annotations

import os
import re
import sys

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fixtures import awkward, empty  # noqa: E402
from oracle import assert_same, run_sql  # noqa: E402

import corpus_pipeline  # noqa: E402
from voxloom.llm import mixing, registry, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_by_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), run_sql(SF, registry.SQL[name]))


def test_every_operator_is_registered():
    numbers = [int(m[1]) for k in registry.QUERIES if (m := re.match(r"op(\d+)_", k))]
    assert sorted(numbers) == list(range(1, 14))


def test_stages_keep_columns_on_awkward_tables(spark):
    for docs in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_run_of_awkward_tables(spark, tmp_path):
    for name, docs in (("awkward", awkward(spark)), ("empty", empty(spark))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert (out.count() > 0) == (name == "awkward")


def test_run_equals_its_stages_by_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in clean}
    first: dict[str, int] = {}
    for d in sorted(rows):
        first.setdefault(" ".join(__import__("re").split(r"[\x20\x09-\x0D]+", rows[d].text)), d)
    unique = set(first.values())
    kept = docs.where(docs.doc_id.isin(sorted(unique)))
    from test_operators import brute_components

    apart = {d for d, (_, root) in brute_components({d: rows[d].text for d in unique}, 5, 80).items() if d == root}
    left = {r.doc_id for r in mixing.mixed(docs.where(docs.doc_id.isin(sorted(apart))), alpha=corpus_pipeline.MIX_ALPHA).where("sampled").collect()}
    assert kept.count() == len(unique)
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out.doc_id) == left
    t = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    tokens = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == {d: tokens[d] for d in left}

"""Each stage of the pipeline against a brute-force version on its own input."""

import collections

import pytest
from conftest import SF
from test_llm import components_of

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    out = [docs]
    for name, apply in corpus_pipeline.STAGES:
        path = corpus_pipeline.common.result_path(spark, name)
        apply(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    rows = [{r["doc_id"]: r["text"] for r in x.select("doc_id", "text").collect()} for x in out[:-1]]
    assert list(stages) == ["language_id", "exact_dedup", "ngram_jaccard_join", "mixing", "byte_bpe"]
    assert all(x.columns == columns for x in out[:-1])
    assert {i for i, t in rows[0].items() if any(c.isalpha() for c in t or "")} >= set(rows[1])
    assert len(rows[1]) >= 0.98 * len(rows[0])
    last = {t: i for i, t in sorted(rows[1].items())}
    assert set(rows[2]) == set(last.values())
    assert set(rows[3]) == {c for _, c in components_of(list(rows[2].items())).values()}
    assert rows[4] == rows[3]
    assert collections.Counter(r["doc_id"] for r in out[-1].collect()) == collections.Counter(list(rows[4]))


def test_mixture_survives_to_the_end(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = corpus_pipeline.mixing.laid_out(corpus_pipeline.mixing.mix(docs), 5).select(*docs.columns)
    mixed.write.parquet(f"{tmp_path}/mixed")
    out = corpus_pipeline.encode_tokens(spark, spark.read.parquet(f"{tmp_path}/mixed"), SF)
    got = [r["doc_id"] for r in out.orderBy("mix_part", "mix_row").select("doc_id").collect()]
    want = [r["doc_id"] for r in corpus_pipeline.mixing.mix(docs).orderBy("mix_slot", "mix_offset").select("doc_id").collect()]
    assert got == want != sorted(want)


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls in any column, repeated rows, empty texts, names that stages use inside, and no rows at all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (None, "some words in a text without id", "en", "web", 3), (7_000_001, "", None, None, None), (7_000_002, None, "en", "web", None), (7_000_003, "12 34 !?", "xx", None, 8)]
    docs = docs.unionByName(docs.limit(20)).unionByName(spark.createDataFrame(odd, docs.schema))
    named = docs.withColumns({c: corpus_pipeline.F.lit(c) for c in ("_language", "_id", "_suspect", "_s", "_h", "_t", "_sha")})
    for name, table in (("odd", named), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    for name, apply in corpus_pipeline.STAGES[:-1]:
        named = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
        out = apply(spark, named, SF)
        assert out.columns == named.columns, name
        assert {tuple(r) for r in out.select("_language", "_id", "_s", "_t").distinct().collect()} <= {("_language", "_id", "_s", "_t")}, name
    whole = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    ids = [r["doc_id"] for r in whole.select("doc_id").collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) > 100
    assert not {7_000_001, 7_000_002, 7_000_003} & set(ids)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_stages_start_by_giving_memory_back(spark, monkeypatch):
    class Trimmed(Exception):
        pass

    def trim(session):
        real(session)
        raise Trimmed

    real = corpus_pipeline.common.trim_driver
    monkeypatch.setattr(corpus_pipeline.common, "trim_driver", trim)
    for _, apply in corpus_pipeline.STAGES:
        with pytest.raises(Trimmed):
            apply(spark, None, "")

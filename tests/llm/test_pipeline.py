from collections import Counter

import corpus_pipeline
from storyweft.llm.common import saved

from . import cases
from .test_formats import tokenizer
from .test_models import labelled


def words(text):
    return len((text or "").encode().split())


def test_an_empty_table_goes_through(spark, tmp_path):
    docs, labels = labelled(spark, 20)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns_and_clean_documents(spark, tmp_path):
    docs, labels = labelled(spark, 300)
    extra = cases.documents(spark, [(i if i is None else 1000 + i, t) for i, t in cases.awkward()])
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "mixing", "packing"]
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = at.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = saved(stage(spark, at, str(tmp_path)), f"{tmp_path}/out{k}")
        seen.append((name, at.count()))
        if name != "packing":
            assert at.columns == columns
        if name == "toxicity":
            ids = {r.doc_id for r in at.select("doc_id").collect()}
            assert len([i for i in range(300) if i % 5 and i not in ids]) <= 6 and len([i for i in range(300) if i % 5 == 0 and i in ids]) <= 6
        if name == "line_dedup":
            assert at.count() == seen[0][1]
        if name == "ngram_jaccard":
            rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/out1").collect()]
            assert Counter(r.doc_id for r in at.collect()) == cases.one_of_each(rows)
        if name == "mixing":
            source = spark.read.parquet(f"{tmp_path}/out2").collect()
            whole, size = Counter((r.doc_id, r.text) for r in source if words(r.text)), Counter()
            for r in source:
                size[r.source] += words(r.text)
            mixed, taken, cut = at.collect(), Counter(), Counter()
            for r in mixed:
                taken[r.source] += words(r.text)
                cut[r.source] += (r.doc_id, r.text) not in whole
            assert max(cut.values(), default=0) <= 1  # a source's last document
            assert all(n <= 2 * whole[k] for k, n in Counter((r.doc_id, r.text) for r in mixed if (r.doc_id, r.text) in whole).items())
            assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(size) and all(taken[k] <= 2 * n for k, n in size.items())
        if name == "packing":
            encode = tokenizer().encode
            want = Counter()
            for r in spark.read.parquet(f"{tmp_path}/out3").collect():
                n = len(encode(r.text or "", add_special_tokens=False).ids) + 1
                want.update((r.doc_id, k, start, min(2048, n - start)) for k, start in enumerate(range(0, n, 2048)))
            assert Counter((r.doc_id, r.piece, r.start, r.length) for r in at.collect()) == want
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[-1][1] > 0
    assert spark.conf.get(key) == before and not corpus_pipeline._kept

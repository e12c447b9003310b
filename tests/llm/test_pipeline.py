from collections import defaultdict

import corpus_pipeline
from tideline.llm import packing, quality, secretscan, simhash, toxicity

from .test_packing import check
from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_work_on_all_that_is_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    good = [i for i, s in zip(rows, quality.score_texts([r.text for r in rows.values()], quality.fit(docs, labels), 18)) if s >= 0.3]
    model = toxicity.fit(docs, labels)
    clean = [i for i, s in zip(good, model.score([toxicity.encoded(rows[i].text) for i in good])) if s < 0.3]
    component = brute_components([(i, brute_fingerprint(rows[i].text)) for i in clean])
    texts = {i: secretscan.redact(rows[i].text, secretscan.scan(rows[i].text)[1]) for i in clean if component[i] == i}

    at, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == docs.columns, name
        kept.append({r.doc_id for r in at.collect()})
    assert kept == [set(good), set(clean), set(texts), set(texts)]
    assert {r.doc_id: r.text for r in at.collect()} == texts and all(r.n_chars == len(r.text) for r in at.collect())
    assert any(texts[i] != rows[i].text for i in texts)

    packed = corpus_pipeline.run(spark, SF).collect()
    check(packed, texts, packing.SIZE)
    assert len(defaultdict(int, {r.doc_id: 1 for r in packed})) == len(texts)
    assert simhash.RADIUS == 4


def test_awkward_rows_pass_all_stages(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, columns with clashing names, an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    good = docs.orderBy("doc_id").filter("length(text) > 400").limit(30).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "k", 1, {"a": i}, 0.5) for i, r in enumerate(good)]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1] + " and some more words", *rows[1][2:]), (None, rows[3][1], None, None, None, None, None, None, None), (9001, None, None, None, None, None, None, None, None), (9002, "", "en", "s", 0, "k", 1, None, 0.1), (9003, rows[4][1] * 300, "en", "s", 5, "k", 1, None, 0.1)]
    awkward = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _keep string, _n int, row map<string,int>, score double")
    docs.limit(0).unionByName(docs).write.parquet(f"{tmp_path}/documents.parquet")
    for table, least in ((awkward, 5), (awkward.filter("false"), 0)):
        at = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, at, str(tmp_path))
            assert after.columns == table.columns and [t for _, t in after.dtypes] == [t for _, t in table.dtypes], name
            after.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            at = spark.read.parquet(f"{tmp_path}/{name}")
        kept = at.collect()
        ids = [r.doc_id for r in kept if r.doc_id is not None]
        assert len(kept) >= least and {i for i in ids if ids.count(i) > 1} <= {rows[1][0]}  # two texts under one id both stay
        packed = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
        assert sum(r.start == 0 for r in packed) == len(kept)

from collections import Counter

import numpy as np

import corpus_pipeline
from sparkaudit.llm import mixing, quality
from test_dedup import brute_components, brute_fingerprint, lower


def test_stages_against_plain_versions(spark, documents, prose, tmp_path):
    rows = []
    for n in range(300):
        text = prose(n % 200, 60 + n % 40)
        if n % 5 == 0:
            text = " ".join(w + "%%%" for w in text.split())
        if n >= 250:
            text = text.replace("river", "bridge", 1)
        rows.append((n, text.upper() if n % 7 == 0 else text))
    docs = documents([(n, t) for n, t in rows] + [(300, None)]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(n, 0 if n % 5 == 0 else 1) for n in range(300)], "doc_id bigint, quality bigint").write.parquet(str(tmp_path / "labels.parquet"))

    out, at = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, at, str(tmp_path))
        if k < 4:
            assert made.columns == docs.columns
        made.write.parquet(str(tmp_path / f"stage{k}"))
        at = spark.read.parquet(str(tmp_path / f"stage{k}"))
        out[k] = at.collect()
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    good = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in out[0]} == good and sum(n % 5 != 0 for n in good) > 220
    newest = {lower(r.text): r.doc_id for r in sorted(out[0], key=lambda r: r.doc_id)}
    assert sorted(r.doc_id for r in out[1]) == sorted(newest.values())
    ids = [r.doc_id for r in out[1]]
    components = brute_components(ids, [brute_fingerprint(r.text) for r in out[1]])
    assert sorted(r.doc_id for r in out[2]) == sorted(set(components)) and len(out[2]) < len(out[1])
    mix = mixing.mix(spark.read.parquet(str(tmp_path / "stage2"))).collect()
    assert Counter(r.doc_id for r in out[3]) == Counter({r.doc_id: r.taken // r["size"] for r in mix if r.taken})
    assert len(out[4]) == len(out[3]) and all(len(r.token_ids) == r.n_tokens > 0 for r in out[4])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(out[4])
    assert np.all([r.n_tokens == len(r.token_ids) for r in out[4]])


def test_contract():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing", "byte-level BPE"]
    assert corpus_pipeline.ORACLE_SQL is None

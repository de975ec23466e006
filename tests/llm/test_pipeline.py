"""The pipeline's stages on a small corpus: each does what its operator does, and columns stay until the mix."""

import random

import corpus_pipeline
from barlake.llm import bagminhash, decontaminate, langid, line_chunks


def test_stages_follow_their_operators(spark, tmp_path):
    rnd = random.Random(0)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    item = " ".join(word() for _ in range(20)) + ". Then " + " ".join(word() for _ in range(6)) + "."
    text = lambda n: "\n".join(" ".join(word() for _ in range(9)) for _ in range(n))
    rows = [(d, text(rnd.randrange(1, 9)), "en", f"s{d % 3}") for d in range(60)]
    rows += [(60, rows[5][1], "en", "s0"), (61, rows[6][1] + "\n" + item, "en", "s1"), (62, None, "en", "s1"), (63, "123", "en", None), (None, text(3), "en", "s2")]
    docs = spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixture"]
    expected = [langid.keep_identified, lambda d: line_chunks.dedup_lines(d), bagminhash.keep_one, lambda d: decontaminate.keep_clean(d, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))]
    ids = lambda d: sorted(str((r.doc_id, r.text)) for r in d.collect())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and ids(out) == ids(expected[k](now))
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    left = {r.doc_id for r in now.collect()}
    assert 61 not in left and 62 not in left and 63 not in left and left <= {r[0] for r in rows}
    assert ids(corpus_pipeline.run(spark, str(tmp_path))) == ids(now)

"""The pipeline's stages one after another, each held against what it should do with its own input."""

from collections import Counter

from pyspark.sql import functions as F
from test_operators import SCHEMA, brute_components, brute_quality, made, shingles, targets_are_met

import corpus_pipeline


def test_stages_decide_as_their_operators(spark, tmp_path):
    rows = made(3, 80)
    passage = " ".join(f"secret{i}" for i in range(40))
    rows += [(500, "Opening words here. " + passage + " " + " ".join(f"tail{i}" for i in range(40)), "en", "src1", 1)]
    # Null ids, repeated rows, and columns whose names the stages use too.
    clash = {c: F.lit("x") for c in ("row", "body", "__row", "__turn", "turn", "c_id", "lines", "kept", "key", "n", "t_id")}
    spark.createDataFrame(rows, SCHEMA).withColumns(clash).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sharding":
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.where(" OR ".join(f"{c} != 'x'" for c in clash)).count() == 0
        kept.append([tuple(r)[:5] for r in docs.collect()])
    quality, near, clean, mixed, sharded = kept
    assert Counter(r[0] for r in quality) == Counter(r[0] for r in brute_quality(rows).elements() if r[8])
    counts, _ = brute_components(quality, 5, 80)
    assert Counter(r[0] for r in near) == Counter({c for _, _, c in counts})
    need = shingles(passage, 5)
    assert Counter(r[0] for r in clean) == Counter(r[0] for r in near if 100 * len(need & shingles(r[1], 5)) < 80 * len(need)) and 500 not in {r[0] for r in clean}
    have = Counter(r[:2] for r in clean)
    assert all(n <= 3 * have[i] for i, n in Counter(r[:2] for r in mixed).items())
    targets_are_met(clean, [(r[3], r[1]) for r in mixed])
    assert Counter(sharded) == Counter(mixed) and None in {r[0] for r in quality}


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

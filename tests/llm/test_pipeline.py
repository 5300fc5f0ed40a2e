import corpus_pipeline as cp
from geoloom.llm.common import saved
from geoloom.llm.quality import op5_quality

from .test_decontamination import brute
from .test_jaccard import shingles, similarity
from .test_packing import check
from .test_simhash import closed, fingerprint


def test_every_stage_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    results = [docs]
    for _, stage in cp.STAGES:
        results.append(saved(stage(spark, results[-1], data), "test"))
    rows = [{r.doc_id: r for r in x.collect()} for x in results[:-1]]
    assert all(x.columns == cp.COLUMNS for x in results[:-1])
    kept = {r.doc_id for r in op5_quality(spark, data).where("keep").collect()}
    assert rows[1].keys() == kept
    assert rows[2].keys() == rows[1].keys() and all(len(r.text) == r.n_chars and r.n_chars <= rows[1][i].n_chars for i, r in rows[2].items())
    prints = {i: fingerprint(r.text) for i, r in rows[2].items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    sets = {i: shingles(r.text) for i, r in rows[2].items()}
    alike = lambda a, b: min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and similarity(a, b) >= 0.8
    near += [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    root = closed(prints, near)
    assert rows[3].keys() == {i for i in prints if root[i] == i}
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    judged = brute([(i, r.text) for i, r in rows[3].items()], items)
    assert rows[4].keys() == {j[0] for j in judged if not j[-1]}
    used, bound = check(results[5].collect(), [(i, r.text) for i, r in rows[4].items()], 4096)
    assert used <= bound + 1


def test_run_is_its_stages(spark, data):
    assert cp.run(spark, data).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_empty_tables_and_more_columns(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{src}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    clash = ["id", "key", "score", "label", "hash", "piece", "length", "sequence_id", "rank", "component_id"]
    few = docs.orderBy("doc_id").limit(40)
    wide = few.selectExpr("*", *(f"'x' AS {c}" for c in clash))
    for _, stage in cp.STAGES:
        assert sorted(map(str, stage(spark, wide, src).collect())) == sorted(map(str, stage(spark, few, src).collect()))

import os
import random
import zlib

import pytest

from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_quality_rules import brute as base

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_run_against_brute_force(spark):
    import corpus_pipeline as P

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i: t for i, t in docs.items() if not base(t)[5]}
    group = components(list(kept.items()))
    kept = {i: t for i, t in kept.items() if group[i][1] == i}
    squeeze = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    clean = {i for i, t in kept.items() if not any(squeeze(x) in squeeze(t) for x in items)}
    got = P.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == clean
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_stages(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality_rules", "jaccard_join", "decontamination", "mixing", "sharding"]


def awkward(spark, path, rows, items):
    """A folder of input tables with columns whose names the operators use themselves."""
    docs = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, slot int, host string, kept boolean")
    docs.repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_over_awkward_rows(spark, rows, tmp_path):
    """Null, empty, very long, tied and repeated rows, null ids, hosts and items, clashing columns."""
    import corpus_pipeline as P

    rng = random.Random(4)
    say = lambda n: " ".join(f"p{rng.randrange(900)}" for _ in range(n))
    item = say(30)
    more = [(None, say(80), "en", None, 1), (None, say(90), None, "s1", None), (900, say(60) + " " + item + " " + say(60), "en", "s1", 1), (901, say(9000), "en", "s0", 1), (902, say(70), "en", None, 1), (902, say(70), "en", None, 1)]
    more.append(more[-1])
    every = rows + more
    path = awkward(spark, f"file://{tmp_path}/in", every, [(1, item), (2, None), (3, " . ")])
    got = P.run(spark, path).collect()
    good = [r for r in every if not base(r[1])[5]]
    group = components(list({(k, r[1]): None for k, r in enumerate(good)}))
    # one of each component: smallest id, nulls last
    first = {}
    for k, r in enumerate(good):
        at = (r[0] is None, r[0] or 0)
        c = group[k][1]
        first[c] = min(first.get(c, (at, k)), (at, k))
    kept = [good[k] for _, k in first.values() if item not in (good[k][1] or "")]
    assert {(r["doc_id"], r["size"]) for r in got} == {(r[0], len(r[1].encode()) + 1) for r in kept}
    assert {zlib.crc32(r[1].encode()) for r in kept} == {r["text_crc32"] for r in got}
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_run_over_empty_tables(spark, rows, tmp_path):
    import corpus_pipeline as P

    assert P.run(spark, awkward(spark, f"file://{tmp_path}/none", [], [])).count() == 0
    only = [r for r in rows if base(r[1])[5]]
    assert P.run(spark, awkward(spark, f"file://{tmp_path}/bad", only, [(1, "a b c")])).count() == 0


def test_depleted_documents_go_and_lines_above_limits_are_cut(spark, tmp_path):
    import corpus_pipeline as P

    line = lambda name, n: " ".join(f"{name}x{k}" for k in range(n))
    foot = [line(f"foot{j}", 12) for j in range(6)]
    rows = [(i, "\n".join([line(f"own{i}", 160), *foot]), "en", "h", 1) for i in range(40)] + [(100 + i, "\n".join([line(f"thin{i}", 15), *foot]), "en", "h", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.quality(spark, docs, "").collect()
    assert {r["doc_id"] for r in kept} == set(range(40))
    assert all(r["text"] == line(f"own{r['doc_id']}", 160) and r["n_chars"] == len(r["text"]) for r in kept)

"""The digest index against a dictionary, over batches and sessions, and awkward rows."""

import hashlib
import re

from tessitura.llm import digest_index
from tessitura.llm.digest_index import DigestIndex, add_new, by_age, fingerprints
from tessitura.session import materialize, new_path
from tests.llm.conftest import DOCS


def key(text) -> str:
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) of each row; of rows that repeat one is kept."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(key(r[1]), []).append(r[0])
    out, taken = [], set()
    for r in rows:
        ids = groups[key(r[1])]
        first = min((i for i in ids if i is not None), default=None)
        kept = r[0] == first and key(r[1]) not in taken
        taken |= {key(r[1])} if kept else set()
        out.append((r[0], first, len(ids), kept, key(r[1])))
    return sorted(out, key=str)


def whole(spark, df):
    rows = fingerprints(df)
    index = DigestIndex(spark, new_path(spark, "index"), 3).open()
    batches = by_age(rows)
    for name, part in batches:
        index.add(part, name)
    return sorted([tuple(r) for r in index.verdicts(rows, [n for n, _ in batches]).collect()], key=str)


def test_against_a_dictionary(spark, rows):
    more = [*rows, (None, "one", "en", "s", 3), (None, None, None, None, 0), (900, "a \t b", "en", "s", 3), (901, "a\n\nb", "en", "s", 3), (899, " a b", "en", "s", 3), rows[0], rows[0]]
    assert whole(spark, spark.createDataFrame(more, DOCS).repartition(3)) == brute(more)


def test_only_null_ids_and_no_rows(spark, empty):
    rows = [(None, "x", "en", "s", 1)] * 3
    assert whole(spark, spark.createDataFrame(rows, DOCS)) == brute(rows)
    assert whole(spark, empty) == []


def test_batches_persist(spark, docs):
    """What an earlier batch brought stays; adding again appends nothing; the files outlive the table's name."""
    path = new_path(spark, "index")
    index = DigestIndex(spark, path, 4).open()
    old, new = docs.filter("doc_id % 2 = 1"), docs
    first = {key(r.text) for r in old.collect()}
    got = add_new(index, old, "1")
    assert sorted(key(r.text) for r in got.collect()) == sorted(first)
    spark.sql(f"drop table {index.name}")
    again = DigestIndex(spark, path, 4).open()
    assert again.entries().count() == len(first)
    got = add_new(again, new, "2").collect()
    assert sorted(key(r.text) for r in got) == sorted({key(r.text) for r in new.collect()} - first)
    n = again.entries().count()
    again.add(fingerprints(new), "2")
    assert again.entries().count() == n == again.entries().select("digest").distinct().count()
    packed = again.compact(new_path(spark, "index"))
    assert sorted(map(str, packed.entries().collect())) == sorted(map(str, again.entries().collect()))
    rows = fingerprints(new)
    assert {r.keep_id for r in packed.verdicts(rows, ["2"]).filter("kept").collect()} == {r.doc_id for r in got}


def test_index_is_not_shuffled(spark, docs):
    """The anti-join is a sort-merge join of pre-aggregated digests with buckets as they lie."""
    index = DigestIndex(spark, new_path(spark, "index"), 4).open()
    rows = fingerprints(docs)
    index.add(rows, "1")
    fresh = materialize(digest_index.firsts(rows).select("digest", "doc_id"), "fresh")
    plan = index.unknown(fresh)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan


def test_clashing_columns(spark, docs):
    index = DigestIndex(spark, new_path(spark, "index"), 2).open()
    wide = docs.selectExpr("*", "1 as digest", "2 as row", "3 as _own_digest", "4 as _held_id", "5 as batch")
    got = add_new(index, wide, "1")
    assert got.columns == wide.columns and got.count() == len({key(r.text) for r in docs.collect()})

import re
import sys
import zlib
from pathlib import Path

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from weftmap.llm import queries
from weftmap.llm.queries import vocabulary

sys.path.insert(0, str(Path(__file__).parent))
from test_near import plain_roots  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    kept = [(k, t) for k, t in docs if t and any(c.isalpha() for c in t)]
    best = {}
    for k, t in kept:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[norm] = min(best.get(norm, (0, 1 << 60)), (-len(t), k))
    ids = {k for _, k in best.values()}
    kept = [(k, t) for k, t in kept if k in ids]
    # sets of five-word shingles of a similarity of 0.8 or more, as the stage has it
    kept.sort()
    root = plain_roots([t for _, t in kept])
    first = {}
    for k, x in enumerate(root):
        first.setdefault(x, k)
    assert len(first) < len(kept)
    kept = {kept[k][0]: kept[k][1] for k in first.values()}
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = {}
    for p in corpus_pipeline.run(spark, SF).collect():
        assert zlib.crc32(p["ids"]) == p["ids_crc32"]
        got.setdefault(p["doc_id"], []).append((p["start"], np.frombuffer(p["ids"], "<u4").tolist()))
    assert set(got) == set(kept)
    for k, text in kept.items():
        assert [i for _, ids in sorted(got[k]) for i in ids] == t.encode(text, add_special_tokens=False).ids + [1]


def test_stages_take_odd_rows(spark, docs, none, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (plain, none):
        rows = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, SF)
            path = str(tmp_path / f"{start is none}-{k}")
            out.write.parquet(path)
            rows = spark.read.parquet(path)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert rows.columns == plain.columns
        assert (rows.count() == 0) == (start is none)
    kept = spark.read.parquet(str(tmp_path / "False-2"))
    assert kept.count() == kept.select("doc_id").distinct().count() and kept.where("text is null").count() == 0
    assert kept.where("doc_id is null").count() == 1


def test_dedup_stages_take_rows_of_no_file(spark):
    text = "one two three four five six seven"
    rows = spark.createDataFrame([(1, text), (2, text + " "), (3, "other"), (3, "other")], "doc_id long, text string")
    assert sorted(r[0] for r in corpus_pipeline.exact(spark, rows, SF).collect()) == [2, 3]
    assert sorted(r[0] for r in corpus_pipeline.near(spark, rows, SF).collect()) == [1, 3]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)
    assert got
    if name in queries.ORACLE_SQL:
        db = duckdb.connect()
        for table in ("documents", "pages", "conversations"):
            db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
        found = db.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in found.description]
        want = sorted((tuple(r[names.index(c)] for c in sorted(df.columns)) for r in found.fetchall()), key=str)
        assert got == want


def test_native_queries_run_no_python(spark):
    for name in ("op1_license_scan", "op7_url_filter"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)

import json
import math
from decimal import Decimal
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from weftmap.model import COMPUTE_COLUMNS, FILTER_COLUMNS, Genome, Params, ddl
from weftmap.operators.expected import expected_values
from weftmap.plans.merge import merge_files, merge_results
from weftmap.plans.products import product
from weftmap.plans.view import view
from weftmap.scratch import discard, materialise
from weftmap.sources import manifest, results, text
from weftmap.sources.pixels import is_empty, read_pixel_text, read_pixels
from weftmap.streaming.ingest import contacts_to_pixels, current_pixels, ingest

G = Genome((("chr2", 100), ("chr1", 95)), 10)


def rows(df):
    return sorted(map(tuple, df.collect()))


def some_results(spark, data=None):
    data = data or [("chr1", 0, 10, "chr1", 20, 30, 0.5, 3, 1.5, 1.0, 2.0, 0.5), ("chr2", 0, 10, "chr1", 20, 30, 0.01, 9, 1.5, math.inf, 2.0, 0.5), ("chr2", 10, 20, "chr2", 20, 30, 0.2, 1, 1.5, -1.0, 2.0, 0.5)]
    return spark.createDataFrame(data, ddl(COMPUTE_COLUMNS))


def test_bed_and_bedpe(spark, tmp_path):
    bed = tmp_path / "a.bed"
    bed.write_text("chr2\t0\t10\textra\r\n\r\n\nchr1\t5\t20\nchrX\t1\t2\n")
    got = text.read_bed3(spark, str(bed))
    assert rows(got.select("chrom", "start", "end")) == [("chr1", 5, 20), ("chr2", 0, 10), ("chrX", 1, 2)]
    assert rows(product(got, G)) == [("chr1", 5, 20, "chr1", 5, 20), ("chr2", 0, 10, "chr1", 5, 20), ("chr2", 0, 10, "chr2", 0, 10)]
    # without a genome, chromosomes are in the file's order
    assert ("chr1", 5, 20, "chrX", 1, 2) in rows(product(got)) and len(rows(product(got))) == 6
    assert rows(product(got, None, "trans", "chr2", "chr1")) == [("chr2", 0, 10, "chr1", 5, 20)]
    (tmp_path / "bad.bed").write_text("chr1\t1\n")
    with pytest.raises(Exception, match="fewer than 3"):
        text.read_bed3(spark, str(tmp_path / "bad.bed")).collect()
    (tmp_path / "word.bed").write_text("chr1\tx\t9\n")
    with pytest.raises(Exception, match="isn't a number"):
        text.read_bed3(spark, str(tmp_path / "word.bed")).collect()
    (tmp_path / "mixed.bed").write_text("chr1\t1\t2\nchr2\t1\t2\nchr1\t3\t4\n")
    with pytest.raises(ValueError, match="aren't sorted"):
        product(text.read_bed3(spark, str(tmp_path / "mixed.bed")))


def test_rectangles(spark, tmp_path):
    path = tmp_path / "a.bedpe"
    lines = ["chr2\t0\t10\tchr1\t5\t20", "chr2\t0\t10\tchr1\t5\t20", "chr1\t0\t10\tchr1\t5\t20\tname", "chrX\t0\t1\tchr1\t0\t1"]
    path.write_text("\n".join(lines))
    rect = text.read_bedpe(spark, str(path))
    assert rows(text.domains_of(rect, G)) == [("chr1", 0, 10, "chr1", 5, 20), ("chr2", 0, 10, "chr1", 5, 20)]
    assert rows(text.domains_of(rect, G, keep_trans=False)) == [("chr1", 0, 10, "chr1", 5, 20)]
    assert text.count_drops(rect, G) == text.Drops(4, 1, 0, 0, 1)
    assert text.count_drops(rect, G, keep_cis=False, chrom1="chr2", chrom2="chr1") == text.Drops(4, 1, 1, 0, 1)
    with pytest.raises(ValueError, match="no domain"):
        text.count_drops(rect, G, keep_cis=False, keep_trans=False)
    path.write_text("chr1\t0\t10\tchr2\t5\t20\n")
    with pytest.raises(Exception, match="upper triangle"):
        text.domains_of(text.read_bedpe(spark, str(path)), G).collect()


def test_masks_sizes_logs(spark, tmp_path):
    bins = spark.createDataFrame([("chr1", 10, 20), ("chr1", 90, 95), ("chr2", 35, 38), ("zz", 0, 5)], "chrom string, start long, end long")
    assert rows(text.mask_bins(bins, G)) == [("chr1", 1), ("chr1", 2), ("chr1", 9), ("chr2", 3)]
    sizes = tmp_path / "sizes"
    sizes.write_text(text.chrom_sizes_text(G))
    assert text.read_chrom_sizes(spark, str(sizes), 10) == G
    assert list(text.two_chroms("a", "b").sizes) == ["a", "b"] and list(text.two_chroms("a").sizes) == ["a"]
    log = tmp_path / "log"
    log.write_text("[info] a\n[warning] b\n[error] c\n")
    assert [r[0] for r in text.scrape_log(spark, str(log)).collect()] == ["[warning] b", "[error] c"]


def test_record_types(spark):
    assert results.record_type(list(COMPUTE_COLUMNS)) == "compute" and results.record_type(list(FILTER_COLUMNS)) == "filter"
    for bad in (COMPUTE_COLUMNS[::-1], COMPUTE_COLUMNS[:-1], (*COMPUTE_COLUMNS, "x")):
        with pytest.raises(ValueError):
            results.record_type(list(bad))


def test_results_by_pair(spark, tmp_path):
    r = some_results(spark)
    results.write_results(r, str(tmp_path / "out"), G)
    assert rows(results.read_results(spark, str(tmp_path / "out"))) == rows(r)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        results.write_results(r, str(tmp_path / "out"), G)
    results.write_results(results.empty_results(spark), str(tmp_path / "none"), G)
    assert results.read_results(spark, str(tmp_path / "none")).columns == list(COMPUTE_COLUMNS)
    with pytest.raises(ValueError):
        results.read_results(spark, str(tmp_path / "out"), "filter")


def test_one_file(spark, tmp_path):
    path = tmp_path / "x.chr1.chr2.parquet"
    meta = results.build_metadata("compute", G, {"a": list(range(500))}, ['{"chromosomes": 1, "x": 2}'])
    assert results.export_file(some_results(spark), str(path), G, meta) == 3
    assert results.read_metadata(str(path)) == meta and json.loads(meta)["input-metadata"] == {"x": 2}
    found = pq.read_table(path)
    assert found.column("chrom1").to_pylist() == ["chr2", "chr2", "chr1"] and not found.schema.field("pvalue").nullable
    assert found.column("chrom1").chunk(0).dictionary.to_pylist() == ["chr2", "chr1"]
    assert rows(results.read_results(spark, str(path))) == rows(some_results(spark))
    names = {(r["file_chrom1"], r["file_chrom2"]) for r in results.with_pair_of_file(spark.read.parquet(str(path))).collect()}
    assert names == {("chr1", "chr2")}
    assert results.pair_files(str(tmp_path), "x", Genome((("chr1", 1), ("chr2", 1)), 1)) == [str(path)]
    assert results.unpack_metadata({b"p:format-version": b"2"}) == ""
    with pytest.raises(ValueError):
        results.unpack_metadata({b"p:format-version": b"1"})
    assert results.pack_metadata("short")["weftmap:metadata-compression"] == "None"
    assert results.listed_collisions([str(path)] * 12).count("\n") == 11


def test_merge_and_view(spark, tmp_path):
    r = some_results(spark)
    merged = merge_results([r.limit(1), r.subtract(r.limit(1))], G).collect()
    assert [(x["chrom1"], x["start1"]) for x in merged] == [("chr2", 0), ("chr2", 10), ("chr1", 0)]
    for k in range(2):
        results.export_file(r, str(tmp_path / f"{k}.parquet"), G)
    assert merge_files(spark, [str(tmp_path / f"{k}.parquet") for k in range(2)], G, sort=False).count() == 6
    assert view(r, "chr2:0-10").count() == 1 and view(r, "all", "chr2:20-21").count() == 1
    assert view(r, pvalue=0.2).count() == 2 and view(r, log_ratio=0.0).count() == 2
    filtered = spark.createDataFrame([(*COORD, 0.01, 0.5, 1, 1.0, 1.0, 1.0, 1.0)], ddl(FILTER_COLUMNS))
    assert view(filtered, pvalue=0.1).count() == 0
    with pytest.raises(ValueError):
        merge_results([r, filtered], G)


COORD = ("chr1", 0, 10, "chr1", 20, 30)


def test_pixels(spark, tmp_path):
    spark.createDataFrame([(0, 3, Decimal(5)), (2, 12, Decimal(1)), (11, 19, Decimal(2))], "bin1_id long, bin2_id long, count decimal(20,0)").write.parquet(str(tmp_path / "thin"))
    got = read_pixels(spark, str(tmp_path / "thin"), G)
    assert rows(got) == [("chr1", "chr1", 1, 9, 2), ("chr2", "chr1", 2, 2, 1), ("chr2", "chr2", 0, 3, 5)] and dict(got.dtypes)["n"] == "bigint"
    assert is_empty(got.where("n > 99")) and not is_empty(got)
    spark.range(1).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        read_pixels(spark, str(tmp_path / "bad"), G)


def test_scratch_tables_are_deleted(spark, tmp_path):
    kept, gone = (materialise(spark.range(9), "t") for _ in range(2))
    discard(gone)
    assert kept.count() == 9 and not Path(gone.weftmap_path).exists()


def test_text_pixels(spark, tmp_path):
    path = tmp_path / "dump"
    path.write_text("chr2\t0\t10\tchr2\t30\t40\t5\r\nchr1\t20\tchr2\t10\t2\n\nchr2\t10\t20\tchr1\t20\t30\t1\nzz\t0\tchr1\t0\t9\n")
    assert rows(read_pixel_text(spark, str(path), G)) == [("chr2", "chr1", 1, 2, 3), ("chr2", "chr2", 0, 3, 5)]
    for bad, why in (("chr1\t0\t9\n", "not a pixel"), ("chr1\tx\tchr1\t0\t9\n", "not a number"), ("chr1\t0\tchr1\t0\t0.5\n", "whole numbers")):
        path.write_text(bad)
        with pytest.raises(Exception, match=why):
            read_pixel_text(spark, str(path), G).collect()


def test_pairs_in_files(spark, tmp_path):
    made = results.export_pairs(some_results(spark), str(tmp_path), "out", G, results.build_metadata("compute", G, {}))
    assert [p.rsplit("/", 1)[1] for p in made] == ["out.chr2.chr2.parquet", "out.chr2.chr1.parquet", "out.chr1.chr1.parquet"]
    assert results.pair_files(str(tmp_path), "out", G) == made and rows(merge_files(spark, made, G)) == rows(some_results(spark))
    results.export_file(some_results(spark), str(tmp_path / "other"), G, results.build_metadata("compute", Genome((("chr2", 101), ("chr1", 95)), 10), {}))
    with pytest.raises(ValueError, match="different chromosomes"):
        merge_files(spark, [made[0], str(tmp_path / "other")], G)


def test_stored_expected(spark, tmp_path):
    px = spark.createDataFrame([("chr1", "chr1", i, j, 3) for i in range(9) for j in range(i, 9)], "chrom1 string, chrom2 string, b1 long, b2 long, n long")
    made = expected_values(px, G, Params(min_delta=10, mad_max=0, observed_cutoff=0, interpolate=False), kind="cis")
    results.save_expected(made, str(tmp_path / "e"), G)
    back = results.load_expected(spark, str(tmp_path / "e"), G, "cis")
    assert back.params == made.params and [str(x) for x in rows(back.weights)] == [str(x) for x in rows(made.weights)]
    with pytest.raises(ValueError, match="has no trans"):
        results.load_expected(spark, str(tmp_path / "e"), G)
    with pytest.raises(ValueError, match="resolution"):
        results.load_expected(spark, str(tmp_path / "e"), Genome(G.chroms, 20), "cis")


def test_hash(tmp_path):
    import xxhash

    path = tmp_path / "f"
    path.write_bytes(bytes(range(256)) * 40)
    data = path.read_bytes()
    assert manifest.hash_file(path) == xxhash.xxh3_128_hexdigest(data)
    assert manifest.hash_file(path, 101) == xxhash.xxh3_128_hexdigest(data[:50] + data[-51:])
    assert manifest.hash_file(path, 1) == xxhash.xxh3_128_hexdigest(data[:1])
    with pytest.raises(ValueError):
        manifest.hash_file(path, 0)
    assert manifest.is_digest("a" * 32) and not manifest.is_digest("A" * 32)


def test_manifest(tmp_path):
    m = manifest.Manifest.create(tmp_path / "out.json")
    (tmp_path / "a").write_text("1")
    (tmp_path / "b").write_text("22")
    m.register(tmp_path / "b")
    m.register(tmp_path / "a")
    (tmp_path / "else").mkdir()
    (tmp_path / "else" / "c").write_text("333")
    m.move_and_register(tmp_path / "else" / "c")
    with pytest.raises(ValueError):
        m.register(tmp_path / "a")
    with pytest.raises(FileNotFoundError):
        m.register(tmp_path / "nothing")
    with pytest.raises(FileExistsError):
        manifest.Manifest.create(tmp_path / "out.json")
    assert not manifest.Manifest.load(tmp_path / "out.json").validate()
    m.finalize()
    with pytest.raises(RuntimeError):
        m.finalize()
    back = manifest.Manifest.load(tmp_path / "out.json")
    assert [r.name for r in back.records] == ["a", "b", "c"] and back.validate() and back.checksum() == m.digest
    assert manifest.checksum(tmp_path / "out.json") == (m.digest, True)
    assert manifest.checksum(tmp_path / "a")[0] == manifest.hash_file(tmp_path / "a")
    (tmp_path / "a").write_text("2")
    (tmp_path / "b").unlink()
    found = back.validate()
    assert set(found.record_failures) == {"a", "b"}
    with pytest.raises(ValueError, match="checksum mismatch"):
        found.raise_failures()


def test_ingest(spark, tmp_path):
    contacts = [("chr1", 5, "chr2", 15), ("chr2", 15, "chr1", 5), ("chr1", 94, "chr1", 3), ("zz", 1, "chr1", 1)]
    schema = "chrom1 string, pos1 long, chrom2 string, pos2 long"
    df = spark.createDataFrame(contacts, schema)
    assert rows(contacts_to_pixels(df, G)) == [("chr1", "chr1", 0, 9, 1), ("chr2", "chr1", 1, 0, 2)]
    for k in range(2):
        df.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest(stream, G, str(tmp_path / "px"), str(tmp_path / "cp")).awaitTermination()
        assert rows(current_pixels(spark.read.parquet(str(tmp_path / "px")))) == [("chr1", "chr1", 0, 9, k + 1), ("chr2", "chr1", 1, 0, 2 * k + 2)]

"""Registered queries of sources, sinks, manifests and text, each a round trip held against SQL.

What is written comes from ``nation``, ``region`` and ``lineitem``. Files that only the
driver handles (manifests, single files for exchange) go to the same shared folder.
"""

from __future__ import annotations

import json
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.stats import is_close
from .functions.text import format_bed, format_range, parse_range, parse_size, pretty_duration, pretty_size
from .model import COMPUTE_COLUMNS, COORDINATES, FILTER_COLUMNS, Genome
from .operators import domains as dom
from .operators import pixels
from .plans.compute import compute, tested
from .plans.filter import filter_results
from .plans.merge import merge_files
from .plans.products import product
from .plans.validate import compare
from .queries import _COORDS, _MADE_UP, _RECT, _ROUNDED, GENOME, RAW, _made_up, contacts, intervals, pixel_table, query, rounded, table
from .scratch import scratch
from .sources import manifest, results, text
from .sources.pixels import read_pixel_text
from .streaming.ingest import current_pixels, ingest


def folder(spark: SparkSession, what: str) -> Path:
    """A new folder, for files of the driver, in the shared one."""
    path = Path(scratch(spark, what).removeprefix("file:"))
    path.mkdir(parents=True)
    return path


def write_lines(lines: DataFrame, path: str) -> str:
    """A text file of the column line, in one part where order matters."""
    lines.select("line").write.text(path)
    return path


def refused(spark: SparkSession, work, message: str) -> DataFrame:
    """One row: whether work raises an error that says message."""
    try:
        work()
        said = "nothing"
    except Exception as error:  # noqa: BLE001  what is raised is the result
        said = str(error)
    return spark.createDataFrame([(message in said,)], "refused boolean")


# text sources


@query('select chrom, s as start, e as "end" from bed')
def bed3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with more fields, carriage returns and blank ones between them."""
    line = F.concat(format_bed(F.col("chrom"), F.col("start"), F.col("end")), F.lit("\tmore\t1\r"))
    lines = intervals(spark, sf_dir).select(F.explode(F.array(line, F.lit(""), F.lit("\r"))).alias("line"))
    return text.read_bed3(spark, write_lines(lines, scratch(spark, "bed"))).drop("line")


def rectangle_file(spark: SparkSession, sf_dir: str) -> str:
    """BEDPE: all rectangles, each twice, and as many on unknown chromosomes."""
    rectangles = dom.domain_product(intervals(spark, sf_dir), GENOME)
    unknown = rectangles.withColumn("chrom1", F.lit("chr_zz"))
    path = scratch(spark, "bedpe")
    text.write_tsv(rectangles.unionByName(rectangles).unionByName(unknown), path)
    return path


@query(f"select {_RECT} from rect")
def bedpe_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.domains_of(text.read_bedpe(spark, rectangle_file(spark, sf_dir)), GENOME)


@query(f"select {_RECT} from rect where chrom1 = 'chr_a' and chrom2 = 'chr_b'")
def bedpe_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.domains_of(text.read_bedpe(spark, rectangle_file(spark, sf_dir)), GENOME, chrom1="chr_a", chrom2="chr_b")


@query("select true as refused")
def bedpe_lower_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = dom.domain_product(intervals(spark, sf_dir), GENOME, "trans").selectExpr("chrom2 as chrom1", "start2 as start1", "end2 as end1", "chrom1 as chrom2", "start1 as start2", "end1 as end2")
    return refused(spark, lambda: text.domains_of(lower, GENOME).count(), "not in the upper triangle")


@query("""select 3 * count(*) as parsed, count(*) as unknown_chrom, 2 * count(*) filter (where chrom1 = chrom2) as wrong_kind,
    cast(0 as bigint) as not_selected, count(*) filter (where chrom1 <> chrom2) as duplicates from rect""")
def domain_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.count_drops(text.read_bedpe(spark, rectangle_file(spark, sf_dir)), GENOME, keep_cis=False)
    return spark.createDataFrame([tuple(vars(found).values())], ", ".join(f"{k} long" for k in vars(found)))


@query("select cid as chrom_id, chrom, size, nb as bins, fb as full_bins from chroms")
def chrom_sizes_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, with a pseudo-chromosome at the end that takes no part, and read again."""
    lines = [(line,) for line in [*text.chrom_sizes_text(GENOME).splitlines(), "ALL\t17"]]
    path = write_lines(spark.createDataFrame(lines, "line string").coalesce(1), scratch(spark, "sizes"))
    return text.read_chrom_sizes(spark, path, GENOME.resolution).table(spark)


@query("select * from (values (0, 'chr_x', 2147483647), (1, 'chr_y', 2147483647)) t(chrom_id, chrom, size)")
def genome_of_two_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.two_chroms("chr_x", "chr_y").table(spark).select("chrom_id", "chrom", "size")


_ORDERED = "select *, row_number() over (order by cid, s, e) - 1 as line from bed"


def ordered_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sorted BED3 file, of one part, read again with its line numbers."""
    rows = intervals(spark, sf_dir).coalesce(1).sortWithinPartitions(GENOME.id_of(F.col("chrom")), "start", "end")
    path = write_lines(rows.select(format_bed(F.col("chrom"), F.col("start"), F.col("end")).alias("line")), scratch(spark, "bed"))
    return text.read_bed3(spark, path)


@query(f"select chrom, min(line) as first, max(line) as last, cast(1 as bigint) as runs from ({_ORDERED}) group by chrom")
def chrom_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.chrom_runs(ordered_bed(spark, sf_dir), "line")


@query(f"select {_RECT} from rect")
def product_in_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a genome: chromosomes in the order in which the file names them."""
    return product(ordered_bed(spark, sf_dir))


@query("select true as refused")
def unsorted_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered_bed(spark, sf_dir)
    again = rows.unionByName(rows.where("line = 0").withColumn("line", F.lit(10**9)))
    return refused(spark, lambda: product(again), "aren't sorted")


@query("""select '[' || level || '] ' || n_name as value from (
    select n_name, case n_nationkey % 4 when 0 then 'info' when 1 then 'warning' when 2 then 'error' else 'debug' end as level from nation) where level in ('warning', 'error')""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, ("info", "warning", "error", "debug"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    lines = table(spark, sf_dir, "nation").select(F.concat(F.lit("["), level, F.lit("] "), "n_name").alias("line"))
    return text.scrape_log(spark, write_lines(lines, scratch(spark, "log")))


@query("select chrom1, chrom2, b1, b2, n from px")
def pixel_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels as tools dump them; half of them with the lower triangle's order."""
    found = pixels.with_coordinates(contacts(spark, sf_dir), GENOME)
    swapped = found.where("n % 2 = 0").selectExpr("chrom2 as chrom1", "start2 as start1", "end2 as end1", "chrom1 as chrom2", "start1 as start2", "end1 as end2", "n")
    rows = found.where("n % 2 = 1").selectExpr(*COORDINATES, "n").unionByName(swapped)
    return read_pixel_text(spark, write_lines(rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("line")), scratch(spark, "dump")), GENOME)


@query("select chrom1, chrom2, b1, b2, cast(n as double) as n from px where (b1 + b2) % 5 <> 0")
def nan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contacts(spark, sf_dir)
    return pixels.drop_nan_counts(found.withColumn("n", F.when((F.col("b1") + F.col("b2")) % 5 == 0, F.lit(float("nan"))).otherwise(F.col("n").cast("double"))))


# results


@query("select * from (values ('compute table', 'compute'), ('filter table', 'filter'), ('other order', 'refused'), ('one column less', 'refused')) t(name, kind)")
def record_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kind(columns) -> str:
        try:
            return results.record_type(list(columns))
        except ValueError:
            return "refused"

    layouts = {"compute table": results.empty_results(spark).columns, "filter table": results.empty_results(spark, "filter").columns, "other order": COMPUTE_COLUMNS[::-1], "one column less": FILTER_COLUMNS[:-1]}
    return spark.createDataFrame([(k, kind(v)) for k, v in layouts.items()], "name string, kind string")


def tested_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute(pixel_table(spark, sf_dir), GENOME, RAW)


@query(f"select {_COORDS}, {_ROUNDED} from res")
def one_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = str(folder(spark, "file") / "all.parquet")
    results.export_file(tested_pixels(spark, sf_dir), path, GENOME)
    return rounded(results.read_results(spark, path, "compute"))


@query("select count(*) as exported, count(*) as in_footer, true as sorted from res")
def one_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written, rows of the file's footer, and whether the file is in its declared order."""
    import pyarrow.parquet as pq

    path = str(folder(spark, "file") / "all.parquet")
    n = results.export_file(tested_pixels(spark, sf_dir), path, GENOME)
    footer = pq.read_metadata(path)
    keys = [(GENOME.ids[a], s, e, GENOME.ids[b], t, f) for a, s, e, b, t, f in zip(*(c.to_pylist() for c in pq.read_table(path, columns=list(COORDINATES)).columns))]
    declared = [s.column_index for s in footer.row_group(0).sorting_columns] == list(range(len(COORDINATES)))
    return spark.createDataFrame([(n, footer.num_rows, declared and keys == sorted(keys))], "exported long, in_footer long, sorted boolean")


@query(f"select * from (values {', '.join(f'({k}, {c!r})' for k, c in enumerate(FILTER_COLUMNS))}) t(place, name)")
def empty_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result without rows keeps its columns."""
    path = str(folder(spark, "file") / "none.parquet")
    if results.export_file(results.empty_results(spark, "filter"), path, GENOME):
        raise AssertionError("rows from nowhere")
    return spark.createDataFrame(list(enumerate(results.read_results(spark, path, "filter").columns)), "place int, name string")


@query("""select p.chrom1, p.chrom2, cast(row_number() over (order by id1, id2) - 1 as int) as place, n from pairs p
    join (select chrom1, chrom2, count(*) as n from res group by all) g on g.chrom1 = p.chrom1 and g.chrom2 = p.chrom2""")
def files_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each pair, found again by chromosomes; the pair is that of each file's name."""
    where = folder(spark, "pairs")
    results.export_pairs(tested_pixels(spark, sf_dir), str(where), "out", GENOME)
    results.export_file(results.empty_results(spark), str(where / "out.chr_b.chr_b2.parquet"), GENOME)  # of no pair
    paths = results.pair_files(str(where), "out", GENOME)
    found = results.with_pair_of_file(results.read_results(spark, paths)).groupBy(F.col("file_chrom1").alias("chrom1"), F.col("file_chrom2").alias("chrom2")).agg(F.count(F.lit(1)).alias("n"))
    places = [(*Path(p).name.split(".")[1:3], k) for k, p in enumerate(paths)]
    return found.join(spark.createDataFrame(places, "chrom1 string, chrom2 string, place int"), ["chrom1", "chrom2"])


_CIS_TRANS = f"select {_COORDS}, {_ROUNDED} from res"


@query(f"{_CIS_TRANS} union all {_CIS_TRANS} where chrom1 = chrom2")
def concatenated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    where, found = folder(spark, "merge"), pixel_table(spark, sf_dir)
    paths = [str(where / f"{kind}.parquet") for kind in ("all", "cis")]
    for path, kind in zip(paths, ("all", "cis")):
        results.export_file(compute(found, GENOME, RAW, kind=kind), path, GENOME, results.build_metadata("compute", GENOME, {}))
    return rounded(merge_files(spark, paths, GENOME, sort=False))


@query("select * from (values ('other chromosomes', true), ('other columns', true), ('the same', false)) t(name, refused)")
def incompatible_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    where, other = folder(spark, "merge"), Genome((("chr_a", 595_001), *GENOME.chroms[1:]), 10_000)
    made = {"one": ("compute", GENOME), "same": ("compute", GENOME), "longer": ("compute", other), "filtered": ("filter", GENOME)}
    for name, (kind, genome) in made.items():
        results.export_file(results.empty_results(spark, kind), str(where / name), genome, results.build_metadata(kind, genome, {}))
    out = []
    for name, second in (("other chromosomes", "longer"), ("other columns", "filtered"), ("the same", "same")):
        row = refused(spark, lambda second=second: results.check_compatible([str(where / "one"), str(where / second)]), "have different").first()
        out.append((name, row["refused"]))
    return spark.createDataFrame(out, "name string, refused boolean")


@query("""select 'chromosomes.' || chrom as name, cast(size as varchar) as value from chroms
    union all values ('command', 'filter'), ('params.chrom1', 'chr_a'), ('input-metadata.command', 'compute'), ('input-metadata.chromosomes', null), ('compression', 'zstd'), ('size kept', 'true')""")
def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of a file and of what it was made from, packed, read back and looked up by JSON paths."""
    import pyarrow.parquet as pq

    path = str(folder(spark, "metadata") / "m.parquet")
    earlier = results.build_metadata("compute", GENOME, {"names": [f"n{k}" for k in range(400)]})
    made = results.build_metadata("filter", GENOME, {"chrom1": "chr_a"}, [earlier])
    results.export_file(results.empty_results(spark), path, GENOME, made)
    pairs = {k.decode().rpartition(":")[2]: v.decode() for k, v in pq.read_schema(path).metadata.items()}
    one = spark.createDataFrame([(results.read_metadata(path), pairs["metadata-compression"], str(int(pairs["metadata-size"]) == len(made)).lower())], "text string, compression string, kept string")
    paths = [f"chromosomes.{n}" for n, _ in GENOME.chroms] + ["command", "params.chrom1"]
    looked = [F.struct(F.lit(p).alias("name"), F.get_json_object("text", f"$.{p}").alias("value")) for p in paths]
    looked += [F.struct(F.lit(f"input-metadata.{p}").alias("name"), F.get_json_object("text", f"$['input-metadata'].{p}").alias("value")) for p in ("command", "chromosomes")]
    looked += [F.struct(F.lit("compression").alias("name"), F.col("compression").alias("value")), F.struct(F.lit("size kept").alias("name"), F.col("kept").alias("value"))]
    return one.select(F.explode(F.array(*looked)).alias("x")).select("x.*")


@query(f"{_MADE_UP} select concat_ws(chr(9), chrom1, start1, end1, chrom2, start2, end2, format('{{:g}}', pvalue)) as line from mu")
def tsv_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tsv_lines(_made_up(spark, sf_dir))


@query(f"{_MADE_UP} select chrom1, start1, end1, chrom2, start2, end2, pvalue from mu")
def tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = scratch(spark, "tsv"), _made_up(spark, sf_dir)
    text.write_tsv(rows, path, header=True)
    return spark.read.option("sep", "\t").option("header", True).schema(rows.schema).csv(path)


@query("""select cast(k as int) as place, line from (
    select row_number() over (order by n_name) - 1 as k, '- ' || n_name as line from nation) where k < 10
    union all select 10, '- and ' || (count(*) - 10) || ' more' from nation""")
def listed_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in the way of an output: the first ten and how many more."""
    where = folder(spark, "collisions")
    paths = sorted(str(where / r[0]) for r in table(spark, sf_dir, "nation").select("n_name").collect())
    for path in paths:
        Path(path).touch()
    said = results.listed_collisions([*paths, str(where / "not there")]).replace(f"{where}/", "").splitlines()[1:]
    return spark.createDataFrame([(k, line.strip()) for k, line in enumerate(said)], "place int, line string")


@query("select true as refused")
def existing_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "results")
    results.write_results(results.empty_results(spark), path, GENOME)
    return refused(spark, lambda: results.write_results(results.empty_results(spark), path, GENOME), "already exists")


_DROPPED = "(start1 // 10000 + start2 // 10000) % 7"


@query(f"""
    , b as (select *, case when {_DROPPED} = 1 then observed_count + 1 else observed_count end as oc from res where {_DROPPED} <> 0),
    c as (select * from res where {_DROPPED} <> 2)
    select coalesce(c.chrom1, b.chrom1) as chrom1, coalesce(c.start1, b.start1) as start1, coalesce(c.end1, b.end1) as end1, coalesce(c.chrom2, b.chrom2) as chrom2, coalesce(c.start2, b.start2) as start2, coalesce(c.end2, b.end2) as end2,
           case when b.chrom1 is null then 'missing' when c.chrom1 is null then 'unexpected' else 'different' end as status, case when b.oc <> c.observed_count then 'observed_count' else '' end as differing
    from c full join b on c.chrom1 = b.chrom1 and c.start1 = b.start1 and c.chrom2 = b.chrom2 and c.start2 = b.start2
    where b.chrom1 is null or c.chrom1 is null or b.oc <> c.observed_count""")
def compared_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result held against itself, with rows missing on either side and others changed."""
    path = scratch(spark, "results")
    tested_pixels(spark, sf_dir).write.parquet(path)
    rows = spark.read.parquet(path)
    k = F.expr("(start1 div 10000 + start2 div 10000) % 7")
    changed = rows.where(k != 0).withColumn("observed_count", F.when(k == 1, F.col("observed_count") + 1).otherwise(F.col("observed_count")))
    return compare(rows.where(k != 2), changed)


# domains and pixels


@query(f"select {_RECT} from rect where start1 < 100000 and start2 >= 100000")
def domains_looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches on all six coordinates."""
    rectangles = dom.domain_product(intervals(spark, sf_dir), GENOME)
    wanted = rectangles.where("start1 < 100000 and start2 >= 100000").unionByName(rectangles.limit(3).withColumn("end2", F.lit(-1).cast("long")))
    return rectangles.join(wanted, list(COORDINATES))


@query(f"select {_RECT} from rect where chrom1 = 'chr_b' and chrom2 = 'chr_b'")
def domains_of_one_chromosome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.select_chroms(dom.domain_product(intervals(spark, sf_dir), GENOME), "chr_b")


@query(f"select cast(row_number() over (order by a.cid, b.cid, start1, start2, end1, end2) as int) as place, {_RECT} from rect join chroms a on a.chrom = chrom1 join chroms b on b.chrom = chrom2")
def domains_in_tiled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered as a file of them would be sorted."""
    rows = dom.domain_product(intervals(spark, sf_dir), GENOME).orderBy(*dom.tiled_order(GENOME)).coalesce(1)
    return rows.select((F.monotonically_increasing_id() + 1).cast("int").alias("place"), *COORDINATES)


@query("select chrom1, chrom2, b1, b2, n from px")
def streamed_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts that arrive as a stream of files, summed up to pixels."""
    found, where = contacts(spark, sf_dir), scratch(spark, "stream")
    position = lambda b, c: F.col(b) * GENOME.resolution + F.lit(7)
    single = found.select("chrom1", position("b1", "chrom1").alias("pos1"), "chrom2", position("b2", "chrom2").alias("pos2"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k")).drop("k")
    single.repartition(6).write.parquet(f"{where}/in")
    stream = spark.readStream.schema(single.schema).option("maxFilesPerTrigger", 2).parquet(f"{where}/in")
    ingest(stream, GENOME, f"{where}/out", f"{where}/checkpoint").awaitTermination()
    return current_pixels(spark.read.parquet(f"{where}/out"))


@query("select chrom1, chrom2, b1, b2, true as near, n * 1.1 < 0 as far, true as both_nan from px")
def close_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, nan = F.col("n").cast("double"), F.lit(float("nan"))
    return contacts(spark, sf_dir).select("chrom1", "chrom2", "b1", "b2", is_close(n, n * (1 + 1e-8)).alias("near"), is_close(n, n * 1.1).alias("far"), is_close(nan, nan).alias("both_nan"))


@query("select true as refused")
def margins_beyond_int32(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("a", "a", 4, 1.0, 2**33, 5, 5, 1e9, 1e6, 1e6)], "chrom1 string, chrom2 string, n long, ex double, total long, n1 long, n2 long, exp_total double, l1 double, l2 double")
    return refused(spark, lambda: tested(rows).collect(), "2^31-1")


# manifests


def reported_files(spark: SparkSession, sf_dir: str) -> tuple[Path, manifest.Manifest, list[str]]:
    """A file for each region, half of them moved into place, and a finalized report of them."""
    where, other = folder(spark, "report"), folder(spark, "made-elsewhere")
    report = manifest.Manifest.create(where / "report.json")
    names = sorted(r[0] for r in table(spark, sf_dir, "region").select("r_name").collect())
    for k, name in enumerate(names):
        target = (other if k % 2 else where) / f"{name}.txt"
        target.write_text(name)
        report.move_and_register(target) if k % 2 else report.register(target)
    report.finalize()
    shutil.rmtree(other)
    return where, report, names


@query("select r_name || '.txt' as name, length(r_name) as size, true as is_digest, true as valid from region")
def report_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    where, _, _ = reported_files(spark, sf_dir)
    back = manifest.Manifest.load(where / "report.json")
    good = bool(back.validate()) and manifest.checksum(where / "report.json") == (back.digest, True)
    return spark.createDataFrame([(r.name, r.size, manifest.is_digest(r.digest), good) for r in back.records], "name string, size long, is_digest boolean, valid boolean")


@query("""select r_name || '.txt' as name, case when k = 0 then 'file does not exist' when k = 1 then 'checksum mismatch' else 'file size mismatch' end as reason
    from (select r_name, row_number() over (order by r_name) - 1 as k from region) where k < 3""")
def report_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file gone, one changed, one longer; the others hold."""
    where, report, names = reported_files(spark, sf_dir)
    (where / f"{names[0]}.txt").unlink()
    (where / f"{names[1]}.txt").write_text(names[1][::-1].swapcase())
    (where / f"{names[2]}.txt").write_text(names[2] + "!")
    found = manifest.Manifest.load(where / "report.json").validate().record_failures
    return spark.createDataFrame([(k, v.split(":")[0]) for k, v in found.items()], "name string, reason string")


@query("""select * from (values ('unfinished', 'not finalized'), ('other algorithm', 'unrecognized digest-algorithm'), ('no sample', 'digest-sample-size cannot be 0'), ('changed record', 'checksum mismatch'), ('no digest', 'the digest isn''t one'), ('missing key', 'has no records')) t(name, reason)""")
def bad_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    where, report, _ = reported_files(spark, sf_dir)
    good = json.loads((where / "report.json").read_text())
    changed = [{**good["records"][0], "size": 10**6}, *good["records"][1:]]
    cases = {
        "unfinished": {"digest": manifest.UNFINISHED}, "other algorithm": {"digest-algorithm": "MD5"}, "no sample": {"digest-sample-size": 0},
        "changed record": {"records": changed}, "no digest": {"digest": "xyz"}, "missing key": {"records": None},
    }
    out = []
    for name, change in cases.items():
        path = where / f"{name}.json"
        path.write_text(json.dumps({k: v for k, v in (good | change).items() if v is not None}))
        try:
            checked = manifest.Manifest.load(path).validate()
            why = checked.report_failures[0] if checked.report_failures else "not finalized" if not checked.finalized else "nothing"
        except ValueError as error:
            why = str(error).removeprefix(f"{path} ")
        out.append((name, why.split(":")[0].split(" '")[0]))
    return spark.createDataFrame(out, "name string, reason string")


@query("select * from (values ('nothing', '99aa06d3014798d86001c324468d497f', true), ('a sample', null, true)) t(name, digest, as_expected)")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published digest of no bytes; and of a large file that of its head and tail together."""
    where = folder(spark, "digests")
    (where / "none").touch()
    data = bytes(k % 251 for k in range(5000))
    (where / "large").write_bytes(data)
    (where / "head and tail").write_bytes(data[:500] + data[-501:])
    none = manifest.hash_file(where / "none")
    same = manifest.hash_file(where / "large", 1001) == manifest.hash_file(where / "head and tail") != manifest.hash_file(where / "large")
    return spark.createDataFrame([("nothing", none, manifest.is_digest(none)), ("a sample", None, same)], "name string, digest string, as_expected boolean")


# text


@query("""select chrom, s as start, e as "end", chrom || ':' || s || '-' || e as range, chrom || chr(9) || s || chr(9) || e as bed, true as parsed from bed""")
def range_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges as text, read back on the driver, a row for each interval of nation."""
    rows = intervals(spark, sf_dir)
    made = rows.select("*", format_range(F.col("chrom"), F.col("start"), F.col("end")).alias("range"), format_bed(F.col("chrom"), F.col("start"), F.col("end")).alias("bed"))
    out = [(*r, parse_range(r["range"]) == (r["chrom"], r["start"], r["end"]) and parse_range(f"{r['chrom']}:{r['start']:,}-{r['end']:,}") == parse_range(r["range"])) for r in made.collect()]
    return spark.createDataFrame(out, f"{', '.join(f'{c} {t}' for c, t in made.dtypes)}, parsed boolean".replace("end ", "`end` "))


@query("""select k, k * 1000000 as mb, k * 1073741824 as gib, printf('%.2fMB', k::double) as size, case when k < 60 then printf('%.3fs', k::double) else '1m:' || printf('%.3fs', (k - 60)::double) end as duration
    from (select cast(n_nationkey as bigint) * 4 + 1 as k from nation)""")
def sizes_and_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = sorted(r[0] for r in table(spark, sf_dir, "nation").selectExpr("n_nationkey * 4 + 1 as k").collect())
    rows = [(k, parse_size(f"{k}MB"), parse_size(f"{k} GiB"), pretty_size(k * 10**6), pretty_duration(k)) for k in keys]
    return spark.createDataFrame(rows, "k long, mb long, gib long, size string, duration string")


@query("select * from (values ('125MB', true), ('124.9MB', false), ('lots', false), ('1GB', true)) t(text, allowed)")
def size_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    def allowed(size: str) -> bool:
        try:
            return parse_size(size, 125 * 10**6) > 0
        except ValueError:
            return False

    return spark.createDataFrame([(s, allowed(s)) for s in ("125MB", "124.9MB", "lots", "1GB")], "text string, allowed boolean")


@query(f"select {_RECT} from res where chrom1 = chrom2")
def filtered_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected results written by pair, their type inferred, and read again."""
    path = scratch(spark, "filtered")
    results.write_results(filter_results(compute(pixel_table(spark, sf_dir), GENOME, RAW, kind="cis"), keep_all=True), path, GENOME)
    return results.read_results(spark, path, "filter").select(*COORDINATES)

"""Result tables in Parquet: schemas, metadata, one file a pair or one in all, expected values."""

from __future__ import annotations

import base64
import json
from dataclasses import asdict
from datetime import datetime, timezone
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pair_of_file
from ..model import COMPUTE_COLUMNS, COORDINATES, FILTER_COLUMNS, Genome, Params, ddl
from ..operators.domains import linear_order
from ..operators.expected import Expected
from ..scratch import materialise, scratch

#: What file metadata is filed under, and the version of the layout; older ones are refused.
PREFIX, FORMAT_VERSION = "weftmap", 2
COMPRESS_FROM = 1024
ROW_GROUP, WRITE_BATCH = 500_000, 1_000_000


def record_type(rows: DataFrame | list[str]) -> str:
    """"compute" or "filter", by the exact column names in order; anything else is refused."""
    columns = tuple(rows.columns if isinstance(rows, DataFrame) else rows)
    for kind, wanted in (("compute", COMPUTE_COLUMNS), ("filter", FILTER_COLUMNS)):
        if columns == wanted:
            return kind
    raise ValueError(f"not a result table: {', '.join(columns)}")


def read_results(spark: SparkSession, paths: str | list[str], wanted: str = "infer") -> DataFrame:
    """Results of files of one record type, with Spark's types; wanted: infer, compute or filter.

    Folders written with a folder for each pair have their chromosomes in the path.
    """
    rows = spark.read.option("mergeSchema", False).parquet(*([paths] if isinstance(paths, str) else paths))
    layout = FILTER_COLUMNS if "pvalue_corrected" in rows.columns else COMPUTE_COLUMNS
    if set(rows.columns) == set(layout):
        rows = rows.select(*layout)
    kind = record_type(rows)
    if wanted not in ("infer", kind):
        raise ValueError(f"a {kind} table where {wanted} was wanted")
    longs = ("start1", "end1", "start2", "end2", "observed_count")
    return rows.select(*[F.col(c).cast("long").alias(c) if c in longs else F.col(c) for c in rows.columns])


def with_pair_of_file(rows: DataFrame) -> DataFrame:
    """rows and file_chrom1, file_chrom2, as their file's name has them."""
    first, second = pair_of_file(F.input_file_name())
    return rows.withColumns({"file_chrom1": first, "file_chrom2": second})


def write_results(rows: DataFrame, path: str, genome: Genome, mode: str = "errorifexists", by_pair: bool = True, codec: str = "zstd", level: int = 9) -> None:
    """Results in a folder, zstd or lz4, sorted by coordinates; by_pair: a folder for each pair.

    Rows are dealt by pair and stretches of the first axis, so that a large pair is
    written by many tasks. An empty result leaves its schema.
    """
    record_type(rows)
    writer_options = {"compression": codec} | ({"parquet.compression.codec.zstd.level": str(level)} if codec == "zstd" else {})
    if by_pair and not rows.isEmpty():
        dealt = rows.repartition("chrom1", "chrom2", F.floor(F.col("start1") / 16_777_216))
        dealt.sortWithinPartitions(*linear_order(genome)).write.mode(mode).options(**writer_options).partitionBy("chrom1", "chrom2").parquet(path)
    else:
        rows.orderBy(*linear_order(genome)).write.mode(mode).options(**writer_options).parquet(path)


def empty_results(spark: SparkSession, kind: str = "compute") -> DataFrame:
    return spark.createDataFrame([], ddl(COMPUTE_COLUMNS if kind == "compute" else FILTER_COLUMNS))


def pack_metadata(text: str, prefix: str = PREFIX) -> dict[str, str]:
    """Key/value pairs for a file: text of 1024 bytes or more is compressed where that makes it smaller."""
    out = {f"{prefix}:format-version": str(FORMAT_VERSION)}
    if not text:
        return out
    data, kind = text, "None"
    if len(text.encode()) >= COMPRESS_FROM:
        import zstandard

        packed = base64.b64encode(zstandard.ZstdCompressor(level=22).compress(text.encode())).decode()
        if len(packed) < len(text.encode()):
            data, kind = packed, "zstd"
    return out | {f"{prefix}:metadata": data, f"{prefix}:metadata-compression": kind, f"{prefix}:metadata-size": str(len(text.encode()))}


def unpack_metadata(pairs: dict[bytes, bytes] | None) -> str:
    """The metadata text of a file's key/value pairs, under any prefix; "" if there is none."""
    found = {k.decode().rpartition(":")[2]: v.decode() for k, v in (pairs or {}).items() if b":" in k}
    if int(found.get("format-version", FORMAT_VERSION)) < FORMAT_VERSION:
        raise ValueError(f"format version {found['format-version']} is no longer read")
    text = found.get("metadata", "")
    if found.get("metadata-compression") == "zstd":
        import zstandard

        text = zstandard.ZstdDecompressor().decompress(base64.b64decode(text), max_output_size=int(found["metadata-size"])).decode()
    return text


def read_metadata(path: str) -> str:
    return unpack_metadata(pq.read_schema(path).metadata)


def build_metadata(command: str, genome: Genome, params: dict, inputs: list[str] = (), version: str = "1") -> str:
    """JSON of a run; inputs: metadata of what it was made from, without their chromosomes."""
    earlier = [{k: v for k, v in json.loads(t).items() if k != "chromosomes"} for t in inputs if t]
    return json.dumps(
        {
            "chromosomes": {n: s for _, n, s in genome.real},
            "command": command,
            "date": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S"),
            "input-metadata": earlier[0] if len(earlier) == 1 else earlier,
            "params": params,
            "version": version,
        }
    )


def file_schema(columns: tuple[str, ...]) -> pa.Schema:
    """Types of an exported file: dictionary-coded names, unsigned coordinates, nothing nullable."""
    kinds = {"chrom1": pa.dictionary(pa.int32(), pa.string()), "chrom2": pa.dictionary(pa.int32(), pa.string()), "observed_count": pa.uint64()}
    kinds |= {c: pa.uint32() for c in ("start1", "end1", "start2", "end2")}
    return pa.schema([pa.field(c, kinds.get(c, pa.float64()), nullable=False) for c in columns])


def export_file(rows: DataFrame, path: str, genome: Genome, metadata: str = "", codec: str = "zstd", level: int = 9) -> int:
    """One sorted Parquet file with metadata, for exchange; the number of rows.

    Executors sort the rows and write them to the shared folder; the driver then puts the
    columns of these files into one, a batch at a time, so it never sees a row.
    """
    record_type(rows)
    names = pa.array([n for _, n, _ in genome.real], pa.string())
    schema = file_schema(tuple(rows.columns)).with_metadata(pack_metadata(metadata))
    target, part, total = Path(path), Path(f"{path}.part"), 0
    folder = scratch(rows.sparkSession, "export")
    rows.orderBy(*linear_order(genome)).write.parquet(folder)
    store, where = fs.FileSystem.from_uri(folder)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(where)) if f.path.endswith(".parquet"))
    try:
        sorting = [pq.SortingColumn(k) for k in range(len(COORDINATES))]
        with pq.ParquetWriter(part, schema, version="2.6", data_page_version="2.0", compression=codec, compression_level=level, sorting_columns=sorting) as out:
            for file in files:
                with store.open_input_file(file) as stream:
                    for batch in pq.ParquetFile(stream).iter_batches(WRITE_BATCH, columns=schema.names):
                        columns = []
                        for field, values in zip(schema, batch.columns):
                            if pa.types.is_dictionary(field.type):
                                columns.append(pa.DictionaryArray.from_arrays(pc.index_in(values, names), names))
                            else:
                                columns.append(values.cast(field.type))
                        out.write_table(pa.Table.from_arrays(columns, schema=schema), row_group_size=ROW_GROUP)
                        total += len(batch)
        part.rename(target)
    finally:
        part.unlink(missing_ok=True)  # nothing unfinished is left behind
    return total


def export_pairs(rows: DataFrame, folder: str, prefix: str, genome: Genome, metadata: str = "", **options) -> list[str]:
    """A file prefix.CHROM1.CHROM2.parquet in a folder for each pair that has rows, in genome order; their paths."""
    rows = materialise(rows, "pairs")
    present = {tuple(r) for r in rows.select("chrom1", "chrom2").distinct().collect()}  # bounded by the genome
    Path(folder).mkdir(parents=True, exist_ok=True)
    made = []
    for a, b in (p for p in genome.pairs() if p in present):
        made.append(str(Path(folder, f"{prefix}.{a}.{b}.parquet")))
        export_file(rows.where((F.col("chrom1") == a) & (F.col("chrom2") == b)), made[-1], genome, metadata, **options)
    return made


def check_compatible(paths: list[str]) -> None:
    """Refuse files of different record types, or made with different chromosomes, before they are put together.

    Files without metadata are held to the columns alone.
    """
    first: dict[str, tuple[str, object]] = {}
    for path in paths:
        schema = pq.read_schema(path)
        text = unpack_metadata(schema.metadata)
        found = {"columns": tuple(schema.names), "chromosomes": list(json.loads(text).get("chromosomes", {}).items()) if text else None}
        for what, value in found.items():
            if value is None:
                continue
            if what in first and first[what][1] != value:
                raise ValueError(f"{path} and {first[what][0]} have different {what}")
            first.setdefault(what, (path, value))


def pair_files(folder: str, prefix: str, genome: Genome) -> list[str]:
    """Files prefix.CHROM1.CHROM2.parquet that exist in a folder, in genome order, empty tables left out."""
    found = [Path(folder, f"{prefix}.{a}.{b}.parquet") for a, b in genome.pairs()]
    return [str(p) for p in found if p.exists() and (p.is_dir() or pq.read_metadata(p).num_rows)]


def listed_collisions(paths: list[str], most: int = 10) -> str:
    """Paths that exist, the first ones by name, for an error message."""
    there = [p for p in paths if Path(p).exists()]
    more = f"\n - and {len(there) - most} more" if len(there) > most else ""
    return "".join(f"\n - {p}" for p in there[:most]) + more


def save_expected(expected: Expected, path: str, genome: Genome, mode: str = "errorifexists") -> None:
    """Expected values as Parquet tables: params, chroms, and those of weights, scaling, trans and mask that there are."""
    spark = next(t for t in (expected.mask, expected.trans, expected.weights) if t is not None).sparkSession
    params = asdict(expected.params) | {"resolution": genome.resolution}
    spark.createDataFrame([(json.dumps(params),)], "params string").coalesce(1).write.mode(mode).parquet(f"{path}/params")
    spark.createDataFrame(list(genome.chroms), "name string, length bigint").coalesce(1).write.mode(mode).parquet(f"{path}/chroms")
    for name in ("weights", "scaling", "trans", "mask"):
        if (part := getattr(expected, name)) is not None:
            part.write.mode(mode).parquet(f"{path}/{name}")


def load_expected(spark: SparkSession, path: str, genome: Genome, kind: str = "all") -> Expected:
    """Stored expected values; refused if their resolution differs or a needed part is missing."""
    params = json.loads(spark.read.parquet(f"{path}/params").first()["params"])
    if (stored := params.pop("resolution")) != genome.resolution:
        raise ValueError(f"expected values are for a resolution of {stored}, not {genome.resolution}")

    def part(name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{path}/{name}")
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None

    found = {name: part(name) for name in ("weights", "scaling", "trans", "mask")}
    needed = {"all": ("weights", "scaling", "trans"), "cis": ("weights", "scaling"), "trans": ("trans",)}[kind]
    if missing := [n for n in needed if found[n] is None]:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    return Expected(Params(**params), **found)

import json

import pytest

from weftmap import cli

SIZES = "chr_a\t300\nchr_b\t200\n"


@pytest.fixture
def data(spark, tmp_path):
    px = [("chr_a", "chr_a", i, j, 40 // (1 + j - i) + (60 if (i, j) == (3, 20) else 0)) for i in range(30) for j in range(i, 30)]
    px += [("chr_a", "chr_b", i, i % 20, 1 + i % 3) for i in range(30)]
    spark.createDataFrame(px, "chrom1 string, chrom2 string, b1 long, b2 long, n long").write.parquet(str(tmp_path / "px"))
    (tmp_path / "sizes").write_text(SIZES)
    (tmp_path / "a.bed").write_text("chr_a\t0\t50\nchr_a\t100\t250\nchr_b\t0\t90\n")
    return tmp_path


MODEL = "--resolution 10 --min-delta 10 --mad-max 0 --bin-aggregation-observed-distances-cutoff 0 --bin-aggregation-possible-distances-cutoff 0 --no-interpolate-expected-values".split()


def test_from_pixels_to_view(data, capsys):
    d = str(data)
    run = lambda *a: cli.run(list(a))
    assert run("compute", f"{d}/px", f"{d}/sizes", f"{d}/out", *MODEL) == 0
    with pytest.raises(FileExistsError):
        run("compute", f"{d}/px", f"{d}/sizes", f"{d}/out", *MODEL)
    run("filter", f"{d}/out", f"{d}/f.parquet", f"{d}/sizes", "--fdr", "0.01", "--log-ratio", "1")
    run("metadata", f"{d}/f.parquet")
    assert json.loads(capsys.readouterr().out)["command"] == "filter"
    run("view", f"{d}/f.parquet", "--range", "chr_a:30-40")
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].startswith("chrom1\tstart1") and [x.split("\t")[:6] for x in lines[1:]] == [["chr_a", "30", "40", "chr_a", "200", "210"]]
    run("filter", f"{d}/out", f"{d}/by-pair", f"{d}/sizes", "--fdr", "0.01", "--log-ratio", "1", "--by-pair")
    run("view", f"{d}/by-pair", "--no-write-header")
    assert [x.split("\t")[:2] for x in capsys.readouterr().out.splitlines()] == [["chr_a", "30"]]
    run("merge", "--input-files", f"{d}/f.parquet", f"{d}/f.parquet", "-o", f"{d}/m.parquet", f"{d}/sizes")
    run("view", f"{d}/m.parquet", "--no-write-header")
    assert len(capsys.readouterr().out.splitlines()) == 2
    run("checksum", f"{d}/m.parquet")
    assert len(capsys.readouterr().out.split()[1]) == 32


def test_stored_expected_and_domains(data, capsys):
    d = str(data)
    cli.run(["expected", f"{d}/px", f"{d}/sizes", "--output", f"{d}/e", *MODEL])
    cli.run(["compute", f"{d}/px", f"{d}/sizes", f"{d}/one", "--resolution", "10", "--expected-values", f"{d}/e"])
    cli.run(["compute", f"{d}/px", f"{d}/sizes", f"{d}/two", *MODEL])
    for name in ("one", "two"):
        cli.run(["view", f"{d}/{name}"])
    out = capsys.readouterr().out.splitlines()
    half = len(out) // 2
    assert sorted(out[:half]) == sorted(out[half:]) and half > 300
    cli.run(["cartesian-product", f"{d}/a.bed", "--chrom-sizes", f"{d}/sizes"])
    (data / "a.bedpe").write_text(capsys.readouterr().out)
    assert len((data / "a.bedpe").read_text().splitlines()) == 6
    cli.run(["compute", f"{d}/px", f"{d}/sizes", f"{d}/dom", *MODEL, "--domains", f"{d}/a.bedpe", "--cis-only"])
    cli.run(["view", f"{d}/dom"])
    rows = [x.split("\t") for x in capsys.readouterr().out.splitlines()[1:]]
    assert rows and all(x[0] == x[3] == "chr_a" for x in rows)


def test_bad_options(data):
    d = str(data)
    for bad in (["--cis-only", "--trans-only"], ["--cis-only", "--chrom1", "chr_a"], ["--chrom2", "chr_a"], ["--expected-values", "x"], ["--min-delta", "9", "--max-delta", "3"]):
        with pytest.raises(ValueError):
            cli.run(["compute", f"{d}/px", f"{d}/sizes", f"{d}/x", "--resolution", "10", "--mad-max", "1", *bad])

"""Registered queries of the engine's operators, on a contact matrix made from ``lineitem``.

The tables hold no contact matrix, so one is derived by integer arithmetic: the first bin
from the part, the distance from the quantity, what runs over a chromosome's end becomes a
contact with the next one. Each query reads whole tables; doubles are rounded, as sums of
doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.fnch import fnch_tail_sql
from .functions.stats import finite
from .model import COORDINATES, Genome, Params
from .operators import domains as dom
from .operators import expected as ev
from .operators import marginals as mg
from .operators import masking, pixels
from .operators.fdr import benjamini_hochberg
from .plans.compute import compute, compute_domains
from .plans.filter import filter_results
from .plans.merge import merge_results
from .plans.view import view
from .scratch import materialise, scratch
from .sources.pixels import read_pixels, write_pixels
from .sources.results import load_expected, read_results, save_expected, write_results
from .sources.text import mask_bins

GENOME = Genome((("chr_a", 595_000), ("chr_b", 450_000), ("chr_c", 297_500)), 10_000)
BINS = {0: 60, 1: 45, 2: 30}
#: Raw profile: no mask, pooling or smoothing.
RAW = Params(mad_max=0.0, min_delta=10_000, observed_cutoff=0.0, interpolate=False)
MASKED = Params(mad_max=2.0, min_delta=10_000, observed_cutoff=0.0, interpolate=False)
REPAIRED = Params(mad_max=5.0, min_delta=10_000, observed_cutoff=5_000.0, interpolate=True, quantile=0.975, window=100_000)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL over the common expressions."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"{COMMON}\n{sql}"
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels: chrom1, chrom2, b1, b2, n."""
    nb = lambda c: F.when(c == 0, 60).when(c == 1, 45).otherwise(30).cast("long")
    part, q = F.col("l_partkey").cast("long"), F.col("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").select((part % 3).alias("c1"), F.expr("cast(l_partkey as bigint) div 3").alias("p3"), q.alias("q"))
    rows = rows.withColumn("nb", nb(F.col("c1"))).withColumn("b1", F.col("p3") % F.col("nb")).withColumn("raw", F.col("b1") + F.expr("(q * q * nb) div 2500"))
    inside, after = F.col("raw") < F.col("nb"), (F.col("c1") + 1) % 3
    rows = rows.select("c1", "b1", F.when(inside, F.col("c1")).otherwise(after).alias("c2"), F.when(inside, F.col("raw")).otherwise((F.col("raw") - F.col("nb")) % nb(after)).alias("b2"))
    up = F.col("c1") <= F.col("c2")
    name = lambda c: F.element_at(F.array(*[F.lit(n) for n, _ in GENOME.chroms]), (c + 1).cast("int"))
    ordered = rows.select(
        name(F.least("c1", "c2")).alias("chrom1"), name(F.greatest("c1", "c2")).alias("chrom2"),
        F.when(up, F.col("b1")).otherwise(F.col("b2")).alias("b1"), F.when(up, F.col("b2")).otherwise(F.col("b1")).alias("b2"),
    )
    return ordered.groupBy("chrom1", "chrom2", "b1", "b2").agg(F.count(F.lit(1)).alias("n"))


def pixel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels written as a table, as plans that scan them more than once find them."""
    return materialise(contacts(spark, sf_dir), "pixels")


def scaled_pixels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Genome]:
    """A matrix that grows with the tables, for measurements: as many bins as parts, and a pixel for nearly each
    row of ``lineitem``, two thirds of them within a chromosome."""
    bins = table(spark, sf_dir, "part").count()
    genome = Genome((("chr_x", bins * 10_000), ("chr_y", (bins // 2 + 1) * 10_000)), 10_000)
    rows = table(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey as bigint) % 3 as kind", f"cast(l_partkey as bigint) % {bins} as x", "cast(l_quantity as bigint) as q", "cast(l_suppkey as bigint) as s", "cast(l_linenumber as bigint) as n")
    far = F.expr(f"(q * q * {bins}) div 5000 + s % 64")
    own = F.col("kind") < 2
    rows = rows.select(
        F.lit("chr_x").alias("chrom1"), F.when(own, "chr_x").otherwise("chr_y").alias("chrom2"), F.col("x").alias("b1"),
        F.when(own, F.least(F.col("x") + far, F.lit(bins - 1))).otherwise(far % (bins // 2 + 1)).alias("b2"), "n",
    )
    return rows.groupBy("chrom1", "chrom2", "b1", "b2").agg(F.sum("n").alias("n")), genome


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping intervals from nation: chrom, start, end."""
    rows = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 3).cast("int").alias("c"), (F.expr("n_nationkey div 3") * 50_000).alias("start"))
    rows = rows.select(F.element_at(F.array(*[F.lit(n) for n, _ in GENOME.chroms]), F.col("c") + 1).alias("chrom"), "start")
    size = GENOME.size_of(F.col("chrom"))
    return rows.where(F.col("start") < size).select("chrom", "start", F.least(F.col("start") + 65_000, size).alias("end"))


def masked_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select((F.col("r_regionkey") % 3).cast("int").alias("c"), (F.col("r_regionkey").cast("long") * 30_000).alias("start"))
    return rows.select(F.element_at(F.array(*[F.lit(n) for n, _ in GENOME.chroms]), F.col("c") + 1).alias("chrom"), "start", (F.col("start") + 10_000).alias("end"))


def user_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_bins(masked_intervals(spark, sf_dir), GENOME)


def r(name: str, digits: int = 6) -> Column:
    """A rounded double; null where it isn't finite."""
    return F.when(finite(F.col(name)), F.round(name, digits) + F.lit(0.0)).alias(name)


def rounded(rows: DataFrame) -> DataFrame:
    """A result with p-values as logarithms, and other doubles rounded."""
    p = [(F.round(F.log10(F.greatest(F.col(c), F.lit(1e-300))), 4) + F.lit(0.0)).alias(f"log_{c}") for c in ("pvalue", "pvalue_corrected") if c in rows.columns]
    return rows.select(*COORDINATES, "observed_count", r("expected_count"), r("log_ratio"), r("odds_ratio"), r("omega"), *p)


def _repaired(s: str, params: Params, bins: int = 60) -> str:
    """The profile prof, repaired step by step as the lists' elements are walked."""
    arm, quantile = -(-params.window // GENOME.resolution) // 2, params.quantile
    sums = lambda a: (f"list_sum(pos[i - {a} + 1:i + {a} + 1])", f"list_sum(obs[i - {a} + 1:i + {a} + 1])")
    met = " and ".join(f"{x} >= {cut}" for x, cut in zip(sums("a"), (params.possible_cutoff, params.observed_cutoff)))
    p, o = sums("arm")
    put = lambda c, x: f"case when {p} >= {params.possible_cutoff} or {o} >= {params.observed_cutoff} then {c}[1:i] || [{x} / (2 * arm + 1)] || {c}[i + 2:{bins}] else {c} end"
    frame = f"list_sort(list_filter(w[i - {arm} + 1:i + {arm} + 1], lambda v: v is not null))"
    smoothed = f"""
    smooth{s}(i, w) as (
        select {arm}, w from weight{s}
        union all
        select i + 1, case when w[i + 1] > f[cast(trunc({quantile} * (len(f) - 1)) as bigint) + 1] then w[1:i] || [list_aggregate(f, 'median')] || w[i + 2:{bins}] else w end
        from (select *, {frame} as f from smooth{s} where i < {bins - arm})),
    last{s} as (select w from smooth{s} where i = {bins - arm}),""" if params.interpolate else f"last{s} as (select w from weight{s}),"
    return f"""
    raw{s} as (
        select list(coalesce(obs, 0)::double order by r.d) as obs, list(coalesce(possible, 0)::double order by r.d) as pos
        from (select unnest(range({bins})) as d) r left join obsd{s} o on o.d = r.d left join poss{s} p on p.d = r.d),
    ends{s} as (select *, list_filter(range({bins}), lambda x: obs[x + 1] <> 0) as there from raw{s}),
    pool{s}(i, pos, obs, stop) as (
        select there[1], pos, obs, 0::bigint from ends{s}
        union all
        select i + 1, {put('pos', p)}, {put('obs', o)}, case when {p} >= {params.possible_cutoff} or {o} >= {params.observed_cutoff} then i + arm + 1 else stop end
        from (select *, coalesce(list_min(list_filter(range(least(i, {bins - 1} - i) + 1), lambda a: {met})), least(i, {bins - 1} - i)) as arm from pool{s} where i < {bins})),
    weight{s} as (
        select list_transform(range({bins}), lambda x: case when x < least(stop, case when there[-1] = {bins - 1} then {bins} else there[-1] + 2 end) and p.obs[x + 1] <> 0 and p.pos[x + 1] <> 0 then p.obs[x + 1] / p.pos[x + 1] end) as w
        from pool{s} p, ends{s} where i = {bins}),
    {smoothed}
    prof{s} as (select * from (select unnest(range({bins})) as d, unnest(w) as w from last{s}) where w is not null)"""


def _chain(s: str, base: str, mask: str | None, params: Params | None = None) -> str:
    """Expressions from usable pixels to p-values; s ends the names. mask: an expression with chrom1, chrom2, side, b.

    params: of the profile's repair; without them there is none.
    """
    plain = f"prof{s} as (select o.d, o.obs / p.possible as w from obsd{s} o join poss{s} p on o.d = p.d where o.obs > 0 and p.possible > 0)"
    drop = "" if mask is None else f"""
        where not exists (select 1 from {mask} m where m.chrom1 = p.chrom1 and m.chrom2 = p.chrom2 and m.side = 1 and m.b = p.b1)
          and not exists (select 1 from {mask} m where m.chrom1 = p.chrom1 and m.chrom2 = p.chrom2 and m.side = case when p.chrom1 = p.chrom2 then 1 else 2 end and m.b = p.b2)"""
    return f"""
    use{s} as (select * from {base} p {drop}),
    obsd{s} as (select b2 - b1 as d, cast(sum(n) as bigint) as obs from use{s} where chrom1 = chrom2 group by 1),
    cis{s} as (select chrom1 as chrom, cast(sum(n) as bigint) as cis_sum from use{s} where chrom1 = chrom2 group by 1),
    poss{s} as (select d, cast(sum(fb - d) as bigint) as possible from (select fb, unnest(range(fb)) as d from chroms where chrom in (select chrom from cis{s})) group by d),
    {_repaired(s, params) if params else plain},
    sf{s} as (select c.chrom, sum((c.fb - p.d) * p.w) / any_value(s.cis_sum) as sf from chroms c join cis{s} s on c.chrom = s.chrom join prof{s} p on p.d < c.fb group by c.chrom),
    tavg{s} as (select p.chrom1, p.chrom2, coalesce(sum(u.n) / count(u.n), 0.0) as avg from pairs p left join use{s} u on p.chrom1 = u.chrom1 and p.chrom2 = u.chrom2 where p.chrom1 <> p.chrom2 group by 1, 2),
    ex{s} as (
        select u.*, case when u.chrom1 = u.chrom2 then coalesce(p.w / s.sf, 0.0) else t.avg end as ex
        from use{s} u left join prof{s} p on u.chrom1 = u.chrom2 and p.d = u.b2 - u.b1 left join sf{s} s on s.chrom = u.chrom1
        left join tavg{s} t on t.chrom1 = u.chrom1 and t.chrom2 = u.chrom2),
    marg{s} as (
        select chrom1, chrom2, side, b, cast(sum(n) as bigint) as m, sum(lx) as lm from (
            select chrom1, chrom2, 1 as side, b1 as b, n, case when chrom1 = chrom2 then ex else n end as lx from ex{s}
            union all
            select chrom1, chrom2, case when chrom1 = chrom2 then 1 else 2 end, b2, n, case when chrom1 = chrom2 then ex else n end from ex{s} where chrom1 <> chrom2 or b1 <> b2)
        group by all),
    tot{s} as (select chrom1, chrom2, cast(sum(m) as bigint) as total, sum(lm) as exp_total from marg{s} where side = 1 group by all),
    st{s} as (
        select e.*, x.m as n1, y.m as n2, x.lm as l1, y.lm as l2, t.total, t.exp_total
        from ex{s} e join marg{s} x on x.chrom1 = e.chrom1 and x.chrom2 = e.chrom2 and x.side = 1 and x.b = e.b1
        join marg{s} y on y.chrom1 = e.chrom1 and y.chrom2 = e.chrom2 and y.side = case when e.chrom1 = e.chrom2 then 1 else 2 end and y.b = e.b2
        join tot{s} t on t.chrom1 = e.chrom1 and t.chrom2 = e.chrom2),
    {_tests(s, f'st{s}')},
    res{s} as (
        select chrom1, b1 * 10000 as start1, least((b1 + 1) * 10000, a.size) as end1, chrom2, b2 * 10000 as start2, least((b2 + 1) * 10000, c.size) as end2,
               pvalue, n as observed_count, ex as expected_count, log_ratio, odds_ratio, omega
        from pv{s} join chroms a on a.chrom = chrom1 join chroms c on c.chrom = chrom2 where isfinite(odds_ratio) and omega <> 0)"""


def _tests(s: str, rows: str) -> str:
    """Odds, and p-values by log-gamma sums over the whole support, of rows with n, ex, total, n1, n2, exp_total, l1, l2."""
    return f"""
    od{s} as (
        select *, row_number() over () as rid, log2(n) - log2(ex) as log_ratio,
               case when n1 = 0 or n2 = 0 then 'nan'::double else n::double * ((case when chrom1 = chrom2 then total else 2 * total end) - n1 - n2 + n) / ((n1 - n)::double * (n2 - n)) end as odds_ratio,
               case when chrom1 <> chrom2 then 1.0 when l1 = 0 or l2 = 0 then 'nan'::double else ex * (exp_total - l1 - l2 + ex) / ((l1 - ex) * (l2 - ex)) end as omega
        from {rows}),
    need{s} as (select rid, n, n1, n2, total, greatest(omega, 0.1) as w from od{s} where isfinite(odds_ratio) and isfinite(omega) and omega <= odds_ratio and n > 1),
    term{s} as (
        select rid, n, x, -lgamma(x + 1) - lgamma(n1 - x + 1) - lgamma(n2 - x + 1) - lgamma(total - n1 - n2 + x + 1) + x * ln(w) as lf
        from (select *, unnest(range(greatest(0, n1 + n2 - total), least(n1, n2) + 1)) as x from need{s})),
    peak{s} as (select rid, max(lf) as top from term{s} group by rid),
    tail{s} as (select t.rid, sum(exp(lf - top)) filter (where x >= n) / sum(exp(lf - top)) as p from term{s} t join peak{s} k on t.rid = k.rid group by t.rid),
    pv{s} as (select o.*, coalesce(t.p, 1.0) as pvalue from od{s} o left join tail{s} t on o.rid = t.rid)"""


COMMON = f"""
with recursive chroms(cid, chrom, size, nb, fb) as (values (0, 'chr_a', 595000, 60, 59), (1, 'chr_b', 450000, 45, 45), (2, 'chr_c', 297500, 30, 29)),
    l1 as (select cast(l_partkey as bigint) % 3 as c1, cast(l_partkey as bigint) // 3 as p3, cast(l_quantity as bigint) as q from lineitem),
    l2 as (select c1, p3 % nb as b1, p3 % nb + (q * q * nb) // 2500 as raw, nb from l1 join chroms on cid = c1),
    l3 as (select c1, b1, case when raw < l2.nb then c1 else (c1 + 1) % 3 end as c2, case when raw < l2.nb then raw else (raw - l2.nb) % k.nb end as b2 from l2 join chroms k on k.cid = (c1 + 1) % 3),
    px as (
        select x.chrom as chrom1, y.chrom as chrom2, case when c1 <= c2 then b1 else b2 end as b1, case when c1 <= c2 then b2 else b1 end as b2, count(*) as n
        from l3 join chroms x on x.cid = least(c1, c2) join chroms y on y.cid = greatest(c1, c2) group by all),
    pairs as (select a.chrom as chrom1, b.chrom as chrom2, a.cid as id1, b.cid as id2, a.size as size1, b.size as size2, a.nb as nb1, b.nb as nb2 from chroms a join chroms b on a.cid <= b.cid),
    band as (select * from px where chrom1 <> chrom2 or b2 - b1 >= 1),
    marg_all as (
        select chrom1, chrom2, side, b, cast(sum(n) as bigint) as m from (
            select chrom1, chrom2, 1 as side, b1 as b, n from px union all
            select chrom1, chrom2, case when chrom1 = chrom2 then 1 else 2 end, b2, n from px where chrom1 <> chrom2 or b1 <> b2) group by all),
    sides as (select chrom1, chrom2, 1 as side, unnest(range(nb1)) as b from pairs union all select chrom1, chrom2, 2, unnest(range(nb2)) from pairs where chrom1 <> chrom2),
    med as (select chrom1, chrom2, side, median(m) as md from marg_all group by all),
    logs as (select a.chrom1, a.chrom2, a.side, b, m / md as x, ln(m / md) as l from marg_all a join med using (chrom1, chrom2, side)),
    cen as (select chrom1, chrom2, side, median(l) as c from logs group by all),
    dev as (select chrom1, chrom2, side, any_value(c) as c, median(abs(l - c)) as mad from logs join cen using (chrom1, chrom2, side) group by all),
    madm as (
        select chrom1, chrom2, side, b from sides
        except select l.chrom1, l.chrom2, l.side, b from logs l join dev using (chrom1, chrom2, side) where x >= exp(dev.c - 2.0 * mad)),
    ubins as (
        select distinct chrom, b from (
            select c.chrom, unnest(range((r_regionkey * 30000) // 10000, least((r_regionkey * 30000 + 10000) // 10000, nb - 1) + 1)) as b
            from region join chroms c on c.cid = r_regionkey % 3)),
    userm as (
        select chrom1, chrom2, 1 as side, b from pairs join ubins on chrom = chrom1
        union all select chrom1, chrom2, 2, b from pairs join ubins on chrom = chrom2 where chrom1 <> chrom2),
    bothm as (select * from madm union select * from userm),
    bed as (
        select c.chrom, (n_nationkey // 3) * 50000 as s, least((n_nationkey // 3) * 50000 + 65000, c.size) as e, cid
        from nation join chroms c on c.cid = n_nationkey % 3 where (n_nationkey // 3) * 50000 < c.size),
    rect as (
        select a.chrom as chrom1, a.s as start1, a.e as end1, b.chrom as chrom2, b.s as start2, b.e as end2
        from bed a join bed b on a.cid < b.cid or (a.cid = b.cid and (a.s < b.s or (a.s = b.s and a.e <= b.e)))),
    {_chain('', 'band', None)},
    {_chain('_m', 'band', 'bothm')}
"""

_ROUNDED = "round(expected_count, 6) + 0.0 as expected_count, round(log_ratio, 6) + 0.0 as log_ratio, round(odds_ratio, 6) + 0.0 as odds_ratio, round(omega, 6) + 0.0 as omega, round(log10(greatest(pvalue, 1e-300)), 4) + 0.0 as log_pvalue"
_COORDS = "chrom1, start1, end1, chrom2, start2, end2, observed_count"


# scans and coordinates


@query("select chrom1, chrom2, b1, b2, n from px")
def pixels_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts(spark, sf_dir)


@query("select chrom1, chrom2, b1, b2, n from px where chrom1 = 'chr_a' and chrom2 = 'chr_b'")
def pixels_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.scan_pair(contacts(spark, sf_dir), "chr_a", "chr_b")


@query("select chrom1, chrom2, b1, b2, n from px where chrom1 = chrom2")
def pixels_cis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.scan_kind(contacts(spark, sf_dir), "cis")


@query("select chrom1, chrom2, b1, b2, n from px where chrom1 <> chrom2")
def pixels_trans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.scan_kind(contacts(spark, sf_dir), "trans")


@query("select chrom1, chrom2, b1, b2, n from px where chrom1 = 'chr_a' and chrom2 = 'chr_b' and b1 between 10 and 25 and b2 between 5 and 30")
def pixel_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.scan_range(contacts(spark, sf_dir), GENOME, ("chr_a", 105_000, 255_001), ("chr_b", 50_000, 310_000))


@query("select chrom1, chrom2, b1, b2, n from px")
def pixels_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by pair and stretch, and read again."""
    path = scratch(spark, "pixels")
    write_pixels(contacts(spark, sf_dir), path)
    return read_pixels(spark, path, GENOME)


@query("select distinct chrom1, chrom2 from px")
def nonempty_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.drop_empty_pairs(GENOME.pair_table(spark).select("chrom1", "chrom2"), contacts(spark, sf_dir))


@query("select chrom1, chrom2, id1, id2, size1, size2, nb1 as bins1, nb2 as bins2 from pairs")
def chrom_pairs_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GENOME.pair_table(spark)


@query("select chrom, b, b + case cid when 0 then 0 when 1 then 60 else 105 end as bin_id, b * 10000 as start, least((b + 1) * 10000, size) as end from (select *, unnest(range(nb)) as b from chroms)")
def bins_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GENOME.bin_table(spark)


@query("""select chrom1, chrom2, b1, b2, n, b1 * 10000 as start1, least((b1 + 1) * 10000, x.size) as end1, b2 * 10000 as start2, least((b2 + 1) * 10000, y.size) as end2
    from px join chroms x on x.chrom = chrom1 join chroms y on y.chrom = chrom2""")
def pixel_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.with_coordinates(contacts(spark, sf_dir), GENOME)


@query("select chrom1, chrom2, b1, b2, n from px")
def pixels_from_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through bins numbered over the genome, and back."""
    offset = GENOME.lookup
    base = {"chr_a": 0, "chr_b": 60, "chr_c": 105}
    thin = contacts(spark, sf_dir).select((F.col("b1") + offset(F.col("chrom1"), base)).alias("bin1_id"), (F.col("b2") + offset(F.col("chrom2"), base)).alias("bin2_id"), F.col("n").alias("count"))
    return pixels.from_thin(thin, GENOME)


# filters and masks


@query("select chrom1, chrom2, b1, b2, n from px where chrom1 <> chrom2 or ((b2 - b1) * 10000 >= 15000 and (b2 - b1) * 10000 < 300000)")
def band_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts(spark, sf_dir).where(pixels.in_band(GENOME, 15_000, 300_000))


@query("select chrom1, chrom2, b1, b2, n from use_m")
def mask_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pixel_table(spark, sf_dir)
    mask = masking.bin_mask(found, GENOME, 2.0, user_bins(spark, sf_dir))
    return pixels.usable(found, GENOME, 10_000, 2**63 - 1, mask)


@query("select chrom1, chrom2, side, b from madm")
def mad_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.mad_mask(mg.marginals(contacts(spark, sf_dir)), GENOME, 2.0)


@query("select chrom, b from ubins")
def user_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_bins(spark, sf_dir)


@query("select chrom1, chrom2, side, b from bothm")
def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.bin_mask(contacts(spark, sf_dir), GENOME, 2.0, user_bins(spark, sf_dir))


# aggregates


@query("select chrom1, chrom2, side, b, m from marg_all where chrom1 = chrom2")
def marginals_cis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mg.marginals(pixels.scan_kind(contacts(spark, sf_dir), "cis"))


@query("select chrom1, chrom2, side, b, m from marg_all where chrom1 <> chrom2")
def marginals_trans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mg.marginals(pixels.scan_kind(contacts(spark, sf_dir), "trans"))


_TOTALS = "select chrom1, chrom2, cast(sum(case when chrom1 = chrom2 and b1 <> b2 then 2 * n else n end) as bigint) as total, cast(sum(case when chrom1 = chrom2 and b1 <> b2 then 2 else 1 end) as bigint) as nnz from px group by all"


@query(_TOTALS)
def matrix_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mg.totals(contacts(spark, sf_dir))


@query(f"select chrom1, chrom2, round(total / nnz, 6) + 0.0 as avg from ({_TOTALS})")
def nnz_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mg.nnz_average(mg.totals(contacts(spark, sf_dir))).select("chrom1", "chrom2", r("avg"))


def _usable_cis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.usable(pixels.scan_kind(pixel_table(spark, sf_dir), "cis"), GENOME, 10_000, 2**63 - 1)


@query("select d, obs from obsd")
def observed_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.observed_by_distance(_usable_cis(spark, sf_dir))


@query("select d, possible from poss")
def possible_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.possible_by_distance(ev.sums_by_chrom(_usable_cis(spark, sf_dir)), GENOME)


@query("select a.d, round(w, 6) + 0.0 as w from (select unnest(range(60)) as d) a left join prof p on a.d = p.d")
def density_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.density(ev.raw_profile(_usable_cis(spark, sf_dir), GENOME)).select("d", r("w"))


@query("select chrom, round(sf, 6) + 0.0 as sf from sf")
def scaling_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.expected_values(pixel_table(spark, sf_dir), GENOME, RAW, kind="cis").scaling.select("chrom", r("sf"))


@query("select chrom1, chrom2, round(avg, 6) + 0.0 as avg from tavg_m")
def trans_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.expected_values(pixel_table(spark, sf_dir), GENOME, MASKED, user_bins(spark, sf_dir), "trans").trans.select("chrom1", "chrom2", r("avg"))


@query("select chrom1, chrom2, round(sum(n) / (any_value(x.fb) * any_value(y.fb)), 6) + 0.0 as density from px join chroms x on x.chrom = chrom1 join chroms y on y.chrom = chrom2 where chrom1 <> chrom2 group by all")
def trans_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.trans_density(pixels.scan_kind(contacts(spark, sf_dir), "trans"), GENOME).select("chrom1", "chrom2", r("density"))


POOLED = Params(mad_max=0.0, min_delta=10_000, observed_cutoff=5_000.0, interpolate=False)
_MAD5 = """
    , mad5 as (
        select chrom1, chrom2, side, b from sides
        except select l.chrom1, l.chrom2, l.side, b from logs l join dev using (chrom1, chrom2, side) where x >= exp(dev.c - 5.0 * mad))"""
_WEIGHTS = "select a.d, round(w, 6) + 0.0 as w from (select unnest(range(60)) as d) a left join prof{s} p on a.d = p.d"


@query(f", {_chain('_p', 'band', None, POOLED)} {_WEIGHTS.format(s='_p')}")
def low_cov_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step of the repair needs the one before."""
    return ev.expected_values(pixel_table(spark, sf_dir), GENOME, POOLED, kind="cis").weights.select("d", r("w"))


@query(f"{_MAD5}, {_chain('_r', 'band', 'mad5', REPAIRED)} {_WEIGHTS.format(s='_r')}")
def outlier_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.expected_values(pixel_table(spark, sf_dir), GENOME, REPAIRED, kind="cis").weights.select("d", r("w"))


def _with_ex(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pixel_table(spark, sf_dir)
    return ev.with_expected(pixels.usable(found, GENOME, 10_000, 2**63 - 1), ev.expected_values(found, GENOME, RAW), GENOME)


@query("select chrom1, chrom2, b1, b2, n, round(ex, 6) + 0.0 as ex from ex")
def pixel_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_ex(spark, sf_dir).select("chrom1", "chrom2", "b1", "b2", "n", r("ex"))


@query("select chrom1, chrom2, side, b, m, round(lm, 4) + 0.0 as lm from marg where chrom1 = chrom2")
def expected_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mg.marginals(pixels.scan_kind(_with_ex(spark, sf_dir), "cis"), m="n", lm="ex")
    return found.select("chrom1", "chrom2", "side", "b", "m", r("lm", 4))


@query("select chrom1, chrom2, total, round(exp_total, 3) + 0.0 as exp_total from tot where chrom1 = chrom2")
def expected_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mg.marginals(pixels.scan_kind(_with_ex(spark, sf_dir), "cis"), m="n", lm="ex")
    return mg.totals_of_marginals(found, total="m", exp_total="lm").select("chrom1", "chrom2", "total", r("exp_total", 3))


# tests


@query(f"select {_COORDS}, round(expected_count, 6) + 0.0 as expected_count, round(log_ratio, 6) + 0.0 as log_ratio, round(odds_ratio, 6) + 0.0 as odds_ratio, round(omega, 6) + 0.0 as omega from res")
def odds_omega_logratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compute(pixel_table(spark, sf_dir), GENOME, RAW)).drop("log_pvalue")


@query(f"select {_COORDS}, {_ROUNDED} from res where chrom1 = chrom2")
def compute_cis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compute(pixel_table(spark, sf_dir), GENOME, RAW, kind="cis"))


@query(f"select {_COORDS}, {_ROUNDED} from res where chrom1 <> chrom2")
def compute_trans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compute(pixel_table(spark, sf_dir), GENOME, RAW, kind="trans"))


@query(f"select {_COORDS}, {_ROUNDED} from res_m")
def compute_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compute(pixel_table(spark, sf_dir), GENOME, MASKED, user_mask=user_bins(spark, sf_dir)))


@query(f"select {_COORDS}, {_ROUNDED} from res where chrom1 = chrom2")
def pvalue_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values by Spark expressions alone."""
    return rounded(compute(pixel_table(spark, sf_dir), GENOME, RAW, kind="cis", kernel=fnch_tail_sql))


@query(f"{_MAD5}, {_chain('_r', 'band', 'mad5', REPAIRED)} select {_COORDS}, {_ROUNDED} from res_r")
def compute_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the mask, pooling and smoothing of the command's defaults."""
    return rounded(compute(pixel_table(spark, sf_dir), GENOME, REPAIRED))


@query(f"select {_COORDS}, {_ROUNDED} from res")
def compute_stored_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With expected values that were written and read again."""
    path = scratch(spark, "expected")
    found = pixel_table(spark, sf_dir)
    save_expected(ev.expected_values(found, GENOME, RAW), path, GENOME)
    return rounded(compute(found, GENOME, expected=load_expected(spark, path, GENOME)))


# domains

_RECT = "chrom1, start1, end1, chrom2, start2, end2"


@query(f"select {_RECT} from rect")
def domain_product_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.domain_product(intervals(spark, sf_dir), GENOME)


@query(f"select {_RECT} from rect where chrom1 = chrom2")
def domain_product_cis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.domain_product(intervals(spark, sf_dir), GENOME, "cis")


@query(f"select {_RECT} from rect where chrom1 <> chrom2")
def domain_product_trans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.domain_product(intervals(spark, sf_dir), GENOME, "trans")


@query('select distinct chrom, s as start, e as "end" from bed')
def domain_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = intervals(spark, sf_dir)
    return dom.distinct_domains(once.unionByName(once))


def _hits(s: str) -> str:
    """Domains and what overlaps them, by a plain comparison of all rectangles."""
    return f"""
    hit as (
        select r.*, u.n, u.ex from rect r join (
            select chrom1, chrom2, b1, b2, n, ex from ex{s} union all select chrom1, chrom2, b2, b1, n, ex from ex{s} where chrom1 = chrom2 and b1 <> b2) u
        on r.chrom1 = u.chrom1 and r.chrom2 = u.chrom2 and u.b1 * 10000 < r.end1 and (u.b1 + 1) * 10000 > r.start1 and u.b2 * 10000 < r.end2 and (u.b2 + 1) * 10000 > r.start2),
    dsum as (
        select r.*, coalesce(h.n, 0) as n, coalesce(h.ex, 0.0) as ex
        from rect r left join (select chrom1, start1, end1, chrom2, start2, end2, cast(sum(n) as bigint) as n, sum(ex) as ex from hit group by all) h using (chrom1, start1, end1, chrom2, start2, end2))"""


@query(f", {_hits('')} select {_RECT}, n as obs, round(ex, 4) + 0.0 as ex from dsum")
def domain_overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rectangles = dom.domain_product(intervals(spark, sf_dir), GENOME)
    return dom.overlap_sums(_with_ex(spark, sf_dir), rectangles, GENOME, obs="n", ex="ex").select(*COORDINATES, "obs", r("ex", 4))


@query("""
    , cell as (select chrom1, chrom2, unnest(range(start1 // 100000, (end1 - 1) // 100000 + 1)) as x, start2, end2 from rect),
    cell2 as (select chrom1, chrom2, x, unnest(range(start2 // 100000, (end2 - 1) // 100000 + 1)) as y from cell),
    up as (select distinct chrom1, chrom2, case when chrom1 = chrom2 then least(x, y) else x end as x, case when chrom1 = chrom2 then greatest(x, y) else y end as y from cell2),
    cnt as (select chrom1, chrom2, count(*) as covered from up group by all),
    tot2 as (select chrom1, chrom2, cast(case when chrom1 = chrom2 then ceil(size1 / 100000) * (ceil(size1 / 100000) + 1) / 2 else ceil(size1 / 100000) * ceil(size2 / 100000) end as bigint) as blocks from pairs)
    select chrom1, chrom2, covered, blocks, round(covered / blocks, 6) + 0.0 as coverage from cnt join tot2 using (chrom1, chrom2)""")
def domain_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dom.coverage(dom.domain_product(intervals(spark, sf_dir), GENOME), GENOME)
    return found.select("chrom1", "chrom2", "covered", "blocks", r("coverage"))


def _sides(s: str, mask: str) -> str:
    one = lambda k, side: f"""
    side{k} as (
        select {_RECT}, coalesce(cast(sum(m) as bigint), 0) as n{k}, coalesce(sum(lm), 0.0) as l{k}, count(masked) / count(*) as bad{k} from (
            select r.*, g.m, g.lm, case when k.b is not null then 1 end as masked
            from (select *, unnest(range(start{k} // 10000, (end{k} + 9999) // 10000)) as b from rect) r
            left join marg{s} g on g.chrom1 = r.chrom1 and g.chrom2 = r.chrom2 and g.side = {side} and g.b = r.b
            left join {mask} k on k.chrom1 = r.chrom1 and k.chrom2 = r.chrom2 and k.side = {side} and k.b = r.b)
        group by {_RECT})"""  # noqa: E731
    return one(1, "1") + "," + one(2, "case when r.chrom1 = r.chrom2 then 1 else 2 end")


@query(f", {_sides('_m', 'bothm')} select {_RECT}, n1, n2, round(l1, 4) + 0.0 as l1, round(l2, 4) + 0.0 as l2, round(bad1, 6) + 0.0 as bad1, round(bad2, 6) + 0.0 as bad2 from side1 join side2 using ({_RECT})")
def domain_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pixel_table(spark, sf_dir)
    expected = ev.expected_values(found, GENOME, MASKED, user_bins(spark, sf_dir))
    valued = ev.with_expected(pixels.usable(found, GENOME, 10_000, 2**63 - 1, expected.mask), expected, GENOME)
    valued = valued.withColumn("lx", F.when(pixels.is_cis(), F.col("ex")).otherwise(F.col("n").cast("double")))
    sides = dom.domain_marginals(dom.domain_product(intervals(spark, sf_dir), GENOME), mg.marginals(valued, m="n", lm="lx"), expected.mask, GENOME)
    return sides.select(*COORDINATES, "n1", "n2", r("l1", 4), r("l2", 4), r("bad1"), r("bad2"))


def _domain_test(s: str, mask: str, limit: float) -> str:
    return f"""
    , {_hits(s)}, {_sides(s, mask)},
    dst as (
        select d.*, n1, l1, n2, l2, total, exp_total from dsum d join side1 using ({_RECT}) join side2 using ({_RECT}) left join tot{s} using (chrom1, chrom2)
        where n > 0 and bad1 < {limit} and bad2 < {limit}),
    {_tests('_d', 'dst')}
    select {_RECT}, n as observed_count, round(ex, 4) + 0.0 as expected_count, round(log_ratio, 5) + 0.0 as log_ratio, round(odds_ratio, 5) + 0.0 as odds_ratio, round(omega, 5) + 0.0 as omega, round(log10(greatest(pvalue, 1e-300)), 3) + 0.0 as log_pvalue
    from pv_d where isfinite(odds_ratio) and omega <> 0"""


def _rounded_domains(rows: DataFrame) -> DataFrame:
    p = (F.round(F.log10(F.greatest(F.col("pvalue"), F.lit(1e-300))), 3) + F.lit(0.0)).alias("log_pvalue")
    return rows.select(*COORDINATES, "observed_count", r("expected_count", 4), r("log_ratio", 5), r("odds_ratio", 5), r("omega", 5), p)


@query(_domain_test("", "(select * from bothm where false)", 1.0))
def compute_domains_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rectangles = dom.domain_product(intervals(spark, sf_dir), GENOME)
    return _rounded_domains(compute_domains(pixel_table(spark, sf_dir), rectangles, GENOME, RAW, bad_bin_fraction=1.0))


@query(_domain_test("_m", "bothm", 0.1))
def compute_domains_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rectangles = dom.domain_product(intervals(spark, sf_dir), GENOME)
    return _rounded_domains(compute_domains(pixel_table(spark, sf_dir), rectangles, GENOME, MASKED, user_mask=user_bins(spark, sf_dir)))


# corrections, filters, merges, views


def _made_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with p-values by integer arithmetic, many of them equal."""
    rows = pixels.with_coordinates(contacts(spark, sf_dir), GENOME)
    return rows.select(*COORDINATES, (((F.col("n") * 7919 + F.col("b1") * 31 + F.col("b2") * 17) % 1000 + 1) / F.lit(1000.0)).alias("pvalue"))


_MADE_UP = """
    , mu as (
        select chrom1, b1 * 10000 as start1, least((b1 + 1) * 10000, x.size) as end1, chrom2, b2 * 10000 as start2, least((b2 + 1) * 10000, y.size) as end2,
               ((n * 7919 + b1 * 31 + b2 * 17) % 1000 + 1) / 1000.0 as pvalue
        from px join chroms x on x.chrom = chrom1 join chroms y on y.chrom = chrom2)"""


def _bh_sql(group: str, value: str = "least(raw, coalesce(lead(raw) over w, raw))") -> str:
    part = f"partition by {group} " if group else ""
    return f"""{_MADE_UP},
    rk as (select *, least(1.0, pvalue * count(*) over ({part}) / row_number() over ({part} order by pvalue, {_RECT})) as raw from mu)
    select {_RECT}, pvalue, round({value}, 9) + 0.0 as pvalue_corrected from rk window w as ({part} order by pvalue, {_RECT})"""


def _bh(spark: SparkSession, sf_dir: str, by: str, method: str = "reference", **more) -> DataFrame:
    found = benjamini_hochberg(_made_up(spark, sf_dir), by, method, **more)
    return found.select(*COORDINATES, "pvalue", F.round("pvalue_corrected", 9).alias("pvalue_corrected"))


@query(_bh_sql(""))
def bh_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bh(spark, sf_dir, "all")


@query(_bh_sql("chrom1 = chrom2"))
def bh_cis_trans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bh(spark, sf_dir, "cis-trans")


@query(_bh_sql("chrom1, chrom2"))
def bh_chrom_chrom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bh(spark, sf_dir, "chrom-chrom")


_FROM_HERE = f"min(raw) over (partition by chrom1 = chrom2 order by pvalue, {_RECT} rows between current row and unbounded following)"


@query(_bh_sql("chrom1 = chrom2", _FROM_HERE))
def bh_textbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bh(spark, sf_dir, "cis-trans", "textbook")


@query(_bh_sql("chrom1 = chrom2"))
def bh_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way taken for large inputs."""
    return _bh(spark, sf_dir, "cis-trans", window_bytes=-1)


@query(_bh_sql("chrom1 = chrom2", _FROM_HERE))
def bh_textbook_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bh(spark, sf_dir, "cis-trans", "textbook", window_bytes=-1)


_FILTERED = f"""
    , rk as (select *, least(1.0, pvalue * count(*) over () / row_number() over (order by pvalue, {_RECT})) as raw from res where chrom1 = chrom2),
    fl as (select *, least(raw, coalesce(lead(raw) over (order by pvalue, {_RECT}), raw)) as pvalue_corrected from rk)
    select {_COORDS}, {_ROUNDED}, round(log10(greatest(pvalue_corrected, 1e-300)), 4) + 0.0 as log_pvalue_corrected from fl"""


@query(f"{_FILTERED} where pvalue_corrected <= 0.01 and log_ratio >= 2")
def filter_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(filter_results(compute(pixel_table(spark, sf_dir), GENOME, RAW, kind="cis")))


@query(_FILTERED)
def filter_keep_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(filter_results(compute(pixel_table(spark, sf_dir), GENOME, RAW, kind="cis"), keep_all=True))


@query(f"select {_COORDS}, {_ROUNDED} from res")
def merge_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pixel_table(spark, sf_dir)
    return rounded(merge_results([compute(found, GENOME, RAW, kind=k) for k in ("trans", "cis")], GENOME))


@query(f"select {_COORDS}, {_ROUNDED} from res")
def results_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written by pair and read again."""
    path = scratch(spark, "results")
    write_results(compute(pixel_table(spark, sf_dir), GENOME, RAW), path, GENOME)
    return rounded(read_results(spark, path))


@query(f"select {_COORDS}, {_ROUNDED} from res where chrom1 = 'chr_a' and start1 >= 100000 and start1 < 300000 and chrom2 = 'chr_b' and start2 >= 50000 and start2 < 250000")
def view_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(compute(pixel_table(spark, sf_dir), GENOME, RAW), "chr_a:100,000-300,000", "chr_b:50,000-250,000"))


@query(f"select {_COORDS}, {_ROUNDED} from res where pvalue <= 0.05 and not (isfinite(log_ratio) and log_ratio < 0.5)")
def view_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view(compute(pixel_table(spark, sf_dir), GENOME, RAW), pvalue=0.05, log_ratio=0.5))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cis contacts with corrected p-values, significant or not."""
    return filter_results(compute(pixel_table(spark, sf_dir), GENOME, REPAIRED, kind="cis"), keep_all=True)


from . import io_queries  # noqa: E402, F401  registers its own, which use what is above

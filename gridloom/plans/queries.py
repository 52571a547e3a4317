"""The catalogue of queries over the driver's tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.grid import Grid, GridMeta
from gridloom.operators import cells, distance, frequency, geometry, mining, models, motion, objects, segment, spectral, stats, stencil, texture, tracking
from gridloom.plans import compositions
from gridloom.plans.tables import FRAME, META, g1, g1g, g2, points, read, shared_dir, sql
from gridloom.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
M = -9999


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def grid_query(name: str, make: Callable[[Grid], Grid | DataFrame], body: str | None = None, source=g1g, tables: str = "g1 g1g") -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        out = make(source(spark, d))
        return out.df if isinstance(out, Grid) else out

    query(name, sql(tables, body) if body else None)(f)


R = '"row"'
V = '"value"'
_map = lambda e: f'select "row", col, cast({e} as int) "value" from g1g'

# cells
grid_query("grid_crop", lambda g: cells.crop(g, 8, 5, 20, 30), 'select "row" - 8 "row", col - 5 col, "value" from g1g where "row" between 8 and 27 and col between 5 and 34')
grid_query("grid_locations", cells.locations, 'select "row", col, "value", 50.0::double - ("row" + 0.5) * 0.5 lat, -100.0::double + (col + 0.5) * 0.5 lon from g1g')
grid_query("grid_scale_linear", lambda g: cells.linear_scale(g, 0.25), _map(f"case when {V} = {M} then {M} else floor({V} * 0.25::double + 0.5) end"))
grid_query("grid_scale_log", lambda g: cells.log_scale(g, 100), _map(f"case when {V} = {M} then {M} when {V} > 1 then floor(100.0::double * log10({V}::double) + 0.5) else 0 end"))
grid_query("threshold", lambda g: cells.threshold(g, 500), _map(f"({V} >= 500)::int"))
grid_query("saturate", lambda g: cells.saturate(g, 300, 700), _map(f"case when {V} = {M} then 300 else least(greatest({V}, 300), 700) end"))
grid_query("invert", lambda g: cells.invert(g, 1000), _map(f"case when {V} = {M} then {M} else 1000 - {V} end"))
grid_query("multiply", lambda g: cells.multiply(g, 3), _map(f"{V} * 3"))
grid_query("replace_value", lambda g: cells.replace_value(g, M, 0), _map(f"case when {V} = {M} then 0 else {V} end"))
grid_query("fill", lambda g: cells.fill(g, 7), _map("7"))
grid_query("pad", lambda g: cells.pad(g, 50, 70), f'select r::int "row", c::int col, coalesce("value", {M}) "value" from (select unnest(range(50)) r), (select unnest(range(70)) c) left join g1g on "row" = r and col = c')
grid_query("longitude_wrap", lambda g: cells.wrap_longitude(g, 10), f'select "row", (col + k + 5)::int col, "value" from g1g, (select unnest([0, -64, 64]) k) where col + k >= -5 and col + k < 69')
grid_query("upsample", lambda g: cells.upsample(g, 2), f'select ("row" * 2 + i)::int "row", (col * 2 + j)::int col, "value" from g1g, (select unnest(range(2)) i), (select unnest(range(2)) j)')
grid_query("decimate", lambda g: cells.decimate(g, 4), f'select ("row" // 4)::int "row", (col // 4)::int col, "value" from g1g where "row" % 4 = 0 and col % 4 = 0')
grid_query("top_n", lambda g: cells.top_n(g, 25), f'select "row", col, "value" from g1g where "value" <> {M} order by "value" desc, "row", col limit 25')
grid_query("top_n_ties", lambda g: cells.top_n_ties(g, 25), f'select "row", col, "value" from g1g where "value" <> {M} qualify rank() over (order by "value" desc) <= 25')
grid_query("argmax", cells.argmax, f'select "row", col, "value" from g1g where "value" <> {M} order by "value" desc, "row", col limit 1')
grid_query("level_set", cells.level_set, f'select "value", count(*) n from g1g where "value" <> {M} group by 1')
grid_query("remap", lambda g: cells.remap(g, Grid(g.df, GridMeta(30, 40, M, 48.0, -99.0, 0.7, 0.7))), f"""select r::int "row", c::int col, coalesce("value", {M}) "value" from (select unnest(range(30)) r), (select unnest(range(40)) c)
    left join g1g on "row" = trunc((50.0::double - (48.0::double - (r + 0.5) * 0.7::double)) / 0.5)::int and col = trunc(((-99.0::double + (c + 0.5) * 0.7::double) + 100.0) / 0.5)::int""")


@query("grid_point_lookup", sql("g1 g1g pts", f"""select id, lat, lon, coalesce(g1g."value", {M}) "value" from pts left join g1g
    on g1g."row" = trunc((50.0::double - lat) / 0.5)::int and g1g.col = trunc((lon + 100.0::double) / 0.5)::int"""))
def _lookup(spark, d):
    return cells.lookup(g1g(spark, d), points(spark, d).drop("value")).select("id", "lat", "lon", "value")


grid_query("grid_add", lambda g: cells.add(g, cells.invert(g, 1000)), _map(f"case when {V} = {M} then {M} else 1000 end"))


@query("grid_diff", sql("f1 f2", 'select "row", col, f2."value" - f1."value" "value" from f1 join f2 using ("row", col)'))
def _diff(spark, d):
    return cells.difference(g2(spark, d, 4), g2(spark, d, 3)).df


@query("aligned_diff", sql("f1 f2", """, m as (select "row", col, "row" % 3 * 10 u, col % 2 * 10 v from f1)
    select f2."row", f2.col, f2."value" - coalesce(b."value", f1."value") "value" from f2 join m using ("row", col) join f1 using ("row", col)
    left join f1 b on b."row" = m."row" - floor(u / 10.0 + 0.5)::int and b.col = m.col - floor(v / 10.0 + 0.5)::int""").replace(" , m as", ", m as"))
def _aligned(spark, d):
    now = g2(spark, d, 4)
    m = now.df.select("row", "col", (F.col("row") % 3 * 10).alias("u"), (F.col("col") % 2 * 10).alias("v"))
    return cells.aligned_difference(now, g2(spark, d, 3), m, 10.0).df


# statistics
grid_query("scalar_stats", lambda g: _rounded(stats.scalar(g.valid)), f"""select round(avg({V}), 6) mean, round(var_pop({V}), 6) variance, round(stddev_pop({V}), 6) stddev, min({V}) "min", max({V}) "max", count(*) n from g1g where {V} <> {M}""")
grid_query("weighted_stats", lambda g: _rounded(stats.weighted(g.valid, "value", "col")), f"""select round(sum(col * {V}) / sum(col)::double, 6) mean, round(sum(col::double * {V} * {V}) / sum(col)::double - power(sum(col * {V}) / sum(col)::double, 2), 6) variance, sum(col)::bigint n from g1g where {V} <> {M}""")
_H = f""", h as (select b::int bin, (b * 50)::int lo, ((b + 1) * 50)::int hi, coalesce(n, 0)::bigint n from (select unnest(range(16)) b) left join
    (select least({V} // 50, 15) k, count(*) n from g1g where {V} <> {M} and {V} >= 0 group by 1) on k = b)"""


def _hist(g: Grid) -> DataFrame:
    return stats.histogram(g, 0, 50, 16)


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def hist_query(name: str, make, body: str) -> None:
    grid_query(name, lambda g: make(_hist(g)), body)
    ORACLE[name] = sql("g1 g1g", "")[:-1] + _H + " " + body


hist_query("histogram", lambda h: h, "select bin, lo, hi, n from h")
hist_query("cdf", lambda h: _rounded(stats.cdf(h)), "select bin, lo, hi, round(sum(n) over (order by bin) / sum(n) over ()::double, 6) prob from h")
hist_query("entropy", lambda h: _rounded(stats.entropy(h)), "select round(sum(-p * log2(p)), 6) entropy from (select n / sum(n) over ()::double p from h where n > 0)")
hist_query("otsu", stats.otsu, """select case when v > 0 then hi else 0 end threshold from (select bin, hi, round(case when w > 1e-12 and w < 1 - 1e-12 then power(t * w - m, 2) / (w * (1 - w)) else 0 end, 9) v from
    (select bin, hi, sum(p) over (order by bin) w, sum(p * bin) over (order by bin) m, sum(p * bin) over () t from (select bin, hi, n / sum(n) over ()::double p from h))) order by v desc, bin limit 1""")
for _how, _n in {"range": "1 + floor(log2(greatest(hi - lo, 1)) + 0.5)", "full": "hi - lo + 1", "stddev": "1 + floor(3.5::double * sd / power(n, 1.0::double / 3) + 0.5)", "sqrt": "1 + floor(sqrt(n) + 0.5)"}.items():
    grid_query(f"hist_bins_{_how}", lambda g, how=_how: stats.bin_choice(g, how), f"""select lo low, {'1' if _how == 'full' else 'greatest(1, (hi - lo) // nbins)'}::int incr, nbins from (select *, ({_n})::int nbins from
        (select min({V}) lo, max({V}) hi, stddev_pop({V}) sd, count(*) n from g1g where {V} <> {M}))""")
grid_query("band_hist", lambda g: stats.band(g, 0, 50, 16), _map(f"case when {V} = {M} or {V} < 0 then {M} else least({V} // 50, 15) * 50 + 25 end"))
grid_query("equal_freq_band", lambda g: stats.equal_frequency_band(g, stats.quantizer(_hist(g), 4)), "select 1")
ORACLE["equal_freq_band"] = "with recursive " + sql("g1 g1g", "")[5:-1] + _H + f""", want as (select sum(n) / 4.0::double w from h),
    fill as (select -1 bin, 0::hugeint have, 0 k, 0 hi, false full_ union all
        select h.bin, case when fill.have + n >= w and fill.k < 4 then 0 else fill.have + n end, fill.k + (fill.have + n >= w and fill.k < 4)::int, h.hi, fill.have + n >= w and fill.k < 4 from fill join h on h.bin = fill.bin + 1, want),
    bound as (select k - 1 i, hi from fill where full_ union all select i, (select max(hi) from h) from (select unnest(range(4)) i) where i >= (select max(k) from fill))
    select "row", col, coalesce(min(i), {M})::int "value" from g1g left join bound on {V} < hi group by 1, 2"""
_B = f"case when {V} = {M} or {V} < 0 then 6 else least({V} // 200, 5) end"
_GLCM = f""", b as (select "row", col, {_B} b from g1g), m as (select x.b b1, coalesce(y.b, 6) b2, count(*) / 3072.0::double p from b x left join b y on y."row" = x."row" and y.col = x.col + 1 group by 1, 2)"""
grid_query("glcm_east", lambda g: _rounded(stats.glcm(g, 0, 200, 6), 9), "select 1")
ORACLE["glcm_east"] = sql("g1 g1g", "")[:-1] + _GLCM + " select b1::int b1, b2::int b2, round(p, 9) p from m"
grid_query("glcm_measures", lambda g: _rounded(stats.glcm_measures(stats.glcm(g, 0, 200, 6))), "select 1")
ORACLE["glcm_measures"] = sql("g1 g1g", "")[:-1] + _GLCM + " select round(sum(p * p), 6) uniformity, round(sum(p * log2(p)), 6) entropy, round(max(p), 6) max_prob, round(sum(case when b1 <> b2 then p * p / power(abs(b1 - b2), 2) else 0 end), 6) moment from m"
grid_query("linearity_mse", lambda g: _rounded(stats.linearity(g, lambda v: v * 2, lambda v: v / 2)), "select 1")
ORACLE["linearity_mse"] = sql("g1 g1g", "")[:-1] + f""", v as (select "row", col, nullif({V}, {M})::double v from g1g), t as (
    select v, lag(v) over (partition by "row" order by col) a, lead(v) over (partition by "row" order by col) b from v
    union all select v, lag(v) over (partition by col order by "row") a, lead(v) over (partition by col order by "row") b from v)
    select round(avg(power((a * 2 + b * 2) / 2 / 2 - v, 2)), 6) mse, count(*) n from t where v is not null and a is not null and b is not null"""
grid_query("kth_smallest", lambda g: g.valid.groupBy("row").agg(F.element_at(F.array_sort(F.collect_list("value")), 6).alias("value")), f'select "row", list_sort(list({V}))[6] "value" from g1g where {V} <> {M} group by 1')
_L = 'case when "value" < 0 then 0 else "value" % 9 end'


def _labels(g: Grid) -> DataFrame:
    return g.df.withColumn("label", F.when(F.col("value") < 0, 0).otherwise(F.col("value") % 9))


grid_query("region_props", lambda g: _rounded(stats.regions(_labels(g)).select("label", "cx", "cy", "cval", "size", "cxy")), f'select {_L} label, round(avg("row"), 6) cx, round(avg(col), 6) cy, round(avg({V}), 6) cval, count(*) size, round(avg("row" * col), 6) cxy from g1g where {_L} > 0 group by 1')
grid_query("region_ellipses", lambda g: _rounded(stats.ellipses(stats.regions(_labels(g))), 4), f"""select label, round(2 * sqrt(greatest(e1, 0)), 4) a, round(2 * sqrt(greatest(e2, 0)), 4) b, round(degrees(atan2(e1 - s11, s12)), 4) phi
    from (select *, (s11 + s22 + sqrt(power(s11 - s22, 2) + 4 * s12 * s12)) / 2 e1, (s11 + s22 - sqrt(power(s11 - s22, 2) + 4 * s12 * s12)) / 2 e2 from (select {_L} label, avg("row" * "row") - power(avg("row"), 2) s11, avg(col * col) - power(avg(col), 2) s22, avg("row" * col) - avg("row") * avg(col) s12
    from g1g where {_L} > 0 group by 1))""")
grid_query("prune", lambda g: stats.prune(_labels(g), 340), f"""select "row", col, {V}, coalesce(k, 0)::int label from (select *, {_L} l from g1g) left join
    (select l, dense_rank() over (order by l) k from (select {_L} l, count(*) n from g1g group by 1) where l > 0 and n >= 340) using (l)""")
grid_query("region_size", lambda g: stats.region_size(_labels(g)), f'select "row", col, (case when {_L} = 0 then 0 else count(*) over (partition by {_L}) end)::int "value" from g1g')
grid_query("weighted_centroid", lambda g: _rounded(stats.weighted_centroid(g)), f'select round(sum("row" * {V}) / sum({V})::double, 6) cx, round(sum(col * {V}) / sum({V})::double, 6) cy, round(avg({V}), 6) weight from g1g where {V} <> {M}')


# neighbourhoods
def _around(agg: str, h: int, inner: bool = True, src: str = "g1g", none: int = M) -> str:
    edge = f'case when a."row" between {h} and {47 - h} and a.col between {h} and {63 - h} then coalesce({agg}, {none}) else {none} end' if inner else agg
    return f"""select a."row", a.col, cast({edge} as int) "value" from {src} a left join {src} b on b."row" between a."row" - {h} and a."row" + {h} and b.col between a.col - {h} and a.col + {h} and b."value" <> {M} group by a."row", a.col"""


grid_query("dilate", lambda g: stencil.dilate(g, 2), _around('max(b."value")', 2))
grid_query("erode", lambda g: stencil.erode(g, 2), _around('min(b."value")', 2))
for _name, _first, _then in (("close", "max", "min"), ("open", "min", "max")):
    grid_query(f"morph_{_name}", lambda g, n=_name: (stencil.close if n == "close" else stencil.open_)(g, 1), "select 1")
    ORACLE[f"morph_{_name}"] = sql("g1 g1g", "")[:-1] + ", one as (" + _around(f'{_first}(b."value")', 1) + ") " + _around(f'{_then}(b."value")', 1, src="one")
grid_query("smooth_boxcar", lambda g: stencil.smooth(g, stencil.boxcar(3)), _around('floor(sum(b."value") / count(b."value")::double + 0.5)', 1))
grid_query("convolve_boxcar", lambda g: stencil.convolve(g, stencil.boxcar(3)), f'select "row", col, case when "row" between 1 and 46 and col between 1 and 62 and "value" = {M} then 0 else "value" end "value" from (' + _around('sum(b."value")', 1) + ")")
_W = 'exp(-power((b."row" - a."row" - 0.5::double) / (5 / 6.0::double), 2) - power((b.col - a.col - 0.5::double) / (5 / 6.0::double), 2))'
grid_query("smooth_gauss", lambda g: stencil.smooth(g, stencil.gauss(5)), _around(f'floor(sum({_W} * b."value") / sum({_W}) + 0.5)', 2))
_three = lambda src, by, along, n, none: f"""select "row", col, case when {along} between 1 and {n - 2} then coalesce(floor((coalesce(a, 0) + 2 * coalesce(v, 0) + coalesce(b, 0)) / nullif((a is not null)::int + 2 * (v is not null)::int + (b is not null)::int, 0)::double + 0.5)::int, {none}) else {none} end "value"
    from (select *, lag(v) over o a, lead(v) over o b from (select "row", col, nullif("value", {M}) v from {src}) window o as (partition by {by} order by {along}))"""  # noqa: E731
grid_query("separable_smooth", lambda g: stencil.separable_smooth(g, [1.0, 2.0, 1.0], [1.0, 2.0, 1.0]), "select 1")
ORACLE["separable_smooth"] = sql("g1 g1g", "")[:-1] + ", one as (" + _three("g1g", "col", '"row"', 48, 0) + ") " + _three("one", '"row"', "col", 64, M)
grid_query("median", lambda g: stencil.median(g, 1), _around('list_sort(list(b."value") filter (b."value" is not null))[count(b."value") // 2 + 1]', 1))
grid_query("speckle", lambda g: stencil.speckle(g, 1, 80), f"""select "row", col, case when m."value" <> {M} and abs(g1g."value" - m."value") > 80 then m."value" else g1g."value" end "value" from g1g join (""" + _around('list_sort(list(b."value") filter (b."value" is not null))[count(b."value") // 2 + 1]', 1) + ') m using ("row", col)')
_K = '(2 - abs(b."row" - a."row") - abs(b.col - a.col))'
grid_query("matched_filter", lambda g: stencil.matched(g, [[0.0, 1.0, 0.0], [1.0, 2.0, 1.0], [0.0, 1.0, 0.0]]), _around(f'floor(round(10000 * sum({_K} / 6.0::double * b."value") / nullif(sum(b."value") filter ({_K} > 0), 0)::double, 6) + 0.5)', 1, none=-1))
_at = lambda i, j: f'max(b."value") filter (b."row" = a."row" + {i} and b.col = a.col + {j})'
_GX = f"{_at(-1, 1)} + 2 * {_at(0, 1)} + {_at(1, 1)} - {_at(-1, -1)} - 2 * {_at(0, -1)} - {_at(1, -1)}"
_GY = f"{_at(1, -1)} + 2 * {_at(1, 0)} + {_at(1, 1)} - {_at(-1, -1)} - 2 * {_at(-1, 0)} - {_at(-1, 1)}"
grid_query("sobel", stencil.sobel, f"""select a."row", a.col, (case when count(*) filter (b."row" <> a."row" or b.col <> a.col) = 8 then abs({_GX}) + abs({_GY}) else {M} end)::int "value"
    from g1g a left join g1g b on b."row" between a."row" - 1 and a."row" + 1 and b.col between a.col - 1 and a.col + 1 and b."value" <> {M} group by a."row", a.col""")
grid_query("local_stats", lambda g: stencil.local_stats(g, 5, 3), f"""select a."row", a.col, coalesce(floor(avg(b."value") + 0.5), {M})::int mean, coalesce(floor(sqrt(greatest(avg(b."value"::double * b."value") - power(avg(b."value"), 2), 0)) + 0.5), {M})::int stdev,
    coalesce(min(b."value"), {M}) "min", coalesce(max(b."value"), {M}) "max" from g1g a left join g1g b on b."row" between a."row" - 2 and a."row" + 2 and b.col between a.col - 1 and a.col + 1 and b."value" <> {M} group by a."row", a.col""")


# segmentation, distance, thinning
def _cut(g: Grid) -> int:
    return stats.otsu(stats.histogram(g, 0, 25, 60)).first()[0]


def _otsu_sql(name: str, src: str, low: int, incr: int, nbins: int, missing: int = M) -> str:
    """A one-row table (t) with the threshold of stats.otsu over a histogram."""
    return f"""{name} as (select case when v > 0 then hi else {low} end t from (select bin, hi, round(case when w > 1e-12 and w < 1 - 1e-12 then power(t * w - m, 2) / (w * (1 - w)) else 0 end, 9) v from
    (select bin, hi, sum(p) over (order by bin) w, sum(p * bin) over (order by bin) m, sum(p * bin) over () t from (select b::int bin, {low} + (b + 1) * {incr} hi, coalesce(n, 0) / sum(coalesce(n, 0)) over ()::double p
    from (select unnest(range({nbins})) b) left join (select least(("value" - {low}) // {incr}, {nbins - 1}) k, count(*) n from {src} where "value" <> {missing} and "value" >= {low} group by 1) on k = b))) order by v desc, bin limit 1)"""


def _label_ctes(p: str, src: str, ncols: int, low: str, first: str) -> str:
    """Components of cells of src above low, by the smallest id that reaches a cell (p_reach), numbered by their first cell for which first holds (p_no)."""
    return f"""{p}_live as (select "row" r, col c, "row" * {ncols} + col id, "value" v from {src} where "value" > {low}),
    {p}_reach(id, r, c, root) using key (id) as (select id, r, c, id from {p}_live union
        select l.id, l.r, l.c, min(x.root) from {p}_reach x join {p}_live l on abs(l.r - x.r) <= 1 and abs(l.c - x.c) <= 1 join recurring.{p}_reach y on y.id = l.id where x.root < y.root group by all),
    {p}_no as (select root, row_number() over (order by k) n from (select root, min(id) k from {p}_reach join {p}_live using (id) where {first} group by 1))"""


def _labels_sql(low: str, first: str) -> str:
    return f"""with recursive {sql("g1 g1g", "")[5:-1]}, {_otsu_sql("cut", "g1g", 0, 25, 60)}, {_label_ctes("a", "g1g", 64, low, first)}
    select g1g."row", g1g.col, "value", coalesce(n, 0)::int label from g1g left join a_reach on a_reach.id = g1g."row" * 64 + g1g.col left join a_no using (root)"""


grid_query("threshold_segment", lambda g: segment.label(g, _cut(g)))
grid_query("hysteresis", lambda g: segment.hysteresis(g, _cut(g), _cut(g) + 60))
ORACLE |= {"threshold_segment": _labels_sql("(select t from cut)", "true"), "hysteresis": _labels_sql("(select t from cut)", "v > (select t from cut) + 60")}
grid_query("watershed", lambda g: segment.watershed(g, _cut(g)))
grid_query("kmeans_contiguity", lambda g: segment.kmeans_contiguity(g, _cut(g), _cut(g) + 120, 400.0, 20.0))
_EDT = f"""select a."row", a.col, coalesce(min((a."row" - b."row") * (a."row" - b."row") + (a.col - b.col) * (a.col - b.col)), 6400)::int "value" from g1g a left join g1g b on b."value" > 800 group by a."row", a.col"""
grid_query("edt", lambda g: distance.edt(g, 800), _EDT)
grid_query("edt_clamped", lambda g: distance.edt_clamped(g, 800, 50), f'select "row", col, case when "value" > 50 then {M} else "value" end "value" from ({_EDT})')
grid_query("medial_axis", lambda g: distance.medial_axis(g, 500), "select 1")
ORACLE["medial_axis"] = sql("g1 g1g", "")[:-1] + """, d as (select a."row", a.col, coalesce(min((a."row" - b."row") * (a."row" - b."row") + (a.col - b.col) * (a.col - b.col)), 6400) v from g1g a left join g1g b on b."value" <= 500 group by 1, 2)
    select "row", col, (v <> 0 and v >= coalesce(lag(v) over r, 0) and v >= coalesce(lead(v) over r, 0) and v >= coalesce(lag(v) over c, 0) and v >= coalesce(lead(v) over c, 0))::int "value" from d
    window r as (partition by "row" order by col), c as (partition by col order by "row")"""
_RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def _thin_sql(src: str) -> str:
    """Rounds of peeling of the cells (r, c, v) of src, 40 of them: more than any shape of 48 rows needs, and a thin one stays."""
    got = ", ".join(f"coalesce(max(y.v) filter (y.r = x.r + {i} and y.c = x.c + {j}), 0) p{k}" for k, (i, j) in enumerate(_RING))
    change = " + ".join(f"(p{k} = 0 and p{(k + 1) % 8} = 1)::int" for k in range(8))
    return f"""thin(k, r, c, v) as (select 0, r, c, v from {src} union all select k + 1, r, c, case when v = 1 and r between 1 and 46 and c between 1 and 62 and b between 2 and 6 and a = 1
        and (p0 * p2 * p6 = 0 or north <> 1) and (p0 * p2 * p4 = 0 or east <> 1) then 0 else v end from (select *, coalesce(lag(a) over (partition by c order by r), 0) north, coalesce(lead(a) over (partition by r order by c), 0) east
        from (select *, {change} a, p0 + p1 + p2 + p3 + p4 + p5 + p6 + p7 b from (select x.k, x.r, x.c, any_value(x.v) v, {got} from thin x left join thin y on abs(y.r - x.r) <= 1 and abs(y.c - x.c) <= 1 where x.k < 40 group by 1, 2, 3))))"""


grid_query("skeleton", lambda g: distance.skeleton(g, 500))
ORACLE["skeleton"] = f"""with recursive {sql("g1 g1g", "")[5:-1]}, bold as (select "row" r, col c, ({V} > 500)::int v from g1g), {_thin_sql("bold")} select r "row", c col, v "value" from thin where k = 40"""


# geometry and points
@query("nearest_point", sql("pts", """, p as (select s_suppkey place, 26 + (s_suppkey * 41 % 240) / 10.0::double plat, -100 + (s_suppkey * 59 % 320) / 10.0::double plon from supplier)
    select id, lat, lon, arg_min(place, (power(lat - plat, 2) + power(lon - plon, 2), place)) filter (power(lat - plat, 2) + power(lon - plon, 2) < 4.0) place from pts, p group by 1, 2, 3""").replace(") , p", "), p"))
def _nearest(spark, d):
    k = F.col("s_suppkey")
    places = read(spark, d, "supplier").select(k.alias("place"), (26 + (k * 41 % 240) / 10.0).alias("plat"), (-100 + (k * 59 % 320) / 10.0).alias("plon"))
    return geometry.nearest(points(spark, d).select("id", "lat", "lon"), places, 2.0)


@query("mean_nn_distance", sql("pts", 'select round(avg(m), 6) mean, count(*) n from (select min(sqrt(power(a.lat - b.lat, 2) + power(a.lon - b.lon, 2))) m from pts a join pts b on a.id <> b.id group by a.id)'))
def _nn(spark, d):
    return _rounded(geometry.mean_neighbour_distance(points(spark, d)))


#: Rings around the customers of each nation: the eighth k of them, by key, stretches corner k.
_CORNERS = [(1.0, 0.0), (0.7, 0.7), (0.0, 1.0), (-0.7, 0.7), (-1.0, 0.0), (-0.7, -0.7), (0.0, -1.0), (0.7, -0.7)]
_POLY = f"""(select n poly, k seq, 29.03::double + n % 5 * 4 + (1 + 0.37::double * (c % 7)) * y lat, -96.01::double + n // 5 * 6 + (1 + 0.37::double * (c % 7)) * x lon
    from (select c_nationkey n, c_custkey % 8 k, count(*) c from customer group by 1, 2) join (values {", ".join(f"({k}, {y}::double, {x}::double)" for k, (y, x) in enumerate(_CORNERS))}) t(k, y, x) using (k)) t"""


def _vertices(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("poly"), (F.col("c_custkey") % 8).alias("seq")).agg(F.count("*").alias("c"))
    far = 1 + F.lit(0.37) * (F.col("c") % 7)
    y, x = (F.get(F.array(*(F.lit(c[i]) for c in _CORNERS)), F.col("seq").cast("int")) for i in (0, 1))
    return n.select("poly", "seq", (F.lit(29.03) + F.col("poly") % 5 * 4 + far * y).alias("lat"), (F.lit(-96.01) + F.floor(F.col("poly") / 5) * 6 + far * x).alias("lon"))


@query("point_in_polygon", sql("pts", f""", e as (select poly, lat y0, lon x0, coalesce(lead(lat) over w, first_value(lat) over w) y1, coalesce(lead(lon) over w, first_value(lon) over w) x1 from {_POLY} window w as (partition by poly order by seq)),
    h as (select id, poly from pts join e on true group by id, poly having count(*) filter ((y0 > lat) <> (y1 > lat) and lon < x0 + (lat - y0) * (x1 - x0) / (y1 - y0)) % 2 = 1
    and count(*) filter ((x0 > lon) <> (x1 > lon) and lat < y0 + (lon - x0) * (y1 - y0) / (x1 - x0)) % 2 = 1)
    select id, lat, lon, coalesce(min(poly), -1)::int poly from pts left join h using (id) group by 1, 2, 3""").replace(") , e", "), e"))
def _pip(spark, d):
    return geometry.point_in_polygon(points(spark, d).drop("value"), _vertices(spark, d)).select("id", "lat", "lon", "poly")


@query("polygon_area", f"""with e as (select poly, lat y0, lon x0, coalesce(lead(lat) over w, first_value(lat) over w) y1, coalesce(lead(lon) over w, first_value(lon) over w) x1 from {_POLY} window w as (partition by poly order by seq))
    select poly, round(abs(sum(x0 * y1 - x1 * y0) / 2), 6) area from e group by 1""")
def _area(spark, d):
    return geometry.area(_vertices(spark, d)).select("poly", F.round("area", 6).alias("area"))


@query("polygon_raster", f"""with pts as (select r::int "row", c::int col, 50.0::double - (r + 0.5) * 0.5 lat, -100.0::double + (c + 0.5) * 0.5 lon from (select unnest(range(48)) r), (select unnest(range(64)) c)),
    e as (select poly, lat y0, lon x0, coalesce(lead(lat) over w, first_value(lat) over w) y1, coalesce(lead(lon) over w, first_value(lon) over w) x1 from {_POLY} window w as (partition by poly order by seq)),
    h as (select "row", col, poly from pts join e on true group by all having count(*) filter ((y0 > lat) <> (y1 > lat) and lon < x0 + (lat - y0) * (x1 - x0) / (y1 - y0)) % 2 = 1
    and count(*) filter ((x0 > lon) <> (x1 > lon) and lat < y0 + (lon - x0) * (y1 - y0) / (x1 - x0)) % 2 = 1)
    select "row", col, coalesce(min(poly), -1)::int "value" from pts left join h using ("row", col) group by 1, 2""")
def _praster(spark, d):
    return geometry.polygon_raster(META, _vertices(spark, d)).df


@query("oban_gather", sql("pts", """select r::int "row", c::int col, coalesce(cast(floor(sum(w * "value") / sum(w) + 0.5) as int), -9999) "value" from (select unnest(range(24)) r), (select unnest(range(32)) c) left join lateral
    (select "value", (1 - d / 9.0) / (1 + d / 9.0) w from (select "value", power(50.0 - (r + 0.5) - lat, 2) + power(-100.0 + (c + 0.5) - lon, 2) d from pts) where d < 9.0) on true group by r, c"""))
def _oban(spark, d):
    return geometry.interpolate(points(spark, d), GridMeta(24, 32, M, 50.0, -100.0, 1.0, 1.0), geometry.cressman(3.0), 3.0).df


_near = lambda src, v: f"""select r, c, coalesce(floor(sum(w * x) / sum(w) + 0.5)::int, -9999) v from (select unnest(range(24)) r), (select unnest(range(32)) c) left join lateral
    (select {v} x, exp(-d / 2) w from (select {v}, power(50.0::double - (r + 0.5) - lat, 2) + power(-100.0::double + (c + 0.5) - lon, 2) d from {src}) where d < 18) on true group by r, c"""  # noqa: E731


@query("oban_multipass", sql("pts", "")[:-1] + f""", a as ({_near("pts", '"value"')}), res as (select lat, lon, "value" - v rest from pts join a on r = trunc(50.0::double - lat)::int and c = trunc(lon + 100.0::double)::int where v <> {M}),
    b as ({_near("res", "rest")}), ends as (select min("value") lo, max("value") hi from pts)
    select a.r::int "row", a.c::int col, case when a.v = {M} or b.v = {M} then a.v else least(greatest(a.v + b.v, lo), hi) end "value" from a join b on a.r = b.r and a.c = b.c, ends""")
def _oban2(spark, d):
    return geometry.interpolate_passes(points(spark, d), GridMeta(24, 32, M, 50.0, -100.0, 1.0, 1.0), geometry.gaussian(1.0), 4.3, 2).df


@query("oban_scatter", sql("pts", """select r::int "row", c::int col, coalesce(cast(floor(sum(w * "value") / sum(w) + 0.5) as int), -9999) "value" from (select unnest(range(24)) r), (select unnest(range(32)) c) left join lateral
    (select "value", (1 - d / 9.0::double) / (1 + d / 9.0::double) w from (select "value", power(r - trunc((50.0::double - lat) / 1.0)::int, 2)::double + power(c - trunc((lon + 100.0::double) / 1.0)::int, 2)::double d from pts) where d < 9) on true group by r, c"""))
def _scatter(spark, d):
    return geometry.scatter(points(spark, d), GridMeta(24, 32, M, 50.0, -100.0, 1.0, 1.0), geometry.cressman(3.0), 3.0).df


@query("bounding_grid", sql("pts", """select floor((n - s) / 0.7::double + 0.5)::int nrows, floor((e - w) / 0.7::double + 0.5)::int ncols, round(n, 6) nw_lat, round(w, 6) nw_lon from
    (select floor((min(lat) - 0.7::double) / 0.7::double + 0.5) * 0.7::double s, floor((max(lat) + 0.7::double) / 0.7::double + 0.5) * 0.7::double n, floor((min(lon) - 0.7::double) / 0.7::double + 0.5) * 0.7::double w, floor((max(lon) + 0.7::double) / 0.7::double + 0.5) * 0.7::double e from pts)"""))
def _bounds(spark, d):
    m = geometry.bounding_grid(points(spark, d), 0.7, 0.7)
    return spark.createDataFrame([(m.nrows, m.ncols, round(m.nw_lat, 6), round(m.nw_lon, 6))], "nrows int, ncols int, nw_lat double, nw_lon double")


@query("lambert_roundtrip", sql("pts", "select id, round(lat, 6) lat, round(lon, 6) lon from pts"))
def _lambert(spark, d):
    m = geometry.Lambert(51.0, -97.0, 43.5, 28.5)
    n, e = m.forward(F.col("lat"), F.col("lon"))
    p = points(spark, d).select("id", n.alias("n"), e.alias("e"))
    lat, lon = m.inverse(F.col("n"), F.col("e"))
    return p.select("id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("line_raster", """with l as (select l_orderkey % 48 r0, l_partkey % 64 c0, l_suppkey % 48 r1, l_linenumber * 7 c1, greatest(abs(r1 - r0), abs(c1 - c0)) n from lineitem)
    select distinct (r0 + floor(coalesce((r1 - r0) * k / nullif(n, 0)::double, 0) + 0.5))::int "row", (c0 + floor(coalesce((c1 - c0) * k / nullif(n, 0)::double, 0) + 0.5))::int col from (select *, unnest(range(n + 1)) k from l)""")
def _lines(spark, d):
    li = read(spark, d, "lineitem")
    return geometry.line_cells(li.selectExpr("cast(l_orderkey % 48 as int) r0", "cast(l_partkey % 64 as int) c0", "cast(l_suppkey % 48 as int) r1", "l_linenumber * 7 c1")).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))


@query("spline", sql("pts", """, k as (select lon x1, avg("value"::double) y1 from pts group by 1),
    w as (select x1, y1, lead(x1) over o x2, lead(y1) over o y2, lag(y1) over o p0, lead(y1, 2) over o p3, max(x1) over () top from k window o as (order by x1)),
    p as (select distinct -100 + (s_suppkey * 59 % 320) / 10.0::double + 0.05::double x from supplier),
    m as (select x, (x - x1) / (x2 - x1) t, coalesce(p0, y1) p0, y1 p1, y2 p2, coalesce(p3, y2) p3 from p join w on x >= x1 and (x < x2 or (x = x2 and x2 = top)))
    select round(x, 4) x, round(0.5::double * (2 * p1 + (p2 - p0) * t + (2 * p0 - 5 * p1 + 4 * p2 - p3) * t * t + (3 * p1 - p0 - 3 * p2 + p3) * t * t * t), 4) y from m""").replace(") , k", "), k"))
def _spline(spark, d):
    knots = points(spark, d).select(F.col("lon").alias("x"), F.col("value").cast("double").alias("y"))
    at = read(spark, d, "supplier").select((-100 + (F.col("s_suppkey") * 59 % 320) / 10.0 + 0.05).alias("x")).distinct()
    return _rounded(geometry.catmull_rom(knots, at), 4)


# mining
_m = lambda x: f"least(greatest({x}, 0.0), 1.0)"
grid_query("fuzzy_market", lambda g: Grid(g.df, g.meta).map(lambda v: mining.market((v % 400).cast("double"), (v % 70).cast("double"))), _map(f"floor(10 * least(least(1 - {_m(f'(10.0::double - {V} % 400) / 5.0')}, 1 - {_m(f'({V} % 400 - 30.0::double) / 50.0')}), {_m(f'({V} % 70 - 30.0::double) / 40.0')}) + 0.5)"))
grid_query("linear_model", lambda g: g.map(lambda v: mining.linear_model((v % 400).cast("double"), (v % 70).cast("double"))), _map(f"floor(0.003494::double + 0.034444::double * ({V} % 70) - 0.005992::double * ({V} % 400) + 0.5)"))
grid_query("nearest_centre", lambda g: g.map(lambda v: mining.nearest_centre([(v % 400).cast("double")], [100.0], [50.0], [[160.0], [38.0], [22.0]])), _map(f"case when abs({V} % 400 - 160) <= least(abs({V} % 400 - 38), abs({V} % 400 - 22)) then 0 when abs({V} % 400 - 38) <= abs({V} % 400 - 22) then 1 else 2 end"))
query("correlations", "select round(corr(l_quantity, l_extendedprice), 6) r_l_quantity, round(corr(l_discount, l_extendedprice), 6) r_l_discount from lineitem")(lambda s, d: _rounded(mining.correlations(read(s, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])))
query("regression", "select round(regr_intercept(l_extendedprice, l_quantity), 3) intercept, round(regr_slope(l_extendedprice, l_quantity), 3) slope from lineitem")(lambda s, d: s.createDataFrame([tuple(round(float(x), 3) for x in mining.least_squares(read(s, d, "lineitem"), "l_extendedprice", ["l_quantity"]))], "intercept double, slope double"))
query("rbf_fit", sql("g1 g1g", f"""select round(sum(h * {V}) / sum(h * h), 4) amplitude from (select {V}, exp(-power(("row" - 20) / 8.0::double, 2) - power((col - 30) / 12.0::double, 2)) h from g1g)"""))(lambda s, d: s.createDataFrame([(round(float(mining.rbf_fit(g1g(s, d), [(20, 30, 8, 12)])[0]), 4),)], "amplitude double"))
query("gmm")(lambda s, d: s.createDataFrame([tuple(float(x) for x in c) for c in mining.gmm(points(s, d).select(F.col("lat").alias("x"), F.col("lon").alias("y")), [(32.0, -92.0), (44.0, -76.0)])], "mx double, my double, sxx double, sxy double, syy double"))


# motion
@query("cost_matrix", sql("f1 f2", """, a as (select "value" i, avg("row") x, avg(col) y from f1 where "value" > 0 group by 1), b as (select "value" j, avg("row") x, avg(col) y from f2 where "value" > 0 group by 1)
    select i, j, round(power(a.x - b.x, 2) + power(a.y - b.y, 2), 6) cost from a, b where power(a.x - b.x, 2) + power(a.y - b.y, 2) < 10000""").replace(") , a", "), a"))
def _cost(spark, d):
    return _rounded(motion.cost_matrix(_bands(g2(spark, d, 3)), _bands(g2(spark, d, 4))))


@query("greedy_assign", sql("f1 f2", """, a as (select "value" i, avg("row") x, avg(col) y from f1 where "value" > 0 group by 1), b as (select "value" j, avg("row") x, avg(col) y from f2 where "value" > 0 group by 1)
    select i, j, round(cost, 6) cost from (select i, j, power(a.x - b.x, 2) + power(a.y - b.y, 2) cost from a, b) where cost < 10000 qualify row_number() over (partition by i order by cost, j) = 1""").replace(") , a", "), a"))
def _greedy(spark, d):
    return _rounded(motion.greedy(motion.cost_matrix(_bands(g2(spark, d, 3)), _bands(g2(spark, d, 4)))))


def _bands(g: Grid) -> DataFrame:
    return stats.regions(g.df.withColumn("label", F.col("value")))


query("cross_correlation", sql("f1 f2", """, s as (select (row_number() over (order by u, v))::int k, u::int u, v::int v from (select unnest(range(-2, 3)) u), (select unnest(range(-2, 3)) v)),
    d as (select b."row", b.col, k, u, v, power(b."value" - a."value", 2)::double d, power(b."value", 2)::double q from f2 b, s join f1 a on a."row" = b."row" - u and a.col = b.col - v),
    w as (select "row" + i "row", col + j col, k, u, v, sum(d) d, sum(q) q, count(*) n from d, (select unnest(range(-2, 3)) i), (select unnest(range(-2, 3)) j) group by all),
    best as (select "row", col, arg_min(u, (d / q, k)) u, arg_min(v, (d / q, k)) v from w where q > 0 and d < 0.75::double * q and 2 * n >= 25 group by 1, 2)
    select f2."row", f2.col, coalesce(u, 0)::int u, coalesce(v, 0)::int v from f2 left join best using ("row", col)""").replace(") , s", "), s"))(lambda s, d: motion.cross_correlation(g2(s, d, 3), g2(s, d, 4), 2, 2, 2))
query("frame_difference", ORACLE["grid_diff"])(lambda s, d: motion.frame_difference(g2(s, d, 4), g2(s, d, 3)).df)
query("kalman")(lambda s, d: motion.kalman(read(s, d, "events").groupBy(F.col("event_type").alias("key"), F.dayofmonth("ts").alias("t")).agg(F.count("*").alias("z"))))


@query("horn_schunck")
def _hs(spark, d):
    a, b = (np.array(g2(spark, d, k).df.orderBy("row", "col").toPandas()["value"]).reshape(24, 24) for k in (3, 4))  # one small frame
    u, v = motion.horn_schunck(a, b)
    return spark.createDataFrame([(i // 24, i % 24, int(x), int(y)) for i, (x, y) in enumerate(zip(u.ravel(), v.ravel(), strict=True))], "row int, col int, u int, v int")


query("fft2", sql("f1", """select i::int "row", j::int col, round(sum("value" * cos(2 * pi() * ((i * "row" + j * col) % 32) / 32)), 4) + 0.0::double re, round(-sum("value" * sin(2 * pi() * ((i * "row" + j * col) % 32) / 32)), 4) + 0.0::double im
    from f1, (select unnest(range(32)) i), (select unnest(range(32)) j) group by 1, 2"""))(lambda s, d: spectral.fft2(g2(s, d, 3)).select("row", "col", *((F.round(c, 4) + 0.0).alias(c) for c in ("re", "im"))))
_LINES = """, hot as (select "row" r, col c, theta::int theta, round("row" * cos(radians(theta::double)) + col * sin(radians(theta::double)), 9) rho from g1g, (select unnest(range(0, 360, 20)) theta) where "value" > {t}),
    voted as (select *, floor(rho / 10 + 0.5)::int bin from hot where floor(rho / 10 + 0.5) >= 0),
    line as (select theta, bin, arg_max(rho, (r, c)) rho, count(*) votes, min(r) r0, min(c) c0, max(r) r1, max(c) c1 from voted group by 1, 2),
    found as (select *, case when votes > 1 then floor(votes * votes / sqrt(((r1 - r0) * (r1 - r0) + (c1 - c0) * (c1 - c0))::double) + 0.5)::int else 0 end quality from line)"""
query("hough", sql("g1 g1g", "")[:-1] + _LINES.format(t=800) + " select theta, bin, rho + 0.0::double rho, votes, r0, c0, r1, c1, quality from found")(lambda s, d: spectral.hough(g1g(s, d), 800).withColumn("rho", F.col("rho") + 0.0))
query("line_pixels", sql("g1 g1g", "")[:-1] + _LINES.format(t=800) + """, k as (select *, r1 - r0 > c1 - c0 by_row, unnest(case when r1 - r0 > c1 - c0 then range(r0, r1 + 1) else range(c0, c1 + 1) end) k from found where votes > 1),
    o as (select *, floor(round(case when by_row then (rho - k * cos(radians(theta::double))) / sin(radians(theta::double)) else (rho - k * sin(radians(theta::double))) / cos(radians(theta::double)) end, 6) + 0.5) other from k)
    select theta, bin, (case when by_row then k else other end)::int "row", (case when by_row then other else k end)::int col from o where other >= 0 and other < case when by_row then 64 else 48 end""")(
    lambda s, d: spectral.line_pixels(spectral.hough(g1g(s, d), 800), META.nrows, META.ncols))
_wave = lambda p, v, f: f"""{p} as (select i, j, sum(v * cos(2 * pi() * ((i * r + j * c) % 32) / 32)) re, -sum(v * sin(2 * pi() * ((i * r + j * c) % 32) / 32)) im from (select "row" r, col c, "value" v from {f}), (select unnest(range(32)) i), (select unnest(range(32)) j) group by 1, 2)"""
query("phase_correlation", sql("f1 f2", "")[:-1] + f""", mid as (select "row", col, case when "row" < 6 or col < 6 or "row" > 24 - 6 or col > 24 - 6 then 0 else "value" end "value" from f2), {_wave("a", "v", "f1")}, {_wave("b", "v", "mid")},
    x as (select i, j, (a.re * b.re + a.im * b.im) / s re, (a.im * b.re - a.re * b.im) / s im from (select a.i, a.j, a, b, sqrt((a.re * a.re + a.im * a.im) * (b.re * b.re + b.im * b.im)) s from a join b using (i, j))),
    y as (select r, c, round((power(sum(re * cos(t) - im * sin(t)), 2) + power(sum(re * sin(t) + im * cos(t)), 2)) / power(1024, 2), 9) p from (select r, c, re, im, 2 * pi() * ((i * r + j * c) % 32) / 32 t from x, (select unnest(range(32)) r), (select unnest(range(32)) c)) group by 1, 2),
    best as (select r, c from y order by p desc, r, c limit 1)
    select (case when r > 16 then 32 - r else -r end)::int u, (case when c > 16 then 32 - c else -c end)::int v from best""")(lambda s, d: spectral.phase_correlation(g2(s, d, 3), g2(s, d, 4), 6, 6))
assert FRAME.nrows == 24

# texture and frequency
_LOG = ", ".join(f"({i - 3}, {j - 3}, {w!r}::double)" for i, line in enumerate(texture.log_kernel(3)) for j, w in enumerate(line))
_pair = lambda a, b: f"case when {a} * {b} < 0 then abs({a} - {b}) else 0 end"
grid_query("log_edges", lambda g: texture.log_edges(g, 3, 20), "select 1")
ORACLE["log_edges"] = sql("g1 g1g", "")[:-1] + f""", r as (select a."row", a.col, coalesce(floor(sum(w * b."value") filter (b."value" <> {M}) + 0.5), 0)::bigint v from g1g a, (values {_LOG}) t(i, j, w) join g1g b on b."row" = a."row" + i and b.col = a.col + j group by 1, 2),
    n as (select "row", col, lag(v) over c u, lead(v) over c d, lag(v) over x l, lead(v) over x e, lag(v) over p ul, lead(v) over p dr, lag(v) over q ur, lead(v) over q dl from r
    window c as (partition by col order by "row"), x as (partition by "row" order by col), p as (partition by "row" - col order by col), q as (partition by "row" + col order by "row")),
    s as (select "row", col, (greatest({_pair("u", "d")}, {_pair("l", "e")}, {_pair("ul", "dr")}, {_pair("ur", "dl")}) // 2)::int s from n)
    select "row", col, case when "row" between 7 and 40 and col between 7 and 56 and s > 20 then s else 0 end "value" from s"""
_MASKS = ", ".join(f"({f}, {i - 3}, {j - 3})" for f, m in enumerate(texture.ellipse_masks(4, 3, 1)) for i, line in enumerate(m) for j, on in enumerate(line) if on)
grid_query("oriented_ellipses", lambda g: texture.oriented(g, 4, 3, 1), f"""select a."row", a.col, coalesce(m, {M})::int "value" from g1g a left join (select "row", col, max(floor(x + 0.5)) m from (select a."row", a.col, f, avg(b."value") x from g1g a, (values {_MASKS}) t(f, i, j)
    join g1g b on b."row" = a."row" + i and b.col = a.col + j where b."value" <> {M} and a."row" between 3 and 44 and a.col between 3 and 60 group by 1, 2, 3) group by 1, 2) using ("row", col)""")
grid_query("vq_normalise", texture.normalised, f"""select "row", col, case when {V} = {M} then -1 else floor(100.0::double * ({V} - lo) / hi + 0.5)::int end "value" from g1g, (select min({V}) lo, max({V}) hi from g1g where {V} <> {M})""")
grid_query("vector_quantizer", lambda g: texture.quantize([g, cells.threshold(g, 500)], texture.vector_quantizer([g, cells.threshold(g, 500)], 4)))
grid_query("local_texture", lambda g: objects.local_texture(g, 3, 3, 0, 200, 6), "select 1")
ORACLE["local_texture"] = sql("g1 g1g", "")[:-1] + f""", own as (select r "row", c col, case when v is null then 6 else v end b1 from (select unnest(range(-1, 49)) r), (select unnest(range(-1, 65)) c)
    left join (select "row" i, col j, {_B} v from g1g) on i = r and j = c),
    d as (select * from (values {", ".join(f"('{k}', {i}, {j})" for k, (i, j) in stats.DIRECTIONS.items())}) t(direction, i, j)),
    pair as (select a."row", a.col, direction, a.b1, coalesce(b.b1, 6) b2 from own a cross join d left join own b on b."row" = a."row" + i and b.col = a.col + j),
    cnt as (select "row" + x "row", col + y col, direction, b1, b2, count(*) n from pair, (select unnest([-1, 0, 1]) x), (select unnest([-1, 0, 1]) y) group by all)
    select "row"::int "row", col::int col, direction, floor(100 * round(sum(n * n) / 81.0::double, 9) + 0.5)::int uniformity, floor(100 * round(max(n) / 9.0::double, 9) + 0.5)::int max_prob
    from cnt where "row" between 0 and 47 and col between 0 and 63 group by all"""
grid_query("fft_convolve", lambda g: frequency.fft_convolve(cells.replace_value(g, M, 0), [[1.0, 2.0], [0.0, 1.0]]), f"""select a."row", a.col, (coalesce(a.v, 0) + 2 * coalesce(b.v, 0) + coalesce(c.v, 0))::int "value" from (select "row", col, greatest({V}, 0) v from g1g) a
    left join (select "row", col, greatest({V}, 0) v from g1g) b on b."row" = a."row" and b.col = (a.col + 1) % 64 left join (select "row", col, greatest({V}, 0) v from g1g) c on c."row" = a."row" + 1 and c.col = (a.col + 1) % 64""")
grid_query("fft_bandpass", lambda g: frequency.bandpass(g, 0.1, 0.6))
grid_query("fft_bandpass_fixed", lambda g: frequency.bandpass(g, 0.1, 0.6, "fixed"))

# models
_p, _l = (lambda v: (v % 400).cast("double")), (lambda v: (v % 100).cast("double"))
grid_query("decision_tree", lambda g: g.map(lambda v: models.decision_tree(_p(v), _l(v))), _map(f"case when {V} % 100 < 17.61 then 0 when {V} % 100 < 48.91 then 1 when {V} % 100 < 81.25 then case when {V} % 400 >= 31.77 then 1 else 2 end when {V} % 400 >= 105.7 then 2 else 4 end"))
_sig = lambda x: f"(1 / (1 + exp(-({x}))))"
grid_query("neural_net", lambda g: g.map(lambda v: models.neural_net(_p(v), _l(v))), _map("floor(100 * " + _sig(f"2.4291 * {_sig(f'3.06728::double * ({V} % 400) + 3.26584 + 1.77153::double * ({V} % 100)')} + 3.12817 - 11.29847 * {_sig(f'0.00625::double * ({V} % 400) + 2.82917 - 0.03631::double * ({V} % 100)')}") + " + 0.5)"))
query("projection_pursuit")(lambda s, d: s.createDataFrame([(*map(float, c), w) for c, w in models.projection_pursuit(cells.replace_value(g1g(s, d), M, 0), 100.0, 3)], "row double, col double, sx double, sy double, amplitude double"))
def _starts_sql(k: int) -> str:
    """The highest cell, then the highest at least 10 away from all before, and so on."""
    out = sql("g1 g1g", "")[:-1]
    for i in range(k):
        far = "".join(f' and power("row" - (select "row" from c{j}), 2) + power(col - (select col from c{j}), 2) >= 100' for j in range(i))
        out += f', c{i} as (select "row", col from g1g where {V} <> {M}{far} order by {V} desc, "row", col limit 1)'
    return out + " " + " union all ".join(f'select "row"::double "row", col::double col from c{i}' for i in range(k))


query("gmm_start", _starts_sql(4))(lambda s, d: s.createDataFrame(models.gmm_start(g1g(s, d), 4), "row double, col double"))
_G = lambda x, y, a, b, c: f'exp(-({c}::double * power("row" - {x}, 2) - 2 * {b}::double * ("row" - {x}) * (col - {y}) + {a}::double * power(col - {y}, 2)) / (2 * {a * c - b * b}::double))'
grid_query("gmm_render", lambda g: models.gmm_render(g, [(20, 30, 40.0, 5.0, 60.0), (35, 10, 30.0, 0.0, 20.0)], 100.0), f'select "row", col, floor(({_G(20, 30, 40.0, 5.0, 60.0)} + {_G(35, 10, 30.0, 0.0, 20.0)}) * 100 + 0.5)::int "value" from g1g')
query("kmeans")(lambda s, d: s.createDataFrame(sorted(map(tuple, models.kmeans(read(s, d, "lineitem"), ["l_quantity", "l_discount"])[0])), "l_quantity double, l_discount double"))
query("kendall", """with v as (select o_custkey % 97 x, o_orderkey % 89 y from orders where o_orderkey is not null), c as (select x, y, count(*) n from v group by 1, 2),
    s as (select sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / 2.0::double s from c a, c b),
    t as (select sum(n * (n - 1) / 2.0::double) t from (select count(*) n from v group by x)), u as (select sum(n * (n - 1) / 2.0::double) u from (select count(*) n from v group by y)), w as (select count(*) * (count(*) - 1) / 2.0::double w from v)
    select round(s / sqrt((w - t) * (w - u)), 6) tau from s, t, u, w""")(lambda s, d: _rounded(models.kendall(read(s, d, "orders").selectExpr("o_custkey % 97 x", "o_orderkey % 89 y"), "x", "y")))
query("summary", "select min(l_quantity)::double \"min\", quantile_cont(l_quantity::double, 0.25) q1, quantile_cont(l_quantity::double, 0.5) median, round(avg(l_quantity), 6) mean, quantile_cont(l_quantity::double, 0.75) q3, max(l_quantity)::double \"max\" from lineitem")(lambda s, d: _rounded(models.summary(read(s, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x")), "x")))

# objects, motion, compositions
grid_query("peak_objects", lambda g: objects.peak_objects(g, _cut(g), 25, _cut(g) + 400, 6, 4))
grid_query("kmeans_levels", lambda g: objects.kmeans_levels(g, _cut(g), _cut(g) + 200, 4, 3))
query("pyramid")(lambda s, d: tracking.pyramid(g2(s, d, 3), g2(s, d, 4), 4))
def _sides(p: str, src: str) -> str:
    return f"""{_label_ctes(p, src, 24, "0", "v > 1")}, {p}_cell as (select {src}."row" r, {src}.col c, dense_rank() over (order by n) label from {src} join {p}_reach on id = {src}."row" * 24 + {src}.col join (select root, n from {p}_no join (select root, count(*) size from {p}_reach group by 1) using (root) where size >= 3) using (root)),
    {p} as (select label, avg(r) cx, avg(c) cy from {p}_cell group by 1)"""


query("object_track", f"""with recursive {sql("f1 f2", "")[5:-1]}, {_sides("o", "f1")}, {_sides("w", "f2")},
    best as (select w.label, arg_min(10 * (w.cx - o.cx), (power(w.cx - o.cx, 2) + power(w.cy - o.cy, 2), o.label)) u, arg_min(10 * (w.cy - o.cy), (power(w.cx - o.cx, 2) + power(w.cy - o.cy, 2), o.label)) v from w, o where power(w.cx - o.cx, 2) + power(w.cy - o.cy, 2) < 10000 group by 1)
    select "row", col, coalesce(floor(u + 0.5), 0)::int u, coalesce(floor(v + 0.5), 0)::int v from f2 left join w_cell on r = "row" and c = col left join best using (label)""")(lambda s, d: tracking.track(g2(s, d, 3), g2(s, d, 4), 0, 1, 3))
query("hybrid_track", f"""with recursive {sql("f1 f2", "")[5:-1]}, {_sides("w", "f2")},
    sh as (select (row_number() over (order by u, v))::int k, u::int u, v::int v from (select unnest(range(-2, 3)) u), (select unnest(range(-2, 3)) v)),
    err as (select label, k, u, v, sum(coalesce(abs(f2."value" - f1."value"), 0)) e from w_cell join f2 on f2."row" = r and f2.col = c cross join sh left join f1 on f1."row" = r - u and f1.col = c - v group by all),
    obj as (select label, any_value(cx) cx, any_value(cy) cy, any_value(n) size, arg_min(u, (e, k)) u, arg_min(v, (e, k)) v from err join w using (label) join (select label, count(*) n from w_cell group by 1) using (label) group by 1),
    wt as (select "row", col, u, v, size / (power(power(cx - "row", 2) + power(cy - col, 2), 2) + 0.0001::double) q from f2, obj)
    select "row", col, floor(sum(q * u) / sum(q) + 0.5)::int u, floor(sum(q * v) / sum(q) + 0.5)::int v from wt group by 1, 2""")(lambda s, d: tracking.hybrid(g2(s, d, 3), g2(s, d, 4), stats.prune(segment.hysteresis(g2(s, d, 4), 0, 1), 3), 2, 2))
query("prefix_lookup", """with a as (select distinct substring(p_name, 1, 12) "name" from part), t as (select "name", min(p_partkey) code from (select substring(p_name, 1, 12) "name", p_partkey from part where p_partkey % 3 = 0) group by 1)
    select a."name", coalesce(t.code, (select arg_min(x.code, x."name") from t x where starts_with(x."name", substring(a."name", 1, length(a."name") // 2)))) code from a left join t using ("name")""")(lambda s, d: compositions.prefix_lookup(*_names(s, d)))


def _names(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = read(s, d, "part").select(F.substring("p_name", 1, 12).alias("name"), "p_partkey")
    return p.select("name").distinct(), p.where("p_partkey % 3 = 0").groupBy("name").agg(F.min("p_partkey").alias("code"))


def _raised(g: Grid) -> Grid:
    return stencil.smooth(cells.replace_value(g, M, 0), stencil.boxcar(5))


def _spots(g: Grid) -> Grid:
    """What a smoothed grid has above its mean, tenfold."""
    g = _raised(g)
    mean = int(g.valid.agg(F.avg("value")).first()[0])
    return g.map_valid(lambda v: F.greatest(v - mean, F.lit(0)) * 10)


grid_query("metro", lambda g: compositions.metro(g, 0, 25, 60, 50))
ORACLE["metro"] = f"""{sql("g1 g1g", "")[:-1]}, {_otsu_sql("cut", "g1g", 0, 25, 60)}, far as (select a."row", a.col, coalesce(min((a."row" - b."row") * (a."row" - b."row") + (a.col - b.col) * (a.col - b.col)), 6400)::int v from g1g a left join (select * from g1g, cut where "value" > t) b on true group by 1, 2),
    near as (select "row", col, case when v > 50 then {M} else 50 - v end "value" from far), {_otsu_sql("cut2", "near", 0, 1, 50)} select "row", col, ("value" >= t)::int "value" from near, cut2"""
query("sprawl")(lambda s, d: compositions.sprawl(_spots(g1(s, d)), _spots(g1g(s, d)), 0, 10, 100))
query("primary_city", sql("g1 g1g", f"""select country, label, round(cval, 6) cval from (select b."value" // 300 country, label, cval from (select {_L} label, avg("row") cx, avg(col) cy, avg({V}) cval from g1g where {_L} > 0 group by 1) r
    join g1g b on b."row" = floor(cx)::int and b.col = floor(cy)::int where b."value" <> {M}) qualify row_number() over (partition by country order by cval desc, label) = 1"""))(
    lambda s, d: _rounded(compositions.primary_cities(stats.regions(_labels(g1g(s, d))), g1g(s, d).map(lambda v: F.when(v == M, -1).otherwise(F.floor(v / 300))))))
_CITY = lambda sig: f"""select label, round(pop, 6) pop, round(light, 6) light, floor(0.003494::double + 0.034444::double * light - 0.005992::double * pop + 0.5)::int linear,
    case when light < 17.61 then 0 when light < 48.91 then 1 when light < 81.25 then case when pop >= 31.77 then 1 else 2 end when pop >= 105.7 then 2 else 4 end tree,
    floor(100 * {sig(f"2.4291 * {sig('3.06728::double * pop + 3.26584 + 1.77153::double * light')} + 3.12817 - 11.29847 * {sig('0.00625::double * pop + 2.82917 - 0.03631::double * light')}")} + 0.5)::int net,
    floor(10 * least(least(1 - {_m('(10.0::double - pop) / 5.0')}, 1 - {_m('(pop - 30.0::double) / 50.0')}), {_m('(light - 30.0::double) / 40.0')}) + 0.5)::int market
    from (select {_L} label, avg({V}) pop, avg({V} % 90) light from g1g where {_L} > 0 group by 1)"""  # noqa: E731
query("city_models", sql("g1 g1g", _CITY(_sig)))(lambda s, d: _rounded(compositions.city_models(g1g(s, d), g1g(s, d).map(lambda v: v % 90), _labels(g1g(s, d)))))
grid_query("skeleton_lines", lambda g: compositions.skeleton_lines(g, 500).withColumn("rho", F.col("rho") + 0.0))
ORACLE["skeleton_lines"] = f"""with recursive {sql("g1 g1g", "")[5:-1]}, s0 as (select "row", col, ({V} >= 500)::int {V} from g1g), s1 as ({_around('max(b."value")', 1, src="s0")}), s2 as ({_around('min(b."value")', 1, src="s1")}), s3 as ({_around('min(b."value")', 1, src="s2")}),
    bold as (select "row" r, col c, ({V} > 0)::int v from s3), {_thin_sql("bold")}, g as (select r "row", c col, v {V} from thin where k = 40)""" + _LINES.format(t=0).replace("from g1g,", "from g,") + " select theta, bin, rho + 0.0::double rho, votes, r0, c0, r1, c1, quality from found order by quality desc, theta, bin limit 20"
grid_query("outlines", lambda g: compositions.outlines(_raised(g), _cut(_raised(g)), _cut(_raised(g)) + 20, 12))

# further parts of whole analyses
grid_query("saturate_above", lambda g: cells.saturate_above(g, 600), _map(f"case when {V} = {M} then {M} else least({V}, 600) end"))
_ELL = f"""(select label, cx, cy, 2 * sqrt(greatest(e1, 0)) a, 2 * sqrt(greatest(e2, 0)) b, atan2(e1 - s11, s12) phi from (select *, (s11 + s22 + sqrt(power(s11 - s22, 2) + 4 * s12 * s12)) / 2 e1, (s11 + s22 - sqrt(power(s11 - s22, 2) + 4 * s12 * s12)) / 2 e2 from
    (select {_L} label, avg("row") cx, avg(col) cy, avg("row" * "row") - power(avg("row"), 2) s11, avg(col * col) - power(avg(col), 2) s22, avg("row" * col) - avg("row") * avg(col) s12 from g1g where {_L} > 0 group by 1)))"""
grid_query("ellipse_aspect", lambda g: _rounded(stats.aspect(stats.ellipses(stats.regions(_labels(g))))), f"select label, round(b / a, 6) aspect from {_ELL}")
grid_query("in_ellipses", lambda g: stats.in_ellipses(g.df, stats.regions(_labels(g))), f"""select "row", col, {V}, coalesce(max(label) filter (power((("row" - cx) * cos(phi) + (col - cy) * sin(phi)) / a, 2) + power(((col - cy) * cos(phi) - ("row" - cx) * sin(phi)) / b, 2) < 1), 0)::int ellipse
    from g1g, {_ELL} group by 1, 2, 3""")
grid_query("prune_where", lambda g: stats.prune_where(_labels(g), stats.regions(_labels(g)), F.col("cval") > 500), f"""select "row", col, {V}, coalesce(k, 0)::int label from (select *, {_L} l from g1g) left join
    (select l, dense_rank() over (order by l) k from (select {_L} l, avg({V}) c from g1g group by 1) where l > 0 and c > 500) using (l)""")
query("category_counts", "select p_brand category, count(*) n from part group by 1")(lambda s, d: stats.category_counts(read(s, d, "part"), "p_brand"))
query("cross_validated", """with f as (select unnest(range(5)) k), m as (select k, regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a from lineitem, f where l_orderkey % 5 <> k group by 1)
    select k::int fold, count(*) n, round(avg(power(l_extendedprice - a - b * l_quantity, 2)), 1) mse from lineitem join m on l_orderkey % 5 = k group by 1""")(
    lambda s, d: s.createDataFrame([(f, n, round(e, 1)) for f, n, e in mining.cross_validated(read(s, d, "lineitem"), "l_extendedprice", ["l_quantity"], F.col("l_orderkey"))], "fold int, n long, mse double"))


def _ranks(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "lineitem").select("l_quantity", "l_extendedprice", F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 20000).alias("level"))


query("fitted_tree")(lambda s, d: models.confusion(models.fit_tree(_ranks(s, d), "level", ["l_quantity", "l_extendedprice"]), _ranks(s, d), "level"))
query("fitted_net")(lambda s, d: models.confusion(models.fit_net(_ranks(s, d), "level", ["l_quantity", "l_extendedprice"], 3, 20), _ranks(s, d), "level"))
query("object_track_reference")(lambda s, d: tracking.track(g2(s, d, 3), g2(s, d, 4), 0, 1, 3, "reference"))
query("cities", sql("g1 g1g pts", f"""select label, round(lat, 6) lat, round(lon, 6) lon, size, round(cval, 6) cval, arg_min(id, (power(lat - plat, 2) + power(lon - plon, 2), id)) filter (power(lat - plat, 2) + power(lon - plon, 2) < 0.25) place
    from (select {_L} label, 50.0::double - (avg("row") + 0.5) * 0.5 lat, -100.0::double + (avg(col) + 0.5) * 0.5 lon, count(*) size, avg({V}) cval from g1g where {_L} > 0 group by 1), (select id, lat plat, lon plon from pts) group by 1, 2, 3, 4, 5"""))(
    lambda s, d: _rounded(compositions.named(stats.regions(_labels(g1g(s, d))), META, points(s, d).select(F.col("id").alias("place"), F.col("lat").alias("plat"), F.col("lon").alias("plon")))))
query("city_categories", sql("g1 g1g", f"""select "row", col, coalesce(k, 0)::int "value" from (select *, {_L} label from g1g) left join (select label, arg_min(k, (power((pop - 32.6673) / 33.05260 - c1, 2) + power((light - 42.5539) / 31.75972 - c2, 2), k)) k from
    (select {_L} label, avg({V} % 300)::double pop, avg({V} % 90)::double light from g1g where {_L} > 0 group by 1), (values (1, 4.0449725::double, 1.1114502::double), (2, -0.2898599, -0.7153647), (3, 0.1143215, 1.0642556)) t(k, c1, c2) group by 1) using (label)"""))(
    lambda s, d: compositions.city_categories(g1g(s, d).map(lambda v: v % 300), g1g(s, d).map(lambda v: v % 90), _labels(g1g(s, d))).df)
query("market_raster", sql("g1 g1g", f"""select "row", col, case when {V} = {M} then {M} else floor(10 * least(least(1 - {_m(f'(10.0::double - {V} % 100) / 5.0')}, 1 - {_m(f'({V} % 100 - 30.0::double) / 50.0')}), {_m(f'({V} % 90 - 30.0::double) / 40.0')}) + 0.5)::int end "value" from g1g"""))(
    lambda s, d: compositions.market_raster(g1g(s, d).map_valid(lambda v: v % 100), g1g(s, d).map_valid(lambda v: v % 90)).df)
query("code_raster", sql("g1 g1g", f"""select "row", col, coalesce(n_regionkey, {V})::int "value" from g1g left join nation on n_nationkey = {V} and n_nationkey % 2 = 0"""))(
    lambda s, d: compositions.code_raster(g1g(s, d), read(s, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("place"), F.col("n_regionkey").alias("code"))).df)
query("training_patterns", sql("g1 g1g", f"""select label, round(avg({V}), 6) pop, round(avg({V} % 90), 6) light, round(avg({V} % 5), 6) gdi from (select *, {_L} label from g1g) where label in (select label from (select label, b."value" // 300 country, cval from
    (select {_L} label, avg("row") cx, avg(col) cy, avg({V}) cval from g1g where {_L} > 0 group by 1) r join g1g b on b."row" = floor(cx)::int and b.col = floor(cy)::int where b."value" <> {M}) qualify row_number() over (partition by country order by cval desc, label) = 1) group by 1"""))(
    lambda s, d: _rounded(compositions.training_patterns(g1g(s, d), g1g(s, d).map(lambda v: v % 90), g1g(s, d).map(lambda v: v % 5), g1g(s, d).map(lambda v: F.when(v == M, -1).otherwise(F.floor(v / 300))), _labels(g1g(s, d)))))
query("bilinear", sql("g1 g1g pts", f"""select id, round(sum(w * g) / sum(w), 6) "value" from pts left join lateral (select g1g."value" g, (1 - abs(y - "row")) * (1 - abs(x - col)) w from (select (50.0::double - lat) / 0.5::double - 0.5 y, (lon + 100.0::double) / 0.5::double - 0.5 x) q, g1g
    where "row" in (floor(y), ceil(y)) and col in (floor(x), ceil(x)) and g1g."value" <> {M}) on true group by 1"""))(
    lambda s, d: _rounded(cells.bilinear(g1g(s, d), points(s, d).select("id", ((F.lit(50.0) - F.col("lat")) / 0.5 - 0.5).alias("y"), ((F.col("lon") + 100.0) / 0.5 - 0.5).alias("x"))).select("id", "value")))


# distances, files
query("distance_km", sql("pts", """, a as (select id, radians(lat) p1, radians(38.5::double) p2, radians(lon) l1, radians(-84.25::double) l2 from pts),
    h as (select id, power(sin((p2 - p1) / 2), 2) + cos(p1) * cos(p2) * power(sin((l2 - l1) / 2), 2) h, 1 - (2 - 1 / 298.257223563::double) / 298.257223563::double * sin((p1 + p2) / 2) s from a)
    select id, round(2 * 6378.137::double * (1 - (2 - 1 / 298.257223563::double) / 298.257223563::double) / power(s * s, 1.5) * asin(least(1, sqrt(h))), 5) km from h""").replace(") , a", "), a"))(
    lambda s, d: points(s, d).select("id", F.round(geometry.haversine_km(F.col("lat"), F.col("lon"), F.lit(38.5), F.lit(-84.25)), 5).alias("km")))


def _there_and_back(g: Grid) -> Grid:
    """The grid as a file in the session's shared folder, written by ranges of rows and read by ranges of bytes."""
    path = f"{shared_dir(g.df.sparkSession)}/gridloom/esri-{uuid.uuid4().hex}"
    files.write_esri(g, path)
    return files.read_esri(g.df.sparkSession, path)


grid_query("esri_there_and_back", _there_and_back, 'select "row", col, "value" from g1g')

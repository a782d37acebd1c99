"""Queries of column, window, aggregate and join operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import scalars as S
from tessitura.functions.scalars import num, r6
from tessitura.operators import arrangement, drums, grid, labels, series, spectrum
from tessitura.plans.registry import registry
from tessitura.session import table

QUERIES, ORACLES, query = registry()
KEYS = ["track", "source"]


def seconds(ts: str):
    """Seconds since the start of 2024, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', {ts})") / num(1e6)


def envelope(spark, sf) -> DataFrame:
    """(track, source, frame, t, value): each user's events of a type in order."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("track"), F.col("event_type").alias("source"), "event_id", "value", seconds("ts").alias("t"))
    return e.withColumn("frame", (F.row_number().over(Window.partitionBy(*KEYS).orderBy("event_id")) - 1).cast("long"))


ENV = """env as (select user_id track, event_type source, event_id, value, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6::double t,
  row_number() over (partition by user_id, event_type order by event_id) - 1 frame from events)"""
FLUX = f"""{ENV}, fl as (select *, coalesce(greatest(ln(1 + greatest(value, 0)) - lag(ln(1 + greatest(value, 0))) over w, 0), 0) flux from env window w as (partition by track, source order by frame))"""
MED = f"""{FLUX}, md as (select *, quantile_cont(flux, 0.5) over (partition by track, source order by frame rows between 43 preceding and 43 following) med,
  max(flux) over (partition by track, source order by frame rows between 3 preceding and 3 following) top, count(*) over (partition by track, source) n from fl)"""


def fluxed(spark, sf) -> DataFrame:
    return series.flux(envelope(spark, sf))


@query("q01_flux", f"with {FLUX} select track, source, frame, round_even(flux, 6) + 0::double flux from fl")
def q01(spark, sf):
    return fluxed(spark, sf).select(*KEYS, "frame", r6(F.col("flux")).alias("flux"))


@query("q02_rolling_median", f"with {MED} select track, source, frame, round_even(med, 6) + 0::double med from md")
def q02(spark, sf):
    return fluxed(spark, sf).select(*KEYS, "frame", r6(series.rolling_median("flux", 43)).alias("med"))


@query("q03_peak_pick", f"""with recursive {MED}, c as (select track, source, frame, flux, med from md where flux > med and flux >= top and frame > 0 and frame < n - 1),
ch as (select *, coalesce((frame - lag(frame) over (partition by track, source order by frame) >= 3)::int, 1) s from c), ci as (select *, sum(s) over (partition by track, source order by frame) chain from ch),
g(track, source, chain, frame) as (select track, source, chain, min(frame) from ci group by track, source, chain union all
  select ci.track, ci.source, ci.chain, min(ci.frame) from g join ci on g.track = ci.track and g.source = ci.source and g.chain = ci.chain where ci.frame >= g.frame + 3 group by ci.track, ci.source, ci.chain),
k as (select ci.*, quantile_cont(flux, 0.9) over (partition by ci.track, ci.source) q from ci join g using (track, source, chain, frame))
select track, source, frame, round_even(flux, 6) + 0::double flux from k where q > 0 and flux > med + 0.4::double * q""")
def q03(spark, sf):
    return series.peaks(fluxed(spark, sf)).select(*KEYS, "frame", r6(F.col("flux")).alias("flux"))


@query("q04_first_onset", f"with {FLUX}, m as (select *, max(flux) over (partition by track, source) top from fl) select track, source, min(frame) frame from m where top > 0 and flux >= 0.2::double * top group by all")
def q04(spark, sf):
    return series.first_onset(fluxed(spark, sf))


@query("q05_band_gates", f"""with {FLUX}, a as (select track, source, sum(value) e, max(flux) peak from fl group by all),
b as (select track, fl.source, avg((flux <= 0.02::double * peak)::int::double) sparse from fl join a using (track, source) group by all),
c as (select track, source, e / sum(e) over (partition by track) share, peak from a)
select track, source, round_even(share, 6) + 0::double share, round_even(peak, 6) + 0::double peak, round_even(sparse, 6) + 0::double sparsity,
  case when share < 0.001 then 'empty' when peak < 1 then 'no_transient' when sparse < 0.72::double then 'not_sparse' end refusal from c join b using (track, source)""")
def q05(spark, sf):
    g = drums.gates(fluxed(spark, sf).withColumnRenamed("source", "band"), ["track"])
    return g.select("track", F.col("band").alias("source"), *[r6(F.col(c)).alias(c) for c in ("share", "peak", "sparsity")], "refusal")


def bars(spark, sf) -> DataFrame:
    """(track, source, bar, level): RMS of the values of each day, summed in the order of the table's rows."""
    e = table(spark, sf, "events").withColumns({"track": F.col("user_id"), "source": F.col("event_type"), "bar": F.floor(seconds("ts") / num(86400)), "power": F.col("value") * F.col("value")})
    return series.averages(e, [*KEYS, "bar"], ["power"]).select(*KEYS, "bar", F.sqrt("power").alias("level"))


def presence(spark, sf) -> DataFrame:
    return arrangement.presence(bars(spark, sf), ["track"])


BARS = f"{ENV}, bars as (select track, source, floor(t / 86400)::bigint bar, sqrt(avg(value * value)) lvl from env group by all)"
PRESENCE = f"""{BARS}, r as (select *, quantile_cont(lvl, 0.9) over (partition by track, source) ref from bars),
pr as (select *, coalesce(ref / nullif(max(ref) over (partition by track), 0), 0) < 0.02::double absent from r), ps as (select *, not absent and ref > 0 and lvl >= 0.15::double * ref present from pr)"""


@query("q06_presence", f"with {PRESENCE} select track, source, bar, present, absent from ps")
def q06(spark, sf):
    return presence(spark, sf).select(*KEYS, "bar", "present", "absent")


@query("q07_sections", f"""with {PRESENCE}, pat as (select track, bar, coalesce(string_agg(source, ',' order by source) filter (where present), '') active from ps group by all),
n as (select *, coalesce((active <> lag(active) over w or bar - lag(bar) over w <> 1)::int, 1) s from pat window w as (partition by track order by bar)),
i as (select *, sum(s) over (partition by track order by bar) run from n)
select track, active, min(bar) "first", max(bar) "last", count(*) n from i group by track, active, run""")
def q07(spark, sf):
    p = presence(spark, sf).groupBy("track", "bar").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("present"), F.col("source")))), ",").alias("active"))
    return series.runs(p, "active", ["track"], "bar").drop("run")


@query("q08_bar_rms", f"with {BARS} select track, source, bar, round_even(lvl, 6) + 0::double lvl from bars")
def q08(spark, sf):
    return bars(spark, sf).select(*KEYS, "bar", r6(F.col("level")).alias("lvl"))


def folded(spark, sf, slots):
    e = envelope(spark, sf)
    return grid.fold(e, F.col("t"), 86400.0, 0.0, slots, "value", ["source"])


def FOLD(n):
    return f"""{ENV}, hk as (select source, round_even(t / (86400::double / {n}), 0)::bigint k, value from env), h as (select source, k, max(value) lvl from hk where k >= 0 group by source, k),
c as (select source, (max(k) + 1) // {n} cycles from h group by 1 having cycles >= 2), d as (select source, unnest(range(cycles * {n})) k from c),
f as (select d.source, k // {n} "cycle", k % {n} slot, greatest(coalesce(lvl, 0), 0) lvl from d left join h using (source, k)),
pf as (select source, slot, quantile_cont(lvl, 0.5) lvl from f group by all)"""


@query("q09_fold_profile", f"with {FOLD(24)} select source, slot, round_even(lvl, 6) + 0::double lvl from pf")
def q09(spark, sf):
    return grid.profile(folded(spark, sf, 24), ["source"]).select("source", F.col("slot").cast("long").alias("slot"), r6(F.col("level")).alias("lvl"))


@query("q10_contrast", f"""with {FOLD(96)} select source, round_even(case when max(lvl) > 0 then 1 - avg(lvl) / max(lvl) else 0 end, 6) + 0::double contrast,
  round_even(sum(lvl) filter (where slot % 4 = 0) / nullif(sum(lvl), 0), 6) + 0::double on_grid from pf group by 1""")
def q10(spark, sf):
    c = grid.contrast(grid.profile(folded(spark, sf, 96), ["source"]), ["source"], 4)
    return c.select("source", r6(F.col("contrast")).alias("contrast"), r6(F.col("on_grid")).alias("on_grid"))


FRACTION = "(value / 0.25::double - round_even(value / 0.25::double, 0))"


@query("q11_phase", f"with {ENV} select source, round_even(atan2(avg(sin(6.283185307179586 * {FRACTION})), avg(cos(6.283185307179586 * {FRACTION}))) / 6.283185307179586, 6) + 0::double shift, round_even(avg(abs({FRACTION})), 6) + 0::double error from env group by 1")
def q11(spark, sf):
    shift, error = grid.phase(S.fractional_steps(F.col("value"), num(0.25), num(0), 1))
    return envelope(spark, sf).groupBy("source").agg(r6(shift).alias("shift"), r6(error).alias("error"))


@query("q12_drift", f"""with {ENV}, m as (select *, (min(t) over (partition by source) + max(t) over (partition by source)) / 2 mid from env),
h as (select source, (t >= mid)::int half, atan2(avg(sin(6.283185307179586 * {FRACTION})), avg(cos(6.283185307179586 * {FRACTION}))) / 6.283185307179586 shift from m group by all),
d as (select a.source, b.shift - a.shift + 0.5::double x from h a join h b on a.source = b.source and a.half = 0 and b.half = 1)
select source, round_even(x - floor(x) - 0.5::double, 6) + 0::double drift from d""")
def q12(spark, sf):
    w = envelope(spark, sf)
    ends = w.groupBy("source").agg(((F.min("t") + F.max("t")) / num(2)).alias("mid"))
    shift, _ = grid.phase(S.fractional_steps(F.col("value"), num(0.25), num(0), 1))
    h = w.join(ends, "source").groupBy("source", (F.col("t") >= F.col("mid")).alias("late")).agg(shift.alias("shift"))
    d = h.groupBy("source").agg(F.max(F.when(F.col("late"), F.col("shift"))).alias("b"), F.max(F.when(~F.col("late"), F.col("shift"))).alias("a")).filter("a is not null and b is not null")
    return d.select("source", r6(F.pmod(F.col("b") - F.col("a") + num(0.5), num(1)) - num(0.5)).alias("drift"))


HOURLY = f"{ENV}, hr as (select source, floor(t / 3600)::bigint h, sum(value) v from env group by all)"


def hourly(spark, sf):
    return envelope(spark, sf).groupBy("source", F.floor(F.col("t") / num(3600)).alias("h")).agg(F.sum("value").alias("v"))


@query("q13_autocorrelation", f"""with {HOURLY}, c as (select source, h, v - avg(v) over (partition by source) v from hr), z as (select source, sum(v * v) z from c group by 1),
l as (select a.source, b.h - a.h lag, sum(a.v * b.v) s from c a join (select unnest(range(1, 25)) g) on true join c b on b.source = a.source and b.h = a.h + g group by all)
select source, lag, round_even(s / z, 6) + 0::double r from l join z using (source)""")
def q13(spark, sf):
    c = hourly(spark, sf).withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("source")))
    z = c.groupBy("source").agg(F.sum(F.col("v") * F.col("v")).alias("z"))
    a = c.withColumn("lag", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(24).cast("long")))).select("source", "lag", (F.col("h") + F.col("lag")).alias("h"), F.col("v").alias("a"))
    s = a.join(c, ["source", "h"]).groupBy("source", "lag").agg(F.sum(F.col("a") * F.col("v")).alias("s"))
    return s.join(z, "source").select("source", "lag", r6(F.col("s") / F.col("z")).alias("r"))


@query("q15_beat_phase", f"""with {HOURLY}, f as (select source, h - min(h) over (partition by source) frame, coalesce(greatest(ln(1 + v) - lag(ln(1 + v)) over (partition by source order by h), 0), 0) x from hr),
m as (select source, frame % 24 o, avg(x) m from f group by all), b as (select source, arg_max(o, {{'m': m, 'o': -o}}) o, max(m) p, sum(m) / 24 a from m group by 1)
select source, o::int "offset", round_even(greatest(0, 1 - a / p), 6) + 0::double contrast from b where p > 0""")
def q15(spark, sf):
    h = hourly(spark, sf).withColumn("frame", F.col("h") - F.min("h").over(Window.partitionBy("source")))
    f = series.flux(h, "v", ["source"])
    out = grid.beat_phase(f, 24.0, "flux", ["source"])
    return out.select("source", F.col("offset").cast("int").alias("offset"), r6(F.col("contrast")).alias("contrast"))


@query("q16_slot_energy", f"""with {ENV}, hr as (select floor(t / 3600)::bigint h, sum(value) low, count(*)::double bright from env group by 1),
w as (select h, max(low) over v low, max(bright) over v bright from hr window v as (order by h rows between current row and 4 following)),
s as (select h % 4 slot, quantile_cont(low, 0.5) low, quantile_cont(bright, 0.5) bright from w group by 1), p as (select slot, low / sum(low) over () low, bright / sum(bright) over () bright from s)
select slot, round_even(low, 6) + 0::double low, round_even(bright, 6) + 0::double bright, round_even(low - bright, 6) + 0::double balance from p""")
def q16(spark, sf):
    """Slots of four hours over all events: their sum as the low envelope, their number as the bright one."""
    h = envelope(spark, sf).groupBy(F.lit("all").alias("track"), F.floor(F.col("t") / num(3600)).alias("h")).agg(F.sum("value").alias("low"), F.count("*").cast("double").alias("bright"))
    ahead, whole = Window.partitionBy("track").orderBy("h").rowsBetween(0, 4), Window.partitionBy("track")
    w = h.select("track", "h", F.max("low").over(ahead).alias("low"), F.max("bright").over(ahead).alias("bright"))
    s = w.groupBy("track", F.pmod("h", F.lit(4)).alias("slot")).agg(F.percentile("low", num(0.5)).alias("low"), F.percentile("bright", num(0.5)).alias("bright"))
    p = s.select("slot", *[(F.col(c) / F.sum(c).over(whole)).alias(c) for c in ("low", "bright")])
    return p.select("slot", r6(F.col("low")).alias("low"), r6(F.col("bright")).alias("bright"), r6(F.col("low") - F.col("bright")).alias("balance"))


IOI = f"""{ENV}, g as (select track, t, t - lag(t) over (partition by track order by t, event_id) ioi from env), g2 as (select * from g where ioi > 0),
m as (select *, quantile_cont(ioi, 0.5) over (partition by track) m from g2), ok as (select track, t, ioi from m where ioi >= m / 4 and ioi <= m * 4)"""


def iois(spark, sf):
    return series.intervals(envelope(spark, sf).select("track", "t"), "t", ["track"])


@query("q17_intervals", f"with {IOI} select track, round_even(t, 3) t, round_even(ioi, 6) + 0::double ioi from ok")
def q17(spark, sf):
    return iois(spark, sf).select("track", F.bround("t", 3).alias("t"), r6(F.col("ioi")).alias("ioi"))


@query("q18_relative_mad", f"with {IOI}, a as (select track, ioi, quantile_cont(ioi, 0.5) over (partition by track) m from ok) select track, round_even(any_value(m), 6) + 0::double med, round_even(quantile_cont(abs(ioi - m), 0.5) / nullif(any_value(m), 0), 6) + 0::double mad from a group by 1")
def q18(spark, sf):
    med, mad = series.relative_mad("ioi")
    i = iois(spark, sf).withColumn("_m", med.over(Window.partitionBy("track")))
    return i.groupBy("track").agg(r6(F.first("_m")).alias("med"), r6(mad).alias("mad"))


@query("q19_feel", f"""with {IOI}, a as (select track, t, ioi, quantile_cont(ioi, 0.5) over (partition by track) u, (r[round_even(0.1::double * (len(r) - 1), 0)::int + 1] + r[round_even(0.9::double * (len(r) - 1), 0)::int + 1]) / 2 split from (select *, list_sort(list(ioi) over (partition by track)) r from ok)),
b as (select *, ioi >= split long, least(4, greatest(1, round_even(ioi / u, 0))) k from a), c as (select *, (long <> lag(long) over (partition by track order by t))::int x from b)
select track, count(*) n, round_even(avg((abs(ioi - k * u) <= 0.22::double * u)::int::double), 6) + 0::double on_grid, round_even(avg((k = 1)::int::double), 6) + 0::double base,
  round_even(least(avg(long::int::double), 1 - avg(long::int::double)), 6) + 0::double cluster, round_even(sum(x) / nullif(count(*) - 1, 0)::double, 6) + 0::double alternation from c group by 1 having count(*) >= 16""")
def q19(spark, sf):
    from tessitura.operators import hints

    f = hints.feel_evidence(iois(spark, sf), ["track"]).filter("n >= 16")
    return f.select("track", "n", *[r6(F.col(c)).alias(c) for c in ("on_grid", "base", "cluster", "alternation")])


@query("q20_density", f"""with {ENV}, d as (select track, count(*) / ((max(t) - min(t)) / 86400) d from env group by 1 having max(t) > min(t))
select track, round_even(d, 6) + 0::double density, case when d < 1 then 'sparse' when d < 5 then 'moderate' else 'busy' end term from d""")
def q20(spark, sf):
    d = envelope(spark, sf).groupBy("track").agg((F.count("*") / ((F.max("t") - F.min("t")) / num(86400))).alias("d"), (F.max("t") > F.min("t")).alias("ok")).filter("ok")
    return d.select("track", r6(F.col("d")).alias("density"), S.classify_density(F.col("d")).alias("term"))


STEP = "(round_even((t - 0) / 3600::double, 0)::bigint % 24)"


@query("q21_step_share", f"with {ENV}, s as (select source, {STEP} step, count(*) n from env group by all) select source, step, round_even(n / sum(n) over (partition by source)::double, 4) + 0::double share from s")
def q21(spark, sf):
    s = envelope(spark, sf).groupBy("source", S.grid_step(F.col("t"), num(0), num(3600), 24).alias("step")).agg(F.count("*").alias("n"))
    return s.select("source", "step", (F.bround(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 4) + num(0)).alias("share"))


@query("q22_occupancy", f"with {ENV}, a as (select source, {STEP} step, floor(t / 86400)::bigint c from env), p as (select source, count(distinct c) n from a group by 1) select a.source, step, round_even(count(distinct c) / any_value(p.n)::double, 6) + 0::double occupancy from a join p using (source) group by all")
def q22(spark, sf):
    h = envelope(spark, sf).select("source", S.grid_step(F.col("t"), num(0), num(3600), 24).alias("step"), F.floor(F.col("t") / num(86400)).alias("c"))
    return grid.occupancy(h, ["source"], "step", "c").select("source", "step", r6(F.col("occupancy")).alias("occupancy"))


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


#: All dimensions of a vector folded to twelve classes, what is negative left out.
CHROMA = "c as (select vec_id, label, list_transform(range(12), lambda i: list_sum(list_transform(range(i + 1, len(embedding) + 1, 12), lambda j: greatest(embedding[j]::double, 0)))) c from embeddings)"


def chroma(spark, sf) -> DataFrame:
    """(vec_id, chroma), summed in one aggregation."""
    v = vectors(spark, sf).select("vec_id", F.posexplode("v").alias("i", "x"))
    sums = v.groupBy("vec_id").agg(*[F.sum(F.when(F.col("i") % 12 == c, F.greatest("x", num(0))).otherwise(num(0))).alias(f"_{c}") for c in range(12)])
    return sums.select("vec_id", F.array(*[F.col(f"_{c}") for c in range(12)]).alias("chroma"))


@query("q23_chroma_entropy", f"with {CHROMA}, t as (select *, list_sum(c) s from c) select vec_id, round_even(case when s > 0 then least(1, greatest(0, -list_sum(list_transform(c, lambda x: case when x > 0 then x / s * ln(x / s) else 0 end)) / ln(12))) end, 6) + 0::double h from t")
def q23(spark, sf):
    return chroma(spark, sf).select("vec_id", r6(S.chroma_entropy(F.col("chroma"))).alias("h"))


#: Ids of a block: a task holds one block of a label at a time.
BLOCK = 4096


def followed(spark, sf) -> DataFrame:
    """(vec_id, label, v, b): each vector with the one before it in its label, whatever the ids between them.

    Windows run inside blocks of ids; a block's first vector gets the last one of the nearest earlier block that has any,
    by a window over the blocks' last ones.
    """
    v = vectors(spark, sf).withColumn("_k", F.floor(F.col("vec_id") / BLOCK))
    inside = Window.partitionBy("label", "_k").orderBy("vec_id")
    v = v.withColumn("b", F.lag("v").over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    last = vectors(spark, sf).groupBy("label", F.floor(F.col("vec_id") / BLOCK).alias("_k")).agg(F.max_by("v", "vec_id").alias("_last"))
    carried = last.select(F.col("label").alias("_l"), F.lead("_k").over(Window.partitionBy("label").orderBy("_k")).alias("_next"), "_last")
    out = v.join(carried, F.col("_first") & F.col("label").eqNullSafe(F.col("_l")) & (F.col("_k") == F.col("_next")), "left")
    return out.select("vec_id", "label", "v", F.when(F.col("_first"), F.col("_last")).otherwise(F.col("b")).alias("b")).filter("b is not null")


@query("q24_consecutive_cosine", "with v as (select vec_id, label, embedding::double[] v, lag(embedding::double[]) over (partition by label order by vec_id) b from embeddings) select vec_id, label, round_even(list_dot_product(v, b) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(b, b)), 0), 6) + 0::double sim from v where b is not null")
def q24(spark, sf):
    v = followed(spark, sf)
    return v.select("vec_id", "label", r6(series.cosine(F.col("v"), F.col("b"))).alias("sim"))


@query("q24b_tonal_stability", "with v as (select label, embedding::double[] v, lag(embedding::double[]) over (partition by label order by vec_id) b from embeddings) select label, round_even(1 - avg(1 - list_dot_product(v, b) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(b, b)), 0)), 6) + 0::double stability from v where b is not null group by 1")
def q24b(spark, sf):
    v = followed(spark, sf)
    return v.groupBy("label").agg(r6(num(1) - F.avg(num(1) - series.cosine(F.col("v"), F.col("b")))).alias("stability"))


def _profiles_sql():
    from tessitura.operators.tonal import PROFILES, rotated

    rows = [f"('{k}', '{s}', {rotated(PROFILES[s], i)}::double[])" for s in PROFILES for i, k in enumerate(S.NOTE_NAMES)]
    return f"p(k, s, w) as (values {', '.join(rows)})"


@query("q25_key", f"""with {CHROMA}, {_profiles_sql()}, e as (select vec_id, k, s, unnest(c) x, unnest(w) w from c, p), r as (select vec_id, k, s, corr(x, w) r from e group by all),
b as (select vec_id, arg_max(k, {{'r': r, 'k': k, 's': s}}) k, arg_max(s, {{'r': r, 'k': k, 's': s}}) s, max(r) r, min(r) worst from r where not isnan(r) group by 1),
o as (select vec_id, max(r.r) rival from r join b using (vec_id) where r.k <> b.k and not isnan(r.r) group by 1)
select vec_id, k "key", s scale, round_even(r, 6) + 0::double strength, round_even(case when r > worst then least(1, greatest(0, r)) * least(1, greatest(0, (r - rival) / (r - worst))) end, 6) + 0::double confidence from b join o using (vec_id)""")
def q25(spark, sf):
    from tessitura.operators.tonal import estimate_key

    return estimate_key(chroma(spark, sf), ["vec_id"]).select("vec_id", "key", "scale", r6(F.col("strength")).alias("strength"), r6(F.col("confidence")).alias("confidence"))


POWER = "p as (select label, i * 300::double freq, sum(embedding[i]::double * embedding[i]::double) p from (select label, embedding, unnest(range(1, 65)) i from embeddings) group by all)"


def power(spark, sf):
    v = vectors(spark, sf).select("label", F.posexplode("v").alias("i", "x"))
    return v.groupBy("label", ((F.col("i") + 1) * num(300)).alias("freq")).agg(F.sum(F.col("x") * F.col("x")).alias("power"))


@query("q26_spectrum", f"""with {POWER}, i as (select * from p where freq >= 20 and freq <= 20000)
select label, round_even(coalesce(sum(p) filter (where freq < 250), 0) / nullif(sum(p), 0), 6) + 0::double low, round_even(sum(p) filter (where freq >= 250 and freq < 2000) / nullif(sum(p), 0), 6) + 0::double low_mid,
 round_even(sum(p) filter (where freq >= 2000 and freq < 6000) / nullif(sum(p), 0), 6) + 0::double high_mid, round_even(sum(p) filter (where freq >= 6000) / nullif(sum(p), 0), 6) + 0::double high,
 round_even(sum(p) filter (where freq >= 1500) / nullif(sum(p), 0), 6) + 0::double brightness, round_even(sum(freq * p) / nullif(sum(p), 0), 4) + 0::double centroid from i group by 1""")
def q26(spark, sf):
    d = spectrum.describe(power(spark, sf), ["label"])
    return d.select("label", *[r6(F.col(c)).alias(c) for c in ("low", "low_mid", "high_mid", "high", "brightness")], (F.bround("centroid", 4) + num(0)).alias("centroid"))


@query("q26b_energy_percentile", f"with {POWER}, c as (select *, sum(p) over (partition by label order by freq) c, sum(p) over (partition by label) t from p) select label, min(freq) rolloff from c where c >= 0.85::double * t group by 1")
def q26b(spark, sf):
    return spectrum.energy_percentile(power(spark, sf), ["label"])


@query("q27_mean_vector", "select label, i - 1 as i, round_even(avg(embedding[i]::double), 6) + 0::double x from (select label, embedding, unnest(range(1, 65)) i from embeddings) group by all")
def q27(spark, sf):
    v = vectors(spark, sf).select("label", F.posexplode("v").alias("i", "x"))
    return v.groupBy("label", F.col("i").cast("long").alias("i")).agg(r6(F.avg("x")).alias("x"))


LI = "li as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) n from lineitem)"
HZ = LI + ", hz as (select l_orderkey track, n frame, 30 + 370 * (l_quantity - 1) / 49::double f from li)"


def lines(spark, sf):
    """Line items numbered inside their order; line numbers repeat in the table."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf, "lineitem").withColumn("n", F.row_number().over(order).cast("long"))


def pitch(spark, sf):
    return lines(spark, sf).select(F.col("l_orderkey").alias("track"), F.col("n").alias("frame"), (num(30) + num(370) * (F.col("l_quantity") - num(1)) / num(49)).alias("f"))


NAMES = "(" + str(S.NOTE_NAMES) + ")"


@query("q28_note_names", f"with {HZ}, m as (select *, 69 + 12 * log2(f / 440) m from hz) select track, frame, round_even(m, 6) + 0::double midi, {NAMES}[(((round_even(m, 0)::int % 12) + 12) % 12) + 1] || (floor(round_even(m, 0) / 12)::int - 1)::varchar note, round_even(440 * pow(2, (m - 69) / 12), 4) + 0::double hz from m")
def q28(spark, sf):
    p = pitch(spark, sf).withColumn("m", S.midi_from_hz(F.col("f")))
    return p.select("track", "frame", r6(F.col("m")).alias("midi"), S.note_name(F.col("m")).alias("note"), (F.bround(S.hz_from_midi(F.col("m")), 4) + num(0)).alias("hz"))


@query("q29_octave_snap", f"""with {HZ}, m as (select *, round_even(69 + 12 * log2(f / 440), 3) m from hz), s as (select *, quantile_cont(m, 0.5) over (partition by track order by frame rows between 2 preceding and 2 following) s from m),
g as (select *, quantile_cont(s, 0.5) over (partition by track order by frame rows between 10 preceding and 10 following) g from s), k as (select *, round_even((g - s) / 12, 0) k from g)
select track, frame, round_even(s, 6) + 0::double smooth, round_even(case when k <> 0 and abs(s + 12 * k - g) < abs(s - g) then s + 12 * k else s end, 6) + 0::double snapped from k""")
def q29(spark, sf):
    p = pitch(spark, sf).withColumn("m", F.bround(S.midi_from_hz(F.col("f")), 3)).withColumn("smooth", series.rolling_median("m", 2, ["track"]))
    return series.octave_snap(p, "smooth", 10, ["track"]).select("track", "frame", r6(F.col("smooth")).alias("smooth"), r6(F.col("snapped")).alias("snapped"))


@query("q30_runs", f"""with {LI}, m as (select *, coalesce((l_returnflag <> lag(l_returnflag) over w)::int, 1) s from li window w as (partition by l_orderkey order by n)),
i as (select *, sum(s) over (partition by l_orderkey order by n) run from m) select l_orderkey, l_returnflag, min(n) "first", max(n) "last", count(*) n from i group by l_orderkey, l_returnflag, run""")
def q30(spark, sf):
    return series.runs(lines(spark, sf).select("l_orderkey", "l_returnflag", F.col("n").alias("i")), "l_returnflag", ["l_orderkey"], "i").drop("run")


@query("q30b_voiced_fraction", "with v as (select l_orderkey, count(*) n, avg((l_returnflag <> 'N')::int::double) f from lineitem group by 1) select l_orderkey, round_even(f, 6) + 0::double voiced, case when f < 0.15 then 'unvoiced' else 'ok' end status, f < 0.30 caveat from v")
def q30b(spark, sf):
    v = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.avg((F.col("l_returnflag") != "N").cast("double")).alias("f"))
    return v.select("l_orderkey", r6(F.col("f")).alias("voiced"), F.when(F.col("f") < 0.15, "unvoiced").otherwise("ok").alias("status"), (F.col("f") < 0.30).alias("caveat"))


def SQL_RAMP(v, t, s):
    return f"(case when ({v} - {t}::double) / {s - t}::double >= 0 then least(1::double, ({v} - {t}::double) / {s - t}::double) end)"


_UP, _DOWN = SQL_RAMP("l_discount", 0.02, 0.08), SQL_RAMP("l_tax", 0.06, 0.01)
_A, _B = SQL_RAMP("l_quantity", 10.0, 15.0), SQL_RAMP("l_quantity", 40.0, 35.0)


@query("q31_ramps", f"select l_orderkey, l_linenumber, round_even({_UP}, 6) + 0::double up, round_even({_DOWN}, 6) + 0::double down, round_even(case when {_UP} is not null and {_DOWN} is not null then least({_UP}, {_DOWN}) end, 6) + 0::double both_, round_even(case when {_A} is not null and {_B} is not null then least({_A}, {_B}) end, 6) + 0::double inside from lineitem")
def q31(spark, sf):
    l = table(spark, sf, "lineitem")
    up, down = S.ramp(F.col("l_discount"), 0.02, 0.08), S.ramp(F.col("l_tax"), 0.06, 0.01)
    return l.select("l_orderkey", "l_linenumber", r6(up).alias("up"), r6(down).alias("down"), r6(S.every(up, down)).alias("both_"), r6(S.between(F.col("l_quantity"), 10, 40, 5)).alias("inside"))


FEATURES = """select l_suppkey track, unnest(['drums', 'bass', 'vocals', 'other']) source, case when l_suppkey % 7 = 0 then null else -60 + avg(l_quantity) end loudness_lufs, avg(l_discount) rms_mean, 1 + count(*) / 50::double crest_factor,
 avg(l_quantity) / 6 onset_density, 100 * avg(l_quantity) centroid_energy_hz, 50 * avg(l_quantity) centroid_mean, 30 * avg(l_quantity) centroid_std, 0.5 + avg(l_tax) * 8 chroma_entropy, avg(l_tax) * 20 band_low, avg(l_discount) * 4 band_high, avg(l_quantity) / 5 transient_sharpness from lineitem group by l_suppkey"""


@query("q32_labels", labels.oracle(FEATURES, "track, source"))
def q32(spark, sf):
    q, d, t, n = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("n")
    f = series.averages(table(spark, sf, "lineitem").withColumn("track", F.col("l_suppkey")), ["track"], ["l_quantity", "l_discount", "l_tax"]).select("track", (num(-60) + q).alias("_l"), d.alias("rms_mean"), (num(1) + n / num(50)).alias("crest_factor"), (q / num(6)).alias("onset_density"), (num(100) * q).alias("centroid_energy_hz"), (num(50) * q).alias("centroid_mean"), (num(30) * q).alias("centroid_std"), (num(0.5) + t * num(8)).alias("chroma_entropy"), (t * num(20)).alias("band_low"), (d * num(4)).alias("band_high"), (q / num(5)).alias("transient_sharpness"))
    f = f.withColumn("loudness_lufs", F.when(F.col("track") % 7 != 0, F.col("_l"))).withColumn("source", F.explode(F.array(*[F.lit(x) for x in ("drums", "bass", "vocals", "other")])))
    return labels.label(f, ["track", "source"]).select("track", "source", "label", r6(F.col("confidence")).alias("confidence"), labels.evidence_text(F.col("evidence")).alias("evidence"))


@query("q33_class_decision", """with s as (select p_partkey, [{'s': -(p_size / 50::double), 'n': 'kick'}, {'s': -(p_retailprice / 2000::double), 'n': 'snare'}, {'s': -((p_partkey % 10) / 10::double), 'n': 'hat'}] a from part),
b as (select p_partkey, list_sort(a) a from s) select p_partkey, case when -a[1].s >= 0.15::double and a[2].s - a[1].s >= 0.10::double then a[1].n else 'unclassified' end cls, round_even(case when -a[1].s >= 0.15::double and a[2].s - a[1].s >= 0.10::double then -a[1].s else -a[2].s end, 6) + 0::double confidence from b""")
def q33(spark, sf):
    from tessitura.operators.drums import decide

    p = table(spark, sf, "part")
    scores = {"kick": F.col("p_size") / num(50), "snare": F.col("p_retailprice") / num(2000), "hat": (F.col("p_partkey") % 10) / num(10)}
    d = decide(scores)
    return p.select("p_partkey", d["cls"].alias("cls"), r6(d["confidence"]).alias("confidence"))


@query("q34_affinity", """with s as (select p_partkey, p_brand, p_size / 50::double a, p_retailprice / 2000::double b, (p_partkey % 10) / 10::double c, ['kick', 'body', 'noise', 'air'][(p_partkey % 4 + 1)::int] band from part)
select p_partkey, band, round_even(a * case band when 'kick' then 1 when 'body' then 0.4 else 0 end::double, 6) + 0::double kick, round_even(b * case band when 'kick' then 0.4 when 'body' then 1 when 'noise' then 0 else 0 end::double, 6) + case when band = 'noise' then round_even(b * 1::double, 6) else 0::double end + case when band = 'air' then round_even(b * 0.3::double, 6) else 0::double end snare,
 round_even(c * case band when 'noise' then 0.5 when 'air' then 1 else 0 end::double, 6) + 0::double hat from s""")
def q34(spark, sf):
    from tessitura.operators.drums import class_scores

    p = table(spark, sf, "part").withColumn("band", F.element_at(F.array(*[F.lit(b) for b in ("kick", "body", "noise", "air")]), (F.col("p_partkey") % 4 + 1).cast("int")))
    s = class_scores(F.col("band"), {"kick": F.col("p_size") / num(50), "snare": F.col("p_retailprice") / num(2000), "hat": (F.col("p_partkey") % 10) / num(10)})
    return p.select("p_partkey", "band", *[r6(v).alias(k) for k, v in s.items()])


@query("q35_range_semi_anti", """with e as (select event_id, user_id, event_type, count(*) filter (where event_type = 'click') over (partition by user_id order by event_id range between 200 preceding and 200 following) n from events)
select event_id, n > 0 near_click from e where event_type <> 'click'""")
def q35(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return e.withColumn("near_click", series.near(e, F.col("event_type") == "click", 200, ["user_id"], "event_id")).filter("event_type <> 'click'").select("event_id", "near_click")


@query("q36_nearest", """with c as (select o_orderkey, date_diff('day', timestamp '1992-01-01', o_orderdate) % 28 d from orders), x as (select o_orderkey, unnest([0, 7, 14, 21]) c, d from c)
select o_orderkey, arg_min(c, {'d': least(abs(d - c), 28 - abs(d - c)), 'c': c})::int candidate from x group by 1""")
def q36(spark, sf):
    from tessitura.operators.tempo import nearest_candidate

    o = table(spark, sf, "orders").withColumn("d", F.pmod(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")), F.lit(28)))
    return o.select("o_orderkey", nearest_candidate(F.col("d"), [0, 7, 14, 21], 28).alias("candidate"))


@query("q37_grid_fanout", "select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def q37(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    grid_ = n.join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return table(spark, sf, "customer").join(grid_, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query("q38_replace_full", "select d.doc_id, coalesce(l.quality, -1) quality, l.doc_id is null missing from documents d left join labels l using (doc_id)")
def q38(spark, sf):
    d, l = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").withColumn("_there", F.lit(True))
    return d.join(l, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("_there").isNull().alias("missing"))


@query("q39_interval_sums", f"""with {LI}, s as (select l_orderkey track, min(n) "start", max(n) "end" from li group by 1)
select track, "start", "end", round_even(coalesce(sum(l_quantity) filter (where n >= "start" and n < "end"), 0), 6) + 0::double total from s join li on l_orderkey = track group by all""")
def q39(spark, sf):
    l = lines(spark, sf).select(F.col("l_orderkey").alias("track"), F.col("n").alias("frame"), "l_quantity")
    spans = l.groupBy("track").agg(F.min("frame").alias("start"), F.max("frame").alias("end"))
    return series.interval_sums(l, spans, "l_quantity", ["track"]).select("track", "start", "end", r6(F.col("total")).alias("total"))


@query("q40_set_operations", """with a as (select user_id, ts::date d, list_sort(list_distinct(list(event_type))) s from events group by all), b as (select *, lag(s) over (partition by user_id order by d) p from a)
select user_id, d::varchar d, array_to_string(list_sort(list_distinct(list_concat(s, coalesce(p, [])))), ',') both_, len(list_filter(s, lambda x: not list_contains(coalesce(p, []), x))) + len(list_filter(coalesce(p, []), lambda x: not list_contains(s, x))) differ from b""")
def q40(spark, sf):
    a = table(spark, sf, "events").groupBy("user_id", F.col("ts").cast("date").alias("d")).agg(F.array_sort(F.collect_set("event_type")).alias("s"))
    p = F.coalesce(F.lag("s").over(Window.partitionBy("user_id").orderBy("d")), F.array().cast("array<string>"))
    a = a.withColumn("p", p)
    return a.select("user_id", F.col("d").cast("string").alias("d"), F.array_join(F.array_sort(F.array_union("s", "p")), ",").alias("both_"), (F.size(F.array_except("s", "p")) + F.size(F.array_except("p", "s"))).cast("long").alias("differ"))


@query("q41_slug", "select page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'track') slug from pages")
def q41(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.slugify(F.col("url")).alias("slug"))


@query("q42_counts", "select conv_id, count(*) turns, round_even(avg(length(text)), 6) + 0::double mean_chars from conversations group by 1")
def q42(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("turns"), r6(F.avg(F.length("text").cast("double"))).alias("mean_chars"))
    return c.select("conv_id", F.size("turns").cast("long").alias("turns"), "mean_chars")


@query("q43_unavailable", "select c_custkey, array_to_string(list_filter([case when c_acctbal < 0 then 'dynamics.balance' end, case when c_mktsegment = 'BUILDING' then 'rhythm.segment' end], lambda x: x is not null), ',') missing from customer")
def q43(spark, sf):
    c = table(spark, sf, "customer")
    fields = {"rhythm.segment": F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")), "dynamics.balance": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))}
    return c.select("c_custkey", F.array_join(S.unavailable(fields), ",").alias("missing"))


@query("q44_caps", "with c as (select conv_id, list(turn order by turn) t from conversations group by 1) select conv_id, array_to_string(t[1:3], ',') items, case when len(t) > 3 then len(t)::int end truncated_from from c")
def q44(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    k = S.capped(F.col("t"), 3)
    return c.select("conv_id", F.array_join(k["items"].cast("array<string>"), ",").alias("items"), k["truncated_from"].alias("truncated_from"))


@query("q45_json", "select event_id, (props::json->>'$.k')::bigint k from events")
def q45(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))

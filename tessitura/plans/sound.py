"""Queries over sound and frames that are made from ``events``.

Two forms: recordings, the values of a type's events of a week in order, each held for 256 samples, written as WAV files and read back by the
data source; and frames of two minutes, a week being a track, an event's type its source and the size of its value the band.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura import sinks
from tessitura.functions.scalars import HOP, HOP_SECONDS, N_FFT, SAMPLE_RATE, num, r6
from tessitura.operators import analysis, arrangement, hints, labels, series, spectrum, tonal, track
from tessitura.plans import sections_sql
from tessitura.plans.columnar import FEATURES, seconds
from tessitura.plans.extended import TUMBLING, shown
from tessitura.plans.registry import registry
from tessitura.session import materialize, new_path, table
from tessitura.sources import audio, wav
from tessitura.streaming import windows

QUERIES, ORACLES, query = registry()
HOLD, FULL = 256, 500.0
WEEK, SLOT = 604800, 120
KEYS = ["track", "source"]


def recordings(spark, sf) -> DataFrame:
    """Chunk rows of the recordings: written, then read by ranges of bytes."""
    return sound_of(spark, table(spark, sf, "events"))[0]


#: Bytes of a recording that one task reads: many chunks, as a task of few takes longer to start than to read.
READ_BYTES = 8 << 20


def sound_of(spark, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk rows, (track, source, path, total)) of the recordings of ``events``."""
    e = events.select(F.concat(F.lit("week"), F.floor(seconds("ts") / num(WEEK)).cast("string")).alias("track"), F.col("event_type").alias("source"), F.col("event_id").alias("i"), (F.col("value") / num(FULL)).alias("value"))
    root = new_path(spark, "recordings")
    written = materialize(wav.write_recordings(e, root, HOLD), "recordings-written")
    return wav.read_chunks(spark, root, READ_BYTES), written


#: The samples of a recording in SQL: v, the i-th value as it is read back.
SAMPLES = f"""w as (select 'week' || floor(epoch_us(ts - timestamp '2024-01-01') / 1e6::double / {WEEK})::bigint track, event_type source, event_id, round_even(least(1, greatest(-1, value / {FULL}::double)) * 32767, 0) / 32768 v from events),
x as (select track, source, row_number() over (partition by track, source order by event_id) - 1 i, v from w)"""


@query("q50_levels", f"with {SAMPLES} select track, source, count(*) * {HOLD} samples, round_even(max(abs(v)), 6) + 0::double peak, round_even(max(abs(v)) / nullif(sqrt(avg(v * v)), 0), 6) + 0::double crest, round_even(count(*) * {HOLD} / {SAMPLE_RATE}::double, 6) + 0::double as seconds from x group by all")
def q50(spark, sf):
    out = audio.levels(recordings(spark, sf), KEYS)
    return out.select(*KEYS, F.rint(F.col("seconds") * num(SAMPLE_RATE)).cast("long").alias("samples"), *[r6(F.col(c)).alias(c) for c in ("peak", "crest", "seconds")])


@query("q50b_loudness_gates", """with h as (select event_type, floor(epoch_us(ts - timestamp '2024-01-01') / 3.6e9::double)::bigint cell, sum(value) / 10000 * 4410 s, 4410 n from events group by all),
b as (select event_type, sum(s) over w / 17640::double p, sum(n) over w n from h window w as (partition by event_type order by cell range between current row and 3 following)),
a as (select event_type, p, -0.691::double + 10 * log10(greatest(p, 1e-30)) l from b where n = 17640), k as (select * from a where l > -70), m as (select event_type, avg(p) m from k group by 1),
g as (select k.* from k join m using (event_type) where l > -0.691::double + 10 * log10(greatest(m, 1e-30)) - 10)
select event_type, round_even(-0.691::double + 10 * log10(avg(p)), 6) + 0::double lufs from g group by 1""")
def q50b(spark, sf):
    """Both gates of the loudness measure over hourly sums in place of cells of 100 ms."""
    h = table(spark, sf, "events").groupBy("event_type", F.floor(seconds("ts") / num(3600)).alias("cell")).agg((F.sum("value") / num(10000) * num(audio.CELL)).alias("weighted"), F.lit(audio.CELL).cast("long").alias("n"))
    return audio.gated(h, ["event_type"]).select("event_type", r6(F.col("lufs")).alias("lufs"))


def _forms() -> dict[str, np.ndarray]:
    """Band energy of a frame as a quadratic form of the eight values that it covers, from the definition of the transform."""
    n = np.arange(N_FFT)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * n / N_FFT)
    bins = np.arange(N_FFT // 2 + 1)
    wave = np.exp(-2j * np.pi * np.outer(bins, n) / N_FFT) * window
    part = wave.reshape(len(bins), N_FFT // HOLD, HOLD).sum(2)
    hz = bins * SAMPLE_RATE / N_FFT
    out = {}
    for band, (lo, hi) in audio.BANDS.items():
        p = part[(hz >= lo) & ((hz <= hi) if band == "air" else (hz < hi))]
        out[band] = (p.conj().T @ p).real
    return out


def _band_sql() -> str:
    def form(m):
        return " + ".join(f"{float(m[i, j]) * (1 if i == j else 2)!r}::double * v{i} * v{j}" for i in range(8) for j in range(i, 8))

    before = N_FFT // 2 // HOLD
    # a place before the first is no place from the end
    at = ", ".join(f"case when f * {HOP // HOLD} - {before - 1} + {k} >= 1 then coalesce(list_extract(l, (f * {HOP // HOLD} - {before - 1} + {k})::bigint), 0) else 0 end v{k}" for k in range(8))
    bands = ", ".join(f"round_even(avg({form(m)}), 4) + 0::double {b}" for b, m in _forms().items())
    rms = " + ".join(f"v{k} * v{k}" for k in range(8))
    return f"""with {SAMPLES}, r as (select track, source, list(v order by i) l from x group by all), fr as (select track, source, l, unnest(range(len(l) * {HOLD} // {HOP} + 1)) f from r),
v as (select track, source, {at} from fr) select track, source, count(*) frames, round_even(avg(sqrt(({rms}) / 8)), 6) + 0::double rms, {bands} from v group by all"""


@query("q46_band_energy", _band_sql())
def q46(spark, sf):
    """Mean level and mean energy of each band over the frames of recordings."""
    f = audio.frame_bands(recordings(spark, sf))
    return f.groupBy(*KEYS).agg(F.count("*").alias("frames"), r6(F.avg("rms")).alias("rms"), *[(F.bround(F.avg(b), 4) + num(0)).alias(b) for b in audio.BANDS])


@query("q65_descriptors")
def q65(spark, sf):
    chunks, written = sound_of(spark, table(spark, sf, "events"))
    return analysis.analyse(audio.frame_bands(chunks), audio.levels(chunks, KEYS), written.select(*KEYS))


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("q59_doctor", " union all ".join(f"select '{t}' probe, true as found, count(*)::varchar || ' rows' detail from {t}" for t in TABLES))
def q59(spark, sf):
    """Whether each input can be read, and how much is in it; the environment's own probes are ``sinks.doctor``."""
    return sinks.doctor_of({t: (lambda t=t: table(spark, sf, t)) for t in TABLES}, spark)


#: Sources of the event frames; the mix is everything, errors included.
SOURCES = {"click": "drums", "view": "bass", "purchase": "vocals", "signup": "other"}
BANDS = {"kick": (0, 25), "body": (25, 50), "noise": (50, 100), "air": (100, 1e9)}
FRAMES = WEEK // SLOT


def event_frames(spark, sf) -> DataFrame:
    """(track, source, frame, bands, tempo, rms, power): every frame of a week's track, zero where nothing happened."""
    t = seconds("ts")
    e = table(spark, sf, "events").select(F.concat(F.lit("week"), F.floor(t / num(WEEK)).cast("string")).alias("track"), "event_type", F.floor((t - F.floor(t / num(WEEK)) * num(WEEK)) / num(SLOT)).alias("frame"), "value")
    kind = F.create_map(*[x for k, v in SOURCES.items() for x in (F.lit(k), F.lit(v))])
    e = e.withColumn("source", F.explode(F.array_compact(F.array(F.lit("mix"), F.try_element_at(kind, F.col("event_type"))))))
    inside = lambda lo, hi: F.sum(F.when((F.col("value") >= lo) & (F.col("value") < hi), F.col("value")).otherwise(num(0)))
    sums = e.groupBy(*KEYS, "frame").agg(*[inside(*b).alias(k) for k, b in BANDS.items()])
    every = e.select(*KEYS).distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FRAMES - 1).cast("long"))))
    f = every.join(sums, [*KEYS, "frame"], "left").select(*KEYS, "frame", *[F.coalesce(b, num(0)).alias(b) for b in BANDS])
    f = f.withColumn("tempo", F.col("kick") + F.col("body")).withColumn("power", F.col("tempo") + F.col("noise") + F.col("air"))
    return materialize(f.withColumn("rms", F.col("power") / num(1000)), "event-frames")


#: The event frames in SQL.
FR = f"""ev as (select 'week' || (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // {WEEK * 1000000} track, event_type, ((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) % {WEEK * 1000000}) // {SLOT * 1000000} frame, value from events),
es as (select track, 'mix' source, frame, value from ev union all select track, case event_type {' '.join(f"when '{k}' then '{v}'" for k, v in SOURCES.items())} end source, frame, value from ev where event_type in ({', '.join(f"'{k}'" for k in SOURCES)})),
eg as (select track, source, frame, {', '.join(f'coalesce(sum(value) filter (where value >= {lo} and value < {hi!r}), 0) {b}' for b, (lo, hi) in BANDS.items())} from es group by all),
ea as (select track, source, unnest(range({FRAMES})) frame from (select distinct track, source from es)),
fr as (select track, source, frame, {', '.join(f'coalesce({b}, 0) {b}' for b in BANDS)}, coalesce(kick, 0) + coalesce(body, 0) tempo, coalesce(kick, 0) + coalesce(body, 0) + coalesce(noise, 0) + coalesce(air, 0) power, (coalesce(kick, 0) + coalesce(body, 0) + coalesce(noise, 0) + coalesce(air, 0)) / 1000 rms from ea left join eg using (track, source, frame))"""
SRC = f"""{FR}, gs as (select track, avg(rms) filter (where source = 'drums') d, count(*) filter (where source = 'mix') m from fr group by 1),
gr as (select track, case when d >= 0.001 then 'drums' when m > 0 then 'mix' end source, coalesce(d >= 0.001, false) is_drums from gs)"""


@query("q72_grid_source", f"with {SRC} select track, source, is_drums from gr")
def q72(spark, sf):
    return track.grid_source(event_frames(spark, sf))


def coarse_of(frames: DataFrame) -> DataFrame:
    """The tempo that each track is given: 120 for want of a listener."""
    return frames.select("track").distinct().select("track", num(120).alias("bpm"), F.lit(None).cast("double").alias("r"))


#: Tempo in SQL: the correlation of the grid source's flux at every lag, and what each multiple of the beat says.
TEMPO = f"""{SRC}, gf as (select fr.track, frame, is_drums, tempo low, air bright, coalesce(greatest(ln(1 + tempo) - lag(ln(1 + tempo)) over (partition by fr.track order by frame), 0), 0) flux from fr join gr on fr.track = gr.track and fr.source = gr.source),
cf as (select track, frame, flux - avg(flux) over (partition by track) x from gf), zz as (select track, sum(x * x) z from cf group by 1),
ask as (select m, o, case when o = 1 then 'own' else 'octave' end kind, m * 60 / (120::double * o) / {HOP_SECONDS!r} target, least(0.03::double, 0.45::double / m) width from (values (16, 1::double), (32, 1::double), (16, 0.5::double), (16, 2::double)) a(m, o)),
win as (select *, greatest(1, floor(target * (1 - width))::bigint) lo, ceil(target * (1 + width))::bigint hi from ask),
lg as (select distinct unnest(range(lo - 3, hi + 4)) g from win), sh as (select track, frame + g frame, g, x from cf, lg), rr as (select track, g, sum(sh.x * cf.x) / any_value(z) r from sh join cf using (track, frame) join zz using (track) group by all),
pk as (select track, m, o, lo, hi, arg_max(g, {{'r': r, 'g': -g}}) i, greatest(0, max(r)) r, max(r) raw from win join rr on g between lo and hi group by all),
lo3 as (select p.track, p.m, p.o, list(q.r order by g) rs from pk p join rr q on q.track = p.track and g between i - 3 and i + 3 group by all),
lob as (select pk.*, list_transform(rs, lambda x: x - list_min(rs)) l from pk join lo3 using (track, m, o)),
ft as (select *, 60::double * m / ((i + list_sum(list_transform(range(1, 8), lambda k: l[k] * (k - 4))) / list_sum(l)) * {HOP_SECONDS!r}) bpm, hi > {FRAMES} // 2 - 4 short from lob),
fw as (select *, case when short then 'too_short' when raw < 0.15 then 'below' when abs(bpm - 120 * o) / (120 * o) > 0.03 then 'outside' end reason from ft),
own as (select track, list(bpm order by m) filter (where reason is null) b, min(r) filter (where reason is null) weakest, count(*) filter (where reason is null) n from fw where o = 1 group by 1),
oct as (select track, bool_or(not short and r >= 0.15) filter (where o <> 1) other from fw where m = 16 group by 1),
tf as (select own.track, case when n = 0 or (n = 2 and abs(b[1] - b[2]) > 0.05) then null when n = 1 then b[1] else (b[1] + b[2]) / 2 end bpm, case when n = 1 then least(weakest, 0.5::double - 1e-9) else weakest end w, other from own join oct using (track))"""


@query("q47_refine_bpm", f"with {TEMPO} select track, round_even(coalesce(bpm, 120), 6) + 0::double bpm, case when bpm is null then 'coarse' else 'refined' end status, round_even(case when bpm is null then 0 else w end, 6) + 0::double r, case when bpm is null then 'low' when w >= 0.5 then 'high' when w >= 0.25 then 'medium' else 'low' end confidence, case when other then 'ambiguous' else 'single' end octave from tf")
def q47(spark, sf):
    """The tempo of each track on its grid source, refined from the one it is given."""
    f = event_frames(spark, sf)
    t = track.Track(f, coarse_of(f)).first_fit
    return t.select("track", r6(F.col("bpm")).alias("bpm"), "status", r6(F.col("r")).alias("r"), "confidence", "octave")


def parts(spark, sf):
    f = event_frames(spark, sf)
    return track.Track(f, coarse_of(f)).drum_parts


@query("q48_decompose")
def q48(spark, sf):
    return parts(spark, sf)[0]


@query("q48b_patterns")
def q48b(spark, sf):
    return parts(spark, sf)[1]


@query("q48c_grid")
def q48c(spark, sf):
    return parts(spark, sf)[2]


GATES = f"""{SRC}, dl as (select fr.track, frame, unnest(['kick', 'body', 'noise', 'air']) band, unnest([kick, body, noise, air]) value from fr join gr on gr.track = fr.track and is_drums where fr.source = 'drums'),
df as (select *, coalesce(greatest(ln(1 + value) - lag(ln(1 + value)) over (partition by track, band order by frame), 0), 0) flux from dl),
dg as (select track, band, sum(value) e, max(flux) peak from df group by all),
ds as (select df.track, df.band, avg((flux <= 0.02::double * peak)::int::double) sparsity from df join dg using (track, band) group by all),
dc as (select track, band, e / nullif(sum(e) over (partition by track), 0) share, peak from dg)"""


@query("q73_drum_gates", f"with {GATES} select track, band, round_even(coalesce(share, 0), 6) + 0::double share, round_even(peak, 6) + 0::double peak, round_even(sparsity, 6) + 0::double sparsity, case when coalesce(share, 0) < 0.001 then 'empty' when peak < 1 then 'no_transient' when sparsity < 0.72::double then 'not_sparse' end refusal from dc join ds using (track, band)")
def q73(spark, sf):
    """Which bands of a track's drums are searched for hits."""
    f = event_frames(spark, sf)
    gate = track.Track(f, coarse_of(f)).heard[3]
    return gate.select("track", "band", *[r6(F.col(c)).alias(c) for c in ("share", "peak", "sparsity")], "refusal")


#: Bars of 2 s from 0 on over the frames: levels, presence, sections.
_EDGE = f"round_even(({{}}) * 2::double / {HOP_SECONDS!r}, 0)"
_BARS = f"floor({FRAMES} * {HOP_SECONDS!r} / 2)::bigint + (({FRAMES} * {HOP_SECONDS!r} - floor({FRAMES} * {HOP_SECONDS!r} / 2) * 2 >= 1)::int)"
ARRANGED = f"""with recursive {FR}, al as (select track, source, frame, rms level from fr where source <> 'mix' union all select track, 'kick', frame, kick from fr where source = 'drums'),
ab as (select track, source, bar, sqrt(avg(case when source = 'kick' then level else level * level end)) lvl from al, unnest(range({_BARS})) t(bar) where frame >= {_EDGE.format('bar')} and frame < {_EDGE.format('bar + 1')} group by all),
ar as (select *, quantile_cont(lvl, 0.9) over (partition by track, source) ref from ab), at_ as (select *, max(case when source <> 'kick' then ref end) over (partition by track) top from ar),
ao as (select *, coalesce(ref / nullif(top, 0), 0) < 0.02::double gone from at_), ai as (select *, coalesce(max(case when source = 'drums' then gone end) over (partition by track), false) dgone from ao),
ps as (select track, source, bar, case when source = 'kick' then dgone else gone end absent, not (case when source = 'kick' then dgone else gone end) and 0.15::double * ref > 0 and lvl >= 0.15::double * ref present from ai),
{sections_sql.merged('ps')}, {sections_sql.named()}"""


@query("q74_arrangement", f"{ARRANGED} select track, start_bar::int start_bar, length_bars::int length_bars, round_even(start_bar * 2, 6) + 0::double start_seconds, array_to_string(p, ',') active, label from lab")
def q74(spark, sf):
    """Sections of each track over bars of two seconds."""
    f = event_frames(spark, sf)
    stems = f.filter(F.col("source").isin(*arrangement.STEMS)).select("track", "source", "frame", F.col("rms").alias("level"))
    kick = f.filter("source = 'drums'").select("track", F.lit(arrangement.KICK).alias("source"), "frame", F.col("kick").alias("level"))
    g = f.select("track").distinct().select("track", num(0.5).alias("beat_period_seconds"), num(0).alias("downbeat_seconds"), F.lit("high").alias("trust"))
    a = arrangement.arrange(stems.unionByName(kick), g, ["track"], HOP_SECONDS)
    s = a.select("track", F.inline("arrangement.sections"))
    return s.select("track", "start_bar", "length_bars", r6(F.col("start_seconds")).alias("start_seconds"), F.array_join("active", ",").alias("active"), "label")


@query("q75_track")
def q75(spark, sf):
    """The whole graph: one nested row for each track, as JSON."""
    f = event_frames(spark, sf)
    return sinks.documents(track.Track(f, coarse_of(f)).tracks())


@query("q76_nearest_peak", """with h as (select event_type source, floor(epoch_us(ts - timestamp '2024-01-01') / 3.6e9::double)::bigint frame, sum(value) v from events group by all),
m as (select a.source, a.frame, arg_max(b.frame, {'v': b.v, 'f': -b.frame}) peak_frame, max(b.v) peak from h a join h b on a.source = b.source and b.frame between a.frame - 2 and a.frame + 2 group by all)
select event_id, peak_frame, round_even(peak, 6) + 0::double peak from (select event_id, event_type source, round_even(epoch_us(ts - timestamp '2024-01-01') / 1e6::double / 3600, 0)::bigint frame from events) e left join m using (source, frame)""")
def q76(spark, sf):
    """Each event moved onto the loudest hour of its type around it."""
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("source"), "value", seconds("ts").alias("t"))
    h = e.groupBy("source", F.floor(F.col("t") / num(3600)).alias("frame")).agg(F.sum("value").alias("value"))
    return series.nearest_peak(e.drop("value"), h, 2, 3600.0, ["source"]).select("event_id", "peak_frame", r6(F.col("peak")).alias("peak"))


@query("q77_flatness", """with h as (select user_id, floor(value / 10)::bigint bin, sum(value * value) p from events group by all), t as (select *, max(p) over (partition by user_id) top from h)
select user_id, round_even(exp(avg(ln(greatest(p, top * 1e-12::double)))) / avg(greatest(p, top * 1e-12::double)), 6) + 0::double flatness from t where top > 0 group by 1""")
def q77(spark, sf):
    """How even the power of a user's events is over their sizes."""
    h = table(spark, sf, "events").groupBy("user_id", F.floor(F.col("value") / num(10)).alias("bin")).agg(F.sum(F.col("value") * F.col("value")).alias("p"))
    power = h.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "p"))), lambda x: x["p"]).alias("power"))
    return power.select("user_id", r6(spectrum.flatness(F.col("power"))).alias("flatness")).filter("flatness is not null")


@query("q78_peak_classes", f"""with p as (select user_id, 55 * power(2::double, (props::json->>'$.k')::bigint / 24::double) hz, value m from events), q as (select *, 69 + 12 * log2(hz / 440) midi from p where hz >= 40 and hz <= 5000 and m > 0),
c as (select user_id, i, midi - i + 6 - floor((midi - i + 6) / 12) * 12 - 6 off, m from q, unnest(range(12)) t(i)), s as (select user_id, i, sum(case when abs(off) <= {2 / 3!r}::double then power(cos({np.pi * 3 / 4!r}::double * off), 2) * m * m else 0 end) s from c group by all)
select user_id, i::int pitch_class, round_even(s / max(s) over (partition by user_id), 6) + 0::double share from s""")
def q78(spark, sf):
    """Pitch classes of each user's events, their size as the magnitude of a peak at a pitch that ``k`` gives."""
    k = F.from_json("props", "k long")["k"]
    p = table(spark, sf, "events").select("user_id", (num(55) * F.pow(num(2), k / num(24))).alias("hz"), F.col("value").alias("magnitude"))
    c = tonal.peak_classes(p, ["user_id"]).select("user_id", F.posexplode("chroma").alias("pitch_class", "share"))
    return c.select("user_id", "pitch_class", r6(F.col("share")).alias("share"))


@query("q79_rules_of_a_table", labels.oracle(FEATURES, "track, source"))
def q79(spark, sf):
    """The labels again by rules that are rows."""
    l = series.averages(table(spark, sf, "lineitem").withColumn("track", F.col("l_suppkey")), ["track"], ["l_quantity", "l_discount", "l_tax"])
    q, d, t, n = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("n")
    f = l.select("track", (num(-60) + q).alias("_l"), d.alias("rms_mean"), (num(1) + n / num(50)).alias("crest_factor"), (q / num(6)).alias("onset_density"), (num(100) * q).alias("centroid_energy_hz"), (num(50) * q).alias("centroid_mean"), (num(30) * q).alias("centroid_std"), (num(0.5) + t * num(8)).alias("chroma_entropy"), (t * num(20)).alias("band_low"), (d * num(4)).alias("band_high"), (q / num(5)).alias("transient_sharpness"))
    f = f.withColumn("loudness_lufs", F.when(F.col("track") % 7 != 0, F.col("_l"))).drop("_l").withColumn("source", F.explode(F.array(*[F.lit(x) for x in arrangement.STEMS])))
    return labels.label_by(f, labels.rule_rows(spark), KEYS).select(*KEYS, "label", r6(F.col("confidence")).alias("confidence"), labels.evidence_text(F.col("evidence")).alias("evidence"))


@query("q80_bounded_stream", TUMBLING)
def q80(spark, sf):
    """Windows of a stream that evicts its state, the latest value of each."""
    e = table(spark, sf, "events")
    latest, _ = windows.run_bounded(spark, sf, "events.parquet", e.schema, new_path(spark, "stream"))
    return shown(latest)


@query("q81_tempo_fanout", f"""with {TEMPO}, p as (select track, 60 / coalesce(bpm, 120) p from tf) select fr.track, fr.source, round_even(any_value(p), 6) + 0::double period_seconds, count(*) frames from fr left join p on p.track = fr.track group by fr.track, fr.source""")
def q81(spark, sf):
    """A track's one tempo at each of its sources."""
    f = event_frames(spark, sf)
    t = track.Track(f, coarse_of(f)).tempo.select("track", "period_seconds")
    return f.join(t, "track", "left").groupBy(*KEYS).agg(r6(F.first("period_seconds")).alias("period_seconds"), F.count("*").alias("frames"))


@query("q82_rounded_documents", "select event_type, '{\"event_type\":\"' || event_type || '\",\"levels\":{\"events\":' || count(*) || ',\"users\":' || count(distinct user_id) || '}}' value from events group by 1")
def q82(spark, sf):
    """Documents in which a list is told by its length."""
    e = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.collect_set("user_id").alias("users"))
    e = e.select("event_type", F.struct("events", "users").alias("levels"))
    kept = e.select("event_type", sinks.counted(F.col("levels"), e.schema["levels"].dataType, {"users"}).alias("levels"))
    return kept.select("event_type", F.to_json(F.struct(*[sinks.rounded(F.col(f.name), f.dataType).alias(f.name) for f in kept.schema])).alias("value"))


@query("q83_hints")
def q83(spark, sf):
    """From the sound of events to hints: a type's recording is a source, errors are the mix."""
    kinds = F.create_map(*[x for k, v in {**SOURCES, "error": "mix"}.items() for x in (F.lit(k), F.lit(v))])
    chunks, written = sound_of(spark, table(spark, sf, "events").withColumn("event_type", F.try_element_at(kinds, F.col("event_type"))))
    chunks = materialize(chunks, "event-sound")
    wanted = analysis.expected(written.select("track"))
    found, tracks = track.from_sound(audio.frame_bands(chunks), audio.pitch(chunks.filter("source = 'bass'")), audio.levels(chunks, KEYS), wanted)
    return sinks.documents(hints.assemble(tracks, found))

"""Queries of operators that need arrays in Python, of documents and of streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessitura import sinks
from tessitura.functions import sql
from tessitura.functions.scalars import HOP_SECONDS, confidence_label, num, r6
from tessitura.operators import analysis, arrangement, downbeat, drums, hints, notes, series, tempo, vocab
from tessitura.plans import sections_sql
from tessitura.plans.columnar import IOI, PRESENCE, envelope, hourly, presence
from tessitura.plans.registry import registry
from tessitura.session import new_path, table
from tessitura.sources import audio
from tessitura.streaming import windows

QUERIES, ORACLES, query = registry()


@query("q14_tempo_hourly")
def q14(spark, sf):
    """Tempo fit of hourly sums, a beat an hour: the data is random, so a coarse answer is right."""
    h = hourly(spark, sf).withColumn("frame", F.col("h") - F.min("h").over(Window.partitionBy("source")))
    f = series.flux(h, "v", ["source"]).withColumn("coarse", num(1 / 60))
    return tempo.refine(f, ["source"], 3600.0)


#: Frames that each line's pitch is held: more than the median of the octave guard spans, so that at most two meet in it.
HELD = 22
NOTES = f"""with l as (select l_suppkey track, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) i, 30 + 370 * (l_quantity - 1) / 49::double f from lineitem),
fr as (select track, (i - 1) * {HELD} + k frame, f, 69 + 12 * log2(f / 440) m from l, unnest(range({HELD})) t(k)),
s as (select *, quantile_cont(m, 0.5) over (partition by track order by frame rows between 2 preceding and 2 following) s from fr), c as (select *, quantile_cont(s, 0.5) over (partition by track order by frame rows between 10 preceding and 10 following) c from s),
r as (select track, frame, f, round_even(case when abs(s + 12 * round_even((c - s) / 12, 0) - c) < abs(s - c) then s + 12 * round_even((c - s) / 12, 0) else s end, 0)::bigint midi from c),
n as (select *, coalesce((midi <> lag(midi) over (partition by track order by frame))::int, 0) new from r), g as (select *, sum(new) over (partition by track order by frame)::int note from n)
select track, note, min(frame)::bigint start_frame, (max(frame) + 1)::bigint end_frame, any_value(midi)::int midi, round_even(100 * (69 + 12 * log2(quantile_cont(f, 0.5) / 440) - any_value(midi)), 4) + 0::double cents from g group by track, note"""


@query("q49_notes", NOTES)
def q49(spark, sf):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    p = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("track"), F.row_number().over(order).alias("i"), (num(30) + num(370) * (F.col("l_quantity") - num(1)) / num(49)).alias("f"))
    held = p.select("track", ((F.col("i") - 1) * HELD).cast("long").alias("frame"), F.lit(HELD).alias("length"), F.col("f").alias("f0_hz"), F.lit(True).alias("voiced"), num(0.9).alias("voiced_prob"))
    n = notes.segment_notes(held, ["track"], HOP_SECONDS)
    return n.select("track", "note", "start_frame", "end_frame", "midi", (F.bround("cents", 4) + num(0)).alias("cents"))


TUMBLING = "select date_trunc('hour', ts)::timestamp start, event_type, count(*) n, round_even(sum(value), 4) + 0::double total from events group by all"


def shown(windowed):
    return windowed.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", (F.bround("total", 4) + num(0)).alias("total"))


@query("q51_stream_windows", TUMBLING)
def q51(spark, sf):
    return shown(windows.tumbling(table(spark, sf, "events")))


@query("q51b_stream_run", TUMBLING)
def q51b(spark, sf):
    e = table(spark, sf, "events")
    return shown(windows.run_available(spark, sf, "events.parquet", e.schema, windows.tumbling, "windows", new_path(spark, "stream")))


@query("q51c_sessions", """with e as (select user_id, ts, coalesce((ts - lag(ts) over w >= interval 30 minutes)::int, 1) s from events window w as (partition by user_id order by ts)),
i as (select *, sum(s) over (partition by user_id order by ts) k from e) select user_id, min(ts)::timestamp "start", (max(ts) + interval 30 minutes)::timestamp "end", count(*) n from i group by user_id, k""")
def q51c(spark, sf):
    out = windows.sessions(table(spark, sf, "events"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


SECTIONS = f"with recursive {PRESENCE}, {sections_sql.merged('ps')}, {sections_sql.named()}"


def event_sections(spark, sf):
    p = presence(spark, sf).select("track", "source", F.col("bar").cast("long").alias("bar"), "present")
    return arrangement.sections(p, ["track"])


@query("q52_section_merge", f"{SECTIONS} select track, start_bar::int start_bar, length_bars::int length_bars, array_to_string(p, ',') active, label from lab")
def q52(spark, sf):
    return event_sections(spark, sf).drop("reason")


def _nearest_sql(value: str, table: dict[str, float]) -> str:
    rows = ", ".join(f"{{'e': abs({value} - {v}::double) / {v}::double, 'k': '{k}'}}" for k, v in table.items())
    return f"case when list_min([{rows}]).e <= 0.15 then list_min([{rows}]).k end"


#: What both readings of a track's intervals need, against a beat of an hour.
FEEL = f"""with {IOI}, a as (select track, t, ioi, quantile_cont(ioi, 0.5) over (partition by track) u, list_sort(list(ioi) over (partition by track)) r from ok),
b as (select *, (r[round_even(0.1::double * (len(r) - 1), 0)::int + 1] + r[round_even(0.9::double * (len(r) - 1), 0)::int + 1]) / 2 split from a), c as (select track, t, ioi, u, ioi >= split long, least(4, greatest(1, round_even(ioi / u, 0))) k from b),
d as (select *, (long <> lag(long) over (partition by track order by t))::int x, quantile_cont(ioi, 0.5) over (partition by track, long) med from c),
e as (select track, count(*) n, any_value(u) u, avg((abs(ioi - k * u) <= 0.22::double * u)::int::double) on_grid, avg((k = 1)::int::double) base, least(avg(long::int::double), 1 - avg(long::int::double)) cl,
 sum(x) / nullif(count(*) - 1, 0)::double alt, avg(ioi) filter (where long) lm, avg(ioi) filter (where not long) sm, quantile_cont(abs(ioi - med), 0.5) filter (where long) / any_value(med) filter (where long) ld, quantile_cont(abs(ioi - med), 0.5) filter (where not long) / any_value(med) filter (where not long) sd from d group by 1),
f as (select *, coalesce(cl >= 0.35 and alt >= 0.75, false) paired, lm / sm ratio from e),
fl as (select *, case when on_grid >= 0.8 and base >= 0.5 and not coalesce(paired and ratio > 1.1, false) then {_nearest_sql("u / 3600", hints.STRAIGHT_UNITS)} end st, case when paired and ld <= 0.12 and sd <= 0.12 and ratio between 1.5 and 2.5 then {_nearest_sql("(lm + sm) / 3600", hints.SWUNG_PAIRS)} end sw from f)"""


@query("q53_feel_label", f"{FEEL} select track, n, case when n >= 16 then case when st is null then sw when sw is null then st end end feel, case when n >= 16 and (case when st is null then sw when sw is null then st end) is not null then '' when n < 16 then 'few' else 'unclear' end note from fl")
def q53(spark, sf):
    e = hints.feel_evidence(series.intervals(envelope(spark, sf).select("track", "t"), "t", ["track"]), ["track"])
    h = e.select("track", "n", hints.feel_hint(e, num(3600)).alias("h"))
    note = F.when(F.col("h.note").isNull(), "").when(F.col("h.note").contains("are needed"), "few").otherwise("unclear")
    return h.select("track", "n", F.col("h.value").alias("feel"), note.alias("note"))


@query("q54_hints", """with d as (select l_suppkey track, case when l_suppkey % 3 = 0 then null else 60 + avg(l_quantity) end refined, case when l_suppkey % 5 = 0 then null else 120::double end drums_bpm, 100::double mix_bpm, avg(l_quantity) / 6 od, avg(l_discount) * 10 kc from lineitem group by 1),
b as (select *, coalesce(refined, mix_bpm, drums_bpm) bpm from d)
select track, round_even(bpm, 6) + 0::double bpm, round_even(240 / bpm, 6) + 0::double cycle_seconds, case when od < 1 then 'sparse' when od < 5 then 'moderate' else 'busy' end drum_density, case when kc >= 0.5 and track % 4 <> 0 then 'a minor' end tonal_centre from b""")
def q54(spark, sf):
    d = series.averages(table(spark, sf, "lineitem").withColumn("track", F.col("l_suppkey")), ["track"], ["l_quantity", "l_discount"])
    d = d.select("track", (num(60) + F.col("l_quantity")).alias("_r"), (F.col("l_quantity") / num(6)).alias("onset_density"), (F.col("l_discount") * num(10)).alias("key_confidence"))
    d = d.select("track", F.when(F.col("track") % 3 != 0, F.col("_r")).alias("refined"), F.when(F.col("track") % 5 != 0, num(120)).alias("drums_bpm"), num(100).alias("mix_bpm"), "onset_density", F.lit("a").alias("key"), F.lit("minor").alias("scale"), "key_confidence", (F.col("track") % 4 == 0).alias("bass_silent"))
    return hints.build(d).select("track", r6(F.col("bpm")).alias("bpm"), r6(F.col("suggested_cycle_seconds")).alias("cycle_seconds"), "drum_density", "tonal_centre")


@query("q55_drum_sounds", """with h as (select l_suppkey track, ['kick', 'snare', 'hat', 'unclassified'][(l_linenumber % 4 + 1)::int] cls, l_discount * 3 body, l_quantity / 5 decay from lineitem),
m as (select track, cls, avg(body) body, quantile_cont(decay, 0.5) decay from h group by all)
select track, cls, case cls when 'kick' then 'bd' when 'snare' then 'sd' when 'hat' then case when decay >= 4 then 'hh' else 'oh' end end sound,
 case when cls = 'snare' and body < 0.15 then 'cp' when cls = 'unclassified' then 'ht,mt,lt,cr,rd,perc,sh,cb,tb' else '' end offers from m""")
def q55(spark, sf):
    cls = F.element_at(F.array(*[F.lit(x) for x in ("kick", "snare", "hat", "unclassified")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    h = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("track"), cls.alias("cls"), (F.col("l_discount") * num(3)).alias("body"), (F.col("l_quantity") / num(5)).alias("decay"), series.place().alias("place"))
    return vocab.drum_sound(h, ["track"]).select("track", "cls", "sound", F.array_join("offers", ",").alias("offers"))


@query("q56_bass_sound", "select p_partkey, case when p_partkey % 7 = 0 then null when p_size / 50::double >= 0.75 and p_retailprice / 200000 <= 0.005 and p_size * 5 <= 250 then 'sine' when p_size / 50::double <= 0.55 and p_retailprice / 5000 >= 0.12 and p_size * 20 >= 180 and not (p_size / 50::double >= 0.75) then 'sawtooth' end sound from part")
def q56(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size") / num(50)
    bright = F.when(size >= 0.75, F.col("p_retailprice") / num(200000)).otherwise(F.col("p_retailprice") / num(5000))
    centroid = F.when(size >= 0.75, F.col("p_size") * 5).otherwise(F.col("p_size") * 20)
    return p.select("p_partkey", vocab.bass_sound(size, bright, centroid, F.col("p_partkey") % 7 == 0).alias("sound"))


@query("q57_documents", "select c_custkey, '{\"id\":' || c_custkey || ',\"segment\":\"' || c_mktsegment || '\",\"size\":' || length(c_name) || '}' value from customer")
def q57(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.length("c_name").alias("size")).alias("d"))
    return c.select("c_custkey", F.to_json("d").alias("value"))


@query("q58_resume", "select distinct o_custkey c_custkey from orders where o_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def q58(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return audio.missing(o.select("c_custkey").distinct(), o.filter("o_orderpriority = '1-URGENT'"), ["c_custkey"])


@query("q60_bass_line", """with n as (select l_suppkey track, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) i, 28 + l_quantity::int % 20 m, l_linenumber::bigint step from lineitem),
s as (select track, step, count(*) k from n group by all), t as (select track, count(*) c, quantile_cont(m, 0.5) med from n group by 1),
q as (select track, string_agg(['c', 'c#', 'd', 'd#', 'e', 'f', 'f#', 'g', 'g#', 'a', 'a#', 'b'][m % 12 + 1] || (m // 12 - 1), ' ' order by i) filter (where i <= 32) seq from n group by 1),
p as (select track, string_agg(step || '=' || round_even(k / c::double, 4), ' ' order by step) shares from s join t using (track) group by 1)
select track, seq, case when c > 32 then c end::int truncated_from, med::double median_midi, shares from t join q using (track) join p using (track)""")
def q60(spark, sf):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    n = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("track"), F.lit("ok").alias("status"), F.row_number().over(order).alias("note"), (28 + F.col("l_quantity").cast("int") % 20).alias("midi"), F.col("l_linenumber").cast("long").alias("step"))
    h = hints.bass_line_hint(n, ["track"])
    share = F.zip_with("bass_line.steps", "bass_line.step_share", lambda s, x: F.concat_ws("=", s.cast("string"), x.cast("string")))
    return h.select("track", F.array_join("bass_line.note_sequence", " ").alias("seq"), F.col("bass_line.truncated_from").alias("truncated_from"), F.col("bass_line.median_midi_note").alias("median_midi"), F.array_join(share, " ").alias("shares"))


@query("q61_arrangement_lines", f"""{SECTIONS}, ln as (select track, start_bar, 'bar ' || start_bar || ' x' || length_bars || ' ' || label || ': ' || case when len(p) > 0 then array_to_string(p, ', ') else 'nothing playing' end line from lab),
c as (select track, list(line order by start_bar) l from ln group by 1), n as (select track, sum(length_bars)::bigint bars from lab group by 1), g as (select track, string_agg(distinct source, ', ' order by source) gone from ps where absent group by 1)
select track, bars, array_to_string(l[1:24], '; ') lines, case when len(l) > 24 then len(l)::int end truncated_from, coalesce(gone, '') gone from c join n using (track) left join g using (track)""")
def q61(spark, sf):
    h = hints.arrangement_hint(event_sections(spark, sf), ["track"], presence(spark, sf).filter("absent").select("track", "source"))
    a = F.col("arrangement")
    return h.select("track", a["bar_count"].alias("bars"), F.array_join(a["sections"], "; ").alias("lines"), a["truncated_from"].alias("truncated_from"), F.array_join(a["absent_tracks"], ", ").alias("gone"))


def summaries(spark, sf):
    """Per track a sum-up of its events as a tempo fit would have it."""
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("track")).agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    status = F.when(F.col("track") % 3 == 0, "refined").when(F.col("track") % 3 == 1, "coarse").otherwise("unavailable")
    return e.withColumn("status", status).withColumn("r", F.col("v") / num(200))


@query("q62_tempo_notes", """with e as (select user_id track, avg(value) / 200 r, case user_id % 3 when 0 then 'refined' when 1 then 'coarse' else 'unavailable' end status from events group by user_id),
l as (select *, case when r >= 0.5 then 'high' when r >= 0.25 then 'medium' else 'low' end label from e)
select track, label, case when status = 'refined' then label else status end trust, case when status = 'refined' and label <> 'low' then '' when status = 'unavailable' then 'as it came' when status = 'coarse' then 'not refined' else 'weak' end note,
 case when status = 'refined' or track % 2 = 0 then 0.5::double end period from l""")
def q62(spark, sf):
    s = summaries(spark, sf).withColumn("label", confidence_label(F.col("r")))
    note = hints.tempo_note(F.col("status"), F.col("label"), F.col("r"))
    short = F.when(note.isNull(), "").when(note.contains("as it came"), "as it came").when(note.contains("not refined"), "not refined").when(note.contains("weak"), "weak")
    return s.select("track", "label", tempo.grid_confidence(F.col("status"), F.col("label")).alias("trust"), short.alias("note"), tempo.bar_period(num(0.5), F.col("status"), F.col("track") % 2 == 0).alias("period"))


@query("q63_octave", """with f as (select user_id track, power(2::double, event_id % 3 - 1) ratio, 100 * power(2::double, event_id % 3 - 1) bpm, min(value) s, max(value) e, count(*) % 4 <> 0 grid from events group by all),
b as (select * from f where ratio = 1), w as (select f.track, f.ratio, f.bpm, f.s from f join b using (track) where f.ratio <> 1 and f.grid and (not b.grid or (f.s < b.s and f.e < b.e))),
x as (select track, arg_min(ratio, {'s': s, 'r': ratio}) ratio, arg_min(bpm, {'s': s, 'r': ratio}) bpm from w group by 1)
select b.track, coalesce(x.ratio, 1) ratio, coalesce(x.bpm, b.bpm) bpm, b.grid compared from b left join x using (track)""")
def q63(spark, sf):
    k = F.pow(num(2), (F.col("event_id") % 3 - 1).cast("double"))
    f = table(spark, sf, "events").groupBy(F.col("user_id").alias("track"), k.alias("ratio")).agg(F.min("value").alias("error_steps"), F.max("value").alias("error_seconds"), (F.count("*") % 4 != 0).alias("grid"))
    return tempo.arbitrate_octave(f.withColumn("bpm", num(100) * F.col("ratio")), ["track"]).select("track", "ratio", "bpm", "compared")


#: The bar's first beat of each type in SQL: a frame an hour, a beat six of them, four beats a bar.
DOWNBEAT = """with e as (select event_type source, floor(epoch_us(ts - timestamp '2024-01-01') / 3.6e9::double)::bigint h, sum(value) low, count(*)::double bright from events group by all),
f as (select source, h - min(h) over (partition by source) frame, low, bright from e), x as (select *, coalesce(greatest(ln(1 + low) - lag(ln(1 + low)) over (partition by source order by frame), 0), 0) flux from f),
n as (select source, max(frame) + 1 n, max(flux) peak, sum(low) tl, sum(bright) tb from x group by 1),
bo as (select source, frame % 6 o, avg(flux) s from x group by all), bb as (select source, arg_max(o, {'s': s, 'o': -o}) o, max(s) p, sum(s) a from bo group by 1), ph as (select source, o, greatest(0, 1 - a / 6 / p) contrast from bb),
fo as (select source, min(frame) * 3600 onset from x join n using (source) where flux >= 0.2::double * peak group by 1),
se as (select source, (frame - o) // 6 % 4 slot, quantile_cont(low, 0.5) low, quantile_cont(bright, 0.5) bright from x join ph using (source) join n using (source) where frame >= o and (frame - o) % 6 = 0 and (frame - o) // 6 < floor((n * 3600 - o * 3600) / 21600::double) group by all),
sl as (select source, slot, coalesce(low, 0) low, coalesce(bright, 0) bright from (select source, unnest(range(4)) slot from n) left join se using (source, slot)),
sc as (select source, slot, low / sum(low) over w - bright / sum(bright) over w score from sl window w as (partition by source)),
od as (select *, row_number() over (partition by source order by score desc, slot desc) k, max(score) over (partition by source) hi, max(score) over (partition by source) - min(score) over (partition by source) spread from sc),
tp as (select source, max(slot) filter (where k = 1) top, any_value(spread) spread, list(slot) filter (where k > 1 and (hi - score) / spread <= 0.25) tied, max((hi - score) / spread) filter (where k = 2) gap from od group by 1),
nr as (select source, o, contrast, case when onset <= 4 * 86400 then list_min(list_transform(range(4), lambda i: {'d': least(((onset - o * 3600 - i * 21600) % 86400 + 86400) % 86400, ((o * 3600 + i * 21600 - onset) % 86400 + 86400) % 86400), 'i': i})).i end near from ph join fo using (source)),
al as (select *, coalesce(len(tied), 0) > 0 tie, coalesce(list_contains(tied, near), false) by_onset, coalesce(len(tied), 0) = 0 and near is not null and near <> top against from tp join nr using (source) where spread > 0)
select source, o * 3600 + (case when by_onset then near else top end) * 21600 offset_seconds, (case when by_onset then near else top end)::int bar_phase, round_even(contrast, 6) + 0::double beat_confidence,
 round_even(case when against then least(least(1, gap / 0.25), 0.5) else least(1, gap / 0.25) end, 6) + 0::double phase_confidence, case when by_onset then 'onset' else 'spectral' end resolved_by,
 case when (case when against then least(least(1, gap / 0.25), 0.5) else least(1, gap / 0.25) end) >= 1 then 'ok' else 'ambiguous' end status from al"""


@query("q64_downbeat", DOWNBEAT)
def q64(spark, sf):
    """Bar phase of each event type from hourly sums (low: the sum, bright: the count); random data, so usually unsettled."""
    h = table(spark, sf, "events").groupBy(F.col("event_type").alias("source"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(F.sum("value").alias("low"), F.count("*").cast("double").alias("bright"))
    env = h.withColumn("frame", (F.unix_timestamp("h") / 3600).cast("long")).withColumn("frame", F.col("frame") - F.min("frame").over(Window.partitionBy("source")))
    meta = env.select("source").distinct().withColumn("period_seconds", num(6 * 3600))
    d = downbeat.find_downbeat(env.select("source", "frame", "low", "bright"), meta, ["source"], 3600.0)
    return d.select("source", F.col("offset_seconds").cast("long").alias("offset_seconds"), "bar_phase", r6(F.col("beat_confidence")).alias("beat_confidence"), r6(F.col("phase_confidence")).alias("phase_confidence"), "resolved_by", "status")


@query("q66_unavailable", """select p_partkey, array_to_string(list_sort(list_filter([case when p_size > 25 then 'rhythm.bpm' end, case when p_retailprice < 1000 then 'tonal.key' end, case when p_partkey % 4 = 0 then 'bass_line (status=unvoiced)' end], lambda x: x is not null)), ', ') missing from part""")
def q66(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") <= 25, 1).alias("bpm"), F.when(F.col("p_retailprice") >= 1000, 1).alias("key"))
    status = F.when(F.col("p_partkey") % 4 == 0, "unvoiced").otherwise("not_attempted")
    return p.select("p_partkey", F.array_join(analysis.unavailable({"rhythm": ["bpm"], "tonal": ["key"]}, {"bass_line": status}), ", ").alias("missing"))


@query("q67_bar_levels", """with f as (select user_id track, event_type source, row_number() over (partition by user_id, event_type order by event_id) - 1 frame, value from events), n as (select track, min(c) n from (select track, source, count(*) c from f group by all) group by 1),
g as (select track, n, floor((n - 1) / 5.2::double) + ((n - 1) - floor((n - 1) / 5.2::double) * 5.2::double >= 2.6::double)::int bars from n where n > 1),
b as (select f.*, bar from f join g using (track), unnest(range(g.bars::bigint)) t(bar) where frame < n and frame >= round_even(1 + bar * 5.2::double, 0) and frame < round_even(1 + (bar + 1) * 5.2::double, 0))
select track, source, bar, round_even(sqrt(avg(value * value)), 6) + 0::double lvl from b group by all""")
def q67(spark, sf):
    f = envelope(spark, sf).select("track", "source", "frame", F.col("value").alias("level"))
    meta = f.select("track").distinct().select("track", num(1.3).alias("beat_period_seconds"), num(1.0).alias("downbeat_seconds"))
    return arrangement.bar_levels(f, meta, ["track"], 1.0).select("track", "source", "bar", r6(F.col("level")).alias("lvl"))




@query("q68_sql_functions", """select p_partkey, round_even(69 + 12 * log2(p_retailprice / 440), 6) + 0::double midi, ['c', 'c#', 'd', 'd#', 'e', 'f', 'f#', 'g', 'g#', 'a', 'a#', 'b'][p_size % 12 + 1] || (p_size // 12 - 1) note, round_even(440 * power(2::double, (p_size - 69) / 12::double), 6) + 0::double hz,
 case when p_size / 10::double < 1 then 'sparse' when p_size / 10::double < 5 then 'moderate' else 'busy' end term, case when p_size >= 10 then least(1::double, (p_size - 10) / 20::double) end graded, ((round_even((p_size - 7) / 3::double, 0)::bigint % 16) + 16) % 16 step,
 trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') slug from part""")
def q68(spark, sf):
    sql.register(spark)
    table(spark, sf, "part").createOrReplaceTempView("_tessitura_part")
    return spark.sql("""select p_partkey, bround(midi_from_hz(p_retailprice), 6) + 0d midi, note_name(p_size) note, bround(hz_from_midi(p_size), 6) + 0d hz, density_term(p_size / 10d) term,
        ramp(p_size, 10, 30) graded, grid_step(p_size, 7, 3, 16) step, slugify(p_name) slug from _tessitura_part""")


@query("q69_table_function", """with s as (select event_type, ts::date d, list(value order by event_id) x from events group by all), f as (select event_type, d, unnest(range(greatest(0, 1 + (len(x) - 16) // 4))) frame, x from s where len(x) >= 16)
select event_type, d::varchar d, frame::int frame, round_even(sqrt(list_avg(list_transform(x[frame * 4 + 1:frame * 4 + 16], lambda v: v * v))), 6) + 0::double rms, list_max(list_transform(x[frame * 4 + 1:frame * 4 + 16], lambda v: abs(v))) peak from f""")
def q69(spark, sf):
    """Frames of 16 values, every 4, of a type's events of a day."""
    sql.register(spark)
    e = table(spark, sf, "events").groupBy("event_type", F.col("ts").cast("date").cast("string").alias("d")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("samples"))
    e.createOrReplaceTempView("_tessitura_series")
    return spark.sql("select event_type, d, frame, bround(rms, 6) + 0d rms, peak from _tessitura_series, lateral frames(samples, 16, 4)")


@query("q70_notes_on_grid", """with g as (select s_suppkey track, s_acctbal / 1000 anchor, case when s_nationkey % 2 = 0 then 0.125::double else case when s_nationkey % 3 <> 0 then 0.5::double * 4 / 16 end end step, case when s_nationkey % 2 = 0 and s_nationkey % 4 = 0 then null else 16 end n from supplier),
l as (select l_suppkey track, l_orderkey start, round_even((l_orderkey * 0.01::double - anchor) / step, 0)::bigint k, n from lineitem join g on l_suppkey = track)
select track, start, case when n is null then k else ((k % n) + n) % n end step, count(*) many from l group by all""")
def q70(spark, sf):
    """The grid of each track fanned out to its notes, given by its step or by its beat."""
    s = table(spark, sf, "supplier")
    even, by_step = F.col("s_nationkey") % 4 == 0, F.col("s_nationkey") % 2 == 0
    anchor = F.col("s_acctbal") / num(1000)
    g = s.select(F.col("s_suppkey").alias("track"), F.when(by_step, anchor).alias("anchor_seconds"), F.when(by_step, num(0.125)).alias("step_seconds"), F.when(by_step & ~even, 16).alias("steps_per_cycle"), F.when(F.col("s_nationkey") % 3 != 0, num(0.5)).alias("beat_period_seconds"), anchor.alias("downbeat_seconds"))
    n = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("track"), F.col("l_orderkey").alias("start_frame"))
    return notes.on_grid(n, g, ["track"], 0.01).groupBy("track", F.col("start_frame").alias("start"), "step").agg(F.count("*").alias("many"))


@query("q71_paths", """select c_custkey, '/out/' || trim(regexp_replace(lower(trim(c_name)), '[^a-z0-9]+', '-', 'g'), '-') || case when c_nationkey % 2 = 0 then '/track_summary.json' else '/analysis/' || lower(c_mktsegment) || '.json' end path from customer""")
def q71(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", sinks.document_path("/out/", F.col("c_name"), F.when(F.col("c_nationkey") % 2 != 0, F.lower("c_mktsegment"))).alias("path"))

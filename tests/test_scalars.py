import math

from pyspark.sql import functions as F

from tessitura.functions import scalars as S


def values(spark, column, data, kind="double"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], f"i int, x {kind}")
    return [r[0] for r in df.select(column(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def test_ramp_both_directions_and_edges(spark):
    data = [None, float("nan"), 1.9, 2.0, 3.0, 4.0, 9.0, float("inf")]
    assert values(spark, lambda x: S.ramp(x, 2.0, 4.0), data) == [None, None, None, 0.0, 0.5, 1.0, 1.0, None]
    assert values(spark, lambda x: S.ramp(x, 4.0, 2.0), data) == [None, None, 1.0, 1.0, 0.5, 0.0, None, None]


def test_every_and_between(spark):
    assert values(spark, lambda x: S.every(x, F.lit(0.5)), [None, 0.2, 0.9]) == [None, 0.2, 0.5]
    assert values(spark, lambda x: S.between(x, 1, 5, 1), [0.5, 1.0, 1.5, 3.0, 5.0, 5.5]) == [None, 0.0, 0.5, 1.0, 0.0, None]


def test_chroma_entropy(spark):
    flat, one = [1.0] * 12, [1.0] + [0.0] * 11
    got = values(spark, S.chroma_entropy, [flat, one, [0.0] * 12, [1.0] * 11, [-1.0] + [1.0] * 11, None], "array<double>")
    assert abs(got[0] - 1) < 1e-12 and got[1] == 0 and got[2] is None and got[3] is None and abs(got[4] - math.log(11) / math.log(12)) < 1e-12 and got[5] is None


def test_pitch_names_and_slugs(spark):
    assert values(spark, lambda x: S.note_name(S.midi_from_hz(x)), [440.0, 261.6256, 32.7032, 0.0]) == ["a4", "c4", "c1", None]
    assert values(spark, S.slugify, ["  Hello, World! ", "---", "Ab9", None], "string") == ["hello-world", "track", "ab9", "track"]


def test_half_even_and_never_negative(spark):
    assert values(spark, lambda x: S.grid_step(x, S.num(0), S.num(1), 16), [0.5, 1.5, 2.5, -1.0, 17.2]) == [0, 2, 2, 15, 1]
    assert values(spark, lambda x: S.fractional_steps(x, S.num(16), S.num(0), 16), [1.25, 1.75]) == [0.25, -0.25]
    assert values(spark, S.seconds_to_frames, [0.0, 0.035, 0.5]) == [1, 3, 43]


def test_terms_and_guards(spark):
    assert values(spark, S.classify_density, [0.0, 1.0, 4.9, 5.0, -1.0, float("nan"), None]) == ["sparse", "moderate", "moderate", "busy", None, None, None]
    assert values(spark, S.suggest_cycle_seconds, [120.0, 0.0, None]) == [2.0, None, None]
    assert values(spark, lambda x: S.match_grid(x, {"a": 0.5, "b": 0.25}), [0.5, 0.26, 0.38, None]) == ["a", "b", None, None]
    assert values(spark, S.is_silent, [None, 1e-4, 1e-3]) == [False, True, False]
    assert values(spark, lambda x: S.within_bpm_tolerance(x, S.num(100)), [103.0, 103.1, None]) == [True, False, False]

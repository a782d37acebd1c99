"""The scalar operators as functions of SQL text, and frames of samples as a table function.

Scalars are SQL expressions, which the optimizer inlines; only ``frames`` runs in Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tessitura.functions.scalars import HOP, N_FFT, NOTE_NAMES

_NAMES = ", ".join(f"'{n}'" for n in NOTE_NAMES)
FUNCTIONS = {
    "positive_or_null(x double) returns double": "case when x > 0 and not isnan(x) and x < double('infinity') then x end",
    "ramp(x double, threshold double, saturation double) returns double": "case when (x - threshold) / (saturation - threshold) >= 0 then least(1d, (x - threshold) / (saturation - threshold)) end",
    "midi_from_hz(hz double) returns double": "case when hz > 0 then 69 + 12 * log2(hz / 440) end",
    "hz_from_midi(midi double) returns double": "440 * power(2, (midi - 69) / 12)",
    "note_name(midi double) returns string": f"element_at(array({_NAMES}), cast(pmod(rint(midi), 12) as int) + 1) || cast(floor(rint(midi) / 12) - 1 as int)",
    "fractional_steps(t double, cycle double, anchor double, steps double) returns double": "(t - anchor) / cycle * steps - rint((t - anchor) / cycle * steps)",
    "grid_step(t double, anchor double, step double, n bigint) returns bigint": "pmod(cast(rint((t - anchor) / step) as bigint), n)",
    "density_term(per_second double) returns string": "case when per_second < 0 then null when per_second < 1 then 'sparse' when per_second < 5 then 'moderate' when per_second >= 5 then 'busy' end",
    "slugify(x string) returns string": "coalesce(nullif(trim(both '-' from regexp_replace(lower(trim(x)), '[^a-z0-9]+', '-')), ''), 'track')",
}


@udtf(returnType="frame int, rms double, peak double")
class Frames:
    """Level of each window (2048 samples, every 512, unless said) of one array."""

    def eval(self, samples: list, window: int = N_FFT, hop: int = HOP):
        import numpy as np

        x = np.asarray(samples, float)
        for i in range(max(0, 1 + (len(x) - window) // hop)):
            w = x[i * hop : i * hop + window]
            yield i, float(np.sqrt((w * w).mean())), float(np.abs(w).max())


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    spark.udtf.register("frames", Frames)
    return [h.split("(")[0] for h in FUNCTIONS] + ["frames"]

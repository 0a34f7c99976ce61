"""Display arithmetic: colours, ticks and ranges as column expressions (§2.13 math / colour)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import js_round

#: The ends of the conservation ramp and the colour of noise.
RAMP_LOW = (241, 229, 191)
RAMP_HIGH = (47, 125, 90)
NOISE = "#8a847a"


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def mix(start, end, share: Column) -> Column:
    """``rgb(r, g, b)`` between two triples of numbers or columns."""
    at = [js_round(F.lit(a) + (F.lit(b) - F.lit(a)) * clamp(share)) if not isinstance(a, Column) else js_round(a + (b - a) * clamp(share)) for a, b in zip(start, end)]
    return F.format_string("rgb(%d, %d, %d)", *at)


def conservation(score: Column) -> Column:
    """Ramp colour of a score of 0 to 100; null counts as 0."""
    return mix(RAMP_LOW, RAMP_HIGH, clamp(F.coalesce(score, F.lit(0)), 0, 100) / 100)


def rgb_of_hsl(hue: Column, saturation: Column, lightness: Column) -> Column:
    """Array of three channels 0 to 255; hue in degrees. Channel n follows the distance from its own hue."""
    h, s, lum = F.pmod(hue, F.lit(360)) / 30, clamp(saturation), clamp(lightness)
    a = s * F.least(lum, 1 - lum)

    def channel(n: int) -> Column:
        k = F.pmod(h + n, F.lit(12.0))
        return js_round((lum - a * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))) * 255)

    return F.array(channel(0), channel(8), channel(4))


def palette(label: Column, colours: list[str]) -> Column:
    """The colour of a label in turn; labels below zero are noise."""
    return F.when(label < 0, NOISE).otherwise(F.element_at(F.array(*map(F.lit, colours)), (label % len(colours) + 1).cast("int")))


def hex_channels(colour: Column) -> Column:
    """``#rrggbb`` as an array of three numbers; null for anything else."""
    low = F.lower(F.trim(colour))
    part = lambda k: F.conv(F.substring(low, k, 2), 16, 10).cast("int")
    return F.when(low.rlike("^#[0-9a-f]{6}$"), F.array(part(2), part(4), part(6)))


def tick_step(span: Column, ticks: int = 8) -> Column:
    """The smallest of 1, 2, 5 or 10 times a power of ten that needs no more than ``ticks`` steps; at least 1."""
    rough = F.greatest(F.lit(1.0), span / max(1, ticks))
    power = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    step = F.when(power >= rough, power).when(power * 2 >= rough, power * 2).when(power * 5 >= rough, power * 5).otherwise(power * 10)
    return F.greatest(F.lit(1).cast("long"), js_round(step))


def bar_strength(share: Column) -> Column:
    """Square-root ramp of a share."""
    return F.sqrt(clamp(F.coalesce(share, F.lit(0.0))))


def wrapped_angle(angle: Column) -> Column:
    """An angle in [0, 2 pi)."""
    return F.pmod(angle, F.lit(2) * F.pi())

"""Colours as column expressions: CIE Lab of sRGB bytes, and the CIEDE2000 distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# sRGB to XYZ for D65, and its white.
_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
_WHITE = (0.95047, 1.0, 1.08883)


def lab(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """L, a and b of a colour given in bytes."""

    def linear(byte: Column) -> Column:
        v = byte / 255.0
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    bands = [linear(c) for c in (red, green, blue)]
    f = []
    for row, white in zip(_XYZ, _WHITE, strict=True):
        t = sum((bands[k] * row[k] for k in (1, 2)), bands[0] * row[0]) / white
        f.append(F.when(t > 216 / 24389, F.cbrt(t)).otherwise((t * (24389 / 27) + 16) / 116))
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def ciede2000(one: tuple[Column, Column, Column], other: tuple[Column, Column, Column]) -> Column:
    """The CIEDE2000 distance of two Lab colours, all weights 1."""
    (l1, a1, b1), (l2, a2, b2) = one, other
    root = lambda x: F.sqrt(x / (x + 25.0**7))
    chroma = (F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2
    g = 0.5 * (1 - root(F.pow(chroma, F.lit(7.0))))
    p1, p2 = a1 * (1 + g), a2 * (1 + g)
    c1, c2 = F.sqrt(p1 * p1 + b1 * b1), F.sqrt(p2 * p2 + b2 * b2)
    hue = lambda a, b: F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)) + 360, F.lit(360.0)))
    h1, h2 = hue(p1, b1), hue(p2, b2)
    grey, turn = c1 * c2 == 0, h2 - h1
    step = F.when(grey, 0.0).when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn)
    dl, dc, dh = l2 - l1, c2 - c1, 2 * F.sqrt(c1 * c2) * F.sin(F.radians(step / 2))
    light, mean = (l1 + l2) / 2, (c1 + c2) / 2
    whole = h1 + h2
    h = F.when(grey, whole).when(F.abs(turn) <= 180, whole / 2).when(whole < 360, (whole + 360) / 2).otherwise((whole - 360) / 2)
    cos = lambda k, off: F.cos(F.radians(k * h + off))
    t = 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.20 * cos(4, -63)
    sl = 1 + 0.015 * (light - 50) * (light - 50) / F.sqrt(20 + (light - 50) * (light - 50))
    sc, sh = 1 + 0.045 * mean, 1 + 0.015 * mean * t
    near = (h - 275) / 25
    rt = -F.sin(F.radians(60 * F.exp(-near * near))) * 2 * root(F.pow(mean, F.lit(7.0)))
    return F.sqrt((dl / sl) * (dl / sl) + (dc / sc) * (dc / sc) + (dh / sh) * (dh / sh) + rt * (dc / sc) * (dh / sh))


def with_ciede2000(frame: DataFrame, one: tuple[Column, Column, Column], other: tuple[Column, Column, Column], name: str) -> DataFrame:
    """The frame with ``name``, the ``ciede2000`` distance of two Lab colours.

    Each part that is used again is a column of its own for a while, so that it is computed once for a row; as one expression
    the distance has tens of thousands of terms.
    """
    c = lambda n: F.col(f"__{n}")
    root = lambda x: F.sqrt(x / (x + 25.0**7))
    hue = lambda a, b: F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)) + 360, F.lit(360.0)))
    cos = lambda k, off: F.cos(F.radians(k * c("h") + off))
    rows = frame.withColumns({f"__{n}{k}": x for k, colour in ((1, one), (2, other)) for n, x in zip(("l", "a", "b"), colour, strict=True)})
    chroma = (F.sqrt(c("a1") * c("a1") + c("b1") * c("b1")) + F.sqrt(c("a2") * c("a2") + c("b2") * c("b2"))) / 2
    steps = [
        {"x": F.pow(chroma, F.lit(7.0))},
        {"g": 0.5 * (1 - root(c("x")))},
        {"p1": c("a1") * (1 + c("g")), "p2": c("a2") * (1 + c("g"))},
        {"c1": F.sqrt(c("p1") * c("p1") + c("b1") * c("b1")), "c2": F.sqrt(c("p2") * c("p2") + c("b2") * c("b2")), "h1": hue(c("p1"), c("b1")), "h2": hue(c("p2"), c("b2"))},
        {"grey": c("c1") * c("c2") == 0, "turn": c("h2") - c("h1"), "whole": c("h1") + c("h2"), "mean": (c("c1") + c("c2")) / 2, "light": (c("l1") + c("l2")) / 2},
        {
            "step": F.when(c("grey"), 0.0).when(c("turn") > 180, c("turn") - 360).when(c("turn") < -180, c("turn") + 360).otherwise(c("turn")), "m7": F.pow(c("mean"), F.lit(7.0)),
            "h": F.when(c("grey"), c("whole")).when(F.abs(c("turn")) <= 180, c("whole") / 2).when(c("whole") < 360, (c("whole") + 360) / 2).otherwise((c("whole") - 360) / 2),
        },
        {"t": 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.20 * cos(4, -63), "near": (c("h") - 275) / 25},
        {
            "dl": (c("l2") - c("l1")) / (1 + 0.015 * (c("light") - 50) * (c("light") - 50) / F.sqrt(20 + (c("light") - 50) * (c("light") - 50))), "dc": (c("c2") - c("c1")) / (1 + 0.045 * c("mean")),
            "dh": (2 * F.sqrt(c("c1") * c("c2")) * F.sin(F.radians(c("step") / 2))) / (1 + 0.015 * c("mean") * c("t")), "rt": -F.sin(F.radians(60 * F.exp(-c("near") * c("near")))) * 2 * root(c("m7")),
        },
    ]
    for step in steps:
        rows = rows.withColumns({f"__{n}": x for n, x in step.items()})
    distance = F.sqrt(c("dl") * c("dl") + c("dc") * c("dc") + c("dh") * c("dh") + c("rt") * c("dc") * c("dh"))
    return rows.select(*[F.col(f"`{n}`") for n in frame.columns], distance.alias(name))

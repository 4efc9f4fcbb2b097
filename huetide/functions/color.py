"""Colour arithmetic as column expressions: everything stays in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published OKLab matrices.
TO_CONE = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
FROM_LAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
FROM_CONE = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
# Achromatic families by upper lightness; chromatic ones by upper hue.
GREYS = (("Black", 0.20), ("Charcoal", 0.38), ("Gray", 0.72), ("Light Gray", 0.90), ("White", None))
HUES = (("Rose", 15), ("Red", 36), ("Red-Orange", 47), ("Orange", 70), ("Amber", 98), ("Yellow", 118), ("Yellow-Green", 131), ("Chartreuse", 141.5),
        ("Green", 162), ("Green-Teal", 184), ("Teal", 205), ("Blue-Teal", 232), ("Blue", 272), ("Indigo", 291), ("Violet", 315), ("Magenta", 346))
NEUTRAL, MUTED, GREY = 0.035, 0.075, 0.028
NEUTRAL_FAMILIES = ("Black", "Charcoal", "Gray", "Light Gray", "White")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _row(weights, values) -> Column:
    return reduce(lambda a, b: a + b, (F.lit(w) * v for w, v in zip(weights, values, strict=True)))


def linear(channel) -> Column:
    """A channel of 0 to 255 as linear light."""
    c = _c(channel).cast("double") / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def hex_of(r, g, b) -> Column:
    return F.format_string("#%02X%02X%02X", _c(r).cast("long"), _c(g).cast("long"), _c(b).cast("long"))


def normalize_hex(text) -> Column:
    """#RRGGBB in capitals from 3 or 6 digits with or without #; null if it isn't a colour."""
    digits = F.upper(F.regexp_replace(F.trim(_c(text)), "^#+", ""))
    six = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    return F.when(six.rlike("^[0-9A-F]{6}$"), F.concat(F.lit("#"), six))


def rgb_of(hex_) -> tuple[Column, Column, Column]:
    return tuple(F.conv(F.substring(_c(hex_), k, 2), 16, 10).cast("long") for k in (2, 4, 6))


def oklab(r, g, b) -> tuple[Column, Column, Column]:
    light = [linear(x) for x in (r, g, b)]
    cone = [F.cbrt(_row(w, light)) for w in TO_CONE]
    return tuple(_row(w, cone) for w in TO_LAB)


def rgb_from_oklab(l, a, b) -> tuple[Column, Column, Column]:  # noqa: E741
    """The nearest sRGB channels, 0 to 255."""
    cone = [F.pow(_row(w, (_c(l), _c(a), _c(b))), F.lit(3.0)) for w in FROM_LAB]

    def channel(w) -> Column:
        x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _row(w, cone)))
        return F.round(255 * F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)).cast("long")

    return tuple(channel(w) for w in FROM_CONE)


def chroma(a, b) -> Column:
    return F.sqrt(_c(a) * _c(a) + _c(b) * _c(b))


def hue(a, b) -> Column:
    """Degrees in [0, 360); 0 for a colour without chroma."""
    turned = F.degrees(F.atan2(_c(b), _c(a)))
    return F.when(chroma(a, b) <= 1e-9, 0.0).when(turned < 0, turned + 360).otherwise(turned)


def distance(p, q) -> Column:
    """Euclidean OKLab distance of two triples of columns."""
    return F.sqrt(reduce(lambda a, b: a + b, ((_c(x) - _c(y)) * (_c(x) - _c(y)) for x, y in zip(p, q, strict=True))))


def family(l, c, h) -> Column:  # noqa: E741
    """The everyday name of an OKLCH colour."""
    l, c, h = _c(l), _c(c), _c(h)  # noqa: E741
    out = None
    for name, top in GREYS:
        test = (c < GREY) & (l < top) if top is not None else c < GREY
        out = F.when(test, name) if out is None else out.when(test, name)
    out = out.when((h >= 35) & (h < 95) & (l < 0.62) & (c < 0.17), "Brown")
    out = out.when((h >= 92) & (h < 136) & (l < 0.72) & (c < 0.15), "Olive")
    out = out.when((h >= 45) & (h < 115) & (l >= 0.74) & (c < 0.075), "Beige")
    for name, top in HUES:
        if name == "Teal":
            out = out.when((h < top) & (l >= 0.80) & (c >= 0.12), "Cyan")
        out = out.when(h < top, name)
    return out.otherwise("Rose")


def is_warm(h) -> Column:
    return (_c(h) < 135) | (_c(h) >= 315)


def luminance(r, g, b) -> Column:
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast(x: Column, y: Column) -> Column:
    """Contrast ratio of two luminances."""
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def readable_text(lum: Column) -> Column:
    """Dark or white text for a background of this luminance."""
    dark = 0.0056054  # luminance of #111111
    return F.when(contrast(lum, F.lit(dark)) >= contrast(lum, F.lit(1.0)), "#111111").otherwise("#FFFFFF")


def dimension(rows: DataFrame) -> DataFrame:
    """Each distinct colour (r, g, b) once, with hex, ll, la, lb, chroma, hue, family and neutral."""
    ll, la, lb = oklab("r", "g", "b")
    out = rows.select("r", "g", "b").distinct().withColumns({"hex": hex_of("r", "g", "b"), "ll": ll, "la": la, "lb": lb})
    out = out.withColumns({"chroma": chroma("la", "lb"), "hue": hue("la", "lb")})
    return out.withColumns({"family": family("ll", "chroma", "hue"), "neutral": F.col("chroma") < NEUTRAL})


#: Colours up to which their dimension is broadcast: some 100 MB.
BROADCAST_COLOURS = 500_000


def small(colors: DataFrame) -> DataFrame:
    """A dimension, to be broadcast if it has no more than BROADCAST_COLOURS rows."""
    return F.broadcast(colors) if colors.limit(BROADCAST_COLOURS + 1).count() <= BROADCAST_COLOURS else colors


def with_color(swatches: DataFrame, colors: DataFrame | None = None) -> DataFrame:
    """Adds the columns of ``colors``, a dimension that holds all of them, to rows with r, g, b, and structural where they are swatches."""
    out = swatches.join(dimension(swatches) if colors is None else colors, ["r", "g", "b"])
    return out.withColumn("structural", structural()) if "border_share" in out.columns else out


def structural() -> Column:
    """A neutral background: much of the image and much of its border."""
    loose = (F.col("share") >= 0.18) & (F.col("border_share") >= 0.42) & (F.col("coverage") <= F.greatest(F.lit(0.08), 0.72 * F.col("share")))
    return F.col("neutral") & (((F.col("share") >= 0.30) & (F.col("border_share") >= 0.70)) | loose)


#: The same columns for the checking SQL, over a relation called swatches.
def sql_colors(source: str = "swatches") -> tuple[tuple[str, str], ...]:
    lin = lambda c: f"CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE power(({c} / 255.0 + 0.055) / 1.055, 2.4) END"
    cone = ", ".join(f"cbrt({x} * lr + {y} * lg + {z} * lbl) AS c{k}" for k, (x, y, z) in enumerate(TO_CONE))
    lab = ", ".join(f"{x} * c0 + ({y}) * c1 + ({z}) * c2 AS {n}" for n, (x, y, z) in zip(("ll", "la", "lb"), TO_LAB, strict=True))
    greys = " ".join(f"WHEN chroma < {GREY}" + (f" AND ll < {t}" if t else "") + f" THEN '{n}'" for n, t in GREYS)
    hues = " ".join(("WHEN hue < 205 AND ll >= 0.80 AND chroma >= 0.12 THEN 'Cyan' " if n == "Teal" else "") + f"WHEN hue < {t} THEN '{n}'" for n, t in HUES)
    return (
        ("linear_", f"SELECT *, {lin('CAST(r AS DOUBLE)')} AS lr, {lin('CAST(g AS DOUBLE)')} AS lg, {lin('CAST(b AS DOUBLE)')} AS lbl FROM {source}"),
        ("cone_", f"SELECT *, {cone} FROM linear_"),
        ("lab_", f"SELECT * EXCLUDE (c0, c1, c2), printf('#%02X%02X%02X', r, g, b) AS hex, {lab} FROM cone_"),
        ("lch_", "SELECT *, sqrt(la * la + lb * lb) AS chroma, CASE WHEN sqrt(la * la + lb * lb) <= 1e-9 THEN 0.0 WHEN degrees(atan2(lb, la)) < 0 THEN degrees(atan2(lb, la)) + 360 ELSE degrees(atan2(lb, la)) END AS hue FROM lab_"),
        (
            "named_",
            f"SELECT *, chroma < {NEUTRAL} AS neutral, CASE {greys} WHEN hue >= 35 AND hue < 95 AND ll < 0.62 AND chroma < 0.17 THEN 'Brown' "
            f"WHEN hue >= 92 AND hue < 136 AND ll < 0.72 AND chroma < 0.15 THEN 'Olive' WHEN hue >= 45 AND hue < 115 AND ll >= 0.74 AND chroma < 0.075 THEN 'Beige' {hues} ELSE 'Rose' END AS family FROM lch_",
        ),
        (
            "colors",
            "SELECT *, neutral AND ((share >= 0.30 AND border_share >= 0.70) OR (share >= 0.18 AND border_share >= 0.42 AND coverage <= greatest(0.08, 0.72 * share))) AS structural FROM named_",
        ),
    )

"""Small predicates and values: machine names, attributes, placements, buckets, percent geometry, draft ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Brand tokens, form factors by token, captive screws, motion thresholds in pixels.
BRANDS = {
    "hp": "HP", "hewlett-packard": "HP", "compaq": "HP", "compoq": "HP", "compac": "HP",
    "dell": "Dell", "delle": "Dell", "lenovo": "Lenovo", "apple": "Apple",
    "acer": "Acer", "asus": "ASUS", "ibm": "IBM", "gateway": "Gateway",
}
SERIES = {
    "optiplex": "Dell", "precision": "Dell", "inspiron": "Dell", "vostro": "Dell", "dimension": "Dell",
    "elitedesk": "HP", "prodesk": "HP", "pavilion": "HP", "thinkcentre": "Lenovo",
}
FORM_FACTORS = [
    ("small form", "sff"), ("sff", "sff"), ("ssf", "sff"), ("sf", "sff"),
    ("cmt", "cmt"), ("twr", "twr"), ("tower", "twr"), ("mt", "mt"), ("dt", "dt"),
]
CAPTIVE_BRANDS, CAPTIVE_ROLE = ["dell", "optiplex"], "cpu_cooler"
MOVE_PX, CHASSIS_PX = 2.0, 12.0


def _word(table: dict[str, str], word: Column) -> Column:
    return F.coalesce(*[F.when(word == k, F.lit(v)) for k, v in table.items()])


def brand_model(raw: Column, brands: dict[str, str] = BRANDS, series: dict[str, str] = SERIES) -> Column:
    """(brand, model): a leading brand is cut off, a leading series names its brand and stays; else all is the model."""
    text = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "))
    head = F.lower(F.split(text, " ")[0])
    rest = F.nullif(F.regexp_replace(text, r"^\S+\s*", ""), F.lit(""))
    own = _word(brands, head)
    return F.struct(F.coalesce(own, _word(series, head)).alias("brand"), F.when(own.isNotNull(), rest).otherwise(F.nullif(text, F.lit(""))).alias("model"))


def form_factor(raw: Column, tokens: list[tuple[str, str]] = FORM_FACTORS) -> Column:
    """The value of the first token that the name has as a word; a token of several words may stand anywhere."""
    text = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(raw, F.lit("")), "-", " ")), r"\s+", " "), F.lit(" "))
    has = lambda t: text.contains(t) if " " in t else text.contains(f" {t} ")
    return F.coalesce(*[F.when(has(t), F.lit(v)) for t, v in tokens])


def is_captive(cls: Column, role: Column, brand: Column) -> Column:
    """Whether a screw stays in its part; null for anything that is no screw."""
    known = F.lower(F.coalesce(brand, F.lit("")))
    dell = known.contains(CAPTIVE_BRANDS[0]) | known.contains(CAPTIVE_BRANDS[1])
    return F.when(cls == "screw", dell & F.coalesce(role == CAPTIVE_ROLE, F.lit(False)))


def has_attr(attrs: Column, name: str) -> Column:
    """Whether an attribute is there and not null: `added_by` marks extra instances, `implied` implied ones."""
    return F.coalesce(F.try_element_at(attrs, F.lit(name)).isNotNull(), F.lit(False))


def draft_id(result_id: Column) -> Column:
    """A stable number below 2**31 for a text id; null for none."""
    return F.when(result_id != "", F.crc32(result_id.cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)))


def rounded(value: Column, digits: int = 4) -> Column:
    """Rounded to some digits, without a negative zero."""
    out = F.round(value, digits)
    return F.when(out == 0, F.lit(0.0)).otherwise(out)


def number_text(value: Column) -> Column:
    """Whole numbers without a fraction, others as they are."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def is_identity(scale: Column, theta: Column, tx: Column, ty: Column, eps: float = 1e-9) -> Column:
    return (F.abs(scale - 1) < eps) & (F.abs(theta) < eps) & (F.abs(tx) < eps) & (F.abs(ty) < eps)


def identity(disc: Column, number: Column) -> Column:
    """What two rows must share to be one part; a missing number is a value like any other (compare with eqNullSafe)."""
    return F.struct(F.coalesce(disc, F.lit("")).alias("disc"), number.alias("number"))


def bucket(width: Column, edges: list[tuple[str, float, float]]) -> Column:
    """The name of the range [low, high) that has the width, else the last name."""
    return F.coalesce(*[F.when((width >= lo) & (width < hi), F.lit(name)) for name, lo, hi in edges], F.lit(edges[-1][0]))


def motion(table_px: Column, table_ok: Column, chassis_px: Column, area_ratio: Column, least: tuple[float, float] = (MOVE_PX, CHASSIS_PX), steady: tuple[float, float] = (0.8, 1.25)) -> Column:
    """What moved between two steps, by two tests: the table shifted by `least[0]` pixels, and a blob whose area kept
    within `steady` shifted by `least[1]`. Without a table to measure by it is undetermined; missing numbers fail a test."""
    passed = lambda test: F.coalesce(test, F.lit(False)).cast("int")
    tests = passed(table_px >= least[0]) + 2 * passed((chassis_px >= least[1]) & area_ratio.between(*steady))
    names = F.array(*[F.lit(n) for n in ("none", "camera", "chassis", "both")])
    return F.when(table_ok.eqNullSafe(F.lit(False)), "undetermined").otherwise(F.get(names, tests))


def view_tier(view: Column, tiers: dict[str, str]) -> Column:
    """The tier of a view; an unknown view fails the query."""
    known = _word(tiers, view)
    return F.when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("no tier for view "), view)))


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    """Whether a problem line begins with one of the codes that block a confirmation."""
    return F.coalesce(F.greatest(*[text.startswith(p) for p in prefixes]) if len(prefixes) > 1 else text.startswith(prefixes[0]), F.lit(False))


def percent_box(points: Column, width: Column, height: Column) -> Column:
    """(x0, y0, x1, y1) in pixels, ends exclusive, of a polygon in percent, cut to the frame; null under three points or outside."""
    xs = F.transform(points, lambda p: F.round(p[0] / 100 * width).cast("long"))
    ys = F.transform(points, lambda p: F.round(p[1] / 100 * height).cast("long"))
    x0, x1 = F.greatest(F.array_min(xs), F.lit(0)), F.least(F.array_max(xs) + 1, width)
    y0, y1 = F.greatest(F.array_min(ys), F.lit(0)), F.least(F.array_max(ys) + 1, height)
    return F.when((F.size(points) >= 3) & (x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def is_native(width: Column, height: Column, ratio: Column, tolerance: float = 0.01) -> Column:
    """Whether an upload has its view's own aspect ratio; nothing measured counts as native."""
    return F.coalesce(F.abs(width / height - ratio) <= tolerance * ratio, F.lit(True))

"""Codes and encodings of the land chronology and of the stability markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: states' characters in the yearly chronology.
STATE_CODES = {"A": "0", "NA": "1", "SLD": "2", "SRC": "3", "PA": "4", "None": "9"}
OTHER_STATE = "5"
#: Land uses that are on offer.
USES = ("AG", "CA", "CI", "CO", "ED", "FO", "FY", "IM", "IV", "OF", "OV", "PA", "PR", "PS", "TA", "TH", "VF", "VI", "VO", "ZC", "ZU", "ZV", "FS", "FL", "FV", "IS", "OC", "CV", "CF", "CS", "FF", "EP", "MT", "OP")
DEFAULT_USES = ("PS", "PA", "PR", "FY", "OV", "VI")
PASTURE = ("PR", "PS", "PA")
ORCHARD_RANGES = ((104, 113), (200, 218), (300, 349))


def compound_id(*parts: Column) -> Column:
    """Parts joined by hyphens; a missing part is empty but keeps its hyphen."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(*[x for t in texts for x in (F.lit("-"), t)][1:])


def state(use: Column, product: Column, incidence: Column, *, mode: str = "frame") -> Column:
    """Abandonment state. The first rule that holds wins. In 'frame' mode any use with a product over 65 counts as in production; in 'sql' mode only pasture does."""
    inc = F.coalesce(incidence, F.lit("None" if mode == "frame" else ""))
    orchard = F.lit(False)
    for lo, hi in ORCHARD_RANGES:
        orchard = orchard | product.between(lo, hi)
    pasture = use.isin(*PASTURE)
    producing = (pasture & (product < 61)) | (product > 65) if mode == "frame" else pasture & ((product < 61) | (product > 65))
    return (
        F.when(product.isNull() | (product == 0), "SLD")
        .when(inc.contains("117") | inc.contains("199"), "A")
        .when(inc.contains("177") | inc.contains("186"), "M5")
        .when((use == "OV") & (product == 101), "NA")
        .when(use == "OV", "PA")
        .when(use.isNull(), "SRC")
        .when((use == "FY") & orchard, "NA")
        .when((use == "FY") & (product == 150), "NA_150")
        .when(pasture & product.between(61, 65), "NA")
        .when(producing, "PA")
        .otherwise("Uso_alt")
    )


def state_code(code: Column) -> Column:
    out = F.lit(OTHER_STATE)
    for name, c in STATE_CODES.items():
        out = F.when(code == name, c).otherwise(out)
    return out


def state_chronology(states: Column) -> Column:
    """One character a year; a missing state is 5."""
    return F.array_join(F.transform(states, state_code), "")


def product_chronology(products: Column) -> Column:
    return F.array_join(F.transform(products, lambda p: F.coalesce(p.cast("long"), F.lit(0)).cast("string")), "_")


def use_chronology(uses: Column) -> Column:
    return F.array_join(uses, "_", "NU")


def incidence_chronology(incidences: Column, present: Column | None = None) -> Column:
    """Incidences of the years; 0 where a year has no declaration. `present` tells, year by year, which have one: those without an incidence are None."""
    if present is not None:
        incidences = F.zip_with(incidences, present, lambda i, p: F.when(p, F.coalesce(i, F.lit("None"))))
    return F.array_join(incidences, "_", "0")


def chosen_uses(uses: tuple[str, ...]) -> tuple[str, ...]:
    """TODOS stands for all land uses."""
    return USES if "TODOS" in uses else uses


def matches_use(chronology: Column, uses: tuple[str, ...]) -> Column:
    """Whether a use chronology holds one of the uses; none given: all do."""
    return chronology.rlike("|".join(chosen_uses(uses))) if uses else F.lit(True)


def angle_flag(angles: Column, threshold: float = 0.4) -> Column:
    """-1 without a pair of years, 1 if an angle is over the threshold (NaN isn't), else 0."""
    return F.when(F.size(angles) == 0, -1).when(F.exists(angles, lambda a: ~F.isnan(a) & (a > threshold)), 1).otherwise(0)


def stability_class(cycle: Column, flag: Column) -> Column:
    """ROJO, NARANJA or VERDE from the annual cycle ('c' and a digit a year) and the angle flag."""
    zeros = F.length(F.regexp_replace(cycle, "[^0]", ""))
    years = F.length(cycle) - 1
    bad = (flag == -1) | (zeros == years) | ((zeros >= F.floor(years / 2)) & (flag == 1))
    return F.when(bad, "ROJO").when(zeros > 0, "NARANJA").otherwise("VERDE")

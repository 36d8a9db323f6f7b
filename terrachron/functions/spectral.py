"""Per-pixel indices, masks and casts as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scene classes that are no clear ground.
CLOUD_CLASSES = (0, 1, 2, 3, 8, 9, 10, 11)
#: Fixed value: first day with the radiometric offset.
OFFSET_DAY = "2022-01-24"
OFFSET = 1000
#: Band centres in nm, by the two conventions in use.
RED = {"array": 664.0, "ee": 664.7}


def wrapped(value: Column, bits: int, *, signed: bool) -> Column:
    """C cast to an integer of so many bits: truncation, then wrapping; no number gives 0."""
    size = 1 << bits
    whole = F.when(value.isNull() | F.isnan(value), F.lit(0)).otherwise(F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)))
    low = F.pmod(whole.cast("long"), F.lit(size))
    return F.when(low >= size // 2, low - size).otherwise(low) if signed else low


def int16(value: Column) -> Column:
    return wrapped(value.cast("double"), 16, signed=True)


def uint16(value: Column) -> Column:
    return wrapped(value.cast("double"), 16, signed=False)


def uint32(value: Column) -> Column:
    return wrapped(value.cast("double"), 32, signed=False)


def clear(scl: Column) -> Column:
    return ~scl.isin(*CLOUD_CLASSES)


def masked(band: Column, scl: Column, *, cloud: str = "null") -> Column:
    """A band where the ground is clear; elsewhere null, or 0 with cloud='zero'."""
    return F.when(clear(scl), band) if cloud == "null" else F.when(clear(scl), band).otherwise(F.lit(0))


def without_offset(band: Column, day: Column, since: str = OFFSET_DAY) -> Column:
    """Remove the radiometric offset from its first day on; never below 0."""
    return F.greatest(F.when(day >= F.lit(since).cast("date"), band - OFFSET).otherwise(band), F.lit(0))


def clipped(index: Column) -> Column:
    """Values below -1000 and missing ones become 0."""
    return F.when(index >= -1000, index).otherwise(F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where the sum is 0."""
    return F.try_divide((a - b).cast("double"), (a + b).cast("double"))


def angle(l1: float, y1: Column, l2: float, y2: Column, l3: float, y3: Column) -> Column:
    """Angle in radians at the middle of three (wavelength, value) points, by the law of cosines, clamped."""
    side = lambda p, q, dl: F.sqrt(F.lit(float(dl * dl)) + (q - p) * (q - p))
    a, b, c = side(y1, y2, l2 - l1), side(y2, y3, l3 - l2), side(y1, y3, l3 - l1)
    return F.acos(F.least(F.greatest((a * a + b * b - c * c) / (2 * a * b), F.lit(-1.0)), F.lit(1.0)))


Bands = Mapping[str, Column]


def _evi(b: Bands, gain: float) -> Column:
    return F.try_divide(gain * (b["b08"] - b["b04"]), b["b08"] + 6 * b["b04"] - 7.5 * b["b02"] + 1.0)


def _as1(b: Bands) -> Column:
    return angle(835, b["b08"], 1613.7, b["b11"], 2202, b["b12"]) * 10000


def _conc(b: Bands) -> Column:
    return b["b11"] - (ratio(b["b08"], b["b11"]) * (1610 - 842) + ratio(b["b08"], b["b12"]) * (2190 - 842))


#: name -> expression over bands b02, b03, ... as doubles.
INDEXES: dict[str, Callable[[Bands], Column]] = {
    "ndvi": lambda b: int16(ratio(b["b08"], b["b04"]) * 10000),
    "gndvi": lambda b: int16(ratio(b["b08"], b["b03"]) * 10000),
    "lai": lambda b: uint16(0.57 * F.exp(2.33 * ratio(b["b08"], b["b04"])) * 1000),
    "evi": lambda b: int16(_evi(b, 2.5) * 1000),
    "lai_evi": lambda b: int16((_evi(b, 3.618) - 0.118) * 1000),
    "sr": lambda b: int16(F.try_divide(b["b08"], b["b04"]) * 10000),
    "nir": lambda b: b["b08"],
    "red": lambda b: b["b04"],
    "savi": lambda b: int16(F.try_divide(b["b08"] - b["b04"], b["b08"] + b["b04"] + 0.5) * 1000),
    "fapar": lambda b: int16(0.026 * F.exp(4.083 * ratio(b["b08"], b["b03"])) * 100),
    "ar": lambda b: uint16(angle(560, b["b03"], RED["array"], b["b04"], 835, b["b08"]) * 10000),
    "as1": lambda b: int16(_as1(b)),
    "sasi": lambda b: uint32(F.try_divide(int16(_as1(b)).cast("double"), b["b11"] - b["b08"]) * 10000),
    "anir": lambda b: uint16(angle(664, b["b04"], 835, b["b08"], 1613.7, b["b11"]) * 10000),
    "are1": lambda b: uint16(angle(665, b["b04"], 705, b["b05"], 740, b["b06"]) * 10000),
    "are2": lambda b: uint16(angle(705, b["b05"], 740, b["b06"], 783, b["b07"]) * 10000),
    "are3": lambda b: uint16(angle(740, b["b06"], 783, b["b07"], 842, b["b08"]) * 10000),
    "nbr": lambda b: int16(ratio(b["b08"], b["b12"]) * 10000),
    "conc": lambda b: int16(_conc(b)),
} | {f"b{k}": (lambda k: lambda b: b[f"b{k:02d}"])(k) for k in range(1, 13)} | {"b8a": lambda b: b["b8a"], "scl": lambda b: b["scl"]}
INDEXES["saavi"] = INDEXES["savi"]


def index(name: str, bands: Bands, *, resolution: int = 10) -> Column:
    """An index by name, in any case. Coarser data than 10 m takes the narrow infrared band."""
    if name.lower() not in INDEXES:
        raise ValueError(f"unknown index {name}")
    if resolution != 10 and "b8a" in bands:
        bands = dict(bands) | {"b08": bands["b8a"]}
    return INDEXES[name.lower()](bands)

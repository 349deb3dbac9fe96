"""Labels, thresholds and confidences of blocks, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels.
STRONG = ["ZERO_WIPE", "FF_WIPE", "RANDOM_WIPE", "MULTI_PASS"]
PARTIAL = ["LIKELY_ZERO_WIPE", "LIKELY_FF_WIPE", "LOW_ENTROPY_SUSPECT"]
#: Order of the type histogram's keys.
TYPES = ["ZERO_WIPE", "FF_WIPE", "RANDOM_WIPE", "MULTI_PASS", "LIKELY_ZERO_WIPE", "LIKELY_FF_WIPE", "LOW_ENTROPY_SUSPECT"]

# First bytes of known formats, for the structure check and for feature 21.
MAGIC = [0x50, 0x4B, 0x1F, 0x8B, 0xFF, 0xD8, 0x89, 0x4E, 0x47, 0x25, 0x44, 0x46, 0x7F, 0x45, 0x4C, 0x4D, 0x5A, 0x52, 0x61, 0x72, 0x21, 0xFD, 0x37, 0x7A, 0x58, 0x42, 0x68]
MAGIC_FEATURE = [0x50, 0x4B, 0x1F, 0x8B, 0xFF, 0xD8, 0x89, 0x25, 0x7F, 0x45, 0x4D, 0x5A, 0x52, 0x61, 0xFD, 0x37, 0x42]

# Thresholds of the decision tree.
FILL, FILL_ENTROPY, PARTIAL_FILL, REST_ENTROPY = 0.90, 0.20, 0.60, 3.5
RANDOM_ENTROPY, FLAT, LOW_FROM, LOW_TO, LOW_DOMINANT, LOW_FLAT = 7.60, 0.0140, 0.21, 1.50, 0.85, 0.020
PASS_FROM, PASS_TO, PASS_FILL, PASS_FLAT = 3.5, 6.5, 0.35, 0.0080
BUCKET_SHARE, PRINTABLE_RUN = 0.35, 64


def round3(x: Column) -> Column:
    """Three decimals, halves up, in binary arithmetic; the same in every SQL engine."""
    return F.floor(x * 1000 + 0.5) / 1000


def fill_confidence(ratio: Column, entropy: Column) -> Column:
    return round3(F.least(0.55 + 0.28 * (ratio - 0.9) / 0.1 + 0.17 * (1 - F.least(entropy / 0.5, F.lit(1.0))), F.lit(1.0)))


def partial_confidence(ratio: Column) -> Column:
    return round3(0.40 + 0.32 * (ratio - 0.6) / 0.3)


def random_confidence(entropy: Column, flatness: Column) -> Column:
    return round3(F.least(0.58 + 0.22 * (entropy - 7.6) / 0.4 + 0.12 * (1 - F.least(flatness / 0.014, F.lit(1.0))), F.lit(0.92)))


def classified(s: dict[str, Column]) -> Column:
    """struct(wipe_type, confidence, is_suspicious) of a block by its statistics; the first rule that holds decides.

    s: n, entropy, uniformity, zero_ratio, ff_ratio, dominant_byte, dominant_pct, entropy_nonzero, entropy_nonff
    and legit. Three of the rules can't hold for any real block; they are kept as they are part of the tree.
    """
    h, z, f, u = s["entropy"], s["zero_ratio"], s["ff_ratio"], s["uniformity"]

    def out(label: str, confidence, suspicious: bool) -> Column:
        c = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
        return F.struct(F.lit(label).alias("wipe_type"), c.cast("double").alias("confidence"), F.lit(suspicious).alias("is_suspicious"))

    part_z, part_f = (z >= PARTIAL_FILL) & (z < FILL), (f >= PARTIAL_FILL) & (f < FILL)
    low = (h > LOW_FROM) & (h <= LOW_TO)
    return (
        F.when(s["n"] == 0, out("NORMAL", 1.0, False))
        .when((z >= FILL) & (h <= FILL_ENTROPY), out("ZERO_WIPE", fill_confidence(z, h), True))
        .when((f >= FILL) & (h <= FILL_ENTROPY), out("FF_WIPE", fill_confidence(f, h) * 0.96, True))
        .when(part_z & (s["entropy_nonzero"] > REST_ENTROPY), out("LIKELY_ZERO_WIPE", partial_confidence(z), True))
        .when(part_z, out("NORMAL", 0.82, False))
        .when(part_f & (s["entropy_nonff"] > REST_ENTROPY), out("LIKELY_FF_WIPE", partial_confidence(f), True))
        .when(part_f, out("NORMAL", 0.82, False))
        .when((h >= RANDOM_ENTROPY) & (u > FLAT), out("NORMAL", 0.87, False))
        .when((h >= RANDOM_ENTROPY) & s["legit"], out("NORMAL", 0.72, False))
        .when(h >= RANDOM_ENTROPY, out("RANDOM_WIPE", random_confidence(h, u), True))
        .when(low & (s["dominant_pct"] <= LOW_DOMINANT) & (u < LOW_FLAT), out("LOW_ENTROPY_SUSPECT", 0.52, True))
        .when(low, out("NORMAL", 0.82, False))
        .when((h >= PASS_FROM) & (h <= PASS_TO) & (z + f >= PASS_FILL) & (u < PASS_FLAT), out("MULTI_PASS", 0.52, True))
        .when((s["dominant_byte"] == 0) & (s["dominant_pct"] >= 0.70) & (s["dominant_pct"] < 0.90), out("UNALLOCATED", 0.48, False))
        .otherwise(out("NORMAL", 0.90, False))
    )


def override(base: Column, ml: Column, confidence: Column) -> Column:
    """Whether a model's label replaces a rule's."""
    pairs = (
        ((base == "RANDOM_WIPE") & (ml == "NORMAL"))
        | ((base == "NORMAL") & ml.isin("RANDOM_WIPE", "ZERO_WIPE", "FF_WIPE", "MULTI_PASS"))
        | (base.isin("LIKELY_ZERO_WIPE", "LIKELY_FF_WIPE") & (ml == "NORMAL"))
    )
    return (confidence >= 0.70) & (ml != base) & pairs


def anomalous(base: Column, entropy: Column, overridden: Column) -> Column:
    """Whether a block without an override is promoted to RANDOM_WIPE with a confidence of at least 0.55."""
    return (base == "NORMAL") & (entropy >= 7.0) & ~overridden


def size_text(n: Column, style: str) -> Column:
    """Bytes as text; exact for whole numbers of up to 31 digits, null for null.

    style: gb (one decimal to GB, then TB), tb (to TB, then PB), floor, floor0 (0 B for 0). Halves of a tenth go to the
    even one, as printf has it.
    """
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    last = {"gb": 4, "tb": 5}.get(style, 4)
    n = n.cast("decimal(38,0)")

    def text(i: int) -> Column:
        unit = F.lit(1024**i)
        rest = n % unit
        whole = ((n - rest) / unit).cast("decimal(38,0)")
        if style not in ("gb", "tb"):
            return F.concat(whole.cast("string"), F.lit(f" {units[i]}"))
        tenths = F.rint(rest.cast("double") * 10 / unit).cast("long")  # ten of them are a whole one
        return F.concat((whole + F.when(tenths == 10, 1).otherwise(0)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {units[i]}"))

    out = text(last)
    for i in range(last - 1, -1, -1):
        out = F.when(n < 1024 ** (i + 1), text(i)).otherwise(out)
    return out


def entropy_meaning(h: Column) -> Column:
    return F.when(h >= 7.5, "random").when(h >= 6.0, "compressed or mixed").when(h <= 0.5, "fill").otherwise("structured")


def region_bounds(first: Column, last: Column) -> Column:
    """Offsets of a region's first and last byte, in hex."""
    return F.concat(F.lit("0x"), F.lpad(F.hex(first), 8, "0"), F.lit("-0x"), F.lpad(F.hex(last), 8, "0"))

"""Images and labels derived from a table of events, in Spark; sql.py has the same in SQL.

Event k is block k % 5000 of image k // 5000. The content and the injected label of a block follow from
k % 500, so that every rule that data can reach, and every region rule, comes up in each 500 blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE_BLOCKS, PERIOD = 5000, 500
#: (first, last, label) of the injected labels within a period; other blocks are NORMAL.
LAYOUT = [
    (0, 39, "ZERO_WIPE"), (45, 64, "ZERO_WIPE"), (68, 84, "ZERO_WIPE"), (105, 124, "ZERO_WIPE"), (127, 146, "FF_WIPE"), (150, 169, "RANDOM_WIPE"),
    (190, 209, "LIKELY_ZERO_WIPE"), (300, 319, "LIKELY_FF_WIPE"), (330, 334, "ZERO_WIPE"), (390, 459, "LOW_ENTROPY_SUSPECT"),
]


def _k() -> Column:
    return F.col("event_id")


def placed(events: DataFrame) -> DataFrame:
    k = _k()
    return events.withColumns(
        {
            "image_id": F.concat(F.lit("img"), F.floor(k / IMAGE_BLOCKS).cast("string")),
            "block_id": k % IMAGE_BLOCKS,
            "offset": (k % IMAGE_BLOCKS) * 512,
            "m": k % PERIOD,
        }
    )


def _hashes(n: int) -> Column:
    return F.concat(*(F.upper(F.sha2(F.concat(_k().cast("string"), F.lit(f":{i}")), 256)) for i in range(n)))


def images(events: DataFrame) -> DataFrame:
    """image_id, block_id, offset, data."""
    m = F.col("m")
    text = F.substring(F.repeat(F.hex(F.encode(F.concat("event_type", F.lit(" "), F.col("user_id").cast("string"), F.lit("; ")), "UTF-8")), 80), 1, 1024)
    content = (
        F.when((m < 85) | m.between(105, 124), F.lit("00" * 512))
        .when(m.between(127, 146), F.lit("FF" * 512))
        .when(m.between(150, 169) | (m % 11 == 0), _hashes(16))
        .when(m.between(190, 209), F.concat(F.lit("00" * 384), _hashes(4)))
        .when(m.between(300, 319), F.concat(F.lit("FF" * 384), _hashes(4)))
        .when(m.between(330, 334), F.concat(F.lit("00" * 502), F.substring(_hashes(1), 1, 20)))
        .when(m.between(390, 459), F.lit("55AA" * 256))
        .when(m.between(470, 475), F.concat(F.lit("00" * 384), F.lit("0102" * 64)))
        .when(m == 499, F.substring(text, 1, 600))
        .otherwise(text)
    )
    return placed(events).select("image_id", "block_id", "offset", F.unhex(content).alias("data"))


def labelled(events: DataFrame) -> DataFrame:
    """image_id, block_id, offset, wipe_type, entropy, confidence, is_suspicious with injected labels."""
    label = F.lit("NORMAL")
    for a, z, t in reversed(LAYOUT):
        label = F.when(F.col("m").between(a, z), t).otherwise(label)
    return placed(events).select(
        "image_id", "block_id", "offset", label.alias("wipe_type"), ((_k() * 7919) % 8000 / 1000).alias("entropy"),
        (0.5 + (_k() * 104729) % 500 / 1000).alias("confidence"), (label != "NORMAL").alias("is_suspicious"),
    )


def maps(events: DataFrame) -> DataFrame:
    """image_id, scheme, last_end: even images end inside, odd ones have no known table."""
    i = F.floor(_k() / IMAGE_BLOCKS)
    return events.select(i.alias("i")).distinct().select(
        F.concat(F.lit("img"), F.col("i").cast("string")).alias("image_id"), F.when(F.col("i") % 2 == 0, "MBR").otherwise("UNKNOWN").alias("scheme"),
        F.when(F.col("i") % 2 == 0, F.lit(2650 * 512 - 1)).cast("long").alias("last_end"),
    )


def predictions(events: DataFrame) -> DataFrame:
    """image_id, block_id, ml_label, ml_confidence: injected predictions for two blocks in three."""
    names = F.array(*map(F.lit, ["RANDOM_WIPE", "NORMAL", "ZERO_WIPE", "FF_WIPE", "MULTI_PASS"]))
    return placed(events).filter(_k() % 3 != 0).select(
        "image_id", "block_id", F.element_at(names, (F.floor(_k() / 3) % 5 + 1).cast("int")).alias("ml_label"), (0.4 + (_k() * 31) % 60 / 100).alias("ml_confidence")
    )


def votes(events: DataFrame) -> DataFrame:
    """image_id, block_id and three arrays of probabilities."""
    def vote(a: int) -> Column:
        w = [(_k() * a + j * j * 7) % 10 + 1 for j in range(5)]
        total = sum(w[1:], w[0])
        return F.array(*(x / total for x in w))
    return placed(events).select("image_id", "block_id", *(vote(a).alias(n) for a, n in ((3, "rf"), (7, "et"), (9, "gb"))))


def custody_entries(events: DataFrame) -> DataFrame:
    """session_id, sequence, timestamp_utc, event_type, sha256_evidence, description: 20 entries a session."""
    k = _k()
    return events.select(
        F.floor(k / 20).alias("session_id"), (k % 20).alias("sequence"), F.concat(F.lit("2024-01-01T00:00:"), F.lpad((k % 20).cast("string"), 2, "0"), F.lit("Z")).alias("timestamp_utc"),
        F.upper("event_type").alias("event_type"), F.when(k % 4 == 0, F.sha2(k.cast("string"), 256)).when(k % 4 == 1, "").alias("sha256_evidence"),
        F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), F.col("event_type")).alias("description"),
    )


def tampered(log: DataFrame) -> DataFrame:
    """log with some descriptions and recorded hashes changed, some blank, also two in a row."""
    s, q = F.col("session_id"), F.col("sequence")
    k = s * 20 + q
    edited = F.when(k % 37 == 5, F.concat("description", F.lit("!"))).otherwise(F.col("description"))
    hash_ = F.when(k % 53 == 7, F.lit("0" * 64)).when((k % 101).isin(11, 12), "").otherwise(F.col("entry_hash"))
    return log.withColumns({"description": edited, "entry_hash": hash_})


def le(x: str, size: int) -> str:
    """SQL, in Spark's and in DuckDB's dialect, for a number as little-endian hex."""
    h = f"lpad(hex({x}), {2 * size}, '0')"
    return "concat(" + ", ".join(f"substr({h}, {2 * (size - i) - 1}, 2)" for i in range(size)) + ")"


def _entry(status: str, kind: str, first: str, n: str) -> str:
    return f"concat('{status}', '000000', '{kind}', '000000', {le(first, 4)}, {le(n, 4)})"


def _record(*entries: str) -> str:
    return f"concat(repeat('00', 446), {', '.join(entries)}, repeat('00', {16 * (4 - len(entries))}), '55AA')"


def _gpt_head(size: int, at: int = 2) -> str:
    return f"concat(hex('EFI PART'), repeat('00', 64), {le(str(at), 8)}, {le('4', 4)}, {le(str(size), 4)}, repeat('00', 424))"


def _gpt_entry(first: str, last: str, flags: int, name: str) -> str:
    wide = "".join(f"{ord(c):02X}00" for c in name)
    return f"concat(repeat('11', 32), {le(first, 8)}, {le(last, 8)}, {le(str(flags), 8)}, '{wide}', repeat('00', {72 - len(wide) // 2}))"


DISK_SECTORS = 100
DISK, AT = f"cast(floor(event_id / {DISK_SECTORS}) as bigint)", f"(event_id % {DISK_SECTORS})"
_KIND = f"({DISK} % 5)"
_GUARD, _PLAIN = _entry("00", "EE", "1", "99"), _entry("80", "07", "5", f"3 + {_KIND}")
_THREE = [_gpt_entry("10", "29", 4, "boot"), _gpt_entry("30", "30", 0, "one"), _gpt_entry("40", f"59 + {_KIND}", 0, "")]
_ENTRIES = f"concat({', '.join(_THREE)}, repeat('00', 128))"
_ALONE = [f"concat({e}, repeat('00', 384))" for e in _THREE]
#: The hex of sector AT of disk DISK, in SQL of both dialects: no table; primary partitions, one with an odd status; a
#: chain of logical ones, sometimes with a loop; GPT; GPT without its guard; a GPT with short entries; one with an entry
#: a sector; one whose entries are far from its header; a chain on a disk that is overwritten with boot signatures.
SECTOR = f"""CASE {DISK} % 9
  WHEN 1 THEN CASE WHEN {AT} = 0 THEN {_record(_entry('80', '07', f'10 + {_KIND}', '20'), _entry('13', '83', '40', f'10 + {_KIND}'))} END
  WHEN 2 THEN CASE {AT} WHEN 0 THEN {_record(_entry('00', '0B', '3', '20'), _entry('00', '05', '30', '60'))}
    WHEN 30 THEN {_record(_entry('80', '83', '1', f'5 + {_KIND}'), _entry('00', '05', '15', '20'))}
    WHEN 45 THEN {_record(_entry('00', '99', '0', '8'), _entry('00', '05', f'15 * ({DISK} % 12 - 2)', '0'))} WHEN 105 THEN '' END
  WHEN 3 THEN CASE {AT} WHEN 0 THEN {_record(_GUARD)} WHEN 1 THEN {_gpt_head(128)} WHEN 2 THEN {_ENTRIES} END
  WHEN 4 THEN CASE {AT} WHEN 0 THEN {_record(_PLAIN)} WHEN 1 THEN {_gpt_head(128)} WHEN 2 THEN {_ENTRIES} END
  WHEN 5 THEN CASE {AT} WHEN 0 THEN {_record(_GUARD, _PLAIN)} WHEN 1 THEN {_gpt_head(64)} WHEN 2 THEN {_ENTRIES} END
  WHEN 6 THEN CASE {AT} WHEN 0 THEN {_record(_GUARD)} WHEN 1 THEN {_gpt_head(512)} WHEN 2 THEN {_ALONE[0]} WHEN 3 THEN {_ALONE[1]} WHEN 4 THEN {_ALONE[2]} END
  WHEN 7 THEN CASE {AT} WHEN 0 THEN {_record(_GUARD)} WHEN 1 THEN {_gpt_head(128, 70)} WHEN 70 THEN {_ENTRIES} END
  WHEN 8 THEN CASE {AT} WHEN 0 THEN {_record(_entry('00', '05', '30', '60'))} WHEN 30 THEN {_record(_entry('80', '83', '1', f'5 + {_KIND}'), _entry('00', '05', '15', '20'))} ELSE repeat('55AA', 256) END END"""


def disks(events: DataFrame) -> DataFrame:
    """image_id, block_id, data: disks of DISK_SECTORS sectors with partition tables of all kinds."""
    data = F.unhex(F.coalesce(F.expr(SECTOR), F.repeat(F.lit("00"), 512)))
    return events.select(F.concat(F.lit("disk"), F.expr(DISK).cast("string")).alias("image_id"), F.expr(AT).alias("block_id"), data.alias("data"))

"""Partition tables of disk images: MBR with extended chains, GPT, and relations of offsets to partitions."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.blockimage import open_input
from ..sources.sinks import small, written
from .intervals import containing, last_mark

SECTOR = 512
EXTENDED = (0x05, 0x0F, 0x85)
MAX_GPT_ENTRIES = 256

# Names of MBR type codes.
MBR_TYPES = {
    0x01: "FAT12", 0x04: "FAT16 (<32 MB)", 0x05: "Extended (CHS)", 0x06: "FAT16", 0x07: "NTFS / exFAT / HPFS", 0x0B: "FAT32 (CHS)", 0x0C: "FAT32 (LBA)",
    0x0E: "FAT16 (LBA)", 0x0F: "Extended (LBA)", 0x11: "Hidden FAT12", 0x14: "Hidden FAT16", 0x16: "Hidden FAT16", 0x17: "Hidden NTFS", 0x1B: "Hidden FAT32",
    0x1C: "Hidden FAT32 (LBA)", 0x27: "Windows Recovery", 0x39: "Plan 9", 0x3C: "PartitionMagic", 0x42: "Windows LDM (dynamic disk)", 0x82: "Linux swap / Solaris",
    0x83: "Linux", 0x84: "Hibernation / Hidden", 0x85: "Linux Extended", 0x86: "FAT16 volume set", 0x87: "NTFS volume set", 0x8E: "Linux LVM", 0x9F: "BSD/OS",
    0xA0: "Hibernation (IBM/Toshiba)", 0xA5: "FreeBSD", 0xA6: "OpenBSD", 0xA8: "macOS X", 0xA9: "NetBSD", 0xAB: "macOS X Boot", 0xAF: "macOS X HFS+",
    0xBE: "Solaris Boot", 0xBF: "Solaris", 0xDB: "CP/M / CTOS", 0xDE: "Dell Diagnostics", 0xEE: "GPT Protective MBR", 0xEF: "EFI System Partition",
    0xFB: "VMware VMFS", 0xFC: "VMware swap / VMKCORE", 0xFD: "Linux RAID auto", 0xFE: "LANstep / PS/2 IML", 0xFF: "XENIX bad track",
}

SCHEMA = (
    "image_id string, scheme string, index int, start_lba long, end_lba long, sector_count long, part_type int, type_name string, is_bootable boolean,"
    " start_offset long, end_offset long, size_bytes long, type_code string, last_used_lba long, disk_size_lba long, errors array<string>"
)
GPT_TYPE = 0xFF

Reader = Callable[[int, int], bytes]


def type_name(code: int) -> str:
    return MBR_TYPES.get(code, f"Unknown (0x{code:02X})")


def _slots(sector: bytes) -> list[tuple[int, int, int, int]]:
    """(status, type, first sector, sectors) of the four entries of a boot record."""
    raw = (struct.unpack_from("<B3xB3xII", sector, 446 + 16 * i) for i in range(4))
    return list(raw)


def _signed(sector: bytes) -> bool:
    return len(sector) == SECTOR and sector[510:] == b"\x55\xaa"


def _row(scheme: str, index: int, first: int, n: int, kind: int, name: str, boot: bool) -> dict:
    return {"scheme": scheme, "index": index, "start_lba": first, "end_lba": first + n - 1, "sector_count": n, "part_type": kind, "type_name": name, "is_bootable": boot}


def _primary(sector: bytes, errors: list[str]) -> list[dict]:
    """The used entries of a boot record; an odd status byte is noted and its entry kept."""
    out = []
    for i, (status, kind, lba, n) in enumerate(_slots(sector)):
        if status not in (0, 0x80):
            errors.append(f"entry {i}: status byte 0x{status:02X}")
        if kind and lba and n:
            out.append(_row("MBR", i, lba, n, kind, type_name(kind), status == 0x80))
    return out


def _logical(read: Reader, base: int, index: int, errors: list[str]) -> list[dict]:
    """Partitions along the chain of boot records that starts at base; a record met twice ends it."""
    out, seen, at = [], set(), base
    while at not in seen:
        seen.add(at)
        sector = read(at * SECTOR, SECTOR)
        if not _signed(sector):
            errors.append(f"no boot record at sector {at}")
            break
        (_, kind, first, n), (_, link, step, _), *_ = _slots(sector)
        if kind and n:
            out.append(_row("MBR", index + len(out), at + first, n, kind, type_name(kind), False))
        if link not in EXTENDED or not step:
            break
        at = base + step
    return out


def _gpt(read: Reader, errors: list[str]) -> list[dict]:
    head = read(SECTOR, 92)
    if head[:8] != b"EFI PART" or len(head) < 92:
        errors.append("no GPT header")
        return []
    at, count, size = struct.unpack_from("<QII", head, 72)
    if size < 128:
        errors.append(f"GPT entries of {size} bytes")
        return []
    out = []
    for i in range(min(count, MAX_GPT_ENTRIES)):
        e = read(at * SECTOR + i * size, 128)
        if len(e) < 32:
            break
        if len(e) < 56:
            errors.append("GPT entries end early")
            return []
        first, last, flags = struct.unpack_from("<qqQ", e, 32)
        if e[:16] == bytes(16) or first <= 0 or last <= 0:
            continue
        if first >= last:
            errors.append(f"GPT entry {i} has no length")
            continue
        name = e[56:128].decode("utf-16-le", "replace").rstrip("\0") if len(e) == 128 else ""
        out.append(_row("GPT", len(out), first, last - first + 1, GPT_TYPE, name or "Unknown", bool(flags & 4)))
    return out


def parse(read: Reader) -> tuple[str, list[dict], list[str]]:
    """(scheme, partitions, errors) of an image; read(offset, length) gives its bytes, fewer at its end.

    Never raises for what an image holds: no boot signature is scheme UNKNOWN. A GPT that gives no partition
    falls back to the boot record's entries, the protective one too. A container of logical partitions isn't a
    partition itself; only the last one is followed, and logical partitions are numbered from 4 and the number
    of the other entries on.
    """
    errors: list[str] = []
    sector = read(0, SECTOR)
    if not _signed(sector):
        return "UNKNOWN", [], ["no boot signature"]
    entries = _primary(sector, errors)
    guard = any(e["part_type"] == 0xEE for e in entries)
    if guard or read(SECTOR, 8) == b"EFI PART":
        if parts := _gpt(read, errors):
            return ("GPT" if guard else "HYBRID"), parts, errors
        errors.append("no partition in the GPT, the boot record's entries count")
    parts = [e for e in entries if e["part_type"] not in EXTENDED]
    for container in [e for e in entries if e["part_type"] in EXTENDED][-1:]:
        parts += _logical(read, container["start_lba"], 4 + len(parts), errors)
    if not parts:
        errors.append("no entry in the boot record")
    return "MBR", parts, errors


def _rows(image: str, read: Reader, size: int) -> list[dict]:
    """SCHEMA rows of an image: one per partition, or one with nulls for an image without any."""
    scheme, parts, errors = parse(read)
    whole = {"image_id": image, "scheme": scheme, "errors": errors, "disk_size_lba": size // SECTOR, "last_used_lba": max((p["end_lba"] for p in parts), default=0)}
    for p in parts:
        p |= {"start_offset": p["start_lba"] * SECTOR, "end_offset": (p["end_lba"] + 1) * SECTOR - 1, "size_bytes": p["sector_count"] * SECTOR, "type_code": hex(p["part_type"])}
    return [{**p, **whole, "scheme": scheme} for p in parts or [{}]]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    fields = [f.split() for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], [n for n, _ in fields])


def partition_tables(images: DataFrame) -> DataFrame:
    """SCHEMA rows of image files (image_id, path), each read in the task that has its row, a few sectors only.

    path: any place that executors can read, as a local path or a URI.
    """

    def run(batches):
        for b in batches:
            rows = []
            for image, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open_input(path) as f:
                    rows += _rows(image, lambda at, n, f=f: f.read_at(max(0, min(n, f.size() - at)), at) if at < f.size() else b"", f.size())
            yield _batch(rows)

    return images.select("image_id", "path").mapInArrow(run, SCHEMA)


def _le(data: Column, at: int, n: int) -> Column:
    """n bytes from at on as an unsigned little-endian number; null where there are fewer."""
    digits = F.concat(*(F.hex(F.substring(data, at + k + 1, 1)) for k in reversed(range(n))))
    return F.when(F.length(data) >= at + n, F.conv(digits, 16, 10).cast("decimal(20,0)"))


def _boot_slots(boot: Column) -> Column:
    """The four entries of a boot record: i, status, kind, first, n."""
    number = lambda at, n: _le(boot, at, n).cast("long")
    return F.array(*(F.struct(F.lit(i).alias("i"), number(446 + 16 * i, 1).alias("status"), number(450 + 16 * i, 1).alias("kind"), number(454 + 16 * i, 4).alias("first"), number(458 + 16 * i, 4).alias("n")) for i in range(4)))


def _is_signed(data: Column) -> Column:
    return (F.length(data) == SECTOR) & (F.substring(data, 511, 2) == F.lit(b"\x55\xaa"))


def _names(kind: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in MBR_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, kind.cast("int")), F.concat(F.lit("Unknown (0x"), F.lpad(F.hex(kind), 2, "0"), F.lit(")")))


@F.udf(StringType(), useArrow=True)
def _wide_text(raw: bytes) -> str:
    """UTF-16 without what ends it; a broken pair is a replacement mark."""
    return bytes(raw).decode("utf-16-le", "replace").rstrip("\0") if len(raw) == 72 else ""


def _gpt_entries(images: DataFrame, sectors: DataFrame) -> DataFrame:
    """image_id, i, raw (up to 128 bytes) of the GPT entries that the headers ask for; sectors: those that _wanted lists."""
    e = _entry_places(images)
    one = sectors.select("image_id", F.col("block_id").alias("sector"), F.col("data").alias("a"))
    two = sectors.select("image_id", (F.col("block_id") - 1).alias("sector"), F.col("data").alias("b"))
    j = e.join(one, ["image_id", "sector"], "left").join(two, ["image_id", "sector"], "left")
    a, b = F.coalesce("a", F.lit(b"")), F.coalesce("b", F.lit(b""))
    both = F.when(F.length(a) == SECTOR, F.concat(a, b)).otherwise(a)
    return j.select("image_id", "i", F.call_function("substring", both, F.col("off") + 1, F.lit(128)).alias("raw"))


def _entry_places(images: DataFrame) -> DataFrame:
    """image_id, i, sector, off of the GPT entries; an array beyond all disks is nowhere."""
    on = images.filter("wide and count > 0").select("image_id", "at", "size", F.explode(F.sequence(F.lit(0), F.least("count", F.lit(MAX_GPT_ENTRIES)).cast("int") - 1)).alias("i"))
    far = F.col("at") >= 1 << 50
    pos = F.when(far, F.lit(1 << 61)).otherwise(F.col("at").cast("long") * SECTOR) + F.col("i") * F.col("size").cast("long")
    return on.select("image_id", "i", F.call_function("shiftright", pos, F.lit(9)).alias("sector"), (pos % SECTOR).cast("int").alias("off"))


def _gpt_parts(images: DataFrame, sectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(partitions of the GPTs: image_id, index, first, last, name, boot; messages: image_id, i, message)."""
    e = _gpt_entries(images, sectors).withColumn("size", F.length("raw"))
    stop = e.filter("size < 56").groupBy("image_id").agg(F.min(F.struct("i", "size")).alias("stop"))
    e = e.join(stop, "image_id", "left")
    early = stop.filter("stop.size >= 32").select("image_id", F.lit(MAX_GPT_ENTRIES).alias("i"), F.lit("GPT entries end early").alias("message"))
    number = lambda at: _le(F.col("raw"), at, 8)
    e = e.filter("stop is null or i < stop.i").select("image_id", "i", "stop", "raw", number(32).alias("first"), number(40).alias("last"))
    used = e.filter((F.substring("raw", 1, 16) != F.lit(bytes(16))) & F.col("first").between(1, (1 << 63) - 1) & F.col("last").between(1, (1 << 63) - 1))
    empty = used.filter("first >= last").select("image_id", "i", F.format_string("GPT entry %d has no length", "i").alias("message"))
    boot = F.conv(F.hex(F.substring("raw", 49, 1)), 16, 10).cast("int").bitwiseAND(4) == 4
    parts = used.filter("first < last and (stop is null or stop.size < 32)").select("image_id", "i", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), boot.alias("boot"), _wide_text(F.substring("raw", 57, 72)).alias("name"))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("i")) - 1
    return parts.withColumn("index", place), empty.unionByName(early)


def _chains(images: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boot records along the chains: image_id, s, d (steps from the first), first, n, kind; messages: image_id, message).

    images: image_id, base. A record points to the next one by its sector, so a chain is walked by doubling: the
    records 2^k steps on are joined to those known, and the pointers with themselves. A chain of a million records
    takes twenty rounds, and a record met again keeps the fewest steps. Only numbers of signed sectors are shuffled.
    """
    kind, first, n, link, step = (_le(F.col("data"), at, size).cast("long") for at, size in ((450, 1), (454, 4), (458, 4), (466, 1), (470, 4)))
    signed = blocks.filter(_is_signed(F.col("data"))).join(small(images.select("image_id", "base")), "image_id")
    to = F.when(link.isin(*EXTENDED) & (step > 0), F.col("base") + step)
    records = written(signed.select("image_id", "base", F.col("block_id").alias("s"), kind.alias("kind"), first.alias("first"), n.alias("n"), to.alias("to")), "records")
    there = records.select("image_id", F.col("s").alias("to"))
    jump = written(records.filter("to is not null").select("image_id", "s", "to").join(there, ["image_id", "to"], "left_semi"), "pointers")
    met = written(records.filter("s = base").select("image_id", "s", F.lit(0).cast("long").alias("d")), "chain")
    known, k = met.count(), 0
    while True:
        further = met.join(jump, ["image_id", "s"]).select("image_id", F.col("to").alias("s"), (F.col("d") + (1 << k)).alias("d"))
        met = written(met.unionByName(further).groupBy("image_id", "s").agg(F.min("d").alias("d")), "chain")
        before, known = known, met.count()
        if known == before:
            break
        onward = jump.select("image_id", F.col("s").alias("to"), F.col("to").alias("then"))
        jump, k = written(jump.join(onward, ["image_id", "to"]).select("image_id", "s", F.col("then").alias("to")), "pointers"), k + 1
    chain = met.join(records, ["image_id", "s"])
    lost = chain.filter("to is not null").select("image_id", "to").join(there, ["image_id", "to"], "left_anti")
    lost = lost.unionByName(images.select("image_id", F.col("base").alias("to")).join(there, ["image_id", "to"], "left_anti"))
    return chain, lost.select("image_id", F.format_string("no boot record at sector %d", "to").alias("message"))


def tables_of_blocks(blocks: DataFrame) -> DataFrame:
    """SCHEMA rows of images that are tables of sectors (image_id, block_id, data), as partition_tables gives them for files.

    Sectors 0 and 1 say which others are needed: the entries of a GPT, wherever its header puts them and however wide
    they are, and the image's last one for its size. They are joined to the blocks by id; chains of boot records are
    followed by joins (see _chains). Nothing is grouped by image but what belongs to its table.
    """
    b = blocks.select("image_id", "block_id", "data")
    at = lambda k: F.max(F.when(F.col("block_id") == k, F.col("data")))
    heads = b.filter(F.col("block_id").isin(0, 1)).groupBy("image_id").agg(at(0).alias("boot"), at(1).alias("head"))
    i = blocks.groupBy("image_id").agg(F.max("block_id").alias("final")).join(heads, "image_id", "left")
    i = i.withColumns({"signed": F.coalesce(_is_signed(F.col("boot")), F.lit(False)), "slots": _boot_slots(F.col("boot"))})
    used = F.filter("slots", lambda e: (e["kind"] > 0) & (e["first"] > 0) & (e["n"] > 0))
    i = i.withColumns({"used": used, "efi": F.coalesce(F.substring("head", 1, 8) == F.lit(b"EFI PART"), F.lit(False))}).withColumn("guard", F.exists("used", lambda e: e["kind"] == 0xEE))
    i = i.withColumns({"asked": F.col("signed") & (F.col("guard") | F.col("efi")), "headed": F.col("efi") & (F.length("head") >= 92), "size": _le(F.col("head"), 84, 4), "count": _le(F.col("head"), 80, 4), "at": _le(F.col("head"), 72, 8)})
    i = i.withColumn("wide", F.col("asked") & F.col("headed") & (F.col("size") >= 128))
    far = F.filter("used", lambda e: e["kind"].isin(*EXTENDED))
    i = written(i.withColumn("base", F.try_element_at(far, F.lit(-1))["first"]).drop("boot", "head"), "boot")

    places = _entry_places(i)
    needed = places.select("image_id", F.col("sector").alias("block_id")).unionByName(places.filter(F.col("off") > SECTOR - 128).select("image_id", (F.col("sector") + 1).alias("block_id")))
    needed = needed.unionByName(i.select("image_id", F.col("final").alias("block_id"))).distinct()
    sectors = written(b.join(small(needed), ["image_id", "block_id"], "left_semi"), "sectors")
    gpt, gpt_messages = _gpt_parts(i, sectors)
    gpt = written(gpt, "gpt")
    i = i.join(gpt.groupBy("image_id").agg(F.lit(True).alias("has_gpt")), "image_id", "left").join(sectors.select("image_id", F.col("block_id").alias("final"), F.length("data").alias("tail")), ["image_id", "final"], "left")
    i = i.withColumn("scheme", F.when(~F.col("signed"), "UNKNOWN").when(F.col("has_gpt"), F.when(F.col("guard"), "GPT").otherwise("HYBRID")).otherwise("MBR"))
    main = i.filter("scheme = 'MBR'").select("image_id", "base", F.filter("used", lambda e: ~e["kind"].isin(*EXTENDED)).alias("own"))
    chain, chain_messages = _chains(main.filter("base is not null"), b)
    later = Window.partitionBy("image_id").orderBy("d")
    logical = chain.filter("kind > 0 and n > 0").join(main.select("image_id", F.size("own").alias("before")), "image_id")
    logical = logical.select("image_id", (3 + F.col("before") + F.row_number().over(later)).alias("index"), (F.col("s") + F.col("first")).alias("first"), "n", "kind", F.lit(False).alias("boot"))
    mbr = main.select("image_id", F.explode("own").alias("e")).select("image_id", F.col("e.i").alias("index"), "e.first", "e.n", "e.kind", (F.col("e.status") == 0x80).alias("boot")).unionByName(logical)
    mbr = mbr.select("image_id", "index", "first", (F.col("first") + F.col("n") - 1).alias("last"), "kind", _names(F.col("kind")).alias("name"), "boot")
    wide = gpt.select("image_id", "index", "first", "last", F.lit(GPT_TYPE).cast("long").alias("kind"), F.when(F.col("name") == "", "Unknown").otherwise(F.col("name")).alias("name"), "boot")
    parts = mbr.unionByName(wide).select(
        "image_id", F.col("index").cast("int").alias("index"), F.col("first").alias("start_lba"), F.col("last").alias("end_lba"), (F.col("last") - F.col("first") + 1).alias("sector_count"), F.col("kind").cast("int").alias("part_type"),
        F.col("name").alias("type_name"), F.col("boot").alias("is_bootable"), (F.col("first") * SECTOR).alias("start_offset"), ((F.col("last") + 1) * SECTOR - 1).alias("end_offset"),
        ((F.col("last") - F.col("first") + 1) * SECTOR).alias("size_bytes"), F.concat(F.lit("0x"), F.lower(F.hex("kind"))).alias("type_code"),
    )
    parts = written(parts, "partitions")
    whole = parts.groupBy("image_id").agg(F.max("end_lba").alias("last_used_lba"))
    texts = gpt_messages.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("i", "message")))["message"].alias("gpt_texts"))
    chained = chain_messages.groupBy("image_id").agg(F.max("message").alias("chain_text"))
    i = i.join(whole, "image_id", "left").join(texts, "image_id", "left").join(chained, "image_id", "left")
    text = lambda when, message: F.when(when, F.array(message if isinstance(message, Column) else F.lit(message))).otherwise(F.array().cast("array<string>"))
    odd = F.transform(F.filter("slots", lambda e: ~e["status"].isin(0, 0x80)), lambda e: F.concat(F.lit("entry "), e["i"].cast("string"), F.lit(": status byte 0x"), F.lpad(F.hex(e["status"]), 2, "0")))
    none = F.col("scheme") == "MBR"
    errors = F.concat(
        odd, text(F.col("asked") & ~F.col("headed"), "no GPT header"), text(F.col("asked") & F.col("headed") & (F.col("size") < 128), F.concat(F.lit("GPT entries of "), F.col("size").cast("string"), F.lit(" bytes"))),
        F.coalesce("gpt_texts", F.array().cast("array<string>")), text(F.col("asked") & none, "no partition in the GPT, the boot record's entries count"),
        text(F.col("chain_text").isNotNull(), F.col("chain_text")), text(none & F.col("last_used_lba").isNull(), "no entry in the boot record"),
    )
    i = i.select(
        "image_id", "scheme", F.coalesce("last_used_lba", F.lit(0)).cast("long").alias("last_used_lba"), F.floor((F.col("final") * SECTOR + F.col("tail")) / SECTOR).cast("long").alias("disk_size_lba"),
        F.when(F.col("signed"), errors).otherwise(F.array(F.lit("no boot signature"))).alias("errors"),
    )
    return i.join(parts, "image_id", "left").select([x.split()[0] for x in SCHEMA.split(", ")])


def maps(tables: DataFrame) -> DataFrame:
    """image_id, scheme, last_end for the boundary of regions."""
    end = F.max((F.col("end_lba") + 1) * SECTOR - 1)
    return tables.groupBy("image_id").agg(F.max("scheme").alias("scheme"), end.alias("last_end"))


def offset_context(offsets: DataFrame, tables: DataFrame) -> DataFrame:
    """offsets (image_id, offset) with context: beyond the last partition, inside (gaps count), or unknown.

    Only the end of the last partition decides, so partitions are aggregated to a row per image and joined.
    """
    j = offsets.join(maps(tables), "image_id", "left")
    unknown = F.col("scheme").isNull() | (F.col("scheme") == "UNKNOWN") | F.col("last_end").isNull()
    return j.withColumn("context", F.when(unknown, "UNKNOWN").when(F.col("offset") > F.col("last_end"), "BEYOND_BOUNDARY").otherwise("INSIDE_PARTITION")).drop("scheme", "last_end")


def partition_of(offsets: DataFrame, tables: DataFrame) -> DataFrame:
    """offsets (image_id, offset) with the index and type_name of the partition that holds each, nulls in gaps and without a table.

    tables: SCHEMA rows. Where partitions overlap it is the one of the smallest index. That is found for the places where
    partitions begin and those after their ends, and holds up to the next such place. So a table that says a partition is
    of terabytes costs no more than any other, and offsets are shuffled once.
    """
    parts = written(tables.filter("image_id is not null and start_lba is not null").select("image_id", "index", "type_name", "start_offset", "end_offset"), "extents")
    edges = parts.select("image_id", F.explode(F.array("start_offset", F.col("end_offset") + 1)).alias("offset")).distinct()
    held = containing(edges, parts, "offset", "start_offset", "end_offset", top=62)
    held = held.groupBy("image_id", "offset").agg(F.min(F.struct("index", "type_name")).alias("p"))
    found = last_mark(offsets, edges.join(held, ["image_id", "offset"], "left"), "offset", "p")
    return found.withColumns({"index": F.col("p.index"), "type_name": F.col("p.type_name")}).drop("p")

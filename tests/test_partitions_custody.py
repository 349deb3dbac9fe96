import json
import struct

from pyspark.sql import functions as F

from tessera.operators import custody, partitions


def mbr(*entries, sign=True):
    out = bytearray(512)
    for i, (status, kind, lba, n) in enumerate(entries):
        struct.pack_into("<B3sB3sII", out, 446 + 16 * i, status, b"", kind, b"", lba, n)
    if sign:
        out[510:] = b"\x55\xaa"
    return bytes(out)


def disk(sectors, size=4000):
    data = bytearray(size * 512)
    for at, s in sectors.items():
        data[at * 512 : at * 512 + len(s)] = s
    return lambda offset, length: bytes(data[offset : offset + length])


def gpt(entries, size=128, count=None):
    head = bytearray(512)
    head[:8] = b"EFI PART"
    struct.pack_into("<QII", head, 72, 2, len(entries) if count is None else count, size)
    body = b"".join((b"\1" * 32 + struct.pack("<QQQ", a, z, flags) + name.encode("utf-16-le").ljust(72, b"\0")).ljust(size, b"\0") for a, z, flags, name in entries)
    return bytes(head), body


def test_boot_records():
    assert partitions.parse(disk({}))[0] == "UNKNOWN" and partitions.parse(lambda o, n: b"")[0] == "UNKNOWN"
    assert partitions.parse(disk({0: mbr()}))[:2] == ("MBR", [])
    scheme, parts, _ = partitions.parse(disk({0: mbr((0x80, 7, 63, 100), (0x13, 0x83, 200, 50), (0, 0x82, 0, 9))}))
    assert scheme == "MBR" and [(p["start_lba"], p["end_lba"], p["is_bootable"]) for p in parts] == [(63, 162, True), (200, 249, False)]
    assert parts[0]["type_name"] == "NTFS / exFAT / HPFS" and partitions.type_name(0x99) == "Unknown (0x99)"


def test_extended_chains():
    sectors = {0: mbr((0, 0x05, 1000, 900)), 1000: mbr((0, 0x83, 1, 50), (0, 0x05, 100, 60)), 1100: mbr((0, 0x07, 1, 20))}
    _, parts, _ = partitions.parse(disk(sectors))  # the container is no partition itself
    assert [(p["index"], p["start_lba"]) for p in parts] == [(4, 1001), (5, 1101)]
    _, parts, _ = partitions.parse(disk(sectors | {0: mbr((0, 7, 63, 9), (0, 0x05, 1000, 900))}))
    assert [(p["index"], p["start_lba"], p["is_bootable"]) for p in parts] == [(0, 63, False), (5, 1001, False), (6, 1101, False)]
    loop = sectors | {1100: mbr((0x80, 0x07, 0, 20), (0, 0x05, 100, 0))}  # a start of 0 and a link without a count are valid
    assert [(p["start_lba"], p["is_bootable"]) for p in partitions.parse(disk(loop))[1]] == [(1001, False), (1100, False)]
    _, parts, errors = partitions.parse(disk(sectors | {1100: mbr(sign=False)}))
    assert len(parts) == 1 and errors
    twice = {0: mbr((0, 5, 100, 9), (0, 15, 1000, 900)), 1000: mbr((0, 0x83, 1, 50))}  # the last container is followed
    assert [p["start_lba"] for p in partitions.parse(disk(twice))[1]] == [1001]


def test_gpt():
    head, body = gpt([(100, 199, 4, "boot"), (300, 300, 0, "one sector"), (400, 900, 0, "")])
    scheme, parts, _ = partitions.parse(disk({0: mbr((0, 0xEE, 1, 3999)), 1: head, 2: body}))
    assert scheme == "GPT" and [(p["start_lba"], p["type_name"], p["is_bootable"]) for p in parts] == [(100, "boot", True), (400, "Unknown", False)]
    assert partitions.parse(disk({0: mbr((0, 7, 63, 9)), 1: head, 2: body}))[0] == "HYBRID"
    small, body2 = gpt([(100, 199, 0, "x")], size=128)
    small = bytearray(small)
    struct.pack_into("<I", small, 84, 64)
    scheme, parts, errors = partitions.parse(disk({0: mbr((0, 0xEE, 1, 9), (0, 7, 63, 9)), 1: bytes(small), 2: body2}))
    assert scheme == "MBR" and [p["part_type"] for p in parts] == [0xEE, 7] and errors  # the guard counts here
    _, parts, errors = partitions.parse(disk({0: mbr((0x11, 7, 5, 9))}))
    assert len(parts) == 1 and any("0x11" in e for e in errors)


def sectors_of(spark, images, size=4000):
    rows = [(i, k, s[:512].ljust(512, b"\0")) for i, sectors in images.items() for k, s in ({j: b"" for j in range(size)} | {k + j: x[512 * j : 512 * j + 512] for k, x in sectors.items() for j in range(-(-len(x) // 512))}).items()]
    return spark.createDataFrame(rows, "image_id string, block_id long, data binary")


def test_tables_of_files_and_of_blocks(spark, tmp_path):
    head, body = gpt([(100, 199, 4, "boot"), (400, 900, 0, "")])
    images = {"a": {0: mbr((0, 7, 100, 100), (0, 5, 300, 100)), 300: mbr((0, 0x83, 1, 50), (0, 5, 20, 9)), 320: mbr((0, 0x83, 2, 5))}, "g": {0: mbr((0, 0xEE, 1, 3999)), 1: head, 2: body}, "raw": {}}
    for name, sectors in images.items():
        (tmp_path / name).write_bytes(disk(sectors)(0, 4000 * 512))
    (tmp_path / "short").write_bytes(b"abc")
    files = partitions.partition_tables(spark.createDataFrame([(n, str(tmp_path / n)) for n in [*images, "short"]], "image_id string, path string"))
    got = sorted(map(str, files.filter("image_id <> 'short'").collect()))
    assert got == sorted(map(str, partitions.tables_of_blocks(sectors_of(spark, images)).collect())) and len(got) == 6
    r = files.filter("image_id = 'a' and index = 6").first()
    assert (r.start_lba, r.end_offset, r.size_bytes, r.type_code, r.last_used_lba, r.disk_size_lba) == (322, 327 * 512 - 1, 5 * 512, "0x83", 350, 4000)
    assert files.filter("image_id in ('raw', 'short')").select("scheme", "start_lba", "last_used_lba").distinct().collect() == [("UNKNOWN", None, 0)]
    assert partitions.partition_tables(spark.createDataFrame([], "image_id string, path string")).count() == 0


def test_unusual_tables(spark, tmp_path):
    """Entries wider than a sector holds four of, an array far away or beyond the disk, entries over two sectors, a disk full of boot signatures, long chains and loops."""
    def laid(entries, size, at, count=None):
        head, body = gpt(entries, size, count)
        head = bytearray(head)
        struct.pack_into("<Q", head, 72, at)
        return {0: mbr((0, 0xEE, 1, 3999)), 1: bytes(head), at: body}

    many = [(100 + 10 * k, 105 + 10 * k, k % 8, f"part {k}") for k in range(100)]
    full = {k: b"\x55\xaa" * 256 for k in range(400)}
    chain = {0: mbr((0, 0x0F, 100, 900))} | {100 + k: mbr((0, 0x83, 1, 5 + k), (0, 0x05, k + 1, 9)) for k in range(70)}
    images = {
        "wide": laid(many, 512, 2), "odd": laid(many[:9], 200, 3), "far": laid(many, 128, 300), "gone": laid(many[:3], 128, 399), "lost": laid(many[:3], 128, 1 << 40), "most": laid(many, 128, 2, 300),
        "fill": full, "filled": full | {0: mbr((0, 5, 30, 60))}, "chain": chain, "loop": chain | {169: mbr((0, 0x83, 1, 5), (0, 0x05, 3, 9))}, "broken": chain | {130: b""}, "nobase": {0: mbr((0, 5, 3000, 60))},
        "empty entries": laid([(5, 3, 0, "no length"), (7, 7, 0, "none"), (0, 9, 0, "zero")], 128, 2), "no header": {0: mbr((0, 0xEE, 1, 9))},
    }
    for name, sectors in images.items():
        (tmp_path / name).write_bytes(disk(sectors, 400)(0, 400 * 512))
    tail = bytearray(disk(laid(many[:3], 128, 399), 400)(0, 400 * 512))[: 399 * 512 + 300]  # ends within the third entry
    (tmp_path / "cut").write_bytes(tail)
    rows = [("cut", k, bytes(tail[512 * k : 512 * k + 512])) for k in range(400)]
    blocks = sectors_of(spark, images, 400).filter("block_id < 400").unionByName(spark.createDataFrame(rows, "image_id string, block_id long, data binary"))
    files = partitions.partition_tables(spark.createDataFrame([(n, str(tmp_path / n)) for n in [*images, "cut"]], "image_id string, path string")).collect()
    got = partitions.tables_of_blocks(blocks)
    assert "InArrow" not in got._jdf.queryExecution().toString() and "InPandas" not in got._jdf.queryExecution().toString()
    got = got.collect()
    for name in [*images, "cut"]:
        assert sorted(map(str, (r for r in got if r.image_id == name))) == sorted(map(str, (r for r in files if r.image_id == name))), name
    count = lambda name: sum(r.image_id == name and r.start_lba is not None for r in got)
    assert [count(n) for n in ("wide", "far", "chain", "loop", "broken", "filled")] == [100, 100, 70, 70, 30, 1]


def test_offsets(spark):
    tables = partitions.tables_of_blocks(sectors_of(spark, {"a": {0: mbr((0, 7, 100, 100), (0, 7, 300, 100))}, "raw": {}}, 500))
    rows = [("a", 0), ("a", 250 * 512), ("a", 400 * 512 - 1), ("a", 400 * 512), ("raw", 5), ("none", 5)]
    got = {(r.image_id, r.offset): r.context for r in partitions.offset_context(spark.createDataFrame(rows, "image_id string, offset long"), tables).collect()}
    assert [got[k] for k in rows] == ["INSIDE_PARTITION"] * 3 + ["BEYOND_BOUNDARY", "UNKNOWN", "UNKNOWN"]


def test_custody_chain(spark):
    rows = [(s, i, f"t{i}", "SCAN_START", ["x", "", None][i % 3], custody.describe("SYSTEM_INIT", system="any", session_id=f"{s}-{i}")) for s in range(3) for i in range(6)]
    log = custody.chained(spark.createDataFrame(rows, "session_id long, sequence int, timestamp_utc string, event_type string, sha256_evidence string, description string"))
    assert all(r.is_intact and r.entries == 6 for r in custody.violations(log).collect())
    edited = log.withColumn("description", F.when((F.col("session_id") == 0) & (F.col("sequence") == 2), "no").otherwise(F.col("description")))
    edited = edited.withColumn("entry_hash", F.when((F.col("session_id") == 1) & (F.col("sequence") == 2), "0" * 64).otherwise(F.col("entry_hash")))
    edited = edited.filter("not (session_id = 2 and sequence = 5)")
    assert {r.session_id: r.violations for r in custody.violations(edited).collect()} == {0: 1, 1: 2, 2: 0}
    gone = log.filter("not (session_id = 0 and sequence = 3)")
    assert {r.session_id: r.violations for r in custody.violations(gone).collect()}[0] == 1


def test_adjacent_blank_hashes(spark):
    rows = [(s, i, f"t{i}", "SCAN_START", None, f"{s}-{i}") for s in range(5) for i in range(7)]
    log = custody.chained(spark.createDataFrame(rows, "session_id long, sequence int, timestamp_utc string, event_type string, sha256_evidence string, description string"))
    blank = {0: (2, 3), 1: (2, 3, 4), 2: (0, 1), 3: (5, 6)}  # session 4 stays whole
    for s, at in blank.items():
        lost = F.lit("") if s % 2 else F.lit(None)
        log = log.withColumn("entry_hash", F.when((F.col("session_id") == s) & F.col("sequence").isin(*at), lost).otherwise(F.col("entry_hash")))
    got = custody.verified(log)
    assert got.columns == [*log.columns, "expected_hash", "broken"]
    broken = {(r.session_id, r.sequence) for r in got.filter("broken").collect()}
    assert broken == {(s, i) for s, at in blank.items() for i in at}
    assert {r.session_id: r.violations for r in custody.violations(log).collect()} == {0: 2, 1: 3, 2: 2, 3: 2, 4: 0}


def test_custody_messages(spark):
    rows = [(s, i, f"t{i}", "SCAN_START", None, f"d{i}") for s in ("ok", "bad") for i in range(6)]
    log = custody.chained(spark.createDataFrame(rows, "session_id string, sequence int, timestamp_utc string, event_type string, sha256_evidence string, description string"))
    hurt = F.col("session_id") == "bad"
    log = log.withColumn("entry_hash", F.when(hurt & F.col("sequence").isin(1, 2), "").otherwise(F.col("entry_hash")))  # two blanks in a row
    log = log.withColumn("description", F.when(hurt & (F.col("sequence") == 4), "other").otherwise(F.col("description")))
    got = {r.session_id: r for r in custody.report_of(log).collect()}
    assert got["ok"].is_intact and got["ok"].messages == [] and not got["bad"].is_intact
    assert [m.split(" ")[1] for m in got["bad"].messages] == ["1", "2", "4"]
    assert custody.report_of(log.limit(0)).count() == 0


ENTRY = "session_id string, sequence long, timestamp_utc string, event_type string, sha256_evidence string, description string"


def test_appending(spark):
    rows = [(s, i, f"t{i:02d}", "SCAN_START", None, f"{s}{i}") for s in "abcd" for i in range(9)]
    entries = spark.createDataFrame(rows, ENTRY)
    whole = {(r.session_id, r.sequence): (r.prev_hash, r.entry_hash) for r in custody.chained(entries).collect()}
    log = custody.chained(entries.filter("sequence < 5 and session_id <> 'd'"))
    after = F.when(F.col("session_id") == "b", "another").when(F.col("session_id") == "d", custody.GENESIS).otherwise(F.col("last_hash"))
    new = entries.filter("sequence >= 5 or session_id = 'd'").join(custody.heads(log), "session_id", "left").withColumn("after", after).filter("not (session_id = 'c' and sequence = 5)")
    added, refused = custody.appended(new, log)
    assert {(r.session_id, r.sequence): (r.prev_hash, r.entry_hash) for r in added.collect()} == {k: v for k, v in whole.items() if k[0] == "d" or (k[0] == "a" and k[1] >= 5)}
    assert {r.session_id: r.reason for r in refused.collect()} == {"b": "the chain has another end", "c": "entries don't follow in sequence"}
    all_ = log.select(added.columns).unionByName(added)
    assert {r.session_id: r.is_intact for r in custody.violations(all_).collect()} == dict.fromkeys("abcd", True)
    document = json.loads(custody.saved(all_).filter("session_id = 'a'").first().document)
    assert document["chain_of_custody"] == {"session_id": "a", "custody_version": "1.0", "total_entries": 9, "genesis_hash": "GENESIS", "final_hash": whole["a", 8][1], "created_at": "t00", "last_updated": "t08"}
    assert [e["sequence"] for e in document["entries"]] == list(range(9))


def test_a_long_session_is_verified_in_many_tasks(spark):
    n = 1_000_000
    made = spark.range(n).selectExpr("'s' AS session_id", "id AS sequence", "cast(id AS string) AS timestamp_utc", "'E' AS event_type", "cast(null AS string) AS sha256_evidence", "concat('d', id) AS description")
    log = custody.chained(made)
    bad = F.col("sequence").isin(7, 65_535, 65_536, 500_000)
    log = log.withColumn("entry_hash", F.when(F.col("sequence").between(65_530, 65_540) | (F.col("sequence") == 3), F.lit(None)).otherwise(F.col("entry_hash"))).withColumn("description", F.when(bad, "edited").otherwise(F.col("description")))
    got = custody.verified(log).withColumn("task", F.spark_partition_id())
    broken = {r.sequence for r in got.filter("broken").collect()}
    assert broken == {3, 7, *range(65_530, 65_542), 500_000}
    per = [r.n for r in got.groupBy("task").agg(F.count("*").alias("n")).collect()]
    assert sum(per) == n and len(per) > 1 and max(per) < 0.6 * n

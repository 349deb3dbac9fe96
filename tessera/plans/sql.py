"""The catalogue's queries in DuckDB SQL, written apart from the operators, to hold their results against."""

from __future__ import annotations

from .synthetic import AT, DISK, LAYOUT, SECTOR

R = lambda n: " || ".join(f"upper(sha256(event_id::VARCHAR || ':{i}'))" for i in range(n))
TEXT = "substr(repeat(upper(hex(encode(event_type || ' ' || user_id::VARCHAR || '; '))), 80), 1, 1024)"

PLACED = "p AS (SELECT *, 'img' || (event_id // 5000)::VARCHAR AS image_id, event_id % 5000 AS block_id, event_id % 500 AS m FROM events)"

_IMG = f"""img AS (SELECT image_id, block_id, CASE
  WHEN m < 85 OR m BETWEEN 105 AND 124 THEN repeat('00', 512) WHEN m BETWEEN 127 AND 146 THEN repeat('FF', 512)
  WHEN m BETWEEN 150 AND 169 OR m % 11 = 0 THEN {R(16)} WHEN m BETWEEN 190 AND 209 THEN repeat('00', 384) || {R(4)}
  WHEN m BETWEEN 300 AND 319 THEN repeat('FF', 384) || {R(4)} WHEN m BETWEEN 330 AND 334 THEN repeat('00', 502) || substr({R(1)}, 1, 20)
  WHEN m BETWEEN 390 AND 459 THEN repeat('55AA', 256) WHEN m BETWEEN 470 AND 475 THEN repeat('00', 384) || repeat('0102', 64)
  WHEN m = 499 THEN substr({TEXT}, 1, 600) ELSE {TEXT} END AS hx FROM p)"""
_BYTES = """bt AS MATERIALIZED (SELECT image_id, block_id, i, length(hx) // 2 AS n, ('0x' || substr(hx, 2 * i + 1, 2))::INT AS b FROM img, range(512) t(i) WHERE 2 * i < length(hx)),
h AS MATERIALIZED (SELECT image_id, block_id, n, b, count(*) AS c FROM bt GROUP BY ALL)"""

IMAGES = f"{PLACED}, {_IMG}, {_BYTES}"
_STATS = """runs_ AS (SELECT image_id, block_id, string_agg(CASE WHEN b BETWEEN 32 AND 126 THEN 'P' ELSE 'N' END, '' ORDER BY i) AS pn,
  bool_or(i < 16 AND b IN (80,75,31,139,255,216,137,78,71,37,68,70,127,69,76,77,90,82,97,114,33,253,55,122,88,66,104)) AS magic FROM bt GROUP BY ALL),
bk AS (SELECT image_id, block_id, max(x) AS max_bucket FROM (SELECT image_id, block_id, b // 32 AS k, sum(c) / any_value(n) AS x FROM h GROUP BY ALL) GROUP BY ALL),
st AS MATERIALIZED (SELECT image_id, block_id, any_value(n) AS n, -sum(c / n * log2(c / n)) + 0.0 AS entropy, sqrt(greatest(sum((c / n) * (c / n)) - 1 / 256, 0) / 256) AS uniformity,
  coalesce(sum(c) FILTER (b = 0), 0) / any_value(n) AS zero_ratio, coalesce(sum(c) FILTER (b = 255), 0) / any_value(n) AS ff_ratio, arg_max(b, c * 1000 - b) AS dominant_byte, max(c) / any_value(n) AS dominant_pct,
  round(coalesce(log2(sum(c) FILTER (b <> 0)) - sum(c * log2(c)) FILTER (b <> 0) / sum(c) FILTER (b <> 0), 0), 6) + 0.0 AS entropy_nonzero,
  round(coalesce(log2(sum(c) FILTER (b <> 255)) - sum(c * log2(c)) FILTER (b <> 255) / sum(c) FILTER (b <> 255), 0), 6) + 0.0 AS entropy_nonff FROM h GROUP BY image_id, block_id),
s AS MATERIALIZED (SELECT st.*, magic, max_bucket, coalesce(list_max(list_transform(regexp_extract_all(pn, 'P+'), lambda x: length(x))), 0)::INT AS printable_run FROM st JOIN runs_ USING (image_id, block_id) JOIN bk USING (image_id, block_id)),
g AS (SELECT *, magic OR max_bucket > 0.35 OR printable_run >= 64 AS legit FROM s),
cl AS MATERIALIZED (SELECT *, CASE
  WHEN zero_ratio >= 0.9 AND entropy <= 0.2 THEN 'ZERO_WIPE' WHEN ff_ratio >= 0.9 AND entropy <= 0.2 THEN 'FF_WIPE'
  WHEN zero_ratio >= 0.6 AND zero_ratio < 0.9 THEN CASE WHEN entropy_nonzero > 3.5 THEN 'LIKELY_ZERO_WIPE' ELSE 'NORMAL' END
  WHEN ff_ratio >= 0.6 AND ff_ratio < 0.9 THEN CASE WHEN entropy_nonff > 3.5 THEN 'LIKELY_FF_WIPE' ELSE 'NORMAL' END
  WHEN entropy >= 7.6 THEN CASE WHEN uniformity <= 0.014 AND NOT legit THEN 'RANDOM_WIPE' ELSE 'NORMAL' END ELSE 'NORMAL' END AS wipe_type FROM g),
lb AS MATERIALIZED (SELECT *, wipe_type <> 'NORMAL' AS is_suspicious, CASE wipe_type
  WHEN 'ZERO_WIPE' THEN floor(least(0.55 + 0.28 * (zero_ratio - 0.9) / 0.1 + 0.17 * (1 - least(entropy / 0.5, 1)), 1) * 1000 + 0.5) / 1000
  WHEN 'FF_WIPE' THEN floor(least(0.55 + 0.28 * (ff_ratio - 0.9) / 0.1 + 0.17 * (1 - least(entropy / 0.5, 1)), 1) * 1000 + 0.5) / 1000 * 0.96
  WHEN 'LIKELY_ZERO_WIPE' THEN floor((0.40 + 0.32 * (zero_ratio - 0.6) / 0.3) * 1000 + 0.5) / 1000 WHEN 'LIKELY_FF_WIPE' THEN floor((0.40 + 0.32 * (ff_ratio - 0.6) / 0.3) * 1000 + 0.5) / 1000
  WHEN 'RANDOM_WIPE' THEN floor(least(0.58 + 0.22 * (entropy - 7.6) / 0.4 + 0.12 * (1 - least(uniformity / 0.014, 1)), 0.92) * 1000 + 0.5) / 1000
  ELSE CASE WHEN zero_ratio >= 0.6 AND zero_ratio < 0.9 OR ff_ratio >= 0.6 AND ff_ratio < 0.9 THEN 0.82 WHEN entropy >= 7.6 THEN CASE WHEN uniformity <= 0.014 THEN 0.72 ELSE 0.87 END
    WHEN entropy > 0.21 AND entropy <= 1.5 THEN 0.82 ELSE 0.90 END END AS confidence FROM cl)"""

STATS = f"{IMAGES}, {_STATS}"
#: The same for the images as files, whose short blocks are filled up, and for texts cut into blocks.
FILES = STATS.replace(f"substr({TEXT}, 1, 600)", f"rpad(substr({TEXT}, 1, 600), 1024, '0')")
_TEXTS = "img AS (SELECT image_id, i AS block_id, substr(hx, 1024 * i + 1, 1024) AS hx FROM (SELECT doc_id::VARCHAR AS image_id, hex(encode(text)) AS hx, unnest(range((length(hex(encode(text))) + 1023) // 1024)) AS i FROM documents))"
TEXTS = f"{_TEXTS}, {_BYTES}, {_STATS}"

LABEL = "CASE " + " ".join(f"WHEN m BETWEEN {a} AND {z} THEN '{t}'" for a, z, t in LAYOUT) + " ELSE 'NORMAL' END"
LABELLED = f"""{PLACED}, lab AS MATERIALIZED (SELECT image_id, block_id, {LABEL} AS wipe_type, ((event_id * 7919) % 8000) / 1000 AS entropy, 0.5 + ((event_id * 104729) % 500) / 1000 AS confidence, {LABEL} <> 'NORMAL' AS susp, event_id FROM p)"""

_W = "OVER (PARTITION BY image_id ORDER BY block_id)"
_F = "OVER (PARTITION BY image_id ORDER BY fb)"
RUNS = f"""{LABELLED}, r0 AS (SELECT *, CASE WHEN lag(susp) {_W} IS DISTINCT FROM susp THEN 1 ELSE 0 END AS new FROM lab), r1 AS MATERIALIZED (SELECT *, sum(new) {_W} AS run FROM r0),
dm AS (SELECT image_id, run, wipe_type, count(*) AS c, min(block_id) AS f FROM r1 WHERE susp GROUP BY ALL), dt AS (SELECT image_id, run, arg_max(wipe_type, c * 1000000 - f) AS dominant FROM dm GROUP BY ALL),
runs AS MATERIALIZED (SELECT r1.image_id, run, min(block_id) AS fb, max(block_id) AS lb, count(*) AS n, any_value(dominant) AS wipe_type FROM r1 JOIN dt USING (image_id, run) WHERE susp GROUP BY r1.image_id, run)"""
ABSORB = f"""{RUNS}, a0 AS (SELECT *, CASE WHEN lag(wipe_type) {_F} = wipe_type AND fb - lag(lb) {_F} - 1 <= 8 THEN 0 ELSE 1 END AS new, lag(lb) {_F} AS plb FROM runs), a1 AS (SELECT *, sum(new) {_F} AS grp FROM a0),
a2 AS (SELECT image_id, min(fb) AS fb, max(lb) AS lb, any_value(wipe_type) AS wipe_type, max(CASE WHEN new = 0 THEN plb + 1 END) AS g1, max(CASE WHEN new = 0 THEN fb - 1 END) AS g2 FROM a1 GROUP BY image_id, grp),
ab AS MATERIALIZED (SELECT a2.image_id, fb, lb, a2.wipe_type, count(*) AS block_count, count(*) FILTER (susp) AS n_susp, sum(entropy) AS fe, sum(confidence) AS fc,
  avg(entropy) FILTER (g1 IS NULL OR block_id < g1 OR block_id > g2) AS avg_entropy FROM a2 JOIN lab ON lab.image_id = a2.image_id AND block_id BETWEEN fb AND lb GROUP BY a2.image_id, fb, lb, a2.wipe_type)"""
_STRONG = "('ZERO_WIPE', 'FF_WIPE', 'RANDOM_WIPE', 'MULTI_PASS')"
_PART = "('LIKELY_ZERO_WIPE', 'LIKELY_FF_WIPE', 'LOW_ENTROPY_SUSPECT')"
BANDS = f"""{ABSORB}, sz AS (SELECT * FROM ab WHERE block_count >= 16), b0 AS (SELECT *, CASE WHEN fb - lag(lb) {_F} - 1 <= 4 AND wipe_type <> lag(wipe_type) {_F} AND wipe_type IN {_STRONG} AND lag(wipe_type) {_F} IN {_STRONG} THEN 0 ELSE 1 END AS new FROM sz),
b1 AS (SELECT *, sum(new) {_F} AS isl FROM b0), b2 AS (SELECT *, count(*) OVER (PARTITION BY image_id, isl) AS k FROM b1),
bd AS MATERIALIZED (SELECT image_id, fb, lb, wipe_type, block_count, n_susp, fe, fc, avg_entropy FROM b2 WHERE k < 3 UNION ALL
  SELECT image_id, min(fb), max(lb), 'MULTI_PASS', sum(block_count)::BIGINT, sum(n_susp)::BIGINT, sum(fe), sum(fc), sum(fe) / sum(block_count) FROM b2 WHERE k >= 3 GROUP BY image_id, isl)"""
SUPPRESS = f"""{BANDS}, su AS (SELECT x.*, x.wipe_type NOT IN {_PART} OR x.block_count >= 64 OR EXISTS (SELECT 1 FROM bd y WHERE y.image_id = x.image_id AND y.wipe_type IN {_STRONG} AND y.fb <> x.fb AND y.fb <= x.lb + 50 AND y.lb >= x.fb - 50) AS supported FROM bd x)"""
_ADJ = "CASE wipe_type WHEN 'FF_WIPE' THEN -0.02 WHEN 'RANDOM_WIPE' THEN -0.04 WHEN 'MULTI_PASS' THEN -0.08 WHEN 'LIKELY_ZERO_WIPE' THEN -0.12 WHEN 'LIKELY_FF_WIPE' THEN -0.12 WHEN 'LOW_ENTROPY_SUSPECT' THEN -0.15 ELSE 0 END"
MAPS = "mp AS (SELECT DISTINCT 'img' || (event_id // 5000)::VARCHAR AS image_id, CASE WHEN event_id // 5000 % 2 = 0 THEN 'MBR' ELSE 'UNKNOWN' END AS scheme, CASE WHEN event_id // 5000 % 2 = 0 THEN 2650 * 512 - 1 END AS last_end FROM events)"
REGIONS = f"""{SUPPRESS}, sc AS (SELECT *, floor(greatest(least(fc / block_count + 0.1 * least(block_count / 512, 1) + 0.1 * (n_susp / block_count - 0.5) + {_ADJ}, 1), 0) * 1000 + 0.5) / 1000 AS confidence0 FROM su WHERE supported), {MAPS},
bc AS (SELECT sc.*, CASE WHEN last_end IS NULL THEN 'UNKNOWN' WHEN fb * 512 > last_end OR ((lb + 1) * 512 - 1 - last_end) / ((lb + 1) * 512 - fb * 512) > 0.5 THEN 'BEYOND_BOUNDARY' ELSE 'INSIDE_PARTITION' END AS boundary_context FROM sc LEFT JOIN mp USING (image_id)),
rg AS MATERIALIZED (SELECT image_id, row_number() {_F} AS id, fb * 512 AS start, (lb + 1) * 512 - 1 AS "end", (lb - fb + 1) * 512 AS size, wipe_type AS type, avg_entropy AS entropy, block_count, n_susp, boundary_context,
  CASE boundary_context WHEN 'BEYOND_BOUNDARY' THEN floor(greatest(confidence0 - CASE WHEN wipe_type IN ('ZERO_WIPE', 'FF_WIPE') THEN 0.28 WHEN wipe_type IN {_PART} THEN 0.364 ELSE 0.14 END, 0.1) * 1000 + 0.5) / 1000
    WHEN 'INSIDE_PARTITION' THEN floor(least(confidence0 + 0.04, 1) * 1000 + 0.5) / 1000 ELSE confidence0 END AS confidence FROM bc)"""
_TYPES = ["ZERO_WIPE", "FF_WIPE", "RANDOM_WIPE", "MULTI_PASS", "LIKELY_ZERO_WIPE", "LIKELY_FF_WIPE", "LOW_ENTROPY_SUSPECT"]
_N = ", ".join(f"count(*) FILTER (wipe_type = '{t}') AS \"n_{t}\"" for t in _TYPES)
SCANNED = f"{FILES}, lab AS MATERIALIZED (SELECT image_id, block_id, wipe_type, entropy, confidence, is_suspicious AS susp FROM lb)"
BLOCKS_ = f"bs AS MATERIALIZED (SELECT image_id, count(*) AS total_blocks, count(*) FILTER (susp) AS suspicious_blocks, coalesce(avg(entropy) FILTER (susp), 0) AS avg_entropy_flagged, {_N} FROM lab GROUP BY image_id)"
_FILLS = "('ZERO_WIPE', 'FF_WIPE', 'LIKELY_ZERO_WIPE', 'LIKELY_FF_WIPE')"
SCORES = f"""{REGIONS}, {BLOCKS_}, ry AS (SELECT image_id, type, sum(block_count) AS b, min(id) AS i FROM rg GROUP BY ALL), rt AS (SELECT image_id, arg_max(type, b * 100000 - i) AS dominant_type FROM ry GROUP BY image_id),
rs AS (SELECT image_id, count(*) AS regions_count, count(*) FILTER (NOT (boundary_context = 'BEYOND_BOUNDARY' AND type IN {_FILLS})) AS effective, count(*) FILTER (boundary_context = 'BEYOND_BOUNDARY') AS beyond,
  coalesce(sum(n_susp) FILTER (boundary_context = 'BEYOND_BOUNDARY' AND type IN {_FILLS}), 0) AS excluded, count(*) FILTER (type = 'RANDOM_WIPE') AS rnd, count(*) FILTER (type = 'MULTI_PASS') AS mul, avg(confidence) AS mc, sum(block_count) AS rb,
  max(size) AS largest_region_size, arg_max(id, size * 100000 - id) AS largest_region_id, avg(size) AS avg_region_size, bool_or(boundary_context <> 'UNKNOWN') AS has_map FROM rg GROUP BY image_id),
t0 AS (SELECT *, (suspicious_blocks - excluded) / total_blocks AS adjusted_density FROM bs JOIN rs USING (image_id) JOIN rt USING (image_id)),
t1 AS (SELECT *, 40 * least(adjusted_density * 10, 1) + 20 * least(effective / 10, 1) + 25 * least(rnd / 3, 1) + 15 * least(mul / 2, 1) AS points,
  CASE WHEN suspicious_blocks > 0 AND "n_LIKELY_ZERO_WIPE" + "n_LIKELY_FF_WIPE" + "n_LOW_ENTROPY_SUSPECT" > "n_ZERO_WIPE" + "n_FF_WIPE" + "n_RANDOM_WIPE" + "n_MULTI_PASS" AND "n_ZERO_WIPE" + "n_FF_WIPE" + "n_RANDOM_WIPE" + "n_MULTI_PASS" < 10 THEN 10 ELSE 0 END
  + CASE WHEN mc < 0.55 THEN 5 ELSE 0 END + CASE WHEN has_map AND beyond / regions_count > 0.6 THEN 15 WHEN has_map AND beyond / regions_count > 0.3 THEN 7 ELSE 0 END AS penalty,
  CASE WHEN adjusted_density > 0.3 THEN 3 WHEN adjusted_density > 0.1 THEN 2 WHEN adjusted_density > 0.02 THEN 1 WHEN suspicious_blocks >= 2 THEN 1 ELSE 0 END AS floor_level FROM t0),
t2 AS (SELECT *, greatest(least(round_even(points - penalty, 0), 100), 0)::INT AS intent_score FROM t1),
t3 AS MATERIALIZED (SELECT *, ['NEGLIGIBLE', 'LOW', 'MEDIUM', 'HIGH'][greatest(floor_level, CASE WHEN intent_score >= 70 THEN 3 WHEN intent_score >= 35 THEN 2 WHEN intent_score >= 10 THEN 1 ELSE 0 END) + 1] AS verdict, 100 * rb / total_blocks AS coverage_pct FROM t2)"""
#: Regions and scores of the scanned files.
SCAN_REGIONS, SCAN_SCORES = (x.replace(LABELLED, SCANNED) for x in (REGIONS, SCORES))

ENTRIES = """e AS MATERIALIZED (SELECT event_id // 20 AS session_id, event_id % 20 AS sequence, '2024-01-01T00:00:' || lpad((event_id % 20)::VARCHAR, 2, '0') || 'Z' AS ts, upper(event_type) AS et,
  CASE event_id % 4 WHEN 0 THEN sha256(event_id::VARCHAR) ELSE 'NULL' END AS sha, 'user ' || user_id::VARCHAR || ' did ' || event_type AS d FROM events)"""
CHAIN = f"""WITH RECURSIVE {ENTRIES}, ch AS (SELECT session_id, sequence, ts, et, sha, d, 'GENESIS' AS prev_hash, sha256('GENESIS|' || ts || '|' || et || '|' || sha || '|' || d) AS entry_hash FROM e WHERE sequence = 0
  UNION ALL SELECT e.session_id, e.sequence, e.ts, e.et, e.sha, e.d, ch.entry_hash, sha256(ch.entry_hash || '|' || e.ts || '|' || e.et || '|' || e.sha || '|' || e.d) FROM ch JOIN e ON e.session_id = ch.session_id AND e.sequence = ch.sequence + 1)"""

_B = lambda hx, at, n: "('0x' || " + " || ".join(f"substr({hx}, 2 * ({at} + {i}) + 1, 2)" for i in reversed(range(n))) + ")::BIGINT"
_SLOT = lambda i: f"{_B('hx', f'446 + 16 * {i}', 1)} AS status, {_B('hx', f'450 + 16 * {i}', 1)} AS kind, {_B('hx', f'454 + 16 * {i}', 4)} AS first, {_B('hx', f'458 + 16 * {i}', 4)} AS n"
_CHAIN = f"{_B('hx', '450', 1)} AS kind, {_B('hx', '454', 4)} AS first, {_B('hx', '458', 4)} AS n, {_B('hx', '466', 1)} AS link, {_B('hx', '470', 4)} AS step"
#: Partition tables of the disks, parsed from their bytes: pt has all partitions, mp a row for each disk.
DISKS = f"""RECURSIVE dk AS MATERIALIZED (SELECT {DISK} AS d, {AT} AS s, coalesce({SECTOR}, repeat('00', 512)) AS hx FROM events),
rec AS MATERIALIZED (SELECT d, s, hx FROM dk WHERE substr(hx, 1021, 4) = '55AA'), boot AS (SELECT d, hx FROM rec WHERE s = 0),
sl AS (SELECT d, i, {_SLOT('i')} FROM boot, range(4) t(i)), pr AS (SELECT * FROM sl WHERE kind > 0 AND first > 0 AND n > 0),
gd AS (SELECT boot.d, coalesce(bool_or(kind = 238), false) AS guard FROM boot LEFT JOIN pr USING (d) GROUP BY boot.d),
gh AS (SELECT d, {_B('hx', '72', 8)} AS tab, {_B('hx', '80', 4)} AS cnt, {_B('hx', '84', 4)} AS size FROM dk WHERE s = 1 AND substr(hx, 1, 16) = '4546492050415254'),
ge AS (SELECT gh.d, i, substr(hx, (i * size % 512) * 2 + 1, 256) AS hx FROM gh, range(256) t(i), dk WHERE size >= 128 AND i < cnt AND dk.d = gh.d AND dk.s = tab + i * size // 512),
gv AS (SELECT d, i, {_B('hx', '32', 8)} AS first, {_B('hx', '40', 8)} AS last, {_B('hx', '48', 8)} AS flags, rtrim(decode(unhex(regexp_replace(substr(hx, 113, 144), '(..)00', '\\1', 'g'))), chr(0)) AS nm
  FROM ge WHERE d IN (SELECT d FROM boot) AND substr(hx, 1, 32) <> repeat('00', 16)),
gp AS (SELECT d, row_number() OVER (PARTITION BY d ORDER BY i) - 1 AS idx, first, last, flags, CASE WHEN nm = '' THEN 'Unknown' ELSE nm END AS nm FROM gv WHERE first > 0 AND first < last),
sc AS (SELECT gd.d, CASE WHEN gd.d IN (SELECT d FROM gp) THEN CASE WHEN guard THEN 'GPT' ELSE 'HYBRID' END ELSE 'MBR' END AS scheme, guard FROM gd),
main AS (SELECT pr.* FROM pr JOIN sc USING (d) WHERE scheme = 'MBR' AND kind NOT IN (5, 15, 133)),
con AS (SELECT d, arg_max(first, i) AS base FROM pr WHERE kind IN (5, 15, 133) GROUP BY d),
ch AS (SELECT d, base, base AS s, [base] AS seen, {_CHAIN} FROM con JOIN rec USING (d) WHERE rec.s = base
  UNION ALL SELECT c.d, c.base, r.s, list_append(c.seen, r.s), {_CHAIN.replace("hx", "r.hx")} FROM ch c JOIN rec r ON r.d = c.d AND r.s = c.base + c.step WHERE c.link IN (5, 15, 133) AND c.step > 0 AND NOT list_contains(c.seen, r.s)),
lg AS (SELECT ch.d, 4 + (SELECT count(*) FROM main m WHERE m.d = ch.d) + row_number() OVER (PARTITION BY ch.d ORDER BY len(seen)) - 1 AS idx, s + first AS first, n, kind FROM ch WHERE kind > 0 AND n > 0),
pt AS (SELECT d, 'MBR' AS scheme, i AS idx, first, first + n - 1 AS last, kind, status = 128 AS boot, NULL::VARCHAR AS nm FROM main UNION ALL SELECT d, 'MBR', idx, first, first + n - 1, kind, false, NULL::VARCHAR FROM lg
  UNION ALL SELECT d, CASE WHEN guard THEN 'GPT' ELSE 'HYBRID' END, idx, first, last, 255, flags & 4 = 4, nm FROM gp JOIN sc USING (d)),
mp AS (SELECT x.d, coalesce(any_value(sc.scheme), 'UNKNOWN') AS scheme, count(pt.d) AS partitions, coalesce(max(last), 0) AS last_used_lba, any_value(size) AS disk_size_lba
  FROM (SELECT d, sum(length(hx)) // 1024 AS size FROM dk GROUP BY d) x LEFT JOIN sc USING (d) LEFT JOIN pt USING (d) GROUP BY x.d)"""
#: What is wrong with them, in order; for DISKS.
PART_ERRORS = """lost AS (SELECT con.d, base AS target FROM con JOIN sc USING (d) WHERE scheme = 'MBR' AND NOT EXISTS (SELECT 1 FROM rec r WHERE r.d = con.d AND r.s = base)
  UNION ALL SELECT ch.d, base + step FROM ch JOIN sc USING (d) WHERE scheme = 'MBR' AND link IN (5, 15, 133) AND step > 0 AND NOT EXISTS (SELECT 1 FROM rec r WHERE r.d = ch.d AND r.s = ch.base + ch.step)),
er AS (SELECT d, 0 AS o, i, 'entry ' || i || ': status byte 0x' || lpad(upper(hex(status)), 2, '0') AS t FROM sl WHERE status NOT IN (0, 128)
  UNION ALL SELECT d, 1, 0, 'no GPT header' FROM gd WHERE guard AND d NOT IN (SELECT d FROM gh)
  UNION ALL SELECT d, 2, 0, 'GPT entries of ' || size || ' bytes' FROM gh JOIN gd USING (d) WHERE size < 128
  UNION ALL SELECT d, 3, i, 'GPT entry ' || i || ' has no length' FROM gv WHERE first > 0 AND last > 0 AND first >= last
  UNION ALL SELECT d, 4, 0, 'no partition in the GPT, the boot record''s entries count' FROM sc WHERE scheme = 'MBR' AND (guard OR d IN (SELECT d FROM gh))
  UNION ALL SELECT d, 5, 0, 'no boot record at sector ' || target FROM lost
  UNION ALL SELECT d, 6, 0, 'no entry in the boot record' FROM sc WHERE scheme = 'MBR' AND d NOT IN (SELECT d FROM pt)
  UNION ALL SELECT DISTINCT d, 7, 0, 'no boot signature' FROM dk WHERE d NOT IN (SELECT d FROM boot))"""
PARTS = """SELECT 'disk' || d::VARCHAR AS image_id, scheme, idx::INT AS "index", first AS start_lba, last AS end_lba, last - first + 1 AS sector_count, kind::INT AS part_type,
  coalesce(nm, CASE kind WHEN 7 THEN 'NTFS / exFAT / HPFS' WHEN 11 THEN 'FAT32 (CHS)' WHEN 131 THEN 'Linux' WHEN 238 THEN 'GPT Protective MBR' WHEN 255 THEN 'Unknown' ELSE 'Unknown (0x' || upper(hex(kind)) || ')' END) AS type_name,
  boot AS is_bootable, first * 512 AS start_offset, (last + 1) * 512 - 1 AS end_offset, '0x' || lower(ltrim(hex(kind), '0')) AS type_code FROM pt"""


# Written out apart from the operators, which must give the same.
TOOLS = """CASE basis WHEN 'multi' THEN 'Blancco; DBAN (Gutmann/DoD mode); Eraser; shred -n 3+' WHEN 'random and zero' THEN 'DoD 5220.22-M wiper; sdelete -p; shred (multi-pass)'
  WHEN 'random' THEN 'Eraser (random pass); dd if=/dev/urandom; shred; srm' WHEN 'zero' THEN 'TRIM; cipher /w:; dd if=/dev/zero; sdelete -z'
  WHEN 'ff' THEN 'Flash memory erase; firmware wipe; hdparm --security-erase' ELSE '' END"""
TYPE_TOOLS = """CASE type WHEN 'ZERO_WIPE' THEN 'Windows format /P:1; cipher /w:; dd (if=/dev/zero); sdelete -z' WHEN 'FF_WIPE' THEN 'Flash erase; dd (if=/dev/urandom truncated); hdparm --security-erase'
  WHEN 'RANDOM_WIPE' THEN 'DBAN random pass; Eraser; dd (if=/dev/urandom); sdelete -p; shred; srm' WHEN 'MULTI_PASS' THEN 'Blancco; DBAN Gutmann (35-pass); DoD 5220.22-M (7-pass); Eraser Gutmann; shred -n 3/7'
  WHEN 'LIKELY_ZERO_WIPE' THEN 'Interrupted zero-fill; Partial wipe; TRIM-affected sectors' WHEN 'LIKELY_FF_WIPE' THEN 'Flash device residue; Interrupted FF-fill' ELSE 'Unknown' END"""
TITLES = """CASE verdict WHEN 'HIGH' THEN ['Preserve and Isolate Evidence', 'Assign Qualified Forensic Examiner', 'Filesystem Metadata Carving', 'Timeline Correlation', 'Network and Cloud Artefact Review']
  WHEN 'MEDIUM' THEN ['Manual Region Verification', 'Filesystem Metadata Correlation', 'Selective vs Full-Disk Assessment', 'Expanded Image Acquisition']
  WHEN 'LOW' THEN ['Supplementary Manual Review', 'Alternative Explanation Assessment', 'Contextual Investigation'] ELSE ['No Immediate Forensic Action Required', 'Retain Image for Reference'] END"""


def with_(parts: str, select: str) -> str:
    return f"WITH {parts} {select}"

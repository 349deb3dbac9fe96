"""The registered queries of the block operators, and the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blockstats import with_features, with_statistics
from ..functions.labels import entropy_meaning, size_text
from ..functions.registered import register
from ..operators import blocks, custody, ml, partitions, regions, report, scoring
from ..sources.blockimage import blocks_of_text, read_images, write_images
from ..sources.ranges import image_hashes as hashes_of_images
from ..sources.ranges import reread
from ..sources.sinks import shared_folder, written
from . import sql, synthetic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEYS = ["image_id", "block_id"]


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _blocks(spark, sf_dir) -> DataFrame:
    return synthetic.images(events(spark, sf_dir))


def _stats(spark, sf_dir) -> DataFrame:
    return with_statistics(_blocks(spark, sf_dir))


def _labelled(spark, sf_dir) -> DataFrame:
    return synthetic.labelled(events(spark, sf_dir))


def _bands(spark, sf_dir) -> DataFrame:
    return regions.bands(regions.sized(regions.absorb(regions.runs(_labelled(spark, sf_dir)))))


def _regions(spark, sf_dir) -> DataFrame:
    return regions.aggregate(_labelled(spark, sf_dir), synthetic.maps(events(spark, sf_dir)))


def _scores(spark, sf_dir) -> DataFrame:
    return scoring.score(_labelled(spark, sf_dir), _regions(spark, sf_dir))


def r6(c: str, alias: str | None = None):
    return (F.round(c, 6) + 0.0).alias(alias or c)


def _images(spark, sf_dir) -> DataFrame:
    """The images as files, read through the image source."""
    return read_images(spark, _folder(spark, sf_dir))


def _folder(spark, sf_dir) -> str:
    """The images as files in the shared folder, short blocks filled up with zeros."""
    folder = shared_folder(spark, "images")
    write_images(_blocks(spark, sf_dir).withColumn("data", F.expr("rpad(data, 512, X'00')")), folder)
    return folder


_BYTES = "SELECT image_id, block_id, block_id * 512 AS \"offset\", 512::BIGINT AS n_bytes, sha256(unhex(rpad(hx, 1024, '0'))) AS sha256 FROM img"


def _hashed(b: DataFrame) -> DataFrame:
    return b.select(*KEYS, "offset", F.length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha256"))


@query(sql.with_(sql.IMAGES, _BYTES))
def image_scan(spark, sf_dir):
    """Every block of the image files."""
    return _hashed(_images(spark, sf_dir))


@query(sql.with_(sql.IMAGES, f"{_BYTES} WHERE block_id BETWEEN 480 AND 519"))
def image_range(spark, sf_dir):
    """A range of blocks; the range is the operator's, and is pushed down to the byte ranges that are read."""
    return _hashed(_images(spark, sf_dir).filter("block_id between 480 and 519"))


@query(sql.with_(sql.IMAGES, f"{_BYTES} WHERE block_id = 499 AND image_id = 'img0'"))
def image_block(spark, sf_dir):
    """One block of one image, whose bytes alone are read."""
    return _hashed(_images(spark, sf_dir).filter("block_id = 499 and image_id = 'img0'"))


_S = lambda cols: sql.with_(sql.STATS, f"SELECT image_id, block_id, {cols} FROM lb")


@query(sql.with_(sql.IMAGES, "SELECT image_id, block_id, b AS byte, c AS cnt FROM h"))
def byte_histogram(spark, sf_dir):
    return blocks.byte_histogram(_blocks(spark, sf_dir))


@query(_S("round(entropy, 6) + 0.0 AS entropy"))
def block_entropy(spark, sf_dir):
    return _stats(spark, sf_dir).select(*KEYS, r6("entropy"))


@query(_S("round(uniformity, 6) AS uniformity"))
def block_uniformity(spark, sf_dir):
    return _stats(spark, sf_dir).select(*KEYS, r6("uniformity"))


@query(_S("round(zero_ratio, 6) AS zero_ratio, round(ff_ratio, 6) AS ff_ratio"))
def fill_ratios(spark, sf_dir):
    return _stats(spark, sf_dir).select(*KEYS, r6("zero_ratio"), r6("ff_ratio"))


@query(_S("dominant_byte, round(dominant_pct, 6) AS dominant_pct"))
def dominant_byte(spark, sf_dir):
    return _stats(spark, sf_dir).select(*KEYS, "dominant_byte", r6("dominant_pct"))


@query(_S("entropy_nonzero, entropy_nonff"))
def nonfill_entropy(spark, sf_dir):
    return _stats(spark, sf_dir).select(*KEYS, r6("entropy_nonzero"), r6("entropy_nonff"))


@query(_S("round(max_bucket, 6) AS max_bucket, max_bucket > 0.35 AS clustered"))
def bucket_clustering(spark, sf_dir):
    return _stats(spark, sf_dir).select(*KEYS, r6("max_bucket"), (F.col("max_bucket") > 0.35).alias("clustered"))


@query(_S("magic"))
def magic_prefix(spark, sf_dir):
    return _stats(spark, sf_dir).select(*KEYS, "magic")


@query(_S("printable_run"))
def printable_run(spark, sf_dir):
    return _stats(spark, sf_dir).select(*KEYS, "printable_run")


@query(_S("legit AS legitimate"))
def legitimate_structure(spark, sf_dir):
    return _stats(spark, sf_dir).select(*KEYS, F.col("legit").alias("legitimate"))


@query(_S("wipe_type, is_suspicious"))
def classify_blocks(spark, sf_dir):
    return blocks.classify(_blocks(spark, sf_dir)).select(*KEYS, "wipe_type", "is_suspicious")


@query(_S("wipe_type, round(confidence, 4) AS confidence"))
def block_confidence(spark, sf_dir):
    return blocks.classify(_blocks(spark, sf_dir)).select(*KEYS, "wipe_type", F.round("confidence", 4).alias("confidence"))


@query(sql.with_(sql.STATS, "SELECT wipe_type, count(*) AS blocks, round(avg(entropy), 6) AS avg_entropy FROM lb GROUP BY wipe_type"))
def labels_by_type(spark, sf_dir):
    """The flagship: images to labels to a summary by label."""
    return blocks.classify(_blocks(spark, sf_dir)).groupBy("wipe_type").agg(F.count("*").alias("blocks"), F.round(F.avg("entropy"), 6).alias("avg_entropy"))


@query(
    "SELECT doc_id::VARCHAR AS image_id, i AS block_id, count(*) OVER (PARTITION BY doc_id) AS blocks_of_image, least(512, octet_length(encode(text)) - 512 * i) AS n_bytes"
    " FROM documents, range(100000) t(i) WHERE i * 512 < octet_length(encode(text))"
)
def text_blocks(spark, sf_dir):
    b = blocks_of_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    size = b.groupBy("image_id").agg(F.count("*").alias("blocks_of_image"))
    return b.join(size, "image_id").select("image_id", "block_id", "blocks_of_image", F.length("data").cast("long").alias("n_bytes"))


@query(sql.with_(sql.TEXTS, "SELECT wipe_type, count(*) AS blocks FROM lb GROUP BY wipe_type"))
def text_block_labels(spark, sf_dir):
    return blocks.classify(blocks_of_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))).groupBy("wipe_type").agg(F.count("*").alias("blocks"))


def _scanned(images: DataFrame) -> DataFrame:
    """Labels of the blocks of images; several steps need them, so they are a table."""
    return written(blocks.classify(images).select(*KEYS, "offset", "wipe_type", "entropy", "confidence", "is_suspicious"), "labels")


@query(sql.with_(f"{sql.SCANNED}, nb AS (SELECT *, max(susp::INT) OVER (PARTITION BY image_id ORDER BY block_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM lab)", f"{_BYTES} JOIN nb USING (image_id, block_id) WHERE near = 1"))
def rescan_candidates(spark, sf_dir):
    """The candidates of a scan of image files, read again by seeks to their byte ranges."""
    folder = _folder(spark, sf_dir)
    return _hashed(reread(spark, blocks.candidates(_scanned(read_images(spark, folder))), folder))


@query(sql.with_(sql.IMAGES, "SELECT image_id, count(*) * 512 AS n_bytes, sha256(unhex(string_agg(rpad(hx, 1024, '0'), '' ORDER BY block_id))) AS sha256 FROM img GROUP BY image_id"))
def image_hashes(spark, sf_dir):
    """The hash of each image's files, one task an image."""
    return hashes_of_images(spark, _folder(spark, sf_dir))


def _scan(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Labels and regions of the image files."""
    labels = _scanned(_images(spark, sf_dir))
    return labels, regions.aggregate(labels, synthetic.maps(events(spark, sf_dir)))


@query(sql.with_(sql.SCAN_REGIONS, 'SELECT image_id, id, start, "end", type, round(entropy, 6) AS entropy, round(confidence, 3) AS confidence, block_count, boundary_context FROM rg'))
def scan_regions(spark, sf_dir):
    """From the bytes of image files to regions."""
    _, found = _scan(spark, sf_dir)
    return found.select("image_id", "id", "start", "end", "type", r6("entropy"), F.round("confidence", 3).alias("confidence"), "block_count", "boundary_context")


@query(sql.with_(sql.SCAN_SCORES, "SELECT image_id, total_blocks, suspicious_blocks, intent_score, verdict, regions_count, dominant_type FROM t3"))
def scan_verdict(spark, sf_dir):
    """From the bytes of image files to scores."""
    return scoring.score(*_scan(spark, sf_dir)).select("image_id", "total_blocks", "suspicious_blocks", "intent_score", "verdict", "regions_count", "dominant_type")


@query(sql.with_(sql.SCAN_SCORES, """SELECT image_id, intent_score, verdict, regions_count AS regions_found, (SELECT arg_max(t, n * 10 - i) FROM (SELECT unnest(['ZERO_WIPE', 'FF_WIPE', 'RANDOM_WIPE', 'MULTI_PASS']) AS t, unnest(["n_ZERO_WIPE", "n_FF_WIPE", "n_RANDOM_WIPE", "n_MULTI_PASS"]) AS n, unnest([0, 1, 2, 3]) AS i)) AS dominant_type,
"n_MULTI_PASS" > 0 AS has_multi_pass, "n_RANDOM_WIPE" > 0 AS has_random_wipe FROM t3"""))
def scan_report(spark, sf_dir):
    """From the bytes of image files to reports; the metrics of each, read back from its JSON."""
    labels, found = _scan(spark, sf_dir)
    d = report.documents(scoring.score(labels, found), found)
    kind = "struct<intent_score:int,verdict:string,regions_found:long,dominant_type:string,has_multi_pass:boolean,has_random_wipe:boolean>"
    return d.select("image_id", F.from_json(F.get_json_object("report", "$.metrics"), kind).alias("r")).select("image_id", "r.*")


@query(sql.with_(sql.TEXTS, "SELECT image_id, block_id, octet_length(unhex(hx)) AS n_bytes, round(entropy, 5) + 0.0 AS entropy FROM img JOIN lb USING (image_id, block_id)"))
def registered_functions(spark, sf_dir):
    """Texts as blocks by the registered functions, in SQL."""
    register(spark)
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("tessera_documents")
    return spark.sql(
        "SELECT cast(d.doc_id AS string) AS image_id, b.block_id, cast(length(b.data) AS bigint) AS n_bytes, round(block_entropy(b.data), 5) + 0.0 AS entropy"
        " FROM tessera_documents d, LATERAL split_blocks(encode(d.text, 'UTF-8'), 512) b"
    )


_FE = """sub AS (SELECT image_id, block_id, n, i, b FROM bt), ent AS (SELECT image_id, block_id, part, -sum(c / t * log2(c / t)) + 0.0 AS e FROM (
  SELECT *, sum(c) OVER (PARTITION BY image_id, block_id, part) AS t FROM (SELECT image_id, block_id, part, b, count(*) AS c FROM (
    SELECT image_id, block_id, b, unnest(list_filter(['all', CASE WHEN i < 128 THEN 'head' END, CASE WHEN i >= n - 128 THEN 'tail' END, CASE WHEN i % 2 = 0 THEN 'even' ELSE 'odd' END], lambda x: x IS NOT NULL)) AS part FROM sub) GROUP BY ALL)) GROUP BY ALL)"""


def _features(spark, sf_dir, names: dict[str, int]) -> DataFrame:
    x = with_features(_blocks(spark, sf_dir), list(names.values()))
    return x.select(*KEYS, *((F.round(F.col("features")[i], 5) + 0.0).alias(n) for n, i in names.items()))


@query(
    sql.with_(
        f"{sql.IMAGES}, {_FE}, w AS (PIVOT ent ON part IN ('all', 'head', 'tail', 'even', 'odd') USING first(e) GROUP BY image_id, block_id)",
        'SELECT image_id, block_id, round("all" / 8, 5) + 0.0 AS f01, round(abs(8 - "all") / 8, 5) + 0.0 AS f04, round(head / 8, 5) + 0.0 AS f26, round(tail / 8, 5) + 0.0 AS f27,'
        " round(abs(head / 8 - tail / 8), 5) + 0.0 AS f28, round(even / 8, 5) + 0.0 AS f29, round(odd / 8, 5) + 0.0 AS f30 FROM w",
    )
)
def entropy_features(spark, sf_dir):
    return _features(spark, sf_dir, {"f01": 0, "f04": 3, "f26": 25, "f27": 26, "f28": 27, "f29": 28, "f30": 29})


@query(
    sql.with_(
        f"""{sql.IMAGES}, fr AS (SELECT image_id, block_id, any_value(n) AS n, list_reverse_sort(list(c / n)) AS f, sqrt(greatest(sum((c / n) * (c / n)) - 1 / 256, 0) / 256) AS u, max(c / n) AS top, count(*) AS kinds,
        coalesce(sum(c / n) FILTER (b = 0), 0) AS f00, coalesce(sum(c / n) FILTER (b = 255), 0) AS fff, coalesce(sum(c / n) FILTER (b < 32), 0) AS lo, coalesce(sum(c / n) FILTER (b BETWEEN 128 AND 159), 0) AS mid FROM h GROUP BY image_id, block_id),
        rg AS (SELECT image_id, block_id, (max(b) - min(b)) / 255 AS spread FROM bt GROUP BY ALL)""",
        """SELECT image_id, block_id, round(least(u / 0.06, 1), 5) AS f02, round(least(16384 * u * u, 1), 5) AS f03, round(least(list_sum(f[1:8]) / 0.25, 1), 5) AS f05,
        round(least(CASE WHEN kinds < 249 THEN 0 ELSE list_sum(f[249:256]) END / 0.03, 1), 5) AS f06, round(top, 5) AS f07, round(kinds / 256, 5) AS f08, round(spread, 5) AS f09,
        round(f00, 5) AS f22, round(fff, 5) AS f23, round(least(lo / 0.375, 1), 5) AS f24, round(least(mid / 0.375, 1), 5) AS f25 FROM fr JOIN rg USING (image_id, block_id)""",
    )
)
def shape_features(spark, sf_dir):
    return _features(spark, sf_dir, {"f02": 1, "f03": 2, "f05": 4, "f06": 5, "f07": 6, "f08": 7, "f09": 8, "f22": 21, "f23": 22, "f24": 23, "f25": 24})


@query(
    sql.with_(
        f"""{sql.IMAGES}, sq AS (SELECT image_id, block_id, i, b, lead(b) OVER w AS b1, lead(b, 2) OVER w AS b2 FROM bt WINDOW w AS (PARTITION BY image_id, block_id ORDER BY i)),
        co AS (SELECT image_id, block_id, CASE WHEN var_pop(b) FILTER (b1 IS NOT NULL) * var_pop(b1) > 0 THEN abs(covar_pop(b, b1) / sqrt(var_pop(b) FILTER (b1 IS NOT NULL) * var_pop(b1))) ELSE 0 END AS c1,
        CASE WHEN var_pop(b) FILTER (b2 IS NOT NULL) * var_pop(b2) > 0 THEN abs(covar_pop(b, b2) / sqrt(var_pop(b) FILTER (b2 IS NOT NULL) * var_pop(b2))) ELSE 0 END AS c2,
        avg((b = b1)::INT) AS p2, avg((b = b1 AND b1 = b2)::INT) FILTER (b2 IS NOT NULL) AS p3 FROM sq GROUP BY ALL)""",
        "SELECT image_id, block_id, round(c1, 5) AS f10, round(c2, 5) AS f11, round(least(p2 / 0.05, 1), 5) AS f12, round(least(p3 / 0.01, 1), 5) AS f13 FROM co",
    )
)
def serial_features(spark, sf_dir):
    return _features(spark, sf_dir, {"f10": 9, "f11": 10, "f12": 11, "f13": 12})


@query(
    sql.with_(
        f"""{sql.IMAGES}, en AS (SELECT image_id, block_id, k, sum(CASE WHEN i // st = k THEN (b / 255) * (b / 255) ELSE 0 END) / count(*) FILTER (i // st = k) + 1e-10 AS e FROM
        (SELECT *, greatest(n // 16, 1) AS st FROM bt) x, range(16) t(k) WHERE i // st = k GROUP BY ALL), sp AS (SELECT image_id, block_id, exp(avg(ln(e))) / avg(e) AS f16, sum(e) + 1e-10 AS t, sum(e) FILTER (k < 4) AS a, sum(e) FILTER (k BETWEEN 4 AND 11) AS b, sum(e) FILTER (k > 11) AS c FROM en GROUP BY ALL)""",
        "SELECT image_id, block_id, round(least(f16, 1), 5) AS f16, round(a / t, 5) AS f17, round(b / t, 5) AS f18, round(c / t, 5) AS f19 FROM sp",
    )
)
def spectral_features(spark, sf_dir):
    return _features(spark, sf_dir, {"f16": 15, "f17": 16, "f18": 17, "f19": 18})


@query(
    sql.with_(
        f"""{sql.IMAGES}, sq AS (SELECT image_id, block_id, i, b, any_value(n) OVER (PARTITION BY image_id, block_id) AS n, lag(b) OVER w AS b0 FROM bt WINDOW w AS (PARTITION BY image_id, block_id ORDER BY i)),
        gr AS (SELECT *, sum(CASE WHEN b0 IS NULL OR b0 <> b THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, block_id ORDER BY i) AS g, sum(CASE WHEN b0 IS NULL OR (b0 BETWEEN 32 AND 126) <> (b BETWEEN 32 AND 126) THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, block_id ORDER BY i) AS p FROM sq),
        rn AS (SELECT image_id, block_id, max(c) AS longest, count(*) AS runs, sum(c) AS n FROM (SELECT image_id, block_id, g, count(*) AS c FROM gr GROUP BY ALL) GROUP BY ALL),
        pr AS (SELECT image_id, block_id, coalesce(max(c) FILTER (t), 0) AS printable FROM (SELECT image_id, block_id, p, count(*) AS c, any_value(b BETWEEN 32 AND 126) AS t FROM gr GROUP BY ALL) GROUP BY ALL),
        mg AS (SELECT image_id, block_id, bool_or(i < 16 AND b IN (80, 75, 31, 139, 255, 216, 137, 37, 127, 69, 77, 90, 82, 97, 253, 55, 66)) AS magic FROM bt GROUP BY ALL)""",
        "SELECT image_id, block_id, round(least(n / runs / 8, 1), 5) AS f14, round(least(longest / 50, 1), 5) AS f15, round(least(printable / 128, 1), 5) AS f20, magic::INT::DOUBLE AS f21 FROM rn JOIN pr USING (image_id, block_id) JOIN mg USING (image_id, block_id)",
    )
)
def run_features(spark, sf_dir):
    return _features(spark, sf_dir, {"f14": 13, "f15": 14, "f20": 19, "f21": 20})


_NEAR = f"""{sql.LABELLED}, nb AS (SELECT *, max(susp::INT) OVER (PARTITION BY image_id ORDER BY block_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM lab)"""


@query(sql.with_(_NEAR, "SELECT image_id, block_id, wipe_type FROM nb WHERE near = 1"))
def neighbour_window(spark, sf_dir):
    return blocks.candidates(_labelled(spark, sf_dir)).select(*KEYS, "wipe_type")


@query(
    sql.with_(
        _NEAR + ", ct AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS k, row_number() OVER (PARTITION BY image_id, susp ORDER BY block_id) AS rn FROM nb WHERE near = 1)",
        "SELECT image_id, block_id, wipe_type FROM ct WHERE k <= 50000 OR susp AND rn <= 50000",
    )
)
def candidate_cap(spark, sf_dir):
    return blocks.capped_candidates(_labelled(spark, sf_dir)).select(*KEYS, "wipe_type")


_ML = f"""{sql.LABELLED}, pr AS (SELECT image_id, block_id, ['RANDOM_WIPE', 'NORMAL', 'ZERO_WIPE', 'FF_WIPE', 'MULTI_PASS'][(event_id // 3) % 5 + 1] AS ml, 0.4 + ((event_id * 31) % 60) / 100 AS mc FROM p WHERE event_id % 3 <> 0),
jn AS (SELECT lab.*, ml, mc, coalesce(mc >= 0.7 AND ml <> wipe_type AND (wipe_type = 'RANDOM_WIPE' AND ml = 'NORMAL' OR wipe_type = 'NORMAL' AND ml <> 'NORMAL' OR wipe_type IN ('LIKELY_ZERO_WIPE', 'LIKELY_FF_WIPE') AND ml = 'NORMAL'), false) AS ov FROM lab LEFT JOIN pr USING (image_id, block_id)),
fin AS (SELECT *, ml IS NOT NULL AND wipe_type = 'NORMAL' AND entropy >= 7 AND NOT ov AS pro FROM jn),
ap AS (SELECT image_id, block_id, wipe_type AS base_label, CASE WHEN ov THEN ml WHEN pro THEN 'RANDOM_WIPE' ELSE wipe_type END AS wipe_type, CASE WHEN ov THEN mc WHEN pro THEN greatest(mc, 0.55) ELSE confidence END AS confidence, ov OR pro AS ml_override FROM fin)"""


def _applied(spark, sf_dir) -> DataFrame:
    return blocks.apply_model(_labelled(spark, sf_dir), synthetic.predictions(events(spark, sf_dir)))


@query(sql.with_(_ML, "SELECT image_id, block_id, base_label, wipe_type, round(confidence, 4) AS confidence, ml_override FROM ap"))
def ml_override_matrix(spark, sf_dir):
    return _applied(spark, sf_dir).select(*KEYS, "base_label", "wipe_type", F.round("confidence", 4).alias("confidence"), "ml_override")


@query(sql.with_(_ML, "SELECT image_id, block_id, round(greatest(mc, 0.55), 4) AS confidence FROM fin WHERE pro"))
def anomaly_rule(spark, sf_dir):
    a = _applied(spark, sf_dir).filter((F.col("base_label") == "NORMAL") & (F.col("wipe_type") == "RANDOM_WIPE") & (F.col("entropy") >= 7.0))
    p = synthetic.predictions(events(spark, sf_dir))
    fits = ~((F.col("ml_label") == "RANDOM_WIPE") & (F.col("ml_confidence") >= 0.70))
    return a.join(p, KEYS).filter(fits).select(*KEYS, F.round("confidence", 4).alias("confidence"))


@query(sql.with_(_ML, "SELECT image_id, count(*) AS blocks_analyzed, count(*) FILTER (ml_override) AS overrides, count(*) FILTER (ml_override AND base_label <> 'NORMAL' AND wipe_type = 'NORMAL') AS false_positive_reductions FROM ap GROUP BY image_id"))
def ml_summary(spark, sf_dir):
    return blocks.ml_summary(_applied(spark, sf_dir))


@query(
    sql.with_(
        sql.PLACED + ", ".join(["", *(f"v{a} AS (SELECT image_id, block_id, event_id, list_transform(range(5), lambda j: ((event_id * {a} + j * j * 7) % 10 + 1)) AS w FROM p)" for a in (3, 7, 9))])
        + ", mv AS (SELECT v3.image_id, v3.block_id, list_transform(range(1, 6), lambda j: (v3.w[j] / list_sum(v3.w) + v7.w[j] / list_sum(v7.w) + v9.w[j] / list_sum(v9.w)) / 3) AS p FROM v3 JOIN v7 USING (event_id) JOIN v9 USING (event_id))",
        "SELECT image_id, block_id, ['RANDOM_WIPE', 'NORMAL', 'ZERO_WIPE', 'FF_WIPE', 'MULTI_PASS'][list_position(list_transform(p, lambda x: round(x, 9)), round(list_max(p), 9))] AS ml_label, round(list_max(p), 6) AS ml_confidence FROM mv",
    )
)
def mean_vote(spark, sf_dir):
    v = synthetic.votes(events(spark, sf_dir))
    mean = F.transform(ml.mean_vote([F.col("rf"), F.col("et"), F.col("gb")]), lambda x: F.round(x, 9))  # equal sums of thirds are ties
    label, sure = ml.label_of(mean)
    return v.select(*KEYS, label.alias("ml_label"), r6_of(sure, "ml_confidence"))


def r6_of(c, alias: str):
    return (F.round(c, 6) + 0.0).alias(alias)


@query()
def ml_refine(spark, sf_dir):
    """A small ensemble on all candidates of the scanned image files, read again from them; trained, so without SQL."""
    folder = _folder(spark, sf_dir)
    found = _scanned(read_images(spark, folder))
    predicted = ml.predict(reread(spark, blocks.candidates(found), folder), ml.train(spark, n=120, trees=20, rounds=5, folds=0))
    return blocks.apply_model(found, predicted).groupBy("base_label", "wipe_type").agg(F.count("*").alias("blocks"))


@query(sql.with_(sql.RUNS, "SELECT image_id, fb AS first_block, lb AS last_block, n FROM runs"))
def suspicious_runs(spark, sf_dir):
    return regions.runs(_labelled(spark, sf_dir)).filter("is_suspicious").select("image_id", "first_block", "last_block", "n")


@query(sql.with_(sql.RUNS, "SELECT image_id, fb AS first_block, wipe_type AS dominant FROM runs"))
def run_dominant_type(spark, sf_dir):
    return regions.runs(_labelled(spark, sf_dir)).filter("is_suspicious").select("image_id", "first_block", "dominant")


_R = "image_id, fb AS first_block, lb AS last_block, wipe_type, block_count, n_susp, round(avg_entropy, 6) AS avg_entropy"


def _shown(r: DataFrame) -> DataFrame:
    return r.select("image_id", "first_block", "last_block", "wipe_type", "block_count", "n_susp", r6("avg_entropy"))


@query(sql.with_(sql.ABSORB, f"SELECT {_R} FROM ab"))
def absorb_noise(spark, sf_dir):
    return _shown(regions.absorb(regions.runs(_labelled(spark, sf_dir))))


@query(sql.with_(sql.ABSORB, f"SELECT {_R} FROM ab WHERE block_count >= 16"))
def size_filter(spark, sf_dir):
    return _shown(regions.sized(regions.absorb(regions.runs(_labelled(spark, sf_dir)))))


@query(sql.with_(sql.BANDS, f"SELECT {_R} FROM bd"))
def multi_pass_bands(spark, sf_dir):
    return _shown(_bands(spark, sf_dir))


@query(sql.with_(sql.SUPPRESS, f"SELECT {_R} FROM su WHERE supported"))
def suppress_fp(spark, sf_dir):
    return _shown(regions.suppress(_bands(spark, sf_dir)))


@query(sql.with_(sql.SUPPRESS, f"SELECT {_R} FROM su WHERE NOT supported"))
def suppressed_regions(spark, sf_dir):
    return _shown(regions.suppressed(_bands(spark, sf_dir)))


@query(sql.with_(sql.REGIONS, "SELECT image_id, fb AS first_block, round(confidence0, 3) AS confidence FROM sc"))
def region_confidence(spark, sf_dir):
    return regions.scored(regions.suppress(_bands(spark, sf_dir))).select("image_id", "first_block", F.round("confidence", 3).alias("confidence"))


@query(sql.with_(sql.REGIONS, "SELECT image_id, id, boundary_context, round(confidence, 3) AS confidence FROM rg"))
def boundary_context(spark, sf_dir):
    return _regions(spark, sf_dir).select("image_id", "id", "boundary_context", F.round("confidence", 3).alias("confidence"))


@query(sql.with_(sql.REGIONS, 'SELECT lab.image_id, block_id, wipe_type, id AS region_id, type AS region_type FROM rg JOIN lab ON lab.image_id = rg.image_id AND block_id * 512 BETWEEN start AND "end"'))
def region_blocks(spark, sf_dir):
    """The blocks of each region."""
    return regions.region_blocks(_labelled(spark, sf_dir).select(*KEYS, "wipe_type"), _regions(spark, sf_dir)).select(*KEYS, "wipe_type", "region_id", "region_type")


@query(sql.with_(sql.REGIONS, 'SELECT image_id, id, start, "end", size, type, round(entropy, 6) AS entropy, round(confidence, 3) AS confidence, block_count, n_susp, boundary_context FROM rg'))
def region_ids(spark, sf_dir):
    return _regions(spark, sf_dir).withColumns({"entropy": F.round("entropy", 6), "confidence": F.round("confidence", 3)})


@query(sql.with_(f"{sql.PLACED}, {sql.MAPS}", "SELECT image_id, block_id * 512 AS \"offset\", CASE WHEN last_end IS NULL THEN 'UNKNOWN' WHEN block_id * 512 > last_end THEN 'BEYOND_BOUNDARY' ELSE 'INSIDE_PARTITION' END AS context FROM p JOIN mp USING (image_id)"))
def offset_context(spark, sf_dir):
    e = events(spark, sf_dir)
    tables = synthetic.maps(e).select("image_id", "scheme", ((F.col("last_end") + 1) / 512 - 1).cast("long").alias("end_lba"))
    return partitions.offset_context(synthetic.placed(e).select("image_id", "offset"), tables)


def _tables(spark, sf_dir) -> DataFrame:
    shown = ["image_id", "scheme", "index", "start_lba", "end_lba", "sector_count", "part_type", "type_name", "is_bootable", "start_offset", "end_offset", "type_code"]
    return partitions.tables_of_blocks(synthetic.disks(events(spark, sf_dir))).filter("start_lba is not null").select(*shown)


@query(sql.with_(sql.DISKS, sql.PARTS))
def partition_entries(spark, sf_dir):
    return _tables(spark, sf_dir)


@query(sql.with_(sql.DISKS, f"{sql.PARTS} WHERE scheme = 'MBR' AND idx >= 4"))
def extended_chain(spark, sf_dir):
    return _tables(spark, sf_dir).filter("scheme = 'MBR' and index >= 4")


@query(sql.with_(sql.DISKS, f"{sql.PARTS} WHERE scheme <> 'MBR'"))
def gpt_entries(spark, sf_dir):
    return _tables(spark, sf_dir).filter("scheme <> 'MBR'")


@query(sql.with_(sql.DISKS, "SELECT 'disk' || d::VARCHAR AS image_id, scheme, partitions, last_used_lba, disk_size_lba::BIGINT AS disk_size_lba FROM mp"))
def partition_maps(spark, sf_dir):
    t = partitions.tables_of_blocks(synthetic.disks(events(spark, sf_dir)))
    return t.groupBy("image_id", "scheme").agg(F.count("start_lba").alias("partitions"), F.max("last_used_lba").alias("last_used_lba"), F.max("disk_size_lba").alias("disk_size_lba"))


@query(sql.with_(f"{sql.DISKS}, {sql.PART_ERRORS}", "SELECT 'disk' || d::VARCHAR AS image_id, coalesce(string_agg(t, '; ' ORDER BY o, i), '') AS errors FROM (SELECT DISTINCT d FROM dk) LEFT JOIN er USING (d) GROUP BY d"))
def partition_errors(spark, sf_dir):
    """What is wrong with each disk's tables."""
    t = partitions.tables_of_blocks(synthetic.disks(events(spark, sf_dir)))
    return t.select("image_id", F.array_join("errors", "; ").alias("errors")).distinct()


@query(sql.with_(f"{sql.DISKS}, pa AS ({sql.PARTS})", "SELECT 'disk' || d::VARCHAR AS image_id, s * 512 AS \"offset\", coalesce(min(\"index\"), -1) AS \"index\", arg_min(type_name, \"index\") AS type_name FROM dk LEFT JOIN pa ON pa.image_id = 'disk' || d::VARCHAR AND s * 512 BETWEEN start_offset AND end_offset GROUP BY d, s"))
def offset_partition(spark, sf_dir):
    """The partition that holds the first byte of each sector; -1 and null in gaps."""
    disks = synthetic.disks(events(spark, sf_dir))
    found = partitions.partition_of(disks.select("image_id", (F.col("block_id") * 512).alias("offset")), partitions.tables_of_blocks(disks))
    return found.withColumn("index", F.coalesce("index", F.lit(-1)))


@query(sql.with_(f"{sql.LABELLED}, {sql.BLOCKS_}", "SELECT image_id, total_blocks, suspicious_blocks, round(100 * suspicious_blocks / total_blocks, 4) AS suspicious_pct, round(avg_entropy_flagged, 6) AS avg_entropy_flagged FROM bs"))
def suspicious_stats(spark, sf_dir):
    s = scoring.block_stats(_labelled(spark, sf_dir))
    return s.select("image_id", "total_blocks", "suspicious_blocks", F.round(100 * F.col("suspicious_blocks") / F.col("total_blocks"), 4).alias("suspicious_pct"), r6("avg_entropy_flagged"))


@query(sql.with_(f"{sql.LABELLED}, {sql.BLOCKS_}, u AS (UNPIVOT bs ON COLUMNS('^n_') INTO NAME t VALUE blocks)", "SELECT image_id, substr(t, 3) AS type, blocks FROM u"))
def type_histogram(spark, sf_dir):
    return scoring.type_histogram(scoring.block_stats(_labelled(spark, sf_dir))).select("image_id", F.explode("type_counts").alias("type", "blocks"))


@query(sql.with_(sql.SCORES, "SELECT image_id, round(adjusted_density, 6) AS adjusted_density, excluded::BIGINT AS excluded_blocks FROM t3"))
def adjusted_density(spark, sf_dir):
    return _scores(spark, sf_dir).select("image_id", r6("adjusted_density"), "excluded_blocks")


@query(sql.with_(sql.SCORES, "SELECT image_id, floor_level FROM t3"))
def density_floor(spark, sf_dir):
    return _scores(spark, sf_dir).select("image_id", "floor_level")


@query(sql.with_(sql.SCORES, "SELECT image_id, round(points, 6) AS points, penalty FROM t3"))
def intent_points(spark, sf_dir):
    return _scores(spark, sf_dir).select("image_id", r6("points"), "penalty")


@query(sql.with_(sql.SCORES, "SELECT image_id, intent_score FROM t3"))
def intent_score(spark, sf_dir):
    return _scores(spark, sf_dir).select("image_id", "intent_score")


@query(sql.with_(sql.SCORES, "SELECT image_id, verdict, regions_count FROM t3"))
def verdict(spark, sf_dir):
    return _scores(spark, sf_dir).select("image_id", "verdict", "regions_count")


@query(sql.with_(sql.SCORES, "SELECT image_id, round(coverage_pct, 1) AS coverage_pct, dominant_type FROM t3"))
def coverage_dominant(spark, sf_dir):
    return _scores(spark, sf_dir).select("image_id", F.round("coverage_pct", 1).alias("coverage_pct"), "dominant_type")


@query(sql.with_(f"{sql.LABELLED}, {sql.BLOCKS_}, u AS (SELECT image_id, wipe_type, count(*) AS n FROM lab WHERE susp GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, list_position(['ZERO_WIPE', 'FF_WIPE', 'RANDOM_WIPE', 'MULTI_PASS', 'LIKELY_ZERO_WIPE', 'LIKELY_FF_WIPE', 'LOW_ENTROPY_SUSPECT'], wipe_type)) AS k FROM u)", "SELECT image_id, wipe_type AS dominant_type FROM r WHERE k = 1"))
def report_dominant(spark, sf_dir):
    return report.dominant_type(scoring.block_stats(_labelled(spark, sf_dir)))


@query(sql.with_(sql.SCORES, "SELECT image_id, largest_region_id, largest_region_size, round(avg_region_size, 3) AS avg_region_size FROM t3"))
def largest_region(spark, sf_dir):
    return _scores(spark, sf_dir).select("image_id", F.col("largest_region_id").cast("long").alias("largest_region_id"), "largest_region_size", F.round("avg_region_size", 3).alias("avg_region_size"))


@query(sql.with_(f"{sql.LABELLED}, u AS (SELECT image_id, wipe_type AS type, count(*) AS block_count FROM lab WHERE susp GROUP BY ALL)", f"SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY block_count DESC, list_position(['ZERO_WIPE', 'FF_WIPE', 'RANDOM_WIPE', 'MULTI_PASS', 'LIKELY_ZERO_WIPE', 'LIKELY_FF_WIPE', 'LOW_ENTROPY_SUSPECT'], type)) AS rank, type, block_count, {sql.TYPE_TOOLS} AS tools FROM u"))
def types_ranked(spark, sf_dir):
    return report.types_ranked(scoring.block_stats(_labelled(spark, sf_dir))).select("image_id", F.col("rank").cast("long").alias("rank"), "type", "block_count", F.concat_ws("; ", "tools").alias("tools"))


@query(sql.with_(sql.REGIONS, "SELECT image_id, id, type, '0x' || lpad(upper(to_hex(start)), 8, '0') || '-0x' || lpad(upper(to_hex(\"end\")), 8, '0') AS bounds, block_count FROM rg WHERE id <= 20"))
def top_regions(spark, sf_dir):
    return report.top_regions(_regions(spark, sf_dir)).select("image_id", "id", "type", "bounds", "block_count")


@query(sql.with_(f"{sql.LABELLED}, {sql.BLOCKS_}, ba AS (SELECT image_id, CASE WHEN \"n_MULTI_PASS\" > 0 THEN 'multi' WHEN \"n_RANDOM_WIPE\" > 0 AND \"n_ZERO_WIPE\" > 0 THEN 'random and zero' WHEN \"n_RANDOM_WIPE\" > 0 THEN 'random' WHEN \"n_ZERO_WIPE\" > 0 THEN 'zero' WHEN \"n_FF_WIPE\" > 0 THEN 'ff' ELSE 'none' END AS basis FROM bs)", f"SELECT image_id, basis, {sql.TOOLS} AS tools FROM ba"))
def tool_attribution(spark, sf_dir):
    return report.attribution(scoring.block_stats(_labelled(spark, sf_dir))).select("image_id", "basis", F.concat_ws("; ", "tools").alias("tools"))


_REL = """rl AS (SELECT *, round(suspicious_blocks / total_blocks, 4) AS d FROM t3), rf AS (SELECT image_id, (d > 0.3)::INT + ("n_RANDOM_WIPE" > 0)::INT + ("n_MULTI_PASS" > 0)::INT + (regions_count >= 3)::INT AS factors,
(d < 0.05)::INT + (avg_entropy_flagged >= 7 AND "n_RANDOM_WIPE" > 0)::INT + (verdict = 'MEDIUM' AND regions_count < 3)::INT + ("n_LIKELY_ZERO_WIPE" > "n_ZERO_WIPE")::INT AS caveats FROM rl)"""


@query(sql.with_(f"{sql.SCORES}, {_REL}", "SELECT image_id, factors, caveats, CASE WHEN factors >= 3 AND caveats <= 1 THEN 'HIGH' WHEN factors >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS reliability_level FROM rf"))
def reliability(spark, sf_dir):
    return report.reliability(_scores(spark, sf_dir)).select("image_id", F.size("factors").alias("factors"), F.size("caveats").alias("caveats"), "reliability_level")


@query(sql.with_(sql.SCORES, "SELECT image_id, CASE verdict WHEN 'HIGH' THEN 6 + (\"n_RANDOM_WIPE\" + \"n_MULTI_PASS\" > 0)::INT + (coverage_pct > 50)::INT WHEN 'MEDIUM' THEN 5 + (\"n_RANDOM_WIPE\" + \"n_MULTI_PASS\" > 0)::INT WHEN 'LOW' THEN 4 ELSE 3 END::BIGINT AS actions FROM t3"))
def actions(spark, sf_dir):
    return report.actions(_scores(spark, sf_dir)).groupBy("image_id").agg(F.count("*").alias("actions"))


@query(sql.with_(f"{sql.SCORES}, ac AS (SELECT image_id, unnest(list_concat({sql.TITLES}, CASE WHEN \"n_RANDOM_WIPE\" + \"n_MULTI_PASS\" > 0 THEN CASE verdict WHEN 'HIGH' THEN ['Wipe Tool Identification'] WHEN 'MEDIUM' THEN ['Wipe Tool Artefact Search'] ELSE [] END ELSE [] END,"
    " CASE WHEN coverage_pct > 50 AND verdict = 'HIGH' THEN ['Full-Disk Sanitisation Confirmation'] ELSE [] END, ['Evidence Hash Verification'])) AS action FROM t3)", "SELECT image_id, action FROM ac"))  # fmt: skip
def action_titles(spark, sf_dir):
    return report.actions(_scores(spark, sf_dir)).select("image_id", "action")


@query()
def report_documents(spark, sf_dir):
    model = blocks.ml_summary(_applied(spark, sf_dir)).withColumn("model_version", F.lit("injected"))
    found = _regions(spark, sf_dir)
    return report.documents(scoring.score(_labelled(spark, sf_dir), found), found, model)


_GB = "CASE WHEN n < 1024 THEN printf('%.1f B', n::DOUBLE) WHEN n < 1024 ** 2 THEN printf('%.1f KB', n / 1024) WHEN n < 1024 ** 3 THEN printf('%.1f MB', n / 1024 ** 2) WHEN n < 1024 ** 4 THEN printf('%.1f GB', n / 1024 ** 3) ELSE "


@query(
    f"WITH s AS (SELECT event_id, event_id * event_id * event_id * 4097 AS n FROM events) SELECT event_id, {_GB}printf('%.1f TB', n / 1024 ** 4) END AS gb,"
    f" {_GB}CASE WHEN n < 1024 ** 5 THEN printf('%.1f TB', n / 1024 ** 4) ELSE printf('%.1f PB', n / 1024 ** 5) END END AS tb,"
    " CASE WHEN n < 1024 THEN n::VARCHAR || ' B' WHEN n < 1048576 THEN (n // 1024)::VARCHAR || ' KB' WHEN n < 1073741824 THEN (n // 1048576)::VARCHAR || ' MB' WHEN n < 1099511627776 THEN (n // 1073741824)::VARCHAR || ' GB' ELSE (n // 1099511627776)::VARCHAR || ' TB' END AS floored, CASE WHEN n = 0 THEN '0 B' ELSE floored END AS floored0 FROM s"
)
def format_bytes(spark, sf_dir):
    k = F.col("event_id").cast("decimal(20,0)")  # cubes leave a long's range at two million events
    n = k * k * k * 4097
    return events(spark, sf_dir).select("event_id", size_text(n, "gb").alias("gb"), size_text(n, "tb").alias("tb"), size_text(n, "floor").alias("floored"), size_text(n, "floor0").alias("floored0"))


@query(sql.with_(sql.LABELLED, "SELECT image_id, block_id, CASE WHEN entropy >= 7.5 THEN 'random' WHEN entropy >= 6 THEN 'compressed or mixed' WHEN entropy <= 0.5 THEN 'fill' ELSE 'structured' END AS meaning FROM lab"))
def entropy_interpretation(spark, sf_dir):
    return _labelled(spark, sf_dir).select(*KEYS, entropy_meaning(F.col("entropy")).alias("meaning"))


@query(f"WITH {sql.ENTRIES} SELECT session_id, sequence, sha256('GENESIS|' || ts || '|' || et || '|' || sha || '|' || d) AS entry_hash FROM e")
def custody_entry_hash(spark, sf_dir):
    e = synthetic.custody_entries(events(spark, sf_dir))
    h = custody.entry_hash(F.lit(custody.GENESIS), F.col("timestamp_utc"), F.col("event_type"), F.col("sha256_evidence"), F.col("description"))
    return e.select("session_id", "sequence", h.alias("entry_hash"))


@query(f"{sql.CHAIN} SELECT session_id, sequence, prev_hash, entry_hash FROM ch")
def custody_chain_fold(spark, sf_dir):
    return custody.chained(synthetic.custody_entries(events(spark, sf_dir))).select("session_id", "sequence", "prev_hash", "entry_hash")


@query(
    f"""{sql.CHAIN}, tp AS (SELECT session_id, sequence, ts, et, sha, CASE WHEN (session_id * 20 + sequence) % 37 = 5 THEN d || '!' ELSE d END AS d,
    CASE WHEN (session_id * 20 + sequence) % 53 = 7 THEN repeat('0', 64) WHEN (session_id * 20 + sequence) % 101 IN (11, 12) THEN '' ELSE entry_hash END AS h FROM ch),
    vf AS (SELECT session_id, sequence, h, sha256('GENESIS|' || ts || '|' || et || '|' || sha || '|' || d) AS x FROM tp WHERE sequence = 0
      UNION ALL SELECT t.session_id, t.sequence, t.h, sha256(CASE WHEN vf.h = '' THEN vf.x ELSE vf.h END || '|' || t.ts || '|' || t.et || '|' || t.sha || '|' || t.d) FROM vf JOIN tp t ON t.session_id = vf.session_id AND t.sequence = vf.sequence + 1)
    SELECT session_id, count(*) AS entries, count(*) FILTER (h <> x) AS violations, count(*) FILTER (h <> x) = 0 AS is_intact FROM vf GROUP BY session_id"""
)
def custody_verify(spark, sf_dir):
    return custody.violations(synthetic.tampered(custody.chained(synthetic.custody_entries(events(spark, sf_dir)))))


@query(f"{sql.CHAIN} SELECT session_id, count(*) AS total_entries, arg_max(entry_hash, sequence) AS final_hash, sha256(string_agg(sequence || '|' || ts || '|' || et || '|' || d || '|' || entry_hash, chr(10) ORDER BY sequence)) AS events_sha256 FROM ch GROUP BY session_id")
def custody_summary(spark, sf_dir):
    s = custody.summary(custody.chained(synthetic.custody_entries(events(spark, sf_dir))))
    lines = F.transform("events", lambda e: F.concat_ws("|", e["sequence"].cast("string"), e["timestamp_utc"], e["event_type"], e["description"], e["entry_hash"]))
    return s.select("session_id", "total_entries", "final_hash", F.sha2(F.array_join(lines, "\n"), 256).alias("events_sha256"))


@query(f"{sql.CHAIN} SELECT session_id, sequence, prev_hash, entry_hash FROM ch WHERE sequence >= 12 AND session_id % 7 <> 3")
def custody_append(spark, sf_dir):
    """The last eight entries of each session, added to its chain of twelve; every seventh writer has an old end of its chain and is refused."""
    entries = synthetic.custody_entries(events(spark, sf_dir))
    log = written(custody.chained(entries.filter("sequence < 12")), "log")
    old = log.filter("sequence = 10").select("session_id", F.col("entry_hash").alias("old_hash"))
    new = entries.filter("sequence >= 12").join(custody.heads(log), "session_id").join(old, "session_id")
    new = new.withColumn("after", F.when(F.col("session_id") % 7 == 3, F.col("old_hash")).otherwise(F.col("last_hash")))
    added, _ = custody.appended(new, log)
    return added.select("session_id", "sequence", "prev_hash", "entry_hash")


@query(sql.with_(f"{sql.IMAGES}, b AS (SELECT image_id, b, sum(c)::BIGINT AS c FROM h GROUP BY ALL)", "SELECT image_id, sum(c)::BIGINT AS n_bytes, count(*) AS kinds, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy, round(coalesce(sum(c) FILTER (b = 0), 0) / sum(c), 6) AS zero_ratio FROM b GROUP BY image_id"))
def image_bytes(spark, sf_dir):
    """Statistics of all bytes of each image, from histograms that are merged."""
    return blocks.byte_statistics(_blocks(spark, sf_dir)).select("image_id", "n_bytes", "kinds", r6("entropy"), r6("zero_ratio"))


@query(sql.with_(sql.RUNS, "SELECT r1.image_id, min(block_id) AS first_block, max(block_id) AS last_block, count(*) AS n, round(sum(entropy), 6) AS sum_entropy FROM r1 WHERE susp GROUP BY r1.image_id, run"))
def sql_runs(spark, sf_dir):
    """Runs of suspicious blocks by the registered table function, in SQL."""
    register(spark)
    _labelled(spark, sf_dir).createOrReplaceTempView("tessera_labels")
    return spark.sql("SELECT image_id, first_block, last_block, n, round(sum_entropy, 6) AS sum_entropy FROM block_runs(TABLE(tessera_labels)) WHERE is_suspicious")

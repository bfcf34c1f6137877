"""Image-derived tables, tamper indicators and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landq.functions import pixels as P
from landq.functions.text import finite, round_to
from landq.operators.records import union_all
from landq.sources import rulebook as rb
from landq.sources.dictionaries import FORENSIC_DISCLAIMER, TAMPER_POINTS, inline_table

# fixed values: thresholds of the indicators
TEAR = 0.35
NOISE_Z, NOISE_FLOOR = 2.2, 40.0
ELA_LIMIT = 0.40
BLOCK_STD = 20.0
BLOCK_GAP = 49
BLOCK_DISTANCE = 100.0
BLOCK_SIGNATURE = 0.6
STROKE_PIXELS = 500
INK_SPREAD = 0.45
EDITORS = ["photoshop", "gimp", "canva", "paint.net", "imagemagick"]
RISK_SCALE = 80.0
#: Rules whose failures are hints.
HINT_RULES = (rb.DUPLICATE, rb.CHRONOLOGY)


def tile_metrics(tiles: DataFrame, rows: int = 4, cols: int = 4) -> DataFrame:
    """Quality of decoded grey tiles. ``tiles``: page_id, row, col, h, w, pixels."""
    px = F.col("pixels")
    corner = F.col("row").isin(0, rows - 1) & F.col("col").isin(0, cols - 1)
    blank = (P.pixel_mean(px) > 248.0) | (P.pixel_variance(px) < 15.0)
    measured = tiles.withColumn("_m", P.stencil_metrics(px, F.col("h"), F.col("w")))
    clean = lambda c, d: round_to(finite(c), d)
    return measured.select(
        "page_id",
        "row",
        "col",
        clean(F.col("_m.blur"), 2).alias("blur"),
        round_to(F.least(F.lit(1.0), F.sqrt(P.pixel_variance(px)) / 64.0), 3).alias("contrast"),
        round_to(P.fade_ratio(px), 3).alias("fade"),
        clean(F.col("_m.noise"), 3).alias("noise"),
        round_to(P.share_between(px, 130, 185), 3).alias("stain"),
        F.when(corner & blank, TEAR).otherwise(0.0).alias("tear"),
        finite(F.col("_m.residual")).alias("residual"),
    )


def page_quality(metrics: DataFrame, rows: int = 4, cols: int = 4) -> DataFrame:
    """page_id, quality: the tiles of a page (rows * cols of them, no more) nested as scoring reads them."""
    box = F.array(F.col("row") / rows, F.col("col") / cols, (F.col("row") + 1) / rows, (F.col("col") + 1) / cols)
    tile = F.struct(
        F.transform(box, lambda v: round_to(v, 4)).alias("bbox"), "blur", "fade", "stain", "tear"
    )
    mean = lambda c: F.avg(c).alias(c)
    grouped = metrics.groupBy("page_id").agg(
        F.array_sort(F.collect_list(tile)).alias("tile_metrics"), mean("blur"), mean("fade"), mean("stain")
    )
    return grouped.select(
        "page_id",
        F.struct(
            F.col("blur").alias("blur_score"),
            F.col("fade").alias("fade_score"),
            F.col("stain").alias("stain_coverage"),
            "tile_metrics",
        ).alias("quality"),
    )


def local_outliers(
    tiles: DataFrame, value: str, group: str, z_limit: float = NOISE_Z, floor: float | None = NOISE_FLOOR
) -> DataFrame:
    """Rows whose value stands out within their group: (v - mean) / (population std + 1e-5) > limit.

    Mean and deviation are one combinable aggregate per group, joined back; no group is gathered.
    """
    stats = tiles.groupBy(group).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    scored = tiles.join(stats, group).withColumn(
        "z_score", (F.col(value) - F.col("_mean")) / (F.col("_std") + 1e-5)
    )
    found = scored.filter(F.col("z_score") > z_limit)
    if floor is not None:
        found = found.filter(F.col(value) > floor)
    return found.select(*tiles.columns, "z_score")


def block_signatures(blocks: DataFrame) -> DataFrame:
    """page_id, i, y, x and the signature of blocks that show any structure.

    ``blocks``: page_id, i (place in scan order among all blocks), y, x, h, w, pixels.
    """
    signed = blocks.withColumn("sig", P.block_signature(F.col("pixels"), F.col("h"), F.col("w")))
    return signed.filter(F.col("sig.std") > BLOCK_STD).select(
        "page_id", "i", "y", "x", F.array("sig.mean", "sig.std", "sig.dy", "sig.dx").alias("sig")
    )


def band_pairs(items: DataFrame, key: str, position: str, gap: int = BLOCK_GAP) -> DataFrame:
    """Pairs (a, b) of one key with b.position - a.position in 1..gap.

    An equi-join on (key, stretch of gap + 1 positions): an item meets its own stretch and the next one,
    so a long page is spread over many groups.
    """
    width = gap + 1
    left = items.select(F.struct(*items.columns).alias("a"), F.col(key).alias("_k"), F.floor(F.col(position) / width).alias("_s"))
    right = (
        items.select(F.struct(*items.columns).alias("b"), F.col(key).alias("_k"), F.floor(F.col(position) / width).alias("_o"))
        .withColumn("_s", F.explode(F.array(F.col("_o"), F.col("_o") - 1)))
        .drop("_o")
    )
    step = F.col(f"b.{position}") - F.col(f"a.{position}")
    return left.join(right, ["_k", "_s"]).filter((step >= 1) & (step <= gap)).select("a", "b")


def clone_pairs(
    signatures: DataFrame,
    keep: int | None = None,
    distance: float = BLOCK_DISTANCE,
    signature: float = BLOCK_SIGNATURE,
) -> DataFrame:
    """Pairs per page of far-apart blocks with nearly equal signatures; the first ``keep`` of each page if given.

    The gap counts structured blocks only, so these are numbered first. A row limit per page is applied
    before the shuffle as well as after it.
    """
    from landq.operators.ordered import ranked

    numbered = ranked(signatures, ["page_id"], ["i"], [F.floor(F.col("i") / 100_000)], "n")
    pairs = band_pairs(numbered, "page_id", "n")
    a, b = F.col("a"), F.col("b")
    dy, dx = a["y"] - b["y"], a["x"] - b["x"]
    apart = F.sqrt(dy * dy + dx * dx)
    gap = F.sqrt(
        F.aggregate(
            F.zip_with(a["sig"], b["sig"], lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v
        )
    )
    near = (
        pairs.withColumn("signature_gap", gap)
        .filter((apart > distance) & (F.col("signature_gap") < signature))
        .select(
            F.col("a.page_id").alias("page_id"),
            F.col("a.i").alias("i"),
            F.col("b.i").alias("j"),
            round_to(1.0 - F.col("signature_gap") / 5.0, 3).alias("similarity"),
        )
    )
    if keep is None:
        return near
    w = Window.partitionBy("page_id").orderBy("i", "j")
    return near.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).drop("_rn")


def ink_dispersion(strokes: DataFrame) -> DataFrame:
    """Per page: stroke pixels, spread of red over blue, and whether several inks were used.

    ``strokes``: page_id, r, g, b, one row per pixel.
    """
    lum = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    dark = (lum < 110) & (lum > 20)
    ratio = (F.col("r") + 1.0) / (F.col("b") + 1.0)
    spread = strokes.groupBy("page_id").agg(
        F.count_if(dark).alias("stroke_pixels"), F.stddev_pop(F.when(dark, ratio)).alias("_spread")
    )
    enough = F.col("stroke_pixels") >= STROKE_PIXELS
    several = F.coalesce(enough & (F.col("_spread") > INK_SPREAD), F.lit(False))
    return spread.select(
        "page_id",
        "stroke_pixels",
        F.when(enough, round_to(F.col("_spread"), 3)).alias("ink_variance"),
        several.alias("multiple_inks"),
        F.when(several, 2).otherwise(1).alias("ink_clusters"),
    )


def has_editor_trace(metadata: Column) -> Column:
    """True when a metadata value names a graphic editor."""

    def names_editor(value: Column) -> Column:
        hit = F.lit(False)
        for tool in EDITORS:
            hit = hit | F.lower(value).contains(tool)
        return hit

    return F.exists(F.map_values(metadata), names_editor)


def _flags(df: DataFrame, flag: str | Column, severity: str | Column, score: Column) -> DataFrame:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        "document_id",
        as_col(flag).alias("flag_type"),
        as_col(severity).alias("severity"),
        score.cast("double").alias("score"),
        F.lit(FORENSIC_DISCLAIMER).alias("disclaimer"),
    )


def ela_flags(scans: DataFrame) -> DataFrame:
    """``scans``: document_id, ela_score (measured where the image was decoded)."""
    found = scans.filter(F.col("ela_score") > ELA_LIMIT)
    return _flags(found, "ela_compression_discrepancy", "warn", round_to(F.col("ela_score"), 2))


def noise_flags(outliers: DataFrame) -> DataFrame:
    worst = outliers.groupBy("document_id").agg(F.max("z_score").alias("z"))
    return _flags(worst, "texture_noise_inconsistency", "critical", F.col("z"))


def clone_flags(clones: DataFrame) -> DataFrame:
    best = clones.groupBy("document_id").agg(F.max("similarity").alias("s"))
    return _flags(best, "copy_move_cloning_hint", "warn", F.col("s"))


def ink_flags(inks: DataFrame) -> DataFrame:
    found = inks.filter("multiple_inks").groupBy("document_id").agg(F.max("ink_variance").alias("v"))
    return _flags(found, "multiple_ink_strokes_detected", "warn", F.col("v"))


def metadata_flags(scans: DataFrame) -> DataFrame:
    """``scans``: document_id, metadata (map)."""
    return _flags(
        scans.filter(has_editor_trace(F.col("metadata"))), "editing_software_metadata_hint", "warn", F.lit(0.95)
    )


def text_logic_flags(results: DataFrame) -> DataFrame:
    """Hints from failed duplicate and chronology rules, one per document and rule."""
    hints = {
        rb.DUPLICATE: ("text_logic_duplicate_registration", "critical", 0.98),
        rb.CHRONOLOGY: ("text_logic_anachronistic_dates", "warn", 0.90),
    }
    rule = F.col("rule_id")
    failed = results.filter((F.col("status") == "failed") & rule.isin(list(hints)))
    pick = lambda at: F.when(rule == rb.DUPLICATE, F.lit(hints[rb.DUPLICATE][at])).otherwise(
        F.lit(hints[rb.CHRONOLOGY][at])
    )
    # one row of fixed width for each document in the aggregation, not a text for each rule
    held = failed.groupBy("document_id").agg(*[F.max((rule == r).cast("int")).alias(f"_{at}") for at, r in enumerate(hints)])
    rules = F.array_compact(F.array(*[F.when(F.col(f"_{at}") == 1, F.lit(r)) for at, r in enumerate(hints)]))
    return _flags(held.select("document_id", F.explode(rules).alias("rule_id")), pick(0), pick(1), pick(2))


def assemble_flags(documents: DataFrame, flags: list[DataFrame]) -> DataFrame:
    """All indicators, plus one clean row for every document without any."""
    found = union_all(flags)
    clean = documents.select("document_id").join(found.select("document_id"), "document_id", "left_anti")
    return found.unionByName(_flags(clean, "clean_scan_integrity", "info", F.lit(0.05)))


def tamper_risk(flags: DataFrame) -> DataFrame:
    """document_id, points, tamper_risk_score, tamper_risk_level. The points are a constant table."""
    points = inline_table(flags.sparkSession, ["flag_type", "points"], list(TAMPER_POINTS.items()))
    scored = flags.join(F.broadcast(points), "flag_type", "left")
    total = scored.groupBy("document_id").agg(F.sum(F.coalesce("points", F.lit(0))).alias("points"))
    score = F.least(F.lit(1.0), round_to(F.col("points") / RISK_SCALE, 3))
    return total.select(
        "document_id",
        "points",
        score.alias("tamper_risk_score"),
        F.when(score >= 0.5, "high").when(score >= 0.2, "medium").otherwise("low").alias("tamper_risk_level"),
    )

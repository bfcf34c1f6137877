"""Queries over image-derived tables and tamper indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from landq.operators import forensics
from landq.plans.catalogue import legal
from landq.plans.catalogue import sqltext as q
from landq.plans.catalogue.registry import query
from landq.plans.fixtures import fx
from landq.sources import rulebook as rb
from landq.sources.dictionaries import TAMPER_POINTS
from landq.sources.readers import read_table

SIDE = 16


def tiles(spark, sf):
    """Four embeddings of 64 numbers make one 16 x 16 tile, fewer a lower one; sixteen tiles make a page of 4 x 4."""
    v = read_table(spark, sf, "embeddings").select(
        "vec_id",
        F.transform(
            "embedding",
            lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 300 + 160))).cast("int"),
        ).alias("px"),
    )
    tile = F.floor(F.col("vec_id") / 4).cast("long")
    grouped = v.groupBy(tile.alias("tile")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "px"))).alias("parts"))
    return grouped.select(
        F.floor(F.col("tile") / 16).cast("long").alias("page_id"),
        F.floor(F.col("tile") % 16 / 4).cast("int").alias("row"),
        (F.col("tile") % 4).cast("int").alias("col"),
        (F.size("parts") * 4).alias("h"),
        F.lit(SIDE).alias("w"),
        F.flatten(F.transform("parts", lambda p: p["px"])).alias("pixels"),
    )


TILES = """select cast(floor(tile / 16) as bigint) page_id, cast(floor(tile % 16 / 4) as int) "row", cast(tile % 4 as int) "col", px, n from (
      select cast(floor(vec_id / 4) as bigint) tile, flatten(list(px order by vec_id)) px, count(*) n from (
        select vec_id, list_transform(embedding, lambda x: cast(greatest(0, least(255, floor(cast(x as double) * 300 + 160))) as int)) px from embeddings) a group by 1) b"""
# cells of a tile: every second pixel (8 x 8), and all pixels
HALF = "px[(2 * (r + {dr})) * 16 + 2 * (c + {dc}) + 1]"
FULL = "px[(r + {dr}) * 16 + (c + {dc}) + 1]"
INNER8 = "(select unnest(range(1, 7)) r) a, (select unnest(range(1, 7)) c) b where r < 2 * n - 1"
INNER16 = "(select unnest(range(1, 15)) r) a, (select unnest(range(1, 15)) c) b where r < 4 * n - 1"


def _at(form: str, dr: int, dc: int) -> str:
    return form.format(dr=dr, dc=dc)


LAP = f"({_at(HALF, -1, 0)} + {_at(HALF, 1, 0)} + {_at(HALF, 0, -1)} + {_at(HALF, 0, 1)} - 4 * {_at(HALF, 0, 0)})"
BOX = "(" + " + ".join(_at(HALF, i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)) + ")"
RES = f"({_at(FULL, 0, 0)} - ({_at(FULL, -1, 0)} + {_at(FULL, 1, 0)} + {_at(FULL, 0, -1)} + {_at(FULL, 0, 1)}) / cast(4 as double))"
COUNT = lambda low, high: f"len(list_filter(px, lambda p: p between {low} and {high}))"
METRICS = f"""select t.page_id, t."row", t."col",
      case when n = 1 then cast(200 as double) else round((select var_pop(cast({LAP} as double)) from {INNER8}), 2) end blur,
      round(least(1, sqrt((select var_pop(p) from (select unnest(px) p) u)) / 64), 3) contrast,
      case when {COUNT(0, 99)} + {COUNT(150, 215)} = 0 then cast(0 as double) else round({COUNT(150, 215)} / ({COUNT(0, 99)} + {COUNT(150, 215)} + cast(0.00001 as double)), 3) end fade,
      case when n < 3 then cast(0 as double) else round(least(1, (select var_pop({_at(HALF, 0, 0)} - {BOX} / cast(9 as double)) from {INNER8}) / 150), 3) end noise,
      round({COUNT(130, 185)} / cast(len(px) as double), 3) stain,
      case when "row" in (0, 3) and "col" in (0, 3) and ((select avg(p) from (select unnest(px) p) u) > 248 or (select var_pop(p) from (select unnest(px) p) u) < 15) then cast(0.35 as double) else cast(0 as double) end tear
    from ({TILES}) t"""


@query("f1_tile_metrics", sql=METRICS)
def tile_metrics(spark, sf):
    return forensics.tile_metrics(tiles(spark, sf)).drop("residual")


RESIDUAL = f"""select page_id, "row", "col", case when n = 1 then cast(0 as double) else (select var_pop({RES}) from {INNER16}) end residual from ({TILES}) t"""


@query("f2_residual_noise", sql=f'select page_id, "row", "col", cast(round(residual * 100) as bigint) residual from ({RESIDUAL}) r')
def residual(spark, sf):
    out = forensics.tile_metrics(tiles(spark, sf)).select("page_id", "row", "col", "residual")
    return out.withColumn("residual", F.round(F.col("residual") * 100).cast("long"))


@query(
    "w5_noise_outliers",
    sql=f"""select page_id, "row", "col" from (select *, (residual - avg(residual) over w) / (stddev_pop(residual) over w + 0.00001) z from ({RESIDUAL}) r window w as (partition by page_id)) t where z > 1.2 and residual > 40""",
)
def outliers(spark, sf):
    """Pages here have 16 tiles, so the limit is lower than on the 36 tiles of a scan."""
    metrics = forensics.tile_metrics(tiles(spark, sf)).select("page_id", "row", "col", "residual")
    return forensics.local_outliers(metrics, "residual", "page_id", z_limit=1.2).select("page_id", "row", "col")


STROKES = """select l_suppkey page_id, cast(l_quantity * 3 as int) r, cast(l_tax * 500 + 40 as int) g, cast(l_discount * 1000 as int) b from {t}"""
LUM = "(cast(0.299 as double) * r + cast(0.587 as double) * g + cast(0.114 as double) * b)"


@query(
    "f3_ink_dispersion",
    sql=f"""select page_id, n stroke_pixels, spread is not null and n >= 500 and spread > cast(0.45 as double) multiple_inks from (
          select page_id, count(case when {LUM} < 110 and {LUM} > 20 then 1 end) n,
            stddev_pop(case when {LUM} < 110 and {LUM} > 20 then (r + cast(1 as double)) / (b + 1) end) spread from ({STROKES.replace("{t}", "lineitem")}) s group by page_id) t""",
)
def ink(spark, sf):
    strokes = spark.sql(STROKES, t=read_table(spark, sf, "lineitem"))
    return forensics.ink_dispersion(strokes).select("page_id", "stroke_pixels", "multiple_inks")


def blocks(spark, sf):
    """Each embedding as an 8 x 8 block on the page of its label."""
    return read_table(spark, sf, "embeddings").select(
        F.col("label").cast("long").alias("page_id"),
        F.col("vec_id").alias("i"),
        (F.floor(F.col("vec_id") / 20) * 16).cast("long").alias("y"),
        (F.col("vec_id") % 20 * 16).alias("x"),
        F.lit(8).alias("h"),
        F.lit(8).alias("w"),
        F.transform(
            "embedding",
            lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 400 + 128))).cast("int"),
        ).alias("pixels"),
    )


BLOCKS = """select cast(label as bigint) page_id, vec_id i, cast(floor(vec_id / 20) * 16 as bigint) y, vec_id % 20 * 16 x,
      list_transform(embedding, lambda v: cast(greatest(0, least(255, floor(cast(v as double) * 400 + 128))) as int)) px from embeddings"""
SIGS = f"""select page_id, i, y, x, (select avg(p) from (select unnest(px) p) u) m, (select stddev_pop(p) from (select unnest(px) p) u) s,
      (select avg(abs(px[r * 8 + c + 1] - px[(r - 1) * 8 + c + 1])) from (select unnest(range(1, 8)) r) a, (select unnest(range(0, 8)) c) b) dy,
      (select avg(abs(px[r * 8 + c + 1] - px[r * 8 + c])) from (select unnest(range(0, 8)) r) a, (select unnest(range(1, 8)) c) b) dx from ({BLOCKS}) k"""


@query("f4_block_signatures", sql=f"select page_id, i, cast(round(m * 1000) as bigint) mean, cast(round(s * 1000) as bigint) std, cast(round(dy * 1000) as bigint) dy, cast(round(dx * 1000) as bigint) dx from ({SIGS}) t where s > 20")
def signatures(spark, sf):
    out = forensics.block_signatures(blocks(spark, sf))
    named = {n: F.round(F.get("sig", F.lit(at)) * 1000).cast("long") for at, n in enumerate(("mean", "std", "dy", "dx"))}
    return out.select("page_id", "i", *[c.alias(n) for n, c in named.items()])


@query(
    "w6_clone_pairs",
    sql=f"""with s as (select *, row_number() over (partition by page_id order by i) n from ({SIGS}) t where s > 20)
        select page_id, i, j from (select a.page_id, a.i, b.i j, row_number() over (partition by a.page_id order by a.i, b.i) rn from s a join s b on a.page_id = b.page_id and b.n - a.n between 1 and 49
          where sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) > 100
            and sqrt((a.m - b.m) * (a.m - b.m) + (a.s - b.s) * (a.s - b.s) + (a.dy - b.dy) * (a.dy - b.dy) + (a.dx - b.dx) * (a.dx - b.dx)) < 2.5) p where rn <= 3""",
)
def clones(spark, sf):
    """The blocks here are noise, so a wider signature distance is used to have pairs at all."""
    out = forensics.clone_pairs(forensics.block_signatures(blocks(spark, sf)), keep=3, signature=2.5)
    return out.select("page_id", "i", "j")


@query(
    "w6_all_clone_pairs",
    sql=f"""with s as (select *, row_number() over (partition by page_id order by i) n from ({SIGS}) t where s > 20)
        select a.page_id, a.i, b.i j from s a join s b on a.page_id = b.page_id and b.n - a.n between 1 and 49
          where sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) > 100
            and sqrt((a.m - b.m) * (a.m - b.m) + (a.s - b.s) * (a.s - b.s) + (a.dy - b.dy) * (a.dy - b.dy) + (a.dx - b.dx) * (a.dx - b.dx)) < 2.5""",
)
def all_clones(spark, sf):
    out = forensics.clone_pairs(forensics.block_signatures(blocks(spark, sf)), signature=2.5)
    return out.select("page_id", "i", "j")


@query(
    "w6_band_pairs",
    sql="select a.vec_id i, b.vec_id j from embeddings a join embeddings b on a.label = b.label and b.vec_id - a.vec_id between 1 and 49",
)
def band(spark, sf):
    items = read_table(spark, sf, "embeddings").select("label", "vec_id")
    out = forensics.band_pairs(items, "label", "vec_id")
    return out.select(F.col("a.vec_id").alias("i"), F.col("b.vec_id").alias("j"))


SOFTWARE = "split_part('GIMP 2.10|flatbed|Adobe Photoshop CC|Paint.NET 4|none|ImageMagick 7|Canvas pro', '|', cast(p_partkey % 7 + 1 as int))"


@query(
    "p27_editor_trace",
    sql=f"""select p_partkey from (select p_partkey, lower({SOFTWARE}) s, lower(p_name) n from part) t
        where s like '%photoshop%' or s like '%gimp%' or s like '%canva%' or s like '%paint.net%' or s like '%imagemagick%'
          or n like '%photoshop%' or n like '%gimp%' or n like '%canva%' or n like '%paint.net%' or n like '%imagemagick%'""",
)
def editor_trace(spark, sf):
    meta = F.create_map(F.lit("software"), F.expr(SOFTWARE), F.lit("title"), F.col("p_name"))
    return read_table(spark, sf, "part").filter(forensics.has_editor_trace(meta)).select("p_partkey")


HINTS = f"""select distinct document_id, case rule_id when '{rb.DUPLICATE}' then 'text_logic_duplicate_registration' else 'text_logic_anachronistic_dates' end flag_type,
      case rule_id when '{rb.DUPLICATE}' then 'critical' else 'warn' end severity from ({legal.RESULTS}) r where status = 'failed' and rule_id in ('{rb.DUPLICATE}', '{rb.CHRONOLOGY}')"""


def text_hints(spark, sf):
    return forensics.text_logic_flags(legal.all_results(spark, sf, legal.BOOK.only(*forensics.HINT_RULES)))


@query("f5_text_logic_hints", legal.INPUTS, HINTS)
def hints(spark, sf):
    return text_hints(spark, sf).select("document_id", "flag_type", "severity")


SCANS = "select o_orderkey document_id, cast(o_orderkey % 50 as double) / 100 ela_score, split_part('GIMP|scanner|camera', '|', cast(o_orderkey % 3 + 1 as int)) software from {t}"
RAW_FLAGS = f"""select document_id, flag_type, severity from ({HINTS}) h
    union all select document_id, 'ela_compression_discrepancy', 'warn' from ({SCANS.replace("{t}", "orders")}) s where ela_score > cast(0.4 as double)
    union all select document_id, 'editing_software_metadata_hint', 'warn' from ({SCANS.replace("{t}", "orders")}) s where software = 'GIMP'"""
ALL_FLAGS = f"""{RAW_FLAGS} union all select document_id, 'clean_scan_integrity', 'info' from fx_records where document_id not in (select document_id from ({RAW_FLAGS}) f)"""


def flags(spark, sf):
    scans = spark.sql(SCANS, t=read_table(spark, sf, "orders")).withColumn(
        "metadata", F.create_map(F.lit("software"), F.col("software"))
    )
    found = [
        text_hints(spark, sf),
        forensics.ela_flags(scans),
        forensics.metadata_flags(scans),
    ]
    return forensics.assemble_flags(fx(spark, sf, "fx_records"), found)


@query("f6_flag_assembly", legal.INPUTS, ALL_FLAGS)
def assembled(spark, sf):
    return flags(spark, sf).select("document_id", "flag_type", "severity")


POINTS = q.rows(["ft", "pts"], list(TAMPER_POINTS.items()))


@query(
    "a10_tamper_risk",
    legal.INPUTS,
    f"""select document_id, points, score tamper_risk_score, case when score >= cast(0.5 as double) then 'high' when score >= cast(0.2 as double) then 'medium' else 'low' end tamper_risk_level
        from (select document_id, points, least(cast(1 as double), {q.rounded("(points / cast(80 as double))", 3)}) score from (
          select document_id, cast(sum(coalesce(pts, 0)) as bigint) points from ({ALL_FLAGS}) f left join (select * from {POINTS}) p on p.ft = f.flag_type group by document_id) a) b""",
)
def risk(spark, sf):
    return forensics.tamper_risk(flags(spark, sf))
